"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ferrywork.llm import annindex, bpe, capfilters, convtrie, extract, langid, packing, pii, prefixhash, simhash, spelling, substring, urlfilter
from ferrywork.llm.frames import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op8_simhash_pivots")
def op8_simhash_pivots(spark, sf_dir):
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


@query("op4_sum_of_squares_packing")
def op4_sum_of_squares_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op5_distinct_word_bpe")
def op5_distinct_word_bpe(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks), ranks)
    return found.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


OP2_SQL = r"""
WITH w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), g AS (
    SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS window_text
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 11, 1))) AS i FROM w)
), f AS (
    SELECT window_text, min(doc_id) AS first FROM g GROUP BY window_text
), r AS (
    SELECT doc_id, list(DISTINCT p) AS gone FROM (
        SELECT g.doc_id, unnest(range(g.i, g.i + 13)) AS p FROM g JOIN f USING (window_text) WHERE f.first < g.doc_id) GROUP BY doc_id
), k AS (
    SELECT w.doc_id, ws, list_filter(range(1, len(ws) + 1), lambda p: gone IS NULL OR NOT list_contains(gone, p)) AS kept FROM w LEFT JOIN r USING (doc_id)
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - len(kept) AS BIGINT) AS n_removed,
    sha256(array_to_string(list_transform(kept, lambda p: ws[p]), ' ')) AS kept_sha256 FROM k
"""


@query("op2_suffix_automata", OP2_SQL)
def op2_suffix_automata(spark, sf_dir):
    found = substring.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op7_weak_supervision_pii")
def op7_weak_supervision_pii(spark, sf_dir):
    found = pii.pii_report(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


@query("op1_multi_index_hashing")
def op1_multi_index_hashing(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return annindex.search(vectors, vectors.where("vec_id % 20 = 0"))


@query("op3_cap_filters")
def op3_cap_filters(spark, sf_dir):
    return capfilters.cap_filter_links(table(spark, sf_dir, "embeddings"))


@query("op10_crf_language")
def op10_crf_language(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


RULES = [
    urlfilter.Rule("net", "/", "block"),
    urlfilter.Rule("example.net", "/en/", "allow"),
    urlfilter.Rule("example.com", "/de/", "block"),
    urlfilter.Rule("org", "/fr/", "allow"),
]


@query("op6_boosted_urls")
def op6_boosted_urls(spark, sf_dir):
    judged = urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op9_neighbour_differencing")
def op9_neighbour_differencing(spark, sf_dir):
    found = extract.main_text(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


# CRC-32 of the characters' codes in the list {0}, bit by bit; 3988292384 is its polynomial.
CRC32_SQL = (
    "xor(list_reduce([4294967295] || {0}, lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], "
    "lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
)
OP13_SQL = r"""
WITH turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || x)) AS place,
        {'role': r, 'text': x} AS item, len(regexp_extract_all(x, '[^ 	-
]+')) AS words
    FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
    SELECT conv_id, CRC % 4 AS h FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL)
), rebuilt AS (
    SELECT conv_id, 1 AS part, place, item, words FROM turns JOIN convs USING (conv_id) WHERE conv_id % 20 = 0 OR place > h
    UNION ALL
    SELECT c.conv_id, 0, t.place, t.item, t.words FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 WHERE c.conv_id % 20 <> 0 AND t.place <= c.h
), steps AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth, item, words FROM rebuilt
), whole AS (
    SELECT c.conv_id, coalesce(list(item ORDER BY depth) FILTER (depth IS NOT NULL), []) AS items FROM convs c LEFT JOIN steps USING (conv_id) GROUP BY c.conv_id
), prefixes AS (
    SELECT conv_id, depth, len(items) AS total, items[1:depth] AS prefix FROM (SELECT conv_id, items, unnest(range(0, len(items) + 1)) AS depth FROM whole)
), named AS (
    SELECT conv_id, depth, total, min(conv_id) OVER (PARTITION BY depth, prefix) AS node FROM prefixes
), nodes AS (
    SELECT node, depth, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (total = depth), '') AS ends
    FROM named GROUP BY node, depth
), saved AS (
    SELECT n.node, n.depth, (n_convs - 1) * coalesce(s.words, 0) AS tokens FROM nodes n LEFT JOIN steps s ON s.conv_id = n.node AND s.depth = n.depth
), above AS (
    SELECT a.node, a.depth, b.node AS up, b.depth AS up_depth, c.tokens FROM nodes a JOIN named b ON b.conv_id = a.node AND b.depth <= a.depth
    JOIN saved c ON c.node = a.node AND c.depth = a.depth
), inner_nodes AS (
    SELECT up AS node, up_depth AS depth, count(*) AS n_children FROM above WHERE up_depth = depth - 1 GROUP BY up, up_depth
), sums AS (
    SELECT a.up AS node, a.up_depth AS depth, sum(a.tokens) AS saved_tokens, count(*) FILTER (i.node IS NULL) AS n_leaves
    FROM above a LEFT JOIN inner_nodes i ON i.node = a.node AND i.depth = a.depth GROUP BY a.up, a.up_depth
)
SELECT n.node AS conv_id, n.depth, p.up AS parent_conv_id, n.n_convs, coalesce(i.n_children, 0) AS n_children, s.n_leaves,
    CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums s USING (node, depth) LEFT JOIN inner_nodes i USING (node, depth)
LEFT JOIN above p ON p.node = n.node AND p.depth = n.depth AND p.up_depth = n.depth - 1
""".replace("CRC", CRC32_SQL.format("list_transform(range(1, length(s) + 1), lambda i: ascii(s[i]))"))


@query("op13_truncation_peeling", OP13_SQL)
def op13_truncation_peeling(spark, sf_dir):
    return convtrie.spliced_trie(table(spark, sf_dir, "conversations"))


OP11_SQL = r"""
WITH RECURSIVE runs AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), each AS (
    SELECT run, length(run) AS size, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS bytes, count(*) AS n FROM runs GROUP BY doc_id, run
), coded AS (
    SELECT run, size, n, CRC AS h FROM each
), words AS (
    SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN left(run, CAST(h % size AS INT)) || substr(run, CAST(h % size AS INT) + 2) ELSE run END AS word FROM coded)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), less AS (
    SELECT word, n, k, left(word, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, n, CAST(unnest(range(1, length(word) + 1)) AS INT) AS k FROM words)
), near AS (
    SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), ranked AS (
    SELECT word, n, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place FROM near
), forms AS (
    SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
    FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1
), chain AS (
    SELECT word, word AS at, form AS ahead FROM forms
    UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.ahead
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.ahead IS NULL
""".replace("CRC", CRC32_SQL.format("list_transform(range(1, length(bytes) // 2 + 1), lambda i: CAST('0x' || bytes[2 * i - 1 : 2 * i] AS BIGINT))"))


@query("op11_pivotal_grams", OP11_SQL)
def op11_pivotal_grams(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query("op12_prefix_hashes")
def op12_prefix_hashes(spark, sf_dir):
    return prefixhash.edited_neighbours(table(spark, sf_dir, "documents"))
