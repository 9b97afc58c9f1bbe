"""The corpus operators against brute force on small tables, with nulls, empty and repeated rows and clashing names."""

import base64
import hashlib
import html
import re

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ferrywork.llm import annindex, bpe, capfilters, extract, langid, packing, pii, simhash, substring, urlfilter
from ferrywork.llm.components import Forest, components
from ferrywork.llm.queries import QUERIES, RULES
from ferrywork.llm.textcodes import distinct_pretokens

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, row string, spans string, n_words int, score string"
PHRASE = " ".join(f"w{k}" for k in range(20))
ODD = [
    (1, None, "en", "a", "s", 1, "x"),
    (2, "", "en", "b", "s", 1, "x"),
    (3, f"one {PHRASE} two", "en", "c", None, 1, "x"),
    (4, f"zwei {PHRASE} drei", "de", None, "s", None, "x"),
    (4, f"zwei {PHRASE} drei", "de", None, "s", None, "x"),
    (5, " \t\n", None, "e", "s", 1, None),
    (None, f"none {PHRASE}", "de", "f", "s", 1, "x"),
    (6, "long " * 30_000 + "me@site.org", "en", "g", "s", 1, "x"),
    (7, "Ünïcode 😀 text\u3000with 9 parts", "fr", "h", "s", 1, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_pretokens_follow_the_pattern():
    rng = np.random.default_rng(2)
    signs = ["a", "b", "s", "re", "'", "'ll", " ", "  ", "\n", "1", "!", "é", "\u3000", "漢", "²", "😀", "\u0301", "_"]
    pattern = regex.compile(public_tokenizers.PATTERN)
    for _ in range(500):
        texts = ["".join(rng.choice(signs, rng.integers(0, 12))) for _ in range(3)]
        words, number, first = distinct_pretokens(texts)
        assert [[words[k] for k in number[first[j] : first[j + 1]]] for j in range(3)] == [pattern.findall(t) for t in texts]


def test_words_of_equal_hash_are_told_apart(spark):
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [word, f"{other} {word}", other, word]
    words, number, first = distinct_pretokens(texts)
    assert [[words[k] for k in number[first[j] : first[j + 1]]] for j in range(4)] == [[word], [other, f" {word}"], [other], [word]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    found: dict[int, list] = {}
    for p in sorted(packing.pack(rows, path).collect(), key=lambda p: (p.doc_id, p.start)):
        found.setdefault(p.doc_id, []).extend(np.frombuffer(p.ids, dtype="<u4").tolist())
    assert found == {k: tokenizer.encode(t, add_special_tokens=False).ids + [1] for k, t in enumerate(texts)}
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(bpe.encode(rows, path), path).collect()} == dict(enumerate(texts))


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(900, k) for k in range(400, 480)] + [(5, 5), (None, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "x long, y long")).collect()}
    forest = Forest()
    for a, b in pairs:
        if a is not None and a != b:
            forest.join(a, b)
    assert found == {x: forest.root(x) for x in forest.parent}


def fingerprint(text, size):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op8(spark, docs, documents):
    rows = documents + [(r[0], r[1], None) for r in ODD[:5]]
    rows = [(k, t) for k, (_, t, _) in enumerate(rows)]
    found = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("hex", simhash.hex_fingerprint()).collect()
    prints = [fingerprint(t, 4) for _, t in rows]
    forest = Forest()
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                forest.join(a, b)
    assert {(r.doc_id, r.hex, r.component_id) for r in found} == {(k, f"{prints[k]:016x}", forest.root(k)) for k, _ in rows}
    assert simhash.simhash_components(docs).count() == len(ODD)
    assert simhash.simhash_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("dense", [4096, 3])
def test_links_of_crowds(spark, dense, monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = np.random.default_rng(0)
    points = set()
    for centre in rng.integers(0, 2**63, 6):
        for _ in range(30):
            x = int(centre)
            for bit in rng.integers(0, 63, rng.integers(0, 7)):
                x ^= 1 << int(bit)
            points.add(x)
    points = sorted(points)
    got, want = Forest(), Forest()
    for r in simhash.links(spark.createDataFrame([(p,) for p in points], "fp long")).collect():
        got.join(r.a, r.b)
    for a in points:
        for b in points:
            if a < b and (a ^ b).bit_count() <= 4:
                want.join(a, b)
    assert [got.root(p) for p in points] == [want.root(p) for p in points]


def brute_windows(rows, size=13):
    first, out = {}, []
    for doc, text in rows:
        words = (text or "").encode().split()
        for k in range(len(words) - size + 1):
            if doc is not None:
                w = tuple(words[k : k + size])
                first[w] = min(first.get(w, doc), doc)
    for doc, text in rows:
        words, gone = (text or "").encode().split(), set()
        for k in range(len(words) - size + 1):
            if doc is not None and first[tuple(words[k : k + size])] < doc:
                gone.update(range(k, k + size))
        out.append((doc, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return out


@pytest.mark.parametrize("hot", [substring.HOT, 1])
def test_op2(spark, docs, documents, hot):
    rows = [(r[0], r[1]) for r in ODD]
    found = substring.substring_dedup(docs, hot=hot)
    assert found.columns == ["doc_id", "text", "lang", "row", "spans", "score", "n_words", "n_removed"]
    got = [(r.doc_id, r.n_words, r.n_removed, r.text or "") for r in found.collect()]
    assert sorted(got, key=str) == sorted(brute_windows(rows), key=str)
    rows = [(d, t) for d, t, _ in documents]
    found = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.text or "") for r in found.collect()) == sorted(brute_windows(rows))
    assert substring.substring_dedup(docs.limit(0)).count() == 0


def test_automaton_matches_all_substrings():
    rng = np.random.default_rng(4)
    for _ in range(60):
        texts = [[bytes([65 + x]) for x in rng.integers(0, 3, rng.integers(1, 12))] for _ in range(4)]
        automaton = substring.Automaton()
        for t in texts[:3]:
            automaton.add(t)
        windows = {tuple(t[k : k + 3]) for t in texts[:3] for k in range(len(t) - 2)}
        assert automaton.matched(texts[3], 3).tolist() == [k >= 2 and tuple(texts[3][k - 2 : k + 1]) in windows for k in range(len(texts[3]))]


def unit(x):
    return x / np.linalg.norm(x)


def test_op1(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 16)) * rng.uniform(0.5, 2, (600, 1))
    rows = [(k, [float(v) for v in x[k]]) for k in range(600)]
    odd = [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [None] * 16), (None, rows[0][1]), (704, rows[5][1]), (5, rows[5][1])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    found = annindex.search(table, table.where("vec_id % 20 = 0"), k=20).collect()
    ids, vectors = [*range(600), 704], np.vstack([x, x[5:6]])
    hits = 0
    for q in range(0, 600, 20):
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21)) and all(abs(r.score - x[q] @ vectors[ids.index(r.vec_id)]) < 1e-9 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own) and q not in {r.vec_id for r in own}
        best = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-(x[q] @ vectors[i]), ids[i]))[:20]
        hits += len({ids[i] for i in best} & {r.vec_id for r in own})
    assert hits / (30 * 20) >= 0.9 and {r.query_id for r in found} == set(range(0, 600, 20))
    few = table.where("vec_id < 5")
    assert annindex.search(few, few.where("vec_id = 0")).count() == 4
    assert annindex.search(table.limit(0), table.limit(0)).count() == 0


def test_op3(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((40, 16))
    x = [unit(base[k % 40] + 0.08 * rng.standard_normal(16)) for k in range(240)]
    rows = [(k, [float(v) for v in x[k]], k % 3 if k % 17 else None) for k in range(240)]
    rows += [(300, rows[4][1], 1), (301, None, 1), (302, [0.0] * 16, 1), (303, [float("inf")] * 16, 1), (304, rows[4][1][:8], 1), (300, rows[4][1], 1)]
    found = capfilters.cap_filter_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    vectors = {r[0]: (np.array(r[1]), r[2]) for r in rows if r[0] < 301 and r[2] is not None}
    close = {a: {b for b, (w, m) in vectors.items() if b != a and m == l and unit(v) @ unit(w) >= 0.93} for a, (v, l) in vectors.items()}
    forest = Forest()
    for a, others in close.items():
        for b in others:
            forest.join(a, b)
    assert len(found) == len(rows)
    wanted = {r[0]: (len(close.get(r[0], ())), forest.root(r[0])) for r in rows}
    assert sum(wanted[r.vec_id] != (r.n_links, r.component_id) for r in found) <= 2
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_op4(spark, docs, documents):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    rows = [(k, t) for k, (_, t, _) in enumerate(documents)] + [(9000 + k, r[1]) for k, r in enumerate(ODD)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for doc, text in rows:
        own = sorted(by_doc[doc], key=lambda p: p.start)
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        assert b"".join(bytes(p.ids) for p in own) == ids.tobytes() and {p.doc_tokens for p in own} == {len(ids)}
        assert [p.start for p in own] == np.cumsum([0, *[p.length for p in own]])[:-1].tolist()
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *[p.length for p in own]])[:-1].tolist()
        total = sum(p.length for p in own)
        assert total <= 2048 and total & (total - 1) == 0
    assert packing.pack(docs, path).select("doc_id").distinct().count() == 8
    assert packing.pack(docs.limit(0), path).count() == 0


def test_level_choice_is_the_least_sum_of_squares():
    rng = np.random.default_rng(8)
    packer = packing.Packer(window=16)
    for size in rng.integers(1, 16, 300).tolist():
        before = packer.count.copy()
        sums = {}
        for level in range(17 - size):
            if level and not before[level]:
                continue
            after = before.copy()
            after[level] -= level > 0
            after[level + size] += 1
            sums[level] = int((after[:16] ** 2).sum())
        assert sums[packer.level_for(size)] == min(sums.values())
        list(packer.add(0, np.zeros(size, np.uint32)))


def test_op5(spark, docs, documents):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(k, t) for k, (_, t, _) in enumerate(documents)] + [(9000 + k, r[1]) for k, r in enumerate(ODD)]
    found = bpe.decode(bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), path, bucket_bytes=100_000), path).collect()
    want = {k: (np.array(library.encode_ordinary(t or ""), dtype="<u4").tobytes(), (t or "").encode()) for k, t in rows}
    assert {r.doc_id: (bytes(r.ids), bytes(r.decoded)) for r in found} == want and len(found) == len(rows)
    assert bpe.encode(docs.limit(0), path).count() == 0


def test_op6(spark):
    urls = [None, "", "no scheme", "HTTP://Www.Example.NET/en/a?b=1", "http://example.net/EN/", "http://a.example.com/de/x#y", "http://b.org?q", "x://org/fr/", "http://badexample.net/en/", "http://Ünet/"]
    pages = spark.createDataFrame([(k, u, "mine") for k, u in enumerate(urls)] + [(3, urls[3], "mine")], "page_id long, url string, host string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, RULES).collect()}
    assert [found[k][:3] for k in range(10)] == [
        ("", "", None), ("", "", None), ("", "", None), ("www.example.net", "/en/a", "example.net/en/"), ("example.net", "/EN/", "net/"),
        ("a.example.com", "/de/x", "example.com/de/"), ("b.org", "", None), ("org", "/fr/", "org/fr/"), ("badexample.net", "/en/", "net/"), ("Ünet", "/", None),
    ]
    assert {v[3] for v in found.values()} <= {"allow", "block"}
    assert urlfilter.judge(pages.limit(0), RULES).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, hit):
    digits = [int(c) for c in hit if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_op7(spark, docs):
    rng = np.random.default_rng(9)
    signs = ["a", "1", "23", "4.5", ".", "@", "-", " ", "+", "b.c", "é", "(", "4111 1111 1111 1111", "_", "😀", "+1 (555) 123", "1.2.3.4", "x@y.z", "\n"]
    rows = [(k, "".join(rng.choice(signs, rng.integers(0, 14)))) for k in range(400)] + [(900 + k, r[1]) for k, r in enumerate(ODD)]
    rows += [(950, "a." * 50_000), (951, "1" * 100_000), (952, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x')]
    for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if r.doc_id == 950:
            assert r.base == ""
            continue
        text = dict(rows)[r.doc_id] or ""
        want = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if valid(k, m.group())]
        assert r.base == ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[0] == k for w in want) for k in BASE]
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
    done = pii.redact(docs)
    assert done.columns == docs.columns and done.count() == len(ODD)
    assert done.where("doc_id = 6").first().text == "long " * 30_000 + "[EMAIL]"
    assert pii.pii_report(docs.limit(0)).count() == 0


def test_vote_estimates_prefer_agreement():
    counts = [("secret", (1, 1, 1, -1), 50), ("secret", (0, -1, 0, 0), 60), ("secret", (1, -1, 1, -1), 5), ("secret", (0, 1, 0, 0), 4)]
    found = pii.estimate(counts)
    assert found["secret", (1, 1, 1, -1)] > 0.9 > 0.5 > found["secret", (0, -1, 0, 0)]


def test_op9(spark):
    found = QUERIES["op9_neighbour_differencing"](spark, SF).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in found:
        body = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        lines = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1|br)>", body)]
        assert r.text == "\n".join(filter(None, lines)) and r.n_chars == len(r.text)
    site = "<div>Top of site</div><div>{}</div><div>All rights reserved</div>"
    rows = [(k, f"http://h.org/{k}", site.format(f"body {k}")) for k in range(4)] + [(9, None, None), (10, "http://x.org/", "")]
    rows += [(11, "http://y.org/", "<article><p>a &amp; b<script>1<2</script></p><div class='comments'><p>hi</p></div></article>")]
    texts = {r.page_id: r.text for r in extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert texts[9] == texts[10] == "" and texts[11] == "a & b"
    assert sum(texts[k] == f"body {k}" for k in range(4)) >= 2
    left, right = extract.common(list("abcbdab"), list("bdcaba"))
    assert len(left) == len(right) == 4


def test_op10(spark, docs):
    found = QUERIES["op10_crf_language"](spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.9 and all(0 <= r.score <= 1 for r in rows)
    odd = {(r.doc_id, r.lang_pred) for r in langid.identify(docs).collect()}
    assert {(1, "und"), (2, "und"), (5, "und")} <= odd
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


def test_crf_follows_switches(documents):
    known = [(t, lang) for _, t, lang in documents if t and lang in ("en", "de")][:60]
    field = langid.train([t for t, _ in known], [lang for _, lang in known])
    import pyarrow as pa

    english = next(t for t, lang in known if lang == "en" and len(t.split()) > 60).split()[:60]
    german = next(t for t, lang in known if lang == "de" and len(t.split()) > 60).split()[:60]
    _, _, marginal = langid.tag(field, pa.array([" ".join(english + german)]))
    best = marginal.argmax(axis=1)
    assert np.mean(best[:60] == field.labels.index("en")) > 0.8 and np.mean(best[60:] == field.labels.index("de")) > 0.8


def test_forward_backward_is_exact():
    rng = np.random.default_rng(3)
    scores, moves, starts = rng.standard_normal((150, 3)), rng.standard_normal((3, 3)), rng.standard_normal(3)
    first = np.array([0, 130, 130, 150])
    marginal = langid.forward_backward(scores, first, moves, starts)[0]
    for a, b in ((0, 130), (130, 150)):
        forward = [np.exp(starts + scores[a])]
        for t in range(a + 1, b):
            now = forward[-1] @ np.exp(moves) * np.exp(scores[t])
            forward.append(now / now.sum())
        backward = [np.ones(3)]
        for t in range(b - 1, a, -1):
            now = np.exp(moves) @ (np.exp(scores[t]) * backward[-1])
            backward.append(now / now.sum())
        want = np.array(forward) * np.array(backward[::-1])
        assert np.allclose(marginal[a:b], want / want.sum(axis=1, keepdims=True))


def test_pipeline(spark):
    import corpus_pipeline

    documents = spark.read.parquet(f"{SF}/documents.parquet")
    now, counts = documents, []
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, SF)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}"
        now.write.mode("overwrite").parquet(path)
        now = spark.read.parquet(path)
        counts.append(now.count())
        if name != "packing":
            assert now.columns == documents.columns
        if name == "simhash_near_dedup":
            rows = [(r.doc_id, fingerprint(r.text, 5)) for r in before.select("doc_id", "text").collect()]
            forest = Forest()
            for i, (a, x) in enumerate(rows):
                forest.join(a, a)
                for b, y in rows[:i]:
                    if (x ^ y).bit_count() <= 4:
                        forest.join(a, b)
            assert {r.doc_id for r in now.select("doc_id").collect()} == {a for a, _ in rows if forest.root(a) == a}
        if name == "substring_dedup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert {(r.doc_id, r.text) for r in now.collect()} == {(d, t) for d, _, _, t in brute_windows(rows)}
    assert counts[0] >= 0.95 * documents.count() and corpus_pipeline.ORACLE_SQL is None


def test_digests(spark):
    found = QUERIES["op2_suffix_automata"](spark, SF).where("n_words = 0").select("kept_sha256").distinct().collect()
    assert all(r[0] == hashlib.sha256(b"").hexdigest() for r in found)
    assert spark.range(1).select(F.lit(1)).count() == 1
