"""Operators 11 to 13 and the SQL of the corpus queries: brute force on small tables, odd rows, clashing names."""

import hashlib
import os
import re
import sys
import time
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from oracle import compare, connect

from ferrywork.llm import convtrie, extract, pii, prefixhash, spelling, substring, urlfilter
from ferrywork.llm.queries import QUERIES, RULES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_its_sql(spark, key):
    assert compare(QUERIES[key](spark, SF), connect(SF), SQL[key]) == []


def brute_trie(sequences):
    """Node rows of {conv_id: [(role, text), ...]}."""
    members = {}
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    children = {p: [q for q in members if len(q) == len(p) + 1 and q[:-1] == p] for p in members}

    def subtree(p):
        words = len(p[-1][1].translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")) - (" " + p[-1][1]).translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ").count("") + 1 if p else 0
        leaves, saved = (0, (len(members[p]) - 1) * words) if children[p] else (1, (len(members[p]) - 1) * words)
        for q in children[p]:
            a, b = subtree(q)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = []
    for p, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(sequences[c]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(own), len(p), parent, len(own), len(children[p]), *subtree(p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def brute_spliced(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h, rest = zlib.crc32(str(c).encode()) % 4, int(np.fmod(c, 20))
        out[c] = own.get(c - rest, [])[:h] + turns[h:]
    return out


CONVERSATIONS = [
    (0, 0, "user", "hello  there\tyou"), (0, 1, "assistant", "hi"), (0, None, "system", "be kind"), (0, 2, "user", "bye now"),
    (1, 0, "user", "x"), (2, 0, "user", None), (2, 1, None, "a b"), (3, 0, "user", "hello  there\tyou"), (3, 1, "assistant", "hi"), (3, 5, "user", "z"),
    (4, 1, "user", "one"), (4, 2, "a", "two"), (4, 3, "a", "three"), (4, 4, "a", "four"), (5, 1, "user", "one"), (5, 2, "a", "two"), (5, 3, "a", "three"), (5, 4, "a", "four"),
    (20, 0, "a", "bc"), (21, 0, "ab", "c"), (-7, 0, "user", "hello  there\tyou"), (None, 0, "user", "nobody"), (47, 0, "user", ""), (48, 0, "user", "q"), (60, 1, "u", "s"), (61, 9, "u", "long " * 5000),
]


def test_op13(spark):
    frame = spark.createDataFrame([(*r, r[0], "x") for r in CONVERSATIONS], "conv_id long, turn long, role string, text string, key long, path string")
    found = convtrie.spliced_trie(frame)
    assert sorted(map(tuple, found.collect()), key=str) == brute_trie(brute_spliced(CONVERSATIONS))
    plain = {}
    for conv, turn, role, text in sorted((r for r in CONVERSATIONS if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        plain.setdefault(conv, []).append((role or "", text or ""))
    assert sorted(map(tuple, convtrie.conversation_trie(frame).collect()), key=str) == brute_trie(plain)
    assert convtrie.spliced_trie(frame.limit(0)).count() == 0
    repeated = convtrie.conversation_trie(frame.union(frame)).where("depth = 0").first()
    assert repeated.n_convs == len(plain)


def test_op13_random(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "CHUNK_IDS", 3)
    rng = np.random.default_rng(12)
    rows = []
    for conv in rng.permutation(400).tolist():
        copy = conv % 3 == 0
        rows += [(conv, t, "user", f"w{t}" if copy else f"w{rng.integers(0, 2)} w") for t in range(12 if copy else int(rng.integers(1, 7)))]
    found = convtrie.spliced_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(map(tuple, found.collect()), key=str) == brute_trie(brute_spliced(rows))


def test_op13_deep_conversation_takes_few_rounds(spark):
    rows = [(1, t, "u", str(t)) for t in range(3000)] + [(2, 0, "u", "0"), (2, 1, "u", "else")]
    found = convtrie.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(found) == 3002 and max(r.depth for r in found) == 3000 and next(r for r in found if r.depth == 0).n_leaves == 2


def edits(a, b):
    """Whether the words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(words, ratio=10):
    near = {w: [v for v in words if edits(w, v)] for w in words}
    best = {w: min(others, key=lambda v: (-words[v], v.encode()), default=None) for w, others in near.items()}
    form = {w: b if b is not None and words[b] >= ratio * words[w] else None for w, b in best.items()}
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def brute_counts(rows):
    found = {}
    for doc, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                found[run] = found.get(run, 0) + 1
    return found


def test_op11_pairs_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    words = {}
    for letters, count in (("ab", 60), ("abcd\u00e9", 300), ("abcdefghijklmnopq\u00ff", 200)):
        for _ in range(count):
            w = "".join(rng.choice(list(letters), rng.integers(7, 11)))
            for _ in range(int(rng.integers(0, 4))):
                words[w] = int(10 ** rng.uniform(0.4, 5))
                k, c = int(rng.integers(0, len(w))), str(rng.choice(list(letters)))
                w = [w[:k] + c + w[k + 1 :], w[:k] + c + w[k:], w[:k] + w[k + 1 :] if len(w) > 7 else w][int(rng.integers(0, 3))]
    found = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert sorted(map(tuple, found.collect())) == brute_variants(words)


def test_op11_counts_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE_CHARS", 50)
    monkeypatch.setattr(spelling, "COUNTER_WORDS", 20)
    rng = np.random.default_rng(5)
    stems = ["verschiedene", "LETTERS", "\u00c9l\u00e9phant", "\u00d7\u00f7abcdef", "straightforward", "na\u00efvet\u00e9s", "\u0100bcdefghi", "shorty", "under_scored"]
    rows = [(k, " ".join(rng.choice(stems, 40)) + "\n" + "".join(rng.choice(stems, 3))) for k in range(80)]
    rows += [(900, None), (901, ""), (None, "verschiedene verschiedene"), (3, rows[3][1]), (902, "x" * 3000 + " verschiedenee"), (903, "verschiedenee")]
    frame = spark.createDataFrame([(*r, "mine", 1) for r in rows], "doc_id long, text string, word string, n int")
    counts = brute_counts(rows)
    assert {r.word: r.n for r in spelling.word_counts(frame).collect()} == counts
    found = spelling.spelling_variants(frame)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, found.collect())) == brute_variants({w: n for w, n in counts.items() if n >= 2})
    assert spelling.spelling_variants(frame.limit(0)).count() == 0


def test_op11_pivots_are_the_lightest_disjoint_pair():
    rng = np.random.default_rng(3)
    for _ in range(300):
        places = sorted(rng.choice(12, int(rng.integers(3, 8)), replace=False).tolist())
        weights = rng.integers(1, 30, len(places)).tolist()
        sums = {(p, q): weights[i] + weights[j] for i, p in enumerate(places) for j, q in enumerate(places) if q - p >= 2}
        if sums:
            assert sums[tuple(spelling.pivots(places, weights))] == min(sums.values())


def hashes(text):
    return prefixhash.PrefixHashes(prefixhash.code_points(text))


@pytest.mark.parametrize("block", [prefixhash.BLOCK, 8, 32])
def test_op12_spans_and_extensions(block, monkeypatch):
    monkeypatch.setattr(prefixhash, "BLOCK", block)
    rng = np.random.default_rng(6)
    for _ in range(60):
        a, b = ("".join(rng.choice(["a", "b", "\u00e9", "\U0001f600"], rng.integers(0, 70), p=[0.9, 0.05, 0.03, 0.02])) for _ in range(2))
        b = a[: len(a) // 2] + b
        x, y = hashes(a), hashes(b)
        for base, k in zip(prefixhash.BASES, (0, 1)):
            assert [x.upto(i)[k] for i in range(len(a) + 1)] == [sum((ord(c) + 1) * pow(base, i, prefixhash.PRIME) for i, c in enumerate(a[:n])) % prefixhash.PRIME for n in range(len(a) + 1)]
        for _ in range(10):
            i, j = int(rng.integers(0, len(a) + 1)), int(rng.integers(0, len(b) + 1))
            assert x.common(y, i, j) == len(os.path.commonprefix([a[i:], b[j:]]))
            assert x.common_back(y, i, j) == len(os.path.commonprefix([a[:i][::-1], b[:j][::-1]]))
            n = int(rng.integers(0, min(len(a) - i, len(b) - j) + 1))
            assert (x.span(i, i + n) == y.span(j, j + n)) == (a[i : i + n] == b[j : j + n])
        spans = {hashes(a[k : k + 16]).span(0, len(a[k : k + 16])) >> 31 for k in range(max(1, len(a) - 15))} if a else set()
        assert x.least_spans(count=5).tolist() == sorted({int(prefixhash.mixed(np.array([s], dtype=np.uint64))[0]) >> 32 for s in spans})[:5]


def test_op12_long_complements_differ():
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(4096))
    other = word.translate(str.maketrans("ab", "ba"))
    assert hashes(word).span(0, 4096) != hashes(other).span(0, 4096) and hashes(word).common(hashes(other)) == 0


def test_op12_likeness():
    rng = np.random.default_rng(1)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    a, b = text(800), text(800)
    near = lambda x, y: prefixhash.likeness(prefixhash.fingerprint(hashes(x)), prefixhash.fingerprint(hashes(y)))
    assert near(a, a) == 1 and near("", "") == 1 and near("", "x") == 0 and near(a, b) < 0.05
    assert 0.35 < near(a, a[:2400] + b[:2400]) < 0.65 and near(a, b + a) > 0.4 and near(a, a.replace("abc", "xyz")) > 0.8
    assert near("abcdef", "abcxyz") == 0.5 and 0 <= near("aaaa", "aaaaaaaa") <= 1


def brute_edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), len((r[1] or "").encode()), prefixhash.xxhash.xxh64_intdigest((r[1] or "").encode())))
    out = []
    for k, (doc, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, changed, following = (prefixhash.fingerprint(hashes(t)) for t in (text, edited, after))
        sha = hashlib.sha256(edited.encode()).hexdigest()
        common = [len(os.path.commonprefix([text, t])) for t in (edited, after)]
        out.append((doc, len(text), sha, own, changed, prefixhash.likeness(own, changed), prefixhash.likeness(own, following), *common))
    return sorted(out, key=str)


def test_op12_neighbours(spark):
    odd = [(5, None), (6, ""), (6, ""), (6, "b" * 40), (None, "last"), (None, None), (7, "\U0001f600\u00e9x" * 70_000), (-3, "negative"), (2**62, "far away")]
    rows = odd + [(100 + 3 * k, f"text number {k} " * (k % 40)) for k in range(300)]
    frame = spark.createDataFrame([(*r, "mine", 0.5) for r in rows], "doc_id long, text string, fingerprint string, near_next double").repartition(7)
    found = prefixhash.edited_neighbours(frame)
    assert sorted(map(tuple, found.collect()), key=str) == brute_edited(rows)
    assert sorted(map(tuple, prefixhash.fingerprints(frame).collect()), key=str) == sorted([(r[0], r[1], r[3]) for r in brute_edited(rows)], key=str)
    assert prefixhash.edited_neighbours(frame.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    assert prefixhash.edited_neighbours(one).first().edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert prefixhash.edited_neighbours(spark.createDataFrame([(None, "abcd"), (None, "xy")], "doc_id long, text string")).count() == 2


def test_op12_query(spark):
    found = QUERIES["op12_prefix_hashes"](spark, SF).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, found), key=str) == brute_edited(rows)
    assert np.mean([r.near_edited > r.near_next for r in found]) > 0.9


def test_op12_extensions_of_pairs(spark):
    rows = [("abcdef", 2, "xxcdef!", 2, 9), (None, 0, "a", 0, 9), ("abc", None, "abd", None, 9), ("abc", 7, "abc", 0, 9)]
    frame = spark.createDataFrame(rows, "left_text string, left_at long, right_text string, right_at long, common int")
    assert [r.common for r in prefixhash.common_extensions(frame).collect()] == [4, 0, 2, 0]


def test_op6_labels_do_not_leak_into_their_own_features(spark):
    """A suffix whose labels are of one page only tells nothing about that page."""
    rows = [(f"http://host{k}.org/{'bad' if k % 2 else 'good'}/{k % 7}",) for k in range(400)]
    rules = [urlfilter.Rule(f"host{k}.org", "/", "block" if k % 2 else "allow") for k in range(0, 200)]
    pages = spark.createDataFrame(rows, "url string")
    measured = urlfilter._measured(urlfilter._ruled(pages, rules, ["url"]), urlfilter._blocked())
    share = urlfilter.FEATURES.index("suffix_blocked")
    assert {round(r.features[share], 6) for r in measured.collect()} == {0.5}


def test_op6_held_out_accuracy(spark):
    """The rules tell pages of one host apart by their language, which no lexical feature shows, so much is left to chance; see README for the figure."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    found = urlfilter.held_out(pages, RULES).collect()
    right, most = np.mean([r.label == r.prediction for r in found]), max(np.mean([r.label == x for r in found]) for x in (0.0, 1.0))
    print(len(found), right, most)
    assert len(found) > 200 and right > most + 0.05


def test_op6_separates_by_lexical_features(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(600):
        spam = k % 3 == 0
        tail = "".join(rng.choice(list("0123456789"), 24)) + "?a=1&b=2&c=3" if spam else "guide/to/things.html"
        rows.append((f"http://{'x' if k % 2 else 'y'}{k % 50}.example.org/{tail}", spam))
    pages = spark.createDataFrame([(u,) for u, _ in rows], "url string")
    rules = [urlfilter.Rule(f"x{k}.example.org", f"/{d}", "block") for k in range(0, 50) for d in range(10)] + [urlfilter.Rule(f"x{k}.example.org", "/g", "allow") for k in range(50)]
    found = {r.url: r.verdict for r in urlfilter.judge(pages, rules).where("rule IS NULL").collect()}
    assert len(found) > 100 and np.mean([found[u] == ("block" if spam else "allow") for u, spam in rows if u in found]) == 1


def test_op6_very_long_urls(spark):
    pages = spark.createDataFrame([("http://a.net/" + "x/" * 100_000, 1), ("http://" + "b" * 50_000 + ".org/fr/1", 2), ("http://c.org/?" + "k=v&" * 50_000, 3)], "url string, rule int")
    found = urlfilter.judge(pages, RULES).collect()
    assert sorted((r.rule or "", len(r.host)) for r in found) == [("", 5), ("net/", 5), ("org/fr/", 50_004)]


@pytest.mark.parametrize("page", [
    "<div>" * 200_000, "<a " * 330_000, "<a b=\"" * 160_000 + ">", "<a b='>' c=\"" * 80_000 + ">", "<!" * 500_000, "</script " * 100_000 + ">", "<script>" * 125_000,
    "<p>" * 330_000, "</div>" * 160_000, "<!--" * 250_000, "<a b=\">\" " * 100_000, "<p class=" + "x " * 400_000 + ">t", "<" * 1_000_000, "&amp" * 250_000, "<ul><li>" * 120_000 + "</ul>" * 60_000,
])
def test_op9_hostile_pages_take_time_in_proportion(page):
    began = time.process_time()
    extract.lines_of(page)
    assert time.process_time() - began < 5


def test_op9_names_inside_an_article():
    page = (
        "<div class='site-header'>Site</div><article><div class='entry-header'><h1>Title</h1></div><p class='share-price'>Price</p>"
        "<div class='related-work'>Work</div><p class='ad'>Maybe</p><div class='share'>Share this</div><div class=\"comments\"><p>Hi</p></div><p title=\"a > b\">Text</p><p>1 < 2</article>"
    )
    assert extract.lines_of(page) == [("text", "Title"), ("text", "Price"), ("loose", "Work"), ("loose", "Maybe"), ("text", "Text"), ("text", "1 < 2")]
    assert extract.lines_of("<p>a<p>b") == [("open", "a"), ("open", "b")]
    assert extract.lines_of("x <!-- never closed <p>y</p>") == [("open", "x")] and extract.lines_of("x <b y") == [("open", "x <b y")]


def brute_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("bits", [1, 40, extract.TABLE_BITS])
def test_op9_common_lines_in_any_memory(bits, monkeypatch):
    monkeypatch.setattr(extract, "TABLE_BITS", bits)
    rng = np.random.default_rng(11)
    for _ in range(80):
        a, b = (rng.integers(0, 4, rng.integers(0, 25)).tolist() for _ in range(2))
        left, right = extract.common(a, b)
        assert [a[i] for i in sorted(left)] == [b[j] for j in sorted(right)] and len(left) == brute_common(a, b)


def test_op9_differencing_decides_pages_without_article(spark):
    """Sites whose furniture bears no name: what neighbours share goes, whatever the markup."""
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for host in range(6):
        menu = [f"menu {host} {k}" for k in range(5)]
        for k in range(8):
            body = [f"line {host} {k} {rng.integers(0, 10**9)}" for _ in range(rng.integers(2, 6))]
            page = "".join(f"<div>{x}</div>" for x in menu[:3]) + "".join(f"<p>{x}</p>" for x in body) + "".join(f"<span>{x}</span><br>" for x in menu[3:])
            rows.append((host * 100 + k, f"http://h{host}.org/a/{k}", page, "mine"))
            want[host * 100 + k] = "\n".join(body)
    pages = spark.createDataFrame([*rows, (9000, None, None, "x"), (9001, "http://lone.org/", "<p>alone</p>", "x")], "page_id long, url string, html string, text string")
    found = {r.page_id: r.text for r in extract.main_text(pages).collect()}
    assert found == want | {9000: "", 9001: "alone"}
    assert extract.main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [substring.HOT, 2])
def test_op2_first_document_of_very_many_anchors(spark, hot):
    """Shards of one first document are split by anchor; texts, cut anywhere, lose the same windows."""
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(40)]
    first = " ".join(rng.choice(words, 3000))
    rows = [(1, first)]
    for k in range(2, 40):
        parts = first.split()
        at, size = int(rng.integers(0, 2900)), int(rng.integers(5, 90))
        rows.append((k, " ".join([*rng.choice(words, 8), *parts[at : at + size], *rng.choice(words, 8), *parts[at + 3 : at + 40]])))
    found = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot, shard_runs=50)
    want = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in found.collect())
    assert got == sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in want.collect())
    seen, gone = set(), {}
    for doc, text in rows:
        own = text.split()
        windows = [tuple(own[k : k + 13]) for k in range(len(own) - 12)]
        gone[doc] = len({p for k, w in enumerate(windows) if w in seen for p in range(k, k + 13)})
        seen.update(windows)
    assert {d: n for d, _, n, _ in got} == gone and sum(gone.values()) > 1000


def planted_personal_data(texts):
    """Texts with secrets, account numbers and written-out addresses in them, and their places; and things that only look like them."""
    rng = np.random.default_rng(21)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    secret = lambda: "".join(rng.choice(list("0123456789abcdef"), 40)) if rng.random() < 0.5 else "k7" + "".join(rng.choice(letters, 30))
    digits = lambda n: "".join(rng.choice(list("123456789"), n))
    name = lambda: "".join(rng.choice(list("abcdefghijklm"), 6))
    rows, want = [], set()
    for k, text in enumerate(texts):
        words = text.split()[:120]
        at = int(rng.integers(1, max(2, len(words))))
        kind = ("secret", "account", "handle", "other", "none")[k % 5]
        before, hit = {
            "secret": lambda: (str(rng.choice(["token = \"", "password: ", "api key = ", "secret: "])), secret()),
            "account": lambda: (str(rng.choice(["account ", "konto ", "compte ", "IBAN "])), digits(int(rng.integers(13, 18)))),
            "handle": lambda: (str(rng.choice(["mail ", "contact ", "write "])), f"{name()} [at] {name()} [dot] org"),
            "other": lambda: ("", str(rng.choice([f"/usr/share/{name()}/{name()}/{name()}2", digits(9), f"{name()}-{name()}-{name()}-{name()}-4"]))),
            "none": lambda: ("", ""),
        }[kind]()
        head = " ".join(words[:at]) + " " + before
        body = f"{head}{hit}{chr(34) if before.endswith(chr(34)) else ''} {' '.join(words[at:])}"
        rows.append((k, body))
        if kind in ("secret", "account", "handle"):
            want.add((k, f"{kind}:{len(head)}:{len(head) + len(hit)}"))
    return rows, want


def test_op7_added_spans_on_planted_data(spark, capsys):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text NOT RLIKE '[0-9@]' AND n_chars > 100").orderBy("doc_id").limit(500).collect()]
    rows, want = planted_personal_data(texts)
    found = set()
    for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found |= {(r.doc_id, s) for s in r.spans.split(",") if s.split(":")[0] in ("secret", "account", "handle")}
    recall, precision = len(found & want) / len(want), len(found & want) / len(found)
    with capsys.disabled():
        print(f"op7 added spans: {len(want)} planted, recall {recall:.3f}, precision {precision:.3f}")
    assert recall > 0.9 and precision > 0.9
