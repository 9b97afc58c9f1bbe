"""Places where an operator did less than the whole job."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ferrywork.llm import extract, langid, packing


def site(furniture, body):
    return "".join(f"<div>{line}</div>" for line in [*[f"menu {k}" for k in range(furniture)], *body])


def main_texts(spark, pages, tasks=1):
    rows = [(k, f"http://{url}", page) for k, (url, page) in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(tasks)
    return [r.text for r in sorted(extract.main_text(frame).collect(), key=lambda r: r.page_id)]


def test_op9_differences_pages_that_are_mostly_furniture():
    own = [f"menu {k}" for k in range(9)]
    assert extract.furniture([*own, "a", "b"], [[*own, "c", "d"]]) == set(range(9))
    assert extract.furniture([*own, *"abcdefghijk"], [own]) == set(range(9))
    body = [f"line {k}" for k in range(50)]
    # A copy with one line changed, and an excerpt, beside a page that shows the furniture.
    assert extract.furniture([*own, *body], [[*own, *body[1:], "edited"], [*own, "other"]]) == set(range(9))
    assert extract.furniture([*own, *body], [[*own, *body[:9]], [*own, "other"]]) == set(range(9))
    # Alone with such a copy, nothing tells what is furniture.
    assert extract.furniture([*own, *body], [[*own, *body[1:], "edited"]]) == set()


@pytest.fixture(params=[1, 4, 60])
def tasks(request, spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_op9_copies_are_folded_and_near_copies_passed_over(spark, tasks):
    """With each number of tasks, up to one for each page, so that runs of copies are cut anywhere."""
    pages = [(f"a.org/{k}", "<div>Top of site</div><div>body {}</div><div>All rights reserved</div>".format(k), f"body {k}") for k in range(4)]
    pages += [(f"two.org/{k}", site(9, b), "\n".join(b)) for k, b in enumerate([["a", "b"], ["c", "d"]])]
    copies = [("a", ["first", "second"]), *[(f"b{k}", ["again", "and again"]) for k in range(4)], ("c", ["last", "of all"])]
    pages += [(f"run.org/{u}", site(9, b), "\n".join(b)) for u, b in copies] + [("run.org/bb", "", "")]
    long = [f"sentence {k}" for k in range(50)]
    near = [("a", ["first"]), *[(f"b{k}", [*long, f"seen {k} times"]) for k in range(5)], ("c", ["last"])]
    pages += [(f"near.org/{u}", site(3, b), "\n".join(b)) for u, b in near]
    assert main_texts(spark, [p[:2] for p in pages]) == [p[2] for p in pages]


def test_op9_edges_carry_what_one_pass_finds():
    """States before each part, however a row of runs is cut."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        pages = [[int(x) for x in rng.integers(0, 3, rng.integers(1, 7))] for _ in range(rng.integers(2, 9))]
        cuts = [0, *sorted(rng.choice(range(1, len(pages)), rng.integers(1, len(pages)), replace=False).tolist()), len(pages)]
        parts, wanted, state = [], [], None
        for a, b in zip(cuts, cuts[1:]):
            wanted.append(state)
            runs = [pages[a]]
            for page in pages[a:b]:
                state = extract.reached(state, page)
                if runs[-1] != page:
                    runs.append(page)
            edge = extract._edge(runs)
            parts.append(("h", edge, "h", edge, True))
        assert extract._carried(parts) == wanted


def test_op10_learns_rare_languages_despite_copies_and_long_texts(spark):
    rng = np.random.default_rng(6)
    words = {lang: [f"{lang}{''.join(rng.choice(list(signs), 5))}" for _ in range(60)] for lang, signs in (("aa", "bcdfg"), ("bb", "klmno"), ("cc", "stuvw"))}
    texts = [(lang, " ".join(rng.choice(words[lang], 12))) for lang in ["aa"] * 600 + ["bb"] * 30]
    texts = [(r.lang, r.text) for r in spark.createDataFrame(texts, "lang string, text string").orderBy(F.xxhash64("text")).collect()]
    first = next(t for t in texts if t[0] == "aa")
    late = [t for t in texts if t[0] == "bb"][-2:]
    long = ("cc", " ".join(rng.choice(words["cc"], 6000)))
    rows = [first] * 450 + [t for t in texts if t[0] == "aa"] + late + [long]
    field = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert field.labels == ["aa", "bb", "cc"]
    asked = [" ".join(rng.choice(words[lang], 12)) for lang in field.labels]
    found = langid.predict(spark.createDataFrame(list(zip(asked)), "text string"), field).collect()
    assert {r.text: r.lang_pred for r in found} == dict(zip(asked, field.labels))
    assert langid.fit(spark.createDataFrame([long], "lang string, text string")).labels == ["cc"]
    # More languages than the sample has texts: each is learned.
    assert len(langid.fit(spark.createDataFrame([(f"l{k}", f"word{k}") for k in range(9)], "lang string, text string"), sample_docs=4).labels) == 9


def test_op4_added_tokens_have_their_own_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    added = [t.content for t in library.get_added_tokens_decoder().values()]
    assert added
    rng = np.random.default_rng(7)
    signs = [*added, *added, "a", " ", "it's", "\n", "é", "12", "<|", "|>", added[0][:-1]]
    rows = [(k, "".join(rng.choice(signs, rng.integers(0, 9)))) for k in range(200)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), path).orderBy("doc_id", "start").collect()
    found = {}
    for p in pieces:
        found[p.doc_id] = found.get(p.doc_id, b"") + bytes(p.ids)
    assert found == {k: np.array([*library.encode(t, add_special_tokens=False).ids, 1], dtype="<u4").tobytes() for k, t in rows}


def test_op4_words_in_use_are_encoded_once(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    monkeypatch.setattr(packing, "CACHED_WORDS", 100)
    ids_of, learned = packing.WordEncoder(path), []
    learn = ids_of._learn
    monkeypatch.setattr(ids_of, "_learn", lambda *words: learned.append(len(words[-1])) or learn(*words))
    common = [f"é{chr(97 + k)}" for k in range(20)]
    for call in range(30):
        own = [f"x{chr(97 + call % 26)}{chr(65 + call // 26)}{chr(97 + k)}" for k in range(15)]
        texts = ["\n".join(common), "\n".join(own)]
        assert [x.tolist() for x in ids_of(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    # The 20, the line break and the 15 of each call; before, the common words were encoded again whenever the cache was full.
    assert sum(learned) == 21 + 30 * 15


@pytest.mark.parametrize("room", [0, 12, 300_000])
def test_op4_ids_do_not_depend_on_what_is_known(monkeypatch, room):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    monkeypatch.setattr(packing, "CACHED_WORDS", room)
    ids_of = packing.WordEncoder(path)
    rng = np.random.default_rng(5)
    signs = ["a", "ab", " the", "'ll", " ", "  ", "\n", "1", "!", "é", "ÿ", "　", "漢", "😀", "\x00", "\U0010ffff", "Ġ", "<|endoftext|>"]
    # Words of equal hash, within a call and from one call to the next.
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    calls = [["".join(rng.choice(signs, rng.integers(0, 12))) for _ in range(3)] for _ in range(150)]
    calls += [[word], [other, "a"], [word, other], [], [""], [word], ["".join(map(chr, range(1, 0x3000)))]]
    for texts in calls:
        assert [x.tolist() for x in ids_of(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        ids_of.forget() if rng.random() < 0.1 else None
