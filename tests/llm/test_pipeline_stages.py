"""The pipeline's stages on odd tables: nulls, empty and very long texts, repeated ids and rows, clashing names, columns of any type."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """The documents with odd rows beside them, and columns whose names the stages use themselves."""
    plain = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").limit(60)
    texts = [r.text for r in plain.where("n_chars > 300").orderBy("doc_id").limit(4).collect()]
    rows = [
        (9001, None, "en", "a", 0), (9002, "", "en", "a", 0), (9003, " \t\n", None, "a", 3), (9004, "12345 67890", "en", "a", 11),
        (9005, "asdf jkl qwer uiop zxcv bnm " * 30, None, "junk", 840), (9006, "这是一个中文文本用来测试 " * 20, None, "junk", 260),
        (9007, texts[0] + " first text of one id", "en", "a", 1), (9007, texts[1], "en", "b", 1), (9007, texts[1], "en", "b", 1),
        (None, texts[2], "en", "a", 1), (None, texts[2], "en", "a", 1), (9008, " ".join([texts[3]] * 60), "en", "long", 1),
    ]
    extra = spark.createDataFrame(rows, COLUMNS)
    both = plain.select(*[c.split()[0] for c in COLUMNS.split(", ")]).union(extra)
    return both.selectExpr("*", "map('k', source) AS score", "array(n_chars) AS familiar", "'mine' AS fp", "1 AS _id", "2 AS n_words", "'x' AS spans")


def test_every_stage_keeps_columns_and_takes_odd_rows(spark, odd):
    now = odd
    for name, stage in corpus_pipeline.STAGES:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/odd-{name}"
        done = stage(spark, now, SF)
        assert name == "packing" or done.dtypes == odd.dtypes
        done.write.mode("overwrite").parquet(path)
        assert stage(spark, now.limit(0), SF).count() == 0
        done = spark.read.parquet(path)
        if name == "language_id":
            left = {r.doc_id for r in done.collect()}
            assert not left & {9001, 9002, 9003, 9004, 9005, 9006} and {9007, 9008, None} <= left
            assert done.where("doc_id < 9000").count() == 60
        if name == "simhash_near_dedup":
            assert done.where("doc_id IS NULL").count() == 2
            assert done.where("doc_id = 9007").count() <= 1  # the second text is a copy of a smaller id
        if name in ("substring_dedup", "personal_data"):
            assert done.count() == now.count()
        now = done


def test_two_texts_of_one_id_both_stay(spark):
    words = [" ".join(f"{w}{k}" for k in range(80)) for w in ("red", "green", "blue")]
    rows = [(5, words[0], 1), (5, words[1], 2), (5, words[1], 3), (7, words[1], 4), (6, words[2], 5), (9, words[0] + " more", 6), (9, words[2], 7), (None, words[0], 8), (11, None, 9), (11, "", 10)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n int").withColumn("tags", F.create_map(F.lit("n"), F.col("n")))
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert kept.dtypes == docs.dtypes
    assert sorted(r.n for r in kept.collect()) == [1, 2, 5, 8, 10] or sorted(r.n for r in kept.collect()) == [1, 2, 5, 8, 9]


def test_junk_goes_and_prose_stays(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    junk = ["asdf jkl qwer uiop zxcv bnm " * 20, "sdkfjh sdkfjhsdf kjhsdf kjhweoiru zxmncb qpwoei " * 10, "это русский текст для проверки " * 10, "qwertyuiop asdfghjkl zxcvbnm " * 10]
    rows = spark.createDataFrame([(10_000 + k, t, None, "junk", len(t)) for k, t in enumerate(junk)], COLUMNS)
    kept = corpus_pipeline.language(spark, documents.unionByName(rows), SF)
    assert kept.where("source = 'junk'").count() == 0 and kept.count() >= documents.where("text RLIKE '[A-Za-z]'").count()
