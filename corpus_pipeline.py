"""Documents to packed training windows: language ID, SimHash near-dedup, substring dedup, redaction, packing.

Each stage reads what its predecessor kept, written as Parquet and read again; run() applies all of them to ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrywork.llm import langid, packing, pii, simhash, substring
from ferrywork.llm.frames import table, written

#: Documents go of whose n-grams the sample of labelled documents had less than this share, in any language: keyboard junk has at most 0.8, prose 0.9 and more.
LEAST_FAMILIAR = 0.8
#: Near-duplicates: fingerprints of five-word shingles within four bits.  That finds few pairs of a Jaccard similarity under 0.85 (see README); similarity is not verified.
SHINGLE = 5


def _like(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of ``docs``, with the length of the changed text where they hold it."""
    types = dict(docs.dtypes)
    if "n_chars" in types:
        changed = changed.withColumn("n_chars", F.length("text").cast(types["n_chars"]))
    return changed.select(*[f"`{c}`" for c in docs.columns])


def _put_aside(docs: DataFrame, *names: str):
    """``docs`` without columns of these names, which an operator gives its results, and a way back to the columns of ``docs``."""
    renamed = {c: f"own {c}" for c in names if c in docs.columns}
    return docs.withColumnsRenamed(renamed), lambda done: done.select(*[F.col(f"`{renamed.get(c, c)}`").alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a learned language; the field learns from the labelled ones.

    Null and empty texts, texts without letters and texts in no learned language go; without labels nothing is learned and all go.  Texts of any length
    are read whole.  Repeated rows, null ids and other columns, whatever their names, stay as they are.  An empty table stays empty.
    """
    aside, back = _put_aside(docs, "lang_pred", "score", "familiar")
    found = langid.predict(aside, langid.fit(aside) if "lang" in docs.columns else None)
    return back(found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("familiar") >= LEAST_FAMILIAR)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group, once; see :func:`simhash.first_of_groups` for ids with several texts and rows without an id.

    Null and empty texts are one group.  An empty table stays empty; other columns stay, of any type.
    """
    return simhash.first_of_groups(docs, shingle=SHINGLE)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove windows of 13 words that a document of a smaller id holds.

    Every row stays: null texts stay null, shorter texts and rows without an id lose nothing; texts of any length are read whole.
    """
    aside, back = _put_aside(docs, "n_words", "n_removed")
    return _like(docs, back(substring.substring_dedup(aside)))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind.  Every row stays; null and empty texts stay as they are."""
    return _like(docs, pii.redact(docs))


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the token ids; one row per piece.  A null or empty text is its end id alone, a null id stays null, repeated rows are packed each."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("personal_data", personal_data),
    ("packing", windows),
]

# No stage can be written in DuckDB's SQL (a trained field, SimHash, token ids); tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
