"""URL verdicts: rules where one fits, else gradient-boosted trees on lexical features trained from the URLs that rules label."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_URLS, TREES, DEPTH, FOLDS = 5000, 8, 3, 5
FEATURES = ("chars", "host_labels", "depth", "digit_ratio", "entropy", "parameters", "suffix_pages", "suffix_blocked")


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host (ASCII-lower-cased) and path; both empty for a null url or one without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def fitting(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest fitting rule as a struct of name and verdict; null where none fits.  Of rules of one length, the one listed first."""
    if not rules:
        return F.lit(None).cast("struct<name:string,verdict:string>")
    fits = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), _ranked(k, r)) for k, r in enumerate(rules)]
    best = F.array_max(F.array(*fits))  # side by side, as a chain of conditions would go as deep as there are rules
    return F.when(best.isNotNull(), F.struct(best["name"].alias("name"), best["verdict"].alias("verdict")))


def _ranked(place: int, rule: Rule) -> Column:
    values = {"size": len(rule.name), "earlier": -place, "name": rule.name, "verdict": rule.verdict}
    return F.struct(*[F.lit(v).alias(k) for k, v in values.items()])


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    length = F.greatest(F.length(url), F.lit(1)).cast("double")
    signs = F.array_distinct(F.split(url, ""))
    share = F.transform(signs, lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / length)
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    return {
        "chars": length,
        "host_labels": F.size(F.split(host, r"\.")).cast("double"),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("double"),
        "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / length,
        "entropy": F.aggregate(share, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0)),
        "parameters": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "[&;]")).cast("double")),
    }


def _measured(source: DataFrame, blocked: Column) -> DataFrame:
    """``source`` (``u, host, path, fit``) with its features as a vector.

    Suffix statistics are of the last two host labels, over all pages.  A page's label never reaches its own features: URLs are dealt into
    ``FOLDS`` by hash, and what the suffix was labelled is counted in the other folds only, for labelled and other pages alike.
    """
    dealt = source.withColumns({"suffix": F.substring_index("host", ".", -2), "fold": F.pmod(F.xxhash64("u"), F.lit(FOLDS))})
    folds = dealt.groupBy("suffix", "fold").agg(F.count("*").alias("pages"), F.count(blocked).alias("labelled"), F.coalesce(F.sum(blocked), F.lit(0.0)).alias("blocked"))
    whole = folds.groupBy("suffix").agg(*[F.sum(c).alias(f"all_{c}") for c in ("pages", "labelled", "blocked")])
    others = folds.join(whole, "suffix").select(
        "suffix", "fold", F.log1p("all_pages").alias("suffix_pages"),
        ((F.col("all_blocked") - F.col("blocked") + 1) / (F.col("all_labelled") - F.col("labelled") + 2)).alias("suffix_blocked"),
    )
    measured = dealt.withColumns(lexical(F.col("u"), F.col("host"), F.col("path"))).join(others, ["suffix", "fold"])
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(measured)


def _trained(labelled: DataFrame, train_urls: int):
    """Trees of ``labelled`` (``features, label, u``), and the one label where there is no more; of at most ``train_urls`` URLs, picked by hash."""
    training = labelled.orderBy(F.xxhash64("u"), "u").limit(train_urls).select("features", "label").persist()
    kinds = [r[0] for r in training.select("label").distinct().orderBy("label").collect()]
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=1).fit(training) if len(kinds) == 2 else None
    training.unpersist()
    return model, kinds


def _ruled(pages: DataFrame, rules: list[Rule], kept: list[str]) -> DataFrame:
    host, path = parts(F.col("url").cast("string"))
    source = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("rest"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("u"), host.alias("host"), path.alias("path"))
    return source.withColumn("fit", fitting(rules, F.col("host"), F.col("path")))


def _blocked() -> Column:
    return F.when(F.col("fit.verdict") == "block", 1.0).when(F.col("fit.verdict") == "allow", 0.0)


def judge(pages: DataFrame, rules: list[Rule], train_urls: int = TRAIN_URLS) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` added, in place of any columns so named.

    The trees learn from at most ``train_urls`` URLs that rules label, picked by hash; see :func:`_measured` for the suffix statistics.
    A null URL has an empty host and path and fits no rule that names a host.  Where the labels hold one verdict only, it is the method's; with no labels it is ``allow``.
    Repeated rows are kept, other columns stay, an empty table gives an empty result.  Long URLs are read whole.
    """
    own = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c not in own]
    vectors = _measured(_ruled(pages, rules, kept), _blocked())
    model, kinds = _trained(vectors.where(_blocked().isNotNull()).select("features", _blocked().alias("label"), "u"), train_urls)
    if model:
        vectors = model.transform(vectors)
        method = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    else:
        method = F.lit("block" if kinds == [1.0] else "allow")
    rule = F.col("fit.name").alias("rule")
    return vectors.select(*[F.col(f"rest.`{c}`").alias(c) for c in kept], "host", "path", rule, F.coalesce("fit.verdict", method).alias("verdict"))


def held_out(pages: DataFrame, rules: list[Rule], train_urls: int = TRAIN_URLS) -> DataFrame:
    """Label and the method's verdict (``label, prediction``, 1 for block) of the labelled URLs in one fold, which the trees did not learn from."""
    vectors = _measured(_ruled(pages, rules, ["url"]), _blocked()).where(_blocked().isNotNull()).withColumn("label", _blocked())
    model, kinds = _trained(vectors.where("fold <> 0").select("features", "label", "u"), train_urls)
    unseen = vectors.where("fold = 0")
    if model:
        return model.transform(unseen).select("label", "prediction")
    return unseen.select("label", F.lit(1.0 if kinds == [1.0] else 0.0).alias("prediction"))
