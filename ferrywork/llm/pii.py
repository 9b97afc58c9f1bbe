"""Personal data by weak supervision, with DataFrame operations only.

Base kinds (email, ip, card, phone) are found by their patterns and checks.  Further spans (secret, account, handle) start as
broad candidates on which labelers vote: a strict pattern, a gazetteer of cue words, the context, and the shape.
Votes are counted per pattern of votes over all documents; expectation-maximisation on those counts (a few hundred rows at most)
estimates how reliable each labeler is.  The posteriors weigh the counts of span features, from which the final
classifier, a naive Bayes model, takes its log-odds; a candidate stays if its odds are above even.

Positions come from the gaps between matches: ``split`` gives the gaps, ``regexp_extract_all`` the matches, and a
running sum per document their places in code points.  Patterns are possessive and anchored at the start of
their run, so that long runs cost linear time; they match what the plain patterns match.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The kinds in the order of their listing, their patterns, and a cheap test a text must pass first.
BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "handle", "secret")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "account": r"(?<![A-Za-z0-9.+@_-])[0-9]{9,19}+(?![A-Za-z0-9@_-])",
    "handle": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]++)++",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]{0,64}[0-9])[A-Za-z0-9+/_-]{20,}+",
}
DIGIT_RUN = "[0-9](?:[ -]?[0-9]){8}"
# Gazetteer: cue words before a candidate, in the languages of the corpus.
CUES = {
    "account": ("account", "acct", "card", "carte", "compte", "konto", "karte", "cuenta", "tarjeta", "iban", "ssn", "number", "nummer"),
    "handle": ("mail", "contact", "kontakt", "contacto", "write", "adresse", "correo"),
    "secret": ("token", "secret", "password", "passwort", "passwd", "key", "bearer", "auth", "credential", "mot de passe", "clave"),
}
CONTEXT, ROUNDS, LABELERS = 32, 50, 4


def _tests(text: Column) -> dict[str, Column]:
    digits = text.rlike(DIGIT_RUN)
    return {
        "email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": digits, "phone": F.contains(text, F.lit("+")),
        "account": digits, "handle": text.rlike(r"[(\[]at[)\]]"), "secret": text.rlike("[A-Za-z0-9+/_-]{20}"),
    }


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def worth(i):
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = 2 * d
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), worth), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def matches(docs: DataFrame) -> DataFrame:
    """``row, kind, start, end, hit, before, after`` of every pattern match in ``docs(row, text)``; rows that repeat give repeated matches."""
    text = F.col("text")
    tests = _tests(text)

    def found(kind: str) -> Column:
        gaps = F.split(text, PATTERNS[kind], -1)
        hits = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
        parts = F.transform(gaps, lambda g: F.struct(F.length(g).alias("gap"), F.right(g, F.lit(CONTEXT)).alias("before"), F.left(g, F.lit(1)).alias("after")))
        return F.struct(F.lit(kind).alias("kind"), F.when(tests[kind], F.struct(parts.alias("gaps"), hits.alias("hits"))).alias("found"))

    kinds = docs.select("row", F.explode(F.array(*[found(k) for k in BASE + ADDED])).alias("k")).select("row", "k.kind", "k.found")
    kinds = kinds.where(F.size("found.hits") > 0)
    each = kinds.select("row", "kind", F.posexplode("found.hits").alias("n", "hit"), "found.gaps").select(
        "row", "kind", "n", "hit", F.expr("gaps[n].gap").alias("gap"), F.expr("gaps[n].before").alias("before"), F.expr("gaps[n + 1].after").alias("after")
    )
    each = each.dropDuplicates(["row", "kind", "n"])
    so_far = Window.partitionBy("row", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.length("hit")).over(so_far)
    return each.withColumn("end", end).select("row", "kind", (F.col("end") - F.length("hit")).alias("start"), "end", "hit", "before", "after")


def _passes() -> Column:
    """Checks of the base kinds; added kinds pass here and are judged by the model."""
    hit, digits, kind = F.col("hit"), _digits(F.col("hit")), F.col("kind")
    # A part of more than 300 digits is no number a cast could hold; leading zeros do not count.
    small = F.forall(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(|[0-9]|[0-9]{2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return (
        F.when(kind == "ip", small)
        .when(kind == "card", F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", F.length(digits).between(9, 15))
        .otherwise(True)
    )


def _votes() -> list[Column]:
    """1, 0 or -1 (no opinion) of each labeler."""
    kind, hit, before, after = (F.col(c) for c in ("kind", "hit", "before", "after"))
    digits = _digits(hit)
    strict = F.when(kind == "account", F.length(digits) >= 13).when(kind == "secret", hit.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$")).otherwise(hit.rlike("dot|[.]"))
    cue = F.lit(False)
    for k, words in CUES.items():
        cue = F.when(kind == k, F.lower(before).rlike("|".join(words))).otherwise(cue)
    set_apart = before.rlike(r"(?:^|\s)$") & (after.rlike(r"^[\s.,;:!?)%&*#$]") | (after == ""))
    context = F.when(kind == "secret", before.rlike(r"[=:]\s?[\"']?$")).otherwise(set_apart)
    variety = F.size(F.array_distinct(F.split(hit, "")))
    shape = F.when(kind == "secret", variety >= 10).when(kind == "account", variety >= 4).otherwise(variety >= 6)
    return [strict.cast("int"), F.when(cue, 1).otherwise(-1), context.cast("int"), F.when(shape, -1).otherwise(0)]


def _features() -> list[Column]:
    hit = F.col("hit")
    share = F.floor(4 * F.length(_digits(hit)) / F.length(hit))
    return [
        F.concat(F.lit("length"), F.least(F.length(hit) / 4, F.lit(16)).cast("int").cast("string")),
        F.concat(F.lit("digits"), share.cast("string")),
        F.concat(F.lit("before"), F.when(F.col("before").rlike(r"[=:]\s?[\"']?$"), "set").when(F.col("before").rlike(r"(?:^|\s)$"), "space").otherwise("other")),
        F.concat(F.lit("votes"), F.col("votes")),
    ]


def estimate(counts: list[tuple[str, tuple[int, ...], int]]) -> dict[tuple[str, tuple[int, ...]], float]:
    """Posterior of each ``(kind, votes)`` by expectation-maximisation over ``(kind, votes, count)``."""
    posterior = {}
    for kind in {c[0] for c in counts}:
        own = [(v, n) for k, v, n in counts if k == kind]
        belief = {v: (1 + sum(x == 1 for x in v)) / (2 + sum(x >= 0 for x in v)) for v, _ in own}
        for _ in range(ROUNDS):
            total = sum(n for _, n in own)
            prior = min(0.99, max(0.01, sum(n * belief[v] for v, n in own) / total))
            says = []
            for j in range(LABELERS):
                # Chance of a yes vote in either class; counts start from a labeler that is right three times in four.
                yes = [3.0 + sum(n * belief[v] for v, n in own if v[j] == 1), 1.0 + sum(n * (1 - belief[v]) for v, n in own if v[j] == 1)]
                no = [1.0 + sum(n * belief[v] for v, n in own if v[j] == 0), 3.0 + sum(n * (1 - belief[v]) for v, n in own if v[j] == 0)]
                says.append([yes[c] / (yes[c] + no[c]) for c in (0, 1)])
            for v, _ in own:
                odds = math.log(prior / (1 - prior))
                for j, x in enumerate(v):
                    if x >= 0:
                        p, q = says[j] if x else [1 - y for y in says[j]]
                        odds += math.log(max(p, 1e-9) / max(q, 1e-9))
                belief[v] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        posterior.update({(kind, v): b for v, b in belief.items()})
    return posterior


def _lookup(pairs: dict[str, float], key: Column) -> Column:
    if not pairs:
        return F.lit(0.0)
    entries = F.create_map(*[x for k, v in sorted(pairs.items()) for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(entries, key), F.lit(0.0))


def personal_spans(docs: DataFrame) -> DataFrame:
    """``row, kind, start, end, base`` (boolean) of every span of ``docs(row, text)``.

    Null and empty texts have no spans; an empty table gives none.  Rows that share ``row`` must share their text and give their spans once.
    """
    all_found = matches(docs).where(_passes())
    base = all_found.where(F.col("kind").isin(*BASE)).select("row", "kind", "start", "end")
    voted = all_found.where(F.col("kind").isin(*ADDED)).withColumn("votes", F.concat_ws("/", *[v.cast("string") for v in _votes()]))
    voted = voted.select("row", "kind", "start", "end", "votes", F.array(*_features()).alias("features"))
    counts = [(r.kind, tuple(map(int, r.votes.split("/"))), r["n"]) for r in voted.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()]
    beliefs = {f"{k}/{'/'.join(map(str, v))}": p for (k, v), p in estimate(counts).items()}
    weighed = voted.withColumn("p", _lookup(beliefs, F.concat_ws("/", "kind", "votes")))
    sums = weighed.select("kind", "p", F.explode("features").alias("feature")).groupBy("kind", "feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    whole = {k: [sum(r[c] for r in sums if r.kind == k) / len(_features()) for c in ("yes", "no")] for k in ADDED}
    odds = {f"{r.kind}/{r.feature}": math.log((r.yes + 1) / (whole[r.kind][0] + 2)) - math.log((r.no + 1) / (whole[r.kind][1] + 2)) for r in sums}
    priors = {k: math.log((y + 1) / (n + 1)) for k, (y, n) in whole.items()}
    score = F.aggregate(F.transform("features", lambda f: _lookup(odds, F.concat_ws("/", F.col("kind"), f))), F.lit(0.0), lambda a, x: a + x) + _lookup(priors, F.col("kind"))
    added = voted.withColumn("score", score).where("score > 0").select("row", "kind", "start", "end")
    # An added span must not lie across a base span: the furthest end of base spans that began before, and the next base start, tell.
    both = base.withColumn("base", F.lit(True)).union(added.withColumn("base", F.lit(False)))
    order = Window.partitionBy("row").orderBy("start", F.col("base").desc(), "end", "kind")
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy("row").orderBy(F.desc("start"), "base", F.desc("end"), F.desc("kind"))
    following = F.min(F.when(F.col("base"), F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    clear = both.withColumn("clear", (F.coalesce(reach, F.lit(0)) <= F.col("start")) & (F.coalesce(following, F.col("end")) >= F.col("end")))
    return clear.where("base OR clear").select("row", "kind", "start", "end", "base")


def _keyed(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))


def pii_report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, counts of the base kinds, ``base`` and ``spans`` as ``kind:start:end`` lists.

    Null and empty texts have empty lists.  Repeated rows are kept, each with the same spans; a null ``doc_id`` stays null.  Other columns are not read.
    """
    rows = docs.select(_keyed(docs).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    place = F.array_position(F.array(*[F.lit(k) for k in BASE + ADDED]), F.col("kind"))
    spans = personal_spans(rows.where("text <> ''").select("row", "text"))
    ordered = F.array_sort(F.collect_set(F.struct(place.alias("place"), "start", "end", "kind", "base")))
    listed = spans.groupBy("row").agg(ordered.alias("s"))

    def text_of(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("s", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")

    told = listed.select("row", *map(count, BASE), text_of(F.filter("s", lambda x: x["base"])).alias("base"), text_of(F.col("s")).alias("spans"))
    joined = rows.select("row", "doc_id").join(told, "row", "left")
    return joined.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE], *[F.coalesce(c, F.lit("")).alias(c) for c in ("base", "spans")])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; overlapping spans become one.  All columns stay."""
    rows = docs.withColumn("row of redact", _keyed(docs))
    texts = rows.where(F.col("text") != "").select(F.col("row of redact").alias("row"), F.col("text").cast("string").alias("text"))
    spans = personal_spans(texts)
    order = Window.partitionBy("row").orderBy("start", "end", "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", (F.coalesce(reach, F.lit(-1)) <= F.col("start")).cast("int"))
    islands = islands.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "end", "kind")).alias("kind"))
    gap = Window.partitionBy("row").orderBy("start")
    merged = merged.withColumn("since", F.lag("end", 1, 0).over(gap))
    listed = merged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "since", "kind"))).alias("s of redact"))
    joined = rows.join(listed.withColumnRenamed("row", "row of redact"), "row of redact", "left")
    text, s = F.col("text"), F.col("`s of redact`")
    parts = F.transform(s, lambda x: F.concat(text.substr((x["since"] + 1).cast("int"), (x["start"] - x["since"]).cast("int")), F.lit("["), F.upper(x["kind"]), F.lit("]")))
    tail = F.expr("substring(text, cast(element_at(`s of redact`, -1).end + 1 as int))")
    return joined.withColumn("text", F.when(s.isNotNull(), F.concat(F.array_join(parts, ""), tail)).otherwise(text)).select(*[f"`{c}`" for c in docs.columns])
