"""Checks of loads, merges, quality checks and dead letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrywork.operators import deadletter as dl, load, merge, quality
from ferrywork.plans.fixtures import AS_OF, BOOKMARK, RUN_ID, table, view
from ferrywork.plans.registry import check
from ferrywork.plans.transform_queries import MIXED_SQL


def now():
    return F.lit(AS_OF).cast("timestamp_ntz")



@check(
    "load_raw",
    f"SELECT '{RUN_ID}' AS _run_id, o_orderkey, o_totalprice, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS status, TRUE AS keeps_nulls FROM orders",
)
def load_raw(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", "o_totalprice", "CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS status")
    raw = load.raw_rows(rows, RUN_ID, now())
    parsed = F.from_json("_data", "o_orderkey bigint, o_totalprice double, status string").alias("row")
    return raw.select("_run_id", parsed, F.col("_data").contains('"status":').alias("keeps_nulls")).select("_run_id", "row.*", "keeps_nulls")


@check("load_raw_times", "SELECT event_id, ts, ts AS ts_of_letter FROM events")
def load_raw_times(spark, sf):
    """Times keep their microseconds through raw rows and dead letters."""
    rows = table(spark, sf, "events").select("event_id", "ts")
    schema = f"event_id bigint, ts {dict(rows.dtypes)['ts']}"
    raw = load.parse_raw(load.raw_rows(rows, RUN_ID, now()), schema).select("event_id", "ts")
    letters = dl.dead_letters(rows.withColumns({dl.ERROR_TYPE: F.lit("x"), dl.ERROR_TEXT: F.lit("x")}), "s", "events", RUN_ID, now())
    mine = letters.select(F.from_json("row_data", schema).alias("row")).select("row.event_id", F.col("row.ts").alias("ts_of_letter"))
    return raw.join(mine, "event_id")


@check(
    "load_typed_append",
    f"SELECT o_orderkey::integer AS o_orderkey, o_orderstatus, NULL::double AS discount, '{RUN_ID}' AS _run_id, timestamp '{AS_OF}' AS _synced_at FROM orders",
)
def load_typed_append(spark, sf):
    schema = spark.createDataFrame([], "o_orderkey int, o_orderstatus string, discount double").schema
    return load.stamp(load.align_to(table(spark, sf, "orders"), schema), RUN_ID, now())


# The target holds the orders up to the bookmark. The changes overlap it by a
# year, and every open order is changed once more a day later.
OVERLAP = "1997-01-01 00:00:00"
_TARGET = f"SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate AS updated_at FROM orders WHERE o_orderdate <= timestamp '{BOOKMARK}'"
_CHANGES = f"""SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate AS updated_at FROM orders WHERE o_orderdate > timestamp '{OVERLAP}'
    UNION ALL SELECT o_orderkey, 'X', o_totalprice + 1, o_orderdate + INTERVAL 1 DAY FROM orders WHERE o_orderstatus = 'O'"""


def order_rows(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").alias("updated_at"))


def target_rows(spark, sf):
    return order_rows(spark, sf).where(F.col("updated_at") <= F.lit(BOOKMARK).cast("timestamp_ntz"))


def change_rows(spark, sf):
    rows = order_rows(spark, sf)
    later = rows.where("o_orderstatus = 'O'").select(
        "o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"),
        (F.col("updated_at") + F.make_dt_interval(F.lit(1))).alias("updated_at"),
    )
    return rows.where(F.col("updated_at") > F.lit(OVERLAP).cast("timestamp_ntz")).unionByName(later)


_NEWEST = f"SELECT * FROM ({_CHANGES}) QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY updated_at DESC) = 1"


@check("merge_upsert", f"SELECT * FROM ({_NEWEST}) UNION ALL SELECT * FROM ({_TARGET}) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({_CHANGES}))")
def merge_upsert(spark, sf):
    return merge.merge_rows(target_rows(spark, sf), change_rows(spark, sf), ["o_orderkey"], merge.newest_first("updated_at"))


@check("load_insert_ignore", f"SELECT * FROM ({_TARGET}) UNION ALL SELECT * FROM ({_NEWEST}) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({_TARGET}))")
def load_insert_ignore(spark, sf):
    target, rows = target_rows(spark, sf), change_rows(spark, sf)
    return target.unionByName(merge.insert_ignore(target, rows, ["o_orderkey"], merge.newest_first("updated_at")))


@check(
    "delete_by_pk",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
        WHERE (l_orderkey, l_linenumber) NOT IN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber <> 2)""",
)
def delete_by_pk(spark, sf):
    rows = table(spark, sf, "lineitem")
    # The key of line 2 is NULL in the deletes, so those name no row.
    deletes = rows.where("l_returnflag = 'R'").selectExpr("l_orderkey", "nullif(l_linenumber, 2) AS l_linenumber")
    return merge.delete_by_key(rows.select("l_orderkey", "l_linenumber", "l_partkey"), deletes, ["l_orderkey", "l_linenumber"])


@check(
    "schema_evolve_union",
    f"""SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderdate > timestamp '{BOOKMARK}' THEN o_orderpriority END AS priority FROM orders""",
)
def schema_evolve_union(spark, sf):
    """Rows from before the bookmark were loaded when there was no priority yet."""
    rows, moment = table(spark, sf, "orders"), F.lit(BOOKMARK).cast("timestamp_ntz")
    old = rows.where(F.col("o_orderdate") <= moment).select("o_orderkey", "o_orderstatus")
    new = rows.where(F.col("o_orderdate") > moment).select("o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("priority"))
    return load.evolve(old, new)


@check("raw_ttl_prune", f"SELECT event_id, ts FROM events WHERE date_trunc('hour', ts) + INTERVAL 7 DAY > timestamp '{AS_OF}'")
def raw_ttl_prune(spark, sf):
    return load.live_raw_rows(table(spark, sf, "events").select("event_id", "ts"), now(), "ts")


@check("compact_latest", "SELECT * FROM (SELECT user_id, event_type, event_id, ts, value FROM events) QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def compact_latest(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return merge.compact_latest(rows, ["user_id", "event_type"], "ts", "event_id")


@check("raw_hash_dedup", "SELECT min(doc_id) AS doc_id, text, length(text) AS size FROM documents GROUP BY text")
def raw_hash_dedup(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text")
    return load.dedup_by_hash(rows, ["text"], ["doc_id"]).select("doc_id", "text", F.length("text").cast("bigint").alias("size"))


@check("raw_replay", _NEWEST)
def raw_replay(spark, sf):
    changes = change_rows(spark, sf)
    raw = load.raw_rows(changes, RUN_ID, now())
    return load.replay_raw(raw, changes.schema, ["o_orderkey"], "updated_at")


# -- quality ----------------------------------------------------------------------

_NULLED = """SELECT l_orderkey, nullif(l_returnflag, 'R') AS l_returnflag, nullif(l_linenumber, 3) AS l_linenumber, l_quantity FROM lineitem"""


def nulled_lines(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("l_orderkey", "nullif(l_returnflag, 'R') AS l_returnflag", "nullif(l_linenumber, 3) AS l_linenumber", "l_quantity")


@check(
    "quality_row_count",
    """SELECT table_name, sum(rows_extracted)::bigint AS rows_extracted, sum(rows_loaded_analytics)::bigint AS rows_loaded,
        round_even(abs(sum(rows_extracted) - sum(rows_loaded_analytics)) / sum(rows_extracted) * 100, 2) AS discrepancy_pct,
        CASE WHEN abs(sum(rows_extracted) - sum(rows_loaded_analytics)) / sum(rows_extracted) * 100 <= 0.25 THEN 'passed' ELSE 'failed' END AS status,
        abs(sum(rows_extracted) - sum(rows_loaded_analytics)) / sum(rows_extracted) * 100 <= 0.25 AS passed
        FROM run_table_stats GROUP BY table_name""",
    ("run_table_stats",),
)
def quality_row_count(spark, sf):
    counts = view(spark, sf, "run_table_stats").groupBy("table_name").agg(
        F.sum("rows_extracted").alias("rows_extracted"), F.sum("rows_loaded_analytics").alias("rows_loaded")
    )
    return quality.row_count_check(counts, threshold=0.25)


_REQUIRED = ["l_orderkey", "l_returnflag", "l_linenumber", "absent"]
_NULL_TEXT = """'l_returnflag(' || count_if(l_returnflag IS NULL) || '), l_linenumber(' || count_if(l_linenumber IS NULL) || '), absent(' || count(*) || ')'"""


@check(
    "quality_null_check",
    f"SELECT 'null_check' AS check_type, 'warning' AS status, {_NULL_TEXT} AS null_columns, '{', '.join(_REQUIRED)}' AS required_columns, FALSE AS passed FROM ({_NULLED})",
)
def quality_null_check(spark, sf):
    return quality.null_check(nulled_lines(spark, sf), _REQUIRED)


@check(
    "quality_log",
    f"""SELECT count(*) AS rows_loaded, (SELECT count(*) FROM orders) * 4 AS rows_extracted, 'row_count' AS check_type,
        CASE WHEN abs((SELECT count(*) FROM orders) * 4 - count(*)) / ((SELECT count(*) FROM orders) * 4) * 100 <= 5 THEN 'passed' ELSE 'failed' END AS status,
        round_even(abs((SELECT count(*) FROM orders) * 4 - count(*)) / ((SELECT count(*) FROM orders) * 4) * 100, 2) AS discrepancy_pct,
        NULL::varchar AS null_columns, NULL::varchar AS required_columns,
        abs((SELECT count(*) FROM orders) * 4 - count(*)) / ((SELECT count(*) FROM orders) * 4) * 100 <= 5 AS passed FROM lineitem
      UNION ALL SELECT count(*), (SELECT count(*) FROM orders) * 4, 'null_check', 'warning', NULL, {_NULL_TEXT}, '{', '.join(_REQUIRED)}', FALSE FROM ({_NULLED})""",
)
def quality_log(spark, sf):
    extracted = table(spark, sf, "orders").agg((F.count("*") * 4).alias("n")).scalar()
    return quality.quality_log(nulled_lines(spark, sf), extracted, _REQUIRED)


@check("quality_unique_check", "SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def quality_unique_check(spark, sf):
    return quality.unique_violations(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@check(
    "quality_null_ratio",
    f"""SELECT 'l_returnflag' AS column_name, round_even(avg((l_returnflag IS NULL)::int) * 100, 2) AS null_pct, avg((l_returnflag IS NULL)::int) * 100 <= 20 AS passed FROM ({_NULLED})
      UNION ALL SELECT 'l_linenumber', round_even(avg((l_linenumber IS NULL)::int) * 100, 2), avg((l_linenumber IS NULL)::int) * 100 <= 20 FROM ({_NULLED})
      UNION ALL SELECT 'l_quantity', 0.0, TRUE""",
)
def quality_null_ratio(spark, sf):
    return quality.null_ratios(nulled_lines(spark, sf), ["l_returnflag", "l_linenumber", "l_quantity"], 20.0)


@check(
    "schema_versions",
    """SELECT event_type AS table_name, row_number() OVER (PARTITION BY event_type ORDER BY applied_at) AS version, columns, applied_at FROM (
        SELECT event_type, CASE WHEN ts < timestamp '2024-01-08' THEN 'id' WHEN ts < timestamp '2024-01-20' THEN 'id,name' ELSE 'id,name,email' END AS columns,
        min(ts) AS applied_at FROM events GROUP BY ALL)""",
)
def schema_versions(spark, sf):
    columns = F.when(F.col("ts") < "2024-01-08", "id").when(F.col("ts") < "2024-01-20", "id,name").otherwise("id,name,email")
    seen = table(spark, sf, "events").select(F.col("event_type").alias("table_name"), F.col("ts").alias("seen_at"), columns.alias("columns"))
    return quality.schema_versions(seen)


# -- dead letters -------------------------------------------------------------------

_PLACE = "l_shipdate, l_extendedprice, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus"


@check(
    "dead_letter_split",
    f"""SELECT * EXCLUDE (n), CASE WHEN l_returnflag IS NULL THEN 'NULL_CONSTRAINT' WHEN n > 1 THEN 'PK_DUPLICATE' END AS error_type,
          CASE WHEN l_returnflag IS NULL THEN 'required value is NULL: l_returnflag' WHEN n > 1 THEN 'key occurs again: ' || l_orderkey || ', ' || l_linenumber END AS error_text
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_returnflag IS NULL ORDER BY {_PLACE}) AS n
              FROM (SELECT * REPLACE (nullif(l_returnflag, 'R') AS l_returnflag) FROM lineitem))""",
)
def dead_letter_split(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("l_returnflag", F.expr("nullif(l_returnflag, 'R')"))
    errors = dl.row_errors(rows, ["l_orderkey", "l_linenumber", "l_returnflag"])
    return dl.mark_duplicates(errors, ["l_orderkey", "l_linenumber"], _PLACE.split(", "))


@check(
    "dead_letter_write",
    f"""SELECT 'shop_db' AS source_name, 'orders' AS table_name, '{RUN_ID}' AS run_id, 'value does not convert: code' AS error_text,
        'TYPE_MISMATCH' AS error_type, timestamp '{AS_OF}' AS failed_at, FALSE AS reprocessed, o_orderkey, o_totalprice, {MIXED_SQL} AS code
        FROM orders WHERE o_orderkey % 4 IN (0, 2)""",
)
def dead_letter_write(spark, sf):
    from ferrywork.operators.transforms import type_cast
    from ferrywork.plans.transform_queries import mixed_text

    casted = type_cast(mixed_text(spark, sf), {"code": "int"}, rejects="_casts", keep_row=True)
    rejected = dl.row_errors(casted, ["o_orderkey"], "_casts").where(F.col(dl.ERROR_TYPE).isNotNull())
    letters = dl.dead_letters(rejected, "Shop-DB", "orders", RUN_ID, now())
    return letters.select(
        "source_name", "table_name", "run_id", "error_text", "error_type", "failed_at", "reprocessed",
        F.from_json("row_data", "o_orderkey bigint, code string, o_totalprice double").alias("row"),
    ).select("*", "row.*").drop("row")


@check(
    "dead_letter_summary",
    "SELECT source_name, table_name, count(*) AS failed_rows, max(failed_at) AS last_failure FROM dead_letters GROUP BY ALL",
    ("dead_letters",),
)
def dead_letter_summary(spark, sf):
    return dl.summary(view(spark, sf, "dead_letters"))


@check(
    "dead_letter_page",
    "SELECT * FROM dead_letters WHERE source_name = 'src_3' ORDER BY failed_at DESC, id DESC LIMIT 50 OFFSET 20",
    ("dead_letters",),
)
def dead_letter_page(spark, sf):
    return dl.page(view(spark, sf, "dead_letters"), "src-3", 20, 50)


@check(
    "dead_letter_reprocess",
    """SELECT id, k, 'fixed-' || k AS label, CASE WHEN k > 50 THEN NULL ELSE k::double END AS small, k <= 50 AS reprocessed,
        CASE WHEN k > 50 THEN 'NULL_CONSTRAINT' END AS error_type, CASE WHEN k > 50 THEN 'required value is NULL: small' END AS error_text
        FROM (SELECT id, reprocessed, cast(json_extract_string(row_data, '$.k') AS bigint) AS k FROM dead_letters) WHERE NOT reprocessed""",
    ("dead_letters",),
)
def dead_letter_reprocess(spark, sf):
    steps = [
        {"type": "compute", "config": {"expression": "label = 'fixed-' + str(k)"}},
        {"type": "compute", "config": {"expression": "small = k / (1 if k <= 50 else 0)"}},
    ]
    return dl.reprocess(view(spark, sf, "dead_letters"), "k bigint", steps, ["k", "small"])
