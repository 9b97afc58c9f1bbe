"""Checks of sources, catalogue and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrywork.functions import formats, names
from ferrywork.operators import deadletter, state
from ferrywork.plans.fixtures import BOOKMARK, table, view
from ferrywork.plans.registry import check
from ferrywork.session import scratch_path
from ferrywork.sources import catalog, scans

TABLES = ["customer", "documents", "events", "lineitem", "nation", "orders", "part", "region", "supplier"]


@check("scan_full_live", "SELECT * FROM src_orders WHERE deleted_at IS NULL", ("src_orders",))
def scan_full_live(spark, sf):
    return scans.live_rows(view(spark, sf, "src_orders"))


@check(
    "scan_incremental",
    f"SELECT * FROM src_orders WHERE updated_at > timestamp '{BOOKMARK}' AND deleted_at IS NULL",
    ("src_orders",),
)
def scan_incremental(spark, sf):
    return scans.incremental_rows(view(spark, sf, "src_orders"), "updated_at", BOOKMARK)


@check("scan_incremental_no_wm", "SELECT o_orderkey, o_custkey, deleted_at FROM src_orders WHERE deleted_at IS NULL", ("src_orders",))
def scan_incremental_no_wm(spark, sf):
    source = view(spark, sf, "src_orders").select("o_orderkey", "o_custkey", "deleted_at")
    return scans.incremental_rows(source, "updated_at", BOOKMARK)


@check("scan_incremental_int", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey > 7000")
def scan_incremental_int(spark, sf):
    source = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return scans.incremental_rows(source, "l_orderkey", "7000")


@check(
    "scan_batch_limited",
    f"""SELECT * FROM src_orders WHERE updated_at > timestamp '{BOOKMARK}' AND deleted_at IS NULL AND updated_at <= (
        SELECT max(updated_at) FROM (SELECT updated_at FROM src_orders
            WHERE updated_at > timestamp '{BOOKMARK}' AND deleted_at IS NULL ORDER BY updated_at LIMIT 500))""",
    ("src_orders",),
)
def scan_batch_limited(spark, sf):
    rows = scans.incremental_rows(view(spark, sf, "src_orders"), "updated_at", BOOKMARK)
    return scans.bounded_rows(rows, "updated_at", 500)


@check(
    "scan_batch_cut",
    f"""SELECT * FROM src_orders WHERE updated_at > timestamp '{BOOKMARK}' AND deleted_at IS NULL AND updated_at <= (
        SELECT max(updated_at) FROM (SELECT updated_at FROM src_orders
            WHERE updated_at > timestamp '{BOOKMARK}' AND deleted_at IS NULL ORDER BY updated_at LIMIT 4000))""",
    ("src_orders",),
)
def scan_batch_cut(spark, sf):
    """The same batch at sizes where the oldest rows do not fit one task."""
    rows = scans.incremental_rows(view(spark, sf, "src_orders"), "updated_at", BOOKMARK)
    return scans.cut_rows(rows, "updated_at", 4000)


@check(
    "scan_files_text",
    " UNION ALL ".join(
        f"""SELECT '{f}' AS format, count(*) AS n, count(o_orderpriority) AS named, sum(o_orderkey)::bigint AS keys, min(o_orderdate) AS first, max(o_totalprice) AS dearest,
            (SELECT count(*) FROM orders WHERE o_orderkey % 50 = 7) {'' if f in ('csv', 'json') else '* 0'} AS broken FROM (SELECT * REPLACE (nullif(o_orderpriority, '5-LOW') AS o_orderpriority) FROM orders)"""
        for f in ("csv", "json", "orc", "parquet")
    ),
)
def scan_files_text(spark, sf):
    """Rows written to four file formats and read back; of the text formats, lines that were cut short become dead letters."""
    rows = table(spark, sf, "orders").withColumn("o_orderpriority", F.expr("nullif(o_orderpriority, '5-LOW')"))
    out = None
    for file_format in ("csv", "json", "orc", "parquet"):
        path = scratch_path(spark, file_format)
        scans.export_files(rows, path, file_format)
        if file_format in ("csv", "json"):
            rows.where("o_orderkey % 50 = 7").select(F.concat(F.lit('{"o_orderkey": '), F.col("o_orderkey").cast("string"), F.lit(', "half'))).write.mode("append").text(path)
            found = scans.read_lines(spark, path, file_format, rows.schema, **scans.import_options(file_format))
            sound, broken = scans.split_broken(found)
            letters = deadletter.dead_letters(broken, "files", "orders", "run-1", F.lit("2024-01-01").cast("timestamp")).where("row_data LIKE '%half%'")
        else:
            sound, letters = scans.read_files(spark, path, file_format), rows.limit(0)
        sums = sound.agg(
            F.count("*").alias("n"), F.count("o_orderpriority").alias("named"), F.sum("o_orderkey").alias("keys"),
            F.min("o_orderdate").alias("first"), F.max("o_totalprice").alias("dearest"),
        )
        part = sums.withColumns({"format": F.lit(file_format), "broken": letters.agg(F.count("*")).scalar()})
        out = part if out is None else out.unionByName(part)
    return out


@check(
    "scan_documents_json",
    """SELECT event_id, cast(json_extract_string(props, '$.k') AS bigint) AS k,
        strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END AS ts
        FROM events""",
)
def scan_documents_json(spark, sf):
    rows = scans.json_documents(table(spark, sf, "events"), "props", "k bigint", keep=["event_id", "ts"])
    return scans.flatten_documents(rows)


@check(
    "scan_soft_deletes",
    f"SELECT o_orderkey, updated_at, deleted_at FROM src_orders WHERE deleted_at > timestamp '{BOOKMARK}'",
    ("src_orders",),
)
def scan_soft_deletes(spark, sf):
    rows = scans.soft_deleted_rows(view(spark, sf, "src_orders"), BOOKMARK, "updated_at")
    return rows.select("o_orderkey", "updated_at", "deleted_at")


@check(
    "scan_soft_deletes_untouched",
    f"""SELECT o_orderkey, updated_at, deleted_at FROM src_orders
        WHERE deleted_at > timestamp '{BOOKMARK}' AND (updated_at IS NULL OR updated_at <= timestamp '{BOOKMARK}')""",
    ("src_orders",),
)
def scan_soft_deletes_untouched(spark, sf):
    rows = scans.soft_deleted_rows(view(spark, sf, "src_orders"), BOOKMARK, "updated_at", include_touched=False)
    return rows.select("o_orderkey", "updated_at", "deleted_at")


@check(
    "scan_files",
    "SELECT l_returnflag, count(*) AS n, sum(cast(l_quantity AS bigint))::bigint AS quantity FROM lineitem GROUP BY l_returnflag",
)
def scan_files(spark, sf):
    rows = scans.read_files(spark, f"{sf}/lineitem.parquet", "parquet")
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))


@check(
    "discover_tables",
    " UNION ALL ".join(
        f"SELECT 'public' AS schema_name, '{t}' AS table_name, count(*) AS row_count, "
        f"(SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}') AS column_count FROM {t}"
        for t in TABLES
    ),
)
def discover_tables(spark, sf):
    frames = {t: table(spark, sf, t) for t in TABLES}
    return catalog.tables_of(frames, "public")


_DUCK_TYPES = """CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
    WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END"""
_LISTED = ", ".join(f"'{t}'" for t in TABLES)


_ROWS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES)


@check(
    "describe_columns",
    f"""SELECT table_name, column_name, {_DUCK_TYPES} AS type, cast(ordinal_position AS bigint) AS position, row_count
        FROM information_schema.columns JOIN ({_ROWS}) USING (table_name)""",
)
def describe_columns(spark, sf):
    frames = {t: table(spark, sf, t) for t in TABLES}
    columns = catalog.columns_of(frames, "public").select(
        "table_name", "column_name", "type", F.col("position").cast("bigint").alias("position")
    )
    return columns.join(catalog.tables_of(frames, "public").select("table_name", "row_count"), "table_name")


@check(
    "infer_json_schema",
    """SELECT key AS column_name, CASE WHEN count(DISTINCT kind) = 1 THEN max(kind) ELSE 'text' END AS type, TRUE AS nullable, FALSE AS pk
        FROM (SELECT unnest(json_keys(props)) AS key, CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'bigint' WHEN 'BIGINT' THEN 'bigint'
              WHEN 'DOUBLE' THEN 'double' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'text' END AS kind FROM events)
        GROUP BY key""",
)
def infer_json_schema(spark, sf):
    return catalog.infer_document_columns(table(spark, sf, "events"), "props")


@check(
    "detect_sync_mode",
    """SELECT 'src_orders' AS table_name, 'incremental' AS sync_mode, 'updated_at' AS bookmark_column, 'deleted_at' AS deleted_at_column,
            count(*) AS row_count, max(updated_at) AS newest FROM src_orders
        UNION ALL SELECT 'orders', 'full_refresh', NULL, NULL, count(*), NULL FROM orders
        UNION ALL SELECT 'events', 'incremental', 'created_at', NULL, count(*), max(ts) FROM events""",
    ("src_orders",),
)
def detect_sync_mode(spark, sf):
    """Sync mode per table, with its rows and the newest value of the column it found."""
    frames = {
        "orders": table(spark, sf, "orders"),
        "events": table(spark, sf, "events").withColumnRenamed("ts", "created_at"),
        "src_orders": view(spark, sf, "src_orders"),
    }
    return catalog.discover(frames, "public").drop("schema_name", "column_count", "newest_value")


ALL_TABLES = [*TABLES, "benchmark", "conversations", "embeddings", "labels", "pages"]
_ALL_ROWS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in ALL_TABLES)


@check(
    "discover_all_tables",
    f"""SELECT 'public' AS schema_name, table_name, row_count, (SELECT count(*) FROM information_schema.columns c WHERE c.table_name = r.table_name) AS column_count
        FROM ({_ALL_ROWS}) r""",
)
def discover_all_tables(spark, sf):
    return catalog.tables_of({t: table(spark, sf, t) for t in ALL_TABLES}, "public")


@check(
    "describe_all_columns",
    f"""SELECT table_name, column_name, CASE WHEN data_type LIKE 'FLOAT%' OR data_type LIKE 'DOUBLE[%' THEN 'array' ELSE {_DUCK_TYPES} END AS type,
        cast(ordinal_position AS bigint) AS position, row_count FROM information_schema.columns JOIN ({_ALL_ROWS}) USING (table_name)""",
)
def describe_all_columns(spark, sf):
    frames = {t: table(spark, sf, t) for t in ALL_TABLES}
    kind = F.when(F.col("type").startswith("array"), "array").otherwise(F.col("type"))
    columns = catalog.columns_of(frames, "public").select("table_name", "column_name", kind.alias("type"), F.col("position").cast("bigint").alias("position"))
    return columns.join(catalog.tables_of(frames, "public").select("table_name", "row_count"), "table_name")


@check(
    "discover_bookmarks",
    """SELECT 'events' AS table_name, 'incremental' AS sync_mode, 'created_at' AS bookmark_column, count(*) AS row_count, max(ts) AS newest, CAST(NULL AS varchar) AS number FROM events
        UNION ALL SELECT 'lineitem', 'incremental', 'updated_at', count(*), NULL, CAST(max(l_orderkey) AS varchar) FROM lineitem
        UNION ALL SELECT 'part', 'full_refresh', NULL, count(*), NULL, NULL FROM part""",
)
def discover_bookmarks(spark, sf):
    """A change column may count versions in place of times."""
    frames = {
        "events": table(spark, sf, "events").withColumnRenamed("ts", "created_at"),
        "lineitem": table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "updated_at"),
        "part": table(spark, sf, "part"),
    }
    found = catalog.discover(frames, "public")
    number = F.when(F.col("newest").isNull(), F.col("newest_value")).alias("number")
    return found.select("table_name", "sync_mode", "bookmark_column", "row_count", "newest", number)


# Documents of four tables, with the fields that a text pattern would take for something else.
_DOCUMENTS = {
    "orders": {
        "_id": "cast(o_orderkey AS string)", "code": "lpad(cast(o_orderkey AS string), 9, '0')", "total": "o_totalprice", "open": "o_orderstatus = 'O'",
        "flag": "CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END", "made": "{$date}cast(o_orderdate AS string)", "shop": "{key}o_custkey",
        "mixed": "CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END", "never": "cast(NULL AS string)", "rank": "o_custkey",
    },
    "customer": {
        "_id": "{$oid}c_name", "code": "c_mktsegment", "total": "c_acctbal", "tags": "[c_mktsegment]", "mixed": "{$binary}c_name", "rank": "c_acctbal + 0.5",
    },
    "nation": {"_id": "cast(n_nationkey AS bigint)", "code": "cast(n_nationkey AS bigint)", "blob": "{$binary}n_name", "rank": "cast(n_nationkey AS bigint)", "owner": "{$oid}n_name"},
    "events": {"_id": "event_id", "seen": "{$date}cast(ts AS string)", "open": "value > 10", "big": "event_id * 1000003", "mixed": "event_type"},
}


def _document_sql(expr: str, duck: bool) -> str:
    if expr.startswith("{"):
        key, inner = expr[1:].split("}", 1)
        return f"json_object('{key}', {inner})" if duck else f"named_struct('{key}', {inner})"
    if expr.startswith("["):
        return f"json_array({expr[1:-1]})" if duck else f"array({expr[1:-1]})"
    return expr


def _duck_documents() -> str:
    parts = []
    for name, fields in _DOCUMENTS.items():
        pairs = ", ".join(f"'{k}', {_document_sql(e, True)}" for k, e in fields.items()).replace("AS string)", "AS varchar)")
        parts.append(f"SELECT json_object({pairs}) AS doc FROM {name}")
    return " UNION ALL ".join(parts)


def documents_of_tables(spark, sf):
    out = None
    for name, fields in _DOCUMENTS.items():
        rows = table(spark, sf, name).select(F.to_json(F.struct(*[F.expr(_document_sql(e, False)).alias(k) for k, e in fields.items()]), {"ignoreNullFields": "false"}).alias("doc"))
        out = rows if out is None else out.unionByName(rows)
    return out


@check(
    "infer_document_types",
    f"""WITH docs AS ({_duck_documents()}), fields AS (
            SELECT key, json_extract(doc, '$."' || key || '"') AS value FROM (SELECT doc, unnest(json_keys(doc)) AS key FROM docs)
        ), kinds AS (
            SELECT key, CASE WHEN json_type(value) IN ('UBIGINT', 'BIGINT') THEN 'bigint' WHEN json_type(value) = 'DOUBLE' THEN 'double' WHEN json_type(value) = 'BOOLEAN' THEN 'boolean'
                WHEN json_type(value) = 'NULL' THEN NULL WHEN json_type(value) = 'ARRAY' THEN 'json' WHEN json_type(value) <> 'OBJECT' THEN 'text'
                WHEN json_keys(value) = ['$date'] THEN 'timestamp' WHEN json_keys(value) = ['$oid'] THEN 'varchar(48)' WHEN json_keys(value) = ['$binary'] THEN 'binary'
                ELSE 'json' END AS kind FROM fields
        )
        SELECT key AS column_name, CASE WHEN key = '_id' THEN 'varchar(48)' WHEN count(kind) = 0 THEN 'null' WHEN count(DISTINCT kind) = 1 THEN max(kind)
            WHEN list_sort(list(DISTINCT kind)) = ['bigint', 'double'] THEN 'double' ELSE 'text' END AS type, key <> '_id' AS nullable, key = '_id' AS pk FROM kinds GROUP BY key""",
)
def infer_document_types(spark, sf):
    """Types of the fields of mixed documents: quoted digits and truth values stay text, wrapped times, ids and bytes are told apart."""
    return catalog.infer_document_types(documents_of_tables(spark, sf), "doc")


@check("raw_json_extract", "SELECT event_id, cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events")
def raw_json_extract(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k")
    )


@check("safe_name", "SELECT c_custkey, translate(lower(c_name || '.' || c_mktsegment || '-x y'), '-. ', '___') AS safe FROM customer")
def safe_name(spark, sf):
    text = F.concat("c_name", F.lit("."), "c_mktsegment", F.lit("-x y"))
    return table(spark, sf, "customer").select("c_custkey", names.safe_name(text).alias("safe"))


_DECLARED = "CASE p_size % 6 WHEN 0 THEN 'VARCHAR(' || p_size || ')' WHEN 1 THEN 'TinyInt(1)' WHEN 2 THEN 'decimal(12, 4)' WHEN 3 THEN 'BIGINT unsigned' WHEN 4 THEN 'datetime' ELSE p_type END"


@check(
    "type_map",
    """SELECT p_partkey, CASE p_size % 6 WHEN 1 THEN 'boolean' WHEN 2 THEN 'decimal(12,4)' WHEN 3 THEN 'bigint' WHEN 4 THEN 'timestamp'
        ELSE 'string' END AS spark_type, lower(regexp_extract(CASE p_size % 6 WHEN 0 THEN 'VARCHAR(9)' WHEN 1 THEN 'TinyInt(1)'
        WHEN 2 THEN 'decimal(12, 4)' WHEN 3 THEN 'BIGINT unsigned' WHEN 4 THEN 'datetime' ELSE p_type END, '^([^( ]*)', 1)) AS token FROM part""",
)
def type_map(spark, sf):
    declared = F.expr(_DECLARED)
    return table(spark, sf, "part").select(
        "p_partkey", names.spark_type_name(declared).alias("spark_type"), names.type_token(declared).alias("token")
    )


@check(
    "iso_parse",
    "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN ts END AS parsed FROM events",
)
def iso_parse(spark, sf):
    text = F.when(F.col("event_id") % 5 == 0, "not a time").otherwise(F.concat(formats.iso_text(F.col("ts")), F.lit("Z")))
    return table(spark, sf, "events").select("event_id", formats.iso_time(text).cast("timestamp_ntz").alias("parsed"))


@check(
    "iso_format",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso FROM orders",
)
def iso_format(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", formats.iso_text(F.col("o_orderdate")).alias("iso"))


@check(
    "table_globs",
    "SELECT p_partkey, p_name FROM part WHERE (p_name LIKE 'Part%1' OR p_name LIKE '%_5_') AND NOT p_name LIKE '%99%'",
)
def table_globs(spark, sf):
    include, exclude = catalog.parse_table_filter("Part*1, +*?5?, -*99*")
    return table(spark, sf, "part").where(catalog.matches_globs(F.col("p_name"), include, exclude)).select("p_partkey", "p_name")


@check(
    "table_filter",
    """SELECT p_partkey, p_brand, p_type FROM part WHERE (p_brand LIKE 'Brand%1' OR p_brand LIKE '%d#_5') AND NOT p_brand LIKE '%3%' AND p_type LIKE '%E%'""",
)
def table_filter(spark, sf):
    """Globs that keep some names and reject others, one list per column."""
    include, exclude = catalog.parse_table_filter("Brand*1, +*d#?5, -*3*")
    kinds, _ = catalog.parse_table_filter("*E*")
    rows = table(spark, sf, "part").where(catalog.matches_globs(F.col("p_brand"), include, exclude) & catalog.matches_globs(F.col("p_type"), kinds, []))
    return rows.select("p_partkey", "p_brand", "p_type")


@check(
    "schema_drift",
    """SELECT 'orders' AS table_name, name AS column_name, type FROM (SELECT unnest(['deleted_at', 'updated_at']) AS name, 'text' AS type)
        WHERE (SELECT count(*) FROM orders) > 0""",
)
def schema_drift(spark, sf):
    """Fields found in all documents that the target table has no column for."""
    documents = view(spark, sf, "src_orders").withColumn("_x", F.lit(1)).select(F.to_json(F.struct("*")).alias("doc"))
    found = catalog.infer_document_columns(documents, "doc").withColumn("table_name", F.lit("orders"))
    target = catalog.columns_of({"orders": table(spark, sf, "orders").withColumnRenamed("o_custkey", "O_CUSTKEY")}, "public")
    return catalog.new_columns(found, target).select("table_name", "column_name", "type")


# -- bookmarks ------------------------------------------------------------------

# Every event is one state update: user = pipeline, event type = table.
_LOG = """SELECT cast(user_id AS varchar) AS pipeline_id, event_type AS source_table, cast(event_id AS varchar) AS bookmark_value,
    ts AS last_synced_at FROM events"""
_LATEST = f"SELECT * FROM ({_LOG}) QUALIFY row_number() OVER (PARTITION BY pipeline_id, source_table ORDER BY last_synced_at DESC) = 1"


def bookmark_log(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("pipeline_id"),
        F.col("event_type").alias("source_table"),
        F.col("event_id").cast("string").alias("bookmark_value"),
        F.lit(1).cast("bigint").alias("row_count"),
        F.lit("run").alias("last_run_id"),
        F.col("ts").alias("last_synced_at"),
    )


STATE_COLUMNS = ["pipeline_id", "source_table", "bookmark_value", "last_synced_at"]


@check("bookmark_upsert", _LATEST)
def bookmark_upsert(spark, sf):
    log = bookmark_log(spark, sf)
    old, new = log.where("last_synced_at < '2024-01-15'"), log.where("last_synced_at >= '2024-01-15'")
    return state.upsert_bookmarks(state.current_bookmarks(old), new).select(STATE_COLUMNS)


@check("bookmark_get", f"SELECT bookmark_value FROM ({_LATEST}) WHERE pipeline_id = '7' AND source_table = 'click'")
def bookmark_get(spark, sf):
    mine = bookmark_log(spark, sf).where((F.col("pipeline_id") == "7") & (F.col("source_table") == "click"))
    return state.current_bookmarks(mine).select("bookmark_value")


@check("bookmark_advance", f"SELECT cast(max(o_orderkey) AS varchar) AS bookmark_value, count(*) AS row_count FROM orders WHERE o_orderdate > timestamp '{BOOKMARK}'")
def bookmark_advance(spark, sf):
    loaded = scans.incremental_rows(table(spark, sf, "orders"), "o_orderdate", BOOKMARK)
    return state.bookmark_after(loaded, "o_orderkey")


@check("bookmark_reset", f"SELECT pipeline_id, source_table, CASE WHEN source_table <> 'click' THEN bookmark_value END AS bookmark_value FROM ({_LATEST})")
def bookmark_reset(spark, sf):
    now = state.current_bookmarks(bookmark_log(spark, sf))
    cleared = state.reset_rows(now, F.col("source_table") == "click", F.lit("2024-02-01").cast("timestamp_ntz"))
    return state.upsert_bookmarks(now, cleared).select("pipeline_id", "source_table", "bookmark_value")


@check(
    "backfill_from",
    "SELECT o_orderkey, updated_at FROM src_orders WHERE updated_at > timestamp '1999-06-01' AND deleted_at IS NULL",
    ("src_orders",),
)
def backfill_from(spark, sf):
    mine = bookmark_log(spark, sf).where((F.col("pipeline_id") == "7") & (F.col("source_table") == "click"))
    now = state.current_bookmarks(mine)
    moved = state.backfill_rows(now, F.lit(True), "1999-06-01 00:00:00", F.lit("2024-02-01").cast("timestamp_ntz"))
    floor = state.upsert_bookmarks(now, moved).select(F.col("bookmark_value").try_cast("timestamp_ntz")).scalar()
    rows = scans.live_rows(view(spark, sf, "src_orders"))
    return rows.where(F.col("updated_at") > floor).select("o_orderkey", "updated_at")
