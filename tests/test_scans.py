"""Scans: predicates, their pushdown, bounded batches, soft deletes, catalogue."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ferrywork.sources import catalog, connectors, scans

DAY = [datetime(2024, 1, d) for d in range(1, 10)]


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("src") / "t")
    data = [
        (1, DAY[0], None), (2, DAY[1], None), (3, DAY[2], None), (4, DAY[2], None), (5, DAY[2], None),
        (6, DAY[3], DAY[4]), (7, DAY[0], DAY[4]), (8, None, None), (9, None, DAY[5]),
    ]
    spark.createDataFrame(data, "id int, updated_at timestamp, deleted_at timestamp").write.parquet(path)
    return spark.read.parquet(path)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_full_scan_leaves_out_deleted_rows(source):
    assert ids(scans.live_rows(source)) == [1, 2, 3, 4, 5, 8]
    assert "Filter (" not in plan(scans.live_rows(source.drop("deleted_at")))
    assert "Sort" not in plan(scans.live_rows(source))


def test_incremental_scan_is_strict_and_pushed_down(source):
    rows = scans.incremental_rows(source, "UPDATED_AT", "2024-01-02 00:00:00")
    assert ids(rows) == [3, 4, 5]
    pushed = plan(rows).split("PushedFilters")[1]
    assert "GreaterThan(updated_at" in pushed and "IsNull(deleted_at)" in pushed
    assert ids(scans.incremental_rows(source.drop("deleted_at"), "updated_at", "2024-01-02")) == [3, 4, 5, 6]


def test_incremental_scan_without_the_column_reads_live_rows(source):
    assert ids(scans.incremental_rows(source.drop("updated_at"), "updated_at", "2024-01-02")) == [1, 2, 3, 4, 5, 8]
    assert ids(scans.incremental_rows(source, "updated_at", None)) == [1, 2, 3, 4, 5, 8]


def test_lookback_reads_late_rows_again(source):
    assert ids(scans.incremental_rows(source, "updated_at", "2024-01-03 00:00:00", lookback="2 days")) == [2, 3, 4, 5]


def test_bounded_scan_takes_all_ties_of_the_last_row(source):
    live = scans.live_rows(source)
    assert ids(scans.bounded_rows(live, "updated_at", 1)) == [1]
    assert ids(scans.bounded_rows(live, "updated_at", 3)) == [1, 2, 3, 4, 5]


def test_soft_deleted_rows(source):
    assert ids(scans.soft_deleted_rows(source, "2024-01-03", "updated_at")) == [6, 7, 9]
    assert ids(scans.soft_deleted_rows(source, "2024-01-03", "updated_at", include_touched=False)) == [7, 9]
    assert ids(scans.soft_deleted_rows(source, None, "updated_at")) == []
    assert ids(scans.soft_deleted_rows(source.drop("deleted_at"), "2024-01-03", "updated_at")) == []


def test_documents_are_flattened(spark):
    df = spark.sql("SELECT 5L AS _id, timestamp_ntz'2024-01-02 03:04:05.5' AS t, named_struct('a', 1, 'b', null) AS s, array(1, 2) AS l")
    assert tuple(scans.flatten_documents(df).first()) == ("5", "2024-01-02T03:04:05.500000", '{"a":1,"b":null}', "[1,2]")


def test_sync_mode_detection(spark):
    def mode(*columns):
        rows = [("public", "t", c, "timestamp", True, False, i) for i, c in enumerate(columns)]
        row = catalog.detect_sync_modes(spark.createDataFrame(rows, catalog.COLUMNS_SCHEMA)).first()
        return row["sync_mode"], row["bookmark_column"], row["deleted_at_column"]

    assert mode("id", "created_at", "Updated_At", "deleted_at") == ("incremental", "Updated_At", "deleted_at")
    assert mode("modified_at", "updated_at") == ("incremental", "modified_at", None)
    assert mode("id", "created_at") == ("incremental", "created_at", None)
    assert mode("id", "deleted_at") == ("full_refresh", None, None)


def test_catalogue_of_the_session(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS seen")
    spark.sql("CREATE TABLE IF NOT EXISTS seen.t (id BIGINT, name STRING) USING parquet")
    got = catalog.discover_tables(spark, ["seen"], {"t": ["id"]}).collect()
    assert [(r["table_name"], r["column_name"], r["type"], r["pk"], r["position"]) for r in got] == [
        ("t", "id", "bigint", True, 1), ("t", "name", "string", False, 2),
    ]


def test_document_inference_over_all_documents(spark):
    docs = ['{"_id": "a", "n": 1, "x": 1, "m": null}', '{"_id": "b", "n": 2, "x": 2.5, "f": true, "o": {"k": 1}}', '{"n": "text", "l": [1]}']
    df = spark.createDataFrame([(d,) for d in docs], "doc string")
    got = {r["column_name"]: (r["type"], r["pk"]) for r in catalog.infer_document_columns(df, "doc").collect()}
    assert got == {
        "_id": ("text", True), "n": ("text", False), "x": ("double", False), "m": ("null", False),
        "f": ("boolean", False), "o": ("json", False), "l": ("json", False),
    }


def test_table_globs(spark):
    include, exclude = catalog.parse_table_filter("ord*, +cust?mer, -*_tmp")
    assert (include, exclude) == (["ord*", "cust?mer"], ["*_tmp"])
    df = spark.createDataFrame([("orders",), ("ord_tmp",), ("customer",), ("x.ord",)], "n string")
    assert sorted(r[0] for r in df.where(catalog.matches_globs(F.col("n"), include, exclude)).collect()) == ["customer", "orders"]
    assert df.where(catalog.matches_globs(F.col("n"), [], ["ord.*"])).count() == 4


def test_connectors():
    with pytest.raises(ValueError, match="available: .*mysql"):
        connectors.get_connector("oracle9")
    base = {"host": "h", "port": 9000, "database": "d", "user": "u", "password": "p", "ssl": True}
    got = connectors.connector_options("clickhouse", base)
    assert got["url"] == "jdbc:clickhouse://h:8123/d" and got["ssl"] == "true" and got["user"] == "u"
    assert connectors.connector_options("mariadb", {"host": "h", "database": "d"})["url"].endswith("h:3306/d")
    assert "url" not in connectors.connector_options("parquet", {})


def test_bounds_are_looked_up(spark):
    spark.range(5, 20).createOrReplaceTempView("bounded")
    assert connectors.column_bounds(spark.sql, "bounded", "id") == (5, 19)


def test_files_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    for kind in ("parquet", "orc", "json", "csv"):
        connectors.write_table(df, kind, {}, f"{tmp_path}/{kind}", mode="overwrite")
        options = connectors.connector_options(kind, {})
        back = scans.read_files(spark, f"{tmp_path}/{kind}", kind, "id int, s string", **options)
        assert sorted(back.collect()) == sorted(df.collect())


def test_document_types_come_from_values_not_their_looks(spark):
    texts = [
        '{"_id": "1", "a": "01234", "b": "true", "c": 1, "d": true, "e": null, "f": [1], "g": {"x": 1}, "h": 1.5, "i": {"$date": "2024-01-01T00:00:00Z"}, "j": {"$date": "x", "y": 1}}',
        '{"_id": {"$oid": "5f"}, "c": 2.5, "d": "no", "e": null, "i": null, "k": {"$binary": {"base64": "AA=="}}, "l": 1e3, "m": 123456789012345678901234567890}',
        "not json", None, "[1, 2]", '{"c": null}',
    ]
    df = spark.createDataFrame([(t,) for t in texts], "doc string")
    got = {r.column_name: (r.type, r.nullable, r.pk) for r in catalog.infer_document_types(df, "doc").collect()}
    kinds = {"_id": "varchar(48)", "a": "text", "b": "text", "c": "double", "d": "text", "e": "null", "f": "json", "g": "json", "h": "double", "i": "timestamp", "j": "json", "k": "binary", "l": "double", "m": "double"}
    assert got == {k: (t, k != "_id", k == "_id") for k, t in kinds.items()}
    assert catalog.infer_document_types(df.limit(0), "doc").count() == 0


def test_document_types_of_typed_values(spark):
    df = spark.sql("SELECT to_variant_object(struct(timestamp'2024-01-01' AS t, date'2024-01-01' AS d, cast('x' AS binary) AS b, 1L AS n, 'x' AS s, map('a', 1) AS m)) AS doc")
    got = {r.column_name: r.type for r in catalog.infer_document_types(df, "doc").collect()}
    assert got == {"t": "timestamp", "d": "timestamp", "b": "binary", "n": "bigint", "s": "text", "m": "json"}


def test_discover_takes_a_numeric_change_column(spark):
    frame = spark.createDataFrame([(1, 5), (2, 9)], "id int, updated_at long")
    found = catalog.discover({"t": frame}).first()
    assert (found.bookmark_column, found.newest, found.newest_value) == ("updated_at", None, "9")
