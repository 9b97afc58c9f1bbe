"""Row transforms, one trap each."""

import pytest
from pyspark.sql import functions as F

from ferrywork.functions.expressions import ExpressionError
from ferrywork.operators import transforms as tr


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_rename_swaps_and_later_column_wins(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    swapped = tr.rename(df, {"a": "b", "b": "a"})
    assert swapped.columns == ["b", "a", "c"] and rows(swapped) == [(1, 2, 3)]
    merged = tr.rename(df, {"a": "c"})
    assert merged.columns == ["c", "b"] and rows(merged) == [(3, 2)]
    assert tr.rename(df, {}) is df


def test_compute_keeps_old_value_on_failure(spark):
    df = spark.createDataFrame([(6, 2, "x"), (6, 0, "y"), (None, 1, "z")], "a int, b int, v string")
    assert rows(tr.compute(df, "q = a / b").select("q")) == [(3.0,), (None,), (None,)]
    assert rows(tr.compute(df, "a = a // b").select("a")) == [(3,), (6,), (None,)]
    # The new values are numbers, so old text that is no number cannot stay.
    assert rows(tr.compute(df, "v = a + 1").select("v")) == [(7,), (7,), (None,)]
    assert tr.compute(df, "no equals sign") is df


def test_filter_keeps_rows_that_fail(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "a int")
    assert rows(tr.filter_rows(df, "a > 3")) == [(5,), (None,)]
    assert rows(tr.filter_rows(df, "a > 3 and a / 0 > 1")) == [(5,), (None,)]


def test_map_values(spark):
    df = spark.createDataFrame([(1, True), (2, False), (None, None)], "n int, f boolean")
    assert rows(tr.map_values(df, "n", {"1": "one", "2": None}).select("n")) == [("one",), (None,), (None,)]
    assert rows(tr.map_values(df, "f", {"True": "yes"}).select("f")) == [("False",), ("yes",), (None,)]
    assert tr.map_values(df, "absent", {"a": "b"}) is df


def test_long_mapping_is_joined_with_the_same_result(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("s"), "id")
    mapping = {str(i): f"v{i}" for i in range(0, 2400, 2)}
    got = {r["id"]: r["s"] for r in tr.map_values(df, "s", mapping).collect()}
    assert got == {i: mapping.get(str(i), str(i)) for i in range(3000)}


def test_type_cast_names_values_that_do_not_convert(spark):
    df = spark.createDataFrame([("1", "x", 3.7), (" 2 ", "1e3", -3.7), ("1_0", None, float("nan"))], "a string, b string, c double")
    out = tr.type_cast(df, {"a": "int", "b": "float", "c": "int", "absent": "int", "d": "nope"}, rejects="bad")
    assert rows(out) == sorted([(1, None, 3, "b"), (2, 1000.0, -3, ""), (10, None, None, "c")], key=repr)


def test_type_cast_bool_and_str(spark):
    df = spark.createDataFrame([("false", 0, 1.0), ("", 2, 1e20)], "s string, n int, x double")
    assert rows(tr.type_cast(df, {"s": "bool", "n": "bool", "x": "str"})) == [(False, True, "1e+20"), (True, False, "1.0")]


def test_dates_cannot_become_numbers_and_stay(spark):
    df = spark.sql("SELECT date'2024-01-02' AS d")
    assert tr.type_cast(df, {"d": "int"}) is df
    assert rows(tr.type_cast(df, {"d": "str"})) == [("2024-01-02",)]


def test_concat_fields(spark):
    df = spark.createDataFrame([("a", None)], "x string, y int")
    assert rows(tr.concat_fields(df, ["x", "y", "absent"], "-", "t")) == [("a", None, "a-None-")]
    dropped = tr.concat_fields(df, ["x", "y"], target="x", drop_source=True)
    assert dropped.columns == []


def test_script(spark):
    df = spark.range(40).select("id", F.lit("k").alias("tag")).repartition(3)

    def step(row):
        if row["id"] % 4 == 0:
            return None
        if row["id"] % 4 == 1:
            raise RuntimeError
        if row["id"] % 4 == 2:
            return {"id": "not a number", "tag": "lost"}
        return {"id": row["id"] * 10, "extra": 1}

    got = rows(tr.script(df, step))
    want = sorted([(i, "k") if i % 4 in (1, 2) else (i * 10, None) for i in range(40) if i % 4], key=repr)
    assert got == want


def test_chain_skips_what_cannot_work(spark):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    steps = [
        {"type": "rename", "config": {"mapping": {"n": "m"}}},
        {"type": "compute", "config": {"expression": "t = n + 1"}},
        {"type": "unknown"},
        {"type": "script", "config": {"script_name": "missing"}},
        {"type": "compute", "config": {"expression": "t = m + 1"}},
    ]
    assert tr.apply_steps(df, steps).collect()[0].asDict() == {"m": 1, "s": "a", "t": 2}
    with pytest.raises(ExpressionError):
        tr.apply_steps(df, steps, strict=True)
    assert tr.apply_steps(df, None) is df


def test_mask(spark):
    df = spark.createDataFrame([("ann@example.com",), (None,), ("x",)], "e string")
    assert rows(tr.mask(df, "e")) == sorted([("a***@example.com",), (None,), ("x",)], key=repr)
