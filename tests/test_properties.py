"""Random checks: merges against a dict, expressions against Python."""

import random

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import types as T

from ferrywork.functions.expressions import value_of
from ferrywork.operators import merge
from ferrywork.operators.targets import TargetTable

OPTIONS = dict(deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
CHANGES = st.lists(st.tuples(st.integers(0, 6), st.integers(0, 50), st.sampled_from("UUUD")), max_size=24)


@settings(max_examples=6, **OPTIONS)
@given(changes=CHANGES, cut=st.integers(1, 5), compact=st.booleans())
def test_any_split_into_batches_gives_the_same_table(spark, tmp_path_factory, changes, cut, compact):
    target = TargetTable(spark, str(tmp_path_factory.mktemp("t")), "t", ["k"], buckets=2)
    want = {}
    step = max(1, len(changes) // cut)
    for n, start in enumerate(range(0, len(changes), step)):
        part = {}
        for k, v, op in changes[start : start + step]:
            part[k] = (v, op)
        rows = [(k, v, op) for k, (v, op) in part.items()]
        target.append(spark.createDataFrame(rows, "k int, v int, _op string"), f"r{n}").commit()
        for k, (v, op) in part.items():
            want.pop(k, None)
            if op == "U":
                want[k] = v
        if compact and n % 2:
            target.compact()
    if changes:
        assert {r["k"]: r["v"] for r in target.read().collect()} == want


@settings(max_examples=10, **OPTIONS)
@given(old=st.dictionaries(st.integers(0, 9), st.integers(0, 99)), new=st.lists(st.tuples(st.integers(0, 9), st.integers(0, 999)), unique_by=lambda r: r[1]))
def test_merge_equals_a_dict_and_is_idempotent(spark, old, new):
    target = spark.createDataFrame(list(old.items()), "k int, v int")
    changes = spark.createDataFrame(new, "k int, v int")
    once = merge.merge_rows(target, changes, ["k"], merge.newest_first("v"))
    want = dict(old)
    newest = {}
    for k, v in new:
        newest[k] = max(v, newest.get(k, -1))
    want.update(newest)
    assert {r["k"]: r["v"] for r in once.collect()} == want
    twice = merge.merge_rows(once, changes, ["k"], merge.newest_first("v"))
    assert sorted(twice.collect()) == sorted(once.collect())


def random_expression(rng, depth):
    if depth == 0:
        return rng.choice(["a", "b", "x", "1", "2", "0", "2.5", "-3"])
    one, two, three = (random_expression(rng, depth - 1) for _ in range(3))
    return rng.choice([
        f"({one} + {two})", f"({one} - {two})", f"({one} * {two})", f"({one} / {two})", f"({one} // {two})", f"({one} % {two})",
        f"abs({one})", f"max({one}, {two})", f"min({one}, {two})", f"round({one})", f"int({one})", f"float({one})",
        f"({one} if {two} > {three} else {two})", f"(1 if {one} > 1 and {two} < 2 else 0)", f"(1 if not {one} or {two} == {three} else 0)",
        f"len(str(int({one})))",
    ])


def test_random_number_expressions(spark):
    rng = random.Random(11)
    schema = T.StructType().add("id", "integer").add("a", "long").add("b", "long").add("x", "double")
    data = [
        (i, rng.choice([None, 0, 1, -1, 3, 10, -7]), rng.choice([None, 0, 2, -2, 5]), rng.choice([None, 0.0, 0.5, -1.5, 2.25, 100.0]))
        for i in range(60)
    ]
    names = {f.__name__: f for f in (abs, max, min, round, int, float, len, str)}
    texts = sorted({random_expression(rng, rng.choice([1, 2, 2])) for _ in range(60)})
    df = spark.createDataFrame(data, schema).cache()
    got = {r["id"]: r for r in df.select("id", *[value_of(t, schema).alias(f"v{i}") for i, t in enumerate(texts)]).collect()}
    for i, text in enumerate(texts):
        for row in data:
            scope = {k: v for k, v in zip(schema.names, row) if v is not None}
            try:
                want = eval(text, {"__builtins__": {}}, {**scope, **names})
            except Exception:
                want = None
            value = got[row[0]][f"v{i}"]
            assert value == want or (value != value and want != want), (text, row, value, want)
