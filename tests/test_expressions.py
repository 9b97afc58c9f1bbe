"""Compiled expressions give what Python gives, row by row."""

import math
import random

import pytest
from pyspark.sql import functions as F, types as T

from ferrywork.functions import pytext
from ferrywork.functions.expressions import ExpressionError, kept_by, value_of

SCHEMA = (
    T.StructType()
    .add("id", "integer").add("a", "long").add("b", "long").add("x", "double").add("y", "double")
    .add("s", "string").add("t", "string").add("f", "boolean").add("d", "date")
)
NAMES = {
    "abs": abs, "float": float, "int": int, "str": str, "round": round,
    "max": max, "min": min, "len": len, "sum": sum, "bool": bool,
}


def rows():
    rng = random.Random(7)
    out = []
    for i in range(160):
        pick = lambda *v: rng.choice(v)
        out.append((
            i,
            pick(None, -7, -3, 0, 1, 2, 5, 7, 12345678901),
            pick(None, -3, -2, 0, 1, 2, 3),
            pick(None, -2.5, -0.5, 0.0, 0.5, 1.5, 2.5, 2.675, 1.005, 12345678.9, 1e20, 1e-5, 0.00025, 1234.125),
            pick(None, -3.0, 0.0, 0.3, 2.0, float("nan")),
            pick(None, "", "abc", "  Ab c\t", "12", " 7 ", "1_000", "x,y,z", "3.7", "-1e3", "nan?", "Ünïcode"),
            pick(None, "", "a", "b", ",", "abc"),
            pick(None, True, False),
            None,
        ))
    return out


DATA = rows()
VALUES = [
    "a + b", "a - b", "a * b", "a / b", "a // b", "a % b", "x // y", "x % y", "-a", "+f", "a + f", "a ** 2",
    "x * 0.11", "abs(a)", "abs(x)", "round(x)", "round(x, 1)", "round(x, 2)", "round(a)", "round(f)",
    "max(a, b)", "min(a, b, 3)", "max(x, a)", "min(s, t)", "max([a, b])", "sum((a, b, 1))", "len(s)",
    "int(x)", "int(s)", "float(s)", "float(a)", "bool(s)", "bool(a)", "str(a)", "str(x)", "str(f)",
    "s + t", "s + a", "s.lower()", "s.upper()", "s.strip()", "s.lstrip()", "s.rstrip()", "s.replace('b', 'ZZ')",
    "s.startswith('a')", "s.endswith('c')", "s.split(',')[1]", "s.split()[0]", "s.split(',')[-1]", "len(s.split(','))",
    "s[0]", "s[-2]", "s[1:3]", "s[:-1]", "s[-2:]", "s[2:1]", "t * 2", "f'{s}-{a}'",
    "a if f else b", "s if a > 1 else t", "a if x > 1 else x", "a and b", "a or b", "s or t", "not s", "f and a > 1",
    "1 < a < 6", "a == b", "a == s", "a != s", "s in ('abc', '12')", "a not in (1, 2, 'q')", "t in s", "a in (b, 7)",
    "a is None", "s is not None", "a < s", "x == a", "f == True", "f + 1 > a", "x > 1 or a / b > 2",
    "s.strip('a ')", "s.rstrip('c')", "s.lstrip('-x]')", "s.capitalize()", "s.find('b')", "s.find(t)", "s.count('a')", "s.count('b,')",
    "s.removeprefix('ab')", "s.removesuffix('c')", "s.removesuffix(t)", "'-'.join([s, t])", "t.join((s, 'q', s))", "s.zfill(5)", "str(a).zfill(4)",
    "a & b", "a | 1", "a ^ b", "f & f", "f | True",
    "y > 0", "y >= x", "x < y", "y == y", "y != y", "y != 2.0", "y == 0.3", "1 > y", "not y > 0", "y <= 5.0",
]
CONDITIONS = [
    "a > 1", "a > 1 and s != 'abc'", "a > 1 or b < 2", "not (a > 1 and f)", "s", "x", "a / b > 1", "s and a > 1",
    "f or a / b > 1", "a > 1 and b > 1 and x > 0", "s in ('abc', '') or t == 'a'", "a < s", "len(s) > 2 and s[0] == 'a'",
    "1 < a < 6 or not f",
]


def python_value(text, row):
    scope = {k: v for k, v in zip(SCHEMA.names, row) if isinstance(v, (int, float, str, bool))}
    try:
        value = eval(text, {"__builtins__": {}}, {**scope, **NAMES})
    except Exception:
        return None
    # Integers are 64 bits wide here; wider results count as errors.
    return None if isinstance(value, int) and abs(value) >= 2**63 else value


def same(got, want):
    if want is None or got is None:
        return got is None and want is None
    if isinstance(want, float) or isinstance(got, float):
        return math.isclose(got, want, rel_tol=0, abs_tol=0) or (math.isnan(got) and math.isnan(want))
    return got == want and isinstance(got, bool) == isinstance(want, bool)


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(DATA, SCHEMA).cache()


def test_values_match_python(frame):
    cols = [value_of(text, frame.schema).alias(f"v{i}") for i, text in enumerate(VALUES)]
    got = {r["id"]: r for r in frame.select("id", *cols).collect()}
    bad = [
        (text, row, got[row[0]][f"v{i}"], python_value(text, row))
        for i, text in enumerate(VALUES)
        for row in DATA
        if not same(got[row[0]][f"v{i}"], python_value(text, row))
    ]
    assert not bad, bad[:5]


def test_filters_keep_true_and_failing_rows(frame):
    cols = [kept_by(text, frame.schema).alias(f"c{i}") for i, text in enumerate(CONDITIONS)]
    got = {r["id"]: r for r in frame.select("id", *cols).collect()}
    for i, text in enumerate(CONDITIONS):
        for row in DATA:
            scope = {k: v for k, v in zip(SCHEMA.names, row) if v is not None}
            try:
                want = bool(eval(text, {"__builtins__": {}}, {**scope, **NAMES}))
            except Exception:
                want = True
            assert got[row[0]][f"c{i}"] is want, (text, row)


def test_round_is_exact_for_any_double(spark):
    rng = random.Random(3)
    xs = [rng.uniform(-1000, 1000) for _ in range(2000)] + [round(rng.uniform(-99, 99), 3) for _ in range(4000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for digits in (0, 1, 2):
        got = [r[0] for r in df.select(pytext.round_half_even(F.col("x"), digits)).collect()]
        assert got == [float(round(x, digits)) for x in xs]


def test_display_rounding_is_exact_and_ties_go_up(spark):
    from decimal import ROUND_HALF_UP, Decimal

    xs = [i / 1000 for i in range(1, 4000)] + [i / 7 for i in range(500)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(pytext.round_half_up(F.col("x"), 1)).collect()]
    assert got == [float(Decimal(x).quantize(Decimal("0.1"), ROUND_HALF_UP)) for x in xs]


def test_float_text_matches_str(spark):
    rng = random.Random(5)
    xs = [0.0, -0.0, 1e16, 1e15, 123456789012345.6, 9.5e-5, 1e-4, 1e7, -1e22, float("inf"), float("-inf"), float("nan")]
    xs += [rng.uniform(-1, 1) * 10 ** rng.randint(-8, 20) for _ in range(500)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(pytext.float_text(F.col("x"))).collect()]
    wrong = [(g, str(x)) for g, x in zip(got, xs) if g != str(x) and float(g) != x]
    assert not wrong, wrong[:5]


@pytest.mark.parametrize("text", ["nope + 1", "a +", "[x for x in s]", "s.title()", "open('f')", "lambda: 1", "a @ b"])
def test_unknown_forms_are_rejected(frame, text):
    with pytest.raises(ExpressionError):
        value_of(text, frame.schema)


def test_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (5, "b")], "a bigint, s string").write.parquet(path)
    df = spark.read.parquet(path)
    plan = df.where(kept_by("a > 1 and s != 'x'", df.schema))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(a,1)" in plan.split("PushedFilters")[1]


def test_whole_powers_like_python(spark):
    bases = [-(2**63), -7, -3, -2, -1, 0, 1, 2, 3, 10, 3037000499, 2**31, 2**62, None]
    exponents = [0, 1, 2, 3, 5, 9, 18, 31, 39, 62, 63, 64, 2**40, 2**62 + 1, -1, -4, None]
    df = spark.createDataFrame([(b, e) for b in bases for e in exponents], "b long, e long")

    def python(b, e):
        if b is None or e is None or (e < 0 and abs(b) != 1):
            return None
        if abs(b) > 1 and e > 64:
            return None
        if e < 0:
            return int(b**e)
        value = (1 if b == 1 or e % 2 == 0 else -1) if abs(b) == 1 else 0**e if b == 0 else b**e
        return value if -(2**63) <= value < 2**63 else None

    for r in df.select("b", "e", value_of("b ** e", df.schema).alias("p"), value_of("b ** 39", df.schema).alias("q")).collect():
        assert (r.b, r.e, r.p, r.q) == (r.b, r.e, python(r.b, r.e), python(r.b, 39))


def test_sound_but_unsupported_expressions_are_told_apart(spark):
    from ferrywork.functions.expressions import UnsupportedExpression
    from ferrywork.operators.transforms import apply_steps

    df = spark.createDataFrame([(1, "a", 2.25)], "n long, s string, f double")
    for text in ("s.title()", "'y' if n else 0", "[x for x in s]", "s.join(x for x in s)", "n.bit_length()"):
        with pytest.raises(UnsupportedExpression):
            value_of(text, df.schema)
        with pytest.raises(UnsupportedExpression):
            apply_steps(df, [{"type": "filter", "config": {"condition": text}}])
    for text in ("n +", "missing > 1", "unknown(n)", "s.no_such()", "n.upper()"):
        with pytest.raises(ExpressionError) as caught:
            value_of(text, df.schema)
        assert not isinstance(caught.value, UnsupportedExpression)
        assert apply_steps(df, [{"type": "filter", "config": {"condition": text}}]).count() == 1
    assert df.select(value_of("round(f, ndigits=1)", df.schema)).first()[0] == 2.2
