"""Checks of row transforms and of the expression language."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrywork.functions.expressions import value_of
from ferrywork.operators import transforms as tr
from ferrywork.plans.fixtures import table
from ferrywork.plans.registry import check


@check("t_rename", "SELECT c_custkey AS id, c_name AS name, c_acctbal FROM customer")
def t_rename(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return tr.rename(rows, {"c_custkey": "id", "c_name": "name", "absent": "x"})


@check("t_rename_swap", "SELECT o_custkey AS o_orderkey, o_orderkey AS o_custkey, o_totalprice FROM orders")
def t_rename_swap(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return tr.rename(rows, {"o_orderkey": "o_custkey", "o_custkey": "o_orderkey"})


@check("t_remove_fields", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def t_remove_fields(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_discount")
    return tr.remove_fields(rows, ["l_tax", "l_discount", "absent"])


@check("t_compute", "SELECT o_orderkey, o_totalprice, o_totalprice * 0.11::double AS tax FROM orders")
def t_compute(spark, sf):
    return tr.compute(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "tax = o_totalprice * 0.11")


@check(
    "t_compute_overwrite",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE o_totalprice / (o_orderkey % 3) END AS o_totalprice FROM orders",
)
def t_compute_overwrite(spark, sf):
    return tr.compute(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice = o_totalprice / (o_orderkey % 3)")


@check(
    "t_compute_null_input",
    "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice + 1 END AS plus FROM orders",
)
def t_compute_null_input(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price")
    return tr.compute(rows, "plus = price + 1")


@check("t_filter", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_quantity > 25 AND l_returnflag <> 'R'")
def t_filter(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return tr.filter_rows(rows, "l_quantity > 25 and l_returnflag != 'R'")


@check(
    "t_filter_keeps_null",
    "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS price FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 200000",
)
def t_filter_keeps_null(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS price")
    return tr.filter_rows(rows, "price > 200000")


@check("t_map_values", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'final' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def t_map_values(spark, sf):
    return tr.map_values(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"O": "open", "F": "final"})


_MIXED = "CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN ' ' || {key} || ' ' WHEN 2 THEN '3.7' ELSE {key} END"

MIXED_SQL = _MIXED.format(key="cast(o_orderkey AS varchar)")


def mixed_text(spark, sf):
    text = _MIXED.format(key="cast(o_orderkey AS string)")
    return table(spark, sf, "orders").selectExpr("o_orderkey", f"{text} AS code", "o_totalprice")


@check(
    "t_cast_int",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (1, 3) THEN o_orderkey END AS code, cast(trunc(o_totalprice) AS bigint) AS o_totalprice FROM orders",
)
def t_cast_int(spark, sf):
    return tr.type_cast(mixed_text(spark, sf), {"code": "int", "o_totalprice": "int", "absent": "int"})


@check("t_cast_float", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 2 THEN 3.7::double ELSE o_orderkey::double END AS code FROM orders")
def t_cast_float(spark, sf):
    return tr.type_cast(mixed_text(spark, sf).drop("o_totalprice"), {"code": "float"})


@check("t_cast_str", "SELECT l_orderkey::varchar AS l_orderkey, l_linenumber::varchar AS l_linenumber, l_quantity::varchar AS l_quantity, CASE WHEN l_quantity > 25 THEN 'True' ELSE 'False' END AS big FROM lineitem")
def t_cast_str(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity", "l_quantity > 25 AS big")
    return tr.type_cast(rows, {"l_orderkey": "str", "l_linenumber": "str", "l_quantity": "str", "big": "str"})


@check("t_cast_bool", "SELECT o_orderkey, o_orderkey % 2 <> 0 AS odd, CASE WHEN o_orderstatus = 'P' THEN FALSE ELSE TRUE END AS status FROM orders")
def t_cast_bool(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderkey % 2 AS odd", "CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'false' END AS status")
    return tr.type_cast(rows, {"odd": "bool", "status": "bool"})


@check(
    "t_concat_fields",
    "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS s, o_orderkey || '/' || CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus ELSE 'None' END || '/' AS label FROM orders",
)
def t_concat_fields(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS s")
    return tr.concat_fields(rows, ["o_orderkey", "s", "absent"], "/", "label")


@check("t_concat_drop_source", "SELECT c_custkey, c_name || ' ' || c_mktsegment AS full_name FROM customer")
def t_concat_drop_source(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return tr.concat_fields(rows, ["c_name", "c_mktsegment"], target="full_name", drop_source=True)


@check(
    "t_script_udtf",
    """SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN role ELSE upper(role) END AS role,
        CASE WHEN turn % 5 = 4 THEN text ELSE reverse(text) END AS text FROM conversations WHERE turn % 5 <> 3""",
)
def t_script_udtf(spark, sf):
    def transform(row):
        if row["turn"] % 5 == 3:
            return None
        row["role"] = row["role"].upper()
        row["text"] = row["text"][::-1]
        if row["turn"] % 5 == 4:
            raise ValueError("the original row is kept")
        return row

    return tr.script(table(spark, sf, "conversations"), transform)


CHAIN = [
    {"type": "filter", "config": {"condition": "o_orderstatus != 'F'"}},
    {"type": "compute", "config": {"expression": "tax = o_totalprice * 0.11", "type": "decimal"}},
    {"type": "rename", "config": {"mapping": {"o_orderkey": "order_id", "o_totalprice": "total"}}},
    {"type": "compute", "config": {"expression": "band = 'high' if total > 250000 else 'low'"}},
    {"type": "map_values", "config": {"column": "o_orderstatus", "mapping": {"O": "open"}}},
    {"type": "concat_fields", "config": {"fields": ["order_id", "band"], "separator": "-", "target": "label"}},
    {"type": "no_such_step", "config": {}},
    {"type": "compute", "config": {"expression": "x = unknown_name + 1"}},
    {"type": "remove_fields", "config": {"fields": ["o_orderdate", "o_orderpriority"]}},
]
CHAIN_SQL = """SELECT o_orderkey AS order_id, o_custkey, CASE o_orderstatus WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus,
    o_totalprice AS total, o_totalprice * 0.11::double AS tax, CASE WHEN o_totalprice > 250000 THEN 'high' ELSE 'low' END AS band,
    o_orderkey || '-' || CASE WHEN o_totalprice > 250000 THEN 'high' ELSE 'low' END AS label
    FROM orders WHERE o_orderstatus <> 'F'"""


@check("t_chain", CHAIN_SQL)
def t_chain(spark, sf):
    return tr.apply_steps(table(spark, sf, "orders"), CHAIN)


@check("t_mask", "SELECT c_custkey, left(c_name, 1) || '***@example.com' AS email, sha256(c_mktsegment) AS segment FROM customer")
def t_mask(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit("@example.com")).alias("email"), F.col("c_mktsegment").alias("segment"))
    return tr.mask(tr.mask(rows, "email"), "segment", "sha256")


def values(df, keys, **expressions):
    return df.select(*keys, *[value_of(text, df.schema).alias(name) for name, text in expressions.items()])


@check(
    "x_arith",
    """SELECT l_orderkey, l_linenumber, l_quantity + l_linenumber AS added, l_quantity * l_discount - l_tax AS mixed,
        CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity / (l_linenumber - 3) END AS ratio, l_linenumber::bigint * l_linenumber AS squared,
        -l_quantity AS negated, abs(l_linenumber - 4)::bigint AS distance FROM lineitem""",
)
def x_arith(spark, sf):
    return values(
        table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"],
        added="l_quantity + l_linenumber", mixed="l_quantity * l_discount - l_tax", ratio="l_quantity / (l_linenumber - 3)",
        squared="l_linenumber ** 2", negated="-l_quantity", distance="abs(l_linenumber - 4)",
    )


@check(
    "x_logic_nulls",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_totalprice > 100000 THEN o_custkey > 10 ELSE FALSE END AS both_hold,
        CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_totalprice > 100000 THEN TRUE ELSE o_custkey > 10 END AS either_holds,
        CASE WHEN o_custkey <= 10 THEN FALSE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice > 100000 END AS late_null,
        CASE WHEN o_orderstatus = 'F' THEN NULL ELSE NOT o_totalprice > 100000 END AS negated FROM orders""",
)
def x_logic_nulls(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey", "CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS price")
    return values(
        rows, ["o_orderkey"], both_hold="price > 100000 and o_custkey > 10", either_holds="price > 100000 or o_custkey > 10",
        late_null="o_custkey > 10 and price > 100000", negated="not price > 100000",
    )


@check(
    "x_round_half_even",
    """SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0)::bigint AS halves, round_even(l_quantity / 8, 2) AS eighths,
        l_linenumber::bigint AS whole FROM lineitem""",
)
def x_round_half_even(spark, sf):
    return values(
        table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"],
        halves="round(l_quantity / 2)", eighths="round(l_quantity / 8, 2)", whole="round(l_linenumber)",
    )


@check(
    "x_floor_mod",
    """SELECT o_orderkey, floor((o_orderkey - 700) / 7.0)::bigint AS quotient, ((o_orderkey - 700) % 7 + 7) % 7 AS rest,
        floor((o_orderkey - 700) / -7.0)::bigint AS negative_quotient, ((o_orderkey - 700) % -7 - 7) % -7 AS negative_rest,
        CASE WHEN o_custkey % 2 = 1 THEN o_orderkey % (o_custkey % 2) END AS by_zero FROM orders""",
)
def x_floor_mod(spark, sf):
    return values(
        table(spark, sf, "orders"), ["o_orderkey"], quotient="(o_orderkey - 700) // 7", rest="(o_orderkey - 700) % 7",
        negative_quotient="(o_orderkey - 700) // -7", negative_rest="(o_orderkey - 700) % -7", by_zero="o_orderkey % (o_custkey % 2)",
    )


@check(
    "x_minmax",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN greatest(o_totalprice, 200000) END AS top,
        CASE WHEN o_orderstatus <> 'F' THEN least(o_totalprice, 200000) END AS low, greatest(o_orderkey, o_custkey, 500) AS most,
        least(o_orderpriority, '3') AS first_text, o_orderkey + o_custkey + 1 AS total FROM orders""",
)
def x_minmax(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("*", "CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS price")
    return values(
        rows, ["o_orderkey"], top="max(price, 200000.0)", low="min(price, 200000.0)", most="max(o_orderkey, o_custkey, 500)",
        first_text="min(o_orderpriority, '3')", total="sum((o_orderkey, o_custkey, 1))",
    )


@check(
    "x_string_methods",
    """SELECT doc_id, upper(source) || '!' AS loud, lower(text) AS quiet, replace(text, 'e', '') AS cut, starts_with(text, 'The') AS begins,
        length(text) AS size, split_part(source, 'r', 1) AS head, left(text, 1) AS first, right(text, 3) AS last, lang IN ('en', 'fr') AS known,
        contains(text, 'and') AS has_and, '[' || lang || ']' AS framed FROM documents""",
)
def x_string_methods(spark, sf):
    return values(
        table(spark, sf, "documents"), ["doc_id"], loud="source.upper() + '!'", quiet="text.lower()", cut="text.replace('e', '')",
        begins="text.startswith('The')", size="len(text)", head="source.split('r')[0]", first="text[0]", last="text[-3:]",
        known="lang in ('en', 'fr')", has_and="'and' in text", framed="f'[{lang}]'",
    )


@check(
    "x_conditional",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN 'bulk' WHEN l_quantity > 10 THEN 'some' ELSE 'few' END AS size,
        CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_linenumber END::bigint AS kept, (10 < l_quantity AND l_quantity <= 30) AS middle,
        'n=' || l_linenumber AS label FROM lineitem""",
)
def x_conditional(spark, sf):
    return values(
        table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"],
        size="'bulk' if l_quantity > 40 else 'some' if l_quantity > 10 else 'few'", kept="0 if l_returnflag == 'R' else l_linenumber",
        middle="10 < l_quantity <= 30", label="'n=' + str(l_linenumber)",
    )


def _power_sql(base: str, exponent: str) -> str:
    """Exact power in 128 bits, NULL where 64 are not enough."""
    value = f"list_reduce([1::hugeint] || list_transform(range(0, {exponent}), lambda i: ({base})::hugeint), lambda a, b: a * b)"
    return f"CASE WHEN {value} BETWEEN -9223372036854775808 AND 9223372036854775807 THEN {value} END::bigint"


@check(
    "x_power",
    f"""SELECT l_orderkey, l_linenumber, {_power_sql("l_linenumber", "9")} AS ninth, {_power_sql("l_suppkey", "12")} AS wide,
        {_power_sql("l_linenumber", "l_linenumber")} AS own, {_power_sql("-l_linenumber - 40", "2 * l_linenumber - 1")} AS odd,
        CASE WHEN l_linenumber <> 3 THEN 1.0 / (l_linenumber - 3) END AS inverse, CASE WHEN l_linenumber = 1 THEN 1 END::bigint AS negative FROM lineitem""",
)
def x_power(spark, sf):
    return values(
        table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ninth="l_linenumber ** 9", wide="l_suppkey ** 12",
        own="l_linenumber ** l_linenumber", odd="(-l_linenumber - 40) ** (2 * l_linenumber - 1)", inverse="(l_linenumber - 3) ** -1",
        negative="l_linenumber ** (0 - l_linenumber)",
    )
