"""Compare a registered query with its SQL on DuckDB: names, types, rows, values."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    return None if value is None else repr(value)


def compare(df, con, sql: str) -> list[str]:
    """Differences in words; empty when both sides agree."""
    relation = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(relation.columns):
        return [f"columns {names} != {sorted(relation.columns)}"]
    problems = []
    left = df.select(*[f"`{n}`" for n in names]).toArrow()
    right = relation.select(", ".join(f'"{n}"' for n in names)).to_arrow_table()
    for name in names:
        a, b = left.schema.field(name).type, right.schema.field(name).type
        a, b = (str(t).replace("large_string", "string").replace("string_view", "string") for t in (a, b))
        if a != b:
            problems.append(f"type of {name}: {a} != {b}")
    if left.num_rows != right.num_rows:
        problems.append(f"rows {left.num_rows} != {right.num_rows}")

    def rows(table):
        columns = [[_plain(v) for v in table.column(n).to_pylist()] for n in names]
        return sorted(zip(*columns), key=lambda r: tuple((v is None, v or "") for v in r))

    a, b = rows(left), rows(right)
    if a != b:
        only_a = sorted(set(a) - set(b), key=str)[:2]
        only_b = sorted(set(b) - set(a), key=str)[:2]
        problems.append(f"values differ: {names}\n  spark {only_a}\n  sql   {only_b}")
    return problems
