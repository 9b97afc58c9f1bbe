"""Table names and source type tokens."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F, types as T

# Source type token -> Spark type.
SPARK_TYPES = {
    "int": "int",
    "integer": "int",
    "smallint": "smallint",
    "bigint": "bigint",
    "serial": "bigint",
    "bigserial": "bigint",
    "tinyint": "tinyint",
    "decimal": "decimal(38,10)",
    "numeric": "decimal(38,10)",
    "float": "double",
    "double": "double",
    "real": "float",
    "varchar": "string",
    "char": "string",
    "text": "string",
    "longtext": "string",
    "mediumtext": "string",
    "boolean": "boolean",
    "bool": "boolean",
    "bit": "boolean",
    "date": "date",
    "datetime": "timestamp",
    "timestamp": "timestamp",
    "json": "string",
    "jsonb": "string",
    "blob": "binary",
    "binary": "binary",
    "uuid": "string",
    "enum": "string",
}
FALLBACK_TYPE = "string"


def safe_name(name, keep_dots: bool = False):
    """Lower-case ``name`` with ``-``, ``.`` and space turned into ``_``.

    Takes a Column or a plain string. ``keep_dots`` leaves dots alone.
    """
    chars = "- " if keep_dots else "-. "
    if isinstance(name, Column):
        return F.translate(F.lower(name), chars, "_" * len(chars))
    return name.lower().translate(str.maketrans(chars, "_" * len(chars)))


def type_token(declared):
    """First word of a declared SQL type, lower-cased, without ``(...)``."""
    if isinstance(declared, Column):
        return F.regexp_extract(F.lower(F.trim(declared)), r"^([^( ]*)", 1)
    return re.split(r"[( ]", declared.strip().lower(), maxsplit=1)[0]


def spark_type_name(declared: Column) -> Column:
    """Column of Spark type names for a column of declared SQL types."""
    token = type_token(declared)
    lookup = F.create_map(*[F.lit(x) for pair in SPARK_TYPES.items() for x in pair])
    precise = F.regexp_extract(F.lower(declared), r"^\s*(?:decimal|numeric)\s*\(\s*(\d+\s*(?:,\s*\d+)?)\s*\)", 1)
    one_bit = F.lower(F.trim(declared)).rlike(r"^tinyint\s*\(\s*1\s*\)")
    precise = F.regexp_replace(precise, r"\s", "")
    with_scale = F.when(precise.contains(","), precise).otherwise(F.concat(precise, F.lit(",0")))
    return (
        F.when(one_bit, "boolean")
        .when(F.length(precise) > 0, F.concat(F.lit("decimal("), with_scale, F.lit(")")))
        .otherwise(F.coalesce(lookup[token], F.lit(FALLBACK_TYPE)))
    )


def spark_type(declared: str) -> T.DataType:
    """Spark type for one declared SQL type; driver-side twin of :func:`spark_type_name`."""
    text = declared.strip().lower()
    if re.match(r"tinyint\s*\(\s*1\s*\)", text):
        return T.BooleanType()
    precise = re.match(r"(?:decimal|numeric)\s*\(\s*(\d+)\s*(?:,\s*(\d+))?\s*\)", text)
    if precise:
        return T.DecimalType(int(precise.group(1)), int(precise.group(2) or 0))
    return T.DataType.fromDDL(SPARK_TYPES.get(type_token(text), FALLBACK_TYPE))


def table_schema(columns: list[dict]) -> T.StructType:
    """Schema from ``{name, type, nullable, pk}`` descriptors, pk kept in the metadata."""
    return T.StructType(
        [
            T.StructField(
                c["name"],
                spark_type(c.get("type", FALLBACK_TYPE)),
                c.get("nullable", True),
                {"pk": bool(c.get("pk", False)), "source_type": c.get("type", FALLBACK_TYPE)},
            )
            for c in columns
        ]
    )
