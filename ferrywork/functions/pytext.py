"""Value conversions with Python's rules, as Spark columns.

Transform configs are written against Python values, so ``str``, ``int``,
``float``, ``bool`` and ``round`` follow Python and not SQL. A conversion that
would raise in Python gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Text that Python reads as a number.
INT_TEXT = r"^[+-]?\d+(_\d+)*$"
FLOAT_TEXT = r"(?i)^[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+)?|inf|infinity|nan)$"
EDGE_SPACE = r"(?U)^\s+|\s+$"

_SPLITTER = float(2**27 + 1)


def strip(col: Column) -> Column:
    return F.regexp_replace(col, EDGE_SPACE, "")


def float_text(col: Column) -> Column:
    """``str(float)``: shortest digits, exponent below 1e-4 and from 1e16."""
    java = col.cast("string")
    sign = F.when(java.startswith("-"), "-").otherwise("")
    body = F.regexp_replace(java, "^-", "")
    mantissa = F.substring_index(body, "E", 1)
    exponent = F.substring_index(body, "E", -1).try_cast("int")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.", ""), "0+$", "")
    padded = F.rpad(digits, F.greatest(exponent + 2, F.length(digits)), "0")
    large = F.concat(padded.substr(F.lit(1), exponent + 1), F.lit("."), padded.substr(exponent + 2, F.length(padded)))
    scientific = F.concat(
        F.regexp_replace(mantissa, r"\.0$", ""),
        F.when(exponent < 0, "e-").otherwise("e+"),
        F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), "0"),
    )
    return (
        F.when(F.isnan(col), "nan")
        .when(body == "Infinity", F.concat(sign, F.lit("inf")))
        .when(~body.contains("E"), java)
        .when(exponent.between(7, 15), F.concat(sign, large))
        .when(exponent == -4, F.concat(sign, F.lit("0.000"), digits))
        .otherwise(F.concat(sign, scientific))
    )


def py_str(col: Column, dtype: T.DataType) -> Column:
    """``str(value)``; NULL stays NULL."""
    if isinstance(dtype, T.BooleanType):
        return F.when(col, "True").when(~col, "False")
    if isinstance(dtype, T.DoubleType):
        return float_text(col)
    if isinstance(dtype, T.FloatType):
        return float_text(col.cast("string").cast("double"))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        micros = F.date_format(col, "SSSSSS")
        whole = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(col)
    return col.cast("string")


def py_int(col: Column, dtype: T.DataType) -> Column | None:
    """``int(value)``; None where Python has no conversion for the type at all."""
    if isinstance(dtype, T.StringType):
        text = strip(col)
        return F.when(text.rlike(INT_TEXT), F.regexp_replace(text, "_", "").try_cast("bigint"))
    if isinstance(dtype, T.NumericType):
        return col.try_cast("bigint")
    if isinstance(dtype, T.BooleanType):
        return col.cast("int").cast("bigint")
    return None


def py_float(col: Column, dtype: T.DataType) -> Column | None:
    if isinstance(dtype, T.StringType):
        text = strip(col)
        return F.when(text.rlike(FLOAT_TEXT), F.regexp_replace(text, "_", "").try_cast("double"))
    if isinstance(dtype, T.NumericType):
        return col.cast("double")
    if isinstance(dtype, T.BooleanType):
        return col.cast("int").cast("double")
    return None


def py_bool(col: Column, dtype: T.DataType) -> Column:
    """Truth of a value: non-empty text, non-zero number; any other value is true."""
    if isinstance(dtype, T.BooleanType):
        return col
    if isinstance(dtype, T.StringType):
        return F.length(col) > 0
    if isinstance(dtype, T.NumericType):
        return col != F.lit(0).cast(dtype)
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return F.size(col) > 0
    return F.when(col.isNotNull(), True)


def _scaled(col: Column, digits: int) -> tuple[Column, Column, Column, float]:
    """``col * 10**digits`` as floor, fraction and rounding error, together exact.

    ``round`` and ``bround`` judge ties on the printed decimal (2.675 looks
    like a tie but lies below it). Splitting both factors into halves gives the
    error of their product, and with it the true side of a tie.
    """
    scale = float(10**digits)
    product = col * scale
    high = col * _SPLITTER - (col * _SPLITTER - col)
    low = col - high
    scale_high = scale * _SPLITTER - (scale * _SPLITTER - scale)
    scale_low = scale - scale_high
    error = ((high * scale_high - product) + high * scale_low + low * scale_high) + low * scale_low
    floor = F.floor(product).cast("double")
    return floor, product - floor, error, scale


def _rounded(col: Column, digits: int, at_tie) -> Column:
    floor, part, error, scale = _scaled(col, digits)
    up = (
        F.when((part > 0.5) | ((part == 0.5) & (error > 0)), 1.0)
        .when((part < 0.5) | (error < 0), 0.0)
        .otherwise(at_tie(floor))
    )
    # Beyond 2**52 / scale a double has no digits left to drop.
    return F.when(F.abs(col) < 2.0**52 / scale, (floor + up) / scale).otherwise(col)


def round_half_even(col: Column, digits: int) -> Column:
    """``round(float, digits)``, ties to the even digit."""
    if digits < 0:
        scale = float(10**-digits)
        return F.rint(col / scale) * scale
    if digits == 0:
        return F.rint(col)
    return _rounded(col, digits, lambda floor: F.abs(floor % 2.0))


def round_half_up(col: Column, digits: int) -> Column:
    """Rounding of display numbers, ties upwards."""
    return _rounded(col, digits, lambda floor: F.lit(1.0))
