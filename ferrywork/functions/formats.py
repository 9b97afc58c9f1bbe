"""Display text for durations, counts and ages, and ISO time conversion."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ferrywork.functions.pytext import round_half_up

# Limits and words of the short texts.
SECOND_MS, MINUTE_MS = 1_000, 60_000
THOUSAND, MILLION = 1_000, 1_000_000
NOTHING, JUST_NOW = "-", "Just now"
ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"


def duration_text(ms: Column) -> Column:
    """``-``, ``Nms``, ``N.Ns`` or ``Nm Ns``."""
    minutes = F.floor(ms / MINUTE_MS)
    seconds = F.floor((ms - minutes * MINUTE_MS) / SECOND_MS)
    return (
        F.when(ms.isNull(), NOTHING)
        .when(ms < SECOND_MS, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < MINUTE_MS, F.concat(one_decimal(ms / SECOND_MS), F.lit("s")))
        .otherwise(F.concat(minutes.cast("string"), F.lit("m "), seconds.cast("string"), F.lit("s")))
    )


def one_decimal(value: Column) -> Column:
    return F.format_string("%.1f", round_half_up(value.cast("double"), 1))


def count_text(n: Column) -> Column:
    """``N.NM`` from a million, ``N.NK`` from a thousand, the number itself below."""
    return (
        F.when(n.isNull(), "0")
        .when(n >= MILLION, F.concat(one_decimal(n / MILLION), F.lit("M")))
        .when(n >= THOUSAND, F.concat(one_decimal(n / THOUSAND), F.lit("K")))
        .otherwise(n.cast("string"))
    )


def age_text(moment: Column, as_of: Column) -> Column:
    """How long before ``as_of``: just now, minutes, hours, else the date."""
    minutes = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(moment.cast("timestamp"))) / 60_000_000)
    hours = F.floor(minutes / 60)
    return (
        F.when(moment.isNull(), NOTHING)
        .when(minutes < 1, JUST_NOW)
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .otherwise(F.date_format(moment, "yyyy-MM-dd"))
    )


def iso_text(moment: Column) -> Column:
    """ISO 8601 text; the fraction appears only when it is not zero."""
    micros = F.date_format(moment, "SSSSSS")
    whole = F.date_format(moment, ISO_SECONDS)
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def iso_time(text: Column) -> Column:
    """Timestamp of ISO text, ``Z`` read as UTC; NULL where it is not ISO."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))
