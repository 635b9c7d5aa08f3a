"""Scalar coercions shared by loads, rules and sinks; all are native column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_TEXT, NO_NUMBER = "-", -1


def sqlite_int(c: Column) -> Column:
    """CAST(text AS integer) as SQLite does it: the numeric prefix, else 0; NULL stays NULL."""
    digits = F.nullif(F.regexp_extract(c, r"^\s*([+-]?\d+)", 1), F.lit(""))
    return F.when(c.isNotNull(), F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint")))


def is_blank(c: Column) -> Column:
    """NULL, or empty after trimming spaces."""
    return c.isNull() | (F.trim(c) == "")


def any_blank(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, (is_blank(c) for c in columns))


def or_text(c: Column) -> Column:
    return F.coalesce(c, F.lit(NO_TEXT))


def or_number(c: Column) -> Column:
    return F.coalesce(c, F.lit(NO_NUMBER).cast("bigint"))


def effective_bound(own: Column, model: Column) -> Column:
    """The explicit bound unless it is -1; then the model's, or -1."""
    return F.when(own == NO_NUMBER, or_number(model)).otherwise(own)


def host_trim(c: Column) -> Column:
    """Trim as host languages do it: any white space, not only spaces."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Text of a cleaned column: blank becomes the sentinel."""
    return F.when(c.isNull() | (host_trim(c) == ""), NO_TEXT).otherwise(c)


def clean_int(c: Column) -> Column:
    """Integer text of a cleaned column: blank or '-' is -1, true/false is 1/0, anything else must be a number.

    A malformed value gives NULL; the caller reports it (see ``sources.staging.cleaned``).
    """
    t = host_trim(F.coalesce(c, F.lit("")))
    return (
        F.when(t.isin("", NO_TEXT), F.lit(NO_NUMBER).cast("bigint"))
        .when(F.lower(t) == "true", F.lit(1).cast("bigint")).when(F.lower(t) == "false", F.lit(0).cast("bigint"))
        .otherwise(t.try_cast("bigint"))
    )
