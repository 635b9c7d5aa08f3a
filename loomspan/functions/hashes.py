"""Hashes that identify scopes and groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def poly31(c: Column) -> Column:
    """The 32-bit polynomial hash with factor 31 over code points, as 8 hexadecimal digits."""
    points = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("bigint"))
    value = F.aggregate(points, F.lit(0).cast("bigint"), lambda h, x: (h * 31 + x).bitwiseAND(F.lit(4294967295)))
    return F.lpad(F.lower(F.hex(value)), 8, "0")


def md5_prefix(c: Column, digits: int = 8) -> Column:
    return F.substring(F.md5(c), 1, digits)
