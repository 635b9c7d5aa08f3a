"""Packed lists ``a / b / c`` and tuples ``k:v:w`` in one text; arrays inside the engine, text at its edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = " / "


def pack(items: Column) -> Column:
    return F.array_join(items, SEPARATOR)


def joined(*parts: Column) -> Column:
    """k:v:w; NULL if any part is, unlike concat_ws."""
    out = [parts[0].cast("string")]
    for p in parts[1:]:
        out += [F.lit(":"), p.cast("string")]
    return F.concat(*out)


def packed_agg(item: Column, *order: Column) -> Column:
    """Aggregate: the items in the order given, packed; NULL without rows."""
    key = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), item.alias("item"))
    rows = F.filter(F.array_sort(F.collect_list(key)), lambda r: r["item"].isNotNull())
    return F.when(F.size(rows) > 0, pack(F.transform(rows, lambda r: r["item"])))


def unpack(c: Column, strict: bool = True) -> Column:
    """The items of a packed list, trimmed, blanks left out.

    ``strict`` splits at `` / `` only; otherwise at every ``/``, which tears apart items that hold one.
    """
    parts = F.split(c, SEPARATOR if strict else "/")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
