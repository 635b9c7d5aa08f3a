"""Whole rows as one value, whatever their columns are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def name(column: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(df: DataFrame, but: tuple[str, ...] = ()) -> Column:
    """All columns as one struct; ``select("x.*")`` gives them back."""
    return F.struct(*(name(c).alias(c) for c in df.columns if c not in but))


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType))


def row_hash(df: DataFrame, seed: int = 0) -> Column:
    """A 64-bit hash of the whole row; a column that nulls move to another place changes it."""
    parts = [F.to_json(F.struct(name(f.name).alias("v"))) if _has_map(f.dataType) else name(f.name) for f in df.schema.fields]
    return F.xxhash64(F.lit(seed), *(x for p in parts for x in (p, p.isNull())))
