"""Cleaning of parsed source rows: type trees, and the unpivoting of wide argument, enum and import columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ARGS = 20
# Contents of rows that carry arguments and enum constants.
ARGUMENT_ROW, ENUM_ROW = "引数", "enum"
_TOKEN = re.compile(r"\s*(@[\w.]+(?:\([^()]*\))?|[\w.$]+|\[\]|\.\.\.|[<>,?&]|\S)")
PRIMITIVES = frozenset("int long double float boolean char byte short void".split())


class _Type:
    """A parsed type: name, type arguments, array depth."""

    def __init__(self, name: str, args: list[_Type] | None = None):
        self.name, self.args = name, args or []

    @property
    def is_array(self) -> bool:
        return self.name == "[]"

    def base(self) -> str:
        return self.name if self.is_array else self.name.split(".")[-1]

    def __str__(self) -> str:
        if self.is_array:
            return f"{self.args[0]}[]"
        return self.name + (f"<{', '.join(map(str, self.args))}>" if self.args else "")


def parse_type(text: str) -> _Type:
    """A type expression: names, type arguments, wildcards (their bound, else Object), arrays. ValueError if it is none."""
    tokens = [t for t in _TOKEN.findall(text) if t.strip() and not t.startswith("@") and t != "final"]
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def one() -> _Type:
        if peek() == "?":
            take()
            if peek() in ("extends", "super"):
                take()
                return one()
            return _Type("Object")
        if not re.fullmatch(r"[\w.$]+", peek()):
            raise ValueError(f"not a type: {text}")
        out = _Type(take())
        if peek() == "<":
            take()
            while True:
                if peek() == ">":
                    break
                out.args.append(one())
                if peek() == "&":
                    take()
                    one()
                if peek() == ",":
                    take()
                    continue
                if peek() != ">":
                    raise ValueError(f"not a type: {text}")
            take()
        while peek() in ("[]", "..."):
            take()
            out = _Type("[]", [out])
        return out

    out = one()
    if at != len(tokens):
        raise ValueError(f"not a type: {text}")
    return out


def type_rows(text: str | None, models: dict[str, str]) -> tuple[str, list[tuple]]:
    """The model of a type and the rows of its tree: (number, parent, position, rawType, baseType, convModel, referenceType), in pre-order; no rows for plain scalars."""
    try:
        root = parse_type(text or "")
    except ValueError:
        return "OBJECT", []
    model = lambda t: models.get(t.base(), "OBJECT")
    rows: list[tuple] = []

    def add(t: _Type, parent: int, position: str) -> None:
        number, conv = len(rows), model(t)
        rows.append((number, parent, position, str(t), t.base(), conv, t.base() if conv == "OBJECT" else "-"))
        for i, a in enumerate(t.args):
            add(a, number, ("KEY", "VALUE")[i] if conv == "MAP" and i < 2 and not t.is_array else "ELEMENT")

    if root.is_array or root.args or (root.name not in PRIMITIVES and model(root) == "OBJECT"):
        add(root, -1, "ROOT")
    return model(root), rows


TREE = "array<struct<number:bigint,parent:bigint,position:string,rawType:string,baseType:string,convModel:string,referenceType:string>>"


def with_type_tree(df: DataFrame, raw: str, models: dict[str, str]) -> DataFrame:
    """Adds convModel and typeTree of the type in the column ``raw``; a type is parsed once for each batch that has it."""

    @F.pandas_udf(f"convModel string, typeTree {TREE}")
    def parse(types: pd.Series) -> pd.DataFrame:
        seen: dict = {}
        out = []
        for t in types:
            if t not in seen:
                conv, rows = type_rows(t, models)
                names = ("number", "parent", "position", "rawType", "baseType", "convModel", "referenceType")
                seen[t] = (conv, [dict(zip(names, r)) for r in rows])
            out.append(seen[t])
        return pd.DataFrame(out, columns=["convModel", "typeTree"])

    return df.withColumn("__t", parse(F.col(raw))).select(*df.columns, "__t.*")


def object_rows(owners: DataFrame, first_id: Column) -> DataFrame:
    """Type trees as object_data rows. ``owners`` has ownerKind, filePath, className, methodName, ownerName, ownerIndex and typeTree; ``first_id`` its first id."""
    node = owners.withColumn("__first", first_id).select("*", F.explode("typeTree").alias("o"))
    return node.select(
        (F.col("__first") + F.col("o.number")).alias("objectId"), F.when(F.col("o.parent") < 0, -1).otherwise(F.col("__first") + F.col("o.parent")).cast("bigint").alias("parentObjectId"),
        "ownerKind", "filePath", "className", "methodName", "ownerName", "ownerIndex", "o.position", "o.rawType", "o.baseType", "o.convModel", "o.referenceType",
    )


def _wide() -> Column:
    return F.array(*(F.col(f"arg{i}") for i in range(1, MAX_ARGS + 1)))


def _items(df: DataFrame) -> DataFrame:
    out = df.select("*", F.posexplode(_wide()).alias("__pos", "__item"))
    item = F.trim("__item")
    return out.withColumn("__item", item).where(item.isNotNull() & ~item.isin("", "-"))


def unpivot_arguments(methods: DataFrame) -> DataFrame:
    """A row for each argument of argument rows: filePath, className, methodName, process1, argIndex (from 1), argName, argRaw, rawType ('-' if it can't be parsed)."""
    rows = _items(methods.where(F.col("processContent") == ARGUMENT_ROW))
    bare = F.trim(F.regexp_replace("__item", r"^(?:\s*(?:@[\w.]+(?:\([^()]*\))?|final)\s+)+", ""))
    pattern = r"^(.*\S)\s+([A-Za-z_$][\w$]*)((?:\s*\[\])*)$"
    named = bare.rlike(pattern)
    return rows.select(
        "filePath", "className", "methodName", "process1", (F.col("__pos") + 1).cast("bigint").alias("argIndex"),
        F.when(named, F.regexp_extract(bare, pattern, 2)).otherwise("-").alias("argName"), F.col("__item").alias("argRaw"),
        F.when(named, F.concat(F.regexp_extract(bare, pattern, 1), F.regexp_replace(F.regexp_extract(bare, pattern, 3), r"\s", ""))).otherwise("-").alias("rawType"),
    )


def unpivot_enums(methods: DataFrame) -> DataFrame:
    """A row for each enum constant: filePath, enumName, enumIndex (page x 20 + place), enumValue, convModel."""
    rows = _items(methods.where(F.col("processContent") == ENUM_ROW))
    page = F.coalesce(F.col("process3").cast("string").try_cast("bigint"), F.lit(0))
    return rows.select("filePath", F.col("className").alias("enumName"), (page * MAX_ARGS + F.col("__pos") + 1).alias("enumIndex"), F.col("__item").alias("enumValue"), F.lit("ENUM").alias("convModel"))


def enum_pages(constants: DataFrame, size: int = MAX_ARGS) -> DataFrame:
    """(filePath, className, values array) to rows of ``size`` values: filePath, className, page (from 0), items."""
    pages = F.sequence(F.lit(0), F.floor((F.size("values") - 1) / size).cast("int"))
    rows = constants.where(F.size("values") > 0).select("filePath", "className", "values", F.explode(pages).alias("page"))
    return rows.select("filePath", "className", F.col("page").cast("bigint").alias("page"), F.slice("values", F.col("page") * size + 1, F.lit(size)).alias("items"))


def explode_imports(sources: DataFrame) -> DataFrame:
    """A row for each import: n, appName, fileName, directoryPath, importList, numbered in the order of the three keys."""
    item = F.explode(F.split("importList", r"\s*/\s*")).alias("item")
    rows = sources.where("importList <> '-'").select("appName", "fileName", "directoryPath", item)
    clean = F.trim(F.regexp_replace(F.regexp_replace("item", r"^\s*import\s+", ""), r"\s*;\s*$", ""))
    rows = rows.withColumn("importList", clean).where("importList <> ''").drop("item")
    return ranked(rows, "directoryPath", "fileName", "importList", "appName")


def ranked(df: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """Numbers rows from 1 in the order given, without gathering them: range partitions are numbered within and shifted by the counts before."""
    laid = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    from loomspan.functions.storage import materialise

    laid = materialise(laid)
    counts = laid.groupBy("__part").agg(F.count("*").alias("__n"))  # a row for each partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__part").orderBy(*order)
    out = laid.join(F.broadcast(counts), "__part").withColumn(name, (F.row_number().over(within) + F.col("__before")).cast("bigint"))
    return out.select(name, *df.columns)


def known_dto_fields(sources: DataFrame, fields: DataFrame) -> DataFrame:
    """Fields of classes that the sources define."""
    known = sources.where("className <> '-' and trim(className) <> ''").select("className").distinct()
    return fields.where("fieldKind = 'field'").join(known, "className", "left_semi")


def first_returns(methods: DataFrame, order: str) -> DataFrame:
    """The first argument row of each method: filePath, className, methodName, process1, rawType."""
    rows = methods.where(F.col("processContent") == ARGUMENT_ROW)
    return rows.groupBy("filePath", "className", "methodName", "process1").agg(F.min_by("returnType", order).alias("rawType"))


def bounds_of(annotations: Column) -> Column:
    """(validationMin, validationMax, nullable) from raw annotations; the first that matches counts, -1 is none or unknown."""

    def number(*patterns: str) -> Column:
        found = [F.nullif(F.regexp_extract(annotations, p, 1), F.lit("")).try_cast("bigint") for p in patterns]
        return F.coalesce(*found, F.lit(-1).cast("bigint"))

    low = number(r"@Min\(\s*(?:value\s*=\s*)?(-?\d+)", r"@Size\([^)]*\bmin\s*=\s*(\d+)", r"@Length\(\s*(\d+)")
    high = number(r"@Max\(\s*(?:value\s*=\s*)?(-?\d+)", r"@Size\([^)]*\bmax\s*=\s*(\d+)", r"@Length\(\s*\d+\s*,\s*(\d+)")
    nullable = (
        F.when(annotations.rlike(r"@(NotNull|NotBlank|NotEmpty|IsNotEmpty|IsDefined)\b"), 0).when(annotations.rlike(r"@(Nullable|IsOptional)\b"), 1).otherwise(-1).cast("bigint")
    )
    return F.struct(low.alias("validationMin"), high.alias("validationMax"), nullable.alias("nullable"))
