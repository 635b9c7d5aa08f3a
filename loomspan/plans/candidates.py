"""Candidate rules of a target on the axes X, Y and Z."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions.packed import joined, packed_agg, unpack

KEY = ["filePath", "className", "methodName", "process1", "targetKind", "argIndex", "dtoName", "targetName"]


def y_applies(y_id: Column) -> Column:
    """Whether a length rule suits a target's nullability (tri-state) and effective bounds."""
    low, high, nullable = F.col("effectiveMin"), F.col("effectiveMax"), F.col("nullable")
    return (
        F.when(y_id == "length_null", nullable.isin(1, -1))
        .when(y_id == "length_empty", nullable.isin(0, -1))
        .when(y_id.isin("length_min", "length_min_minus_1"), low != -1)
        .when(y_id.isin("length_max", "length_max_plus_1"), high != -1)
        .when(y_id == "length_normal_mid", (low != -1) & (high != -1) & (high > low))
        .otherwise(F.lit(False))
    )


def y_pairs(targets: DataFrame, y: DataFrame) -> DataFrame:
    """Every (target, applicable rule): the rule list travels with every row as one array and is filtered in place."""
    rules = y.agg(F.collect_list(F.struct(*y.columns)).alias("__y"))  # one row
    fit = F.explode(F.filter("__y", lambda r: y_applies(r["y_id"]))).alias("__r")
    return targets.where("targetKind <> 'METHOD'").crossJoin(F.broadcast(rules)).select(*targets.columns, fit).select(*targets.columns, "__r.*")


def _lists(x: DataFrame, prefix: str, *details: str) -> DataFrame:
    n = F.col("n")
    return x.agg(
        packed_agg(joined(n, F.col(details[-1])), n).alias(f"{prefix}CandidateIds"), packed_agg(joined(n, *(F.col(c) for c in details[:-1])), n).alias(f"{prefix}CandidateDetails")
    )


def x_lists(x: DataFrame) -> DataFrame:
    """One row; NULL lists without rows."""
    return _lists(x, "x", "root_id", "branch_id", "leaf_id", "leaf_edge_id", "x_id", "x_name", "x_id")


def z_lists(z: DataFrame) -> DataFrame:
    return _lists(z.where("z_id <> 'Nothing'"), "z", "category_id", "group_id", "z_type", "z_name", "z_id", "variants", "z_id")


def attach(targets: DataFrame, x: DataFrame, y: DataFrame, z: DataFrame) -> DataFrame:
    """targets with xCandidateIds, xCandidateDetails, and the same for y and z.

    The whole Y list travels with every row as one array and is filtered in place: no join back by eight keys.
    """
    rows = y.agg(F.array_sort(F.collect_list(F.struct("n", "y_id", "domains_name", "logic"))).alias("__y"))
    out = targets.crossJoin(F.broadcast(rows)).crossJoin(F.broadcast(x_lists(x))).crossJoin(F.broadcast(z_lists(z)))  # one row each
    is_method = F.col("targetKind") == "METHOD"
    fit = F.filter("__y", lambda r: y_applies(r["y_id"]))

    def listed(item) -> Column:
        return F.when(is_method | (F.size(fit) == 0), "-").otherwise(F.array_join(F.transform(fit, item), " / "))

    out = out.withColumn("yCandidateIds", listed(lambda r: joined(r["n"], r["y_id"])))
    out = out.withColumn("yCandidateDetails", listed(lambda r: joined(r["n"], r["y_id"], r["domains_name"], r["logic"])))
    for axis in "xz":
        for kind in ("Ids", "Details"):
            name = f"{axis}Candidate{kind}"
            out = out.withColumn(name, F.when(is_method, "-").otherwise(F.col(name)))
    return out.select(*targets.columns, *(f"{a}Candidate{k}" for a in "xyz" for k in ("Ids", "Details")))


def target_id() -> Column:
    """Eight parts joined by '::'; NULL if any is."""
    parts = [F.col(c).cast("string") for c in ("filePath", "className", "methodName", "process1", "targetKind", "argIndex", "dtoName", "targetName")]
    out = [parts[0]]
    for p in parts[1:]:
        out += [F.lit("::"), p]
    return F.concat(*out)


def ai_input(attached: DataFrame) -> DataFrame:
    return attached.select(target_id().alias("targetId"), "*")


def lists_by_target(inputs: DataFrame, axes: str = "XYZ") -> DataFrame:
    """targetId and the packed ids of each axis (columns X, Y, Z), one row for each target; rows of one target join their lists."""
    ids = {a: F.col(f"{a.lower()}CandidateIds") for a in axes}
    return inputs.groupBy("targetId").agg(*(F.array_join(F.collect_set(ids[a]), " / ").alias(a) for a in axes))


def explode_ids(inputs: DataFrame, strict: bool = True, axes: str = "XYZ") -> DataFrame:
    """(targetId, axis, mirrorId), distinct: one scan for all axes asked for, and a shuffle of packed lists instead of single ids."""
    return exploded_lists(lists_by_target(inputs, axes), strict, axes)


def exploded_lists(lists: DataFrame, strict: bool = True, axes: str = "XYZ") -> DataFrame:
    """(targetId, axis, mirrorId) of ``lists_by_target``."""
    pairs = F.explode(F.create_map(*(v for a in axes for v in (F.lit(a), F.col(a))))).alias("axis", "ids")
    return lists.select("targetId", pairs).select("targetId", "axis", F.explode(F.array_distinct(unpack(F.col("ids"), strict))).alias("mirrorId"))


def known_targets(inputs: DataFrame) -> DataFrame:
    return inputs.select("targetId").distinct()
