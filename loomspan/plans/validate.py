"""Validation of a test specification: enrichment, ten rules, accepted and rejected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.coercion import any_blank, or_number, or_text
from loomspan.plans.targets import METHOD

X, Y, Z = "観点ID_X", "観点ID_Y", "観点ID_Z"
#: Columns that may not be blank.
REQUIRED = [
    "CaseNo", "targetId", "大分類", "中分類", "小分類", X, Y, Z, "ケース内容", "操作手順", "確認内容", "確認手順", "想定結果",
    "想定結果判断基準・判断手順", "generatorTarget", "generatorRule",
]
LOGICAL_KEY = ["targetId", X, Y, Z]
RULES = ["required", "target", "generator_target", "x", "y", "z", "generator_rule", "case_no_duplicate", "case_duplicate", "y_coverage"]


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def rule_text(blank: bool = False) -> Column:
    """The generator rule that a row's axes call for."""
    part = (lambda c: F.coalesce(q(c), F.lit(""))) if blank else q
    return F.concat(F.lit("X="), part(X), F.lit("|Y="), part(Y), F.lit("|Z="), part(Z))


def enrich(spec: DataFrame, inputs: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """The specification with its target's context (sentinels where there is none) and three validity flags.

    ``inputs`` has all columns, or those of the target itself, with ``context`` for each method: long texts then meet the
    rows last and are shuffled once for each method.
    """
    numbers = {"process1", "argIndex", "validationMin", "validationMax", "nullable", "modelMin", "modelMax", "effectiveMin", "effectiveMax"}
    skipped = {"targetId", "arg_n", "dto_n", "field_n", "objectRootId", "return_n", "returnObjectRootId", "imports", "xCandidateDetails", "yCandidateDetails", "zCandidateDetails"}
    taken = [c for c in inputs.columns if c not in skipped]
    joined = spec.join(inputs.select("targetId", *taken).withColumn("__known", F.lit(True)).hint("merge"), "targetId", "left")
    if context is not None:
        added = [c for c in context.columns if c not in {*METHOD, *skipped}]
        joined = joined.join(context.select(*METHOD, *added).hint("merge"), METHOD, "left")
        lists = [c for c in taken if c.endswith("CandidateIds")]
        taken = [*(c for c in taken if c not in lists), *added, *lists]
    flag = lambda c: F.when(c, 1).otherwise(0)
    return joined.select(
        *(q(c) for c in spec.columns), *((or_number if c in numbers else or_text)(F.col(c)).alias(c) for c in taken),
        flag(F.col("__known").isNotNull()).alias("targetExists"), flag(F.col("generatorTarget") == F.col("targetId")).alias("generatorTargetValid"),
        flag(F.col("generatorRule") == rule_text()).alias("generatorRuleValid"),
    )


def ng_required(spec: DataFrame) -> DataFrame:
    return spec.where(any_blank(q(c) for c in REQUIRED))


def ng_target(spec: DataFrame, targets: DataFrame) -> DataFrame:
    return spec.join(targets.select("targetId"), "targetId", "left_anti").select(*(q(c) for c in spec.columns))


def ng_generator_target(spec: DataFrame) -> DataFrame:
    return spec.where(F.coalesce("generatorTarget", F.lit("")) != F.coalesce("targetId", F.lit("")))


def ng_axis(spec: DataFrame, candidates: DataFrame, axis: str) -> DataFrame:
    """Rows whose id on the axis is not a candidate of their target; '-' is no id."""
    column = {"X": X, "Y": Y, "Z": Z}[axis]
    known = candidates.where(F.col("axis") == axis).select("targetId", F.col("mirrorId").alias(column))
    return spec.where(q(column) != "-").join(known, ["targetId", column], "left_anti").select(*(q(c) for c in spec.columns))


def ng_generator_rule(spec: DataFrame) -> DataFrame:
    return spec.where(F.coalesce("generatorRule", F.lit("")) != rule_text(blank=True))


def duplicate_keys(spec: DataFrame, keys: list[str]) -> DataFrame:
    return spec.groupBy(*(q(k) for k in keys)).agg(F.count("*").alias("duplicateCount")).where("duplicateCount > 1")


def ng_duplicate(spec: DataFrame, keys: list[str]) -> DataFrame:
    return spec.join(duplicate_keys(spec, keys), keys, "left_semi").select(*(q(c) for c in spec.columns))


def missing_y(spec: DataFrame, candidates: DataFrame) -> DataFrame:
    """(targetId, missingMirrorId): Y candidates without a row."""
    wanted = candidates.where("axis = 'Y'").select("targetId", F.col("mirrorId").alias("missingMirrorId"))
    return wanted.join(spec.select("targetId", q(Y).alias("missingMirrorId")), ["targetId", "missingMirrorId"], "left_anti")


def ng_y_coverage(spec: DataFrame, candidates: DataFrame) -> DataFrame:
    return spec.join(missing_y(spec, candidates).select("targetId").distinct(), "targetId", "left_semi").select(*(q(c) for c in spec.columns))


def judged(spec: DataFrame, inputs: DataFrame, strict: bool = True) -> DataFrame:
    """spec with ``reasons``: the names of all rules that a row breaks, in order, from one pass.

    A row is shuffled twice: by its number, which counts its namesakes, and by its target, which gives it the
    candidate lists (packed as they are), the Y rules in use and the rows of the same logical key. Rules of a
    row alone are judged before, so that only the columns that the caller wants travel.
    """
    from loomspan.functions.packed import unpack
    from loomspan.plans.candidates import lists_by_target

    alone = {
        "required": any_blank(q(c) for c in REQUIRED), "generator_target": F.coalesce("generatorTarget", F.lit("")) != F.coalesce("targetId", F.lit("")),
        "generator_rule": F.coalesce("generatorRule", F.lit("")) != rule_text(blank=True),
    }
    rows = spec.withColumns({f"__{r}": c for r, c in alone.items()})
    rows = rows.repartition("CaseNo").withColumn("__cases", F.col("CaseNo").isNotNull() & (F.count("*").over(Window.partitionBy("CaseNo")) > 1))
    whole = F.lit(True)
    for k in LOGICAL_KEY:
        whole = whole & q(k).isNotNull()
    rows = rows.repartition("targetId").withColumn("__copies", whole & (F.count("*").over(Window.partitionBy(*(q(k) for k in LOGICAL_KEY))) > 1))
    # The set names __copies to be made after it: rows sorted by the logical key are sorted by target.
    rows = rows.withColumn("__used", F.collect_set(F.when(F.col("__copies").isNotNull(), q(Y))).over(Window.partitionBy("targetId")))  # as many as Y rules, at most a handful
    lists = lists_by_target(inputs).select("targetId", *(F.col(a).alias(f"__{a.lower()}") for a in "XYZ"), F.lit(True).alias("__known"))
    out = rows.join(lists.hint("merge"), "targetId", "left")
    gap = F.size(F.array_except(unpack(F.col("__y"), strict), F.col("__used"))) > 0

    def off(column: str, a: str) -> Column:
        known = F.coalesce(F.array_contains(unpack(F.col(f"__{a}"), strict), q(column)), F.lit(False))
        return (q(column) != "-") & ~known

    broken = {
        **{r: F.col(f"__{r}") for r in alone}, "target": F.col("__known").isNull(), "x": off(X, "x"), "y": off(Y, "y"), "z": off(Z, "z"),
        "case_no_duplicate": F.col("__cases"), "case_duplicate": F.col("__copies"), "y_coverage": F.coalesce(F.col("__known") & gap, F.lit(False)),
    }
    reasons = F.array_compact(F.array(*(F.when(broken[r], r) for r in RULES)))
    return out.select(*(q(c) for c in spec.columns), reasons.alias("reasons"))


def accepted(spec: DataFrame, inputs: DataFrame, strict: bool = True) -> DataFrame:
    return judged(spec, inputs, strict).where(F.size("reasons") == 0).drop("reasons")


def rejected(spec: DataFrame, inputs: DataFrame, strict: bool = True) -> DataFrame:
    return judged(spec, inputs, strict).where(F.size("reasons") > 0)
