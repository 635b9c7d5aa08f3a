"""Screen graphs: edge resolution, hop by hop path expansion, maximal paths, phases and reachability.

Paths are arrays; text is made at sinks. ``ords`` holds the ordinals of a path's edges, so "first" always
means first in the order in which edges were given, whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions.hashes import poly31
from loomspan.functions.storage import materialise

BACK, COMMON, UNRESOLVED = "__back__", "__common__", "__unresolved__"
SEPARATOR = "｜"
#: The names of the test phases.
UNIT, SYSTEM, INTEGRATION = "単体テスト", "総合テスト", "結合テスト"
MULTIPLIER = 5


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def longest_prefix(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(toPath) to (toPath, component): an exact route, else the longest route that is a prefix, "/" excepted; ties go to the first.

    Every prefix of a path is looked up by equality, instead of comparing all paths with all routes.
    """
    exact = nodes.select(F.explode(F.array_distinct(F.array("path", "normalizedPath"))).alias("toPath"), "componentName", "ord")
    exact = paths.join(exact, "toPath").groupBy("toPath").agg(F.min_by("componentName", "ord").alias("exact"))
    prefixes = paths.select("toPath", F.explode(F.transform(F.sequence(F.lit(1), F.length("toPath")), lambda i: F.substring(F.col("toPath"), F.lit(1), i))).alias("normalizedPath"))
    near = prefixes.join(nodes.where("normalizedPath <> '/' and normalizedPath <> ''"), "normalizedPath")
    near = near.groupBy("toPath").agg(F.min_by("componentName", F.struct(-F.length("normalizedPath"), "ord")).alias("near"))
    both = paths.join(exact, "toPath", "left").join(near, "toPath", "left")
    return both.select("toPath", F.coalesce("exact", "near").alias("component"))


def adjacency(nodes: DataFrame, edges: DataFrame, start: str = "/", headers: tuple[str, ...] = ("Header",)) -> DataFrame:
    """(path, normalizedPath, componentName, ord) and (sourceFile, toPath, transitionType, ord) to one row for each (fromPath, toPath).

    Columns: fromPath, fromComponent, toPath, toComponent, sourceFile, transitionType, ord.
    """
    first = nodes.groupBy(F.col("componentName").alias("stem")).agg(F.min_by("path", "ord").alias("path"))
    e = edges.withColumn("stem", file_stem(F.col("sourceFile"))).join(first, "stem", "left")
    e = e.join(longest_prefix(e.select("toPath").where(F.col("toPath") != BACK).distinct(), nodes), "toPath", "left")
    rows = e.select(
        F.coalesce("path", F.lit(COMMON)).alias("fromPath"), F.col("stem").alias("fromComponent"), "toPath",
        F.when(F.col("toPath") == BACK, BACK).otherwise(F.coalesce("component", F.lit(UNRESOLVED))).alias("toComponent"), "sourceFile", "transitionType",
        F.lit(0).alias("part"), "ord",
    )
    home = nodes.where(F.col("path") == start).agg(F.min_by("componentName", "ord").alias("home"))  # one row
    header = rows.where((F.col("fromPath") == COMMON) & F.col("fromComponent").isin(*headers) & (F.col("toPath") != start)).crossJoin(F.broadcast(home))
    copied = header.select(
        F.lit(start).alias("fromPath"), F.coalesce("home", F.lit("TopPage")).alias("fromComponent"), "toPath", "toComponent", "sourceFile", "transitionType", F.lit(1).alias("part"), "ord"
    )
    order = F.struct("part", "ord")
    kept = rows.unionByName(copied).groupBy("fromPath", "toPath").agg(
        F.min_by(F.struct("fromComponent", "toComponent", "sourceFile", "transitionType"), order).alias("r"), F.min(order).alias("o")
    )
    return kept.select("fromPath", "r.fromComponent", "toPath", "r.toComponent", "r.sourceFile", "r.transitionType", (F.col("o.part").cast("bigint") * F.lit(1 << 40) + F.col("o.ord")).alias("ord"))


def screens(adj: DataFrame) -> DataFrame:
    sides = adj.where(F.col("fromPath") != COMMON).select(F.col("fromPath").alias("screen"))
    return sides.unionByName(adj.where(F.col("toPath") != BACK).select(F.col("toPath").alias("screen"))).distinct()


def expand(adj: DataFrame, start: str = "/", multiplier: int = MULTIPLIER, max_rows: int = 50_000_000, simple_paths: bool = False) -> DataFrame:
    """Every path from the start, a row for each: level, cost, fromPath, toPath, path, ords.

    Only edges back to the start are skipped (``simple_paths``: edges to any screen of the path). The level
    beyond screens x multiplier is kept with cost -1 and ends the walk; so does a level without rows. A level
    of more than ``max_rows`` rows is an error, since paths of a dense graph multiply: none are dropped.
    """
    limit = screens(adj).count() * multiplier
    edges = materialise(adj.select("fromPath", "toPath", "ord"))
    level = edges.where(F.col("fromPath") == start).select(
        F.lit(1).cast("bigint").alias("level"), F.lit(1).cast("bigint").alias("cost"), "fromPath", "toPath", F.array("fromPath", "toPath").alias("path"), F.array("ord").alias("ords")
    )
    level = materialise(level)
    out, depth = level, 1
    step = edges.select(F.col("fromPath").alias("toPath"), F.col("toPath").alias("next"), F.col("ord").alias("next_ord"))
    while not level.isEmpty():
        depth += 1
        ahead = level.join(step, "toPath").where("next <> fromPath")
        if simple_paths:
            ahead = ahead.where(~F.array_contains("path", F.col("next")))
        over = depth > limit
        level = materialise(
            ahead.select(
                F.lit(depth).cast("bigint").alias("level"), F.lit(-1 if over else depth).cast("bigint").alias("cost"), "fromPath", F.col("next").alias("toPath"),
                F.array_append("path", F.col("next")).alias("path"), F.array_append("ords", F.col("next_ord")).alias("ords"),
            )
        )
        if (n := level.count()) > max_rows:
            raise ValueError(f"level {depth} has {n} paths, more than max_rows={max_rows}")
        out = out.unionByName(level)
        if over:
            break
    return out


def reversed_edges(adj: DataFrame) -> DataFrame:
    return adj.where(F.col("fromPath") != COMMON).select(F.col("toPath").alias("fromPath"), F.col("fromPath").alias("toPath"), "ord")


def max_cost(levels: DataFrame) -> DataFrame:
    """One row: the largest level that isn't cut off (0 without paths)."""
    return levels.agg(F.coalesce(F.max(F.when(F.col("cost") != -1, F.col("level"))), F.lit(0).cast("bigint")).alias("maxCost"))


def leaves(adj: DataFrame, start: str = "/") -> DataFrame:
    """Screens that are reached but have no edge on, but for edges to the start."""
    going = adj.where(F.col("toPath") != start).select(F.col("fromPath").alias("toPath"))
    return adj.where(F.col("toPath") != BACK).select("toPath").distinct().join(going, "toPath", "left_anti")


def maximal_paths(adj: DataFrame, levels: DataFrame, start: str = "/") -> DataFrame:
    """Paths that end at a leaf, each once, the first of equal ones."""
    ended = levels.where("cost <> -1").join(leaves(adj, start), "toPath", "left_semi")
    return ended.groupBy("path").agg(F.min_by(F.struct("level", "cost", "fromPath", "toPath", "ords"), F.struct("level", "ords")).alias("r")).select("r.*", "path")


def phase(levels: DataFrame, cost_base: int = 1) -> DataFrame:
    """levels with testPhase: cost 0 unit, the largest cost system, all others integration (cut-off rows too).

    ``cost_base`` 0 counts the screens between, as the design does, instead of the hops.
    """
    cost = F.when(F.col("cost") == -1, -1).otherwise(F.col("cost") - (1 - cost_base)).cast("bigint")
    joined = levels.crossJoin(F.broadcast(max_cost(levels)))
    top = F.col("maxCost") - (1 - cost_base)
    return joined.withColumn("cost", cost).withColumn("testPhase", F.when(F.col("cost") == 0, UNIT).when(F.col("cost") == top, SYSTEM).otherwise(INTEGRATION)).drop("maxCost")


def repeated_patterns(levels: DataFrame, least: int = 3) -> DataFrame:
    """Transitions that the expansion took ``least`` times or more after the first hop."""
    n = F.size("path")
    hop = levels.where("level > 1").select(F.element_at("path", n - 1).alias("fromPath"), F.element_at("path", n).alias("toPath"))
    return hop.groupBy("fromPath", "toPath").agg(F.count("*").alias("times")).where(F.col("times") >= least)


def bfs(adj: DataFrame, start_component: str) -> DataFrame:
    """(screenComponent, viaPath): the shortest way over components, the first found in edge order."""
    edges = materialise(adj.where(~F.col("toComponent").isin(BACK, COMMON, UNRESOLVED)).select("fromComponent", "toComponent", "ord"))
    spark = adj.sparkSession
    level = spark.createDataFrame([(start_component, [start_component], [0])], "screenComponent string, viaPath array<string>, ords array<bigint>")
    seen = level
    while not level.isEmpty():
        ahead = level.join(edges, level["screenComponent"] == edges["fromComponent"]).select(
            F.col("toComponent").alias("screenComponent"), F.array_append("viaPath", F.col("toComponent")).alias("viaPath"), F.array_append("ords", F.col("ord")).alias("ords")
        )
        fresh = ahead.join(seen.select("screenComponent"), "screenComponent", "left_anti")
        level = materialise(fresh.groupBy("screenComponent").agg(F.min_by(F.struct("viaPath", "ords"), "ords").alias("r")).select("screenComponent", "r.*"))
        seen = materialise(seen.unionByName(level))
    return seen.select("screenComponent", "viaPath")


def tiers(nodes: DataFrame, adj: DataFrame, maximal: DataFrame, start: str = "/") -> DataFrame:
    """A row for each screen component: tier1 if it has a route; else tier2 by the first maximal path that holds it, else by the shortest way, else without.

    Columns: screenComponent, tier, url, hasDynamicSegment, viaPath, viaPathCost, sourceStrategy, pathGroupId.
    """
    named = adj.select(F.explode(F.array("fromComponent", "toComponent")).alias("screenComponent")).where(~F.col("screenComponent").isin(BACK, COMMON, UNRESOLVED)).distinct()
    routed = nodes.groupBy(F.col("componentName").alias("screenComponent")).agg(F.max_by(F.struct("path", "hasDynamicSegment", "sourceStrategy"), "ord").alias("node"))
    home = (nodes.where(F.col("path") == start).agg(F.min_by("componentName", "ord")).first() or [None])[0] or "TopPage"
    # Segments of a path as components; a segment without a component keeps its path.
    names = adj.where(~F.col("toComponent").isin(BACK, COMMON, UNRESOLVED)).groupBy(F.col("toPath").alias("segment")).agg(F.max_by("toComponent", "ord").alias("name"))
    parts = maximal.select("path", "level", "ords", F.posexplode("path").alias("pos", "segment")).join(names, "segment", "left")
    name = F.coalesce("name", F.when(F.col("segment") == start, F.lit(home)).otherwise(F.col("segment")))
    lists = parts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", name.alias("name")))).alias("c"), F.first("level").alias("level"), F.first("ords").alias("ords"))
    lists = lists.select("path", "level", "ords", F.transform("c", lambda x: x["name"]).alias("components"))
    held = lists.select("path", "level", "ords", "components", F.explode(F.array_distinct("components")).alias("screenComponent"))
    best = held.groupBy("screenComponent").agg(F.min_by(F.struct("path", "components"), F.struct("level", "ords")).alias("m"))
    out = named.join(routed, "screenComponent", "left").join(best, "screenComponent", "left").join(bfs(adj, home).withColumnRenamed("viaPath", "b"), "screenComponent", "left")
    tier1 = F.col("node").isNotNull()
    via = F.coalesce(F.slice("m.components", F.lit(1), F.array_position("m.components", F.col("screenComponent")).cast("int")), F.col("b"))
    group = F.concat(F.lit("path-"), F.regexp_replace(poly31(F.array_join("m.path", SEPARATOR)), "^0+(?=.)", ""))
    return out.select(
        "screenComponent", F.when(tier1, "tier1").otherwise("tier2").alias("tier"), F.col("node.path").alias("url"),
        F.coalesce("node.hasDynamicSegment", F.lit(False)).alias("hasDynamicSegment"), F.when(~tier1, via).alias("viaPath"),
        F.when(~tier1, F.size(via) - 1).cast("bigint").alias("viaPathCost"), F.col("node.sourceStrategy").alias("sourceStrategy"), F.when(~tier1, group).alias("pathGroupId"),
    )


def summary(adj: DataFrame, forward: DataFrame, backward: DataFrame) -> DataFrame:
    """One row: counts by phase of both directions and the distinct unresolved paths, as JSON."""

    def counts(df: DataFrame, name: str) -> DataFrame:
        n = lambda p: F.count_if(F.col("testPhase") == p)
        return df.agg(F.struct(F.count("*").alias("total"), n(UNIT).alias("unit"), n(INTEGRATION).alias("integration"), n(SYSTEM).alias("system")).alias(name))

    lost = adj.where(F.col("toComponent") == UNRESOLVED).agg(F.array_sort(F.collect_set("toPath")).alias("unresolvedPaths"))
    one = counts(forward, "forward").crossJoin(counts(backward, "reverse")).crossJoin(max_cost(forward)).crossJoin(lost)  # a row each
    return one.select(F.to_json(F.struct("maxCost", "forward", "reverse", "unresolvedPaths")).alias("summary"))


def rendered(levels: DataFrame) -> DataFrame:
    """cost (MAX-OVER where the walk was cut off), fromPath, toPath, testPhase: the rows of the path files."""
    return levels.select(F.when(F.col("cost") == -1, "MAX-OVER").otherwise(F.col("cost").cast("string")).alias("cost"), "fromPath", "toPath", "testPhase")
