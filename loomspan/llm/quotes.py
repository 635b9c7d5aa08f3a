"""Chat formatting by quotation linking, on native operations only.

Lines that begin with ">" are quotes; the number of ">" is their level. Runs of
lines of one level are passages. Passages, and the messages' own text, are cut
into units (the passage, each of its sentences, each line and each run of
consecutive lines), normalised (lower case, letters and digits only, single
spaces) and hashed, so a quote may be part of a list or wrapped in another way.
Runs of more words than the longest passage of the other side in the
conversation can't meet anything and aren't made. A quoted unit belongs to the
original message: the first message of the conversation whose own text has that
unit, if it is earlier. A message answers the message that most of its units of
the outermost matched level come from (ties: the latest); without any, it
answers the message before it.

A message that answers any but the message before it begins a branch. In reply
order a conversation is its branches one after the other, each a chain of
messages that answer the one before: sort by conv_id, branch, place. Each row
carries the message without quotes and attribution lines, in chat form.

Ranks within a conversation are sums over ranges of turns, so a conversation of
any length is many small ranges; messages of a conversation are never collected.

Defined results: null text is empty text. Messages without conv_id or turn have
no parent and are branch 0, place 0. Messages of the same turn share parent,
branch and place. Units of fewer than ``UNIT_WORDS`` words are only compared as
whole passages and whole lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT_WORDS = 3
#: Turns of a range.
RANGE_TURNS = 1024
MARK = r"^(?:[ \t]*>)+"
ATTRIBUTION = r"(?i)^\s*(?:on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió|[^\s].*\bwrote)\s*:\s*$"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def level_of(line: Column) -> Column:
    return F.length(F.translate(F.regexp_extract(line, MARK, 0), " \t", ""))


def _lines(text: Column) -> Column:
    """Array of (level, line), without attribution lines (those right before a quote)."""

    def attributed(lines: Column) -> Column:
        pairs = F.transform(lines, lambda x: F.struct(level_of(x).alias("level"), F.regexp_replace(x, MARK + r"[ \t]?", "").alias("line")))

        def keep(ps: Column) -> Column:
            def own(p: Column, i: Column) -> Column:
                quoted_next = F.coalesce(F.get(ps, i + 1)["level"] > p["level"], F.lit(False))
                return ~(p["line"].rlike(ATTRIBUTION) & quoted_next)

            return F.filter(ps, own)

        return let(pairs, keep)

    return let(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n"), attributed)


def passages(text: Column) -> Column:
    """Array of (level, text): runs of lines of one level, in order."""

    def runs(lines: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.coalesce(F.get(lines, i)["level"] != F.get(lines, i - 1)["level"], F.lit(True))
        )

        def cut(at: Column) -> Column:
            def run(i: Column, k: Column) -> Column:
                end = F.coalesce(F.get(at, k + 1), F.size(lines))
                part = F.transform(F.slice(lines, i + 1, end - i), lambda p: p["line"])
                return F.struct(F.get(lines, i)["level"].alias("level"), F.array_join(part, "\n").alias("text"))

            return F.transform(at, run)

        return F.when(F.size(lines) > 0, let(starts, cut)).otherwise(F.array().cast("array<struct<level:int,text:string>>"))

    return let(_lines(text), runs)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def lines_of(text: Column) -> Column:
    """A passage's lines, normalised, without those that have no words."""
    return F.filter(F.transform(F.split(text, "\n"), normalised), lambda s: s != "")


def units(text: Column) -> Column:
    """Distinct hashes of a passage's units but its runs of lines."""
    sentences = F.filter(
        F.transform(F.split(text, r"(?<=[.!?])\s+|\n\s*\n"), normalised), lambda s: F.size(F.split(s, " ")) >= UNIT_WORDS
    )
    whole = F.filter(F.array(normalised(text)), lambda s: s != "")
    return F.array_distinct(F.transform(F.concat(sentences, whole, lines_of(text)), lambda s: F.xxhash64(s)))


def runs_from(lines: Column, words: Column, start: Column, most: Column) -> Column:
    """Hashes of the runs of two lines or more, ``UNIT_WORDS`` words or more and ``most`` words at most that begin at a line (from 0).

    ``words``: the number of words up to the end of each line.
    """
    before = F.when(start > 0, F.get(words, start - 1)).otherwise(0)
    last = F.least(F.size(lines) - start, most)  # every line has a word
    counts = F.filter(F.when(last >= 2, F.sequence(F.lit(2), last)).otherwise(F.array().cast("array<int>")), lambda n: (F.get(words, start + n - 1) - before).between(UNIT_WORDS, most))
    return F.transform(counts, lambda n: F.xxhash64(F.array_join(F.slice(lines, start + 1, n), " ")))


def body(text: Column) -> Column:
    """The message's own text: lines of level 0, trimmed, runs of blank lines made one."""
    own = F.transform(F.filter(_lines(text), lambda p: p["level"] == 0), lambda p: p["line"])
    return F.regexp_replace(F.regexp_replace(F.array_join(own, "\n"), r"\n\s*\n\s*(?=\n)", "\n"), r"^\s+|\s+$", "")


def chat_form(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("user")), F.lit("|>\n"), text, F.lit("\n<|end|>\n"))


def _runs(parts: DataFrame) -> DataFrame:
    """(conv_id, turn, level, unit) of the runs of lines that the other side's passages are long enough for."""
    lined = parts.select("conv_id", "turn", "level", F.explode(F.array(lines_of(F.col("text")))).alias("lines"))
    total = F.aggregate("lines", F.lit(0), lambda n, s: n + F.size(F.split(s, " ")))
    longest = lined.groupBy("conv_id").agg(
        F.max(F.when(F.col("level") == 0, total)).alias("own"), F.max(F.when(F.col("level") > 0, total)).alias("quoted")
    )
    most = F.when(F.col("level") == 0, F.col("quoted")).otherwise(F.col("own"))
    several = lined.where(F.size("lines") > 1).join(longest, "conv_id").withColumn("most", most).where(F.col("most") >= UNIT_WORDS)
    none = F.array().cast("array<int>")
    ends = F.aggregate(
        "lines", none, lambda at, s: F.concat(at, F.array(F.coalesce(F.element_at(F.when(F.size(at) > 0, at), -1), F.lit(0)) + F.size(F.split(s, " "))))
    )
    starts = several.select("conv_id", "turn", "level", "lines", "most", F.explode(F.array(ends)).alias("words"))
    starts = starts.select("*", F.explode(F.sequence(F.lit(0), F.size("lines") - 2)).alias("start"))
    runs = runs_from(F.col("lines"), F.col("words"), F.col("start"), F.col("most"))
    return starts.select("conv_id", "turn", "level", F.explode(runs).alias("unit"))


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, origin): the earlier turn that a turn's quotes come from."""
    known = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    quoting = known.where(F.col("text").rlike(r"(?m)^[ \t]*>"))
    # Only conversations with a quote are read for origins.
    asked = known.join(quoting.select("conv_id").distinct(), "conv_id", "left_semi")
    parts = asked.select("conv_id", "turn", F.explode(passages(F.col("text"))).alias("p")).select("conv_id", "turn", "p.level", "p.text")
    hashed = parts.select("conv_id", "turn", "level", F.explode(units(F.col("text"))).alias("unit")).unionByName(_runs(parts))
    origins = hashed.where("level = 0").groupBy("conv_id", "unit").agg(F.min("turn").alias("origin"))
    quoted = hashed.where("level > 0").groupBy("conv_id", "turn", "level", "unit").agg(F.lit(1).alias("one")).drop("one")
    met = quoted.join(origins, ["conv_id", "unit"]).where("origin < turn")
    votes = met.groupBy("conv_id", "turn", "level", "origin").agg(F.count("*").alias("n"))
    return votes.groupBy("conv_id", "turn").agg(F.min_by("origin", F.struct("level", -F.col("n"), -F.col("origin"))).alias("origin"))


def _placed(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, origin) to conv_id, turn, parent_turn, branch, place; all ranks by ranges of turns."""
    ranged = turns.withColumn("range", F.floor(F.col("turn") / RANGE_TURNS))
    per_range = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    last = ranged.groupBy("conv_id", "range").agg(F.max("turn").alias("last"))
    last = last.withColumn("before", F.max("last").over(per_range)).drop("last")
    within = Window.partitionBy("conv_id", "range").orderBy("turn")
    linked = ranged.join(last, ["conv_id", "range"]).withColumn("previous", F.coalesce(F.lag("turn").over(within), "before")).drop("before")
    linked = linked.withColumn("parent_turn", F.coalesce("origin", "previous"))
    linked = linked.withColumn("starts", F.coalesce(F.col("parent_turn") != F.col("previous"), F.lit(False)).cast("bigint"))
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    linked = linked.select(
        "*", F.sum("starts").over(running).alias("starts_in"), F.count("*").over(running).alias("row_in"),
    )
    linked = linked.withColumn("start_row_in", F.max(F.when(F.col("starts") == 1, F.col("row_in"))).over(running))
    totals = linked.groupBy("conv_id", "range").agg(
        F.sum("starts").alias("n_starts"), F.count("*").alias("n_rows"), F.max("start_row_in").alias("last_start")
    )
    totals = totals.select(
        "conv_id", "range", "last_start",
        F.coalesce(F.sum("n_starts").over(per_range), F.lit(0)).alias("starts_before"), F.coalesce(F.sum("n_rows").over(per_range), F.lit(0)).alias("rows_before"),
    )
    totals = totals.withColumn("start_before", F.coalesce(F.max(F.col("rows_before") + F.col("last_start")).over(per_range), F.lit(1)))
    out = linked.join(totals.drop("last_start"), ["conv_id", "range"])
    start = F.coalesce(F.col("rows_before") + F.col("start_row_in"), F.col("start_before"))
    return out.select(
        "conv_id", "turn", "parent_turn", (F.col("starts_before") + F.col("starts_in")).alias("branch"),
        (F.col("rows_before") + F.col("row_in") - start).alias("place"), F.col("origin").isNotNull().alias("linked"),
    )


def reply_ordered(messages: DataFrame) -> DataFrame:
    """A row for each message: conv_id, turn, role, parent_turn, branch, place, linked (by a quote), body, formatted."""
    turns = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    placed = _placed(turns.join(links(messages), ["conv_id", "turn"], "left"))
    out = messages.select("conv_id", "turn", "role", body(F.col("text")).alias("body")).join(placed, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "parent_turn", F.coalesce("branch", F.lit(0).cast("bigint")).alias("branch"),
        F.coalesce("place", F.lit(0).cast("bigint")).alias("place"), F.coalesce("linked", F.lit(False)).alias("linked"),
        "body", chat_form(F.col("role"), F.col("body")).alias("formatted"),
    )
