"""URL filters: a temporal join of captures with dated list entries.

A list is a log of dated entries: at ``day`` a pattern of a list is added or
removed. Entries become validity intervals: an interval begins where a pattern
becomes listed and ends where it is next removed (repeated adds or removals
change nothing; of entries of one day the last in the order add, remove
counts). Every capture is then joined, as of its fetch day, with the entries
active on that day.

A pattern is a host with all its subdomains ("ads.example") or a host and the
beginning of its path, at a "/" ("example.com/spam"). Patterns are made
canonical first: no scheme, the host in lower case without leading "*." or "."
and without a "." at its end, no empty path segments. An address (IPv4, or IPv6
in brackets) has no subdomains. A capture has one candidate key for each suffix
of its host and each prefix of its path, so the join is an equality of keys;
intervals are cut at spans of ``SPAN_DAYS`` days and captures carry their span,
so a pattern listed and delisted any number of times meets a capture with a few
intervals only. Suffixes of a number of labels that no pattern has aren't made
("com" is a key only if a list holds a whole top-level domain), and if the
patterns are few enough to broadcast, keys that none has go before the shuffle.
Hot hosts meet a short list side and Spark may split them.

Defined results: a capture without url, host or day is not listed. Entries
with a null, or without a host, are not used. The verdict names the longest
pattern, then the least list. Repeated captures are each reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.storage import materialise

SPAN_DAYS = 64
OPEN_END = 1_000_000
#: Patterns that may be broadcast, to leave out other keys before the shuffle.
BROADCAST_PATTERNS = 500_000
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"
_HOST = _SCHEME + r"(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
_ADDRESS = r"^(?:\d+(?:\.\d+){3}|\[.*)$"


def canonical(pattern: Column) -> Column:
    """The form in which patterns meet keys; null without a host."""
    bare = F.regexp_replace(F.trim(pattern), _SCHEME, "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/]*", 0)), r"^(?:\*?\.)+|\.+$", "")
    steps = F.filter(F.split(F.regexp_extract(bare, "/.*", 0), "/"), lambda x: x != "")
    return F.when(host != "", F.concat_ws("/", F.array(host), steps))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, day, listed) to (list, pattern, valid_from, valid_to), days whole numbers, valid_to exclusive."""
    known = entries.select("list", canonical(F.col("pattern")).alias("pattern"), "day", "listed")
    known = known.where("list is not null and pattern is not null and day is not null and listed is not null")
    daily = known.groupBy("list", "pattern", "day").agg(F.min("listed").alias("listed"))  # a removal wins its day
    order = Window.partitionBy("list", "pattern").orderBy("day")
    changed = daily.withColumn("was", F.coalesce(F.lag("listed").over(order), F.lit(False))).where("listed <> was")
    # What is left alternates, so the next change of an add is its removal.
    return changed.withColumn("valid_to", F.coalesce(F.lead("day").over(order), F.lit(OPEN_END))).where("listed").select(
        "list", "pattern", F.col("day").alias("valid_from"), "valid_to"
    )


def host_of(url: Column) -> Column:
    return F.rtrim(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit("."))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def candidate_keys(url: Column, segments: int, labels: list[int] | None = None) -> Column:
    """Host suffixes (of a number of labels in ``labels``, if given), and the host with each path prefix of up to ``segments`` segments."""
    parts = F.split(host_of(url), r"\.")
    wanted = F.sequence(F.lit(1), F.size(parts))
    if labels is not None:
        wanted = F.filter(wanted, lambda i: (F.size(parts) - i + 1).isin(labels) if labels else F.lit(False))
    suffixes = F.when(host_of(url).rlike(_ADDRESS), F.array(host_of(url))).otherwise(
        F.transform(wanted, lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    )
    steps = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    prefixes = F.when(
        (F.size(steps) > 0) & (F.lit(segments) > 0),
        F.transform(
            F.sequence(F.lit(1), F.least(F.size(steps), F.lit(segments))),
            lambda i: F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(host_of(url)) > 0, F.array_distinct(F.concat(suffixes, prefixes))).otherwise(F.array().cast("array<string>"))


def listed_captures(captures: DataFrame, entries: DataFrame, broadcast_patterns: int = BROADCAST_PATTERNS) -> DataFrame:
    """(page_id, url, day) to page_id, url, day, n_active (entries active on that day), list and pattern (of the verdict), blocked."""
    valid = materialise(intervals(entries))
    shape = valid.agg(
        F.max(F.size(F.split("pattern", "/")) - 1).alias("deepest"), F.count("*").alias("n"),
        F.collect_set(F.when(~F.col("pattern").contains("/"), F.size(F.split("pattern", r"\.")))).alias("labels"),  # a host has 127 at most
    ).first()
    spans = valid.select(
        "list", F.col("pattern").alias("key"), "valid_from", "valid_to",
        # An interval without end is listed under its spans up to the last capture; see below.
        F.floor(F.col("valid_from") / SPAN_DAYS).alias("first_span"), F.floor((F.col("valid_to") - 1) / SPAN_DAYS).alias("last_span"),
    )
    most = captures.agg(F.floor(F.max("day") / SPAN_DAYS)).first()[0] or 0
    spans = spans.where(F.col("first_span") <= most).withColumn(
        "span", F.explode(F.sequence("first_span", F.least("last_span", F.lit(most).cast("bigint"))))
    )
    once = captures.where("url is not null and day is not null").select("url", "day").distinct()
    keys = F.explode(candidate_keys(F.col("url"), shape.deepest or 0, list(shape.labels)))
    asked = once.select("url", "day", F.floor(F.col("day") / SPAN_DAYS).alias("span"), keys.alias("key"))
    if shape.n <= broadcast_patterns:
        asked = asked.join(F.broadcast(valid.select(F.col("pattern").alias("key")).distinct()), "key", "left_semi")
    active = asked.join(spans, ["key", "span"]).where("valid_from <= day and day < valid_to")
    best = F.struct(-F.length("key"), "list", "key")
    found = active.groupBy("url", "day").agg(F.count("*").alias("n_active"), F.min_by(F.struct("list", "key"), best).alias("best"))
    return captures.select("page_id", "url", "day").join(found, ["url", "day"], "left").select(
        "page_id", "url", "day", F.coalesce("n_active", F.lit(0).cast("bigint")).alias("n_active"), "best.list",
        F.col("best.key").alias("pattern"), F.col("n_active").isNotNull().alias("blocked"),
    )


# The tables hold neither fetch days nor lists, so the query derives both from the pages, by rule.
FIRST_DAY, DAYS = 19_700, 730
#: Parts of host names that a list blocks from its first day on, with the day of their removal.
BAD = (("ads-track", 400), ("casino-win", 300), ("free-bets", None), ("adult-x", None), ("spam-farm", 600), ("cheap-pills", None))


def derived_captures(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", (F.pmod(F.col("page_id") * 37, F.lit(DAYS)) + FIRST_DAY).alias("day"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for the hosts of the pages: bad names, and a rule on the host's hash (added, removed and added again)."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    number = F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("bigint")
    hosts = hosts.withColumn("n", number)
    domain = F.regexp_replace("host", r"^[^.]*\.(?=[^.]*\.[^.]*\.)", "")
    parts = []
    for name, until in BAD:
        bad = hosts.where(F.col("host").contains(name))
        parts.append(bad.select(F.lit("named").alias("list"), domain.alias("pattern"), F.lit(FIRST_DAY + 30).cast("bigint").alias("day"), F.lit(True).alias("listed")))
        if until is not None:
            parts.append(bad.select(F.lit("named"), domain, F.lit(FIRST_DAY + until).cast("bigint"), F.lit(False)))
    some = hosts.where("n % 5 = 0")
    for k, (shift, listed) in enumerate(((0, True), (90, False), (200, True), (310, False))):
        parts.append(some.select(F.lit("hashed"), F.col("host"), F.pmod("n", F.lit(400)) + FIRST_DAY + shift, F.lit(listed)))
    parts.append(hosts.where("n % 3 = 0").select(F.lit("paths"), F.concat("host", F.lit("/en")), F.pmod("n", F.lit(DAYS)) + FIRST_DAY, F.lit(True)))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


SQL = r"""
WITH host AS (SELECT page_id, url, (page_id * 37) % 730 + 19700 AS day,
    rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1)), '.') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
h AS (SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 6))::BIGINT AS n,
    CASE WHEN len(string_split(host, '.')) > 3 THEN array_to_string(string_split(host, '.')[2:], '.') ELSE host END AS domain FROM host WHERE host <> ''),
bad AS (SELECT * FROM (VALUES ('ads-track', 400), ('casino-win', 300), ('free-bets', NULL), ('adult-x', NULL),
    ('spam-farm', 600), ('cheap-pills', NULL)) AS b(name, until)),
entry AS (
  SELECT 'named' AS list, domain AS pattern, 19730 AS day, true AS listed FROM h JOIN bad ON contains(host, name)
  UNION ALL SELECT 'named', domain, 19700 + until, false FROM h JOIN bad ON contains(host, name) WHERE until IS NOT NULL
  UNION ALL SELECT 'hashed', host, n % 400 + 19700 + s, l FROM h, (VALUES (0, true), (90, false), (200, true), (310, false)) AS v(s, l) WHERE n % 5 = 0
  UNION ALL SELECT 'paths', host || '/en', n % 730 + 19700, true FROM h WHERE n % 3 = 0),
daily AS (SELECT list, pattern, day, bool_and(listed) AS listed FROM entry GROUP BY ALL),
valid AS (
  SELECT list, pattern, day AS valid_from,
         coalesce((SELECT min(r.day) FROM daily r WHERE r.list = a.list AND r.pattern = a.pattern AND NOT r.listed AND r.day > a.day), 1000000) AS valid_to
  FROM daily a WHERE listed
    AND coalesce((SELECT NOT arg_max(p.listed, p.day) FROM daily p WHERE p.list = a.list AND p.pattern = a.pattern AND p.day < a.day), true)),
steps AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg, string_split(host, '.') AS labels FROM host),
asked AS (
  SELECT page_id, url, day, unnest(list_distinct(list_concat(
    CASE WHEN regexp_matches(host, '^(\d+(\.\d+){3}|\[.*)$') THEN [host]
         ELSE list_transform(range(1, len(labels) + 1), lambda i: array_to_string(labels[i:], '.')) END,
    list_transform(range(1, len(seg) + 1), lambda i: host || '/' || array_to_string(seg[1:i], '/'))))) AS key
  FROM steps WHERE host <> ''),
best AS (
  SELECT page_id, url, count(*) AS n_active,
         arg_min({'list': list, 'key': key}, {'l': -length(key), 'list': list, 'key': key}) AS b
  FROM asked JOIN valid ON pattern = key AND valid_from <= day AND day < valid_to GROUP BY page_id, url)
SELECT p.page_id, p.url, p.day, coalesce(n_active, 0) AS n_active, b.list AS list, b.key AS pattern, n_active IS NOT NULL AS blocked
FROM host p LEFT JOIN best USING (page_id, url)"""
