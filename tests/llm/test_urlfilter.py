import random

import pytest
from pyspark.sql import functions as F

from loomspan.llm import urlfilter as u

ENTRIES, CAPTURES = "list string, pattern string, day bigint, listed boolean", "page_id bigint, url string, day bigint"


def brute(url, day, entries):
    """(list, pattern) of all active entries."""
    if url is None or day is None:
        return []
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = rest.split("/")[0].split("?")[0].split("#")[0].split("@")[-1].lower()
    host = (host.split("]")[0] + "]" if host[:1] == "[" else host.split(":")[0]).rstrip(".")
    path = "/" + rest.split("/", 1)[1].split("?")[0].split("#")[0] if "/" in rest else ""
    steps = [s for s in path.split("/") if s]
    if not host:
        return []
    address = host[0] == "[" or len(host.split(".")) == 4 and all(x.isdigit() for x in host.split("."))
    keys = {host.split(".", k)[-1] for k in range(1 if address else host.count(".") + 1)} | {host + "/" + "/".join(steps[: k + 1]) for k in range(len(steps))}
    state = {}
    for name, pattern, at, listed in sorted((e for e in entries if None not in e), key=lambda e: (e[2], not e[3])):
        first, *more = pattern.split("://", 1)[-1].split("/")
        pattern = "/".join([first.lower().lstrip("*.").rstrip("."), *(x for x in more if x)])
        if at <= day and pattern in keys:
            state[name, pattern] = listed
    return sorted(k for k, on in state.items() if on)


def world():
    rng = random.Random(6)
    hosts = ["a.example", "www.a.example", "b.example", "x.y.b.example", "10.0.1.1", "[::1]:80"]
    patterns = ["a.example", "www.a.example", "example", "b.example/p", "b.example/p/q/r/s/t", "a.example/z"]
    patterns += ["A.Example", "*.a.example.", "b.example/p/", "http://B.example//p", "1.1", "10.0.1.1", "[::1]", "1.1/p", "10.0.1.1/p"]
    entries = [(rng.choice("mn"), rng.choice(patterns), rng.randrange(0, 400), rng.random() < 0.6) for _ in range(240)]
    captures = [(i, f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/p', '/p/q/r/s/t/u?x#y', '/z/'])}", rng.randrange(0, 500)) for i in range(400)]
    captures += [(1, None, 3), (2, "no url", 3), (3, "http://A.EXAMPLE.:80/", None), (4, "http://u@A.Example.:80/z", 399), (4, "http://u@A.Example.:80/z", 399)]
    return [*entries, (None, "a.example", 1, True), ("m", None, 1, True), ("m", "a.example", None, True)], captures


@pytest.mark.parametrize("broadcast", [u.BROADCAST_PATTERNS, 0])
def test_verdicts_equal_brute_force(spark, broadcast):
    entries, captures = world()
    c = spark.createDataFrame(captures, CAPTURES).withColumn("key", F.lit(1)).withColumn("span", F.lit(1)).withColumn("list", F.lit(1))
    out = sorted((r.page_id, r.url or "", r.day or -1, r.n_active, r.list, r.pattern, r.blocked) for r in u.listed_captures(c, spark.createDataFrame(entries, ENTRIES), broadcast).collect())
    want = []
    for i, url, day in captures:
        hit = brute(url, day, [e for e in entries if e[0] is not None])
        best = min(hit, key=lambda k: (-len(k[1]), k[0], k[1])) if hit else (None, None)
        want.append((i, url or "", day or -1, len(hit), *best, bool(hit)))
    assert out == sorted(want)


@pytest.mark.parametrize("entries,captures", [([], [(1, "http://a.example/", 5)]), ([("m", "a", 1, True)], []), ([], [])])
def test_empty_sides(spark, entries, captures):
    out = u.listed_captures(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(entries, ENTRIES)).collect()
    assert len(out) == len(captures) and not any(r.blocked for r in out)


def test_patterns_as_lists_hold_them():
    captures = [(1, "http://x.ads.example/a", 5), (2, "http://b.example/p/q", 5), (3, "http://10.0.1.1/", 5)]
    hit = {p: [i for i, url, day in captures if brute(url, day, [("m", p, 1, True)])] for p in ("Ads.Example", "b.example/p/", "1.1", "*.ads.example")}
    assert hit == {"Ads.Example": [1], "b.example/p/": [2], "1.1": [], "*.ads.example": [1]}
