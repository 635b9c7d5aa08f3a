"""Scans of source files and pages: rows are bounded, files are scanned once and by many tasks."""

import tracemalloc

from pyspark.sql import functions as F

from loomspan.functions.batches import batches
from loomspan.sources import code


def java(n):
    return "class C { final int k = 1; int v; " + "".join(f"public void m{i}(int a, List<String> b) {{ x(); }} " for i in range(n)) + "}"


def test_rows_come_in_bounded_lists():
    assert [len(x) for x in batches(iter(range(10000)))] == [4096, 4096, 1808] and list(batches([])) == []


def test_only_the_kinds_asked_for_are_kept():
    whole = code.parse_file("p", java(5))
    for kind in ("file", "method", "field"):
        assert code.parse_file("p", java(5), kind) == [r for r in whole if r["row"] == kind]
    assert {k: whole[0][k] for k in ("methodCount", "variableCount", "constantCount")} == {"methodCount": 5, "variableCount": 1, "constantCount": 1}


def test_tokens_of_a_long_file_are_small():
    text = java(2000)
    tracemalloc.start()
    t = code._Tokens(text)
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert size < 15 * len(t.all) and t.all[0] == ("name", "class", 0) and t.all[:3] == code.lex(text)[:3] and len(t.all) == len(code.lex(text))


def test_short_rows_with_long_scans_go_to_all_tasks(spark):
    from loomspan.functions.joins import dealt

    assert dealt(spark.range(100).coalesce(1), "id").groupBy(F.spark_partition_id()).count().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
