"""UI elements of a component."""

from loomspan.operators import ui
from loomspan.sources import code


def test_elements_are_scanned_once_and_counted_without_broadcast(spark):
    files = spark.createDataFrame([(f"src/P{i}.tsx", '<form id="f"><input aria-label="a"/><a href="/x">go</a></form>') for i in range(3)], "path string, text string")
    rows = ui.resolved(code.jsx_elements(files))
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert text.count("MapIn") == 1 and "Broadcast" not in text
    assert {(r.componentName, r.tag, r.siblingCount) for r in rows.collect()} == {(f"P{i}", tag, 2) for i in range(3) for tag in ("input", "a")}
