"""Plans of the domain views: long texts travel once for each method, and only where they are wanted."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["q07_ng_target", "q15_ng_y_coverage", "q16_accepted", "q16_rejected", "set03_broken_rules", "q04_candidate_refresh"])
def test_rules_read_no_context(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert "importList" not in text and "s_suppkey" not in text.replace("l_suppkey", "")


@pytest.mark.parametrize("name", ["q01_all_targets", "q02_mirror_candidates", "q03_ai_input", "q05_test_spec"])
def test_context_is_never_broadcast_nor_shuffled_by_file(spark, name):
    lines = plan(entry.queries()[name](spark, FOLDER)).split("\n")
    last = next(x for x in lines if "Join" in x)
    assert "SortMergeJoin [filePath" in last and "methodName" in last and not [x for x in lines if "methodSemanticContext" in x and "Exchange" in x]


@pytest.mark.parametrize("name", ["q16_rejected", "set03_broken_rules"])
def test_specification_is_shuffled_twice(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert text.count("hashpartitioning(CaseNo") == 1 and text.count("REPARTITION_BY_COL") == 2
