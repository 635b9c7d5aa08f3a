"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "q01_all_targets", "q05_test_spec", "q16_rejected", "q17_missing_y", "q19_expanded_instructions", "dml01_typed_load", "prj02_composite_key", "prj09_row_id", "flt03_suffix_any_case", "jn04_computed_key",
    "jn11_or_join", "jn13_path_key", "jn15_first_match", "jn16_longest_prefix", "jn17_nearest_ancestor", "ag01_packed_by_group", "ag06_first_wins", "ag08_conditional_counts", "set08_unpivot", "rec02_tokens_compat",
    "gr01_adjacency", "gr05_maximal_paths", "gr09_shortest_paths", "dom06_scopes", "dom07_path_hash", "q21_case_numbers", "q22_labels", "q23_scope_groups", "gen02_values", "gen08_elements",
    "tre02_arguments", "tre10_enum_pages", "src03_csv_by_header", "src13_file_routes", "src14_page_links", "src14_transitions",
    "src07_dom_csv", "src09_java_scan", "src15_jsx_elements", "snk08_elements_csv", "snk08_elements_json", "snk08_elements_markdown", "snk09_evidence_append", "gen12_container_build", "tre08_control_flow", "rec04_data_paths", "dml05_refresh",
    "dml07_lifecycle", "q24_interactions", "jn09_theta", "q16_accepted", "q10_ng_y",
]


def rows(frame):
    def plain(x):
        if not isinstance(x, (list, dict)) and not hasattr(x, "shape") and pd.isna(x):
            return None
        return int(x) if isinstance(x, (bool, float)) and x == int(x) else x

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(repr([plain(x) for x in r]) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    got, want = entry.queries()[name](spark, FOLDER).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100
