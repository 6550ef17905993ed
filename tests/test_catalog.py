import os
import re
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

import check_oracle  # noqa: E402

import __spark_entry__ as entry_point  # noqa: E402
from mensura.plans.registry import ORACLE, QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="input tables not present")

# One or two per family; tools/check_oracle.py runs them all.
CHECKED = """s04_read_keyed_json s06_manifest p02_to_number p11_classify_censoring p24_largest_component t01_keyword_matrix t03_extract_field
t09_clause_then_numbers j03_outer_with_indicator j06_constrained_self_join j10_star_join a01_entity_aggregate a05_long_value_counts
w03_keep_one w04_average_rank q05_counts_match d02_delta_values m03_roc_auc m07_fold_summary k01_group_kfold f02_descriptors
l01_mean_baseline l12_partial_correlation e04_release_counts""".split()


@pytest.fixture(scope="module")
def con():
    return check_oracle.connect(FOLDER)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_statement(spark, con, name):
    assert check_oracle.compare(QUERIES[name](spark, FOLDER), con, ORACLE[name]) in (None, "both empty")


def test_entry_point(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


# Every operator of the inventory except those that are part of another or are built in.
INVENTORY = {"s": 11, "p": 26, "t": 15, "j": 13, "a": 18, "w": 7, "u": 3, "q": 12, "d": 6, "c": 9, "m": 9, "k": 7, "f": 5, "l": 13}


def test_inventory_is_covered():
    have = {n.split("_")[0] for n in QUERIES}
    want = {f"{letter}{i:02d}" for letter, many in INVENTORY.items() for i in range(1, many + 1)}
    assert want <= have


PLANNED = "p10_strict_filter a01_entity_aggregate a02_source_aggregate j10_star_join d02_delta_values m01_regression_metrics w03_keep_one".split()


@pytest.mark.parametrize("name", PLANNED)
def test_plan_has_no_cartesian_product_or_global_window(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"Window \[[^\]]*\], \[\],", plan)


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["p10_strict_filter"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,R)" in plan and "l_shipdate" not in plan
