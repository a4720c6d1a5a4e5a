"""Registered queries against their SQL in a second engine, and rules on their plans."""

import pytest

from defectloom.plans.oracle import ORACLE
from defectloom.plans.queries import QUERIES
from tools import check_oracle

ROWS_ONLY = sorted(set(QUERIES) - set(ORACLE))


@pytest.fixture(scope="module")
def duck():
    check_oracle.SF_DIR = "/root/testdata/sf0.001"
    return check_oracle.duck()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, name):
    assert check_oracle.compare(spark, duck, QUERIES[name], ORACLE[name]) == "ok"


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_only_operators_without_sql_lack_it():
    assert ROWS_ONLY == ["stream_score", "train_and_evaluate", "train_and_score"]


LAZY = [
    "split_stats", "length_profile", "heldout_metrics", "evaluation_report", "pair_rows",
    "unpaired", "attach_predictions", "early_stop", "leaderboard_all", "encode", "decode",
    "pad_batches", "accepted_batches", "project_ranking", "preview", "variant_rows",
]


@pytest.mark.parametrize("name", LAZY)
def test_no_row_is_joined_with_all_rows(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_columns_are_pruned_and_filters_pushed(spark, sf_dir):
    plan = QUERIES["leaderboard_all"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert scans and all("props" not in line and "value" not in line for line in scans)
    plan = QUERIES["project_split_sorted"](spark, sf_dir)._jdf.queryExecution().executedPlan()
    scans = [line for line in plan.toString().splitlines() if "FileScan parquet" in line]
    assert scans and all("text" not in line for line in scans)


def test_batches_are_counted_before_the_shuffle(spark, sf_dir):
    plan = QUERIES["accepted_batches"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert "partial_count" in plan[plan.rindex("Exchange") :]


def test_no_global_sort_of_data_rows(spark, sf_dir):
    """Numbering is done per bucket: the only one-task windows are over bucket sizes."""
    plan = QUERIES["batches"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [row_number()" in line]
    assert windows and all("windowspecdefinition(_bucket" in line for line in windows)


def test_one_split_is_read_alone(spark, sf_dir):
    from defectloom.plans.training import of_split
    from defectloom.plans.queries import written_splits

    plan = of_split(written_splits(spark, sf_dir), "train")._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [isnotnull(split" in plan.toString()
