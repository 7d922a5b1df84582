"""What the physical plans must and must not hold."""

import re

import pytest

from posevidence.plans.catalog import REGISTRY
from posevidence.sources.adapter import CheckTables

DIRECTORY = "/root/testdata/sf0.001"
SKIPPED_FOR_TIME = {"streamed_tracks", "streamed_counts", "streamed_latest_shapes"}


def plan(spark, name):
    df = REGISTRY[name].build(CheckTables(spark, DIRECTORY))
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - SKIPPED_FOR_TIME))
def test_no_cross_join(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_window_reaches_the_scan(spark):
    for name in ("manifest", "positions", "record_count", "quality_summary"):
        text = plan(spark, name)
        assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts", text), name


def test_counting_reads_only_what_it_counts(spark):
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan(spark, "log_extent")).group(1)
    assert read == "ts:timestamp"
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan(spark, "record_count")).group(1)
    assert "props" not in read and "value" not in read


def test_counts_shuffle_once_per_device(spark):
    assert plan(spark, "record_count").count("Exchange hashpartitioning") == 1
    # Decoding channels adds no shuffle at all.
    assert "Exchange" not in plan(spark, "decoded_masks")
    assert "Exchange" not in plan(spark, "locations")
