"""Every query with SQL gives the same rows as its SQL; the others give rows."""

import duckdb
import pytest

from __spark_entry__ import entry
from check_oracle import compare, database

from workload.queries import QUERIES
from workload.sql import ORACLE


def test_every_query_is_covered():
    # What a forest learns has no SQL; test_plans holds it against its own trees and an accuracy floor.
    assert set(QUERIES) - set(ORACLE) == {"g5_importances", "g6_classes"}
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("CartesianProduct", "BroadcastNestedLoopJoin"))
    # The id over everything ends in one row of bounded size.
    assert name == "b2_dataset_id" or "SinglePartition" not in plan
    # User code, and records that tasks read from their folders.
    assert name in ("g2_user_step", "a3_scan_run_records") or not any(node in plan for node in ("EvalPython", "InPandas", "InArrow"))
    if name in ORACLE:
        con = database(sf_dir)
        assert isinstance(con, duckdb.DuckDBPyConnection)
        assert compare(df, con, ORACLE[name]) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    df = entry(spark)
    assert df.columns[:4] == ["id", "status", "start_time", "end_time"]
    times = [row["end_time"] for row in df.select("end_time").collect()]
    assert times == sorted(times, reverse=True)
