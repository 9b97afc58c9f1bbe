"""Every registered query against its SQL on the smallest tables."""

import sys
from pathlib import Path

import pytest
from oracle import compare, connect

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import entry, oracle_sql, queries

from ferrywork.plans.registry import load_checks

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("key", sorted(load_checks()))
def test_query_matches_its_sql(spark, con, key):
    df = queries()[key](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert key == "t_script_udtf" or "MapIn" not in plan and "PythonUDF" not in plan
    if key in oracle_sql():
        assert compare(df, con, oracle_sql()[key]) == []
    else:
        assert df.count() > 0


def test_entry_gives_rows(spark):
    assert entry(spark).count() > 0
