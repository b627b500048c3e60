import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from oracle import assert_same, database

from skylog.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    """The rows are those of the SQL, and no join pairs all rows with all, nor does a row go through Python alone."""
    rows = QUERIES[name](spark, DATA)
    assert_same(rows, database(DATA), SQL[name])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"))


@pytest.mark.parametrize("name", ["detect_steps", "first_steps", "step_summary"])
def test_gyro_at_a_bound(spark, tmp_path, name):
    """A gyro that lies at a tenth of a step to the last bit: 30 raw units are a little less than 30 degrees a second."""
    events = spark.range(2600).selectExpr("id as event_id", "id as user_id", "'click' as event_type", "10.0D as value")
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert_same(QUERIES[name](spark, str(tmp_path)), database(str(tmp_path)), SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5 * 3 * 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
