"""What a row step needs is worked out once."""

import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["rows_that_passed", "rows_set_aside"])
def test_a_row_step_is_worked_out_once(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("box is inside out") == 1
