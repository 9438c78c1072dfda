import pytest

from palimpsest import queries as Q

from . import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, con, name):
    oracle.check(Q.queries()[name](spark, SF), con, Q.oracle_sql()[name])


def test_size_tiered_pick_runs(spark):
    assert Q.size_tiered_q(spark, SF).count() >= 2


def test_filters_reach_the_scan(spark):
    text = Q.point_get_as_of(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,7)" in text and "LessThanOrEqual(ts," in text and "html" not in text
    assert "WindowGroupLimit" in text


def test_prefix_is_a_pushed_range(spark):
    text = Q.prefix_q(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(c_name" in text and "LessThan(c_name" in text


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
