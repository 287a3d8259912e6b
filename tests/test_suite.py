import pytest
from oracle import assert_same, connect

from framesql import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    assert_same(plans.QUERIES[name](spark, SF), con, plans.ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["sort_multi_mixed", "sort_nulls", "sort_nulls_default", "sort_expression"])
def test_order(spark, con, name):
    key = lambda r: r[0]
    assert list(map(key, plans.QUERIES[name](spark, SF).collect())) == list(map(key, con.execute(plans.ORACLE_SQL[name]).fetchall()))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    assert "LeftSemi" in plan(plans.QUERIES["exists"](spark, SF))
    assert "LeftAnti" in plan(plans.QUERIES["not_exists"](spark, SF))
    assert "TakeOrderedAndProject" in plan(plans.QUERIES["topk"](spark, SF))
    text = plan(plans.QUERIES["filter_between"](spark, SF))
    assert "PushedFilters: [IsNotNull(l_discount)" in text and "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_discount:double>" in text
    assert "CartesianProduct" not in plan(plans.QUERIES["join_comma_where"](spark, SF))
