import random

import pandas as pd
import pytest

import framesql
from framesql import ExecuteError, UnsupportedError, execute, operators
from framesql.functions import ratio, sum_text


@pytest.fixture(scope="module")
def t1(spark):
    r = random.Random(123)
    return spark.createDataFrame([(f"t_{r.randrange(1000)}", r.random(), r.randrange(100)) for _ in range(100)], "a string, b double, c bigint")


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame([(1, "x", 1.0), (None, "x", None), (2, None, 3.0), (1, "y", None), (None, None, None)], "k int, g string, v double")


def test_project_and_filter(t1):
    got = execute("select a, b/2 as H from t where c > 50", tables={"t": t1}).toPandas()
    want = t1.toPandas().query("c > 50")
    assert got.columns.tolist() == ["a", "h"] and sorted(got.h) == sorted(want.b / 2)


def test_sum_of_text_and_names(t1):
    got = execute("select c, SUM(a) as SUM_A, AVG(b/2) as avg_b from t group by c order by c limit 30", tables={"t": t1}).toPandas()
    want = t1.toPandas().groupby("c").agg(a=("a", list), b=("b", "mean")).head(30)
    assert got.columns.tolist() == ["c", "sum_a", "avg_b"]
    for mine, theirs in zip(got.sum_a, want.a, strict=True):
        assert sorted(mine.split("t_")[1:]) == sorted(x[2:] for x in theirs)


def test_join_and_sort(spark, t1):
    t2 = t1.select("a", "b").dropDuplicates(["a"])
    got = execute("select t1.a, t2.b/2 as h from t1, t2 where t1.a == t2.a order by t1.c desc, t1.a limit 10", tables={"t1": t1, "t2": t2}).toPandas()
    want = t1.toPandas().merge(t2.toPandas(), on="a").sort_values(["c", "a"], ascending=[False, True]).head(10)
    assert got.a.tolist() == want.a.tolist() and got.h.tolist() == (want.b_y / 2).tolist()


def test_three_valued_logic(nulls):
    one = lambda q: [tuple(r) for r in execute(q, tables={"t": nulls}).collect()]
    assert one("select count(*), count(v), sum(v) from t") == [(5, 2, 4.0)]
    assert one("select count(*) from t where not (v > 1)") == [(1,)]
    assert one("select count(*) from t as a join t as b on a.k = b.k") == [(5,)]
    assert one("select count(*) from t where k not in (select k from t)") == [(0,)]
    assert sorted(one("select g, count(*) from t group by g"), key=str) == [("x", 2), ("y", 1), (None, 2)]
    assert one("select cast(null as text), sum(v) from t where k = 7") == [(None, None)]
    assert one("select count(*) from t where g like 'X'") == [(0,)]
    assert one("select count(*) from t as a full join t as b on a.k = b.k and a.v > 100") == [(10,)]


@pytest.mark.parametrize(("dialect", "want"), [("duckdb", [1, 2, None]), ("presto", [1, 2, None]), ("snowflake", [1, 2, None]), ("spark", [None, 1, 2]), ("bigquery", [None, 1, 2]), (None, [None, 1, 2])])
def test_default_null_order(spark, dialect, want):
    t = spark.createDataFrame([(2,), (None,), (1,)], "k int")
    assert [r[0] for r in execute("select k from t order by k", dialect=dialect, tables={"t": t}).collect()] == want
    down = [r[0] for r in execute("select k from t order by k desc nulls first", dialect=dialect, tables={"t": t}).collect()]
    assert down == [None, 2, 1]


def test_nested_names(spark, t1):
    tables = {"db": {"x": t1, "y": t1.limit(0)}}
    assert execute("select db.x.a from db.x where db.x.c > 50", tables=tables).count() == t1.where("c > 50").count()
    assert execute("select u.a from db.x u left join db.y on u.a = y.a", tables=tables).count() == 100
    deep = {"cat": {"db": {"x": t1}}}
    assert execute("select count(*) n from cat.db.x", tables=deep).first()[0] == 100
    with pytest.raises(ExecuteError):
        execute("select 1", tables=tables, schema={"x": {"a": "string"}})
    with pytest.raises(ExecuteError):
        execute("select 1", tables={"x": t1, "db": {"y": t1}})


def test_inputs(spark):
    rows = [{"A": 1, "b": "x"}, {"A": 2, "b": None}]
    assert execute("select a, b from t order by a", tables={"t": rows}, spark=spark).collect()[0][:] == (1, "x")
    assert execute("select a from t", tables={"t": [{"A": None}]}, schema={"t": {"a": "bigint"}}, spark=spark).dtypes == [("a", "bigint")]
    assert execute("select k from t", tables={"t": []}, schema={"t": {"k": "int"}}, spark=spark).count() == 0
    assert execute("select sum(k) s from t", tables={"t": pd.DataFrame({"k": [1, 2]})}, spark=spark).first()[0] == 3
    assert execute("select 1 as one", spark=spark).first()[0] == 1


def test_views_are_scoped(spark, t1):
    t1.limit(1).createOrReplaceTempView("mine")
    df = execute("select * from mine", tables={"mine": t1})
    assert df.count() == 100 and spark.table("mine").count() == 1
    assert not [v for v in spark.catalog.listTables() if v.name.startswith("framesql_")]
    with pytest.raises(ExecuteError) as e:
        execute("select nope from mine", tables={"mine": t1})
    assert e.value.__cause__ is not None
    with pytest.raises(ExecuteError):
        execute("selec 1", tables={"mine": t1})
    with pytest.raises(UnsupportedError):
        execute("select 1", dialect="klingon", spark=spark)
    assert not [v for v in spark.catalog.listTables() if v.name.startswith("framesql_")]
    assert issubclass(ExecuteError, framesql.FrameSqlError)


def test_read_csv(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text("n_key|n_name|n_x\n1|it's|2.5\n2||\n")
    schema = {"n": {"n_key": "bigint", "n_name": "string", "n_x": "double"}}
    df = execute(f"select n_key, n.n_x * 2 as y from read_csv('{path}', 'delimiter', '|') as n where n_name = 'it''s'", schema=schema, dialect="duckdb", spark=spark)
    assert df.dtypes == [("n_key", "bigint"), ("y", "double")] and df.collect()[0][:] == (1, 5.0)
    both = execute(f"select count(*) c from read_csv('{path}', 'delimiter', '|') a join read_csv('{path}', 'delimiter', '|') b on a.n_key = b.n_key", spark=spark)
    assert both.first()[0] == 2


def test_sources(spark, tmp_path, t1):
    from framesql import sources

    for end in ("parquet", "orc", "json", "csv", "tsv"):
        sources.write(t1, f"{tmp_path}/t.{end}")
        assert execute("select sum(c) s from t", tables={"t": f"{tmp_path}/t.{end}"}, schema={"t": {"a": "string", "b": "double", "c": "bigint"}}, spark=spark).first()[0] == t1.agg({"c": "sum"}).first()[0]
    with pytest.raises(UnsupportedError):
        sources.read(spark, "x.unknown")


def test_frame_operators(spark, t1, nulls):
    assert operators.top(t1, 3, "-c", "a").count() == 3
    assert operators.aggregate(nulls, ["g"], n=("count", "*"), v=("sum", "v")).count() == 3
    assert operators.aggregate(nulls, ["g"]).count() == 3
    assert operators.join(nulls, nulls, "k", "semi").count() == 3
    assert operators.combine("union", nulls, nulls).count() == 5
    for wrong in (lambda: operators.join(nulls, nulls, "k", "sideways"), lambda: operators.aggregate(nulls, ["g"], x=("mode7", "v")), lambda: operators.combine("xor", nulls, nulls)):
        with pytest.raises(UnsupportedError):
            wrong()
    assert nulls.select(ratio(nulls.v, nulls.v - nulls.v).alias("r")).where("r is not null").count() == 0
    assert sorted(nulls.agg(sum_text(nulls.g, nulls.v)).first()[0]) == ["x", "x", "y"]
