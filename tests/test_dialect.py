import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import framesql
from framesql.dialect import rewrite, tokenize
from framesql.dialect.tokens import write
from framesql.errors import ExecuteError, UnsupportedError
from framesql.types import spark_name, spark_type, struct_type


def said(sql, dialect=None, tables=None):
    return rewrite(sql, dialect, tables or {}, lambda: "v", lambda c: c == "name").sql


@pytest.mark.parametrize(
    ("dialect", "sql", "want"),
    [
        ("duckdb", "select \"A b\" from t", "select `A b` from t"),
        ("bigquery", "select \"a\" from `t`", "select 'a' from `t`"),
        ("duckdb", "select 'it''s \\n'", "select 'it\\'s \\\\n'"),
        ("duckdb", "select a from t order by a, b desc limit 3", "select a from t order by a NULLS LAST, b desc NULLS LAST limit 3"),
        ("snowflake", "select a from t order by a desc", "select a from t order by a desc NULLS FIRST"),
        ("spark", "select a from t order by a", "select a from t order by a"),
        ("duckdb", "select sum(x) over (partition by a order by b rows unbounded preceding) from t", "select sum(x) over (partition by a order by b NULLS LAST rows unbounded preceding) from t"),
        ("duckdb", "select f(a, (select b from t order by c)) from t order by f(a, b) nulls first", "select f(a, (select b from t order by c NULLS LAST)) from t order by f(a, b) nulls first"),
        ("bigquery", "select cast(a as INT64), safe_cast(b as FLOAT64)", "select cast(a as bigint), try_cast(b as double)"),
        (None, "select a::text, cast(b as varchar(10))", "select a::string, cast(b as string)"),
        (None, "select sum(t.name), sum(x) from t;", "select listagg(t.name,''), sum(x) from t"),
        (None, "select /* x */ 1 -- end", "select   1"),
    ],
)
def test_rewrites(dialect, sql, want):
    assert said(sql, dialect) == want


T = {"t": [{"i": 7, "j": 2, "x": 7.0, "d": datetime.date(2024, 1, 7), "l": [10, 20, 30]}, {"i": 9, "j": None, "x": 1.5, "d": datetime.date(2024, 1, 8), "l": [1]}]}


@pytest.mark.parametrize(
    ("sql", "dialects", "want"),
    [
        ("select i / 2 as v from t where i = 7", "postgres presto trino", 3),
        ("select i / 2 as v from t where i = 7", "duckdb mysql bigquery spark", 3.5),
        ("select (i + 1) * 2 / 3 as v from t where i = 7", "postgres", 5),
        ("select x / 2 as v from t where i = 7", "postgres trino", 3.5),
        ("select count(*) / 4 as v from t", "presto", 0),
        ("select sum(i) / cast(3 as double) as v from t", "postgres", 16 / 3),
        ("select i // 2 as v from t where i = 7", "duckdb", 3),
        ("select l[1] as v from t where i = 7", "duckdb postgres presto trino", 10),
        ("select l[1] as v from t where i = 7", "spark databricks snowflake bigquery", 20),
        ("select l[OFFSET(0)] + l[ORDINAL(2)] as v from t where i = 7", "bigquery", 30),
        ("select l[-1] as v from t where i = 7", "duckdb", 30),
        ("select l[9] as v from t where i = 7", "duckdb postgres", None),
        ("select l[2:3] as v from t where i = 7", "duckdb", [20, 30]),
        ("select [1, i][2] as v from t where i = 7", "duckdb", 7),
        ("select array[1, i][2] as v from t where i = 7", "postgres trino", 7),
        ("select 2 ^ 3 ^ 2 as v", "duckdb postgres", 64.0),
        ("select -2 ^ 2 + 1 - 2 ** (1 + 1) as v", "duckdb", 1.0),
        ("select 6 ^ 3 as v", "mysql bigquery spark", 5),
        ("select log(100) as v", "duckdb postgres", 2.0),
        ("select log(100, 10) as v", "bigquery", 2.0),
        ("select log(10, 100) as v", "postgres trino spark mysql", 2.0),
        ("select true || false as v", "mysql", True),
        ("select 'a' || 'b' as v", "duckdb postgres presto trino snowflake bigquery", "ab"),
        ("select dayofweek(d) as v from t where i = 7", "duckdb snowflake", 0),
        ("select dayofweek(d) as v from t where i = 7", "mysql spark", 1),
        ("select extract(dow from d) as v from t where i = 7", "duckdb postgres", 0),
        ("select day_of_week(d) as v from t where i = 7", "presto trino", 7),
        ("select size(list(j)) as v from t", "duckdb", 2),
        ("select size(array_agg(j)) as v from t", "postgres trino", 2),
        ("select size(array_agg(j)) as v from t", "snowflake spark", 1),
        ("select regexp_matches('abc', 'b') as v", "duckdb", True),
        ("select i as v from t qualify row_number() over (order by x) = 1 order by v", "duckdb snowflake bigquery", 9),
        ("select max(v) as v from (select j, count(*) as v from t group by j qualify row_number() over (order by j) > 1) as q", "duckdb", 1),
        ("select sum(e) as v from t, unnest(l) as u(e)", "duckdb postgres bigquery", 61),
        ("select sum(e) as v from t cross join unnest(l) as u(e)", "presto trino", 61),
        ("select sum(e) as v from unnest([1, 2, 3]) as u(e)", "duckdb", 6),
        ("select max(e) as v from (select unnest(l) as e from t) as q", "duckdb", 30),
        ("select * exclude (j, x, d, l) from t where i = 7", "duckdb snowflake", 7),
        ("select * exclude l from (select i, l from t where i = 7) as q", "duckdb", 7),
    ],
)
def test_meanings(spark, sql, dialects, want):
    for d in dialects.split():
        rows = framesql.execute(sql, dialect=d, tables=T, spark=spark).collect()
        assert len(rows) == 1 and rows[0][0] == pytest.approx(want) if isinstance(want, float) else rows[0][0] == want, (d, sql, rows)


@pytest.mark.parametrize(
    ("sql", "dialects"),
    [
        ("select f(i) / 2 from t", "postgres trino"), ("select 7.5 // 2", "duckdb"), ("select 7 // 2", "postgres mysql"), ("select 2 ^ 3", "presto trino snowflake"), ("select l[i] from t", "duckdb presto"),
        ("select l[0] from t", "duckdb"), ("select list(distinct i) from t", "duckdb"), ("select distinct i from t qualify row_number() over (order by i) = 1", "duckdb"), ("select i from t, unnest(l) with ordinality as u(e, n)", "trino"),
    ],
)
def test_refused(spark, sql, dialects):
    for d in dialects.split():
        with pytest.raises(UnsupportedError):
            framesql.execute(sql, dialect=d, tables=T, spark=spark)


def test_qualified_names():
    tables = {("db", "t"): "db.t"}
    assert said("select db.t.a from db.t", tables=tables) == "select `t`.a from `db.t` AS `t`"
    assert said("select x.a from DB.T as x", tables=tables) == "select x.a from `db.t` as x"


def test_wrong_input(spark):
    with pytest.raises(ExecuteError):
        tokenize("select 'x")
    with pytest.raises(UnsupportedError):
        said("select 1", "klingon")
    with pytest.raises(UnsupportedError):
        spark_type("nonsense")


def test_types(spark):
    assert spark_name("DECIMAL(10,2)") == "decimal(10,2)" and spark_name("FLOAT64") == "double"
    assert struct_type({"a": "int8", "b": "array<int>"}).simpleString() == "struct<a:bigint,b:array<int>>"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=40))
def test_string_literals_survive(text):
    tokens = tokenize("select '" + text.replace("'", "''") + "' as x", "'", '"`', False)
    assert tokens[2].text == text
    again = tokenize(write(tokens), "'\"", "`", True)
    if "\\%" not in text and "\\_" not in text:
        assert again[2].text == text
