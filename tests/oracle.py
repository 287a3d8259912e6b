"""Compares a Spark result with DuckDB's by types and rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*.parquet')" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(table):
    plain = lambda x: round(x, 4) + 0.0 if isinstance(x, float) else x
    return sorted(str(tuple(map(plain, r))) for r in zip(*[table[c].to_pylist() for c in sorted(table.column_names)], strict=True))


def assert_same(df, con, sql):
    mine, theirs = df.toArrow(), con.execute(sql).to_arrow_table()
    assert sorted(mine.column_names) == sorted(theirs.column_names)
    assert {f.name: str(f.type) for f in mine.schema} == {f.name: str(f.type) for f in theirs.schema}
    assert rows(mine) == rows(theirs)
