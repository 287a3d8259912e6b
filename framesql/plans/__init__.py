"""The query suite: each text runs here through ``execute`` and in an oracle as it stands."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framesql.api import execute
from framesql.plans import corpus, relational

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Query texts in the dialect of the oracle.
SQL: dict[str, str] = relational.SQL | corpus.SQL


def tables_of(spark: SparkSession, sf_dir: str, sql: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", sql)}


def _query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return execute(sql, dialect="duckdb", tables=tables_of(spark, sf_dir, sql), spark=spark)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(sql) for name, sql in SQL.items()} | relational.FRAME_QUERIES
ORACLE_SQL: dict[str, str] = SQL | relational.FRAME_SQL
