"""``execute``: SQL over registered frames, rows and files."""

from __future__ import annotations

import logging
import time
from collections.abc import Mapping
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from framesql import catalog, sources
from framesql.dialect import rewrite
from framesql.dialect.rewrite import dialect_of
from framesql.errors import ExecuteError, FrameSqlError

log = logging.getLogger("framesql")


def execute(sql: Any, schema: Mapping | None = None, dialect: str | None = None, tables: Mapping | None = None, *, spark: SparkSession | None = None) -> DataFrame:
    """Runs a query and returns an ordinary, lazy DataFrame.

    ``sql``: text, or a parsed query with a ``sql(dialect=...)`` method. ``schema``: {table: {column: type}}, also one or two levels deeper.
    ``dialect``: one of ``framesql.dialect.DIALECTS``. ``tables``: {name: table}, nested as deep as the schema; a
    table is a DataFrame, a pandas frame, a path, or a list of row mappings. Unquoted output names are folded.

    Registered names exist for this call only. Errors of parsing and analysis are ``ExecuteError`` with their cause;
    errors of the data come from Spark when the result is used.
    """
    began = time.perf_counter()
    d = dialect_of(dialect)
    if not isinstance(sql, str):
        if not hasattr(sql, "sql"):
            raise ExecuteError(f"no query: {type(sql).__name__}")
        sql, d, dialect = sql.sql(dialect="spark"), dialect_of("spark"), "spark"
    spark = catalog.session(tables, spark)
    declared = catalog.schemas(schema)
    if tables and declared and catalog.depth(tables) != len(next(iter(declared))):
        raise ExecuteError("tables and schema are nested to different depths")
    if len({len(p) for p in declared}) > 1:
        raise ExecuteError("schemas lie at different depths")
    if tables:
        catalog.depth(tables)
    frames = {p: catalog.to_frame(v, spark, declared.get(p), d.fold) for p, v in catalog.walk(tables or {})}
    types: dict[str, set[str]] = {}
    for df in frames.values():
        for f in df.schema:
            kind = "text" if isinstance(f.dataType, T.StringType) else "int" if isinstance(f.dataType, T.IntegralType) else "real" if isinstance(f.dataType, T.NumericType) else "other"
            types.setdefault(f.name.lower(), set()).add(kind)

    def kind_of(column: str) -> str | None:
        known = types.get(column.lower(), set())
        return next(iter(known)) if known in ({"int"}, {"real"}) else None

    with catalog.Scope(spark) as scope:
        try:
            said = rewrite(sql, dialect, {p: ".".join(p) for p in frames}, scope.new_view, lambda c: types.get(c.lower()) == {"text"}, kind_of)
            lowered = said.sql.lower()
            for path, df in frames.items():
                if path[-1].lower() in lowered:
                    scope.bind(".".join(path), df)
            for call in said.csv:
                own = next((s for p, s in declared.items() if call.alias and p[-1].lower() == call.alias.lower()), None)
                sources.from_query(spark, call.path, call.options, own).createOrReplaceTempView(call.view)
            whole = scope.wrap(said.sql)
            log.debug("rewritten in %.3f s: %s", time.perf_counter() - began, said.sql)
            out = spark.sql(whole)
        except FrameSqlError:
            raise
        except PySparkException as e:
            raise ExecuteError(f"the query failed: {str(e).splitlines()[0]}") from e
        names = folded(out.columns, said.quoted, {c for df in frames.values() for c in df.columns}, d.fold)
        out = out if names == out.columns else out.toDF(*names)
        # The plan is analysed: it outlives the views.
        if log.isEnabledFor(logging.DEBUG):
            log.debug("analysed in %.3f s: %s", time.perf_counter() - began, out._jdf.queryExecution().optimizedPlan().toString())
            log.debug("planned in %.3f s: %s", time.perf_counter() - began, out._jdf.queryExecution().executedPlan().toString())
        return out


def folded(names: list[str], quoted: set[str], registered: set[str], fold) -> list[str]:
    """Output names: quoted ones and those of registered columns keep their case."""
    return [n if n in quoted or n in registered else fold(n) for n in names]
