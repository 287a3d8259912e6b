"""Registration of tables: input coercion, nested names, and views that live for one analysis."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from framesql import sources
from framesql.errors import ExecuteError
from framesql.types import struct_type

Path = tuple[str, ...]


def session(tables: Any, spark: SparkSession | None = None) -> SparkSession:
    """The given session, that of the first DataFrame, the active one, or a new one."""
    if spark is not None:
        return spark
    for _, t in walk(tables or {}):
        if isinstance(t, DataFrame):
            return t.sparkSession
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def walk(nested: Mapping, at: Path = ()) -> Iterable[tuple[Path, Any]]:
    """Leaves of a nested mapping with their paths; a table is a leaf."""
    for name, value in nested.items():
        if isinstance(value, Mapping):
            yield from walk(value, (*at, str(name)))
        else:
            yield (*at, str(name)), value


def depth(nested: Mapping, leaf: Callable[[Any], bool] = lambda v: not isinstance(v, Mapping)) -> int:
    """Levels of names above the leaves; all leaves must lie equally deep."""
    found = {1 if leaf(v) else 1 + depth(v, leaf) for v in nested.values()}
    if len(found) > 1:
        raise ExecuteError("tables lie at different depths")
    return found.pop() if found else 0


def is_columns(value: Any) -> bool:
    """Whether a value is the column mapping of one table."""
    return isinstance(value, T.StructType) or (isinstance(value, Mapping) and all(isinstance(v, (str, T.DataType)) for v in value.values()))


def schemas(schema: Mapping | None) -> dict[Path, T.StructType]:
    """Declared schemas by the path of their table."""
    out: dict[Path, T.StructType] = {}

    def go(nested: Mapping, at: Path) -> None:
        for name, value in nested.items():
            if is_columns(value):
                out[(*at, str(name))] = value if isinstance(value, T.StructType) else struct_type(value)
            elif isinstance(value, Mapping):
                go(value, (*at, str(name)))
            else:
                raise ExecuteError(f"no schema: {name!r}")

    go(schema or {}, ())
    return out


def to_frame(value: Any, spark: SparkSession, declared: T.StructType | None, fold: Callable[[str], str]) -> DataFrame:
    """A DataFrame of whatever was registered: a DataFrame, pandas or Arrow table, path, or list of row mappings."""
    if isinstance(value, DataFrame):
        return value
    if isinstance(value, str):
        return sources.read(spark, value, declared)
    if type(value).__module__.split(".")[0] in ("pandas", "pyarrow"):
        return spark.createDataFrame(value, declared) if declared is not None else spark.createDataFrame(value)
    if isinstance(value, (list, tuple)):
        if not value:
            return spark.createDataFrame([], declared or T.StructType([]))
        names = [str(c) for c in value[0]]
        folded = [fold(c) for c in names]
        if declared is not None:
            types = {fold(f.name): f.dataType for f in declared}
            known = T.StructType([T.StructField(f, types.get(f, T.StringType()), True) for f in folded])
            return spark.createDataFrame([tuple(r.get(c) for c in names) for r in value], known)
        return spark.createDataFrame([tuple(r.get(c) for c in names) for r in value], folded)
    raise ExecuteError(f"no table can be made of {type(value).__name__}")


class Scope:
    """Binds tables to unique views for one analysis; the caller's own views stay untouched."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.views = spark, []
        self.bound: dict[str, tuple[str, DataFrame]] = {}

    def __enter__(self) -> Scope:
        return self

    def __exit__(self, *_: object) -> None:
        for v in self.views:
            self.spark.catalog.dropTempView(v)

    def new_view(self) -> str:
        self.views.append(f"framesql_{uuid.uuid4().hex}")
        return self.views[-1]

    def bind(self, name: str, df: DataFrame) -> None:
        view = self.new_view()
        df.createOrReplaceTempView(view)
        self.bound[name] = (view, df)

    def wrap(self, sql: str) -> str:
        """The query with its tables as common table expressions over the views."""
        if not self.bound:
            return sql
        named = ", ".join(f"`{n.replace('`', '``')}` AS (SELECT * FROM `{v}`)" for n, (v, _) in self.bound.items())
        return f"WITH {named} ({sql}\n)"
