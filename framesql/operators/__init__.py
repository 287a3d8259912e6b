"""The relational operators as DataFrame functions, for those who compose plans without SQL.

Each only declares a logical plan; join strategies, partial aggregation and skew are Catalyst's and adaptive execution's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesql.errors import UnsupportedError

JOINS = {"inner", "left", "right", "full", "semi", "anti", "cross"}
AGGREGATES = {
    "count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev_samp, "variance": F.var_samp,
    "stddev_pop": F.stddev_pop, "var_pop": F.var_pop, "count_distinct": F.count_distinct, "approx_count_distinct": F.approx_count_distinct, "median": F.median, "any_value": F.any_value,
}


def project(df: DataFrame, **columns: Column | str) -> DataFrame:
    return df.select(*[(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def where(df: DataFrame, *conditions: Column | str) -> DataFrame:
    for c in conditions:
        df = df.where(c)
    return df


def join(left: DataFrame, right: DataFrame, on: Column | str | Sequence[str] | None = None, how: str = "inner") -> DataFrame:
    """Any join; a kind that is not known is an error, and a residual belongs to the condition."""
    if how not in JOINS:
        raise UnsupportedError(f"unknown join {how!r}")
    if on is None or how == "cross":
        if how not in ("cross", "inner") or (how == "cross" and on is not None):
            raise UnsupportedError(f"a {how} join without or against a condition")
        return left.crossJoin(right)
    return left.join(right, on, {"semi": "left_semi", "anti": "left_anti"}.get(how, how))


def aggregate(df: DataFrame, by: Sequence[str | Column] = (), having: Column | str | None = None, **aggregates: tuple[str, Column | str]) -> DataFrame:
    """``aggregate(df, ["g"], total=("sum", "x"))``; without aggregates the distinct keys."""
    if not aggregates:
        out = df.select(*by).distinct()
    else:
        for kind, _ in aggregates.values():
            if kind not in AGGREGATES:
                raise UnsupportedError(f"unknown aggregate {kind!r}")
        made = [AGGREGATES[k](F.lit(1) if isinstance(x, str) and x == "*" else F.expr(x) if isinstance(x, str) else x).alias(n) for n, (k, x) in aggregates.items()]
        out = df.groupBy(*by).agg(*made)
    return out if having is None else out.where(having)


def ordered(*keys: str, nulls: str = "last") -> list[Column]:
    """Sort keys such as "a" and "-b", with nulls first or last for all of them."""
    out = []
    for k in keys:
        c = F.col(k.removeprefix("-"))
        out.append(getattr(c, f"{'desc' if k.startswith('-') else 'asc'}_nulls_{nulls}")())
    return out


def top(df: DataFrame, n: int, *keys: str, nulls: str = "last", offset: int = 0) -> DataFrame:
    """The first rows in an order: a bounded heap per task, not a full sort."""
    out = df.orderBy(*ordered(*keys, nulls=nulls))
    return (out.offset(offset) if offset else out).limit(n)


def combine(kind: str, left: DataFrame, right: DataFrame, every: bool = False, by_name: bool = False) -> DataFrame:
    """UNION, INTERSECT and EXCEPT, by position or name; ``every`` keeps duplicates (ALL)."""
    if by_name:
        right = right.select(*left.columns)
    if kind == "union":
        out = left.unionAll(right)
        return out if every else out.distinct()
    if kind == "intersect":
        return left.intersectAll(right) if every else left.intersect(right)
    if kind == "except":
        return left.exceptAll(right) if every else left.subtract(right)
    raise UnsupportedError(f"unknown set operation {kind!r}")


