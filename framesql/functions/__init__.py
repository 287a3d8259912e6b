"""Column functions that Spark's own library lacks or names otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum_text(value: Column, by: Column | None = None) -> Column:
    """The non-null texts of a group joined, in the order of ``by`` if given; null for none."""
    if by is None:
        return F.listagg(value)
    rows = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(by.alias("by"), value.alias("value")))))
    return F.when(F.count(value) > 0, F.array_join(F.transform(rows, lambda r: r["value"]), ""))


def ratio(a: Column, b: Column) -> Column:
    """True division that gives null for a zero divisor, whatever the session's ANSI mode."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))
