"""Type names of the supported dialects and their Spark types."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import types as T

from framesql.errors import UnsupportedError

#: Names that Spark's own type parser does not know, or reads otherwise.
NAMES = {
    "int1": "tinyint", "int2": "smallint", "int4": "int", "int8": "bigint", "int64": "bigint", "int32": "int", "int16": "smallint",
    "hugeint": "decimal(38,0)", "integer": "int", "long": "bigint", "float4": "float", "float8": "double", "float32": "float", "float64": "double", "real": "float",
    "text": "string", "varchar": "string", "char": "string", "nvarchar": "string", "str": "string", "object": "string",
    "bool": "boolean", "bytes": "binary", "blob": "binary", "varbinary": "binary", "bytea": "binary",
    "datetime": "timestamp", "timestamptz": "timestamp", "numeric": "decimal", "number": "decimal", "bignumeric": "decimal(38,9)",
}


def spark_name(name: str) -> str:
    """The Spark spelling of a type name, with its parameters if it has some."""
    m = re.fullmatch(r"\s*([A-Za-z_][A-Za-z_0-9 ]*?)\s*(\(.*\)|<.*>)?\s*", name, re.S)
    if not m:
        raise UnsupportedError(f"no type name: {name!r}")
    base, rest = m[1].lower(), m[2] or ""
    if base in ("varchar", "char", "nvarchar", "text", "string") and rest.startswith("("):
        return "string"  # lengths are not checked
    known = NAMES.get(base, base)
    return known if "(" in known else known + rest


def spark_type(name: str | T.DataType) -> T.DataType:
    if isinstance(name, T.DataType):
        return name
    try:
        return T.StructType.fromDDL(f"c {spark_name(name)}")[0].dataType
    except UnsupportedError:
        raise
    except Exception as e:
        raise UnsupportedError(f"unknown type: {name!r}") from e


def struct_type(columns: Mapping[str, str | T.DataType]) -> T.StructType:
    """A table's declared schema, every column nullable."""
    return T.StructType([T.StructField(c, spark_type(t), True) for c, t in columns.items()])
