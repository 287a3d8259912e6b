"""File sources and sinks, thin over Spark's own; a declared schema spares the inference pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from framesql.errors import ExecuteError, UnsupportedError

FORMATS = {".parquet": "parquet", ".orc": "orc", ".json": "json", ".jsonl": "json", ".csv": "csv", ".tsv": "csv", ".tbl": "csv"}
DELIMITERS = {".tsv": "\t", ".tbl": "|"}


def _suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for end in (".gz", ".bz2", ".zst", ".snappy"):
        name = name.removesuffix(end)
    return "." + name.rpartition(".")[2] if "." in name else ""


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", schema: T.StructType | None = None, header: bool = True) -> DataFrame:
    """A delimited file with a header row. Columns are matched by the header's names; undeclared ones are text."""
    reader = spark.read.option("header", header).option("sep", delimiter)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    if not header:
        return reader.schema(schema).csv(path)
    names = spark.read.option("header", True).option("sep", delimiter).csv(path).columns
    declared = {f.name.lower(): f.dataType for f in schema}
    return reader.schema(T.StructType([T.StructField(c, declared.get(c.lower(), T.StringType()), True) for c in names])).csv(path)


def read(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A table of a file or folder, by its suffix; without a suffix it is Parquet."""
    suffix = _suffix(path)
    kind = FORMATS.get(suffix, "parquet" if not suffix else None)
    if kind is None:
        raise UnsupportedError(f"no source for {path!r}")
    if kind == "csv":
        return read_csv(spark, path, DELIMITERS.get(suffix, ","), schema)
    return (spark.read if schema is None else spark.read.schema(schema)).format(kind).load(path)


def write(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = (), **options: str) -> None:
    """The sink of the same formats; nothing is gathered on the driver."""
    suffix = _suffix(path)
    kind = FORMATS.get(suffix, "parquet" if not suffix else None)
    if kind is None:
        raise UnsupportedError(f"no sink for {path!r}")
    if kind == "csv":
        options = {"header": "true", "sep": DELIMITERS.get(suffix, ",")} | options
    df.write.mode(mode).partitionBy(*partition_by).options(**options).format(kind).save(path)


def from_query(spark: SparkSession, path: str, options: dict[str, str], schema: T.StructType | None) -> DataFrame:
    """The frame behind a READ_CSV call of a query."""
    unknown = set(options) - {"delimiter", "delim", "sep", "header"}
    if unknown:
        raise ExecuteError(f"READ_CSV does not know the option {sorted(unknown)[0]!r}")
    delimiter = options.get("delimiter", options.get("delim", options.get("sep", ",")))
    return read_csv(spark, path, delimiter, schema, options.get("header", "true").lower() in ("true", "1"))
