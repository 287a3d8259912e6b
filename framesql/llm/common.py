"""Shared helpers: table reading, written intermediate tables, hashing, text splitting."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts state it; ``bytes.split()`` uses the same set.
SPACE = "\\x20\\x09-\\x0D"

BATCH_ROWS = 1_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


_CACHES: list[dict] = []


def own_cache(cache: dict) -> dict:
    """The cache of the operator that now runs in this Python worker; those of others are emptied, as workers are used again."""
    for other in _CACHES:
        if other is not cache:
            other.clear()
    if not any(other is cache for other in _CACHES):
        _CACHES.append(cache)
    return cache


def find_package(spark: SparkSession) -> None:
    """Lets Python workers on machines that have this folder import the package (elsewhere: ``--py-files``).

    Texts are long rows: where the session has Spark's default of 10,000 rows for a batch to Python, it gets ``BATCH_ROWS``.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    home = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (known, home)))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that the driver and every executor can reach.

    It lies in ``spark.checkpoint.dir``; only where that is unset (tests, local mode) a
    temporary folder of this machine is taken, and set for the session.
    """
    find_package(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="framesql-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/framesql/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` to the shared folder and reads it back."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Deletes all intermediate tables and files; results that still read them can't be used any more."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/framesql")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, _UPPER, _UPPER.lower())


def strip(c: Column) -> Column:
    """Without the white space of ``SPACE`` at both ends, in one pass."""
    return F.btrim(c, F.lit(" \t\n\x0b\x0c\r"))


def row_text(c: str | Column = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def hash128(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes that together serve as a key."""
    return [F.xxhash64(F.lit(17), *cols), F.xxhash64(F.lit(91), *cols)]


def add_unique(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have yet (extra columns may clash with ours)."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name += "_"
    return name
