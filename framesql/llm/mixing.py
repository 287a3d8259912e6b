"""Mixing sources to target weights by a time-varying curriculum (operator 3).

Every source has a weight that ramps linearly over the run, w(t) = weight * (1 + slope * (2t - 1))
for t from 0 to 1. Its integral over the run is its weight, so the integrals share the budget
(``share`` times all sizes); a target stops at ``cap`` times its source's size and the excess is
shared again by weight until none is above. Within a source, documents stand in the order of a
hash of their identifier; the running sum of their sizes is the demand at which they are due,
and inverting the source's cumulative demand gives each copy its training position in [0, 1).

A running sum over a hot source would be one task: documents are first dealt to hash buckets
of a source, buckets are summed, and only sums meet in one task; each bucket then runs alone.

A row of a mix is known by its place in the file that it was read from, or, if it comes from elsewhere, by a number that is written with it
first, so that rows which are equal in all columns keep their own positions.

Defined cases: a null text has size 0 and a text of any length is counted whole; a null source is a source, and the last; documents
repeated under one identifier are each a document of the source that they stand in, ordered by size; a source without words gets
target 0 and no copies; an empty table gives no row; extra columns, also under names that are used inside, are kept by ``mix``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framesql.llm import common

#: Documents of a hash bucket, and most buckets of a source.
BUCKET_DOCS, MOST_BUCKETS = 256, 65_536


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{common.SPACE}]+")).cast("long")


def _cyclic(values: tuple[float, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (at % len(values)).cast("int") + 1)


def targets(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """One row per source: source, rank, n_docs, source_size, target. Only sums meet in one task."""
    own = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    rank = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("rank")
    own = own.select("*", rank).withColumn("weight", _cyclic(weights, F.col("rank"))).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    # In the order of most / weight the sources fill up one by one; the level is that of the first that stays below its cap.
    order = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    everything = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    own = own.withColumn("level", level).withColumn("open", F.col("most") > F.col("level") * F.col("weight"))
    final = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.struct(F.col("most") / F.col("weight"), F.col("rank")))).over(everything)
    target = F.least(F.col("most"), F.coalesce(final * F.col("weight"), F.col("most")))
    return own.select("source", "rank", "n_docs", "source_size", target.alias("target"))


def position(share_done: Column, slope: Column) -> Column:
    """Inverts t + slope * (t * t - t), the share of its target that a source has given by t."""
    rest = 1 - slope
    return 2 * share_done / (rest + F.sqrt(rest * rest + 4 * slope * share_done))


def plan(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), slopes: tuple[float, ...] = (-0.5, 0.0, 0.5), share: float = 1.5, cap: float = 2.0, row: str | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, positions, and the column ``row`` as ``row``."""
    number = [F.col(row).alias("row")] if row else []
    sized = common.written(docs.select("doc_id", "source", *number, word_count(common.row_text()).alias("size")), "sizes")
    per_source = common.written(targets(sized, weights, share, cap), "targets").withColumnRenamed("source", "source_")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    buckets = F.least(F.lit(MOST_BUCKETS), F.ceil(F.col("n_docs") / BUCKET_DOCS))
    bucket = F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * buckets / F.lit(2.0**32)).cast("int")
    rows = sized.join(per_source, sized["source"].eqNullSafe(per_source["source_"])).drop("source_").withColumn("order", order).withColumn("bucket", bucket)
    sums = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    starts = sums.select("rank", "bucket", (F.sum("words").over(Window.partitionBy("rank").orderBy("bucket")) - F.col("words")).alias("start"))
    inside = Window.partitionBy("rank", "bucket").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("inside", F.sum("size").over(inside) - F.col("size")).join(starts, ["rank", "bucket"])
    middle = F.col("start") + F.col("inside") + F.col("size") / 2
    due = F.filter(F.transform(F.sequence(F.lit(0), F.lit(int(-(-cap // 1)) - 1)), lambda r: r * F.col("source_size") + middle), lambda y: y < F.col("target"))
    slope = _cyclic(slopes, F.col("rank"))
    rows = rows.withColumn("positions", F.transform(due, lambda y: position(y / F.col("target"), slope)))
    return rows.withColumn("copies", F.size("positions").cast("long")).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "positions", *(["row"] if row else []))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix, each copy a row with its own columns, in the order of training."""
    row, at, due = (common.add_unique(docs, c) for c in ("mix_row", "mix_at", "mix_due"))
    try:
        rows = docs.withColumn(row, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))
    except AnalysisException:
        # The number is made once: the written table is its source.
        rows = common.written(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    planned = plan(rows, row=row, **options).where("copies > 0").select(F.col("row").alias(due), F.explode("positions").alias(at))
    joined = rows.join(planned, F.col(row) == F.col(due))
    return joined.repartitionByRange(at).sortWithinPartitions(at).drop(row, at, due)


def training_order(mixed: DataFrame, name: str) -> DataFrame:
    """A mix read back from Parquet, with the place of each row in it (from 0) as a column ``name``: files in their order, rows in the order of their file."""
    file, row, before = (common.add_unique(mixed, c) for c in ("mix_file", "mix_row", "mix_before"))
    own = mixed.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(row))
    # One row per file: the running total over files is the only work in a single task.
    counts = common.written(own.groupBy(file).agg(F.count(F.lit(1)).alias("n")), "mix-files")
    starts = counts.select(F.col(file).alias(before + "_of"), (F.sum("n").over(Window.orderBy(file)) - F.col("n")).alias(before))
    return own.join(starts, F.col(file) == F.col(before + "_of")).withColumn(name, F.col(before) + F.col(row)).drop(file, row, before, before + "_of")


def op3_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan(common.read(spark, sf_dir, "documents"))
    first = F.round(F.element_at(F.col("positions"), F.when(F.col("copies") > 0, F.lit(1))), 6)
    return planned.select("doc_id", "size", "source_size", "target", "taken", first.alias("position")).orderBy(F.col("position").asc_nulls_last(), "doc_id")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
             CASE rank % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS slope,
             2.0::DOUBLE * source_size AS most FROM s),
o AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
                 - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
f AS (SELECT arg_min(level, most / weight) FILTER (WHERE most > level * weight) AS final FROM o),
t AS (SELECT w.*, least(most, coalesce(final * weight, most)) AS target FROM w, f),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.slope,
             sum(d.size) OVER (PARTITION BY t.rank ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null')), d.size
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size + d.size / 2.0::DOUBLE AS middle
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * ((middle < target)::BIGINT + (middle + source_size < target)::BIGINT) AS BIGINT) AS taken,
       CASE WHEN middle < target THEN round(2 * (middle / target) / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * (middle / target))), 6) END AS position
FROM c
"""
