"""Quality classifier by importance resampling (operator 5).

Two hashed n-gram models are counted: the target model over a bounded sample of labelled good
documents, the raw model over every document. A document's log weight is the sum of
log(target / raw) over its n-grams, counts being smoothed towards a ratio of 1 by ``PRIOR``. It is divided by a ``temperature``, Gumbel noise, fixed
by the document's identifier and text, is added, and the k documents of the largest sums are kept (a sample without replacement in proportion to the
weights to the power of 1 / temperature). So a document near the cut stays or goes by chance, one far from it by its weight.

n-grams: words and pairs of words (lower case, marks apart from letters) in ``BUCKETS`` hashed buckets, and triples of
word shapes, which tell shouting, tables, symbol noise and repetition, in buckets of their own.

k comes from the labels: the sample's documents give the cut of the log weight that agrees best with them, and k
is ``share`` of the number of all documents above it. The k-th sum is found by counting in ever finer intervals, so
no more than some thousand numbers reach the driver at any size.

Defined cases: a null or empty text has log weight 0, which speaks neither for nor against it, and noise; documents that tie with the k-th all stay;
repeated rows share their fate; texts of any length are taken whole; without labels everything is kept; labels that are null, or
without a document, are ignored; identifiers have to be integers (others raise); an empty table gives no row; extra columns, also under names that are
used inside, are kept by ``resample``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesql.llm import common

BUCKETS = 1 << 16
SHAPES = 9
SIZE = BUCKETS + SHAPES**3
#: Most labelled rows that the target model and the cut are fitted on.
LABELLED_ROWS = 20_000
#: Added to the seen and to the expected count of a bucket: a bucket of a few hundred n-grams or less says next to nothing.
PRIOR = 200.0
TEMPERATURE = 4.0
CACHE_TOKENS = 250_000

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_CACHE: dict[str, int] = {}


def _shape(t: str) -> int:
    """1 lower, 2 capitalised, 3 upper, 4 with digits, 5 end of a clause, 6 bar, 7 other marks; 0 the edge, 8 the same token again."""
    if t[0].isalnum() or t[0] == "_":
        if any(map(str.isdigit, t)):
            return 4
        return 1 if t.islower() else 3 if len(t) > 1 and t.isupper() else 2
    return 5 if t in (".", ",") else 6 if t == "|" else 7


def _known(t: str) -> int:
    """A 60-bit hash of the token in lower case, and its shape in the last four bits."""
    got = xxhash.xxh3_64_intdigest(t.lower().encode()) & ~15 | _shape(t)
    if len(_CACHE) < CACHE_TOKENS and len(t) < 40:
        _CACHE[t] = got
    return got


def features(text: str) -> np.ndarray:
    """The buckets of a text's n-grams, with repeats."""
    tokens = _TOKEN.findall(text)
    if not tokens:
        return np.empty(0, "i4")
    cache = common.own_cache(_CACHE)
    try:
        known = np.array([cache[t] for t in tokens], dtype="u8")
    except KeyError:
        known = np.array([cache[t] if t in cache else _known(t) for t in tokens], dtype="u8")
    n = len(known)
    h = known >> np.uint64(4)
    shape = np.zeros(n + 2, "i4")
    shape[1:-1] = known & np.uint64(15)
    shape[2:-1][h[1:] == h[:-1]] = 8
    out = np.empty(3 * n - 1, "i4")
    out[:n] = h & np.uint64(BUCKETS - 1)
    with np.errstate(over="ignore"):
        out[n : 2 * n - 1] = ((h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(48)
    out[2 * n - 1 :] = BUCKETS + (shape[:-2] * SHAPES + shape[1:-1]) * SHAPES + shape[2:]
    return out


def _ids(batch: pa.RecordBatch, at: int) -> list:
    return batch.column(at).to_pylist()


def _count(good: frozenset[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(SIZE, "i8"), np.zeros(SIZE, "i8")
        held: list[np.ndarray] = []
        most = 0

        def add() -> None:
            raw[:] += np.bincount(np.concatenate(held), minlength=SIZE)

        for batch in batches:
            for doc_id, text in zip(_ids(batch, 0), batch.column(1), strict=True):
                f = features(text.as_py() or "")
                held.append(f)
                most += len(f)
                if doc_id in good:
                    target += np.bincount(f, minlength=SIZE)
                if most > 500_000:
                    add()
                    held, most = [], 0
        if held:
            add()
        at = np.nonzero(raw)[0]
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    return run


def labelled(labels: DataFrame, rows: int = LABELLED_ROWS) -> dict[int, bool]:
    """A bounded sample of the labels: whether the document is good (of quality, and not toxic)."""
    good = (F.col("quality") == 1) & ~F.coalesce(F.col("toxic") == 1, F.lit(False))
    # Toxic documents of quality say nothing against its style: they are left out.
    sample = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND NOT (quality = 1 AND coalesce(toxic, 0) = 1)")
    # A threshold on the hash, not a sort: tasks send only what is taken.
    share = min(1.0, 0.95 * rows / max(1, sample.count()))
    taken = sample.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    picked = taken.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(good).alias("good")).limit(rows).collect()
    return {r["doc_id"]: r["good"] for r in picked}


def fit(docs: DataFrame, labels: dict[int, bool]) -> np.ndarray | None:
    """log(target / raw) for each bucket; None where nothing good is labelled."""
    good = frozenset(i for i, g in labels.items() if g)
    if not good:
        return None
    counted = docs.select("doc_id", "text").mapInArrow(_count(good), "bucket long, raw long, target long")
    rows = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # SIZE rows at most
    raw, target = np.zeros(SIZE), np.zeros(SIZE)
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return None
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + PRIOR) / (expected + PRIOR))


def _uniform(doc_id: int | None, text: str | None) -> float:
    h = xxhash.xxh3_64_intdigest(f"{doc_id}\0".encode() + (text or "").encode())
    return ((h >> 12) + 0.5) / 2**52


def _weigh(model: np.ndarray, ids: list, texts: pa.Array, temperature: float) -> tuple[np.ndarray, np.ndarray]:
    """Log weights, and the sums with the noise."""
    weights, noise = np.zeros(len(ids)), np.zeros(len(ids))
    for i, (doc_id, t) in enumerate(zip(ids, texts, strict=True)):
        text = t.as_py()
        if text:
            weights[i] = model[features(text)].sum()
        noise[i] = _uniform(doc_id, text)
    return weights, weights / temperature - np.log(-np.log(noise))


def score(docs: DataFrame, model: np.ndarray, temperature: float = TEMPERATURE) -> DataFrame:
    """Rows of doc_id and text with log_weight and perturbed, the sum with the noise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, p = _weigh(model, _ids(batch, 0), batch.column(1), temperature)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w), pa.array(p)], ["doc_id", "log_weight", "perturbed"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, log_weight double, perturbed double")


def cut(scored: DataFrame, labels: dict[int, bool]) -> float:
    """The log weight above which the labelled sample agrees best with its labels."""
    own = scored.where(F.col("doc_id").isin(list(labels))) if len(labels) < 200 else scored.join(F.broadcast(scored.sparkSession.createDataFrame([(i,) for i in labels], "doc_id long")), "doc_id", "left_semi")
    rows = own.groupBy("doc_id").agg(F.max("log_weight").alias("w")).collect()
    if not rows:
        return -np.inf
    w = np.array([r["w"] for r in rows])
    good = np.array([labels[r["doc_id"]] for r in rows])
    order = np.argsort(w)
    w, good = w[order], good[order]
    # Rejecting the first i: bad ones below are right, good ones below are wrong (and weigh more).
    gain = np.concatenate(([0.0], np.cumsum(np.where(good, -4.0, 1.0))))
    i = int(np.argmax(gain))
    if i == 0:
        return -np.inf
    middle = w[i - 1] if i == len(w) else (w[i - 1] + w[i]) / 2
    # Below 0 where the bad ones allow it: a weight of 0 says nothing against a document.
    return float(min(middle, w[i - 1] / 2) if w[i - 1] < 0 else middle)


def kth_largest(values: DataFrame, column: str, k: int) -> float:
    """The exact k-th largest number, by counts in 1,024 parts of an ever smaller interval."""
    if k <= 0:
        return np.inf
    low, high = values.agg(F.min(column), F.max(column)).first()
    if low is None:
        return -np.inf
    above = 0
    while low < high:
        step = (high - low) / 1024
        if step == 0 or low + step == low:
            break
        part = F.least(F.lit(1023), F.floor((F.col(column) - F.lit(low)) / F.lit(step))).cast("int")
        inside = values.where(F.col(column).between(F.lit(low), F.lit(high)))
        seen = above
        for r in sorted(inside.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect(), key=lambda r: -r["part"]):
            if seen + r["n"] >= k:
                break
            seen += r["n"]
        above, low, high = seen, r["low"], r["high"]
    return low


def decide(docs: DataFrame, labels: DataFrame, share: float = 1.0, temperature: float = TEMPERATURE) -> tuple[DataFrame, np.ndarray, float] | None:
    """doc_id, log_weight and perturbed of every row (a written table), the model, and the k-th largest sum; None keeps everything."""
    common.find_package(docs.sparkSession)
    sample = labelled(labels)
    model = fit(docs, sample)
    if model is None:
        return None
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = common.written(score(own, model, temperature), "scores")
    k = int(share * scored.where(F.col("log_weight") >= F.lit(cut(scored, sample))).count())
    return scored, model, kth_largest(scored, "perturbed", k)


def resample(docs: DataFrame, labels: DataFrame, share: float = 1.0, temperature: float = TEMPERATURE) -> DataFrame:
    """The rows that are kept, with their own columns. They are weighed again: that takes less disk than texts written with their scores, and no shuffle."""
    decided = decide(docs, labels, share, temperature)
    if decided is None:
        return docs
    _, model, least = decided
    at, of = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_weigh(model, _ids(batch, at), batch.column(of), temperature)[1] >= least))

    return docs.mapInArrow(run, docs.schema)


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept documents: doc_id, log_weight, perturbed."""
    docs = common.read(spark, sf_dir, "documents")
    decided = decide(docs, common.read(spark, sf_dir, "labels"))
    if decided is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("log_weight"), F.lit(0.0).alias("perturbed"))
    scored, _, least = decided
    return scored.where(F.col("perturbed") >= F.lit(least))
