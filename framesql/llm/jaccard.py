"""N-gram Jaccard join with adaptive multi-match prefixes (operator 8).

Sets of word shingles are linked where intersection / union >= ``share`` / 100, and documents get the
smallest doc_id that links reach. Tokens are 64-bit shingle hashes, n is the size of a set and p = floor((1 - share) n) + 1.

1. Documents of equal sets are one (a 128-bit key of the set); only representatives go on.
2. The order of tokens: cold ones of the near zone (the lower part of the hash space, 1 - share and ``ROOM`` of it) by
   document frequency; cold ones of the far zone (the rest); hot ones, which more than ``COLD`` representatives have, by frequency. Frequencies in the far
   zone are counted only over documents that need it, those with less than p cold tokens in the near zone.
3. Linked documents share at least m tokens of the first p + m - 1 of both, for every m. Each document takes the m up to ``MOST_MATCHES``
   of the least estimated cost: its postings in that prefix, each counted ``MEET``, and a comparison of two sets for each candidate, of which
   there are at most the postings divided by m. A longer prefix costs postings and has to be met more often.
4. A pair of documents counts its shared tokens in the prefixes of the smaller m of the two; pairs with m of them are
   candidates. Each is compared on whole sets, in groups that are bounded in tokens and get every set once or few times.
5. Only documents with less than p cold tokens anywhere, that is nearly all hot, take hot tokens into their prefix, the rarest first. All
   documents of such a token are compared with one of them, which gathers groups of near copies to classes. What is in one class needs
   no further look; where a token still has several classes, its documents are compared class against class, in tiles bounded
   in rows and tokens that return a spanning forest of the links.

Defined cases: null or empty texts have no shingle and are linked with nothing; a text of fewer words
than a shingle is one shingle of all its words; texts of any length are taken whole; a null doc_id stays alone, with a null component; repeated
rows link as equal sets, and different texts under one doc_id each have their own class; extra columns, also under names that are
used inside, are ignored; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framesql.llm import common, graph

#: The near zone is 1 - share of the hash space and this much more, so that few documents need the far one.
ROOM = 0.07
#: Most representatives of a cold token.
COLD = 16
#: Most shared prefix tokens that a document may demand.
MOST_MATCHES = 8
#: Cost of a pair of postings, in tokens read to compare two sets.
MEET = 20.0
#: Tokens and rows of a tile.
TILE_TOKENS, TILE_ROWS = 1_000_000, 1024
#: Tokens that a task holds to count hot ones before the shuffle.
HELD_TOKENS = 500_000
BROADCAST_ROWS = 1_000_000
CACHE_WORDS = 250_000

_CACHE: dict[bytes, int] = {}


def _word(w: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(w)
    if len(_CACHE) < CACHE_WORDS and len(w) < 40:
        _CACHE[w] = h
    return h


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, "u8")
    cache = common.own_cache(_CACHE)
    try:
        h = np.array([cache[w] for w in words], dtype="u8")
    except KeyError:
        h = np.array([cache[w] if w in cache else _word(w) for w in words], dtype="u8")
    k = min(width, len(h))
    n = len(h) - k + 1
    with np.errstate(over="ignore"):
        out = np.full(n, 0x9E3779B97F4A7C15 + k, dtype="u8")
        for i in range(k):
            out = (out ^ h[i : i + n]) * np.uint64(0xC2B2AE3D27D4EB4F)
            out ^= out >> np.uint64(29)
        out *= np.uint64(0x165667B19E3779F9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def prefix(n: int, share: int) -> int:
    """Tokens of the shortest prefix of a set of n."""
    return n + share * n // -100 + 1


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype("i4")
    values = np.concatenate(arrays) if arrays else np.empty(0, "u8")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view("i8")))


def zone_end(share: int) -> int:
    """The hash below which tokens are in the near zone."""
    return min(2**64 - 1, int((1 - share / 100 + ROOM) * 2**64))


def _sketch(width: int, share: int):
    limit = np.uint64(zone_end(share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                n, k1, k2, near = [], [], [], []
                for text in some.column(3):
                    s = shingles(text.as_py(), width)
                    key = xxhash.xxh3_128_digest(s.tobytes())
                    n.append(len(s))
                    k1.append(int.from_bytes(key[:8], "little", signed=True))
                    k2.append(int.from_bytes(key[8:], "little", signed=True))
                    near.append(s[: int(np.searchsorted(s, limit))])
                yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(n, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), _lists(near)], ["doc_id", "ha", "hb", "n", "k1", "k2", "near"])

    return run


def _postings(after: int | None, cold: int):
    """Rows token, rid, w of the lists of a partition (of tokens from ``after`` on); of a token with more than ``cold`` rows, ``cold`` + 1 with the count in w."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, rids, held = [], [], 0

        def out() -> pa.RecordBatch:
            tokens, rid = np.concatenate(lists), np.repeat(np.array(rids, "i8"), [len(x) for x in lists])
            order = np.argsort(tokens, kind="stable")
            tokens, rid = tokens[order], rid[order]
            first = np.nonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))[0]
            sizes = np.diff(np.append(first, len(tokens)))
            place = np.arange(len(tokens)) - np.repeat(first, sizes)
            w = np.where(place == cold, np.repeat(sizes, sizes) - cold, 1)
            keep = place <= cold
            return pa.RecordBatch.from_arrays([pa.array(tokens[keep]), pa.array(rid[keep]), pa.array(w[keep])], ["token", "rid", "w"])

        for batch in batches:
            for rid, tokens in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = tokens.values.to_numpy()
                if after is not None:
                    tokens = tokens[np.searchsorted(tokens.view("u8"), np.uint64(after)) :]
                if len(tokens):
                    lists.append(tokens)
                    rids.append(rid)
                    held += len(tokens)
                if held > HELD_TOKENS:
                    yield out()
                    lists, rids, held = [], [], 0
        if lists:
            yield out()

    return run


def _frequencies(cold: int):
    """Of sorted postings: (rid, token, df) of shared cold tokens, (null, token, df) of hot ones."""
    names = ["rid", "token", "df"]


    def emit(tokens, rids, w) -> Iterator[pa.RecordBatch]:
        first = np.nonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))[0]
        df = np.add.reduceat(w, first)
        each = np.repeat(df, np.diff(np.append(first, len(tokens))))
        shared = (each > 1) & (each <= cold)
        if shared.any():
            yield pa.RecordBatch.from_arrays([pa.array(rids[shared]), pa.array(tokens[shared]), pa.array(each[shared])], names)
        hot = df > cold
        if hot.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(int(hot.sum()), pa.int64()), pa.array(tokens[first][hot]), pa.array(df[hot])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, "i8")] * 3
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [np.concatenate((r, batch.column(i).to_numpy())) for i, r in enumerate(rest)]
            # The last run may go on in the next batch; of a hot one, ``cold`` rows and the count of the others are enough.
            cut = int(np.searchsorted(now[0], now[0][-1], side="left"))
            rest = [x[cut : cut + cold + 1] for x in now]
            if len(now[0]) - cut > cold + 1:
                rest[2] = np.append(rest[2][:cold], now[2][cut + cold :].sum())
            if cut:
                yield from emit(*[x[:cut] for x in now])
        if len(rest[0]):
            yield from emit(*rest)

    return run


def matches_to_demand(meets: np.ndarray, p: int, n: int) -> int:
    """The m of the least estimated cost, by the partners (df - 1) of a document's cold tokens in their order."""
    most = min(MOST_MATCHES, len(meets) - p + 1)
    if most <= 1:
        return 1
    postings = np.cumsum(meets)[p - 1 : p - 1 + most].astype("f8")
    m = np.arange(1, most + 1)
    return int(np.argmin(postings * MEET + postings / m * 2 * n)) + 1


def _prefixes(share: int):
    """Of profiles (rid, n, single tokens and shared cold ones of both zones): the prefix tokens with the m from which they count."""
    names = ["token", "rid", "n", "level", "m"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, rids, ns, levels, ms, sizes = [], [], [], [], [], []
            columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 4)]
            for rid, n, near1, far1, near, far in zip(*columns, batch.column(3), batch.column(5), strict=True):
                zones = []
                for c in (near, far):
                    # Structs of df and token, in this order already.
                    v = c.values
                    zones.append((v.field(0).to_numpy() - 1, v.field(1).to_numpy()) if v is not None and len(v) else (np.empty(0, "i8"), np.empty(0, "i8")))
                if not len(zones[0][0]) and not len(zones[1][0]):
                    continue
                p = prefix(n, share)
                meets = np.concatenate((np.zeros(near1, "i8"), zones[0][0], np.zeros(far1, "i8"), zones[1][0]))
                m = matches_to_demand(meets, p, n)
                at = np.concatenate((near1 + np.arange(len(zones[0][0])), near1 + len(zones[0][0]) + far1 + np.arange(len(zones[1][0]))))
                own = np.concatenate((zones[0][1], zones[1][1]))
                keep = at < p + m - 1
                k = int(keep.sum())
                if k:
                    tokens.append(own[keep])
                    levels.append(np.maximum(1, at[keep] - p + 2))
                    rids.append(rid)
                    ns.append(n)
                    ms.append(m)
                    sizes.append(k)
            if tokens:
                spread = lambda x, t: pa.array(np.repeat(np.array(x, t), sizes))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), spread(rids, "i8"), spread(ns, "i4"), pa.array(np.concatenate(levels).astype("i4")), spread(ms, "i4")], names)

    return run


def _meet(share: int, cold: int):
    """Pairs (a, b) that share prefix tokens, with the count of them and the count that they need."""

    def emit(tokens, rids, ns, levels, ms) -> Iterator[pa.RecordBatch]:
        first = np.nonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))[0]
        sizes = np.diff(np.append(first, len(tokens)))
        found = []
        for size in range(2, cold + 1):
            at = first[sizes == size]
            if not len(at):
                continue
            for i in range(size):
                for j in range(i):
                    x, y = at + i, at + j
                    small, large = np.minimum(ns[x], ns[y]), np.maximum(ns[x], ns[y])
                    m = np.minimum(ms[x], ms[y])
                    fit = (100 * small.astype("i8") >= share * large.astype("i8")) & (levels[x] <= m) & (levels[y] <= m)
                    x, y = rids[x[fit]], rids[y[fit]]
                    found.append((np.minimum(x, y), np.maximum(x, y), m[fit]))
        if not found:
            return
        a, b, m = map(np.concatenate, zip(*found, strict=True))
        if not len(a):
            return
        # Pairs that meet again in this batch are summed here.
        order = np.lexsort((b, a))
        a, b, m = a[order], b[order], m[order]
        new = np.nonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))[0]
        yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(np.diff(np.append(new, len(a)))), pa.array(m[new])], ["a", "b", "shared", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy() for i in range(5)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1], side="left"))
            rest = [x[cut:] for x in now]
            if cut:
                yield from emit(*[x[:cut] for x in now])
        if rest is not None:
            yield from emit(*rest)

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([some.column(0), _lists([shingles(t.as_py(), width) for t in some.column(1)])], ["rid", "tokens"])

    return run


def linked(sets: list[np.ndarray], share: int) -> np.ndarray:
    """Boolean matrix: which sets are linked."""
    n = np.array([len(s) for s in sets], dtype="i8")
    owner = np.repeat(np.arange(len(sets)), n)
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(at)
    new = np.cumsum(often > 1) - 1
    keep = often[at] > 1
    at, owner = new[at[keep]], owner[keep]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    common_ = np.zeros((len(sets), len(sets)), dtype="f4")
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
        i, j = np.searchsorted(at, (low, low + 4096))
        x = np.zeros((len(sets), 4096), dtype="f4")
        x[owner[i:j], at[i:j] - low] = 1
        common_ += x @ x.T
    inter = common_.astype("i8")
    found = 100 * inter >= share * (n[:, None] + n[None, :] - inter)
    np.fill_diagonal(found, False)
    return found


def _verify(share: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        if not pairs.num_rows:
            return schema.empty_table()
        known = {r: s.values.to_numpy().view("u8") for r, s in zip(sets["rid"].to_pylist(), sets["tokens"].combine_chunks(), strict=True)}
        a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
        good = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            x, y = known[x], known[y]
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            inter = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            good[i] = 100 * inter >= share * (len(x) + len(y) - inter)
        return pa.table([a[good], b[good]], schema=schema)

    return run


def _forest(share: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        sets = [x.values.to_numpy() for x in table["tokens"].combine_chunks()] if table.num_rows else []
        # A document of both tiles comes twice, and so does one whose row is repeated.
        once = list({(r, s.tobytes() if len(s) < 4 else (len(s), int(s[0]), int(s[-1]), int(s.sum()))): i for i, (r, s) in enumerate(zip(table["rid"].to_pylist(), sets, strict=True))}.values())
        rid, sets = table["rid"].to_numpy()[once] if once else [], [sets[i] for i in once]
        if len(sets) < 2:
            return schema.empty_table()
        found = linked(sets, share)
        a, b, todo = [], [], set(range(len(rid)))
        while todo:
            reached = {start := todo.pop()}
            front = [start]
            while front:
                for y in np.nonzero(found[front.pop()])[0].tolist():
                    if y in todo:
                        todo.discard(y)
                        reached.add(y)
                        front.append(y)
            least = min(reached)
            a += [rid[least]] * (len(reached) - 1)
            b += [rid[x] for x in reached if x != least]
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return run


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast only if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class _Sets:
    """Documents as sets: ``facts`` has a row for each row of the table, ``reps`` one for each distinct set."""

    def __init__(self, docs: DataFrame, width: int, share: int) -> None:
        common.find_package(docs.sparkSession)
        self.width, self.share = width, share
        ha, hb = common.hash128("doc_id", "text")
        self.own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ha.alias("ha"), hb.alias("hb"), "text")
        self.facts = common.written(self.own.mapInArrow(_sketch(width, share), "doc_id long, ha long, hb long, n int, k1 long, k2 long, near array<bigint>"), "sets")
        known = self.facts.where("n > 0 AND doc_id IS NOT NULL")
        row = F.min(F.struct("doc_id", "ha", "hb"))
        reps = known.groupBy("k1", "k2").agg(row.alias("row"), F.any_value("n").alias("n"), F.any_value("near").alias("near"))
        # The number is made once: the written table is its source.
        self.reps = common.written(reps.select(F.monotonically_increasing_id().alias("rid"), "k1", "k2", "row.*", "n", "near"), "representatives")

    def whole(self, rids: DataFrame) -> DataFrame:
        """rid, tokens: the whole sets of some representatives, from their texts."""
        wanted = common.written(self.reps.join(_bounded(rids), "rid", "left_semi").select("rid", F.col("ha").alias("ha_"), F.col("hb").alias("hb_")), "wanted")
        rows = self.own.join(_bounded(wanted), (F.col("ha") == F.col("ha_")) & (F.col("hb") == F.col("hb_"))).select("rid", "text")
        again = self.facts.join(_bounded(wanted), (F.col("ha") == F.col("ha_")) & (F.col("hb") == F.col("hb_"))).groupBy("rid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rid")
        again = common.written(again, "repeated")
        if not again.isEmpty():
            rows = rows.join(_bounded(again), "rid", "left_anti").unionAll(rows.join(_bounded(again), "rid", "left_semi").dropDuplicates(["rid"]))
        return rows.mapInArrow(_full_sets(self.width), "rid long, tokens array<bigint>")


def _counted(lists: DataFrame, after: int | None) -> DataFrame:
    postings = lists.mapInArrow(_postings(after, COLD), "token long, rid long, w long")
    return common.written(postings.repartition("token").sortWithinPartitions("token").mapInArrow(_frequencies(COLD), "rid long, token long, df long"), "frequencies")


def _profile(counted: DataFrame, listed: DataFrame, tokens: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per document of ``listed`` (rid, size): single tokens and shared cold ones in their order; the hot tokens; their places."""
    hot = common.written(counted.where("rid IS NULL").select("token", "df"), "hot-tokens")
    placed = common.written(tokens.join(_bounded(hot), "token"), "hot-places")
    heat = placed.groupBy("rid").agg(F.count(F.lit(1)).alias("h"))
    cold = counted.where("rid IS NOT NULL").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias(name))
    whole = listed.join(heat, "rid", "left").join(cold, "rid", "left")
    single = F.col("size") - F.coalesce("h", F.lit(0)) - F.coalesce(F.size(name), F.lit(0))
    empty = F.array().cast("array<struct<df:bigint,token:bigint>>")
    return whole.select("rid", single.cast("int").alias(f"{name}_single"), F.coalesce(name, empty).alias(name), F.coalesce("h", F.lit(0)).alias(f"{name}_h")), hot, placed


def candidates(sets: _Sets) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) to compare, and the places (token, rid) of hot tokens in prefixes."""
    share, end = sets.share, zone_end(sets.share)
    p = F.col("n") - F.ceil(F.col("n") * share / 100) + 1
    counted = _counted(sets.reps.select("rid", "near"), None)
    near, _, placed = _profile(counted, sets.reps.select("rid", F.size("near").alias("size")), sets.reps.select("rid", F.explode("near").alias("token")), "near")
    near = common.written(near.join(sets.reps.select("rid", "n"), "rid"), "near")
    cold = F.col("near_single") + F.size("near")
    short = near.where(cold < p).select("rid")

    # Documents that the near zone does not serve: whole sets.
    whole = common.written(sets.whole(short), "far-sets")
    signed = end if end < 2**63 else end - 2**64
    far_token = ~((F.col("token") >= 0) & (F.col("token") < F.lit(signed))) if signed >= 0 else (F.col("token") < 0) & (F.col("token") >= F.lit(signed))
    tokens = whole.select("rid", F.explode("tokens").alias("token")).where(far_token)
    sizes = whole.select("rid", F.size("tokens").alias("n")).join(near.select("rid", (F.col("near_single") + F.size("near") + F.col("near_h")).alias("near_size")), "rid").select("rid", (F.col("n") - F.col("near_size")).alias("size"))
    far, _, far_placed = _profile(_counted(whole, end), sizes, tokens, "far")
    both = near.join(far, "rid", "left")
    empty = F.array().cast("array<struct<df:bigint,token:bigint>>")
    profile = common.written(both.select("rid", "n", "near_single", "near", F.coalesce("far_single", F.lit(0)).alias("far_single"), F.coalesce("far", empty).alias("far")), "profiles")

    met = profile.mapInArrow(_prefixes(share), "token long, rid long, n int, level int, m int")
    met = met.repartition("token").sortWithinPartitions("token").mapInArrow(_meet(share, COLD), "a long, b long, shared long, m int")
    pairs = met.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.any_value("m").alias("m")).where(F.col("shared") >= F.col("m")).select("a", "b")

    take = p - F.col("near_single") - F.size("near") - F.col("far_single") - F.size("far")
    full = profile.where(take > 0).select("rid", take.alias("take"))
    ranked = placed.unionAll(far_placed).join(full, "rid")
    place = F.row_number().over(Window.partitionBy("rid").orderBy("df", "token"))
    tied = common.written(ranked.withColumn("place", place).where(F.col("place") <= F.col("take")).select("token", "rid"), "tied")
    hubs = _bounded(common.written(tied.groupBy("token").agg(F.min("rid").alias("hub")), "hubs"))
    stars = tied.join(hubs, "token").where("hub <> rid").select(F.col("hub").alias("a"), F.col("rid").alias("b")).distinct()
    return common.written(pairs.unionAll(stars).distinct(), "candidates"), tied


def _compared(sets: _Sets, pairs: DataFrame) -> DataFrame:
    """The pairs that are linked. Documents that hang together by candidates go to one group; larger ones are cut to parts, and only pairs of parts with candidates meet."""
    blocks = graph.components(pairs).join(sets.reps.select(F.col("rid").alias("id"), "n"), "id")
    sums = blocks.groupBy("root").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    sums = common.written(sums.withColumn("parts", F.ceil(F.greatest(F.col("tokens") / TILE_TOKENS, F.col("rows") / TILE_ROWS)).cast("int")), "blocks")
    total = sums.where("parts = 1").agg(F.sum("tokens")).first()[0] or 0
    bins = max(1, -(-4 * total // TILE_TOKENS))
    of = blocks.join(_bounded(sums.select("root", "parts")), "root")
    # Small blocks share a bin; a part of a larger one has its own.
    bin_ = F.when(F.col("parts") == 1, F.struct(F.lit(-1).cast("long").alias("of"), F.pmod(F.xxhash64("root"), F.lit(bins)).alias("part")))
    of = common.written(of.select("id", F.coalesce(bin_, F.struct(F.col("root").alias("of"), F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).alias("part"))).alias("bin")), "bins")
    ba, bb = (of.select(F.col("id").alias(x), F.col("bin").alias(f"bin_{x}")) for x in "ab")
    dealt = pairs.join(ba, "a").join(bb, "b").select(F.struct(F.least("bin_a", "bin_b").alias("x"), F.greatest("bin_a", "bin_b").alias("y")).alias("g"), "a", "b")
    dealt = common.written(dealt, "dealt")
    members = dealt.select(F.col("g").alias("h"), F.explode(F.array("a", "b")).alias("rid")).distinct()
    given = members.join(sets.whole(of.select(F.col("id").alias("rid"))), "rid").select("h", "rid", "tokens")
    return dealt.groupBy("g").cogroup(given.groupBy("h")).applyInArrow(_verify(sets.share), "a long, b long")


def _tile(members: DataFrame, share: int) -> DataFrame:
    """Members (block, rid, n, class), each for every pair of tiles that it belongs to: pair, rid. Tiles of one class do not meet."""
    totals = members.groupBy("block").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    split = totals.where((F.col("tokens") > TILE_TOKENS) | (F.col("rows") > TILE_ROWS)).select("block", F.lit(True).alias("split"))
    level = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(share / 100)) + F.lit(1e-9)).cast("int") if share < 100 else F.col("n")
    # A small block is one tile; large classes have tiles of their own.
    rows = common.written(members.join(_bounded(split), "block", "left").withColumn("level", F.when(F.col("split"), level).otherwise(0)), "members")
    large = rows.where("split").groupBy("block", "level", "class").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") * 4 > TILE_ROWS).select("block", "level", "class", F.lit(True).alias("large"))
    rows = rows.join(_bounded(large), ["block", "level", "class"], "left").withColumn("of", F.when(F.col("large"), F.col("class")).otherwise(F.lit(-1)))
    counts = rows.groupBy("block", "level", "of").agg(F.ceil(F.greatest(F.sum("n") / TILE_TOKENS, F.count(F.lit(1)) / TILE_ROWS)).cast("int").alias("tiles"))
    counts = common.written(counts, "tiles")
    rows = rows.join(_bounded(counts), ["block", "level", "of"]).withColumn("tile", F.pmod(F.xxhash64("rid"), F.col("tiles")).cast("int"))
    # Partner tiles: those of the same level or a neighbour.
    other = counts.select("block", F.col("level").alias("level2"), F.col("of").alias("of2"), F.col("tiles").alias("tiles2"))
    partners = _bounded(other.withColumn("level", F.explode(F.array(F.col("level2") - 1, F.col("level2"), F.col("level2") + 1))))
    rows = rows.join(partners, ["block", "level"]).where((F.col("of") != F.col("of2")) | (F.col("of") == -1)).withColumn("tile2", F.explode(F.sequence(F.lit(0), F.col("tiles2") - 1)))
    own, theirs = F.struct("level", "of", "tile"), F.struct(F.col("level2").alias("level"), F.col("of2").alias("of"), F.col("tile2").alias("tile"))
    return rows.select(F.struct("block", F.least(own, theirs).alias("x"), F.greatest(own, theirs).alias("y")).alias("pair"), "rid")


def _left_over(sets: _Sets, tied: DataFrame, found: DataFrame) -> DataFrame:
    """Links between classes that share a hot prefix token."""
    of = tied.join(found.withColumnRenamed("id", "rid"), "rid", "left").withColumn("class", F.coalesce("root", "rid"))
    several = of.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.min("rid").alias("hub")).where("low <> high").select("token", "hub")
    several = common.written(several, "several")
    none = found.select(F.col("id").alias("a"), F.col("root").alias("b")).limit(0)
    if several.isEmpty():
        return none
    of = common.written(of.join(_bounded(several), "token").select("token", "rid", "class", "hub"), "class-places")
    blocks = graph.components(of.where("hub <> rid").select(F.col("hub").alias("a"), F.col("rid").alias("b")))
    members = blocks.select(F.col("root").alias("block"), F.col("id").alias("rid")).join(of.select("rid", "class").distinct(), "rid").join(sets.reps.select("rid", "n"), "rid")
    members = common.written(members.select("block", "rid", "n", "class"), "class-members")
    whole = sets.whole(members.select("rid"))
    return _tile(members, sets.share).join(whole, "rid").groupBy("pair").applyInArrow(_forest(sets.share), "a long, b long")


def _classified(docs: DataFrame, width: int, share: int) -> tuple[DataFrame, DataFrame]:
    """The facts of all rows, and k1, k2, root and the least row (doc_id, ha, hb) of its class for each distinct set."""
    sets = _Sets(docs, width, share)
    pairs, tied = candidates(sets)
    links = common.written(_compared(sets, pairs), "links")
    roots = graph.components(links)
    more = common.written(_left_over(sets, tied, roots), "more-links")
    if not more.isEmpty():
        roots = graph.components(links.unionAll(more))
    own = sets.reps.select("rid", "k1", "k2", F.struct("doc_id", "ha", "hb").alias("own"))
    own = common.written(own.join(roots.withColumnRenamed("id", "rid"), "rid", "left"), "roots-of-sets")
    # Only classes of several sets are looked up; a set without links is its own class (null roots would meet in one task).
    linked_ = own.where("root IS NOT NULL")
    least = common.written(linked_.groupBy("root").agg(F.min("own").alias("first")), "least-rows")
    of_set = linked_.join(_bounded(least), "root").select("k1", "k2", "root", "first")
    return sets.facts.drop("near"), of_set.unionAll(own.where("root IS NULL").select("k1", "k2", F.col("rid").alias("root"), F.col("own").alias("first")))


def _with_class(facts: DataFrame, of_set: DataFrame) -> DataFrame:
    of_set = of_set.withColumnsRenamed({"k1": "k1_", "k2": "k2_"})
    same = (F.col("k1") == F.col("k1_")) & (F.col("k2") == F.col("k2_")) & (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return facts.join(of_set, same, "left")


def classes(docs: DataFrame, width: int = 5, share: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    rows = _with_class(*_classified(docs, width, share))
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("first.doc_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, share: int = 80) -> DataFrame:
    """One row of each class, of the smallest doc_id; rows without words or doc_id stay."""
    rows = _with_class(*_classified(docs, width, share)).where("root IS NOT NULL")
    rows = common.written(rows.select(F.struct("doc_id", "ha", "hb").alias("row"), "first"), "classes")
    x, y = common.add_unique(docs, "row_a"), common.add_unique(docs, "row_b")
    keys = lambda c: [F.col(f"{c}.ha").alias(x), F.col(f"{c}.hb").alias(y)]
    gone = _bounded(common.written(rows.where("row <> first").select(*keys("row")).distinct(), "gone"))
    a, b = common.hash128(F.col("doc_id"), F.col("text"))
    same = (a == F.col(x)) & (b == F.col(y))
    kept = docs.join(gone, same, "left_anti")
    again = common.written(rows.groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys("row")), "repeated")
    if again.isEmpty():
        return kept
    more = _bounded(again)
    return kept.join(more, same, "left_anti").unionByName(kept.join(more, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def op8_adaptive_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.read(spark, sf_dir, "documents"), width=4, share=85)


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, row_number() OVER () AS r,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, r, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                             ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')))) END AS sh FROM w),
k AS (SELECT doc_id, r, len(sh) AS n, first_value(r) OVER (PARTITION BY sh ORDER BY r) AS rep, sh FROM s),
reps AS (SELECT r, n, sh FROM k WHERE r = rep AND n > 0),
known AS (SELECT rep, min(doc_id) AS id FROM k WHERE n > 0 AND doc_id IS NOT NULL GROUP BY rep),
e AS (SELECT r, n, unnest(sh) AS g FROM reps WHERE r IN (SELECT rep FROM known)),
p AS (SELECT a.r AS x, b.r AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS k FROM e AS a JOIN e AS b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT x, y FROM p WHERE 100 * k >= 85 * (nx + ny - k)),
edges AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT rep AS a, rep AS b FROM known UNION SELECT reach.a, edges.y FROM reach JOIN edges ON reach.b = edges.x),
comp AS (SELECT a, min(id) AS component_id FROM reach JOIN known ON reach.b = known.rep GROUP BY a)
SELECT doc_id, n AS n_shingles, CASE WHEN doc_id IS NULL OR n = 0 THEN doc_id ELSE component_id END AS component_id
FROM k LEFT JOIN comp ON k.rep = comp.a
"""
