"""Token-id output as sorted-string-table shards (operator 10).

``write`` range-partitions documents by identifier, tokenises every whole text and writes one
shard file per partition. ``read`` gives the documents back in ascending key order with the
global offset of their first id, and ``Shard`` opens one file for binary-search lookups.

Layout of a shard (integers little-endian)::

    block*   entries of ascending keys, zstandard-compressed as a whole
    index    zstandard of [first key, file offset, stored bytes, raw bytes, entries, ids before] per block
    bloom    bit array over the keys
    footer   fixed size: offsets and sizes of index and bloom, counts, ids, bloom hashes, magic

An entry is ``shared(varint) unshared(varint) ids(varint) place(varint) key-suffix ids``: keys are
prefix-compressed against the previous key of the block, and the ids are unsigned 32-bit; place is 0, or 1 more than a
number that the document carries (its place in training).
A key is 9 bytes: 0 for a null identifier, else 1 and the big-endian identifier with its sign
bit flipped, so that bytewise order is numeric order with nulls first.

Defined cases: a null or empty text is one end id; a null ``doc_id`` sorts first; repeated
identifiers keep every row, ordered by a hash of the text (null texts count as empty ones) and then by text; texts of any length are
encoded whole; an empty table makes no shard and no row. Extra columns are ignored.

Any file of the tokenizers library serves: the one that the chunked encoder knows (``_KNOWN``) is encoded chunk by chunk, every other one as whole texts.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesql.llm import common

MAGIC = b"FSST0002"
FOOTER = struct.Struct("<QQQQQQQQ8s")
INDEX = struct.Struct("<9sQIIIQ")
#: Raw bytes after which a block is closed.
BLOCK_BYTES = 1 << 18
#: Texts of about this many bytes go to one shard.
SHARD_BYTES = 64 << 20
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Most chunks that a Python worker keeps; frequent ones come early, later ones are encoded each time.
CACHE_CHUNKS = 1_000_000

_CACHE: dict[str, dict[str, bytes]] = {}
_TOKENIZERS: dict[str, object] = {}


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


#: What a tokenizer file must say besides its vocabulary for chunks to be encoded one by one.
_KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None, "truncation": None, "padding": None,
}


def _tokenizer(path: str):
    """The tokenizer of a file, and whether chunks between blanks can be encoded one by one."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        model = {k: v for k, v in said["model"].items() if k not in ("vocab", "merges")}
        byte_pairs = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        # A special token that holds a blank or reaches over one would cross chunks.
        special = all(not re.search(r"\s", t["content"]) and not t["lstrip"] and not t["rstrip"] for t in said.get("added_tokens", []))
        _TOKENIZERS[path] = Tokenizer.from_file(path), byte_pairs and special and all(said.get(k) == v for k, v in _KNOWN.items())
    return _TOKENIZERS[path]


#: Words of Latin-1 letters, perhaps with closing marks: their pieces are known without the full pre-tokenizer.
_PLAIN = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,!?;:#$%&*]*)")


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: printable ones stand for themselves, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(own))}
    return [chr(rest.get(b, b)) for b in range(256)]


_LETTERS = _byte_letters()


def _chunk_ids(tokenizer, cache: dict[str, bytes], chunk: str) -> bytes:
    m = _PLAIN.fullmatch(chunk)
    if not m:
        return array("I", tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
    word, marks = m.groups()
    word = word.lower()
    got = cache.get(word)
    if got is None:
        letters = word if word.isascii() else "".join([_LETTERS[b] for b in word.encode()])
        got = array("I", [t.id for t in tokenizer.model.tokenize(letters)]).tobytes()
    if marks:
        if marks not in cache:
            cache[marks] = array("I", tokenizer.encode(marks, add_special_tokens=False).ids).tobytes()
        got += cache[marks]
    return got


def encode(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian 32-bit integers.

    With the known tokenizer, a text is encoded chunk by chunk between blanks and line ends, and equal chunks are encoded once
    per worker as long as the cache has room. The ids equal those of the whole text.
    """
    tokenizer, chunked = _tokenizer(path)
    if not chunked:
        return [array("I", tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    cache = common.own_cache(_CACHE.setdefault(path, {}))
    cache[""] = b""
    out = []
    for t in texts:
        own = t.replace("\n", " ").split(" ")
        try:
            out.append(b"".join([cache[c] for c in own]))
        except KeyError:
            got = []
            for c in own:
                ids = cache.get(c)
                if ids is None:
                    ids = _chunk_ids(tokenizer, cache, c)
                    if len(cache) < CACHE_CHUNKS and len(c) < 40:
                        cache[c] = ids
                got.append(ids)
            out.append(b"".join(got))
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(keys: list[bytes], bits: int) -> np.ndarray:
    digests = b"".join(hashlib.blake2b(k, digest_size=16).digest() for k in keys)
    h = np.frombuffer(digests, dtype="<u8").reshape(-1, 2)
    with np.errstate(over="ignore"):
        return (h[:, :1] + np.arange(BLOOM_HASHES, dtype="u8") * (h[:, 1:] | np.uint64(1))) % np.uint64(bits)


class ShardWriter:
    """Streams entries of ascending keys to a file; holds one block and the keys."""

    def __init__(self, out) -> None:
        self.out, self.at = out, 0
        self.raw, self.last, self.first, self.n = io.BytesIO(), b"", b"", 0
        self.index, self.digests = [], []
        self.entries = self.ids = self.block_ids = 0
        self.zstd = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: bytes, place: int | None = None) -> None:
        if key < self.last:
            raise ValueError("keys must ascend")
        shared = len(os.path.commonprefix([self.last, key])) if self.n else 0
        if not self.n:
            self.first, self.block_ids = key, self.ids
        self.raw.write(_varint(shared) + _varint(len(key) - shared) + _varint(len(ids) // 4) + _varint(0 if place is None else place + 1) + key[shared:])
        self.raw.write(ids)
        self.last, self.n = key, self.n + 1
        self.entries, self.ids = self.entries + 1, self.ids + len(ids) // 4
        self.digests.append(key)
        if self.raw.tell() >= BLOCK_BYTES:
            self.flush()

    def _write(self, data: bytes) -> tuple[int, int]:
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at, len(data)

    def flush(self) -> None:
        if self.n:
            raw = self.raw.getvalue()
            at, stored = self._write(self.zstd.compress(raw))
            self.index.append(INDEX.pack(self.first, at, stored, len(raw), self.n, self.block_ids))
            self.raw, self.n = io.BytesIO(), 0

    def close(self) -> None:
        self.flush()
        index = self._write(self.zstd.compress(b"".join(self.index)))
        bits = max(64, -(-len(self.digests) * BLOOM_BITS // 8) * 8)
        filled = np.zeros(bits, dtype=bool)
        for i in range(0, len(self.digests), 65_536):
            filled[_bloom_places(self.digests[i : i + 65_536], bits)] = True
        bloom = self._write(np.packbits(filled).tobytes())
        self._write(FOOTER.pack(*index, *bloom, len(self.index), self.entries, self.ids, bits, MAGIC))


def _entries(raw: bytes) -> Iterator[tuple[bytes, bytes, int | None]]:
    """Key, ids and place of each entry."""
    at, key = 0, b""
    while at < len(raw):
        shared, at = _read_varint(raw, at)
        unshared, at = _read_varint(raw, at)
        n, at = _read_varint(raw, at)
        place, at = _read_varint(raw, at)
        key = key[:shared] + raw[at : at + unshared]
        at += unshared
        yield key, raw[at : at + 4 * n], place - 1 if place else None
        at += 4 * n


class Shard:
    """One shard opened for lookups: reads the footer, the sparse index and the Bloom filter."""

    def __init__(self, uri: str) -> None:
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        self.size = self.file.size()
        if self.size < FOOTER.size:
            raise ValueError(f"{uri} is no shard")
        *f, magic = FOOTER.unpack(self._at(self.size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        self.blocks, self.entries, self.ids, self.bits = f[4:]
        self.index = list(INDEX.iter_unpack(zstandard.ZstdDecompressor().decompress(self._at(f[0], f[1]))))
        self.bloom = self._at(f[2], f[3])

    def __enter__(self) -> Shard:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, i: int) -> bytes:
        _, at, stored, raw, _, _ = self.index[i]
        return zstandard.ZstdDecompressor().decompress(self._at(at, stored), max_output_size=raw)

    def scan(self) -> Iterator[tuple[bytes, bytes, int | None]]:
        for i in range(self.blocks):
            yield from _entries(self.block(i))

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in map(int, _bloom_places([key], self.bits)[0]))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every row of this document, by binary search over the block index."""
        key = key_of(doc_id)
        if not self.blocks or not self.may_hold(key):
            return []
        low, high = 0, self.blocks
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.index[mid][0] < key else (low, mid)
        found = []
        for i in range(max(0, low - 1), self.blocks):
            if self.index[i][0] > key:
                break
            found += [np.frombuffer(ids, dtype="<u4") for k, ids, _ in _entries(self.block(i)) if k == key]
        return found


def _write_partition(folder: str, tokenizer: str, end_id: int):
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(folder)
        temporary, name = f"{root}/.{shard:06d}-{uuid.uuid4().hex}", f"{shard:06d}.sst"
        out = None
        for batch in batches:
            ids, texts, places = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
            for i in range(0, len(ids), 2_000):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(temporary)
                    writer = ShardWriter(out)
                some = texts.slice(i, 2_000).to_pylist()
                for doc_id, got, place in zip(ids[i : i + 2_000], encode([t or "" for t in some], tokenizer), places[i : i + 2_000], strict=True):
                    writer.add(key_of(doc_id), got + end, place)
        if out is not None:
            writer.close()
            out.close()
            fs.move(temporary, f"{root}/{name}")  # an attempt that was run again replaces it by the same bytes
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [name], "entries": [writer.entries], "ids": [writer.ids]}, schema=MANIFEST)

    return run


MANIFEST = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("entries", pa.int64()), ("ids", pa.int64())])


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, shard_bytes: int = SHARD_BYTES, place: str | None = None) -> DataFrame:
    """Writes the shards and a manifest table (one row per shard) and returns the manifest. ``place`` names a column of numbers from 0 that entries carry."""
    spark = docs.sparkSession
    common.find_package(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.col(place) if place else F.lit(None)).cast("long").alias("place"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(6, -(-total // shard_bytes)) if total else 1
    ordered = own.repartitionByRange(int(shards), F.col("doc_id").asc_nulls_first(), F.xxhash64(common.row_text())).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64(common.row_text()), common.row_text(), "place")
    # Rows of one identifier may lie in two neighbouring shards.
    made = ordered.mapInArrow(_write_partition(f"{folder}/shards", tokenizer, end_id), "shard long, file string, entries long, ids long")
    made.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _read_shards(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                held = 0
                with Shard(f"{folder}/shards/{name}") as shard:
                    for key, ids, place in shard.scan():
                        rows.append((id_of(key), start, len(ids) // 4, zlib.crc32(ids), ids, place))
                        start, held = start + len(ids) // 4, held + len(ids)
                        if held > 8 << 20 or len(rows) >= 10_000:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc_id, start, n, crc, ids, place = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(ids, pa.binary()), pa.array(place, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids", "place"])


def read(spark: SparkSession, folder: str, with_ids: bool = False, place: str | None = None) -> DataFrame:
    """Documents of the files of a folder: doc_id, start, n_tokens, ids_crc32 (and ids, and the places under the name ``place``)."""
    from pyspark.sql import Window

    manifest = spark.read.parquet(f"{folder}/manifest")
    # One row per shard: the running total over them is the only work in a single task.
    before = manifest.select("file", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("start"), (F.row_number().over(Window.orderBy("shard")) - 1).alias("part"))
    n = max(1, manifest.count())
    spread = before.repartitionByRange(n, "part").select("file", "start")
    run = _read_shards(folder)
    types = {"doc_id": "long", "start": "long", "n_tokens": "long", "ids_crc32": "long"} | ({"ids": "binary"} if with_ids else {}) | ({"place": "long"} if place else {})

    def some(batches):
        for b in run(batches):
            yield b.select(list(types))

    made = spread.mapInArrow(some, ", ".join(f"{c} {t}" for c, t in types.items()))
    return made.withColumnRenamed("place", place) if place else made


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_and_read(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, place: str | None = None) -> DataFrame:
    """Writes ``docs`` to a fresh shared folder and reads the files back."""
    folder = common.shared_dir(docs.sparkSession, "sst")
    write(docs, folder, tokenizer or default_tokenizer(), end_id, place=place)
    return read(docs.sparkSession, folder, place=place)


def op10_sorted_string_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read(common.read(spark, sf_dir, "documents"))
