"""Token-ID files: raw id payloads in shards, and a minimal perfect hash index from document key to shard and offset.

Files of one folder
-------------------
``ids-<shard>.bin``     ids of the shard's documents one after the other, little-endian, 2 bytes each (4 if the
                        vocabulary has more than 65,536 ids).  Shards hold ascending ranges of keys.
``index-<bucket>.npz``  the keys whose hash falls in the bucket: bit levels of the hash function, and for each slot the
                        32-bit fingerprint of its key, shard, position in the shard, position in the corpus, count of ids.

A key is (id, copy): ``copy`` numbers rows with the same id, by text.  A look-up hashes the key once per level (under two
levels on average), reads one slot and compares the fingerprint; a key that is not there is found out with probability
1 - 2^-32.
"""

from __future__ import annotations

import io
import posixpath
import uuid
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapelib.llm.encode import encoder
from tapelib.llm.store import open_fs, put_file, stored
from tapelib.llm.text import mix

#: Keys in one index file, on average.
KEYS_PER_BUCKET = 50_000
#: Slots for each key that is still unplaced, in each level.
SLOTS_PER_KEY = 2
_LEVEL = 0x9E3779B97F4A7C15
_PRINT = np.uint64(0xA0761D6478BD642F)


class PerfectHash:
    """Each level has a bit for every slot that exactly one of its keys falls on; the others go on to the next level.
    The slot of a key is the number of set bits before its own, over all levels."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, base = [], 0
        for bits in levels:
            self.ranks.append(base + np.cumsum(bits) - bits)
            base += int(bits.sum())

    @staticmethod
    def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * _LEVEL % 2**64)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two keys have the same 64-bit hash")
        levels = []
        while len(keys):
            size = max(64, SLOTS_PER_KEY * len(keys))
            slots = cls._slots(keys, len(levels), size)
            alone = np.bincount(slots, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[slots]]
        return cls(levels)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, or -1; a key that was not there at building may get any slot."""
        out, rest = np.full(len(keys), -1), np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            slots = self._slots(keys[rest], k, len(bits))
            hit = bits[slots]
            out[rest[hit]] = self.ranks[k][slots[hit]]
            rest = rest[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ _PRINT) >> np.uint64(32)).astype(np.uint32)


def _key(copy="copy"):
    return F.xxhash64("id", F.col(copy).cast("long"))


def write_token_files(df: DataFrame, folder: str, vocabulary: str, spaced: bool, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append ``end_id``, write payload and index files to ``folder``, which all executors see.

    Returns one row per index file: ``bucket, keys``.  Null texts count as empty and hold the end id alone; null ids sort
    first; rows with the same id are copies 0, 1, ... by text; other columns are not looked at; an empty table gives no files.

    Texts move once, by ranges of ids; ids go straight from the tokenizer to the shard's file, written under a name of the
    attempt and then moved, so a repeated task replaces the file whole.
    """
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema["id"].dataType

    def write(batches):
        code, name, place, last, copy = encoder(vocabulary, spaced), None, 0, object(), 0
        shard = TaskContext.get().partitionId()
        fs, base = open_fs(folder)
        for batch in batches:
            texts = code.encode(batch.column("text"))
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                if name is None:
                    fs.create_dir(base, recursive=True)
                    name = posixpath.join(base, f".ids-{shard:06d}.{uuid.uuid4().hex}")
                    out = fs.open_output_stream(name)
                end = np.array([end_id], dtype=code.kind).tobytes()
                copies, places, counts = [], [], []
                ids = part.column("id").to_pylist()
                for key, tokens in zip(ids, islice(texts, len(ids)), strict=True):
                    out.write(tokens.tobytes() + end)
                    copy = copy + 1 if key == last else 0
                    last = key
                    copies.append(copy)
                    places.append(place)
                    counts.append(len(tokens) + 1)
                    place += len(tokens) + 1
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(copies, pa.int32()), pa.array([shard] * len(ids), pa.int32()), pa.array(places, pa.int64()), pa.array(counts, pa.int64())], ["id", "copy", "shard", "place", "n_tokens"])
        if name is not None:
            out.close()
            fs.move(name, posixpath.join(base, f"ids-{shard:06d}.bin"))

    sorted_docs = docs.repartitionByRange("id").sortWithinPartitions("id", "text")
    rows = stored(sorted_docs.mapInArrow(write, f"id {kind.simpleString()}, copy int, shard int, place long, n_tokens long"), "token-rows")
    # one row per shard: what stands before it
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = shards.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before"))
    buckets = max(1, -(-rows.count() // KEYS_PER_BUCKET))
    placed = rows.join(before, "shard").select(_key().alias("key"), "shard", "place", (F.col("before") + F.col("place")).alias("start"), "n_tokens")

    def index(key, found):
        bucket = key[0].as_py()
        columns = {c: found.column(c).to_numpy() for c in ("shard", "place", "start", "n_tokens")}
        keys = found.column("key").to_numpy().view(np.uint64)
        mph = PerfectHash.build(keys)
        order = np.argsort(mph.find(keys))
        levels = {f"level{k}": np.packbits(bits) for k, bits in enumerate(mph.levels)}
        buf = io.BytesIO()
        np.savez(buf, sizes=np.array([len(b) for b in mph.levels]), prints=fingerprints(keys)[order], **levels, **{c: v[order] for c, v in columns.items()})
        put_file(folder, f"index-{bucket:06d}.npz", lambda out: out.write(buf.getvalue()))
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "keys": pa.array([len(keys)], pa.int64())})

    bucket = F.pmod("key", F.lit(buckets)).cast("int")
    return stored(placed.groupBy(bucket.alias("bucket")).applyInArrow(index, "bucket int, keys long"), "token-index")


def find_tokens(keys: DataFrame, folder: str, buckets: int) -> DataFrame:
    """Look up ``keys`` (id, copy) in the index: adds ``shard, place, start, n_tokens``, null for keys that are not there."""
    hashed = keys.select("id", "copy", _key().alias("key"))
    hashed = hashed.withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))
    kind = keys.schema["id"].dataType.simpleString()

    def find(batches):
        loaded, now = None, None
        fs, base = open_fs(folder)
        for batch in batches:
            b = batch.column("bucket").to_numpy()
            for lo, hi in zip(cuts := np.flatnonzero(np.r_[True, b[1:] != b[:-1]]), np.r_[cuts[1:], len(b)], strict=True):
                if now != b[lo]:
                    now = b[lo]
                    with fs.open_input_stream(posixpath.join(base, f"index-{now:06d}.npz")) as f:
                        loaded = dict(np.load(io.BytesIO(f.read())))
                    mph = PerfectHash([np.unpackbits(loaded[f"level{k}"], count=n).astype(bool) for k, n in enumerate(loaded["sizes"])])
                part = batch.slice(lo, hi - lo)
                hashes = part.column("key").to_numpy().view(np.uint64)
                slots = mph.find(hashes)
                miss = (slots < 0) | (loaded["prints"][slots] != fingerprints(hashes))
                found = [pa.array(loaded[c][slots], mask=miss) for c in ("shard", "place", "start", "n_tokens")]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("copy"), *found], ["id", "copy", "shard", "place", "start", "n_tokens"])

    return hashed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(find, f"id {kind}, copy int, shard int, place long, start long, n_tokens long")


def read_tokens(found: DataFrame, folder: str, width: int = 2, with_ids: bool = True) -> DataFrame:
    """Read the ids of rows of :func:`find_tokens`: adds ``ids_crc32`` (of the ids as little-endian 32-bit integers) and,
    if asked for, ``ids`` (array of int).  Reading is dealt by ranges of (shard, place), so files are read forwards."""
    kind = found.schema["id"].dataType.simpleString()

    def read(batches):
        now, f = None, None
        fs, base = open_fs(folder)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sums, ids = [], []
                for shard, place, n in zip(*(part.column(c).to_pylist() for c in ("shard", "place", "n_tokens")), strict=True):
                    if now != shard:
                        now, f = shard, fs.open_input_file(posixpath.join(base, f"ids-{shard:06d}.bin"))
                    f.seek(place * width)
                    got = np.frombuffer(f.read(n * width), dtype=f"<u{width}").astype("<u4")
                    sums.append(zlib.crc32(got.tobytes()))
                    if with_ids:
                        ids.append(got.astype(np.int32))
                out = [part.column(c) for c in ("id", "copy", "start", "n_tokens")] + [pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, ["id", "copy", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    rows = found.filter("shard IS NOT NULL").repartitionByRange("shard", "place").sortWithinPartitions("shard", "place")
    return rows.mapInArrow(read, f"id {kind}, copy int, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
