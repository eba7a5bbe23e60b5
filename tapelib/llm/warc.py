"""WARC shards of pages and their fixity audit by Merkle trees.

A shard ``pages-<n>.warc.gz`` holds one gzip member per record, in ascending page order.  Leaves of the tree are SHA-256
digests of the records' bytes; a node is the digest of up to 16 consecutive nodes below it (ordered offset ranges of a
shard, then ranges of shards).  Two replicas are compared from the root, and only children of nodes that differ are read.
"""

from __future__ import annotations

import gzip
import hashlib
import posixpath
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelib.llm.store import open_fs, stored

#: Children of a node.
FANOUT = 16
#: WARC-Date of all records, so that replicas written from the same pages are equal.
DATE = "2024-01-01T00:00:00Z"


def record(key, url: str | None, html: str | None) -> bytes:
    """One gzip member with a ``resource`` record; a null page is an empty one, a null url has no target line."""
    body = (html or "").encode()
    target = f"WARC-Target-URI: {''.join(url.split())}\r\n" if url else ""
    head = (f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}')}>\r\n{target}WARC-Date: {DATE}\r\n"
            f"WARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n")
    return gzip.compress(head.encode() + body + b"\r\n\r\n", 6, mtime=0)


def payload(raw: bytes) -> bytes:
    """The body of a record."""
    text = gzip.decompress(raw)
    head, _, rest = text.partition(b"\r\n\r\n")
    size = next(int(line.split(b":")[1]) for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    return rest[:size]


class _Shard:
    """A shard being written: under a name of the attempt, then moved."""

    def __init__(self, folder: str, number: int):
        self.fs, self.base = open_fs(folder)
        self.fs.create_dir(self.base, recursive=True)
        self.name = posixpath.join(self.base, f"pages-{number:06d}.warc.gz")
        self.temporary = f"{self.name}.{uuid.uuid4().hex}"
        self.out, self.size = self.fs.open_output_stream(self.temporary, compression=None), 0

    def add(self, raw: bytes) -> int:
        self.out.write(raw)
        self.size += len(raw)
        return self.size - len(raw)

    def done(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self.name)


_RECORDS = "shard int, place long, offset long, length long, digest binary"


def write_warc(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages; returns the stored manifest: ``id, shard, place`` (number in the shard) ``, offset, length, digest``.

    Null ids sort first; repeated pages are records of their own; other columns are not written; no page, no shard."""
    pages = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def write(batches):
        shard, number, place = None, TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for key, url, html in zip(*(part.column(c).to_pylist() for c in ("id", "url", "html")), strict=True):
                    shard = shard or _Shard(folder, number)
                    raw = record(key, url, html)
                    rows.append((number, place, shard.add(raw), len(raw), hashlib.sha256(raw).digest()))
                    place += 1
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], ["id", "shard", "place", "offset", "length", "digest"])
        if shard:
            shard.done()

    placed = pages.repartitionByRange("id").sortWithinPartitions("id", "url", "html")
    return stored(placed.mapInArrow(write, f"id {pages.schema['id'].dataType.simpleString()}, {_RECORDS}"), "warc-manifest")


def copy_warc(manifest: DataFrame, source: str, target: str, damaged) -> DataFrame:
    """Copy a replica record by record, changing one byte in the middle of records for which ``damaged`` (a Column) is true:
    a replica with known faults.  Returns one row per shard."""
    rows = manifest.select("shard", "offset", "length", damaged.alias("damaged")).repartitionByRange("shard").sortWithinPartitions("shard", "offset")

    def copy(batches):
        now, shard, file = None, None, None
        fs, base = open_fs(source)
        for batch in batches:
            for number, offset, length, hurt in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length", "damaged")), strict=True):
                if number != now:
                    if shard:
                        shard.done()
                        yield pa.RecordBatch.from_pydict({"shard": pa.array([now], pa.int32())})
                    now, shard, file = number, _Shard(target, number), fs.open_input_file(posixpath.join(base, f"pages-{number:06d}.warc.gz"))
                file.seek(offset)
                raw = bytearray(file.read(length))
                if hurt:
                    raw[length // 2] ^= 0x20
                shard.add(bytes(raw))
        if shard:
            shard.done()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([now], pa.int32())})

    return stored(rows.mapInArrow(copy, "shard int"), "warc-copy")


def read_records(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Digest of each record's bytes in ``folder`` at the manifest's offsets, null where the file ends before or is missing;
    with ``payload_sha256`` and ``payload_bytes`` of the unpacked page if asked for (null where it cannot be unpacked)."""
    rows = manifest.select("id", "shard", "place", "offset", "length").repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")

    def read(batches):
        now, file = None, None
        fs, base = open_fs(folder)
        for batch in batches:
            digests, sums, sizes = [], [], []
            for number, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if number != now:
                    path = posixpath.join(base, f"pages-{number:06d}.warc.gz")
                    now, file = number, fs.open_input_file(path) if fs.get_file_info(path).is_file else None
                raw = b""
                if file and file.size() >= offset + length:
                    file.seek(offset)
                    raw = file.read(length)
                digests.append(hashlib.sha256(raw).digest() if raw else None)
                if with_payload:
                    try:
                        body = payload(raw)
                    except (OSError, EOFError, ValueError, StopIteration, zlib.error):
                        body = None
                    sums.append(hashlib.sha256(body).hexdigest() if body is not None else None)
                    sizes.append(len(body) if body is not None else None)
            more = [pa.array(sums, pa.string()), pa.array(sizes, pa.int64())] if with_payload else []
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "shard", "place", "offset", "length")] + [pa.array(digests, pa.binary()), *more], ["id", "shard", "place", "offset", "length", "digest"] + ["payload_sha256", "payload_bytes"] * with_payload)

    kind = manifest.schema["id"].dataType.simpleString()
    return rows.mapInArrow(read, f"id {kind}, {_RECORDS}" + ", payload_sha256 string, payload_bytes long" * with_payload)


def merkle_tree(records: DataFrame) -> list[DataFrame]:
    """Levels from leaves to root, each ``shard, node, low, high`` (offset range) ``, hash``.  Below the shard roots ``node``
    counts within the shard; above, ``shard`` is -1 and ``node`` counts ranges of shards.  Without records: one empty level."""
    levels = [stored(records.select("shard", F.col("place").alias("node"), F.col("offset").alias("low"), (F.col("offset") + F.col("length")).alias("high"), F.coalesce("digest", F.lit(b"")).alias("hash")), "merkle")]

    def up(below: DataFrame) -> DataFrame:
        children = F.array_sort(F.collect_list(F.struct("node", "hash")))  # FANOUT at most
        return below.groupBy("shard", F.floor(F.col("node") / FANOUT).alias("parent")).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.transform(children, lambda c: c["hash"]).alias("c")).select(
            "shard", F.col("parent").alias("node"), "low", "high", F.unhex(F.sha2(F.aggregate("c", F.lit(b""), lambda a, b: F.concat(a, b)), 256)).alias("hash"))

    while levels[-1].agg(F.max("node")).first()[0] or len(levels) == 1 and not levels[0].isEmpty():
        levels.append(stored(up(levels[-1]), "merkle"))
    if not levels[-1].isEmpty():
        levels.append(stored(levels[-1].select(F.lit(-1).alias("shard"), F.col("shard").cast("long").alias("node"), F.lit(0).cast("long").alias("low"), F.col("high"), "hash"), "merkle"))
        while levels[-1].count() > 1:
            levels.append(stored(up(levels[-1]), "merkle"))
    return levels


def audit(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """Leaves that differ between two replicas: ``shard, place``.  Starts at the roots; at each level only children of
    nodes that differ are compared, so equal replicas cost one comparison.  Both trees are of the same manifest."""
    differ = None
    for k in range(len(ours) - 1, -1, -1):
        a, b = ours[k].select("shard", "node", "hash"), theirs[k].select("shard", "node", F.col("hash").alias("other"))
        if differ is not None:
            if differ.isEmpty():
                break
            if k + 1 == next(i for i, level in enumerate(ours) if level.filter("shard = -1").limit(1).count()):
                a = a.join(differ.select(F.col("node").alias("of")), F.col("shard") == F.col("of"), "left_semi")  # shard roots
            else:
                parents = differ.select(F.col("shard").alias("p_shard"), F.col("node").alias("p_node"))
                a = a.join(parents, (F.col("shard") == F.col("p_shard")) & (F.floor(F.col("node") / FANOUT) == F.col("p_node")), "left_semi")
        differ = stored(a.join(b, ["shard", "node"], "left").filter(~F.col("hash").eqNullSafe(F.col("other"))).select("shard", "node"), "merkle-differ")
    return differ.select("shard", F.col("node").alias("place")).filter("shard >= 0")
