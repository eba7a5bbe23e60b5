"""Harmonic packing: class k holds the lengths from capacity / (k + 1), exclusive, to capacity / k, and every bin of class k takes
k pieces of it, whichever they are.  So each worker fills bins of its own without knowing of any other.

Lengths near the lower end of their class would leave much padding.  Since texts may be cut, such a text gives off a piece of the
full length of the next class, capacity / (k + 1), and the rest, of a class above k * (k + 1), is judged again.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapelib.llm.encode import encoder
from tapelib.llm.store import stored

#: A text is cut where that saves more than so many tokens of padding.
SLACK = 4
#: Pieces of text whose ids a worker remembers, some 300 MB.
PIECES = 800_000
#: Rows handed on at once.
ROWS = 4096
#: Where the numbers of bins filled from several workers' pieces, and of the last bins of all classes, begin.
SHARED, LAST = 1 << 61, 1 << 62


def cuts(n: int, capacity: int, slack: int = SLACK) -> list[int]:
    """Lengths into which a text of ``n`` tokens is cut, in order."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        k = capacity // n
        if capacity - k * n <= slack * k:
            out.append(n)
            break
        out.append(capacity // (k + 1))
        n -= out[-1]
    return out


def _bins(docs: DataFrame, vocabulary: str, spaced: bool, end_id: int, capacity: int, slack: int, with_ids: bool) -> DataFrame:
    """Pieces of all texts.  ``sequence_id`` and ``offset`` are set in bins that a worker filled by itself; the others, at most
    k - 1 of each class and worker, carry ``worker`` and their ``place`` among the class's leftovers there."""
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "class", "worker", "place", "sequence_id", "offset"] + ["ids"] * with_ids
    longs = names[1:10]

    def fill(batches):
        code, worker, done = encoder(vocabulary, spaced, PIECES), TaskContext.get().partitionId(), 0
        by_rest = [cuts(n, capacity, slack) for n in range(capacity)]
        waiting: dict[int, list[tuple]] = defaultdict(list)  # of each class, fewer pieces than a bin takes
        ready: list[tuple] = []
        kind = pa.null()

        def batch_of(rows):
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(columns[0], kind)] + [pa.array(c, pa.int64()) for c in columns[1:10]]
            return pa.RecordBatch.from_arrays(arrays + ([pa.array(columns[10], pa.list_(pa.int32()))] if with_ids else []), names)

        for batch in batches:
            kind, texts = batch.column("id").type, code.encode(batch.column("text"))
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for key, tokens in zip(part.column("id").to_pylist(), islice(texts, part.num_rows), strict=True):
                    tokens = np.append(tokens, code.kind.type(end_id)).astype("<u4")
                    total, start = len(tokens), 0
                    for n in [capacity] * (total // capacity) + by_rest[total % capacity]:
                        one, k = tokens[start:start + n], capacity // n
                        bin_ = waiting[k]
                        bin_.append((key, start, n, zlib.crc32(one.tobytes()), total, one.astype(np.int32) if with_ids else None))
                        start += n
                        if len(bin_) == k:
                            offset = 0
                            for p in bin_:
                                ready.append((*p[:5], k, worker, None, (worker << 32) + done, offset, p[5])[:10 + with_ids])
                                offset += p[2]
                            done += 1
                            waiting[k] = []
                if len(ready) >= ROWS:
                    yield batch_of(ready)
                    ready = []
        ready += [(*p[:5], k, worker, place, None, None, p[5])[:10 + with_ids] for k, bin_ in sorted(waiting.items()) for place, p in enumerate(bin_)]
        if ready:
            yield batch_of(ready)

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(fill, f"id {kind}, " + ", ".join(f"`{c}` long" for c in longs) + ", ids array<int>" * with_ids)


def _shared_bins(left: DataFrame) -> DataFrame:
    """Leftovers of all workers in bins of their class.  They are numbered from counts per worker; only the last bin of a class
    can lack pieces: it gets no ``sequence_id``."""
    counts = left.groupBy("class", "worker").agg(F.count(F.lit(1)).alias("c"))
    of_class = Window.partitionBy("class")
    counts = counts.select("class", "worker", (F.sum("c").over(of_class.orderBy("worker")) - F.col("c")).alias("before"), F.sum("c").over(of_class).alias("n"))
    placed = left.join(counts, ["class", "worker"]).withColumn("number", F.col("before") + F.col("place"))
    placed = placed.withColumn("bin", F.expr("number div class"))
    offset = F.sum("length").over(Window.partitionBy("class", "bin").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    full = F.expr("(bin + 1) * class <= n")
    return placed.withColumn("offset", F.when(full, offset)).withColumn("sequence_id", F.when(full, F.lit(SHARED) + F.col("class") * (1 << 40) + F.col("bin"))).select(*left.columns)


def _last_bins(rest: DataFrame, capacity: int) -> DataFrame:
    """The last bins of all classes, packed together by best fit in one task.  They are fewer than k pieces of each class:
    some thousands for common capacities, whatever the corpus."""
    def fit(batches):
        rows = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        lengths, numbers, offsets, rooms = rows.column("length").to_numpy(), [], [], []
        order = np.lexsort((rows.column("place").to_numpy(), rows.column("worker").to_numpy(), -lengths))
        for n in lengths[order].tolist():
            at = min((k for k, room in enumerate(rooms) if room >= n), key=rooms.__getitem__, default=len(rooms))
            if at == len(rooms):
                rooms.append(capacity)
            numbers.append(LAST + at)
            offsets.append(capacity - rooms[at])
            rooms[at] -= n
        rows = rows.take(pa.array(order))
        for name, values in (("sequence_id", numbers), ("offset", offsets)):
            rows = rows.set_column(rows.column_names.index(name), name, pa.array(values, pa.int64()))
        yield from rows.combine_chunks().to_batches()

    return rest.coalesce(1).mapInArrow(fit, rest.schema)


def pack_documents(df: DataFrame, vocabulary: str, spaced: bool, end_id: int, capacity: int, slack: int = SLACK, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode each whole text, append ``end_id``, cut and pack: ``id, start, length, ids_crc32, doc_tokens, class, sequence_id,
    offset`` and, if asked for, the piece's ``ids``.  Sequences hold at most ``capacity`` tokens, filled from 0 without gaps.

    Padding: at most ``slack`` tokens a text, less than k - 1 in a bin of class k from lengths that do not divide the capacity,
    and the last sequences of all.  Null texts count as empty, one piece of the end id alone; longer texts than ``capacity`` fill
    sequences of their own first; null ids and equal rows are texts of their own; other columns are not looked at; an empty
    table gives an empty result.

    Plan: texts are read once and never shuffled.  A worker holds fewer than k pieces of each class (some thousands), and only
    what is left there at its end is dealt by (class, bin), groups of k rows.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pieces = stored(_bins(docs, vocabulary, spaced, end_id, capacity, slack, with_ids), "harmonic-pieces")
    shared = stored(_shared_bins(pieces.filter("sequence_id IS NULL")), "harmonic-shared")
    last = _last_bins(shared.filter("sequence_id IS NULL"), capacity)
    out = pieces.filter("sequence_id IS NOT NULL").unionByName(shared.filter("sequence_id IS NOT NULL")).unionByName(last)
    return out.drop("worker", "place")
