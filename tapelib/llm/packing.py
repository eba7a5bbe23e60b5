"""Packing of token sequences by patterns: non-negative least squares fits how often each short pattern of length classes
is used, the counts are rounded, and what is left is packed by best fit on exact lengths.

Only the histogram of lengths (at most ``capacity`` rows) goes to the driver; the plan is made from it and has as many
entries whatever the corpus; documents are dealt to the plan's places by their rank among pieces of the same length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapelib.llm.encode import encoder

#: Classes of lengths, and most documents in a pattern that least squares fits.
CLASSES, PARTS = 64, 4


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |ax - b|: active sets, least squares over the passive columns."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    tol = 1e-9 * max(1.0, float(np.abs(b).max(initial=0.0))) * a.shape[0]
    for _ in range(4 * a.shape[0]):
        gradient = a.T @ (b - a @ x)
        gradient[passive] = -np.inf
        k = int(gradient.argmax())
        if gradient[k] <= tol:
            break
        passive[k] = True
        while True:
            z = np.zeros_like(x)
            z[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            low = passive & (z <= 0)
            if not low.any():
                break
            step = (x[low] / np.maximum(x[low] - z[low], 1e-300)).min()
            x = x + step * (z - x)
            passive &= x > 1e-12 * max(1.0, float(x.max()))
            x[~passive] = 0
        x = z
    return x


def patterns(classes: int = CLASSES, parts: int = PARTS) -> list[tuple[int, ...]]:
    """Non-increasing tuples of 2 to ``parts`` length classes whose middles add up to the capacity.  The last one has room
    whatever the lengths of the others in their classes."""
    out = []

    def grow(done: tuple[int, ...], left: int, p: int) -> None:
        if p == 1:
            if left >= 1 and left <= done[-1] and left >= (len(done) + 1) // 2:
                out.append((*done, left))
            return
        for k in range(min(left - (p - 1), done[-1] if done else classes), 0, -1):
            grow((*done, k), left - k, p - 1)

    for p in range(2, parts + 1):
        grow((), classes + p // 2, p)
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of the sequences that hold every piece of the histogram; their number follows the number of
    different lengths, not of pieces."""
    left = {n: c for n, c in histogram.items() if c}
    done = [((capacity,), left.pop(capacity))] if capacity in left else []
    classes = min(CLASSES, capacity)
    width = -(-capacity // classes)
    have = np.zeros(classes + 1)
    for n, c in left.items():
        have[-(-n // width)] += c
    shapes = patterns(classes)
    fit = np.zeros((classes + 1, len(shapes)))
    for j, shape in enumerate(shapes):
        for k in shape:
            fit[k, j] += 1
    repeats = np.floor(nnls(fit, have) + 1e-6).astype(int) if shapes else []
    pools = {k: sorted(n for n in left if -(-n // width) == k) for k in range(1, classes + 1)}
    open_bins: dict[int, list[list]] = defaultdict(list)  # room -> [lengths, repeats]

    def take(k: int, want: int, largest: bool) -> list[list[int]]:
        runs, pool = [], pools[k]
        while want and pool:
            n = pool[-1 if largest else 0]
            got = min(want, left[n])
            runs.append([n, got])
            want -= got
            left[n] -= got
            if not left[n]:
                pool.pop(-1 if largest else 0)
                del left[n]
        return runs

    for j in np.argsort(-np.asarray(repeats), kind="stable"):
        if repeats[j] < 1:
            break
        bins: list[list] = [[(), int(repeats[j])]]
        for i, k in enumerate(shapes[j][:-1]):  # long with short of their classes, so that the room left varies little
            runs, merged = take(k, sum(c for _, c in bins), largest=i % 2 == 0), []
            for lengths, c in bins:
                while c and runs:
                    got = min(c, runs[0][1])
                    merged.append([(*lengths, runs[0][0]), got])
                    c -= got
                    runs[0][1] -= got
                    if not runs[0][1]:
                        runs.pop(0)
                if c and lengths:
                    merged.append([lengths, c])
            bins = merged
        for lengths, c in bins:
            open_bins[capacity - sum(lengths)].append([lengths, c])

    rooms = sorted(open_bins)
    for n in sorted(left, reverse=True):
        want = left[n]
        while want:
            at = bisect.bisect_left(rooms, n)
            if at == len(rooms):
                fits = capacity // n
                full, some = divmod(want, fits)
                for times, c in ((fits, full), (some, 1)):
                    if times and c:
                        _open(open_bins, rooms, capacity - times * n, [(n,) * times, c])
                break
            room = rooms[at]
            group = open_bins[room][-1]
            got = min(want, group[1])
            group[1] -= got
            want -= got
            lengths = (*group[0], n)
            if not group[1]:
                open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
            _open(open_bins, rooms, room - n, [lengths, got])
    return done + [(lengths, c) for groups in open_bins.values() for lengths, c in groups]


def _open(open_bins: dict, rooms: list[int], room: int, group: list) -> None:
    if room not in open_bins:
        bisect.insort(rooms, room)
    open_bins[room].append(group)


def token_pieces(df: DataFrame, vocabulary: str, spaced: bool, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode each whole text, append ``end_id`` and cut what is longer than ``capacity``: ``id, piece, start, length,
    ids_crc32`` and, if asked for, ``ids``.  Null texts count as empty: one piece of the end id alone."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def cut(batches):
        code = encoder(vocabulary, spaced)
        for batch in batches:
            texts = code.encode(batch.column("text"))
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, pieces, starts, lengths, sums, ids = [], [], [], [], [], []
                for row, tokens in enumerate(islice(texts, part.num_rows)):
                    tokens = np.append(tokens, code.kind.type(end_id)).astype("<u4")
                    for k, lo in enumerate(range(0, len(tokens), capacity)):
                        one = tokens[lo:lo + capacity]
                        rows.append(row)
                        pieces.append(k)
                        starts.append(lo)
                        lengths.append(len(one))
                        sums.append(zlib.crc32(one.tobytes()))
                        if with_ids:
                            ids.append(one.astype(np.int32))
                out = [part.column("id").take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return docs.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``id, piece, length`` (1 to ``capacity``): sequences of at most
    ``capacity`` tokens, filled from 0 without gaps.  Equal rows get places of their own; an empty table stays empty.

    ``pieces`` is read twice and should be a stored table.  Ranks among pieces of one length are counted in salts of that
    length, so a length that a third of all pieces have is dealt over many tasks.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    lengths, firsts, bases, offsets, next_rank, base = [], [], [], [], defaultdict(int), 0
    for pattern, repeats in plan(histogram, capacity):
        at = 0
        for n in pattern:
            lengths.append(n)
            firsts.append(next_rank[n])
            bases.append(base)
            offsets.append(at)
            next_rank[n] += repeats
            at += n
        base += repeats
    order = np.lexsort((firsts, lengths)) if lengths else np.empty(0, dtype=int)
    codes = (np.array(lengths, dtype=np.int64)[order] << 44) + np.array(firsts, dtype=np.int64)[order]
    shift = np.array(bases, dtype=np.int64)[order] - np.array(firsts, dtype=np.int64)[order]
    offset = np.array(offsets, dtype=np.int64)[order]
    slots = pieces.sparkSession.sparkContext.broadcast((codes, shift, offset))

    salts = max(64, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("length", "__salt", (F.sum("__n").over(Window.partitionBy("length").orderBy("__salt")) - F.col("__n")).alias("__before"))
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__salt").orderBy("id", "piece")))
    ranked = ranked.join(before, ["length", "__salt"]).withColumn("__rank", F.col("__before") + F.col("__rank") - 1).select(*pieces.columns, "__rank")

    def place(batches):
        codes, shift, offset = slots.value
        for batch in batches:
            rank = batch.column("__rank").to_numpy()
            at = np.searchsorted(codes, (batch.column("length").to_numpy() << 44) + rank, side="right") - 1
            names = [c for c in batch.schema.names if c != "__rank"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(shift[at] + rank, pa.int64()), pa.array(offset[at], pa.int64())], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")
