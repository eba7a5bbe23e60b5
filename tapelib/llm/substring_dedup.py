"""Substring dedup over the De Bruijn graph of word windows.

An edge is a window of 13 words.  Consecutive windows that share their minimizer (the smallest of the 4-word seeds in the
window) form a path without branches inside a document; equal paths of different documents are compacted into one by a
Spark aggregation.  Only paths whose seed occurs in two documents can hold a repeated window, and only one document of
each compacted path is expanded into windows again, to find windows that different paths share (where copies begin, end or
differ).  Every compacted path and window carries its source document and two hashes taken there (of the path and its seed,
or two of the window): documents and sources meet by the first, and words are removed only where the copy's own words give
the same sum (exclusive or) of both.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapelib.llm.store import stored
from tapelib.llm.text import SPACED, Chunk, _power, chunks, gram_hashes, mix

WINDOW, SEED = 13, 4
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Paths:
    """Paths of a chunk: row, first word, number of windows, hash of the seed, hash of all words."""

    row: np.ndarray
    first: np.ndarray
    windows: np.ndarray
    seed: np.ndarray
    path: np.ndarray


def paths(c: Chunk, words: np.ndarray) -> Paths:
    n = len(words) - WINDOW + 1
    if n <= 0:
        none = np.empty(0, dtype=np.int64)
        return Paths(none, none, none, *[none.view(np.uint64)] * 2)
    seeds = gram_hashes(words, SEED)
    least, at = seeds[:n].copy(), np.zeros(n, dtype=np.int64)
    for j in range(1, WINDOW - SEED + 1):
        other = seeds[j:n + j]
        less = other < least
        np.copyto(least, other, where=less)
        at[less] = j
    at += np.arange(n)
    valid = c.row[:n] == c.row[WINDOW - 1:]
    head = valid.copy()
    head[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    first = np.flatnonzero(head)
    number = np.cumsum(head) - 1
    windows = np.bincount(number[valid], minlength=len(first))
    m, size = len(words), windows + WINDOW - 1
    total = np.concatenate(([np.uint64(0)], np.cumsum(words * _power(2, False, m))))
    path = mix((total[first + size] - total[first]) * _power(2, True, m)[first] + size.astype(np.uint64) * _ODD)
    return Paths(c.row[first], first, windows, least[first], path)


def _paths_of(df: DataFrame) -> DataFrame:
    """Distinct paths of a batch with its smallest document, and whether it has several."""
    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            found = []
            for c in chunks(batch.column("text"), SPACED):
                p = paths(c, c.hashes())
                found.append((p.path, p.seed, ids[c.first + p.row]))
            if not found:
                continue
            path, seed, doc = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((doc, path))
            path, doc, seed = path[order], doc[order], seed[order]
            first = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1]))) if len(path) else np.empty(0, dtype=np.int64)
            last = np.concatenate((first[1:], [len(path)])) - 1 if len(path) else first
            yield pa.RecordBatch.from_arrays([pa.array(seed[first].view(np.int64)), pa.array(path[first].view(np.int64)), pa.array(doc[first]), pa.array(doc[first] < doc[last])], ["seed", "path", "low", "several"])

    return df.mapInArrow(run, "seed long, path long, low long, several boolean")


def _occurrences(df: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for c in chunks(batch.column("text"), SPACED):
                p = paths(c, c.hashes())
                yield pa.RecordBatch.from_arrays([pa.array(p.path.view(np.int64)), pa.array(ids[c.first + p.row])], ["path", "id"])

    return df.mapInArrow(run, "path long, id long")


def _windows_of(joined: DataFrame) -> DataFrame:
    """Windows of the paths that a document stands for, with its id and a second digest."""
    def run(batches):
        for batch in batches:
            ids, lists = batch.column("id").to_numpy(), batch.column("own")
            for c in chunks(batch.column("text"), SPACED):
                words = c.hashes()
                p = paths(c, words)
                edge = np.searchsorted(p.row, np.arange(c.rows + 1))
                chosen = np.zeros(len(p.row), dtype=bool)
                for r in range(c.rows):
                    own = lists[c.first + r].values.to_numpy(zero_copy_only=False).view(np.uint64)
                    chosen[edge[r]:edge[r + 1]] = np.isin(p.path[edge[r]:edge[r + 1]], own)
                first, n = p.first[chosen], p.windows[chosen]
                at = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum())) if len(first) else first
                window, check = gram_hashes(words, WINDOW), gram_hashes(words, WINDOW, seed=1)
                yield pa.RecordBatch.from_arrays([pa.array(window[at].view(np.int64)), pa.array(check[at].view(np.int64)), pa.array(ids[c.first + c.row[at]])], ["window", "check", "id"])

    return joined.mapInArrow(run, "window long, check long, id long")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word covered by a window whose words also start in a document with a smaller id.

    One row per row of ``df``: ``id, n_words, n_removed, kept_text`` (kept words joined by one space) ``, spans`` (removed
    word ranges [from, to)), ``kept_sha256``.  Ids are integers.  Null texts have no words; rows with a null id lose nothing
    and take nothing from others; rows that share an id take nothing from each other; repeated rows get equal results; a
    text of fewer than 13 words has no window.  Windows are judged on the input, not on what is left.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    real = docs.filter("id IS NOT NULL")
    # compaction: equal paths become one row; those whose seed is in one document only are dropped
    seeds = _paths_of(real).repartition("seed")
    by_seed = Window.partitionBy("seed")
    shared = seeds.withColumn("s_several", F.max("several").over(by_seed) | (F.min("low").over(by_seed) < F.max("low").over(by_seed))).filter("s_several")
    compact = shared.groupBy("seed", "path").agg(F.min("low").alias("low"), (F.max("several") | (F.min("low") < F.max("low"))).alias("several"))
    compact = stored(compact, "paths")
    # whole paths that a smaller document has
    copied = _occurrences(real).join(compact.filter("several").select("path", "seed", "low"), "path").filter("id > low").select("id", "path", "seed")
    whole = stored(copied.groupBy("id").agg(F.collect_set(F.col("path").bitwiseXOR(F.col("seed"))).alias("whole")), "copied-paths")
    # windows of one document for each compacted path
    own = compact.groupBy(F.col("low").alias("o_id")).agg(F.collect_list("path").alias("own"))
    texts = real.join(own.hint("shuffle_hash"), F.col("id") == F.col("o_id")).select("id", "text", "own")
    windows = _windows_of(texts)
    first = windows.groupBy("window", "check").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("window", "check", "low")
    single = windows.select("window", "id").join(first, "window").filter("id > low").groupBy("id").agg(F.collect_set(F.col("window").bitwiseXOR(F.col("check"))).alias("windows"))
    removal = whole.join(single, "id", "full_outer").select(F.col("id").alias("r_id"), "whole", "windows")
    # texts are dealt by id as for the windows above, so Spark shuffles them once for both joins
    marked = real.join(removal.hint("shuffle_hash"), F.col("id") == F.col("r_id"), "left").select("id", "text", "whole", "windows")
    none = F.lit(None).cast("array<long>")
    return _without(marked.union(docs.filter("id IS NULL").select("id", "text", none, none)))


def _without(joined: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            whole, single = batch.column("whole"), batch.column("windows")
            texts = batch.column("text")
            for c in chunks(texts, SPACED):
                bounds = c.bounds()
                hit = np.zeros(len(c.starts) + 1, dtype=np.int64)
                touched = [r for r in range(c.rows) if whole[c.first + r].is_valid or single[c.first + r].is_valid]
                if touched:
                    words = c.hashes()
                    p, window, check = paths(c, words), gram_hashes(words, WINDOW), gram_hashes(words, WINDOW, seed=1)
                    edge = np.searchsorted(p.row, np.arange(c.rows + 1))
                    for r in touched:
                        if whole[c.first + r].is_valid:
                            k = np.arange(edge[r], edge[r + 1])
                            k = k[np.isin(p.path[k] ^ p.seed[k], whole[c.first + r].values.to_numpy().view(np.uint64))]
                            np.add.at(hit, p.first[k], 1)
                            np.add.at(hit, p.first[k] + p.windows[k] + WINDOW - 1, -1)
                        if single[c.first + r].is_valid and bounds[r + 1] - bounds[r] >= WINDOW:
                            k = np.arange(bounds[r], bounds[r + 1] - WINDOW + 1)
                            k = k[np.isin(window[k] ^ check[k], single[c.first + r].values.to_numpy().view(np.uint64))]
                            np.add.at(hit, k, 1)
                            np.add.at(hit, k + WINDOW, -1)
                gone = np.cumsum(hit)[:-1] > 0
                removed, kept, spans, sums = [], [], [], []
                for r in range(c.rows):
                    words = c.data[c.offsets[r]:c.offsets[r + 1]].tobytes().split()  # the bytes that bytes.split() takes for white space
                    mask = gone[bounds[r]:bounds[r + 1]]
                    n = int(mask.sum())
                    text = b" ".join(compress(words, ~mask) if n else words)
                    removed.append(n)
                    kept.append(text)
                    sums.append(hashlib.sha256(text).hexdigest())
                    edge_ = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))) if n else ()
                    spans.append([[int(a), int(b)] for a, b in zip(edge_[::2], edge_[1::2], strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(c.first, c.rows), pa.array(np.diff(bounds), pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(sums)], ["id", "n_words", "n_removed", "kept_text", "spans", "kept_sha256"])

    return joined.mapInArrow(run, "id long, n_words long, n_removed long, kept_text string, spans array<array<int>>, kept_sha256 string")
