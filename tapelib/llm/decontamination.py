"""Benchmark decontamination by FM-indexes of the training text.

Each shard of documents is indexed as a string of words: the suffix order gives the Burrows-Wheeler transform, a wavelet
matrix over it answers ranks, test phrases are found by backward search (all phrases of a block in step), occurrences are
located by walking to sampled suffix positions, and overlapping occurrences are merged into removal spans.
"""

from __future__ import annotations

import io
import posixpath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelib.llm.store import new_path, open_fs, put_file
from tapelib.llm.text import ALNUM, chunks
from tapelib.llm.worker import kept

#: Words in a phrase; a benchmark item of fewer words is one phrase.
WINDOW = 13
#: Phrases that are searched together; more are searched block by block in the same shard.
BLOCK_PHRASES = 100_000
#: Bytes of text in a shard; a longer document is a shard of its own.
SHARD_BYTES = 4 << 20
#: Every so many suffix positions one is kept.
SAMPLE = 8


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.zeros, self.ones = [], []  # per level: count of zeros, ones before each position
        for shift in range(self.bits - 1, -1, -1):
            bit = (symbols >> shift) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))
        self.first = self._down(np.arange(sigma), np.zeros(sigma, dtype=np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (zeros, ones) in enumerate(zip(self.zeros, self.ones, strict=True)):
            bit = (symbols >> (self.bits - 1 - k)) & 1
            before = ones[at]
            at = np.where(bit == 1, zeros + before, at - before)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        return self._down(symbols, at) - self.first[symbols]

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), dtype=np.int64)
        for zeros, ones in zip(self.zeros, self.ones, strict=True):
            before = ones[at]
            bit = ones[at + 1] - before
            out = 2 * out + bit
            at = np.where(bit == 1, zeros + before, at - before)
        return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array; every 0 ends a run and counts as a symbol of its own, smaller than all words."""
    n = len(text)
    ends = text == 0
    rank = np.where(ends, np.cumsum(ends) - 1, text + int(ends.sum()))
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        later = np.zeros(n, dtype=np.int64)
        later[:n - step] = rank[step:] + 1
        key = rank * (n + 2) + later
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        rank[order] = new
        if n == 0 or new[-1] == n - 1:
            return order
        step *= 2
        if step >= n:
            return order


class FMIndex:
    """``text``: runs of symbols 1 .. sigma - 1, each ended by a 0."""

    def __init__(self, text: np.ndarray, sigma: int):
        order = suffix_order(text)
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        self.ranks = WaveletMatrix(text[order - 1], sigma)
        # sampled positions; run starts are always among them, so no walk has to cross a 0
        kept = (order % SAMPLE == 0) | (text[order - 1] == 0)
        self.kept, self.kept_before, self.kept_at = kept, np.concatenate(([0], np.cumsum(kept))), order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the rows of ``phrases`` (all of one length)."""
        last = phrases[:, -1]
        lo, hi = self.counts[last].astype(np.int64), self.counts[last + 1].astype(np.int64)
        live = np.flatnonzero(lo < hi)
        for k in range(phrases.shape[1] - 2, -1, -1):
            c = phrases[live, k]
            lo[live] = self.counts[c] + self.ranks.rank(c, lo[live])
            hi[live] = self.counts[c] + self.ranks.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        dead = np.ones(len(lo), dtype=bool)
        dead[live] = False
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks."""
        out, walked, live, rows = np.zeros(len(rows), dtype=np.int64), 0, np.arange(len(rows)), rows.copy()
        while len(live):
            done = self.kept[rows]
            out[live[done]] = self.kept_at[self.kept_before[rows[done]]] + walked
            live, rows = live[~done], rows[~done]
            c = self.ranks.access(rows)
            rows = self.counts[c] + self.ranks.rank(c, rows)
            walked += 1
        return out


def write_phrases(benchmark: DataFrame, folder: str, id_col: str = "item_id", text_col: str = "text") -> int:
    """Write the phrases of all items in blocks (all rows of one phrase in the same block); returns how many blocks."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("text"))

    def cut(batches):
        for batch in batches:
            for c in chunks(batch.column("text"), ALNUM, lower=True):
                hashes, bounds, rows, out = c.hashes(), c.bounds(), [], []
                for r in range(c.rows):
                    words = hashes[bounds[r]:bounds[r + 1]]
                    for k in range(max(len(words) - WINDOW + 1, min(1, len(words)))):
                        rows.append(c.first + r)
                        out.append(words[k:k + WINDOW].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(rows, pa.int64())), pa.array(out, pa.binary())], ["item", "words"])

    phrases = items.mapInArrow(cut, "item string, words binary").distinct()
    blocks = -(-phrases.count() // BLOCK_PHRASES)

    def write(key, rows):
        raw, item = rows.column("words").to_pylist(), rows.column("item").to_pylist()
        phrase = {w: i for i, w in enumerate(dict.fromkeys(raw))}
        words = [np.frombuffer(w, dtype=np.uint64) for w in phrase]
        vocabulary = np.unique(np.concatenate(words))
        names = np.array(sorted(set(item)))
        lengths = np.array([len(w) for w in words])
        padded = np.zeros((len(words), WINDOW), dtype=np.int32)
        for i, w in enumerate(words):
            padded[i, :len(w)] = np.searchsorted(vocabulary, w) + 1
        buf = io.BytesIO()
        np.savez(buf, vocabulary=vocabulary, lengths=lengths, phrases=padded, names=names, of_phrase=np.array([phrase[w] for w in raw]), of_item=np.searchsorted(names, item))
        put_file(folder, f"phrases-{key[0].as_py():06d}.npz", lambda out: out.write(buf.getvalue()))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32())})

    if blocks:
        phrases.groupBy(F.pmod(F.xxhash64("words"), F.lit(blocks)).cast("int").alias("block")).applyInArrow(write, "block int").count()
    return blocks


class _Blocks:
    """The blocks of phrases, read one at a time; a single block stays in memory."""

    def __init__(self, folder: str, count: int):
        self.fs, self.base, self.only = None, None, None
        self.folder, self.count = folder, count

    def __iter__(self):
        if self.only:
            yield self.only
            return
        fs, base = open_fs(self.folder)
        for info in fs.get_file_info([posixpath.join(base, f"phrases-{k:06d}.npz") for k in range(self.count)]):
            if info.is_file:
                with fs.open_input_stream(info.path) as f:
                    block = dict(np.load(io.BytesIO(f.read()), allow_pickle=False))
                block["order"] = np.argsort(block["of_phrase"], kind="stable")
                block["at"] = np.searchsorted(block["of_phrase"][block["order"]], np.arange(len(block["lengths"]) + 1))
                if self.count == 1:
                    self.only = block
                yield block


def _hits(hashes: np.ndarray, row: np.ndarray, block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word position, phrase, length) of every occurrence of the block's phrases in a shard."""
    vocabulary, lengths = block["vocabulary"], block["lengths"]
    at = np.searchsorted(vocabulary, hashes)
    at[at == len(vocabulary)] = 0
    known = vocabulary[at] == hashes if len(vocabulary) else np.zeros(len(hashes), dtype=bool)
    # runs of benchmark words within a document; one shorter than the shortest phrase cannot hold any
    breaks = np.ones(len(hashes), dtype=bool)
    breaks[1:] = ~known[1:] | ~known[:-1] | (row[1:] != row[:-1])
    run = np.cumsum(breaks) - 1
    size = np.bincount(run[known], minlength=len(hashes) and int(run[-1]) + 1)
    word = np.flatnonzero(known & (size[run] >= lengths.min())) if len(hashes) else np.empty(0, dtype=np.int64)
    if not len(word):
        return word, word, word
    number = np.cumsum(np.concatenate(([0], run[word][1:] != run[word][:-1])))
    place = np.arange(len(word)) + number
    text = np.zeros(len(word) + int(number[-1]) + 1, dtype=np.int64)
    text[place] = at[word] + 1
    word_at = np.zeros(len(text), dtype=np.int64)
    word_at[place] = word
    index = FMIndex(text, len(vocabulary) + 1)
    found = []
    for n in np.unique(lengths):
        which = np.flatnonzero(lengths == n)
        lo, hi = index.search(block["phrases"][which, :n].astype(np.int64))
        some = np.flatnonzero(hi > lo)
        counts = (hi - lo)[some]
        rows = np.repeat(lo[some] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(int(counts.sum()))
        found.append((word_at[index.locate(rows)], np.repeat(which[some], counts), np.full(len(rows), n)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def find_phrases(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Each row of ``df`` as the struct ``doc``, with ``n_words, n_hit``, ``items`` (ids of items with occurring phrases, as
    strings, sorted) and ``spans`` (word ranges [from, to) to remove, merged).

    A-Z count as lower case; words are runs of letters, digits and non-ASCII characters.  Null and empty texts have no
    words and no hits; an item without words has no phrase; a null item id is named "null"; repeated rows and items change
    nothing; an empty benchmark hits nothing.  Documents never move: every task indexes its own shards.
    """
    folder = new_path(df.sparkSession, "phrases")
    blocks = _Blocks(folder, write_phrases(benchmark, folder, item_id, item_text))
    wrapped = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"), F.col(text_col).alias("text"))

    def find(batches):
        kept("decontamination")
        for batch in batches:
            for c in chunks(batch.column("text"), ALNUM, lower=True, limit=SHARD_BYTES):
                hashes, bounds = c.hashes(), c.bounds()
                change = np.zeros(len(hashes) + 1, dtype=np.int64)
                items: list[set] = [set() for _ in range(c.rows)]
                for block in blocks:
                    at, phrase, n = _hits(hashes, c.row, block)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + n, -1)
                    pairs = np.unique(np.stack((c.row[at], phrase), axis=1), axis=0) if len(at) else np.empty((0, 2), dtype=int)
                    for r, p in pairs:
                        items[r].update(block["names"][block["of_item"][block["order"][block["at"][p]:block["at"][p + 1]]]].tolist())
                hit = np.cumsum(change)[:-1] > 0
                n_hit = np.concatenate(([0], np.cumsum(hit)))[bounds]
                n_hit = n_hit[1:] - n_hit[:-1]
                spans = [_spans(hit[bounds[r]:bounds[r + 1]]) if n_hit[r] else [] for r in range(c.rows)]
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(c.first, c.rows), pa.array(np.diff(bounds), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int32())))], ["doc", "n_words", "n_hit", "items", "spans"])

    return wrapped.mapInArrow(find, f"doc {wrapped.schema['doc'].dataType.simpleString()}, n_words long, n_hit long, items array<string>, spans array<array<int>>")


def _spans(hit: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [[int(a), int(b)] for a, b in zip(edge[::2], edge[1::2], strict=True)]


def contaminated():
    """The rule over columns of :func:`find_phrases`: one word in twenty or more is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def sha256_of_items():
    return F.sha2(F.array_join("items", ","), 256)
