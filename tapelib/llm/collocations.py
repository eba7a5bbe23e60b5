"""Phrase collocations by dynamic itemset counting.

The texts are dealt to shards, which are scanned one after the other, round and round.  Words are counted from the first shard on.
A longer phrase starts with the shard after the one in which both its parts, without its last and without its first word, had
been seen often enough, so lengths are counted beside each other; it ends when it has seen each shard once.

Scans tell the active phrases by filters: one byte for each slot of phrase hashes, the step at which a phrase of that slot had been
seen often enough.  That step never changes, so the first step of every phrase above it is known to all tasks from then on.  Two
phrases in one slot can only start a phrase that is counted for nothing, never lose one.  The last scan reads the frequent
phrases as texts and counts those, so no result rests on hashes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapelib.llm.store import new_path, open_fs, put_file, stored
from tapelib.llm.text import SPACED, Chunk, chunks, gram_hashes, mix

#: Shards of the cyclic scan.
SHARDS = 4
#: Most slots of a filter, a byte each, whatever the corpus; beyond them more phrases are counted for nothing.
MOST_SLOTS = 1 << 26
#: Slots in one file of a filter.
BLOCK = 1 << 18
#: Bytes of text whose phrases are summed before they leave the task.
TEXT_BYTES = 3 << 20
#: Bytes of a shard's text for each part of the range of hashes; a part's counts are summed in one task's memory.
PART_BYTES = 2 << 20
#: Shares of a language that are ranked before the language is.
SHARES = 64
NEVER = 255

BREAKS = np.zeros(256, dtype=bool)  # [.,;:!?\x0A-\x0D]
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORDS = SPACED & ~BREAKS


def _languages(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Code of each row and the values of the codes."""
    codes = column.dictionary_encode()
    return codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), codes.dictionary.to_pylist()


def _joined(c: Chunk) -> np.ndarray:
    """Whether each word but the last is followed by the next one within the same piece."""
    piece = np.cumsum(BREAKS[c.data])[c.starts] if len(c.starts) else np.empty(0, dtype=np.int64)
    return (c.row[1:] == c.row[:-1]) & (piece[1:] == piece[:-1])


def _runs(joined: np.ndarray, size: int) -> np.ndarray:
    """Whether ``size`` words from each on lie in one piece."""
    inside = np.ones(max(0, len(joined) + 2 - size), dtype=bool)
    for k in range(size - 1):
        inside &= joined[k:len(joined) - size + 2 + k]
    return inside


class Filters:
    """Filters of one step, by phrase length, as written to ``path``; a task reads them when it first asks."""

    held: dict[str, dict[int, np.ndarray | None]] = {}  # of this worker

    def __init__(self, path: str | None, bits: int):
        self.path, self.bits = path, bits

    def _read(self, size: int) -> np.ndarray | None:
        fs, folder = open_fs(self.path)
        names = [f for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if f.base_name.startswith(f"{size}-")]
        if not names:
            return None
        slots = np.full(1 << self.bits, NEVER, dtype=np.uint8)
        for f in names:
            at = int(f.base_name.split("-")[1]) * BLOCK
            with fs.open_input_stream(f.path) as stream:
                part = np.frombuffer(zlib.decompress(stream.read()), dtype=np.uint8)
            slots[at:at + len(part)] = part
        return slots

    def steps(self, size: int, keys: np.ndarray) -> np.ndarray | None:
        """Step at which each phrase had been seen often enough (``NEVER``: not yet); ``None`` if none has."""
        if self.path is None:
            return None
        if self.path not in self.held:
            self.held.clear()
            self.held[self.path] = {}
        of = self.held[self.path]
        if size not in of:
            of[size] = self._read(size)
        return None if of[size] is None else of[size][keys >> np.uint64(64 - self.bits)]


def _keys(c: Chunk, lang_of: np.ndarray, languages: list[str]) -> np.ndarray:
    """Hash of each word together with its language."""
    salt = np.array([int.from_bytes(hashlib.md5(x.encode()).digest()[:8], "little") for x in languages], dtype=np.uint64)
    return mix(c.hashes() ^ salt[lang_of[c.first + c.row]]) if len(c.starts) else np.empty(0, dtype=np.uint64)


_COUNTS = "size int, began int, part long, keys binary, times binary"


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its times."""
    order = np.argsort(keys)
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, dtype=np.int64)
    return keys[first], np.add.reduceat(times, first) if len(first) else times


def _merged(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return _summed(np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in rows["keys"]]), np.concatenate([np.frombuffer(x, dtype=np.int64) for x in rows["times"]]))


def _count_step(texts: DataFrame, step: int, shards: int, longest: int, filters: Filters, part_bits: int) -> DataFrame:
    """Occurrences of the phrases active in ``step``: ``size, began, part, keys, times``, one row for each part of the range of
    hashes.  Rows carry arrays, so that millions of rare phrases are a few rows to shuffle."""
    def count(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang_of, languages = _languages(batch.column("lang"))
            for c in chunks(batch.column("text"), WORDS, lower=True, limit=TEXT_BYTES):
                words, joined, before = _keys(c, lang_of, languages), _joined(c), None
                for size in range(1, longest + 1):
                    keys, inside = gram_hashes(words, size) if size > 1 else words, _runs(joined, size)
                    if size == 1:
                        began = np.zeros(len(keys), dtype=np.int16)
                    else:
                        began = np.maximum(before[:-1], before[1:]) + np.int16(1)
                    active = inside & (began <= step) & (step < began + shards)
                    for b in np.unique(began[active]).tolist():
                        found, times = np.unique(keys[active & (began == b)], return_counts=True)
                        part = (found >> np.uint64(64 - part_bits)).astype(np.int64) if part_bits else np.zeros(len(found), dtype=np.int64)
                        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                        ends, n = np.append(starts[1:], len(found)).tolist(), len(starts)
                        spans = list(zip(starts.tolist(), ends, strict=True))
                        times = times.astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, size, np.int32)), pa.array(np.full(n, b, np.int32)), pa.array(part[starts]), pa.array([found[i:j].tobytes() for i, j in spans], pa.binary()), pa.array([times[i:j].tobytes() for i, j in spans], pa.binary())],
                                                         ["size", "began", "part", "keys", "times"])
                    steps = filters.steps(size, keys) if size < longest else None
                    if steps is None:
                        break
                    before = np.where(inside, steps, NEVER).astype(np.int16)

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        keys, times = _merged(rows)
        return pd.DataFrame({"size": rows["size"].iloc[:1], "began": rows["began"].iloc[:1], "part": rows["part"].iloc[:1], "keys": [keys.tobytes()], "times": [times.tobytes()]})

    return texts.mapInArrow(count, _COUNTS).groupBy("size", "began", "part").applyInPandas(add, _COUNTS)


def _often(counts: DataFrame, least: int, bits: int, whole: bool) -> DataFrame:
    """``size, slot`` of phrases counted ``least`` times: within each row of ``counts`` or, ``whole``, over all rows of a part."""
    def slots(size: int, keys: np.ndarray) -> pd.DataFrame:
        found = np.unique((keys >> np.uint64(64 - bits)).astype(np.int64))
        return pd.DataFrame({"size": np.full(len(found), size, dtype=np.int32), "slot": found})

    def of_part(rows: pd.DataFrame) -> pd.DataFrame:
        keys, times = _merged(rows)
        return slots(int(rows["size"].iloc[0]), keys[times >= least])

    def of_rows(batches):
        for rows in batches:
            for size, keys, times in zip(rows["size"], rows["keys"], rows["times"], strict=True):
                yield slots(size, np.frombuffer(keys, dtype=np.uint64)[np.frombuffer(times, dtype=np.int64) >= least])

    return counts.groupBy("size", "part").applyInPandas(of_part, "size int, slot long") if whole else counts.mapInPandas(of_rows, "size int, slot long")


def _write_filters(reached: list[DataFrame], folder: str, bits: int) -> dict[int, int]:
    """One file for each block of slots; the last step found at each phrase length."""
    block = min(BLOCK, 1 << bits)

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        slots = np.full(block, NEVER, dtype=np.uint8)
        slots[rows["at"]] = rows["step"]
        size, number = int(rows["size"].iloc[0]), int(rows["block"].iloc[0])
        put_file(folder, f"{size}-{number}", lambda out: out.write(zlib.compress(slots.tobytes(), 1)))
        return pd.DataFrame({"size": [size], "last": [int(rows["step"].max())]})

    rows = reached[0]
    for more in reached[1:]:
        rows = rows.unionByName(more)
    slots = rows.groupBy("size", "slot").agg(F.min("step").alias("step"))
    slots = slots.select("size", F.expr(f"slot div {block}").alias("block"), F.expr(f"slot % {block}").alias("at"), "step")
    last: dict[int, int] = {}
    for r in slots.groupBy("size", "block").applyInPandas(write, "size int, last int").collect():
        last[r["size"]] = max(r["last"], last.get(r["size"], -1))
    return last


def _remove(path: str) -> None:
    fs, folder = open_fs(path)
    if fs.get_file_info(folder).type == pafs.FileType.Directory:
        fs.delete_dir(folder)


def _itemset_filters(texts: DataFrame, bits: int, part_bits: int, longest: int, least: int, shards: int) -> Filters:
    """Filters of all phrases that occur ``least`` times, after as many steps as their counting takes."""
    spark = texts.sparkSession
    counts: dict[int, tuple[str, DataFrame]] = {}
    reached: list[DataFrame] = []
    filters, step, newest = Filters(None, bits), 0, 0
    while step < shards or step <= newest + shards:
        path = new_path(spark, "phrase-counts")
        found = _count_step(texts.filter(F.col("shard") == step % shards), step, shards, longest, filters, part_bits)
        found.write.partitionBy("size", "began").parquet(path)
        counts[step] = path, spark.read.schema(found.schema).parquet(path)
        often = _often(counts[step][1], least, bits, whole=False)
        began = step - shards + 1
        if began >= 0:  # phrases that have now seen each shard
            cycle = None
            for k in range(began, step + 1):
                one = counts[k][1].filter(F.col("began") == began)
                cycle = one if cycle is None else cycle.unionByName(one)
            often = often.unionByName(_often(cycle, least, bits, whole=True))
        reached.append(stored(often.distinct().withColumn("step", F.lit(step)), "phrases-reached"))
        before, filters = filters, Filters(new_path(spark, "phrase-filters"), bits)
        last = _write_filters(reached, filters.path, bits)
        newest = max([newest, *(k for size, k in last.items() if size < longest)])
        if before.path:
            _remove(before.path)
        if began >= 0:
            _remove(counts.pop(began)[0])
        step += 1
    for path, _ in counts.values():
        _remove(path)
    return filters


def _exact_counts(texts: DataFrame, filters: Filters, longest: int) -> DataFrame:
    """``lang, size, phrase, c`` of phrases that pass the filters, counted by their text; size 0 is all words of a language."""
    def count(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang_of, languages = _languages(batch.column("lang"))
            names = pa.array(languages, pa.string())
            for c in chunks(batch.column("text"), WORDS, lower=True, limit=TEXT_BYTES):
                n = len(c.starts)
                if not n:
                    continue
                words, joined, lang = _keys(c, lang_of, languages), _joined(c), lang_of[c.first + c.row]
                ends = np.concatenate([[0], np.cumsum(c.ends - c.starts)])
                kind, width = (pa.string(), np.int32) if ends[-1] < 1 << 31 else (pa.large_string(), np.int64)
                texts_ = pa.Array.from_buffers(kind, n, [None, pa.py_buffer(ends.astype(width).tobytes()), pa.py_buffer(c.data[WORDS[c.data]].tobytes())]).dictionary_encode()
                ids, known = texts_.indices.to_numpy().astype(np.int64), texts_.dictionary
                per_lang = np.bincount(lang, minlength=len(languages))
                yield _rows(names, pa.array(np.full(len(languages), "").astype(object), pa.string()), 0, per_lang)
                code = lang * len(known) + ids
                for size in range(1, longest + 1):
                    keys = gram_hashes(words, size) if size > 1 else words
                    if size > 1:
                        if len(code) and int(code.max()) >= (1 << 62) // len(known):
                            code = np.unique(code, return_inverse=True)[1]
                        code = code[:-1] * len(known) + ids[size - 1:]
                    steps = filters.steps(size, keys)
                    if steps is None:
                        break
                    at = np.flatnonzero(_runs(joined, size) & (steps != NEVER))
                    _, first, times = np.unique(code[at], return_index=True, return_counts=True)
                    at = at[first]
                    parts = [known.take(pa.array(ids[at + k])) for k in range(size)]
                    phrases = pc.binary_join_element_wise(*parts, pa.scalar(" ", kind)) if size > 1 else parts[0]
                    yield _rows(names.take(pa.array(lang[at])), phrases.cast(pa.string()), size, times)
                pa.default_memory_pool().release_unused()

    rows = texts.mapInArrow(count, "lang string, size int, phrase string, c long")
    return rows.groupBy("lang", "size", "phrase").agg(F.sum("c").alias("c"))


def _rows(lang: pa.Array, phrases: pa.Array, size: int, times: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(lang), size, np.int32)), phrases, pa.array(times.astype(np.int64))], ["lang", "size", "phrase", "c"])


def phrase_counts(df: DataFrame, longest: int = 3, least: int = 10, lang_col: str = "lang", text_col: str = "text", shards: int = SHARDS, most_slots: int = MOST_SLOTS) -> DataFrame:
    """Phrases of 1 to ``longest`` words that occur ``least`` times in a language: ``lang, size, phrase, c``; rows of size 0 give
    all words of a language, frequent or not.

    Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` and then into words at spaces and tabs; phrases do not cross pieces.
    A null language is ``und``, a null text has no words, equal rows count each, very long texts are read whole, other columns
    are not looked at; an empty table gives an empty result.

    Plan: texts are written once by shard; each is read as often as its phrases of different lengths start late, at most once a
    length, and once at the end.  Arrays of hashes and counts are shuffled by parts of the range of hashes, whose number grows
    with the texts; a phrase is one entry for 3 MB of text, so frequent phrases are no hot keys.
    Counts of a step are removed once all its phrases have seen every shard.
    """
    spark = df.sparkSession
    path = new_path(spark, "phrase-texts")
    texts = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("n_bytes", F.octet_length("text")).withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int"))
    texts.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    texts = spark.read.schema(texts.schema).parquet(path)
    n_bytes = texts.agg(F.sum("n_bytes")).first()[0] or 0
    bits = max(12, min(most_slots, n_bytes // 16).bit_length() - 1)
    part_bits = max(0, n_bytes // shards // PART_BYTES).bit_length()
    texts = texts.select("lang", "text", "shard")
    filters = _itemset_filters(texts, bits, part_bits, longest, least, shards)
    counts = stored(_exact_counts(texts.drop("shard"), filters, longest).filter((F.col("c") >= least) | (F.col("size") == 0)), "phrases")
    _remove(filters.path)
    _remove(path)
    return counts


def collocations(counts: DataFrame, longest: int = 3, most: int = 2000, cover: int = 50) -> DataFrame:
    """Ranks the phrases of two words and more of :func:`phrase_counts`, a stored table: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase is cut in two where ``floor(1000000 * a * a / (l * r))`` is lowest, first such cut; phrases that lie within a longer one
    of which there are ``cover`` percent as many are dropped; the first ``most`` of a language stay, ties by ``a`` and then bytewise.
    """
    words = F.split("phrase", " ")
    phrases = counts.filter("size >= 2")
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1))
    cuts = phrases.select("lang", "phrase", "size", F.col("c").alias("a"), words.alias("words"), cut.alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("words", F.col("k") + 1, F.col("size")), " ").alias("right"))
    parts = counts.filter(f"size BETWEEN 1 AND {longest - 1}").select("lang", "phrase", "c")
    for side in ("left", "right"):  # stored between, so that each join has two plain exchanges and a hot word can be split
        cuts = stored(cuts.join(parts.select("lang", F.col("phrase").alias(side), F.col("c").alias(side[0])), ["lang", side]).drop(side), "phrase-cuts")
    whole = "cast({} AS decimal(19, 0))".format
    score = F.expr(f"(cast(1000000 AS decimal(7, 0)) * ({whole('a')} * {whole('a')})) div ({whole('l')} * {whole('r')})")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))

    spans = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " ")))))
    longer = counts.filter("size >= 3").withColumn("words", words).select("lang", spans.alias("phrase"), "c")
    longer = longer.groupBy("lang", "phrase").agg(F.max("c").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(F.expr(f"longer IS NULL OR 100 * longer < {cover} * a"))
    order = [F.col("best.score").desc(), F.col("a").desc(), "phrase"]
    share = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    first = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= most)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= most)
    totals = counts.filter("size = 0").select("lang", F.col("c").alias("n"))
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")
