"""Hidden Markov language model of words: Baum-Welch counts are summed over partitions, the scaled forward recursion gives
the exact likelihood of a text.

The model emits symbols: the most frequent words, classes of all other words by their last two bytes, and the end of a
text.  A word of a class has its add-0.1 share of the class, so probabilities of all texts sum to one over known words and
one unknown word per class.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelib.llm.store import stored
from tapelib.llm.text import SPACED, Chunk, chunks, mix

#: Latent states; words that are symbols of their own; classes of other words.
STATES, WORDS, CLASSES = 8, 8192, 256
#: Most frequent words whose counts are given to every task; counts of the others are joined.
HEAD = 65_536
#: Added to every count.
ADD = 0.1
#: Training texts are dealt into this many shares; the model is renewed after each share of a pass over all of them.
SHARES = 8
#: Passes end when one gains less than this in natural log-likelihood per token.
SETTLED = 0.002
#: Tokens that forward and backward values are worked out for in one go; what stands before and after is carried over.
SEGMENT = 512
_TOKENS = 300_000  # of which forward and backward values are held at once


def _words(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hash and class of each word."""
    last = c.data[c.ends - 1].astype(np.int64)
    before = np.where(c.ends - c.starts > 1, c.data[np.maximum(c.ends - 2, 0)], 0).astype(np.int64)
    return c.hashes(), (last * 31 + before * 131) % CLASSES


def count_words(texts: DataFrame) -> DataFrame:
    """``word`` (hash), ``class``, ``n`` over all rows of ``texts`` (column text), summed per batch before the shuffle."""
    def count(batches):
        for batch in batches:
            for c in chunks(batch.column("text"), SPACED, lower=True, limit=8 << 20):
                words, kind = _words(c)
                found, first, n = np.unique(words, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(kind[first].astype(np.int32)), pa.array(n)], ["word", "class", "n"])

    return texts.mapInArrow(count, "word long, class int, n long").groupBy("word", "class").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """Counts of the head and of the classes.  ``symbol`` of a head word: its rank below WORDS, else its class."""

    words: np.ndarray  # sorted hashes
    counts: np.ndarray
    symbol: np.ndarray
    class_total: np.ndarray  # tokens and types of words that are not symbols
    class_types: np.ndarray
    texts: int
    tokens: int
    types: int

    @property
    def end(self) -> int:
        return WORDS + CLASSES

    def class_log(self) -> np.ndarray:
        return np.log10(self.class_total + ADD * (self.class_types + 1))

    def unigram(self) -> np.ndarray:
        p = np.full(self.end + 1, ADD)
        np.add.at(p, self.symbol[self.symbol < WORDS], self.counts[self.symbol < WORDS])
        p[WORDS:self.end] += self.class_total
        p[self.end] += self.texts
        return p / p.sum()


def lexicon(counts: DataFrame, texts: int) -> Lexicon:
    """``counts`` is stored; at most HEAD + CLASSES rows and a histogram of counts come to the driver."""
    # the smallest count (above 64 in steps of a sixteenth of an octave) that no more than HEAD words reach
    step = F.when(F.col("n") <= 64, F.col("n")).otherwise(F.floor(F.log2("n") * 16) - 31)
    least, room = None, HEAD
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        room -= r["words"]
        if room < 0:
            break
        least = r["step"]
    head = counts.filter(step >= least if least is not None else F.lit(False)).toPandas().sort_values(["n", "word"], ascending=[False, True])
    classes = counts.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).toPandas()
    total, types = np.zeros(CLASSES), np.zeros(CLASSES)
    total[classes["class"]], types[classes["class"]] = classes.n, classes.types
    own = head.iloc[:WORDS]
    np.subtract.at(total, own["class"].to_numpy(dtype=np.int64), own.n.to_numpy(dtype=float))
    np.subtract.at(types, own["class"].to_numpy(dtype=np.int64), 1)
    rank = np.arange(len(head))
    symbol = np.where(rank < WORDS, rank, WORDS + head["class"].to_numpy(dtype=np.int64))
    keys = head.word.to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    return Lexicon(keys[order], head.n.to_numpy(dtype=float)[order], symbol[order], total, types, texts, int(classes.n.sum()) + texts, int(classes.types.sum()) + (texts > 0))


def _head(lex: Lexicon, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(lex.words):
        return np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=bool)
    at = np.searchsorted(lex.words, words)
    at[at == len(lex.words)] = 0
    return at, lex.words[at] == words


def _keys(ids: list, c: Chunk, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit key of a row by id and words; equal rows have equal keys."""
    total = np.concatenate(([np.uint64(0)], np.cumsum(words * (np.arange(len(words), dtype=np.uint64) * np.uint64(2) + np.uint64(1)))))
    start = np.concatenate(([np.uint64(0)], np.cumsum(words)))
    lo, hi = bounds[:-1], bounds[1:]
    # position weights counted from the row's own first word
    own = (total[hi] - total[lo]) - np.uint64(2) * lo.astype(np.uint64) * (start[hi] - start[lo])
    salt = np.array([zlib.crc32(repr(i).encode()) | zlib.adler32(repr(i).encode()) << 32 for i in ids], dtype=np.uint64)
    return mix(own ^ mix(salt))


def encode(docs: DataFrame, lex) -> DataFrame:
    """Rows (id, text, train) as symbols, with sums over the tokens whose counts every task has."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        known = lex.value
        z = known.class_log()
        for batch in batches:
            for c in chunks(batch.column("text"), SPACED, lower=True):
                words, kinds = _words(c)
                at, hit = _head(known, words)
                bounds = c.bounds()
                symbol = np.where(hit, known.symbol[at], WORDS + kinds) if len(known.words) else WORDS + kinds
                logs = np.where(hit, np.log10(known.counts[at] + ADD), 0.0) if len(known.words) else np.zeros(len(words))
                in_class = symbol >= WORDS
                n = np.diff(bounds)
                per = lambda w: np.bincount(c.row, weights=w, minlength=c.rows)  # noqa: E731, B023
                end = np.array([known.end], dtype="<u2").tobytes()
                raw = symbol.astype("<u2")
                rows = batch.slice(c.first, c.rows)
                out = [pa.array(_keys(rows.column("id").to_pylist(), c, words, bounds).view(np.int64)), pa.array([raw[bounds[r]:bounds[r + 1]].tobytes() + end for r in range(c.rows)], pa.binary()), pa.array(n + 1)]
                out += [pa.array(per(hit).astype(np.int64) + (known.texts > 0)), pa.array(per(logs) + np.log10(known.texts + ADD)), pa.array(per(np.where(in_class, logs - z[np.where(in_class, symbol - WORDS, 0)], 0.0)))]
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("train"), *out], ["id", "train", "key", "symbols", "n_tokens", "head_known", "head_log", "class_log"])

    return docs.mapInArrow(run, f"id {kind}, train boolean, key long, symbols binary, n_tokens long, head_known long, head_log double, class_log double")


def rare_words(docs: DataFrame, lex) -> DataFrame:
    """``key, word, n`` for the words of each row that are not in the head."""
    def run(batches):
        for batch in batches:
            for c in chunks(batch.column("text"), SPACED, lower=True):
                words, _ = _words(c)
                keys = _keys(batch.column("id").slice(c.first, c.rows).to_pylist(), c, words, c.bounds())
                rest = np.flatnonzero(~_head(lex.value, words)[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys[c.row[rest]].view(np.int64)), pa.array(words[rest].view(np.int64))], ["key", "word"])

    return docs.mapInArrow(run, "key long, word long")


# ---------------------------------------------------------------------------------------------------------------- model

@dataclass
class Hmm:
    start: np.ndarray  # (states)
    step: np.ndarray  # (states, states)
    emit: np.ndarray  # (symbols, states)

    def counts(self, sequences: list[np.ndarray], segment: int = SEGMENT) -> tuple[np.ndarray, float]:
        """Expected counts of sequences: rows of emissions by symbol, then of steps by state, then of starts; and the
        natural log-likelihood.

        Sequences above ``segment`` tokens are worked out in pieces, whose products of steps and emissions carry the exact
        state before and after each piece over the cuts; so counts are the same for any ``segment``.
        """
        m, k = self.emit.shape
        out, likelihood = np.zeros((m + k + 1, k)), 0.0
        pieces = [s[i:i + segment] for s in sequences for i in range(0, len(s), segment)]
        number = np.array([-(-len(s) // segment) for s in sequences], dtype=np.int64)
        heads = np.cumsum(number) - number
        first = np.zeros(len(pieces), dtype=bool)
        first[heads[number > 0]] = True
        before, after = np.zeros((len(pieces), k)), np.ones((len(pieces), k))
        if number.max(initial=0) > 1:
            self._carry(pieces, first, heads[number > 1], number[number > 1], before, after)
        order = np.argsort([-len(p) for p in pieces], kind="stable") if pieces else np.empty(0, dtype=np.int64)
        i = 0
        while i < len(order):
            j = min(len(order), i + max(1, _TOKENS // len(pieces[order[i]])))
            at = order[i:j]
            likelihood += self._expect([pieces[r] for r in at], first[at], before[at], after[at], out)
            i = j
        return out, likelihood

    @staticmethod
    def _columns(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sizes, symbols by (place, piece), and how many pieces reach each place; ``pieces`` are sorted by falling size."""
        size = np.array([len(p) for p in pieces])
        live = np.searchsorted(-size, -np.arange(size[0] + 1), side="left")
        at = np.zeros((size[0], len(pieces)), dtype=np.int64)
        for r, p in enumerate(pieces):
            at[:len(p), r] = p
        return size, at, live

    def _products(self, pieces: list[np.ndarray], first: np.ndarray) -> np.ndarray:
        """Per piece the product of steps and emissions, up to a factor: state before the piece to state at its end.  A first
        piece has no step before its first symbol."""
        k = len(self.start)
        _, at, live = self._columns(pieces)
        out = np.where(first[:, None, None], np.eye(k), self.step)
        for t in range(len(at)):
            n = live[t]
            a = out[:n] if t == 0 else (out[:n].reshape(n * k, k) @ self.step).reshape(n, k, k)
            a = a * self.emit[at[t, :n]][:, None, :]
            out[:n] = a / a.max(axis=(1, 2), keepdims=True) if t % 8 == 7 else a
        return out / out.max(axis=(1, 2), keepdims=True)

    def _carry(self, pieces, first, heads, number, before, after) -> None:
        """Fill ``before`` (state at the last token before a piece, given all up to it) and ``after`` (likelihood of what
        follows by state at its end, up to a factor) for the pieces of cut sequences."""
        k = len(self.start)
        mine = np.concatenate([np.arange(h, h + n) for h, n in zip(heads, number, strict=True)])
        mine = mine[np.argsort([-len(pieces[r]) for r in mine], kind="stable")]
        group = max(1, _TOKENS // len(pieces[mine[0]]))
        product = np.empty((len(pieces), k, k))
        for i in range(0, len(mine), group):
            at = mine[i:i + group]
            product[at] = self._products([pieces[r] for r in at], first[at])
        order = np.argsort(-number, kind="stable")
        heads, number = heads[order], number[order]
        most = int(number[0])
        live = np.searchsorted(-number, -np.arange(most), side="left")  # sequences with more than j pieces
        state = np.tile(self.start, (len(heads), 1))
        for j in range(most):
            at = heads[:live[j]] + j
            before[at] = state[:live[j]]
            state = np.einsum("ni,nij->nj", state[:live[j]], product[at])
            state /= state.sum(axis=1, keepdims=True)
        rest = np.ones((len(heads), k))
        for j in range(most - 1, -1, -1):
            at = heads[:live[j]] + j
            after[at] = rest[:live[j]]
            back = np.einsum("nij,nj->ni", product[at], rest[:live[j]])
            rest[:live[j]] = back / back.max(axis=1, keepdims=True)

    def _expect(self, pieces: list[np.ndarray], first: np.ndarray, before: np.ndarray, after: np.ndarray, out: np.ndarray) -> float:
        m, k = self.emit.shape
        size, at, live = self._columns(pieces)
        long = len(at)
        values, scales, a, tail = [], [], None, np.empty((len(pieces), k))
        for t in range(long):
            prior = np.where(first[:, None], self.start, before @ self.step) if t == 0 else a[:live[t]] @ self.step
            a = prior * self.emit[at[t, :live[t]]]
            s = a.sum(axis=1)
            a = a / s[:, None]
            tail[live[t + 1]:live[t]] = a[live[t + 1]:]  # of the pieces that end here
            values.append(a)
            scales.append(s)
        tail = after / (tail * after).sum(axis=1, keepdims=True)
        beta = tail[:live[long - 1]]
        for t in range(long - 1, -1, -1):
            back = beta * self.emit[at[t, :live[t]]] / scales[t][:, None]
            values[t] = values[t] * beta  # from here on: probability of each state given the whole sequence
            if t:
                out[m:m + k] += self.step * (values[t - 1][:live[t]].T @ back)
                beta = tail[:live[t - 1]].copy()
                beta[:live[t]] = back @ self.step.T
        out[m:m + k] += self.step * (before[~first].T @ back[~first])
        out[m + k] += values[0][first].sum(axis=0)
        symbols = np.concatenate([at[t, :live[t]] for t in range(long)])
        for state in range(k):
            out[:m, state] += np.bincount(symbols, weights=np.concatenate([v[:, state] for v in values]), minlength=m)
        return float(sum(np.log(s).sum() for s in scales))

    @classmethod
    def of_counts(cls, counts: np.ndarray, unigram: np.ndarray) -> Hmm:
        """Maximisation; every state keeps a little of the unigram, so that it can emit every symbol."""
        m, k = len(unigram), counts.shape[1]
        emit = counts[:m] + unigram[:, None]
        step = counts[m:m + k] + 0.1
        start = counts[m + k] + 0.1
        return cls(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def log10(self, sequences: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each whole sequence, by the scaled forward recursion over all of them in step."""
        size = np.array([len(s) for s in sequences], dtype=np.int64)
        order = np.argsort(-size, kind="stable")
        flat = np.concatenate([sequences[i] for i in order]).astype(np.int64) if len(sequences) else np.empty(0, dtype=np.int64)
        size = size[order]
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        out, a = np.zeros(len(size)), None
        for t in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -t, side="left"))
            a = (self.start if t == 0 else a[:n] @ self.step) * self.emit[flat[first[:n] + t]]
            s = a.sum(axis=1)
            a = a / s[:, None]
            out[:n] += np.log10(s)
        back = np.empty(len(size))
        back[order] = out
        return back


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype="<u2") for x in column.to_pylist()]


def train(encoded: DataFrame, unigram: np.ndarray, tokens: int) -> Hmm:
    """Baum-Welch over all rows of ``encoded`` (stored by ``share``; ``tokens`` in all), from seeded noise until it settles.

    A pass takes one share after the other: the share's expected counts, summed over its partitions, replace those that it
    gave in the pass before, and the model is renewed from the counts of all shares.  Each pass counts every row once.
    """
    m, k = len(unigram), STATES
    noise = np.random.default_rng(3).random((m, k)) + 0.5
    model = Hmm(np.full(k, 1 / k), np.full((k, k), 0.02 / (k - 1)) + np.eye(k) * (0.98 - 0.02 / (k - 1)), unigram[:, None] * noise / (unigram[:, None] * noise).sum(axis=0))
    names = [f"s{i}" for i in range(k)]
    shares = [np.zeros((m + k + 1, k)) for _ in range(SHARES)]  # WORDS + CLASSES + STATES + 2 rows each
    last = -np.inf
    while tokens:
        likelihood = 0.0
        for share in range(SHARES):
            shared = encoded.sparkSession.sparkContext.broadcast(model)  # (WORDS + CLASSES + 1) x STATES numbers

            def expect(batches, shared=shared):
                total, log = np.zeros((m + k + 1, k)), 0.0
                for batch in batches:
                    found, more = shared.value.counts(_sequences(batch.column("symbols")))
                    total += found
                    log += more
                used = np.flatnonzero(total.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1).astype(np.int32))] + [pa.array(np.append(total[used, i], log)) for i in range(k)], ["row", *names])

            rows = encoded.filter(F.col("share") == share).select("symbols")
            sums = rows.mapInArrow(expect, "row int, " + ", ".join(f"{n} double" for n in names)).groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
            likelihood += float(sums.loc[sums.row < 0, "s0"].sum())
            sums = sums[sums.row >= 0]
            shares[share] = np.zeros((m + k + 1, k))
            shares[share][sums.row] = sums[names].to_numpy()
            model = Hmm.of_counts(np.sum(shares, axis=0), unigram)
            shared.unpersist()
        if likelihood - last < SETTLED * tokens:
            break
        last = likelihood
    return model


def score(df: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``id, train, n_tokens, n_known, train_tokens, base_score, score``; learnt from rows for
    which ``training`` (a Column over ``id``) is true.

    Null texts count as empty: the end alone.  Null ids are ids like any other (``training`` null counts as false).
    Repeated rows get equal scores.  Without training rows every count is 0; an empty table gives no rows.  Texts of any
    length are counted and scored whole.  Other columns are not looked at.

    Plan: word counts of the whole corpus are summed and stored; counts of the most frequent words go to every task, those
    of all others are joined to the rows by word, where no word is frequent any more.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("train", F.coalesce(training, F.lit(False)))
    learning = docs.filter("train")
    counts = stored(count_words(learning.select("text")), "word-counts")
    lex = lexicon(counts, learning.select("id").count())
    shared = spark.sparkContext.broadcast(lex)  # HEAD entries
    encoded = stored(encode(docs, shared).withColumn("share", F.pmod(F.xxhash64("key"), F.lit(SHARES)).cast("int")), "symbols", "share")
    model = spark.sparkContext.broadcast(train(encoded.filter("train"), lex.unigram(), lex.tokens))

    def likelihood(batches):
        for batch in batches:
            names = [c for c in batch.schema.names if c != "symbols"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(model.value.log10(_sequences(batch.column("symbols"))))], [*names, "hmm"])

    kind = encoded.schema["id"].dataType.simpleString()
    scored = encoded.drop("share").mapInArrow(likelihood, f"id {kind}, train boolean, key long, n_tokens long, head_known long, head_log double, class_log double, hmm double")
    rare = rare_words(docs.select("id", "text"), shared).join(counts.select("word", "n"), "word", "left")
    rare = rare.groupBy("key").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + ADD)).alias("rare_log"), F.count("n").alias("rare_known"))
    copies = encoded.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    all_ = scored.join(rare.join(copies, "key"), "key", "left")
    rare_log = F.coalesce(F.col("rare_log") / F.col("copies"), F.lit(0.0))
    base = F.col("head_log") + rare_log - F.col("n_tokens") * float(np.log10(lex.tokens + ADD * (lex.types + 1)))
    return all_.select("id", "train", "n_tokens", (F.col("head_known") + F.coalesce(F.col("rare_known") / F.col("copies"), F.lit(0)).cast("long")).alias("n_known"),
                       F.lit(lex.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("hmm") + F.col("class_log") + rare_log).alias("score"))
