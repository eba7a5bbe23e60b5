"""Toxicity by class-conditional Kneser-Ney bigram models: the log-likelihoods of a text under a model of toxic and one of
ordinary texts are compared per word.  Both back off to the same, shared continuation counts.  All words and pairs of the
labelled texts count; what chance makes of rare ones is taken off by discounts and by a fit on held-out texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelib.llm.store import new_path, open_fs, stored
from tapelib.llm.text import LETTERS, Chunk, chunks, gram_hashes
from tapelib.llm.worker import kept

#: Labelled documents of each class that the models are learnt from: the smallest by a hash of the id.  The bound keeps
#: the join with the documents a broadcast (24 bytes a row); labels beyond it only count in the share of each class.
LABELLED = 20_000
#: Expressions seen so often at least, in both classes together, are kinds of evidence of their own, from the surest on.
OFTEN = (50, 3)
#: A word is sure evidence after so many different words.
KNOWN = 3
#: Where there are too few counts to work discounts out.
DISCOUNT = 0.75
#: One labelled document in so many is kept from the counts and fits the score instead.
FOLDS = 4
#: Log ratio above which a word counts as leaning to toxic.
LEANING = 3.0
#: Bytes of text that a worker looks at once: some sixty numbers a word are held meanwhile, beside the model's tables.
AT_ONCE = 1 << 18


def _expressions(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes; and for each word with one before it: that word, itself, the pair."""
    words = c.hashes()
    pair = gram_hashes(words, 2)
    inside = c.row[1:] == c.row[:-1] if len(words) else np.empty(0, dtype=bool)
    return words, words[:-1][inside], words[1:][inside], pair[inside]


def _counts(labelled: DataFrame) -> DataFrame:
    """Pairs of words in each class, summed within a batch before they are shuffled."""
    def count(batches):
        kept("toxicity")
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for c in chunks(batch.column("text"), LETTERS, lower=True, limit=AT_ONCE):
                words, before, word, pair = _expressions(c)
                of = toxic[c.first + c.row[1:][c.row[1:] == c.row[:-1]]] if len(words) else np.empty(0, dtype=np.int64)
                found, first, back = np.unique(pair, return_index=True, return_inverse=True)
                n, t = np.bincount(back, minlength=len(found)), np.bincount(back, weights=of, minlength=len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (found, before[first], word[first])] + [pa.array(t), pa.array(n - t)], ["pair", "before", "word", "toxic", "plain"])

    rows = labelled.mapInArrow(count, "pair long, before long, word long, toxic long, plain long")
    return rows.groupBy("pair", "before", "word").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))


def _table(path: str, columns: list[str]) -> tuple[np.ndarray, ...]:
    """Columns of a written table, sorted by the first; the first as 64-bit hashes, the others in 32 bits.  The worker keeps
    the tables of the last model: many tasks, one reading."""
    read = kept("toxicity")
    if path not in read:
        fs, folder = open_fs(path)
        files = list(ds.dataset(folder, filesystem=fs, format="parquet").get_fragments())
        ends = np.cumsum([0, *(f.count_rows() for f in files)])

        def parts(c):  # one file at a time, to hold little besides the columns
            for f, start, end in zip(files, ends, ends[1:]):
                yield slice(start, end), f.to_table(columns=[c]).column(0).to_numpy()

        keys = np.empty(ends[-1], dtype=np.uint64)
        for at, x in parts(columns[0]):
            keys[at] = x.view(np.uint64)
        order = np.argsort(keys)
        keys = keys[order]
        place = np.empty(ends[-1], dtype=np.uint32)
        place[order] = np.arange(ends[-1], dtype=np.uint32)
        del order
        out = [keys, *(np.empty(ends[-1], dtype=np.float32) for _ in columns[1:])]
        for y, c in zip(out[1:], columns[1:]):
            for at, x in parts(c):
                y[place[at]] = x
        read[path] = tuple(out)
        pa.default_memory_pool().release_unused()
    return read[path]


def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each asked key and whether it is there; sorted first, so that the searches stay near one another."""
    asked, back = np.unique(asked, return_inverse=True)
    at = np.searchsorted(keys, asked)
    at[at == len(keys)] = 0
    return at[back], (keys[at] == asked)[back]


class Model:
    """Kneser-Ney counts of all words and word pairs of the labelled texts, in tables of the shared folder (``None``: no
    texts of both classes), with discounts, and weights of the score."""

    WIDTH = 2 + 3 * (len(OFTEN) + 1)

    def __init__(self, tables: tuple[str, str, str] | None = None, totals=None, word_cut: np.ndarray | None = None, pair_cut: np.ndarray | None = None):
        self.tables, self.totals, self.word_cut, self.pair_cut = tables, totals, word_cut, pair_cut
        self.weights = np.zeros(self.WIDTH)

    def _ratios(self, c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: its own log ratio, the one given the word before it, the part of that which is only the weight of
        backing off, and the kinds of evidence of the first two (0: the surest)."""
        words, before, _, pair = _expressions(c)
        second = np.flatnonzero(np.append(False, c.row[1:] == c.row[:-1]))
        read = kept("toxicity")
        if any(path not in read for path in self.tables):
            read.clear()
        keys, *seen = _table(self.tables[0], ["word", "toxic", "plain"])
        at, known = _find(keys, words)
        lower, rest = [], []
        for k, n in enumerate(seen):
            n = np.where(known, n[at], 0)
            rest.append(self.word_cut[k] @ self.totals[k][1:] / self.totals[k][0])
            lower.append((n - _cut(self.word_cut[k], n)) / self.totals[k][0] + rest[k] * np.where(known, seen[0][at] + seen[1][at], 1) / (self.totals[0][0] + self.totals[1][0]))
        ratio, back = np.log(lower[0] / lower[1]), np.zeros(len(words))
        ratio[~known] = 0
        kind = np.where(known & (seen[0][at] + seen[1][at] < KNOWN), len(OFTEN), 0)
        back[~known] = np.log(rest[0] / rest[1])
        keys, *of_before = _table(self.tables[1], ["before", "toxic", "plain", "toxic_cut", "plain_cut"])
        at, led = _find(keys, before)
        total, cut = [np.where(led, x[at], 0) for x in of_before[:2]], [np.where(led, x[at], 0) for x in of_before[2:]]
        weight = [np.where(t > 0, d / np.where(t > 0, t, 1), 1) for t, d in zip(total, cut)]
        keys, *times = _table(self.tables[2], ["pair", "toxic", "plain"])
        at, hit = _find(keys, pair)
        back[second] += np.where(hit, 0, np.log(weight[0] / weight[1]))
        times = [np.where(hit, x[at], 0) for x in times]
        given = [(n - _cut(self.pair_cut[k], n)) / np.where(total[k] > 0, total[k], 1) + weight[k] * lower[k][second] for k, n in enumerate(times)]
        full, of_full = ratio.copy(), kind.copy()
        full[second] = np.where(hit, np.log(given[0] / given[1]), ratio[second])
        of_full[second] = np.where(hit, sum(times[0] + times[1] < n for n in OFTEN), kind[second])
        return ratio, full, back, kind, of_full

    def features(self, c: Chunk) -> np.ndarray:
        """Sums by kind of evidence, so that the fit on held-out texts says what each is worth."""
        if self.tables is None or not len(c.starts):
            return np.eye(1, self.WIDTH).repeat(c.rows, axis=0)
        word, full, back, of_word, of_full = self._ratios(c)
        n = np.bincount(c.row, minlength=c.rows) + 1
        total = lambda x: np.bincount(c.row, weights=x, minlength=c.rows)
        out = [np.ones(c.rows), total(back) / n]
        leaning = lambda x: np.maximum(x - LEANING, 0)
        for k in range(len(OFTEN) + 1):
            own, more = of_word == k, of_full == k  # a pair adds what it says beyond its word
            lean = total(leaning(word) * own + (leaning(full) - leaning(word)) * more)
            out += [total(word * own + (full - word) * more) / n, 10 * lean / n, np.log1p(np.maximum(lean, 0))]
        return np.stack(out, axis=1)

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights, -500, 500)))


def _cut(discounts: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.append(0.0, discounts)[np.minimum(n, 3).astype(np.int64)]


def _discounts(n: list[int]) -> np.ndarray:
    """Discounts of expressions seen once, twice and more often (Chen and Goodman) from how many are seen 1 to 4 times."""
    if not all(n):
        return np.full(3, DISCOUNT)
    y = n[0] / (n[0] + 2 * n[1])
    return np.clip([k + 1 - (k + 2 if k < 2 else 4) * y * n[k + 1] / n[k] if k else 1 - 2 * y * n[1] / n[0] for k in range(3)], 0.05, [0.99, 1.9, 2.9])


def _profile(counts: DataFrame) -> dict[str, list[int]]:
    """For each class: sum of the counts; expressions seen once, twice, three times, four times and at all."""
    sums = {c: [F.sum(c), *[F.sum((F.col(c) == k).cast("long")) for k in (1, 2, 3, 4)], F.sum((F.col(c) > 0).cast("long"))] for c in ("toxic", "plain")}
    found = counts.agg(*[F.coalesce(x, F.lit(0)).alias(f"{c}{k}") for c, s in sums.items() for k, x in enumerate(s)]).first()
    return {c: [found[f"{c}{k}"] for k in range(6)] for c in sums}


def _put(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def _model(counts: DataFrame) -> Model:
    """The two models over all expressions.  Counts stay in files that the workers read; only sums come to the driver."""
    pairs_at, counts = _put(counts, "pair-counts")
    seen = lambda c: F.sum((F.col(c) > 0).cast("long"))
    words_at, words = _put(counts.groupBy("word").agg(seen("toxic").alias("toxic"), seen("plain").alias("plain")), "word-counts")
    of_words, of_pairs = _profile(words), _profile(counts)
    if not of_words["toxic"][0] or not of_words["plain"][0]:
        return Model()
    word_cut, pair_cut = ([_discounts(x[c][1:5]) for c in ("toxic", "plain")] for x in (of_words, of_pairs))
    lost = lambda c, d: F.sum(F.element_at(F.array(*[F.lit(float(x)) for x in (0, *d)]), F.least(F.col(c), F.lit(3)).cast("int") + 1))
    before_at, _ = _put(counts.groupBy("before").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"), lost("toxic", pair_cut[0]).alias("toxic_cut"), lost("plain", pair_cut[1]).alias("plain_cut")), "before-counts")
    totals = [np.array([x[0], x[1], x[2], x[5] - x[1] - x[2]], dtype=float) for x in (of_words["toxic"], of_words["plain"])]
    return Model((words_at, before_at, pairs_at), totals, np.array(word_cut), np.array(pair_cut))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton's method with halved steps."""
    w = np.zeros(x.shape[1])

    def loss(w):
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.005 * w @ w)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w)), x.T @ (weight * (y - p)) - 0.01 * w)
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def learn(df: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label: str = "toxic") -> Model:
    """Learn from labelled rows for which ``usable`` (a Column over the ids as ``id``) holds.

    Null ids and labels other than 0 and 1 are left out; an id with both labels counts as toxic.  Without rows of both
    classes every text gets the share of the class that is there (one half if neither is)."""
    given = labels.select(F.col(label_id).alias("id"), F.col(label).cast("int").alias("toxic")).filter(F.col("id").isNotNull() & F.col("toxic").isin(0, 1)).filter(usable)
    given = given.groupBy("id").agg(F.max("toxic").alias("toxic"))
    by_hash = F.xxhash64(F.col("id"), F.lit(5))
    picked = [given.filter(F.col("toxic") == k).orderBy(by_hash, "id").limit(LABELLED) for k in (0, 1)]
    sample = picked[0].unionByName(picked[1]).withColumn("fold", F.pmod(F.xxhash64(F.col("id"), F.lit(9)), F.lit(FOLDS)).cast("int"))
    sample = sample.select(F.col("id").alias("l_id"), "toxic", "fold")
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    labelled = stored(docs.join(F.broadcast(sample), F.col("id") == F.col("l_id")).select("text", F.col("toxic").cast("long").alias("toxic"), "fold"), "labelled")
    model = _model(_counts(labelled.filter("fold > 0")))
    kinds = [f"f{k}" for k in range(model.WIDTH)]

    def features(batches):
        for batch in batches:
            for c in chunks(batch.column("text"), LETTERS, lower=True, limit=AT_ONCE):
                x = model.features(c)
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(c.first, c.rows), *(pa.array(x[:, k]) for k in range(model.WIDTH))], ["toxic", *kinds])

    seen = labelled.filter("fold = 0").mapInArrow(features, ", ".join(["toxic long", *(f"{k} double" for k in kinds)])).toPandas()
    share = {r["toxic"]: r["count"] for r in given.groupBy("toxic").count().collect()}
    y = seen.toxic.to_numpy()
    if len(set(y)) < 2:
        model.weights[0] = {(): 0.0, (0,): -5.0, (1,): 5.0}[tuple(sorted(share))] if len(share) < 2 else np.log(share[1] / share[0])
        return model
    each = {k: share[k] / (y == k).sum() for k in (0, 1)}
    weight = np.where(y == 1, each[1], each[0])
    model.weights = logistic(seen[kinds].to_numpy(), y, weight / weight.mean())
    return model


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Each row of ``df`` as the struct ``doc`` with ``score`` (0 to 1).  Null and empty texts have no words and get the
    score of a text without any expression; repeated rows get equal scores.  Workers get the texts alone, once, and give
    back the scores alone."""
    def rate(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array(np.concatenate([np.empty(0), *(model.score(model.features(c)) for c in chunks(batch, LETTERS, lower=True, limit=AT_ONCE))]))

    rated = F.arrow_udf(rate, "double").asNondeterministic()  # so that a filter on the score does not rate twice
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"), rated(F.col(text_col)).alias("score"))
