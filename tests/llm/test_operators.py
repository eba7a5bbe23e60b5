"""Operators of the document subpackage against brute force, with nulls, empty and long texts, ties, repeated rows, empty
tables and extra columns whose names clash with the operators' own."""

import collections
import hashlib
import math
import re
import textwrap
import tracemalloc
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tapelib.llm import decontamination, exact_dedup, hmm, licences, near_dedup, packing, substring_dedup, token_files, toxicity, warc  # noqa: E402
from tapelib.llm.encode import Encoder, encoder  # noqa: E402
from tapelib.llm.queries import BYTE_BPE, WORD_BPE, vocabulary  # noqa: E402
from tapelib.llm.store import new_path, stored  # noqa: E402
from tapelib.llm.text import SPACED, chunks  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, digest string, n_words int, node string, doc string, id int"


def corpus():
    rng = np.random.default_rng(5)
    vocabulary_ = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary_, n))
    docs = [text(int(n)) for n in rng.integers(1, 120, 40)]
    passage = text(30)
    docs += [f"{text(20)} {passage} {text(9)}", f"{passage}\n{text(15)}", passage.replace(" ", "  "), docs[3], docs[3], docs[7].upper()]
    base = text(100).split(" ")
    for k in range(12):  # near copies
        w = list(base)
        w[5 * k % 100] = f"x{k}"
        docs.append(" ".join(w))
    docs += ["", "  \t\n", "one", "One", "the the the the " * 50, "é ü x " * 20, text(4000), None, None]
    rows = [(i, t) for i, t in enumerate(docs)]
    return rows + [rows[2], (None, "no id here " * 9), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "d", 7, "n", "x", 3) for i, t in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [(1, "x")]).filter("false")


def test_exact_groups(docs, none, rows):
    got = collections.Counter((r.id, r.sha256, r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs, keep="max").collect())
    by = collections.defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    want = {(i, hashlib.sha256((t or "").encode()).hexdigest(), max((x for x in by[t or ""] if x is not None), default=None), len(by[t or ""])) for i, t in rows}
    assert set(got) == want and max(got.values()) == 1
    kept = exact_dedup.exact_dedup(docs).collect()
    assert sorted(r.text or "" for r in kept) == sorted(by) and kept[0].__fields__ == ["doc_id", "text", "digest", "n_words", "node", "doc", "id"]
    assert exact_dedup.exact_dedup(none).count() == 0


def test_hash_collisions_are_told_apart(spark):
    d = frame(spark, [(1, "aa"), (2, "ab"), (3, "aa"), (4, "b")])
    got = {r.id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(d, digest=lambda t: F.substring(t, 1, 1)).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (4, 1)}


def test_near_groups(docs, none, rows):
    def shingles(t, k=2):
        w = WORD.findall((t or "").translate(LOWER))
        return frozenset(tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, min(1, len(w)))))
    sets = {t: shingles(t) for _, t in rows}
    low = {(i, t): i for i, t in rows}
    keys = list(low)
    for _ in range(len(keys)):
        changed = False
        for a in keys:
            for b in keys:
                x, y = sets[a[1]], sets[b[1]]
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    m = min((v for v in (low[a], low[b]) if v is not None), default=None)
                    changed |= low[a] != m or low[b] != m
                    low[a] = low[b] = m
        if not changed:
            break
    got = collections.Counter((r.id, r.n_shingles, r.component_id) for r in near_dedup.near_groups(docs, k=2).collect())
    assert got == collections.Counter((i, len(sets[t]), low[i, t]) for i, t in rows)
    assert near_dedup.near_dedup(none).count() == 0


def test_registers_and_estimate():
    rng = np.random.default_rng(1)
    v = rng.integers(1, 2**63, 1000, dtype=np.uint64) >> rng.integers(0, 30, 1000).astype(np.uint64)
    for x, r in zip(v.tolist(), near_dedup.compress(v).tolist()):
        x |= 1
        zeros = 64 - x.bit_length()
        assert r >> 10 == zeros and r & 1023 == ((x << zeros + 1) & (2**64 - 1)) >> 54
    a = rng.integers(0, 2**63, 900, dtype=np.uint64)
    sketch = lambda s: near_dedup.compress(np.array([np.min((s ^ near_dedup._B[j]) * near_dedup._A[j]) for j in range(near_dedup.REGISTERS)]))
    got = near_dedup.estimate((sketch(a[:800]) == sketch(a[100:])).sum(), 800.0, 800.0)
    assert abs(got - 7 / 9) < 0.13


def test_remove_repeats(docs, none, rows):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 12):
            if i is not None:
                first[tuple(w[k:k + 13])] = min(i, first.get(tuple(w[k:k + 13]), i))
    want = collections.Counter()
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = {p for k in range(len(w) - 12) if i is not None and first[tuple(w[k:k + 13])] < i for p in range(k, k + 13)}
        want[i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)] += 1
    got = substring_dedup.remove_repeats(docs).collect()
    assert collections.Counter((r.id, r.n_words, r.n_removed, r.kept_text) for r in got) == want
    assert all(r.n_removed == sum(b - a for a, b in r.spans) and r.kept_sha256 == hashlib.sha256(r.kept_text.encode()).hexdigest() for r in got)
    assert substring_dedup.remove_repeats(none).count() == 0


def test_find_phrases(spark, docs, none, rows):
    alnum = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = [(1, rows[5][1]), (2, "ONE"), (3, None), (4, "!!"), (20, rows[40][1]), (None, rows[9][1]), (20, rows[40][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: alnum.findall((t or "").translate(LOWER))
    want = collections.Counter()
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for item, x in items:
            x = words(x)
            for k in range(max(len(x) - 12, min(1, len(x)))):
                g = x[k:k + 13]
                for p in range(len(w) - len(g) + 1):
                    if w[p:p + len(g)] == g:
                        hit |= set(range(p, p + len(g)))
                        found.add(str(item) if item is not None else "null")
        want[i, len(w), len(hit), tuple(sorted(found))] += 1
    got = decontamination.find_phrases(docs, bench).select("doc.doc_id", "n_words", "n_hit", "items", "spans").collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == want
    assert all(sum(b - a for a, b in r.spans) == r.n_hit for r in got)
    assert decontamination.find_phrases(docs, bench.filter("false")).filter("n_hit > 0").count() == 0
    assert decontamination.find_phrases(none, bench).count() == 0


def test_fm_index_finds_and_locates_everything():
    rng = np.random.default_rng(2)
    text = np.concatenate([np.append(rng.integers(1, 4, n), 0) for n in rng.integers(1, 60, 20)])
    index = decontamination.FMIndex(text, 4)
    for n in (1, 2, 5):
        phrases = rng.integers(1, 4, (30, n))
        lo, hi = index.search(phrases)
        for p, a, b in zip(phrases, lo, hi):
            want = [i for i in range(len(text) - n + 1) if (text[i:i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("name,spaced", [(WORD_BPE, False), (BYTE_BPE, True)])
def test_cached_encoding_equals_the_tokenizer(name, spaced, rows):
    e = Encoder(vocabulary(name), spaced)
    texts = [t or "" for _, t in rows] + ["a  b", " x ", "x.\nY z", "don't 'S", "a\x1c b\x85 c", "ΣΑΣ é ﬁ", "<|endoftext|> a <|endoftext|>", "1234 5,6 a1b", "x" * 300]
    for _ in range(2):
        for t, got in zip(texts, e.encode(texts), strict=True):
            assert got.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t[:40]


def test_token_files(spark, docs, none, rows):
    folder = new_path(spark, "test-tokens")
    index = token_files.write_token_files(docs, folder, vocabulary(BYTE_BPE), True, 0)
    assert index.agg(F.sum("keys")).first()[0] == len(rows)
    keys = docs.groupBy(F.col("doc_id").alias("id")).count().select("id", F.explode(F.expr("sequence(0, cast(count - 1 AS int))")).alias("copy"))
    absent = spark.createDataFrame([(-5, 0), (3, 9)], "id long, copy int")
    found = token_files.find_tokens(keys.unionByName(absent), folder, index.count())
    assert found.filter("shard IS NULL").count() == 2
    got = token_files.read_tokens(found, folder).collect()
    e, start = Encoder(vocabulary(BYTE_BPE), True), 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for r, (i, t) in zip(sorted(got, key=lambda r: r.start), ordered, strict=True):
        ids = e.tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        assert (r.id, r.start, r.n_tokens, list(r.ids), r.ids_crc32) == (i, start, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.write_token_files(none, new_path(spark, "test-empty"), vocabulary(BYTE_BPE), True, 0).count() == 0


def test_perfect_hash():
    keys = np.random.default_rng(3).integers(0, 2**63, 5000, dtype=np.uint64)
    slots = token_files.PerfectHash.build(keys).find(keys)
    assert sorted(slots) == list(range(5000))


def test_plan_fills_sequences():
    rng = np.random.default_rng(4)
    for sizes in (rng.integers(1, 4097, 3000), rng.geometric(0.002, 5000).clip(1, 4096), [4096] * 5, [1] * 9000, [2049] * 7):
        histogram = dict(collections.Counter(int(x) for x in sizes))
        used, total = collections.Counter(), 0
        plan = packing.plan(histogram, 4096)
        for lengths, times in plan:
            assert sum(lengths) <= 4096
            total += times
            for n in lengths:
                used[n] += times
        assert dict(used) == histogram
        least = max(-(-sum(k * v for k, v in histogram.items()) // 4096), sum(v for k, v in histogram.items() if k > 2048))
        assert total <= least * 1.02 + 1
    assert packing.plan({}, 4096) == []
    a, b = rng.random((20, 50)), rng.random(20)
    x = packing.nnls(a, b)
    gradient = a.T @ (b - a @ x)
    assert (x >= 0).all() and gradient.max() < 1e-6 and abs(gradient[x > 0]).max() < 1e-6


def test_pack(docs, none, rows):
    pieces = stored(packing.token_pieces(docs, vocabulary(WORD_BPE), False, 1, 64), "test-pieces")
    got = packing.pack(pieces, 64).collect()
    e, want = Encoder(vocabulary(WORD_BPE), False), collections.Counter()
    for i, t in rows:
        ids = e.tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want.update((i, k, a, len(ids[a:a + 64]), zlib.crc32(np.array(ids[a:a + 64], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 64)))
    assert collections.Counter((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for v in places.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(stored(packing.token_pieces(none, vocabulary(WORD_BPE), False, 1, 64), "test-pieces"), 64).count() == 0


def test_toxicity_finds_planted_words(spark, none):
    rng = np.random.default_rng(6)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = []
    for i in range(1200):
        w = list(rng.choice(words, rng.integers(5, 80)))
        if i % 5 == 0:
            for p in rng.integers(0, len(w), 3):
                w[p] = str(rng.choice(["zounds", "drat", "bother"]))
        rows.append((i, " ".join(w)))
    d = frame(spark, rows + [(5000, None), (5001, ""), (None, "drat")])
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(1200)] + [(None, 1, 1), (7, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(d, labels, F.col("id") % 4 != 2)
    got = {r.doc_id: r.score for r in toxicity.score(d, model).select("doc.doc_id", "score").collect()}
    held = [i for i in range(1200) if i % 4 == 2]
    assert np.mean([(got[i] >= 0.3) == (i % 5 == 0) for i in held]) > 0.97
    assert got[5000] == got[5001] and all(0 <= s <= 1 for s in got.values())
    assert toxicity.score(none, model).count() == 0
    nothing = toxicity.learn(d, labels.filter("false"), F.lit(True))
    assert {r.score for r in toxicity.score(d, nothing).collect()} == {0.5}


def test_toxicity_tables_are_sorted_in_little_memory(tmp_path):
    rnd, n = np.random.default_rng(5), 400_000
    keys = rnd.integers(-2**63, 2**63 - 1, n)
    for k in range(4):
        own = slice(k * n // 4, (k + 1) * n // 4)
        pq.write_table(pa.table({"pair": keys[own], "toxic": np.arange(n)[own], "plain": keys[own] % 1000}), tmp_path / f"part-{k}.parquet")
    tracemalloc.start()
    found, toxic, plain = toxicity._table(str(tmp_path), ["pair", "toxic", "plain"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    order = np.argsort(keys.view(np.uint64))
    assert (found == keys.view(np.uint64)[order]).all() and (toxic == order).all() and (plain == (keys % 1000)[order]).all()
    assert peak < 27 * n, peak / n  # of which the result takes 16


def test_a_worker_keeps_the_things_of_one_kind_of_work(tmp_path):
    pq.write_table(pa.table({"pair": np.arange(9), "toxic": np.arange(9), "plain": np.arange(9)}), tmp_path / "part-0.parquet")
    code = weakref.ref(encoder(vocabulary(WORD_BPE), False))
    assert encoder(vocabulary(WORD_BPE), False) is code()
    table = weakref.ref(toxicity._table(str(tmp_path), ["pair", "toxic", "plain"])[0])
    assert code() is None and toxicity._table(str(tmp_path), ["pair", "toxic", "plain"])[0] is table()
    encoder(vocabulary(WORD_BPE), False)
    assert table() is None


@pytest.mark.parametrize("stage", [lambda d: near_dedup.sketches(d, 5, "doc_id", "text"), lambda d: decontamination.find_phrases(d, d, item_id="doc_id")])
def test_a_stage_drops_what_other_work_has_kept(spark, monkeypatch, stage):
    d, run = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), []
    plain = type(d).mapInArrow
    monkeypatch.setattr(type(d), "mapInArrow", lambda self, f, *a, **b: run.append(f) or plain(self, f, *a, **b))
    stage(d)
    code = weakref.ref(encoder(vocabulary(WORD_BPE), False))
    list(run[-1]([]))
    assert code() is None


def test_toxicity_scores_get_the_texts_alone(spark):
    d = spark.createDataFrame([(1, "a b", "x" * 50), (2, None, None)], "doc_id long, text string, other string")
    scored = toxicity.score(d, toxicity.Model())
    assert "MapInArrow" not in scored._jdf.queryExecution().executedPlan().toString()
    assert [(r.doc.doc_id, r.doc.other, r.score) for r in scored.orderBy("doc.doc_id").collect()] == [(1, "x" * 50, 0.5), (2, None, 0.5)]


@pytest.mark.parametrize("phrase", ["waa gorm", "waa wbb"])
def test_toxicity_finds_fixed_phrases(spark, phrase):
    """A word that only follows one other, and two ordinary words that stand together fewer than 50 times."""
    rng = np.random.default_rng(8)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(30)] + ["wbb"]
    rows = []
    for i in range(300):
        w, v = (" ".join(rng.choice(words, rng.integers(5, 40))).replace("waa wbb", "waa") for _ in range(2))
        rows.append((i, f"{w} {phrase} {v}" if i % 5 == 0 else f"{w} {v}"))
    d = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(d, toxicity.learn(d, labels, F.col("id") % 4 != 2)).select("doc.doc_id", "score").collect()}
    assert np.mean([(got[i] >= 0.3) == (i % 5 == 0) for i in range(300) if i % 4 == 2]) > 0.95


def test_hmm_scores(docs, none, rows):
    train = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 != 0
    got = collections.defaultdict(list)
    for r in hmm.score(docs, F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(10)) != 0).collect():
        got[r.id].append(r)
    tokens = lambda t: WORD.findall((t or "").translate(LOWER)) + [None]
    c = collections.Counter(w for i, t in rows if train(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
        assert any(r.n_tokens == len(tokens(t)) and r.n_known == sum(c[w] > 0 for w in tokens(t)) and r.train_tokens == n and abs(r.base_score - base) < 1e-6 * abs(base) + 1e-9 for r in got[i])
        assert all(np.isfinite(r.score) and r.score < 0 for r in got[i])
    assert hmm.score(none, F.lit(True)).count() == 0


def brute_hmm(rows, train, k):
    """log10 probabilities by id, text by text and token by token: symbols, Baum-Welch until it settles, forward recursion."""
    split = lambda t: [w.encode() for w in WORD.findall((t or "").translate(LOWER))]
    c = collections.Counter(w for i, t in rows if train(i) for w in split(t))
    texts = sum(1 for i, _ in rows if train(i))
    hashes = {}
    for w in c:
        chunk, = chunks(pa.array([w.decode()]), SPACED, lower=True)
        hashes[w] = int(chunk.hashes().view(np.int64)[0])
    symbol = {w: r for r, w in enumerate(sorted(c, key=lambda w: (-c[w], hashes[w])))}
    end, m = hmm.WORDS + hmm.CLASSES, hmm.WORDS + hmm.CLASSES + 1
    assert len(symbol) <= hmm.WORDS  # so known words are symbols, and the classes hold one unknown word each
    of = lambda w: symbol[w] if w in symbol else hmm.WORDS + (w[-1] * 31 + (w[-2] * 131 if len(w) > 1 else 0)) % hmm.CLASSES
    sequences = [[of(w) for w in split(t)] + [end] for _, t in rows]
    unigram = np.full(m, 0.1)
    for w, n in c.items():
        unigram[symbol[w]] += n
    unigram[end] += texts
    unigram /= unigram.sum()
    emit = unigram[:, None] * (np.random.default_rng(3).random((m, k)) + 0.5)
    emit /= emit.sum(axis=0)
    start, step = np.full(k, 1 / k), np.where(np.eye(k), 0.98, 0.02 / (k - 1))
    learning = [s for s, (i, _) in zip(sequences, rows) if train(i)]
    tokens, last = sum(map(len, learning)), -np.inf
    while True:
        e, x, b, total = np.zeros((m, k)), np.zeros((k, k)), np.zeros(k), 0.0
        for s in learning:
            alphas, scales, a = [], [], None
            for t, o in enumerate(s):
                a = (start if t == 0 else a @ step) * emit[o]
                scales.append(a.sum())
                a = a / scales[-1]
                alphas.append(a)
            beta = np.ones(k)
            for t in range(len(s) - 1, -1, -1):
                e[s[t]] += alphas[t] * beta
                if t:
                    x += step * np.outer(alphas[t - 1], emit[s[t]] * beta) / scales[t]
                    beta = step @ (emit[s[t]] * beta) / scales[t]
            b += alphas[0] * beta
            total += np.log(scales).sum()
        e, x, b = e + unigram[:, None], x + 0.1, b + 0.1
        emit, step, start = e / e.sum(axis=0), x / x.sum(axis=1, keepdims=True), b / b.sum()
        if total - last < hmm.SETTLED * tokens:
            break
        last = total
    out = []
    for s in sequences:
        log, a = 0.0, None
        for t, o in enumerate(s):
            a = (start if t == 0 else a @ step) * emit[o]
            log += math.log10(a.sum())
            a = a / a.sum()
        out.append(log)
    return out


def test_hmm_score_equals_brute_force(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(hmm, "SHARES", 1)  # plain Baum-Welch: the model is renewed once a pass
    monkeypatch.setattr(hmm, "STATES", 3)
    train = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 != 0
    got = sorted((-1 if r.id is None else r.id, r.n_tokens, r.score) for r in hmm.score(docs, F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(10)) != 0).collect())
    want = sorted((-1 if i is None else i, len(WORD.findall(t or "")) + 1, s) for (i, t), s in zip(rows, brute_hmm(rows, train, 3)))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], rtol=1e-9)


def test_hmm_learns_from_all_shares(spark, docs):
    """Renewing the model share by share ends at least as high as renewing it once a pass from the same start."""
    totals = {}
    for shares in (1, 8):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(hmm, "SHARES", shares)
            totals[shares] = hmm.score(docs, F.lit(True)).agg(F.sum("score")).first()[0]
    assert totals[8] > totals[1] * 1.01  # log-likelihoods are negative: at most 1 % lower


def test_counts_carry_state_over_cuts():
    rng = np.random.default_rng(8)
    norm = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    m = hmm.Hmm(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((50, 3)), 0))
    seqs = [rng.integers(0, 50, n).astype("<u2") for n in (4, 1, 6, 700, 33, 8, 9, 16, 17, 0, 120)]
    whole, likelihood = m.counts(seqs, 10**6)
    assert whole[53].sum() == pytest.approx(10) and likelihood == pytest.approx(m.log10([s for s in seqs if len(s)]).sum() * math.log(10))
    for segment in (1, 3, 8, 64, 128):
        counts, log = m.counts(seqs, segment)
        assert np.allclose(counts, whole, atol=1e-9) and log == pytest.approx(likelihood)
    assert m.counts([])[0].sum() == 0


def test_forward_recursion_sums_over_all_paths():
    import itertools
    rng = np.random.default_rng(8)
    norm = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    m = hmm.Hmm(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((5, 3)), 0))
    seqs = [rng.integers(0, 5, n).astype("<u2") for n in (4, 1, 6)]
    for s, got in zip(seqs, m.log10(seqs)):
        p = sum(m.start[q[0]] * m.emit[s[0], q[0]] * np.prod([m.step[a, b] * m.emit[x, b] for a, b, x in zip(q, q[1:], s[1:])]) for q in itertools.product(range(3), repeat=len(s)))
        assert abs(got - math.log10(p)) < 1e-9
    likelihood = []
    for _ in range(6):
        counts, l = m.counts(seqs * 20)
        likelihood.append(l)
        m = hmm.Hmm.of_counts(counts, np.full(5, 1e-9))
    assert counts[:5].sum() == pytest.approx(20 * 11)
    assert likelihood[-1] > likelihood[0]


def test_warc_audit(spark):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>{'x' * (i * 7 % 900)}é</p>") for i in range(90)] + [(200, None, None), (201, "u", ""), (3, "http://a/3", "other")], "page_id long, url string, html string").repartition(6)
    ours, theirs = new_path(spark, "test-warc"), new_path(spark, "test-warc")
    manifest = warc.write_warc(pages, ours)
    warc.copy_warc(manifest, ours, theirs, F.col("id").isin(4, 50, 201)).count()
    tree = warc.merkle_tree(manifest)
    same = warc.merkle_tree(warc.read_records(manifest, ours))
    assert warc.audit(tree, same).count() == 0 and tree[-1].count() == 1
    bad = warc.audit(tree, warc.merkle_tree(warc.read_records(manifest, theirs))).join(manifest, ["shard", "place"])
    assert sorted(r.id for r in bad.collect()) == [4, 50, 201]
    read = {(r.id, r.payload_bytes) for r in warc.read_records(manifest, ours, with_payload=True).collect()}
    assert read == {(r.page_id, len((r.html or "").encode())) for r in pages.collect()}
    missing = warc.audit(tree, warc.merkle_tree(warc.read_records(manifest, new_path(spark, "nowhere"))))
    assert missing.count() == 93
    empty = warc.write_warc(pages.filter("false"), new_path(spark, "test-warc"))
    assert warc.audit(warc.merkle_tree(empty), warc.merkle_tree(empty)).count() == 0


def test_licence_rules(spark, none):
    s = licences.SENTENCES
    d = frame(spark, [(1, f"Intro\n{s['mit-grant']}:\n\n{s['mit-notice']}.\nSomething else. {s['mit-as-is']}."), (2, f"{s['mit-notice']}. {s['mit-grant']}. {s['mit-as-is']}."), (3, s["cc-by-4"] + ".\n" + s["gpl3-name"]),
                      (4, ". ".join(s[k] for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"))), (5, ". ".join(s[k] for k in ("bsd-grant", "bsd-source", "bsd-binary"))), (6, None), (7, ""), (3, s["cc-by-4"] + ".\n" + s["gpl3-name"])])
    got = collections.Counter((r.doc_id, ",".join(r.licences)) for r in licences.scan(d).select("doc.doc_id", "licences").collect())
    assert got == {(1, "MIT"): 1, (2, ""): 1, (3, "CC-BY-4.0,GPL-3.0"): 2, (4, "BSD-3-Clause"): 1, (5, "BSD-2-Clause"): 1, (6, ""): 1, (7, ""): 1}
    assert licences.scan(none).count() == 0


LIBRARY = "is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; {}."
OFFICIAL = {
    "GPL-2.0-or-later": "This program " + LIBRARY.format("General Public License", "either version 2 of the License, or (at your option) any later version"),
    "GPL-2.0-only": "This program " + LIBRARY.format("General Public License", "version 2 of the License"),
    "LGPL-2.1-or-later": "This library " + LIBRARY.format("Lesser General Public License", "either version 2.1 of the License, or (at your option) any later version"),
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MIT": " ".join(licences.SENTENCES[k] + "." for k in ("mit-grant", "mit-notice", "mit-as-is")),
}


def test_official_notices_at_any_wrap_width(spark):
    rows = [(i, "Copyright (c) 2020 Someone\n\n" + "\n".join(textwrap.wrap(text, w, break_long_words=False, break_on_hyphens=False)) + "\n\nMore text here") for i, text in enumerate(OFFICIAL.values()) for w in range(20, 100, 3)]
    got = licences.scan(frame(spark, rows)).select("doc.doc_id", "licences").collect()
    assert {(r.doc_id, *r.licences) for r in got} == set(enumerate(OFFICIAL))


def test_bsd_2_beside_bsd_3(spark):
    two = [licences.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary")]
    three = [*two, licences.SENTENCES["bsd-endorse-org"]]
    d = frame(spark, [(1, ". ".join(three)), (2, ". ".join(three + two)), (3, ". ".join(three + three))])
    assert {r.doc_id: r.licences for r in licences.scan(d).select("doc.doc_id", "licences").collect()} == {1: ["BSD-3-Clause"], 2: ["BSD-2-Clause", "BSD-3-Clause"], 3: ["BSD-3-Clause"]}


def test_licence_sentences_at_the_edges_of_a_text(spark, none):
    """First and last sentences beside spaces, comment marks, brackets and quotes; SPDX lines; more notices."""
    mit = "Licensed under the MIT License."
    texts = [(1, mit), (2, "  " + mit), (3, "# " + mit), (4, "// " + mit + "\n"), (5, f"({mit})"), (6, f'"{mit}"'), (7, "/* " + mit + " */"), (8, "# SPDX-License-Identifier: Apache-2.0\n\nimport os"), (9, "SPDX-License-Identifier: MIT"),
             (10, "Licensed under the MIT license (see LICENSE)."), (11, licences.SENTENCES["epl2"]), (12, ". ".join(licences.SENTENCES[k] for k in ("zlib-as-is", "zlib-grant")) + ":"), (13, "MIT"), (14, "  "), (15, "#")]
    got = {r.doc_id: (list(r.licences), r.n_sentences) for r in licences.scan(frame(spark, texts)).select("doc.doc_id", "licences", "n_sentences").collect()}
    assert {k: v[0] for k, v in got.items()} == {**dict.fromkeys(range(1, 8), ["MIT"]), 8: ["Apache-2.0"], 9: ["MIT"], 10: ["MIT"], 11: ["EPL-2.0"], 12: ["Zlib"], 13: [], 14: [], 15: []}
    assert (got[2][1], got[14][1], got[15][1]) == (1, 0, 0)
