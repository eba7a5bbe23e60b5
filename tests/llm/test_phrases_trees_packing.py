"""Collocations, Merkle manifest and harmonic packing against brute force, with nulls, empty and very long texts, ties, repeated
rows, empty tables and extra columns whose names clash with the operators' own."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapelib.llm import collocations, harmonic, merkle, queries

public_tokenizers = pytest.importorskip("public_tokenizers")

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, size int, grp string, pos long, id string, phrase string, shard int"


def corpus():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 5))) for _ in range(60)]
    odds = np.arange(60, 0, -1.0) ** 2
    odds /= odds.sum()

    def text(n):
        out = rng.choice(words, n, p=odds).tolist()
        return "".join(w.capitalize() + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", ": "]) for w in out)

    rows = [(i, text(int(n)), ["en", "de", None, "und", ""][int(i % 7) % 5]) for i, n in enumerate(rng.integers(0, 150, 60))]
    rows += [(60, None, "en"), (61, "", "de"), (62, " \t.,;", None), (63, "new york " * 40, "en"), (64, "x", "only"), (65, "of the of the of the of", "en")]
    rows += [rows[3], rows[3], (None, "no id at all, no id at all", "en"), (None, None, None), (66, "same word. " * 15, "de"), (67, text(3000), "en")]
    return [(i, t, lang, None if i is None or i % 5 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t, lang in rows]


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, 7, "g", 1, "x", "p", 2) for r in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    return corpus()


# -- collocations ---------------------------------------------------------------------------------

def brute_counts(rows, longest, least):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    counts[lang][tuple(w[i:i + n])] += 1
    return {lang: {p: c for p, c in of.items() if c >= least} for lang, of in counts.items()}, totals


def brute_ranks(rows, longest, least, most, cover):
    out = {}
    counts, totals = brute_counts(rows, longest, least)
    for lang, of in counts.items():
        found = []
        for p, a in of.items():
            if len(p) < 2:
                continue
            score, k = min((1000000 * a * a // (of[p[:k]] * of[p[k:]]), k) for k in range(1, len(p)))
            longer = [c for q, c in of.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * c >= cover * a for c in longer):
                found.append((-score, -a, " ".join(p).encode(), of[p[:k]], of[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:most], 1):
            out[lang, rank] = (p.decode(), -a, l, r, totals[lang], -score)
    return out


@pytest.mark.parametrize(("shards", "longest", "least", "slots"), [(4, 3, 3, 1 << 16), (3, 4, 2, 1 << 12), (1, 2, 5, 1 << 12)])
def test_phrase_counts_equal_a_full_count(spark, rows, shards, longest, least, slots):
    """For any number of shards; with few slots many phrases are counted for nothing and none is lost."""
    got = collocations.phrase_counts(frame(spark, rows), longest=longest, least=least, shards=shards, most_slots=slots).collect()
    want, totals = brute_counts(rows, longest, least)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.c for r in got if r["size"]} == {(lang, p): c for lang, of in want.items() for p, c in of.items()}
    assert {r.lang: r.c for r in got if not r["size"] and r.c} == {k: v for k, v in totals.items() if v}


def test_phrases_reached_in_late_shards_are_counted_over_a_whole_cycle(spark, monkeypatch):
    """Words and pairs that pass the threshold only in the last shards start late and go round."""
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(["a b c"] * 6 + ["x"] * 5 + ["a b c a b"] * 4 + ["b c d"] * 3)]
    got = collocations.phrase_counts(frame(spark, rows, 1), longest=3, least=10, shards=5)
    assert {r.phrase: r.c for r in got.filter("size > 0").collect()} == {" ".join(p): c for p, c in brute_counts(rows, 3, 10)[0]["en"].items()}


def test_long_texts_are_counted_whole(spark, monkeypatch):
    """Texts longer than what is counted at once, beside short ones."""
    long = "lorem ipsum dolor. " * 500_000
    rows = [(0, long, "en", "s", 1), (1, "ipsum dolor ipsum", "en", "s", 1), (2, long[:100], None, "s", 1)]
    assert len(long) > collocations.TEXT_BYTES
    got = {r.phrase: r.c for r in collocations.phrase_counts(frame(spark, rows, 1), least=10).filter("lang = 'en' AND size > 0").collect()}
    assert got == {"lorem": 500_000, "ipsum": 500_002, "dolor": 500_001, "lorem ipsum": 500_000, "ipsum dolor": 500_001, "lorem ipsum dolor": 500_000}


def test_collocations_rank_as_stated(spark, rows):
    for most in (2000, 4):
        got = collocations.collocations(collocations.phrase_counts(frame(spark, rows), longest=4, least=3), longest=4, most=most, cover=50).collect()
        want = brute_ranks(rows, 4, 3, most, 50)
        assert {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got} == want
        assert len(got) == len(want) > 10


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3_000_000_000
    counts = spark.createDataFrame([("en", 0, "", 5 * big), ("en", 1, "a", 2 * big + 1), ("en", 1, "b", 2 * big), ("en", 2, "a b", big + 7)], "lang string, size int, phrase string, c long")
    r, = collocations.collocations(counts, longest=3).collect()
    assert (r.a, r.l, r.r, r.score) == (big + 7, 2 * big + 1, 2 * big, 1000000 * (big + 7) ** 2 // ((2 * big + 1) * 2 * big))


def test_no_texts_no_phrases(spark, rows):
    none = frame(spark, rows).filter("false")
    counts = collocations.phrase_counts(none)
    assert counts.count() == 0 and collocations.collocations(counts).count() == 0
    assert collocations.collocations(collocations.phrase_counts(frame(spark, [(1, None, None, None, None), (2, " . ", "en", None, 3)]))).count() == 0


# -- Merkle manifest ------------------------------------------------------------------------------

def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(leaves):
    """Root, and the siblings before and after each leaf, level by level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 8 * 8:i // 8 * 8 + 8]
            paths[k].append(("".join(run[:i % 8]), "".join(run[i % 8 + 1:])))
        level = [sha("".join(level[i:i + 8])) for i in range(0, len(level), 8)]
        at = [i // 8 for i in at]
    return level[0], paths


def fold(x, path):
    for before, after in path:
        x = sha(before + x + after)
    return x


def brute_manifest(rows):
    groups = collections.defaultdict(list)
    for i, text, lang, source, n in rows:
        lower = text is not None and i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        groups[lang].append((i, leaf_of((i, source, lang, n, text)), leaf_of((i, source, lang, n, text.translate(LOWER) if lower else text))))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: brute_tree([leaf for _, leaf, _ in sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]) for lang in langs}
    root, tops = brute_tree([trees[lang][0] for lang in langs])
    out = []
    for lang, top in zip(langs, tops):
        members = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        for (i, leaf, bad), path in zip(members, trees[lang][1]):
            path = path + top
            out.append((i, leaf, trees[lang][0], root, sha("".join(a + b for a, b in path)), fold(bad, path), fold(bad, path) == root))
    return sorted(out, key=str)


@pytest.fixture
def op12(spark, tmp_path):
    def run(rows):
        path = str(tmp_path)
        frame(spark, rows).write.mode("overwrite").parquet(f"{path}/documents.parquet")
        got = queries.QUERIES["op12_merkle_manifest"](spark, path)
        assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        return sorted((tuple(r) for r in got.collect()), key=str)
    return run


def test_manifest_equals_brute_force(op12, rows):
    got = op12(rows)
    assert got == brute_manifest(rows)
    assert {v for *_, v in got} == {True, False}


def test_manifest_of_full_runs_single_rows_and_many_groups(op12):
    for n, langs in ((1, 1), (8, 1), (9, 2), (64, 1), (65, 1), (130, 70)):
        rows = [(i, f"Text {i}", None if i % langs == 3 else f"l{i % langs}", "s", i) for i in range(n)]
        assert op12(rows) == brute_manifest(rows), (n, langs)


def test_manifest_of_long_and_equal_texts(op12):
    rows = [(0, "A" * 5_000_000, "en", "s", 1), (1, "", "en", "", 0), (2, None, None, None, None)] + [(3, "again", "en", "s", 5)] * 30
    assert op12(rows) == brute_manifest(rows)


def test_manifest_without_rows(spark, rows):
    assert merkle.manifest(frame(spark, rows).filter("false"), "lang", "doc_id", ["doc_id", "text"]).count() == 0


# -- harmonic packing -----------------------------------------------------------------------------

def test_cuts_cover_a_text_and_leave_little():
    for capacity, slack in ((2048, 4), (100, 1), (7, 0), (1, 0)):
        for n in (*range(1, 3 * capacity + 5), 1000 * capacity + 3):
            parts = harmonic.cuts(n, capacity, slack)
            assert sum(parts) == n and all(1 <= p <= capacity for p in parts)
            assert all(capacity / (capacity // p) - p <= max(slack, 1) for p in parts)


def packed(spark, rows, capacity, parts, **more):
    got = harmonic.pack_documents(frame(spark, rows, parts), queries.vocabulary(queries.BYTE_BPE), spaced=True, end_id=1, capacity=capacity, with_ids=True, **more).collect()
    return got


@pytest.mark.parametrize(("capacity", "parts"), [(64, 7), (2048, 3), (16, 1)])
def test_every_token_lies_in_one_piece_and_sequences_are_full(spark, rows, capacity, parts):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(queries.vocabulary(queries.BYTE_BPE))
    got = packed(spark, rows, capacity, parts)
    want = collections.Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for i, t, *_ in rows)
    # pieces of equal rows are equal, so texts are put together from as many pieces at each start
    by_text = collections.defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        by_text[r.id, r.doc_tokens].append(r)
    made = collections.Counter()
    for (i, total), pieces in by_text.items():
        starts = collections.defaultdict(list)
        for r in pieces:
            starts[r.start].append(tuple(r.ids))
        ways = {len(v) for v in starts.values()}
        assert len(ways) == 1
        for k in range(ways.pop()):
            made[i, sum((sorted(starts[s])[k] for s in sorted(starts)), ())] += 1
    different = {k for k in want if k[0] is not None}
    assert {k: made[k] for k in different} == {k: want[k] for k in different}
    assert sum(len(r.ids) for r in got) == sum(len(ids) * n for (_, ids), n in want.items())
    room = collections.defaultdict(list)
    for r in got:
        room[r.sequence_id].append((r.offset, r.length))
    fill = []
    for places in room.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
        fill.append(at)
    assert sum(capacity - n for n in fill) <= harmonic.SLACK * len(rows) + 2 * capacity


def test_many_workers_share_the_bins_they_cannot_fill(spark):
    """Texts of one length in many partitions: leftovers of all of them meet in bins of their class."""
    rows = [(i, "word " * 30, "en", "s", 1) for i in range(500)]
    got = packed(spark, rows, 2048, 40)
    n = {r.doc_tokens for r in got}.pop()
    per_bin = collections.Counter(r.sequence_id for r in got if r["class"] == 2048 // n)
    assert len(set(per_bin.values()) - {2048 // n}) <= 1 and len({r.sequence_id for r in got}) <= -(-len(rows) * n // 2048) + 2


def test_packing_of_long_texts_and_empty_tables(spark, rows):
    long = [(0, "alpha beta, gamma. " * 250_000, "en", "s", 1), (1, None, "en", "s", 1)]
    got = packed(spark, long, 2048, 1)
    assert sum(r.length for r in got if r.id == 0) == {r.doc_tokens for r in got if r.id == 0}.pop() > 1_000_000
    assert harmonic.pack_documents(frame(spark, rows).filter("false"), queries.vocabulary(queries.BYTE_BPE), spaced=True, end_id=1, capacity=64).count() == 0
