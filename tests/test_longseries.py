"""Block plans against plain pandas on several blocks, and independence of the partitioning."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from tapelib.operators import indicators as I, outcomes as O
from tapelib.plans import asof as A, longseries as L

N = 137


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    parts = []
    for s, n in (("a", N), ("b", 11)):
        close = 100 + rng.normal(size=n).cumsum()
        spread = rng.random(n)
        parts.append(pd.DataFrame({"series": s, "time": pd.date_range("2024-03-09", periods=n, freq="h"), "open": close + rng.normal(size=n) / 3, "close": close,
                                   "volume": rng.integers(1, 9, n).astype(float)}).assign(high=lambda d: d[["open", "close"]].max(axis=1) + spread, low=lambda d: d[["open", "close"]].min(axis=1) - spread))
    pdf = pd.concat(parts, ignore_index=True)
    d = spark.createDataFrame(pdf)
    d = L.with_index(d, ["series"], ["time"], F.floor(F.unix_millis("time") / (3_600_000 * 10)))
    return pdf, L.materialize(d, "t")


def col(d, name, series="a"):
    return d.filter(F.col("series") == series).orderBy("idx").toPandas()[name].to_numpy()


def test_row_numbers(frame):
    pdf, d = frame
    assert list(col(d, "idx")) == list(range(N)) and list(col(d, "idx", "b")) == list(range(11))


def test_blocked_frames_and_carry(frame):
    pdf, d = frame
    x = pdf[pdf.series == "a"].close.reset_index(drop=True)
    r = L.blocked(d, ["series"], lambda q, f: q.select("*", f.full(F.avg("close"), "close", -6, 0).alias("m"), f.lead("close", 3).alias("n")), back=6, ahead=3, size=16)
    assert np.allclose(col(r, "m").astype(float), x.rolling(7).mean(), equal_nan=True)
    assert np.allclose(col(r, "n").astype(float), x.shift(-3), equal_nan=True)
    e = d.withColumn("e", F.when(F.col("idx") % 29 == 3, F.col("close")))
    c = L.carry(e, ["series"], {"last": ("last", "e"), "top": ("max", "close"), "sum": ("sum", "close")}, size=16)
    ev = x.where(np.arange(N) % 29 == 3)
    assert np.allclose(col(c, "last").astype(float), ev.ffill(), equal_nan=True)
    assert np.allclose(col(c, "top"), x.cummax()) and np.allclose(col(c, "sum"), x.cumsum())
    b = L.carry(e, ["series"], {"nxt": ("last", "e"), "least": ("min", "close")}, forward=False, inclusive=False, size=16)
    assert np.allclose(col(b, "nxt").astype(float), ev.bfill().shift(-1), equal_nan=True)
    assert np.allclose(col(b, "least").astype(float), x[::-1].cummin()[::-1].shift(-1), equal_nan=True)


def smooth(x, n, q, g):
    out, prev, seen = [], None, []
    for v in x:
        if v != v:
            out.append(np.nan)
            continue
        if prev is None:
            seen.append(v)
            prev = np.mean(seen) if len(seen) == n else None
        else:
            prev = q * prev + g * v
        out.append(np.nan if prev is None else prev)
    return np.array(out)


@pytest.mark.parametrize("size", [8, 32, 512])
def test_smoothing_over_blocks(frame, monkeypatch, size):
    pdf, d = frame
    monkeypatch.setattr(L, "SCAN_BLOCK", size)
    x = pdf[pdf.series == "a"].close.to_numpy()
    r = L.scan(d, ["series"], [("e5", "close", "ema", 5), ("e2", "close", "ema", 2), ("w7", "close", "rma", 7), ("e1", "close", "ema", 1)])
    assert np.allclose(col(r, "e5").astype(float), smooth(x, 5, 1 - 2 / 6, 2 / 6), equal_nan=True, rtol=1e-12)
    assert np.allclose(col(r, "e2").astype(float), smooth(x, 2, 1 / 3, 2 / 3), equal_nan=True, rtol=1e-12)
    assert np.allclose(col(r, "w7").astype(float), smooth(x, 7, 6 / 7, 1 / 7), equal_nan=True, rtol=1e-12)
    assert np.allclose(col(r, "e1").astype(float), x)
    late = d.withColumn("x", F.when(F.col("idx") >= 9, F.col("close")))
    y = x.copy()
    y[:9] = np.nan
    for lead in (9, None):
        z = L.scan(late, ["series"], [("e5", "x", "ema", 5)], lead=lead)
        assert np.allclose(col(z, "e5").astype(float), smooth(y, 5, 1 - 2 / 6, 2 / 6), equal_nan=True, rtol=1e-12)


@pytest.mark.parametrize("size", [7, 40, 4096])
def test_state_machine_is_block_independent(frame, monkeypatch, size):
    pdf, d = frame
    whole = I.compute(d, [I.spec("supertrend", mult=1.0), I.spec("zigzag", k=1.0)])
    want = {c: col(whole, c).astype(float) for c in whole.columns if c.startswith(("super", "zig"))}
    full = L.fsm
    monkeypatch.setattr(I, "fsm", lambda *a, **k: full(*a, **{**k, "size": size}))
    got = I.compute(d, [I.spec("supertrend", mult=1.0), I.spec("zigzag", k=1.0)])
    for c, v in want.items():
        assert np.allclose(col(got, c).astype(float), v, equal_nan=True), c
    assert len(set(want["supertrend_10_1_direction"][9:])) == 2


def test_indicators_do_not_see_the_future(frame):
    pdf, d = frame
    specs = [I.spec("ema", period=9), I.spec("rsi"), I.spec("macd", fast=4, slow=9, signal=3), I.spec("adx", period=5), I.spec("stoch"), I.spec("swing"), I.spec("zigzag", k=1.0),
             I.spec("bbands"), I.spec("donchian"), I.spec("stochrsi"), I.spec("avwap"), I.spec("vwap"), I.spec("keltner")]
    a = I.compute(d, specs).orderBy("series", "idx").toPandas()
    b = I.compute(d.filter("idx < 90"), specs).orderBy("series", "idx").toPandas()
    a = a[a.idx < 90].reset_index(drop=True)
    for c in a.columns[8:]:
        assert np.allclose(a[c].astype(float), b[c].astype(float), equal_nan=True, rtol=1e-9), c


def test_partition_count_does_not_matter(frame):
    pdf, d = frame
    one = I.compute(d.repartition(1), [I.spec("atr"), I.spec("rsi")]).orderBy("series", "idx").toPandas()
    many = I.compute(d.repartition(8), [I.spec("atr"), I.spec("rsi")]).orderBy("series", "idx").toPandas()
    pd.testing.assert_frame_equal(one, many)


def test_unknown_indicator_is_refused():
    with pytest.raises(ValueError, match="have:"):
        I.spec("nope")
    with pytest.raises(ValueError, match="no parameter"):
        I.spec("ema", length=3)


def test_asof_both_ways(spark):
    left = spark.createDataFrame([("k", i) for i in (5, 10, 4000, 9_000_000)], "k string, i long").withColumn("t", F.timestamp_millis("i"))
    right = spark.createDataFrame([("k", i, float(i)) for i in (10, 20, 5000)], "k string, j long, v double").withColumn("u", F.timestamp_millis("j")).drop("j")
    for bucket in (7, 1000, 10_000_000):
        b = {r.i: r.v for r in A.asof(left, right, ["k"], "t", "u", ["v"], bucket_ms=bucket).collect()}
        assert b == {5: None, 10: 10.0, 4000: 20.0, 9_000_000: 5000.0}
        f = {r.i: r.v for r in A.asof(left, right, ["k"], "t", "u", ["v"], "forward", bucket_ms=bucket).collect()}
        assert f == {5: 10.0, 10: 10.0, 4000: 5000.0, 9_000_000: None}
    t = A.asof(left, right, ["k"], "t", "u", ["v"], "forward", tolerance_ms=5).collect()
    assert {r.i: r.v for r in t} == {5: 10.0, 10: 10.0, 4000: None, 9_000_000: None}


def test_thinning_crosses_blocks(spark, monkeypatch):
    rows = [("s", i, i + 7) for i in range(0, 60, 2)]
    d = spark.createDataFrame(rows, "series string, idx long, until long")
    full = L.fsm
    monkeypatch.setattr(O, "fsm", lambda *a, **k: full(*a, **{**k, "size": 5}))
    got = sorted(r.idx for r in O.thin(d, ["series"], "until").collect())
    want, free = [], -1
    for _, i, u in rows:
        if i > free:
            want.append(i)
            free = u
    assert got == want
