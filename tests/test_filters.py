"""Gates, flat windows, self-managed trades, interval unions and pairs, on small made-up bars."""

import random

from pyspark.sql import functions as F

from tapelib.operators import filters as X, joins as J, outcomes as O, signals as G

LEVELS = (("open", 100.0), ("high", 100.4), ("low", 99.6), ("close", 100.0), ("atr", 5.0))


def flat_bars(spark, n=400, start=1_704_090_600):  # 2024-01-01 01:30 in New York
    return spark.range(n).select(F.lit("x").alias("series"), F.col("id").alias("idx"), F.timestamp_seconds(F.lit(start) + F.col("id") * 900).alias("time"), *[F.lit(v).alias(c) for c, v in LEVELS], F.lit(1.0).alias("volume"))


def entries(spark, rows):
    return spark.createDataFrame(rows, "series string, cell string, idx long, side int, stop double, target double, self_managed boolean")


def test_flat_window_stops_entries_and_closes_trades(spark):
    b = flat_bars(spark)
    table = X.gate_table(b, [X.hours(800, 1600)], flat=[(1530, 1700)])
    rows = {r.idx: r for r in table.collect()}
    minute = lambda i: (90 + 15 * i) % 1440
    assert all((r.allowed, r.flat) == (480 <= minute(i) < 960, 930 <= minute(i) < 1020) for i, r in rows.items())
    d = b.select("series", "idx", "time", F.lit("c").alias("cell"), F.lit(False).alias("self_managed"), F.when(F.col("idx") % 10 == 0, 1).alias("side"), F.lit(None).cast("double").alias("stop"), F.lit(None).cast("double").alias("target"),
                 F.lit(False).alias("exit_long"), F.lit(False).alias("exit_short"))
    f = X.filtered(d, table)
    got = O.first_touch(f.filter("side IS NOT NULL"), b, O.Rules(spread=0.0, max_hold_ms=0), flags=f).collect()
    assert {r.idx for r in got} == {i for i in range(0, 400, 10) if 480 <= minute(i) < 930}
    for r in got:  # closed at the open after the first flat bar at or after the entry
        first = next((i for i in range(r.idx + 1, 400) if 930 <= minute(i) < 1020), None)
        assert (r.exit_kind, r.held) == (("SIGNAL", first + 1 - r.idx) if first is not None and first + 1 < 400 else ("END_OF_DATA", 399 - r.idx))


def test_self_managed_trades_have_no_engine_exits(spark):
    b = flat_bars(spark, 300)
    got = {r.cell: r for r in O.first_touch(entries(spark, [("x", "own", 5, 1, 99.9, None, True), ("x", "engine", 5, 1, 99.9, None, False), ("x", "none", 5, 1, None, None, True)]), b, O.Rules(spread=0.0, max_hold_ms=3_600_000)).collect()}
    assert (got["engine"].exit_kind, got["own"].exit_kind, got["own"].held, got["none"].risk) == ("STOP", "END_OF_DATA", 294, 6.0)
    assert got["own"].target is None and abs(got["own"].risk - 0.1) < 1e-9
    zero = O.first_touch(entries(spark, [("x", "c", 5, 1, 90.0, None, False)]), b, O.Rules(spread=0.0, max_hold_ms=0, reward_risk=0.0)).first()
    assert (zero.target, zero.exit_kind) == (None, "END_OF_DATA")
    assert all(r.self_managed == (G.lookup("buy-and-hold").exits == "strategy") for r in G.signals(b, [("h", "buy-and-hold", {})]).collect())


def test_unions_of_intervals(spark):
    rnd = random.Random(6)
    rows = [(k, s := rnd.randrange(0, 3000), s + rnd.randrange(0, 60)) for k in "ab" for _ in range(80)] + [("c", 5, 5), ("d", 1, 9), ("d", 9, 12)]
    d = spark.createDataFrame(rows, "k string, a long, z long").select("k", F.timestamp_seconds(F.col("a") * 3600).alias("start"), F.timestamp_seconds(F.col("z") * 3600).alias("stop"))
    u = J.union_intervals(d, ["k"], "start", "stop")
    got = {}
    for r in u.collect():
        got.setdefault(r.k, []).append((int(r.start.timestamp()) // 3600, int(r.stop.timestamp()) // 3600))
    hours = {k: {h for kk, a, z in rows if kk == k for h in range(a, z)} for k in "abcd"}
    for k, spans in got.items():
        spans.sort()
        assert all(z1 < a2 for (_, z1), (a2, _) in zip(spans, spans[1:]))
        assert {h for a, z in spans for h in range(a, z)} == hours[k]
    assert "c" not in got and got["d"] == [(1, 12)]
    times = spark.createDataFrame([(k, h) for k in "abcd" for h in range(0, 3100, 7)], "k string, h long").withColumn("time", F.timestamp_seconds(F.col("h") * 3600))
    assert all(r.held == (r.h in hours[r.k]) for r in J.inside(times, u, ["k"], "held").collect())


def test_pairs_in_one_join(spark):
    rows = [(s, t, float(i + 10 * t)) for i, s in enumerate("abc") for t in range(30) if (t + i) % 4]
    b = spark.createDataFrame(rows, "series string, t long, v double").select("series", F.timestamp_seconds(F.col("t") * 60).alias("time"), *[F.col("v").alias(c) for c in ("open", "high", "low", "close")])
    got = {(r.series, int(r.time.timestamp()) // 60): (r.a_close, r.b_close) for r in J.pair_table(b, J.all_pairs(b)).collect()}
    at = {(s, t): v for s, t, v in rows}
    assert got == {(f"{p}/{q}", t): (at[p, t], at[q, t]) for p in "abc" for q in "abc" if p < q for t in range(30) if (p, t) in at and (q, t) in at}
