"""Hand cases for the rules that ties, clocks and rounding decide."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapelib.functions import clock, scalars as S
from tapelib.operators import flow, indicators as I, levels, metrics as M, outcomes as O, profile, signals as G, stats as X, structure as X2, timeline as TL
from tapelib.plans.longseries import with_index
from tapelib.sources import bar_store, payloads, tables, tape as store


def one(spark, *cols):
    return list(spark.range(1).select(*cols).first())


def ts(s):
    return F.lit(s).cast("timestamp")


def test_rounding_goes_up_at_halves(spark):
    assert one(spark, S.js_round(F.lit(-2.5)), S.js_round(F.lit(2.5)), S.js_round(F.lit(-0.125), 2)) == [-2.0, 3.0, -0.12]


def test_aggressor_inference(spark):
    q = lambda p, b, a, v: S.infer_aggressor(F.lit(p), F.lit(b).cast("double"), F.lit(a).cast("double"), F.lit(v).cast("double"))
    got = one(spark, q(2.0, 1.0, 2.0, None), q(1.0, 1.0, 2.0, None), q(1.6, 1.0, 2.0, None), q(1.5, 1.0, 2.0, 1.4), q(1.5, 2.0, 1.0, 1.6), q(1.5, None, None, None))
    assert got == ["BUY", "SELL", "BUY", "BUY", "SELL", "UNKNOWN"]


def test_new_york_clock_over_the_switch(spark):
    got = one(spark, clock.ny_minute(ts("2026-03-08 06:59:00")), clock.ny_minute(ts("2026-03-08 07:00:00")), clock.ny_minute(ts("2026-11-01 05:59:00")), clock.ny_minute(ts("2026-11-01 06:00:00")), clock.ny_weekday(ts("2026-03-08 12:00:00")))
    assert got == [119, 180, 119, 60, 0]


def test_swap_nights(spark):
    n = lambda a, b: clock.swap_nights(ts(a), ts(b))
    got = one(spark, n("2026-09-14 14:00:00", "2026-09-14 20:00:00"), n("2026-09-14 14:00:00", "2026-09-14 22:00:00"), n("2026-09-15 14:00:00", "2026-09-16 22:00:00"), n("2026-09-14 14:00:00", "2026-09-21 14:00:00"), n("2026-09-15 00:00:00", "2026-09-14 00:00:00"))
    assert got == [0, 1, 4, 9, 0]


def board(spark, rows):
    d = spark.createDataFrame([("m", "s", *r) for r in rows], "market string, symbol string, option_type string, strike double, contracts double, premium_usd double, aggressor_side string")
    return d.withColumn("trade_price", F.col("premium_usd") / F.col("contracts") / 100).withColumn("flow_class", S.flow_class())


def test_max_pain_takes_the_lower_strike(spark):
    d = board(spark, [("CALL", 10.0, 1.0, 1.0, "BUY"), ("PUT", 20.0, 1.0, 1.0, "BUY")])
    assert profile.max_pain(profile.positioning(d), 100.0).first().max_pain == 10.0


def test_value_area_prefers_the_upper_side(spark):
    d = board(spark, [("CALL", k, 1.0, p, "BUY") for k, p in ((1.0, 5.0), (2.0, 10.0), (3.0, 5.0), (4.0, 1.0))])
    r = profile.profile_levels(profile.strike_profile(d), 0.7).first()
    assert (r.poc, r.vah, r.val, r.above_poc, r.under_poc) == (2.0, 3.0, 2.0, 3.0, 1.0)


def test_payoff_root_equals_bisection(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    for s in range(20):
        legs = [(rnd.choice(["CALL", "PUT"]), float(rnd.randint(5, 30)), float(rnd.randint(1, 9)), rnd.random() * 4000) for _ in range(12)]
        rows += [("m", f"s{s}", *x, "BUY") for x in legs]
        for kind in ("CALL", "PUT"):
            mine = [x for x in legs if x[0] == kind]
            if not mine:
                continue
            cost, up = sum(x[3] for x in mine) / 100, kind == "CALL"
            lo, hi = (min(x[1] for x in mine), 3 * max(x[1] for x in mine)) if up else (0.0, max(x[1] for x in mine))
            for _ in range(120):
                mid = (lo + hi) / 2
                pay = sum(max(mid - x[1] if up else x[1] - mid, 0) * x[2] for x in mine)
                if pay < cost if up else pay > cost:
                    lo = mid
                else:
                    hi = mid
            want[f"s{s}", kind] = (lo + hi) / 2
    d = spark.createDataFrame(rows, "market string, symbol string, option_type string, strike double, contracts double, premium_usd double, aggressor_side string")
    for r in profile.aggregate_payoff(d, 100.0).collect():
        for kind, v in (("CALL", r.call_be), ("PUT", r.put_be)):
            if (r.symbol, kind) in want:
                assert math.isclose(v, want[r.symbol, kind], rel_tol=1e-9)


def test_clusters_chain_and_score(spark):
    d = spark.createDataFrame([("m", "a", "e1", 1.0, "POC", 10.0, 1.0, False), ("m", "a", "e1", 1.0, "WSUP", 10.4, 1.0, True), ("m", "b", "e2", 1.0, "POC", 10.8, 2.0, False), ("m", "b", "e2", 1.0, "WRES", 20.0, 1.0, True)],
                              "market string, symbol string, expiration string, dte double, level_type string, price double, weight double, experimental boolean")
    r = levels.cluster_levels(d, 0.5).orderBy("rank").collect()
    assert [x.low for x in r] == [10.0, 20.0] and math.isclose(r[0].score, 4 * 1.25 * 1.35) and math.isclose(r[0].center, 10.5)


def test_venue_trades_parse_a_line_once(spark):
    good = '{"trade_id":"a","instrument_name":"BTC-8SEP26-83000-C","timestamp":1,"price":0.1,"amount":2,"index_price":100,"iv":50,"direction":"buy"}'
    lines = spark.createDataFrame([(good,), (good.replace("-C", "-X"),), (good.replace("8SEP", "31SEP"),), (good.replace('"amount":2,', ""),), ("no json",), (None,)], "value string")
    d = payloads.venue_trades(lines, "v").select("id", "symbol", "strike", "option_type", "expiration", "premium_usd")
    assert [tuple(r)[:4] for r in d.collect()] == [("a", "BTC-8SEP26", 83000.0, "CALL")]
    assert d._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_content_ids_number_repeats(spark):
    d = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "v string, o int")
    ids = [r.content_id for r in flow.with_content_ids(d, ["v"], ["o"], F.floor(F.col("o") / 2)).orderBy("o").collect()]
    assert ids[1] == ids[0] + "-1" and ids[2] != ids[0]


def test_content_ids_shuffle_prints_once(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [(rnd.choice(["x", "x", "y", "z", None]), o) for o in range(300)]
    d = spark.createDataFrame(rows, "v string, o int").repartition(3)
    seen, want = {}, {}
    for v, o in rows:
        want[o] = n = seen.get(v, 0)
        seen[v] = n + 1
    for large in (0, 70, 500_000):  # all contents bucket by bucket, some, none
        monkeypatch.setattr(flow, "LARGE_SHARE", large)
        got = flow.with_content_ids(d, ["v"], ["o"], F.floor(F.col("o") / 7))
        found = {r.o: r.content_id for r in got.collect()}
        assert len(found) == 300 and {o: int(x.partition("-")[2] or 0) for o, x in found.items()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()  # 32 bytes a content, not its text of 64
    assert "hashpartitioning(_digest#" in plan and "hashpartitioning(content#" not in plan


def test_timeline_equals_a_rescan(spark, sf):
    from tapelib.operators.levels import Settings
    s = Settings(big=flow.BigPrints(min_premium=95_000.0, window=50), cluster_floor=0.05)
    p, step = tables.prints(spark, sf), 86_400_000 * 200
    ctx = TL.step_contexts(p, step, s).toPandas()
    d = TL.with_steps(p, step)
    for k in sorted(ctx.step.unique())[1::5]:
        naive = levels.contexts(d.filter(F.col("step") <= int(k)), s).toPandas().set_index("symbol").sort_index()
        mine = ctx[ctx.step == k].set_index("symbol").sort_index()
        assert list(mine.index) == list(naive.index)
        for c in ("max_pain", "poc", "vah", "val", "above_poc", "under_poc", "call_be", "put_be", "bull_ratio", "dte", "spot"):
            pd.testing.assert_series_equal(mine[c].astype(float), naive[c].astype(float), rtol=1e-9, check_names=False)
        for c in ("w_sup", "w_res"):  # carried levels may exist where the re-scan has none
            both = naive[c].notna()
            pd.testing.assert_series_equal(mine[c][both].astype(float), naive[c][both].astype(float), check_names=False)


def test_large_print_levels_at_every_step_equal_a_rescan(spark, sf):
    """Levels of all steps, carried ones included, and empty steps: half-day steps over daily prints."""
    cfg = flow.BigPrints(min_premium=60_000.0, min_contracts=10.0, window=8)
    p = tables.prints(spark, sf).filter("timestamp < '1995-09-01'")
    d = TL.with_steps(p, 43_200_000)
    clock = TL.step_clock(d).toPandas().set_index("step").sort_index()
    assert list(clock.index) == list(range(int(clock.index.max()) + 1)) and clock.as_of.is_monotonic_increasing
    got = TL.whale_steps(d, TL.step_clock(d), cfg).toPandas().set_index(["symbol", "step"])
    rows = d.select("symbol", "step", "timestamp", "sequence_id", "strike", "option_type", "contracts", "premium_usd", "aggressor_side").toPandas().sort_values(["timestamp", "sequence_id"])
    checked = 0
    for symbol, mine in rows.groupby("symbol"):
        sup = res = None
        for step in range(int(mine.step.min()), int(clock.index.max()) + 1):
            past = mine[mine.step <= step]
            thr = min(np.quantile(past.premium_usd.tail(cfg.window), cfg.percentile), cfg.min_premium)
            big = past[(past.premium_usd >= thr) & (past.contracts >= cfg.min_contracts)]
            q = big.contracts * big.aggressor_side.map({"BUY": 1, "SELL": -1}).fillna(0)
            spot, best = clock.spot[step], {"PUT": [], "CALL": []}
            for (strike, kind), g in big.groupby(["strike", "option_type"]):
                net = float(q[g.index].sum())
                at = big[big.strike == strike]
                if net > 0 and (strike <= spot if kind == "PUT" else strike >= spot):
                    best[kind].append((net, max(zip(at.timestamp, at.sequence_id)), strike))
            sup, res = (max(best["PUT"])[2] if best["PUT"] else sup), (max(best["CALL"])[2] if best["CALL"] else res)
            r = got.loc[symbol, step]
            assert (r.w_sup if r.w_sup == r.w_sup else None, r.w_res if r.w_res == r.w_res else None) == (sup, res), (symbol, step)
            checked += 1
    assert checked == len(got) > 500 and got.w_sup.notna().any()


def test_timeline_settings_are_honoured_or_refused(spark, sf):
    from tapelib.operators.levels import Settings
    p = tables.prints(spark, sf).filter("timestamp < '1995-06-01'")
    with pytest.raises(ValueError, match="no running form of whale"):
        TL.step_contexts(p, 86_400_000, Settings(whale="largest-print"))
    assert TL.step_thresholds(TL.with_steps(p, 86_400_000), ["market"], flow.BigPrints(percentile=None)).agg(F.min("threshold")).first()[0] == math.inf


def test_activity_profile_with_any_number_of_buckets(spark):
    """Windows of far more than thousands of buckets, and of few, against a count bucket by bucket."""
    rnd = random.Random(8)
    rows = []
    for win, scale in ((0, 0.002), (1, 0.7), (2, 5.0)):
        px = 100.0
        for i in range(60):
            px += rnd.gauss(0, 1)
            lo = px - rnd.random()
            rows.append(("s", win, i, lo, lo + rnd.random() * 2, scale * 4))
    d = spark.createDataFrame(rows, "series string, win long, i long, low double, high double, atr double")
    got = {r.win: r for r in X2.activity_profile(d).collect()}
    assert max(r.buckets for r in got.values()) > 5_000
    for win, r in got.items():
        mine = [x for x in rows if x[1] == win]
        size, low = mine[-1][5] / 4, min(x[3] for x in mine)
        n = int((max(x[4] for x in mine) - low) // size) + 1
        count, first = [0] * n, [None] * n
        for _, _, i, lo, hi, _ in mine:
            for b in range(min(int((lo - low) // size), n - 1), min(int((hi - low) // size), n - 1) + 1):
                count[b] += 1
                first[b] = i if first[b] is None else first[b]
        poc = count.index(max(count))
        a = b = poc
        acc, target = count[poc], sum(count) * 0.7
        while acc < target and (a > 0 or b < n - 1):
            below, above = count[a - 1] if a else -1, count[b + 1] if b < n - 1 else -1
            if above >= below:
                b += 1
                acc += above
            else:
                a -= 1
                acc += below
        assert (r.buckets, r.activity, r.activity_in_area, r.poc_age) == (n, sum(count), acc, 59 - first[poc])
        assert math.isclose(r.vah, low + (b + 1) * size) and math.isclose(r.val, low + a * size) and math.isclose(r.poc, low + poc * size + size / 2)


def test_drawdown_composes_over_days(spark):
    rnd = random.Random(5)
    rows, eq, peak, dd = [], 0.0, 0.0, 0.0
    for i in range(200):
        v = rnd.gauss(0, 10)
        eq += v
        peak, dd = max(peak, eq), max(dd, max(peak, eq) - eq)
        rows.append(("c", i, v))
    d = spark.createDataFrame(rows, "cell string, idx long, pnl double").withColumn("exit_time", F.timestamp_seconds(F.col("idx") * 7200))
    r = M.drawdown(d, ["cell"]).first()
    assert math.isclose(r.max_drawdown, dd) and math.isclose(r.peak, peak)


def test_planted_effect_is_found(spark):
    rows = [("s", i % 2, float(i % 7), i, 1.0 if i % 3 else -1.0) for i in range(120)]
    d = spark.createDataFrame(rows, "series string, block int, vol double, idx long, sign double").withColumn("ret", F.col("sign") * 2.0)
    r = X.matched_permutation(d, ["series"], ["block"], 40).first()
    assert math.isclose(r.observed, 2.0) and r.percentile == 100.0 and r.frozen == 0.0


def test_registry_and_grid():
    assert len(G.cells_of("donchian-breakout")) == 9 and len(G.REGISTRY) >= 28
    with pytest.raises(ValueError, match="unknown strategy"):
        G.lookup("nope")


def test_sweep_chain_finds_a_planted_setup(spark):
    """A higher-timeframe gap, a sweep into it, a displaced close, a gap and the retrace; every stage is planted."""
    px = [(100, 101, 99, 100)] * 8 + [(100, 100.2, 90, 91), (91, 91.5, 89, 90), (90, 90.5, 88, 89), (89, 89.5, 87, 88)] + [(88, 89, 87, 88)] * 4
    px += [(88, 89, 87, 88), (88, 92, 88, 91), (91, 94, 90, 92), (92, 92.5, 90, 91), (91, 91.5, 89, 90), (90, 91, 89, 90)]  # swing high 94
    px += [(90, 95, 89.5, 92), (92, 92, 84, 85), (85, 85.5, 80, 81), (81, 83, 80, 82), (82, 88, 81, 84)]
    rows = [("x", i, *map(float, v)) for i, v in enumerate(px)]
    d = spark.createDataFrame(rows, "series string, idx long, open double, high double, low double, close double").withColumn("time", F.timestamp_seconds(F.col("idx") * 3600)).withColumn("volume", F.lit(1.0))
    r = G.sweep_chain(d, 3_600_000, htfFactor=2, swingLeft=2, swingRight=2, pipSize=1.0, minHtfFvgPips=0.1, htfTolerancePips=50.0, minSweepPips=0.5, displacementMult=1.0, minBodyAtrRatio=0.1, minEntryFvgPips=0.1, slBufferPips=0.0, atrPeriod=3).collect()
    assert [(x.side, x.stop) for x in r] == [(-1, 95.0)]


def test_tape_store_is_idempotent_on_read(spark, sf, tmp_path):
    p = store.conform(tables.prints(spark, sf)).filter(F.col("timestamp").between("1998-01-01", "1998-02-01"))
    root = str(tmp_path / "tape")
    for _ in range(2):
        store.append_tape(p, root)
    store.append_tape(p.filter("false"), root)
    r = store.read_range(spark, root, "1998-01-05", "1998-01-20")
    assert r.count() == p.filter((F.col("timestamp") >= "1998-01-05") & (F.col("timestamp") < "1998-01-20")).select("id").distinct().count()
    assert "date" in r._jdf.queryExecution().toString()


def test_calendar_text(spark):
    lines = [("# c", 2024), ("January | 30-31 | Meeting | statement | unknown", 2024), ("April | 30-1 | Meeting | statement | unknown", 2024), ("March | 3 | cancelled | x | y", 2024),
             ("March | 15 | Unscheduled | s | release at 5:00 p.m. EDT March 15, 2020", 2020)]
    got = [str(r.time) for r in bar_store.parse_fed(spark.createDataFrame(lines, "value string, year int")).orderBy("time").collect()]
    assert got == ["2020-03-15 21:00:00", "2024-01-31 19:00:00", "2024-05-01 18:00:00"]
    ecb = bar_store.parse_ecb(spark.createDataFrame([("2022-07-20 | a",), ("2022-07-21 | b",)], "value string"))
    assert [str(r.time) for r in ecb.orderBy("time").collect()] == ["2022-07-20 11:45:00", "2022-07-21 12:15:00"]
    bls = bar_store.parse_bls(spark.createDataFrame([("Consumer Price Index | Dec | January 11, 2024 | 08:30 AM",)], "value string"))
    assert str(bls.first().time) == "2024-01-11 13:30:00"


def test_instrument_names(spark):
    i = payloads.parse_instrument(F.lit("BTC-18SEP26-83000-C"))
    assert [str(v) for v in one(spark, *i.values())] == ["BTC", "BTC-18SEP26", "2026-09-18 08:00:00", "83000.0", "CALL"]
    assert one(spark, *payloads.parse_instrument(F.lit("BTC-PERPETUAL")).values())[2:4] == [None, None]


def test_fingerprint_window_ignores_appends(spark, sf):
    from tapelib.operators.bars import fingerprint
    b = tables.bars(spark, sf)
    old = {r.series: r.digest for r in fingerprint(b.filter("time < '2024-01-10'"), until="2024-01-08").collect()}
    assert old == {r.series: r.digest for r in fingerprint(b, until="2024-01-08").collect()}
    assert old != {r.series: r.digest for r in fingerprint(b, until="2024-01-09").collect()}


def test_outcomes_run_until_the_hold_ends_or_the_series_does(spark):
    """Flat one-minute bars: a four-hour hold ends 241 bars after entry, in a later block; without a limit the series ends it."""
    n = 700
    d = spark.range(n).select(F.lit("x").alias("series"), F.col("id").alias("idx"), F.timestamp_seconds(F.col("id") * 60).alias("time"), *[F.lit(v).alias(c) for c, v in (("open", 100.0), ("high", 100.1), ("low", 99.9), ("close", 100.0), ("atr", 5.0))])
    sig = spark.createDataFrame([("x", "c", 200, 1, None, None), ("x", "c", 600, -1, None, None)], "series string, cell string, idx long, side int, stop double, target double")
    got = {r.idx: r for r in O.first_touch(sig, d, O.Rules(spread=0.0)).collect()}
    assert (got[200].exit_kind, got[200].hold_ms, got[200].held) == ("TIMEOUT", 241 * 60_000, 242)
    assert (got[600].exit_kind, got[600].held) == ("END_OF_DATA", 99)
    free = {r.idx: r for r in O.first_touch(sig, d, O.Rules(spread=0.0, max_hold_ms=0)).collect()}
    assert (free[200].exit_kind, free[200].held) == ("END_OF_DATA", n - 201)


def test_option_signals_read_their_own_market(spark):
    """Two markets with opposite frames at nearly the same time give opposite signals."""
    d = spark.range(60).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("series"), F.col("id").alias("idx"), F.timestamp_seconds(F.col("id") * 60).alias("time"),
                               *[F.lit(v).alias(c) for c, v in (("open", 100.0), ("high", 101.0), ("low", 99.0), ("close", 100.0), ("volume", 1.0))]).withColumn("market", F.col("series"))
    frames = spark.range(60).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("market"), F.col("id").alias("n")).select(
        "market", F.timestamp_seconds(F.col("n") * 60 - F.when(F.col("market") == "a", 2).otherwise(1)).alias("t"), F.lit(None).cast("array<struct<low:double,high:double,center:double,score:double>>").alias("clusters"),
        F.lit(None).cast("array<struct<dte:double>>").alias("contexts"), F.when(F.col("market") == "a", 0.9).otherwise(0.1).alias("bull_ratio_15m"), F.when(F.col("market") == "a", 1.0).otherwise(-1.0).alias("velocity_norm"))
    cell = [("c", "flow-momentum", G.resolve("flow-momentum"))]
    got = {(r.series, r.side) for r in G.signals(d, cell, frames=frames).collect()}
    assert got == {("a", 1), ("b", -1)}
    with pytest.raises(ValueError, match="common column"):
        G.signals(d.drop("market"), cell, frames=frames)


def test_sweep_chain_needs_four_bars_from_sweep_to_entry(spark):
    """The planted setup without its quiet bar: the first touch comes three bars after the sweep, is spent, and none follows."""
    px = [(100, 101, 99, 100)] * 8 + [(100, 100.2, 90, 91), (91, 91.5, 89, 90), (90, 90.5, 88, 89), (89, 89.5, 87, 88)] + [(88, 89, 87, 88)] * 4
    px += [(88, 89, 87, 88), (88, 92, 88, 91), (91, 94, 90, 92), (92, 92.5, 90, 91), (91, 91.5, 89, 90), (90, 91, 89, 90)]
    px += [(90, 95, 89.5, 92), (92, 92, 84, 85), (85, 85.5, 80, 81), (82, 88, 81, 84), (84, 88, 81, 84)]
    rows = [("x", i, *map(float, v)) for i, v in enumerate(px)]
    d = spark.createDataFrame(rows, "series string, idx long, open double, high double, low double, close double").withColumn("time", F.timestamp_seconds(F.col("idx") * 3600)).withColumn("volume", F.lit(1.0))
    r = G.sweep_chain(d, 3_600_000, htfFactor=2, swingLeft=2, swingRight=2, pipSize=1.0, minHtfFvgPips=0.1, htfTolerancePips=50.0, minSweepPips=0.5, displacementMult=1.0, minBodyAtrRatio=0.1, minEntryFvgPips=0.1, slBufferPips=0.0, atrPeriod=3)
    assert r.count() == 0


def test_keyed_models_equal_single_fits(spark):
    """Every key's own optimum, a key of one class and a constant column among them; folds that cannot be fitted are named."""
    from tapelib.operators import model as ML
    rnd = random.Random(11)
    rows = [(k, i, x := rnd.gauss(0, 2), y := rnd.gauss(5, 1), 3.0, int(rnd.random() < 1 / (1 + math.exp(-(x * s + y - 5))))) for k, s in (("a", 1.0), ("b", -0.5)) for i in range(150)]
    rows += [("one", i, float(i), 0.0, 3.0, 1) for i in range(12)]
    d = spark.createDataFrame(rows, "k string, i long, x double, y double, z double, label int").withColumn("t", F.timestamp_seconds(F.col("i") * 86_400))
    got = {r.k: r for r in ML.keyed_fit(d, ["k"], ["x", "y", "z"]).collect()}
    assert all(r.gradient < 1e-6 for r in got.values()) and set(got) == {"a", "b", "one"}
    for k in "ab":
        scale, m = ML.fit(d.filter(F.col("k") == k), ["x", "y", "z"])
        assert np.allclose([got[k].weights[0], *got[k].weights[1:]], [m.intercept, *m.coefficients.toArray()], atol=2e-4)
        assert got[k].weights[3] == 0 and abs(got[k].mean[0] - scale["x"][0]) < 1e-9
    x = ML.fold_table(d, "t", 3, ["k"], ["i"])
    report = {(r.k, r.fold): r for r in ML.fold_report(x, folds=3, keys=["k"]).collect()}
    assert {k for k, r in report.items() if r.skipped} == {("one", f) for f in (1, 2, 3)}
    scored = ML.walk_forward(d, ["x", "y"], "t", 3, keys=["k"], tie=["i"]).collect()
    assert {(r.k, r.fold) for r in scored} == {(k, f) for k in "ab" for f in (1, 2, 3)} and all(0 < r.p < 1 for r in scored)
