"""Causal indicators over indexed bars (columns series, time, open, high, low, close, volume, idx).

Frame indicators run in ``blocked`` windows, smoothed ones in ``scan``, state machines in ``fsm``.  A value
that is not warm yet is NULL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import clock, scalars as S
from ..plans.longseries import blocked, carry, fsm, scan

KEY = ["series"]

# fixed values: indicator ids, ordered parameters with defaults, outputs
INDICATORS = {
    "sma": ({"period": 20}, ["sma"]), "ema": ({"period": 21}, ["ema"]), "rsi": ({"period": 14}, ["rsi"]),
    "macd": ({"fast": 12, "slow": 26, "signal": 9}, ["macd", "signal", "histogram"]),
    "bbands": ({"period": 20, "mult": 2.0}, ["upper", "middle", "lower"]), "atr": ({"period": 14}, ["atr"]),
    "vwap": ({"sessionMs": 86_400_000}, ["vwap"]), "stoch": ({"period": 14, "smoothK": 3, "smoothD": 3}, ["k", "d"]),
    "stochrsi": ({"rsiPeriod": 14, "period": 14, "smoothK": 3, "smoothD": 3}, ["k", "d"]),
    "adx": ({"period": 14}, ["adx", "plusDi", "minusDi"]), "donchian": ({"period": 20}, ["upper", "middle", "lower"]),
    "keltner": ({"period": 20, "atrPeriod": 10, "mult": 1.5}, ["upper", "middle", "lower"]),
    "swing": ({"left": 3, "right": 3}, ["high", "low", "highAt", "lowAt"]),
    "supertrend": ({"period": 10, "mult": 3.0}, ["supertrend", "direction"]),
    "zigzag": ({"k": 3.0, "atrPeriod": 14}, ["zigzag", "direction"]), "avwap": ({"anchor": 1}, ["avwap"]),
    "cmp": ({"period": 2, "atrPeriod": 14}, ["change", "atr", "close"]),
}


def _num(v) -> str:
    return str(int(v)) if float(v) == int(v) else str(float(v)).replace(".", "p")


def spec(ind: str, source: str = "close", **params) -> dict:
    """A fully resolved indicator request; unknown ids and parameters are refused."""
    if ind not in INDICATORS:
        raise ValueError(f"unknown indicator {ind} (have: {', '.join(INDICATORS)})")
    defaults, _ = INDICATORS[ind]
    unknown = set(params) - set(defaults)
    if unknown:
        raise ValueError(f"{ind} has no parameter {', '.join(sorted(unknown))}")
    return {"id": ind, "source": source, "params": {k: params.get(k, v) for k, v in defaults.items()}}


def column_key(s: dict, output: str | None = None) -> str:
    """``ema_21`` for one-output indicators, ``macd_12_26_9_signal`` otherwise."""
    base = "_".join([s["id"], *[_num(v) for v in s["params"].values()]])
    if s["source"] != "close":
        base += "_" + s["source"]
    outs = INDICATORS[s["id"]][1]
    return base if len(outs) == 1 else f"{base}_{output}"


# -- building blocks ------------------------------------------------------------------------------

def true_range_expr(f) -> Column:
    pc = f.lag("close")
    r = F.col("high") - F.col("low")
    return F.coalesce(F.greatest(r, F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)), r)


def base_moves(d: DataFrame, f) -> DataFrame:
    """True range, gains and losses, directional moves; the first row of a series has only a range."""
    diff = F.col("close") - f.lag("close")
    up, down = F.col("high") - f.lag("high"), f.lag("low") - F.col("low")
    tr = true_range_expr(f)
    return d.select("*", tr.alias("_tr"), F.when(diff.isNotNull(), F.greatest(diff, F.lit(0.0))).alias("_gain"),
                    F.when(diff.isNotNull(), F.greatest(-diff, F.lit(0.0))).alias("_loss"),
                    F.when(up.isNotNull(), F.when((up > down) & (up > 0), up).otherwise(0.0)).alias("_pdm"),
                    F.when(up.isNotNull(), F.when((down > up) & (down > 0), down).otherwise(0.0)).alias("_mdm"),
                    F.when(diff.isNotNull(), tr).alias("_tr1"), S.hlc3().alias("_hlc3"))


BASE_LEAD = {"_tr": 0, "_gain": 1, "_loss": 1, "_pdm": 1, "_mdm": 1, "_tr1": 1, "open": 0, "high": 0, "low": 0,
             "close": 0, "_hlc3": 0}
BASE_COLS = ["_tr", "_gain", "_loss", "_pdm", "_mdm", "_tr1", "_hlc3"]


def rsi_expr(gain: str, loss: str) -> Column:
    g, ls = F.col(gain), F.col(loss)
    return F.when(g.isNull() | ls.isNull(), None).when(ls == 0, 100.0).otherwise(
        100.0 - 100.0 / (1.0 + F.try_divide(g, ls)))


def compute(bars: DataFrame, specs: list[dict], companion: DataFrame | None = None) -> DataFrame:
    """Add every requested indicator.  Equal specs and shared inputs are computed once:

    one pass for all smoothing of the bars, one for the smoothing of smoothed values (ADX, MACD signal), one
    for all frames, and one pass per state machine."""
    want = {}
    for s in specs:
        want[tuple([s["id"], s["source"], *s["params"].values()])] = s
    specs = list(want.values())
    cols = list(bars.columns)
    first, second, exprs, frames = {}, {}, [], []
    lead2 = {}
    back = 0

    def smooth(kind, c, n):
        name = f"_{kind}{n}{c}"
        first[name] = (name, c, kind, int(n))
        return name

    def src(s):
        return "_hlc3" if s["source"] == "hlc3" else s["source"]

    machines, later = [], []
    for s in specs:
        p, ind = s["params"], s["id"]
        k = lambda o=None, s=s: column_key(s, o)
        if ind == "ema":
            exprs.append((k(), F.col(smooth("ema", src(s), p["period"]))))
        elif ind == "atr":
            exprs.append((k(), F.col(smooth("rma", "_tr", p["period"]))))
        elif ind == "rsi":
            exprs.append((k(), rsi_expr(smooth("rma", "_gain", p["period"]), smooth("rma", "_loss", p["period"]))))
        elif ind == "keltner":
            m, a = smooth("ema", "close", p["period"]), smooth("rma", "_tr", p["atrPeriod"])
            mid = F.col(m)
            band = F.col(a) * float(p["mult"])
            exprs += [(k("upper"), mid + band), (k("middle"), mid), (k("lower"), mid - band)]
        elif ind == "macd":
            a, b = smooth("ema", "close", p["fast"]), smooth("ema", "close", p["slow"])
            line = k("macd")
            exprs.append((line, F.col(a) - F.col(b)))
            second[k("signal")] = (k("signal"), line, "ema", int(p["signal"]))
            lead2[line] = max(int(p["fast"]), int(p["slow"])) - 1
            later.append((k("histogram"), lambda line=line, sg=k("signal"): F.col(line) - F.col(sg)))
        elif ind == "adx":
            n = p["period"]
            tr, pl, mi = (smooth("rma", c, n) for c in ("_tr1", "_pdm", "_mdm"))
            live = F.when(F.col(tr) != 0, F.col(tr))
            pd_, md = 100.0 * F.col(pl) / live, 100.0 * F.col(mi) / live
            dx = f"_dx{n}"
            exprs += [(k("plusDi"), pd_), (k("minusDi"), md),
                      (dx, F.when(pd_.isNotNull(), F.coalesce(F.try_divide(100.0 * F.abs(pd_ - md), pd_ + md), F.lit(0.0))))]
            second[k("adx")] = (k("adx"), dx, "rma", int(n))
            lead2[dx] = None
        elif ind == "sma":
            n = int(p["period"])
            frames.append((n - 1, 0, lambda d, f, n=n, s=s, k=k: d.withColumn(k(), f.full(F.avg(src(s)), src(s), -(n - 1), 0))))
        elif ind == "bbands":
            n, m = int(p["period"]), float(p["mult"])

            def bb(d, f, n=n, m=m, k=k):
                mid = f.full(F.avg("close"), "close", -(n - 1), 0)
                sd = f.full(F.stddev_pop("close"), "close", -(n - 1), 0)
                d = d.select("*", mid.alias(k("middle")), sd.alias("_sd"))
                return d.select("*", (F.col(k("middle")) + m * F.col("_sd")).alias(k("upper")),
                                (F.col(k("middle")) - m * F.col("_sd")).alias(k("lower"))).drop("_sd")
            frames.append((n - 1, 0, bb))
        elif ind == "donchian":
            n = int(p["period"])

            def dc(d, f, n=n, k=k):
                hi, lo = f.full(F.max("high"), "high", -n, -1), f.full(F.min("low"), "low", -n, -1)
                return d.select("*", hi.alias(k("upper")), lo.alias(k("lower")), ((hi + lo) / 2).alias(k("middle")))
            frames.append((n, 0, dc))
        elif ind == "stoch":
            n, sk, sd_ = int(p["period"]), int(p["smoothK"]), int(p["smoothD"])

            def st(d, f, n=n, sk=sk, sd_=sd_, k=k):
                hi, lo = f.full(F.max("high"), "high", -(n - 1), 0), f.full(F.min("low"), "low", -(n - 1), 0)
                d = d.select("*", hi.alias("_hi"), lo.alias("_lo"))
                flat = F.abs(F.col("_hi") - F.col("_lo")) < 2.220446049250313e-16
                d = d.withColumn("_raw", F.when(flat, 50.0).otherwise(
                    F.try_divide(F.col("close") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * 100.0))
                d = d.withColumn(k("k"), f.full(F.avg("_raw"), "_raw", -(sk - 1), 0))
                return d.withColumn(k("d"), f.full(F.avg(k("k")), k("k"), -(sd_ - 1), 0)).drop("_hi", "_lo", "_raw")
            frames.append((n + sk + sd_ - 3, 0, st))
        elif ind == "stochrsi":
            r = f"_rsi{p['rsiPeriod']}"
            exprs.append((r, rsi_expr(smooth("rma", "_gain", p["rsiPeriod"]), smooth("rma", "_loss", p["rsiPeriod"]))))
            n, sk, sd_ = int(p["period"]), max(int(p["smoothK"]), 1), max(int(p["smoothD"]), 1)

            def sr(d, f, n=n, sk=sk, sd_=sd_, k=k, r=r):
                hi, lo = f.full(F.max(r), r, -(n - 1), 0), f.full(F.min(r), r, -(n - 1), 0)
                d = d.select("*", hi.alias("_hi"), lo.alias("_lo"))
                span = F.col("_hi") - F.col("_lo")
                d = d.withColumn("_raw", F.when(span > 0, F.try_divide(F.col(r) - F.col("_lo"), span) * 100.0))
                d = d.withColumn(k("k"), f.full(F.avg("_raw"), "_raw", -(sk - 1), 0))
                return d.withColumn(k("d"), f.full(F.avg(k("k")), k("k"), -(sd_ - 1), 0)).drop("_hi", "_lo", "_raw")
            frames.append((n + sk + sd_ - 3, 0, sr))
        elif ind in ("supertrend", "zigzag"):
            machines.append(s)
        elif ind in ("vwap", "avwap", "swing", "cmp"):
            machines.append(s)

    d = bars
    if first:
        d = scan(d, KEY, list(first.values()), base_moves, 1, BASE_LEAD)
    elif any(s["source"] == "hlc3" for s in specs):
        d = d.withColumn("_hlc3", S.hlc3())
    if exprs:
        d = d.select("*", *[e.alias(n) for n, e in dict(exprs).items()])
    fixed = [v for v in second.values() if lead2[v[1]] is not None]
    data = [v for v in second.values() if lead2[v[1]] is None]
    if fixed:
        d = scan(d, KEY, fixed, lead=lead2)
    if data:
        d = scan(d, KEY, data, lead=None)
    if later:
        d = d.select("*", *[e().alias(n) for n, e in later])
    if frames:
        back = max(b for b, _, _ in frames)

        def all_frames(x, f):
            for _, _, fn in frames:
                x = fn(x, f)
            return x
        d = blocked(d, KEY, all_frames, back=back)
    # Every state machine and swing starts from the bars again and joins on the row number: chaining them would
    # repeat the whole plan under each one.
    for s in machines:
        p, k = s["params"], (lambda o=None, s=s: column_key(s, o))
        if s["id"] == "supertrend":
            src_ = scan(bars, KEY, [("_atr", "_tr", "rma", int(p["period"]))], base_moves, 1, BASE_LEAD)
            d = d.join(supertrend(src_, "_atr", float(p["mult"]), k("supertrend"), k("direction")), ["series", "idx"])
        elif s["id"] == "zigzag":
            src_ = scan(bars, KEY, [("_atr", "_tr", "rma", int(p["atrPeriod"]))], base_moves, 1, BASE_LEAD)
            d = d.join(zigzag(src_, "_atr", float(p["k"]), k("zigzag"), k("direction"), bars), ["series", "idx"])
        elif s["id"] == "vwap":
            d = vwap(d, int(p["sessionMs"]), k())
        elif s["id"] == "avwap":
            d = anchored_vwap(d, int(p["anchor"]), k())
        elif s["id"] == "swing":
            names = [k("high"), k("low"), k("highAt"), k("lowAt")]
            d = d.join(swing(bars, int(p["left"]), int(p["right"]), *names).select("series", "idx", *names), ["series", "idx"])
        elif s["id"] == "cmp":
            names = [k("change"), k("atr"), k("close")]
            d = aligned_change(d, companion, int(p["period"]), int(p["atrPeriod"]), names)
    outs = [column_key(s, o) for s in specs for o in INDICATORS[s["id"]][1]]
    return d.select(*cols, *dict.fromkeys(outs))


def with_atr(bars: DataFrame, period: int = 14, name: str = "atr") -> DataFrame:
    return compute(bars, [spec("atr", period=period)]).withColumnRenamed(f"atr_{period}", name)


# -- single indicators that need their own pass ---------------------------------------------------

def vwap(d: DataFrame, session_ms: int, name: str) -> DataFrame:
    """Running volume-weighted typical price inside floor(t / session); groups are one session long."""
    w = (Window.partitionBy("series", F.floor(S.ms("time") / session_ms)).orderBy("time")
         .rowsBetween(Window.unboundedPreceding, 0))
    v = F.when(F.col("volume") > 0, F.col("volume")).otherwise(1.0)
    return d.withColumn(name, F.sum(S.hlc3() * v).over(w) / F.sum(v).over(w))


def anchored_vwap(d: DataFrame, anchor_days: int, name: str) -> DataFrame:
    """Mean typical price since the broker day (1) or week (7) began; other anchors give NULL."""
    if anchor_days not in (1, 7):
        return d.withColumn(name, F.lit(None).cast("double"))
    key = clock.broker_day("time") if anchor_days == 1 else clock.broker_week("time")
    w = Window.partitionBy("series", key).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn(name, F.avg(S.hlc3()).over(w))


def swing_points(bars: DataFrame, left: int, right: int) -> DataFrame:
    """Marks strict fractals: ``is_high`` / ``is_low`` on the bar itself."""
    def mark(d, f):
        def best(agg, c):
            before = f.full(agg(c), c, -left, -1) if left else None
            after = f.full(agg(c), c, 1, right) if right else None
            return before, after
        h, lo = F.col("high"), F.col("low")
        (hb, ha), (lb, la) = best(F.max, "high"), best(F.min, "low")
        is_high = F.lit(True)
        is_low = F.lit(True)
        for x in (hb, ha):
            if x is not None:
                is_high = is_high & (x < h)
        for x in (lb, la):
            if x is not None:
                is_low = is_low & (x > lo)
        return d.select("*", F.coalesce(is_high, F.lit(False)).alias("is_high"), F.coalesce(is_low, F.lit(False)).alias("is_low"))
    return blocked(bars, KEY, mark, back=left, ahead=right)


def swing(d: DataFrame, left: int, right: int, high: str, low: str, high_at: str, low_at: str) -> DataFrame:
    """Last confirmed swing high / low as of each bar and the bar index it formed on."""
    m = swing_points(d, left, right)

    def confirm(x, f):
        return x.select("*", *[F.when(f.lag(flag, right) if right else F.col(flag),
                                      f.lag(c, right) if right else F.col(c)).alias(o)
                               for flag, c, o in (("is_high", "high", "_h"), ("is_low", "low", "_l"),
                                                  ("is_high", "idx", "_ha"), ("is_low", "idx", "_la"))])
    m = blocked(m, KEY, confirm, back=right)
    m = carry(m, KEY, {high: ("last", "_h"), low: ("last", "_l"), high_at: ("last", "_ha"), low_at: ("last", "_la")})
    return m.drop("is_high", "is_low", "_h", "_l", "_ha", "_la")


def aligned_change(d: DataFrame, companion: DataFrame, period: int, atr_period: int, names: list[str],
                   interval_ms: int | None = None) -> DataFrame:
    """Companion close, ATR and gap-free change at exactly equal times; NULL where it has no bar.

    ``companion`` is an indexed series (or several, matched on ``series``).  Without ``interval_ms`` the
    smallest step of the companion is used."""
    c = with_atr(companion, atr_period, "_catr")
    c = blocked(c, KEY, lambda x, f: x.select("*", f.lag("close", period).alias("_pc"), f.lag("time", period).alias("_pt"),
                                              (S.ms("time") - S.ms(f.lag("time"))).alias("_dt")), back=period)
    if interval_ms is None:
        steps = c.groupBy("series").agg(F.min("_dt").alias("_step"))
        c = c.join(steps, "series")
        step = F.col("_step")
    else:
        step = F.lit(interval_ms)
    change = F.when(S.ms("time") - S.ms("_pt") == step * period, F.col("close") - F.col("_pc"))
    c = c.select("series", "time", change.alias(names[0]), F.col("_catr").alias(names[1]), F.col("close").alias(names[2]))
    return d.join(c, ["series", "time"], "left")


def _supertrend_fold(mult: float, atr: str, line: str, direction: str):
    def run(pdf: pd.DataFrame, state: list[float]):
        upper, lower, way, prev = state
        hi, lo, cl, at = (pdf[c].to_numpy() for c in ("high", "low", "close", atr))
        out, dirs = np.full(len(pdf), np.nan), np.full(len(pdf), np.nan)
        for t in range(len(pdf)):
            a = at[t]
            if a == a:
                mid, pad = (hi[t] + lo[t]) / 2.0, mult * a
                top, bottom = mid + pad, mid - pad
                if upper != upper:
                    upper, lower = top, bottom
                else:
                    if top < upper or prev > upper:
                        upper = top
                    if bottom > lower or prev < lower:
                        lower = bottom
                way = 1.0 if cl[t] > upper else -1.0 if cl[t] < lower else way
                dirs[t], out[t] = way, lower if way > 0 else upper
            prev = cl[t]
        return pd.DataFrame({"idx": pdf["idx"].to_numpy(), line: out, direction: dirs}), [upper, lower, way, prev]
    return run


def supertrend(d: DataFrame, atr: str, mult: float, line: str, direction: str) -> DataFrame:
    out = T.StructType([T.StructField("idx", T.LongType()), T.StructField(line, T.DoubleType()),
                        T.StructField(direction, T.DoubleType())])
    nan = float("nan")
    r = fsm(d, KEY, _supertrend_fold(mult, atr, line, direction), [nan, nan, 1.0, nan], out,
            cols=["idx", "high", "low", "close", atr])
    r = r.select("series", "idx", S.finite(line).alias(line), S.finite(direction).alias(direction))
    return r


PIVOTS = T.StructType([T.StructField("confirmed_idx", T.LongType()), T.StructField("pivot_idx", T.LongType()),
                       T.StructField("price", T.DoubleType()), T.StructField("is_high", T.BooleanType())])


def _zigzag_fold(k: float, atr: str, hindsight: bool = False):
    """Fold of a run of bars: the extreme of the leg, its bar, the leg's direction (0 before the first).

    ``hindsight``: a bar that extends its leg cannot turn it, the anchor stays where the ATR begins, and the anchor is no
    pivot.  A block whose incoming state is not known yet starts at its own first close; its end state soon agrees with
    the true one, so that few blocks have to run a third time."""
    def run(pdf: pd.DataFrame, state: list[float]):
        extreme, since, way = state
        turns = []
        columns = [pdf[c].to_numpy() for c in ("idx", "high", "low", "close", atr)]
        if extreme != extreme and not hindsight:
            extreme, since = columns[3][0], columns[0][0]
        for i, high, low, close, a in zip(*columns):
            if a != a:
                continue
            if extreme != extreme:
                extreme, since = close, i
            beyond = (high if way > 0 else low) if way and (high > extreme if way > 0 else low < extreme) else None
            if beyond is not None:
                extreme, since = beyond, i
                if hindsight:
                    continue
            rise, fall = way <= 0 and high - extreme > k * a, way >= 0 and extreme - low > k * a
            if rise or fall:
                if way or not hindsight:
                    turns.append((i, since, extreme, not rise))
                extreme, since, way = (high, i, 1.0) if rise else (low, i, -1.0)
            elif not way and not hindsight and (high > extreme if close >= extreme else low < extreme):
                extreme, since = (high if close >= extreme else low), i
        out = pd.DataFrame(turns, columns=[f.name for f in PIVOTS])
        return out.astype({"confirmed_idx": "int64", "pivot_idx": "int64", "price": "float64", "is_high": "bool"}), [extreme, float(since), way]
    return run


def zigzag_pivots(d: DataFrame, atr: str, k: float, hindsight: bool = False) -> DataFrame:
    """Confirmed pivots: the leg turns when price retraces more than ``k`` ATRs of the current bar."""
    nan = float("nan")
    return fsm(d, KEY, _zigzag_fold(k, atr, hindsight), [nan, nan, 0.0], PIVOTS, cols=["idx", "high", "low", "close", atr])


def zigzag(d: DataFrame, atr: str, k: float, line: str, direction: str, bars: DataFrame) -> DataFrame:
    p = zigzag_pivots(d, atr, k).select("series", F.col("confirmed_idx").alias("idx"), F.col("price").alias("_z"),
                                        F.when(F.col("is_high"), -1.0).otherwise(1.0).alias("_zd"))
    j = bars.select("series", "idx").join(p, ["series", "idx"], "left")
    return carry(j, KEY, {line: ("last", "_z"), direction: ("last", "_zd")}).drop("_z", "_zd")


# -- other windows --------------------------------------------------------------------------------

def atr_from_closes(bars: DataFrame, period: int) -> DataFrame:
    """Mean range of the last ``period`` bars against the previous close, for close-only bars."""
    def mean(d, f):
        d = d.withColumn("_tr", F.when(f.lag("close").isNotNull(), true_range_expr(f)))
        return d.withColumn("atr", F.avg("_tr").over(f.rows(-(period - 1), 0))).drop("_tr")
    return blocked(bars, KEY, mean, back=period)


def efficiency(bars: DataFrame, n: int) -> DataFrame:
    """|net move| / travelled path over the last ``n`` bars, and the sign of the net move."""
    def eff(d, f):
        d = d.withColumn("_d", F.abs(F.col("close") - f.lag("close")))
        net = F.col("close") - f.lag("close", n)
        return d.select("*", F.try_divide(F.abs(net), f.full(F.sum("_d"), "_d", -(n - 1), 0)).alias("efficiency"),
                        F.signum(net).alias("slope")).drop("_d")
    return blocked(bars, KEY, eff, back=n + 1)


def bars_since_extreme(bars: DataFrame, n: int) -> DataFrame:
    """Bars since the n-bar high and low, the latest bar on ties."""
    def since(d, f):
        w = f.rows(-(n - 1), 0)
        full = F.count("high").over(w) == n
        hi = F.max_by("idx", F.struct("high", "idx")).over(w)
        lo = F.max_by("idx", F.struct(-F.col("low"), F.col("idx"))).over(w)
        return d.select("*", F.when(full, F.col("idx") - hi).alias("since_high"), F.when(full, F.col("idx") - lo).alias("since_low"))
    return blocked(bars, KEY, since, back=n - 1)
