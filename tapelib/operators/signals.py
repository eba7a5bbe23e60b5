"""Entry signals as columns.

A strategy is a rule over the columns of one bar and a bounded number of earlier bars.  ``signals`` evaluates
any number of (strategy, parameters) cells in one pass: indicators of all cells are computed once, then every
cell is one struct per bar.  Output rows: series, idx, time, cell, self_managed, side (1 / -1), stop, target; a NULL stop or
target is left to the outcome rules, and self-managed trades have neither: their strategy's exit flags close them.  ``exit_flags`` gives the strategy's own exit conditions per bar."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import candles, clock, scalars as S
from ..plans.longseries import blocked, materialize, with_index
from . import bars as B, indicators as I
from .levels import band_distance

REGISTRY: dict[str, "Strategy"] = {}


@dataclass
class Strategy:
    id: str
    params: dict
    rule: Callable
    specs: Callable = lambda p: []
    back: Callable = lambda p: 1
    warmup: Callable = lambda p: 1
    grid: dict = field(default_factory=dict)
    prep: Callable | None = None      # adds columns that need days, sessions or a companion
    frames: bool = False              # reads option frames joined as of the bar
    exits: str = "engine"


def register(id_: str, params: dict, **kw):
    def add(rule):
        REGISTRY[id_] = Strategy(id_, params, rule, **kw)
        return rule
    return add


def lookup(id_: str) -> Strategy:
    if id_ not in REGISTRY:
        raise ValueError(f"unknown strategy {id_} (have: {', '.join(sorted(REGISTRY))})")
    return REGISTRY[id_]


def resolve(id_: str, **params) -> dict:
    s = lookup(id_)
    unknown = set(params) - set(s.params)
    if unknown:
        raise ValueError(f"{id_} has no parameter {', '.join(sorted(unknown))}")
    return {**s.params, **params}


def cells_of(id_: str, grid: dict | None = None, **fixed) -> list[tuple[str, str, dict]]:
    """Every combination of the grid: (cell name, strategy, parameters)."""
    s = lookup(id_)
    axes = s.grid if grid is None else grid
    out = []
    for combo in itertools.product(*axes.values()):
        p = resolve(id_, **fixed, **dict(zip(axes, combo)))
        name = id_ + "".join(f"|{k}={v}" for k, v in zip(axes, combo))
        out.append((name, id_, p))
    return out


def k(ind: str, out: str | None = None, **params) -> Column:
    return F.col(I.column_key(I.spec(ind, **params), out))


def kn(ind: str, out: str | None = None, **params) -> str:
    return I.column_key(I.spec(ind, **params), out)


def c_(name: str) -> Column:
    return F.col(name)


def _atr(p) -> Column:
    return k("atr", period=p["atrPeriod"])


def _rr(r: dict, p: dict) -> dict:
    """Targets at ``riskReward`` times the distance to the stop; no entry without risk."""
    c, rr = c_("close"), p["riskReward"]
    for side, sign in (("long", 1), ("short", -1)):
        risk = F.abs(c - r[f"stop_{side}"])
        r[side] = r[side] & (risk > 0)
        r[f"target_{side}"] = c + sign * risk * rr
    return r


def _atr_stops(p: dict, r: dict) -> dict:
    a = _atr(p) * p["stopAtr"]
    return {**r, "stop_long": c_("close") - a, "stop_short": c_("close") + a}


ATR = lambda p: [I.spec("atr", period=p["atrPeriod"])]


# -- indicator rules ------------------------------------------------------------------------------

@register("ema-cross", {"fast": 9, "slow": 21, "atrPeriod": 14, "stopAtr": 1.5}, grid={"fast": [5, 9, 13], "slow": [21, 34, 55]},
          specs=lambda p: ATR(p) + [I.spec("ema", period=p["fast"]), I.spec("ema", period=p["slow"])], warmup=lambda p: p["slow"] + 5)
def _ema_cross(p, f):
    a, b = kn("ema", period=p["fast"]), kn("ema", period=p["slow"])
    up = (f.lag(a) <= f.lag(b)) & (c_(a) > c_(b)) & _atr(p).isNotNull()
    down = (f.lag(a) >= f.lag(b)) & (c_(a) < c_(b)) & _atr(p).isNotNull()
    return _atr_stops(p, {"long": up, "short": down, "exit_long": down, "exit_short": up})


@register("rsi-reversion", {"period": 14, "oversold": 30.0, "overbought": 70.0, "exitLevel": 50.0, "atrPeriod": 14, "stopAtr": 1.5},
          grid={"period": [7, 14, 21], "oversold": [20.0, 25.0, 30.0]}, specs=lambda p: ATR(p) + [I.spec("rsi", period=p["period"])],
          warmup=lambda p: p["period"] * 3)
def _rsi_reversion(p, f):
    r = kn("rsi", period=p["period"])
    ok = _atr(p).isNotNull()
    return _atr_stops(p, {"long": (f.lag(r) <= p["oversold"]) & (c_(r) > p["oversold"]) & ok,
                          "short": (f.lag(r) >= p["overbought"]) & (c_(r) < p["overbought"]) & ok,
                          "exit_long": c_(r) >= p["exitLevel"], "exit_short": c_(r) <= p["exitLevel"]})


@register("donchian-breakout", {"period": 20, "atrPeriod": 14, "stopAtr": 2.0}, grid={"period": [10, 20, 40], "stopAtr": [1.5, 2.0, 3.0]},
          specs=lambda p: ATR(p) + [I.spec("donchian", period=p["period"])], warmup=lambda p: p["period"] + 5)
def _donchian(p, f):
    u, m, lo = (k("donchian", o, period=p["period"]) for o in ("upper", "middle", "lower"))
    ok = _atr(p).isNotNull()
    return _atr_stops(p, {"long": (c_("close") > u) & ok, "short": (c_("close") < lo) & ok, "exit_long": c_("close") < m, "exit_short": c_("close") > m})


@register("bb-fade", {"period": 20, "mult": 2.0, "atrPeriod": 14, "stopAtr": 1.5}, grid={"period": [14, 20, 30], "mult": [1.5, 2.0, 2.5]},
          specs=lambda p: ATR(p) + [I.spec("bbands", period=p["period"], mult=p["mult"])], warmup=lambda p: p["period"] + 5)
def _bb_fade(p, f):
    u, m, lo = (k("bbands", o, period=p["period"], mult=p["mult"]) for o in ("upper", "middle", "lower"))
    ok = _atr(p).isNotNull()
    return _atr_stops(p, {"long": (c_("close") < lo) & ok, "short": (c_("close") > u) & ok, "target_long": m, "target_short": m,
                          "exit_long": c_("close") >= m, "exit_short": c_("close") <= m})


@register("buy-and-hold", {}, exits="strategy")
def _hold(p, f):
    return {"long": F.col("idx") == 1, "short": F.lit(False)}


@register("keltner-break", {"period": 20, "kAtr": 10, "mult": 1.5, "riskReward": 1.5, "atrPeriod": 14},
          grid={"mult": [1.5, 2.0, 2.5], "riskReward": [1.0, 1.5, 2.0]},
          specs=lambda p: ATR(p) + [I.spec("keltner", period=p["period"], atrPeriod=p["kAtr"], mult=p["mult"])],
          warmup=lambda p: max(p["period"], p["kAtr"]) + 5)
def _keltner(p, f):
    q = {"period": p["period"], "atrPeriod": p["kAtr"], "mult": p["mult"]}
    u, m, lo = kn("keltner", "upper", **q), kn("keltner", "middle", **q), kn("keltner", "lower", **q)
    return _rr({"long": (c_("close") > c_(u)) & (f.lag("close") <= f.lag(u)), "short": (c_("close") < c_(lo)) & (f.lag("close") >= f.lag(lo)),
                "stop_long": c_(m), "stop_short": c_(m)}, p)


@register("macd-cross", {"fast": 12, "slow": 26, "signal": 9, "stopAtr": 1.5, "riskReward": 1.5, "atrPeriod": 14},
          grid={"fast": [8, 12, 16], "riskReward": [1.0, 1.5, 2.0]},
          specs=lambda p: ATR(p) + [I.spec("macd", fast=p["fast"], slow=p["slow"], signal=p["signal"])], warmup=lambda p: p["slow"] + p["signal"] + 5)
def _macd(p, f):
    q = {n: p[n] for n in ("fast", "slow", "signal")}
    m, s = kn("macd", "macd", **q), kn("macd", "signal", **q)
    ok = _atr(p) > 0
    return _rr(_atr_stops(p, {"long": (c_(m) > c_(s)) & (f.lag(m) <= f.lag(s)) & ok, "short": (c_(m) < c_(s)) & (f.lag(m) >= f.lag(s)) & ok}), p)


@register("rsi2-pullback", {"level": 10.0, "trend": 200, "stopAtr": 2.0, "riskReward": 1.0, "atrPeriod": 14},
          grid={"level": [5.0, 10.0, 15.0], "riskReward": [0.75, 1.0, 1.5]},
          specs=lambda p: ATR(p) + [I.spec("rsi", period=2), I.spec("sma", period=p["trend"])], warmup=lambda p: p["trend"] + 5)
def _rsi2(p, f):
    r, t, ok = k("rsi", period=2), k("sma", period=p["trend"]), _atr(p) > 0
    return _rr(_atr_stops(p, {"long": (c_("close") > t) & (r < p["level"]) & ok, "short": (c_("close") < t) & (r > 100.0 - p["level"]) & ok}), p)


@register("squeeze-break", {"period": 20, "mult": 2.0, "lookback": 60, "riskReward": 1.5, "atrPeriod": 14},
          grid={"lookback": [40, 60, 100], "riskReward": [1.0, 1.5, 2.0]},
          specs=lambda p: [I.spec("bbands", period=p["period"], mult=p["mult"])], back=lambda p: p["lookback"] + 1,
          warmup=lambda p: p["period"] + p["lookback"] + 5)
def _squeeze(p, f):
    q = {"period": p["period"], "mult": p["mult"]}
    u, m, lo = (k("bbands", o, **q) for o in ("upper", "middle", "lower"))
    width = F.try_divide(u - lo, m)
    tight = F.lag(width).over(f.w) <= F.min(width).over(f.rows(-p["lookback"], -1)) * 1.05
    ok = tight & (m > 0) & (F.col("idx") >= p["lookback"] + 1)
    return _rr({"long": (c_("close") > u) & ok, "short": (c_("close") < lo) & ok, "stop_long": m, "stop_short": m}, p)


@register("stoch-reversal", {"period": 14, "smoothK": 3, "smoothD": 3, "level": 20.0, "stopAtr": 1.5, "riskReward": 1.5, "atrPeriod": 14},
          grid={"level": [15.0, 20.0, 25.0], "riskReward": [1.0, 1.5, 2.0]},
          specs=lambda p: ATR(p) + [I.spec("stoch", **{n: p[n] for n in ("period", "smoothK", "smoothD")})],
          warmup=lambda p: p["period"] + p["smoothK"] + p["smoothD"] + 5)
def _stoch(p, f):
    q = {n: p[n] for n in ("period", "smoothK", "smoothD")}
    a, b, ok = kn("stoch", "k", **q), kn("stoch", "d", **q), _atr(p) > 0
    return _rr(_atr_stops(p, {"long": (c_(a) > c_(b)) & (f.lag(a) <= f.lag(b)) & (f.lag(a) < p["level"]) & ok,
                              "short": (c_(a) < c_(b)) & (f.lag(a) >= f.lag(b)) & (f.lag(a) > 100.0 - p["level"]) & ok}), p)


@register("gap-fade", {"minGapHours": 24.0, "minGapAtr": 1.0, "fillPct": 100.0, "stopGapMult": 1.0, "atrPeriod": 14},
          grid={"minGapAtr": [0.5, 1.0, 2.0], "stopGapMult": [0.5, 1.0, 2.0]}, specs=ATR, warmup=lambda p: p["atrPeriod"] + 5)
def _gap_fade(p, f):
    a = f.lag(kn("atr", period=p["atrPeriod"]))
    gap = c_("open") - f.lag("close")
    ok = (S.ms("time") - S.ms(f.lag("time")) >= p["minGapHours"] * 3_600_000) & (a > 0) & (F.abs(gap) >= p["minGapAtr"] * a)
    stop, target = c_("open") + gap * p["stopGapMult"], c_("open") - gap * (p["fillPct"] / 100.0)
    return {"long": ok & (gap <= 0), "short": ok & (gap > 0), "stop_long": stop, "stop_short": stop, "target_long": target, "target_short": target}


@register("doji-reversal", {"bodyMaxPct": 0.10, "minRangeAtr": 1.0, "trendBars": 10, "trendAtr": 1.5, "bufferPips": 3.0, "riskReward": 1.5,
                            "atrPeriod": 14, "pipSize": 0.1}, grid={"bodyMaxPct": [0.05, 0.10, 0.20], "riskReward": [1.0, 1.5, 2.0]},
          specs=ATR, back=lambda p: p["trendBars"], warmup=lambda p: max(p["atrPeriod"], p["trendBars"]) + 5)
def _doji(p, f):
    a = _atr(p)
    move = f.lag("close") - f.lag("close", p["trendBars"])
    rng, body = c_("high") - c_("low"), F.abs(c_("close") - c_("open"))
    is_doji = (rng >= p["minRangeAtr"] * a) & (body <= p["bodyMaxPct"] * rng)
    pr = f.lag("high") - f.lag("low")
    before = (pr >= p["minRangeAtr"] * a) & (F.abs(f.lag("close") - f.lag("open")) <= p["bodyMaxPct"] * pr)
    ok = (a > 0) & (F.abs(move) >= p["trendAtr"] * a) & is_doji & ~F.coalesce(before, F.lit(False))
    pad = p["bufferPips"] * p["pipSize"]
    return _rr({"long": ok & (move <= 0), "short": ok & (move > 0), "stop_long": c_("low") - pad, "stop_short": c_("high") + pad}, p)


@register("trend-pullback", {"fast": 20, "slow": 200, "slopeBars": 20, "runBars": 3, "swingBars": 5, "bufferPips": 3.0, "riskReward": 1.5,
                             "atrPeriod": 14, "pipSize": 0.1}, grid={"fast": [10, 20, 34], "riskReward": [1.0, 1.5, 2.0]},
          specs=lambda p: [I.spec("ema", period=p["fast"]), I.spec("ema", period=p["slow"])],
          back=lambda p: max(p["slopeBars"], p["runBars"], p["swingBars"]), warmup=lambda p: p["slow"] + p["slopeBars"] + 5)
def _pullback(p, f):
    a, b = kn("ema", period=p["fast"]), kn("ema", period=p["slow"])
    old = f.lag(b, p["slopeBars"])
    above = below = F.lit(True)
    for j in range(1, p["runBars"] + 1):
        above, below = above & (f.lag("close", j) > f.lag(a, j)), below & (f.lag("close", j) < f.lag(a, j))
    pad, w = p["bufferPips"] * p["pipSize"], f.rows(1 - p["swingBars"], 0)
    return _rr({"long": (c_(b) > old) & (c_("close") > c_(b)) & above & (c_("close") < c_(a)),
                "short": (c_(b) < old) & (c_("close") < c_(b)) & below & (c_("close") > c_(a)),
                "stop_long": F.min("low").over(w) - pad, "stop_short": F.max("high").over(w) + pad}, p)


@register("volume-thrust", {"volMult": 2.5, "volBars": 20, "closePct": 0.2, "minRangeAtr": 1.0, "bufferPips": 3.0, "riskReward": 1.5,
                            "atrPeriod": 14, "pipSize": 1.0}, grid={"volMult": [2.0, 2.5, 3.5], "riskReward": [1.0, 1.5, 2.0]},
          specs=ATR, back=lambda p: p["volBars"], warmup=lambda p: max(p["volBars"], p["atrPeriod"]) + 5)
def _thrust(p, f):
    a, rng, v = _atr(p), c_("high") - c_("low"), c_("volume")
    mean = F.sum("volume").over(f.rows(-p["volBars"], -1)) / p["volBars"]
    ok = (a > 0) & (F.col("idx") >= p["volBars"] + 1) & (mean > 0) & (v >= p["volMult"] * mean) & (rng >= p["minRangeAtr"] * a)
    ok = ok & ~F.coalesce(f.lag("volume") >= p["volMult"] * mean, F.lit(False))
    top = c_("close") >= c_("high") - rng * p["closePct"]
    pad = p["bufferPips"] * p["pipSize"]
    return _rr({"long": ok & top, "short": ok & ~top & (c_("close") <= c_("low") + rng * p["closePct"]),
                "stop_long": c_("low") - pad, "stop_short": c_("high") + pad}, p)


@register("vwap-fade", {"stretchAtr": 1.5, "stopAtr": 1.0, "atrPeriod": 14, "sessionMs": 86_400_000},
          grid={"stretchAtr": [1.0, 1.5, 2.0], "stopAtr": [1.0, 1.5, 2.0]},
          specs=lambda p: ATR(p) + [I.spec("vwap", sessionMs=p["sessionMs"])], warmup=lambda p: p["atrPeriod"] + 5)
def _vwap_fade(p, f):
    v, a = kn("vwap", sessionMs=p["sessionMs"]), kn("atr", period=p["atrPeriod"])
    pad, pp = p["stretchAtr"] * c_(a), p["stretchAtr"] * f.lag(a)
    long, short = c_("close") <= c_(v) - pad, c_("close") >= c_(v) + pad
    was_l = F.coalesce(f.lag("close") <= f.lag(v) - pp, F.lit(False))
    was_s = F.coalesce(f.lag("close") >= f.lag(v) + pp, F.lit(False))
    return _atr_stops(p, {"long": (c_(a) > 0) & long & ~was_l, "short": (c_(a) > 0) & ~long & short & ~was_s, "target_long": c_(v), "target_short": c_(v)})


@register("volman-box", {"boxBars": 20, "maxBoxAtr": 1.5, "boxes": 2.0, "emaPeriod": 18, "atrPeriod": 14, "maxBreakAtr": 1.0},
          grid={"boxBars": [12, 20, 30]}, specs=lambda p: ATR(p) + [I.spec("ema", period=p["emaPeriod"])], back=lambda p: p["boxBars"],
          warmup=lambda p: p["boxBars"] + max(p["emaPeriod"], p["atrPeriod"]) + 5)
def _box(p, f):
    a, e, n = kn("atr", period=p["atrPeriod"]), k("ema", period=p["emaPeriod"]), p["boxBars"]
    hi, lo = f.full(F.max("high"), "high", -n, -1), f.full(F.min("low"), "low", -n, -1)
    h, c = hi - lo, c_("close")
    ok = (c_(a) > 0) & (f.lag(a) > 0) & (h > 0) & (h <= p["maxBoxAtr"] * f.lag(a))
    lim = p["maxBreakAtr"] * c_(a)
    return {"long": ok & (c > hi) & (c > e) & (c - hi <= lim), "short": ok & (c < lo) & (c < e) & (lo - c <= lim),
            "stop_long": lo, "stop_short": hi, "target_long": hi + p["boxes"] * h, "target_short": lo - p["boxes"] * h}


@register("far-stop-break", {"period": 20, "atrPeriod": 14, "stopMode": 0, "stopAtr": 1.2, "riskReward": 1.0, "minStopPoints": 0.0},
          grid={"period": [20, 40, 80], "riskReward": [1.0, 1.8]}, specs=lambda p: ATR(p) + [I.spec("donchian", period=p["period"])],
          warmup=lambda p: max(p["period"], p["atrPeriod"]) + 5)
def _far(p, f):
    u, lo, a, c = k("donchian", "upper", period=p["period"]), k("donchian", "lower", period=p["period"]), _atr(p), c_("close")
    sl, ss = (lo, u) if p["stopMode"] < 0.5 else (c - a * p["stopAtr"], c + a * p["stopAtr"])
    ok = a.isNotNull()
    return _rr({"long": ok & (c > u) & (c - sl > 0) & (c - sl >= p["minStopPoints"]), "short": ok & (c < lo) & (ss - c > 0) & (ss - c >= p["minStopPoints"]),
                "stop_long": sl, "stop_short": ss}, p)


@register("rsi-reversal-vol", {"rsiPeriod": 14, "stochPeriod": 14, "smoothK": 3, "smoothD": 3, "buyRsi": 30.0, "sellRsi": 70.0, "volBars": 30,
                               "volMult": 1.0, "stopPrice": 16.0, "targetPrice": 6.0, "dojiBody": 0.1, "smallBody": 0.35, "maxShadow": 0.05},
          grid={"buyRsi": [25.0, 30.0, 35.0], "volMult": [1.0, 1.2, 1.5]}, back=lambda p: p["volBars"],
          specs=lambda p: [I.spec("rsi", period=p["rsiPeriod"]), I.spec("stochrsi", rsiPeriod=p["rsiPeriod"], period=p["stochPeriod"], smoothK=p["smoothK"], smoothD=p["smoothD"])],
          warmup=lambda p: p["rsiPeriod"] + p["stochPeriod"] + p["smoothK"] + p["smoothD"] + p["volBars"] + 3,
          prep=lambda d, p: blocked(d, I.KEY, lambda x, f: x.select("*", f.lag(F.struct("open", "high", "low", "close"), 1).alias("p1"),
                                                                    f.lag(F.struct("open", "high", "low", "close"), 2).alias("p2")), back=2))
def _reversal_vol(p, f):
    r = kn("rsi", period=p["rsiPeriod"])
    s = kn("stochrsi", "k", rsiPeriod=p["rsiPeriod"], period=p["stochPeriod"], smoothK=p["smoothK"], smoothD=p["smoothD"])
    w = f.rows(-p["volBars"], -1)
    whole = F.count(F.when(F.col("volume") > 0, 1)).over(w) == p["volBars"]
    shape = candles.reversal(p["smallBody"], p["maxShadow"])
    ok = whole & (c_("volume") > F.sum("volume").over(w) / p["volBars"] * p["volMult"])
    c = c_("close")
    return {"long": ok & (shape == 1) & (c_(r) < p["buyRsi"]) & (c_(r) > f.lag(r)) & (c_(s) > f.lag(s)),
            "short": ok & (shape == -1) & (c_(r) > p["sellRsi"]) & (c_(r) < f.lag(r)) & (c_(s) < f.lag(s)),
            "stop_long": c - p["stopPrice"], "stop_short": c + p["stopPrice"], "target_long": c + p["targetPrice"], "target_short": c - p["targetPrice"]}


# -- day and session rules ------------------------------------------------------------------------

def _days(d: DataFrame) -> DataFrame:
    return d.withColumn("_day", clock.ny_day().cast("long")).withColumn("_min", clock.ny_minute())


def _prep_orb(d, p):
    a, b, z = clock.hhmm(p["rangeStart"]), clock.hhmm(p["rangeStart"]) + int(p["rangeMinutes"]), clock.hhmm(p["entryUntil"])
    w = Window.partitionBy("series", "_day")
    inside = (F.col("_min") >= a) & (F.col("_min") < b)
    d = _days(d)
    # bars of the range precede every entry bar of the day, so the day's aggregate is what was known by then
    d = d.select("*", F.max(F.when(inside, F.col("high"))).over(w).alias("_rh"), F.min(F.when(inside, F.col("low"))).over(w).alias("_rl"))
    pad = p["entryBufferPips"] * p["pipSize"]
    live = (F.col("_min") >= b) & (F.col("_min") < z)
    d = d.withColumn("_way", F.when(live, F.when(F.col("close") > F.col("_rh") + pad, 1).when(F.col("close") < F.col("_rl") - pad, -1)))
    return d.withColumn("_first", F.min(F.when(F.col("_way").isNotNull(), F.col("idx"))).over(w))


@register("orb", {"rangeStart": 820, "rangeMinutes": 60, "entryUntil": 1200, "entryBufferPips": 0.0, "stopMode": 0, "riskReward": 1.5,
                  "minRangePips": 5.0, "maxRangeAtr": 3.0, "atrPeriod": 14, "pipSize": 0.1}, specs=ATR, warmup=lambda p: p["atrPeriod"] + 5, prep=_prep_orb,
          grid={"riskReward": [1.0, 1.5, 2.0], "entryBufferPips": [0.0, 2.0, 5.0]})
def _orb(p, f):
    width = F.col("_rh") - F.col("_rl")
    ok = (F.col("idx") == F.col("_first")) & (width >= p["minRangePips"] * p["pipSize"]) & ~F.coalesce(width > p["maxRangeAtr"] * _atr(p), F.lit(False))
    mid = (F.col("_rh") + F.col("_rl")) / 2.0
    return _rr({"long": ok & (F.col("_way") == 1), "short": ok & (F.col("_way") == -1),
                "stop_long": mid if p["stopMode"] >= 0.5 else F.col("_rl"), "stop_short": mid if p["stopMode"] >= 0.5 else F.col("_rh")}, p)


def _prep_pdhl(d, p):
    d = _days(d)
    r = d.groupBy("series", "_day").agg(F.max("high").alias("_h"), F.min("low").alias("_l"))
    w = Window.partitionBy("series").orderBy("_day")
    r = r.select("series", "_day", F.lag("_h").over(w).alias("_pdh"), F.lag("_l").over(w).alias("_pdl"))
    d = d.join(r, ["series", "_day"])
    h, lo = F.col("_pdh"), F.col("_pdl")
    if p["mode"] < 0.5:
        lvl = F.when((c_("high") > h) & (c_("close") < h), 1).when((c_("low") < lo) & (c_("close") > lo), -1)
    else:
        lvl = F.when(c_("close") > h, 1).when(c_("close") < lo, -1)
    d = d.withColumn("_lvl", lvl)
    return d.withColumn("_first", F.min(F.when(F.col("_lvl").isNotNull(), F.col("idx"))).over(Window.partitionBy("series", "_day", "_lvl")))


@register("pdhl", {"mode": 0, "bufferPips": 3.0, "riskReward": 1.5, "maxRiskAtr": 3.0, "atrPeriod": 14, "pipSize": 0.1}, specs=ATR,
          warmup=lambda p: p["atrPeriod"] + 5, prep=_prep_pdhl, grid={"riskReward": [1.0, 1.5, 2.0], "bufferPips": [1.0, 3.0, 6.0]})
def _pdhl(p, f):
    pad, fade = p["bufferPips"] * p["pipSize"], p["mode"] < 0.5
    at_high, at_low = F.col("_lvl") == 1, F.col("_lvl") == -1
    first = F.col("idx") == F.col("_first")
    sl = c_("low") - pad if fade else F.col("_pdh") - pad
    ss = c_("high") + pad if fade else F.col("_pdl") + pad
    lim = lambda stop: ~F.coalesce(F.abs(c_("close") - stop) > p["maxRiskAtr"] * _atr(p), F.lit(False))
    return _rr({"long": first & (at_low if fade else at_high) & lim(sl), "short": first & (at_high if fade else at_low) & lim(ss),
                "stop_long": sl, "stop_short": ss}, p)


def _with_range(d, p):
    r = B.average_day_range(d.select("series", "time", "open", "high", "low", "close", "volume"), int(p["rangeDays"]))
    return _days(d).join(r.select("series", F.col("day").cast("long").alias("_day"), "avg_range"), ["series", "_day"], "left")


def _enters(p, f, day_bound=False):
    a, b = clock.hhmm(p["from"]), clock.hhmm(p["to"])
    inside = clock.in_window("_min", a, b)
    was = F.lag(inside).over(f.w)
    if day_bound and a <= b:
        was = was & (f.lag("_day") == F.col("_day"))
    return inside, inside & ~F.coalesce(was, F.lit(False))


@register("session-hold", {"from": 930, "to": 1600, "side": 1, "atrPeriod": 14, "riskDailyRanges": 0.0, "rangeDays": 20}, prep=_with_range,
          specs=ATR, warmup=lambda p: p["atrPeriod"] + 5, exits="strategy")
def _session_hold(p, f):
    inside, first = _enters(p, f)
    pad = F.when(F.lit(p["riskDailyRanges"] > 0), F.col("avg_range") * p["riskDailyRanges"])
    if p["riskDailyRanges"] > 0:
        first = first & pad.isNotNull()
    return {"long": first & F.lit(p["side"] >= 0), "short": first & F.lit(p["side"] < 0), "stop_long": c_("close") - pad, "stop_short": c_("close") + pad,
            "exit_long": ~inside, "exit_short": ~inside}


def _prep_intraday(d, p):
    d = _with_range(d, p)
    a, b = clock.hhmm(p["firstFrom"]), clock.hhmm(p["firstTo"])
    w = Window.partitionBy("series", "_day").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    bar = F.struct("idx", "open", "close")
    return d.select("*", F.min(F.when(F.col("_min") >= a, bar)).over(w).alias("_s"), F.max(F.when(F.col("_min") < b, bar)).over(w).alias("_e"))


@register("intraday-momentum", {"firstFrom": 830, "firstTo": 900, "from": 1515, "to": 1630, "minMove": 0.0, "riskDailyRanges": 1.0, "rangeDays": 20,
                                "atrPeriod": 14}, prep=_prep_intraday, specs=ATR, warmup=lambda p: p["atrPeriod"] + 5, exits="strategy")
def _intraday(p, f):
    inside, first = _enters(p, f, True)
    move = F.col("_e.close") - F.col("_s.open")
    ok = first & (F.col("_s.idx") <= F.col("_e.idx")) & F.col("avg_range").isNotNull()
    if p["minMove"] > 0:
        ok = ok & (F.abs(move) >= p["minMove"] * F.col("avg_range"))
    pad = F.col("avg_range") * p["riskDailyRanges"]
    return {"long": ok & (move > 0), "short": ok & (move < 0), "stop_long": c_("close") - pad, "stop_short": c_("close") + pad, "exit_long": ~inside, "exit_short": ~inside}


def _prep_tsmom(d, p):
    d = _with_range(d, p)
    last = d.groupBy("series", "_day").agg(F.max_by("close", "idx").alias("_pc")).withColumn("_pt", F.timestamp_seconds(F.col("_day") * 86_400))
    from ..plans.asof import asof
    left = d.select("series", "_day").distinct().withColumn("_at", F.timestamp_seconds((F.col("_day") - int(p["lookbackDays"])) * 86_400))
    past = asof(left, last.select("series", "_pt", "_pc"), ["series"], "_at", "_pt", ["_pc"], bucket_ms=86_400_000 * 512)
    return d.join(past.select("series", "_day", "_pc"), ["series", "_day"], "left")


@register("tsmom", {"lookbackDays": 60, "rebalanceHHMM": 1800, "atrPeriod": 14, "riskDailyRanges": 2.0, "rangeDays": 20}, prep=_prep_tsmom, specs=ATR,
          grid={"lookbackDays": [20, 60, 120]}, warmup=lambda p: 1, exits="strategy")
def _tsmom(p, f):
    m = clock.hhmm(p["rebalanceHHMM"])
    again = (f.lag("_day") == F.col("_day")) & (f.lag("_min") >= m)
    first = (F.col("_min") >= m) & ~F.coalesce(again, F.lit(False))
    ret = F.try_divide(c_("close"), F.col("_pc")) - 1.0
    pad = F.col("avg_range") * p["riskDailyRanges"]
    ok = first & pad.isNotNull()
    return {"long": ok & (ret > 0), "short": ok & (ret < 0), "stop_long": c_("close") - pad, "stop_short": c_("close") + pad,
            "exit_long": first & (ret < 0), "exit_short": first & (ret > 0)}


def _prep_quiet(d, p):
    kk, w = int(p["lookbackSessions"]), int(p["windowSessions"])
    want = kk + w + 1
    d = _with_range(d, p).withColumn("_ses", clock.session_index().cast("long"))
    look = want + want // 5 + 2
    # One row per session: a window per series is bounded by the calendar.
    s = B.sessions(d.select("series", "time", "open", "high", "low", "close", "volume")).withColumn("session", F.col("session").cast("long"))
    before = Window.partitionBy("series").orderBy("session").rowsBetween(-look, -1)
    past = F.reverse(F.collect_list(F.struct("high", "low", "close", "n")).over(before))
    s = s.withColumn("_p", past)
    most = F.array_max(F.transform("_p", lambda x: x["n"]))
    s = s.withColumn("_k", F.slice(F.filter("_p", lambda x: x["n"] * 2 >= most), 1, want)).filter(F.size("_k") == want)
    tr = F.transform(F.sequence(F.lit(0), F.lit(want - 2)), lambda j: F.greatest(F.get("_k", j)["high"], F.get("_k", j + 1)["close"])
                     - F.least(F.get("_k", j)["low"], F.get("_k", j + 1)["close"]))
    s = s.withColumn("_tr", tr)
    sums = F.transform(F.sequence(F.lit(0), F.lit(w)), lambda m: F.aggregate(F.slice("_tr", m + 1, F.lit(kk)), F.lit(0.0), lambda a, x: a + x))
    s = s.withColumn("_sum", sums)
    share = F.size(F.filter(F.slice("_sum", 2, w), lambda v: v < F.get("_sum", F.lit(0)))) / float(w)
    s = s.select("series", F.col("session").alias("_ses"), share.alias("_quiet"), F.get("_sum", F.lit(0)).alias("_now"),
                 (F.try_divide(F.get("_k", F.lit(0))["close"], F.get("_k", F.lit(kk))["close"]) - 1.0).alias("_ret"))
    return d.join(s, ["series", "_ses"], "left")


@register("quiet-swing", {"lookbackSessions": 10, "windowSessions": 60, "quietPct": 0.5, "holdSessions": 5, "riskDailyRanges": 1.5, "rangeDays": 20,
                          "atrPeriod": 14}, prep=_prep_quiet, specs=ATR, exits="strategy",
          warmup=lambda p: p["lookbackSessions"] + p["windowSessions"] + p["rangeDays"] + 4)
def _quiet(p, f):
    first = ~F.coalesce(f.lag("_ses") == F.col("_ses"), F.lit(False))
    pad = F.col("avg_range") * p["riskDailyRanges"]
    ok = first & (F.col("_now") > 0) & (F.col("_quiet") < p["quietPct"]) & pad.isNotNull()
    return {"long": ok & (F.col("_ret") > 0), "short": ok & (F.col("_ret") < 0), "stop_long": c_("close") - pad, "stop_short": c_("close") + pad,
            "exit_long": first & (F.col("_ret") < 0), "exit_short": first & (F.col("_ret") > 0)}


@register("companion-unconfirmed", {"moveBars": 2, "moveAtr": 1.5, "companionAtr": 0.0, "stopAtr": 4.0, "atrPeriod": 14, "companionAtrPeriod": 14},
          specs=lambda p: ATR(p) + [I.spec("cmp", period=p["moveBars"], atrPeriod=p["companionAtrPeriod"])], back=lambda p: p["moveBars"],
          warmup=lambda p: max(p["atrPeriod"], p["companionAtrPeriod"]) + p["moveBars"] + 2,
          grid={"moveAtr": [1.0, 1.5, 2.0], "companionAtr": [0.3, 0.0, -0.3], "stopAtr": [2.0, 4.0, 6.0]})
def _unconfirmed(p, f):
    n, q = p["moveBars"], {"period": p["moveBars"], "atrPeriod": p["companionAtrPeriod"]}
    t = S.ms("time")
    steps = [F.lag(t, j).over(f.w) - F.lag(t, j + 1).over(f.w) if j else t - F.lag(t, 1).over(f.w) for j in range(n)]
    even = steps[-1] > 0
    for s in steps[:-1]:
        even = even & (s == steps[-1])
    move = c_("close") - f.lag("close", n)
    a, ca = _atr(p), k("cmp", "atr", **q)
    other = F.signum(move) * F.try_divide(k("cmp", "change", **q), ca)
    ok = even & (a > 0) & (ca > 0) & (F.abs(F.try_divide(move, a)) > p["moveAtr"]) & (other < p["companionAtr"])
    return _atr_stops(p, {"long": ok & (move < 0), "short": ok & (move > 0)})


# -- rules over option frames ---------------------------------------------------------------------
# Frames are joined as of the bar: clusters array<struct(low, high, center, score)> in score order,
# contexts array<struct(symbol, dte, max_pain, ...)> by dte, bull_ratio_15m, velocity_norm.

def _near(p):
    return lambda x: (x["score"] >= p["minClusterScore"]) & (band_distance(c_("close"), x["low"], x["high"]) <= _atr(p) * p["entryAtr"])


@register("level-reversion", {"minClusterScore": 3.0, "entryAtr": 0.35, "atrPeriod": 14, "stopAtr": 1.5}, frames=True, specs=ATR,
          grid={"minClusterScore": [2.0, 3.0, 5.0], "entryAtr": [0.2, 0.35, 0.6]}, warmup=lambda p: p["atrPeriod"] * 3)
def _level_reversion(p, f):
    x = F.get(F.filter("clusters", _near(p)), F.lit(0))
    ok = _atr(p).isNotNull() & x.isNotNull()
    return {"long": ok & (x["center"] <= c_("close")), "short": ok & (x["center"] > c_("close")),
            "stop_long": x["low"] - _atr(p) * 0.3, "stop_short": x["high"] + _atr(p) * 0.3}


@register("maxpain-magnet", {"minDistanceAtr": 1.5, "maxDte": 3.0, "atrPeriod": 14, "stopAtr": 2.0}, frames=True, specs=ATR,
          grid={"minDistanceAtr": [1.0, 1.5, 2.5], "maxDte": [1.0, 3.0, 7.0]}, warmup=lambda p: p["atrPeriod"] * 3)
def _magnet(p, f):
    x = F.get("contexts", F.lit(0))
    gap = x["max_pain"] - c_("close")
    ok = (x["dte"] <= p["maxDte"]) & (F.abs(gap) >= _atr(p) * p["minDistanceAtr"])
    return _atr_stops(p, {"long": ok & (gap > 0), "short": ok & (gap <= 0), "target_long": x["max_pain"], "target_short": x["max_pain"]})


@register("flow-momentum", {"minBullRatio": 0.6, "minVelocity": 0.05, "atrPeriod": 14, "stopAtr": 1.5}, frames=True, specs=ATR,
          grid={"minBullRatio": [0.55, 0.6, 0.65], "minVelocity": [0.0, 0.05, 0.15]}, warmup=lambda p: p["atrPeriod"] * 3)
def _flow_momentum(p, f):
    r, v = F.col("bull_ratio_15m"), F.col("velocity_norm")
    ok = _atr(p).isNotNull()
    long = ok & (r >= p["minBullRatio"]) & (v >= p["minVelocity"])
    return _atr_stops(p, {"long": long, "short": ok & ~long & (1.0 - r >= p["minBullRatio"]) & (v <= -p["minVelocity"])})


@register("flow-at-level", {"minClusterScore": 3.0, "entryAtr": 0.4, "minBullRatio": 0.55, "requireReclaim": 1, "atrPeriod": 14, "stopAtr": 1.5},
          frames=True, specs=ATR, grid={"minClusterScore": [2.0, 3.0, 5.0], "minBullRatio": [0.5, 0.55, 0.6], "requireReclaim": [0, 1]},
          warmup=lambda p: p["atrPeriod"] * 3)
def _flow_at_level(p, f):
    c, prev, r, near = c_("close"), f.lag("close"), F.col("bull_ratio_15m"), _near(p)
    free = p["requireReclaim"] == 0

    def up(x):
        hit = F.lit(True) if free else (prev <= x["low"]) & (c > x["low"])
        return near(x) & (x["center"] <= c) & (r >= p["minBullRatio"]) & F.coalesce(hit, F.lit(False))

    def down(x):
        hit = F.lit(True) if free else (prev >= x["high"]) & (c < x["high"])
        return near(x) & (x["center"] > c) & (1.0 - r >= p["minBullRatio"]) & F.coalesce(hit, F.lit(False))

    x = F.get(F.filter("clusters", lambda q: up(q) | down(q)), F.lit(0))
    ok = _atr(p).isNotNull() & x.isNotNull()
    return {"long": ok & (x["center"] <= c), "short": ok & (x["center"] > c), "stop_long": x["low"] - _atr(p) * 0.3, "stop_short": x["high"] + _atr(p) * 0.3}


# -- evaluation -----------------------------------------------------------------------------------

def signals(bars: DataFrame, cells: list[tuple[str, str, dict]], companion: DataFrame | None = None, frames: DataFrame | None = None,
            flags: bool = False) -> DataFrame:
    """Evaluate cells; with ``flags`` every bar is kept and carries exit_long / exit_short."""
    groups: dict[tuple, list] = {}
    for name, sid, p in cells:
        s = lookup(sid)
        groups.setdefault((sid, repr(sorted(p.items()))) if s.prep else ("shared", s.frames), []).append((name, s, p))
    out = None
    for group in groups.values():
        specs = [x for _, s, p in group for x in s.specs(p)]
        d = I.compute(bars, specs, companion) if specs else bars
        if group[0][1].prep:
            d = group[0][1].prep(d, group[0][2])
        if group[0][1].frames:
            if frames is None:
                raise ValueError("these strategies need an options timeline")
            from ..plans.asof import asof
            keys = [c for c in ("series", "market") if c in frames.columns and c in d.columns]
            if not keys:
                raise ValueError("bars and frames need a common column, series or market: a frame holds for its own market only")
            d = asof(d, frames, keys, "time", "t", ["clusters", "contexts", "bull_ratio_15m", "velocity_norm"])

        def evaluate(x, f, group=group):
            cols = []
            for j, (name, s, p) in enumerate(group):
                r = s.rule(p, f)
                null = F.lit(None).cast("double")
                live = F.col("idx") >= s.warmup(p)
                side = F.when(live & F.coalesce(r["long"], F.lit(False)), 1).when(live & F.coalesce(r["short"], F.lit(False)), -1)
                pick = lambda n, r=r, side=side: F.when(side == 1, r.get(f"{n}_long", null)).when(side == -1, r.get(f"{n}_short", null))
                no = F.lit(False)
                cols.append(F.struct(F.lit(name).alias("cell"), F.lit(s.exits == "strategy").alias("self_managed"), side.alias("side"), pick("stop").alias("stop"), pick("target").alias("target"),
                                     F.coalesce(r.get("exit_long", no), no).alias("exit_long"), F.coalesce(r.get("exit_short", no), no).alias("exit_short")).alias(f"_c{j}"))
            x = x.select("series", "idx", "time", "_blk", *cols)
            return x.select("series", "idx", "time", "_blk", F.inline(F.array(*[f"_c{j}" for j in range(len(group))])))

        one = blocked(d, I.KEY, evaluate, back=max(max(s.back(p), 1) for _, s, p in group))
        one = one.drop("exit_long", "exit_short").filter(F.col("side").isNotNull()) if not flags else one
        out = one if out is None else out.unionByName(one)
    return out


def gated(sig: DataFrame, gate: DataFrame) -> DataFrame:
    """Keep signals whose bar passes: ``gate`` is (series, idx, allowed)."""
    return sig.join(gate.filter("allowed").select("series", "idx"), ["series", "idx"], "left_semi")


# -- sweep, shift, gap, retrace -------------------------------------------------------------------

CHAIN = {"pipSize": 0.1, "htfFactor": 15, "minHtfFvgPips": 15.0, "maxHtfFvgAge": 60, "htfTolerancePips": 25.0, "swingLeft": 3, "swingRight": 3,
         "liquidityLookback": 150, "minSweepPips": 1.0, "maxSweepPips": 60.0, "sweepBufferPips": 0.5, "mssBufferPips": 0.5, "structureLookback": 30,
         "displacementLookback": 20, "displacementMult": 1.5, "minBodyAtrRatio": 0.5, "atrPeriod": 14, "maxBarsSweepToMss": 20, "maxBarsMssToFvg": 5,
         "maxBarsFvgToEntry": 30, "minEntryFvgPips": 1.0, "entryPercent": 50.0, "slBufferPips": 3.0, "riskReward": 2.0}


def sweep_chain(bars: DataFrame, step_ms: int, **params) -> DataFrame:
    """Swept swing closing back inside -> displaced close through the protected swing -> gap in the impulse ->
    retrace into it, each within its deadline.

    Shorts and mirrored longs are one case: prices of longs are negated, so that the swept swing is always above.  Sweeps,
    coarse gaps and bars are tables; each stage joins the setups so far with the bars of its deadline and keeps the first
    that fits, unless a close beyond the sweep came before it.  All joins are within tiles of bounded length."""
    p = {**CHAIN, **params}
    pip = p["pipSize"]
    d = materialize(mirrored(bars, p), "mirrored")  # every stage reads it
    setups = _at_gap(_sweeps(d, p, step_ms), _coarse_gaps(d, p, step_ms), p)
    # a displaced close through the protected swing; `gone` is the first close beyond the sweep within all deadlines
    reach = p["maxBarsSweepToMss"] + p["maxBarsMssToFvg"] + p["maxBarsFvgToEntry"] + 3
    gone = _first(setups, d, "sweep_idx", reach, F.col("b.close") > F.col("s.extreme"), "gone")
    setups = gone.withColumn("gone", F.coalesce("gone", F.lit(1 << 62)))
    shifted = _first(setups, d, "sweep_idx", p["maxBarsSweepToMss"], F.col("b.displaced") & (F.col("b.close") < F.col("s.guard") - p["mssBufferPips"] * pip), "shift_idx")
    shifted = shifted.filter("shift_idx < gone")
    # the impulse leaves a gap: this bar's high below the low two bars before
    width = F.col("b.low_2") - F.col("b.high")
    zoned = _first(shifted, d, "shift_idx", p["maxBarsMssToFvg"], (width > 0) & (width >= p["minEntryFvgPips"] * pip), "gap_idx").filter("gap_idx < gone")
    zone = d.select("series", "side", F.col("idx").alias("gap_idx"), F.col("high").alias("bottom"), F.col("low_2").alias("top"))
    zoned = zoned.join(zone, ["series", "side", "gap_idx"])
    share = F.when(F.col("side") < 0, p["entryPercent"] / 100.0).otherwise(1.0 - p["entryPercent"] / 100.0)
    zoned = zoned.withColumn("entry", F.col("bottom") + (F.col("top") - F.col("bottom")) * share)
    ahead = p["maxBarsFvgToEntry"]
    left = _first(zoned, d, "gap_idx", ahead, F.col("b.close") > F.col("s.top"), "left_idx")
    entered = _first(left, d, "gap_idx", ahead, F.col("b.high") >= F.col("s.entry"), "idx")
    # the first touch is spent whether or not it comes early, but an entry is at least four bars after the sweep
    entered = entered.filter((F.col("idx") >= F.col("sweep_idx") + 4) & (F.col("idx") < F.col("gone")) & (F.col("left_idx").isNull() | (F.col("idx") < F.col("left_idx"))))
    stop = F.col("extreme") + p["slBufferPips"] * pip
    sign = -F.col("side")
    rows = entered.select("series", "idx", "side", "sweep_idx", (sign * stop).alias("stop"), (sign * (F.col("entry") + (F.col("entry") - stop) * p["riskReward"])).alias("target"))
    # several sweeps can be entered on one bar: the latest sweep wins, the short side first
    return rows.groupBy("series", "idx").agg(F.max_by(F.struct("side", "sweep_idx", "stop", "target"), F.struct("sweep_idx", -F.col("side"))).alias("_best")).select("series", "idx", "_best.*")


TILE = 64


def mirrored(bars: DataFrame, p: dict) -> DataFrame:
    """Bars of both sides, longs negated, with the last swing above and below, and whether the body is displaced."""
    d = I.compute(bars, [I.spec("swing", left=p["swingLeft"], right=p["swingRight"]), I.spec("atr", period=p["atrPeriod"])])
    n = f"swing_{p['swingLeft']}_{p['swingRight']}_"
    body = F.abs(F.col("close") - F.col("open"))
    d = d.select("series", "idx", "time", "high", "low", "close", body.alias("body"), F.col(f"atr_{p['atrPeriod']}").alias("atr"), F.col(n + "highAt").alias("highAt"), F.col(n + "lowAt").alias("lowAt"),
                 F.col(n + "high").alias("swing_high"), F.col(n + "low").alias("swing_low"))

    def sides(x, f):
        usual = F.avg("body").over(f.rows(-p["displacementLookback"], -1))
        strong = (F.col("body") >= usual * p["displacementMult"]) & (F.lit(p["minBodyAtrRatio"] <= 0) | (F.col("body") >= F.col("atr") * p["minBodyAtrRatio"]))
        before = f.rows(-p["structureLookback"], -1)
        x = x.select("*", F.coalesce(strong, F.lit(False)).alias("displaced"), f.lag("low", 2).alias("low_2"), f.lag("high", 2).alias("high_2"), F.min("low").over(before).alias("least"), F.max("high").over(before).alias("most"),
                     *[f.lag(c).alias(f"p_{c}") for c in ("swing_high", "swing_low", "highAt", "lowAt")])
        short = F.struct(F.lit(-1).alias("side"), F.col("high").alias("high"), F.col("low").alias("low"), F.col("close").alias("close"), F.col("low_2").alias("low_2"), F.col("p_swing_high").alias("level"), F.col("p_highAt").alias("level_at"),
                         F.coalesce("swing_low", "least").alias("guard"))
        long = F.struct(F.lit(1).alias("side"), (-F.col("low")).alias("high"), (-F.col("high")).alias("low"), (-F.col("close")).alias("close"), (-F.col("high_2")).alias("low_2"), (-F.col("p_swing_low")).alias("level"), F.col("p_lowAt").alias("level_at"),
                        (-F.coalesce("swing_high", "most")).alias("guard"))
        return x.select("series", "idx", "time", "displaced", "_blk", F.inline(F.array(short, long)))

    return blocked(d, I.KEY, sides, back=max(p["displacementLookback"], p["structureLookback"], 3))


def _sweeps(d: DataFrame, p: dict, step_ms: int) -> DataFrame:
    """Bars that trade through a recent swing and close back inside, with the coarse bar that they are in."""
    pip, depth = p["pipSize"], F.col("high") - F.col("level")
    through = (depth > p["sweepBufferPips"] * pip) & depth.between(p["minSweepPips"] * pip, p["maxSweepPips"] * pip)
    s = d.filter((F.col("idx") - F.col("level_at") <= p["liquidityLookback"]) & (F.col("close") < F.col("level")) & through & (F.col("guard") < F.col("level")))
    return s.select("series", "side", F.col("idx").alias("sweep_idx"), F.col("high").alias("extreme"), "guard", F.floor(S.ms("time") / (step_ms * int(p["htfFactor"]))).alias("coarse"))


def _coarse_gaps(d: DataFrame, p: dict, step_ms: int) -> DataFrame:
    """Gaps between the first and third of three coarse bars: zone, the coarse bar that makes it and the one that fills it."""
    wide, age = step_ms * int(p["htfFactor"]), int(p["maxHtfFvgAge"])
    c = d.groupBy("series", "side", F.floor(S.ms("time") / wide).alias("coarse")).agg(F.max("high").alias("high"), F.min("low").alias("low"))
    c = with_index(c, ["series", "side"], ["coarse"], F.floor(F.col("coarse") / 4096), "k")

    def gaps(x, f):
        later = F.collect_list(F.struct("k", "high")).over(f.rows(1, age + 1))
        x = x.select("series", "side", "k", "coarse", "_blk", F.col("high").alias("bottom"), f.lag("low", 2).alias("top"), later.alias("later"))
        return x.select("series", "side", "k", "coarse", "_blk", "bottom", "top", F.get(F.transform(F.slice(F.filter("later", lambda b: b["high"] >= F.col("top")), 1, 1), lambda b: b["k"]), F.lit(0)).alias("filled_k"))

    return blocked(c, ["series", "side"], gaps, back=2, ahead=age + 1, idx="k")


def _at_gap(sweeps: DataFrame, gaps: DataFrame, p: dict) -> DataFrame:
    """Sweeps whose extreme lies in or near the nearest open gap among the coarse bars that had closed."""
    age, tol = int(p["maxHtfFvgAge"]), p["htfTolerancePips"] * p["pipSize"]
    s = sweeps.join(gaps.select("series", "side", "coarse", F.col("k").alias("now_k")), ["series", "side", "coarse"])
    s = s.withColumn("tile", F.explode(F.array_distinct(F.array(F.floor((F.col("now_k") - 1 - age) / TILE), *[F.floor((F.col("now_k") - 1 - min(age, n)) / TILE) for n in range(0, age, TILE)]))))
    g = gaps.filter((F.col("top") > F.col("bottom")) & (F.col("top") - F.col("bottom") >= p["minHtfFvgPips"] * p["pipSize"])).withColumn("tile", F.floor(F.col("k") / TILE)).drop("coarse")
    j = s.alias("s").join(g.alias("g"), ["series", "side", "tile"]).filter((F.col("k") < F.col("now_k")) & (F.col("now_k") - 1 - F.col("k") <= age) & (F.col("filled_k").isNull() | (F.col("filled_k") >= F.col("now_k"))))
    away = F.greatest(F.col("bottom") - F.col("extreme"), F.col("extreme") - F.col("top"), F.lit(0.0))
    near = j.groupBy("series", "side", "sweep_idx").agg(F.min_by(F.struct("bottom", "top"), F.struct(away, "k")).alias("z"), F.first("extreme").alias("extreme"), F.first("guard").alias("guard"))
    return near.filter(F.col("extreme").between(F.col("z.bottom") - tol, F.col("z.top") + tol)).drop("z")


def _first(setups: DataFrame, d: DataFrame, start: str, within: int, condition: Column, name: str) -> DataFrame:
    """Adds to each setup the first bar after ``start``, at most ``within`` bars on, that meets ``condition`` over the
    setup ``s`` and the bar ``b``; null if none does."""
    setups = materialize(setups, "setups")  # read twice here, and by every later stage
    tiles = F.array_distinct(F.array(*[F.floor((F.col(start) + n) / TILE) for n in (*range(1, within, TILE), within)]))
    s = setups.select("series", "side", "sweep_idx", *[c for c in setups.columns if c not in ("series", "side", "sweep_idx")]).withColumn("tile", F.explode(tiles))
    b = d.withColumn("tile", F.floor(F.col("idx") / TILE))
    j = s.alias("s").join(b.alias("b"), (F.col("s.series") == F.col("b.series")) & (F.col("s.side") == F.col("b.side")) & (F.col("s.tile") == F.col("b.tile"))
                          & (F.col("b.idx") > F.col(f"s.{start}")) & (F.col("b.idx") <= F.col(f"s.{start}") + within) & condition)
    first = j.groupBy("s.series", "s.side", "s.sweep_idx").agg(F.min("b.idx").alias(name))
    return setups.join(first, ["series", "side", "sweep_idx"], "left")
