"""Price-structure levels.

The level operators work on report windows: consecutive runs of ``days`` days of one series, numbered ``win``,
with the bar position ``i`` in the window.  A window holds at most days / step bars, so its frames, arrays
and look-ups are bounded however long a series is.  Bias labels run over whole series in blocks."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import clock, scalars as S
from ..plans.longseries import blocked, carry, materialize, scan
from ..plans.pyramid import Pyramid
from . import indicators as I
from .bars import with_runs

KEY = ["series", "win"]


def report_windows(bars: DataFrame, days: int = 10) -> DataFrame:
    """Add ``win``, the position ``i`` and the bar count ``n`` of the window."""
    d = bars.withColumn("win", F.floor(S.ms("time") / (days * 86_400_000)))
    w = Window.partitionBy(*KEY)
    return d.select("*", (F.row_number().over(w.orderBy("time")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))


# fixed values: a hole longer than this ends a trading day; bars of an hour and more do not show the daily hole, so their days
# are counted from the first bar after a weekend
DAY_GAP_MS, DAILY_HOLE_MS, WEEKEND_MS, DAY_MS = 45 * 60_000, 60 * 60_000, 2 * 86_400_000, 86_400_000


def trading_days(bars: DataFrame, step_ms: int, name: str = "day") -> DataFrame:
    """Adds the dense number of each bar's trading day in its series."""
    if step_ms < DAILY_HOLE_MS:
        return with_runs(bars, DAY_GAP_MS, name)
    d = with_runs(bars, WEEKEND_MS, "_week")
    first = d.groupBy("series", "_week").agg(F.min(S.ms("time")).alias("_t0"))
    d = d.join(first, ["series", "_week"]).withColumn("_slice", F.floor((S.ms("time") - F.col("_t0")) / DAY_MS))
    days = d.select("series", "_week", "_slice").distinct()  # one row a day: bounded by the calendar
    days = days.withColumn(name, F.row_number().over(Window.partitionBy("series").orderBy("_week", "_slice")).cast("long") - 1)
    return d.join(days, ["series", "_week", "_slice"]).drop("_week", "_slice", "_t0")


def trading_windows(bars: DataFrame, step_ms: int, days: int = 10, each: bool = False) -> DataFrame:
    """Report windows of the last ``days`` trading days of each series (fewer where it has fewer); ``win`` is the number of the
    window's last day.  With ``each`` there is a window for every trading day: a day's bars are in ``days`` of them."""
    d = trading_days(bars, step_ms)
    top = d.groupBy("series").agg(F.max("day").alias("_top"))
    d = d.join(top, "series")
    if each:
        d = d.withColumn("win", F.explode(F.sequence(F.col("day"), F.least(F.col("day") + days - 1, F.col("_top")))))
    else:
        d = d.filter(F.col("day") > F.col("_top") - days).withColumn("win", F.col("_top"))
    w = Window.partitionBy(*KEY)
    return d.drop("_top").select("*", (F.row_number().over(w.orderBy("time")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))


def _w():
    return Window.partitionBy(*KEY).orderBy("i")


def _tower(d: DataFrame) -> Pyramid:
    """Extremes of a window's bars by position, for look-ups of the first later bar beyond a price."""
    return Pyramid(d, KEY, {"top": ("high", "max"), "low": ("low", "min"), "most": ("close", "max"), "least": ("close", "min")}, idx="i")


def fair_value_gaps(d: DataFrame) -> DataFrame:
    """Three-bar imbalances not yet traded back through, with the filled share."""
    w = _w()
    later = w.rowsBetween(2, Window.unboundedFollowing)
    ph, pl, nh, nl = F.lag("high").over(w), F.lag("low").over(w), F.lead("high").over(w), F.lead("low").over(w)
    x = d.select("*", ph.alias("_ph"), pl.alias("_pl"), nh.alias("_nh"), nl.alias("_nl"), F.lead("time").over(w).alias("confirmed_at"),
                 F.min("low").over(later).alias("_deep"), F.max("high").over(later).alias("_tall"))
    bull, bear = F.col("_ph") < F.col("_nl"), F.col("_pl") > F.col("_nh")
    lo = F.when(bull, F.col("_ph")).when(bear, F.col("_nh"))
    hi = F.when(bull, F.col("_nl")).when(bear, F.col("_pl"))
    x = x.filter(bull | bear).withColumn("band_low", lo).withColumn("band_high", hi)
    height = F.col("band_high") - F.col("band_low")
    share = F.when(bull, F.try_divide(F.col("band_high") - F.col("_deep"), height)).otherwise(
        F.try_divide(F.col("_tall") - F.col("band_low"), height))
    x = x.withColumn("filled", F.coalesce(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)))
    return x.filter((F.col("filled") < 1) & (height > 0)).select(
        *KEY, "i", F.col("time").alias("formed_at"), "confirmed_at", F.when(bull, "BULLISH").otherwise("BEARISH").alias("direction"),
        "band_low", "band_high", "filled", F.when(F.col("filled") > 0, "PARTIALLY_FILLED").otherwise("UNFILLED").alias("state"),
        (F.col("n") - 1 - F.col("i")).alias("age_bars"))


def order_blocks(d: DataFrame, k: float = 1.5, atr: str = "atr") -> DataFrame:
    """Last opposite candle before each bar whose body exceeds k ATRs, one per candle, with its lifecycle."""
    prior = _w().rowsBetween(Window.unboundedPreceding, -1)
    bar = F.struct("i", "time", "low", "high")
    body = F.col("close") - F.col("open")
    x = d.select(*KEY, "i", "time", "n", body.alias("_body"), F.col(atr).alias("_atr"),
                 F.last(F.when(body < 0, bar), ignorenulls=True).over(prior).alias("_down"),
                 F.last(F.when(body > 0, bar), ignorenulls=True).over(prior).alias("_up"))
    x = x.filter((F.col("_atr") > 0) & (F.abs("_body") > k * F.col("_atr")))
    x = x.withColumn("up", F.col("_body") > 0).withColumn("c", F.when(F.col("up"), F.col("_down")).otherwise(F.col("_up")))
    x = x.filter(F.col("c").isNotNull())
    first = Window.partitionBy(*KEY, "c.i").orderBy("i")
    x = x.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") == 1)
    x = x.select(*KEY, "i", "n", "up", "_body", "_atr", F.col("time").alias("displaced_at"), F.col("c.i").alias("block_i"),
                 F.col("c.time").alias("formed_at"), F.col("c.low").alias("band_low"), F.col("c.high").alias("band_high"))
    tower = _tower(d)
    inside = lambda b: (b["low"] <= F.col("band_high")) & (b["top"] >= F.col("band_low"))
    x = tower.first(materialize(x, "order-blocks"), F.col("i") + 1, lambda b: F.when(F.col("up"), b["least"] < F.col("band_low")).otherwise(b["most"] > F.col("band_high")), "broken_i")
    x = tower.first(x, F.col("i") + 1, inside, "tested_i", until=F.col("broken_i") - 1)
    x = tower.first(x, F.col("broken_i") + 1, inside, "breaker_i")
    state = (F.when(F.col("breaker_i").isNotNull(), "BREAKER").when(F.col("broken_i").isNotNull(), "BROKEN")
             .when(F.col("tested_i").isNotNull(), "TESTED").otherwise("UNTESTED"))
    return x.select(*KEY, "block_i", "formed_at", F.when(F.col("up"), "BULLISH").otherwise("BEARISH").alias("direction"),
                    "band_low", "band_high", "displaced_at", (F.abs("_body") / F.col("_atr")).alias("body_atr"), "tested_i",
                    "broken_i", "breaker_i", state.alias("state"), (F.col("n") - 1 - F.col("block_i")).alias("age_bars"))


def confirmed_swings(d: DataFrame, left: int = 2, right: int = 2) -> DataFrame:
    """One row per strict fractal: side, price, the bar it formed on and the bar that confirmed it."""
    w = _w()
    before, after = w.rowsBetween(-left, -1), w.rowsBetween(1, right)
    whole = (F.col("i") >= left) & (F.col("i") + right < F.col("n"))
    hi = whole & (F.max("high").over(before) < F.col("high")) & (F.max("high").over(after) < F.col("high"))
    lo = whole & (F.min("low").over(before) > F.col("low")) & (F.min("low").over(after) > F.col("low"))
    x = d.select("*", hi.alias("_h"), lo.alias("_l"))
    at = [*KEY, F.col("i").alias("at"), F.col("time").alias("at_time"), (F.col("i") + right).alias("confirmed"), "n"]
    return (x.filter("_h").select(*at, F.lit(True).alias("high_side"), F.col("high").alias("price"))
            .unionByName(x.filter("_l").select(*at, F.lit(False).alias("high_side"), F.col("low").alias("price"))))


def swing_id(timeframe: str, high_side, t) -> Column:
    return F.concat_ws("-", F.lit(timeframe), F.when(S.col(high_side), "hi").otherwise("lo"), S.ms(t).cast("string"))


def liquidity_pools(d: DataFrame, timeframe: str, tolerance_atr: float = 0.1, left: int = 2, right: int = 2,
                    atr: str = "atr") -> DataFrame:
    """Equal highs / lows: swings sorted by price join a pool while within tolerance of its lowest price."""
    last = F.last(F.when(F.col(atr) > 0, F.col(atr)), ignorenulls=True).over(
        _w().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    a = d.select(*KEY, F.col("i").alias("confirmed"), F.coalesce(F.when(F.col(atr) > 0, F.col(atr)), last).alias("_a"))
    s = confirmed_swings(d, left, right).join(a, [*KEY, "confirmed"])
    key = [*KEY, "high_side"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in s.schema.fields)

    def pools(rows: pd.DataFrame) -> pd.DataFrame:
        """Swings of one window and side in order of price: a pool ends where the next is too far above its lowest price."""
        rows = rows.sort_values(["price", "at"])
        base, pool, ids = None, 0, []
        for price, a in zip(rows["price"].tolist(), rows["_a"].tolist()):
            if base is None or price - base > (a * tolerance_atr if a == a else 0.0):
                base, pool = price, pool + 1
            ids.append(pool)
        return rows.assign(pool=ids)

    x = s.groupBy(*key).applyInPandas(pools, kinds + ", pool int").withColumnRenamed("_a", "a")
    p = x.groupBy(*key, "pool").agg(
        F.avg("price").alias("price"), F.min("price").alias("band_low"), F.max("price").alias("band_high"),
        F.min("at").alias("first_at"), F.min("at_time").alias("formed_at"), F.max("confirmed").alias("newest"), F.count(F.lit(1)).alias("members"),
        F.max_by("a", "confirmed").alias("_a"), F.first("n").alias("n"),
        F.array_sort(F.collect_list(swing_id(timeframe, "high_side", "at_time"))).alias("swing_ids"))
    p = _tower(d).first(materialize(p, "pools"), F.col("newest") + 1, lambda b: F.when(F.col("high_side"), b["top"] > F.col("band_high")).otherwise(b["low"] < F.col("band_low")), "swept_i")
    return p.select(*KEY, F.when(F.col("high_side"), "EQUAL_HIGHS").otherwise("EQUAL_LOWS").alias("kind"), "price", "band_low", "band_high",
                    "formed_at", "members", "swing_ids", F.when(F.col("members") > 1, F.try_divide(F.col("band_high") - F.col("band_low"), F.col("_a"))).alias("spread_atr"),
                    "swept_i", F.when(F.col("swept_i").isNotNull(), "SWEPT").otherwise("RESTING").alias("state"),
                    (F.col("n") - 1 - F.col("first_at")).alias("age_bars"))


def period_extremes(d: DataFrame, period: Column) -> DataFrame:
    """High and low of every period of a window (latest bar on ties), its state and the first later sweep."""
    x = d.withColumn("period", period)
    g = x.groupBy(*KEY, "period").agg(
        F.max_by(F.struct("i", "time", "high"), F.struct("high", "i")).alias("h"),
        F.max_by(F.struct("i", "time", "low"), F.struct(-F.col("low"), F.col("i"))).alias("l"),
        F.min("time").alias("start"), F.max("time").alias("end"), F.max("i").alias("last_i"), F.count(F.lit(1)).alias("bars"), F.first("n").alias("n"))
    rows = None
    for side, price in (("h", "high"), ("l", "low")):
        one = g.select(*KEY, "period", F.lit("HIGH" if side == "h" else "LOW").alias("side"), F.col(f"{side}.{price}").alias("price"),
                       F.col(f"{side}.time").alias("formed_at"), F.col(f"{side}.i").alias("at"), "start", "end", "last_i", "bars", "n")
        rows = one if rows is None else rows.unionByName(one)
    rows = _tower(d).first(materialize(rows, "extremes"), F.col("last_i") + 1, lambda b: F.when(F.col("side") == "HIGH", b["top"] > F.col("price")).otherwise(b["low"] < F.col("price")), "swept_i")
    return rows.select(*KEY, "period", "side", "price", "formed_at", "start", "end", "bars", "swept_i",
                       F.when(F.col("last_i") == F.col("n") - 1, "FORMING").otherwise("COMPLETE").alias("state"),
                       (F.col("n") - 1 - F.col("at")).alias("age_bars"))


def _area_of_runs(start: list, stop: list, total: list, pct: float) -> tuple[int, int, int, float]:
    """Point of control and value area (poc, lowest, highest bucket, activity) of runs of equal buckets without holes: from the
    lowest busiest bucket on, the busier neighbour is taken, the upper one on ties, as many buckets of a run at once as
    would be taken one by one."""
    left = right = max(range(len(total)), key=lambda k: (total[k], -k))
    lo = hi = start[left]
    acc, target = total[left], sum(t * (b - a) for a, b, t in zip(start, stop, total)) * pct
    while acc < target:
        down = left if lo > start[left] else left - 1
        up = right if hi + 1 < stop[right] else right + 1
        below, above = (total[down] if down >= 0 else -1.0), (total[up] if up < len(total) else -1.0)
        value = max(below, above)
        if value < 0:
            break
        room = stop[up] - hi - 1 if above >= below else lo - start[down]
        take = room if value == 0 else min(room, max(1, math.ceil((target - acc) / value)))
        if take > 1 and acc + (take - 1) * value >= target:
            take -= 1
        acc += take * value
        if above >= below:
            hi, right = hi + take, up
        else:
            lo, left = lo - take, down
    return start[max(range(len(total)), key=lambda k: (total[k], -k))], lo, hi, acc


def activity_runs(d: DataFrame, per_atr: float = 4.0, atr: str = "atr") -> DataFrame:
    """Time at price: each bar adds one to every bucket of ATR / ``per_atr`` it spans.  One row per run of buckets that as many
    bars span: ``start`` (inclusive), ``stop`` (exclusive), ``total``; windows without an ATR have none.

    A bar is two events, one more at its lowest bucket and one less after its highest; running sums over a window's events
    are the profile.  So a window costs as much as it has bars, however many buckets its range is cut into."""
    g = d.groupBy(*KEY).agg(F.min("low").alias("lo"), F.max("high").alias("hi"), F.max("i").alias("last"),
                            F.max_by(atr, F.when(F.col(atr).isNotNull(), F.col("i"))).alias("_a"))
    g = g.withColumn("size", F.col("_a") / per_atr).filter(F.col("size") > 0)
    g = g.withColumn("buckets", F.floor((F.col("hi") - F.col("lo")) / F.col("size")) + 1).drop("hi", "_a")
    x = d.filter(F.col("high") >= F.col("low")).join(g, KEY)
    pos = lambda c: F.least(F.floor((F.col(c) - F.col("lo")) / F.col("size")), F.col("buckets") - 1)
    edge = lambda at, by: F.struct(at.alias("b"), F.lit(by).alias("by"))
    x = x.select(*KEY, "lo", "size", "buckets", "last", F.explode(F.array(edge(pos("low"), 1.0), edge(pos("high") + 1, -1.0))).alias("e"))
    x = x.groupBy(*KEY, "lo", "size", "buckets", "last", F.col("e.b").alias("start")).agg(F.sum("e.by").alias("by"))
    w = Window.partitionBy(*KEY).orderBy("start")
    x = x.withColumn("total", F.sum("by").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("stop", F.lead("start").over(w))
    return x.filter(F.col("stop").isNotNull()).drop("by")


def activity_profile(d: DataFrame, per_atr: float = 4.0, pct: float = 0.7, atr: str = "atr") -> DataFrame:
    """Point of control and value area of the time spent at price (see :func:`activity_runs`), for any number of buckets.

    ``poc_age``: bars since the first one that spans the bucket of the point of control."""
    runs = activity_runs(d, per_atr, atr)

    def area(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("start")
        poc, lo, hi, acc = _area_of_runs(rows["start"].tolist(), rows["stop"].tolist(), rows["total"].tolist(), pct)
        first = rows.iloc[:1][[*KEY, "lo", "size", "buckets", "last"]]
        return first.assign(_poc=poc, _low=lo, _high=hi, activity=float((rows["total"] * (rows["stop"] - rows["start"])).sum()), acc=acc)

    kinds = ", ".join(f"`{c}` {runs.schema[c].dataType.simpleString()}" for c in (*KEY, "lo", "size", "buckets", "last"))
    p = materialize(runs.groupBy(*KEY).applyInPandas(area, f"{kinds}, _poc long, _low long, _high long, activity double, acc double"), "areas")
    at = p.select(*KEY, "_poc", "lo", "size", "buckets")
    pos = lambda c: F.least(F.floor((F.col(c) - F.col("lo")) / F.col("size")), F.col("buckets") - 1)
    first = d.filter(F.col("high") >= F.col("low")).join(at, KEY).filter((pos("low") <= F.col("_poc")) & (pos("high") >= F.col("_poc"))).groupBy(*KEY).agg(F.min("i").alias("_first"))
    edge = lambda k: F.col("lo") + k * F.col("size")
    return p.join(first, KEY).select(*KEY, (edge(F.col("_poc")) + F.col("size") / 2.0).alias("poc"), edge(F.col("_high") + 1).alias("vah"), edge(F.col("_low")).alias("val"),
                                     (F.col("last") - F.col("_first")).alias("poc_age"), F.col("size").alias("bucket_size"), "buckets", "activity", F.col("acc").alias("activity_in_area"))


def market_structure(d: DataFrame, left: int = 2, right: int = 2) -> DataFrame:
    """Close-based BOS / CHoCH events.  Breaks while no structure is seeded carry kind UNCLASSIFIED.

    A swing is spent by the first close beyond it.  After the seed the label is the direction of the latest
    break, so an event's kind is its direction against the previous break's; a bar closing beyond both
    swings counts the high only."""
    s = confirmed_swings(d, left, right)
    ws = Window.partitionBy(*KEY, "high_side").orderBy("at")
    s = s.select(*KEY, F.col("confirmed").alias("i"), "high_side", F.struct("at", "at_time", "price", F.lag("price").over(ws).alias("prior")).alias("s"))
    s = s.groupBy(*KEY, "i").agg(F.max_by("s", F.when(F.col("high_side"), 1)).alias("_h"), F.max_by("s", F.when(~F.col("high_side"), 1)).alias("_l"))
    run = _w().rowsBetween(Window.unboundedPreceding, 0)
    x = d.join(s, [*KEY, "i"], "left").select(*KEY, "i", "n", "time", "close", F.last("_h", True).over(run).alias("h"), F.last("_l", True).over(run).alias("l"))
    up = (F.col("h.price") > F.col("h.prior")) & (F.col("l.price") > F.col("l.prior"))
    down = (F.col("h.price") < F.col("h.prior")) & (F.col("l.price") < F.col("l.prior"))
    x = x.withColumn("_seed", F.when(up, 1).when(down, -1))
    everything = Window.partitionBy(*KEY)
    x = x.withColumn("_s0", F.min(F.when(F.col("_seed").isNotNull(), F.struct("i", F.col("_seed").alias("way")))).over(everything))
    x = x.withColumn("_hb", F.col("close") > F.col("h.price")).withColumn("_lb", F.col("close") < F.col("l.price"))
    first_h = F.row_number().over(Window.partitionBy(*KEY, "h.at").orderBy(F.when(F.col("_hb"), F.col("i")).asc_nulls_last()))
    x = x.withColumn("_high", F.coalesce(F.col("_hb") & (first_h == 1), F.lit(False)))
    low_try = F.col("_lb") & ~F.col("_high")
    first_l = F.row_number().over(Window.partitionBy(*KEY, "l.at").orderBy(F.when(low_try, F.col("i")).asc_nulls_last()))
    x = x.withColumn("_low", F.coalesce(low_try & (first_l == 1), F.lit(False))).filter(F.col("_high") | F.col("_low"))
    x = x.withColumn("way", F.when(F.col("_high"), 1).otherwise(-1)).withColumn("_live", F.col("i") >= F.col("_s0.i"))
    prev = F.lag("way").over(Window.partitionBy(*KEY, "_live").orderBy("i"))
    label = F.when(F.coalesce(F.col("_live"), F.lit(False)), F.coalesce(prev, F.col("_s0.way")))
    x = x.withColumn("label", label)
    kind = F.when(F.col("label").isNull(), "UNCLASSIFIED").when(F.col("label") == F.col("way"), "BOS").otherwise("CHOCH")
    swing = F.when(F.col("_high"), F.col("h")).otherwise(F.col("l"))
    later = F.lead("i").over(Window.partitionBy(*KEY).orderBy("i"))
    return x.select(*KEY, "i", F.col("time").alias("closed_at"), "close", kind.alias("kind"), F.when(F.col("_high"), "BULLISH").otherwise("BEARISH").alias("direction"),
                    swing["price"].alias("broke_price"), swing["at_time"].alias("broke_swing_time"),
                    F.when(F.col("label").isNotNull(), F.when(F.col("way") == 1, "UP").otherwise("DOWN")).otherwise("RANGE").alias("structure_after"),
                    later.isNotNull().alias("superseded"), (F.col("n") - 1 - F.col("i")).alias("age_bars"))


def dealing_range(d: DataFrame, timeframe: str, left: int = 2, right: int = 2) -> DataFrame:
    """Last confirmed swing high and low of each window, midpoint and the (unclamped) place of the last close."""
    s = confirmed_swings(d, left, right)
    pick = lambda high, v: F.max_by(v, F.when(F.col("high_side") == F.lit(high), F.col("at")))
    g = s.groupBy(*KEY).agg(pick(True, "price").alias("high"), pick(False, "price").alias("low"),
                            pick(True, swing_id(timeframe, "high_side", "at_time")).alias("high_swing_id"),
                            pick(False, swing_id(timeframe, "high_side", "at_time")).alias("low_swing_id"))
    g = g.join(d.groupBy(*KEY).agg(F.max_by("close", "i").alias("close")), KEY).filter(F.col("high") > F.col("low"))
    g = g.withColumn("fraction", (F.col("close") - F.col("low")) / (F.col("high") - F.col("low")))
    return g.withColumn("equilibrium", (F.col("high") + F.col("low")) / 2).withColumn(
        "zone", F.when(F.col("fraction") > 0.5, "PREMIUM").when(F.col("fraction") < 0.5, "DISCOUNT").otherwise("EQUILIBRIUM"))


def levels_report(bars: DataFrame, timeframe: str, step_ms: int, days: int = 10, each: bool = False) -> dict[str, DataFrame]:
    """Every level table over the last ``days`` trading days (``each``: as of every trading day); ``bars`` need the column ``atr``."""
    d = materialize(trading_windows(bars, step_ms, days, each), "windows")  # read by every table
    return {"profile": activity_profile(d), "fair_value_gaps": fair_value_gaps(d), "order_blocks": order_blocks(d),
            "pools": liquidity_pools(d, timeframe), "structure": market_structure(d), "dealing_range": dealing_range(d, timeframe),
            "extremes": period_extremes(d, clock.ny_day("time")), "weeks": period_extremes(d, clock.broker_week("time")),
            "sessions": period_extremes(d, clock.session_index("time"))}


# -- bias labels over whole series ----------------------------------------------------------------

def _fractal_label(bars: DataFrame, n: int, high: str, low: str, name: str) -> DataFrame:
    """HH + HL -> 1, LH + LL -> -1, else 0, from loose fractals (a tie is allowed if some bar is beaten)."""
    def mark(d, f):
        def side(c, sign):
            x = F.col(c) * sign
            b, a = f.full(F.max(x), c, -n, -1), f.full(F.max(x), c, 1, n)
            bl, al = F.min(x).over(f.rows(-n, -1)), F.min(x).over(f.rows(1, n))
            return F.coalesce((x >= b) & (x >= a) & ((x > bl) | (x > al)), F.lit(False))
        return d.select("*", side(high, 1).alias("_fh"), side(low, -1).alias("_fl"))

    def confirm(d, f):
        return d.select("*", F.when(f.lag("_fh", n), f.lag(high, n)).alias("_h"), F.when(f.lag("_fl", n), f.lag(low, n)).alias("_l"))

    d = blocked(blocked(bars, I.KEY, mark, back=n, ahead=n), I.KEY, confirm, back=n)
    d = carry(d, I.KEY, {"_ph": ("last", "_h"), "_pl": ("last", "_l")}, inclusive=False)
    # the swing before the newest one: carry the predecessor recorded at each confirmation
    d = d.withColumn("_hp", F.when(F.col("_h").isNotNull(), F.struct(F.col("_h").alias("v"), F.col("_ph").alias("p"))))
    d = d.withColumn("_lp", F.when(F.col("_l").isNotNull(), F.struct(F.col("_l").alias("v"), F.col("_pl").alias("p"))))
    d = carry(d, I.KEY, {"_hs": ("last", "_hp"), "_ls": ("last", "_lp")})
    up = (F.col("_hs.v") > F.col("_hs.p")) & (F.col("_ls.v") > F.col("_ls.p"))
    down = (F.col("_hs.v") < F.col("_hs.p")) & (F.col("_ls.v") < F.col("_ls.p"))
    return d.withColumn(name, F.when(up, 1).when(down, -1).otherwise(0)).drop(
        "_fh", "_fl", "_h", "_l", "_ph", "_pl", "_hp", "_lp", "_hs", "_ls")


def side_of(c, ref) -> Column:
    return F.when(S.col(c) > S.col(ref), 1).when(S.col(c) < S.col(ref), -1).otherwise(0)


def bias_labels(bars: DataFrame) -> DataFrame:
    """Seventeen causal direction labels (1 up, -1 down, 0 flat) per bar."""
    sp = I.spec
    core = I.compute(bars, [sp("ema", period=n) for n in (20, 21, 50, 55, 200)] + [sp("adx"), sp("avwap"), sp("avwap", anchor=7)])
    turns = I.compute(bars, [sp("supertrend"), sp("supertrend", mult=2.0), sp("zigzag"), sp("zigzag", k=1.5)])
    channels = I.compute(bars, [sp("donchian"), sp("donchian", period=55)])

    def stack(names):
        e = [F.col(f"ema_{n}") for n in names]
        up, down = F.col("close") > e[0], F.col("close") < e[0]
        for a, b in zip(e, e[1:]):
            up, down = up & (a > b), down & (a < b)
        return F.when(up, 1).when(down, -1).otherwise(0)

    def touch(n):
        return F.when(F.col("high") > F.col(f"donchian_{n}_upper"), 1).when(F.col("low") < F.col(f"donchian_{n}_lower"), -1)

    def adx(gate):
        way = F.when(F.col("adx_14_plusDi") > F.col("adx_14_minusDi"), 1).otherwise(-1)
        return F.when(F.col("adx_14_adx") >= gate, way).otherwise(0)

    way = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    id_ = ["series", "idx"]
    parts = [core.select(*bars.columns, stack([21, 55]).alias("ema_21_55"), stack([20, 50, 200]).alias("ema_20_50_200"), adx(25.0).alias("adx_25"),
                         adx(20.0).alias("adx_20"), side_of("close", "avwap_1").alias("avwap_day"), side_of("close", "avwap_7").alias("avwap_week"))]
    parts.append(turns.select(*id_, way("supertrend_10_3_direction").alias("supertrend_3"), way("supertrend_10_2_direction").alias("supertrend_2"),
                              way("zigzag_3_14_direction").alias("zigzag_3"), way("zigzag_1p5_14_direction").alias("zigzag_1_5")))
    c = carry(channels.select(*id_, touch(20).alias("_d20"), touch(55).alias("_d55")), I.KEY, {"_s20": ("last", "_d20"), "_s55": ("last", "_d55")})
    parts.append(c.select(*id_, F.coalesce("_s20", F.lit(0)).alias("donchian_20"), F.coalesce("_s55", F.lit(0)).alias("donchian_55")))
    for n in (1, 2, 3):
        parts.append(_fractal_label(bars, n, "high", "low", f"fractal_{n}").select(*id_, f"fractal_{n}"))
    parts.append(_fractal_label(bars, 2, "close", "close", "dow_closes").select(*id_, "dow_closes"))
    out = parts[0]
    for x in parts[1:]:
        out = out.join(x, id_)
    for name, key in (("day", clock.broker_day("time")), ("week", clock.broker_week("time"))):
        r = bars.groupBy("series", key.cast("long").alias("_p")).agg(((F.max("high") + F.min("low")) / 2).alias("_m"))
        r = r.select("series", "_p", F.lag("_m").over(Window.partitionBy("series").orderBy("_p")).alias("_mid"))
        out = out.withColumn("_p", key.cast("long")).join(r, ["series", "_p"])
        out = out.withColumn(f"prior_{name}", F.when(F.col("_mid").isNotNull(), side_of("close", "_mid")).otherwise(0)).drop("_p", "_mid")
    return out


def zigzag_structure(bars: DataFrame, k: float = 3.0) -> DataFrame:
    """Pivot-to-pivot structure: per confirmed pivot whether it is a higher/lower high/low, and the level whose
    break would end the leg (the previous opposite pivot)."""
    p = I.zigzag_pivots(I.with_atr(bars), "atr", k)
    side = Window.partitionBy("series", "is_high", ).orderBy("pivot_idx")
    legs = Window.partitionBy("series").orderBy("confirmed_idx")
    prev = F.lag("price").over(side)
    mark = F.when(prev.isNull(), None).when(F.col("is_high"), F.when(F.col("price") > prev, "HH").otherwise("LH")).otherwise(
        F.when(F.col("price") > prev, "HL").otherwise("LL"))
    return p.select("*", mark.alias("mark"), F.lag("price").over(legs).alias("break_level"))


def trend_facts(bars: DataFrame) -> DataFrame:
    """One row per series for the newest bar: EMAs and slopes, ATR distance, ADX, efficiency, channel ages."""
    sp = I.spec
    d = I.compute(bars, [sp("ema", period=21), sp("ema", period=55), sp("atr"), sp("adx"), sp("donchian")])
    d = I.bars_since_extreme(I.efficiency(d, 20), 20)
    d = blocked(d, I.KEY, lambda x, f: x.select("*", (F.col("ema_21") - f.lag("ema_21", 5)).alias("ema_21_slope"),
                                                (F.col("ema_55") - f.lag("ema_55", 5)).alias("ema_55_slope")), back=5)
    d = d.withColumn("distance_atr", F.try_divide(F.col("close") - F.col("ema_21"), F.col("atr_14")))
    cols = ["idx", "close", "ema_21", "ema_55", "ema_21_slope", "ema_55_slope", "atr_14", "distance_atr", "adx_14_adx", "efficiency",
            "donchian_20_upper", "donchian_20_lower", "since_high", "since_low"]
    return d.groupBy("series").agg(F.max_by(F.struct(*cols), "idx").alias("f")).select("series", "f.*")


def day_facts(bars: DataFrame) -> DataFrame:
    """Prior day and week high / low / mid and the place of the last close in the prior week's range."""
    out = bars.groupBy("series").agg(F.max_by("close", "time").alias("close"))
    for name, key in (("day", clock.broker_day("time")), ("week", clock.broker_week("time"))):
        g = bars.groupBy("series", key.alias("p")).agg(F.max("high").alias("h"), F.min("low").alias("l"))
        r = F.row_number().over(Window.partitionBy("series").orderBy(F.col("p").desc()))
        g = g.withColumn("_r", r).filter(F.col("_r") == 2)
        out = out.join(g.select("series", F.col("h").alias(f"prior_{name}_high"), F.col("l").alias(f"prior_{name}_low"),
                                ((F.col("h") + F.col("l")) / 2).alias(f"prior_{name}_mid")), "series", "left")
    span = F.col("prior_week_high") - F.col("prior_week_low")
    return out.withColumn("close_fraction_of_week", F.try_divide(F.col("close") - F.col("prior_week_low"), span))
