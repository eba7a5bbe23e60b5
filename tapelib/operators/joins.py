"""Joins between tapes, bars, quotes and calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import ms
from ..plans.asof import asof
from ..plans.longseries import blocked, carry

__all__ = ["asof", "open_at", "at_horizon", "pair", "pair_table", "all_pairs", "stale", "union_intervals", "inside", "blackout", "fine_in_coarse", "with_grid", "grid", "step_lookup"]


def open_at(left: DataFrame, bars: DataFrame, tolerance_ms: int, time: str = "time") -> DataFrame:
    """Open of the first bar at or after each row's time, NULL when it is later than the tolerance."""
    right = bars.select("series", F.col("time").alias("_bt"), "open")
    return asof(left, right, ["series"], time, "_bt", ["open"], "forward", tolerance_ms=tolerance_ms)


def at_horizon(bars: DataFrame, horizon_ms: int, tolerance_ms: int) -> DataFrame:
    """``fwd``: close of the last bar at or before t + horizon, if later than t and within tolerance."""
    left = bars.withColumn("_at", F.timestamp_millis(ms("time") + horizon_ms))
    right = bars.select("series", F.col("time").alias("_rt"), F.col("close").alias("fwd"))
    d = asof(left, right, ["series"], "_at", "_rt", ["fwd"], tolerance_ms=tolerance_ms, prefix="")
    return d.withColumn("fwd", F.when(F.col("matched") > F.col("time"), F.col("fwd"))).drop("_at", "matched")


def pair(a: DataFrame, b: DataFrame, cols=("open", "high", "low", "close")) -> DataFrame:
    """Inner join of two instruments on equal times."""
    x = a.select("time", *[F.col(c).alias(f"a_{c}") for c in cols])
    return x.join(b.select("time", *[F.col(c).alias(f"b_{c}") for c in cols]), "time")


def pair_table(bars: DataFrame, pairs: DataFrame, cols=("open", "high", "low", "close")) -> DataFrame:
    """Every pair of instruments of ``pairs`` (series, a, b) in one join on (pair, time): ``series`` is the pair's name, the legs'
    columns start with ``a_`` and ``b_``.  A leg's bars are copied once for each pair that it is in."""
    def leg(side):
        of = pairs.select("series", F.col(side).alias("_leg"))
        return bars.select(F.col("series").alias("_leg"), "time", *[F.col(c).alias(f"{side}_{c}") for c in cols]).join(of, "_leg").drop("_leg")
    return leg("a").join(leg("b"), ["series", "time"])


def all_pairs(bars: DataFrame) -> DataFrame:
    """Each unordered pair of instruments, in order of name; a table of instruments, not of bars."""
    names = bars.select("series").distinct()
    a, b = names.select(F.col("series").alias("a")), names.select(F.col("series").alias("b"))
    return a.join(b, F.col("a") < F.col("b")).select(F.concat_ws("/", "a", "b").alias("series"), "a", "b")


def stale(bars: DataFrame, n: int = 1) -> DataFrame:
    """The same bars with the quotes of ``n`` bars before: a venue whose prices arrive late, as a control."""
    cols = [c for c in ("open", "high", "low", "close") if c in bars.columns]
    d = blocked(bars, ["series"], lambda x, f: x.select(*[c for c in bars.columns if c not in cols], "_blk", *[f.lag(c, n).alias(c) for c in cols]), back=n)
    return d.filter(F.col(cols[-1]).isNotNull())


def union_intervals(rows: DataFrame, keys: list[str], start: str, stop: str) -> DataFrame:
    """Disjoint intervals that cover the same time as half-open [start, stop) ones; touching ones become one.

    A new interval begins where no earlier one reaches: the latest stop before is a running maximum, carried over blocks."""
    from ..plans.longseries import with_index
    d = rows.select(*keys, F.col(start).alias("start"), F.col(stop).alias("stop")).filter(F.col("stop") > F.col("start"))
    d = with_index(d, keys, ["start", "stop"], F.floor(ms("start") / 86_400_000))
    d = carry(d, keys, {"_reach": ("max", "stop")}, inclusive=False)
    d = d.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach")), 1).otherwise(0))
    d = carry(d, keys, {"_run": ("sum", "_new")})
    return d.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_run")


def inside(rows: DataFrame, intervals: DataFrame, keys: list[str], name: str, time: str = "time") -> DataFrame:
    """Flag rows whose time lies in one of the disjoint half-open ``intervals``: the last one begun has not ended."""
    d = asof(rows, intervals, keys, time, "start", ["stop"], prefix="_")
    return d.withColumn(name, F.coalesce(F.col(time) < F.col("_stop"), F.lit(False))).select(*rows.columns, name)


def blackout(rows: DataFrame, calendar: DataFrame, before_ms: int, after_ms: int, min_impact: int,
             currencies: list[str], time: str = "time") -> DataFrame:
    """Flag rows inside [event - before, event + after) of a relevant event.

    Each event is listed under the hours it covers, so the join is an equi-join on the hour; distinct hour
    intervals keep repeated events from multiplying rows."""
    hour = 3_600_000
    ev = calendar.filter((F.col("impact") >= min_impact) & F.col("currency").isin(*currencies, "All"))
    ev = ev.select((ms("time") - before_ms).alias("_a"), (ms("time") + after_ms).alias("_z"))
    ev = ev.select("_a", "_z", F.explode(F.sequence(F.floor(F.col("_a") / hour), F.floor((F.col("_z") - 1) / hour))).alias("_h"))
    ev = ev.groupBy("_h").agg(F.collect_set(F.struct(F.greatest("_a", F.col("_h") * hour).alias("a"),
                                                     F.least("_z", (F.col("_h") + 1) * hour).alias("z"))).alias("_iv"))
    t = ms(time)
    d = rows.withColumn("_h", F.floor(t / hour)).join(ev, "_h", "left")
    hit = F.exists("_iv", lambda e: (t >= e["a"]) & (t < e["z"]))
    return d.withColumn("blackout", F.coalesce(hit, F.lit(False))).drop("_h", "_iv")


def fine_in_coarse(fine: DataFrame, coarse: DataFrame, step_ms: int) -> DataFrame:
    """Attach to each finer row the coarse bar that contains it."""
    c = coarse.withColumnRenamed("time", "coarse_time")
    f = fine.withColumn("coarse_time", F.timestamp_millis(F.floor(ms("time") / step_ms) * step_ms))
    return f.join(c, ["series", "coarse_time"])


def with_grid(df: DataFrame, axes: dict[str, list]) -> DataFrame:
    """Every row once per parameter combination; the values are literals, so nothing is joined."""
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def grid(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """Every combination of the parameter values, one row per cell."""
    return with_grid(spark.range(1).select(), axes)


def step_lookup(rows: DataFrame, steps: DataFrame, keys: list[str], index: str, start: str, value: str) -> DataFrame:
    """Value of the last step whose start is at or before the row's index (run-length coded levels)."""
    left = rows.withColumn("_lt", F.timestamp_millis(F.col(index)))
    right = steps.withColumn("_rt", F.timestamp_millis(F.col(start)))
    return asof(left, right, keys, "_lt", "_rt", [value], bucket_ms=4096).drop("_lt", "matched")
