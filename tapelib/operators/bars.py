"""Bar construction, resampling, gaps and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import clock, scalars as S
from ..plans.longseries import blocked, carry

# fixed values: bar widths by name
TIMEFRAME_MS = {"1m": 60_000, "5m": 300_000, "15m": 900_000, "30m": 1_800_000, "1h": 3_600_000, "4h": 14_400_000,
                "1d": 86_400_000}


def _floor_ms(t, step: int, offset: int = 0) -> Column:
    return F.floor((S.ms(t) + offset) / step) * step - offset


def bars_from_ticks(ticks: DataFrame, step_ms: int) -> DataFrame:
    """ticks(series, time, price, seq) -> bars; steps without ticks stay absent."""
    at = F.struct("time", "seq")
    return (ticks.groupBy("series", S.from_ms(_floor_ms("time", step_ms)).alias("time"))
            .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
                 F.max_by("price", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")))


def _ohlcv(key_time: str = "time"):
    return [F.min_by("open", key_time).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", key_time).alias("close"), F.sum(F.coalesce("volume", F.lit(1.0))).alias("volume")]


def resample(bars: DataFrame, step_ms: int, offset_ms: int = 0) -> DataFrame:
    """Coarser bars on an epoch grid, optionally shifted (``floor((t+off)/step)*step-off``)."""
    close = F.col("close")
    clean = bars.select("series", "time", *[F.coalesce(S.finite(c), close).alias(c) for c in ("open", "high", "low")],
                        "close", "volume")
    return (clean.groupBy("series", S.from_ms(_floor_ms("time", step_ms, offset_ms)).alias("bucket"))
            .agg(*_ohlcv(), F.count(F.lit(1)).alias("n")).withColumnRenamed("bucket", "time"))


def resample_broker(bars: DataFrame, hours: int, full: int) -> DataFrame:
    """H-hour bars on the broker clock, kept only between a series' first and last full bucket."""
    local_h = F.floor(F.unix_seconds(clock.broker_local("time")) / 3600)
    d = (bars.withColumn("bucket", F.floor(local_h / hours)).groupBy("series", "bucket")
         .agg(F.min("time").alias("time"), *_ohlcv(), F.count(F.lit(1)).alias("n")))
    ends = d.filter(F.col("n") >= full).groupBy("series").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    return d.join(ends, "series").filter(F.col("bucket").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def resample_closes(bars: DataFrame, step_ms: int) -> DataFrame:
    """Bars built from closes only."""
    return (bars.groupBy("series", S.from_ms(_floor_ms("time", step_ms)).alias("bucket"))
            .agg(F.min_by("close", "time").alias("open"), F.max("close").alias("high"), F.min("close").alias("low"),
                 F.max_by("close", "time").alias("close")).withColumnRenamed("bucket", "time"))


def dedupe_by_time(bars: DataFrame, arrival: str, last: bool = True) -> DataFrame:
    """One bar per series and time: the last (or first) arrival."""
    cols = [c for c in bars.columns if c not in ("series", "time")]
    pick = F.max_by if last else F.min_by
    return (bars.groupBy("series", "time").agg(pick(F.struct(*cols), arrival).alias("b"))
            .select("series", "time", "b.*"))


def merge_keep_existing(base: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    return base.unionByName(extra.join(base.select(*keys), keys, "left_anti").select(*base.columns))


def with_previous(bars: DataFrame, cols: list[str], n: int = 1) -> DataFrame:
    return blocked(bars, ["series"], lambda d, f: d.select(
        "*", *[f.lag(c, n).alias(f"prev_{c}") for c in cols]), back=n)


def gaps(bars: DataFrame, step_ms: int, factor: float = 2.0) -> DataFrame:
    """Holes longer than ``factor`` steps."""
    d = with_previous(bars, ["time"])
    dt = S.ms("time") - S.ms("prev_time")
    return d.filter(dt > factor * step_ms).select("series", F.col("prev_time").alias("gap_from"),
                                                  F.col("time").alias("gap_to"), dt.alias("gap_ms"))


def resync_start(bars: DataFrame, step_ms: int, lookback_ms: int) -> DataFrame:
    """Earliest point to refetch: the oldest hole inside the look-back, else the newest bar."""
    ends = bars.groupBy("series").agg(F.max(S.ms("time")).alias("last_ms"))
    g = gaps(bars, step_ms).join(ends, "series")
    cut = F.col("last_ms") - lookback_ms
    first = (g.filter(S.ms("gap_to") > cut).groupBy("series")
             .agg(F.min(F.greatest(S.ms("gap_from"), cut)).alias("gap_ms_from")))
    return ends.join(first, "series", "left").select(
        "series", F.coalesce("gap_ms_from", "last_ms").alias("resync_ms"))


def with_runs(bars: DataFrame, gap_ms: int, name: str = "run") -> DataFrame:
    """Number the runs of bars with no hole longer than ``gap_ms``."""
    d = with_previous(bars, ["time"])
    d = d.withColumn("_new", F.when(S.ms("time") - S.ms("prev_time") > gap_ms, 1).otherwise(0))
    return carry(d, ["series"], {name: ("sum", "_new")}).drop("_new", "prev_time")


def last_runs(bars: DataFrame, n: int, run: str = "run") -> DataFrame:
    top = bars.groupBy("series").agg(F.max(run).alias("_top"))
    return bars.join(top, "series").filter(F.col(run) > F.col("_top") - n).drop("_top")


def last_rows(bars: DataFrame, n: int) -> DataFrame:
    top = bars.groupBy("series").agg(F.max("idx").alias("_top"))
    return bars.join(top, "series").filter(F.col("idx") > F.col("_top") - n).drop("_top")


def weekly_break_minutes(bars: DataFrame, step_ms: int) -> DataFrame:
    """Most common minute of day at which trading resumes after a hole, per ISO week."""
    g = gaps(bars, step_ms, 1.0)
    g = g.select("series", F.date_trunc("week", "gap_to").alias("week"),
                 (F.hour("gap_to") * 60 + F.minute("gap_to")).alias("minute"))
    n = g.groupBy("series", "week", "minute").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("series", "week").agg(
        F.min_by("minute", F.struct(-F.col("n"), F.col("minute"))).alias("minute"), F.sum("n").alias("holes"))


def gap_sizes(bars: DataFrame, min_gap_ms: int) -> DataFrame:
    """Open-to-previous-close moves over long holes: count and quantiles of the absolute move."""
    d = with_previous(bars, ["time", "close"])
    d = d.filter(S.ms("time") - S.ms("prev_time") > min_gap_ms).withColumn(
        "move", F.abs(F.col("open") - F.col("prev_close")))
    return d.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.percentile("move", F.lit(0.5)).alias("median"),
                                   F.percentile("move", F.lit(0.9)).alias("p90"), F.max("move").alias("largest"))


def sessions(bars: DataFrame, key: Column | None = None) -> DataFrame:
    """One bar per trading session (17:00 New York unless another integer key is given)."""
    k = clock.session_index("time") if key is None else key
    return (bars.withColumn("session", k).groupBy("series", "session")
            .agg(F.min("time").alias("first_time"), F.max("time").alias("last_time"), *_ohlcv(),
                 F.count(F.lit(1)).alias("n")))


def completed_sessions(bars: DataFrame, want: int) -> DataFrame:
    """Sessions that are at least half as full as the fullest of the last ``want*6/5+2`` sessions.

    The table has one row per session, so a window per series is bounded by the calendar."""
    s = sessions(bars)
    w = Window.partitionBy("series").orderBy("session").rowsBetween(-(want + want // 5 + 1), 0)
    return s.withColumn("fullest", F.max("n").over(w)).filter(F.col("n") * 2 >= F.col("fullest"))


def average_day_range(bars: DataFrame, days: int) -> DataFrame:
    """(series, day, avg_range): mean range of the last ``days`` New York days before ``day``; days whose
    span is under half of the longest in the look-back are left out."""
    d = sessions(bars, clock.ny_day("time")).withColumnRenamed("session", "day")
    d = d.withColumn("span", S.ms("last_time") - S.ms("first_time")).withColumn("range", F.col("high") - F.col("low"))
    look = days + days // 5 + 2
    w = Window.partitionBy("series").orderBy("day").rowsBetween(-look, -1)
    prior = F.reverse(F.collect_list(F.struct("range", "span")).over(w))
    d = d.withColumn("_p", prior)
    longest = F.array_max(F.transform("_p", lambda x: x["span"]))
    kept = F.slice(F.filter("_p", lambda x: x["span"] * 2 >= longest), 1, days)
    d = d.withColumn("_k", kept)
    total = F.aggregate("_k", F.lit(0.0), lambda a, x: a + x["range"])
    mean = total / F.size("_k")
    return d.select("series", "day", F.when((F.size("_k") >= min(days, 5)) & (mean > 0), mean).alias("avg_range"))


def fingerprint(bars: DataFrame, since=None, until=None) -> DataFrame:
    """Digest per series over an optional half-open window: row hashes -> day digests -> digest of days.

    Rows appended outside the window never change it."""
    d = bars
    if since is not None:
        d = d.filter(F.col("time") >= since)
    if until is not None:
        d = d.filter(F.col("time") < until)
    row = F.sha2(F.concat_ws("|", S.ms("time").cast("string"),
                             *[F.col(c).cast("string") for c in ("open", "high", "low", "close")],
                             F.coalesce(F.col("volume").cast("string"), F.lit("null"))), 256)
    hours = (d.groupBy("series", F.date_trunc("hour", "time").alias("hour"))
             .agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), ","), 256).alias("h")))
    days = (hours.groupBy("series", F.to_date("hour").alias("day"))
            .agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col("hour").cast("string"), "h"))), ","), 256).alias("h")))
    return days.groupBy("series").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(
        F.concat_ws(":", F.col("day").cast("string"), "h"))), ","), 256).alias("digest"))
