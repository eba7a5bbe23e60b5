"""Feature table: 24 columns per grid step from the frame in force and the price context, with forward moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S
from ..plans.asof import asof
from ..plans.longseries import blocked, materialize, with_index
from . import bars as B

# fixed values: feature columns in order
FEATURES = ["cluster_inside", "cluster_distance", "cluster_score", "cluster_types", "cluster_expirations", "cluster_side", "bull_ratio", "bull_ratio_15m",
            "bull_ratio_60m", "velocity", "big_imbalance", "max_pain", "poc", "w_sup", "w_res", "call_be", "put_be", "front_dte", "expiry_weight",
            "atr_pct", "premium_rate", "move_15m", "move_60m", "day_position"]


def close_atr(bars: DataFrame, bar_ms: int, period: int) -> DataFrame:
    """Mean range of the last ``period`` coarse close-only bars as of every fine bar; the last one may be forming.

    Coarse bars come from the previous buckets' totals; only the running part of the current bucket is windowed."""
    d = bars.withColumn("_b", F.floor(S.ms("time") / bar_ms))
    run = Window.partitionBy("series", "_b").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    d = d.select("*", F.max("close").over(run).alias("_h"), F.min("close").over(run).alias("_l"))
    c = d.groupBy("series", "_b").agg(F.max("close").alias("high"), F.min("close").alias("low"), F.max_by("close", "time").alias("close"))
    c = with_index(c, ["series"], ["_b"], F.floor(F.col("_b") / 4096), "_i")

    def ranges(x, f):
        pc = f.lag("close")
        tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))
        x = x.select("*", pc.alias("_pc"), F.when(pc.isNotNull(), tr).alias("_tr"))
        w = f.rows(-(period - 1), -1)
        return x.select("*", F.coalesce(F.sum("_tr").over(w), F.lit(0.0)).alias("_s"), F.count("_tr").over(w).alias("_n"))
    c = blocked(c, ["series"], ranges, back=period, idx="_i").select("series", "_b", "_pc", "_s", "_n")
    d = d.join(c, ["series", "_b"])
    now = F.greatest(F.col("_h") - F.col("_l"), F.abs(F.col("_h") - F.col("_pc")), F.abs(F.col("_l") - F.col("_pc")))
    atr = F.when(F.col("_pc").isNotNull(), (F.col("_s") + now) / (F.col("_n") + 1))
    return d.withColumn("atr", F.when(atr > 0, atr)).drop("_b", "_h", "_l", "_pc", "_s", "_n")


def price_context(points: DataFrame, bars: DataFrame, atr_bar_ms: int, period: int = 14, short_ms: int = 900_000, long_ms: int = 3_600_000, day_ms: int = 86_400_000) -> DataFrame:
    """Attach price, ATR, earlier closes and the range of closes over the last day to (series, t)."""
    a = close_atr(bars, atr_bar_ms, period)
    width = max(day_ms, 3_600_000)
    r = a.withColumn("_t", S.ms("time")).withColumn("_k", F.explode(F.array(F.floor(S.ms("time") / width), F.floor(S.ms("time") / width) + 1)))
    w = Window.partitionBy("series", "_k").orderBy("_t").rangeBetween(-day_ms, 0)
    r = r.select("*", F.max("close").over(w).alias("day_high"), F.min("close").over(w).alias("day_low")).filter(F.floor(F.col("_t") / width) == F.col("_k"))
    r = r.select("series", F.col("time").alias("_bt"), F.col("close").alias("price"), "atr", "day_high", "day_low")
    # the day window is taken at t, not at the last bar: points are expected on the bar grid
    # every as-of join reads its left side twice: the small grid is written between joins
    p = materialize(asof(points, r, ["series"], "t", "_bt", ["price", "atr", "day_high", "day_low"], bucket_ms=width * 30).drop("matched"), "grid")
    first = bars.groupBy("series").agg(F.min_by("close", "time").alias("_first"))
    right = bars.select("series", F.col("time").alias("_bt"), F.col("close").alias("_c"))
    for name, back in (("close_15m", short_ms), ("close_60m", long_ms)):
        p = p.withColumn("_at", S.from_ms(S.ms("t") - back))
        p = materialize(asof(p, right, ["series"], "_at", "_bt", ["_c"], bucket_ms=width * 30).drop("matched", "_at").withColumnRenamed("_c", name), "grid")
    p = p.join(first, "series", "left")
    return p.select(*[c for c in p.columns if c not in ("_first", "close_15m", "close_60m")], F.coalesce("close_15m", "_first").alias("close_15m"), F.coalesce("close_60m", "_first").alias("close_60m"))


def extract(d: DataFrame) -> DataFrame:
    """Frame and price-context columns -> the 24 features; rows without price or ATR are dropped."""
    spot, atr = F.coalesce("price", "spot"), F.col("atr")
    d = d.filter(spot.isNotNull() & (atr > 0) & (F.size("contexts") > 0)).withColumn("_s", spot).withColumn("_f", F.get("contexts", F.lit(0)))
    s, n, f = F.col("_s"), F.col("nearest"), F.col("_f")
    some = n.isNotNull()
    norm = lambda c: S.clamp(F.coalesce((f[c] - s) / atr, F.lit(0.0)), -10.0, 10.0)
    move = lambda c: F.coalesce(S.clamp((s - F.col(c)) / atr, -10.0, 10.0), F.lit(0.0))
    pos = F.when(F.col("day_high") > F.col("day_low"), S.clamp((s - F.col("day_low")) / (F.col("day_high") - F.col("day_low")), 0.0, 1.0)).otherwise(0.5)
    e = {"cluster_inside": F.when(some & n["inside"], 1.0).otherwise(0.0), "cluster_distance": F.when(some, F.least(n["distance"] / atr, F.lit(10.0))).otherwise(10.0),
         "cluster_score": F.when(some, F.least(n["score"], F.lit(20.0))), "cluster_types": n["distinct_types"].cast("double"), "cluster_expirations": n["distinct_expirations"].cast("double"),
         "cluster_side": F.when(some, F.when(n["center"] <= s, 1.0).otherwise(-1.0)), "bull_ratio": F.col("bull_ratio"), "bull_ratio_15m": F.col("bull_ratio_15m"),
         "bull_ratio_60m": F.col("bull_ratio_60m"), "velocity": F.col("velocity_norm"), "big_imbalance": F.col("big_imbalance"), "max_pain": norm("max_pain"), "poc": norm("poc"),
         "w_sup": norm("w_sup"), "w_res": norm("w_res"), "call_be": norm("call_be"), "put_be": norm("put_be"), "front_dte": F.coalesce(F.least(f["dte"], F.lit(60.0)), F.lit(30.0)),
         "expiry_weight": S.expiry_weight(f["dte"]), "atr_pct": atr / s * 100.0, "premium_rate": F.log10(F.greatest(F.col("premium_15m"), F.lit(1.0))) / 10.0,
         "move_15m": move("close_15m"), "move_60m": move("close_60m"), "day_position": pos}
    keep = [c for c in d.columns if c in ("market", "series", "t")]
    return d.select(*keep, s.alias("spot_at"), atr.alias("atr_at"), f["symbol"].alias("front_symbol"), *[S.sanitize(e[c]).alias(f"x_{c}") for c in FEATURES])


def dataset(frames: DataFrame, bars: DataFrame, step_ms: int, warmup_ms: int, horizons: dict[str, int], atr_bar_ms: int, period: int = 14,
            short_ms: int = 900_000, long_ms: int = 3_600_000, day_ms: int = 86_400_000, series: str | None = None) -> DataFrame:
    """Rows every ``step_ms`` after the warm-up with forward moves in ATRs; stops where a horizon has no data.

    ``frames`` carry market; its bars have series = ``series`` (or the market's own name)."""
    name = F.lit(series) if series else F.col("market")
    span = frames.groupBy("market").agg(F.min(S.ms("t")).alias("_a"), F.max(S.ms("t")).alias("_z"))
    grid = span.select("market", name.alias("series"), F.explode(F.sequence(F.col("_a") + warmup_ms, F.col("_z"), F.lit(step_ms))).alias("_m")).withColumn("t", S.from_ms("_m")).drop("_m")
    cols = [c for c in frames.columns if c not in ("market", "t", "step")]
    d = asof(grid, frames.withColumnRenamed("t", "_ft"), ["market"], "t", "_ft", cols, bucket_ms=step_ms * 512).drop("matched").filter(F.col("spot").isNotNull())
    d = materialize(d, "grid")
    d = extract(price_context(d, bars, atr_bar_ms, period, short_ms, long_ms, day_ms))
    last = bars.groupBy("series").agg(F.max(S.ms("time")).alias("_last"))
    d = d.join(last, "series").filter(S.ms("t") + max(horizons.values()) <= F.col("_last")).drop("_last")
    right = bars.select("series", F.col("time").alias("_bt"), F.col("close").alias("_c"))
    for n, h in horizons.items():
        d = d.withColumn("_at", S.from_ms(S.ms("t") + h))
        d = materialize(asof(d, right, ["series"], "_at", "_bt", ["_c"], "forward", bucket_ms=step_ms * 512).drop("matched", "_at"), "grid")
        d = d.withColumn(f"fwd_{n}", (F.col("_c") - F.col("spot_at")) / F.col("atr_at")).drop("_c")
    return d


def labelled(d: DataFrame, horizon: str, band: float) -> DataFrame:
    """1 at or over the band, 0 at or under minus the band, the rest dropped."""
    m = F.col(f"fwd_{horizon}")
    return d.withColumn("label", F.when(m >= band, 1).when(m <= -band, 0)).filter(F.col("label").isNotNull())
