"""Level rows from contract contexts, their clusters, and the market snapshot."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S
from . import flow, profile
from .flow import CONTRACT, BigPrints

# fixed values: weight of each level type, and the types that are unverified models
TYPE_WEIGHTS = {"MAX_PAIN": 1.0, "POC": 1.0, "ABOVE_POC": 0.6, "UNDER_POC": 0.6, "CALL_BE": 0.7, "PUT_BE": 0.7,
                "WSUP": 0.9, "WRES": 0.9, "GAMMA_WALL": 0.8}
EXPERIMENTAL = ("CALL_BE", "PUT_BE", "WSUP", "WRES", "GAMMA_WALL")
LEVEL_COLUMNS = {"MAX_PAIN": "max_pain", "POC": "poc", "ABOVE_POC": "above_poc", "UNDER_POC": "under_poc",
                 "CALL_BE": "call_be", "PUT_BE": "put_be", "WSUP": "w_sup", "WRES": "w_res",
                 "GAMMA_WALL": "gamma_wall"}


@dataclass(frozen=True)
class Settings:
    multiplier: float = 100.0
    profile_mode: str = "PREMIUM"
    value_area_pct: float = 0.7
    break_even: str = "premium-weighted"
    whale: str = "net-long-whale"
    positioning: str = "volume"
    big: BigPrints = BigPrints()
    cluster_floor: float = 5.0
    cluster_atr_fraction: float = 0.15
    max_clusters: int = 12
    velocity_ms: int = 900_000
    windows: dict = field(default_factory=lambda: dict(flow.FLOW_WINDOWS))
    weights: dict = field(default_factory=lambda: dict(TYPE_WEIGHTS))


def contexts(prints: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per contract: dte, max pain, profile levels, break-evens, large-print levels and flow."""
    state = flow.market_state(prints)
    base = flow.flow_summary(prints, CONTRACT)
    last = prints.groupBy(*CONTRACT).agg(F.max_by("expiration", F.struct("timestamp", "sequence_id")).alias("expiration"))
    pos = profile.positioning(prints, mode=s.positioning)
    out = (base.join(last, CONTRACT).join(state, "market")
           .join(profile.max_pain(pos, s.multiplier).select(*CONTRACT, "max_pain"), CONTRACT, "left")
           .join(profile.profile_levels(profile.strike_profile(prints, s.profile_mode), s.value_area_pct), CONTRACT, "left")
           .join(profile.break_even(prints, s.break_even, s.multiplier), CONTRACT, "left")
           .join(flow.whale_levels(prints, state.select("market", "spot"), s.whale, s.big), CONTRACT, "left"))
    out = out.withColumn("dte", S.to_fixed(S.dte("as_of", "expiration"), 4)).withColumn("gamma_wall", F.lit(None).cast("double"))
    w = Window.partitionBy("market").orderBy("dte", "symbol")
    return out.withColumn("expiration_type", S.expiry_bucket("dte")).withColumn("dte_rank", F.row_number().over(w))


def levels_from_contexts(ctx: DataFrame, weights: dict = TYPE_WEIGHTS, keys: list[str] = ["market"]) -> DataFrame:
    """Nine level columns of a context become level rows."""
    pairs = ", ".join(f"'{t}', {c}, {float(weights.get(t, TYPE_WEIGHTS[t]))}D" for t, c in LEVEL_COLUMNS.items())
    d = ctx.select(*keys, "symbol", "expiration", "dte", F.expr(f"stack(9, {pairs}) AS (level_type, price, base)"))
    return d.filter(S.finite("price").isNotNull()).select(
        *keys, "symbol", "expiration", "dte", "level_type", "price",
        (F.col("base") * S.expiry_weight("dte")).alias("weight"),
        F.col("level_type").isin(*EXPERIMENTAL).alias("experimental"))


def cluster_distance(floor: float, fraction: float, atr) -> Column:
    return F.greatest(F.lit(float(floor)), F.coalesce(S.finite(atr) * fraction, F.lit(0.0)))


def cluster_score(weights: Column, types: Column, exps: Column) -> Column:
    return weights * (1.0 + 0.25 * (types - 1.0)) * (1.0 + 0.35 * (exps - 1.0))


def cluster_levels(levels: DataFrame, distance: Column | float, keys: list[str] = ["market"]) -> DataFrame:
    """Chain levels whose price is within ``distance`` of the previous one; score and rank the clusters.

    A group is one market at one instant: contracts times nine level types."""
    w = Window.partitionBy(*keys).orderBy("price", "symbol", "level_type")
    dist = distance if isinstance(distance, Column) else F.lit(float(distance))
    d = levels.withColumn("_new", F.when(F.col("price") - F.lag("price").over(w) <= dist, 0).otherwise(1))
    d = d.withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = d.groupBy(*keys, "cluster").agg(
        F.min("price").alias("low"), F.max("price").alias("high"), F.sum("weight").alias("weight"),
        F.sum(F.col("price") * F.col("weight")).alias("_pw"),
        F.countDistinct("level_type").alias("distinct_types"), F.countDistinct("expiration").alias("distinct_expirations"),
        F.sort_array(F.collect_list(F.struct("price", "level_type", "symbol", "weight", "experimental"))).alias("levels"))
    g = g.withColumn("center", F.when(F.col("weight") > 0, F.try_divide(F.col("_pw"), F.col("weight")))
                     .otherwise((F.col("low") + F.col("high")) / 2))
    g = g.withColumn("score", cluster_score(F.col("weight"), F.col("distinct_types"), F.col("distinct_expirations")))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("score", 9).desc(), "low"))
    return g.drop("_pw").withColumn("rank", rank)


def band_distance(price, low, high) -> Column:
    p, a, b = S.col(price), S.col(low), S.col(high)
    return F.when(p < a, a - p).when(p > b, p - b).otherwise(0.0)


def nearest_cluster(clusters: DataFrame, price: DataFrame, tolerance: float, keys: list[str] = ["market"]) -> DataFrame:
    """Closest cluster to (keys, spot); the higher-scored one on ties."""
    cols = [c for c in clusters.columns if c not in keys]
    d = clusters.join(price, keys).withColumn("distance", band_distance("spot", "low", "high"))
    n = d.groupBy(*keys).agg(F.min_by(F.struct("distance", *cols), F.struct("distance", "rank")).alias("n"))
    return n.select(*keys, "n.*").withColumn("inside", F.col("distance") <= tolerance)


def snapshot(prints: DataFrame, s: Settings = Settings(), atr: float | None = None) -> DataFrame:
    """One row per market with nested contexts, clusters, flow windows, velocity and big prints."""
    ctx = contexts(prints, s)
    dist = max(s.cluster_floor, (atr or 0.0) * s.cluster_atr_fraction)
    clusters = cluster_levels(levels_from_contexts(ctx, s.weights), dist)
    state = flow.market_state(prints)
    near = nearest_cluster(clusters, state.select("market", "spot"), dist).select(
        "market", F.struct("low", "high", "center", "score", "distance", "inside", "distinct_types",
                           "distinct_expirations").alias("nearest"))
    overall = flow.flow_summary(prints, ["market"])
    flow_cols = [c for c in overall.columns if c != "market"]
    windows = None
    for name, width in s.windows.items():
        one = flow.summary_at(prints, width, state).withColumn("name", F.lit(name))
        windows = one if windows is None else windows.unionByName(one)
    windows = windows.groupBy("market").agg(F.map_from_entries(F.collect_list(
        F.struct(F.col("name"), F.struct(*flow_cols)))).alias("flow_windows"))
    width = s.velocity_ms
    t, n = S.ms("timestamp"), S.ms("as_of")
    net = F.when(S.is_bull(), F.col("premium_usd")).when(S.is_bear(), -F.col("premium_usd")).otherwise(0.0)
    velocity = prints.join(F.broadcast(state), "market").groupBy("market").agg(
        F.sum(F.when((t <= n) & (t >= n - width), net).otherwise(0.0)).alias("current"),
        F.sum(F.when((t <= n - width) & (t >= n - 2 * width), net).otherwise(0.0)).alias("previous"))
    velocity = velocity.select("market", F.struct("current", "previous", (F.col("current") - F.col("previous"))
                                                  .alias("velocity")).alias("velocity"))
    big = flow.big_prints(prints, ["market"], s.big).groupBy("market").agg(F.array_sort(F.collect_list(F.struct(
        "newest_rank", "timestamp", "symbol", "strike", "option_type", "premium_usd", "flow_class"))).alias("big_prints"))
    ctxs = ctx.groupBy("market").agg(F.array_sort(F.collect_list(F.struct(
        "dte_rank", "symbol", "dte", "expiration_type", "max_pain", "poc", "vah", "val", "above_poc", "under_poc",
        "call_be", "put_be", "w_sup", "w_res", "bull_ratio", "trades"))).alias("contexts"))
    top = clusters.filter(F.col("rank") <= s.max_clusters).groupBy("market").agg(F.array_sort(F.collect_list(
        F.struct("rank", "low", "high", "center", "score", "distinct_types", "distinct_expirations"))).alias("clusters"))
    out = state.join(overall.select("market", F.struct(*flow_cols).alias("flow_overall")), "market")
    for part in (ctxs, top, near, windows, velocity, big):
        out = out.join(part, "market", "left")
    return out.withColumn("bias", flow.bias_label("flow_overall.bull_ratio")).withColumn("cluster_distance", F.lit(dist))
