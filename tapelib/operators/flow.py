"""Premium flow: summaries, rolling windows, contract ranking, large prints and their levels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S
from ..plans.longseries import blocked, with_index

CONTRACT = ["market", "symbol"]

# fixed values: named flow windows in milliseconds and bias thresholds
FLOW_WINDOWS = {"5m": 300_000, "15m": 900_000, "30m": 1_800_000, "60m": 3_600_000, "session": 28_800_000}
BIAS = {"strong_bull": 0.60, "moderate_bull": 0.55, "moderate_bear": 0.45, "strong_bear": 0.40}


@dataclass(frozen=True)
class BigPrints:
    min_premium: float = 100_000.0
    min_contracts: float | None = None
    percentile: float | None = 0.95
    window: int = 2000
    limit: int = 200


def _class_sums(prefix: str = ""):
    p = F.col("premium_usd")
    out = [F.sum(F.when(F.col("flow_class") == c.upper(), p).otherwise(0.0)).alias(f"{prefix}{c}_premium")
           for c in ("lc", "lp", "sc", "sp")]
    return out + [F.count(F.lit(1)).alias(f"{prefix}trades"), F.sum("contracts").alias(f"{prefix}contracts")]


def finish_summary(df: DataFrame) -> DataFrame:
    bull, bear = F.col("lc_premium") + F.col("sp_premium"), F.col("lp_premium") + F.col("sc_premium")
    return (df.withColumn("bull_premium", bull).withColumn("bear_premium", bear)
            .withColumn("net_directional_premium", F.col("bull_premium") - F.col("bear_premium"))
            .withColumn("bull_ratio", bull_ratio(F.col("bull_premium"), F.col("bear_premium"))))


def bull_ratio(bull: Column, bear: Column) -> Column:
    return F.coalesce(F.when(bull + bear > 0, F.try_divide(bull, bull + bear)), F.lit(0.5))


def flow_summary(prints: DataFrame, keys: list[str]) -> DataFrame:
    """Premium by class, bull/bear, net and ratio; UNKNOWN prints count but take no side."""
    return finish_summary(prints.groupBy(*keys).agg(*_class_sums()))


def bias_label(ratio, t: dict = BIAS) -> Column:
    r = S.col(ratio)
    return (F.when(r >= t["strong_bull"], "STRONG_BULL").when(r >= t["moderate_bull"], "MODERATE_BULL")
            .when(r <= t["strong_bear"], "STRONG_BEAR").when(r <= t["moderate_bear"], "MODERATE_BEAR")
            .otherwise("BALANCED"))


def summary_at(prints: DataFrame, window_ms: int, now: DataFrame) -> DataFrame:
    """Flow summary of each market inside [as_of - window, as_of]; ``now`` has one row per market."""
    d = prints.join(F.broadcast(now.select("market", "as_of")), "market")
    t, n = S.ms("timestamp"), S.ms("as_of")
    return flow_summary(d.filter((t <= n) & (t >= n - window_ms)), ["market"])


def _per_instant(prints: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and millisecond: bounds any time bucket by its number of milliseconds."""
    return prints.groupBy(*keys, S.ms("timestamp").alias("t")).agg(*_class_sums())


def _range_blocks(df: DataFrame, keys: list[str], span: int, fn, width: int | None = None) -> DataFrame:
    """Range frames over ``t`` (ms) reaching ``span`` back, evaluated per (keys, time block)."""
    width = max(width or 0, span, 3_600_000)
    own = F.floor(F.col("t") / width)
    d = df.withColumn("_blk", F.explode(F.array_compact(F.array(
        own, F.when(F.pmod("t", F.lit(width)) >= width - span, own + 1)))))
    w = Window.partitionBy(*keys, "_blk").orderBy("t")
    return fn(d, w).filter(F.floor(F.col("t") / width) == F.col("_blk")).drop("_blk")


def rolling_flow(prints: DataFrame, keys: list[str], window_ms: int) -> DataFrame:
    """Flow summary of the closed window [t - window, t] at every print time t."""
    names = ["lc_premium", "lp_premium", "sc_premium", "sp_premium", "trades", "contracts"]

    def sums(d, w):
        f = w.rangeBetween(-window_ms, 0)
        return d.select(*keys, "t", "_blk", *[F.sum(c).over(f).alias(c) for c in names])

    return finish_summary(_range_blocks(_per_instant(prints, keys), keys, window_ms, sums))


def flow_velocity(prints: DataFrame, keys: list[str], window_ms: int) -> DataFrame:
    """This window's net, bull and bear premium minus the window before (the shared edge is in both)."""
    bull, bear = F.col("lc_premium") + F.col("sp_premium"), F.col("lp_premium") + F.col("sc_premium")

    def sums(d, w):
        now, before = w.rangeBetween(-window_ms, 0), w.rangeBetween(-2 * window_ms, -window_ms)

        def z(c, f):
            return F.coalesce(F.sum(c).over(f), F.lit(0.0))

        return d.select(*keys, "t", "_blk", z(bull - bear, now).alias("current"),
                        z(bull - bear, before).alias("previous"), z(bull, now).alias("_b1"),
                        z(bull, before).alias("_b0"), z(bear, now).alias("_r1"), z(bear, before).alias("_r0"))

    d = _range_blocks(_per_instant(prints, keys), keys, 2 * window_ms, sums)
    return d.select(*keys, "t", "current", "previous", (F.col("current") - F.col("previous")).alias("velocity"),
                    (F.col("_b1") - F.col("_b0")).alias("bull_velocity"),
                    (F.col("_r1") - F.col("_r0")).alias("bear_velocity"))


def top_contracts(prints: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` contracts with the largest premium per market (ties by symbol)."""
    t = prints.groupBy(*CONTRACT).agg(F.sum("premium_usd").alias("premium"), F.count(F.lit(1)).alias("trades"))
    w = Window.partitionBy("market").orderBy(F.round("premium", 6).desc(), "symbol")
    return t.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def keep_top_contracts(prints: DataFrame, keep: int) -> DataFrame:
    return prints.join(F.broadcast(top_contracts(prints, keep).select(*CONTRACT)), CONTRACT, "left_semi")


def newest(df: DataFrame, keys: list[str], n: int, order=("timestamp", "sequence_id"), salts: int = 64) -> DataFrame:
    """The last ``n`` rows of each key.  Counts of days give the day from which on a key has ``n`` rows or more; older rows go
    before any is shuffled.  A salted first cut keeps what is left of a hot key out of a single task."""
    desc = [F.col(c).desc() for c in order]
    day = F.floor(S.ms(order[0]) / 86_400_000)
    later = Window.partitionBy(*keys).orderBy(F.col("_day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    days = df.groupBy(*keys, day.alias("_day")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_later", F.coalesce(F.sum("_n").over(later), F.lit(0)))
    since = days.filter(F.col("_later") < n).groupBy(*keys).agg(F.min("_day").alias("_since"))
    d = df.join(F.broadcast(since), keys).filter(day.isNull() | (day >= F.col("_since"))).drop("_since")
    d = d.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*desc))).filter(F.col("_r") <= n)
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*desc))).filter(F.col("_r") <= n)
    return d.drop("_salt").withColumnRenamed("_r", "newest_rank")


def percentile_threshold(prints: DataFrame, keys: list[str], cfg: BigPrints = BigPrints()) -> DataFrame:
    """Interpolated premium percentile of each key's last ``cfg.window`` prints (infinite when off)."""
    if cfg.percentile is None:
        return prints.select(*keys).distinct().withColumn("threshold", F.lit(float("inf")))
    return newest(prints, keys, cfg.window).groupBy(*keys).agg(
        F.percentile("premium_usd", F.lit(cfg.percentile)).alias("threshold"))


def is_big(threshold="threshold", cfg: BigPrints = BigPrints()) -> Column:
    big = (F.col("premium_usd") >= cfg.min_premium) | (F.col("premium_usd") >= S.col(threshold))
    return big if cfg.min_contracts is None else big & (F.col("contracts") >= cfg.min_contracts)


def big_prints(prints: DataFrame, keys: list[str], cfg: BigPrints = BigPrints(), limited: bool = True) -> DataFrame:
    """Prints at or over the floor or the rolling percentile, newest ``cfg.limit`` per key."""
    d = prints.join(F.broadcast(percentile_threshold(prints, keys, cfg)), keys).filter(is_big("threshold", cfg))
    return newest(d, keys, cfg.limit) if limited else d


def footprint(big: DataFrame, keys: list[str]) -> DataFrame:
    """Signed contracts and premium of large prints per strike."""
    call, put = F.col("option_type") == "CALL", F.col("option_type") == "PUT"
    q = S.signed_contracts()
    return big.groupBy(*keys, "strike").agg(
        F.sum(F.when(call, q).otherwise(0.0)).alias("call_net"), F.sum(F.when(put, q).otherwise(0.0)).alias("put_net"),
        F.sum(F.when(call, F.col("premium_usd")).otherwise(0.0)).alias("call_premium"),
        F.sum(F.when(put, F.col("premium_usd")).otherwise(0.0)).alias("put_premium"),
        F.max("premium_usd").alias("max_premium"),
        F.max(F.struct("timestamp", "sequence_id")).alias("last_seen"),
        F.min(F.struct("timestamp", "sequence_id")).alias("first_seen"))


def _best(level, value, cond, order):
    """Level with the largest positive ``value`` under ``cond``; ties by the larger ``order``."""
    return F.max_by(level, F.when(cond & (value > 0), F.struct(F.round(value, 6), order)))


def whale_levels(prints: DataFrame, spot: DataFrame, model: str = "net-long-whale", cfg: BigPrints = BigPrints(),
                 keys: list[str] = CONTRACT) -> DataFrame:
    """(keys, w_sup, w_res): best put strike at or under spot, best call strike at or over it.

    Models: net-long-whale, largest-print, premium-concentration.  ``spot`` holds (market, spot)."""
    if model == "premium-concentration":
        f = footprint(prints, keys)
        put, call = F.col("put_premium"), F.col("call_premium")
        # first seen wins: rank the strikes of a contract newest first, so the oldest has the largest order
        w = Window.partitionBy(*keys).orderBy(F.col("first_seen").desc())
        f = f.join(spot, "market").withColumn("_o", F.row_number().over(w))
    elif model == "net-long-whale":
        f = footprint(big_prints(prints, keys, cfg, limited=False), keys).join(spot, "market")
        put, call = F.col("put_net"), F.col("call_net")
        f = f.withColumn("_o", F.col("last_seen"))
    elif model == "largest-print":
        b = big_prints(prints, keys, cfg, limited=False).join(F.broadcast(spot), "market")
        f = b.withColumn("_o", F.struct("timestamp", "sequence_id"))
        put = F.when(F.col("option_type") == "PUT", F.col("premium_usd"))
        call = F.when(F.col("option_type") == "CALL", F.col("premium_usd"))
    else:
        raise ValueError(f"unknown whale model {model} (have: net-long-whale, largest-print, premium-concentration)")
    k, s = F.col("strike"), F.col("spot")
    return f.groupBy(*keys).agg(_best(k, put, k <= s, F.col("_o")).alias("w_sup"),
                                _best(k, call, k >= s, F.col("_o")).alias("w_res"))


def sticky(levels: DataFrame, keys: list[str], step: str, cols: list[str]) -> DataFrame:
    """Carry the last non-null level of each key over its steps (one row per grid step)."""
    w = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return levels.select(*[c for c in levels.columns if c not in cols],
                         *[F.last(c, ignorenulls=True).over(w).alias(c) for c in cols])


def market_state(prints: DataFrame) -> DataFrame:
    """(market, as_of, spot): the newest time and the underlying price of the first print at that time."""
    at = F.struct((-S.ms("timestamp")).alias("t"), F.col("sequence_id"))
    return prints.groupBy("market").agg(F.max("timestamp").alias("as_of"), F.min_by("underlying_price", at).alias("spot"))


def indexed_prints(prints: DataFrame, keys: list[str], bucket_ms: int = 86_400_000) -> DataFrame:
    return with_index(prints, keys, ["timestamp", "sequence_id"], F.floor(S.ms("timestamp") / bucket_ms))


def inferred_aggressor(prints: DataFrame, keys: list[str] = CONTRACT) -> DataFrame:
    """Quote rule then tick rule; the previous price comes from the previous print of the contract."""
    d = blocked(indexed_prints(prints, keys), keys, lambda x, f: x.withColumn("prev_price", f.lag("trade_price")), back=1)
    return d.withColumn("inferred", S.infer_aggressor("trade_price", "bid", "ask", "prev_price"))


#: Contents are counted in so many shares; those of a share with more than ``LARGE_SHARE`` prints are numbered bucket by bucket.
SHARES, LARGE_SHARE = 1 << 16, 500_000


def with_content_ids(prints: DataFrame, cols: list[str], order: list[str], bucket: Column) -> DataFrame:
    """Equal content gives an equal id; the n-th repeat gets ``-n`` appended.

    ``bucket`` is a coarse monotone function of the order.  Prints are shuffled once, by the digest of their content; in large
    shares also by the bucket, where repeats are numbered per bucket and shifted by the counts of earlier buckets, so a
    content that makes up a third of the tape is not one task."""
    share = F.pmod(F.xxhash64(S.content(*cols)), F.lit(SHARES))
    large = F.broadcast(prints.groupBy(share.alias("_share")).agg(F.count(F.lit(1)).alias("_of")).filter(F.col("_of") > LARGE_SHARE).select("_share", F.lit(True).alias("_large")))
    d = prints.withColumn("_share", share).join(large, "_share", "left").withColumn("_digest", F.unhex(S.content_hash(*cols)))
    d = d.withColumn("_part", F.when(F.col("_large"), bucket)).drop("_share", "_large")
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy("_digest", "_part").orderBy(*order)) - 1)
    counts = prints.withColumn("_share", share).join(large, "_share").groupBy(F.unhex(S.content_hash(*cols)).alias("_digest"), bucket.alias("_part")).agg(F.count(F.lit(1)).alias("_of"))
    earlier = Window.partitionBy("_digest").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(counts.select("_digest", "_part", F.sum("_of").over(earlier).alias("_before")), ["_digest", "_part"], "left")
    n = F.col("_n") + F.coalesce("_before", F.lit(0))
    d = d.withColumn("content", F.lower(F.hex("_digest"))).withColumn("content_id", F.when(n > 0, F.concat_ws("-", "content", n)).otherwise(F.col("content")))
    return d.select(*prints.columns, "content", "content_id")


def dedupe_prints(prints: DataFrame, order: list[str]) -> DataFrame:
    """First print per id wins."""
    cols = [c for c in prints.columns if c != "id"]
    return prints.groupBy("id").agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("p")).select("id", "p.*")


def reconcile(live: DataFrame, backfill: DataFrame, key: str = "id") -> DataFrame:
    """Ids by status: missing from live, extra in live, duplicated, or matched."""
    a = live.groupBy(key).agg(F.count(F.lit(1)).alias("live_n"))
    b = backfill.groupBy(key).agg(F.count(F.lit(1)).alias("back_n"))
    j = a.join(b, key, "full_outer").na.fill(0, ["live_n", "back_n"])
    return j.withColumn("status", F.when(F.col("live_n") == 0, "missing").when(F.col("back_n") == 0, "extra")
                        .when(F.col("live_n") > F.col("back_n"), "duplicated").otherwise("matched"))


def set_difference(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """(key, side): ids only in one of the two sets."""
    x, y = a.select(key), b.select(key)
    return (x.exceptAll(y).withColumn("side", F.lit("left"))
            .unionByName(y.exceptAll(x).withColumn("side", F.lit("right"))))
