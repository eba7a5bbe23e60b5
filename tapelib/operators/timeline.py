"""Timeline of snapshots over a tape, built from running sums instead of re-reading the tape at every step.

Grid steps start at a market's first print.  Step of a print = ceil((ts - first) / step); prints after the last
grid point never reach a frame.  There is a frame for every step up to the last; a step without new prints repeats the
frame before it, whose time is the last print seen.  Costs are linear in the prints and in what the steps return."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S
from ..plans.longseries import materialize, with_index
from . import flow, levels, profile
from .levels import Settings

SYM = ["market", "symbol"]
AT = ["market", "symbol", "step"]
NARROW = ["market", "symbol", "timestamp", "sequence_id", "expiration", "strike", "option_type", "trade_price", "contracts", "premium_usd", "aggressor_side",
          "flow_class", "underlying_price", "step", "last_step"]


def with_steps(prints: DataFrame, step_ms: int) -> DataFrame:
    """Adds ``step`` and the number of the grid's last step, ``last_step``.  The ends, a row per market, go to the prints: one market
    may be the whole tape."""
    ends = prints.groupBy("market").agg(F.min(S.ms("timestamp")).alias("_t0"), F.max(S.ms("timestamp")).alias("_t1"))
    d = prints.join(F.broadcast(ends), "market").withColumn("step", F.ceil((S.ms("timestamp") - F.col("_t0")) / step_ms)).withColumn("last_step", F.floor((F.col("_t1") - F.col("_t0")) / step_ms))
    return d.filter(F.col("step") <= F.col("last_step")).drop("_t0", "_t1")


def step_clock(d: DataFrame) -> DataFrame:
    """(market, step, as_of, spot): one row per grid step; one without prints repeats the one before."""
    at = F.struct((-S.ms("timestamp")).alias("t"), F.col("sequence_id"))
    seen = d.groupBy("market", "step").agg(F.max("timestamp").alias("as_of"), F.min_by("underlying_price", at).alias("spot"), F.max("last_step").alias("last_step"))
    grid = seen.groupBy("market").agg(F.explode(F.sequence(F.min("step"), F.max("last_step"))).alias("step"))
    w = Window.partitionBy("market").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(seen.drop("last_step"), ["market", "step"], "left").select("market", "step", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in ("as_of", "spot")])


def _dense(cells: DataFrame, keys: list[str], clock: DataFrame, cols: list[str]) -> DataFrame:
    """Running sums of ``cols`` at every step from a key's first one on (the grid bounds a key's rows)."""
    first = cells.groupBy(*keys).agg(F.min("step").alias("_f"))
    steps = clock.groupBy("market").agg(F.array_sort(F.collect_list("step")).alias("_steps"))
    grid = first.join(steps, "market").select(*keys, F.explode(F.filter("_steps", lambda s: s >= F.col("_f"))).alias("step"))
    d = grid.join(cells, [*keys, "step"], "left")
    w = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return d.select(*keys, "step", *[F.coalesce(F.sum(c).over(w), F.lit(0.0)).alias(c) for c in cols])


def strike_states(d: DataFrame, clock: DataFrame, mode: str = "PREMIUM") -> DataFrame:
    """Every additive input per (contract, strike) at every step."""
    call = F.col("option_type") == "CALL"
    p, q, v = F.col("premium_usd"), F.col("contracts"), profile.contribution(mode)
    be = F.col("strike") + F.when(call, 1.0).otherwise(-1.0) * F.col("trade_price")
    put = ~call
    z = lambda c, x: F.sum(F.when(c, x).otherwise(0.0))
    parts = {"c_qty": z(call, q), "p_qty": z(put, q), "c_val": z(call, v), "p_val": z(put, v), "c_num": z(call & (p > 0), be * p), "c_den": z(call & (p > 0), p),
             "p_num": z(put & (p > 0), be * p), "p_den": z(put & (p > 0), p), "trades": F.count(F.lit(1)).cast("double"), "contracts": F.sum(q)}
    parts.update({f"{c}_premium": z(F.col("flow_class") == c.upper(), p) for c in ("lc", "lp", "sc", "sp")})
    cells = d.groupBy(*SYM, "strike", "step").agg(*[e.alias(n) for n, e in parts.items()])
    return _dense(cells, [*SYM, "strike"], clock, list(parts))


def step_thresholds(d: DataFrame, keys: list[str], cfg: flow.BigPrints) -> DataFrame:
    """(keys, step, threshold): percentile of the key's last ``cfg.window`` prints as of each step with prints (infinite when
    off).

    A key's prints are cut into blocks of ``window``; each block sees the one before it, keeps the premiums of the moving
    window in order, and adds and takes out one a print, so no window is sorted anew."""
    if cfg.percentile is None:
        return d.select(*keys, "step").distinct().withColumn("threshold", F.lit(float("inf")))
    n, share = cfg.window, float(cfg.percentile)
    x = with_index(d.select(*keys, "timestamp", "sequence_id", "step", "premium_usd"), keys, ["timestamp", "sequence_id"], F.floor(S.ms("timestamp") / 86_400_000))
    own = F.floor(F.col("idx") / n)
    ahead = F.when(F.col("idx") % n == 0, F.array(own - 1)).otherwise(F.array().cast("array<bigint>"))  # tells the block before where its last step ends
    x = x.select(*keys, "idx", "step", "premium_usd", F.explode(F.concat(F.array(own, own + 1), ahead)).alias("_b"))

    def roll(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        block, steps, out = int(rows["_b"].iloc[0]), rows["step"].to_numpy(), []
        inside = (rows["idx"].to_numpy() // n) == block
        ends = np.append(steps[1:] != steps[:-1], True) & inside
        values, window = rows["premium_usd"].tolist(), []
        for k, v in enumerate(values):
            bisect.insort(window, v)
            if k >= n:
                window.pop(bisect.bisect_left(window, values[k - n]))
            if ends[k]:
                pos = (len(window) - 1) * share
                lo = int(pos)
                out.append((steps[k], window[lo] + (window[min(lo + 1, len(window) - 1)] - window[lo]) * (pos - lo)))
        found = pd.DataFrame(out, columns=["step", "threshold"])
        for key in keys:
            found[key] = rows[key].iloc[0]
        return found[[*keys, "step", "threshold"]]

    kinds = ", ".join(f"{k} {d.schema[k].dataType.simpleString()}" for k in keys)
    return x.groupBy(*keys, "_b").applyInPandas(roll, f"{kinds}, step long, threshold double")


def _at_or_over(cells: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
    """Sums, at every step of one (contract, strike), of the cells up to it whose rank is the step's or more, and the latest
    print among them: two trees over the ranks, in which the cells are entered as the steps go by."""
    cells, steps = cells.sort_values("at"), steps.sort_values("step")
    most = int(max(cells["over"].max(), steps["rank"].max())) + 1
    sums, latest = np.zeros((most + 1, 2)), [None] * (most + 1)
    entries = list(zip(cells["at"].tolist(), cells["over"].tolist(), cells["call_net"].tolist(), cells["put_net"].tolist(), zip(cells["seen_ms"].tolist(), cells["seen_id"].tolist())))
    k, out = 0, []
    for step, rank in zip(steps["step"].tolist(), steps["rank"].tolist()):
        while k < len(entries) and entries[k][0] <= step:
            _, over, call, put, seen = entries[k]
            i = most - over  # the highest ranks first, so that a prefix holds the ranks from some one on
            while i <= most:
                sums[i, 0] += call
                sums[i, 1] += put
                latest[i] = seen if latest[i] is None or seen > latest[i] else latest[i]
                i += i & -i
            k += 1
        i, call, put, seen = most - rank, 0.0, 0.0, None
        while i > 0:
            call, put = call + sums[i, 0], put + sums[i, 1]
            seen = latest[i] if seen is None or (latest[i] is not None and latest[i] > seen) else seen
            i -= i & -i
        if seen is not None:
            out.append((step, call, put, *seen))
    return pd.DataFrame(out, columns=["step", "call_net", "put_net", "seen_ms", "seen_id"])


def whale_steps(d: DataFrame, clock: DataFrame, cfg: flow.BigPrints) -> DataFrame:
    """Net-long large-print levels at every step, carried over steps.

    A step's threshold re-judges all earlier prints, so prints are summed into (strike, step, rank of the smallest
    thresholds they pass), cells bounded by the grid.  Each (contract, strike) then enters its cells into a tree of ranks, step
    by step, and asks it for the ranks at or over the step's own: no step is paired with the cells before it."""
    thr = materialize(step_thresholds(d, SYM, cfg).withColumn("eff", F.least("threshold", F.lit(cfg.min_premium))), "thresholds")
    first = thr.groupBy(*SYM).agg(F.min("step").alias("_f"), F.array_sort(F.collect_set("eff")).alias("_q"))
    steps = clock.groupBy("market").agg(F.array_sort(F.collect_list("step")).alias("_steps"))
    grid = first.join(steps, "market").select(*SYM, "_q", F.explode(F.filter("_steps", lambda s: s >= F.col("_f"))).alias("step"))
    # a contract without new prints keeps its threshold
    w = Window.partitionBy(*SYM).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.join(thr.select(*AT, "eff"), AT, "left").withColumn("eff", F.last("eff", True).over(w))
    grid = grid.withColumn("rank", F.array_position("_q", F.col("eff")).cast("int")).select(*AT, "rank")
    big = d if cfg.min_contracts is None else d.filter(F.col("contracts") >= cfg.min_contracts)
    big = big.join(F.broadcast(first.select(*SYM, "_q")), SYM).filter(F.col("premium_usd") >= F.get("_q", F.lit(0)))
    call, s = F.col("option_type") == "CALL", S.signed_contracts()
    cells = big.withColumn("over", F.size(F.filter("_q", lambda q: q <= F.col("premium_usd")))).groupBy(*SYM, "strike", F.col("step").alias("at"), "over").agg(
        F.sum(F.when(call, s).otherwise(0.0)).alias("call_net"), F.sum(F.when(call, 0.0).otherwise(s)).alias("put_net"), F.max(F.struct(S.ms("timestamp").alias("ms"), "sequence_id")).alias("seen"))
    cells = materialize(cells.select(*SYM, "strike", "at", "over", "call_net", "put_net", F.col("seen.ms").alias("seen_ms"), F.col("seen.sequence_id").alias("seen_id")), "large-cells")
    wanted = materialize(cells.groupBy(*SYM, "strike").agg(F.min("at").alias("_f")).join(grid, SYM).filter(F.col("step") >= F.col("_f")).drop("_f"), "large-steps")

    def sums(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = _at_or_over(left, right)
        for name, value in zip([*SYM, "strike"], key):
            found[name] = value
        return found[[*SYM, "strike", "step", "call_net", "put_net", "seen_ms", "seen_id"]]

    by = [*SYM, "strike"]
    f = cells.groupBy(*by).cogroup(wanted.groupBy(*by)).applyInPandas(sums, f"market string, symbol string, strike double, step long, call_net double, put_net double, seen_ms long, seen_id {d.schema['sequence_id'].dataType.simpleString()}")
    f = f.join(clock.select("market", "step", "spot"), ["market", "step"])
    k, sp, seen = F.col("strike"), F.col("spot"), F.struct("seen_ms", "seen_id")
    lv = f.groupBy(*AT).agg(flow._best(k, F.col("put_net"), k <= sp, seen).alias("w_sup"), flow._best(k, F.col("call_net"), k >= sp, seen).alias("w_res"))
    return flow.sticky(grid.select(*AT).join(lv, AT, "left"), SYM, "step", ["w_sup", "w_res"])


#: The level models that have running sums; others are refused.
MODELS = {"break_even": "premium-weighted", "whale": "net-long-whale", "positioning": "volume"}


def step_contexts(prints: DataFrame, step_ms: int, s: Settings = Settings()) -> DataFrame:
    """The contract contexts of every frame.  Level models without running sums (see ``MODELS``) are refused."""
    for name, model in MODELS.items():
        if getattr(s, name) != model:
            raise ValueError(f"a timeline has no running form of {name} {getattr(s, name)!r} (have: {model!r})")
    # read by every part below: one narrow copy instead of re-reading and re-joining the tape
    d = materialize(with_steps(prints, step_ms).select(*NARROW), "steps")
    clock = step_clock(d)
    st = strike_states(d, clock, s.profile_mode)
    pos = st.select(*AT, "strike", F.col("c_qty").alias("call_oi_proxy"), F.col("p_qty").alias("put_oi_proxy"))
    prof = profile.finish_profile(st.select(*AT, "strike", F.col("c_val").alias("call"), F.col("p_val").alias("put")))
    sums = ["c_num", "c_den", "p_num", "p_den", "trades", "contracts", "lc_premium", "lp_premium", "sc_premium", "sp_premium"]
    base = st.groupBy(*AT).agg(*[F.sum(c).alias(c) for c in sums])
    base = flow.finish_summary(base).withColumn("call_be", F.try_divide("c_num", "c_den")).withColumn("put_be", F.try_divide("p_num", "p_den"))
    exp = d.groupBy(*SYM).agg(F.max_by("expiration", F.struct("timestamp", "sequence_id")).alias("expiration"))
    out = (base.join(profile.max_pain(pos, s.multiplier, AT).select(*AT, "max_pain"), AT)
           .join(profile.profile_levels(prof, s.value_area_pct, AT), AT).join(whale_steps(d, clock, s.big), AT, "left")
           .join(exp, SYM).join(clock, ["market", "step"]))
    out = out.withColumn("dte", S.to_fixed(S.dte("as_of", "expiration"), 4)).withColumn("gamma_wall", F.lit(None).cast("double"))
    return out.drop("c_num", "c_den", "p_num", "p_den")


def big_imbalance(d: DataFrame, clock: DataFrame, cfg: flow.BigPrints, window_ms: int) -> DataFrame:
    """Signed share of the premium of all large prints in the last ``window_ms`` of every frame."""
    w = Window.partitionBy("market").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    c = clock.join(step_thresholds(d, ["market"], cfg), ["market", "step"], "left").select("market", "step", S.ms("as_of").alias("_n"), F.last("threshold", ignorenulls=True).over(w).alias("threshold"))
    c = c.withColumn("_k", F.explode(F.sequence(F.floor((F.col("_n") - window_ms) / window_ms), F.floor(F.col("_n") / window_ms))))
    # only prints that pass the market's lowest threshold can count at any step
    least = c.groupBy("market").agg(F.min("threshold").alias("_least"))
    p = d.join(F.broadcast(least), "market").filter((F.col("premium_usd") >= cfg.min_premium) | (F.col("premium_usd") >= F.col("_least")))
    p = p.select("market", S.ms("timestamp").alias("_t"), "premium_usd", "contracts", "flow_class").withColumn("_k", F.floor(F.col("_t") / window_ms))
    j = c.join(p, ["market", "_k"]).filter((F.col("_t") <= F.col("_n")) & (F.col("_t") >= F.col("_n") - window_ms) & flow.is_big("threshold", cfg))
    bull, bear = F.sum(F.when(S.is_bull(), F.col("premium_usd")).otherwise(0.0)), F.sum(F.when(S.is_bear(), F.col("premium_usd")).otherwise(0.0))
    g = j.groupBy("market", "step").agg(bull.alias("_u"), bear.alias("_d"))
    return g.select("market", "step", F.coalesce(F.try_divide(F.col("_u") - F.col("_d"), F.col("_u") + F.col("_d")), F.lit(0.0)).alias("big_imbalance"))


def timeline(prints: DataFrame, step_ms: int, s: Settings = Settings(), short_ms: int = 900_000, long_ms: int = 3_600_000, big_ms: int = 900_000) -> DataFrame:
    """One frame per step: (market, step, t, spot, overall and windowed flow, all clusters, contexts)."""
    d = with_steps(prints, step_ms)
    clock = step_clock(d)
    ctx = materialize(step_contexts(prints, step_ms, s), "contexts")  # read by flow, levels and the context arrays
    lv = levels.levels_from_contexts(ctx, s.weights, ["market", "step"])
    cl = levels.cluster_levels(lv, float(s.cluster_floor), ["market", "step"])
    cl = materialize(cl.drop("levels"), "clusters")
    near = levels.nearest_cluster(cl, clock.select("market", "step", "spot"), s.cluster_floor, ["market", "step"]).select(
        "market", "step", F.struct("low", "high", "center", "score", "distance", "inside", "distinct_types", "distinct_expirations").alias("nearest"))
    top = cl.groupBy("market", "step").agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high", "center", "score"))).alias("clusters"))
    cx = ctx.groupBy("market", "step").agg(F.array_sort(F.collect_list(F.struct("dte", "symbol", "max_pain", "poc", "w_sup", "w_res", "call_be", "put_be", "bull_ratio"))).alias("contexts"),
                                           F.sum("bull_premium").alias("bull_premium"), F.sum("bear_premium").alias("bear_premium"))
    t = S.ms("as_of").alias("t")
    roll = lambda ms_, n: flow.rolling_flow(prints, ["market"], ms_).select("market", "t", F.col("bull_ratio").alias(n), (F.col("bull_premium") + F.col("bear_premium")).alias(f"_p_{n}"))
    f = clock.select("market", "step", "as_of", "spot", t).join(cx, ["market", "step"]).join(top, ["market", "step"], "left").join(near, ["market", "step"], "left")
    f = f.join(roll(short_ms, "bull_ratio_15m"), ["market", "t"]).join(roll(long_ms, "bull_ratio_60m"), ["market", "t"])
    f = f.join(flow.flow_velocity(prints, ["market"], s.velocity_ms).select("market", "t", "velocity"), ["market", "t"])
    f = f.join(big_imbalance(d, clock, s.big, big_ms), ["market", "step"], "left").na.fill(0.0, ["big_imbalance"])
    total = F.greatest(F.col("bull_premium") + F.col("bear_premium"), F.lit(1.0))
    f = f.withColumn("bull_ratio", flow.bull_ratio(F.col("bull_premium"), F.col("bear_premium"))).withColumn("velocity_norm", S.clamp(F.col("velocity") / total, -1.0, 1.0))
    return f.withColumnRenamed("_p_bull_ratio_15m", "premium_15m").drop("_p_bull_ratio_60m").withColumn("t", F.col("as_of")).drop("as_of")
