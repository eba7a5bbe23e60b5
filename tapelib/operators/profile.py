"""Per-strike positioning, payout, profiles, value areas and break-even prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S
from .flow import CONTRACT

MODES = ("PREMIUM", "VOLUME", "NET_PREMIUM", "ABS_NET_PREMIUM", "OPEN_INTEREST")
BREAK_EVEN_MODELS = ("premium-weighted", "premium-weighted-long", "size-weighted", "aggregate-payoff",
                     "net-positioning")


def positioning(prints: DataFrame, keys: list[str] = CONTRACT, mode: str = "volume") -> DataFrame:
    """Contracts per strike; the proxy is clamped at zero, the raw net is kept."""
    q = F.col("contracts") if mode == "volume" else S.position_sign() * F.col("contracts")
    call = F.col("option_type") == "CALL"
    d = prints.filter(S.finite("strike").isNotNull()).groupBy(*keys, "strike").agg(
        F.sum(F.when(call, q).otherwise(0.0)).alias("net_call"), F.sum(F.when(call, 0.0).otherwise(q)).alias("net_put"))
    return (d.withColumn("call_oi_proxy", F.greatest("net_call", F.lit(0.0)))
            .withColumn("put_oi_proxy", F.greatest("net_put", F.lit(0.0))))


def payout_curve(rows: DataFrame, multiplier: float, keys: list[str] = CONTRACT) -> DataFrame:
    """Intrinsic payout to holders if settled at each strike, from running sums over the strike board."""
    w = Window.partitionBy(*keys)
    up = w.orderBy("strike").rowsBetween(Window.unboundedPreceding, 0)
    down = w.orderBy(F.col("strike").desc()).rowsBetween(Window.unboundedPreceding, 0)
    c, p, k = F.col("call_oi_proxy"), F.col("put_oi_proxy"), F.col("strike")
    pay = (k * F.sum(c).over(up) - F.sum(c * k).over(up)) + (F.sum(p * k).over(down) - k * F.sum(p).over(down))
    return rows.withColumn("payout", pay * multiplier)


def max_pain(rows: DataFrame, multiplier: float, keys: list[str] = CONTRACT) -> DataFrame:
    """Strike with the smallest payout; the lower strike on ties."""
    return payout_curve(rows, multiplier, keys).groupBy(*keys).agg(
        F.min_by("strike", F.struct(F.round("payout", 6), "strike")).alias("max_pain"),
        F.min(F.round("payout", 6)).alias("min_payout"))


def max_pain_at(rows: DataFrame, candidates: DataFrame, multiplier: float, keys: list[str] = CONTRACT) -> DataFrame:
    """Max pain over explicit settlement candidates (keys, settlement).

    Candidates are merged into the strike board as rows without contracts, so each candidate's payout is
    one pair of running sums and no pairs are formed."""
    c = candidates.select(*keys, F.col("settlement").alias("strike"), F.lit(0.0).alias("call_oi_proxy"),
                          F.lit(0.0).alias("put_oi_proxy"), F.lit(True).alias("_cand"))
    board = rows.select(*keys, "strike", "call_oi_proxy", "put_oi_proxy").withColumn("_cand", F.lit(False)).unionByName(c)
    board = board.groupBy(*keys, "strike").agg(F.sum("call_oi_proxy").alias("call_oi_proxy"),
                                               F.sum("put_oi_proxy").alias("put_oi_proxy"), F.max("_cand").alias("_cand"))
    return payout_curve(board, multiplier, keys).filter("_cand").groupBy(*keys).agg(
        F.min_by("strike", F.struct(F.round("payout", 6), "strike")).alias("max_pain"),
        F.min(F.round("payout", 6)).alias("min_payout"))


def contribution(mode: str) -> Column:
    sign, prem, qty = S.position_sign(), F.col("premium_usd"), F.col("contracts")
    return {"PREMIUM": prem, "VOLUME": qty, "NET_PREMIUM": sign * prem, "ABS_NET_PREMIUM": F.abs(sign * prem),
            "OPEN_INTEREST": sign * qty}[mode]


def strike_profile(prints: DataFrame, mode: str = "PREMIUM", strike_step: float | None = None,
                   keys: list[str] = CONTRACT) -> DataFrame:
    """(keys, strike, call, put, total): contribution by strike, total = |call| + |put|."""
    k = F.col("strike")
    if strike_step:
        k = F.round(k / strike_step) * strike_step
    v, call = contribution(mode), F.col("option_type") == "CALL"
    d = prints.filter(S.finite("strike").isNotNull()).groupBy(*keys, k.alias("strike")).agg(
        F.sum(F.when(call, v).otherwise(0.0)).alias("call"), F.sum(F.when(call, 0.0).otherwise(v)).alias("put"))
    return finish_profile(d)


def finish_profile(d: DataFrame) -> DataFrame:
    d = d.withColumn("call", S.js_round("call", 2)).withColumn("put", S.js_round("put", 2))
    return d.withColumn("total", S.js_round(F.abs("call") + F.abs("put"), 2))


def value_area_expr(rows: Column, pct: float) -> Column:
    """Walk over an array of structs (x, total) sorted by x: start at the largest total (lowest x on ties)
    and keep taking the heavier neighbour, upper side on ties, until ``pct`` of the total is enclosed.
    Returns struct(lo, hi, poc, acc) of 1-based positions."""
    n = F.size(rows)
    totals = F.transform(rows, lambda r: r["total"])
    poc = F.array_position(totals, F.array_max(totals)).cast("int")
    target = F.aggregate(totals, F.lit(0.0), lambda a, x: a + x) * pct

    def at(i):
        return F.coalesce(F.try_element_at(totals, F.when((i >= 1) & (i <= n), i).otherwise(n + 1)), F.lit(float("-inf")))

    def step(s, _):
        lo, hi, acc = s["lo"], s["hi"], s["acc"]
        below, above = at(lo - 1), at(hi + 1)
        done = (acc >= target) | ((lo == 1) & (hi == n))
        up = ~done & (above >= below)
        down = ~done & (above < below)
        return F.struct(F.when(down, lo - 1).otherwise(lo).alias("lo"), F.when(up, hi + 1).otherwise(hi).alias("hi"),
                        (acc + F.when(up, above).when(down, below).otherwise(F.lit(0.0))).alias("acc"))

    start = F.struct(poc.alias("lo"), poc.alias("hi"), F.element_at(totals, poc).alias("acc"))
    end = F.aggregate(F.sequence(F.lit(1), n), start, step)
    return F.struct(end["lo"].alias("lo"), end["hi"].alias("hi"), poc.alias("poc"), end["acc"].alias("acc"))


def profile_levels(profile: DataFrame, pct: float = 0.7, keys: list[str] = CONTRACT) -> DataFrame:
    """POC, value area and the next node over and under the POC, one row per key.

    The array holds one entry per strike of a contract (the listed board), never prints."""
    d = profile.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("strike").alias("x"), "total"))).alias("_a"))
    d = d.withColumn("_v", value_area_expr(F.col("_a"), pct))
    n, poc = F.size("_a"), F.col("_v.poc")

    def tot(i):
        return F.coalesce(F.try_element_at(F.col("_a"), F.when((i >= 1) & (i <= n), i).otherwise(n + 1))["total"],
                          F.lit(float("-inf")))

    def peak(i):
        return (tot(i) >= tot(i - 1)) & (tot(i) >= tot(i + 1))

    def node(idx):
        """``idx``: positions walking away from the POC."""
        first = F.try_element_at(F.filter(idx, peak), F.lit(1))
        best = F.array_max(F.transform(idx, tot))
        widest = F.try_element_at(F.filter(idx, lambda i: tot(i) == best), F.lit(1))
        return F.try_element_at(F.col("_a"), F.coalesce(first, widest, n + 1))["x"]

    up = F.when(poc < n, F.sequence(poc + 1, n)).otherwise(F.array().cast("array<int>"))
    down = F.when(poc > 1, F.sequence(poc - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("_up", up).withColumn("_dn", down)
    at = lambda i: F.element_at(F.col("_a"), i)["x"]
    return d.select(*keys, at(poc).alias("poc"), at(F.col("_v.hi")).alias("vah"), at(F.col("_v.lo")).alias("val"),
                    node(F.col("_up")).alias("above_poc"), node(F.col("_dn")).alias("under_poc"))


def _weighted(prints, keys, weight, extra=None) -> DataFrame:
    call = F.col("option_type") == "CALL"
    w = weight if extra is None else F.when(extra, weight)
    w = F.when(w > 0, w)
    v = F.col("strike") + F.when(call, 1.0).otherwise(-1.0) * F.col("trade_price")

    def mean(side):
        return F.try_divide(F.sum(F.when(side, v * w)), F.sum(F.when(side, w)))

    return prints.groupBy(*keys).agg(mean(call).alias("call_be"), mean(~call).alias("put_be"))


def break_even(prints: DataFrame, model: str = "premium-weighted", multiplier: float = 100.0,
               keys: list[str] = CONTRACT) -> DataFrame:
    """(keys, call_be, put_be) under one of ``BREAK_EVEN_MODELS``."""
    if model == "premium-weighted":
        return _weighted(prints, keys, F.col("premium_usd"))
    if model == "premium-weighted-long":
        return _weighted(prints, keys, F.col("premium_usd"), F.col("aggressor_side") == "BUY")
    if model == "size-weighted":
        return _weighted(prints, keys, F.col("contracts"))
    call = F.col("option_type") == "CALL"
    if model == "net-positioning":
        sign = S.position_sign()
        slots = prints.filter(sign != 0).groupBy(*keys, "option_type", "strike").agg(
            F.sum(sign * F.col("contracts")).alias("qty"),
            F.sum(sign * F.col("trade_price") * F.col("contracts")).alias("cost")).filter(F.col("qty") > 0)
        v = F.col("strike") * F.col("qty") + F.when(call, 1.0).otherwise(-1.0) * F.col("cost")
        return slots.groupBy(*keys).agg(
            F.try_divide(F.sum(F.when(call, v)), F.sum(F.when(call, F.col("qty")))).alias("call_be"),
            F.try_divide(F.sum(F.when(~call, v)), F.sum(F.when(~call, F.col("qty")))).alias("put_be"))
    if model == "aggregate-payoff":
        return aggregate_payoff(prints, multiplier, keys)
    raise ValueError(f"unknown break-even model {model} (have: {', '.join(BREAK_EVEN_MODELS)})")


def aggregate_payoff(prints: DataFrame, multiplier: float, keys: list[str] = CONTRACT) -> DataFrame:
    """Settlement price at which payout repays premium.

    Payout is convex and piecewise linear in the settlement price: the maximum over strikes of the line
    through all strikes on its paying side.  So the root is the smallest (calls) or largest (puts) of the
    lines' own roots, clamped to the search bracket; no iteration is needed."""
    board = prints.groupBy(*keys, "option_type", "strike").agg(
        F.sum("contracts").alias("q"), F.sum("premium_usd").alias("prem"))
    w = Window.partitionBy(*keys, "option_type")
    up = w.orderBy("strike").rowsBetween(Window.unboundedPreceding, 0)
    down = w.orderBy(F.col("strike").desc()).rowsBetween(Window.unboundedPreceding, 0)
    k, q = F.col("strike"), F.col("q")
    cost = F.sum("prem").over(w) / multiplier
    call = F.col("option_type") == "CALL"
    root = F.when(call, F.try_divide(cost + F.sum(k * q).over(up), F.sum(q).over(up))).otherwise(
        F.try_divide(F.sum(k * q).over(down) - cost, F.sum(q).over(down)))
    d = board.withColumn("root", root).groupBy(*keys, "option_type").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("strike").alias("mn"), F.max("strike").alias("mx"))
    be = F.when(call, F.least(F.greatest("lo", "mn"), F.col("mx") * 3.0)).otherwise(
        F.least(F.greatest("hi", F.lit(0.0)), F.col("mx")))
    d = d.withColumn("be", be)
    return d.groupBy(*keys).agg(F.max(F.when(call, F.col("be"))).alias("call_be"),
                                F.max(F.when(~call, F.col("be"))).alias("put_be"))


def net_positioning_by_strike(prints: DataFrame, keys: list[str] = CONTRACT) -> DataFrame:
    sign, call = S.position_sign(), F.col("option_type") == "CALL"
    return prints.filter(sign != 0).groupBy(*keys, "strike").agg(
        F.sum(F.when(call, sign * F.col("contracts")).otherwise(0.0)).alias("call_net"),
        F.sum(F.when(call, 0.0).otherwise(sign * F.col("contracts"))).alias("put_net"))
