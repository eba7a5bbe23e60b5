"""First-touch outcomes of signals, and thinning of overlapping signals."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import clock, scalars as S
from ..plans.longseries import fsm, materialize
from ..plans.pyramid import Pyramid


@dataclass(frozen=True)
class Rules:
    # fixed values
    spread: float = 0.3
    stop_atr: float = 1.2
    reward_risk: float = 1.8
    max_hold_ms: int = 14_400_000
    risk_usd: float = 100.0
    contract_size: float = 100.0


def first_touch(signals: DataFrame, bars: DataFrame, rules: Rules = Rules(), atr: str = "atr", flags: DataFrame | None = None) -> DataFrame:
    """One outcome per signal, independent of other signals, at a fixed 1R size.

    Entry at the next bar's open plus half the spread.  From the entry bar on: the stop is checked before the
    target, a gap fills at the open, a bar later than ``max_hold_ms`` closes the trade (0: never), and the last bar of
    the series closes what is open then.  ``bars`` need ``atr``; ``flags`` (series, idx, cell, exit_long, exit_short)
    close at the open after the flagged bar.  Signals with ``self_managed`` have no stop, target or clock: flags or the last bar
    close them, and a stop is their unit of risk only.  A ``reward_risk`` of 0 sets no target.

    Stop, target and clock are bounds on one side each, so one climb through a pyramid of extremes finds the bar where the
    first of them is met, and another its excursions, in as many joins as the pyramid has levels, however long a trade lasts."""
    half, side, long = rules.spread / 2.0, F.col("side"), F.col("side") == 1
    d = signals if "self_managed" in signals.columns else signals.withColumn("self_managed", F.lit(False))
    d = d.join(bars.select("series", "idx", F.col(atr).alias("_atr")), ["series", "idx"])
    d = d.join(bars.select("series", (F.col("idx") - 1).alias("idx"), F.col("time").alias("entry_time"), F.col("open").alias("_open")), ["series", "idx"])
    d = d.withColumn("entry_price", F.col("_open") + side * half)
    # an own stop, else one from the ATR; a trade that manages itself has it as a unit of risk only
    d = d.withColumn("stop", F.coalesce("stop", F.col("entry_price") - side * F.col("_atr") * rules.stop_atr))
    d = d.withColumn("risk", F.abs(F.col("entry_price") - F.col("stop"))).filter(F.col("risk") > 0)
    usual = F.when(~F.col("self_managed") & F.lit(rules.reward_risk != 0), F.col("entry_price") + side * F.col("risk") * rules.reward_risk)
    d = d.withColumn("target", F.coalesce("target", usual))
    trades = materialize(d.select("series", "cell", "idx", "side", "entry_time", "entry_price", "stop", "target", "risk", "self_managed"), "trades")
    tower = Pyramid(bars.withColumn("_ms", S.ms("time")), ["series"], {"top": ("high", "max"), "low": ("low", "min"), "ms": ("_ms", "max")})

    def ends(x: Column) -> Column:
        no = F.lit(False)
        stop = F.when(long, x["low"] <= F.col("stop")).otherwise(x["top"] >= F.col("stop"))
        target = F.when(long, x["top"] >= F.col("target")).otherwise(x["low"] <= F.col("target"))
        late = x["ms"] - S.ms("entry_time") > rules.max_hold_ms if rules.max_hold_ms > 0 else no
        return ~F.col("self_managed") & (F.coalesce(stop, no) | F.coalesce(target, no) | late)

    d = tower.first(trades, F.col("idx") + 1, ends, "_met")
    if flags is not None:
        mark = lambda c: F.when(F.col(c), 1.0).otherwise(0.0)
        marked = flags.filter("exit_long or exit_short").select("series", "cell", "idx", mark("exit_long").alias("long"), mark("exit_short").alias("short"))
        d = Pyramid(marked, ["series", "cell"], {"long": ("long", "max"), "short": ("short", "max")}).first(d, F.col("idx") + 1, lambda x: F.when(long, x["long"]).otherwise(x["short"]) > 0, "_flag")
        d = d.withColumn("_flag", F.col("_flag") + 1)
    else:
        d = d.withColumn("_flag", F.lit(None).cast("long"))
    last = bars.groupBy("series").agg(F.max("idx").alias("_last"))
    d = d.join(last, "series").withColumn("_flag", F.when(F.col("_flag") <= F.col("_last"), F.col("_flag")))
    d = d.withColumn("_x", F.coalesce(F.least("_met", "_flag"), "_last"))
    d = d.join(bars.select("series", F.col("idx").alias("_x"), *[F.col(c).alias(f"_x_{c}") for c in ("time", "open", "high", "low", "close")]), ["series", "_x"])
    bar = {c: F.col(f"_x_{c}") for c in ("time", "open", "high", "low", "close")}
    stopped = F.when(long, bar["low"] <= F.col("stop")).otherwise(bar["high"] >= F.col("stop"))
    reached = F.when(long, bar["high"] >= F.col("target")).otherwise(bar["low"] <= F.col("target"))
    open_end = F.col("_met").isNull() & F.col("_flag").isNull()
    kind = F.when(open_end, "END_OF_DATA").when(F.col("_flag") == F.col("_x"), "SIGNAL").when(stopped, "STOP").when(reached, "TARGET").otherwise("TIMEOUT")
    through = F.when(long, F.least(bar["open"], F.col("stop"))).otherwise(F.greatest(bar["open"], F.col("stop")))
    beyond = F.when(long, F.greatest(bar["open"], F.col("target"))).otherwise(F.least(bar["open"], F.col("target")))
    d = d.withColumn("exit_kind", kind)
    price = F.when(F.col("exit_kind") == "SIGNAL", bar["open"]).when(F.col("exit_kind") == "STOP", through).when(F.col("exit_kind") == "TARGET", beyond).otherwise(bar["close"])
    d = d.withColumn("_exit", price).withColumn("exit_time", bar["time"]).withColumn("_n", F.col("_x") - F.col("idx"))
    d = d.drop(*[f"_x_{c}" for c in bar])
    # excursions of the bars before the exit bar; the last bar of the series counts where it ended the trade
    d = tower.extremes(d, F.col("idx") + 1, F.col("_x") + F.when(open_end, 1).otherwise(0), {"top": "_top", "low": "_low"})
    return _measured(d, rules)


def _measured(done: DataFrame, rules: Rules) -> DataFrame:
    side, long = F.col("side"), F.col("side") == 1
    d = done.withColumn("exit_price", F.col("_exit") - side * rules.spread / 2.0)
    points = side * (F.col("exit_price") - F.col("entry_price"))
    best = F.greatest(F.lit(0.0), points, F.when(long, F.col("_top") - F.col("entry_price")).otherwise(F.col("entry_price") - F.col("_low")))
    worst = F.least(F.lit(0.0), points, F.when(long, F.col("_low") - F.col("entry_price")).otherwise(F.col("entry_price") - F.col("_top")))
    d = d.select("series", "cell", "idx", "side", "entry_time", "entry_price", "stop", "target", "exit_time", "exit_price", "exit_kind", "risk",
                 S.js_round(points / F.col("risk"), 4).alias("r"), S.js_round(worst / F.col("risk"), 4).alias("mae"),
                 S.js_round(best / F.col("risk"), 4).alias("mfe"), F.col("_n").alias("held"),
                 (S.ms("exit_time") - S.ms("entry_time")).alias("hold_ms"), clock.swap_nights("entry_time", "exit_time").alias("nights"))
    return d.withColumn("lots", rules.risk_usd / (F.col("risk") * rules.contract_size)).withColumn("pnl", S.js_round(F.col("r") * rules.risk_usd, 2))


THIN = T.StructType([T.StructField("idx", T.LongType()), T.StructField("keep", T.BooleanType())])


def thin(rows: DataFrame, keys: list[str], until: str, strict: bool = True) -> DataFrame:
    """Keep a signal only when the previously kept one is off: idx > its ``until`` (>= when not strict)."""
    def run(pdf: pd.DataFrame, state: list[float]):
        free, keep = state[0], []
        for i, u in zip(pdf["idx"].to_numpy(), pdf["_until"].to_numpy()):
            ok = i > free if strict else i >= free
            if ok:
                free = float(u)
            keep.append(bool(ok))
        return pd.DataFrame({"idx": pdf["idx"].to_numpy(), "keep": keep}), [free]

    r = fsm(rows.select(*keys, "idx", F.col(until).cast("double").alias("_until")), keys, run, [-1.0], THIN)
    return rows.join(r.filter("keep").select(*keys, "idx"), [*keys, "idx"], "left_semi")


def guard(rows: DataFrame, keys: list[str], per_day: int, cooldown_ms: int, time: str = "time") -> DataFrame:
    """At most ``per_day`` signals a day with ``cooldown_ms`` between them; state is bounded by one day."""
    def run(pdf: pd.DataFrame, state: list[float]):
        day, n, last, keep = *state, []
        for d, t in zip(pdf["_day"].to_numpy(), pdf["_t"].to_numpy()):
            if d != day:
                day, n, last = float(d), 0.0, float("-inf")
            ok = n < per_day and t - last >= cooldown_ms
            if ok:
                n, last = n + 1, float(t)
            keep.append(bool(ok))
        return pd.DataFrame({"idx": pdf["idx"].to_numpy(), "keep": keep}), [day, n, last]

    r = fsm(rows.select(*keys, "idx", F.unix_date(F.to_date(time)).alias("_day"), S.ms(time).alias("_t")), keys, run, [-1.0, 0.0, float("-inf")], THIN)
    return rows.join(r.filter("keep").select(*keys, "idx"), [*keys, "idx"], "left_semi")
