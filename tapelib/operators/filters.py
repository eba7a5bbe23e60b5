"""Entry gates and flat windows around any strategy.

A gate may stop an entry.  A flat window also ends what is open: its bars carry exit flags for both sides, so the trade closes at
the open after the first of them (see :func:`outcomes.first_touch`), whatever the strategy would have done."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import clock
from . import indicators as I, joins as J, outcomes as O, signals as G


@dataclass(frozen=True)
class Gate:
    """``allowed`` gives a Column over a bar and the indicators in ``specs``; no reading means no entry."""

    allowed: Callable[[], Column]
    specs: list = field(default_factory=list)


def hours(start: int, stop: int) -> Gate:
    """New York wall clock, hhmm, half-open, may wrap midnight."""
    return Gate(lambda: clock.in_window(clock.ny_minute(), clock.hhmm(start), clock.hhmm(stop)))


def sessions(windows: list[tuple[int, int]]) -> Gate:
    return Gate(lambda: clock.in_sessions(clock.ny_minute(), [(clock.hhmm(a), clock.hhmm(b)) for a, b in windows]))


def weekdays(mask: int) -> Gate:
    return Gate(lambda: clock.weekday_in(mask))


def before_weekend(friday_hhmm: int = 1600) -> Gate:
    return Gate(lambda: ~clock.past_weekend_cutoff("time", friday_hhmm))


def volatility_regime(fast: int, slow: int, least: float, most: float) -> Gate:
    """ATR of ``fast`` bars as a ratio of that of ``slow`` bars."""
    f, s = I.spec("atr", period=fast), I.spec("atr", period=slow)
    return Gate(lambda: F.try_divide(I.column_key(f), I.column_key(s)).between(least, most), [f, s])


def volatility_percent(period: int, least: float, most: float) -> Gate:
    """ATR in percent of the close."""
    a = I.spec("atr", period=period)
    return Gate(lambda: F.try_divide(100.0 * F.col(I.column_key(a)), F.col("close")).between(least, most), [a])


def gate_table(bars: DataFrame, gates: list[Gate] = (), flat: list[tuple[int, int]] = (), intervals: DataFrame | None = None, keys: list[str] = ("series",)) -> DataFrame:
    """(series, idx, allowed, flat) of every bar.  ``flat``: New York windows (hhmm); ``intervals``: half-open (keys, start, stop),
    in any order and overlapping, in which nothing may be held either."""
    specs = [s for g in gates for s in g.specs]
    d = I.compute(bars, specs) if specs else bars
    allowed = F.lit(True)
    for g in gates:
        allowed = allowed & F.coalesce(g.allowed(), F.lit(False))
    is_flat = clock.in_sessions(clock.ny_minute(), [(clock.hhmm(a), clock.hhmm(b)) for a, b in flat]) if flat else F.lit(False)
    d = d.select("series", "idx", "time", allowed.alias("allowed"), is_flat.alias("flat"))
    if intervals is not None:
        d = J.inside(d, J.union_intervals(intervals, list(keys), "start", "stop"), list(keys), "_in").withColumn("flat", F.col("flat") | F.col("_in")).drop("_in")
    return d.drop("time")


def filtered(flags: DataFrame, table: DataFrame) -> DataFrame:
    """Signals with exit flags (``signals(..., flags=True)``) under a gate table: no entry where it is not allowed or flat, exits of
    both sides where it is flat."""
    d = flags.join(table, ["series", "idx"])
    d = d.withColumn("side", F.when(F.col("allowed") & ~F.col("flat"), F.col("side")))
    return d.withColumn("exit_long", F.col("exit_long") | F.col("flat")).withColumn("exit_short", F.col("exit_short") | F.col("flat")).drop("allowed", "flat")


def trade(bars: DataFrame, cells: list[tuple[str, str, dict]], rules: O.Rules = O.Rules(), table: DataFrame | None = None, own_exits: bool = True, companion: DataFrame | None = None, atr: str = "atr") -> DataFrame:
    """Outcomes of any cells.  Exit flags are evaluated only for cells that need them: those that manage themselves, all under a
    gate table, and, with ``own_exits``, those of other strategies.  ``bars`` need the column ``atr``."""
    flagged = [c for c in cells if table is not None or own_exits or G.lookup(c[1]).exits == "strategy"]
    plain = [c for c in cells if c not in flagged]
    out = None
    if plain:
        out = O.first_touch(G.signals(bars, plain, companion), bars, rules, atr)
    if flagged:
        f = G.signals(bars, flagged, companion, flags=True)
        f = filtered(f, table) if table is not None else f
        f = O.materialize(f.filter(F.col("side").isNotNull() | F.col("exit_long") | F.col("exit_short")), "flags")
        one = O.first_touch(f.filter(F.col("side").isNotNull()), bars, rules, atr, flags=f)
        out = one if out is None else out.unionByName(one)
    return out
