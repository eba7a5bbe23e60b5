"""Performance of outcome rows, leaderboards, gates, costs and rebates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S
from .bars import resample
from .indicators import with_atr
from ..plans.longseries import materialize, with_index


def profit_factor(pnl) -> Column:
    """Gross win over gross loss as an aggregate; infinite without losses, a zero counts as a loss."""
    p = S.col(pnl)
    win, loss = F.sum(F.when(p > 0, p).otherwise(0.0)), F.sum(F.when(p > 0, 0.0).otherwise(-p))
    return F.when(loss > 0, F.try_divide(win, loss)).otherwise(float("inf"))


def drawdown(outcomes: DataFrame, keys: list[str], pnl: str = "pnl", start: float = 0.0) -> DataFrame:
    """(keys, max_drawdown, peak) of the running equity in order of exit.

    Runs per (keys, day) and composes days, so one cell with very many trades is not one task."""
    d = outcomes.withColumn("_d", F.to_date("exit_time"))
    order = [c for c in ("exit_time", "entry_time", "series", "idx") if c in outcomes.columns]
    w = Window.partitionBy(*keys, "_d").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_e", F.sum(pnl).over(w))
    d = d.withColumn("_dd", F.greatest(F.lit(0.0), F.max("_e").over(w)) - F.col("_e"))
    day = d.groupBy(*keys, "_d").agg(F.max("_dd").alias("dd"), F.max("_e").alias("hi"), F.min("_e").alias("lo"), F.sum(pnl).alias("sum"))
    before = Window.partitionBy(*keys).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    day = day.withColumn("off", F.coalesce(F.sum("sum").over(before), F.lit(0.0)))
    day = day.withColumn("pk", F.greatest(F.lit(0.0), F.coalesce(F.max(F.col("off") + F.col("hi")).over(before), F.lit(0.0))))
    return day.groupBy(*keys).agg(F.max(F.greatest("dd", F.col("pk") - F.col("off") - F.col("lo"))).alias("max_drawdown"),
                                  (F.greatest(F.lit(0.0), F.max(F.col("off") + F.col("hi"))) + start).alias("peak"))


def performance(outcomes: DataFrame, keys: list[str], start: float = 10_000.0) -> DataFrame:
    """Win rate, R statistics, profit factor, drawdown, Sharpe and exits by kind of each key."""
    win = F.col("pnl") > 0
    r4 = lambda c: S.js_round(c, 4)
    g = outcomes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.avg(F.when(win, 1.0).otherwise(0.0)).alias("win_rate"), F.avg("r").alias("_mean"),
        F.stddev_samp("r").alias("_sd"), r4(F.avg(F.when(win, F.col("r")))).alias("avg_win_r"), r4(F.avg(F.when(~win, F.col("r")))).alias("avg_loss_r"),
        profit_factor("pnl").alias("_pf"), r4(F.sum("r")).alias("total_r"), S.js_round(F.sum("pnl"), 2).alias("net_pnl"),
        r4(F.avg("mae")).alias("avg_mae"), r4(F.avg("mfe")).alias("avg_mfe"), S.js_round(F.avg("hold_ms") / 60_000.0, 2).alias("avg_hold_min"))
    pf = F.when(F.col("_pf") == float("inf"), F.col("_pf")).otherwise(r4(F.col("_pf")))
    g = g.withColumn("avg_r", r4("_mean")).withColumn("expectancy", r4("_mean")).withColumn("profit_factor", pf)
    g = g.withColumn("sharpe", F.when(F.col("_sd") > 0, r4(F.try_divide(F.col("_mean"), F.col("_sd")) * F.sqrt("trades"))))
    kinds = outcomes.groupBy(*keys, "exit_kind").agg(F.count(F.lit(1)).alias("_n"))
    hist = kinds.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("exit_kind", "_n")))).alias("exits"))
    dd = drawdown(outcomes, keys, start=start)
    dd = dd.withColumn("max_drawdown_pct", r4(F.try_divide(F.col("max_drawdown"), F.col("peak")) * 100.0)).withColumn("max_drawdown", S.js_round("max_drawdown", 2))
    g = g.withColumn("return_pct", r4(F.col("net_pnl") / start * 100.0))
    return g.drop("_mean", "_sd", "_pf").join(hist, keys).join(dd.drop("peak"), keys)


def score(trades="trades", pf="profit_factor") -> Column:
    t, p = S.col(trades), S.col(pf)
    p = F.when(p == float("inf"), 3.0).otherwise(p)
    return F.when(t == 0, float("-inf")).when(t < 5, -1e6 + t).otherwise(p * F.least(t / 30.0, F.lit(1.0)))


def leaderboard(metrics: DataFrame, cell: str = "cell") -> DataFrame:
    m = metrics.withColumn("score", score())
    return m.withColumn("rank", F.row_number().over(Window.orderBy(F.round("score", 9).desc(), cell)))


def sweep_summary(metrics: DataFrame, keys: list[str], min_trades: int = 5) -> DataFrame:
    """Usable cells, median profit factor (infinite counts 3), median expectancy, profitable share."""
    pf = F.when(F.col("profit_factor") == float("inf"), 3.0).otherwise(F.col("profit_factor"))
    use = metrics.withColumn("_u", F.col("trades") >= min_trades)
    u = F.col("_u")
    return use.groupBy(*keys).agg(F.count(F.lit(1)).alias("cells"), F.sum(u.cast("int")).alias("usable"), F.percentile(F.when(u, pf), F.lit(0.5)).alias("median_pf"),
                                  F.percentile(F.when(u, F.col("expectancy")), F.lit(0.5)).alias("median_expectancy"),
                                  F.avg(F.when(u, (F.col("expectancy") > 0).cast("double"))).alias("profitable_share"))


def gate(metrics: DataFrame, min_trades: int = 30, min_pf: float = 1.2, min_expectancy: float = 0.05) -> DataFrame:
    ok = lambda c, v: F.coalesce((F.col(c) >= v) & ~F.isnan(F.col(c).cast("double")), F.lit(False))
    why = F.array_compact(F.array(F.when(~ok("trades", min_trades), F.concat(F.lit("only "), F.col("trades").cast("string"), F.lit(f" trades (need {min_trades})"))),
                                  F.when(~ok("profit_factor", min_pf), F.lit(f"profit factor under {min_pf}")),
                                  F.when(~ok("expectancy", min_expectancy), F.lit(f"expectancy under {min_expectancy}R"))))
    return metrics.withColumn("reasons", why).withColumn("promising", F.size(why) == 0)


def rebate_credit(outcomes: DataFrame, share: float, spread: float, contract_size: float) -> DataFrame:
    """Share of the paid spread handed back per trade, and the credited result."""
    credit = share * spread * F.col("lots") * contract_size
    return outcomes.withColumn("credit", credit).withColumn("pnl_credited", F.col("pnl") + credit)


def rebate_totals(outcomes: DataFrame, keys: list[str], risk_usd: float) -> DataFrame:
    return outcomes.groupBy(*keys).agg(F.sum("credit").alias("credit"), F.avg(F.col("credit") / risk_usd).alias("mean_fraction_of_r"),
                                       profit_factor("pnl").alias("pf_gross"), profit_factor("pnl_credited").alias("pf_credited"))


def ranked(df: DataFrame, keys: list[str], value: str, slices: int = 1024) -> DataFrame:
    """Distinct values with the rows at or under them (``_hi``) and the key's row count ``n``.

    Values are counted first and cut into equal-width slices of the key's range, so one key's values are
    spread over many tasks; only slice totals are summed per key."""
    c = materialize(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")), "counts")
    lim = c.groupBy(*keys).agg(F.min(value).alias("_mn"), F.max(value).alias("_mx"), F.sum("_c").alias("n"))
    pos = F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("_mn"), F.col("_mx") - F.col("_mn")) * slices), F.lit(0))
    c = c.join(lim, keys).withColumn("_bk", pos).drop("_mn", "_mx")
    w = Window.partitionBy(*keys, "_bk").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    off = c.groupBy(*keys, "_bk").agg(F.sum("_c").alias("_t"))
    wb = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    off = off.select(*keys, "_bk", F.coalesce(F.sum("_t").over(wb), F.lit(0)).alias("_off"))
    return c.withColumn("_h", F.sum("_c").over(w)).join(off, [*keys, "_bk"]).withColumn("_hi", F.col("_h") + F.col("_off")).drop("_h", "_off", "_bk")


def percentiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Interpolated quantiles of each key without gathering its values in one task."""
    c = ranked(df, keys, value)
    at = lambda pos: F.min(F.when(F.col("_hi") > pos, F.col(value)))
    cols, out = [], []
    for name, q in qs.items():
        pos = F.lit(q) * (F.col("n") - 1)
        cols += [at(F.floor(pos)).alias(f"_a_{name}"), at(F.ceil(pos)).alias(f"_b_{name}")]
        out.append((F.col(f"_a_{name}") + (F.col(f"_b_{name}") - F.col(f"_a_{name}")) * (F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1)))).alias(name))
    return c.groupBy(*keys).agg(F.max("n").alias("n"), *cols).select(*keys, "n", *out)


def nearest_rank_by(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Quantiles at index round(q (n - 1)) of the sorted values."""
    c = ranked(df, keys, value)
    pick = [F.min(F.when(F.col("_hi") > F.floor(F.lit(q) * (F.col("n") - 1) + 0.5), F.col(value))).alias(a) for a, q in qs.items()]
    return c.groupBy(*keys).agg(F.max("n").alias("n"), *pick)


def cost_fractions(bars: DataFrame, spread: float, stop_atr: float, rules: dict[str, tuple[int, int]], eras: dict[str, tuple] | None = None) -> DataFrame:
    """spread / (stop_atr x ATR) at several bar sizes: n, p10, p50, p90 and the median stop.

    ``rules`` maps a name to (step ms, clock offset ms)."""
    out = None
    for name, (step, off) in rules.items():
        b = resample(bars, step, off)
        b = with_index(b, ["series"], ["time"], F.floor((S.ms("time") + off) / (step * 4096)))
        d = with_atr(b, 14).filter(F.col("atr") > 0).withColumn("stop", F.col("atr") * stop_atr)
        d = d.withColumn("ratio", F.round(spread / F.col("stop"), 9)).withColumn("stop", F.round("stop", 9)).withColumn("rule", F.lit(name))
        out = d.select("series", "time", "rule", "ratio", "stop") if out is None else out.unionByName(d.select("series", "time", "rule", "ratio", "stop"))
    keys = ["series", "rule"]
    if eras:
        era = F.lit(None).cast("string")
        for name, (a, b) in eras.items():
            era = F.when((F.col("time") >= F.lit(a).cast("timestamp")) & (F.col("time") < F.lit(b).cast("timestamp")), name).otherwise(era)
        out, keys = out.withColumn("era", era).filter(F.col("era").isNotNull()), [*keys, "era"]
    a = nearest_rank_by(out, keys, "ratio", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return a.join(nearest_rank_by(out, keys, "stop", {"median_stop": 0.5}).drop("n"), keys)


def pass_rates(rows: DataFrame, keys: list[str], conditions: dict[str, Column]) -> DataFrame:
    """Per condition: how many rows pass it, pass all the others, and pass everything."""
    names = list(conditions)
    d = rows.select(*keys, *[F.coalesce(c, F.lit(False)).alias(n) for n, c in conditions.items()])
    every = lambda skip=None: F.array_min(F.array(F.lit(True), *[F.col(n) for n in names if n != skip]))
    hit = lambda c: F.sum(c.cast("int"))
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("bars"), hit(every()).alias("_all"), *[hit(F.col(n)).alias(f"_p_{n}") for n in names],
                             *[hit(every(n)).alias(f"_o_{n}") for n in names])
    rows_ = F.array(*[F.struct(F.lit(n).alias("condition"), F.col(f"_p_{n}").alias("passes"), F.col(f"_o_{n}").alias("passes_others")) for n in names])
    return g.select(*keys, "bars", F.col("_all").alias("passes_all"), F.inline(rows_))


def cost_sensitivity(outcomes: DataFrame, keys: list[str], spread: float, fractions=(0.0, 0.25, 0.5, 1.0, 2.0)) -> DataFrame:
    """Profit factor when the round-turn cost is scaled; the cost of a trade in R is spread / risk."""
    d = outcomes.withColumn("fraction", F.explode(F.array(*[F.lit(float(x)) for x in fractions])))
    d = d.withColumn("_p", F.col("r") + (1.0 - F.col("fraction")) * spread / F.col("risk"))
    return d.groupBy(*keys, "fraction").agg(profit_factor("_p").alias("profit_factor"), F.count(F.lit(1)).alias("trades"))


def volume_economics(outcomes: DataFrame, keys: list[str], swap_per_lot: float, spread: float, contract_size: float) -> DataFrame:
    """Trades per year, swap and net per lot, and the rebate share that would break even."""
    span = (F.max(S.ms("exit_time")) - F.min(S.ms("entry_time"))) / (365.25 * 86_400_000.0)
    lots, swap = F.sum("lots"), F.sum(F.col("nights") * F.col("lots") * swap_per_lot)
    net = F.sum("pnl") + swap
    cost = F.sum(F.col("lots") * spread * contract_size)
    return outcomes.groupBy(*keys).agg(F.try_divide(F.count(F.lit(1)).cast("double"), span).alias("trades_per_year"), F.try_divide(swap, lots).alias("swap_per_lot"),
                                       F.try_divide(net, lots).alias("net_per_lot"), F.try_divide(net - swap, lots).alias("ex_swap_per_lot"),
                                       F.avg(F.try_divide(F.col("pnl"), F.col("lots"))).alias("fixed_lot_mean"),
                                       F.greatest(F.lit(0.0), -F.try_divide(net, cost)).alias("break_even_share"))


def split_excluded(outcomes: DataFrame, excluded: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(counted, excluded): named trades stay in the record and leave the totals."""
    return outcomes.join(excluded, on, "left_anti"), outcomes.join(excluded, on, "left_semi")


def concentration(df: DataFrame, keys: list[str], value: str, time: str) -> DataFrame:
    """Month with the largest share of the net; NULL where the net is smaller than a month's own size."""
    m = df.groupBy(*keys, F.date_format(time, "yyyy-MM").alias("month")).agg(F.sum(value).alias("v"))
    g = m.groupBy(*keys).agg(F.sum("v").alias("net"), F.max(F.abs("v")).alias("big"), F.max_by("month", F.struct("v", "month")).alias("top"),
                             F.max("v").alias("top_v"), F.min_by("month", F.struct("v", "month")).alias("low"), F.min("v").alias("low_v"))
    ok = F.abs("net") >= F.col("big")
    return g.select(*keys, "net", F.when(ok, F.when(F.col("net") > 0, F.col("top")).otherwise(F.col("low"))).alias("month"),
                    F.when(ok, 100.0 * F.try_divide(F.when(F.col("net") > 0, F.col("top_v")).otherwise(F.col("low_v")), F.col("net"))).alias("share"))


def folds(outcomes: DataFrame, bars: DataFrame, n: int, select_by: str = "expectancy", min_trades: int = 5) -> DataFrame:
    """Chronological folds by bar number: per fold the best cell on the train part and its test result.

    Bars are cut into n + 1 equal parts; fold f trains on the parts before part f and tests on part f."""
    size = bars.groupBy("series").agg((F.max("idx") + 1).alias("_n"))
    d = outcomes.join(size, "series").withColumn("part", F.least(F.floor(F.col("idx") * (n + 1) / F.col("_n")), F.lit(n)))
    train = d.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("_tr", F.col("part") < F.col("fold"))
    train = train.filter(F.col("part") <= F.col("fold"))
    m = train.groupBy("series", "cell", "fold", "_tr").agg(F.count(F.lit(1)).alias("trades"), F.avg("r").alias("expectancy"), profit_factor("pnl").alias("profit_factor"))
    tr = m.filter("_tr").filter(F.col("trades") >= min_trades)
    w = Window.partitionBy("series", "fold").orderBy(F.round(select_by, 9).desc(), "cell")
    best = tr.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("series", "fold", "cell", F.col("trades").alias("train_trades"), F.col("expectancy").alias("train_expectancy"))
    te = m.filter("not _tr").select("series", "fold", "cell", F.col("trades").alias("test_trades"), F.col("expectancy").alias("test_expectancy"))
    return best.join(te, ["series", "fold", "cell"], "left")
