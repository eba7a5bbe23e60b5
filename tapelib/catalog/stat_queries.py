"""Queries over the statistical operators."""

from pyspark.sql import functions as F

from ..functions import clock, scalars as S
from ..operators import indicators as I, metrics as M, outcomes as O, signals as G, stats as X, structure as ST
from ..sources import tables
from . import signal_queries as SQ
from .registry import R, Rs, cte, query, r6, r6s, sql

HOUR = 3_600_000
_bars = tables.bars

cte("ff", """SELECT *, r/atr AS z, hour(ts) AS hour FROM (SELECT *, close - pc AS r, CASE WHEN count(tr1) OVER a = 24 THEN avg(tr1) OVER a END AS atr, lead(close, 1) OVER w - close AS f1, lead(close, 4) OVER w - close AS f4,
 CASE WHEN count(*) OVER n = 4 THEN max(high) OVER n END AS h4, CASE WHEN count(*) OVER n = 4 THEN min(low) OVER n END AS l4 FROM (SELECT *, CASE WHEN idx > 0 THEN tr END AS tr1 FROM moves)
 WINDOW w AS (PARTITION BY series ORDER BY idx), a AS (PARTITION BY series ORDER BY idx ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), n AS (PARTITION BY series ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING))""", "moves")
MF = "CASE WHEN r > 0 THEN h4-close WHEN r < 0 THEN close-l4 END"
MA = "CASE WHEN r > 0 THEN close-l4 WHEN r < 0 THEN h4-close END"


def _ff(spark, sf):
    return X.forward_features(_bars(spark, sf), 24)


@query("forward_features", sql(f"SELECT series, idx, {Rs('r', 'atr', 'z', 'f1', 'f4')}, {R(MF)} AS mfe4, {R(MA)} AS mae4 FROM ff", "ff"))
def forward_features(spark, sf):
    return _ff(spark, sf).select("series", "idx", *r6s("r", "atr", "z", "f1", "f4", "mfe4", "mae4"))


cte("cont", "SELECT *, c - avg(c) OVER (PARTITION BY series, hour) AS dv, avg(c) OVER (PARTITION BY series, hour) AS m, count(*) OVER (PARTITION BY series, hour) AS n FROM (SELECT *, sign(r)*f4 AS c FROM ff WHERE sign(r) <> 0 AND f4 IS NOT NULL)", "ff")


@query("continuation_by_hour", sql(f"""SELECT series, hour, n, {R('m')} AS mean, {R('CASE WHEN v > 0 THEN m/sqrt(v/n) END')} AS t, {R('absm')} AS abs_move FROM (SELECT series, hour, any_value(n) AS n, any_value(m) AS m, (sum(dv*dv) + 2*(1-1/5.0)*coalesce(sum(dv*l1),0) + 2*(1-2/5.0)*coalesce(sum(dv*l2),0) + 2*(1-3/5.0)*coalesce(sum(dv*l3),0) + 2*(1-4/5.0)*coalesce(sum(dv*l4),0))/any_value(n) AS v FROM
 (SELECT series, hour, n, m, dv, lag(dv,1) OVER w AS l1, lag(dv,2) OVER w AS l2, lag(dv,3) OVER w AS l3, lag(dv,4) OVER w AS l4 FROM cont WINDOW w AS (PARTITION BY series, hour ORDER BY t)) GROUP BY ALL) JOIN (SELECT series, hour, avg(abs(f4)) AS absm FROM ff WHERE f4 IS NOT NULL GROUP BY ALL) USING (series, hour)""", "cont"))
def continuation_by_hour(spark, sf):
    d = X.continuation(_ff(spark, sf), ["series", "hour"], 4, min_n=1)
    return d.select("series", "hour", "n", *r6s("mean", "t", "abs_move"))


@query("continuation_by_z_band", sql(f"SELECT series, band, count(*) AS n, {R('avg(c)')} AS mean FROM (SELECT *, CASE WHEN abs(z) < 0.5 THEN 0 WHEN abs(z) < 1 THEN 1 WHEN abs(z) < 2 THEN 2 ELSE 3 END AS band FROM cont WHERE z IS NOT NULL) GROUP BY ALL", "cont"))
def continuation_by_z(spark, sf):
    d = _ff(spark, sf).withColumn("band", X.z_band()).filter(F.col("band").isNotNull())
    return X.continuation(d, ["series", "band"], 4).select("series", "band", "n", r6("mean"))


@query("continuation_hour_by_band")
def continuation_cross(spark, sf):
    d = _ff(spark, sf).withColumn("band", X.z_band()).filter(F.col("band").isNotNull()).withColumn("block", F.floor(F.col("hour") / 6))
    return X.continuation(d, ["series", "block", "band"], 4).filter(F.col("n") >= 10).select("series", "block", "band", "n", *r6s("mean", "t"))


@query("path_efficiency", sql(f"""SELECT series, idx, {R('CASE WHEN count(a) OVER n = 6 THEN abs(lead(close,6) OVER w - close)/nullif(sum(a) OVER n,0) END')} AS eff_fwd, {R('CASE WHEN count(a) OVER p = 6 THEN abs(close - lag(close,6) OVER w)/nullif(sum(a) OVER p,0) END')} AS eff_past FROM (SELECT *, abs(close-pc) AS a FROM moves)
 WINDOW w AS (PARTITION BY series ORDER BY idx), n AS (PARTITION BY series ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING), p AS (PARTITION BY series ORDER BY idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""", "moves"))
def path_efficiency(spark, sf):
    return X.path_efficiency(_bars(spark, sf), 6).select("series", "idx", *r6s("eff_fwd", "eff_past"))


@query("path_efficiency_null")
def path_efficiency_null(spark, sf):
    d = X.path_efficiency_null(_bars(spark, sf), 6, 20, F.floor(F.hour("time") / 6))
    return d.select("series", "group", *r6s("observed", "null_mean", "percentile"))


@query("displacement_give_back", sql(f"SELECT series, band, hour//8 AS block, count(*) AS n, {R('avg(-sign(r)*f4/atr)')} AS give_back, {R(f'avg({MF}/atr)')} AS mfe, {R(f'avg({MA}/atr)')} AS mae FROM (SELECT *, CASE WHEN abs(z) < 0.5 THEN 0 WHEN abs(z) < 1 THEN 1 WHEN abs(z) < 2 THEN 2 ELSE 3 END AS band FROM ff WHERE atr > 0 AND f4 IS NOT NULL AND sign(r) <> 0) GROUP BY ALL", "ff"))
def give_back(spark, sf):
    d = _ff(spark, sf).withColumn("band", X.z_band()).withColumn("block", F.floor(F.col("hour") / 8))
    return X.give_back(d, ["series", "band", "block"]).select("series", "band", "block", "n", *r6s("give_back", "mfe", "mae"))


@query("thinness_reversion", sql(f"""SELECT series, thin, halt_free, count(*) AS n, {R('avg(fwd)')} AS mean FROM (SELECT series, CASE WHEN th < 0.8 THEN 0 WHEN th < 1.2 THEN 1 ELSE 2 END AS thin, min(ok) OVER n = 1 AS halt_free, fwd, th FROM (SELECT series, idx, ok, lead(close,4) OVER w - close AS fwd, CASE WHEN count(a) OVER s = 4 AND count(a) OVER l = 24 THEN avg(a) OVER s / nullif(avg(a) OVER l, 0) END AS th FROM
 (SELECT *, abs(close-pc) AS a, (t - lag(t) OVER (PARTITION BY series ORDER BY idx) = 3600000)::INT AS ok FROM moves) WINDOW w AS (PARTITION BY series ORDER BY idx), s AS (PARTITION BY series ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), l AS (PARTITION BY series ORDER BY idx ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
 WINDOW n AS (PARTITION BY series ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)) WHERE th IS NOT NULL AND fwd IS NOT NULL GROUP BY ALL""", "moves"))
def thinness(spark, sf):
    d = X.thinness(_bars(spark, sf), HOUR, 4, 24, 4).filter(F.col("thinness").isNotNull() & F.col("fwd").isNotNull())
    th = F.when(F.col("thinness") < 0.8, 0).when(F.col("thinness") < 1.2, 1).otherwise(2)
    return d.groupBy("series", th.alias("thin"), "halt_free").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("fwd"), "mean"))


# -- label quality --------------------------------------------------------------------------------

def _labels(spark, sf):
    b = _bars(spark, sf)
    return ST._fractal_label(b, 2, "high", "low", "label")


TURN_REC = """tn AS (SELECT series, idx, idx AS pos, CASE WHEN high-close > 2*atr THEN high WHEN close-low > 2*atr THEN low ELSE close END AS px, CASE WHEN high-close > 2*atr THEN 1 WHEN close-low > 2*atr THEN -1 ELSE 0 END AS way, NULL::BIGINT AS pv, NULL::INT AS pw FROM ba14 WHERE idx = 13
 UNION ALL SELECT series, idx, CASE WHEN way = 0 THEN CASE WHEN high-px > 2*atr OR px-low > 2*atr THEN idx ELSE pos END WHEN ext OR turn THEN idx ELSE pos END, CASE WHEN way = 0 THEN CASE WHEN high-px > 2*atr THEN high WHEN px-low > 2*atr THEN low ELSE px END WHEN ext THEN CASE WHEN way > 0 THEN high ELSE low END WHEN turn THEN CASE WHEN way > 0 THEN low ELSE high END ELSE px END,
  CASE WHEN way = 0 THEN CASE WHEN high-px > 2*atr THEN 1 WHEN px-low > 2*atr THEN -1 ELSE 0 END WHEN turn AND NOT ext THEN -way ELSE way END, CASE WHEN way <> 0 AND turn AND NOT ext THEN pos END, CASE WHEN way <> 0 AND turn AND NOT ext THEN -way END
 FROM (SELECT b.series, b.idx, b.high, b.low, b.atr, t.pos, t.px, t.way, CASE WHEN t.way > 0 THEN b.high > t.px ELSE b.low < t.px END AS ext, CASE WHEN t.way > 0 THEN t.px - b.low > 2*b.atr ELSE b.high - t.px > 2*b.atr END AS turn FROM tn t JOIN ba14 b ON b.series=t.series AND b.idx=t.idx+1))"""


@query("reference_turns", sql("SELECT series, pv AS idx, pw AS way FROM tn WHERE pv IS NOT NULL", "ba14", recursive=TURN_REC))
def reference_turns(spark, sf):
    return X.reference_turns(I.with_atr(_bars(spark, sf)), 2.0)


@query("label_latency")
def label_latency(spark, sf):
    t = X.reference_turns(I.with_atr(_bars(spark, sf)), 2.0)
    return X.latency_summary(X.latency(_labels(spark, sf), t, "label")).select("series", "turns", "early", "missed", *r6s("median_lag", "p90_lag"))


@query("label_whipsaw", sql(f"SELECT series, flips, {R('100.0*flips/bars')} AS per_100, {R('undone/flips')} AS undone_share FROM (SELECT series, any_value(bars) AS bars, count(*) AS flips, sum((nx-idx <= 3)::INT) AS undone FROM (SELECT *, lead(idx) OVER (PARTITION BY series ORDER BY idx) AS nx FROM (SELECT *, lag(label) OVER (PARTITION BY series ORDER BY idx) AS p FROM (SELECT *, count(*) OVER (PARTITION BY series) AS bars FROM frac2l) WHERE label <> 0) WHERE label <> p) GROUP BY series)", "frac2l"))
def label_whipsaw(spark, sf):
    return X.whipsaw(_labels(spark, sf), "label").select("series", "flips", *r6s("per_100", "undone_share"))


@query("label_information")
def label_information(spark, sf):
    d = X.information(_labels(spark, sf), "label", 6 * HOUR, HOUR, 50)
    return d.select("series", "n", *r6s("rate", "mean_r", "null_rate", "percentile"))


@query("structure_break_study")
def structure_break_study(spark, sf):
    return X.reversal_within(X.structure_breaks(_bars(spark, sf)))


@query("structure_follow_through")
def follow_through(spark, sf):
    b = I.with_atr(_bars(spark, sf))
    return X.follow_through(b, X.structure_breaks(_bars(spark, sf)), 6 * HOUR, HOUR).select("series", "kind", "n", *r6s("p25", "p75"))


# -- residuals ------------------------------------------------------------------------------------

def _two(spark, sf):
    b = _bars(spark, sf)
    return b.filter(F.col("series") == "click"), b.filter(F.col("series") == "view")


cte("pr", """SELECT *, dev / CASE WHEN count(dev) OVER z = 48 THEN stddev_samp(dev) OVER z END AS zz FROM (SELECT *, (ln(bc) - ln(lag(bc,4) OVER w)) - beta*(ln(ac) - ln(lag(ac,4) OVER w)) AS dev FROM (SELECT *, CASE WHEN count(rb) OVER c = 48 THEN covar_samp(rb, ra) OVER c / var_samp(ra) OVER c END AS beta FROM (
 SELECT *, ln(ac) - ln(lag(ac) OVER w) AS ra, ln(bc) - ln(lag(bc) OVER w) AS rb FROM (SELECT a.t, row_number() OVER (ORDER BY a.t) - 1 AS idx, a.close AS ac, b.close AS bc, a.high AS ah, a.low AS al, b.high AS bh, b.low AS bl FROM bars a JOIN bars b USING (t) WHERE a.series='click' AND b.series='view') WINDOW w AS (ORDER BY idx))
 WINDOW c AS (ORDER BY idx ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING)) WINDOW w AS (ORDER BY idx)) WINDOW z AS (ORDER BY idx ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING)""", "bars")


@query("pair_residual", sql(f"SELECT idx, {R('beta')} AS beta, {R('dev')} AS dev, {R('zz')} AS z FROM pr", "pr"))
def pair_residual(spark, sf):
    a, b = _two(spark, sf)
    return X.pair_residual(a, b, 48, 4, 48).select("idx", *r6s("beta", "dev", "z"))


@query("pair_residual_cells")
def pair_cells(spark, sf):
    a, b = _two(spark, sf)
    return X.pair_cells(X.pair_residual(a, b, 48, 4, 48), [1.0, 1.5], [4, 8]).select("threshold", "k", "n", *r6s("gross", "win", "t"))


@query("venue_residual", sql(f"""SELECT idx, {R('sk')} AS skew, {R('mk')} AS markup, {R('(sk-mk)/sd')} AS z FROM (SELECT *, CASE WHEN count(sk-mk) OVER z = 48 THEN stddev_samp(sk-mk) OVER z END AS sd FROM (SELECT *, CASE WHEN count(sk) OVER m = 24 THEN median(sk) OVER m END AS mk FROM (SELECT idx, 1e4*(ln(ac)-ln(bc)) AS sk FROM pr) WINDOW m AS (ORDER BY idx ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
 WINDOW z AS (ORDER BY idx ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING))""", "pr"))
def venue_residual(spark, sf):
    a, b = _two(spark, sf)
    return X.venue_residual(a, b, HOUR, 24, 48).select("idx", *r6s("skew", "markup", "z"))


@query("venue_matched_permutation")
def venue_permutation(spark, sf):
    a, b = _two(spark, sf)
    f = X.deciles(X.venue_fires(X.venue_residual(a, b, HOUR, 24, 48), 0.5, 1), ["series"], "vol", 4)
    return X.matched_permutation(f, ["series"], ["decile"], 50).select("n", *r6s("observed", "frozen", "percentile"))


@query("hour_matched_permutation")
def hour_permutation(spark, sf):
    o = SQ._outcomes(spark, sf).select("series", "idx", F.col("side").cast("double").alias("sign"), (F.col("r") * F.col("side")).alias("ret"), F.floor(F.hour("entry_time") / 6).alias("block"), F.col("risk").alias("vol"))
    return X.matched_permutation(X.deciles(o, ["series"], "vol", 3), ["series"], ["block", "decile"], 30).select("series", "n", *r6s("observed", "frozen", "percentile"))


@query("day_cluster_t", sql(f"SELECT series, n, {R('m')} AS mean, {R('m/(sqrt(v)/n)')} AS t FROM (SELECT series, any_value(n) AS n, any_value(m) AS m, sum(pow(s-m*c,2)) AS v FROM (SELECT series, xt//86400000 AS d, sum(r) AS s, count(*) AS c FROM res GROUP BY ALL) JOIN (SELECT series, avg(r) AS m, count(*) AS n FROM res GROUP BY series) USING (series) GROUP BY series)", "res"))
def day_cluster_t(spark, sf):
    return X.cluster_t(SQ._outcomes(spark, sf), ["series"], "r", F.to_date("exit_time")).select("series", "n", *r6s("mean", "t"))


@query("day_block_interval")
def day_block(spark, sf):
    return X.day_block_interval(SQ._outcomes(spark, sf), ["series"], "r", F.to_date("exit_time"), 100).select("series", *r6s("low", "high"))


@query("gap_safe_z", sql(f"""SELECT series, idx, {R('s')} AS window_sum, {R('s/sd')} AS z FROM (SELECT *, CASE WHEN count(s) OVER z >= 22 THEN nullif(stddev_samp(s) OVER z, 0) END AS sd FROM (SELECT series, idx, CASE WHEN count(volume) OVER a = 3 AND min(coalesce(ok,0)) OVER b = 1 THEN sum(volume) OVER a END AS s FROM
 (SELECT *, (t - lag(t) OVER (PARTITION BY series ORDER BY idx) = 3600000)::INT AS ok FROM bars) WINDOW a AS (PARTITION BY series ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), b AS (PARTITION BY series ORDER BY idx ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)) WINDOW z AS (PARTITION BY series ORDER BY idx ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))""", "bars"))
def gap_safe_z(spark, sf):
    return X.gap_safe_z(_bars(spark, sf), "volume", 3, 24, HOUR).select("series", "idx", *r6s("window_sum", "z"))


# -- events and clocks ----------------------------------------------------------------------------

EVM = """SELECT series, n, avg_m AS mean, avg_m/sd*sqrt(n) AS t, up FROM (SELECT series, count(*) AS n, avg(mv) AS avg_m, stddev_samp(mv) AS sd, avg((mv > 0)::INT) AS up FROM (SELECT x.series, x.o1 - y.open AS mv FROM (SELECT e.series, e.t0, b.open AS o1 FROM (SELECT s.series, et - 3600000 AS t0, et + 7200000 AS t1 FROM cal, (SELECT DISTINCT series FROM bars) s WHERE impact = 3) e ASOF JOIN bars b ON b.series=e.series AND e.t1 <= b.t WHERE b.t - e.t1 <= 7200000) x
 ASOF JOIN bars y ON y.series=x.series AND x.t0 <= y.t WHERE y.t - x.t0 <= 7200000) GROUP BY series)"""


@query("event_drift", sql(f"SELECT series, n, {Rs('mean', 't', 'up')} FROM ({EVM})", "bars", "cal"))
def event_drift(spark, sf):
    e = tables.calendar(spark, sf).filter("impact = 3")
    m = X.event_moves(e, _bars(spark, sf), {"w": (-60, 120)}, 2 * HOUR)
    return X.describe_moves(m, ["series"]).select("series", "n", *r6s("mean", "t", "up"))


@query("event_date_permutation")
def event_permutation(spark, sf):
    e = tables.calendar(spark, sf).filter("impact = 3 and currency = 'USD'")
    return X.date_permutation(e, _bars(spark, sf), (-60, 120), 20, 2 * HOUR).select("series", "n", *r6s("observed", "null_mean", "percentile"))


@query("friday_cells")
def friday_cells(spark, sf):
    c = tables.calendar(spark, sf)
    d = X.friday_cells(_bars(spark, sf), c.filter("impact = 3 and currency = 'USD'"), c.filter("impact = 2 and currency = 'EUR' and hour(time) < 2"), (0, 240), 480, 2 * HOUR)
    return d.select("series", "first_friday", "release", "n", *r6s("mean", "t", "up"))


@query("window_drift", sql(f"""SELECT series, year, count(*) AS days, {R('avg(win)')} AS window_bp, {R('avg(whole)')} AS day_bp, {R('avg(win - whole*wb/n)')} AS excess_bp FROM (SELECT series, day, min(y) AS year, 1e4*ln(arg_max(close,idx) FILTER (ins)/arg_min(open,idx) FILTER (ins)) AS win, 1e4*ln(arg_max(close,idx)/arg_min(open,idx)) AS whole, count(*) AS n, count(*) FILTER (ins) AS wb FROM
 (SELECT *, (t-5*3600000)//86400000 AS day, year(ts - INTERVAL 5 HOUR) AS y, (t-5*3600000)%86400000//60000 BETWEEN 480 AND 719 AS ins FROM bars) GROUP BY series, day) WHERE wb > 0 GROUP BY series, year""", "bars"))
def window_drift(spark, sf):
    return X.window_drift(_bars(spark, sf), 480, 720).select("series", F.col("year").cast("long"), "days", *r6s("window_bp", "day_bp", "excess_bp"))


_store: dict = {}


def _daily(spark, sf):
    """Daily underlying prices of the tape as bars: a series long enough to hold month ends."""
    from ..operators.bars import bars_from_ticks
    from ..plans.longseries import materialize, with_index
    p = tables.prints(spark, sf).select(F.lit("tape").alias("series"), F.col("timestamp").alias("time"), F.col("underlying_price").alias("price"), F.col("sequence_id").alias("seq"))
    key = (spark.sparkContext.applicationId, sf)
    if key not in _store:
        b = with_index(bars_from_ticks(p, 86_400_000), ["series"], ["time"], F.floor(S.ms("time") / (86_400_000 * 4096)))
        _store[key] = materialize(b, "daily")
    return _store[key]


@query("month_end_slope")
def month_end_slope(spark, sf):
    m = X.month_end(_daily(spark, sf), 0, 1440)
    return X.slope_permutation(m.withColumn("fix_bp", F.coalesce("fix_bp", F.col("mtd") * 100)), ["series"], "mtd", "fix_bp", 50).select("series", "n", *r6s("slope", "percentile"))


@query("month_end_returns")
def month_end_returns(spark, sf):
    return X.month_end(_bars(spark, sf), 840, 1080).select("series", "month", "last", *r6s("fix_bp", "placebo_bp", "mtd"))


# -- controls -------------------------------------------------------------------------------------

@query("direction_null")
def direction_null(spark, sf):
    d = X.direction_null(SQ._outcomes(spark, sf), ["series"], 0.5, 100.0, 50, 0.3)
    return d.select("series", *r6s("pf", "pf_credited", "null_median", "percentile", "percentile_credited"))


def _null(spark, sf, n=10):
    b = _bars(spark, sf)
    return O.first_touch(X.random_entries(b, 0.04, n), I.with_atr(b), SQ.RULES)


@query("random_entry_control")
def random_entry(spark, sf):
    return M.performance(_null(spark, sf), ["cell"]).select("cell", "trades", *r6s("expectancy", "profit_factor"))


@query("random_hold_control")
def random_hold(spark, sf):
    d = X.random_holds(_bars(spark, sf), 0.04, 5, 2.0, 0.5)
    return d.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("hold"), "mean_hold"), F.sum("side").alias("net_side"))


@query("matched_entry_rate", sql(f"SELECT trades, bars, {R('trades/bars')} AS rate FROM (SELECT count(*) AS trades FROM res), (SELECT count(*) AS bars FROM bars)", "res", "bars"))
def matched_rate(spark, sf):
    return X.matched_rate(SQ._outcomes(spark, sf), _bars(spark, sf)).select("trades", "bars", r6("rate"))


@query("hypothesis_report")
def hypothesis_report(spark, sf):
    d = X.hypothesis_report(SQ._outcomes(spark, sf), _null(spark, sf), share=0.3, spread=0.5)
    return d.select("trades", *r6s("profit_factor", "profit_factor_net", "null_trades", "null_pf", "percentile", "percentile_net", "count_ratio"), "count_matched", "passes_gross", "passes_net")


# -- ticks ----------------------------------------------------------------------------------------

cte("rev", """SELECT *, CASE WHEN ma AND mb THEN 'two' WHEN ma OR mb THEN 'one' ELSE 'none' END AS kind, CASE WHEN ma AND mb THEN (da+db)/2 WHEN ma THEN da WHEN mb THEN db ELSE 0 END / 10.0 AS size FROM (SELECT *, abs(db) > 5 AS mb, abs(da) > 5 AS ma FROM (SELECT *, bid - lag(bid) OVER w AS db, ask - lag(ask) OVER w AS da, lag(bid) OVER w AS pb FROM
 (SELECT event_type AS series, ts, event_id, value AS bid, value + 0.01*(1 + user_id % 10) AS ask, epoch_ms(ts) AS t FROM events) WINDOW w AS (PARTITION BY series, date_trunc('day', ts) ORDER BY ts, event_id)) WHERE pb IS NOT NULL)""")


@query("quote_minutes", sql(f"""SELECT m.*, q.bid AS bid_0s, q.ask AS ask_0s FROM (SELECT series, t//600000*600000 AS minute, count(*) AS n_ticks, sum((kind='one')::INT)::BIGINT AS n_one, sum((kind='two')::INT)::BIGINT AS n_two, {R("sum(CASE WHEN kind='two' THEN size ELSE 0 END)")} AS ts_sum, {R('arg_max((bid+ask)/2, ts)')} AS mid_close, {R('max((bid+ask)/2)-min((bid+ask)/2)')} AS mid_range FROM rev GROUP BY ALL) m
 ASOF LEFT JOIN (SELECT event_type AS series, epoch_ms(ts) AS t, value AS bid, {R('value + 0.01*(1 + user_id % 10)')} AS ask FROM events) q ON q.series=m.series AND m.minute + 600000 <= q.t""", "rev"))
def quote_minutes(spark, sf):
    d = X.quote_minutes(tables.quotes(spark, sf), 10.0, (0,), 600_000)
    return d.select("series", S.ms("minute").alias("minute"), "n_ticks", "n_one", "n_two", *r6s("ts_sum", "mid_close", "mid_range"), "bid_0s", r6("ask_0s"))


@query("one_sided_runs")
def one_sided_runs(spark, sf):
    return X.one_sided_runs(tables.quotes(spark, sf).withColumn("ask", F.when(F.col("event_id") % 2 == 0, F.col("ask")).otherwise(F.round("ask", -1))), 10.0)


@query("tick_gaps", sql(f"SELECT series, count(*) AS ticks, sum(coalesce(dt > 7200, false)::INT)::BIGINT AS sessions, {R('quantile_cont(dt, 0.5) FILTER (dt <= 7200)')} AS median_gap, {R('max(dt) FILTER (dt <= 7200)')} AS max_gap FROM (SELECT event_type AS series, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id))/1e6 AS dt FROM events) GROUP BY ALL"))
def tick_gaps(spark, sf):
    return X.tick_gaps(tables.quotes(spark, sf), 120.0).select("series", "ticks", "sessions", *r6s("median_gap", "max_gap"))


@query("spread_quantiles", sql(f"SELECT series, hour, count(*) AS n, {R('list_sort(list(s))[least(count(*)-1, floor(0.5*count(*)))::INT+1]')} AS p50, {R('list_sort(list(s))[least(count(*)-1, floor(0.9*count(*)))::INT+1]')} AS p90 FROM (SELECT event_type AS series, hour(ts) AS hour, round((value + 0.01*(1 + user_id % 10)) - value, 9) AS s FROM events) GROUP BY ALL"))
def spread_quantiles(spark, sf):
    q = tables.quotes(spark, sf).withColumn("hour", F.hour("time"))
    return X.spread_quantiles(q, ["series", "hour"]).select("series", "hour", "n", *r6s("p50", "p90"))
