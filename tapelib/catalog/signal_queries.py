"""Queries over signals, outcomes and their metrics."""

from pyspark.sql import functions as F

from ..functions import clock, scalars as S
from ..operators import bars as B, indicators as I, joins as J, metrics as M, outcomes as O, signals as G
from ..plans.longseries import blocked, materialize
from ..sources import tables
from . import bar_queries  # noqa: F401
from .registry import R, Rs, cte, query, r6, r6s, sql

HOUR = 3_600_000
RULES = O.Rules(spread=0.5, max_hold_ms=24 * HOUR)

cte("ib", """SELECT b.*, a.atr, e9.y AS ema9, e21.y AS ema21, r14.y AS rsi14, r2.y AS rsi2, ml.y AS macd, ms.y AS macds, sk.k AS k, sk.d AS d, e20.y + 1.5*a10.y AS ku, e20.y AS km, e20.y - 1.5*a10.y AS kl, e18.y AS ema18, e200.y AS ema200,
 CASE WHEN b.idx >= 20 THEN max(b.high) OVER d20 END AS du, CASE WHEN b.idx >= 20 THEN min(b.low) OVER d20 END AS dl, CASE WHEN b.idx >= 19 THEN avg(b.close) OVER b20 END AS bm, CASE WHEN b.idx >= 19 THEN stddev_pop(b.close) OVER b20 END AS bs,
 CASE WHEN b.idx >= 199 THEN avg(b.close) OVER s200 END AS sma200, sum(b.hlc3*b.volume) OVER v / sum(b.volume) OVER v AS vwap, sum(b.volume) OVER v20 AS vs
 FROM bars b LEFT JOIN ba14 a USING (series, idx) LEFT JOIN ema9 e9 USING (series, idx) LEFT JOIN ema21 e21 USING (series, idx) LEFT JOIN rsi14 r14 USING (series, idx) LEFT JOIN rsi2 r2 USING (series, idx) LEFT JOIN macdline ml USING (series, idx)
 LEFT JOIN macdsig ms USING (series, idx) LEFT JOIN stoch_kd sk USING (series, idx) LEFT JOIN ema20 e20 USING (series, idx) LEFT JOIN atr10 a10 USING (series, idx) LEFT JOIN ema18 e18 USING (series, idx) LEFT JOIN ema200 e200 USING (series, idx)
 WINDOW d20 AS (PARTITION BY series ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), b20 AS (PARTITION BY series ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), s200 AS (PARTITION BY series ORDER BY idx ROWS BETWEEN 199 PRECEDING AND CURRENT ROW),
  v AS (PARTITION BY series, b.t//86400000 ORDER BY idx), v20 AS (PARTITION BY series ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
    "bars", "ba14", "ema9", "ema21", "rsi14", "rsi2", "macdline", "macdsig", "stoch_kd", "ema20", "atr10", "ema18", "ema200")
L1 = ["close", "open", "high", "low", "t", "ema9", "ema21", "rsi14", "macd", "macds", "k", "d", "ku", "kl", "atr", "vwap", "volume"]
cte("il", "SELECT *, " + ", ".join(f"lag({c}) OVER w AS p_{c}" for c in L1) + " FROM ib WINDOW w AS (PARTITION BY series ORDER BY idx)", "ib")


def sig_sql(long: str, short: str, warm: int, sl: str = "NULL", ss: str = "NULL", tl: str = "NULL", ts: str = "NULL", rr: float | None = None, src: str = "il", needs=("il",)) -> str:
    if rr is not None:
        tl, ts = f"close + abs(close-({sl}))*{rr}", f"close - abs(close-({ss}))*{rr}"
        long, short = f"({long}) AND abs(close-({sl})) > 0", f"({short}) AND abs(close-({ss})) > 0"
    return sql(f"SELECT series, idx, side, {R('stop')} AS stop, {R('target')} AS target FROM (SELECT series, idx, side, CASE WHEN side=1 THEN {sl} ELSE {ss} END AS stop, CASE WHEN side=1 THEN {tl} ELSE {ts} END AS target FROM "
               f"(SELECT *, CASE WHEN coalesce({long}, false) THEN 1 WHEN coalesce({short}, false) THEN -1 END AS side FROM {src}) WHERE side IS NOT NULL AND idx >= {warm})", *needs)


def strategy(sid: str, statement: str | None = None, companion: bool = False, **params):
    def run(spark, sf):
        b = tables.bars(spark, sf)
        other = None
        if companion:
            other, b = b.filter(F.col("series") == "view").withColumn("series", F.lit("click")), b.filter(F.col("series") == "click")
        d = G.signals(b, [(sid, sid, G.resolve(sid, **params))], other)
        return d.select("series", "idx", "side", r6("stop"), r6("target"))
    query("signal_" + sid.replace("-", "_"), statement)(run)


def a(kk):
    return f"close - {kk}*atr", f"close + {kk}*atr"


strategy("ema-cross", sig_sql("p_ema9 <= p_ema21 AND ema9 > ema21 AND atr IS NOT NULL", "p_ema9 >= p_ema21 AND ema9 < ema21 AND atr IS NOT NULL", 26, *a(1.5)))
strategy("rsi-reversion", sig_sql("p_rsi14 <= 30 AND rsi14 > 30", "p_rsi14 >= 70 AND rsi14 < 70", 42, *a(1.5)))
strategy("donchian-breakout", sig_sql("close > du AND atr IS NOT NULL", "close < dl AND atr IS NOT NULL", 25, *a(2)))
strategy("bb-fade", sig_sql("close < bm-2*bs AND atr IS NOT NULL", "close > bm+2*bs AND atr IS NOT NULL", 25, *a(1.5), "bm", "bm"))
strategy("buy-and-hold", sig_sql("idx = 1", "false", 1))
strategy("keltner-break", sig_sql("close > ku AND p_close <= p_ku", "close < kl AND p_close >= p_kl", 25, "km", "km", rr=1.5))
strategy("macd-cross", sig_sql("macd > macds AND p_macd <= p_macds AND atr > 0", "macd < macds AND p_macd >= p_macds AND atr > 0", 40, *a(1.5), rr=1.5))
strategy("rsi2-pullback", sig_sql("close > sma200 AND rsi2 < 10 AND atr > 0", "close < sma200 AND rsi2 > 90 AND atr > 0", 205, *a(2), rr=1.0))
strategy("squeeze-break", sig_sql("ok AND close > bm+2*bs", "ok AND close < bm-2*bs", 85, "bm", "bm", rr=1.5, needs=("il",), src="(SELECT *, bm > 0 AND idx >= 61 AND lag(wd) OVER (PARTITION BY series ORDER BY idx) <= 1.05 * min(wd) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS ok FROM (SELECT *, 4*bs/bm AS wd FROM il))"))
strategy("stoch-reversal", sig_sql("k > d AND p_k <= p_d AND p_k < 20 AND atr > 0", "k < d AND p_k >= p_d AND p_k > 80 AND atr > 0", 25, *a(1.5), rr=1.5))
strategy("gap-fade", sig_sql("ok AND open - p_close <= 0", "ok AND open - p_close > 0", 19, "open + (open-p_close)", "open + (open-p_close)", "open - (open-p_close)", "open - (open-p_close)", src="(SELECT *, t - p_t >= 2*3600000 AND p_atr > 0 AND abs(open-p_close) >= p_atr AS ok FROM il)"), minGapHours=2.0)
strategy("doji-reversal", sig_sql("ok AND mv <= 0", "ok AND mv > 0", 19, "low - 0.3", "high + 0.3", rr=1.5, src="(SELECT *, p_close - lag(close, 10) OVER (PARTITION BY series ORDER BY idx) AS mv, atr > 0 AND abs(p_close - lag(close, 10) OVER (PARTITION BY series ORDER BY idx)) >= 0.5*atr AND high-low >= 0.5*atr AND abs(close-open) <= 0.2*(high-low) AND NOT coalesce(p_high-p_low >= 0.5*atr AND abs(p_close-p_open) <= 0.2*(p_high-p_low), false) AS ok FROM il)"), bodyMaxPct=0.2, minRangeAtr=0.5, trendAtr=0.5)
strategy("trend-pullback", sig_sql("ema200 > o200 AND close > ema200 AND up3 AND close < ema21", "ema200 < o200 AND close < ema200 AND dn3 AND close > ema21", 225, "mn - 0.3", "mx + 0.3", rr=1.5, src="""(SELECT *, lag(ema200, 20) OVER w AS o200, lag(close,1) OVER w > lag(ema21,1) OVER w AND lag(close,2) OVER w > lag(ema21,2) OVER w AS up3, lag(close,1) OVER w < lag(ema21,1) OVER w AND lag(close,2) OVER w < lag(ema21,2) OVER w AS dn3,
 min(low) OVER f AS mn, max(high) OVER f AS mx FROM il WINDOW w AS (PARTITION BY series ORDER BY idx), f AS (PARTITION BY series ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""), fast=21, runBars=2)
strategy("volume-thrust", sig_sql("ok AND close >= high - (high-low)*0.2", "ok AND close < high - (high-low)*0.2 AND close <= low + (high-low)*0.2", 25, "low - 3", "high + 3", rr=1.5, src="(SELECT *, atr > 0 AND idx >= 21 AND vs > 0 AND volume >= 1.5*vs/20 AND high-low >= 0.5*atr AND NOT coalesce(p_volume >= 1.5*vs/20, false) AS ok FROM il)"), volMult=1.5, minRangeAtr=0.5)
strategy("vwap-fade", sig_sql("atr > 0 AND close <= vwap-0.5*atr AND NOT coalesce(p_close <= p_vwap-0.5*p_atr, false)", "atr > 0 AND close >= vwap+0.5*atr AND NOT coalesce(p_close >= p_vwap+0.5*p_atr, false)", 19, *a(1.0), "vwap", "vwap"), stretchAtr=0.5)
strategy("volman-box", sig_sql("ok AND close > hi AND close > ema18 AND close-hi <= 5*atr", "ok AND close < lo AND close < ema18 AND lo-close <= 5*atr", 28, "lo", "hi", "hi+2*(hi-lo)", "lo-2*(hi-lo)", src="(SELECT *, atr > 0 AND p_atr > 0 AND hi > lo AND hi-lo <= 3*p_atr AS ok FROM (SELECT *, CASE WHEN idx >= 5 THEN max(high) OVER f END AS hi, CASE WHEN idx >= 5 THEN min(low) OVER f END AS lo FROM il WINDOW f AS (PARTITION BY series ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)))".replace("idx >= 5", "idx >= 5")), boxBars=5, maxBoxAtr=3.0, maxBreakAtr=5.0)
strategy("far-stop-break", sig_sql("close > du AND close-dl > 0", "close < dl AND du-close > 0", 25, "dl", "du", rr=1.0))
strategy("rsi-reversal-vol", buyRsi=60.0, sellRsi=40.0)
strategy("companion-unconfirmed", companion=True, moveAtr=0.5)
DAYCOLS = "(t-5*3600000)//86400000 AS day, (t-5*3600000)%86400000//60000 AS mn"
strategy("orb", sig_sql("idx = f AND way = 1 AND ok", "idx = f AND way = -1 AND ok", 19, "rl", "rh", rr=1.5, src=f"""(SELECT *, min(CASE WHEN way IS NOT NULL THEN idx END) OVER (PARTITION BY series, day) AS f, rh-rl >= 0.5 AND NOT coalesce(rh-rl > 3*atr, false) AS ok FROM (SELECT *, CASE WHEN mn >= 720 AND mn < 1200 THEN CASE WHEN close > rh THEN 1 WHEN close < rl THEN -1 END END AS way FROM
 (SELECT *, max(CASE WHEN mn >= 480 AND mn < 720 THEN high END) OVER (PARTITION BY series, day) AS rh, min(CASE WHEN mn >= 480 AND mn < 720 THEN low END) OVER (PARTITION BY series, day) AS rl FROM (SELECT *, {DAYCOLS} FROM il))))"""), rangeStart=800, rangeMinutes=240, entryUntil=2000)
PD = f"""(SELECT *, min(CASE WHEN lvl IS NOT NULL THEN idx END) OVER (PARTITION BY series, day, lvl) AS f FROM (SELECT x.*, r.pdh, r.pdl, CASE WHEN high > pdh AND close < pdh THEN 1 WHEN low < pdl AND close > pdl THEN -1 END AS lvl FROM (SELECT *, {DAYCOLS} FROM il) x JOIN
 (SELECT series, day, lag(h) OVER (PARTITION BY series ORDER BY day) AS pdh, lag(l) OVER (PARTITION BY series ORDER BY day) AS pdl FROM (SELECT series, (t-5*3600000)//86400000 AS day, max(high) AS h, min(low) AS l FROM bars GROUP BY ALL)) r USING (series, day)))"""
strategy("pdhl", sig_sql("idx = f AND lvl = -1 AND NOT coalesce(abs(close-(low-0.3)) > 3*atr, false)", "idx = f AND lvl = 1 AND NOT coalesce(abs(close-(high+0.3)) > 3*atr, false)", 19, "low - 0.3", "high + 0.3", rr=1.5, src=PD, needs=("il", "bars")))
strategy("session-hold", sig_sql("ins AND NOT coalesce(pins, false)", "false", 19, src=f"(SELECT *, lag(ins) OVER (PARTITION BY series ORDER BY idx) AS pins FROM (SELECT *, mn >= 570 AND mn < 960 AS ins FROM (SELECT *, {DAYCOLS} FROM il)))"))
strategy("intraday-momentum", rangeDays=5, firstFrom=800, firstTo=1000)
strategy("tsmom", sig_sql("fst AND close/pc > 1 AND avg_range IS NOT NULL", "fst AND close/pc < 1 AND avg_range IS NOT NULL", 1, "close - 2*avg_range", "close + 2*avg_range", needs=("il", "bars", "dayrange"), src=f"""(SELECT x.*, r.avg_range, mn >= 1080 AND NOT coalesce(pday = day AND pmn >= 1080, false) AS fst, q.c AS pc FROM (SELECT *, lag(day) OVER (PARTITION BY series ORDER BY idx) AS pday, lag(mn) OVER (PARTITION BY series ORDER BY idx) AS pmn, day-5 AS tday FROM (SELECT *, {DAYCOLS} FROM il)) x
 LEFT JOIN dayrange r USING (series, day) ASOF LEFT JOIN (SELECT series, (t-5*3600000)//86400000 AS qday, arg_max(close, t) AS c FROM bars GROUP BY ALL) q ON x.series=q.series AND x.tday >= q.qday)"""), lookbackDays=5, rangeDays=10)
strategy("quiet-swing", lookbackSessions=3, windowSessions=8, rangeDays=5)


@query("signal_sweep_chain")
def sweep_chain(spark, sf):
    return G.sweep_chain(tables.bars(spark, sf), HOUR, htfFactor=4, maxHtfFvgAge=40, htfTolerancePips=3000.0, maxSweepPips=3000.0, minHtfFvgPips=1.0,
                         minBodyAtrRatio=0.2, displacementMult=1.0, liquidityLookback=100)


# -- filters, outcomes ----------------------------------------------------------------------------

CELL = [("donchian-breakout", "donchian-breakout", G.resolve("donchian-breakout"))]


def _bars_atr(spark, sf):
    return I.with_atr(tables.bars(spark, sf))


def _outcomes(spark, sf, rules=RULES, cells=CELL):
    b = tables.bars(spark, sf)
    # an outcome table is small next to the bars and every metric reads it several times
    return materialize(O.first_touch(G.signals(b, cells), I.with_atr(b), rules), "outcomes")


@query("signal_filters", sql("""SELECT series, count(*) AS n FROM il WHERE ((close > du) OR (close < dl)) AND atr IS NOT NULL AND idx >= 25 AND ((t-5*3600000)%86400000//60000) BETWEEN 480 AND 959 AND dayofweek(ts - INTERVAL 5 HOUR) IN (1,2,3,4,5)
 AND NOT EXISTS (SELECT 1 FROM cal WHERE impact >= 3 AND il.t >= et - 1800000 AND il.t < et + 3600000 AND currency IN ('USD','All')) GROUP BY ALL""", "il", "cal"))
def signal_filters(spark, sf):
    b = tables.bars(spark, sf)
    g = J.blackout(b, tables.calendar(spark, sf), 1_800_000, 3_600_000, 3, ["USD"]).select(
        "series", "idx", (clock.in_window(clock.ny_minute(), 480, 960) & clock.weekday_in(0b0111110) & ~F.col("blackout")).alias("allowed"))
    return G.gated(G.signals(b, CELL), g).groupBy("series").agg(F.count(F.lit(1)).alias("n"))


# signal -> first touch, as plain SQL: entry next open, stop before target, timeout after 24 h, 48 bars at most
cte("sig", """SELECT series, idx, side, CASE WHEN side=1 THEN close-2*atr ELSE close+2*atr END AS stop FROM (SELECT *, CASE WHEN close > du THEN 1 WHEN close < dl THEN -1 END AS side FROM il WHERE atr IS NOT NULL AND idx >= 25) WHERE side IS NOT NULL""", "il")
cte("ent", """SELECT *, entry + side*risk*1.8 AS target FROM (SELECT s.series, s.idx, s.side, s.stop, b.open + s.side*0.25 AS entry, b.t AS et, abs(b.open + s.side*0.25 - s.stop) AS risk FROM sig s JOIN bars b ON b.series=s.series AND b.idx=s.idx+1) WHERE risk > 0""", "sig", "bars")
cte("walk", """SELECT e.*, b.idx - e.idx - 1 AS j, b.t, b.open AS o, b.high AS h, b.low AS l, b.close AS c, CASE WHEN side=1 THEN b.low <= stop ELSE b.high >= stop END AS hs, CASE WHEN side=1 THEN b.high >= target ELSE b.low <= target END AS ht, b.t - et > 86400000 AS late,
 max(b.idx) OVER (PARTITION BY e.series, e.idx) - e.idx - 1 AS lastj FROM ent e JOIN bars b ON b.series=e.series AND b.idx BETWEEN e.idx+1 AND e.idx+48""", "ent", "bars")
cte("outc", """SELECT *, (CASE kind WHEN 'STOP' THEN CASE WHEN side=1 THEN least(o, stop) ELSE greatest(o, stop) END WHEN 'TARGET' THEN CASE WHEN side=1 THEN greatest(o, target) ELSE least(o, target) END ELSE c END) - side*0.25 AS exit_price FROM (
 SELECT w.*, CASE WHEN hs THEN 'STOP' WHEN ht THEN 'TARGET' WHEN late THEN 'TIMEOUT' ELSE 'END_OF_DATA' END AS kind, xh, xl FROM walk w JOIN (SELECT series, idx, coalesce(min(j) FILTER (hs OR ht OR late), max(j)) AS x, bool_or(hs OR ht OR late) AS any_ FROM walk GROUP BY ALL) m ON m.series=w.series AND m.idx=w.idx AND m.x=w.j
 LEFT JOIN (SELECT v.series, v.idx, max(v.h) AS xh, min(v.l) AS xl FROM walk v JOIN (SELECT series, idx, coalesce(min(j) FILTER (hs OR ht OR late), max(j)+1) AS x FROM walk GROUP BY ALL) z ON z.series=v.series AND z.idx=v.idx AND v.j < z.x GROUP BY ALL) q ON q.series=w.series AND q.idx=w.idx)""", "walk")
cte("res", """SELECT *, floor(side*(exit_price-entry)/risk*10000+0.5)/10000 AS r, floor(least(0, side*(exit_price-entry), CASE WHEN side=1 THEN xl-entry ELSE entry-xh END)/risk*10000+0.5)/10000 AS mae, floor(greatest(0, side*(exit_price-entry), CASE WHEN side=1 THEN xh-entry ELSE entry-xl END)/risk*10000+0.5)/10000 AS mfe,
 floor(floor(side*(exit_price-entry)/risk*10000+0.5)/10000*100*100+0.5)/100 AS pnl, t AS xt, 100.0/(risk*100) AS lots FROM outc""", "outc")


@query("first_touch_outcomes", sql(f"SELECT series, idx, side, kind AS exit_kind, {Rs('entry', 'exit_price', 'r', 'mae', 'mfe')}, xt AS exit_t FROM res", "res"))
def first_touch(spark, sf):
    return _outcomes(spark, sf).select("series", "idx", "side", "exit_kind", r6("entry_price", "entry"), *r6s("exit_price", "r", "mae", "mfe"), S.ms("exit_time").alias("exit_t"))


@query("first_touch_with_exits")
def first_touch_exits(spark, sf):
    b = tables.bars(spark, sf)
    f = G.signals(b, CELL, flags=True)
    d = O.first_touch(f.filter(F.col("side").isNotNull()), I.with_atr(b), RULES, flags=f)
    return d.groupBy("series", "exit_kind").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("r"), "avg_r"))


MET = ["win_rate", "avg_r", "profit_factor", "total_r", "net_pnl", "avg_mae", "avg_mfe", "max_drawdown", "sharpe"]
cte("eq", "SELECT *, sum(pnl) OVER (PARTITION BY series ORDER BY xt, et, idx) AS e FROM res", "res")
cte("met", """SELECT r.series, count(*) AS trades, avg((pnl > 0)::INT) AS win_rate, floor(avg(r)*10000+0.5)/10000 AS avg_r, floor(sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END)/sum(CASE WHEN pnl > 0 THEN 0 ELSE -pnl END)*10000+0.5)/10000 AS profit_factor,
 floor(sum(r)*10000+0.50001)/10000 AS total_r, floor(sum(pnl)*100+0.50001)/100 AS net_pnl, floor(avg(mae)*10000+0.5)/10000 AS avg_mae, floor(avg(mfe)*10000+0.5)/10000 AS avg_mfe, floor(avg(r)/stddev_samp(r)*sqrt(count(*))*10000+0.5)/10000 AS sharpe, floor(any_value(dd)*100+0.5)/100 AS max_drawdown
 FROM res r JOIN (SELECT series, max(greatest(0, pk)-e) AS dd FROM (SELECT *, max(e) OVER (PARTITION BY series ORDER BY xt, et, idx) AS pk FROM eq) GROUP BY series) q USING (series) GROUP BY r.series""", "res", "eq")


@query("performance_metrics", sql(f"SELECT series, trades, {Rs(*MET)} FROM met", "met"))
def performance(spark, sf):
    return M.performance(_outcomes(spark, sf), ["series"]).select("series", "trades", *r6s(*MET))


@query("profit_factor_of_lines", sql(f"SELECT l_shipmode_, {R('sum(CASE WHEN p > 0 THEN p ELSE 0 END)/sum(CASE WHEN p > 0 THEN 0 ELSE -p END)')} AS profit_factor FROM (SELECT l_returnflag AS l_shipmode_, l_extendedprice*(l_discount-0.05) AS p FROM lineitem) GROUP BY ALL".replace("l_shipmode_", "flag")))
def profit_factor_lines(spark, sf):
    d = tables.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("p"))
    return d.groupBy("flag").agg(r6(M.profit_factor("p"), "profit_factor"))


@query("rebate_credit", sql(f"SELECT series, {R('sum(cr)')} AS credit, {R('avg(cr/100)')} AS mean_fraction_of_r, {R('sum(CASE WHEN p2 > 0 THEN p2 ELSE 0 END)/sum(CASE WHEN p2 > 0 THEN 0 ELSE -p2 END)')} AS pf_credited FROM (SELECT *, pnl+cr AS p2 FROM (SELECT *, 0.3*0.5*lots*100 AS cr FROM res)) GROUP BY ALL", "res"))
def rebate_credit(spark, sf):
    d = M.rebate_credit(_outcomes(spark, sf), 0.3, 0.5, 100.0)
    return M.rebate_totals(d, ["series"], 100.0).select("series", *r6s("credit", "mean_fraction_of_r", "pf_credited"))


@query("cost_sensitivity", sql(f"SELECT series, f AS fraction, {R('sum(CASE WHEN p > 0 THEN p ELSE 0 END)/sum(CASE WHEN p > 0 THEN 0 ELSE -p END)')} AS profit_factor, count(*) AS trades FROM (SELECT *, r + (1-f)*0.5/risk AS p FROM res, (VALUES (0.0),(0.25),(0.5),(1.0),(2.0)) v(f)) GROUP BY ALL".replace("f AS fraction", "f::DOUBLE AS fraction"), "res"))
def cost_sensitivity(spark, sf):
    return M.cost_sensitivity(_outcomes(spark, sf), ["series"], 0.5).select("series", "fraction", r6("profit_factor"), "trades")


@query("volume_economics", sql(f"SELECT series, {R('count(*)/((max(xt)-min(et))/(365.25*86400000.0))')} AS trades_per_year, {R('sum(pnl)/sum(lots)')} AS ex_swap_per_lot, {R('avg(pnl/lots)')} AS fixed_lot_mean FROM res GROUP BY ALL", "res"))
def volume_economics(spark, sf):
    return M.volume_economics(_outcomes(spark, sf), ["series"], -0.1, 0.5, 100.0).select("series", *r6s("trades_per_year", "ex_swap_per_lot", "fixed_lot_mean"))


@query("excluded_trades", sql(f"SELECT series, count(*) FILTER (NOT x) AS counted, count(*) FILTER (x) AS excluded, {R('coalesce(sum(r) FILTER (NOT x), 0)')} AS total_r FROM (SELECT *, idx % 50 < 5 AS x FROM res) GROUP BY ALL", "res"))
def excluded_trades(spark, sf):
    d = _outcomes(spark, sf)
    ex = tables.bars(spark, sf).filter(F.col("idx") % 50 < 5).select("series", "idx")
    kept, out = M.split_excluded(d, ex, ["series", "idx"])
    u = kept.select("series", "r", F.lit(0).alias("x")).unionByName(out.select("series", "r", F.lit(1).alias("x")))
    return u.groupBy("series").agg(F.sum(1 - F.col("x")).alias("counted"), F.sum("x").alias("excluded"), r6(F.coalesce(F.sum(F.when(F.col("x") == 0, F.col("r"))), F.lit(0.0)), "total_r"))


@query("condition_pass_rates", sql("SELECT series, count(*) AS bars, sum((a AND b AND c)::INT)::BIGINT AS passes_all, u.condition, sum(CASE u.condition WHEN 'trend' THEN a WHEN 'oversold' THEN b ELSE c END::INT)::BIGINT AS passes, sum(CASE u.condition WHEN 'trend' THEN b AND c WHEN 'oversold' THEN a AND c ELSE a AND b END::INT)::BIGINT AS passes_others FROM (SELECT series, coalesce(close > ema21, false) AS a, coalesce(rsi14 < 45, false) AS b, coalesce(volume >= 3, false) AS c FROM ib), (VALUES ('trend'),('oversold'),('volume')) u(condition) GROUP BY ALL", "ib"))
def condition_pass_rates(spark, sf):
    d = I.compute(tables.bars(spark, sf), [I.spec("ema"), I.spec("rsi")])
    return M.pass_rates(d, ["series"], {"trend": F.col("close") > F.col("ema_21"), "oversold": F.col("rsi_14") < 45, "volume": F.col("volume") >= 3})


cte("cf", """SELECT series, 'intraday' AS rule, 0.5/(1.2*atr) AS ratio, 1.2*atr AS stop FROM ba14 WHERE atr > 0""", "ba14")


@query("cost_fraction_of_r", sql(f"""SELECT series, rule, count(*) AS n, {R('list_sort(list(round(ratio,9)))[(floor(0.1*(count(*)-1)+0.5)+1)::INT]')} AS p10, {R('list_sort(list(round(ratio,9)))[(floor(0.5*(count(*)-1)+0.5)+1)::INT]')} AS p50, {R('list_sort(list(round(ratio,9)))[(floor(0.9*(count(*)-1)+0.5)+1)::INT]')} AS p90,
 {R('list_sort(list(round(stop,9)))[(floor(0.5*(count(*)-1)+0.5)+1)::INT]')} AS median_stop FROM cf GROUP BY ALL""", "cf"))
def cost_fraction(spark, sf):
    d = M.cost_fractions(tables.bars(spark, sf), 0.5, 1.2, {"intraday": (HOUR, 0)})
    return d.select("series", "rule", "n", *r6s("p10", "p50", "p90", "median_stop"))


@query("cost_fraction_by_era")
def cost_fraction_by_era(spark, sf):
    d = M.cost_fractions(tables.bars(spark, sf), 0.5, 1.2, {"intraday": (HOUR, 0), "4h": (4 * HOUR, 0), "session": (24 * HOUR, 3 * HOUR)},
                         {"early": ("2024-01-01", "2024-01-16"), "late": ("2024-01-16", "2024-02-01")})
    return d.select("series", "rule", "era", "n", *r6s("p10", "p50", "p90", "median_stop"))


@query("month_concentration", sql(f"""SELECT symbol, {R('net')} AS net, CASE WHEN abs(net) >= big THEN CASE WHEN net > 0 THEN top ELSE low END END AS month, {R('CASE WHEN abs(net) >= big THEN 100.0*CASE WHEN net > 0 THEN topv ELSE lowv END/net END')} AS share FROM (SELECT symbol, sum(v) AS net, max(abs(v)) AS big, arg_max(m, v) AS top, max(v) AS topv, arg_min(m, v) AS low, min(v) AS lowv FROM
 (SELECT symbol, strftime(ts, '%Y-%m') AS m, sum(premium_usd*(underlying_price-24.9)/100) AS v FROM prints GROUP BY ALL) GROUP BY symbol)""", "prints"))
def month_concentration(spark, sf):
    from . import tape  # noqa: F401
    p = tables.prints(spark, sf).withColumn("v", F.col("premium_usd") * (F.col("underlying_price") - 24.9) / 100)
    return M.concentration(p, ["symbol"], "v", "timestamp").select("symbol", r6("net"), "month", r6("share"))


# -- sweeps ---------------------------------------------------------------------------------------

def _sweep(spark, sf):
    return _outcomes(spark, sf, cells=G.cells_of("donchian-breakout"))


@query("grid_sweep")
def grid_sweep(spark, sf):
    m = M.leaderboard(M.performance(_sweep(spark, sf), ["cell"]))
    return m.select("cell", "trades", *r6s("expectancy", "profit_factor", "score"), "rank")


SW = """SELECT cell, count(*) AS trades, avg(r) AS ex FROM (SELECT 1)"""


@query("sweep_summary")
def sweep_summary(spark, sf):
    d = M.sweep_summary(M.performance(_sweep(spark, sf), ["series", "cell"]), ["series"])
    return d.select("series", "cells", "usable", *r6s("median_pf", "median_expectancy", "profitable_share"))


@query("strategy_leaderboard")
def strategy_leaderboard(spark, sf):
    ids = ["ema-cross", "rsi-reversion", "donchian-breakout", "bb-fade", "keltner-break", "macd-cross", "stoch-reversal", "volman-box", "far-stop-break"]
    o = _outcomes(spark, sf, cells=[(i, i, G.resolve(i)) for i in ids])
    m = M.gate(M.leaderboard(M.performance(o, ["cell"])))
    return m.select("cell", "trades", *r6s("expectancy", "profit_factor", "score"), "rank", "promising", F.size("reasons").alias("n_reasons"))


@query("walk_forward_folds")
def walk_forward_folds(spark, sf):
    b = tables.bars(spark, sf)
    d = M.folds(_sweep(spark, sf), b, 3)
    return d.select("series", "fold", "cell", "train_trades", r6("train_expectancy"), "test_trades", r6("test_expectancy"))


@query("thinned_signals", sql("""SELECT series, count(*) AS kept FROM th WHERE keep GROUP BY ALL""", "sig",
       recursive="""sr AS MATERIALIZED (SELECT series, idx, row_number() OVER (PARTITION BY series ORDER BY idx) AS n FROM sig), th AS (SELECT series, n, idx, true AS keep, idx + 12 AS free FROM sr WHERE n = 1 UNION ALL SELECT s.series, s.n, s.idx, s.idx > t.free, CASE WHEN s.idx > t.free THEN s.idx + 12 ELSE t.free END FROM th t JOIN sr s ON s.series=t.series AND s.n=t.n+1)"""))
def thinned_signals(spark, sf):
    s = G.signals(tables.bars(spark, sf), CELL).withColumn("until", F.col("idx") + 12)
    return O.thin(s, ["series"], "until").groupBy("series").agg(F.count(F.lit(1)).alias("kept"))


@query("guarded_signals", sql("""SELECT series, count(*) AS kept FROM gd WHERE keep GROUP BY ALL""", "sig", "bars",
       recursive="""sr AS MATERIALIZED (SELECT s.series, s.idx, b.t, b.t//86400000 AS day, row_number() OVER (PARTITION BY s.series ORDER BY s.idx) AS n FROM sig s JOIN bars b USING (series, idx)), gd AS (SELECT series, n, day, 1 AS c, t AS lt, true AS keep FROM sr WHERE n = 1
 UNION ALL SELECT s.series, s.n, s.day, CASE WHEN s.day <> g.day THEN 1 WHEN g.c < 4 AND s.t - g.lt >= 7200000 THEN g.c + 1 ELSE g.c END, CASE WHEN s.day <> g.day OR (g.c < 4 AND s.t - g.lt >= 7200000) THEN s.t ELSE g.lt END, s.day <> g.day OR (g.c < 4 AND s.t - g.lt >= 7200000) FROM gd g JOIN sr s ON s.series=g.series AND s.n=g.n+1)"""))
def guarded_signals(spark, sf):
    s = G.signals(tables.bars(spark, sf), CELL)
    return O.guard(s, ["series"], 4, 7_200_000).groupBy("series").agg(F.count(F.lit(1)).alias("kept"))


# -- entry studies --------------------------------------------------------------------------------

@query("fill_convention", sql(f"SELECT series, count(*) AS n, {R('avg(nclose-close)')} AS close_to_close, {R('avg(nclose-nopen)')} AS open_to_close, {R('avg(nopen-close)')} AS slip FROM (SELECT *, lead(open) OVER (PARTITION BY series ORDER BY idx) AS nopen, lead(close) OVER (PARTITION BY series ORDER BY idx) AS nclose FROM il) WHERE close > du AND nopen IS NOT NULL GROUP BY ALL", "il"))
def fill_convention(spark, sf):
    d = I.compute(tables.bars(spark, sf), [I.spec("donchian")])
    d = blocked(d, ["series"], lambda x, f: x.select("*", f.lead("open").alias("no"), f.lead("close").alias("nc")), ahead=1)
    d = d.filter((F.col("close") > F.col("donchian_20_upper")) & F.col("no").isNotNull())
    return d.groupBy("series").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("nc") - F.col("close")), "close_to_close"),
                                   r6(F.avg(F.col("nc") - F.col("no")), "open_to_close"), r6(F.avg(F.col("no") - F.col("close")), "slip"))


@query("limit_entry", sql(f"""SELECT series, side, k AS atr_offset, wait, count(*) AS n, {R('avg(f::INT)')} AS fill_rate, {R('avg(CASE WHEN f THEN gain END)')} AS mean_gain FROM (SELECT b.series, v.side, o.k, w.wait, v.side*(b.fwd-(b.close - v.side*o.k*b.atr)) AS gain,
 CASE WHEN v.side=1 THEN CASE WHEN w.wait=2 THEN l2 ELSE l4 END <= b.close-o.k*b.atr ELSE CASE WHEN w.wait=2 THEN h2 ELSE h4 END >= b.close+o.k*b.atr END AS f FROM (SELECT *, lead(close, 6) OVER w AS fwd, min(low) OVER a2 AS l2, max(high) OVER a2 AS h2, min(low) OVER a4 AS l4, max(high) OVER a4 AS h4 FROM ba14
  WINDOW w AS (PARTITION BY series ORDER BY idx), a2 AS (PARTITION BY series ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), a4 AS (PARTITION BY series ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)) b, (VALUES (1),(-1)) v(side), (VALUES (0.1),(0.3)) o(k), (VALUES (2),(4)) w(wait) WHERE b.fwd IS NOT NULL AND b.atr IS NOT NULL) GROUP BY ALL""".replace("k AS atr_offset", "k::DOUBLE AS atr_offset"), "ba14"))
def limit_entry(spark, sf):
    """Would a resting order k ATRs away have filled within the wait, and what a filled one gained by bar t + 6."""
    def look(x, f):
        ext = [agg(c).over(f.rows(1, n)).alias(f"{nm}{n}") for n in (2, 4) for nm, agg, c in (("lo", F.min, "low"), ("hi", F.max, "high"))]
        return x.select("*", f.lead("close", 6).alias("fwd"), *ext)
    d = blocked(_bars_atr(spark, sf), ["series"], look, ahead=6).filter(F.col("fwd").isNotNull() & F.col("atr").isNotNull())
    d = J.with_grid(d, {"side": [1, -1], "atr_offset": [0.1, 0.3], "wait": [2, 4]})
    px = F.col("close") - F.col("side") * F.col("atr_offset") * F.col("atr")
    fill = F.when(F.col("side") == 1, F.when(F.col("wait") == 2, F.col("lo2")).otherwise(F.col("lo4")) <= px).otherwise(F.when(F.col("wait") == 2, F.col("hi2")).otherwise(F.col("hi4")) >= px)
    return d.groupBy("series", "side", "atr_offset", "wait").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(fill.cast("double")), "fill_rate"), r6(F.avg(F.when(fill, F.col("side") * (F.col("fwd") - px))), "mean_gain"))


@query("entry_granularity", sql(f"SELECT b.series, b.idx, count(*) AS fine, {R('min(e.value) - any_value(b.open)')} AS best, {R('max(e.value) - any_value(b.open)')} AS worst FROM bars b JOIN events e ON e.event_type=b.series AND date_trunc('hour', e.ts)=b.ts GROUP BY b.series, b.idx", "bars"))
def entry_granularity(spark, sf):
    f = J.fine_in_coarse(tables.ticks(spark, sf), tables.bars(spark, sf).select("series", "time", "open", "idx"), HOUR)
    g = f.groupBy("series", "idx").agg(F.count(F.lit(1)).alias("fine"), F.min("price").alias("mn"), F.max("price").alias("mx"), F.first("open").alias("o"))
    return g.select("series", "idx", "fine", r6(F.col("mn") - F.col("o"), "best"), r6(F.col("mx") - F.col("o"), "worst"))
