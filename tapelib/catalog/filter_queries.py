"""Queries over gates, flat windows, self-managed trades and pairs of instruments."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import filters as X, indicators as I, joins as J, metrics as M, outcomes as O, signals as G, stats
from ..sources import tables
from . import signal_queries as SQ, stat_queries  # noqa: F401  (registers their CTEs)
from .registry import R, Rs, cte, query, r6, r6s, sql

HOUR = 3_600_000

# exit flags of the Donchian cell, New York minutes of a winter month, and what the gates of the queries below allow
cte("fl", """SELECT *, coalesce(close < (du+dl)/2, false) AS xl, coalesce(close > (du+dl)/2, false) AS xs, mn >= 930 AND mn < 1020 AS flat, wd BETWEEN 1 AND 5 AND (mn >= 120 AND mn < 960) AND coalesce(ratio BETWEEN 0.7 AND 1.3, false) AS allowed FROM (
 SELECT series, idx, close, du, dl, (t-5*3600000)%86400000//60000 AS mn, dayofweek(ts - INTERVAL 5 HOUR) AS wd, f.y/s.y AS ratio FROM il LEFT JOIN atr14 f USING (series, idx) LEFT JOIN atr50 s USING (series, idx))""", "il", "atr14", "atr50")


def _exits_sql(entries: str, xl: str, xs: str, *needs: str) -> str:
    """Outcomes of the Donchian cell with exits at the open after a flagged bar, summed by kind."""
    return sql(f"""SELECT series, kind AS exit_kind, count(*) AS n, {R('avg(r)')} AS avg_r FROM (
 SELECT series, kind, floor(side*(px - side*0.25 - entry)/risk*10000+0.5)/10000 AS r FROM (
  SELECT w.*, CASE WHEN hx THEN 'SIGNAL' WHEN hs THEN 'STOP' WHEN ht THEN 'TARGET' WHEN late THEN 'TIMEOUT' ELSE 'END_OF_DATA' END AS kind,
   CASE WHEN hx THEN o WHEN hs THEN CASE WHEN side=1 THEN least(o, stop) ELSE greatest(o, stop) END WHEN ht THEN CASE WHEN side=1 THEN greatest(o, target) ELSE least(o, target) END ELSE c END AS px,
   row_number() OVER (PARTITION BY series, idx ORDER BY (hx OR hs OR ht OR late) DESC, CASE WHEN hx OR hs OR ht OR late THEN j ELSE -j END) AS k
  FROM (SELECT v.*, coalesce(j > 0 AND CASE WHEN v.side=1 THEN {xl} ELSE {xs} END, false) AS hx FROM walk v JOIN {entries} e ON e.series = v.series AND e.idx = v.idx LEFT JOIN fl f ON f.series = v.series AND f.idx = v.idx + v.j) w) WHERE k = 1) GROUP BY ALL""", "walk", "fl", *needs)


@query("first_touch_own_exits", _exits_sql("ent", "f.xl", "f.xs", "ent"))
def own_exits(spark, sf):
    """A strategy's own exits close its trades at the next open, before stop and target are looked at."""
    d = X.trade(I.with_atr(tables.bars(spark, sf)), SQ.CELL, SQ.RULES)
    return d.groupBy("series", "exit_kind").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("r"), "avg_r"))


cte("entf", "SELECT e.* FROM ent e JOIN fl USING (series, idx) WHERE allowed AND NOT flat", "ent", "fl")


@query("flat_window_outcomes", _exits_sql("entf", "(f.xl OR f.flat)", "(f.xs OR f.flat)", "entf"))
def flat_window(spark, sf):
    """Gates on hours, weekdays and volatility, and a flat window before the New York close: no entry in it, and nothing held."""
    b = I.with_atr(tables.bars(spark, sf))
    gates = [X.hours(200, 1600), X.weekdays(0b0111110), X.volatility_regime(14, 50, 0.7, 1.3)]
    d = X.trade(b, SQ.CELL, SQ.RULES, X.gate_table(b, gates, flat=[(1530, 1700)]))
    return d.groupBy("series", "exit_kind").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("r"), "avg_r"))


cte("calw", "SELECT epoch_us(ets)//1000 - 1800000 AS a, epoch_us(ets)//1000 + 3600000 AS z FROM cal WHERE impact >= 2", "cal")
cte("calu", "SELECT min(a) AS a, max(z) AS z FROM (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (ORDER BY a, z) AS run FROM (SELECT *, max(z) OVER (ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM calw)) GROUP BY run", "calw")


def _event_windows(spark, sf):
    e = tables.calendar(spark, sf).filter("impact >= 2")
    return e.select(F.lit("all").alias("calendar"), S.from_ms(S.ms("time") - 1_800_000).alias("start"), S.from_ms(S.ms("time") + 3_600_000).alias("stop"))


@query("event_window_union", sql("SELECT 'all' AS calendar, a AS start_t, z AS stop_t FROM calu", "calu"))
def event_window_union(spark, sf):
    return J.union_intervals(_event_windows(spark, sf), ["calendar"], "start", "stop").select("calendar", S.ms("start").alias("start_t"), S.ms("stop").alias("stop_t"))


@query("event_flat_bars", sql("SELECT series, count(*) AS bars, sum((EXISTS (SELECT 1 FROM calw w WHERE b.t >= w.a AND b.t < w.z))::INT)::BIGINT AS flat FROM bars b GROUP BY series", "bars", "calw"))
def event_flat_bars(spark, sf):
    b = tables.bars(spark, sf).withColumn("calendar", F.lit("all"))
    d = J.inside(b, J.union_intervals(_event_windows(spark, sf), ["calendar"], "start", "stop"), ["calendar"], "flat")
    return d.groupBy("series").agg(F.count(F.lit(1)).alias("bars"), F.sum(F.col("flat").cast("long")).alias("flat"))


# -- trades that manage themselves ----------------------------------------------------------------

@query("buy_and_hold_outcome", sql(f"""SELECT b.series, b.idx, 'END_OF_DATA' AS exit_kind, {R('floor((l.close - 0.25 - e.open - 0.25)/(1.2*a.atr)*10000+0.5)/10000')} AS r, l.idx - b.idx AS held FROM bars b JOIN bars e ON e.series = b.series AND e.idx = b.idx + 1 JOIN ba14 a ON a.series = b.series AND a.idx = 20
 JOIN (SELECT series, max(idx) AS idx, arg_max(close, idx) AS close FROM bars GROUP BY series) l ON l.series = b.series WHERE b.idx = 20""", "bars", "ba14"))
def buy_and_hold(spark, sf):
    """A trade without stop, target or clock runs to the last bar; the distance to its stop is only its unit of risk."""
    b = I.with_atr(tables.bars(spark, sf))
    null = F.lit(None).cast("double")
    s = b.filter("idx = 20").select("series", "idx", F.lit("hold").alias("cell"), F.lit(1).alias("side"), null.alias("stop"), null.alias("target"), F.lit(True).alias("self_managed"))
    return O.first_touch(s, b, SQ.RULES).select("series", "idx", "exit_kind", r6("r"), "held")


def every_cell():
    """One cell of each strategy that reads its own bars only, with its default parameters."""
    return [(sid, sid, G.resolve(sid)) for sid, s in sorted(G.REGISTRY.items()) if not s.frames and sid != "companion-unconfirmed"]


@query("whole_registry_leaderboard")
def whole_registry(spark, sf):
    """All strategies at once, each with its own kind of exits."""
    o = O.materialize(X.trade(I.with_atr(tables.bars(spark, sf)), every_cell(), SQ.RULES, own_exits=False), "outcomes")
    m = M.gate(M.leaderboard(M.performance(o, ["cell"])))
    return m.select("cell", "trades", *r6s("expectancy", "profit_factor", "score"), "rank", "promising")


# -- pairs of instruments -------------------------------------------------------------------------

def _windows(rows: str, name: str) -> str:
    return f"(PARTITION BY pair ORDER BY idx ROWS BETWEEN {rows}) AS {name}"


PW = "PARTITION BY pair ORDER BY idx"
cte("pt", "SELECT a.series || '/' || b.series AS pair, a.t, row_number() OVER (PARTITION BY a.series, b.series ORDER BY a.t) - 1 AS idx, a.open AS ao, a.close AS ac, b.open AS bo, b.close AS bc FROM bars a JOIN bars b ON a.t = b.t AND a.series < b.series", "bars")
cte("prs", f"""SELECT *, dev / CASE WHEN count(dev) OVER z = 48 THEN stddev_samp(dev) OVER z END AS zz FROM (SELECT *, (ln(bc) - ln(lag(bc,4) OVER w)) - beta*(ln(ac) - ln(lag(ac,4) OVER w)) AS dev FROM (SELECT *, CASE WHEN count(rb) OVER c = 48 THEN covar_samp(rb, ra) OVER c / var_samp(ra) OVER c END AS beta FROM (
 SELECT *, ln(ac) - ln(lag(ac) OVER w) AS ra, ln(bc) - ln(lag(bc) OVER w) AS rb FROM pt WINDOW w AS ({PW})) WINDOW c AS ({PW} ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING)) WINDOW w AS ({PW})) WINDOW z AS ({PW} ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING)""", "pt")


def _skews(source: str) -> str:
    return f"""SELECT *, (sk-mk)/sd AS z FROM (SELECT *, CASE WHEN count(sk-mk) OVER z = 48 THEN stddev_samp(sk-mk) OVER z END AS sd FROM (SELECT *, CASE WHEN count(sk) OVER m = 24 THEN median(sk) OVER m END AS mk FROM (SELECT pair, idx, 1e4*(ln(ac)-ln(bc)) AS sk FROM {source})
 WINDOW m AS ({PW} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)) WINDOW z AS ({PW} ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING))"""


cte("skews", _skews("pt"), "pt")
cte("late", "SELECT * EXCLUDE (close), lag(close) OVER (PARTITION BY series ORDER BY idx) AS close FROM bars", "bars")
cte("ptl", "SELECT a.series || '/' || b.series AS pair, row_number() OVER (PARTITION BY a.series, b.series ORDER BY a.t) - 1 AS idx, a.close AS ac, b.close AS bc FROM bars a JOIN late b ON a.t = b.t AND a.series < b.series WHERE b.close IS NOT NULL", "bars", "late")
cte("skewl", _skews("ptl"), "ptl")


def _pairs(spark, sf):
    b = tables.bars(spark, sf)
    return b, J.all_pairs(b)


@query("pair_table", sql("SELECT pair, t, ao AS a_open, ac AS a_close, bo AS b_open, bc AS b_close FROM pt", "pt"))
def pair_table(spark, sf):
    """All ten pairs of the five series in one join."""
    return J.pair_table(*_pairs(spark, sf)).select(F.col("series").alias("pair"), S.ms("time").alias("t"), "a_open", "a_close", "b_open", "b_close")


@query("pair_table_residual", sql(f"SELECT pair, idx, {R('beta')} AS beta, {R('dev')} AS dev, {R('zz')} AS z FROM prs", "prs"))
def pair_table_residual(spark, sf):
    return stats.pair_residuals(J.pair_table(*_pairs(spark, sf)), 48, 4, 48).select(F.col("series").alias("pair"), "idx", *r6s("beta", "dev", "z"))


@query("venue_table_residual", sql(f"SELECT pair, idx, {R('sk')} AS skew, {R('mk')} AS markup, {R('z')} AS z FROM skews", "skews"))
def venue_table_residual(spark, sf):
    return stats.venue_residuals(J.pair_table(*_pairs(spark, sf)), HOUR, 24, 48).select(F.col("series").alias("pair"), "idx", *r6s("skew", "markup", "z"))


@query("venue_stale_control", sql(f"SELECT pair, idx, {R('sk')} AS skew, {R('mk')} AS markup, {R('z')} AS z FROM skewl", "skewl"))
def venue_stale_control(spark, sf):
    """The same residuals with the second leg one bar late: what a slow quote alone would show."""
    b, pairs = _pairs(spark, sf)
    both = J.pair_table(b.unionByName(J.stale(b).withColumn("series", F.concat("series", F.lit("~")))), pairs.withColumn("b", F.concat("b", F.lit("~"))))
    return stats.venue_residuals(both, HOUR, 24, 48).select(F.col("series").alias("pair"), "idx", *r6s("skew", "markup", "z"))
