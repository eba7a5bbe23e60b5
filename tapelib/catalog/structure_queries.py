"""Queries over price structure."""

from pyspark.sql import functions as F

from ..functions import clock, scalars as S
from ..operators import indicators as I, structure as X
from ..sources import tables
from . import bar_queries  # noqa: F401  (registers the bar CTEs)
from .registry import CTES, SQL, R, Rs, cte, query, r6, r6s, sql

cte("wb", """SELECT *, row_number() OVER (PARTITION BY series, win ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY series, win) AS n FROM
 (SELECT series, t, t//864000000 AS win, open, high, low, close, atr FROM ba14)""", "ba14")
PW = "PARTITION BY series, win ORDER BY i"
cte("wsw", f"""SELECT series, win, i AS pos, t AS at_t, i+2 AS confirmed, n, true AS hs, high AS price FROM q WHERE whole AND hb < high AND ha < high
 UNION ALL SELECT series, win, i, t, i+2, n, false, low FROM q WHERE whole AND lb > low AND la > low""".replace("FROM q", f"""FROM (SELECT *, i >= 2 AND i+2 < n AS whole, max(high) OVER b AS hb, max(high) OVER a AS ha, min(low) OVER b AS lb, min(low) OVER a AS la FROM wb
 WINDOW b AS ({PW} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), a AS ({PW} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING))"""), "wb")


def _win(spark, sf):
    return X.report_windows(I.with_atr(tables.bars(spark, sf)), 10)


def L(c, n=None):
    return F.col(c).cast("long").alias(n or c) if isinstance(c, str) else c.cast("long").alias(n)


@query("fair_value_gaps", sql(f"""SELECT series, win, i, direction, band_low, band_high, {R('filled')} AS filled, n-1-i AS age_bars FROM (SELECT *, CASE WHEN direction='BULLISH' THEN coalesce(least(greatest((band_high-deep)/(band_high-band_low),0),1),0) ELSE coalesce(least(greatest((tall-band_low)/(band_high-band_low),0),1),0) END AS filled FROM (
 SELECT *, CASE WHEN ph < nl THEN 'BULLISH' ELSE 'BEARISH' END AS direction, CASE WHEN ph < nl THEN ph ELSE nh END AS band_low, CASE WHEN ph < nl THEN nl ELSE pl END AS band_high FROM (
 SELECT *, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lead(high) OVER w AS nh, lead(low) OVER w AS nl, min(low) OVER f AS deep, max(high) OVER f AS tall FROM wb WINDOW w AS ({PW}), f AS ({PW} ROWS BETWEEN 2 FOLLOWING AND UNBOUNDED FOLLOWING)) WHERE ph < nl OR pl > nh)) WHERE filled < 1""", "wb"))
def fair_value_gaps(spark, sf, windows=_win):
    return X.fair_value_gaps(windows(spark, sf)).select("series", "win", L("i"), "direction", "band_low", "band_high", r6("filled"), L("age_bars"))


@query("order_blocks", sql(f"""SELECT b.series, b.win, b.j AS block_i, b.up, b.band_low, b.band_high, {R('abs(b.body)/b.atr')} AS body_atr, br AS broken_i, tested_i, (SELECT min(x.i) FROM wb x WHERE x.series=b.series AND x.win=b.win AND x.i > br AND x.low <= band_high AND x.high >= band_low) AS breaker_i FROM (
 SELECT b.*, (SELECT min(x.i) FROM wb x WHERE x.series=b.series AND x.win=b.win AND x.i > b.i AND x.i < coalesce(br, 1000000) AND x.low <= band_high AND x.high >= band_low) AS tested_i FROM (
 SELECT b.*, (SELECT min(x.i) FROM wb x WHERE x.series=b.series AND x.win=b.win AND x.i > b.i AND CASE WHEN b.up THEN x.close < band_low ELSE x.close > band_high END) AS br FROM (
 SELECT d.series, d.win, d.i, d.n, d.body, d.atr, d.body > 0 AS up, d.j, c.low AS band_low, c.high AS band_high FROM (SELECT *, close-open AS body, CASE WHEN close > open THEN dj ELSE uj END AS j FROM (SELECT *, max(CASE WHEN close < open THEN i END) OVER p AS dj, max(CASE WHEN close > open THEN i END) OVER p AS uj FROM wb WINDOW p AS ({PW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE atr > 0 AND abs(close-open) > 1.0*atr) d
 JOIN wb c ON c.series=d.series AND c.win=d.win AND c.i=d.j QUALIFY row_number() OVER (PARTITION BY d.series, d.win, d.j ORDER BY d.i) = 1) b) b) b""", "wb"))
def order_blocks(spark, sf, windows=_win):
    d = X.order_blocks(windows(spark, sf), 1.0)
    return d.select("series", "win", L("block_i"), (F.col("direction") == "BULLISH").alias("up"), "band_low", "band_high", r6("body_atr"), L("broken_i"), L("tested_i"), L("breaker_i"))


@query("confirmed_swings", sql("SELECT series, win, pos AS \"at\", confirmed, hs AS high_side, price FROM wsw", "wsw"))
def confirmed_swings(spark, sf, windows=_win):
    return X.confirmed_swings(windows(spark, sf)).select("series", "win", L("at"), L("confirmed"), "high_side", "price")


POOL_REC = """pl AS (SELECT series, win, hs, r, price, confirmed, pos, a, price AS base, 1 AS pool FROM sw WHERE r = 1
 UNION ALL SELECT s.series, s.win, s.hs, s.r, s.price, s.confirmed, s.pos, s.a, CASE WHEN s.price - p.base > coalesce(s.a*0.1, 0) THEN s.price ELSE p.base END, CASE WHEN s.price - p.base > coalesce(s.a*0.1, 0) THEN p.pool + 1 ELSE p.pool END
 FROM pl p JOIN sw s ON s.series=p.series AND s.win=p.win AND s.hs=p.hs AND s.r=p.r+1)"""
cte("sw", """SELECT w.*, coalesce(b.atr, l.la) AS a, row_number() OVER (PARTITION BY w.series, w.win, w.hs ORDER BY w.price, w.pos) AS r FROM wsw w JOIN wb b ON b.series=w.series AND b.win=w.win AND b.i=w.confirmed
 JOIN (SELECT series, win, arg_max(atr, i) FILTER (atr > 0) AS la FROM wb GROUP BY ALL) l ON l.series=w.series AND l.win=w.win""", "wsw", "wb")


@query("liquidity_pools", sql(f"""SELECT p.series, p.win, CASE WHEN p.hs THEN 'EQUAL_HIGHS' ELSE 'EQUAL_LOWS' END AS kind, {Rs('price', 'band_low', 'band_high', 'spread_atr')}, members,
 (SELECT min(x.i) FROM wb x WHERE x.series=p.series AND x.win=p.win AND x.i > p.newest AND CASE WHEN p.hs THEN x.high > p.band_high ELSE x.low < p.band_low END) AS swept_i FROM (
 SELECT series, win, hs, pool, avg(price) AS price, min(price) AS band_low, max(price) AS band_high, count(*) AS members, max(confirmed) AS newest, CASE WHEN count(*) > 1 THEN (max(price)-min(price))/arg_max(a, confirmed) END AS spread_atr FROM pl GROUP BY ALL) p""", "sw", "wb", recursive=POOL_REC))
def liquidity_pools(spark, sf, windows=_win):
    return X.liquidity_pools(windows(spark, sf), "1h").select("series", "win", "kind", *r6s("price", "band_low", "band_high", "spread_atr"), "members", L("swept_i"))


@query("period_extremes", sql("""SELECT p.series, p.win, p.period, p.side, p.price, p.at_t, p.bars, p.last_i = p.n-1 AS forming,
 (SELECT min(x.i) FROM wb x WHERE x.series=p.series AND x.win=p.win AND x.i > p.last_i AND CASE WHEN p.side='HIGH' THEN x.high > p.price ELSE x.low < p.price END) AS swept_i FROM (
 SELECT series, win, (t-5*3600000)//86400000 AS period, 'HIGH' AS side, max(high) AS price, arg_max(t, {'h': high, 'i': i}) AS at_t, count(*) AS bars, max(i) AS last_i, any_value(n) AS n FROM wb GROUP BY ALL
 UNION ALL SELECT series, win, (t-5*3600000)//86400000, 'LOW', min(low), arg_max(t, {'h': -low, 'i': i}), count(*), max(i), any_value(n) FROM wb GROUP BY ALL) p""", "wb"))
def period_extremes(spark, sf, windows=_win):
    d = X.period_extremes(windows(spark, sf), clock.ny_day("time"))
    return d.select("series", "win", L("period"), "side", "price", S.ms("formed_at").alias("at_t"), "bars", (F.col("state") == "FORMING").alias("forming"), L("swept_i"))


@query("activity_profile", sql(f"""SELECT series, win, {Rs('poc', 'bucket_size', 'activity')}, buckets FROM (SELECT series, win, any_value(lo)+arg_min(b, {{'t': -total, 'b': b}})*any_value(size)+any_value(size)/2 AS poc, any_value(size) AS bucket_size, sum(total) AS activity, any_value(buckets) AS buckets FROM (
 SELECT series, win, lo, size, buckets, b, count(*) AS total FROM (SELECT w.series, w.win, lo, size, buckets, unnest(range(least(floor((low-lo)/size), buckets-1)::BIGINT, least(floor((high-lo)/size), buckets-1)::BIGINT+1)) AS b FROM wb w JOIN (
  SELECT *, floor((hi-lo)/size)::BIGINT+1 AS buckets FROM (SELECT series, win, min(low) AS lo, max(high) AS hi, arg_max(atr, i) FILTER (atr IS NOT NULL)/4.0 AS size FROM wb GROUP BY ALL) WHERE size > 0) g USING (series, win)) GROUP BY ALL) GROUP BY series, win)""", "wb"))
def activity_profile(spark, sf, windows=_win):
    return X.activity_profile(windows(spark, sf)).select("series", "win", *r6s("poc", "bucket_size", "activity"), "buckets")


cte("act", """SELECT series, win, lo, size, buckets, b, count(*) AS total, min(i) AS first, any_value(last) AS last FROM (SELECT w.series, w.win, w.i, lo, size, buckets, last, unnest(range(least(floor((low-lo)/size), buckets-1)::BIGINT, least(floor((high-lo)/size), buckets-1)::BIGINT+1)) AS b FROM wb w JOIN (
  SELECT *, floor((hi-lo)/size)::BIGINT+1 AS buckets FROM (SELECT series, win, min(low) AS lo, max(high) AS hi, max(i) AS last, arg_max(atr, i) FILTER (atr IS NOT NULL)/4.0 AS size FROM wb GROUP BY ALL) WHERE size > 0) g USING (series, win)) GROUP BY ALL""", "wb")
cte("actpoc", "SELECT series, win, arg_min(b, {'t': -total, 'b': b}) AS poc, max(total)::DOUBLE AS acc, 0.7*sum(total) AS target, any_value(buckets) AS buckets FROM act GROUP BY series, win", "act")
AREA_REC = """area AS (SELECT series, win, poc AS lo, poc AS hi, acc, target, buckets FROM actpoc
 UNION ALL SELECT r.series, r.win, CASE WHEN up THEN lo ELSE lo-1 END, CASE WHEN up THEN hi+1 ELSE hi END, acc + CASE WHEN up THEN above ELSE below END, target, buckets FROM (
  SELECT r.*, CASE WHEN r.lo > 0 THEN coalesce(x.total, 0) ELSE -1 END AS below, CASE WHEN r.hi < r.buckets-1 THEN coalesce(y.total, 0) ELSE -1 END AS above, above >= below AS up
  FROM area r LEFT JOIN act x ON x.series = r.series AND x.win = r.win AND x.b = r.lo-1 LEFT JOIN act y ON y.series = r.series AND y.win = r.win AND y.b = r.hi+1
  WHERE r.acc < r.target AND (r.lo > 0 OR r.hi < r.buckets-1)) r)"""


@query("activity_value_area", sql(f"""SELECT series, win, {R('a.lo + (r.hi+1)*a.size')} AS vah, {R('a.lo + r.lo*a.size')} AS val, {R('r.acc')} AS activity_in_area, a.last - a.first AS poc_age
 FROM (SELECT * FROM area QUALIFY row_number() OVER (PARTITION BY series, win ORDER BY hi-lo DESC) = 1) r JOIN actpoc p USING (series, win) JOIN act a ON a.series = r.series AND a.win = r.win AND a.b = p.poc""", "wb", "act", "actpoc", recursive=AREA_REC))
def activity_value_area(spark, sf, windows=_win):
    return X.activity_profile(windows(spark, sf)).select("series", "win", *r6s("vah", "val", "activity_in_area"), L("poc_age"))


@query("activity_runs", sql("SELECT series, win, count(*) AS buckets_spanned, sum(total)::DOUBLE AS activity, max(total)::DOUBLE AS most FROM act GROUP BY series, win", "act"))
def activity_runs(spark, sf, windows=_win):
    r = X.activity_runs(windows(spark, sf)).filter("total > 0")
    return r.groupBy("series", "win").agg(F.sum(F.col("stop") - F.col("start")).alias("buckets_spanned"), F.sum(F.col("total") * (F.col("stop") - F.col("start"))).alias("activity"), F.max("total").alias("most"))


STRUCT_REC = """ms AS (
 SELECT series, win, -1::BIGINT AS i, 0 AS label, NULL::BIGINT AS sh, NULL::BIGINT AS sl, NULL::VARCHAR AS kind, NULL::BOOLEAN AS up, NULL::DOUBLE AS price FROM (SELECT DISTINCT series, win FROM wst)
 UNION ALL SELECT series, win, i, CASE WHEN bh THEN CASE WHEN l1 = 0 THEN 0 ELSE 1 END WHEN bl THEN CASE WHEN l1 = 0 THEN 0 ELSE -1 END ELSE l1 END,
  CASE WHEN bh THEN hat ELSE sh END, CASE WHEN bl AND NOT bh THEN lat ELSE sl END,
  CASE WHEN NOT (bh OR bl) THEN NULL WHEN l1 = 0 THEN 'UNCLASSIFIED' WHEN (l1 = 1) = bh THEN 'BOS' ELSE 'CHOCH' END, CASE WHEN bh OR bl THEN bh END, CASE WHEN bh THEN hp WHEN bl THEN lp END
 FROM (SELECT w.*, m.sh, m.sl, CASE WHEN m.label = 0 THEN w.seed ELSE m.label END AS l1, coalesce(w.close > w.hp AND w.hat IS DISTINCT FROM m.sh, false) AS bh, coalesce(w.close < w.lp AND w.lat IS DISTINCT FROM m.sl, false) AS bl
  FROM ms m JOIN wst w ON w.series=m.series AND w.win=m.win AND w.i=m.i+1))"""
cte("wst", f"""SELECT *, CASE WHEN hp > hpp AND lp > lpp THEN 1 WHEN hp < hpp AND lp < lpp THEN -1 ELSE 0 END AS seed FROM (SELECT b.series, b.win, b.i, b.close, last_value(h.price IGNORE NULLS) OVER w AS hp, last_value(h.pos IGNORE NULLS) OVER w AS hat, last_value(h.ps IGNORE NULLS) OVER w AS hpp,
  last_value(l.price IGNORE NULLS) OVER w AS lp, last_value(l.pos IGNORE NULLS) OVER w AS lat, last_value(l.ps IGNORE NULLS) OVER w AS lpp FROM wb b LEFT JOIN (SELECT *, lag(price) OVER (PARTITION BY series, win ORDER BY pos) AS ps FROM wsw WHERE hs) h ON h.series=b.series AND h.win=b.win AND h.confirmed=b.i
  LEFT JOIN (SELECT *, lag(price) OVER (PARTITION BY series, win ORDER BY pos) AS ps FROM wsw WHERE NOT hs) l ON l.series=b.series AND l.win=b.win AND l.confirmed=b.i WINDOW w AS (PARTITION BY b.series, b.win ORDER BY b.i))""", "wb", "wsw")


@query("market_structure", sql("SELECT series, win, i, kind, CASE WHEN up THEN 'BULLISH' ELSE 'BEARISH' END AS direction, price AS broke_price, CASE label WHEN 1 THEN 'UP' WHEN -1 THEN 'DOWN' ELSE 'RANGE' END AS structure_after FROM ms WHERE kind IS NOT NULL", "wst", recursive=STRUCT_REC))
def market_structure(spark, sf, windows=_win):
    return X.market_structure(windows(spark, sf)).select("series", "win", L("i"), "kind", "direction", "broke_price", "structure_after")


@query("dealing_range", sql(f"""SELECT series, win, high, low, {R('(high+low)/2')} AS equilibrium, {R('(close-low)/(high-low)')} AS fraction, hid AS high_swing_id, CASE WHEN (close-low)/(high-low) > 0.5 THEN 'PREMIUM' WHEN (close-low)/(high-low) < 0.5 THEN 'DISCOUNT' ELSE 'EQUILIBRIUM' END AS zone FROM (
 SELECT series, win, arg_max(price, pos) FILTER (hs) AS high, arg_max(price, pos) FILTER (NOT hs) AS low, '1h-hi-' || (arg_max(at_t, pos) FILTER (hs)) AS hid FROM wsw GROUP BY ALL) JOIN (SELECT series, win, arg_max(close, i) AS close FROM wb GROUP BY ALL) USING (series, win) WHERE high > low""", "wsw", "wb"))
def dealing_range(spark, sf, windows=_win):
    return X.dealing_range(windows(spark, sf), "1h").select("series", "win", "high", "low", *r6s("equilibrium", "fraction"), "high_swing_id", "zone")


# the same tables over the last ten trading days; days of hourly bars are counted from the first bar after a weekend
cte("wt", """SELECT * EXCLUDE (wk, slice, day), row_number() OVER (PARTITION BY series, win ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY series, win) AS n FROM (SELECT *, max(day) OVER (PARTITION BY series) AS win FROM (
 SELECT *, dense_rank() OVER (PARTITION BY series ORDER BY wk, slice) - 1 AS day FROM (SELECT *, (t - min(t) OVER (PARTITION BY series, wk))//86400000 AS slice FROM (
  SELECT series, t, open, high, low, close, atr, sum(CASE WHEN t - before > 172800000 THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY t) AS wk FROM (SELECT *, lag(t) OVER (PARTITION BY series ORDER BY t) AS before FROM ba14))))) WHERE day > win - 10""", "ba14")


def _last_days(spark, sf):
    return X.trading_windows(I.with_atr(tables.bars(spark, sf)), 3_600_000, 10)


#: Tables of the report as registered above over windows of ten days, each with its name in the report.
REPORT = {"activity_profile": activity_profile, "activity_value_area": activity_value_area, "fair_value_gaps": fair_value_gaps, "order_blocks": order_blocks,
          "liquidity_pools": liquidity_pools, "period_extremes": period_extremes, "market_structure": market_structure, "dealing_range": dealing_range}


def _register_report():
    for name, fn in REPORT.items():
        statement = SQL[name]
        assert CTES["wb"][1] in statement
        query(f"levels_report_{name}", statement.replace(CTES["wb"][1], CTES["wt"][1]))(lambda spark, sf, fn=fn: fn(spark, sf, _last_days))


_register_report()


cte("td", """SELECT *, dense_rank() OVER (PARTITION BY series ORDER BY wk, slice) - 1 AS day FROM (SELECT *, (t - min(t) OVER (PARTITION BY series, wk))//86400000 AS slice FROM (
 SELECT series, t, high, low, sum(CASE WHEN t - before > 172800000 THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY t) AS wk FROM (SELECT *, lag(t) OVER (PARTITION BY series ORDER BY t) AS before FROM ba14)))""", "ba14")


@query("levels_report_each_day", sql("SELECT d.series, d.day AS win, count(*) AS bars, min(w.low) AS lowest, max(w.high) AS highest, count(DISTINCT w.day) AS days FROM (SELECT DISTINCT series, day FROM td) d JOIN td w ON w.series = d.series AND w.day BETWEEN d.day - 9 AND d.day GROUP BY d.series, d.day", "td"))
def levels_report_each_day(spark, sf):
    """Sliding windows: one as of every trading day, over its last ten."""
    d = X.trading_windows(I.with_atr(tables.bars(spark, sf)), 3_600_000, 10, each=True)
    return d.groupBy("series", "win").agg(F.count(F.lit(1)).alias("bars"), F.min("low").alias("lowest"), F.max("high").alias("highest"), F.countDistinct("day").alias("days"))


@query("levels_report")
def levels_report(spark, sf):
    """Rows of every table of the report; the tables themselves are the queries above."""
    out = None
    for name, d in X.levels_report(I.with_atr(tables.bars(spark, sf)), "1h", 3_600_000).items():
        one = d.groupBy("series", "win").agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


LABELS = ["fractal_1", "fractal_2", "fractal_3", "dow_closes", "zigzag_3", "zigzag_1_5", "ema_21_55", "ema_20_50_200", "adx_25", "adx_20", "donchian_20",
          "donchian_55", "supertrend_3", "supertrend_2", "avwap_day", "avwap_week", "prior_day", "prior_week"]


@query("bias_labels")
def bias_labels(spark, sf):
    return X.bias_labels(tables.bars(spark, sf)).select("series", "idx", *LABELS)


BL = "PARTITION BY series ORDER BY idx"
cte("frac2", f"""SELECT *, coalesce(nb=2 AND na=2 AND high >= hb AND high >= ha AND (high > hlb OR high > hla), false) AS fh, coalesce(nb=2 AND na=2 AND low <= lb AND low <= la AND (low < lhb OR low < lha), false) AS fl FROM (SELECT series, idx, high, low, count(*) OVER b AS nb, count(*) OVER a AS na,
 max(high) OVER b AS hb, max(high) OVER a AS ha, min(high) OVER b AS hlb, min(high) OVER a AS hla, min(low) OVER b AS lb, min(low) OVER a AS la, max(low) OVER b AS lhb, max(low) OVER a AS lha FROM bars WINDOW b AS ({BL} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), a AS ({BL} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING))""", "bars")
cte("frac2l", f"""SELECT series, idx, CASE WHEN hp > hq AND lp > lq THEN 1 WHEN hp < hq AND lp < lq THEN -1 ELSE 0 END AS label FROM (SELECT b.series, b.idx, last_value(h.high IGNORE NULLS) OVER w AS hp, last_value(h.prior IGNORE NULLS) OVER w AS hq, last_value(l.low IGNORE NULLS) OVER w AS lp, last_value(l.prior IGNORE NULLS) OVER w AS lq FROM bars b
 LEFT JOIN (SELECT *, lag(high) OVER ({BL}) AS prior FROM frac2 WHERE fh) h ON h.series=b.series AND h.idx=b.idx-2 LEFT JOIN (SELECT *, lag(low) OVER ({BL}) AS prior FROM frac2 WHERE fl) l ON l.series=b.series AND l.idx=b.idx-2 WINDOW w AS (PARTITION BY b.series ORDER BY b.idx))""", "bars", "frac2")


@query("bias_frame_labels", sql(f"""SELECT b.series, b.idx, f.label AS fractal_2, coalesce(last_value(CASE WHEN high > up THEN 1 WHEN low < dn THEN -1 END IGNORE NULLS) OVER (PARTITION BY b.series ORDER BY b.idx), 0) AS donchian_20,
 CASE WHEN e.y > g.y AND close > e.y THEN 1 WHEN e.y < g.y AND close < e.y THEN -1 ELSE 0 END AS ema_21_55, CASE WHEN a.y >= 25 THEN CASE WHEN plusdi > minusdi THEN 1 ELSE -1 END ELSE 0 END AS adx_25, CASE WHEN mid IS NULL THEN 0 WHEN close > mid THEN 1 WHEN close < mid THEN -1 ELSE 0 END AS prior_day
 FROM (SELECT *, (t+7200000)//86400000 AS day, CASE WHEN idx >= 20 THEN max(high) OVER d END AS up, CASE WHEN idx >= 20 THEN min(low) OVER d END AS dn FROM bars WINDOW d AS ({BL} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) b JOIN frac2l f USING (series, idx) LEFT JOIN ema21 e USING (series, idx) LEFT JOIN ema55 g USING (series, idx)
 LEFT JOIN adx a USING (series, idx) LEFT JOIN di USING (series, idx) JOIN (SELECT series, day, lag(mid) OVER (PARTITION BY series ORDER BY day) AS mid FROM (SELECT series, (t+7200000)//86400000 AS day, (max(high)+min(low))/2 AS mid FROM bars GROUP BY ALL)) m ON m.series=b.series AND m.day=b.day""", "bars", "frac2l", "ema21", "ema55", "adx", "di"))
def bias_frame_labels(spark, sf):
    return X.bias_labels(tables.bars(spark, sf)).select("series", "idx", "fractal_2", "donchian_20", "ema_21_55", "adx_25", "prior_day")


@query("zigzag_structure")
def zigzag_structure(spark, sf):
    return X.zigzag_structure(tables.bars(spark, sf)).select("series", "confirmed_idx", "pivot_idx", r6("price"), "is_high", "mark", r6("break_level"))


@query("trend_facts", sql(f"""SELECT series, {R('e.y')} AS ema_21, {R('a.y')} AS atr_14, {R('(close-e.y)/a.y')} AS distance_atr, {R('x.y')} AS adx FROM (SELECT * FROM bars QUALIFY idx = max(idx) OVER (PARTITION BY series)) LEFT JOIN ema21 e USING (series, idx) LEFT JOIN atr14 a USING (series, idx) LEFT JOIN adx x USING (series, idx)""", "bars", "ema21", "atr14", "adx"))
def trend_facts(spark, sf):
    return X.trend_facts(tables.bars(spark, sf)).select("series", *r6s("ema_21", "atr_14", "distance_atr"), r6("adx_14_adx", "adx"))


@query("day_facts", sql(f"""SELECT series, close, d.h AS prior_day_high, d.l AS prior_day_low, w.h AS prior_week_high, {R('(close-w.l)/(w.h-w.l)')} AS close_fraction_of_week FROM (SELECT series, arg_max(close, t) AS close FROM bars GROUP BY ALL)
 JOIN (SELECT series, max(high) AS h, min(low) AS l FROM bars GROUP BY series, (t+7200000)//86400000 QUALIFY row_number() OVER (PARTITION BY series ORDER BY (t+7200000)//86400000 DESC) = 2) d USING (series)
 JOIN (SELECT series, max(high) AS h, min(low) AS l FROM bars GROUP BY series, ((t+7200000)//86400000+3)//7 QUALIFY row_number() OVER (PARTITION BY series ORDER BY ((t+7200000)//86400000+3)//7 DESC) = 2) w USING (series)""", "bars"))
def day_facts(spark, sf):
    return X.day_facts(tables.bars(spark, sf)).select("series", "close", "prior_day_high", "prior_day_low", "prior_week_high", r6("close_fraction_of_week"))
