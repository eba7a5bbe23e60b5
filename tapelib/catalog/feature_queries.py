"""Queries over the timeline, the feature table and the model."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import features as X, flow, levels, model as ML, signals as G, timeline as T
from ..operators.flow import BigPrints
from ..operators.levels import Settings
from ..plans.longseries import materialize
from ..sources import tables
from . import stat_queries, tape
from .registry import R, Rs, cte, query, r6, r6s, sql

DAY = 86_400_000
STEP = 28 * DAY
SET = Settings(big=BigPrints(min_premium=95_000.0), cluster_floor=0.05, velocity_ms=7 * DAY)
_cache: dict = {}


def _frames(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _cache:
        _cache[key] = materialize(T.timeline(tables.stored_prints(spark, sf), STEP, SET, 7 * DAY, 30 * DAY, 7 * DAY), "frames")
    return _cache[key]


cte("stp", f"SELECT * FROM (SELECT *, ceil((t - min(t) OVER ())/{STEP}.0)::BIGINT AS step, (max(t) OVER () - min(t) OVER ())//{STEP} AS laststep FROM prints) WHERE step <= laststep", "prints")
cte("clk", "SELECT step, max(ts) AS as_of, max(t) AS at_ms FROM stp GROUP BY step", "stp")
cte("sflow", f"""SELECT c.step, p.symbol, count(*) AS trades, sum(CASE WHEN flow_class IN ('LC','SP') THEN premium_usd ELSE 0 END) AS bull, sum(CASE WHEN flow_class IN ('LP','SC') THEN premium_usd ELSE 0 END) AS bear,
 sum((strike+trade_price)*premium_usd) FILTER (option_type='CALL')/sum(premium_usd) FILTER (option_type='CALL') AS call_be, sum((strike-trade_price)*premium_usd) FILTER (option_type='PUT')/sum(premium_usd) FILTER (option_type='PUT') AS put_be FROM clk c JOIN stp p ON p.step <= c.step GROUP BY ALL""", "clk", "stp")
cte("sboard", "SELECT c.step, p.symbol, strike, sum(CASE WHEN option_type='CALL' THEN contracts ELSE 0 END) AS c, sum(CASE WHEN option_type='PUT' THEN contracts ELSE 0 END) AS p FROM clk c JOIN stp p ON p.step <= c.step GROUP BY ALL", "clk", "stp")
cte("spain", "SELECT step, symbol, arg_min(strike, {'p': round(pay,6), 's': strike}) AS max_pain FROM (SELECT a.step, a.symbol, a.strike, sum(greatest(a.strike-b.strike,0)*b.c*100 + greatest(b.strike-a.strike,0)*b.p*100) AS pay FROM sboard a JOIN sboard b USING (step, symbol) GROUP BY ALL) GROUP BY ALL", "sboard")


@query("timeline_contexts", sql(f"SELECT step, symbol, trades, {R('CASE WHEN bull+bear > 0 THEN bull/(bull+bear) ELSE 0.5 END')} AS bull_ratio, {Rs('call_be', 'put_be')}, max_pain FROM sflow JOIN spain USING (step, symbol)", "sflow", "spain"))
def timeline_contexts(spark, sf):
    d = T.step_contexts(tables.stored_prints(spark, sf), STEP, SET)
    return d.select("step", "symbol", F.col("trades").cast("long").alias("trades"), *r6s("bull_ratio", "call_be", "put_be"), "max_pain")


@query("timeline_thresholds", sql(f"SELECT step, symbol, {R('quantile_cont(premium_usd, 0.95)')} AS threshold FROM (SELECT e.step, e.symbol, p.premium_usd, p.i, e.n FROM (SELECT step, symbol, max(i) AS n FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, sequence_id) AS i FROM stp) GROUP BY ALL) e JOIN (SELECT symbol, premium_usd, row_number() OVER (PARTITION BY symbol ORDER BY ts, sequence_id) AS i FROM stp) p ON p.symbol=e.symbol AND p.i <= e.n AND p.i > e.n - 2000) GROUP BY ALL", "stp"))
def timeline_thresholds(spark, sf):
    return T.step_thresholds(T.with_steps(tables.stored_prints(spark, sf), STEP), T.SYM, SET.big).select("step", "symbol", r6("threshold"))


@query("timeline_frames", sql(f"""SELECT c.at_ms AS t, {R('(SELECT CASE WHEN sum(bull)+sum(bear) > 0 THEN sum(bull)/(sum(bull)+sum(bear)) ELSE 0.5 END FROM sflow f WHERE f.step=c.step)')} AS bull_ratio, (SELECT count(*) FROM sflow f WHERE f.step=c.step) AS n_contexts,
 {R("(SELECT sum(CASE WHEN flow_class IN ('LC','SP') THEN premium_usd ELSE 0 END)/nullif(sum(CASE WHEN flow_class <> 'UNKNOWN' THEN premium_usd ELSE 0 END),0) FROM prints p WHERE p.t BETWEEN c.at_ms - 7*86400000 AND c.at_ms)")} AS bull_ratio_15m FROM clk c""", "clk", "sflow", "prints"))
def timeline_frames(spark, sf):
    return _frames(spark, sf).select(S.ms("t").alias("t"), r6("bull_ratio"), F.size("contexts").cast("long").alias("n_contexts"), r6("bull_ratio_15m"))


HALF = DAY // 2
cte("half", f"SELECT *, ceil((t - min(t) OVER ())/{HALF}.0)::BIGINT AS step, (max(t) OVER () - min(t) OVER ())//{HALF} AS laststep FROM prints", "prints")


@query("timeline_clock", sql("SELECT g.step, p.t AS as_of, p.spot FROM (SELECT unnest(range(0, max(laststep)::BIGINT + 1)) AS step FROM half) g ASOF JOIN (SELECT step, max(t) AS t, arg_min(underlying_price, {'t': -t, 's': sequence_id}) AS spot FROM half GROUP BY step) p ON p.step <= g.step", "half"))
def timeline_clock(spark, sf):
    """Half-day steps over daily prints: every second step has none and repeats the one before."""
    return T.step_clock(T.with_steps(tables.stored_prints(spark, sf), HALF)).select("step", S.ms("as_of").alias("as_of"), "spot")


cte("sthr", "SELECT step, symbol, least(quantile_cont(premium_usd, 0.95), 95000.0) AS eff FROM (SELECT e.step, e.symbol, p.premium_usd FROM (SELECT step, symbol, max(i) AS n FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, sequence_id) AS i FROM stp) GROUP BY ALL) e JOIN (SELECT symbol, premium_usd, row_number() OVER (PARTITION BY symbol ORDER BY ts, sequence_id) AS i FROM stp) p ON p.symbol=e.symbol AND p.i <= e.n AND p.i > e.n - 2000) GROUP BY ALL", "stp")
cte("sgrid", "SELECT c.step, t.symbol, c.spot, t.eff FROM (SELECT DISTINCT symbol FROM sthr) s JOIN (SELECT step, arg_min(underlying_price, {'t': -t, 's': sequence_id}) AS spot FROM stp GROUP BY step) c ON true ASOF JOIN sthr t ON t.symbol = s.symbol AND t.step <= c.step", "sthr", "stp")
cte("swhale", """SELECT step, symbol, arg_max(strike, {'v': round(put_net, 6), 'o': seen}) FILTER (strike <= spot AND put_net > 0) AS w_sup, arg_max(strike, {'v': round(call_net, 6), 'o': seen}) FILTER (strike >= spot AND call_net > 0) AS w_res FROM (
 SELECT g.step, g.symbol, g.spot, p.strike, sum(CASE WHEN option_type='CALL' THEN q ELSE 0 END) AS call_net, sum(CASE WHEN option_type='CALL' THEN 0 ELSE q END) AS put_net, max({'t': p.t, 's': sequence_id}) AS seen
 FROM sgrid g JOIN (SELECT *, contracts * CASE aggressor_side WHEN 'BUY' THEN 1 WHEN 'SELL' THEN -1 ELSE 0 END AS q FROM stp) p ON p.symbol = g.symbol AND p.step <= g.step AND p.premium_usd >= g.eff GROUP BY ALL) GROUP BY ALL""", "sgrid", "stp")


@query("timeline_whales", sql("SELECT step, symbol, last_value(w_sup IGNORE NULLS) OVER w AS w_sup, last_value(w_res IGNORE NULLS) OVER w AS w_res FROM sgrid LEFT JOIN swhale USING (step, symbol) WINDOW w AS (PARTITION BY symbol ORDER BY step)", "sgrid", "swhale"))
def timeline_whales(spark, sf):
    d = materialize(T.with_steps(tables.stored_prints(spark, sf), STEP), "steps")
    return T.whale_steps(d, T.step_clock(d), SET.big).select("step", "symbol", "w_sup", "w_res")


@query("timeline_imbalance", sql(f"""SELECT c.step, {R("coalesce((sum(p.premium_usd) FILTER (p.flow_class IN ('LC','SP')) - coalesce(sum(p.premium_usd) FILTER (p.flow_class IN ('LP','SC')), 0)) / (sum(p.premium_usd) FILTER (p.flow_class <> 'UNKNOWN')), 0)")} AS big_imbalance FROM (
 SELECT c.step, c.at_ms, (SELECT quantile_cont(premium_usd, 0.95) FROM (SELECT premium_usd FROM stp p WHERE p.step <= c.step ORDER BY ts DESC, sequence_id DESC LIMIT 2000)) AS threshold FROM clk c) c
 JOIN stp p ON p.t BETWEEN c.at_ms - 7*86400000 AND c.at_ms AND p.step <= c.step AND (p.premium_usd >= 95000 OR p.premium_usd >= c.threshold) GROUP BY c.step""", "clk", "stp"))
def timeline_imbalance(spark, sf):
    """The premium of all large prints of the week before each step, not only of the newest ones."""
    d = materialize(T.with_steps(tables.stored_prints(spark, sf), STEP), "steps")
    return T.big_imbalance(d, T.step_clock(d), SET.big, 7 * DAY).select("step", r6("big_imbalance"))


@query("timeline_clusters")
def timeline_clusters(spark, sf):
    d = _frames(spark, sf)
    return d.select(S.ms("t").alias("t"), F.posexplode("clusters").alias("pos", "c")).select("t", "pos", r6(F.col("c.low"), "low"), r6(F.col("c.high"), "high"), r6(F.col("c.score"), "score"))


def _dataset(spark, sf):
    b = stat_queries._daily(spark, sf)
    return X.dataset(_frames(spark, sf), b, 7 * DAY, 56 * DAY, {"short": 7 * DAY, "long": 28 * DAY}, 7 * DAY, 14, 7 * DAY, 28 * DAY, 28 * DAY, series="tape")


@query("feature_dataset")
def feature_dataset(spark, sf):
    d = _dataset(spark, sf)
    return d.select(S.ms("t").alias("t"), *[r6(c) for c in d.columns if c.startswith("x_") or c.startswith("fwd_")])


@query("close_atr", sql(f"""SELECT t, {R('CASE WHEN pc IS NOT NULL AND s + greatest(h-l, abs(h-pc), abs(l-pc)) > 0 THEN (s + greatest(h-l, abs(h-pc), abs(l-pc)))/(n+1) END')} AS atr FROM (SELECT d.*, w.pc, w.s, w.n FROM (SELECT t, t//{7*DAY} AS wk, max(c) OVER r AS h, min(c) OVER r AS l FROM (SELECT t, arg_max(underlying_price, sequence_id) AS c FROM prints GROUP BY t) WINDOW r AS (PARTITION BY t//{7*DAY} ORDER BY t)) d
 JOIN (SELECT wk, pc, coalesce(sum(tr) OVER f, 0) AS s, count(tr) OVER f AS n FROM (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(h-l, abs(h-pc), abs(l-pc)) END AS tr FROM (SELECT *, lag(c) OVER (ORDER BY wk) AS pc FROM (SELECT t//{7*DAY} AS wk, max(c) AS h, min(c) AS l, arg_max(c, t) AS c FROM (SELECT t, arg_max(underlying_price, sequence_id) AS c FROM prints GROUP BY t) GROUP BY ALL))) WINDOW f AS (ORDER BY wk ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING)) w USING (wk))""", "prints"))
def close_atr(spark, sf):
    return X.close_atr(stat_queries._daily(spark, sf), 7 * DAY, 14).select(S.ms("time").alias("t"), r6("atr"))


COLS = [f"x_{c}" for c in X.FEATURES]


@query("labelled_rows")
def labelled_rows(spark, sf):
    return X.labelled(_dataset(spark, sf), "short", 0.2).groupBy("label").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("x_bull_ratio"), "mean_bull_ratio"))


@query("model_walk_forward")
def model_walk_forward(spark, sf):
    d = ML.walk_forward(X.labelled(_dataset(spark, sf), "short", 0.2).select("t", "label", *COLS), COLS, "t", 3, tie=COLS)
    return ML.evaluate(d, ["fold"]).select("fold", "n", *r6s("log_loss", "accuracy", "baseline", "auc"))


@query("model_factors")
def model_factors(spark, sf):
    d = materialize(X.labelled(_dataset(spark, sf), "short", 0.2).select("t", "label", *COLS), "train")
    scale, m = ML.fit(d, COLS)
    return ML.top_factors(spark, COLS, m, 8).select("feature", r6("weight"))


def _scored(spark, sf):
    return tables.table(spark, sf, "lineitem").select((F.col("l_returnflag") == "A").cast("int").alias("label"), S.sigmoid((F.col("l_quantity") - 25.0) / 10.0).alias("p"))


@query("model_metrics", sql(f"""WITH s AS (SELECT (l_returnflag='A')::INT AS y, 1.0/(1.0+exp(-((l_quantity-25.0)/10.0))) AS p FROM lineitem), r AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1)/2.0 AS rk FROM s)
SELECT count(*) AS n, {R('avg(CASE WHEN y=1 THEN -ln(p) ELSE -ln(1-p) END)')} AS log_loss, {R('avg(((p >= 0.5)::INT = y)::INT)')} AS accuracy, {R('greatest(sum(y), count(*)-sum(y))/count(*)')} AS baseline, {R('(sum(rk*y) - sum(y)*(sum(y)+1)/2.0)/(sum(y)*(count(*)-sum(y)))')} AS auc FROM r"""))
def model_metrics(spark, sf):
    return ML.evaluate(_scored(spark, sf)).select("n", *r6s("log_loss", "accuracy", "baseline", "auc"))


@query("model_calibration", sql(f"SELECT b.bin, coalesce(n, 0) AS n, {R('predicted')} AS predicted, {R('actual')} AS actual FROM (SELECT unnest(range(10))::INT AS bin) b LEFT JOIN (SELECT least(floor(p*10), 9)::INT AS bin, count(*) AS n, avg(p) AS predicted, avg(y) AS actual FROM (SELECT (l_returnflag='A')::INT AS y, 1.0/(1.0+exp(-((l_quantity-25.0)/10.0))) AS p FROM lineitem) GROUP BY ALL) c USING (bin)"))
def model_calibration(spark, sf):
    return ML.calibration(_scored(spark, sf)).select("bin", "n", *r6s("predicted", "actual"))


@query("standardized_columns", sql(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {R('(l_quantity - avg(l_quantity) OVER ())/stddev_samp(l_quantity) OVER ()')} AS l_quantity FROM lineitem"))
def standardized(spark, sf):
    d = tables.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return ML.standardize(d, ML.fit_standardizer(d, ["l_quantity"])).withColumn("l_quantity", r6("l_quantity"))


# -- rules over frames ----------------------------------------------------------------------------

def _option_signal(sid, **params):
    def run(spark, sf):
        """Frames are compressed onto the bars' month so that both cover the same span."""
        f = _frames(spark, sf)
        span = f.agg(F.min(S.ms("t")).alias("a"), F.max(S.ms("t")).alias("z"))
        b = tables.bars(spark, sf).withColumn("market", F.lit("main"))  # the market of the mapped tape: all series are priced on it
        lim = b.agg(F.min(S.ms("time")).alias("ba"), F.max(S.ms("time")).alias("bz"))
        x = f.crossJoin(span).crossJoin(lim)  # one row each
        x = x.withColumn("t", S.from_ms((F.col("ba") + (S.ms("t") - F.col("a")) / (F.col("z") - F.col("a")) * (F.col("bz") - F.col("ba"))).cast("long")))
        return G.signals(b, [(sid, sid, G.resolve(sid, **params))], frames=x.select("market", "t", "clusters", "contexts", "bull_ratio_15m", "velocity_norm")).select("series", "idx", "side", r6("stop"), r6("target"))
    query("signal_" + sid.replace("-", "_"))(run)


_option_signal("level-reversion", entryAtr=2.0)
_option_signal("maxpain-magnet", maxDte=100_000.0, minDistanceAtr=0.5)
_option_signal("flow-momentum", minBullRatio=0.5, minVelocity=0.0)
_option_signal("flow-at-level", entryAtr=2.0, minBullRatio=0.4, requireReclaim=0)


# -- one model a key, against the same Newton steps in SQL ----------------------------------------

def _ship_rows(spark, sf):
    l = tables.table(spark, sf, "lineitem")
    return l.select(F.col("l_returnflag").alias("key"), F.col("l_quantity").cast("double").alias("x_quantity"), (F.col("l_extendedprice") > 40_000).cast("int").alias("label"))


def _newton_sql(rounds: int = 9) -> str:
    """Newton steps of one input and an intercept, written out round by round."""
    parts = ["""r AS MATERIALIZED (SELECT key, y, (x - m)/s AS z, CASE WHEN y = 1 THEN n/(2*pos) ELSE n/(2*(n - pos)) END AS w FROM (SELECT l_returnflag AS key, l_quantity::DOUBLE AS x, (l_extendedprice > 40000)::INT AS y FROM lineitem)
 JOIN (SELECT l_returnflag AS key, avg(l_quantity) AS m, stddev_samp(l_quantity) AS s, count(*)::DOUBLE AS n, sum((l_extendedprice > 40000)::INT)::DOUBLE AS pos FROM lineitem GROUP BY ALL) USING (key))""",
             "n0 AS (SELECT DISTINCT key, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM r)"]
    for k in range(rounds):
        parts.append(f"""n{k + 1} AS MATERIALIZED (SELECT key, a - (h22*g1 - h12*g2)/(h11*h22 - h12*h12) AS a, b - (h11*g2 - h12*g1)/(h11*h22 - h12*h12) AS b FROM (
 SELECT key, any_value(a) AS a, any_value(b) AS b, sum(w*(p - y)) AS g1, sum(w*(p - y)*z) + any_value(b) AS g2, sum(w*p*(1-p)) AS h11, sum(w*p*(1-p)*z) AS h12, sum(w*p*(1-p)*z*z) + 1 AS h22 FROM (SELECT *, 1/(1 + exp(-(a + b*z))) AS p FROM r JOIN n{k} USING (key)) GROUP BY key))""")
    return "WITH " + ",\n".join(parts) + f"\nSELECT key, n, {R('a')} AS intercept, {R('b')} AS weight, true AS settled FROM n{rounds} JOIN (SELECT l_returnflag AS key, count(*) AS n FROM lineitem GROUP BY ALL) USING (key)"


@query("model_keyed_fit", _newton_sql())
def model_keyed_fit(spark, sf):
    """A model of each ship mode, all fitted at once; the slopes left at the optimum are next to nothing."""
    m = ML.keyed_fit(_ship_rows(spark, sf), ["key"], ["x_quantity"])
    return m.select("key", "n", r6(F.get("weights", F.lit(0)), "intercept"), r6(F.get("weights", F.lit(1)), "weight"), (F.col("gradient") < 1e-6).alias("settled"))


def _dated(spark, sf):
    l = tables.table(spark, sf, "lineitem")
    return l.select(F.col("l_returnflag").alias("key"), F.col("l_shipdate").cast("timestamp").alias("t"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("double").alias("x_quantity"), (F.col("l_extendedprice") > 40_000).cast("int").alias("label"))


@query("model_fold_report", """WITH r AS (SELECT l_returnflag AS key, (l_extendedprice > 40000)::INT AS y, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
f AS (SELECT key, least(i*4//n, 3)::INT AS fold, count(*) AS test_rows, sum(y) AS p FROM r GROUP BY ALL)
SELECT key, fold, train_rows::BIGINT AS train_rows, train_positives::BIGINT AS train_positives, test_rows, test_rows < 10 OR train_positives = 0 OR train_positives = train_rows AS skipped FROM (SELECT *, sum(test_rows) OVER w AS train_rows, sum(p) OVER w AS train_positives FROM f WINDOW w AS (PARTITION BY key ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE fold > 0""")
def model_fold_report(spark, sf):
    return ML.fold_report(ML.fold_table(_dated(spark, sf), "t", 3, ["key"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]), folds=3, keys=["key"])
