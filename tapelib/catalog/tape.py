"""Queries over the trade tape."""

from pyspark.sql import Window, functions as F

from ..functions import scalars as S
from ..operators import flow, levels, profile
from ..operators.flow import BigPrints
from ..operators.levels import Settings
from ..sources import tables
from .registry import R, Rs, cte, query, r6, r6s, sql

BIG = BigPrints(min_premium=95_000.0)
SET = Settings(big=BIG, cluster_floor=0.05)
DAY = 86_400_000

cte("prints", """
SELECT 'main' AS market, l_orderkey || '-' || l_linenumber AS id, l_shipdate AS ts, p_brand AS symbol,
  TIMESTAMP '2001-12-31' + to_days(CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT)) AS expiration,
  CAST(p_size AS DOUBLE) AS strike, CASE WHEN l_linestatus = 'O' THEN 'CALL' ELSE 'PUT' END AS option_type,
  l_extendedprice / (100.0 * l_quantity) AS trade_price, l_quantity AS contracts,
  CASE l_returnflag WHEN 'A' THEN 'BUY' WHEN 'R' THEN 'SELL' ELSE 'UNKNOWN' END AS aggressor_side,
  l_extendedprice AS premium_usd, 20.0 + 100.0 * l_discount AS underlying_price,
  printf('%012d-%02d-%010d-%08d', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS sequence_id,
  CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_linestatus = 'O' THEN 'LC' ELSE 'LP' END
       WHEN l_returnflag = 'R' THEN CASE WHEN l_linestatus = 'O' THEN 'SC' ELSE 'SP' END ELSE 'UNKNOWN' END AS flow_class,
  CASE WHEN l_returnflag = 'A' THEN 1.0 WHEN l_returnflag = 'R' THEN -1.0 ELSE 0.0 END AS sgn,
  epoch_ms(l_shipdate) AS t
FROM lineitem JOIN part ON l_partkey = p_partkey""")

FLOW_COLS = ["lc_premium", "lp_premium", "sc_premium", "sp_premium", "bull_premium", "bear_premium",
             "net_directional_premium", "bull_ratio"]


def flow_sql(src: str, keys: str) -> str:
    k = keys + ", " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    cls = ", ".join(f"sum(CASE WHEN flow_class = '{c}' THEN premium_usd ELSE 0 END) AS {c.lower()}_premium"
                    for c in ("LC", "LP", "SC", "SP"))
    return (f"SELECT *, bull_premium - bear_premium AS net_directional_premium, CASE WHEN bull_premium + bear_premium > 0 "
            f"THEN bull_premium / (bull_premium + bear_premium) ELSE 0.5 END AS bull_ratio FROM (SELECT *, "
            f"lc_premium + sp_premium AS bull_premium, lp_premium + sc_premium AS bear_premium FROM (SELECT {k}{cls}, "
            f"count(*) AS trades, sum(contracts) AS contracts FROM {src} {g}))")


cte("flow_by_symbol", flow_sql("prints", "market, symbol"), "prints")
cte("state", "SELECT market, max(ts) AS as_of, arg_min(underlying_price, sequence_id) FILTER (ts = m) AS spot FROM "
    "(SELECT *, max(ts) OVER (PARTITION BY market) AS m FROM prints) GROUP BY market", "prints")
cte("board", "SELECT market, symbol, strike, sum(CASE WHEN option_type='CALL' THEN contracts ELSE 0 END) AS c, "
    "sum(CASE WHEN option_type='PUT' THEN contracts ELSE 0 END) AS p FROM prints GROUP BY ALL", "prints")
cte("payouts", "SELECT a.market, a.symbol, a.strike, sum(greatest(a.strike-b.strike,0)*b.c*100 + "
    "greatest(b.strike-a.strike,0)*b.p*100) AS payout FROM board a JOIN board b USING (market, symbol) GROUP BY ALL", "board")
cte("maxpain", "SELECT market, symbol, arg_min(strike, {'p': round(payout,6), 's': strike}) AS max_pain, "
    "min(round(payout,6)) AS min_payout FROM payouts GROUP BY ALL", "payouts")


def profile_cte(mode_expr: str) -> str:
    j = lambda e: f"floor(({e})*100.0+0.5)/100.0"
    return (f"SELECT market, symbol, strike, call, put, {j('abs(call)+abs(put)')} AS total FROM (SELECT market, symbol, "
            f"strike, {j(f'sum(CASE WHEN option_type=$$CALL$$ THEN {mode_expr} ELSE 0 END)')} AS call, "
            f"{j(f'sum(CASE WHEN option_type=$$PUT$$ THEN {mode_expr} ELSE 0 END)')} AS put FROM prints GROUP BY ALL)").replace("$$", "'")


MODE_SQL = {"PREMIUM": "premium_usd", "VOLUME": "contracts", "NET_PREMIUM": "sgn*premium_usd",
            "ABS_NET_PREMIUM": "abs(sgn*premium_usd)", "OPEN_INTEREST": "sgn*contracts"}
for _m, _e in MODE_SQL.items():
    cte(f"profile_{_m.lower()}", profile_cte(_e), "prints")
cte("prof", "SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY market, symbol) AS n, sum(total) OVER "
    "(PARTITION BY market, symbol) AS s FROM profile_premium WINDOW w AS (PARTITION BY market, symbol ORDER BY strike)",
    "profile_premium")
cte("pocs", "SELECT market, symbol, arg_min(i, {'t': -total, 'k': strike}) AS poc, any_value(n) AS n, any_value(s) AS s, "
    "max(total) AS acc FROM prof GROUP BY ALL", "prof")
# value-area walk as a fold over list positions
cte("va", """
SELECT market, symbol, poc, n, list_reduce(list_prepend({'lo': CAST(poc AS BIGINT), 'hi': CAST(poc AS BIGINT), 'acc': acc},
   list_transform(range(n), lambda q: {'lo': CAST(0 AS BIGINT), 'hi': CAST(0 AS BIGINT), 'acc': CAST(0 AS DOUBLE)})), lambda st, q:
   CASE WHEN st.acc >= s * 0.7 OR (st.lo = 1 AND st.hi = n) THEN st
        WHEN coalesce(CASE WHEN st.hi < n THEN tt[st.hi + 1] END, -1e300) >= coalesce(CASE WHEN st.lo > 1 THEN tt[st.lo - 1] END, -1e300)
        THEN {'lo': st.lo, 'hi': st.hi + 1, 'acc': st.acc + tt[st.hi + 1]}
        ELSE {'lo': st.lo - 1, 'hi': st.hi, 'acc': st.acc + tt[st.lo - 1]} END) AS v
FROM pocs JOIN (SELECT market, symbol, list(total ORDER BY strike) AS tt FROM prof GROUP BY ALL) USING (market, symbol)""", "pocs", "prof")
cte("nodes", """
SELECT market, symbol, coalesce(min(CASE WHEN i > poc AND pk THEN i END), arg_min(CASE WHEN i > poc THEN i END, {'t': -total, 'i': i}) FILTER (i > poc)) AS up_i,
  coalesce(max(CASE WHEN i < poc AND pk THEN i END), arg_min(i, {'t': -total, 'i': -i}) FILTER (i < poc)) AS dn_i
FROM (SELECT p.*, c.poc, total >= coalesce(lag(total) OVER w, -1e300) AND total >= coalesce(lead(total) OVER w, -1e300) AS pk
      FROM prof p JOIN pocs c USING (market, symbol) WINDOW w AS (PARTITION BY p.market, p.symbol ORDER BY strike)) GROUP BY ALL""", "prof", "pocs")
cte("plevels", """
SELECT v.market, v.symbol, a.strike AS poc, b.strike AS vah, c.strike AS val, d.strike AS above_poc, e.strike AS under_poc
FROM va v JOIN nodes n USING (market, symbol) JOIN prof a ON a.symbol=v.symbol AND a.i=v.poc JOIN prof b ON b.symbol=v.symbol AND b.i=v.v.hi
JOIN prof c ON c.symbol=v.symbol AND c.i=v.v.lo LEFT JOIN prof d ON d.symbol=v.symbol AND d.i=n.up_i LEFT JOIN prof e ON e.symbol=v.symbol AND e.i=n.dn_i""", "va", "nodes", "prof")


def be_sql(weight: str, cond: str = "true") -> str:
    f = lambda side, s: (f"sum((strike{s}trade_price)*({weight})) FILTER (option_type='{side}' AND {weight}>0 AND {cond}) / "  # noqa: E731
                         f"sum({weight}) FILTER (option_type='{side}' AND {weight}>0 AND {cond})")
    return f"SELECT market, symbol, {f('CALL', '+')} AS call_be, {f('PUT', '-')} AS put_be FROM prints GROUP BY ALL"


cte("be_pw", be_sql("premium_usd"), "prints")
cte("newest2000", "SELECT * FROM prints QUALIFY row_number() OVER (PARTITION BY market, symbol ORDER BY ts DESC, sequence_id DESC) <= 2000", "prints")
cte("thr", "SELECT market, symbol, quantile_cont(premium_usd, 0.95) AS threshold FROM newest2000 GROUP BY ALL", "newest2000")
cte("big", "SELECT p.*, threshold FROM prints p JOIN thr USING (market, symbol) WHERE premium_usd >= 95000 OR premium_usd >= threshold", "prints", "thr")
cte("foot", """
SELECT market, symbol, strike, sum(CASE WHEN option_type='CALL' THEN sgn*contracts ELSE 0 END) AS call_net,
 sum(CASE WHEN option_type='PUT' THEN sgn*contracts ELSE 0 END) AS put_net,
 sum(CASE WHEN option_type='CALL' THEN premium_usd ELSE 0 END) AS call_premium,
 sum(CASE WHEN option_type='PUT' THEN premium_usd ELSE 0 END) AS put_premium, max(premium_usd) AS max_premium,
 max({'t': ts, 's': sequence_id}) AS seen FROM big GROUP BY ALL""", "big")


def whale_sql(src: str, put: str, call: str, order: str) -> str:
    return (f"SELECT market, symbol, arg_max(strike, {{'v': round({put},6), 'o': {order}}}) FILTER (strike <= spot AND {put} > 0) AS w_sup, "
            f"arg_max(strike, {{'v': round({call},6), 'o': {order}}}) FILTER (strike >= spot AND {call} > 0) AS w_res "
            f"FROM {src} JOIN state USING (market) GROUP BY ALL")


cte("whale", whale_sql("foot", "put_net", "call_net", "seen"), "foot", "state")
cte("contexts", """
SELECT f.*, s.as_of, s.spot, m.max_pain, l.poc, l.vah, l.val, l.above_poc, l.under_poc, b.call_be, b.put_be, w.w_sup, w.w_res,
  round((epoch_ms(x.expiration) - epoch_ms(s.as_of)) / 86400000.0, 4) AS dte, x.expiration
FROM flow_by_symbol f JOIN state s USING (market) LEFT JOIN maxpain m USING (market, symbol) LEFT JOIN plevels l USING (market, symbol)
LEFT JOIN be_pw b USING (market, symbol) LEFT JOIN whale w USING (market, symbol)
JOIN (SELECT market, symbol, max(expiration) AS expiration FROM prints GROUP BY ALL) x USING (market, symbol)""",
    "flow_by_symbol", "state", "maxpain", "plevels", "be_pw", "whale", "prints")
EW = "CASE WHEN dte <= 0.25 THEN 1.5 WHEN dte <= 1 THEN 1.3 WHEN dte <= 3 THEN 1.15 WHEN dte <= 7 THEN 1.0 ELSE 0.8 END"
cte("lvl", " UNION ALL ".join(
    f"SELECT market, symbol, expiration, dte, '{t}' AS level_type, {c} AS price, {levels.TYPE_WEIGHTS[t]} * {EW} AS weight, "
    f"{str(t in levels.EXPERIMENTAL).lower()} AS experimental FROM contexts WHERE {c} IS NOT NULL"
    for t, c in levels.LEVEL_COLUMNS.items() if t != "GAMMA_WALL"), "contexts")
cte("clusters", """
SELECT *, row_number() OVER (PARTITION BY market ORDER BY round(score, 9) DESC, low) AS rank FROM (
 SELECT market, cluster, min(price) AS low, max(price) AS high, sum(price*weight)/sum(weight) AS center,
  count(DISTINCT level_type) AS distinct_types, count(DISTINCT expiration) AS distinct_expirations, sum(weight) AS weight, count(*) AS n_levels,
  sum(weight) * (1 + 0.25*(count(DISTINCT level_type)-1)) * (1 + 0.35*(count(DISTINCT expiration)-1)) AS score
 FROM (SELECT *, sum(nw) OVER (PARTITION BY market ORDER BY price, symbol, level_type ROWS UNBOUNDED PRECEDING) AS cluster FROM (
   SELECT *, CASE WHEN price - lag(price) OVER (PARTITION BY market ORDER BY price, symbol, level_type) <= 0.05 THEN 0 ELSE 1 END AS nw FROM lvl))
 GROUP BY market, cluster)""", "lvl")


# -- scalars over prints --------------------------------------------------------------------------

@query("print_classes", sql(f"SELECT sequence_id, flow_class, flow_class IN ('LC','SP') AS bull, flow_class IN ('LP','SC') AS bear, "
                            "sgn AS position_sign, CASE aggressor_side WHEN 'BUY' THEN contracts WHEN 'SELL' THEN -contracts ELSE 0 END AS signed_contracts "
                            "FROM prints", "prints"))
def print_classes(spark, sf):
    return tables.prints(spark, sf).select("sequence_id", "flow_class", S.is_bull().alias("bull"), S.is_bear().alias("bear"),
                                           S.position_sign().alias("position_sign"), S.signed_contracts().alias("signed_contracts"))


@query("print_parsing", sql("""SELECT l_linestatus, l_returnflag, CASE WHEN l_linestatus='F' THEN 'CALL' ELSE 'PUT' END AS option_type,
 CASE WHEN l_returnflag='A' THEN 'BUY' WHEN l_returnflag='R' THEN 'SELL' ELSE 'UNKNOWN' END AS side, count(*) AS n FROM lineitem GROUP BY ALL"""))
def print_parsing(spark, sf):
    d = tables.table(spark, sf, "lineitem").withColumn("letter", F.when(F.col("l_linestatus") == "F", " call").otherwise("p")).withColumn(
        "word", F.when(F.col("l_returnflag") == "A", "long ").when(F.col("l_returnflag") == "R", "s").otherwise("?"))
    return d.groupBy("l_linestatus", "l_returnflag", S.option_type("letter").alias("option_type"), S.aggressor("word").alias("side")).agg(
        F.count(F.lit(1)).alias("n"))


@query("premium_measures", sql(f"""SELECT symbol, {R('sum(trade_price*contracts*100.0)')} AS premium, {R('sum(trade_price*underlying_price*contracts)')} AS premium_in_underlying,
 {R('sum(contracts*underlying_price*100.0)')} AS notional, {R('sum(contracts*underlying_price*100.0*abs(0.5*sgn))')} AS delta_notional FROM prints GROUP BY ALL""", "prints"))
def premium_measures(spark, sf):
    p = tables.prints(spark, sf)
    return p.groupBy("symbol").agg(
        r6(F.sum(S.premium_usd("trade_price", "contracts", 100.0)), "premium"),
        r6(F.sum(S.premium_usd_in_underlying("trade_price", "contracts", "underlying_price")), "premium_in_underlying"),
        r6(F.sum(S.notional_usd("contracts", "underlying_price", 100.0)), "notional"),
        r6(F.sum(S.delta_adjusted_notional("contracts", "underlying_price", S.position_sign() * 0.5, 100.0)), "delta_notional"))


@query("expiry_buckets", sql(f"""SELECT symbol, bucket, weight, count(*) AS n, {R('min(dte)')} AS min_dte FROM (SELECT *, CASE WHEN dte<=1 THEN 'DAILY' WHEN dte<=7 THEN 'WEEKLY' ELSE 'MONTHLY' END AS bucket,
 {EW} AS weight FROM (SELECT symbol, (epoch_ms(expiration)-t)/86400000.0 - 56 AS dte FROM prints)) GROUP BY ALL""", "prints"))
def expiry_buckets(spark, sf):
    p = tables.prints(spark, sf).withColumn("dte", S.dte("timestamp", "expiration") - 56)
    return p.groupBy("symbol", S.expiry_bucket("dte").alias("bucket"), S.expiry_weight("dte").alias("weight")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.min("dte"), "min_dte"))


@query("inferred_aggressor", sql("""SELECT symbol, inferred, count(*) AS n FROM (SELECT symbol,
 CASE WHEN ask >= bid AND (p >= ask - 1e-8) THEN 'BUY' WHEN ask >= bid AND p <= bid + 1e-8 THEN 'SELL'
  WHEN ask >= bid AND p > (bid+ask)/2 + 1e-8 THEN 'BUY' WHEN ask >= bid AND p < (bid+ask)/2 - 1e-8 THEN 'SELL'
  WHEN p > prev + 1e-8 THEN 'BUY' WHEN p < prev - 1e-8 THEN 'SELL' ELSE 'UNKNOWN' END AS inferred
 FROM (SELECT symbol, trade_price AS p, CASE WHEN contracts > 25 THEN trade_price - 0.01*contracts + 0.3 END AS bid,
  CASE WHEN contracts > 25 THEN trade_price + 0.01*contracts - 0.32 END AS ask, lag(trade_price) OVER (PARTITION BY market, symbol ORDER BY ts, sequence_id) AS prev FROM prints))
 GROUP BY ALL""", "prints"))
def inferred(spark, sf):
    p = tables.prints(spark, sf)
    quoted = F.col("contracts") > 25
    p = p.withColumn("bid", F.when(quoted, F.col("trade_price") - 0.01 * F.col("contracts") + 0.3)).withColumn(
        "ask", F.when(quoted, F.col("trade_price") + 0.01 * F.col("contracts") - 0.32))
    return flow.inferred_aggressor(p).groupBy("symbol", "inferred").agg(F.count(F.lit(1)).alias("n"))


@query("content_ids", sql("""SELECT symbol, count(*) AS prints, count(DISTINCT h) AS contents, sum(CASE WHEN n > 1 THEN 1 ELSE 0 END)::BIGINT AS repeats
 FROM (SELECT symbol, h, row_number() OVER (PARTITION BY h ORDER BY sequence_id) AS n FROM (SELECT symbol, sequence_id, ts || '|' || symbol || '|' || strike || '|' || option_type || '|' || contracts || '|' || aggressor_side AS h FROM prints)) GROUP BY ALL""", "prints"))
def content_ids(spark, sf):
    p = tables.prints(spark, sf)
    d = flow.with_content_ids(p, ["timestamp", "symbol", "strike", "option_type", "contracts", "aggressor_side"], ["sequence_id"], F.substring("sequence_id", 1, 9))
    repeat = (F.col("content") != F.col("content_id")).cast("int")  # a content holds its symbol, so its first print stands for it
    return d.groupBy("symbol").agg(F.count(F.lit(1)).alias("prints"), F.sum(1 - repeat).alias("contents"), F.sum(repeat).alias("repeats"))


@query("lots_for_risk", sql(f"SELECT sequence_id, {R('greatest(floor((premium_usd*0.01)/(trade_price*100.0)/0.01)*0.01, 0.01)')} AS lots FROM prints", "prints"))
def lots(spark, sf):
    return tables.prints(spark, sf).select("sequence_id", r6(S.lots_for_risk(F.col("premium_usd") * 0.01, "trade_price", 100.0, 0.01, 0.01), "lots"))


# -- flow -----------------------------------------------------------------------------------------

@query("flow_summary", sql(f"SELECT market, symbol, {Rs(*FLOW_COLS)}, trades, contracts, CASE WHEN bull_ratio>=0.6 THEN 'STRONG_BULL' WHEN bull_ratio>=0.55 THEN 'MODERATE_BULL' "
                           "WHEN bull_ratio<=0.4 THEN 'STRONG_BEAR' WHEN bull_ratio<=0.45 THEN 'MODERATE_BEAR' ELSE 'BALANCED' END AS bias FROM flow_by_symbol", "flow_by_symbol"))
def flow_summary(spark, sf):
    d = flow.flow_summary(tables.prints(spark, sf), ["market", "symbol"])
    return d.select("market", "symbol", *r6s(*FLOW_COLS), "trades", "contracts", flow.bias_label("bull_ratio").alias("bias"))


@query("top_contracts", sql(f"SELECT market, symbol, {R('premium')} AS premium, trades, rank FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY round(premium,6) DESC, symbol) AS rank FROM "
                            "(SELECT market, symbol, sum(premium_usd) AS premium, count(*) AS trades FROM prints GROUP BY ALL)) WHERE rank <= 10", "prints"))
def top_contracts(spark, sf):
    return flow.top_contracts(tables.prints(spark, sf), 10).select("market", "symbol", r6("premium"), "trades", "rank")


@query("top_contract_prints", sql("SELECT p.symbol, count(*) AS n FROM prints p WHERE symbol IN (SELECT symbol FROM prints GROUP BY symbol ORDER BY round(sum(premium_usd),6) DESC, symbol LIMIT 5) GROUP BY ALL", "prints"))
def top_contract_prints(spark, sf):
    return flow.keep_top_contracts(tables.prints(spark, sf), 5).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("rolling_flow", sql(f"""SELECT symbol, t, {Rs(*FLOW_COLS)}, trades, contracts FROM ({flow_sql("(SELECT a.symbol, a.t, b.flow_class, b.premium_usd, b.contracts FROM (SELECT DISTINCT symbol, t FROM prints) a JOIN prints b ON b.symbol=a.symbol AND b.t BETWEEN a.t - 7*86400000 AND a.t)", "symbol, t")})""", "prints"))
def rolling_flow(spark, sf):
    return flow.rolling_flow(tables.prints(spark, sf), ["symbol"], 7 * DAY).select("symbol", "t", *r6s(*FLOW_COLS), "trades", "contracts")


VEL = ["current", "previous", "velocity", "bull_velocity", "bear_velocity"]


@query("flow_velocity", sql(f"""SELECT symbol, t, {R('c1-c2')} AS current, {R('p1-p2')} AS previous, {R('(c1-c2)-(p1-p2)')} AS velocity, {R('c1-p1')} AS bull_velocity, {R('c2-p2')} AS bear_velocity FROM (
 SELECT a.symbol, a.t, coalesce(sum(bull) FILTER (b.t >= a.t-w), 0) AS c1, coalesce(sum(bear) FILTER (b.t >= a.t-w), 0) AS c2, coalesce(sum(bull) FILTER (b.t <= a.t-w), 0) AS p1, coalesce(sum(bear) FILTER (b.t <= a.t-w), 0) AS p2
 FROM (SELECT DISTINCT symbol, t, 7*86400000 AS w FROM prints) a JOIN (SELECT symbol, t, CASE WHEN flow_class IN ('LC','SP') THEN premium_usd ELSE 0 END AS bull, CASE WHEN flow_class IN ('LP','SC') THEN premium_usd ELSE 0 END AS bear FROM prints) b
 ON b.symbol=a.symbol AND b.t BETWEEN a.t - 2*a.w AND a.t GROUP BY ALL)""", "prints"))
def flow_velocity(spark, sf):
    return flow.flow_velocity(tables.prints(spark, sf), ["symbol"], 7 * DAY).select("symbol", "t", *r6s(*VEL))


@query("named_flow_windows", sql(f"""SELECT name, {Rs('bull_premium', 'bear_premium', 'bull_ratio')}, trades FROM ({flow_sql("(SELECT w.name, p.* FROM prints p, state s, (VALUES ('1d', 86400000), ('30d', 30*86400000::BIGINT), ('90d', 90*86400000::BIGINT)) w(name, ms) WHERE p.t <= epoch_ms(s.as_of) AND p.t >= epoch_ms(s.as_of) - w.ms)", "name")})""", "prints", "state"))
def named_windows(spark, sf):
    p = tables.prints(spark, sf)
    now, out = flow.market_state(p), None
    for name, width in (("1d", DAY), ("30d", 30 * DAY), ("90d", 90 * DAY)):
        one = flow.summary_at(p, width, now).select(F.lit(name).alias("name"), *r6s("bull_premium", "bear_premium", "bull_ratio"), "trades")
        out = one if out is None else out.unionByName(one)
    return out


@query("premium_percentile", sql(f"SELECT symbol, {R('threshold')} AS threshold FROM thr", "thr"))
def premium_percentile(spark, sf):
    return flow.percentile_threshold(tables.prints(spark, sf), flow.CONTRACT, BIG).select("symbol", r6("threshold"))


@query("big_prints", sql("SELECT symbol, sequence_id, premium_usd, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, sequence_id DESC) AS newest_rank FROM big QUALIFY newest_rank <= 200", "big"))
def big_prints(spark, sf):
    return flow.big_prints(tables.prints(spark, sf), flow.CONTRACT, BIG).select("symbol", "sequence_id", "premium_usd", "newest_rank")


@query("whale_footprint", sql(f"SELECT symbol, strike, {Rs('call_net', 'put_net', 'call_premium', 'put_premium', 'max_premium')} FROM foot", "foot"))
def whale_footprint(spark, sf):
    f = flow.footprint(flow.big_prints(tables.prints(spark, sf), flow.CONTRACT, BIG, limited=False), flow.CONTRACT)
    return f.select("symbol", "strike", *r6s("call_net", "put_net", "call_premium", "put_premium", "max_premium"))


def _whale(model):
    def run(spark, sf):
        p = tables.prints(spark, sf)
        return flow.whale_levels(p, flow.market_state(p).select("market", "spot"), model, BIG).select("symbol", "w_sup", "w_res")
    return run


cte("conc", """SELECT market, symbol, strike, sum(CASE WHEN option_type='PUT' THEN premium_usd ELSE 0 END) AS pp, sum(CASE WHEN option_type='CALL' THEN premium_usd ELSE 0 END) AS cp,
 row_number() OVER (PARTITION BY market, symbol ORDER BY min({'t': ts, 's': sequence_id}) DESC) AS o FROM prints GROUP BY market, symbol, strike""", "prints")
query("whale_net_long", sql("SELECT symbol, w_sup, w_res FROM whale", "whale"))(_whale("net-long-whale"))
query("whale_largest_print", sql("SELECT symbol, w_sup, w_res FROM (" + whale_sql(
    "(SELECT *, CASE WHEN option_type='PUT' THEN premium_usd ELSE 0 END AS pp, CASE WHEN option_type='CALL' THEN premium_usd ELSE 0 END AS cp FROM big)",
    "pp", "cp", "{'t': ts, 's': sequence_id}") + ")", "big", "state"))(_whale("largest-print"))
query("whale_premium_concentration", sql("SELECT symbol, w_sup, w_res FROM (" + whale_sql("conc", "pp", "cp", "o") + ")", "conc", "state"))(_whale("premium-concentration"))


# -- per-strike -----------------------------------------------------------------------------------

@query("positioning_volume", sql("SELECT symbol, strike, c AS net_call, p AS net_put, greatest(c,0) AS call_oi_proxy, greatest(p,0) AS put_oi_proxy FROM board", "board"))
def positioning_volume(spark, sf):
    return profile.positioning(tables.prints(spark, sf)).select("symbol", "strike", "net_call", "net_put", "call_oi_proxy", "put_oi_proxy")


@query("positioning_net", sql("SELECT symbol, strike, nc AS net_call, np AS net_put, greatest(nc,0) AS call_oi_proxy, greatest(np,0) AS put_oi_proxy FROM (SELECT symbol, strike, sum(CASE WHEN option_type='CALL' THEN sgn*contracts ELSE 0 END) AS nc, sum(CASE WHEN option_type='PUT' THEN sgn*contracts ELSE 0 END) AS np FROM prints GROUP BY ALL)", "prints"))
def positioning_net(spark, sf):
    return profile.positioning(tables.prints(spark, sf), mode="net").select("symbol", "strike", "net_call", "net_put", "call_oi_proxy", "put_oi_proxy")


@query("payout_curve", sql(f"SELECT symbol, strike, {R('payout')} AS payout FROM payouts", "payouts"))
def payout_curve(spark, sf):
    return profile.payout_curve(profile.positioning(tables.prints(spark, sf)), 100.0).select("symbol", "strike", r6("payout"))


@query("max_pain", sql(f"SELECT symbol, max_pain, {R('min_payout')} AS min_payout FROM maxpain", "maxpain"))
def max_pain(spark, sf):
    return profile.max_pain(profile.positioning(tables.prints(spark, sf)), 100.0).select("symbol", "max_pain", r6("min_payout"))


@query("max_pain_at_candidates", sql(f"""SELECT symbol, arg_min(s, {{'p': round(pay,6), 's': s}}) AS max_pain, {R('min(round(pay,6))')} AS min_payout FROM (
 SELECT b.symbol, c.s, sum(greatest(c.s-strike,0)*c*100.0 + greatest(strike-c.s,0)*p*100.0) AS pay FROM board b JOIN (SELECT DISTINCT symbol, strike + 0.25 AS s FROM board WHERE strike % 5 = 0) c USING (symbol) GROUP BY ALL) GROUP BY symbol""", "board"))
def max_pain_at(spark, sf):
    rows = profile.positioning(tables.prints(spark, sf))
    cand = rows.filter(F.col("strike") % 5 == 0).select("market", "symbol", (F.col("strike") + 0.25).alias("settlement")).distinct()
    return profile.max_pain_at(rows, cand, 100.0).select("symbol", "max_pain", r6("min_payout"))


def _profile(mode):
    return lambda spark, sf: profile.strike_profile(tables.prints(spark, sf), mode).select("symbol", "strike", *r6s("call", "put", "total"))


for _m in profile.MODES:
    query(f"profile_{_m.lower()}", sql(f"SELECT symbol, strike, {Rs('call', 'put', 'total')} FROM profile_{_m.lower()}", f"profile_{_m.lower()}"))(_profile(_m))


@query("profile_bucketed", sql(f"SELECT symbol, round(strike/5)*5 AS strike, {R('floor(sum(contracts)*100.0+0.5)/100.0')} AS total FROM prints GROUP BY ALL", "prints"))
def profile_bucketed(spark, sf):
    return profile.strike_profile(tables.prints(spark, sf), "VOLUME", 5.0).select("symbol", "strike", r6("total"))


@query("profile_levels", sql("SELECT symbol, poc, vah, val, above_poc, under_poc FROM plevels", "plevels"))
def profile_levels(spark, sf):
    return profile.profile_levels(profile.strike_profile(tables.prints(spark, sf))).drop("market")


AGG_BE = """
WITH q AS (SELECT symbol, option_type AS o, strike AS k, sum(contracts) AS q, sum(premium_usd) AS prem FROM prints GROUP BY ALL),
c AS (SELECT symbol, o, sum(prem)/100.0 AS cost, min(k) AS mn, max(k) AS mx FROM q GROUP BY ALL),
cross_at AS (SELECT c.*, a.k AS k0, sum(CASE WHEN o='CALL' THEN CASE WHEN b.k <= a.k THEN b.q ELSE 0 END ELSE CASE WHEN b.k >= a.k THEN b.q ELSE 0 END END) AS sq,
  sum(CASE WHEN o='CALL' THEN CASE WHEN b.k <= a.k THEN b.q*b.k ELSE 0 END ELSE CASE WHEN b.k >= a.k THEN b.q*b.k ELSE 0 END END) AS sqk
  FROM c JOIN q a USING (symbol, o) JOIN q b USING (symbol, o) GROUP BY ALL)
SELECT symbol, max(be) FILTER (o='CALL') AS call_be, max(be) FILTER (o='PUT') AS put_be FROM (
  SELECT symbol, o, CASE WHEN o='CALL' THEN least(greatest(min((cost+sqk)/sq), any_value(mn)), any_value(mx)*3) ELSE least(greatest(max((sqk-cost)/sq), 0), any_value(mx)) END AS be FROM cross_at GROUP BY symbol, o) GROUP BY symbol"""
NET_BE = """SELECT symbol, sum(strike*qty + cost) FILTER (option_type='CALL') / sum(qty) FILTER (option_type='CALL') AS call_be,
 sum(strike*qty - cost) FILTER (option_type='PUT') / sum(qty) FILTER (option_type='PUT') AS put_be FROM (
 SELECT symbol, option_type, strike, sum(sgn*contracts) AS qty, sum(sgn*trade_price*contracts) AS cost FROM prints WHERE sgn<>0 GROUP BY ALL) WHERE qty > 0 GROUP BY symbol"""
BE_SQL = {"premium-weighted": be_sql("premium_usd"), "premium-weighted-long": be_sql("premium_usd", "aggressor_side='BUY'"),
          "size-weighted": be_sql("contracts"), "aggregate-payoff": AGG_BE, "net-positioning": NET_BE}


def _be(model):
    return lambda spark, sf: profile.break_even(tables.prints(spark, sf), model).select("symbol", *r6s("call_be", "put_be"))


for _m in profile.BREAK_EVEN_MODELS:
    query("break_even_" + _m.replace("-", "_"), sql(f"SELECT symbol, {Rs('call_be', 'put_be')} FROM ({BE_SQL[_m]})", "prints"))(_be(_m))


@query("net_positioning_by_strike", sql("SELECT symbol, strike, sum(CASE WHEN option_type='CALL' THEN sgn*contracts ELSE 0 END) AS call_net, sum(CASE WHEN option_type='PUT' THEN sgn*contracts ELSE 0 END) AS put_net FROM prints WHERE sgn<>0 GROUP BY ALL", "prints"))
def net_by_strike(spark, sf):
    return profile.net_positioning_by_strike(tables.prints(spark, sf)).drop("market")


# -- contexts, levels, clusters, snapshot ---------------------------------------------------------

CTX = ["max_pain", "poc", "vah", "val", "above_poc", "under_poc", "call_be", "put_be", "w_sup", "w_res", "dte", "bull_ratio"]


@query("contexts", sql(f"SELECT symbol, {Rs(*CTX)}, trades, row_number() OVER (ORDER BY dte, symbol) AS dte_rank FROM contexts", "contexts"))
def contexts(spark, sf):
    return levels.contexts(tables.stored_prints(spark, sf), SET).select("symbol", *r6s(*CTX), "trades", "dte_rank")


@query("level_rows", sql(f"SELECT symbol, level_type, {Rs('price', 'weight', 'dte')}, experimental FROM lvl", "lvl"))
def level_rows(spark, sf):
    return levels.levels_from_contexts(levels.contexts(tables.stored_prints(spark, sf), SET)).select(
        "symbol", "level_type", *r6s("price", "weight", "dte"), "experimental")


def _clusters(spark, sf):
    return levels.cluster_levels(levels.levels_from_contexts(levels.contexts(tables.stored_prints(spark, sf), SET)), SET.cluster_floor)


@query("level_clusters", sql(f"SELECT {Rs('low', 'high', 'center', 'score')}, distinct_types, distinct_expirations, n_levels, rank FROM clusters WHERE rank <= 12", "clusters"))
def level_clusters(spark, sf):
    return _clusters(spark, sf).filter(F.col("rank") <= 12).select(*r6s("low", "high", "center", "score"), "distinct_types", "distinct_expirations",
                                                                   F.size("levels").cast("long").alias("n_levels"), "rank")


@query("nearest_cluster", sql(f"""SELECT market, {Rs('low', 'high', 'distance')}, distance <= 0.05 AS inside FROM (SELECT c.*, CASE WHEN spot < low THEN low-spot WHEN spot > high THEN spot-high ELSE 0 END AS distance
 FROM clusters c JOIN state USING (market)) ORDER BY distance, rank LIMIT 1""", "clusters", "state"))
def nearest_cluster(spark, sf):
    state = flow.market_state(tables.prints(spark, sf)).select("market", "spot")
    return levels.nearest_cluster(_clusters(spark, sf), state, SET.cluster_floor).select("market", *r6s("low", "high", "distance"), "inside")


@query("snapshot", sql(f"""SELECT s.market, epoch_ms(s.as_of) AS as_of_ms, {R('s.spot')} AS spot, {R('f.bull_ratio')} AS bull_ratio, (SELECT count(*) FROM contexts) AS n_contexts,
 (SELECT arg_min(symbol, {{'d': dte, 's': symbol}}) FROM contexts) AS front, (SELECT {R('max(score)')} FROM clusters) AS best_score, (SELECT least(count(*), 12) FROM clusters) AS n_clusters,
 (SELECT {R("sum(CASE WHEN flow_class IN ('LC','SP') THEN premium_usd WHEN flow_class IN ('LP','SC') THEN -premium_usd ELSE 0 END)")} FROM prints p WHERE p.t >= epoch_ms(s.as_of) - 900000) AS current_net,
 (SELECT count(*) FROM prints p WHERE p.t >= epoch_ms(s.as_of) - 28800000) AS session_trades, 200 AS n_big
 FROM state s JOIN ({flow_sql('prints', 'market')}) f USING (market)""", "state", "contexts", "clusters"))
def snapshot(spark, sf):
    d = levels.snapshot(tables.stored_prints(spark, sf), SET)
    return d.select("market", S.ms("as_of").alias("as_of_ms"), r6("spot"), r6(F.col("flow_overall.bull_ratio"), "bull_ratio"),
                    F.size("contexts").cast("long").alias("n_contexts"), F.col("contexts")[0]["symbol"].alias("front"),
                    r6(F.col("clusters")[0]["score"], "best_score"), F.size("clusters").cast("long").alias("n_clusters"),
                    r6(F.col("velocity.current"), "current_net"), F.col("flow_windows")["session"]["trades"].alias("session_trades"),
                    F.size("big_prints").alias("n_big"))


# -- set operations -------------------------------------------------------------------------------

@query("dedupe_prints", sql("SELECT id, sequence_id, premium_usd FROM prints QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts, sequence_id) = 1", "prints"))
def dedupe_prints(spark, sf):
    return flow.dedupe_prints(tables.prints(spark, sf), ["timestamp", "sequence_id"]).select("id", "sequence_id", "premium_usd")


RECON = """FROM (SELECT id, count(*) AS live_n FROM prints WHERE premium_usd > 2000 GROUP BY id) a FULL JOIN (SELECT DISTINCT id, 1 AS back_n FROM prints WHERE premium_usd < 90000) b USING (id)"""


@query("reconcile_feeds", sql(f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN live_n IS NULL THEN 'missing' WHEN back_n IS NULL THEN 'extra' WHEN live_n > back_n THEN 'duplicated' ELSE 'matched' END AS status {RECON}) GROUP BY ALL", "prints"))
def reconcile(spark, sf):
    p = tables.prints(spark, sf)
    back = p.filter(F.col("premium_usd") < 90000).select("id").distinct()
    return flow.reconcile(p.filter(F.col("premium_usd") > 2000), back).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("print_set_difference", sql("SELECT side, count(*) AS n FROM (SELECT id, 'left' AS side FROM (SELECT id FROM prints WHERE premium_usd > 2000 EXCEPT ALL SELECT id FROM prints WHERE premium_usd < 90000) UNION ALL SELECT id, 'right' FROM (SELECT id FROM prints WHERE premium_usd < 90000 EXCEPT ALL SELECT id FROM prints WHERE premium_usd > 2000)) GROUP BY ALL", "prints"))
def set_difference(spark, sf):
    p = tables.prints(spark, sf)
    return flow.set_difference(p.filter(F.col("premium_usd") > 2000), p.filter(F.col("premium_usd") < 90000)).groupBy("side").agg(F.count(F.lit(1)).alias("n"))
