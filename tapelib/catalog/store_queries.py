"""Queries that write real files and read them back: tapes, bars, calendars, logs."""

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.longseries import scratch_dir
from ..sources import bar_store, payloads, tables, tape as store
from . import bar_queries, source_queries, tape  # noqa: F401  (register their CTEs)
from .registry import SQL, R, Rs, cte, query, r6, r6s, sql


def _path(spark, name):
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _tape(spark, sf):
    """The tape in its schema; labels of large prints are ones that nobody knows."""
    p = tables.prints(spark, sf).withColumn("flow_class", F.when(F.col("contracts") >= 45, "SWEEPER").otherwise(F.col("flow_class")))
    return store.conform(p)


LABELLED = "CASE WHEN contracts >= 45 THEN 'UNKNOWN' ELSE flow_class END"


@query("tape_file", sql(f"SELECT symbol, {LABELLED} AS flow_class, count(*) AS n, {R('sum(premium_usd)')} AS premium, min(t) AS first_t FROM prints GROUP BY ALL", "prints"))
def tape_file(spark, sf):
    """A tape written and read back; labels out of the list become UNKNOWN."""
    path = _path(spark, "tape-file")
    store.write_tape(_tape(spark, sf), path)
    return store.read_tape(spark, path).groupBy("symbol", "flow_class").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("premium_usd"), "premium"), F.min(S.ms("timestamp")).alias("first_t"))


@query("tape_store_all", sql("SELECT count(*) AS n, sum(unknown)::BIGINT AS unknown FROM (SELECT id, max((contracts >= 45 AND n = 1)::INT) AS unknown FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM prints) GROUP BY id)", "prints"))
def tape_store_all(spark, sf):
    """The whole day store, appended twice: one row an id, unknown labels as in a single tape."""
    root = _path(spark, "tape-all")
    p = _tape(spark, sf)
    for _ in range(2):
        store.append_tape(p, root)
    once = p.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n = 1")
    d = store.read_all(spark, root, ["flow_class", "contracts"]).join(once, "id", "left")
    return d.agg(F.count(F.lit(1)).alias("n"), F.sum(((F.col("flow_class") == "UNKNOWN") & (F.col("contracts") >= 45) & F.col("n").isNotNull()).cast("long")).alias("unknown"))


@query("tape_json_columns", sql(f"SELECT symbol, count(*) AS n, {R('sum(premium_usd)')} AS premium, {R('sum(strike*contracts)')} AS weight, min(t) AS first_t, max(option_type) AS option_type FROM prints GROUP BY symbol", "prints"))
def tape_json_columns(spark, sf):
    """Documents of 25 parallel arrays, one a symbol and month, written as JSON lines and read back as prints."""
    path = _path(spark, "tape-json")
    p = store.conform(tables.prints(spark, sf))
    payloads.tape_documents(p, [F.col("symbol"), F.date_format("timestamp", "yyyy-MM")]).write.option("compression", "gzip").text(path)
    d = payloads.read_tape_documents(spark.read.text(path))
    return d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("premium_usd"), "premium"), r6(F.sum(F.col("strike") * F.col("contracts")), "weight"), F.min(S.ms("timestamp")).alias("first_t"), F.max("option_type").alias("option_type"))


@query("calendar_files", sql("SELECT f AS format, currency, impact, count(*) AS n, min(epoch_us(ets)//1000) AS first_t FROM (SELECT DISTINCT * FROM (SELECT c.*, e.event_id FROM events e JOIN cal c ON c.ets = e.ts AND e.event_type = 'error' AND e.value >= 100)), (VALUES ('csv'), ('parquet')) v(f) GROUP BY ALL", "cal"))
def calendar_files(spark, sf):
    """The calendar written as Parquet and as CSV and read back from both."""
    out = None
    for fmt in ("parquet", "csv"):
        path = _path(spark, "calendar")
        bar_store.write_calendar(tables.calendar(spark, sf), path, fmt)
        one = bar_store.read_calendar(spark, path, fmt).groupBy("currency", "impact").agg(F.count(F.lit(1)).alias("n"), F.min(S.ms("time")).alias("first_t")).withColumn("format", F.lit(fmt))
        out = one if out is None else out.unionByName(one)
    return out


MINUTES = "SELECT epoch_us(ts)//60000000*60000 AS ms, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close, count(*) - 1 AS volume FROM events GROUP BY ALL"
cte("m1", MINUTES)


@query("csv_minute_bars", sql("SELECT 60000::BIGINT AS step, ms AS t, open, high, low, close FROM m1 WHERE NOT (volume = 0 AND high = low) UNION ALL SELECT 3600000, ms//3600000*3600000 AS t, arg_min(open, ms), max(high), min(low), arg_max(close, ms) FROM m1 WHERE NOT (volume = 0 AND high = low) GROUP BY 2", "m1"))
def csv_minute_bars(spark, sf):
    """Minute bars from CSV, and hours made of them; flat minutes without volume are left out."""
    path, e = _path(spark, "csv"), tables.table(spark, sf, "events")
    m = e.groupBy((F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000) * 60_000).cast("long").alias("ms")).agg(
        F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"), (F.count(F.lit(1)) - 1).cast("double").alias("volume"))
    m.write.option("header", True).csv(path)
    out = None
    for step, d in bar_store.csv_minutes(spark, path, "x", [3_600_000]).items():
        one = d.select(F.lit(step).cast("long").alias("step"), S.ms("time").alias("t"), "open", "high", "low", "close")
        out = one if out is None else out.unionByName(one)
    return out


@query("server_clock_bars", sql("SELECT series, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM bars WHERE t + 3600000 <= epoch_ms(TIMESTAMP '2024-01-20 12:30:00') GROUP BY series", "bars"))
def server_clock_bars(spark, sf):
    """Bars stamped by the broker's wall clock (two hours ahead in winter); the one still forming is left out."""
    d = tables.bars(spark, sf).withColumn("time", F.col("time") + F.expr("INTERVAL 2 HOURS"))
    return bar_store.server_bars_to_utc(d, 3_600_000, "2024-01-20 12:30:00").groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.min(S.ms("time")).alias("first_t"), F.max(S.ms("time")).alias("last_t"))


@query("calendar_feed", sql("SELECT country AS currency, impact, count(*) AS n, min(t) AS first_t FROM (SELECT ['USD','EUR','GBP'][user_id % 3 + 1] AS country, CASE event_type WHEN 'error' THEN 3 WHEN 'view' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS impact, epoch_us(ts)//1000000*1000 + 5*3600000 AS t FROM events) WHERE impact >= 2 GROUP BY ALL"))
def calendar_feed(spark, sf):
    """Feed items in JSON with an offset in their dates and impact in words."""
    e = tables.table(spark, sf, "events")
    word = F.when(F.col("event_type") == "error", "High").when(F.col("event_type") == "view", "Medium").when(F.col("event_type") == "click", "Low").otherwise("Holiday")
    j = F.to_json(F.struct(F.concat(F.lit(" item "), F.col("event_id")).alias("title"), F.element_at(F.array(F.lit("USD"), F.lit("EUR"), F.lit("GBP")), (F.col("user_id") % 3 + 1).cast("int")).alias("country"),
                           F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'-05:00'").alias("date"), word.alias("impact")))
    items = e.select(F.from_json(j, "title string, country string, date string, impact string").alias("i")).select("i.*")
    return bar_store.parse_calendar_feed(items).groupBy("currency", "impact").agg(F.count(F.lit(1)).alias("n"), F.min(S.ms("time")).alias("first_t"))


@query("calendar_text_undated", sql("SELECT source, dated, undated FROM (SELECT 'bls' AS source, sum((n <> 13)::INT)::BIGINT AS dated, sum((n = 13)::INT)::BIGINT AS undated FROM d UNION ALL SELECT 'federalreserve', sum((n <> 13)::INT)::BIGINT, sum((n = 13)::INT)::BIGINT FROM d)".replace("FROM d", "FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, day(o_orderdate) AS n FROM orders)")))
def calendar_text_undated(spark, sf):
    """Lines whose date cannot be read are counted, not lost in silence."""
    d = tables.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct().withColumn("bad", F.dayofmonth("d") == 13).withColumn("year", F.year("d"))
    bls = d.select("year", F.concat_ws(" | ", F.lit("Consumer Price Index"), F.lit("x"), F.when(F.col("bad"), "to be announced").otherwise(F.date_format("d", "MMMM d, yyyy")), F.lit("08:30 AM")).alias("value"))
    fed = d.select("year", F.concat_ws(" | ", F.when(F.col("bad"), "soon").otherwise(F.date_format("d", "MMMM")), F.date_format("d", "d"), F.lit("Meeting"), F.lit("statement"), F.lit("x")).alias("value"))
    out = None
    for parse, text in ((bar_store.parse_bls, bls), (bar_store.parse_fed, fed)):
        one = bar_store.dated(parse(text, keep_undated=True))
        out = one if out is None else out.unionByName(one)
    return out


@query("decision_log_file", SQL["decision_log_review"])
def decision_log_file(spark, sf):
    """The decision log as a JSON lines file."""
    path, e = _path(spark, "decisions"), tables.table(spark, sf, "events")
    verdict = lambda n: F.element_at(F.array(F.lit("allow"), F.lit("cut"), F.lit("veto")), ((F.col("event_id") + n) % 3 + 1).cast("int"))
    steps = F.array(F.struct(F.lit("first").alias("agent"), verdict(1).alias("verdict")), F.struct(F.lit("last").alias("agent"), verdict(0).alias("verdict")))
    e.select(F.concat(F.lit("run-"), F.col("user_id") % 4).alias("run"), F.col("event_id").alias("at"), F.col("value").alias("latency_ms"), F.col("value").alias("book_pnl"), F.lit(100.0).alias("shadow_pnl"), steps.alias("transcript")).write.json(path)
    return payloads.review_runs(payloads.read_jsonl(spark, path)).select("run", "decisions", "allow", "cut", "veto", *r6s("latency_ms", "book_minus_shadow"))


@query("synthetic_bars", sql("SELECT series, sum((high = low)::INT)::BIGINT AS synthetic, count(*) AS bars, count(DISTINCT weekofyear(ts)) AS weeks FROM bars GROUP BY series", "bars"))
def synthetic_bars(spark, sf):
    from ..functions import clock
    return tables.bars(spark, sf).groupBy("series").agg(F.sum(S.is_synthetic().cast("long")).alias("synthetic"), F.count(F.lit(1)).alias("bars"), F.countDistinct(clock.iso_week()).alias("weeks"))
