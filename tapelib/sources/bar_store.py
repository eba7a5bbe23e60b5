"""Bar store, sealed copies, CSV and server-clock bars, calendar files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import clock, scalars as S
from ..operators.bars import dedupe_by_time, resample
from ..schema import BARS, CALENDAR, assert_schema


def read_bars(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(BARS).parquet(root)


def write_bars(bars: DataFrame, root: str) -> None:
    """Rewrite only the series present in ``bars``."""
    d = assert_schema(bars, BARS).hint("rebalance", "series").sortWithinPartitions("series", "time")
    d.write.option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("series").mode("overwrite").parquet(root)


def seal_store(spark: SparkSession, src: str, dst: str, cutoff) -> DataFrame:
    """Copy every series up to an exclusive cutoff and fail if a later bar survived; returns the last times."""
    read_bars(spark, src).filter(F.col("time") < F.lit(cutoff).cast("timestamp")).write.option("compression", "zstd").partitionBy("series").mode("overwrite").parquet(dst)
    ends = read_bars(spark, dst).groupBy("series").agg(F.max("time").alias("last_time"))
    if not ends.filter(F.col("last_time") >= F.lit(cutoff).cast("timestamp")).isEmpty():
        raise ValueError("a bar at or after the cutoff survived")
    return ends


def csv_minutes(spark: SparkSession, path: str, series: str, coarser: list[int] = []) -> dict[int, DataFrame]:
    """CSV minute bars (ms, open, high, low, close, volume): malformed and flat zero-volume bars are dropped,
    the last row of a time wins.  Keys of the result: 60000 and the coarser steps."""
    d = spark.read.schema("ms long, open double, high double, low double, close double, volume double").option("header", True).csv(path)
    flat = (F.col("volume") == 0) & (F.col("high") == F.col("low"))
    d = d.filter(S.sane_bar() & ~flat).withColumn("_o", F.monotonically_increasing_id())
    d = d.select(F.lit(series).alias("series"), S.from_ms("ms").alias("time"), "open", "high", "low", "close", "volume", "_o")
    one = dedupe_by_time(d, "_o").drop("_o")
    return {60_000: one, **{s: resample(one, s).drop("n") for s in coarser}}


def server_bars_to_utc(rows: DataFrame, step_ms: int, now) -> DataFrame:
    """Server wall-clock bars to UTC; the bar still forming at ``now`` is dropped."""
    d = rows.withColumn("time", clock.server_to_utc("time"))
    return d.filter(S.ms("time") + step_ms <= F.unix_millis(F.lit(now).cast("timestamp")))


# -- calendar -------------------------------------------------------------------------------------

def read_calendar(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Columns found by name, Parquet or CSV with a header; rows without time or impact are dropped, negative impact is 0."""
    d = spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.parquet(path)
    d = d.withColumn("time", F.col("time").cast("timestamp"))
    opt = lambda c: F.col(c) if c in d.columns else F.lit(None).cast("string")
    d = d.select("time", opt("currency").alias("currency"), F.coalesce(opt("name"), F.lit("")).alias("name"), F.col("impact").cast("int").alias("impact"), opt("source").alias("source"))
    return d.na.drop(subset=["time", "impact"]).withColumn("impact", F.greatest("impact", F.lit(0)))


def _lines(text: DataFrame) -> DataFrame:
    """Pipe-delimited lines (value, year): trimmed cells, comments and blanks skipped."""
    d = text.filter((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    return d.withColumn("c", F.transform(F.split("value", r"\|"), lambda x: F.trim(x)))


def _cell(i: int):
    return F.coalesce(F.get("c", F.lit(i)), F.lit(""))


def _row(d: DataFrame, local, zone: str, currency: str, name, source: str, keep_undated: bool = False) -> DataFrame:
    rows = d.select(F.to_utc_timestamp(local, zone).alias("time"), F.lit(currency).alias("currency"), (name if not isinstance(name, str) else F.lit(name)).alias("name"),
                    F.lit(3).alias("impact"), F.lit(source).alias("source"))
    return rows if keep_undated else rows.filter(F.col("time").isNotNull())


def dated(rows: DataFrame) -> DataFrame:
    """(source, dated, undated): how many rows of a parser (``keep_undated=True``) have a time, and how many lines had none."""
    return rows.groupBy("source").agg(F.count("time").alias("dated"), F.sum(F.col("time").isNull().cast("long")).alias("undated"))


def parse_fed(text: DataFrame, keep_undated: bool = False) -> DataFrame:
    """month | days | type | statement | release header.  Scheduled meetings: last day 14:00 New York, a day
    range running backwards spills into the next month; unscheduled ones take the header's time or the date in
    the statement address at 14:00; cancelled entries are dropped."""
    d = _lines(text).filter(~F.lower(_cell(2)).contains("cancel") & (F.lower(_cell(3)) != "no statement"))
    first, last = F.try_element_at(F.split(_cell(1), "-"), F.lit(1)).try_cast("int"), F.element_at(F.split(_cell(1), "-"), -1).try_cast("int")
    month = F.month(F.try_to_timestamp(F.concat(F.lit("2000 "), F.substring(F.get(F.split(_cell(0), "/"), F.lit(0)), 1, 3), F.lit(" 1")), F.lit("yyyy MMM d")))
    day = F.make_date(F.col("year"), month, F.lit(1))
    day = F.date_add(F.when(last < first, F.add_months(day, 1)).otherwise(day), last - 1)
    two_pm = lambda x: x.cast("timestamp") + F.expr("INTERVAL 14 HOURS")
    meet = F.lower(_cell(2)) == "meeting"
    head = r"release at (\d{1,2}:\d{2}) ([ap])\.m\. E[DS]T ([A-Za-z]+ \d{1,2}, \d{4})"
    stamp = F.concat(F.regexp_extract(_cell(4), head, 3), F.lit(" "), F.regexp_extract(_cell(4), head, 1), F.lit(" "), F.upper(F.regexp_extract(_cell(4), head, 2)), F.lit("M"))
    by_head = F.try_to_timestamp(stamp, F.lit("MMMM d, yyyy h:mm a"))
    by_address = two_pm(F.try_to_timestamp(F.regexp_extract(_cell(3), r"monetary(\d{8})", 1), F.lit("yyyyMMdd")).cast("date"))
    return _row(d.filter(meet), two_pm(day), clock.NEW_YORK, "USD", "FOMC", "federalreserve", keep_undated).unionByName(
        _row(d.filter(~meet), F.coalesce(by_head, by_address), clock.NEW_YORK, "USD", "FOMC (unscheduled)", "federalreserve", keep_undated))


def parse_bls(text: DataFrame, keep_undated: bool = False) -> DataFrame:
    """name | reference | 'Month d, yyyy' (weekday allowed in front) | 'hh:mm AM'."""
    d = _lines(text)
    date = F.regexp_replace(_cell(2), r"^[A-Za-z]+,\s*", "")
    local = F.try_to_timestamp(F.concat(date, F.lit(" "), F.upper(_cell(3))), F.lit("MMMM d, yyyy h:mm a"))
    name = F.when(_cell(0).startswith("Consumer Price Index"), "US CPI").when(_cell(0).startswith("Employment Situation"), "US Employment Situation (NFP)")
    return _row(d.filter(name.isNotNull()), local, clock.NEW_YORK, "USD", name, "bls", keep_undated)


def parse_extra(text: DataFrame, label: str, currency: str, source: str) -> tuple[DataFrame, DataFrame]:
    """name | reference | ISO date | HH:MM Eastern; returns (rows, count of rows without a known time)."""
    d = _lines(text)
    known = F.upper(_cell(3)) != "UNKNOWN"
    local = F.try_to_timestamp(F.concat(_cell(2), F.lit(" "), _cell(3)), F.lit("yyyy-MM-dd HH:mm"))
    return _row(d.filter(known), local, clock.NEW_YORK, currency, label, source), d.filter(~known).agg(F.count(F.lit(1)).alias("unknown"))


def parse_ecb(text: DataFrame) -> DataFrame:
    """ISO date | title; 13:45 Berlin, from 2022-07-21 on 14:15."""
    d = _lines(text)
    day = F.to_date(_cell(0))
    minutes = F.when(day >= F.to_date(F.lit("2022-07-21")), 14 * 60 + 15).otherwise(13 * 60 + 45)
    return _row(d, F.timestamp_seconds(F.unix_date(day).cast("long") * 86_400 + minutes * 60), "Europe/Berlin", "EUR", "ECB rate decision", "ecb")


def parse_calendar_feed(items: DataFrame, min_impact: int = 2) -> DataFrame:
    """Feed rows (title, country, date with offset, impact text) at or over an impact."""
    impact = F.when(F.col("impact") == "High", 3).when(F.col("impact") == "Medium", 2).when(F.col("impact") == "Low", 1).otherwise(0)
    return items.withColumn("impact", impact).filter(F.col("impact") >= min_impact).select(
        F.to_timestamp("date").alias("time"), F.col("country").alias("currency"), F.trim("title").alias("name"), "impact", F.lit("feed").alias("source"))


def merge_calendar(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Existing rows win; keyed by time, currency, name."""
    keys = ["time", "currency", "name"]
    extra = new.dropDuplicates(keys).join(rows.select(*keys), keys, "left_anti")
    return rows.unionByName(extra.select(*rows.columns))


def write_calendar(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    d = assert_schema(rows.withColumn("impact", F.col("impact").cast("int")), CALENDAR).dropDuplicates(["time", "currency", "name"])
    d.sortWithinPartitions("time").write.mode("overwrite").format(fmt).option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").save(path)
