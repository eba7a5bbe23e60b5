"""Domain tables derived from the star-schema test tables (see FIXTURES.md).

``bars`` and ``bars_indexed`` are written once per application to shared storage, as a bar store would be."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars as S
from ..operators.bars import bars_from_ticks
from ..plans.longseries import materialize, with_index

HOUR = 3_600_000
_store: dict = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def quotes(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("series"), F.col("ts").cast("timestamp").alias("time"), F.col("value").alias("bid"),
                    (F.col("value") + 0.01 * (1 + F.col("user_id") % 10)).alias("ask"), "event_id")


def ticks(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("series"), F.col("ts").cast("timestamp").alias("time"), F.col("value").alias("price"),
                    F.col("event_id").alias("seq"))


def bars(spark, sf, step_ms: int = HOUR) -> DataFrame:
    """Bars with the row number ``idx`` per series."""
    key = (spark.sparkContext.applicationId, sf, step_ms)
    if key not in _store:
        b = bars_from_ticks(ticks(spark, sf), step_ms)
        b = with_index(b, ["series"], ["time"], F.floor(S.ms("time") / (step_ms * 4096)))
        _store[key] = materialize(b.select("series", "time", "open", "high", "low", "close", "volume", "idx"), "bars")
    return _store[key]


def calendar(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").filter((F.col("event_type") == "error") & (F.col("value") >= 100))
    return e.select(F.col("ts").cast("timestamp").alias("time"),
                    F.element_at(F.array(F.lit("USD"), F.lit("EUR"), F.lit("All")),
                                 (F.col("user_id") % 3 + 1).cast("int")).alias("currency"),
                    F.concat(F.lit("event-"), F.col("event_id")).alias("name"),
                    F.when(F.col("value") >= 150, 3).otherwise(2).alias("impact"), F.lit("table").alias("source"))


def stored_prints(spark, sf) -> DataFrame:
    """The tape as a stored table, for operators that read it several times."""
    key = (spark.sparkContext.applicationId, sf, "prints")
    if key not in _store:
        _store[key] = materialize(prints(spark, sf), "prints")
    return _store[key]


def prints(spark, sf) -> DataFrame:
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    j = line.join(part.select("p_partkey", "p_brand", "p_size"), line.l_partkey == part.p_partkey)
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    d = j.select(
        F.lit("main").alias("market"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"), F.col("p_brand").alias("symbol"),
        F.expr("timestamp'2001-12-31'").alias("_end"), brand.alias("_b"),
        F.col("p_size").cast("double").alias("strike"),
        F.when(F.col("l_linestatus") == "O", "CALL").otherwise("PUT").alias("option_type"),
        (F.col("l_extendedprice") / (100.0 * F.col("l_quantity"))).alias("trade_price"),
        F.col("l_quantity").alias("contracts"),
        F.when(F.col("l_returnflag") == "A", "BUY").when(F.col("l_returnflag") == "R", "SELL")
        .otherwise("UNKNOWN").alias("aggressor_side"),
        F.col("l_extendedprice").alias("premium_usd"),
        (20.0 + 100.0 * F.col("l_discount")).alias("underlying_price"),
        F.format_string("%012d-%02d-%010d-%08d", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        .alias("sequence_id"))
    d = d.withColumn("expiration", F.timestamp_seconds(F.unix_seconds("_end") + F.col("_b").cast("long") * 86400))
    return d.withColumn("flow_class", S.flow_class()).drop("_end", "_b")
