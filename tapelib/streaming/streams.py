"""Structured Streaming jobs over the same operators."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars as S
from ..operators import flow, profile
from ..operators.bars import resample
from ..plans.longseries import carry, materialize
from ..sources.payloads import kline_events


def collect_prints(prints: DataFrame, root: str, checkpoint: str, every: str | None = "300 seconds"):
    """Normalized print stream to the day-partitioned store.  Late prints are kept: an id that comes again is stored again
    and made unique when the store is read (see :func:`collected_prints`)."""
    d = prints.withColumn("date", F.to_date("timestamp"))
    w = d.writeStream.format("parquet").option("path", root).option("checkpointLocation", checkpoint).partitionBy("date").outputMode("append")
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def collected_prints(spark: SparkSession, root: str, schema) -> DataFrame:
    """The store with one row per id: of rows that differ, the earliest, then the least."""
    d = spark.read.schema(schema).parquet(root)
    cols = [c for c in d.columns if c != "id"]
    first = ["timestamp", *[c for c in cols if c != "timestamp"]]
    return d.groupBy("id").agg(F.min_by(F.struct(*cols), F.struct(*first)).alias("p")).select("id", "p.*").select(*d.columns)


#: Folders of the index of ids; a batch reads those that its own ids fall in.
ID_BUCKETS = 256


def append_unseen(stream: DataFrame, root: str, checkpoint: str, every: str | None = None):
    """Rolling-window feed: each batch appends only ids that are not in the store, however long ago they came.

    Digests of all ids are kept beside the store by hash buckets, so the store itself is not read.  A batch writes its rows and
    digests under its own name and looks at those of other batches only: one that runs twice replaces itself."""
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    index = root.rstrip("/") + "-ids"

    def write(batch: DataFrame, number: int):
        spark, name = batch.sparkSession, f"{run}-{number}"
        cols = [c for c in batch.columns if c != "id"]
        b = batch.groupBy("id").agg(F.min_by(F.struct(*cols), F.struct("timestamp", *[c for c in cols if c != "timestamp"])).alias("p")).select("id", "p.*")
        b = b.withColumn("digest", F.md5("id")).withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(ID_BUCKETS)).cast("int"))
        try:
            known = spark.read.schema("digest string, batch string, bucket int").parquet(index).filter(F.col("batch") != name)
            b = b.join(known.select("bucket", "digest"), ["bucket", "digest"], "left_anti")
        except Exception as e:  # the index does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        b = materialize(b, "unseen")
        b.select("digest", "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{index}/batch={name}")
        b.drop("digest", "bucket").withColumn("date", F.to_date("timestamp")).write.partitionBy("date").mode("overwrite").parquet(f"{root}/batch={name}")
    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def closed_klines(lines: DataFrame) -> DataFrame:
    """Closed bars of a kline stream (append); the forming bar is the same stream with ``closed`` false."""
    return kline_events(lines).filter("closed")


def minute_ticks(quotes: DataFrame) -> DataFrame:
    """The quotes of each (series, minute) in order of (milliseconds, event_id), with the quotes that are not numbers counted as
    ``dropped``.  A column ``us`` may hold the exact time of quotes whose ``time`` is a clock in milliseconds.  Rows of one minute may be many, from any number of batches: :func:`minute_bars` puts them together."""
    q = quotes.select("series", "time", S.ms("time").alias("ms"), "bid", "ask", (F.col("event_id") if "event_id" in quotes.columns else F.lit(0)).cast("long").alias("seq"),
                      F.col("us") if "us" in quotes.columns else F.unix_micros("time").alias("us"))
    bad = F.isnan("bid") | F.isnan("ask") | F.col("bid").isNull() | F.col("ask").isNull()
    return q.groupBy("series", F.date_trunc("minute", "time").alias("time")).agg(F.array_sort(F.collect_list(F.when(~bad, F.struct("ms", "seq", "us", "bid", "ask")))).alias("quotes"), F.sum(bad.cast("long")).alias("dropped"))


def collect_minutes(quotes: DataFrame, root: str, checkpoint: str, every: str | None = None):
    """Keep a quote stream by minutes.  There is no watermark: each batch writes its quotes by (series, minute) under its own
    number, so none is lost however late it is, and a batch that runs twice replaces itself."""
    def write(batch: DataFrame, number: int):
        minute_ticks(batch).write.mode("overwrite").parquet(f"{root}/batch={number}")
    w = quotes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def minute_bars(spark: SparkSession, root: str) -> DataFrame:
    """One-minute mid bars of the collected quotes, the forming minute included, as one fold over all quotes in order of time
    gives them: a quote equal to the one before it is ignored, also across minutes; bad and repeated quotes are counted; a
    minute nobody ticked stays absent.  Repeats are judged in order of (milliseconds, event_id), open and close are the first and
    last of the exact time.  The parts of a minute meet in one row; minutes of a series are as many rows."""
    quotes = "array<struct<ms:bigint,seq:bigint,us:bigint,bid:double,ask:double>>"
    d = spark.read.option("basePath", root).schema(f"series string, time timestamp, quotes {quotes}, dropped long").parquet(f"{root}/batch=*")
    d = d.groupBy("series", "time").agg(F.array_sort(F.flatten(F.collect_list("quotes"))).alias("t"), F.sum("dropped").alias("dropped"))
    new = F.filter("t", lambda x, i: (i == 0) | (x["bid"] != F.get("t", i - 1)["bid"]) | (x["ask"] != F.get("t", i - 1)["ask"]))
    d = d.select("series", "time", "dropped", F.size("t").cast("long").alias("seen"), new.alias("k"))

    def bar(ticks, name):
        exact = F.array_sort(F.transform(ticks, lambda x: F.struct(x["us"], x["seq"], ((x["bid"] + x["ask"]) / 2.0).alias("mid"))))
        mid = F.transform(exact, lambda x: x["mid"])
        wide = F.aggregate(ticks, F.lit(0.0), lambda s, x: s + x["ask"] - x["bid"])
        return F.when(F.size(ticks) > 0, F.struct(F.get(mid, F.lit(0)).alias("open"), F.array_max(mid).alias("high"), F.array_min(mid).alias("low"), F.element_at(mid, -1).alias("close"),
                                                  F.size(ticks).cast("long").alias("ticks"), wide.alias("spread"))).alias(name)

    quote = lambda x: F.struct(x["bid"].alias("bid"), x["ask"].alias("ask"))
    d = d.select("series", "time", "dropped", "seen", F.when(F.size("k") > 0, quote(F.get("k", F.lit(0)))).alias("first"), F.when(F.size("k") > 0, quote(F.element_at("k", -1))).alias("last"),
                 bar(F.col("k"), "bar"), bar(F.when(F.size("k") > 1, F.slice("k", 2, 1 << 30)), "rest"))
    d = carry(d.withColumn("idx", F.floor(S.ms("time") / 60_000)), ["series"], {"before": ("last", "last")}, inclusive=False)
    b = F.when(F.col("before").eqNullSafe(F.col("first")), F.col("rest")).otherwise(F.col("bar"))
    d = d.withColumn("b", b).filter(F.col("b").isNotNull())
    return d.select("series", "time", "b.open", "b.high", "b.low", "b.close", "b.ticks", (F.col("b.spread") / F.col("b.ticks")).alias("spread"), "dropped", (F.col("seen") - F.col("b.ticks")).alias("repeated"))


def window_bars(quotes: DataFrame, width: str = "1 minute", delay: str = "1 minute") -> DataFrame:
    """The same bars without the repeat rule, as a tumbling window: partial aggregation spreads a hot series."""
    mid = (F.col("bid") + F.col("ask")) / 2
    w = F.window("time", width)
    return quotes.withWatermark("time", delay).groupBy("series", w).agg(
        F.min_by(mid, "time").alias("open"), F.max(mid).alias("high"), F.min(mid).alias("low"), F.max_by(mid, "time").alias("close"), F.count(F.lit(1)).alias("ticks"),
        F.avg(F.col("ask") - F.col("bid")).alias("spread")).select("series", F.col("window.start").alias("time"), "open", "high", "low", "close", "ticks", "spread")


def forming_bar(closed: DataFrame, finer: DataFrame, step_ms: int) -> DataFrame:
    """The coarse bar now forming: finer bars at or after the end of the last closed coarse bar."""
    ends = closed.groupBy("series").agg(F.max(S.ms("time")).alias("_e"))
    f = finer.join(ends, "series", "left").filter(F.col("_e").isNull() | (S.ms("time") >= F.col("_e") + step_ms)).drop("_e")
    r = resample(f, step_ms)
    last = r.groupBy("series").agg(F.max("time").alias("time"))
    return r.join(last, ["series", "time"])


def strike_totals(prints: DataFrame) -> DataFrame:
    """Running per-strike totals of a print stream (update or complete mode): the only state levels need."""
    call = F.col("option_type") == "CALL"
    return prints.groupBy("market", "symbol", "strike").agg(
        F.sum(F.when(call, F.col("contracts")).otherwise(0.0)).alias("call_oi_proxy"), F.sum(F.when(call, 0.0).otherwise(F.col("contracts"))).alias("put_oi_proxy"),
        F.sum(F.when(call, F.col("premium_usd")).otherwise(0.0)).alias("call"), F.sum(F.when(call, 0.0).otherwise(F.col("premium_usd"))).alias("put"))


def levels_from_totals(totals: DataFrame, multiplier: float = 100.0, pct: float = 0.7) -> DataFrame:
    p = profile.profile_levels(profile.finish_profile(totals.select("market", "symbol", "strike", "call", "put")), pct)
    return p.join(profile.max_pain(totals.select("market", "symbol", "strike", "call_oi_proxy", "put_oi_proxy"), multiplier), ["market", "symbol"])


def live_levels(prints: DataFrame, path: str, checkpoint: str, every: str | None = "2 seconds"):
    """Write the level table from the running totals at most once per trigger, each time in a folder of its own: a reader of
    an earlier one (see :func:`latest_levels`) is never disturbed."""
    def write(totals: DataFrame, number: int):
        levels_from_totals(totals).write.mode("overwrite").parquet(f"{path}/batch={number}")
    w = strike_totals(prints).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def latest_levels(spark: SparkSession, path: str) -> DataFrame:
    """The level table of the last finished batch."""
    d = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return d.join(F.broadcast(d.agg(F.max("batch").alias("batch"))), "batch").drop("batch")  # one row


def sliding_flow(prints: DataFrame, keys: list[str], width: str, slide: str, delay: str) -> DataFrame:
    """Flow summary of sliding windows on the live tape."""
    w = F.window("timestamp", width, slide)
    g = prints.withWatermark("timestamp", delay).groupBy(*keys, w).agg(*flow._class_sums())
    return flow.finish_summary(g.select(*keys, F.col("window.end").alias("until"), *[c for c in g.columns if c not in (*keys, "window")]))
