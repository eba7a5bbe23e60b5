"""Landed JSON payloads to prints and bars; decision logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S
from ..schema import PRINTS


def columns_to_rows(df: DataFrame, arrays: list[str], keep: list[str] = []) -> DataFrame:
    """Parallel arrays of one document to rows."""
    return df.select(*keep, F.inline(F.arrays_zip(*[F.col(a).alias(a) for a in arrays])))


def parsed(df: DataFrame, struct: Column, keep: list[str] = []) -> DataFrame:
    """Fields of ``struct`` as columns, worked out once a row: a filter on them stays above, where it would else be pushed
    below with a copy of the whole expression for each field it asks for."""
    return df.select(*keep, struct.alias("_parsed")).select(*keep, F.inline(F.array("_parsed")))


def tape_documents(prints: DataFrame, keys: list[Column]) -> DataFrame:
    """One JSON line of parallel arrays, one for each column of the tape, for each value of ``keys``, which bound a document's
    length; times in milliseconds."""
    cols = [S.ms(f.name).alias(f.name) if f.dataType.simpleString() == "timestamp" else F.col(f.name) for f in PRINTS]
    g = prints.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.collect_list(F.struct(*cols)).alias("r"))
    arrays = [F.transform("r", (lambda n: lambda x: x[n])(f.name)).alias(f.name) for f in PRINTS]
    return g.select(F.to_json(F.struct(*arrays), {"ignoreNullFields": "false"}).alias("value"))


def read_tape_documents(lines: DataFrame) -> DataFrame:
    """The prints of such lines."""
    kind = lambda f: "bigint" if f.dataType.simpleString() == "timestamp" else f.dataType.simpleString()
    d = lines.select(F.from_json("value", ", ".join(f"`{f.name}` array<{kind(f)}>" for f in PRINTS)).alias("d")).select("d.*")
    rows = columns_to_rows(d, [f.name for f in PRINTS])
    return rows.select(*[(S.from_ms(f.name) if f.dataType.simpleString() == "timestamp" else F.col(f.name)).alias(f.name) for f in PRINTS])


def seconds_or_ms(c) -> Column:
    c = S.col(c)
    return F.when(c > 1e12, c).otherwise(c * 1000).cast("long")


def parse_instrument(name) -> dict[str, Column]:
    """BTC-18SEP26-83000-C -> contract, expiration (08:00 UTC), strike, type."""
    n = S.col(name)
    pattern = r"^([A-Z]+)-(\d{1,2}[A-Z]{3}\d{2})-(\d+(?:\.\d+)?)-([CP])$"
    part = lambda i: F.regexp_extract(n, pattern, i)
    day = F.lpad(part(2), 7, "0")
    date = F.try_to_timestamp(F.concat(F.substring(day, 1, 2), F.initcap(F.substring(day, 3, 3)), F.substring(day, 6, 2)), F.lit("ddMMMyy"))
    return {"underlying": F.nullif(part(1), F.lit("")), "symbol": F.when(part(2) != "", F.concat_ws("-", part(1), part(2))), "expiration": date + F.expr("INTERVAL 8 HOURS"),
            "strike": part(3).try_cast("double"), "option_type": S.option_type(part(4))}


TRADE = "trade_id string, instrument_name string, timestamp double, price double, amount double, index_price double, iv double, direction string"


def venue_trades(lines: DataFrame, source: str, value: str = "value") -> DataFrame:
    """Venue trade JSON to prints; rows without index, size or price are dropped; iv arrives in percent."""
    t = parsed(lines, F.from_json(value, TRADE))
    t = t.filter(F.col("index_price").isNotNull() & F.col("amount").isNotNull() & F.col("price").isNotNull())
    t = parsed(t, F.struct(*[c.alias(f"_{k}") for k, c in parse_instrument("instrument_name").items()]), t.columns)
    i = {k: F.col(f"_{k}") for k in ("underlying", "symbol", "expiration", "strike", "option_type")}
    t = t.filter(i["strike"].isNotNull() & i["expiration"].isNotNull())
    d = t.select(F.col("trade_id").alias("id"), S.from_ms(F.col("timestamp").cast("long")).alias("timestamp"), i["symbol"].alias("symbol"), F.col("instrument_name").alias("instrument"),
                 i["underlying"].alias("underlying"), i["expiration"].alias("expiration"), i["strike"].alias("strike"), i["option_type"].alias("option_type"), F.col("price").alias("trade_price"),
                 F.col("amount").alias("contracts"), S.aggressor("direction").alias("aggressor_side"), (F.col("iv") / 100.0).alias("implied_volatility"), F.col("index_price").alias("underlying_price"),
                 S.premium_usd_in_underlying("price", "amount", "index_price").alias("premium_usd"), F.lit(source).alias("source"))
    return d.withColumn("dte", S.dte("timestamp", "expiration")).withColumn("flow_class", S.flow_class())


def feed_trades(docs: DataFrame, offset_ms: int) -> DataFrame:
    """Columnar feed document (symbol, expiration, arrays t, strike, type, side, price, size, fills, spot) to prints.

    The clock offset is taken off time and expiry, stamps may be seconds or ms, a trade of several fills is a sweep."""
    d = columns_to_rows(docs, ["t", "strike", "type", "side", "price", "size", "fills", "spot"], ["symbol", "expiration"])
    at = lambda c: S.from_ms(seconds_or_ms(c) - offset_ms)
    d = d.select("symbol", at("t").alias("timestamp"), at("expiration").alias("expiration"), "strike", S.option_type("type").alias("option_type"), S.aggressor("side").alias("aggressor_side"),
                 F.col("price").alias("trade_price"), F.col("size").alias("contracts"), F.col("spot").alias("underlying_price"), (F.col("fills") > 1).alias("flag_sweep"))
    return d.withColumn("flow_class", S.flow_class()).withColumn("premium_usd", S.premium_usd("trade_price", "contracts", 100.0))


def feed_bars(docs: DataFrame, offset_ms: int) -> DataFrame:
    """Columnar bars; rows with a close only become flat bars."""
    d = columns_to_rows(docs, ["t", "open", "high", "low", "close", "volume"], ["series"])
    c = F.col("close")
    return d.filter(c.isNotNull()).select("series", S.from_ms(seconds_or_ms("t") - offset_ms).alias("time"), *[F.coalesce(F.col(x), c).alias(x) for x in ("open", "high", "low")], "close", "volume")


def kline_rows(lines: DataFrame, series: str, value: str = "value") -> DataFrame:
    """Kline arrays with numbers as strings: [open ms, o, h, l, c, volume, ...]."""
    a = F.from_json(value, "array<string>")
    n = lambda i: F.get(a, F.lit(i)).try_cast("double")
    return lines.select(F.lit(series).alias("series"), S.from_ms(F.get(a, F.lit(0)).try_cast("long")).alias("time"), n(1).alias("open"), n(2).alias("high"), n(3).alias("low"), n(4).alias("close"), n(5).alias("volume"))


KLINE = "k struct<t: long, s: string, o: string, h: string, l: string, c: string, v: string, x: boolean>"


def kline_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Stream messages to bars with a ``closed`` flag."""
    k = parsed(lines, F.from_json(value, KLINE)["k"])
    return k.select(F.col("s").alias("series"), S.from_ms("t").alias("time"), *[F.col(x).try_cast("double").alias(n) for x, n in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("v", "volume"))], F.col("x").alias("closed"))


# -- decision logs --------------------------------------------------------------------------------

LOG = "run string, at long, latency_ms double, book_pnl double, shadow_pnl double, transcript array<struct<agent: string, verdict: string>>"


def read_jsonl(spark, path: str, schema: str = LOG) -> DataFrame:
    return spark.read.schema(schema).json(path)


def review_runs(log: DataFrame) -> DataFrame:
    """Per run: decisions by final verdict, mean latency and book minus shadow at the newest event."""
    last = F.element_at("transcript", -1)["verdict"]
    d = log.filter(F.size("transcript") > 0).withColumn("verdict", last)
    n = lambda v: F.sum((F.col("verdict") == v).cast("int")).alias(v)
    return d.groupBy("run").agg(F.count(F.lit(1)).alias("decisions"), n("allow"), n("cut"), n("veto"), F.avg("latency_ms").alias("latency_ms"),
                                F.max_by(F.col("book_pnl") - F.col("shadow_pnl"), "at").alias("book_minus_shadow"))


def review_agents(log: DataFrame) -> DataFrame:
    d = log.select("run", F.inline("transcript"))
    return d.groupBy("run", "agent").pivot("verdict", ["allow", "cut", "veto"]).agg(F.count(F.lit(1))).na.fill(0)
