"""Minute bars of a live quote stream, kept in keyed state: bars are handed out once, when the next minute begins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import scalars as S

MINUTE_MS = 60_000
#: A minute that begins later than this after the one before it leaves a hole to fetch again.
BREAK_MS = 2 * MINUTE_MS
#: Complete minutes handed to a reader.
RING_MINUTES = 720

_BAR = ["minute", "open", "high", "low", "close", "ticks", "spread"]
_COUNTS = ["late", "bad", "repeated"]
OUTPUT = "series string, kind string, minute long, open double, high double, low double, close double, ticks long, spread double, gap_from long, late long, bad long, repeated long, last_ms long"


class MinuteFold(StatefulProcessor):
    """State of one series: the last accepted quote, the forming minute and what was refused.

    A quote older than the last accepted one is counted as late, one without numbers as bad, one equal to the last accepted
    as repeated; none of the three changes a bar.  Lateness is judged against the series' own quotes, not against a watermark, so
    a series that is behind the others loses nothing.  A batch's quotes are put in order of (milliseconds, event_id) first; a
    minute opens and closes with the first and last accepted quote of the exact time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ms long, bid double, ask double")
        self.forming = handle.getValueState("forming", "minute long, open double, high double, low double, close double, ticks long, spread double, opened_us long, opened_seq long, closed_us long, closed_seq long")
        self.counts = handle.getValueState("counts", "late long, bad long, repeated long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        d = pd.concat(list(rows), ignore_index=True)
        last, forming = self.last.get(), self.forming.get()
        late, bad, repeated = self.counts.get() or (0, 0, 0)
        good = d["bid"].notna() & d["ask"].notna()
        bad += int((~good).sum())
        d = d[good].sort_values(["ms", "seq"], kind="stable")
        if last is not None:
            old = d["ms"] < last[0]
            late += int(old.sum())
            d = d[~old]
        bid, ask = d["bid"].to_numpy(dtype=float), d["ask"].to_numpy(dtype=float)
        same = np.zeros(len(d), dtype=bool)
        same[1:] = (bid[1:] == bid[:-1]) & (ask[1:] == ask[:-1])
        if len(d) and last is not None:
            same[0] = bid[0] == last[1] and ask[0] == last[2]
        repeated += int(same.sum())
        ms, us, seq = (d[c].to_numpy(dtype=np.int64)[~same] for c in ("ms", "us", "seq"))
        bid, ask = bid[~same], ask[~same]
        out = []
        if len(ms):
            self.last.update((int(ms[-1]), float(bid[-1]), float(ask[-1])))
            mid, minute = (bid + ask) / 2, ms // MINUTE_MS * MINUTE_MS
            starts = np.flatnonzero(np.append(True, minute[1:] != minute[:-1]))
            ends = np.append(starts[1:], len(ms)) - 1
            exact = np.lexsort((seq, us, minute))
            first, final = exact[starts], exact[ends]
            bars = zip(minute[starts].tolist(), mid[first].tolist(), np.maximum.reduceat(mid, starts).tolist(), np.minimum.reduceat(mid, starts).tolist(), mid[final].tolist(),
                       (ends - starts + 1).tolist(), np.add.reduceat(ask - bid, starts).tolist(), us[first].tolist(), seq[first].tolist(), us[final].tolist(), seq[final].tolist())
            for bar in bars:
                if forming is not None and forming[0] == bar[0]:
                    a, z = min(forming, bar, key=lambda b: b[7:9]), max(bar, forming, key=lambda b: b[9:11])
                    forming = (bar[0], a[1], max(forming[2], bar[2]), min(forming[3], bar[3]), z[4], forming[5] + bar[5], forming[6] + bar[6], *a[7:9], *z[9:11])
                    continue
                if forming is not None:
                    out.append(("closed", *forming[:7], None))
                    if bar[0] - forming[0] > BREAK_MS:
                        out.append(("gap", bar[0], *[None] * 6, forming[0]))
                forming = bar
            self.forming.update(tuple(forming))
        self.counts.update((late, bad, repeated))
        out.append(("forming", *(forming[:7] if forming else [None] * 7), None))
        out = pd.DataFrame(out, columns=["kind", *_BAR, "gap_from"])
        out = out.assign(series=key[0], late=late, bad=bad, repeated=repeated, last_ms=int(ms[-1]) if len(ms) else (last[0] if last else None))
        kinds = {"minute": "Int64", "ticks": "Int64", "gap_from": "Int64", "last_ms": "Int64"} | {c: "float64" for c in _BAR[1:5] + _BAR[6:]}
        yield out.astype(kinds)[[c.split(" ")[0] for c in OUTPUT.split(", ")]]

    def close(self) -> None:
        pass


def fold_minutes(quotes: DataFrame) -> DataFrame:
    """Rows ``closed`` (a complete minute, once), ``gap`` (a hole before ``minute``, since ``gap_from``, once) and ``forming`` (the
    minute so far and the counts, for each series of a batch).  Use it with ``update`` output.

    A column ``us`` may hold the exact time of quotes whose ``time`` is a clock in milliseconds.  A series' quotes of one batch meet in one task, so bound batches by the source's options; its state is three rows."""
    q = quotes.select("series", S.ms("time").alias("ms"), "bid", "ask", (F.col("event_id") if "event_id" in quotes.columns else F.lit(0)).cast("long").alias("seq"),
                      F.col("us") if "us" in quotes.columns else F.unix_micros("time").alias("us"))
    return q.groupBy("series").transformWithStateInPandas(statefulProcessor=MinuteFold(), outputStructType=OUTPUT, outputMode="Update", timeMode="None")


def collect_live_minutes(quotes: DataFrame, root: str, checkpoint: str, every: str | None = None):
    """Run :func:`fold_minutes` into a folder per batch; a batch that runs twice replaces itself."""
    quotes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def write(batch: DataFrame, number: int):
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")
    w = fold_minutes(quotes).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def _rows(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("basePath", root).schema(OUTPUT + ", batch long").parquet(f"{root}/batch=*")


def closed_minutes(spark: SparkSession, root: str, newest: int | None = None) -> DataFrame:
    """Complete minutes; with ``newest`` (see ``RING_MINUTES``) only so many of each series."""
    d = _rows(spark, root).filter("kind = 'closed'")
    if newest is not None:
        from pyspark.sql import Window
        d = d.withColumn("_r", F.row_number().over(Window.partitionBy("series").orderBy(F.desc("minute")))).filter(F.col("_r") <= newest)
    return d.select("series", S.from_ms("minute").alias("time"), "open", "high", "low", "close", "ticks", (F.col("spread") / F.col("ticks")).alias("spread"))


def forming_minutes(spark: SparkSession, root: str) -> DataFrame:
    """The forming minute of each series with its counts of late, bad and repeated quotes up to now."""
    d = _rows(spark, root).filter("kind = 'forming'")
    d = d.groupBy("series").agg(F.max_by(F.struct(*[c for c in d.columns if c not in ("series", "batch", "kind", "gap_from")]), "batch").alias("f"))
    return d.select("series", "f.*")


def repair_ranges(spark: SparkSession, root: str) -> DataFrame:
    """Holes to fetch again: the minutes before and after each."""
    return _rows(spark, root).filter("kind = 'gap'").select("series", S.from_ms("gap_from").alias("after"), S.from_ms("minute").alias("before"))
