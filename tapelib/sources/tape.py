"""Tape store: Parquet partitioned by day, append only, de-duplicated on read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import scalars as S
from ..schema import PRINTS, assert_schema

# fixed values: flow labels
LABELS = ("LC", "LP", "SC", "SP", "UNKNOWN")


def read_tape(spark: SparkSession, path: str) -> DataFrame:
    return _labelled(spark.read.schema(PRINTS).parquet(path))


def _labelled(d: DataFrame) -> DataFrame:
    return d.withColumn("flow_class", F.when(F.col("flow_class").isin(*LABELS), F.col("flow_class")).otherwise("UNKNOWN"))


def write_tape(prints: DataFrame, path: str) -> None:
    assert_schema(prints, PRINTS).write.option("compression", "zstd").mode("overwrite").parquet(path)


def conform(prints: DataFrame) -> DataFrame:
    """Add the missing columns of the tape schema as NULL, in order."""
    have = set(prints.columns)
    return prints.select(*[F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in PRINTS])


def append_tape(prints: DataFrame, root: str) -> None:
    """Append to date=YYYY-MM-DD directories, time sorted in each file; an empty input writes nothing.

    The rebalance gathers a day's rows and lets AQE split a heavy day over several tasks and files."""
    if prints.isEmpty():
        return
    d = assert_schema(prints, PRINTS).withColumn("date", F.to_date("timestamp"))
    d = d.hint("rebalance", "date").sortWithinPartitions("date", "timestamp", "id")
    d.write.option("compression", "zstd").partitionBy("date").mode("append").parquet(root)


def read_range(spark: SparkSession, root: str, start, stop) -> DataFrame:
    """Prints in [start, stop): day directories are pruned, the first stored copy of an id wins, time order."""
    d = spark.read.schema(T.StructType([*PRINTS.fields, T.StructField("date", T.DateType())])).parquet(root)
    d = d.filter((F.col("date") >= F.to_date(F.lit(start))) & (F.col("date") <= F.to_date(F.lit(stop))) & (F.col("timestamp") >= F.lit(start).cast("timestamp")) & (F.col("timestamp") < F.lit(stop).cast("timestamp")))
    return _first_of_id(d).orderBy("timestamp", "id")


def _first_of_id(d: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or [f.name for f in PRINTS if f.name not in ("id", "date")]
    # copies of one day differ in the file's own name only
    d = _labelled(d.withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -1)))
    d = d.groupBy("id").agg(F.min_by(F.struct(*cols), F.struct("date", "_file", "timestamp")).alias("p"))
    return d.select("id", "p.*")


def read_all(spark: SparkSession, root: str, cols: list[str] | None = None) -> DataFrame:
    """The whole store, one row an id as in :func:`read_range`, in no order; with ``cols`` only these columns beside the id, so that
    no others are shuffled."""
    return _first_of_id(spark.read.schema(T.StructType([*PRINTS.fields, T.StructField("date", T.DateType())])).parquet(root), cols)
