"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Unset, a local session gets a folder of its own; a cluster is refused,
    since its executors could not see such a folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="tapelib-llm-"))
    return "file://" + _local[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages re-read files after a lost executor.  A filter on
    the columns ``by`` reads the files of those values alone."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder URI; works for every scheme pyarrow knows."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def put_file(uri: str, name: str, write) -> None:
    """Write one file through ``write(stream)``: under a name of this attempt first, then moved, so that a second
    attempt of a lost task replaces the whole file."""
    fs, folder = open_fs(uri)
    fs.create_dir(folder, recursive=True)
    temporary = posixpath.join(folder, f".{name}.{uuid.uuid4().hex}")
    with fs.open_output_stream(temporary) as out:
        write(out)
    fs.move(temporary, posixpath.join(folder, name))
