"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which driver and executors share.

    Only a session that names none (a local test) gets a folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not named and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder, with no lineage behind them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions; bucket counts follow it, so they grow with the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` of Parquet files with a column ``name``: 0, 1, 2, ... in the order of the files.

    A row is told by its file and its place there, so its number is the same in every reading, however the
    files are split, and rows that are alike in all columns have numbers of their own. Rows that come from
    elsewhere are written to the shared folder first. One row for each input file is broadcast;
    the driver lists the same files to plan any scan of them.
    """
    try:
        place = rows.metadataColumn("_metadata")
        placed = rows.select("*", place["file_path"].alias("_file"), place["row_index"].alias("_index"))
    except AnalysisException:
        path = f"{shared_folder(rows.sparkSession)}/rows-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return numbered(rows.sparkSession.read.schema(rows.schema).parquet(path), name)
    files = placed.groupBy("_file").agg((F.max("_index") + 1).alias("_rows"))
    before = F.sum("_rows").over(W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1))  # a row per file
    files = files.select("_file", F.coalesce(before, F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(files), "_file").select(*rows.columns, (F.col("_before") + F.col("_index")).alias(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sampled(df: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows at most, chosen by a hash of ``key``; all rows of a smaller table.

    The same rows come at every run, from any partitioning.
    """
    total = df.count()
    if total <= bound:
        return df
    steps = 1 << 30
    hashed = F.pmod(F.xxhash64(F.lit(77), F.col(key)), F.lit(steps))
    return df.filter(hashed < int(steps * bound / total))
