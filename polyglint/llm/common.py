"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the controls from tab to carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"
#: A key that holds more than this share of all rows is looked up in a broadcast table; there are at most 2000 of them.
HEAVY_SHARE = 1 / 2000
#: Narrow tables are broadcast up to so many rows, some ten megabytes.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, spark.checkpoint.dir; a local session without one gets a folder of its own."""
    context = spark.sparkContext
    if (folder := context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)) is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes df to the cluster's shared folder and cuts its lineage there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of DataFrames that are gone; it follows the driver's garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df (few narrow columns, counted cheaply) marked for broadcast if it has at most so many rows; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def plain_name(df: DataFrame, wanted: str) -> str:
    """wanted, with underscores in front until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def heavy_join(left: DataFrame, right: DataFrame, on: Sequence[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """left joined with right, whose keys are unique and whose column `weight` counts the left rows of a key.

    Keys with more than HEAVY_SHARE of the `total` left rows cannot be more than 1 / HEAVY_SHARE, so that part of
    right is broadcast and no hot key is shuffled. All other keys take the shuffle join, which AQE may refine.
    how: inner or left.
    """
    on = list(on)
    limit = max(1.0, total * HEAVY_SHARE)
    mark = plain_name(left, plain_name(right, "__heavy"))
    extra = [c for c in right.columns if c not in on]
    hot = F.broadcast(right.where(F.col(weight) > limit).select(*on, F.struct(*extra).alias(mark)))
    # left is read once for each part, and is best a checkpoint; only rows without a hot key go through the shuffle
    tagged = left.join(hot, on, "left")
    first = tagged.where(F.col(mark).isNotNull()).select(*left.columns, *[F.col(f"{mark}.{c}").alias(c) for c in extra])
    cold = tagged.where(F.col(mark).isNull()).select(*left.columns)
    rest = cold.join(right.where(F.col(weight) <= limit), on, how).select(*left.columns, *extra)
    return first.unionByName(rest)


def words(text: Column | str) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    text = F.col(text) if isinstance(text, str) else text
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(GAP_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))


def crc_rest(column: Column | str, modulus: int) -> Column:
    """crc32 of a value as text, modulo; a null counts as the empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus
