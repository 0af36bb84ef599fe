"""Samples, splits and augmentation, all by hash so that they are the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import truncate

#: A sentence of so many characters is long; so large a part of each language trains.
LONG, TRAIN_PART = 40, 0.8


def draw(key: Column | str, seed: int = 42) -> Column:
    """A hash that orders rows at random, alike in Spark and other engines."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def reservoir(docs: DataFrame, by: list[str], limit: int, key: str, seed: int = 42) -> DataFrame:
    """At most limit rows of each group, uniformly; Spark prunes to the limit before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(draw(key, seed), key))
    return docs.withColumn("__rank", rank).where(F.col("__rank") <= limit).drop("__rank")


def with_fallback(docs: DataFrame, limit: int, lang: str = "lang", text: str = "text", key: str = "doc_id", seed: int = 42) -> DataFrame:
    """At most limit rows of each language: long texts first, short ones only to fill up."""
    short = (F.length(text) < LONG).cast("int")
    rank = F.row_number().over(Window.partitionBy(lang).orderBy(short, draw(key, seed), key))
    return docs.withColumn("__rank", rank).where(F.col("__rank") <= limit).drop("__rank")


def split(docs: DataFrame, lang: str = "lang", order: Column | str = "doc_id", part: float = TRAIN_PART) -> DataFrame:
    """docs with is_train: the first floor(part * n) rows of each language in the given order."""
    place = F.row_number().over(Window.partitionBy(lang).orderBy(order))
    n = F.count("*").over(Window.partitionBy(lang))
    return docs.withColumn("is_train", place <= F.floor(n * part))


def truncated_copies(train: DataFrame, part: float, lang: str = "lang", text: str = "text", key: str = "doc_id", seed: int = 42) -> DataFrame:
    """Copies of floor(part * n) rows of each language, cut to 15 to 40 characters."""
    rank = F.row_number().over(Window.partitionBy(lang).orderBy(draw(key, seed + 1), key))
    n = F.count("*").over(Window.partitionBy(lang))
    size = (F.pmod(F.conv(F.substring(draw(key, seed + 2), 1, 7), 16, 10).cast("int"), F.lit(26)) + 15).cast("int")
    rows = train.withColumn("__rank", rank).withColumn("__n", n).where(F.col("__rank") <= F.floor(F.col("__n") * part))
    return rows.withColumn("size", size).withColumn(text, truncate(text, F.col("size"))).drop("__rank", "__n")


def with_copies(train: DataFrame, part: float, lang: str = "lang", text: str = "text", key: str = "doc_id", seed: int = 42) -> DataFrame:
    """train and its truncated copies, told apart by is_copy."""
    rows = train.withColumn("is_copy", F.lit(False))
    if part <= 0:
        return rows
    return rows.unionByName(truncated_copies(train, part, lang, text, key, seed).drop("size").withColumn("is_copy", F.lit(True)))
