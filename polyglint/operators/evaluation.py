"""Accuracy by language and overall, and short-text test sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncate

#: Lengths of the short-text test.
SHORT = (20, 30, 40)


def accuracy(rows: DataFrame, by: list[str], expected: str = "lang", found: str = "pred") -> DataFrame:
    """(by..., total, pass, acc): acc in hundredths, 4 places; a null prediction is wrong."""
    right = F.coalesce((F.col(expected) == F.col(found)).cast("int"), F.lit(0))
    grouped = rows.groupBy(*by) if by else rows.groupBy()
    return grouped.agg(F.count("*").alias("total"), F.coalesce(F.sum(right), F.lit(0)).alias("pass")).withColumn("acc", F.round(F.try_divide(100 * F.col("pass"), F.col("total")), 4))


def imperfect(by_lang: DataFrame) -> DataFrame:
    """Languages below 100, worst first."""
    return by_lang.where("acc < 100").orderBy("acc", "lang")


def short_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each row cut to each length of SHORT, in a column size."""
    return docs.withColumn("size", F.explode(F.array(*map(F.lit, SHORT)))).withColumn(text, truncate(text, F.col("size")))


def compare(rows: DataFrame, detectors: list[str], expected: str = "lang") -> DataFrame:
    """(detector, lang, total, pass, acc) for several columns of predictions over the same rows."""
    long = rows.select(expected, F.explode(F.array(*[F.struct(F.lit(d).alias("detector"), F.col(d).alias("pred")) for d in detectors])).alias("d")).select(expected, "d.detector", "d.pred")
    return accuracy(long, ["detector", expected], expected)


def first_seen(rows: DataFrame, lang: str = "lang", order: str = "doc_id") -> DataFrame:
    """(lang, first): each language once, with the place where it is first seen, in that order."""
    return rows.where(F.col(lang).isNotNull()).groupBy(lang).agg(F.min(order).alias("first")).orderBy("first", lang)
