"""Detection over streams: scoring is row by row, so the batch plan serves; windows count languages as they pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scoring import detect
from ..plans.model import GroupModel


def detect_stream(docs: DataFrame, models: dict[str, GroupModel], text: str = "text") -> DataFrame:
    """A streaming DataFrame with the best language of each row."""
    found = detect(docs, models, text)
    return found.withColumn("lang_pred", F.get("detections", F.lit(0))["lang"])


def languages_by_window(found: DataFrame, ts: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Rows by window and predicted language; rows later than the watermark are left out."""
    return found.withWatermark(ts, late).groupBy(F.window(ts, window), "lang_pred").agg(F.count("*").alias("n"))
