"""The public interface: make a detector, initialise it, detect."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.local import detect_all
from .operators.scoring import detect as detect_rows
from .operators.scoring import detect_tiered
from .plans.model import GroupModel, load
from .sources.binary import read_models

Detection = tuple[str, float]


class Detector:
    """Language detection of texts or of a DataFrame, batch or streaming."""

    def __init__(self, spark: SparkSession, sources: dict[str, str] | str | dict[str, GroupModel]):
        """sources: model files by group, a folder of model tables, or models."""
        self.spark, self.sources, self.models = spark, sources, None

    def initialize(self) -> Detector:
        if isinstance(self.sources, str):
            self.models = load(self.spark, self.sources)
        elif all(isinstance(v, GroupModel) for v in self.sources.values()):
            self.models = dict(self.sources)
        else:
            self.models = read_models(self.spark, self.sources)
        return self

    def _ready(self) -> dict[str, GroupModel]:
        if self.models is None:
            raise RuntimeError("call initialize() first")
        return self.models

    def detect(self, text: str) -> list[Detection]:
        """(language, probability) of one text, best first."""
        row = detect_rows(self.spark.createDataFrame([(text,)], "text string"), self._ready()).first()
        return [(d["lang"], d["probability"]) for d in row["detections"]]

    def detect_frame(self, docs: DataFrame, text: str = "text") -> DataFrame:
        return detect_rows(docs, self._ready(), text)

    def detect_tiered(self, docs: DataFrame, text: str = "text") -> DataFrame:
        return detect_tiered(docs, self._ready(), text)

    def register(self, name: str = "detect_language") -> None:
        """A SQL function of a text, giving its detections."""
        models = self._ready()

        @F.pandas_udf("array<struct<lang:string,probability:double>>")
        def detections(texts: pd.Series) -> pd.Series:
            return pd.Series([[{"lang": x, "probability": p} for x, p in found] for found in detect_all(texts.fillna("").tolist(), models)])

        self.spark.udf.register(name, detections)


def create(spark: SparkSession, sources) -> Detector:
    return Detector(spark, sources)
