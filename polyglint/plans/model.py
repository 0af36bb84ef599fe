"""Model tables: vocabulary, languages, weights and biases of script groups, and the training configurations."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ngrams import GramTable

#: Languages of the model groups, and the n-grams and epochs of the base configuration.
LANGS = {
    "cyrillic": ["bel", "bul", "kaz", "mkd", "rus", "srp", "ukr"],
    "arabic": ["ara", "ckb", "pes"],
    "devanagari": ["hin", "mar"],
    "latin": [
        "afr", "aze", "cat", "ces", "dan", "deu", "eng", "est", "eus", "fin", "fra", "hau", "hrv", "hun", "ind",
        "isl", "ita", "lit", "nld", "nob", "pol", "por", "ron", "run", "slk", "spa", "swe", "tgl", "tur", "vie",
    ],
}
BASE = {"cyrillic": ((250, 350, 350, 250, 0), 64), "arabic": ((100, 150, 150, 100, 0), 32), "devanagari": ((80, 120, 120, 80, 0), 32), "latin": ((200, 550, 550, 300, 0), 64)}
#: The two published experiments; sizes by group, then training options.
EXPERIMENTS = {
    "linear_mega_5g": {
        "sizes": {"cyrillic": (500, 700, 700, 500, 400), "arabic": (200, 300, 300, 200, 150), "devanagari": (150, 250, 250, 150, 100), "latin": (500, 900, 900, 700, 500)},
        "epochs": {"cyrillic": 32, "arabic": 16, "devanagari": 16},
        "train": {"label_smoothing": 0.1},
    },
    "lean_v5": {
        "prune_from": "linear_mega_5g",
        "seed": 0,
        "sizes": {"cyrillic": (130, 280, 280, 130, 0), "arabic": (25, 50, 50, 25, 0), "devanagari": (15, 30, 30, 15, 0), "latin": (165, 425, 425, 235, 90)},
        "train": {"label_smoothing": 0.1, "truncate_aug": 0.75, "focal_gamma": 2.0},
        "qat_pq": {"groups": ["latin"], "epochs": 20, "lr": 0.001, "k": 256, "d": 4, "seed": 0},
    },
}


@dataclass(frozen=True)
class Group:
    name: str
    langs: list[str]
    sizes: tuple[int, ...]
    epochs: int = 64
    batch: int = 32


@dataclass(frozen=True)
class Training:
    lr: float = 0.001
    label_smoothing: float = 0.0
    focal_gamma: float = 0.0
    data_limit: int = 9000
    truncate_aug: float = 0.0


def resolve(experiment: str, experiments: dict = EXPERIMENTS) -> tuple[dict[str, Group], Training]:
    """Groups and training options of an experiment: the base with what it overrides. An experiment may name groups of its own."""
    chosen = experiments[experiment]
    langs = chosen.get("langs", LANGS)
    groups = {g: Group(g, langs[g], *BASE.get(g, ((0, 0, 0, 0, 0), 64))) for g in langs}
    groups = {g: replace(c, sizes=chosen["sizes"].get(g, c.sizes), epochs=chosen.get("epochs", {}).get(g, c.epochs)) for g, c in groups.items()}
    return groups, Training(**chosen.get("train", {}))


@dataclass
class GroupModel:
    """A linear model: langs, vocabulary by n-gram size, weights (langs by features) and bias."""

    langs: list[str]
    vocab: dict[int, list[str]]
    weights: np.ndarray
    bias: np.ndarray
    codebook: np.ndarray | None = field(default=None)

    accuracy: float | None = field(default=None)

    @property
    def features(self) -> list[tuple[int, str]]:
        return [(n, g) for n in sorted(self.vocab) for g in self.vocab[n]]

    @cached_property
    def table(self) -> GramTable:
        """The vocabulary for look-up; made where it is used, it doesn't travel."""
        return GramTable([g for _, g in self.features])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "table"}


def to_tables(spark: SparkSession, models: dict[str, GroupModel]) -> dict[str, DataFrame]:
    """The models as small tables: vocab, langs (with biases), weights, codebooks and accuracies."""
    vocab = [(g, n, k, gram) for g, m in models.items() for k, (n, gram) in enumerate(m.features)]
    langs = [(g, k, x, float(m.bias[k])) for g, m in models.items() for k, x in enumerate(m.langs)]
    weights = [(g, k, j, float(w)) for g, m in models.items() for k, row in enumerate(m.weights) for j, w in enumerate(row)]
    books = [(g, k, [float(x) for x in row]) for g, m in models.items() if m.codebook is not None for k, row in enumerate(m.codebook)]
    return {
        "vocab": spark.createDataFrame(vocab, "grp string, n int, idx int, gram string"),
        "langs": spark.createDataFrame(langs, "grp string, lang_idx int, lang string, bias double"),
        "weights": spark.createDataFrame(weights, "grp string, lang_idx int, idx int, w double"),
        "codebook": spark.createDataFrame(books, "grp string, centroid_id int, c array<double>"),
        "accuracy": spark.createDataFrame([(g, m.accuracy) for g, m in models.items()], "grp string, accuracy double"),
    }


def save(spark: SparkSession, models: dict[str, GroupModel], folder: str) -> None:
    for name, df in to_tables(spark, models).items():
        df.write.mode("overwrite").partitionBy("grp").parquet(f"{folder}/{name}")


def _read(spark: SparkSession, folder: str, name: str, groups: list[str] | None) -> DataFrame:
    schema = {
        "vocab": "n int, idx int, gram string", "langs": "lang_idx int, lang string, bias double", "weights": "lang_idx int, idx int, w double", "codebook": "centroid_id int, c array<double>", "accuracy": "accuracy double",
    }[name]
    rows = spark.read.schema(f"{schema}, grp string").parquet(f"{folder}/{name}")
    return rows if groups is None else rows.where(F.col("grp").isin(groups))


def load_vocabs(spark: SparkSession, folder: str, groups: list[str] | None = None) -> dict[str, dict[int, list[str]]]:
    """The vocabularies alone of a folder of model tables, by group and size; only groups that are asked for are read."""
    out: dict[str, dict[int, list[str]]] = {}
    for r in _read(spark, folder, "vocab", groups).orderBy("grp", "idx").collect():
        out.setdefault(r["grp"], {}).setdefault(r["n"], []).append(r["gram"])
    return out


def load(spark: SparkSession, folder: str, groups: list[str] | None = None) -> dict[str, GroupModel]:
    """Models as they were saved. They are small (the shipped size is 46,612 parameters), so they are collected."""
    vocabs = load_vocabs(spark, folder, groups)
    rows = {name: _read(spark, folder, name, groups).collect() for name in ("langs", "weights", "codebook", "accuracy")}
    own = lambda name, g: [r for r in rows[name] if r["grp"] == g]
    out = {}
    for g in sorted({r["grp"] for r in rows["langs"]}):
        names = sorted(own("langs", g), key=lambda r: r["lang_idx"])
        vocab = vocabs.get(g, {})
        w = np.zeros((len(names), sum(map(len, vocab.values()))))
        for r in own("weights", g):
            w[r["lang_idx"], r["idx"]] = r["w"]
        book = sorted(own("codebook", g), key=lambda r: r["centroid_id"])
        accuracy = [r["accuracy"] for r in own("accuracy", g)]
        out[g] = GroupModel([r["lang"] for r in names], vocab, w, np.array([r["bias"] for r in names]), np.array([r["c"] for r in book]) if book else None, accuracy[0] if accuracy else None)
    return out


def average(models: list[GroupModel]) -> GroupModel:
    """The mean of models of different seeds; their languages and vocabularies must be the same."""
    if any(m.langs != models[0].langs or m.vocab != models[0].vocab for m in models):
        raise ValueError("models differ in languages or vocabulary")
    known = [m.accuracy for m in models if m.accuracy is not None]
    return GroupModel(models[0].langs, models[0].vocab, np.mean([m.weights for m in models], axis=0), np.mean([m.bias for m in models], axis=0), None, float(np.mean(known)) if known else None)
