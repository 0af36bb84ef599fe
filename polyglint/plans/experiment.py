"""Running an experiment: data, vocabularies, training, pruning, quantisation-aware tuning, and what comes of it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..operators import sampling, vocabulary
from ..sources.binary import size_estimate
from .model import EXPERIMENTS, Group, GroupModel, Training, load_vocabs, resolve, save, to_tables
from .trainer import fit_groups, tune_groups

SIZES = (1, 2, 3, 4, 5)


@dataclass
class Outcome:
    """Models by group, and each one's mean loss by epoch."""

    models: dict[str, GroupModel]
    losses: dict[str, list[float]] = field(default_factory=dict)

    def report(self, spark: SparkSession) -> DataFrame:
        """(grp, langs, features, params, accuracy, size): what was trained, with bytes in the compact format."""
        rows = [(g, len(m.langs), len(m.features), int(m.weights.size + m.bias.size), m.accuracy, size_estimate(m)) for g, m in self.models.items()]
        return spark.createDataFrame(rows, "grp string, langs long, features long, params long, accuracy double, size long")

    def loss_rows(self, spark: SparkSession) -> DataFrame:
        """(grp, epoch, loss), epochs from 1 on."""
        rows = [(g, k + 1, x) for g, own in self.losses.items() for k, x in enumerate(own)]
        return spark.createDataFrame(rows, "grp string, epoch long, loss double")


def languages(groups: dict[str, Group]) -> list[str]:
    """The groups' languages, each once, in the order in which they are first seen."""
    return list(dict.fromkeys(x for g in groups.values() for x in g.langs))


def prepare(corpus: DataFrame, how: Training) -> DataFrame:
    """(lang, norm, is_train) of a corpus (lang, text, source_ord, pos): the first part of each language trains, together
    with truncated copies of a share of it; the rest tests."""
    place = F.struct("source_ord", F.col("pos").cast("string"))
    rows = sampling.split(corpus.where("text IS NOT NULL AND lang IS NOT NULL"), order=place)
    train = rows.where("is_train").select("lang", "text", F.concat_ws("/", "source_ord", "pos").alias("key"))
    train = sampling.with_copies(train, how.truncate_aug, key="key").select("lang", "text", F.lit(True).alias("is_train"))
    both = train.unionByName(rows.where("NOT is_train").select("lang", "text", "is_train"))
    return both.select("lang", normalize("text").alias("norm"), "is_train")


def choose(corpus: DataFrame, groups: dict[str, Group]) -> dict[str, dict[int, list[str]]]:
    """Each group's vocabulary, taken from its languages in turn, from counts over the whole corpus (lang, text)."""
    counts = vocabulary.corpus_counts(corpus.select("lang", normalize("text").alias("norm"))).persist()
    out = {g: vocabulary.round_robin(counts, c.langs, dict(zip(SIZES, c.sizes, strict=False))) for g, c in groups.items()}
    counts.unpersist()
    return out


def pruned(spark: SparkSession, models: dict[str, GroupModel], groups: dict[str, Group]) -> dict[str, dict[int, list[str]]]:
    """The n-grams of most weight of each wide model, as many as its group has now, in their old order."""
    out = {}
    for g, m in models.items():
        tables = to_tables(spark, {g: m})
        kept = vocabulary.prune(tables["weights"], tables["vocab"], dict(zip(SIZES, groups[g].sizes, strict=False))).orderBy("idx").collect()
        out[g] = {n: [r["gram"] for r in kept if r["n"] == n] for n in SIZES}
    return out


def train(corpus: DataFrame, groups: dict[str, Group], how: Training, vocabs: dict[str, dict[int, list[str]]] | None = None, seed: int = 0) -> Outcome:
    """One phase: all groups over a corpus, with given vocabularies or ones of their own."""
    corpus = corpus.where(F.col("lang").isin(languages(groups)))
    models, losses = fit_groups(prepare(corpus, how), groups, vocabs or choose(corpus, groups), how, seed)
    return Outcome(models, losses)


def run(spark: SparkSession, corpus, experiment: str, preset: str | None = None, seed: int | None = None, folder: str | None = None, experiments: dict = EXPERIMENTS) -> Outcome:
    """An experiment from data to models.

    corpus: a function of (languages, sentences for each) to (lang, text, source_ord, pos), as sources.corpora.merged with
    its folder bound. preset: a folder of model tables whose vocabularies are taken; else, if the experiment prunes
    another one, that is trained first and its n-grams of most weight are taken. Models are put in byte order, tuned under
    product quantisation where the experiment says so, and written to folder as tables, if there is one.
    """
    chosen, (groups, how) = experiments[experiment], resolve(experiment, experiments)
    seed = seed if seed is not None else chosen.get("seed", 0)
    data = corpus(languages(groups), how.data_limit)
    vocabs = None
    if preset is not None:
        vocabs = load_vocabs(spark, preset)
        if missing := set(groups) - set(vocabs):
            raise ValueError(f"the preset lacks groups: {', '.join(sorted(missing))}")
    elif "prune_from" in chosen:
        wide, wide_how = resolve(chosen["prune_from"], experiments)
        vocabs = pruned(spark, train(data, wide, wide_how, seed=seed).models, groups)
    out = train(data, groups, how, vocabs, seed)
    out.models = {g: vocabulary.canonical(m) for g, m in out.models.items()}
    if quantised := chosen.get("qat_pq"):
        options = {k: v for k, v in quantised.items() if k != "groups"}
        out.models |= tune_groups(prepare(data, how), {g: out.models[g] for g in quantised["groups"] if g in out.models}, how, **options)
    if folder is not None:
        save(spark, out.models, folder)
    return out
