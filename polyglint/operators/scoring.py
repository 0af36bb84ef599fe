"""Scoring of texts by linear n-gram models, and detection by script and model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scripts
from ..functions.ngrams import batched, explode_grams, kept_schema
from ..functions.text import normalize
from ..plans.model import GroupModel

DETECTIONS = "array<struct<lang:string,probability:double>>"


def softmax(logits: np.ndarray) -> np.ndarray:
    shifted = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return shifted / shifted.sum(axis=-1, keepdims=True)


def frequency_matrix(texts: list[str], model: GroupModel) -> np.ndarray:
    """(texts, features): relative frequencies of the vocabulary's n-grams; all n-grams of a text are its measure."""
    out = np.zeros((len(texts), model.weights.shape[1]), np.float64)
    row, place, many = model.table.counts(texts)
    sizes, lengths = np.array([n for n, _ in model.features], np.int64), np.array([len(t) for t in texts], np.int64)
    out[row, place] = many / (lengths[row] - sizes[place] + 1)
    return out


def linear(texts: list[str], model: GroupModel) -> np.ndarray:
    """(texts, languages): the model's logits, from the n-grams that occur alone; sums go by size, then over sizes in order."""
    row, place, many = model.table.counts(texts)
    sizes, lengths = np.array([n for n, _ in model.features], np.int64), np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), len(model.langs)))
    for n in sorted(model.vocab):
        own = sizes[place] == n
        for k, w in enumerate(model.weights):
            out[:, k] += np.bincount(row[own], many[own] * w[place[own]], len(texts)) / np.maximum(lengths - n + 1, 1)
    return out + model.bias


def probabilities(models: dict[str, GroupModel]):
    """A pandas UDF: normalised text and group to detections in the order of the group's languages."""

    @F.pandas_udf(DETECTIONS)
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, groups in batches:
            out: list = [None] * len(texts)
            for name in groups.dropna().unique():
                model = models.get(name)
                rows = np.flatnonzero((groups == name).to_numpy() & texts.notna().to_numpy())
                for a in range(0, len(rows) if model else 0, 500):
                    part = rows[a : a + 500]
                    found = softmax(linear(texts.iloc[part].tolist(), model))
                    for k, p in zip(part, found, strict=True):
                        out[k] = [{"lang": x, "probability": float(v)} for x, v in zip(model.langs, p, strict=True)]
            yield pd.Series(out)

    return score


def _ordered(found: Column) -> Column:
    """By probability, descending; equal ones stay as they stand."""
    marked = F.transform(found, lambda x, k: F.struct((-x["probability"]).alias("p"), k.alias("k"), x.alias("x")))
    return F.transform(F.array_sort(marked), lambda m: m["x"])


def _scaled(found: str, share: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["lang"].alias("lang"), (x["probability"] * share).alias("probability")))


def detect(docs: DataFrame, models: dict[str, GroupModel], text: str = "text") -> DataFrame:
    """docs with detections (lang, probability), best first, and fallback: whether no character was classified.

    Every script in the text speaks for its share: unique scripts and CJK directly, the others through their group's
    model on the whole text. Groups without a model are passed over; without anything else the Latin model decides. Null
    texts count as empty. The scoring is row by row, so a streaming DataFrame works as well.
    """
    if "latin" not in models:
        raise ValueError("the latin model is needed as the fallback")
    own = [c for c in docs.columns if c not in ("detections", "fallback")]
    score = probabilities(models)
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(*own, *[c.alias(f"__{f}") for f, c in zip(scripts.FAMILIES, scripts.histogram(raw), strict=True)], normalize(raw).alias("__norm"))
    inner = rows.withColumnsRenamed({f"__{f}": f"__h_{f}" for f in scripts.FAMILIES})
    total = sum((F.col(f"__h_{f}") for f in scripts.FAMILIES), F.lit(0))
    share = lambda f: F.try_divide(F.col(f"__h_{f}"), total)
    parts = [F.when(F.col(f"__h_{f}") > 0, F.array(F.struct(F.lit(x).alias("lang"), share(f).alias("probability")))) for f, x in scripts.UNIQUE.items()]
    parts.append(F.when(F.col("__h_cjk_kana") > 0, F.array(F.struct(F.lit("jpn").alias("lang"), share("cjk_kana").alias("probability")))))
    parts.append(F.when((F.col("__h_cjk_han") > 0) & (F.col("__h_cjk_kana") == 0), F.array(F.struct(F.lit("cmn").alias("lang"), share("cjk_han").alias("probability")))))
    for g in scripts.GROUPS:
        if g in models:
            inner = inner.withColumn(f"__p_{g}", score(F.when(F.col(f"__h_{g}") > 0, F.col("__norm")), F.lit(g)))
            parts.append(_scaled(f"__p_{g}", share(g)))
    empty = F.array().cast(DETECTIONS)
    found = F.flatten(F.array(*[F.coalesce(p, empty) for p in parts]))
    inner = inner.withColumn("__found", found).withColumn("__fall", score(F.when(F.size("__found") == 0, F.col("__norm")), F.lit("latin")))
    out = F.when(F.size("__found") == 0, F.col("__fall")).otherwise(F.col("__found"))
    return inner.select(*own, _ordered(out).alias("detections"), (total == 0).alias("fallback"))


def detect_tiered(docs: DataFrame, models: dict[str, GroupModel], text: str = "text") -> DataFrame:
    """docs with lang_tiered: the first script that decides, else the best language of the group it leads to."""
    own = [c for c in docs.columns if c != "lang_tiered"]
    route = scripts.tiered_route(F.col(text).cast("string"))
    group = F.when(route.startswith("group:"), F.substring(route, 7, 20))
    found = _ordered(probabilities(models)(normalize(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.col("__group")))
    rows = docs.select(*own, route.alias("__route"), group.alias("__group")).withColumn("__found", found)
    return rows.select(*own, F.when(F.col("__group").isNull(), F.col("__route")).otherwise(F.get("__found", F.lit(0))["lang"]).alias("lang_tiered"))


def logits(docs: DataFrame, model: GroupModel, keep: list[str], text: str = "norm") -> DataFrame:
    """(keep..., lang, lang_idx, logit) for each row and language; a row without any n-gram of the model has the biases.

    Nothing is shuffled: a row's n-grams are looked up in its task. Null texts count as empty.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batched(batches, len(keep)):
            found = linear(texts, model)
            row, lang = np.indices(found.shape).reshape(2, -1)
            columns = [batch.column(k).take(pa.array(row)) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(model.langs).take(pa.array(lang)), pa.array(lang.astype(np.int32)), pa.array(found.ravel())], [*keep, "lang", "lang_idx", "logit"])

    return docs.select(*keep, text).mapInArrow(score, f"{kept_schema(docs, keep)}, lang string, lang_idx int, logit double")


def ranked(docs: DataFrame, model: GroupModel, keep: list[str], text: str = "norm") -> DataFrame:
    """(keep..., found): for each row an array of (lang, lang_idx, logit, probability), by logit descending, then lang_idx.

    Ranks go by what the model gives, not by rounded values. One row in, one row out, without a shuffle.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lang", pa.string()), ("lang_idx", pa.int32()), ("logit", pa.float64()), ("probability", pa.float64())]))
        for batch, texts in batched(batches, len(keep)):
            found = linear(texts, model)
            p, order = softmax(found), np.argsort(-found, axis=1, kind="stable")
            out = [[{"lang": model.langs[k], "lang_idx": k, "logit": x[k], "probability": y[k]} for k in o] for o, x, y in zip(order.tolist(), found.tolist(), p.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keep))], pa.array(out, kind)], [*keep, "found"])

    return docs.select(*keep, text).mapInArrow(score, f"{kept_schema(docs, keep)}, found array<struct<lang:string,lang_idx:int,logit:double,probability:double>>")


def relational_logits(docs: DataFrame, vocab: DataFrame, langs: DataFrame, weights: DataFrame, keep: list[str], text: str = "norm") -> DataFrame:
    """(keep..., lang, lang_idx, logit) by joins, for small tables: n-grams meet the vocabulary, then its weights.

    Every n-gram becomes a row that is shuffled by document; logits() gives the same without. vocab: (n, idx, gram);
    langs: (lang_idx, lang, bias); weights: (lang_idx, idx, w). All three are bounded by the model's configuration and
    broadcast.
    """
    sizes = sorted(r["n"] for r in vocab.select("n").distinct().collect())
    sized = docs.select(*keep, text, F.length(text).alias("__length"))
    rows = explode_grams(sized, [*keep, "__length"], text, sizes).join(F.broadcast(vocab), ["n", "gram"])
    counts = rows.groupBy(*keep, "n", "idx", "__length").agg(F.count("*").alias("cnt")).withColumn("all", F.col("__length") - F.col("n") + 1)
    sums = counts.join(F.broadcast(weights), "idx").groupBy(*keep, "lang_idx", "n", "all").agg(F.sum(F.col("cnt") * F.col("w")).alias("s"))
    by_lang = sums.groupBy(*keep, "lang_idx").agg(*[F.max(F.when(F.col("n") == n, F.col("s") / F.col("all"))).alias(f"s{n}") for n in sizes])
    every = docs.select(*keep).crossJoin(F.broadcast(langs))
    logit = sum((F.coalesce(f"s{n}", F.lit(0.0)) for n in sizes), F.lit(0.0)) + F.col("bias")
    return every.join(by_lang, [*keep, "lang_idx"], "left").select(*keep, "lang", "lang_idx", logit.alias("logit"))
