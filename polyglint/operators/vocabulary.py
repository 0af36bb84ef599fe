"""Vocabularies: corpus counts of n-grams, their selection, and features of documents over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ngrams import SIZES, GramTable, batched, group_counts, kept_schema
from ..plans.model import GroupModel


def corpus_counts(docs: DataFrame, lang: str = "lang", text: str = "norm", sizes=SIZES) -> DataFrame:
    """(lang, n, gram, cnt): how often each n-gram occurs in each language; batches are summed before the shuffle."""
    return group_counts(docs.select(F.col(lang).alias("lang"), F.col(text).alias("norm")), "lang", "norm", sizes)


def top_grams(counts: DataFrame, k: int) -> DataFrame:
    """counts with rank, for the k most frequent n-grams of each language and size; ties go by gram."""
    rank = F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("cnt"), "gram"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def round_robin(counts: DataFrame, langs: list[str], limits: dict[int, int]) -> dict[int, list[str]]:
    """For each size limits[n] n-grams, taken from the languages in turn, each giving its most frequent one not yet taken.

    No language is asked for more than its first `limit`, so only these rows come to the driver, for all sizes at once.
    """
    limit = F.coalesce(*[F.when(F.col("n") == n, F.lit(k)) for n, k in limits.items()], F.lit(0))
    ranked = top_grams(counts.where(F.col("lang").isin(langs)), max(limits.values(), default=0)).where(F.col("rank") <= limit)
    queues: dict[tuple[int, str], list[str]] = {}
    for row in ranked.orderBy("n", "lang", "rank").toLocalIterator():
        queues.setdefault((row["n"], row["lang"]), []).append(row["gram"])
    return {n: _in_turn([queues.get((n, x), []) for x in langs], k) for n, k in limits.items()}


def _in_turn(queues: list[list[str]], limit: int) -> list[str]:
    turns, taken = [iter(q) for q in queues], {}
    while turns and len(taken) < limit:
        still = []
        for turn in turns:
            gram = next((g for g in turn if g not in taken), None)
            if gram is not None and len(taken) < limit:
                taken[gram] = None
                still.append(turn)
        turns = still
    return list(taken)


def prune(weights: DataFrame, vocab: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """vocab's rows of largest L1 weight over languages: the first sizes[n] for each size, with new places in order."""
    importance = weights.groupBy("grp", "idx").agg(F.sum(F.abs("w")).alias("importance"))
    rank = F.row_number().over(Window.partitionBy("grp", "n").orderBy(F.desc("importance"), "idx"))
    limit = F.coalesce(*[F.when(F.col("n") == n, F.lit(k)) for n, k in sizes.items()], F.lit(0))
    kept = vocab.join(importance, ["grp", "idx"]).withColumn("rank", rank).where(F.col("rank") <= limit)
    place = F.row_number().over(Window.partitionBy("grp").orderBy("idx")) - 1
    return kept.select("grp", "n", place.alias("idx"), "gram", F.round("importance", 6).alias("importance"))


def canonical(model: GroupModel) -> GroupModel:
    """The same model with each size's n-grams in UTF-8 byte order."""
    order, at, vocab = [], 0, {}
    for n in sorted(model.vocab):
        ranked = sorted(range(len(model.vocab[n])), key=lambda k: model.vocab[n][k].encode())  # noqa: B023
        vocab[n] = [model.vocab[n][k] for k in ranked]
        order += [at + k for k in ranked]
        at += len(ranked)
    return GroupModel(model.langs, vocab, model.weights[:, np.array(order, int)], model.bias, model.codebook, model.accuracy)


def coverage(docs: DataFrame, vocab: list[str], keep: list[str], text: str = "norm", sizes=SIZES) -> DataFrame:
    """(keep..., n, hits, total): n-grams of each row that the vocabulary has, and all; rows stay where they are.

    The vocabulary is bounded by its configuration and goes along with the tasks. Sizes that a text is too short for have no row.
    """
    sizes = sorted(sizes)
    lengths = np.array([len(g) for g in vocab], np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = GramTable(vocab)
        for batch, texts in batched(batches, len(keep)):
            row, place, many = table.counts(texts)
            for n in sizes:
                own = lengths[place] == n
                hits = np.bincount(row[own], many[own], len(texts)).astype(np.int64)
                total = np.array([len(t) - n + 1 for t in texts], np.int64)
                some = np.flatnonzero(total > 0)
                columns = [batch.column(k).take(pa.array(some)) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(some), n), pa.int32()), pa.array(hits[some]), pa.array(total[some])], [*keep, "n", "hits", "total"])

    return docs.select(*keep, text).mapInArrow(count, f"{kept_schema(docs, keep)}, n int, hits long, total long")


def sparse_features(docs: DataFrame, vocab: list[str], keep: list[str], text: str = "norm") -> DataFrame:
    """(keep..., idx, freq) of the features that a row has, idx being the place in the vocabulary; rows stay where they are."""
    lengths = np.array([len(g) for g in vocab], np.int64)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = GramTable(vocab)
        for batch, texts in batched(batches, len(keep)):
            row, place, many = table.counts(texts)
            freq = many / (np.array([len(t) for t in texts], np.int64)[row] - lengths[place] + 1)
            columns = [batch.column(k).take(pa.array(row)) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(place.astype(np.int32)), pa.array(freq)], [*keep, "idx", "freq"])

    return docs.select(*keep, text).mapInArrow(features, f"{kept_schema(docs, keep)}, idx int, freq double")
