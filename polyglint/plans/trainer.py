"""Training of group models: MLlib on the cluster, or numpy AdamW with focal loss and quantisation-aware tuning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantise import pq_fit, pq_snap
from ..operators.scoring import frequency_matrix, linear
from .model import Group, GroupModel, Training


def fit_mllib(docs: DataFrame, langs: list[str], vocab: dict[int, list[str]], lang: str = "lang", text: str = "norm", iterations: int = 50) -> GroupModel:
    """Multinomial regression over n-gram frequencies; rows of other languages are passed over."""
    empty = GroupModel(langs, vocab, np.zeros((len(langs), sum(map(len, vocab.values())))), np.zeros(len(langs)))

    @F.pandas_udf("array<double>")
    def frequencies(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(frequency_matrix(texts.fillna("").tolist(), empty)))

    index = F.array_position(F.array(*map(F.lit, langs)), F.col(lang)).cast("double") - 1
    rows = docs.where(F.col(lang).isin(langs)).select(index.alias("label"), array_to_vector(frequencies(text)).alias("features"))
    fitted = LogisticRegression(family="multinomial", maxIter=iterations, standardization=False).fit(rows)
    w, b = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    if len(b) < len(langs):  # no row of the last languages
        w, b = np.vstack([w, np.zeros((len(langs) - len(b), w.shape[1]))]), np.append(b, np.full(len(langs) - len(b), -1e3))
    return GroupModel(langs, vocab, w, b)


def loss_gradient(logits: np.ndarray, target: np.ndarray, gamma: float, smoothing: float) -> tuple[float, np.ndarray]:
    """Mean focal loss with label smoothing over the other classes, and its gradient; gamma 0 is plain cross-entropy.

    Smoothing gives each wrong class smoothing / (classes - 1) for the focal loss and smoothing / classes otherwise.
    """
    n, c = logits.shape
    logp = logits - logits.max(axis=1, keepdims=True)
    logp -= np.log(np.exp(logp).sum(axis=1, keepdims=True))
    p = np.exp(logp)
    want = np.full((n, c), smoothing / (max(1, c - 1) if gamma else c))
    want[np.arange(n), target] = 1 - smoothing if gamma else 1 - smoothing + smoothing / c
    rest = 1 - p
    loss = -(rest**gamma * want * logp).sum() / n
    # d loss / d logp, then through the softmax
    slope = -want * (rest**gamma - gamma * rest ** max(gamma - 1, 0) * p * logp if gamma else 1.0) / n
    return float(loss), slope - p * slope.sum(axis=1, keepdims=True)


def _adamw(model: GroupModel, x: np.ndarray, y: np.ndarray, how: Training, epochs: int, batch: int, seed: int, snap=None, after=None, losses: list[float] | None = None) -> GroupModel:
    """losses: gets each epoch's mean loss over its rows."""
    rng = np.random.default_rng(seed)
    w, b = model.weights.copy(), model.bias.copy()
    state, step = [[np.zeros_like(v), np.zeros_like(v)] for v in (w, b)], 0
    for _ in range(epochs):
        order, total = rng.permutation(len(x)), 0.0
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            loss, g = loss_gradient(x[rows] @ (snap(w) if snap else w).T + b, y[rows], how.focal_gamma, how.label_smoothing)
            step, total = step + 1, total + loss * len(rows)
            for v, grad, (m, s) in zip((w, b), (g.T @ x[rows], g.sum(axis=0)), state, strict=True):
                m += 0.1 * (grad - m)
                s += 0.001 * (grad * grad - s)
                v -= how.lr * (0.01 * v + (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8))
        if after:
            after(w, b)
        if losses is not None:
            losses.append(total / max(1, len(x)))
    return GroupModel(model.langs, model.vocab, w, b, model.codebook)


def fit_numpy(texts: list[str], labels: list[str], langs: list[str], vocab: dict[int, list[str]], how: Training, epochs: int = 64, batch: int = 32, seed: int = 0, losses: list[float] | None = None) -> GroupModel:
    """AdamW with shuffled minibatches; texts are normalised. For one group's bounded training sample. losses: gets each epoch's mean."""
    n = sum(map(len, vocab.values()))
    rng = np.random.default_rng(seed)
    bound = 1 / np.sqrt(max(1, n))
    start = GroupModel(langs, vocab, rng.uniform(-bound, bound, (len(langs), n)), rng.uniform(-bound, bound, len(langs)))
    x = frequency_matrix(texts, start)
    return _adamw(start, x, np.array([langs.index(v) for v in labels], int), how, epochs, batch, seed, losses=losses)


def tune_quantised(model: GroupModel, texts: list[str], labels: list[str], test_texts: list[str], test_labels: list[str], how: Training, codebook: np.ndarray, epochs: int = 20, seed: int = 0) -> tuple[GroupModel, float]:
    """Fine-tuning under product quantisation: the forward pass sees snapped weights, the gradient goes to the real ones.

    The codebook stays as it is; the epoch with the best snapped test accuracy (in hundredths) is kept.
    """
    snap = lambda w: pq_snap(w, codebook)
    x, y = frequency_matrix(texts, model), np.array([model.langs.index(v) for v in labels], int)
    tx, ty = frequency_matrix(test_texts, model), np.array([model.langs.index(v) for v in test_labels], int)
    rate = lambda w, b: float((np.argmax(tx @ snap(w).T + b, axis=1) == ty).mean() * 100) if len(ty) else 0.0
    best = [rate(model.weights, model.bias), model.weights.copy(), model.bias.copy()]

    def keep(w, b):
        if (now := rate(w, b)) > best[0]:
            best[:] = [now, w.copy(), b.copy()]

    _adamw(model, x, y, how, epochs, 32, seed, snap, keep)
    return GroupModel(model.langs, model.vocab, best[1], best[2], codebook, best[0]), best[0]


def test_accuracy(model: GroupModel, texts: list[str], labels: list[str]) -> float:
    """Texts (normalised) whose best language is their label, in hundredths; 0 without any."""
    if not texts:
        return 0.0
    best = np.argmax(linear(texts, model), axis=1)
    return float(np.mean([model.langs[k] == v for k, v in zip(best, labels, strict=True)]) * 100)


test_accuracy.__test__ = False


_FITTED = "grp string, weights array<double>, bias array<double>, accuracy double, losses array<double>, codebook array<double>"


def _by_group(rows: DataFrame, langs: dict[str, list[str]], work) -> list:
    """work(group, train, test) for each group of languages, side by side on the executors; rows: lang, norm and is_train,
    bounded for each language by the sampling limit. A group without rows has no result."""
    member = F.coalesce(*[F.when(F.col("lang").isin(own), F.lit(g)) for g, own in langs.items()])

    def fit(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["lang", "norm"])
        m, losses = work(key[0], rows[rows["is_train"]], rows[~rows["is_train"]])
        book = None if m.codebook is None else m.codebook.ravel().tolist()
        return pd.DataFrame({"grp": [key[0]], "weights": [m.weights.ravel().tolist()], "bias": [m.bias.tolist()], "accuracy": [m.accuracy], "losses": [losses], "codebook": [book]})

    return rows.select(member.alias("grp"), "lang", "norm", "is_train").where("grp IS NOT NULL").groupBy("grp").applyInPandas(fit, _FITTED).collect()


def fit_groups(rows: DataFrame, groups: dict[str, Group], vocabs: dict[str, dict[int, list[str]]], how: Training, seed: int = 0) -> tuple[dict[str, GroupModel], dict[str, list[float]]]:
    """A model for each script group, with its accuracy on the rows that are not is_train, and its losses by epoch."""

    def work(name: str, train: pd.DataFrame, test: pd.DataFrame):
        g, losses = groups[name], []
        m = fit_numpy(train["norm"].tolist(), train["lang"].tolist(), g.langs, vocabs[name], how, g.epochs, g.batch, seed, losses)
        m.accuracy = test_accuracy(m, test["norm"].tolist(), test["lang"].tolist())
        return m, losses

    models, losses = {}, {}
    for r in _by_group(rows, {g: c.langs for g, c in groups.items()}, work):
        g = r["grp"]
        models[g] = GroupModel(groups[g].langs, vocabs[g], np.array(r["weights"]).reshape(len(r["bias"]), -1), np.array(r["bias"]), None, r["accuracy"])
        losses[g] = r["losses"]
    return models, losses


def tune_groups(rows: DataFrame, models: dict[str, GroupModel], how: Training, epochs: int = 20, lr: float = 0.001, k: int = 256, d: int = 4, seed: int = 0) -> dict[str, GroupModel]:
    """tune_quantised() for each model, side by side; each one gets its codebook and its snapped accuracy."""
    how, books = replace(how, lr=lr), {g: pq_fit(rows.sparkSession, m.weights, k, d, seed) for g, m in models.items()}

    def work(name: str, train: pd.DataFrame, test: pd.DataFrame):
        return tune_quantised(models[name], train["norm"].tolist(), train["lang"].tolist(), test["norm"].tolist(), test["lang"].tolist(), how, books[name], epochs, seed)[0], []

    out = dict(models)
    for r in _by_group(rows, {g: m.langs for g, m in models.items()}, work):
        m = models[r["grp"]]
        out[r["grp"]] = GroupModel(m.langs, m.vocab, np.array(r["weights"]).reshape(len(r["bias"]), -1), np.array(r["bias"]), np.array(r["codebook"]).reshape(-1, d), r["accuracy"])
    return out
