"""Registered queries over the driver's tables, and the DuckDB SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import ngrams, quantise, scripts, text
from .operators import evaluation, sampling, scoring, vocabulary
from .plans import experiment
from .plans.model import GroupModel, average, to_tables
from .plans.trainer import fit_mllib
from .sources import binary

#: Texts in scripts that the tables lack, for the queries that route by script.
SAMPLES = ["Hello Мир", "日本語です", "中文", "한국어 hello", "Ўzbek", "Việt", "123 !?", "", "don't a--b", "ქართული ენა", "Հայերեն", "বাংলা ভাষা", "Ελληνικά ᾳ", "עברית", "العربية ݐ", "हिन्दी", "Ђорђе", "Қазақ", "× ÷ ・", "x — y", "a\nb", "a\t\nb", "é", "ABC Ёж 中 カ"]
#: Two-letter codes of the tables and the three-letter codes of the models.
CODES = {"en": "eng", "fr": "fra", "de": "deu", "es": "spa"}
#: The count model: n-gram sizes, the most frequent ones taken for each language and size, and what a weight of one is
#: worth, a power of two, so that sums of weights are exact.
COUNT_SIZES, COUNT_TOP, COUNT_SCALE = (1, 2, 3, 4, 5), 60, 1 / 512
#: N-grams of each size that the languages give in turn.
ROBIN = {1: 80, 2: 100, 3: 100, 4: 60, 5: 40}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one that comes in fewer splits than there are cores is dealt out, a split to eight tasks at most."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    splits, cores = df.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism
    return df.repartition(min(cores, 8 * splits)) if splits < cores else df


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and, with negative ids, SAMPLES."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.unionByName(spark.createDataFrame([(-1 - k, t) for k, t in enumerate(SAMPLES)], "doc_id long, text string"))


def normed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "text", text.normalize("text").alias("norm"))


# scripts


def script_profile(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", *scripts.histogram("text"))


def script_proportions(spark, sf_dir):
    rows = script_profile(spark, sf_dir).select("doc_id", F.explode(scripts.proportions()).alias("p"))
    return rows.select("doc_id", "p.script", "p.n", F.round("p.proportion", 6).alias("proportion"))


def dominant_script(spark, sf_dir):
    return script_profile(spark, sf_dir).select("doc_id", scripts.dominant().alias("script"), scripts.total().alias("total"))


def literal_detect(spark, sf_dir):
    rows = script_profile(spark, sf_dir).select("doc_id", F.explode(scripts.literal_detections()).alias("d"))
    return rows.select("doc_id", "d.lang", F.round("d.probability", 6).alias("probability"))


def tiered_route(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", scripts.tiered_route("text").alias("route"))


# text and n-grams


def normalize_text(spark, sf_dir):
    docs, talks = texts(spark, sf_dir), table(spark, sf_dir, "conversations")
    rows = docs.select(F.lit("documents").alias("tbl"), "doc_id", F.lit(0).cast("long").alias("part"), "text").unionByName(talks.select(F.lit("conversations").alias("tbl"), F.col("conv_id").alias("doc_id"), F.col("turn").alias("part"), "text"))
    norm = text.normalize("text")
    return rows.select("tbl", "doc_id", "part", F.md5(norm.cast("binary")).alias("norm_md5"), F.length(norm).cast("long").alias("n_chars"))


def ngram_freq(n: int) -> Callable:
    def query(spark, sf_dir):
        found = ngrams.frequencies(normed(spark, sf_dir), ["doc_id"], n)
        return found.select("doc_id", "gram", "cnt", F.round("freq", 9).alias("freq"))

    return query


def datum_view(spark, sf_dir):
    """Each document as a training datum, summed up by size: distinct n-grams, all of them, and the largest share."""
    rows = ngrams.data(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", F.length("norm").cast("long").alias("n_chars"), F.explode("ngrams").alias("n", "grams"))
    most = F.coalesce(F.array_max(F.transform("grams", lambda g: g["freq"])), F.lit(0.0))
    total = F.aggregate("grams", F.lit(0).cast("long"), lambda s, g: s + g["cnt"])
    return rows.select("doc_id", "n_chars", F.col("n").cast("long").alias("n"), F.size("grams").cast("long").alias("grams"), total.alias("total"), F.round(most, 9).alias("most"))


def top_ngrams_per_lang(spark, sf_dir):
    counts = vocabulary.corpus_counts(normed(spark, sf_dir))
    return vocabulary.top_grams(counts, 20).select("lang", "n", "gram", "cnt", F.col("rank").cast("long").alias("rank"))


def html_paragraphs(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.posexplode(text.paragraphs("html")).alias("pos", "p"))
    return rows.select("page_id", "lang", F.col("pos").cast("long").alias("pos"), F.md5(F.col("p").cast("binary")).alias("paragraph_md5"))


# a model whose weights are whole numbers from counts, so that SQL gives the same logits


def count_model(docs: DataFrame) -> GroupModel:
    """A model of docs (lang, norm): for each language the logarithm of an n-gram's share, in ten-thousandths, times COUNT_SCALE.

    What comes to the driver is bounded by languages, sizes and COUNT_TOP.
    """
    counts = vocabulary.corpus_counts(docs.where("lang IS NOT NULL"), sizes=COUNT_SIZES).persist()
    totals = {(r["lang"], r["n"]): r["total"] for r in counts.groupBy("lang", "n").agg(F.sum("cnt").alias("total")).collect()}
    grams = vocabulary.top_grams(counts, COUNT_TOP).select("n", "gram").distinct()
    cnt = {(r["lang"], r["gram"]): r["cnt"] for r in counts.join(F.broadcast(grams), ["n", "gram"]).collect()}
    counts.unpersist()
    vocab = {n: sorted({g for _, g in cnt if len(g) == n}) for n in COUNT_SIZES}
    langs = sorted({x for x, _ in totals})
    shares = np.array([[(cnt.get((x, g), 0) + 1) / (totals.get((x, n), 0) + 1) for n in COUNT_SIZES for g in vocab[n]] for x in langs]).reshape(len(langs), -1)
    whole = np.sign(np.log(shares)) * np.floor(np.abs(np.log(shares) * 10000) + 0.5)
    return GroupModel(langs, vocab, whole * COUNT_SCALE, np.zeros(len(langs)))


def whole_tables(spark: SparkSession, model: GroupModel) -> dict[str, DataFrame]:
    """The count model's tables, its weights as whole numbers."""
    return to_tables(spark, {"latin": GroupModel(model.langs, model.vocab, model.weights / COUNT_SCALE, model.bias)})


def linear_logits(spark, sf_dir):
    docs = normed(spark, sf_dir)
    return scoring.logits(docs, count_model(docs), ["doc_id"]).select("doc_id", "lang", F.round("logit", 6).alias("logit"))


def _ranked(spark, sf_dir):
    docs = normed(spark, sf_dir)
    return scoring.ranked(docs, count_model(docs), ["doc_id"])


def softmax_probs(spark, sf_dir):
    return _ranked(spark, sf_dir).select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.lang", F.round("f.probability", 6).alias("probability"))


def detect_topk(spark, sf_dir):
    best = _ranked(spark, sf_dir).select("doc_id", F.posexplode(F.slice("found", 1, 2)).alias("k", "f"))
    return best.select("doc_id", (F.col("k") + 1).cast("long").alias("rank"), "f.lang", F.round("f.probability", 6).alias("probability"))


def held_out(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The first part of each language, and the rest."""
    rows = sampling.split(normed(spark, sf_dir).where("lang IS NOT NULL"))
    return rows.where("is_train").drop("is_train"), rows.where("NOT is_train").drop("is_train")


def _predicted(spark, sf_dir):
    """The rest, with what a model of the first part says, and a model of single letters alone."""
    train, test = held_out(spark, sf_dir)
    model = count_model(train)
    few = {n: model.vocab[n] if n == 1 else [] for n in COUNT_SIZES}
    letters = GroupModel(model.langs, few, model.weights[:, : len(few[1])], model.bias)
    best = F.get("found", F.lit(0))["lang"]
    found = scoring.ranked(test, model, ["doc_id", "lang", "norm"]).select("doc_id", "lang", "norm", best.alias("pred"))
    return scoring.ranked(found, letters, ["doc_id", "lang", "pred"]).select("doc_id", "lang", "pred", best.alias("letters"))


def eval_accuracy_per_lang(spark, sf_dir):
    return evaluation.accuracy(_predicted(spark, sf_dir), ["lang"])


def eval_overall(spark, sf_dir):
    return evaluation.accuracy(_predicted(spark, sf_dir), [])


def imperfect_langs(spark, sf_dir):
    return evaluation.imperfect(evaluation.accuracy(_predicted(spark, sf_dir), ["lang"], found="letters"))


def eval_compare(spark, sf_dir):
    """The model and the comparator on the same rows."""
    return evaluation.compare(_predicted(spark, sf_dir), ["pred", "letters"])


def short_text_eval(spark, sf_dir):
    """The test rows, cut short."""
    _, test = held_out(spark, sf_dir)
    rows = evaluation.short_texts(test.select("doc_id", "lang", "text"))
    return rows.select("doc_id", "lang", F.col("size").cast("long").alias("size"), "text")


def first_seen_langs(spark, sf_dir):
    return evaluation.first_seen(table(spark, sf_dir, "documents"))


def vocab_coverage(spark, sf_dir):
    docs = normed(spark, sf_dir)
    return vocabulary.coverage(docs, [g for _, g in count_model(docs).features], ["doc_id"])


def feature_vector_sparse(spark, sf_dir):
    docs = normed(spark, sf_dir)
    found = vocabulary.sparse_features(docs, [g for _, g in count_model(docs).features], ["doc_id"])
    return found.select("doc_id", F.col("idx").cast("long").alias("idx"), F.round("freq", 9).alias("freq"))


def vocab_roundrobin(spark, sf_dir):
    counts = vocabulary.corpus_counts(normed(spark, sf_dir))
    found = vocabulary.round_robin(counts, sorted(CODES), ROBIN)
    return spark.createDataFrame([(n, k, g) for n, own in found.items() for k, g in enumerate(own)], "n long, idx long, gram string")


def importance_prune(spark, sf_dir):
    tables = whole_tables(spark, count_model(normed(spark, sf_dir)))
    found = vocabulary.prune(tables["weights"], tables["vocab"], {1: 20, 2: 40, 3: 40, 4: 40, 5: 40})
    return found.select("n", F.col("idx").cast("long").alias("idx"), "gram", "importance")


def int6_quantize(spark, sf_dir):
    out = quantise.int6_rows(whole_tables(spark, count_model(normed(spark, sf_dir)))["weights"])
    return out.select(F.col("lang_idx").cast("long").alias("lang_idx"), F.col("idx").cast("long").alias("idx"), F.round("scale", 9).alias("scale"), F.col("q").cast("long").alias("q"))


def seed_average(spark, sf_dir):
    """Weights of three seeds, the seed's number being added to each, averaged by row and column; all seeds have each one."""
    weights = whole_tables(spark, count_model(normed(spark, sf_dir)))["weights"]
    seeds = weights.withColumn("seed", F.explode(F.array(*map(F.lit, range(3))))).withColumn("w", F.col("w") + F.col("seed"))
    out = seeds.groupBy("lang_idx", "idx").agg(F.avg("w").alias("w"), F.count("*").alias("seeds"))
    return out.select(F.col("lang_idx").cast("long").alias("lang_idx"), F.col("idx").cast("long").alias("idx"), "w", "seeds")


def prefix_sharing_stats(spark, sf_dir):
    """Bytes that each n-gram of the vocabulary shares with the one before, and that it adds."""
    vocab = whole_tables(spark, count_model(normed(spark, sf_dir)))["vocab"]
    by = Window.partitionBy("n").orderBy("gram")
    before = F.coalesce(F.lag("gram").over(by), F.lit(""))
    a, b = F.hex(F.encode("gram", "UTF-8")), F.hex(F.encode("before", "UTF-8"))
    rows = vocab.withColumn("before", before).withColumn("a", a).withColumn("b", b)
    same = F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0), lambda s, k: s + F.when((F.length("a") >= 2 * k) & (F.length("b") >= 2 * k) & (F.substr("a", F.lit(1), 2 * k) == F.substr("b", F.lit(1), 2 * k)), 1).otherwise(0))
    shared = rows.withColumn("shared", same).withColumn("rest", (F.length("a") / 2).cast("long") - F.col("shared"))
    return shared.groupBy("n").agg(F.count("*").alias("grams"), F.sum(F.col("shared").cast("long")).alias("shared"), F.sum("rest").alias("rest"))


def codec_decoded(spark, sf_dir):
    """The count model, written in the compact format and read again: names, n-grams and weights as they come back."""
    model = count_model(normed(spark, sf_dir))
    back = binary.loads(binary.dumps(GroupModel(model.langs, model.vocab, model.weights / COUNT_SCALE, model.bias)))
    rows = [(x, n, k, g, float(w)) for x, own in zip(back.langs, back.weights, strict=True) for k, ((n, g), w) in enumerate(zip(back.features, own, strict=True))]
    return spark.createDataFrame(rows, "lang string, n long, idx long, gram string, w double").withColumn("w", F.round("w", 2))


def pq_assign(spark, sf_dir):
    """Each embedding's nearest of the first 16, after scaling to a largest magnitude of one."""
    most = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") / most).alias("v"))
    book = rows.where("vec_id < 16").select(F.col("vec_id").alias("centroid_id"), F.col("v").alias("c"))
    found = quantise.assign(rows, book, "vec_id")
    return found.select("vec_id", "centroid_id", F.round("dist", 4).alias("dist"))


def kmeans_step(spark, sf_dir):
    """A round of k-means over scaled embeddings from the first 16, and one centroid far off that gets no point."""
    most = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") / most).alias("v"))
    book = rows.where("vec_id < 16").select(F.col("vec_id").alias("centroid_id"), F.col("v").alias("c"))
    far = book.where("centroid_id = 0").select(F.lit(99).cast("long").alias("centroid_id"), F.transform("c", lambda x: F.lit(10.0)).alias("c"))
    found = quantise.lloyd(rows, book.unionByName(far), "vec_id")
    square = F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x)
    return found.select("centroid_id", "n", F.round(F.get("c", F.lit(0)), 6).alias("first"), F.round(square, 6).alias("square"), F.round("mse", 6).alias("mse"))


def named_model(docs: DataFrame) -> GroupModel:
    """The count model with the languages' three-letter codes."""
    model = count_model(docs)
    return GroupModel([CODES.get(x, x) for x in model.langs], model.vocab, model.weights, model.bias)


def detect_documents(spark, sf_dir):
    """The best detection of every document and sample, by the count model of the documents."""
    found = scoring.detect(texts(spark, sf_dir), {"latin": named_model(normed(spark, sf_dir))})
    best = F.get("detections", F.lit(0))
    return found.select("doc_id", best["lang"].alias("lang_pred"), F.round(best["probability"], 6).alias("probability"), "fallback")


def detect_all_languages(spark, sf_dir):
    """All detections of the samples in other scripts, ranked."""
    samples = texts(spark, sf_dir).where("doc_id < 0")
    found = scoring.detect(samples, {"latin": named_model(normed(spark, sf_dir))}).select("doc_id", F.posexplode("detections").alias("k", "d"))
    return found.select("doc_id", (F.col("k") + 1).cast("long").alias("rank"), "d.lang", F.round("d.probability", 6).alias("probability"))


def detect_tiered_documents(spark, sf_dir):
    return scoring.detect_tiered(texts(spark, sf_dir), {"latin": named_model(normed(spark, sf_dir))}).select("doc_id", "lang_tiered")


# samples


def reservoir_sample(spark, sf_dir):
    return sampling.reservoir(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], 50, "doc_id")


def fallback_fill(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), F.col("role").alias("lang"), "text")
    return sampling.with_fallback(talks, 100, key="key").select("key", "lang", (F.length("text") >= sampling.LONG).alias("is_long"))


def positional_split(spark, sf_dir):
    return sampling.split(table(spark, sf_dir, "documents").select("doc_id", "lang"))


def truncate_aug(spark, sf_dir):
    train = sampling.split(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).where("is_train").drop("is_train")
    return sampling.truncated_copies(train, 0.75).select("doc_id", "lang", F.col("size").cast("long").alias("size"), "text")


def train_with_copies(spark, sf_dir):
    """Rows that train and their truncated copies, by language: how many, and their characters."""
    train = sampling.split(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).where("is_train").drop("is_train")
    rows = sampling.with_copies(train, 0.75)
    return rows.groupBy("lang", "is_copy").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))


def merge_sources(spark, sf_dir):
    """Sentences, declarations and news in this order within a language: here documents, paragraphs and talks."""
    docs = table(spark, sf_dir, "documents").select("lang", F.lit(0).alias("source_ord"), F.col("doc_id").alias("pos"), "text")
    pages = html_source(spark, sf_dir)
    talks = table(spark, sf_dir, "conversations").select(F.lit("und").alias("lang"), F.lit(2).alias("source_ord"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), "text")
    rows = docs.unionByName(pages).unionByName(talks.where(F.length("text") >= text.MIN_PARAGRAPH))
    return rows.groupBy("lang", "source_ord").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"), F.max("pos").alias("last")).select("lang", F.col("source_ord").cast("long").alias("source_ord"), "n", "chars", "last")


def html_source(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.explode(text.paragraphs("html")).alias("text"))
    return rows.select("lang", F.lit(1).alias("source_ord"), F.col("page_id").alias("pos"), "text")


# trained models: no SQL gives these


def coded(spark, sf_dir) -> DataFrame:
    """Documents as a training corpus: three-letter codes, and the order of the rows."""
    docs = table(spark, sf_dir, "documents").withColumn("lang", F.coalesce(*[F.when(F.col("lang") == a, F.lit(b)) for a, b in CODES.items()]))
    return docs.where("lang IS NOT NULL").select("lang", "text", F.lit(0).alias("source_ord"), F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("pos"))


def trained(spark, sf_dir) -> GroupModel:
    """Multinomial regression over a vocabulary of all five sizes; a bounded sample trains, as the sampling limit has it."""
    docs = coded(spark, sf_dir).withColumn("norm", text.normalize("text"))
    train = sampling.split(docs, order="pos").where("is_train")
    langs = sorted(CODES.values())
    vocab = vocabulary.round_robin(vocabulary.corpus_counts(train), langs, {1: 30, 2: 40, 3: 40, 4: 30, 5: 20})
    return fit_mllib(sampling.reservoir(train, ["lang"], 500, "pos"), langs, vocab, iterations=20)


def detect_trained(spark, sf_dir):
    found = scoring.detect(texts(spark, sf_dir), {"latin": trained(spark, sf_dir)})
    best = F.get("detections", F.lit(0))
    return found.select("doc_id", best["lang"].alias("lang_pred"), F.round(best["probability"], 6).alias("probability"), "fallback")


#: A small experiment of the registered query: a wide model, pruned to half, tuned under product quantisation.
SMALL = {
    "wide": {"langs": {"latin": sorted(CODES.values())}, "sizes": {"latin": (40, 60, 60, 40, 20)}, "epochs": {"latin": 16}, "train": {"lr": 0.01, "label_smoothing": 0.1, "data_limit": 300}},
    "small": {
        "prune_from": "wide", "seed": 0, "langs": {"latin": sorted(CODES.values())}, "sizes": {"latin": (20, 30, 30, 20, 10)}, "epochs": {"latin": 16},
        "train": {"lr": 0.01, "label_smoothing": 0.1, "truncate_aug": 0.75, "focal_gamma": 2.0, "data_limit": 300}, "qat_pq": {"groups": ["latin"], "epochs": 4, "lr": 0.001, "k": 64, "d": 4, "seed": 0},
    },
}


def run_experiment(spark, sf_dir):
    """SMALL run from data to models: languages, features, parameters, accuracy and bytes of the result."""
    data = lambda langs, limit: sampling.with_fallback(coded(spark, sf_dir).where(F.col("lang").isin(langs)), limit, key="pos")
    return experiment.run(spark, data, "small", experiments=SMALL).report(spark)


def codec_roundtrip(spark, sf_dir):
    """The trained model and its average with itself, written in both forms and read again: the largest error of each."""
    model = vocabulary.canonical(trained(spark, sf_dir))
    model = average([model, model])
    rows = []
    for name, book in (("six bits", None), ("product", quantise.pq_fit(spark, model.weights, 64, 4, 0, 1, 20))):
        m = GroupModel(model.langs, model.vocab, model.weights, model.bias, book)
        data = binary.dumps(m)
        back = binary.loads(data)
        rows.append((name, len(data), binary.size_estimate(m), float(np.abs(back.weights - m.weights).max()), back.langs == m.langs and back.features == m.features))
    return spark.createDataFrame(rows, "codec string, n_bytes long, estimate long, max_error double, same_names boolean")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        script_profile, script_proportions, dominant_script, literal_detect, tiered_route, normalize_text, datum_view, top_ngrams_per_lang, html_paragraphs, linear_logits, softmax_probs, detect_topk,
        eval_accuracy_per_lang, eval_overall, imperfect_langs, eval_compare, first_seen_langs, short_text_eval, vocab_coverage, feature_vector_sparse, vocab_roundrobin, importance_prune, int6_quantize,
        seed_average, prefix_sharing_stats, codec_decoded, pq_assign, kmeans_step, reservoir_sample, fallback_fill, positional_split, truncate_aug, train_with_copies, merge_sources, detect_documents,
        detect_all_languages, detect_tiered_documents, detect_trained, run_experiment, codec_roundtrip,
    )
} | {f"ngram_freq_{n}": ngram_freq(n) for n in (1, 2, 3, 4, 5)}
