import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from polyglint.detector import create
from polyglint.functions import ngrams, quantise, scripts, text
from polyglint.operators import evaluation, local, sampling, scoring, vocabulary
from polyglint.oracles import ORACLES
from polyglint.plans import experiment, trainer
from polyglint.plans import model as M
from polyglint.queries import CODES, QUERIES
from polyglint.sources import binary, corpora

SF = "/root/testdata/sf0.001"
TINY = M.GroupModel(["eng", "fra"], {1: ["e", "t"], 2: ["th", "é "], 3: []}, np.array([[1.0, 2.0, 9.0, -3.0], [2.0, -1.0, -4.0, 7.0]]), np.array([0.5, -0.25]))


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("Hello, World! 123", " hello world "), ("don't", " dont "), ("a--b", " a b "), ("a - b", " a b "), ("x — y", " x y "), ("a\nb", " a\nb "), ("a\t\nb", " a b "), ("a  b", " a b "), ("é", " é "), ("hi😀you", " hiyou "), ("", "  "), ("123", "  "), (None, None)])
def test_normalize(spark, raw, want):
    assert one(spark, text.normalize("t"), raw) == want
    assert raw is None or local.normalize(raw) == want


@pytest.mark.parametrize(("raw", "size", "want"), [("the quick brown fox", 15, "the quick"), ("abcdefghij", 4, "abcd"), ("short", 15, "short"), ("ab cdefghijk", 6, "ab cde")])
def test_truncate(spark, raw, size, want):
    assert one(spark, text.truncate("t", size), raw) == want


def test_ngrams(spark):
    docs = spark.createDataFrame([(1, " ab "), (2, "  ")], "id long, norm string")
    got = {n: {(r["id"], r["gram"]): r["freq"] for r in ngrams.frequencies(docs, ["id"], n).collect()} for n in (1, 2, 3)}
    counted = {(r["n"], r["gram"]): r["cnt"] for r in ngrams.group_counts(docs.withColumn("lang", F.lit("x")), "lang", sizes=(1, 2)).collect()}
    exploded = ngrams.explode_grams(docs, ["id"], sizes=(1, 2)).groupBy("n", "gram").count().collect()
    assert counted == {(r["n"], r["gram"]): r["count"] for r in exploded}
    assert got[2] == {(1, " a"): 1 / 3, (1, "ab"): 1 / 3, (1, "b "): 1 / 3, (2, "  "): 1.0}
    assert got[1][2, " "] == 1.0 and all(k[0] == 1 for k in got[3])


@pytest.mark.parametrize(("raw", "want", "tier"), [("日本語です", [("jpn", 0.4)], "jpn"), ("中文", [("cmn", 1.0)], "cmn"), ("한국어", [("kor", 1.0)], "kor"), ("Ўzbek", [], "bel"), ("Мир", [], "group:cyrillic"), ("", [], "group:latin"), (None, [], "group:latin")])
def test_routes(spark, raw, want, tier):
    rows = spark.createDataFrame([(raw,)], "t string").select("t", *scripts.histogram("t"))
    got = rows.select(scripts.literal_detections().alias("d"), scripts.tiered_route("t").alias("r")).first()
    assert [(d["lang"], pytest.approx(d["probability"])) for d in got["d"]] == want and got["r"] == tier


def test_detect(spark):
    detector = create(spark, {"latin": TINY})
    with pytest.raises(RuntimeError):
        detector.detect("x")
    detector.initialize()
    for raw in ("the thé 中文", "日本語です", "123", "", "Hello Мир", "한국어 the"):
        got = detector.detect(raw)
        assert got == [(a, pytest.approx(b)) for a, b in local.detect_local(raw, {"latin": TINY})]
        assert [p for _, p in got] == sorted((p for _, p in got), reverse=True)
    assert detector.detect("日本語です") == [("jpn", pytest.approx(0.4))]
    rows = spark.createDataFrame([("é é é",), (None,), ("Ўzbek",)], "text string")
    assert [r["lang_tiered"] for r in detector.detect_tiered(rows).collect()][::2] == ["fra", "bel"]
    detector.register("langs")
    assert spark.sql("SELECT langs('日本語です')[0].lang AS x").first()["x"] == "jpn"


def test_relational_and_vector_scores_agree(spark):
    docs = spark.createDataFrame([(1, " the cat "), (2, " é "), (3, "  ")], "id long, norm string")
    tables = M.to_tables(spark, {"latin": TINY})
    got = scoring.relational_logits(docs, tables["vocab"].drop("grp"), tables["langs"].drop("grp"), tables["weights"].drop("grp"), ["id"])
    got = {(r["id"], r["lang"]): r["logit"] for r in got.collect()}
    assert got == {(r["id"], r["lang"]): pytest.approx(r["logit"]) for r in scoring.logits(docs, TINY, ["id"]).collect()}
    best = {r["id"]: [(f["lang"], f["logit"]) for f in r["found"]] for r in scoring.ranked(docs, TINY, ["id"]).collect()}
    assert all(own == sorted(own, key=lambda x: -x[1]) for own in best.values())
    texts = [" the cat ", " é ", "  "]
    want = scoring.frequency_matrix(texts, TINY) @ TINY.weights.T + TINY.bias
    assert got == {(i + 1, x): pytest.approx(want[i, k]) for i in range(3) for k, x in enumerate(TINY.langs)}


def test_gram_kernels_match_plain_counts():
    """Letters beyond the basic plane and alphabets too large for the numbers, which then go by rank."""
    rng = np.random.default_rng(0)
    texts = ["", "a", "ab\0b", "😀é😀é", "".join(map(chr, rng.integers(0x4E00, 0x9FFF, 3000)))] + ["".join(rng.choice(list("abé "), 40)) for _ in range(5)]
    for n, row, names, many in ngrams.count_grams(texts, np.arange(len(texts))):
        want = {(k, t[i : i + n]): 0 for k, t in enumerate(texts) for i in range(len(t) - n + 1)}
        for k, t in enumerate(texts):
            for i in range(len(t) - n + 1):
                want[k, t[i : i + n]] += 1
        assert dict(zip(zip(row.tolist(), names), many.tolist())) == want
    vocab = ["a", "", "é😀", "abé a", "ab", "ab", "zz"]
    row, place, many = ngrams.GramTable(vocab).counts(texts)
    found = dict(zip(zip(row.tolist(), place.tolist()), many.tolist()))
    assert found == {(k, vocab.index(g)): c for k, t in enumerate(texts) for g in set(vocab) - {""} if (c := sum(t.startswith(g, i) for i in range(len(t))))}


def test_datum(spark):
    rows = ngrams.data(spark.createDataFrame([(1, "Ab-a!"), (2, None), (3, "")], "id long, text string"), ["id"]).collect()
    got = {r["id"]: (r["norm"], {n: [(g["gram"], g["cnt"]) for g in own] for n, own in r["ngrams"].items()}) for r in rows}
    assert got[1][0] == " ab a " and sorted(got[1][1][1]) == [(" ", 3), ("a", 2), ("b", 1)] and len(got[1][1][5]) == 2
    assert got[2] == got[3] == ("  ", {1: [(" ", 2)], 2: [("  ", 1)], 3: [], 4: [], 5: []})
    assert all(sum(g["freq"] for g in own) == pytest.approx(1) for r in rows for own in r["ngrams"].values() if own)


def test_round_robin(spark):
    counts = spark.createDataFrame([("A", 1, "x", 9), ("A", 1, "y", 8), ("A", 1, "z", 7), ("B", 1, "x", 9), ("B", 1, "w", 1)], "lang string, n int, gram string, cnt long")
    assert vocabulary.round_robin(counts, ["A", "B"], {1: 3, 2: 5}) == {1: ["x", "w", "y"], 2: []}
    assert vocabulary.round_robin(counts, ["A", "B"], {1: 2}) == {1: ["x", "w"]}
    assert vocabulary.round_robin(counts, ["A", "B"], {1: 9}) == {1: ["x", "w", "y", "z"]}


def test_codecs(spark):
    assert quantise.pack6(np.array([-31, 0, 31, 1])).hex() == "01ffa0"
    assert binary.encode_grams(["b", "abc", "ab"]).hex() == "02616221630162"
    for n in range(9):
        v = np.random.default_rng(n).integers(-31, 32, n)
        assert (quantise.unpack6(quantise.pack6(v), n) == v).all()
    back = binary.loads(binary.dumps(TINY))
    assert (back.langs, back.features) == (TINY.langs, vocabulary.canonical(TINY).features)
    assert np.abs(back.weights - vocabulary.canonical(TINY).weights).max() < 0.2
    book = quantise.pq_fit(spark, TINY.weights, 4, 2, 0)
    tuned = vocabulary.canonical(M.GroupModel(TINY.langs, TINY.vocab, TINY.weights, TINY.bias, book))
    assert np.allclose(binary.loads(binary.dumps(tuned)).weights, quantise.pq_snap(tuned.weights, book), atol=1e-5)
    with pytest.raises(ValueError, match="too long"):
        binary.encode_grams(["ก" * 6])


def test_model_tables(spark, tmp_path):
    tuned = M.GroupModel(TINY.langs, TINY.vocab, TINY.weights, TINY.bias, quantise.pq_fit(spark, TINY.weights, 4, 2, 0), 87.5)
    M.save(spark, {"latin": TINY, "arabic": tuned}, str(tmp_path))
    loaded = M.load(spark, str(tmp_path))
    back = loaded["latin"]
    assert back.langs == TINY.langs and back.features == TINY.features and np.allclose(back.weights, TINY.weights) and back.codebook is None and back.accuracy is None
    assert np.allclose(loaded["arabic"].codebook, tuned.codebook) and loaded["arabic"].accuracy == 87.5
    assert set(M.load(spark, str(tmp_path), ["arabic"])) == {"arabic"}
    assert M.load_vocabs(spark, str(tmp_path), ["latin"])["latin"] == {n: v for n, v in TINY.vocab.items() if v}
    groups, how = M.resolve("lean_v5")
    assert sum(len(g.langs) * (sum(g.sizes) + 1) for g in groups.values()) == 46_612 and how.focal_gamma == 2.0
    with pytest.raises(ValueError, match="differ"):
        M.average([TINY, M.GroupModel(["eng"], {}, TINY.weights, TINY.bias)])


def test_training(spark):
    rng = np.random.default_rng(0)
    words = {"eng": ["the", "that", "with"], "fra": ["les", "é", "une"]}
    rows = [(x, " " + " ".join(rng.choice(words[x], 6)) + " ") for x in words for _ in range(40)]
    vocab = {1: list("thelsuné"), 2: ["th", "le", "un"]}
    for gamma, smooth in ((0.0, 0.0), (2.0, 0.1), (0.0, 0.1)):
        logits, y = rng.normal(size=(5, 3)), np.array([0, 1, 2, 0, 1])
        _, g = trainer.loss_gradient(logits, y, gamma, smooth)
        step = np.zeros_like(logits)
        step[1, 2] = 1e-6
        near = (trainer.loss_gradient(logits + step, y, gamma, smooth)[0] - trainer.loss_gradient(logits - step, y, gamma, smooth)[0]) / 2e-6
        assert g[1, 2] == pytest.approx(near, rel=1e-4)
    how = M.Training(lr=0.01, label_smoothing=0.1, focal_gamma=2.0)
    frame = spark.createDataFrame(rows, "lang string, norm string")
    group = M.Group("latin", sorted(words), (8, 3, 0, 0, 0), epochs=8)
    fitted, losses = trainer.fit_groups(frame.withColumn("is_train", F.lit(True)), {"latin": group}, {"latin": vocab}, how)
    assert len(losses["latin"]) == 8 and losses["latin"][-1] < losses["latin"][0]
    for m in (fitted["latin"], trainer.fit_mllib(frame, sorted(words), vocab)):
        x = scoring.frequency_matrix([t for _, t in rows], m) @ m.weights.T + m.bias
        assert np.mean([m.langs[k] == a for k, (a, _) in zip(x.argmax(axis=1), rows)]) > 0.95
    tuned, rate = trainer.tune_quantised(m, *zip(*[(t, a) for a, t in rows[::2]]), *zip(*[(t, a) for a, t in rows[1::2]]), how, quantise.pq_fit(spark, m.weights, 8, 2), epochs=2)
    assert rate > 90 and tuned.codebook.shape == (8, 2)


def test_experiment(spark, tmp_path):
    rng = np.random.default_rng(1)
    words = {"eng": ["the", "that", "with"], "fra": ["les", "une", "dans"]}
    rows = [(x, " ".join(rng.choice(words[x], 9)), 0, f"{k:04}") for x in words for k in range(60)]
    corpus = lambda langs, limit: spark.createDataFrame(rows[:60][:limit] + rows[60:][:limit], "lang string, text string, source_ord int, pos string")
    langs, how = {"latin": ["eng", "fra"]}, {"lr": 0.02, "data_limit": 50}
    plans = {
        "wide": {"langs": langs, "sizes": {"latin": (9, 12, 9, 4, 2)}, "epochs": {"latin": 6}, "train": how},
        "lean": {"prune_from": "wide", "langs": langs, "sizes": {"latin": (5, 6, 4, 0, 0)}, "epochs": {"latin": 6}, "train": {**how, "truncate_aug": 0.5}, "qat_pq": {"groups": ["latin"], "epochs": 2, "k": 8, "d": 2}},
    }
    out = experiment.run(spark, corpus, "lean", folder=str(tmp_path / "lean"), experiments=plans)
    m = out.models["latin"]
    assert {n: len(v) for n, v in m.vocab.items()} == {1: 5, 2: 6, 3: 4, 4: 0, 5: 0} and m.codebook.shape == (8, 2) and m.accuracy > 80
    assert all(v == sorted(v, key=str.encode) for v in m.vocab.values())
    assert out.report(spark).first()["params"] == 2 * 15 + 2 and out.loss_rows(spark).count() == 6
    back = M.load(spark, str(tmp_path / "lean"))["latin"]
    assert np.allclose(back.weights, m.weights) and np.allclose(back.codebook, m.codebook) and binary.loads(binary.dumps(back)).codebook.shape == (8, 2)
    again = experiment.run(spark, corpus, "lean", preset=str(tmp_path / "lean"), experiments=plans)
    assert set(again.models["latin"].features) == set(m.features)
    rows_of = experiment.prepare(corpus(None, 50), M.Training(truncate_aug=0.5))
    assert (rows_of.where("is_train").count(), rows_of.where("NOT is_train").count()) == (120, 20)
    with pytest.raises(ValueError, match="lacks groups"):
        experiment.run(spark, corpus, "linear_mega_5g", preset=str(tmp_path / "lean"))


def test_sources(spark, tmp_path):
    long = "x" * 50
    (tmp_path / "tatoeba.csv").write_text(f"1\teng\tshort\n2\teng\t{long}\n3\tfra\tbon\n4\teng\ttoo\tmany\n5\tzzz\tno\n")
    (tmp_path / "udhr/declaration").mkdir(parents=True)
    (tmp_path / "udhr/declaration/por_BR.html").write_text("<p> <b>Todos os seres</b> humanos </p><p>curto</p><P>Outro texto longo</P>")
    name = corpora.NEWS["est"]
    (tmp_path / f"leipzig/{name}").mkdir(parents=True)
    (tmp_path / f"leipzig/{name}/{name}-sentences.txt").write_text("1\tTere hommikust kõigile\n2\tlühike\nbroken\n")
    got = corpora.merged(spark, str(tmp_path), ["eng", "por", "est"], limit=1).orderBy("source_ord").collect()
    assert [(r["lang"], r["text"]) for r in got] == [("eng", long), ("por", "Todos os seres humanos"), ("est", "Tere hommikust kõigile")]
    assert corpora.merged(spark, str(tmp_path / "none"), ["eng"]).count() == 0
    assert len(corpora.DECLARATION_CODES) == 48 and len(set(corpora.DECLARATION_CODES.values())) == 46 and len(corpora.NEWS) == 9
    for code in ("por_PT", "srp_latn", "eng", "zzz"):
        (tmp_path / f"udhr/declaration/{code}.html").write_text(f"<p>paragraph of {code}</p>")
    got = corpora.declarations(spark, str(tmp_path / "udhr/declaration"), ["por", "srp", "eng"]).collect()
    assert sorted((r["lang"], r["text"]) for r in got) == [("eng", "paragraph of eng"), ("por", "Todos os seres humanos"), ("por", "paragraph of por_PT"), ("srp", "paragraph of srp_latn")]
    many = tmp_path / f"leipzig/{name}/{name}-sentences.txt"
    many.write_text("".join(f"{k}\tsentence number {k}\n" for k in range(60)))
    assert corpora.news(spark, str(tmp_path / "leipzig"), ["est", "eng"], limit=20).count() == 20


def test_samples_and_accuracy(spark):
    docs = spark.createDataFrame([(i, "a" if i % 3 else "b", "word " * i) for i in range(30)], "doc_id long, lang string, text string")
    kept = sampling.with_fallback(docs, 12).groupBy("lang").agg(F.count("*").alias("n"), F.min(F.length("text")).alias("least")).collect()
    assert sorted((r["lang"], r["n"]) for r in kept) == [("a", 12), ("b", 10)]
    assert sampling.split(docs).where("is_train").count() == 24
    copies = sampling.truncated_copies(docs, 0.5).collect()
    assert len(copies) == 15 and all(len(r["text"]) <= r["size"] <= 40 for r in copies)
    acc = evaluation.accuracy(docs.withColumn("pred", F.when(F.col("doc_id") < 10, "a")), []).first()
    assert (acc["total"], acc["pass"]) == (30, 6)


def test_stream_scores_like_batch(spark, tmp_path):
    from polyglint.streaming.detection import detect_stream

    docs = spark.createDataFrame([("the cat",), ("日本語です",), ("é",)], "text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = detect_stream(spark.readStream.schema("text string").parquet(str(tmp_path / "in")), {"latin": TINY})
    query = stream.select("text", "lang_pred").writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    batch = detect_stream(docs, {"latin": TINY}).select("text", "lang_pred")
    assert sorted(map(tuple, spark.table("found").collect())) == sorted(map(tuple, batch.collect()))


def test_stream_counts_by_window(spark, tmp_path):
    from polyglint.streaming.detection import detect_stream, languages_by_window

    rows = [("the cat", "2024-01-01 00:01:00"), ("the the", "2024-01-01 00:02:00"), ("日本語です", "2024-01-01 00:04:59"), ("the", "2024-01-01 00:06:00")]
    docs = spark.createDataFrame(rows, "text string, at string").select("text", F.col("at").cast("timestamp").alias("at"))
    docs.write.parquet(str(tmp_path / "in"))
    stream = languages_by_window(detect_stream(spark.readStream.schema("text string, at timestamp").parquet(str(tmp_path / "in")), {"latin": TINY}), "at")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r["window"]["start"].minute, r["lang_pred"], r["n"]) for r in spark.table("windows").collect())
    want = sorted((r["m"], r["lang_pred"], r["n"]) for r in detect_stream(docs, {"latin": TINY}).groupBy((F.floor(F.minute("at") / 5) * 5).alias("m"), "lang_pred").agg(F.count("*").alias("n")).collect())
    assert got == want and (0, "jpn", 1) in got


def test_models_from_files(spark, tmp_path):
    """Compact files by path and by URL, and model tables, all give the same detections."""
    (tmp_path / "latin.bin").write_bytes(binary.dumps(TINY))
    M.save(spark, {"latin": binary.loads(binary.dumps(TINY))}, str(tmp_path / "tables"))
    found = [create(spark, source).initialize().detect("the thé") for source in ({"latin": str(tmp_path / "latin.bin")}, {"latin": f"file://{tmp_path}/latin.bin"}, str(tmp_path / "tables"))]
    assert found[0] == found[1] and [x for x, _ in found[0]] == [x for x, _ in found[2]] and found[0][0][1] == pytest.approx(found[2][0][1])
    data = bytearray(binary.dumps(TINY))
    data[2] = 99  # any mark but that of product quantisation is read as six bits
    assert np.allclose(binary.loads(bytes(data)).weights, binary.loads(binary.dumps(TINY)).weights)


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_duckdb(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    cur = con.execute(ORACLES[name])
    at = [[d[0] for d in cur.description].index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=str)


def test_trained_queries(spark):
    found = QUERIES["detect_trained"](spark, SF).where("doc_id >= 0").collect()
    langs = dict(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()))
    assert np.mean([CODES[langs[r["doc_id"]]] == r["lang_pred"] for r in found]) > 0.9
    assert all(r["same_names"] for r in QUERIES["codec_roundtrip"](spark, SF).collect())
    report = QUERIES["run_experiment"](spark, SF).first()
    assert (report["langs"], report["features"]) == (4, 110) and report["accuracy"] > 80
