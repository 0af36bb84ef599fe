"""The pipeline against a plain version of its stages on a small table."""

import random
from collections import Counter, defaultdict

import corpus_pipeline as P
from plain import lpt, pour
from pyspark.sql import functions as F

from polyglint.llm import mixing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(900)]
    clean = [" ".join(rng.choice(vocab) for _ in range(60)) for _ in range(40)]
    bench = [" ".join(rng.choice(vocab) for _ in range(30)) for _ in range(3)]
    rows = [(k, t) for k, t in enumerate(clean)]
    rows += [(100 + k, t) for k, t in enumerate(clean[:6])]  # copies
    rows += [(200 + k, " ".join([*t.split()[:-1], "changed"])) for k, t in enumerate(clean[6:12])]  # near copies
    rows += [(300 + k, clean[20 + k] + " " + b + " " + clean[30 + k]) for k, b in enumerate(bench)]  # leaks
    rows += [(400, "too short"), (401, "again " * 40), (402, None), (403, "")]
    return [(d, t, rng.choice(["en", "fr"]), f"src{d % 5}", None) for d, t in rows], [(k, b) for k, b in enumerate(bench)]


def test_run(spark, tmp_path):
    rows, bench = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = set(range(40))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for name, stage in P.STAGES[:3]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
    by_id = {r[0]: r for r in rows}
    assert {r.doc_id for r in kept.collect()} == want
    assert sorted((r.doc_id, r.copies) for r in P.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.count("*").alias("copies")).collect()) == mixed(spark, [by_id[d] for d in want])
    got = P.run(spark, str(tmp_path)).collect()
    groups = Counter()
    for r in got:
        groups[r.doc_id] += r.size
        assert r.size == len(by_id[r.doc_id][1].encode()) + 1
    loads = Counter()
    for d, shards in {d: {r.shard for r in got if r.doc_id == d} for d in groups}.items():
        (shard,) = shards
        loads[shard] += groups[d]
    assert sorted(loads[k] for k in range(8)) == lpt(groups.values(), 8)
    assert not list(tmp_path.glob("pipeline-*"))


def mixed(spark, rows):
    """(doc_id, times taken) for the rows that are taken, all of 60 words and with texts of their own."""
    frame = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    hashes = frame.select("doc_id", *[F.xxhash64(F.lit(k), "doc_id", "text").alias(f"h{k}") for k in (0, 1)])
    for k in range(mixing.MAX_EPOCHS + 1):
        hashes = hashes.withColumn(f"e{k}", F.struct(*[F.xxhash64(F.lit(k).cast("long"), f"h{j}") for j in (0, 1)]))
    place = {r.doc_id: [tuple(r[f"e{k}"]) for k in range(mixing.MAX_EPOCHS + 1)] for r in hashes.collect()}
    leaves = defaultdict(list)
    for r in rows:
        leaves[mixing.DOMAINS[int(r[3][3:]) % 4], r[2], r[3]].append(r[0])
    plan = pour({k: 60 * len(v) for k, v in leaves.items()}, mixing.WEIGHTS, 60 * len(rows), mixing.MAX_EPOCHS)
    out = {}
    for leaf, docs in leaves.items():
        whole, part = divmod(plan[leaf], 60 * len(docs))
        extra = set(sorted(docs, key=lambda d: place[d][whole])[: part // 60])  # noqa: B023
        out |= {d: whole + (d in extra) for d in docs}
    return sorted((d, n) for d, n in out.items() if n)


def test_odd_rows(spark, tmp_path):
    """Nulls everywhere, repeated rows, a very long text and columns named like intermediate ones pass every stage."""
    rng = random.Random(3)
    long = " ".join(f"v{rng.randrange(5000)}" for _ in range(30_000))
    text = " ".join(f"u{rng.randrange(900)}" for _ in range(40))
    rows = [(1, long, "en", "src1"), (2, text, None, None), (2, text, None, None), (None, text + " more", "fr", "src2"), (3, None, None, None), (4, "", "en", "src1")]
    extra = {"key": "k", "bin": 1, "__host": "h", "__all": "a", "win": 2, "epochs": 3, "shard": 4, "__bad": 5, "own": 6, "place": 7}
    docs = spark.createDataFrame([(*r, 9) for r in rows], COLUMNS).withColumns({c: F.lit(v) for c, v in extra.items()})
    spark.createDataFrame([(None, None), (1, ""), (2, "nothing like it in the documents at all here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs
    for _, stage in P.STAGES[:3]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, long), (2, text)]
    kept = P.STAGES[3][1](spark, kept, str(tmp_path))
    assert kept.columns == docs.columns
    # the long text is more than its leaf's budget
    assert {r.doc_id for r in P.STAGES[4][1](spark, kept, str(tmp_path)).collect()} == {2}


def test_stages_pass_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in P.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
