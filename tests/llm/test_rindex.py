import hashlib
import random

import numpy as np
import pytest

from polyglint.llm import packs as P
from polyglint.llm import rindex as R


def brute(rows):
    """rows (doc_id or None, text or None) to the contract's results."""
    data = [(R.LAST if d is None else d, (t or "").encode()) for d, t in rows]
    least = {}
    for d, b in data:
        for i in range(len(b) - R.LENGTH + 1):
            w = b[i : i + R.LENGTH]
            least[w] = min(least.get(w, d), d)
    out = []
    for (d, b), (own, _) in zip(data, rows):
        gone = bytearray(len(b))
        for i in range(len(b) - R.LENGTH + 1):
            if least[b[i : i + R.LENGTH]] < d:
                gone[i : i + R.LENGTH] = b"\1" * R.LENGTH
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((own, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["ab", "é", "the", "tion", "x", "ñ", "\0", "lore", " ", "\n"]
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.5:
            a = rng.choice(out)
            i = rng.randrange(len(a) + 1)
            cut = a[i : i + rng.randrange(20, 120)]
            out.append("".join(rng.choice(words) for _ in range(rng.randrange(10))) + cut + "".join(rng.choice(words) for _ in range(rng.randrange(30))))
        elif kind < 0.6:
            out.append("Ofwhhean " * rng.randrange(1, 60))
        elif out and kind < 0.7:
            out.append(rng.choice(out))
        else:
            out.append("".join(rng.choice(words) for _ in range(rng.randrange(0, 200))))
    return out


def check(spark, rows, slices=4):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(slices)
    got = sorted((tuple(r) for r in R.remove_repeats(docs).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("small", [False, True])
def test_matches_brute_force(spark, monkeypatch, small):
    if small:  # many packs, ranges, slots and indexes
        for name, value in {"PACK_BYTES": 1500, "SLOT_BYTES": 500, "INDEX_BYTES": 300, "RANGE_HASHES": 40}.items():
            monkeypatch.setattr(R, name, value)
    texts = corpus(1)
    ids = list(range(len(texts)))
    random.Random(2).shuffle(ids)
    check(spark, list(zip(ids, texts)))


def test_a_line_in_every_document(spark, monkeypatch):
    for name, value in {"PACK_BYTES": 4000, "SLOT_BYTES": 3000}.items():
        monkeypatch.setattr(R, name, value)
    rng = random.Random(8)
    line = "".join(rng.choice("abcdefgh ") for _ in range(50))
    noise = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(60)))
    check(spark, [(i, noise() + line + noise()) for i in range(400)])


def test_strings_that_the_owner_of_the_anchor_lacks(spark, monkeypatch):
    """The first pack has the anchors alone; the strings around them repeat among later ones."""
    monkeypatch.setattr(R, "PACK_BYTES", 200)
    rng = random.Random(9)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    core = some(40)
    tails = [some(30) for _ in range(6)]
    check(spark, [(0, some(50) + core)] + [(i, some(50) + core + tails[i % 6]) for i in range(1, 40)])


def test_odd_rows(spark, monkeypatch):
    long = "".join(random.Random(4).choice("abcdefgh ") for _ in range(60_000))
    rows = [(1, None), (2, ""), (3, "short"), (3, "short"), (None, long[:80]), (None, long[:80]), (None, long[40:140]), (9, long), (9, long), (9, long[10:90]), (5, long[30_000:30_049]), (4, long[100:150]), (7, "a" * 300), (6, "a" * 60), (-5, long[50_000:50_100])]
    check(spark, rows)
    monkeypatch.setattr(R, "PACK_BYTES", 50)
    check(spark, rows)
    clash = spark.createDataFrame([(1, "x" * 60, 1, b"", 2), (2, "x" * 70, 1, b"", 2)], "doc_id long, text string, pack int, payload binary, bin int")
    assert sorted((r.doc_id, r.n_removed) for r in R.remove_repeats(clash).collect()) == [(1, 0), (2, 70)]
    assert R.remove_repeats(spark.createDataFrame([], "doc_id long, text string, n_bytes int")).count() == 0


def pieces(texts, docs):
    zero = np.zeros(len(texts), np.int64)
    return R.Pieces(zero, zero, np.array(docs, np.int64), texts)


def expected(texts, docs, others):
    least = {}
    for t, d in zip(texts, docs):
        for i in range(len(t) - R.LENGTH + 1):
            least[t[i : i + R.LENGTH]] = min(least.get(t[i : i + R.LENGTH], R.NEVER), d)
    return [least.get(t[i : i + R.LENGTH], R.NEVER) for t in others for i in range(len(t) - R.LENGTH + 1)]


def matched(texts, docs, others, **how):
    found, starts = R.earliest(pieces(texts, docs), others, **how)
    return [int(x) for a, b in zip(starts[:-1], starts[1:]) for x in found[a : b - R.LENGTH + 1]]


@pytest.mark.parametrize("how", [{}, {"index_bytes": 200, "lane": 7}])
def test_index_streams_foreign_texts(how):
    rng = random.Random(6)
    for _ in range(20):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(50, 90))).encode() for _ in range(12)]
        docs = rng.sample(range(12), 12)
        other = [t[5:40] + t[3:60] for t in texts] + [b"c" * 60, texts[0], b"b" + texts[1] + b"c"]
        assert matched(texts, docs, other, **how) == expected(texts, docs, other)


def test_index_tells_close_copies_apart():
    for seed in range(20):
        rng = random.Random(seed)
        passage = bytes(rng.choice(b"abcdefghijklmnop ") for _ in range(180))
        texts = sorted({bytes(rng.choice(b"abcdefghijklmnop ") if rng.random() < 0.03 else c for c in passage) for _ in range(70)})
        rng.shuffle(texts)
        assert matched(texts, range(len(texts)), texts) == expected(texts, range(len(texts)), texts)


def test_index_is_run_length_compressed():
    rng = random.Random(3)
    passage = bytes(rng.choice(b"abcdefghijklmnop ") for _ in range(2000))
    sizes = []
    for copies in (1, 50):
        texts = [passage[:k] + b"#" + passage[k:] for k in rng.sample(range(2000), copies)]
        index = R.RunIndex(texts, np.arange(len(texts)))
        sizes.append((len(index.table), len(index.earliest)))
    assert sizes[1][0] < 4 * sizes[0][0] and sizes[1][1] < 20 * sizes[0][1] + 4000


def test_numbers_come_back():
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64))
    (a, b), body = freeze_back([values, values[:0]], b"rest")
    assert (a.view(np.uint64) == values).all() and len(b) == 0 and body == b"rest"


def freeze_back(arrays, body):
    return P.thaw(P.freeze(arrays, body))
