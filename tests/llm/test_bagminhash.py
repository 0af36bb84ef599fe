import random
from collections import Counter

import numpy as np

from polyglint.llm import bagminhash as B

DOC = "doc_id long, text string, key string, bucket int"


def bag(text):
    words = text.split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def brute(rows):
    """Class by row: equal or similar texts, chained."""
    bags = [bag(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and 5 * sum((bags[i] & bags[j]).values()) >= 4 * sum((bags[i] | bags[j]).values()):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, least[root(i)]) for i, (d, _) in enumerate(rows))


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.6:
            base = rng.choice(out).split()
            for _ in range(rng.randrange(0, 4)):
                if base:
                    base[rng.randrange(len(base))] = rng.choice(words)
            out.append(" ".join(base))
        elif kind < 0.7:
            out.append(" ".join([rng.choice(words), rng.choice(words)] * rng.randrange(1, 40)))
        else:
            out.append(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 150))))
    return out


def test_classes_match_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(corpus(300, 7))]
    got = B.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.class_id) for r in got.collect()) == brute(rows)


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(50)]
    errors = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(60)] * rng.randrange(1, 4)
        other = list(base)
        for _ in range(rng.randrange(0, 12)):
            other[rng.randrange(len(other))] = rng.choice(words)
        texts = [" ".join(base), " ".join(other)]
        doc, shingle, weight = B.Bags.of([t.encode() for t in texts])
        a, b = B.sketch(doc, shingle, weight, 2)
        x, y = map(bag, texts)
        errors.append((a == b).mean() - sum((x & y).values()) / sum((x | y).values()))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def test_odd_rows(spark):
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, " \n", "x", 1), (4, "a b", "x", 1), (5, "a b", None, None), (5, "a b", None, None), (None, "a b", "y", 2), (7, "long " * 30_000, "y", 2)]
    docs = spark.createDataFrame(rows, DOC)
    got = sorted((r.doc_id or 0, r.class_id) for r in B.classes(docs).collect())
    assert got == [(0, 4), (1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (5, 4), (7, 7)]
    kept = B.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 7]
    assert B.classes(docs.limit(0)).count() == 0


def test_no_link_is_lost_in_a_large_bucket(spark):
    """Texts that share the pivot's bucket but only resemble each other in two families."""
    rng = random.Random(5)
    core = [f"c{k}" for k in range(200)]
    families = []
    for f in range(3):
        own = list(core)
        for k in range(f * 60, f * 60 + 8):
            own[k] = f"f{f}.{k}"
        families.append(own)
    rows = []
    for i in range(60):
        t = list(families[i % 3])
        t[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(t)))
    got = B.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.class_id) for r in got.collect()) == brute(rows)
