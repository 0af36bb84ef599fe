import math
import zlib
from collections import Counter

import numpy as np
import pytest

from polyglint.llm import attention as A

PIECES = [bytes([b]) for b in b" abcdefghijklmnopqrstuvwxyz"] + [b" the", b"th", b"ing", b" an"]


def base(rows):
    """The contract's counts and base score, word by word."""
    texts = [(t or "").encode().lower().split() for _, t in rows]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in rows]
    counts = Counter(w for t, h in zip(texts, held) if not h for w in [*t, None])
    n, v = counts.total(), len(counts)
    out = []
    for (d, _), t, h in zip(rows, texts, held):
        tokens = [*t, None]
        out.append((d, h, len(tokens), sum(counts[w] > 0 for w in tokens), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)))
    return out


def test_counts_and_base(spark):
    rows = [(i, " ".join(["The thing"] * (i % 7) + [f"w{i % 13}\tand\x0bx y"])) for i in range(60)] + [(None, "The"), (61, None), (62, ""), (62, ""), (63, "long " * 20_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in A.score(docs, PIECES).collect()), key=str)
    want = sorted(base(rows), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(g[5] == pytest.approx(w[5], abs=1e-6) and g[6] < 0 for g, w in zip(got, want))
    assert A.score(docs.limit(0), PIECES).count() == 0


def plain(model, ids):
    """log10 probability, a token at a time, with the window that scores it."""
    total, inputs = 0.0, [A.END, *ids[:-1]]
    for t, target in enumerate(ids):
        begin = t // A.SCORED * A.SCORED - A.CONTEXT
        seen = range(max(0, begin), t + 1)
        q = model["query"][inputs[t]]
        w = np.array([math.exp(q @ model["key"][inputs[j]] + model["distance"][t - j]) for j in seen])
        context = sum(x * model["value"][inputs[j]] for x, j in zip(w / w.sum(), seen))
        kind, last = divmod(target, A.SIDE)
        by_class = model["class_direct"][inputs[t]] + context @ model["class_out"]
        by_id = model["id_direct"][inputs[t], kind] + context @ model["id_out"][kind]
        total += by_class[kind] - math.log(np.exp(by_class).sum()) + by_id[last] - math.log(np.exp(by_id).sum())
        total -= math.log(256) * (target == A.ESCAPE)
    return total / math.log(10)


def random_model(rng, scale, kind):
    return {k: rng.normal(0, scale, v.shape).astype(kind) for k, v in (A.fresh() | A.direct(np.zeros((A.IDS, A.IDS)))).items()}


def as_ids(texts):
    return A.Ids(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]))


def test_windows_score_each_token_once():
    rng = np.random.default_rng(0)
    model = random_model(rng, 0.5, np.float32)
    texts = [bytes([*rng.integers(1, A.IDS, n).tolist(), A.END]) for n in (0, 1, 30, 31, 32, 33, 200)]
    assert A.log10_scores(model, as_ids(texts)) == pytest.approx([plain(model, t) for t in texts], rel=1e-4)


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    attention = A.Attention(random_model(rng, 0.3, np.float64), 80)
    windows = A.Windows(as_ids([bytes([*rng.integers(1, A.IDS, 70).tolist(), A.END]), b"\0"]))
    taken = windows.taken(np.arange(len(windows.begin)))
    grads, _, tokens = A.gradients(attention, taken)
    assert tokens == 72 and set(grads) == set(A.fresh())
    for k, g in grads.items():
        i, own = np.unravel_index(np.abs(g).argmax(), g.shape), attention.model[k]
        own[i] += 1e-4
        up = A.gradients(attention, taken)[1]
        own[i] -= 2e-4
        down = A.gradients(attention, taken)[1]
        own[i] += 1e-4
        assert g[i] == pytest.approx((up - down) / (2e-4 * tokens), rel=1e-3)


def test_model_learns_held_out_text():
    """Words in turn, which pairs of ids alone can't tell: only what stands before them does."""
    trie, rng = A.Trie(PIECES), np.random.default_rng(2)
    make = lambda: b" ".join([b"the", b"thing", b"and"][(int(k) + j) % 3] for k in [rng.integers(3)] for j in range(60))
    texts = [A.Ids.of(A.Words.of([make() for _ in range(50)]), trie) for _ in range(6)]
    pairs = sum(np.histogram2d(np.append(A.END, t.flat[:-1]), t.flat, bins=(np.arange(A.IDS + 1),) * 2)[0] for t in texts[:5])
    start = A.fresh() | A.direct(pairs)
    every = [A.Windows(t).taken(np.arange(len(A.Windows(t).begin))) for t in texts[:5]]
    own, seen = A.train(start, (w for _ in range(20) for w in every))
    before, after = A.log10_scores(start, texts[5]).sum(), A.log10_scores(start | own, texts[5]).sum()
    assert seen == 20 * sum(len(t.flat) for t in texts[:5])
    assert after > 0.65 * before


def longest(word, pieces):
    """A word's pieces, the longest first; parts of LANE bytes of a longer one on their own."""
    out, word = [], b" " + word
    for a in range(0, len(word), A.LANE):
        part, at = word[a : a + A.LANE], 0
        while at < len(part):
            piece = max((p for p in pieces if part.startswith(p, at)), key=len, default=part[at : at + 1])
            out.append(piece)
            at += len(piece)
    return out


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_pieces_of_words(monkeypatch, chunk):
    monkeypatch.setattr(A, "TEXT_BYTES", chunk)
    rng = np.random.default_rng(3)
    texts = ["The  thing\tand", "", " \n", "xyz é qqthe", "a", "the" * 70 + " thean", "ing" * 300] + ["".join(rng.choice(list("thean gi\n"), 90)) for _ in range(30)]
    data = [t.encode() for t in texts]
    words = A.Words.of(data)
    assert words.counts.tolist() == [len(t.split()) for t in data]
    got, used = A.Ids.of(words, A.Trie(PIECES)), np.zeros(len(PIECES) + 256, np.int64)
    A.uses(words, A.Trie(PIECES), used)
    want, counts = [], Counter()
    for t in data:
        found = [p for w in t.lower().split() for p in longest(w, PIECES)]
        counts.update(found)
        want += [PIECES.index(p) + 1 if p in PIECES else A.ESCAPE for p in found] + [A.END]
    assert got.flat.tolist() == want and got.sizes.sum() == len(want)
    assert {(PIECES[k] if k < len(PIECES) else bytes([k - len(PIECES)])): n for k, n in enumerate(used.tolist()) if n} == counts


def test_word_hashes_tell_words_apart():
    texts = [b"a b ab ba", b"b  a\tAB x" + b"y" * 100_000, b"", b"x" + b"y" * 100_000 + b" x" + b"y" * 99_999, b"w1 " * 40_000]
    flat = [w for t in texts for w in t.lower().split()]
    hashes = A.Words.of(texts).hashes().tolist()
    assert len(hashes) == len(flat) and len(set(hashes)) == len(set(flat)) == len(set(zip(flat, hashes)))


def test_everything_is_counted_and_every_text_is_learnt_from(spark, monkeypatch):
    # more texts than a sample would take, and what stands late in a long one
    rows = [(i, f"the and {i}") for i in range(1, 900)] + [(900, "the " * 3_000 + "qq " * 3_000)] + [(901, "an")] * 50 + [(902, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(A, "MEANS", 2)
    pairs, seen, average = [], [], A._average
    # the driver's averages only: workers have their own list
    monkeypatch.setattr(A, "_average", lambda group: seen.append(average(group).column("seen")[0].as_py()) or average(group))
    monkeypatch.setattr(A, "direct", lambda p, real=A.direct: pairs.append(p) or real(p))
    pieces, model = A.fit(docs, PIECES)
    counts = Counter(p for _, t in rows for w in (t or "").encode().split() for p in longest(w, PIECES))
    assert pieces == A.choose(counts) and b"q" in pieces and pieces.index(b"q") < pieces.index(b"d")
    assert pairs[0].sum() == counts.total() + len(rows)
    assert all(np.isfinite(v).all() for v in model.values()) and any((model[k] != v).any() for k, v in A.fresh().items())
    # every token of every text is learnt from, each once
    assert sum(seen) == pairs[0].sum()
