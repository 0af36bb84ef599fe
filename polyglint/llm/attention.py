"""A one-layer causal self-attention model over subword ids, in numpy, and its corpus-wide scoring.

Words are cut into the longest pieces of a public vocabulary, of which the model uses the few that the training documents use most;
a byte that none of them covers is an escape and one of 256 bytes. A token attends to itself and to what stands before
it in its window, with a learned weight for each distance. The next token is predicted in two steps, its class of 16 ids
and then the id, each by a softmax over a row for the token itself plus what the attention gathers. Windows of 32 inputs
overlap by 8 and score their last 24, so that each token is scored once; many windows go through masked batched
attention at a time.

The rows for the token itself are the logarithms of how often pairs of ids follow each other in all training documents.
The attention is trained by gradient steps over windows of all training documents, data-parallel: windows are dealt to
rounds and in these to trainers, as many as there is text for, whose models are averaged in a tree after each round. Word
counts for the unigram base cover all training documents. They never meet in one place: packs of texts send sorted word
hashes and counts, by ranges of the hash, and get the sums back.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, crc_rest, release, table
from .packs import PACKED as _PACKED
from .packs import freeze, thaw
from .packs import rows as _rows
from .packs import values as _values

#: Ids: the end of a text (and what stands before its first token), pieces, and the escape; classes of SIDE ids each.
SIDE = 16
IDS, END, ESCAPE = SIDE * SIDE, 0, SIDE * SIDE - 1
#: Bytes of the longest piece that is considered; longer words are cut after so many bytes first.
PIECE_BYTES, LANE = 5, 64
#: Inputs of a window that only give context, inputs that are scored, and the width of the attention.
CONTEXT, SCORED, WIDTH = 8, 24, 16
SPAN = CONTEXT + SCORED
#: Windows that go through the attention at a time, when scoring and when training.
BATCH, LESSON = 80, 320
#: Rounds of training, in each of which a part of the packs is learnt from; models that are averaged at a time; the rate.
ROUNDS, MEANS, LEARN = 2, 64, 0.01
#: Text of a pack, of what is cut at a time, and in steps of the search for pieces; hashes in one range.
PACK_BYTES, TEXT_BYTES, CHUNK, RANGE_WORDS = 4 << 20, 1 << 20, 1 << 16, 1_000_000
#: The remainder of crc32(doc_id) modulo FOLDS that is held out, by contract.
FOLDS, HELD_OUT = 10, 0


def vocabulary(path: str | None = None) -> list[bytes]:
    """The pieces of a public vocabulary of ranks, a base64 piece and a number on each line."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines]


_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
#: Fixed numbers of the words' hash: one for each byte, and a factor with its inverse.
_BYTE = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)


class Words(NamedTuple):
    """Texts as one stream of lower-case words with a space before each; where they begin, with the end; and their texts."""

    stream: np.ndarray
    begin: np.ndarray
    text: np.ndarray
    texts: int

    @classmethod
    def of(cls, texts: list[bytes]) -> Words:
        data = np.frombuffer(b" ".join([b"", *texts, b""]).translate(_PLAIN), np.uint8)
        space = data == 32
        heads = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        keep = ~space
        keep[heads - 1] = True
        stream = data[keep]
        starts = np.cumsum([1, *[len(t) + 1 for t in texts]])
        return cls(stream, np.append(np.flatnonzero(stream == 32), len(stream)), np.searchsorted(starts, heads, "right") - 1, len(texts))

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.text, minlength=self.texts)

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words: sums of bytes times powers, from running sums over the stream."""
        out, at, size = np.empty(len(self.text), np.uint64), 0, 1 << 16
        forward = np.cumprod(np.full(size, _STEP, np.uint64))
        back = np.cumprod(np.full(size, pow(_STEP, -1, 1 << 64), np.uint64))
        while at < len(out):
            end = max(at + 1, int(np.searchsorted(self.begin, self.begin[at] + size, "right")) - 1)
            first, last = self.begin[at:end] - self.begin[at], self.begin[at + 1 : end + 1] - self.begin[at]
            if last[-1] > len(forward):  # a word longer than that
                forward = np.cumprod(np.full(int(last[-1]), _STEP, np.uint64))
                back = np.cumprod(np.full(int(last[-1]), pow(_STEP, -1, 1 << 64), np.uint64))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[self.stream[self.begin[at] : self.begin[end]]] * forward[: last[-1]])])
            found = (sums[last] - sums[first]) * back[first]
            found = (found ^ (found >> np.uint64(31))) * _MIX
            out[at:end] = found ^ (found >> np.uint64(29))
            at = end
        return out


class Trie:
    """Byte strings, of which it finds the longest from each place on."""

    def __init__(self, strings: list[bytes]):
        steps: list[dict[int, int]] = [{}]
        final = [0]
        for k, s in enumerate(strings):
            node = 0
            for b in s:
                if b not in steps[node]:
                    steps[node][b] = len(steps)
                    steps.append({})
                    final.append(0)
                node = steps[node][b]
            final[node] = k + 1
        self.final = np.array(final, np.int32)
        self.step = np.zeros(256 * len(steps), np.int32)
        for node, own in enumerate(steps):
            for b, to in own.items():
                self.step[256 * node + b] = to
        # nodes that end no search, and what two bytes come to: the longest string, its length and the node, if it goes on
        self.open = np.array([len(own) > 0 for own in steps])
        one = self.step[:256]
        two = np.where(one[:, None] > 0, self.step[256 * one[:, None] + np.arange(256)], 0).ravel()
        self.found = np.where(self.final[two] > 0, self.final[two], np.repeat(self.final[one], 256))
        self.size = np.where(self.final[two] > 0, 2, 1).astype(np.uint8)
        self.node = np.where(self.open[two], two, 0)

    def longest(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place the number of the longest string there, from 1 on, and its length; 0 and 1 if there is none."""
        found, size = np.zeros(len(stream), np.int32), np.ones(len(stream), np.uint8)
        if len(stream):
            found[-1] = self.final[self.step[stream[-1]]]
        for a in range(0, len(stream) - 1, CHUNK):
            part = stream[a : a + CHUNK + PIECE_BYTES]
            code = (part[:CHUNK].astype(np.uint16) << np.uint16(8))[: len(part) - 1] | part[1 : CHUNK + 1]
            found[a : a + len(code)], size[a : a + len(code)] = self.found[code], self.size[code]
            node, depth = self.node[code], 2
            live = np.flatnonzero(node)
            node = node[live]
            while len(live):
                inside = np.searchsorted(live, len(part) - depth)
                live = live[:inside]
                node = self.step[(node[:inside] << 8) + part[live + depth]]
                on = np.flatnonzero(node)
                live, node, depth = live[on], node[on], depth + 1
                full = np.flatnonzero(number := self.final[node])
                found[a + live[full]], size[a + live[full]] = number[full], depth
                on = np.flatnonzero(self.open[node])
                live, node = live[on], node[on]
        return found, size

    def cut(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of the words begin, the longest first from left to right, and their numbers, 0 for a lone byte.

        All words are gone through abreast, each within itself; parts of LANE bytes of a long word count as words.
        """
        stream, (found, size) = words.stream, self.longest(words.stream)
        at, stop = words.begin[:-1], words.begin[1:]
        parts = -(-(stop - at) // LANE)
        if len(parts) and parts.max() > 1:
            place = LANE * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
            stop = np.minimum(np.repeat(at, parts) + place + LANE, np.repeat(stop, parts))
            at = np.repeat(at, parts) + place
        token = np.zeros(len(stream), bool)
        while len(at):
            over = at[at + size[at] > stop]
            if len(over):
                found[over], size[over] = self.final[self.step[stream[over]]], 1
            token[at] = True
            at = at + size[at]
            on = np.flatnonzero(at < stop)
            at, stop = at[on], stop[on]
        begins = np.flatnonzero(token)
        return begins, found[begins]


class Ids(NamedTuple):
    """Texts as ids, one after the other, each with its end; and their sizes."""

    flat: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, words: Words, trie: Trie) -> Ids:
        begins, number = trie.cut(words)
        word = np.cumsum(words.stream[begins] == 32) - 1
        sizes = np.bincount(words.text[word], minlength=words.texts)
        flat = np.full(len(begins) + words.texts, END, np.uint8)
        flat[np.arange(len(begins)) + np.repeat(np.arange(words.texts), sizes)] = np.where(number > 0, number, ESCAPE)
        return cls(flat, sizes + 1)


def batched(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Lists of texts of some TEXT_BYTES together, or of one text."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > TEXT_BYTES:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield held


def candidates(pieces: list[bytes]) -> list[bytes]:
    """Those that may be the model's: short, and without white space but in front."""
    return [p for p in dict.fromkeys(pieces) if 0 < len(p) <= PIECE_BYTES and not any(b in b" \t\n\x0b\x0c\r" for b in p[1:])]


def uses(words: Words, trie: Trie, used: np.ndarray) -> None:
    """Adds to used how often each string of the trie, and behind them each lone byte, is a piece of the words."""
    begins, number = trie.cut(words)
    lone = number == 0
    used += np.bincount(np.where(lone, words.stream[begins].astype(np.int64) + len(used) - 256, number - 1), minlength=len(used))


def choose(used: dict[bytes, int]) -> list[bytes]:
    """The ESCAPE - 1 pieces of most use; the bytes of the alphabet are kept first, so that escapes are rare."""
    single: dict[bytes, int] = {}
    for p, n in used.items():
        for b in p:
            single[bytes([b])] = single.get(bytes([b]), 0) + n
    rank = lambda d: sorted(d, key=lambda p: (-d[p], p))
    first = rank(single)[:48]
    return (first + [p for p in rank(used) if p not in set(first)])[: ESCAPE - 1]


def fresh(seed: int = 0) -> dict[str, np.ndarray]:
    """The attention's parameters before training: near uniform."""
    rng = np.random.default_rng(seed)
    part = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return {
        "query": part(IDS, WIDTH), "key": part(IDS, WIDTH), "value": part(IDS, WIDTH), "distance": np.linspace(0, -1, SPAN).astype(np.float32),
        "class_out": part(WIDTH, SIDE), "id_out": part(SIDE, WIDTH, SIDE),
    }


def direct(pairs: np.ndarray) -> dict[str, np.ndarray]:
    """The rows for the token itself, from how often each id follows each (IDS, IDS): logarithms of shares, a little evened out."""
    by_id = pairs.reshape(IDS, SIDE, SIDE).astype(np.float64) + 0.1
    by_class = pairs.reshape(IDS, SIDE, SIDE).sum(axis=2) + 0.1
    return {"class_direct": np.log(by_class / by_class.sum(axis=1, keepdims=True)).astype(np.float32), "id_direct": np.log(by_id / by_id.sum(axis=2, keepdims=True)).astype(np.float32)}


class Windows:
    """Ids laid out in windows; only the scored part of a window has targets."""

    def __init__(self, ids: Ids):
        flat, sizes = ids
        count = -(-sizes // SCORED)
        room = CONTEXT + count * SCORED
        begin = np.cumsum(room) - room
        self.inputs = np.zeros(int(room.sum()), np.uint8)
        self.targets = np.zeros(len(self.inputs), np.uint8)
        first = np.cumsum(sizes) - sizes
        to = np.arange(len(flat)) + np.repeat(begin + CONTEXT - first, sizes)
        self.targets[to] = flat
        inner = np.ones(len(flat), bool)
        inner[first] = False
        self.inputs[to[inner]] = flat[:-1][inner[1:]] if len(flat) else flat
        self.real = np.zeros(len(self.inputs), bool)
        self.real[to] = True
        self.text = np.repeat(np.arange(len(sizes)), count)
        self.number = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        self.begin = np.repeat(begin, count) + self.number * SCORED

    def taken(self, at: np.ndarray) -> Taken:
        whole = self.begin[at, None] + np.arange(SPAN)
        return Taken(self.inputs[whole], self.targets[whole[:, CONTEXT:]], self.real[whole[:, CONTEXT:]], self.number[at] == 0)


class Taken(NamedTuple):
    """Some windows: inputs (n, SPAN), targets and whether they are real (n, SCORED), and whether they are a text's first."""

    inputs: np.ndarray
    targets: np.ndarray
    real: np.ndarray
    first: np.ndarray

    def rows(self, at: np.ndarray) -> Taken:
        return Taken(*(x[at] for x in self))


_AHEAD = np.where(np.arange(SCORED)[:, None] + CONTEXT - np.arange(SPAN)[None] < 0, np.float32(-1e9), np.float32(0))
_APART = np.maximum(np.arange(SCORED)[:, None] + CONTEXT - np.arange(SPAN)[None], 0)


class Attention:
    """Masked attention over batches of windows, in buffers that are made once."""

    def __init__(self, model: dict[str, np.ndarray], most: int):
        self.model, kind = model, model["query"].dtype
        self.keys, self.values = np.empty((most, SPAN, WIDTH), kind), np.empty((most, SPAN, WIDTH), kind)
        self.queries, self.context = np.empty((most, SCORED, WIDTH), kind), np.empty((most, SCORED, WIDTH), kind)
        self.weights, self.sums = np.empty((most, SCORED, SPAN), kind), np.empty((most, SCORED, 1), kind)

    def gather(self, inputs: np.ndarray, first: np.ndarray) -> np.ndarray:
        """What the scored inputs (n, SPAN) of windows gather (n, SCORED, WIDTH)."""
        n, m = len(inputs), self.model
        np.take(m["query"], inputs[:, CONTEXT:], axis=0, out=self.queries[:n], mode="clip")
        np.take(m["key"], inputs, axis=0, out=self.keys[:n], mode="clip")
        np.take(m["value"], inputs, axis=0, out=self.values[:n], mode="clip")
        w = np.matmul(self.queries[:n], self.keys[:n].transpose(0, 2, 1), out=self.weights[:n])
        w += m["distance"][_APART] + _AHEAD.astype(w.dtype)
        head = np.flatnonzero(first)
        if len(head):
            w[head, :, :CONTEXT] = -1e9
        np.exp(w, out=w)
        np.sum(w, axis=2, keepdims=True, out=self.sums[:n])
        context = np.matmul(w, self.values[:n], out=self.context[:n])
        context /= self.sums[:n]
        return context


def log10_scores(model: dict[str, np.ndarray], texts: Ids) -> np.ndarray:
    """log10 probability of each text; each token counts once. model: fresh() and direct()."""
    windows, attention = Windows(texts), Attention(model, BATCH)
    out, rows, ones = np.zeros(len(texts.sizes)), BATCH * SCORED, np.ones(SIDE, np.float32)
    by_class, by_id, own, context = (np.empty((rows, k), np.float32) for k in (SIDE, SIDE, SIDE, WIDTH))
    pairs = model["id_direct"].reshape(IDS * SIDE, SIDE)
    for a in range(0, len(windows.begin), BATCH):
        at = np.arange(a, min(a + BATCH, len(windows.begin)))
        n = len(at) * SCORED
        inputs = windows.inputs[windows.begin[at, None] + np.arange(SPAN)]
        gathered = attention.gather(inputs, windows.number[at] == 0)
        place = (windows.begin[at, None] + np.arange(CONTEXT, SPAN)).ravel()
        target = windows.targets[place]
        # rows in order of the target's class, so that each class is one product
        order = np.argsort(target >> 4, kind="stable")
        target, now, place = target[order], inputs[:, CONTEXT:].ravel()[order], place[order]
        kind = target >> 4
        np.take(gathered.reshape(n, WIDTH), order, axis=0, out=context[:n], mode="clip")
        np.dot(context[:n], model["class_out"], out=by_class[:n])
        by_class[:n] += np.take(model["class_direct"], now, axis=0, out=own[:n], mode="clip")
        cuts = np.searchsorted(kind, np.arange(SIDE + 1)).tolist()
        for k in range(SIDE):
            if cuts[k + 1] > cuts[k]:
                np.dot(context[cuts[k] : cuts[k + 1]], model["id_out"][k], out=by_id[cuts[k] : cuts[k + 1]])
        by_id[:n] += np.take(pairs, now.astype(np.int32) * SIDE + kind, axis=0, out=own[:n], mode="clip")
        every = np.arange(n)
        found = (by_class[every, kind] + by_id[every, target & 15]).astype(np.float64)
        found -= np.log((np.exp(by_class[:n], out=by_class[:n]) @ ones).astype(np.float64) * (np.exp(by_id[:n], out=by_id[:n]) @ ones))
        found[~windows.real[place]] = 0
        out += np.bincount(windows.text[at[order // SCORED]], found, len(out))
    escapes = np.add.reduceat(texts.flat == ESCAPE, np.cumsum(texts.sizes) - texts.sizes, dtype=np.int64) if len(out) else 0
    return out / np.log(10) - escapes * np.log10(256)


def _sums(ids: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of values by their ids, of which there are size."""
    order = np.argsort(ids, kind="stable")
    ranked = ids[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    out = np.zeros((size, values.shape[1]), values.dtype)
    out[ranked[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def gradients(attention: Attention, windows: Taken, measure: bool = True) -> tuple[dict[str, np.ndarray], float, int]:
    """Gradients of the mean cross-entropy over windows for the attention's parameters, the sum of losses (if measured) and the tokens."""
    model, m = attention.model, len(windows.inputs)
    n = m * SCORED
    gathered = attention.gather(windows.inputs, windows.first)
    query, key, value = attention.queries[:m], attention.keys[:m], attention.values[:m]
    weight = np.divide(attention.weights[:m], attention.sums[:m], out=attention.weights[:m])
    real = windows.real.ravel()
    order = np.argsort(windows.targets.ravel() >> 4, kind="stable")
    target, now, real, context = windows.targets.ravel()[order], windows.inputs[:, CONTEXT:].ravel()[order], real[order], gathered.reshape(n, WIDTH)[order]
    kind, last, tokens = (target >> 4).astype(np.int64), (target & 15).astype(np.int64), max(1, int(real.sum()))
    share, every = (real / tokens).astype(weight.dtype)[:, None], np.arange(n)
    cuts = np.searchsorted(kind, np.arange(SIDE + 1)).tolist()
    by_id = np.empty((n, SIDE), weight.dtype)
    spans = [(k, slice(cuts[k], cuts[k + 1])) for k in range(SIDE) if cuts[k + 1] > cuts[k]]
    for k, rows in spans:
        np.dot(context[rows], model["id_out"][k], out=by_id[rows])
    by_class = context @ model["class_out"]
    by_class += np.take(model["class_direct"], now, axis=0)
    by_id += np.take(model["id_direct"].reshape(IDS * SIDE, SIDE), now.astype(np.int64) * SIDE + kind, axis=0)
    loss = 0.0
    for logits, wanted in ((by_class, kind), (by_id, last)):
        np.exp(logits, out=logits)
        logits /= (logits @ np.ones((SIDE, 1), logits.dtype))
        flat = every * SIDE + wanted
        own = np.take(logits, flat)
        if measure:
            loss -= float(np.log(np.maximum(own, 1e-30))[real].sum())
        logits.reshape(-1)[flat] = own - 1
        logits *= share
    grads = {"class_out": context.T @ by_class, "id_out": np.zeros_like(model["id_out"])}
    sorted_back = by_class @ model["class_out"].T
    for k, rows in spans:
        grads["id_out"][k] = context[rows].T @ by_id[rows]
        sorted_back[rows] += by_id[rows] @ model["id_out"][k].T
    back = np.empty_like(sorted_back)
    back[order] = sorted_back
    back = back.reshape(m, SCORED, WIDTH)
    d_score = back @ value.transpose(0, 2, 1)
    d_score -= np.einsum("ijk,ijk->ij", d_score, weight)[:, :, None]
    d_score *= weight
    d_query = d_score @ key
    d_both = np.concatenate([d_score.transpose(0, 2, 1) @ query, weight.transpose(0, 2, 1) @ back], axis=2)
    grads["query"] = _sums(windows.inputs[:, CONTEXT:].ravel(), d_query.reshape(n, WIDTH), IDS)
    both = _sums(windows.inputs.ravel(), d_both.reshape(-1, 2 * WIDTH), IDS)
    grads["key"], grads["value"] = both[:, :WIDTH], both[:, WIDTH:]
    grads["distance"] = np.bincount(_APART.ravel(), d_score.sum(axis=0).ravel() * (_AHEAD.ravel() == 0), SPAN).astype(weight.dtype)
    return grads, loss, tokens


def train(model: dict[str, np.ndarray], lessons: Iterator[Taken], learn: float = LEARN) -> tuple[dict[str, np.ndarray], int]:
    """Adam over batches of windows; returns the attention's new parameters and the tokens seen."""
    # all parameters are views of one array, so that a step is a few operations
    names, at, own = sorted(fresh()), 0, {}
    theta = np.concatenate([model[k].ravel() for k in names])
    for k in names:
        own[k] = theta[at : at + model[k].size].reshape(model[k].shape)
        at += model[k].size
    attention = Attention({**model, **own}, LESSON)
    mean, square, step, seen = np.zeros_like(theta), np.zeros_like(theta), 0, 0
    for windows in lessons:
        order = np.random.default_rng(step).permutation(len(windows.inputs))
        for a in range(0, len(order), LESSON):
            grads, _, tokens = gradients(attention, windows.rows(order[a : a + LESSON]), False)
            g = np.concatenate([grads[k].ravel() for k in names])
            step, seen = step + 1, seen + tokens
            rate = learn * min(1.0, step / 20) / (1 + step / 500)
            mean += 0.1 * (g - mean)
            square += 0.01 * (g * g - square)
            theta -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return own, seen


def _flat(model: dict[str, np.ndarray]) -> bytes:
    return b"".join(model[k].astype("<f4").tobytes() for k in sorted(fresh()))


def _full(data: bytes) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, v in sorted(fresh().items()):
        out[k] = np.frombuffer(data, "<f4", v.size, at).reshape(v.shape).copy()
        at += 4 * v.size
    return out


def useful_pieces(texts: DataFrame, pieces: list[bytes]) -> list[bytes]:
    """The model's pieces, counted over all texts (one column, not null)."""
    strings = candidates(pieces)
    known = texts.sparkSession.sparkContext.broadcast(strings)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, used = Trie(known.value), np.zeros(len(known.value) + 256, np.int64)
        for part in batched(t.encode("utf-8", "replace") for (t,) in _values(batches)):
            uses(Words.of(part), trie, used)
        some = np.flatnonzero(used)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(used[some])], ["piece", "n"])

    # no more rows than the public vocabulary has short pieces, and single bytes
    used: dict[bytes, int] = {}
    for r in texts.mapInArrow(count, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        piece = strings[r["piece"]] if r["piece"] < len(strings) else bytes([r["piece"] - len(strings)])
        used[piece] = used.get(piece, 0) + r["n"]
    return choose(used)


def lessons(batches: Iterator[pa.RecordBatch]) -> Iterator[Taken]:
    """All windows of the texts of packs that train."""
    for (payload,) in _values(batches, 1):
        (_, _, train, _, lengths, _), body = thaw(payload)
        for at, end, ids in _parts(np.frombuffer(body, np.uint8), lengths):
            windows, own = Windows(ids), train[at:end] > 0
            taken = np.flatnonzero(own[windows.text])
            if len(taken):
                yield windows.taken(taken)


def _parts(flat: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, Ids]]:
    """Ranges of texts of some TEXT_BYTES ids together, or of one text, with their ids."""
    cuts, at = np.concatenate([[0], np.cumsum(lengths)]), 0
    while at < len(lengths):
        end = max(at + 1, int(np.searchsorted(cuts, cuts[at] + TEXT_BYTES, "right")) - 1)
        yield at, end, Ids(flat[cuts[at] : cuts[end]], lengths[at:end])
        at = end


def trained(packed: DataFrame) -> dict[str, np.ndarray]:
    """A model from the pairs (kind 5) and ids (kind 0) of packs. Without any it stays untrained.

    Each partition of packs is a trainer, so that no text is moved and trainers grow with the corpus. In each round it takes
    some of its packs; the models are averaged, by tokens seen, MEANS at a time.
    """
    context = packed.sparkSession.sparkContext
    pairs = np.zeros(IDS * IDS, np.int64)
    # no more rows than pairs of ids
    for r in packed.where("kind = 5").groupBy("pack").agg(F.sum("bin").alias("n")).collect():
        pairs[r["pack"]] = r["n"]
    model = fresh() | direct(pairs.reshape(IDS, IDS))
    trainers = packed.rdd.getNumPartitions()
    for k in range(ROUNDS):
        start = context.broadcast(model)

        def learn(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            own, seen = train(start.value, lessons(batches))
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([seen], pa.int64()), pa.array([_flat(own)], pa.binary())], ["part", "seen", "model"])

        part = packed.where((F.col("kind") == 0) & (F.pmod(F.xxhash64("pack"), F.lit(ROUNDS)) == k)).select("payload")
        found, left = part.mapInArrow(learn, "part long, seen long, model binary"), trainers
        while left > MEANS:
            left = -(-left // MEANS)
            found = found.withColumn("part", F.col("part") % left).groupBy("part").applyInArrow(_average, "part long, seen long, model binary")
        got = found.toArrow()
        if got.num_rows:
            model |= _full(_average(got).column("model")[0].as_py())
    return model


def fit(docs: DataFrame, pieces: list[bytes] | None = None) -> tuple[list[bytes], dict[str, np.ndarray]]:
    """The model's pieces and parameters, from docs (doc_id, text). Null texts are empty; without rows it stays untrained.

    Pieces and pairs are counted over all text, and every window is learnt from once.
    """
    rows = docs.select("doc_id", F.lit(False).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chosen = useful_pieces(rows.select("text"), pieces if pieces is not None else vocabulary())
    return chosen, trained(checkpoint(rows.mapInArrow(_packer(chosen, 1), _PACKED)))


def _average(group: pa.Table) -> pa.Table:
    """Models and the tokens they have seen to their weighted mean and all tokens."""
    seen = group.column("seen").to_pylist()
    mean = sum(np.frombuffer(m.as_py(), "<f4") * (n / sum(seen)) for m, n in zip(group.column("model"), seen, strict=True))
    return pa.table({"part": group.column("part").slice(0, 1), "seen": pa.array([sum(seen)], pa.int64()), "model": pa.array([mean.astype("<f4").tobytes()], pa.binary())})


def _packer(chosen: list[bytes], ranges: int):
    """(doc_id, held_out, text) to packs of ids (kind 0); by range of hashes, a pack's words with their counts in training
    (kind 1); and pairs of ids with their counts in training (kind 5)."""

    def emit(pack: int, ids: list[int], held: list[bool], texts: list[bytes], trie: Trie, pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
        train = ~np.array(held, bool)
        sizes, hashes, flat, lengths, at = [], [], [], [], 0
        for part in batched(iter(texts)):
            words = Words.of(part)
            own, learn = Ids.of(words, trie), train[at : at + len(part)]
            at += len(part)
            sizes.append(words.counts)
            hashes.append(words.hashes())
            flat.append(own.flat)
            lengths.append(own.sizes)
            before = np.concatenate([[END], own.flat[:-1]]).astype(np.int64)
            pairs += np.bincount((before * IDS + own.flat)[np.repeat(learn, own.sizes)], minlength=IDS * IDS)
        sizes = np.concatenate(sizes)
        hashes, place = np.unique(np.concatenate(hashes), return_inverse=True)
        missing = np.array([i is None for i in ids], np.int64)
        body = np.concatenate(flat).tobytes()
        yield _rows([(0, pack, 0, freeze([pa.array(ids, pa.int64()).fill_null(0).to_numpy(), missing, train.astype(np.int64), sizes, np.concatenate(lengths), place], body))])
        counts = np.bincount(place[np.repeat(train, sizes)], minlength=len(hashes))
        share = (hashes.astype(np.float64) * (ranges / 2.0**64)).astype(np.int64).clip(0, ranges - 1)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(share)) + 1, [len(share)]]).tolist()
        rows = [(1, pack, int(share[a]), freeze([np.diff(hashes[a:b], prepend=np.uint64(0)), counts[a:b]])) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
        if rows:
            yield _rows(rows)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 32, 0
        trie, pairs = Trie(chosen), np.zeros(IDS * IDS, np.int64)
        ids, held, texts = [], [], []
        for doc, out, text in _values(batches):
            ids.append(doc)
            held.append(out)
            texts.append((text or "").encode("utf-8", "replace"))
            size += len(texts[-1]) + 16
            if size >= PACK_BYTES:
                yield from emit(number, ids, held, texts, trie, pairs)
                number, size, ids, held, texts = number + 1, 0, [], [], []
        if ids:
            yield from emit(number, ids, held, texts, trie, pairs)
        some = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), 5), pa.int32()), pa.array(some), pa.array(pairs[some]), pa.nulls(len(some), pa.binary())], ["kind", "pack", "bin", "payload"])

    return pack


def _summed(group: pa.Table) -> pa.Table:
    """One range of word hashes to each pack's counts over the corpus, in the order of its hashes, and in pack and bin (kind 3) all counts and how many words have one."""
    packs, parts = group.column("pack").to_pylist(), [thaw(p)[0] for p in group.column("payload").to_pylist()]
    cuts = np.cumsum([0, *(len(p[0]) for p in parts)])
    _, number = np.unique(np.concatenate([np.cumsum(p[0].view(np.uint64)) for p in parts]), return_inverse=True)
    total = np.zeros(int(number.max(initial=-1)) + 1, np.int64)
    np.add.at(total, number, np.concatenate([p[1] for p in parts]))
    bin_ = group.column("bin")[0].as_py()
    rows = [(2, p, bin_, freeze([total[number[a:b]]])) for p, a, b in zip(packs, cuts[:-1], cuts[1:], strict=True)]
    rows.append((3, int(total.sum()), int((total > 0).sum()), b""))
    return pa.Table.from_batches([_rows(rows)])


_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, pieces: list[bytes] | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs (doc_id long, text, ...).

    Rows whose crc32(doc_id) modulo FOLDS is not HELD_OUT train the model and the base. Texts are lower-cased from A to
    Z; words are what white space parts, then one end. A null text is empty, one token; a null doc_id counts as '' and
    trains or not by that. Words are told apart by 64 bits of hash. Texts of any length are scored whole, repeated
    rows alike, other columns are ignored, and an empty table gives no rows.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_rest("doc_id", FOLDS) == HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))
    total, ends = source.agg(F.sum(F.octet_length("text").cast("long")), F.sum((~F.col("held_out")).cast("long"))).first()
    ends = ends or 0
    chosen = useful_pieces(source.where("NOT held_out").select(F.coalesce("text", F.lit("")).alias("text")), pieces if pieces is not None else vocabulary())
    ranges = max(1, -(-(total or 0) // (RANGE_WORDS * 40)))
    packed = checkpoint(source.mapInArrow(_packer(chosen, ranges), _PACKED))
    model = trained(packed)
    release(docs.sparkSession)
    summed = checkpoint(packed.where("kind = 1").groupBy("bin").applyInArrow(_summed, _PACKED))
    words = summed.where("kind = 3").agg(F.sum("pack"), F.sum("bin")).first()
    n, v = (words[0] or 0) + ends, (words[1] or 0) + (ends > 0)
    by_pack = summed.where("kind = 2").groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("bin", "payload"))).alias("parts")).select("pack", F.col("parts.payload").alias("counts"))
    joined = packed.where("kind = 0").select("pack", "payload").join(by_pack, "pack", "left").select("payload", "counts")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for payload, counts in _values(batches, 1):
            yield _scored(payload, counts or [], shared.value, n, v, ends)

    return joined.mapInArrow(finish, _SCHEMA)


def _scored(payload: bytes, counts: list[bytes], model: dict, n: int, v: int, ends: int) -> pa.RecordBatch:
    (ids, missing, train, sizes, lengths, place), body = thaw(payload)
    size = len(ids)
    c = np.concatenate([thaw(x)[0][0] for x in counts]) if counts else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(size), sizes)
    logs = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    base = np.bincount(owner, logs[place], size) + np.log10((ends + 0.1) / (n + 0.1 * (v + 1)))
    known = np.bincount(owner, c[place] > 0, size).astype(np.int64) + (ends > 0)
    scores = [log10_scores(model, part) for _, _, part in _parts(np.frombuffer(body, np.uint8), lengths)]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64(), mask=missing > 0), pa.array(train == 0, pa.bool_()), pa.array(sizes + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(list(repeat(n, size)), pa.int64()), pa.array(base, pa.float64()), pa.array(np.concatenate(scores), pa.float64())],
        [c.split()[0] for c in _SCHEMA.split(", ")],
    )


def op4(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
