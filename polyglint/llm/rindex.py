"""Removal of repeated 50-byte strings through run-length indexes.

The corpus is put in order of doc_id and cut into packs. Every 50-byte window of a text has an anchor, the 24-byte string
in it of least hash, so equal windows have equal anchors wherever they stand. Packs send the hashes of their anchors to
ranges of the hash, and learn for each one that several documents have which pack is the first with it, its owner. What
lies around such anchors goes to their owners in long regions: a passage that was copied goes as one region to the pack
that had it first, an anchor that is in every document brings each region to one pack in bounded slots.

An owner indexes its own such regions: a run-compressed Burrows-Wheeler transform of contexts, with suffix samples at both
ends of each run, and the earliest document by ranges of rows. What arrives streams backwards through the index for its
matching statistics, cut off at 50. A match of 50 that an earlier document has is marked. Windows that the owner doesn't
have, though it has their anchor, go through the same once more, each its own anchor, so that only the same window meets
them. The marks go back to the packs, which cut their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, release, table
from .packs import PACKED, freeze, thaw
from .packs import rows as _rows
from .packs import values as _values

#: Fixed by the contract: the length of a string that counts as a repeat.
LENGTH = 50
#: Bytes of an anchor in the first round, and of the contexts that the transform is sorted by.
GRAM, DEPTH = 24, 64
#: Text bytes of a pack, of one index and of what streams past it in a task; windows of a lane; hashes in one range.
PACK_BYTES, INDEX_BYTES, SLOT_BYTES, LANE, RANGE_HASHES = 8 << 20, 4 << 20, 8 << 20, 400, 1_000_000
#: Owners with more than a slot are broadcast up to so many, in two longs each.
BROADCAST_OWNERS = 100_000
#: Stands for a null doc_id, which is later than all others; and for no document.
LAST, NEVER = (1 << 63) - 2, (1 << 63) - 1

_CHUNK, _BASE = 1 << 17, 0x100000001B3
_GOLD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_LOW = np.uint64((1 << 18) - 1)


class Search(NamedTuple):
    """How a round looks for anchors: their bytes, the seed and bits of their hash, and ranges that it is dealt to."""

    gram: int
    seed: int
    bits: int
    ranges: int


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _GOLD
    return x ^ (x >> np.uint64(32))


def _rolled(data: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes of the strings of `size` bytes from each place on, put together from those of powers of two."""
    level, have, out, done = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    while done < size:
        if size & have:
            n = len(data) - done - have + 1
            out = level[:n] if out is None else out[:n] * np.uint64(pow(_BASE, have, 1 << 64)) + level[done : done + n]
            done += have
        if done < size:
            level = level[:-have] * np.uint64(pow(_BASE, have, 1 << 64)) + level[have:]
            have *= 2
    return out


def anchors(data: np.ndarray, starts: np.ndarray, search: Search) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, hash) of runs of windows with one anchor, in order of place.

    data: texts one after the other; starts: where each begins, and the end. Windows lie within one text.
    """
    spread, parts = LENGTH - search.gram + 1, []
    for at in range(0, len(data) - LENGTH + 1, _CHUNK):
        part = data[at : at + _CHUNK + LENGTH - 1]
        grams = _mix(_rolled(part, search.gram) + np.uint64(search.seed) * _GOLD)
        least, width = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), 1
        while 2 * width <= spread:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < spread:
            least = np.minimum(least[: len(least) - (spread - width)], least[spread - width :])
        inside = np.ones(len(least), bool)
        for s in starts[np.searchsorted(starts, at, "right") : np.searchsorted(starts, at + len(part), "left")].tolist():
            inside[max(0, s - at - LENGTH + 1) : max(0, s - at)] = False
        windows = np.flatnonzero(inside)
        if len(windows):
            place = (least & _LOW).astype(np.int64)[windows]
            new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)]))
            parts.append((at + windows[new], at + windows[np.append(new[1:], len(windows)) - 1], _mix(grams[place[new]] + _GOLD) >> np.uint64(64 - search.bits)))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


class Starts:
    """Ascending places below n as bits, with counts before each word, to tell how many are at or below a place."""

    def __init__(self, places: np.ndarray, n: int):
        bits = np.zeros(-(-n // 64) * 64, bool)
        bits[places] = True
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1]

    def upto(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        return self.before[word] + np.bitwise_count(self.words[word] << (63 - (at & 63)).astype(np.uint64))


class RunIndex:
    """Run-length index of texts (bytes without zeros), each of a document, for matches of LENGTH bytes.

    The transform is sorted by contexts of DEPTH bytes and, within one, by the byte before, which makes its runs longest.
    A step back from a row comes to a row that shares all but one byte of the context, so that matches up to LENGTH are
    exact. Kept are, for each run, its first row, its byte, where it leads and the suffixes of its two ends; for ranges of
    rows that share LENGTH bytes the earliest document, where it changes; and the texts, to measure matches with samples.
    """

    def __init__(self, texts: list[bytes], docs: np.ndarray):
        self.data = np.frombuffer(b"\0".join(texts) + bytes(DEPTH + 17), np.uint8)
        n = self.n = len(self.data) - DEPTH - 16
        order, joined = self._sorted(n)
        before = self.data[order - 1]
        before[order == 0] = 0
        start = np.concatenate([[0], np.flatnonzero(before[1:] != before[:-1]) + 1])
        self.runs = Starts(start, n)
        length = np.diff(np.append(start, n))
        self.last_row = start + length - 1
        head = before[start].astype(np.int64)
        self.first, self.last = order[start], order[self.last_row]
        by_head = np.argsort(head, kind="stable")
        target = np.empty(len(by_head), np.int64)
        target[by_head] = np.cumsum(length[by_head]) - length[by_head]
        self.by_head = head[by_head] * len(by_head) + by_head
        # a run's first row, its byte, and how far a step back goes from its rows
        self.table = np.stack([start, head, target - start], axis=1)
        ranges = np.flatnonzero(~joined)
        earliest = np.minimum.reduceat(np.repeat(docs, [len(t) + 1 for t in texts])[order], ranges)
        new = np.concatenate([[True], earliest[1:] != earliest[:-1]])
        self.ranges, self.earliest = Starts(ranges[new], n), earliest[new]

    def _sorted(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in order of the DEPTH bytes from each on, then the byte before; and which share LENGTH bytes with the one above."""
        key = np.ndarray((n,), ">u8", self.data, strides=(1,)).astype(np.uint64)
        width, half = 8, None
        while True:
            order = np.argsort(key)
            ranked = key[order]
            rank = np.empty(n, np.uint64)
            rank[order] = np.cumsum(np.concatenate([[False], ranked[1:] != ranked[:-1]])).astype(np.uint64) + np.uint64(1)
            if width == DEPTH:
                break
            if 2 * width == DEPTH:
                half = rank
            after = np.zeros(n, np.uint64)
            after[: n - width] = rank[width:]
            key = (rank << np.uint64(32)) | after
            width *= 2
        before = np.concatenate([[0], self.data[: n - 1]]).astype(np.uint64)
        order = np.argsort((rank << np.uint64(8)) | before)
        beyond = np.minimum(order + LENGTH - DEPTH // 2, n - 1)
        joined = np.zeros(n, bool)
        joined[1:] = (half[order[1:]] == half[order[:-1]]) & (half[beyond[1:]] == half[beyond[:-1]])
        return order, joined

    def common(self, at: np.ndarray, data: np.ndarray, place: np.ndarray, most: int) -> np.ndarray:
        """Bytes that the text from `at` on shares with data from `place` on, up to `most` and LENGTH; data ends in LENGTH spare bytes."""
        own, other = (np.ndarray((len(x) - 7,), "<u8", x, strides=(1,)) for x in (self.data, data))
        out, live = np.full(len(at), LENGTH), np.arange(len(at))
        for k in range(0, LENGTH, 8):
            apart = own[np.minimum(at[live] + k, len(own) - 1)] ^ other[np.minimum(place[live] + k, len(other) - 1)]
            off = apart != 0
            bit = apart[off] & (~apart[off] + np.uint64(1))
            out[live[off]] = k + np.searchsorted(_BYTES, bit, "right")
            live = live[~off]
            if not len(live):
                break
        return np.minimum(out, min(most, LENGTH))

    def stream(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, found: np.ndarray) -> None:
        """Matching statistics of lanes of data (begin to end, without zeros), from their ends backwards and all abreast.

        For each place from which LENGTH bytes of a lane match, found gets the earliest document, if that is earlier.
        """
        place, left, count = end - 1, end - begin - 1, len(self.table)
        row, match = np.zeros(len(end), np.int64), np.zeros(len(end), np.int64)
        back = 0
        while len(place):
            back += 1
            wanted = data[place].astype(np.int64)
            run = self.runs.upto(row) - 1
            _, head, step = self.table[run].T
            off = np.flatnonzero(head != wanted)
            if off.size:
                step = step.copy()
                at = np.searchsorted(self.by_head, wanted[off] * count + run[off])
                above, below = self.by_head[np.maximum(at - 1, 0)] - wanted[off] * count, self.by_head[np.minimum(at, count - 1)] - wanted[off] * count
                has_above, has_below = (at > 0) & (above >= 0) & (above < count), (at < count) & (below >= 0) & (below < count)
                above, below = np.where(has_above, above, 0), np.where(has_below, below, 0)
                up = np.where(has_above, self.common(self.last[above], data, place[off] + 1, back - 1), -1)
                down = np.where(has_below, self.common(self.first[below], data, place[off] + 1, back - 1), -1)
                rise, best = up >= down, np.maximum(up, down)
                chosen = self.table[np.where(rise, above, below)]
                # without a run of this byte the match is empty, at any row
                row[off] = np.where(best < 0, 0, np.where(rise, self.last_row[above], chosen[:, 0]))
                step[off] = np.where(best < 0, 0, chosen[:, 2])
                match[off] = best
            row += step
            match = np.minimum(match + 1, LENGTH)
            hit = np.flatnonzero(match == LENGTH)
            if hit.size:
                found[place[hit]] = np.minimum(found[place[hit]], self.earliest[self.ranges.upto(row[hit]) - 1])
            # lanes go on while what is left of them can still make a match
            on = np.flatnonzero((left > 0) & (match + left >= LENGTH))
            place, left, row, match = place[on] - 1, left[on] - 1, row[on], match[on]


#: The least numbers above one byte, two and so on.
_BYTES = np.uint64(1) << np.arange(8, 64, 8, dtype=np.uint64)
# Zero bytes end texts in the index. They may occur in documents, so those bytes stream as 0xFF, which UTF-8 never has.
_ZERO = bytes([255]) + bytes(range(1, 256))


class Pieces(NamedTuple):
    """Strings of a pack: the number of the text in the pack, where in it the string begins, the document, the bytes."""

    number: np.ndarray
    begin: np.ndarray
    doc: np.ndarray
    texts: list[bytes]

    def frozen(self, level: int = 1) -> bytes:
        return freeze([*self[:3], np.array([len(t) for t in self.texts], np.int64)], b"".join(self.texts), level)

    @classmethod
    def thawed(cls, payloads: list[bytes]) -> Pieces:
        parts, texts = [], []
        for payload in payloads:
            arrays, body = thaw(payload)
            parts.append(arrays)
            ends = np.cumsum(arrays[3]).tolist()
            texts += [body[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return cls(*(np.concatenate([p[k] for p in parts]) for k in range(3)), texts)

    def picked(self, at: np.ndarray) -> Pieces:
        return Pieces(self.number[at], self.begin[at], self.doc[at], [self.texts[k] for k in at.tolist()])


def _joined(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    raw = b"".join(texts)
    return raw, np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _representatives(texts: list[bytes]) -> np.ndarray:
    """For each text, the first equal one."""
    first: dict[bytes, int] = {}
    return np.array([first.setdefault(t, k) for k, t in enumerate(texts)], np.int64)


def _whole(pieces: Pieces) -> np.ndarray:
    """The places of the distinct texts that are long enough to matter."""
    same = _representatives(pieces.texts)
    return np.array([k for k in np.flatnonzero(same == np.arange(len(same))).tolist() if len(pieces.texts[k]) >= LENGTH], np.int64)


def _ask(pack: int, pieces: Pieces, search: Search, whole: bool) -> Iterator[pa.RecordBatch]:
    """By range (kind 1): the anchors' hashes, those of several documents, and the digests of whole texts."""
    if whole:
        pieces = pieces.picked(_whole(pieces))
    _, data, starts = _joined(pieces.texts)
    first, _, hashes = anchors(data, starts, search)
    doc = pieces.doc[np.searchsorted(starts, first, "right") - 1]
    order = np.argsort(hashes, kind="stable")
    hashes, doc = hashes[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.empty(0, np.int64)
    single = hashes[new]
    several = np.minimum.reduceat(doc, new) != np.maximum.reduceat(doc, new) if len(new) else np.empty(0, bool)
    share = (single.astype(np.float64) * (search.ranges / 2.0**search.bits)).astype(np.int64).clip(0, search.ranges - 1)
    digests = np.frombuffer(b"".join(hashlib.md5(t).digest() for t in pieces.texts) if whole else b"", "<u8").reshape(-1, 2)
    rank = np.argsort(digests[:, 0])
    digests, number, docs = digests[rank], pieces.number[rank[: len(digests)]], pieces.doc[rank[: len(digests)]]
    place = (digests[:, 0].astype(np.float64) * (search.ranges / 2.0**64)).astype(np.int64).clip(0, search.ranges - 1)
    rows = []
    for bin_ in np.union1d(share, place).tolist():
        a, b = np.searchsorted(share, [bin_, bin_ + 1])
        c, d = np.searchsorted(place, [bin_, bin_ + 1])
        own = single[a:b]
        rows.append((1, pack, bin_, freeze([np.diff(own, prepend=np.uint64(0)), np.diff(own[several[a:b]], prepend=np.uint64(0)), digests[c:d, 0], digests[c:d, 1], docs[c:d], number[c:d]])))
        if len(rows) >= 1000:
            yield _rows(rows)
            rows = []
    if rows:
        yield _rows(rows)


def _packer(search: Search, pack_bytes: int):
    """Texts, in order of doc_id, to packs (kind 0) and what they ask (kind 1)."""

    def emit(pack: int, docs: list[int], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(np.arange(len(docs)), np.zeros(len(docs), np.int64), np.array([min(LAST, LAST if d is None else d) for d in docs], np.int64), texts)
        real = np.array([-1 if d is None else d for d in docs], np.int64)
        missing = np.array([d is None for d in docs], np.int64)
        yield _rows([(0, pack, 0, freeze([real, missing], b"", 1)), (4, pack, 0, pieces.frozen(6))])
        yield from _ask(pack, pieces, search, True)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        docs: list[int] = []
        texts: list[bytes] = []
        size = 0
        for doc, text in _values(batches):
            docs.append(doc)
            texts.append((text or "").encode("utf-8", "replace"))
            size += len(texts[-1]) + 16
            if size >= pack_bytes:
                yield from emit(number, docs, texts)
                number, docs, texts, size = number + 1, [], [], 0
        if docs:
            yield from emit(number, docs, texts)

    return pack


def _asker(search: Search):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, payloads in _values(batches, 1):
            yield from _ask(pack, Pieces.thawed(payloads), search, False)

    return ask


def _owners(group: pa.Table) -> pa.Table:
    """One range to, for each pack (kind 2), its hashes that several documents have with their owners, the first packs that
    have them, and the numbers of texts that equal one of an earlier document."""
    packs = group.column("pack").to_pylist()
    parts = [thaw(p)[0] for p in group.column("payload").to_pylist()]
    hashes = [np.cumsum(p[0].view(np.uint64)) for p in parts]
    sure = np.concatenate([np.isin(h, np.cumsum(p[1].view(np.uint64)), assume_unique=True) for h, p in zip(hashes, parts, strict=True)])
    of = np.repeat(np.arange(len(packs)), [len(h) for h in hashes])
    hashes, named = np.concatenate(hashes), np.array(packs, np.int64)
    order = np.lexsort((named[of], hashes))
    new = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]) if len(order) else np.empty(0, bool)
    number = np.cumsum(new) - 1
    shared = (np.bincount(number) > 1) | (np.bincount(number, sure[order]) > 0) if len(order) else new
    owner, keep = np.zeros(len(order), np.int64), np.zeros(len(order), bool)
    owner[order], keep[order] = named[of[order[new]]][number], shared[number]
    digest = [np.concatenate([p[k] for p in parts]) for k in (2, 3, 4, 5)]
    from_ = np.repeat(np.arange(len(packs)), [len(p[2]) for p in parts])
    order = np.lexsort((digest[2], digest[1], digest[0]))
    late = np.zeros(len(order), bool)
    if len(order):
        a, b, doc = (digest[k][order] for k in (0, 1, 2))
        head = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        late[order] = doc > doc[head][np.cumsum(head) - 1]
    hash_cuts, text_cuts = np.searchsorted(of, np.arange(len(packs) + 1)), np.searchsorted(from_, np.arange(len(packs) + 1))
    rows = []
    for k, pack in enumerate(packs):
        a, b, c, d = *hash_cuts[k : k + 2], *text_cuts[k : k + 2]
        own, copies = hashes[a:b][keep[a:b]], digest[3][c:d][late[c:d]]
        if len(own) or len(copies):
            rows.append((2, pack, 0, freeze([np.diff(own, prepend=np.uint64(0)), owner[a:b][keep[a:b]], copies])))
    return _table(rows)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_rows(rows)] if rows else [], _rows([(0, 0, 0, b"")]).schema)


def _regions(search: Search, whole: bool):
    """A pack and the answers to regions for the owners of their anchors (kind 3) and marks of copies (kind 5)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, payloads, answers in _values(batches, 1):
            parts = [thaw(a)[0] for a in answers]
            known, owners, copies = np.concatenate([np.cumsum(p[0].view(np.uint64)) for p in parts]), *(np.concatenate([p[k] for p in parts]) for k in (1, 2))
            order = np.argsort(known)
            known, owners = known[order], owners[order]
            pieces = Pieces.thawed(payloads)
            if len(copies):
                sizes = np.array([len(t) for t in pieces.texts], np.int64)[copies]
                yield _rows([(5, pack, 0, freeze([copies, np.zeros_like(copies), sizes - LENGTH]))])
            if whole:
                pieces = pieces.picked(np.setdiff1d(_whole(pieces), copies))
            if not len(known):
                continue
            raw, data, starts = _joined(pieces.texts)
            first, last, hashes = anchors(data, starts, search)
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            good = known[at] == hashes
            first, last, owner = first[good], last[good], owners[at[good]]
            if not len(first):
                continue
            text = np.searchsorted(starts, first, "right") - 1
            new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (text[1:] != text[:-1]) | (first[1:] != last[:-1] + 1)]))
            first, last, owner, text = first[new], last[np.append(new[1:], len(last)) - 1], owner[new], text[new]
            order = np.argsort(owner, kind="stable")
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(owner[order])) + 1, [len(order)]])
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = order[a:b]
                inside = text[own]
                found = [raw[x : y + LENGTH] for x, y in zip(first[own].tolist(), last[own].tolist(), strict=True)]
                rows.append((3, pack, int(owner[own[0]]), Pieces(pieces.number[inside], pieces.begin[inside] + first[own] - starts[inside], pieces.doc[inside], found).frozen(3)))
                if len(rows) >= 1000:
                    yield _rows(rows)
                    rows = []
            yield _rows(rows)

    return cut


def _indexes(own: Pieces, index_bytes: int) -> Iterator[RunIndex]:
    """Indexes of bounded size that together have all windows of the distinct strings."""
    least: dict[bytes, int] = {}
    for doc, text in zip(own.doc.tolist(), own.texts, strict=True):
        for a in range(0, len(text) - LENGTH + 1, index_bytes):
            part = text[a : a + index_bytes + LENGTH - 1].translate(_ZERO)
            least[part] = min(least.get(part, NEVER), doc)
    texts, docs, size = [], [], 0
    for text, doc in least.items():
        if texts and size + len(text) > index_bytes + LENGTH:
            yield RunIndex(texts, np.array(docs, np.int64))
            texts, docs, size = [], [], 0
        texts.append(text)
        docs.append(doc)
        size += len(text) + 1
    if texts:
        yield RunIndex(texts, np.array(docs, np.int64))


def earliest(own: Pieces, texts: list[bytes], index_bytes: int = INDEX_BYTES, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the texts, which are LENGTH bytes or more, one after the other: the earliest document of own that
    has the LENGTH bytes from there on, or NEVER; and where each text begins, and the end."""
    _, _, starts = _joined(texts)
    data = np.frombuffer(b"".join(texts).translate(_ZERO) + bytes(LENGTH + 16), np.uint8)
    windows = np.diff(starts) - LENGTH + 1
    lanes = -(-windows // lane)
    text = np.repeat(np.arange(len(texts)), lanes)
    begin = starts[text] + lane * (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    end = np.minimum(begin + lane, starts[text] + windows[text]) + LENGTH - 1
    found = np.full(starts[-1], NEVER, np.int64)
    for index in _indexes(own, index_bytes):
        index.stream(data, begin, end, found)
    return found, starts


def _matcher(index_bytes: int):
    """What came to an owner's slot to marks (kind 5) and windows that the owner doesn't have (kind 6)."""

    def match(group: pa.Table) -> pa.Table:
        owner, slot = group.column("bin")[0].as_py(), group.column("slot")[0].as_py()
        came = [(pack, Pieces.thawed([p])) for pack, p in zip(group.column("pack").to_pylist(), group.column("payload").to_pylist(), strict=True)]
        own = [p for pack, p in came if pack == owner][0]
        if slot:
            came = [(pack, p) for pack, p in came if pack != owner]
        number: dict[bytes, int] = {}
        which = [np.array([number.setdefault(t, len(number)) for t in p.texts], np.int64) for _, p in came]
        found, starts = earliest(own, list(number), index_bytes)
        rows = []
        for (pack, pieces), at in zip(came, which, strict=True):
            sizes = np.array([len(t) for t in pieces.texts], np.int64) - LENGTH + 1
            ends = np.cumsum(sizes)
            piece, offset = np.repeat(np.arange(len(sizes)), sizes), np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
            had = found[starts[at[piece]] + offset]
            state = np.where(had < pieces.doc[piece], 1, np.where(had == NEVER, 2, 0))
            new = np.flatnonzero(np.concatenate([[True], (state[1:] != state[:-1]) | (piece[1:] != piece[:-1])]))
            last, state, piece, first = offset[np.append(new[1:], len(offset)) - 1], state[new], piece[new], offset[new]
            for kind, of in ((5, state == 1), (6, state == 2)):
                if of.any():
                    p, a, b = piece[of], first[of], last[of]
                    if kind == 5:
                        payload = freeze([pieces.number[p], pieces.begin[p] + a, pieces.begin[p] + b])
                    else:
                        payload = Pieces(pieces.number[p], pieces.begin[p] + a, pieces.doc[p], [pieces.texts[k][x : y + LENGTH] for k, x, y in zip(p.tolist(), a.tolist(), b.tolist(), strict=True)]).frozen(3)
                    rows.append((kind, pack, 0, payload))
        return _table(rows)

    return match


def _settled(pieces: DataFrame, asked: DataFrame, search: Search, whole: bool) -> DataFrame:
    """One round: pieces (pack, payloads) and what they asked to marks (kind 5) and windows that are left (kind 6)."""
    answers = asked.groupBy("bin").applyInArrow(_owners, PACKED).groupBy("pack").agg(F.collect_list("payload").alias("answers"))
    cut = checkpoint(pieces.join(answers, "pack").select("pack", "payloads", "answers").mapInArrow(_regions(search, whole), PACKED))
    del answers
    release(pieces.sparkSession)
    regions = cut.where("kind = 3")
    # an owner's load, without its own regions, is cut into slots by who sends; each slot gets a copy of the index's text
    load = regions.where("pack <> bin").groupBy("bin").agg(F.sum(F.conv(F.hex(F.substring("payload", 1, 8)), 16, 10).cast("long")).alias("load"))
    slots = checkpoint(load.select("bin", F.ceil(F.col("load") / SLOT_BYTES).alias("slots")).where("slots > 1"))
    slots = F.broadcast(slots) if slots.count() <= BROADCAST_OWNERS else slots
    dealt = regions.join(slots, "bin", "left").withColumn("slots", F.coalesce("slots", F.lit(1)))
    every = F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)
    slot = F.when(F.col("pack") == F.col("bin"), every).otherwise(F.array(F.pmod(F.xxhash64("pack"), "slots")))
    matched = dealt.select("pack", "bin", "payload", F.explode(slot).alias("slot")).groupBy("bin", "slot").applyInArrow(_matcher(INDEX_BYTES), PACKED)
    return checkpoint(matched.unionByName(cut.where("kind = 5")))


def _spans(texts: list[bytes], docs: np.ndarray, marks: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(bytes removed, runs, kept bytes) for each text of a pack."""
    same = _representatives(texts)
    edges = np.concatenate([np.stack(thaw(m)[0], axis=1) for m in marks]) if marks else np.empty((0, 3), np.int64)
    edges = edges[np.lexsort((edges[:, 1], edges[:, 0]))]
    cuts = np.searchsorted(edges[:, 0], np.arange(len(texts) + 1))
    for k, data in enumerate(texts):
        if docs[k] > docs[same[k]] and len(data) >= LENGTH:
            yield len(data), 1, b""
            continue
        own = edges[cuts[same[k]] : cuts[same[k] + 1]]
        if not len(own):
            yield 0, 0, data
            continue
        reach = np.maximum.accumulate(own[:, 2]) + LENGTH
        new = np.concatenate([[True], own[1:, 1] > reach[:-1]])
        begin = own[new, 1]
        end = np.append(reach[np.flatnonzero(new)[1:] - 1], reach[-1])
        kept = [data[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(data)], strict=True)]
        yield int((end - begin).sum()), len(begin), b"".join(kept)


def remove_repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row of docs (doc_id long, text, ...).

    A byte goes if a LENGTH-byte string that covers it also starts in a row with a smaller doc_id; a null doc_id counts
    as larger than all others (like the two largest longs), and rows with one doc_id take nothing from each other, so
    repeated rows fare alike. Null texts are empty; texts under LENGTH bytes stay; texts of any length are taken whole.
    texts: adds kept (binary), the remaining bytes, which need not be whole characters. Other columns are ignored; an
    empty table gives no rows.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = source.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    # one anchor for every 13 bytes or so; with eight bits more than their number calls for, strangers rarely share a hash
    count = total // 13 + 1
    search = Search(GRAM, 0, min(64, max(40, count.bit_length() + 8)), max(1, -(-count // RANGE_HASHES)))
    order = F.col("doc_id").asc_nulls_last()
    ordered = source.repartitionByRange(max(1, -(-total // PACK_BYTES)), order, F.xxhash64("text")).sortWithinPartitions(order)
    packed = checkpoint(ordered.mapInArrow(_packer(search, PACK_BYTES), PACKED))
    # the texts as they were dealt are of no more use
    del ordered
    release(docs.sparkSession)
    packs = packed.where("kind = 4").select("pack", "payload")
    done = _settled(packs.select("pack", F.array("payload").alias("payloads")), packed.where("kind = 1"), search, True)
    marks = done.where("kind = 5")
    while not (left := done.where("kind = 6").select("pack", "payload")).isEmpty():
        # windows of their own; a further round is for those that a hash of 64 bits threw together
        windows = left.agg(F.sum(F.conv(F.hex(F.substring("payload", 1, 8)), 16, 10).cast("long"))).first()[0]
        search = Search(LENGTH, search.seed + 1, 64, max(1, -(-windows // RANGE_HASHES)))
        pieces = left.groupBy("pack").agg(F.collect_list("payload").alias("payloads"))
        done = _settled(pieces, pieces.mapInArrow(_asker(search), PACKED), search, False)
        marks = marks.unionByName(done.where("kind = 5"))
    marks = marks.groupBy("pack").agg(F.collect_list("payload").alias("marks"))
    ids = packed.where("kind = 0").select("pack", F.col("payload").alias("ids"))
    joined = packs.join(ids, "pack").join(marks, "pack", "left").select("ids", "payload", "marks")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, payload, marks in _values(batches, 1):
            (real, missing), _ = thaw(ids)
            pieces = Pieces.thawed([payload])
            out = list(_spans(pieces.texts, pieces.doc, marks or []))
            columns = [
                pa.array(real, pa.int64(), mask=missing > 0),
                pa.array([len(t) for t in pieces.texts], pa.int64()),
                pa.array([n for n, _, _ in out], pa.int64()),
                pa.array([s for _, s, _ in out], pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for _, _, k in out], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns + [pa.array([k for _, _, k in out], pa.binary())] * texts, [c.split()[0] for c in schema.split(", ")])

    return joined.mapInArrow(finish, schema)


def op9(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
