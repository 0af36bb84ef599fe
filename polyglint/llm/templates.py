"""Benchmark decontamination by templates: numbers, names and units give way to typed placeholders.

Windows of eight template tokens of the benchmark are hashed into a table that every executor gets; documents stream
past it whole. Windows that meet are laid side by side in runs, which are cut where slots contradict each other: within
a piece one value of the item stands for one value of the document, and the other way round. Windows that are nearly
all slots, and items no longer than a window, are also looked for word by word.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import broadcast_if_small, checkpoint, plain_name, table

#: Template tokens in a window, and how many of them must be literal.
WINDOW, MIN_LITERALS = 8, 4
#: Tokens that a piece of a cut run must have to count. Items with fewer tokens than a window are matched whole, as templates from this length on and else word by word.
MIN_ITEM = 4
#: A document leaks an item if so many of its tokens, or this share of them, are covered.
MIN_TOKENS, MIN_SHARE = 13, 0.5
#: Benchmark text that one broadcast table may hold (its index takes some ten times as much); a larger benchmark takes several passes.
PASS_BYTES = 8 << 20
#: Distinct words a worker remembers before it starts afresh.
CACHE = 300_000

#: Units that count as such after a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t oz lb lbs gram grams kilogram kilograms ton tons tonne tonnes ounce ounces pound pounds ml l liter liters litre litres "
    "s sec secs min mins h hr hrs second seconds minute minutes hour hours day days week weeks month months year years "
    "mph kph kmh hz khz mhz ghz w kw mw v a j kj cal kcal pa kpa c f k % percent ° € $ £ usd eur gbp dollar dollars cent cents euro euros pence".split()
)
_NUMBER = re.compile(r"[+-]?[$€£]?\d+(?:[.,:/]\d+)*%?")
_JOINT = re.compile(r"(?<=\d)(?=[A-Za-z°€])")
_EDGE = ".,;:!?\"'()[]{}<>«»“”‘’…*_|"
LITERAL, NUMBER, UNIT, CAPITAL = range(4)
_MARK = {k: np.uint64(xxhash.xxh3_64_intdigest(f"\0<{k}>")) for k in ("num", "unit", "name")}
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _word(raw: str) -> tuple[int, int, bool]:
    """Hash of the literal, class, and whether a sentence ends here."""
    bare = raw.strip(_EDGE)
    ends = raw.rstrip("\"')]}»”’*_")[-1:] in (".", "!", "?", ":", "…")
    if bare and _NUMBER.fullmatch(bare):
        kind = NUMBER
    elif bare.lower() in UNITS:
        kind = UNIT
    else:
        kind = CAPITAL if bare[:1].isupper() and not bare.isupper() else LITERAL
    return xxhash.xxh3_64_intdigest(bare.lower()), kind, ends


class Tokens:
    """Template tokens of many texts, one after the other."""

    _seen: dict[str, int] = {}
    _facts: list[tuple[int, int, bool]] = []

    def __init__(self, texts: list[str]):
        self.words: list[str] = []
        sizes = []
        for t in texts:
            found = _JOINT.sub(" ", t).split()
            sizes.append(len(found))
            self.words += found
        seen, facts = Tokens._seen, Tokens._facts
        for w in set(self.words).difference(seen):
            seen[w] = len(facts)
            facts.append(_word(w))
        at = np.fromiter(map(seen.__getitem__, self.words), np.int64, len(self.words))
        used, at = np.unique(at, return_inverse=True)
        known = [facts[i] for i in used.tolist()]
        if len(seen) > CACHE:
            seen.clear()
            facts.clear()
        hashes = np.array([x[0] for x in known], np.uint64)[at] if known else np.empty(0, np.uint64)
        kind = np.array([x[1] for x in known], np.int8)[at] if known else np.empty(0, np.int8)
        ends = np.array([x[2] for x in known], bool)[at] if known else np.empty(0, bool)
        self.doc = np.repeat(np.arange(len(texts)), sizes)
        self.start = np.cumsum([0, *sizes])
        first = np.ones(len(kind), bool)
        first[1:] = ends[:-1] | (self.doc[1:] != self.doc[:-1])
        after = np.zeros(len(kind), bool)
        after[1:] = (kind[:-1] == NUMBER) & (self.doc[1:] == self.doc[:-1])
        self.slot = (kind == NUMBER) | (kind == UNIT) & after | (kind == CAPITAL) & ~first
        self.literal = hashes.copy()
        hashes[kind == NUMBER] = _MARK["num"]
        hashes[(kind == UNIT) & after] = _MARK["unit"]
        hashes[(kind == CAPITAL) & ~first] = _MARK["name"]
        self.hash = hashes

    def windows(self, size: int, literal: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Places where a window of one text begins, and the windows' hashes; of templates only those with enough
        literals, of literal words all."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        out, hashes = np.zeros(n, np.uint64), self.literal if literal else self.hash
        for k in range(size):
            out *= _STEP
            out += hashes[k : k + n]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        good = self.doc[:n] == self.doc[size - 1 :]
        if not literal:
            good &= self.enough(size)
        at = np.flatnonzero(good)
        return at, out[at]

    def enough(self, size: int) -> np.ndarray:
        """Whether the window from each place on has literals enough for a template."""
        slots = np.concatenate([[0], np.cumsum(self.slot)])
        return size - (slots[size:] - slots[:-size]) >= min(MIN_LITERALS, size - 1)


class Index:
    """Windows of a benchmark, or of a part of it."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.tokens = Tokens([t for _, t in items])
        sizes = np.diff(self.tokens.start)
        self.sizes = sizes
        self.tables = []
        for size, literal in sorted({(WINDOW, False), (WINDOW, True), *[(int(s), x) for s in sizes if 0 < s < WINDOW for x in (False, True) if x or s >= MIN_ITEM]}):
            at, found = self.tokens.windows(size, literal)
            whole = sizes[self.tokens.doc[at]] == size
            if literal:
                whole |= (size == WINDOW) & ~self.tokens.enough(size)[at]
            elif size == WINDOW:
                whole[:] = True
            at, found = at[whole], found[whole]
            if not len(at):
                continue
            order = np.argsort(found, kind="stable")
            marks = np.zeros(1 << 20, bool)
            marks[(found >> np.uint64(44)).astype(np.int64)] = True
            self.tables.append((size, literal, found[order], at[order], marks))

    def leaks(self, texts: list[str]) -> Iterator[tuple[int, int, int, float, bool]]:
        """(text, item, tokens covered, share of the item, verbatim) for every pair that leaks."""
        tokens = Tokens(texts)
        lined: dict[tuple[int, int], dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for size, literal, known, places, marks in self.tables:
            at, found = tokens.windows(size, literal)
            likely = marks[(found >> np.uint64(44)).astype(np.int64)]
            at, found = at[likely], found[likely]
            low, high = np.searchsorted(known, found, "left"), np.searchsorted(known, found, "right")
            for k in np.flatnonzero(high > low).tolist():
                doc, i = int(tokens.doc[at[k]]), int(at[k])
                for j in places[low[k] : high[k]].tolist():
                    lined[doc, int(self.tokens.doc[j])][i - j].update(range(j, j + size))
        for (doc, item), by_shift in lined.items():
            covered: set[int] = set()
            verbatim = True
            for shift, places in by_shift.items():
                order = sorted(places)
                cuts = [0, *[k for k in range(1, len(order)) if order[k] != order[k - 1] + 1], len(order)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    found, same = self._consistent(tokens, shift, order[a:b])
                    covered |= found
                    verbatim &= same
            share = len(covered) / max(1, int(self.sizes[item]))
            if covered and (len(covered) >= MIN_TOKENS or share >= MIN_SHARE):
                yield doc, self.ids[item], len(covered), share, verbatim

    def _consistent(self, tokens: Tokens, shift: int, run: list[int]) -> tuple[set[int], bool]:
        """What a run covers, and whether all its slots are the same: the pieces between contradicting slots, and the
        stretches of equal words, that are long enough."""
        there: dict[str, str] = {}
        back: dict[str, str] = {}
        covered: set[int] = set()
        least, begin, equal, verbatim = min(MIN_ITEM, len(run)), 0, 0, True
        for k, j in enumerate([*run, None]):
            same = fits = False
            if j is not None:
                same = fits = not self.tokens.slot[j]
                if not fits:
                    a, b = self.tokens.words[j].strip(_EDGE).lower(), tokens.words[j + shift].strip(_EDGE).lower()
                    same, fits = a == b, there.get(a, b) == b and back.get(b, a) == a
                    verbatim &= same
            if not fits:
                if k - begin >= least:
                    covered.update(run[begin:k])
                begin = k
                there.clear()
                back.clear()
            if j is not None and self.tokens.slot[j]:
                there[a], back[b] = b, a
            if not same:
                if k - equal >= least:
                    covered.update(run[equal:k])
                equal = k + 1
        return covered, verbatim


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_tokens, share (6 places) and verbatim for each document and benchmark item that it leaks.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored, and ids of any type, null ones too, come back
    as they are. Null and empty texts leak nothing and match nothing; documents of any length are searched whole. Windows
    with fewer than MIN_LITERALS literals, and items of under MIN_ITEM tokens, match word by word. Repeated rows on either
    side give repeated rows. Empty tables give none. A benchmark of any size is read in parts of about PASS_BYTES bytes,
    each broadcast for one pass over the documents.
    """
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(1, -(-total // PASS_BYTES))
    kind = benchmark.schema["item_id"].dataType
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {kind.simpleString()}, n_tokens long, share double, verbatim boolean"
    out = None
    for k in range(parts):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else items
        rows = [(r["item_id"], r["text"]) for r in part.toLocalIterator()]
        found = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").mapInArrow(_search(docs, rows, to_arrow_type(kind)), schema)
        out = found if out is None else out.unionByName(found)
    return out


#: The index that this worker built last, by the search that it is for; tasks of one search share it.
_built: dict[str, Index] = {}


def _search(docs: DataFrame, rows: list[tuple], kind: pa.DataType):
    shared, name = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _built:
            _built.clear()
            _built[name] = Index(shared.value)
        index = _built[name]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = list(index.leaks(part.column(1).to_pylist()))
                if found:
                    doc, item, n, share, verbatim = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(doc)), pa.array(item, kind), pa.array(n, pa.int64()), pa.array([round(x, 6) for x in share], pa.float64()), pa.array(verbatim, pa.bool_())],
                        ["doc_id", "item_id", "n_tokens", "share", "verbatim"],
                    )

    return search


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose document leaks an item; rows with a null doc_id stay unless a null one leaks."""
    name = plain_name(docs, "__bad")
    bad = broadcast_if_small(checkpoint(find_leaks(docs, benchmark).select(F.col("doc_id").alias(name)).distinct()))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[name]), "left_anti")


def op7(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
