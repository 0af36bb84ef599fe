"""Character n-grams of normalised texts.

All sizes are counted in one pass over the texts, in Arrow batches: code points become numbers, an n-gram a number in the
base of the alphabet, and equal numbers of a row or group are counted by sorting. A row's n-grams never leave its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import normalize

SIZES = (1, 2, 3, 4, 5)
#: Characters that are counted at a time; up to so many different numbers are counted in a table instead of by sorting.
BATCH_CHARS, DENSE = 1 << 20, 1 << 22


def characters(text: Column | str) -> Column:
    """Code points as an array; null and empty texts have none."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def grams(chars: Column | str, n: int) -> Column:
    """All n-grams in order, from an array of characters; shorter texts have none."""
    chars = F.col(chars) if isinstance(chars, str) else chars
    if n == 1:
        return chars
    places = F.sequence(F.lit(1), F.size(chars) - n + 1)
    some = F.transform(places, lambda i: F.concat(*[F.element_at(chars, i + k) for k in range(n)]))
    return F.when(F.size(chars) >= n, some).otherwise(F.array().cast("array<string>"))


def explode_grams(docs: DataFrame, keep: list[str], text: str = "norm", sizes=SIZES) -> DataFrame:
    """A row (keep..., n, gram) for each n-gram, in one pass."""
    chars = docs.select(*keep, characters(text).alias("__chars"))
    sized = lambda n: lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram"))
    named = [F.transform(grams("__chars", n), sized(n)) for n in sizes]
    return chars.select(*keep, F.explode(F.concat(*named)).alias("__gram")).select(*keep, "__gram.n", "__gram.gram")


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points, one text after the other, and where each begins, with the end."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return codes, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def inner(starts: np.ndarray, n: int) -> np.ndarray:
    """Where the n-grams begin that lie within one text."""
    many = np.maximum(np.diff(starts) - n + 1, 0)
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[:-1], many)


def count_grams(texts: list[str], groups: np.ndarray, sizes=SIZES) -> Iterator[tuple[int, np.ndarray, list[str], np.ndarray]]:
    """For each size: (n, group, gram, count) of the n-grams of texts whose groups, from 0 on, are given."""
    codes, starts = code_points(texts)
    alphabet, letters = np.unique(codes, return_inverse=True)
    base, owner = len(alphabet) + 1, np.repeat(np.asarray(groups, np.int64), np.diff(starts))
    # a number for each place's n-gram; ranks keep it small where the base's power would not fit
    number, most, plain = letters.astype(np.int64), base, True
    for n in range(1, max(sizes) + 1):
        if n > 1:
            if most >= (1 << 62) // base:
                ranks, number = np.unique(number, return_inverse=True)
                most, plain = len(ranks), False
            number = number[:-1] * base + letters[n - 1 :] if len(number) else number
            most *= base
        if n not in sizes:
            continue
        at = inner(starts, n)
        if not len(at):
            continue
        many = int(owner.max()) + 1
        if plain and most * many <= DENSE:
            count = np.bincount(owner[at] * most + number[at], minlength=most * many)
            key = np.flatnonzero(count)
            places = alphabet[(key[:, None] % most) // base ** np.arange(n - 1, -1, -1) % base]
            flat = places.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            yield n, key // most, [flat[i : i + n] for i in range(0, len(flat), n)], count[key]
            continue
        if most >= (1 << 62) // many:
            ranks, number = np.unique(number, return_inverse=True)
            most, plain = len(ranks), False
        key, first, count = np.unique(owner[at] * most + number[at], return_index=True, return_counts=True)
        at = at[first]
        flat = codes[at[:, None] + np.arange(n)].tobytes().decode("utf-32-le", "surrogatepass")
        yield n, key // most, [flat[i : i + n] for i in range(0, len(flat), n)], count


def batched(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of Arrow batches of some BATCH_CHARS, or one row, with the texts; null texts are empty."""
    for batch in batches:
        texts = [t or "" for t in batch.column(text).to_pylist()]
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH_CHARS):
                size += len(texts[end])
                end += 1
            yield batch.slice(at, end - at), texts[at:end]
            at = end


def kept_schema(docs: DataFrame, keep: list[str]) -> str:
    return ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)


def frequencies(docs: DataFrame, keep: list[str], n: int, text: str = "norm") -> DataFrame:
    """(keep..., gram, cnt, freq) of one n-gram size; freq is of all n-grams of the row. Rows stay where they are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batched(batches, len(keep)):
            sizes = np.array([len(t) - n + 1 for t in texts], np.int64)
            for _, row, names, many in count_grams(texts, np.arange(len(texts)), (n,)):
                columns = [batch.column(k).take(pa.array(row)) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(many, pa.int64()), pa.array(many / sizes[row])], [*keep, "gram", "cnt", "freq"])

    return docs.select(*keep, F.col(text)).mapInArrow(count, f"{kept_schema(docs, keep)}, gram string, cnt long, freq double")


DATUM = "map<int,array<struct<gram:string,cnt:bigint,freq:double>>>"


def data(docs: DataFrame, keep: list[str], text: str = "text", sizes=SIZES) -> DataFrame:
    """(keep..., norm, ngrams): a row's normalised text, and by size its n-grams with counts and shares, in one value.

    A size that the text is too short for has an empty list; null texts count as empty. Rows stay where they are.
    """
    sizes = sorted(sizes)
    kind = pa.struct([("gram", pa.string()), ("cnt", pa.int64()), ("freq", pa.float64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batched(batches, len(keep)):
            cell, names, many, share = [], [], [], []
            lengths = np.array([len(t) for t in texts], np.int64)
            for n, row, found, own in count_grams(texts, np.arange(len(texts)), sizes):
                cell.append(row * len(sizes) + sizes.index(n))
                names += found
                many.append(own)
                share.append(own / (lengths[row] - n + 1))
            cell, many, share = (np.concatenate(x) if x else np.empty(0) for x in (cell, many, share))
            order = np.argsort(cell, kind="stable")
            grams = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(many.astype(np.int64)), pa.array(share.astype(np.float64))], fields=list(kind)).take(pa.array(order))
            cuts = np.searchsorted(cell[order], np.arange(len(texts) * len(sizes) + 1))
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), grams)
            keys = pa.array(np.tile(sizes, len(texts)), pa.int32())
            maps = pa.MapArray.from_arrays(pa.array(np.arange(len(texts) + 1) * len(sizes), pa.int32()), keys, lists)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keep))], pa.array(texts, pa.string()), maps], [*keep, "norm", "ngrams"])

    rows = docs.select(*keep, F.coalesce(normalize(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lit("")).alias("norm"))
    return rows.mapInArrow(count, f"{kept_schema(docs, keep)}, norm string, ngrams {DATUM}")


def group_counts(docs: DataFrame, group: str, text: str = "norm", sizes=SIZES) -> DataFrame:
    """(group, n, gram, cnt): counts over all rows of a group (a string), summed within batches before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batched(batches, 1):
            names = batch.column(0).dictionary_encode()
            of = names.indices.fill_null(len(names.dictionary)).to_numpy(zero_copy_only=False)
            values = pa.array([*names.dictionary.to_pylist(), None], pa.string())
            for n, which, found, many in count_grams(texts, of, sizes):
                yield pa.RecordBatch.from_arrays([values.take(pa.array(which)), pa.array(np.full(len(which), n), pa.int32()), pa.array(found, pa.string()), pa.array(many, pa.int64())], [group, "n", "gram", "cnt"])

    counted = docs.select(F.col(group).cast("string").alias(group), F.col(text)).mapInArrow(count, f"`{group}` string, n int, gram string, cnt long")
    return counted.groupBy(group, "n", "gram").agg(F.sum("cnt").alias("cnt"))


class GramTable:
    """A vocabulary (n-gram by place) that is looked up for all places of many texts at once."""

    def __init__(self, vocab: list[str]):
        self.size, self.sizes = len(vocab), sorted({len(g) for g in vocab if g})
        letters = sorted({c for g in vocab for c in g})
        self.base = len(letters) + 1
        if self.base ** max(self.sizes, default=1) >= 1 << 62:
            raise ValueError("the vocabulary has too many letters for its longest n-grams")
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, self.base)
        # the first place of an n-gram counts; padding (empty ones) never occurs
        place = {}
        for k, g in enumerate(vocab):
            if g:
                place.setdefault(g, k)
        self.tables, self.dense = {}, {}
        for n in self.sizes:
            own = sorted((sum(int(self.letter[ord(c)]) * self.base ** (n - 1 - i) for i, c in enumerate(g)), k) for g, k in place.items() if len(g) == n)
            self.tables[n] = np.array([x for x, _ in own], np.int64), np.array([k for _, k in own], np.int64)
            if self.base**n <= DENSE:
                self.dense[n] = np.full(self.base**n, -1, np.int32)
                self.dense[n][self.tables[n][0]] = self.tables[n][1]

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, count) of the n-grams of the vocabulary that occur, in order."""
        codes, starts = code_points(texts)
        letters = self.letter[codes].astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), np.diff(starts))
        number, keys = letters, []
        for n in range(1, max(self.sizes, default=0) + 1):
            if n > 1:
                number = number[:-1] * self.base + letters[n - 1 :] if len(number) else number
            if n not in self.tables or not len(number):
                continue
            known, places = self.tables[n]
            # a letter that the vocabulary lacks makes the n-gram unknown
            bad = np.concatenate([[0], np.cumsum(letters == 0)])
            at = inner(starts, n)
            at = at[bad[at + n] == bad[at]]
            if n in self.dense:
                place = self.dense[n][number[at]]
                hit = place >= 0
                keys.append(owner[at[hit]] * self.size + place[hit])
                continue
            found = np.minimum(np.searchsorted(known, number[at]), len(known) - 1)
            hit = known[found] == number[at]
            keys.append(owner[at[hit]] * self.size + places[found[hit]])
        keys = np.concatenate(keys) if keys else np.empty(0, np.int64)
        if len(texts) * self.size <= DENSE:
            count = np.bincount(keys, minlength=1)
            key = np.flatnonzero(count)
            count = count[key]
        else:
            key, count = np.unique(keys, return_counts=True)
        return key // max(1, self.size), key % max(1, self.size), count
