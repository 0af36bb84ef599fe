"""Near-duplicates by weighted Jaccard similarity of five-word shingles, found with BagMinHash signatures.

A text is a bag: each shingle weighs as often as it occurs. For each shingle, Poisson processes run over its weight axis,
cut at powers of two into levels of their own seed; a point of a level falls to a unit of weight by halving the level
bit by bit, and counts only below the shingle's weight. Each point also names a register, and a register keeps the
earliest point that hits it, so two bags agree in a register with just their weighted Jaccard similarity. Only points
earlier than the time by which all registers are filled are ever drawn: one or so for each shingle.

Signatures are cut into bands, and texts that share a band are candidates; what links them is the overlap of their bags
alone. No bucket is expanded into pairs. Each member is compared with the bucket's pivot, the text that meets most others
in its buckets. Where that leaves a candidate cluster with several classes, the texts outside its largest class are a
query set that is run against the whole cluster, in blocks of bounded size, each with an inverted index of its bags, so
that no link between different classes is lost.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, heavy_join, plain_name, release, table
from .graphs import components

SHINGLE = 5
SIMILARITY = Fraction(4, 5)
#: 24 bands of 4 registers: a pair of similarity 0.8 shares no band with probability 3e-6.
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
#: Texts of a cluster, and bytes of them, that one task holds as members, and as queries, on average.
BLOCK_TEXTS, BLOCK_BYTES = 2000, 8 << 20
#: Words that are sketched at a time, and distinct words and keys of texts that a task remembers.
CHUNK_WORDS, CACHE, SEEN = 200_000, 300_000, 300_000

_GOLD, _MIX1, _MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def sketch(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    """(n_docs, REGISTERS) signatures of bags given as rows (doc, shingle hash, weight); each bag has a row at least."""
    total = np.bincount(doc, weight, n_docs)
    limit = (np.log(REGISTERS) + 3) / total
    # one process for each shingle and level: level 0 is the first unit of weight, level k the 2**(k-1) units after it
    doc_of, seeds, begin, width, top = [doc], [_mix(shingle)], [np.zeros(len(doc), np.int64)], [np.ones(len(doc), np.int64)], [weight]
    k = 1
    while (more := np.flatnonzero(weight > 1 << (k - 1))).size:
        doc_of.append(doc[more])
        seeds.append(_mix(shingle[more] + np.array([k], np.uint64) * _GOLD))
        begin.append(np.full(more.size, 1 << (k - 1)))
        width.append(np.full(more.size, 1 << (k - 1)))
        top.append(weight[more])
        k += 1
    doc_of, seeds, begin, width, top = map(np.concatenate, (doc_of, seeds, begin, width, top))
    best = np.full(n_docs * REGISTERS, np.inf)
    out = np.zeros(n_docs * REGISTERS, np.uint64)
    points = _mix(seeds + _GOLD)
    times = _wait(points, width)
    live = np.arange(len(doc_of))
    while True:
        soon = times[live] < limit[doc_of[live]]
        now, later = live[soon], [live[~soon]]
        while now.size:
            draw = _mix(points[now] + _MIX2)
            place = begin[now] + (((draw >> np.uint64(32)) * width[now].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            hit = place < top[now]
            slot = doc_of[now[hit]] * REGISTERS + ((draw[hit] & np.uint64(0xFFFFFFFF)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
            when = times[now[hit]]
            np.minimum.at(best, slot, when)
            first = best[slot] == when
            out[slot[first]] = draw[hit][first]
            points[now] = _mix(points[now] + seeds[now])
            times[now] += _wait(points[now], width[now])
            soon = times[now] < limit[doc_of[now]]
            later.append(now[~soon])
            now = now[soon]
        empty = np.isinf(best.reshape(n_docs, REGISTERS)).any(axis=1)
        if not empty.any():
            return out.reshape(n_docs, REGISTERS)
        limit = np.where(empty, 2 * limit, limit)
        live = np.concatenate(later)
        live = live[empty[doc_of[live]]]


def _wait(points: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Exponential waiting times; a unit of weight has REGISTERS points in a unit of time, one for each register."""
    return -np.log(((points >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (width * float(REGISTERS))


class Bags:
    """Shingle bags of texts."""

    _seen: dict[bytes, int] = {}

    @classmethod
    def of(cls, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, shingle hash, weight), ordered by doc and hash. A text of fewer than five words is one shingle."""
        seen, flat, sizes = cls._seen, [], []
        for t in texts:
            found = t.split()
            sizes.append(len(found))
            flat += found
        if len(seen) > CACHE:
            seen.clear()
        for w in set(flat).difference(seen):
            seen[w] = xxhash.xxh3_64_intdigest(w)
        words = np.fromiter(map(seen.__getitem__, flat), np.uint64, len(flat))
        sizes = np.array(sizes, np.int64)
        counts = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, np.minimum(sizes, 1))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        doc = np.repeat(np.arange(len(texts)), counts)
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
        last = np.repeat(starts + sizes, counts)
        found = np.zeros(len(at), np.uint64)
        for k in range(SHINGLE):
            inside = at + k < last
            found = _mix(found * _GOLD + np.where(inside, words[np.minimum(at + k, max(len(words) - 1, 0))], np.uint64(0)))
        # text and 44 bits of the hash in one number: one sort brings equal shingles of a text together
        both = np.sort(doc.astype(np.uint64) << np.uint64(44) | _mix(found) >> np.uint64(20))
        new = np.ones(len(both), bool)
        new[1:] = both[1:] != both[:-1]
        at = np.flatnonzero(new)
        return (both[at] >> np.uint64(44)).astype(np.int64), both[at] & np.uint64((1 << 44) - 1), np.diff(np.append(at, len(both)))


def bands(signatures: np.ndarray) -> np.ndarray:
    """(n, BANDS) bucket keys as signed longs."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS)
    out = np.zeros(parts.shape[:2], np.uint64)
    for k in range(ROWS):
        out = _mix(out * _GOLD + parts[:, :, k])
    return _mix(out + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """(keys, texts) of rows (key, text), few at a time, without those whose key has just come: of a group of copies a task
    takes up one or so. At most SEEN keys are remembered."""
    seen: set[bytes] = set()
    for batch in (b.slice(a, 500) for b in batches for a in range(0, b.num_rows, 500)):
        keys, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("key", "text"))
        new = []
        for k, key in enumerate(keys.to_pylist()):
            if key not in seen:
                seen.add(key)
                new.append(k)
        if len(seen) > SEEN:
            seen.clear()
        if new:
            at = pa.array(new)
            yield keys.take(at), [t.encode("utf-8", "replace") for t in texts.take(at).to_pylist()]


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, texts in _fresh(batches):
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < CHUNK_WORDS * 6):
                size += len(texts[end])
                end += 1
            doc, shingle, weight = Bags.of(texts[at:end])
            found = bands(sketch(doc, shingle, weight, end - at))
            yield pa.RecordBatch.from_arrays([keys.slice(at, end - at), pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), BANDS).cast(pa.list_(pa.int64()))], ["key", "buckets"])
            at = end


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to (key, bytes of the text, compressed text): it travels several times."""
    for keys, texts in _fresh(batches):
        yield pa.RecordBatch.from_arrays([keys, pa.array([len(t) for t in texts], pa.int64()), pa.array([zstandard.compress(t, 3) for t in texts], pa.binary())], ["key", "size", "text"])


def overlap(a: bytes, b: bytes, similarity: Fraction = SIMILARITY, known: dict | None = None) -> bool:
    """Whether the weighted Jaccard similarity of two compressed texts' bags of shingles is similarity or more, exactly."""

    def bag(text: bytes) -> Counter:
        if known is not None and text in known:
            return known[text]
        found = zstandard.decompress(text).split()
        out = Counter(b" ".join(found[i : i + SHINGLE]) for i in range(max(1, len(found) - SHINGLE + 1))) if found else Counter()
        if known is not None:
            if len(known) >= 4:
                known.pop(next(iter(known)))
            known[text] = out
        return out

    x, y = bag(a), bag(b)
    n, m = x.total(), y.total()
    if not n or not m or min(n, m) < similarity * max(n, m):
        return False
    if len(x) > len(y):
        x, y = y, x
    shared = sum(min(v, y[k]) for k, v in x.items() if k in y)
    return shared >= similarity * (n + m - shared)


def _verified(similarity: Fraction):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in (b.slice(a, 500) for b in batches for a in range(0, b.num_rows, 500)):
            good = [overlap(x, y, similarity, known) for x, y in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return check


def content_key(text: str = "text"):
    """The text's digest; null for null texts and those without a word."""
    return F.when(F.col(text).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.md5(F.col(text).cast("string").cast("binary"))))


def _joined(group: pa.Table, similarity: Fraction) -> Iterator[tuple[bytes, bytes]]:
    """Links that join different classes, of the queries of one block with its members; a spanning set of them."""
    keys, labels, query = (group.column(c).to_pylist() for c in ("key", "label", "query"))
    raw = group.column("text").to_pylist()
    doc, shingle, weight = Bags.of([zstandard.decompress(t) for t in raw])
    total = np.bincount(doc, weight, len(keys))
    starts = np.searchsorted(doc, np.arange(len(keys) + 1))
    member = ~np.array(query, bool)[doc]
    order = np.argsort(shingle[member], kind="stable")
    index, owner, counts = shingle[member][order], doc[member][order], weight[member][order]
    root: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while root.get(x, x) != x:
            x = root[x]
        return x

    for k in np.flatnonzero(query).tolist():
        own, times = shingle[starts[k] : starts[k + 1]], weight[starts[k] : starts[k + 1]]
        low, high = np.searchsorted(index, own, "left"), np.searchsorted(index, own, "right")
        size = high - low
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        shared = np.bincount(owner[at], np.minimum(counts[at], np.repeat(times, size)), len(keys))
        # a little under the threshold, for the exact check to decide
        for m in np.flatnonzero(shared >= float(similarity) * (total[k] + total - shared) - 1).tolist():
            a, b = find(labels[k]), find(labels[m])
            if shared[m] and a != b and overlap(raw[k], raw[m], similarity):
                root[max(a, b)] = min(a, b)
                yield keys[k], keys[m]


def links(docs: DataFrame, similarity: Fraction = SIMILARITY) -> DataFrame:
    """(node, label) by content key, for the texts that are connected with another text of similarity or more.

    docs: key (content_key, not null) and text. Equal texts are one node.
    """
    # distinct first, so that copies of a text meet as one row; then only buckets of several texts go on
    members = checkpoint(docs.mapInArrow(_banded, "key binary, buckets array<long>").select("key", F.explode("buckets").alias("bucket")).distinct())
    shared = members.groupBy("bucket").agg(F.count("*").alias("rows")).where("rows > 1").select("bucket")
    members = checkpoint(members.join(shared, "bucket").select("bucket", "key"))
    release(docs.sparkSession)
    sizes = members.groupBy("bucket").agg(F.count("*").alias("rows"))
    total = max(1, members.count())
    met = heavy_join(members, sizes, ["bucket"], "rows", total).groupBy("key").agg(F.sum("rows").alias("met"))
    pivots = members.join(met, "key").groupBy("bucket").agg(F.max(F.struct("met", "key")).alias("best"), F.count("*").alias("rows")).select("bucket", F.col("best.key").alias("pivot"), "rows")
    pairs = checkpoint(heavy_join(members, pivots, ["bucket"], "rows", total).where("key <> pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b")).distinct())
    texts = docs.mapInArrow(_squeezed, "key binary, size long, text binary")
    texts = checkpoint(texts.join(members.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]))
    del members, sizes, met, pivots
    release(docs.sparkSession)
    side = lambda end: texts.select(F.col("key").alias(end), F.col("text").alias(f"t{end}"))
    good = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")
    good = checkpoint(good.mapInArrow(_verified(similarity), "a binary, b binary"))
    release(docs.sparkSession)
    labels = components(good)
    clusters = components(pairs).select(F.col("node").alias("key"), F.col("label").alias("cluster"))
    # components() lists the ends of links but for the least of each, which is its own label
    clusters = clusters.unionByName(clusters.select(F.col("cluster").alias("key"), "cluster")).distinct()
    named = checkpoint(clusters.join(labels, clusters["key"] == labels["node"], "left").select("key", "cluster", F.coalesce("label", "key").alias("label")))
    by_label = named.groupBy("cluster", "label").agg(F.count("*").alias("rows"))
    main = by_label.groupBy("cluster").agg(F.max(F.struct("rows", "label")).alias("main"), F.sum("rows").alias("n"), F.count("*").alias("labels")).where("labels > 1")
    main = checkpoint(main.select("cluster", F.col("main.label").alias("main"), "n"))
    if main.isEmpty():
        return labels
    stray = F.col("label") != F.col("main")
    open_ = heavy_join(named, main, ["cluster"], "n", max(1, named.count()))
    open_ = checkpoint(open_.join(texts.select("key", "size"), "key").select("key", "cluster", "label", stray.alias("stray"), "size"))
    part = lambda rows, size: F.greatest(F.ceil(rows / BLOCK_TEXTS), F.ceil(size / BLOCK_BYTES))
    loads = open_.groupBy("cluster").agg(
        part(F.count("*"), F.sum("size")).alias("blocks"), part(F.count_if("stray"), F.sum(F.when(F.col("stray"), F.col("size")))).alias("chunks"), F.count("*").alias("n")
    )
    open_ = heavy_join(open_, loads, ["cluster"], "n", max(1, open_.count()))
    split = lambda n: F.pmod(F.xxhash64("key"), n)
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    own = open_.select("cluster", "key", "label", F.lit(False).alias("query"), split(F.col("blocks")).alias("block"), spread(F.col("chunks")).alias("chunk"))
    asked = open_.where("stray").select("cluster", "key", "label", F.lit(True).alias("query"), split(F.col("chunks")).alias("chunk"), spread(F.col("blocks")).alias("block"))
    found = own.unionByName(asked).join(texts.select("key", "text"), "key").groupBy("cluster", "block", "chunk").applyInArrow(
        lambda table_: pa.Table.from_pylist([{"a": a, "b": b} for a, b in _joined(table_, similarity)], pa.schema([("a", pa.binary()), ("b", pa.binary())])), "a binary, b binary"
    )
    found = checkpoint(found)
    release(docs.sparkSession)
    return components(good.unionByName(found))


def classes(docs: DataFrame, similarity: Fraction = SIMILARITY) -> DataFrame:
    """doc_id, key, class_key and class_id for each row of docs (doc_id, text, ...).

    Rows are of one class if their texts are equal or connected by a chain of texts that are each similar to the next.
    class_id is the least doc_id of the class. Null texts and those without a word have null keys and are classes of
    their own. Repeated rows share a class. Texts of any length are compared whole; ties need no rule, for the least id names
    a class. Other columns are ignored; an empty table gives no rows.
    """
    keyed = docs.select("doc_id", F.col("text").cast("string").alias("text"), content_key().alias("key"))
    label = links(keyed.where("key IS NOT NULL").select("key", "text"), similarity)
    slim = checkpoint(keyed.select("doc_id", "key"))
    total = slim.count()
    sized = slim.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    sized = checkpoint(sized.join(label, sized["key"] == label["node"], "left").select("key", "n", "least", F.coalesce("label", "key").alias("class_key")))
    least = sized.groupBy("class_key").agg(F.min("least").alias("class_id"), F.count("*").alias("keys"))
    named = heavy_join(sized, least, ["class_key"], "keys", max(1, total)).select("key", "n", "class_key", "class_id")
    out = heavy_join(slim.where("key IS NOT NULL"), named, ["key"], "n", total).select("doc_id", "key", "class_key", "class_id")
    alone = slim.where("key IS NULL").select("doc_id", "key", F.lit(None).cast("binary").alias("class_key"), F.col("doc_id").alias("class_id"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame, similarity: Fraction = SIMILARITY) -> DataFrame:
    """docs with one row of each class: that of the least doc_id (null last), of equal rows any one."""
    found = checkpoint(classes(docs, similarity))
    release(docs.sparkSession)
    rows = found.where("class_key IS NOT NULL").groupBy("class_key", "doc_id", "key").agg(F.count("*").alias("n"))
    best = checkpoint(rows.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key", "n")).alias("best")).select("best.doc_id", "best.key", "best.n"))
    id_, key = plain_name(docs, "__id"), plain_name(docs, "__key")
    keyed = docs.withColumn(key, content_key())
    best = best.select(F.col("doc_id").alias(id_), F.col("key").alias(f"{key}2"), "n")
    chosen = lambda b: keyed.join(b, keyed["doc_id"].eqNullSafe(b[id_]) & (keyed[key] == b[f"{key}2"]), "left_semi")
    # both parts read one shuffle of the texts; only repeated rows are shuffled again
    kept = chosen(best.where("n = 1")).unionByName(chosen(best.where("n > 1")).dropDuplicates([key]))
    return kept.unionByName(keyed.where(F.col(key).isNull())).select(*docs.columns)


def op5(spark, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id")
