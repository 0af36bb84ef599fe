"""Longest-processing-time sharding: groups that must stay together, largest first, each to the least-loaded shard.

The groups never reach the driver. Groups of one size are interchangeable for the rule, so the heap runs over the
histogram of group sizes alone. With d distinct sizes the groups hold at least d(d+1)/2 bytes, so a corpus of T bytes
has at most sqrt(2T) histogram rows (14 million for 100 TB). They pass through the driver largest first, in chunks that
go back to the shared folder. Groups of one size are then numbered in bounded pieces on the executors, and a group's
number tells its shard.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, heavy_join, shared_folder, table

#: Rows that one window task numbers, on average; size classes that the driver holds at a time, and that are broadcast (some
#: 10 MB); more of them are joined by shuffle.
PIECE_ROWS, CLASSES = 20_000, 100_000


def deal(histogram: Iterable[tuple[int, int]], n_shards: int) -> Iterator[tuple[int, int, list[int]]]:
    """(size, groups of that size), largest first, to (size, groups, groups for each shard), by the LPT rule; ties go to the lower shard.

    A class is dealt through the heap group by group until all loads lie within one size; from there on the rule only
    goes round, so whole rounds are given out at once.
    """
    loads = [(0, k) for k in range(n_shards)]
    heapq.heapify(loads)
    for size, n in histogram:
        got, left = [0] * n_shards, n
        while left:
            load, k = loads[0]
            rounds = left // n_shards
            if rounds > 1 and max(x for x, _ in loads) - load <= size:
                got = [g + rounds for g in got]
                loads = [(x + rounds * size, i) for x, i in loads]
                heapq.heapify(loads)
                left -= rounds * n_shards
                continue
            many = 1
            if n_shards > 1 and size > 0:
                second = min(loads[1:3])
                many = max(1, min(left, -(-(second[0] - load) // size)))
            elif n_shards == 1:
                many = left
            heapq.heapreplace(loads, (load + many * size, k))
            got[k] += many
            left -= many
        yield size, n, got


def _classes(groups: DataFrame, n_shards: int) -> DataFrame:
    """(group_size, class_groups, pieces, ends) of groups (group_size, ...): how many groups of a size the shards up to each one get."""
    spark = groups.sparkSession
    histogram = checkpoint(groups.groupBy("group_size").agg(F.count("*").alias("groups")))
    rows = ((r["group_size"], r["groups"]) for r in histogram.orderBy(F.desc("group_size")).toLocalIterator())
    dealt, folder, small = deal(rows, n_shards), None, None
    schema = pa.schema([("group_size", pa.int64()), ("class_groups", pa.int64()), ("pieces", pa.int64()), ("ends", pa.list_(pa.int64()))])
    while chunk := list(islice(dealt, CLASSES)):
        ends = []
        for _, _, got in chunk:
            at, own = 0, []
            for g in got:
                own.append(at := at + g)
            ends.append(own)
        sizes, many = [c[0] for c in chunk], [c[1] for c in chunk]
        part = spark.createDataFrame(pa.table([pa.array(sizes, pa.int64()), pa.array(many, pa.int64()), pa.array([-(-n // PIECE_ROWS) for n in many], pa.int64()), pa.array(ends, pa.list_(pa.int64()))], schema=schema))
        if folder is None and len(chunk) < CLASSES:
            small = part
            break
        folder = folder or f"{shared_folder(spark)}/classes-{uuid.uuid4().hex}"
        part.write.mode("append").parquet(folder)
    if folder is not None:
        return spark.read.parquet(folder)
    return F.broadcast(small if small is not None else spark.createDataFrame([], "group_size long, class_groups long, pieces long, ends array<long>"))


def assign(items: DataFrame, n_shards: int) -> DataFrame:
    """items (key, size, ...; rows of one key are a group) with `shard` and `slot`, the row's number in its shard from 0.

    key: a non-null value that rows of a group share; size: a positive long. Groups of any size stay whole; repeated
    rows are rows of their own; groups of one size go to shards, and rows within a shard to slots, in the order of hashes
    and keys. An empty table stays empty. Columns named shard or slot are replaced.
    """
    items = checkpoint(items.drop("shard", "slot"))
    total = items.count()
    groups = checkpoint(items.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("group_size")))
    by_class = _classes(groups, n_shards)
    sized = groups.join(by_class, "group_size").withColumn("piece", F.pmod(F.xxhash64("key"), F.col("pieces")))
    before = Window.partitionBy("group_size").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sized.groupBy("group_size", "piece").agg(F.count("*").alias("rows")).withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows")
    # only classes of several pieces need the table of starts
    many = sized.where("pieces > 1").join(starts.where("start > 0"), ["group_size", "piece"], "left")
    numbered = many.unionByName(sized.where("pieces = 1").withColumn("start", F.lit(0).cast("long")))
    rank = F.coalesce("start", F.lit(0)) + F.row_number().over(Window.partitionBy("group_size", "piece").orderBy("key")) - 1
    shard = F.size(F.filter("ends", lambda e: e <= F.col("rank")))
    placed = numbered.withColumn("rank", rank).select("key", "n", shard.alias("shard"))
    rows = heavy_join(items, placed, ["key"], "n", total).drop("n")
    pieces = max(1, -(-total // PIECE_ROWS))
    rows = checkpoint(rows.withColumn("piece", F.pmod(F.xxhash64("key", *[c for c in items.columns if c not in ("key", "size")]), F.lit(pieces))))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "piece").agg(F.count("*").alias("rows")).withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows")
    slot = F.col("start") + F.row_number().over(Window.partitionBy("shard", "piece").orderBy(*[c for c in items.columns])) - 1
    return rows.join(starts, ["shard", "piece"]).withColumn("slot", slot).select(*items.columns, "shard", "slot")


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs (doc_id, text, ...).

    size: UTF-8 bytes and 1, of texts of any length. Equal texts stay together, null texts too, apart from empty ones. A null
    text has crc 0. Repeated rows have slots of their own; an empty table gives no rows.
    The law is `bytes`; grown_shard is null, for LPT moves many groups when a shard is added. Other columns are ignored.
    """
    text = F.col("text").cast("string")
    items = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b"")).alias("key"),
    )
    out = assign(items, n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


def op3(spark, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
