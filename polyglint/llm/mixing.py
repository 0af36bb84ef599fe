"""Mixing sources to target weights, by budgets that run down a tree of domains, languages and sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checkpoint, heavy_join, table, words

#: A leaf gives at most so many epochs of its tokens.
MAX_EPOCHS = 4
#: Rows of a leaf that one window task orders, on average.
PIECE_ROWS = 2_000


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[tuple, float], total: int, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """leaves (levels..., tokens, ...; one row for each path of a tree) with `budget`, their share of total tokens.

    weights: by path prefix, for nodes at any level; a node without one has weight 1. Each node's budget is split among
    its children by weight, no child getting more than max_epochs times its tokens; what a child cannot take goes to its
    siblings, again by weight, and only what no sibling can take is left to the parent's siblings. Fractions are rounded
    down. If the whole tree cannot take the total, all leaves are full. The tree is worked down level by level, each one
    a window over siblings; an empty tree stays empty.
    """
    spark, levels = leaves.sparkSession, list(levels)
    room = leaves.agg(F.sum("tokens")).first()[0] or 0
    nodes = None
    for k in range(1, len(levels) + 1):
        path = levels[:k]
        # a child's room bounds what its whole subtree can take, so shortages are settled here, among siblings
        children = leaves.groupBy(*path).agg((F.sum("tokens") * max_epochs).cast("double").alias("room"))
        own = [(*map(str, p), float(w)) for p, w in weights.items() if len(p) == k]
        if own:
            given = spark.createDataFrame(own, ", ".join(f"{c} string" for c in path) + ", weight double")
            children = children.join(F.broadcast(given), path, "left")
        weight = F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(0.0)) if own else F.lit(1.0)
        children = children.withColumn("weight", weight)
        if k == 1:
            children = children.withColumn("left", F.lit(float(min(total, room * max_epochs))))
        else:
            children = children.join(nodes.withColumnRenamed("budget", "left"), path[:-1])
        siblings = Window.partitionBy(*path[:-1])
        # in the order in which children fill up: the first ones are full, as far as what is left after them still fills the next
        order = siblings.orderBy(F.when(F.col("weight") > 0, F.col("room") / F.col("weight")).otherwise(F.lit(float("inf"))), path[-1])
        before = F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        heavier = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        children = children.withColumn("full", (F.col("weight") > 0) & ((F.col("left") - before) * F.col("weight") >= heavier * F.col("room")))
        rest = F.col("left") - F.coalesce(F.sum(F.when(F.col("full"), F.col("room"))).over(siblings), F.lit(0.0))
        share = rest * F.col("weight") / F.sum(F.when(~F.col("full"), F.col("weight"))).over(siblings)
        got = F.when(F.col("full"), F.col("room")).when(F.col("weight") > 0, F.floor(F.least(share, F.col("room")))).otherwise(0.0)
        nodes = children.select(*path, got.cast("double").alias("budget"))
    return leaves.join(nodes.withColumn("budget", F.col("budget").cast("long")), levels)


def select(docs: DataFrame, path: Mapping[str, Column], weights: Mapping[tuple, float], total: int | None = None, fraction: float = 1.0, max_epochs: int = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """docs with n_tokens and epochs (long): how often each row is taken; rows that are not taken have 0.

    path: the columns of the tree from the root down; a null counts as ''. total: the tokens wanted, or a `fraction` of
    those there are. A leaf's budget buys whole epochs first and then a prefix of one more epoch, in the order of hashes
    of seed, epoch, doc_id and text: the longest prefix whose tokens fit. Rows without words cost nothing and come along
    with the rows around them; rows of one doc_id and text are taken together. Texts of any length count whole. Columns
    named n_tokens or epochs are replaced, all others stay; an empty table gives no rows.

    Only hashes and counts are shuffled: a leaf's prefix ends at a hash, which each row is then held against where it is.
    """
    own = {f"own{k}": c for k, c in enumerate(docs.columns) if c not in ("n_tokens", "epochs")}
    levels = [f"level{k}" for k in range(len(path))]
    base = [F.xxhash64(F.lit(2 * seed + k), F.col("doc_id"), F.col("text")) for k in (0, 1)]
    rows = docs.select(
        F.struct(*[F.col(c).alias(n) for n, c in own.items()]).alias("own"), F.size(words("text")).cast("long").alias("n_tokens"), F.array(*base).alias("hashes"),
        *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(levels, path.values(), strict=True)],
    )
    slim = checkpoint(rows.drop("own"))
    leaves = checkpoint(slim.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")))
    all_ = leaves.agg(F.sum("tokens"), F.sum("rows")).first()
    wanted = total if total is not None else int(fraction * (all_[0] or 0))
    plan = budgets(leaves, levels, weights, wanted, max_epochs)
    some = F.col("tokens") > 0
    plan = plan.select(*levels, "rows", F.when(some, F.floor(F.try_divide("budget", "tokens"))).otherwise(1).alias("whole"), F.when(some, F.try_mod("budget", "tokens")).otherwise(0).alias("part"))
    plan = checkpoint(plan)
    ends = _ends(slim, plan, levels, all_[1] or 0)
    taken = checkpoint(plan.join(ends, levels, "left").select(*levels, "rows", "whole", "end"))
    found = _looked_up(rows, taken, levels, all_[1] or 0)
    epochs = F.col("whole") + F.coalesce((_place() <= F.col("end")).cast("long"), F.lit(0))
    return found.select(*[F.col(f"own.{n}").alias(c) for n, c in own.items()], "n_tokens", epochs.cast("long").alias("epochs"))


def _place() -> Column:
    """A row's place in the order of the epoch after the whole ones."""
    return F.struct(*[F.xxhash64(F.col("whole"), F.col("hashes")[k]).alias(f"h{k}") for k in (0, 1)])


def _looked_up(rows: DataFrame, plan: DataFrame, levels: list[str], total: int) -> DataFrame:
    """rows with the columns of their leaf: a broadcast while leaves are few, else with hot leaves apart."""
    small = plan.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(plan), levels) if small else heavy_join(rows, plan, levels, "rows", total)


def _ends(slim: DataFrame, plan: DataFrame, levels: list[str], total: int) -> DataFrame:
    """(levels..., end): the place of the last row of each leaf's prefix, for leaves that have one."""
    pieces = F.ceil(F.col("rows") / PIECE_ROWS)
    unsigned = F.col("place.h0").cast("double") / 2.0**64 + 0.5
    rows = _looked_up(slim, plan.where("part > 0"), levels, total).withColumn("place", _place())
    rows = rows.select(*levels, "part", "n_tokens", "place", F.least(F.floor(unsigned * pieces), pieces - 1).alias("piece"))
    before = Window.partitionBy(*levels).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*levels, "piece", "part").agg(F.sum("n_tokens").alias("sum"), F.max("place").alias("last"), F.count("*").alias("n"))
    sums = checkpoint(sums.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0))).where("before <= part"))
    # rows of a piece that fits whole are in; only the one piece of a leaf that the budget cuts is put in order row by row
    whole = sums.where("before + sum <= part").select(*levels, F.col("last").alias("end"))
    cut = sums.where("before + sum > part").select(*levels, "piece", "before")
    inside = rows.join(cut, [*levels, "piece"])
    # rows of one place stand or fall together
    up_to = Window.partitionBy(*levels, "piece").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fits = inside.withColumn("up_to", F.col("before") + F.sum("n_tokens").over(up_to)).where("up_to <= part").select(*levels, F.col("place").alias("end"))
    return whole.unionByName(fits).groupBy(*levels).agg(F.max("end").alias("end"))


def repeat(docs: DataFrame, path: Mapping[str, Column], weights: Mapping[tuple, float], total: int | None = None, fraction: float = 1.0, max_epochs: int = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """docs with each row as often as select() takes it, in the columns of docs."""
    whole = docs.select(F.struct("*").alias("own"), F.col("doc_id"), F.col("text"), *[c.alias(f"path{k}") for k, c in enumerate(path.values())])
    columns = {n: F.col(f"path{k}") for k, n in enumerate(path)}
    taken = select(whole, columns, weights, total, fraction, max_epochs, seed).where("epochs > 0")
    rows = taken.select("own", F.explode(F.array_repeat(F.lit(0), F.col("epochs").cast("int"))))
    return rows.select("own.*")


#: The tree of the registered query: books, code, news and web by the source's number, with these weights.
DOMAINS = ("books", "code", "news", "web")
WEIGHTS = {("books",): 3.0, ("code",): 1.0, ("news",): 2.0, ("web",): 4.0} | {(d, "en"): 2.0 for d in DOMAINS}


def document_path() -> dict[str, Column]:
    number = F.coalesce(F.regexp_extract(F.coalesce("source", F.lit("")), r"(\d+)$", 1).try_cast("long"), F.lit(3))
    return {"domain": F.element_at(F.array(*map(F.lit, DOMAINS)), (F.pmod(number, F.lit(len(DOMAINS))) + 1).cast("int")), "lang": F.col("lang"), "source": F.col("source")}


def op6(spark, sf_dir: str) -> DataFrame:
    out = select(table(spark, sf_dir, "documents"), document_path(), WEIGHTS)
    return out.select("doc_id", "lang", "source", "n_tokens", "epochs")
