"""Removal of repeated three-line windows, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, heavy_join, plain_name, table

#: Lines in a window.
SPAN = 3


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with `text` without the lines of repeated windows, and n_lines, n_removed (long).

    A text is split at each newline. A window is three consecutive lines, of which one at least has a character that is
    not white space. Of the occurrences of a window anywhere the first stays, by doc_id (null first), then the text's
    digest, then position; the lines of all others go, so windows that overlap themselves go too. Everything is judged on
    the input. Rows with one doc_id and one text are one occurrence and fare alike. Texts of fewer than three lines and
    null texts (n_lines 0) stay as they are; a text that loses all its lines becomes empty. Texts of any length are
    taken whole. Columns named n_lines or n_removed are replaced, all others stay; an empty table gives no rows.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    seed, lines, gone, key, n, other = (plain_name(docs, c) for c in ("__digest", "__lines", "__gone", "__window", "__n", "__id"))
    # the lines are cut again after the join below, so that only texts travel
    base = docs.select(*own, F.unhex(F.md5(F.col("text").cast("binary"))).alias(seed))
    keyed = base.select("doc_id", seed, F.split("text", "\n").alias(lines))
    at = [F.element_at(lines, F.col("__i") + k) for k in range(1, SPAN + 1)]
    places = F.when(F.size(lines) >= SPAN, F.sequence(F.lit(0), F.size(lines) - SPAN))
    windows = (
        keyed.where(F.size(lines) >= SPAN)
        .select(F.struct("doc_id", seed).alias("__doc"), lines, F.explode(places).alias("__i"))
        .select("__doc", "__i", F.concat_ws("\n", *at).alias("__t"))
        .where(F.col("__t").rlike(r"[^\x20\x09-\x0D]"))
        .select(F.unhex(F.md5(F.col("__t").cast("binary"))).alias(key), "__doc", "__i")
    )
    windows = checkpoint(windows)
    first = windows.groupBy(key).agg(F.min(F.struct("__doc", "__i")).alias("__first"), F.count("*").alias(n)).where(F.col(n) > 1)
    later = heavy_join(windows, first, [key], n, windows.count()).where(~F.struct("__doc", "__i").eqNullSafe(F.col("__first")))
    cover = F.flatten(F.collect_set(F.array(*[F.col("__i") + k for k in range(SPAN)])))
    removed = later.groupBy("__doc").agg(F.array_distinct(cover).alias(gone)).select(F.col(f"__doc.{seed}").alias(seed), F.col("__doc.doc_id").alias(other), gone)
    joined = base.join(removed, (base[seed] == removed[seed]) & base["doc_id"].eqNullSafe(removed[other]), "left").drop(removed[seed]).drop(other)
    joined = joined.withColumn(lines, F.split("text", "\n"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: F.element_at(F.col(lines), i + 1))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.concat_ws("\n", kept))
    return joined.select(
        *[text.alias("text") if c == "text" else c for c in own],
        F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col(gone).isNotNull(), F.size(gone)), F.lit(0)).cast("long").alias("n_removed"),
    )


def op10(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


OP10_SQL = r"""
WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i, ls[i] || chr(10) || ls[i+1] || chr(10) || ls[i+2] AS k
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM t WHERE len(ls) >= 3)),
l AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS o FROM w
      WHERE regexp_matches(k, '[^\x20\x09-\x0D]')) WHERE o > 1),
g AS (SELECT doc_id, list(DISTINCT i + j) AS gone FROM l, range(3) AS r(j) GROUP BY doc_id),
o AS (SELECT t.doc_id, ls, text, gone, list_filter(range(1, len(ls) + 1), lambda p: NOT list_contains(coalesce(gone, []), p)) AS keep FROM t LEFT JOIN g USING (doc_id))
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
       md5(CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(keep, lambda p: ls[p]), chr(10)) END) AS kept_md5
FROM o
"""
