"""Resolution of not-modified revisits: an as-of join by canonical URL to the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HEAVY_SHARE, checkpoint, heavy_join, table

#: A URL with more instants than this, and more than HEAVY_SHARE of all, is ordered in so many blocks of nearly even load.
BLOCK_ROWS, BLOCKS = 20_000, 500
#: Headers of a 304 that never replace those of the stored response.
KEPT_HEADERS = ("connection", "content-encoding", "content-length", "content-md5", "content-range", "etag", "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
#: Query parameters that do not name another page.
_TRACKING = r"(?:utm_[a-z]+|ref|gclid|fbclid|sessionid)"


def canonical_url(url: Column | str) -> Column:
    """Host and path in one form: no scheme, www. or m., default port, fragment, tracking parameters, index page,
    .html or closing slash; the host in lower case. Null stays null."""
    out = F.col(url) if isinstance(url, str) else url
    out = F.regexp_replace(F.trim(out), r"#.*$", "")
    host = F.lower(F.regexp_extract(out, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^(?:www|m)\.", ""), r":(?:80|443)$", "")
    rest = F.regexp_replace(out, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?]*", "")
    rest = F.regexp_replace(rest, rf"([?&]){_TRACKING}=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, r"&{2,}", "&"), r"\?&", "?")
    rest = F.regexp_replace(rest, r"[?&]+$", "")
    rest = F.regexp_replace(rest, r"(?:/index)?(?:\.html?)?/?(\?|$)", "$1")
    return F.concat(host, rest)


def resolve(records: DataFrame) -> DataFrame:
    """One row for each revisit: record_id, url_key, original_id, outcome, digest and headers.

    records: record_id, url, ts (long), kind ('response' or 'revisit'), status, headers (map, names in lower case) and
    digest; other columns are ignored. A full response has kind response, status 200 and a URL. The original is the
    full response of the same canonical URL with the latest ts before the revisit's (ties: the largest record_id).
    Validators: etag (weak ones compare as strong), last-modified and the digest, each where both sides have it. outcome:
    resolved (one compares at least, all agree), mismatch, unverified (none compares), no_original. digest is the
    original's if resolved; headers are the original's with the revisit's permitted ones over them, or the revisit's own
    if it isn't resolved. Revisits without URL or ts have no original. Repeated rows are rows of their own; an empty table
    gives no rows. Digests and headers of any length are compared whole.

    Records of one URL and instant are one point in time, so that a burst is no more than that; a URL of very many points
    is cut into blocks at quantiles of its own instants.
    """
    rows = records.select("record_id", canonical_url("url").alias("url_key"), F.col("ts").cast("long").alias("ts"), "kind", "status", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "digest")
    rows = checkpoint(rows.where(F.col("kind").isin("response", "revisit")))
    usable = rows.where("url_key IS NOT NULL AND ts IS NOT NULL")
    facts = F.struct("record_id", "ts", "headers", "digest")
    full = usable.where("kind = 'response' AND status = 200").groupBy("url_key", "ts").agg(F.max_by(facts, F.struct("record_id")).alias("__fact"))
    asked = usable.where("kind = 'revisit'").groupBy("url_key", "ts").agg(F.count("*").alias("__n"))
    points = checkpoint(full.withColumn("__n", F.lit(None).cast("long")).unionByName(asked.withColumn("__fact", F.lit(None).cast(full.schema["__fact"].dataType))))
    total = points.count()
    per_url = points.groupBy("url_key").agg(F.count("*").alias("__rows")).where(F.col("__rows") > max(BLOCK_ROWS, total * HEAVY_SHARE))
    hot = checkpoint(per_url.select("url_key"))
    cuts = points.join(F.broadcast(hot), "url_key").groupBy("url_key").agg(F.percentile_approx("ts", [k / BLOCKS for k in range(1, BLOCKS)], 20 * BLOCKS).alias("__cuts"))
    place = F.size(F.filter("__cuts", lambda c: c < F.col("ts")))
    points = points.join(F.broadcast(cuts), "url_key", "left").withColumn("__block", F.when(F.col("__cuts").isNotNull(), place).otherwise(0)).drop("__cuts")
    inside = Window.partitionBy("url_key", "__block").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    near = points.withColumn("__near", F.max_by("__fact", F.when(F.col("__fact").isNotNull(), F.col("ts"))).over(inside)).where("__n IS NOT NULL")
    # what a block inherits: the last response of the blocks before it; only hot URLs have more than one block
    last = points.where("__fact IS NOT NULL").join(F.broadcast(hot), "url_key", "left_semi").groupBy("url_key", "__block").agg(F.max_by("__fact", "ts").alias("__last"), F.max("ts").alias("__stamp"))
    marks = near.select("url_key", "__block").join(F.broadcast(hot), "url_key", "left_semi").distinct().join(last, ["url_key", "__block"], "full")
    earlier = Window.partitionBy("url_key").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("url_key", "__block", F.max_by("__last", "__stamp").over(earlier).alias("__carried"))
    found = near.join(carried, ["url_key", "__block"], "left").select("url_key", "ts", "__n", F.coalesce("__near", "__carried").alias("__original"))
    revisits = rows.where("kind = 'revisit'")
    joined = heavy_join(revisits.where("url_key IS NOT NULL AND ts IS NOT NULL"), checkpoint(found), ["url_key", "ts"], "__n", total)
    lost = revisits.where("url_key IS NULL OR ts IS NULL").withColumn("__original", F.lit(None).cast(joined.schema["__original"].dataType))
    columns = ["record_id", "url_key", "headers", "digest", "__original"]
    return _verdict(joined.select(columns).unionByName(lost.select(columns)))


def _verdict(rows: DataFrame) -> DataFrame:
    etag = lambda h: F.regexp_replace(h["etag"], r"^[Ww]/", "")
    old = F.col("__original")
    same = [etag(F.col("headers")) == etag(old["headers"]), F.col("headers")["last-modified"] == old["headers"]["last-modified"], F.col("digest") == old["digest"]]
    agree = F.coalesce(*[F.when(s.isNotNull(), F.lit(True)) for s in same], F.lit(False))
    clash = F.greatest(*[F.coalesce(~s, F.lit(False)) for s in same])
    outcome = F.when(old.isNull(), "no_original").when(clash, "mismatch").when(agree, "resolved").otherwise("unverified")
    fresh = F.map_filter("headers", lambda k, _: ~F.lower(k).isin(*KEPT_HEADERS))
    stored = F.map_filter(old["headers"], lambda k, _: ~F.array_contains(F.map_keys(F.col("__fresh")), k))
    out = rows.withColumn("outcome", outcome).withColumn("__fresh", fresh)
    good = F.col("outcome") == "resolved"
    return out.select("record_id", "url_key", old["record_id"].alias("original_id"), "outcome", F.when(good, old["digest"]).alias("digest"), F.when(good, F.map_concat(stored, "__fresh")).otherwise(F.col("headers")).alias("headers"))


#: The registered query: each page is captured at ten times its id, and asked for again after so many.
LATER = 505


def page_records(pages: DataFrame) -> DataFrame:
    """Two records for each page: its capture, and a later revisit with the capture's validators."""
    digest = F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    stored = F.create_map(F.lit("etag"), F.concat(F.lit('"'), F.left(digest, F.lit(12)), F.lit('"')), F.lit("content-length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("server"), F.lit("a"), F.lit("date"), (F.col("page_id") * 10).cast("string"))
    again = F.create_map(F.lit("etag"), F.concat(F.lit('W/"'), F.left(digest, F.lit(12)), F.lit('"')), F.lit("content-length"), F.lit("0"), F.lit("date"), (F.col("page_id") * 10 + LATER).cast("string"))
    capture = pages.select((F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 10).alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"), stored.alias("headers"), digest.alias("digest"))
    revisit = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") * 10 + LATER).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), again.alias("headers"), F.lit(None).cast("string").alias("digest"))
    return capture.unionByName(revisit)


def op2(spark, sf_dir: str) -> DataFrame:
    out = resolve(page_records(table(spark, sf_dir, "pages")))
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select("record_id", "url_key", "original_id", "outcome", "digest", headers.alias("headers"))


OP2_SQL = r"""
WITH u AS (SELECT *, regexp_replace(trim(url), '#.*$', '') AS v, md5(coalesce(html, '')) AS d FROM pages),
x AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(v, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?]*)', 1)), '^(?:www|m)\.', ''), ':(?:80|443)$', '') AS host,
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?]*', ''),
        '([?&])(?:utm_[a-z]+|ref|gclid|fbclid|sessionid)=[^&]*', '\1', 'g'), '&{2,}', '&', 'g'), '\?&', '?', 'g'), '[?&]+$', '') AS rest FROM u),
k AS (SELECT *, host || regexp_replace(rest, '(?:/index)?(?:\.html?)?/?(\?|$)', '\1') AS url_key FROM x),
c AS (SELECT page_id, url_key, page_id * 10 AS ts, d, octet_length(encode(coalesce(html, ''))) AS n FROM k),
r AS (SELECT page_id, url_key, page_id * 10 + 505 AS ts, d FROM k),
j AS (SELECT r.page_id, r.url_key, r.ts, r.d, c.page_id AS o, c.d AS od, c.n FROM r ASOF LEFT JOIN c ON r.url_key = c.url_key AND r.ts > c.ts)
SELECT page_id * 2 + 1 AS record_id, url_key, o * 2 AS original_id,
       CASE WHEN o IS NULL THEN 'no_original' WHEN left(d, 12) <> left(od, 12) THEN 'mismatch' ELSE 'resolved' END AS outcome,
       CASE WHEN left(d, 12) = left(od, 12) THEN od END AS digest,
       CASE WHEN left(d, 12) = left(od, 12) THEN 'content-length=' || n || ';date=' || ts || ';etag="' || left(od, 12) || '";server=a'
            ELSE 'content-length=0;date=' || ts || ';etag=W/"' || left(d, 12) || '"' END AS headers
FROM j
"""
