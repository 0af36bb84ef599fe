"""Quality rules with host verdicts, in DataFrame functions alone.

Each document is judged by rules; failures are summed by host, each host's failure rate is shrunk towards the corpus
by a beta prior that is fitted to the hosts themselves, and the verdict of a bad host goes to all its documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpoint, heavy_join, plain_name, table, words

#: Fixed values of the base rule: least words, and the most words (in hundredths) inside repeated five-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: A document also fails (for its host's rate) beyond these: symbols and duplicate lines in hundredths of words and lines.
MAX_SYMBOL_PERCENT, MAX_DUP_LINE_PERCENT = 10, 30
#: A host whose shrunk failure rate is above this is rejected.
MAX_HOST_RATE = 0.5
#: The fitted prior counts as at least and at most so many documents.
PRIOR_RANGE = (1.0, 10_000.0)

#: Words in five-word windows found twice or more. Windows are sorted with their positions, so neighbours with one hash
#: are repeats; each repeated position covers up to five words, fewer where the next one begins.
_REPEATS = """
CASE WHEN size(win) = size(array_distinct(win)) THEN 0L ELSE
  transform(array(array_sort(transform(win, (h, i) -> struct(h AS h, i AS i)))), s ->
    transform(array(array_sort(filter(
        transform(s, (x, k) -> IF(x.h = get(s, k - 1).h OR x.h = get(s, k + 1).h, x.i, -1)), p -> p >= 0))), p ->
      aggregate(transform(p, (x, k) -> least(5, coalesce(get(p, k + 1) - x, 5))), 0L, (a, b) -> a + b))[0])[0]
END"""

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def features(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (long); see op8's contract.

    A null text counts as empty; texts of any length are counted whole. Own columns of these names are replaced, all
    others stay.
    """
    kept = [c for c in docs.columns if c not in _COUNTS]
    text, found, lines, win, row = (plain_name(docs, c) for c in ("__text", "__words", "__lines", "__win", "__row"))
    out = docs.select(*kept, F.coalesce(F.col("text").cast("string"), F.lit("")).alias(text))
    out = out.select(*kept, text, words(text).alias(found), F.expr(rf"filter(split({text}, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias(lines))
    five = ", ".join(f"element_at({found}, i + {k})" for k in range(5))
    out = out.select(
        *kept,
        F.size(found).cast("long").alias("n_words"),
        F.expr(f"aggregate({found}, 0L, (a, w) -> a + length(w))").alias("word_chars"),
        F.expr(f"CAST(regexp_count({text}, '[#*$%&|<>]') AS long)").alias("n_symbols"),
        F.expr(f"CAST(size({lines}) - size(array_distinct({lines})) AS long)").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        F.expr(f"IF(size({found}) < 5, array(), transform(sequence(1, size({found}) - 4), i -> xxhash64({five})))").alias(win),
        F.monotonically_increasing_id().alias(row),
    )
    # filters of callers stop at a column that is not deterministic; below it they would work out the windows for each lambda
    out = out.where(F.col(row) >= 0).drop(row)
    return out.withColumn("n_repeat_words", F.expr(_REPEATS.replace("win", win))).drop(win)


def _ruled(docs: DataFrame) -> DataFrame:
    """docs with the counts, base_failed and rule_failed."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    other = (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars")) | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"))
    return features(docs).withColumn("base_failed", base).withColumn("rule_failed", base | other)


def judge(docs: DataFrame, host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """docs without text, with the counts, base_failed, rule_failed, host_rate (6 places) and kept.

    A document fails a rule if it fails the base rule or has too many symbols or duplicate lines. kept is false if the
    base rule fails or the host is rejected. A null host is a host of its own. Clashing columns are replaced; repeated
    rows are judged alike, each counting for its host; an empty table gives an empty result.
    """
    own = {f"__own{k}": c for k, c in enumerate(docs.columns) if c not in ("text", *_COUNTS, "base_failed", "rule_failed", "host_rate", "kept")}
    found = _ruled(docs.select(*[F.col(c).alias(n) for n, c in own.items()], "text", _named(host).alias("__host")))
    found = checkpoint(found.drop("text"))
    hosts, total = _hosts(found, max_host_rate)
    out = heavy_join(found, hosts, ["__host"], "__n", total)
    kept = ~F.col("base_failed") & ~F.col("__bad")
    return out.select(*[F.col(n).alias(c) for n, c in own.items()], *_COUNTS, "base_failed", "rule_failed", "host_rate", kept.alias("kept"))


def _named(host: str):
    return F.coalesce(F.col(host).cast("string"), F.lit("\0"))


def _hosts(found: DataFrame, max_host_rate: float) -> tuple[DataFrame, int]:
    """(__host, __n, host_rate, __bad) of what _ruled() found, and the number of documents."""
    hosts = checkpoint(found.groupBy("__host").agg(F.count("*").alias("__n"), F.sum(F.col("rule_failed").cast("long")).alias("__f")))
    whole = hosts.agg(F.sum("__n").alias("n"), F.sum("__f").alias("f"), F.count("*").alias("h"), F.sum(F.col("__f") * F.col("__f") / F.col("__n")).alias("sq"))
    n, f, h, sq = whole.first()
    mean = (f or 0) / n if n else 0.0
    alpha, beta = beta_prior(n or 0, f or 0, h, sq or 0.0)
    rate = (F.col("__f") + F.lit(alpha)) / (F.col("__n") + F.lit(alpha + beta)) if n else F.lit(mean)
    return hosts.select("__host", "__n", F.round(rate, 6).alias("host_rate"), (rate > max_host_rate).alias("__bad")), n or 0


def beta_prior(n: int, f: int, hosts: int, sq: float) -> tuple[float, float]:
    """alpha and beta by moments. n documents, f failures, hosts; sq: the sum over hosts of failures squared over documents.

    The spread of the hosts' rates, less what chance alone makes, tells how many documents the prior is worth.
    """
    mean = f / n if n else 0.0
    noise = mean * (1 - mean)
    spread = sq / n - mean * mean - noise * hosts / n if n else 0.0
    worth = noise / spread - 1 if spread > 0 else PRIOR_RANGE[1]
    worth = min(max(worth, PRIOR_RANGE[0]), PRIOR_RANGE[1])
    return mean * worth, (1 - mean) * worth


def keep_good(docs: DataFrame, host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """docs without the rows that judge() would not keep; columns and repeated rows stay as they are.

    The rules are worked out once. Rows that fail the base rule are laid by without their columns, for their host's rate;
    the others wait, whole, for the list of rejected hosts, which is broadcast up to a checked number of hosts.
    """
    own = {f"__own{k}": c for k, c in enumerate(docs.columns)}
    found = _ruled(docs.select(F.struct(*[F.col(c).alias(n) for n, c in own.items()]).alias("__all"), "text", _named(host).alias("__host")))
    found = checkpoint(found.select("__host", "rule_failed", F.when(~F.col("base_failed"), F.col("__all")).alias("__all")))
    hosts, _ = _hosts(found, max_host_rate)
    bad = broadcast_if_small(checkpoint(hosts.where("__bad").select(F.col("__host"))))
    good = found.where("__all IS NOT NULL").join(bad, "__host", "left_anti")
    return good.select(*[F.col(f"__all.{n}").alias(c) for n, c in own.items()])


def op8(spark, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *_COUNTS[:5], "base_failed", "rule_failed", "host_rate", "kept")


OP8_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT r, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] || ' ' || ws[i+4] AS k
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM g) WHERE c > 1),
n AS (SELECT r, sum(least(5, coalesce(nxt - i, 5))) AS c FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM d) GROUP BY r),
f AS (SELECT doc_id, host, len(ws)::BIGINT AS n_words, length(list_aggregate(ws || [''], 'string_agg', ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines
      FROM w LEFT JOIN n USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
v AS (SELECT *, base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines AS rule_failed FROM b),
h AS (SELECT host, count(*) AS n, sum(rule_failed::INT)::BIGINT AS x FROM v GROUP BY host),
p AS (SELECT sum(x) / sum(n) AS m, sum(x * x / n) / sum(n) - m * m - m * (1 - m) * count(*) / sum(n) AS s,
             least(greatest(CASE WHEN s > 0 THEN m * (1 - m) / s - 1 ELSE 10000 END, 1), 10000) AS k FROM h),
q AS (SELECT host, (x + m * k) / (n + k) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule_failed,
       round(rate, 6) AS host_rate, NOT base_failed AND rate <= 0.5 AS kept
FROM v JOIN q USING (host)
"""
