"""Language identification by compression: the dictionary that makes a text smallest names its language.

For each language a raw-content zstandard dictionary is cut from a bounded sample of labelled texts. A text is folded
to lower-case letters and compressed whole, in blocks, against each dictionary; sizes are summed over blocks. A narrow
margin between the two smallest sums marks the row as rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_rest, plain_name, table

#: Bounds of the labelled sample: texts for each language, bytes of a text, and texts of all languages, which share them
#: evenly when they are very many; each language has one at least.
SAMPLE_ROWS, SAMPLE_BYTES, ALL_ROWS = 32, 1024, 16_384
#: Bytes that are compressed at a time, so that the dictionary counts throughout a long text.
BLOCK = 4096
#: Below this relative gap between the two smallest sizes the label is rejected; the gap that makes odds of e.
MIN_MARGIN, ODDS_SCALE = 0.005, 0.01
UNKNOWN = "und"

#: ASCII letters fold to lower case, other ASCII to space; bytes of other scripts stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def fold(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_FOLD).split())


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionaries by language, from at most SAMPLE_ROWS distinct texts of each language.

    Rows whose text or language is null, and empty texts, are passed over. The choice depends on the texts alone: those
    with the least hash modulo 2^30. A first pass counts distinct texts by language, nearly, so that the second keeps
    only a small excess of the texts it needs. Ties of the hash go by the text, copies count once, an empty table gives none.
    """
    rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL AND text <> ''")
    counts = {r["lang"]: r["texts"] for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("texts")).collect()}
    if not counts:
        return {}
    spark, scale, many = labelled.sparkSession, 1 << 30, max(1, min(SAMPLE_ROWS, ALL_ROWS // len(counts)))
    share = spark.createDataFrame([(k, int(min(1.0, 64 * SAMPLE_ROWS / max(1, n)) * scale)) for k, n in counts.items()], "lang string, share long")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("hash", F.lit(scale)), "hash"))
    picked = (
        rows.withColumn("hash", F.xxhash64("text"))
        .join(F.broadcast(share), "lang")
        .where(F.pmod("hash", F.lit(scale)) < F.col("share"))
        .groupBy("lang", "hash")
        .agg(F.max(F.substring("text", 1, 4 * SAMPLE_BYTES)).alias("text"))
        .withColumn("rank", rank)
        .where(F.col("rank") <= many)
    )
    parts: dict[str, list[bytes]] = {}
    for r in picked.orderBy("lang", "rank").toLocalIterator():
        parts.setdefault(r["lang"], []).append(fold(r["text"])[:SAMPLE_BYTES])
    return {k: b" ".join(v) for k, v in sorted(parts.items())}


@cache
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=15, search_log=2, min_match=3, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
    known.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=how)


def sizes(text: str, dictionaries: dict[str, bytes]) -> dict[str, int]:
    """Compressed bytes of a whole text by language."""
    folded = fold(text)
    blocks = [folded[i : i + BLOCK] for i in range(0, len(folded), BLOCK)]
    return {k: sum(len(_compressor(d).compress(b)) for b in blocks) for k, d in dictionaries.items()}


def decide(found: dict[str, int]) -> tuple[str, float, float]:
    """The language of the least size (ties: the first by name), a score in 0 to 1, and the margin to the next."""
    order = sorted(found, key=lambda k: (found[k], k))
    least = max(found[order[0]], 1)
    score = 1 / sum(math.exp((least - max(v, 1)) / (least * ODDS_SCALE)) for v in found.values())
    margin = 1 - found[order[0]] / found[order[1]] if len(order) > 1 and found[order[1]] else 1.0
    return order[0], score, margin


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """docs with lang_pred, score, margin and rejected.

    A null text or one without a letter gives `und`, score 0 and rejected, as does a model without languages. Clashing
    columns are replaced; all others pass through, repeated rows included. Texts of any length are compressed whole, in
    blocks; of equal sizes the first language by name wins. The dictionaries are at most SAMPLE_ROWS * SAMPLE_BYTES each.
    """
    own = [c for c in docs.columns if c not in ("lang_pred", "score", "margin", "rejected")]
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    @F.pandas_udf("lang_pred string, score double, margin double, rejected boolean")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                if t is None or not shared.value or not any(map(str.isalpha, t)):
                    rows.append((UNKNOWN, 0.0, 0.0, True))
                else:
                    lang, score, margin = decide(sizes(t, shared.value))
                    rows.append((lang, score, margin, margin < MIN_MARGIN))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "margin", "rejected"])

    out = plain_name(docs, "__found")
    return docs.select(*own, classify(F.col(text).cast("string")).alias(out)).select(*own, f"{out}.*")


def op1(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc_rest("doc_id", 3) == 1).alias("held_out"))
    found = predict(docs.select("doc_id", "held_out", "text"), fit(docs.where(~F.col("held_out"))))
    return found.select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")
