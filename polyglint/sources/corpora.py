"""Training corpora: sentence lists, HTML declarations and news sentences, and how they merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import MIN_PARAGRAPH, paragraphs, trim
from ..operators.sampling import reservoir, with_fallback

#: Files of the declaration and their languages.
DECLARATION_CODES = {
    "afr": "afr", "bel": "bel", "ben": "ben", "bul": "bul", "cat": "cat", "ces": "ces", "cmn_hans": "cmn", "dan": "dan",
    "deu_1996": "deu", "ell_monotonic": "ell", "eng": "eng", "eus": "eus", "fin": "fin", "fra": "fra", "hau_NG": "hau", "heb": "heb",
    "hin": "hin", "hrv": "hrv", "hun": "hun", "hye": "hye", "ind": "ind", "isl": "isl", "ita": "ita", "jpn": "jpn",
    "kat": "kat", "kaz": "kaz", "kor": "kor", "lit": "lit", "mar": "mar", "mkd": "mkd", "nld": "nld", "nob": "nob",
    "pes_1": "pes", "pol": "pol", "por_BR": "por", "por_PT": "por", "ron_2006": "ron", "run": "run", "rus": "rus", "slk": "slk",
    "spa": "spa", "srp_cyrl": "srp", "srp_latn": "srp", "swe": "swe", "tgl": "tgl", "tur": "tur", "ukr": "ukr", "vie": "vie",
}
#: The news corpus of each language that has one.
NEWS = {"slk": "slk_newscrawl_2016_100K", "nob": "nob_newscrawl_2019_100K", "aze": "aze_newscrawl_2013_100K", "kaz": "kaz_newscrawl_2016_100K", "afr": "afr_newscrawl_2013_100K", "run": "run_community_2017", "hrv": "hrv_newscrawl_2016_100K", "est": "est_newscrawl_2017_100K", "eus": "eus_newscrawl_2012_100K"}
#: Sentences for each language from the sentence list and from the news.
SENTENCES, NEWS_SENTENCES = 9000, 5000
SCHEMA = "lang string, text string, source_ord int, pos string"


def _there(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def sentence_list(spark: SparkSession, path: str, langs: list[str], limit: int = SENTENCES) -> DataFrame:
    """Lines of id, language and sentence; others are passed over. Long sentences come before short ones."""
    if not _there(spark, path):
        return spark.createDataFrame([], SCHEMA)
    parts = F.split("value", "\t", -1)
    rows = spark.read.text(path).where(F.size(parts) == 3).select(parts[0].alias("pos"), parts[1].alias("lang"), parts[2].alias("text")).where(F.col("lang").isin(langs))
    return with_fallback(rows, limit, key="pos").select("lang", "text", F.lit(0).alias("source_ord"), "pos")


def declarations(spark: SparkSession, folder: str, langs: list[str]) -> DataFrame:
    """Paragraphs of <code>.html files whose code stands for one of langs; missing files are passed over."""
    wanted = {c: x for c, x in DECLARATION_CODES.items() if x in langs}
    if not wanted or not _there(spark, f"{folder}/*.html"):
        return spark.createDataFrame([], SCHEMA)
    codes = F.broadcast(spark.createDataFrame(sorted(wanted.items()), "code string, lang string"))
    files = spark.read.text(f"{folder}/*.html", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.html$", 1).alias("code"), "value")
    rows = files.join(codes, "code").select("lang", "code", F.posexplode(paragraphs("value")).alias("k", "text"))
    return rows.select("lang", "text", F.lit(1).alias("source_ord"), F.concat_ws("/", "code", F.lpad(F.col("k").cast("string"), 9, "0")).alias("pos"))


def news(spark: SparkSession, folder: str, langs: list[str], limit: int = NEWS_SENTENCES) -> DataFrame:
    """Sentences of MIN_PARAGRAPH characters or more, sampled down to limit for each language."""
    out = spark.createDataFrame([], SCHEMA)
    for lang, name in NEWS.items():
        path = f"{folder}/{name}/{name}-sentences.txt"
        if lang in langs and _there(spark, path):
            parts = F.split("value", "\t", 2)
            rows = spark.read.text(path).where(F.size(parts) == 2).select(F.lit(lang).alias("lang"), trim(parts[1]).alias("text"), F.lit(2).alias("source_ord"), parts[0].alias("pos"))
            out = out.unionByName(reservoir(rows.where(F.length("text") >= MIN_PARAGRAPH), ["lang"], limit, "pos"))
    return out


def merged(spark: SparkSession, folder: str, langs: list[str], limit: int = SENTENCES) -> DataFrame:
    """All three sources; source_ord and pos give the order within a language."""
    return sentence_list(spark, f"{folder}/tatoeba.csv", langs, limit).unionByName(declarations(spark, f"{folder}/udhr/declaration", langs)).unionByName(news(spark, f"{folder}/leipzig", langs))
