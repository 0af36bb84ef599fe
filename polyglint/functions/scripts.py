"""Script families of characters: histograms, proportions and the routing of texts by script."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code point ranges of the families, and the language or model group that each one leads to.
FAMILIES: dict[str, list[tuple[int, int]]] = {
    "korean": [(0xAC00, 0xD7AF), (0x1100, 0x11FF)],
    "georgian": [(0x10A0, 0x10FF), (0x2D00, 0x2D2F)],
    "armenian": [(0x0530, 0x058F)],
    "bengali": [(0x0980, 0x09FF)],
    "greek": [(0x0370, 0x03FF), (0x1F00, 0x1FFF)],
    "hebrew": [(0x0590, 0x05FF)],
    "cjk_kana": [(0x3040, 0x309F), (0x30A0, 0x30FF)],
    "cjk_han": [(0x4E00, 0x9FFF), (0x3400, 0x4DBF)],
    "cyrillic": [(0x0400, 0x04FF)],
    "arabic": [(0x0600, 0x06FF), (0x0750, 0x077F)],
    "devanagari": [(0x0900, 0x097F)],
    "latin": [(0x0041, 0x005A), (0x0061, 0x007A), (0x00C0, 0x024F), (0x1E00, 0x1EFF)],
}
UNIQUE = {"korean": "kor", "georgian": "kat", "armenian": "hye", "bengali": "ben", "greek": "ell", "hebrew": "heb"}
GROUPS = ("cyrillic", "arabic", "devanagari", "latin")
#: Letters that only one Cyrillic language has.
CYRILLIC_ONLY = {"srp": "ЂђЋћ", "mkd": "ЃѓЌќЅѕ", "bel": "Ўў", "ukr": "ЇїЄє", "kaz": "ӘәҒғҚқҢңӨөҮү"}


def char_class(ranges: list[tuple[int, int]]) -> str:
    """A regular expression class that Java and RE2 read alike."""
    return "[" + "".join(rf"\x{{{a:04X}}}-\x{{{b:04X}}}" for a, b in ranges) + "]"


def count_in(text: Column | str, family: str) -> Column:
    """Characters of a family: what is left without the runs of all others."""
    text = F.col(text) if isinstance(text, str) else text
    others = char_class(FAMILIES[family]).replace("[", "[^", 1) + "+"
    return F.coalesce(F.length(F.regexp_replace(text, others, "")), F.lit(0)).cast("long")


def histogram(text: Column | str) -> list[Column]:
    """A count for each family; characters of no family, and null texts, count nowhere.

    All families but Latin lie above U+036F, so one search tells texts that need no more than the Latin count.
    """
    text = F.col(text) if isinstance(text, str) else text
    other = text.rlike(r"[\x{0370}-\x{FFFF}]")
    return [(count_in(text, f) if f == "latin" else F.when(other, count_in(text, f)).otherwise(F.lit(0).cast("long"))).alias(f) for f in FAMILIES]


def total() -> Column:
    """Classified characters, from the columns of histogram()."""
    return sum((F.col(f) for f in FAMILIES), F.lit(0).cast("long"))


def proportions() -> Column:
    """(script, n, proportion) of the families that occur, from the columns of histogram()."""
    parts = [F.struct(F.lit(f).alias("script"), F.col(f).alias("n"), F.try_divide(F.col(f), total()).alias("proportion")) for f in FAMILIES]
    return F.filter(F.array(*parts), lambda x: x["n"] > 0)


def dominant() -> Column:
    """The family with most characters (ties: the first in FAMILIES); null if there is none."""
    most = F.greatest(*[F.col(f) for f in FAMILIES])
    return F.coalesce(*[F.when((F.col(f) == most) & (most > 0), F.lit(f)) for f in FAMILIES])


def literal_detections() -> Column:
    """Detections that need no model: unique scripts, kana as jpn, Han as cmn where no kana is."""
    sure = [F.struct(F.lit(lang).alias("lang"), F.try_divide(F.col(f), total()).alias("probability"), F.col(f).alias("n")) for f, lang in UNIQUE.items()]
    sure.append(F.struct(F.lit("jpn").alias("lang"), F.try_divide(F.col("cjk_kana"), total()).alias("probability"), F.col("cjk_kana").alias("n")))
    sure.append(F.struct(F.lit("cmn").alias("lang"), F.try_divide(F.col("cjk_han"), total()).alias("probability"), F.when(F.col("cjk_kana") == 0, F.col("cjk_han")).otherwise(0).alias("n")))
    found = F.filter(F.array(*sure), lambda x: x["n"] > 0)
    return F.transform(found, lambda x: F.struct(x["lang"].alias("lang"), x["probability"].alias("probability")))


def tiered_route(text: Column | str) -> Column:
    """The first tier that matches: a language ('kor'), or a group to score ('group:latin'); latin if none does."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    has = lambda ranges: text.rlike(char_class(ranges))
    out = None
    tiers = [(has(FAMILIES[f]), lang) for f, lang in UNIQUE.items()]
    tiers += [(has(FAMILIES["cjk_kana"]), "jpn"), (has(FAMILIES["cjk_han"]), "cmn")]
    tiers += [(has(FAMILIES["cyrillic"]) & text.rlike(f"[{letters}]"), lang) for lang, letters in CYRILLIC_ONLY.items()]
    tiers += [(has(FAMILIES[g]), f"group:{g}") for g in GROUPS[:3]]
    for test, to in tiers:
        out = F.when(test, to) if out is None else out.when(test, to)
    return out.otherwise("group:latin")
