"""Text clean-up for n-gram extraction, and HTML paragraphs."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: the white space of JavaScript, written so that Java and RE2 read it alike.
SPACE = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: Fixed value: the least length of a paragraph, in characters after trimming.
MIN_PARAGRAPH = 10


@F.pandas_udf(StringType())
def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(text: Column) -> Column:
    """Canonical composition. There is no built-in for it; texts below U+0300, which it never changes, pass by the Python
    worker: it gets a null for them."""
    odd = text.rlike(r"[^\x00-\x{02FF}]")
    return F.when(odd, _nfc(F.when(odd, text))).otherwise(text)


def normalize(text: Column | str) -> Column:
    """Lower-case letters and marks with single spaces, and a space at either end; null stays null.

    Hyphens become spaces, all else that is no letter, mark or space goes without a trace, and runs of white space shrink
    to a space; a white-space character that stands alone stays as it is.
    """
    out = nfc(F.col(text) if isinstance(text, str) else text)
    out = F.regexp_replace(out, "-+", " ")
    out = F.regexp_replace(out, rf"[^\p{{L}}\p{{M}}{SPACE}]+", "")
    out = F.regexp_replace(out, rf"[{SPACE}]{{2,}}", " ")
    out = F.regexp_replace(F.lower(out), rf"^[{SPACE}]+|[{SPACE}]+$", "")
    return F.concat(F.lit(" "), out, F.lit(" "))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def paragraphs(html: Column | str) -> Column:
    """The trimmed texts of literal <p> elements of MIN_PARAGRAPH characters or more; entities stay as they are."""
    html = F.col(html) if isinstance(html, str) else html
    found = F.regexp_extract_all(html, F.lit("(?s)<p>(.*?)</p>"), F.lit(1))
    return F.filter(F.transform(found, lambda p: trim(strip_tags(p))), lambda p: F.length(p) >= MIN_PARAGRAPH)


def truncate(text: Column | str, size: Column | int) -> Column:
    """At most size characters, back to the last space if that leaves more than five; shorter texts stay."""
    text = F.col(text) if isinstance(text, str) else text
    size = F.lit(size) if isinstance(size, int) else size
    head = F.left(text, size)
    cut = F.length(head) - F.locate(" ", F.reverse(head))
    has = F.locate(" ", F.reverse(head)) > 0
    return F.when(F.length(text) <= size, text).when(has & (cut > 5), F.left(head, cut)).otherwise(head)
