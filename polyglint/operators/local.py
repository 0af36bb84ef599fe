"""Detection of single texts without Spark, by the same rules, for SQL functions."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

from ..functions import scripts as S
from ..functions.text import SPACE
from .scoring import linear, softmax

_WHITE = re.sub(r"\\x\{([0-9A-F]{4})\}", r"\\u\1", SPACE)
_CLASS = {f: re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in r) + "]") for f, r in S.FAMILIES.items()}


def normalize(text: str) -> str:
    """As functions.text.normalize()."""
    out = re.sub("-+", " ", unicodedata.normalize("NFC", text))
    out = "".join(c for c in out if unicodedata.category(c)[0] in "LM" or re.match(f"[{_WHITE}]", c))
    return " " + re.sub(f"^[{_WHITE}]+|[{_WHITE}]+$", "", re.sub(f"[{_WHITE}]{{2,}}", " ", out).lower()) + " "


def detect_local(text: str, models: dict) -> list[tuple[str, float]]:
    return detect_all([text], models)[0]


def detect_all(texts: list[str], models: dict) -> list[list[tuple[str, float]]]:
    """Detections of each text, best first; each group's model scores all the texts that need it at once."""
    counts = [{f: len(c.findall(t)) for f, c in _CLASS.items()} for t in texts]
    normal: dict[int, str] = {}

    def scores(group: str, rows: list[int]) -> dict[int, np.ndarray]:
        own = [normal.setdefault(k, normalize(texts[k])) for k in rows]
        return dict(zip(rows, softmax(linear(own, models[group])), strict=True)) if rows else {}

    by_group = {g: scores(g, [k for k, c in enumerate(counts) if c[g]]) for g in S.GROUPS if g in models}
    out: list[list[tuple[str, float]]] = []
    for k, own in enumerate(counts):
        total, found = sum(own.values()), []
        for f, n in own.items():
            if not n:
                continue
            if f in S.UNIQUE:
                found.append((S.UNIQUE[f], n / total))
            elif f == "cjk_kana":
                found.append(("jpn", n / total))
            elif f == "cjk_han":
                found += [("cmn", n / total)] if not own["cjk_kana"] else []
            elif f in models:
                found += [(x, float(p) * n / total) for x, p in zip(models[f].langs, by_group[f][k], strict=True)]
        out.append(found)
    for k, p in scores("latin", [k for k, found in enumerate(out) if not found]).items():
        out[k] = [(x, float(v)) for x, v in zip(models["latin"].langs, p, strict=True)]
    return [sorted(found, key=lambda d: -d[1]) for found in out]
