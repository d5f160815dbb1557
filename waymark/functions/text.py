"""Text functions: folding, trimming, splitting; all inside Catalyst."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\p{Z}\x{85}]+"


@functools.cache
def _accents() -> tuple[str, str]:
    """Characters that are one base letter with marks, and those letters, by Unicode's own data."""
    source, target = [], []
    for point in range(0xA0, 0xFFFF):
        if 0xAC00 <= point <= 0xD7A3 or 0xD800 <= point <= 0xDFFF:
            continue
        c = chr(point)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(base) == 1 and base != c:
            source.append(c)
            target.append(base)
    return "".join(source), "".join(target)


def fold(text: Column) -> Column:
    """Without diacritics, then in lower case; the same in every locale."""
    source, target = _accents()
    return F.lower(F.regexp_replace(F.translate(text, source, target), r"\p{Mn}+", ""))


def fold_literal(text: str) -> str:
    """`fold` of one query string, on the driver."""
    table = str.maketrans(*_accents())
    return "".join(c for c in text.translate(table) if unicodedata.category(c) != "Mn").lower()


def trimmed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{_SPACE}", ""), f"{_SPACE}$", "")


def name_and_area(text: Column) -> tuple[Column, Column]:
    """A request's place and area: trimmed parts around the first comma; without one, the text as it is."""
    parts = F.split(text, ",", -1)
    comma = F.size(parts) > 1
    return F.when(comma, trimmed(F.get(parts, 0))).otherwise(text), F.when(comma, trimmed(F.get(parts, 1))).otherwise(F.lit(""))
