"""Identifier rules, once for headers (driver side) and once for data columns."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# What a cleaned name looks like.
DIGIT_PREFIX = "q_"
EMPTY_NAME = "unknown"

# Whitespace as Python's str knows it. Java's \s covers ASCII only, and its dot
# also stops at other line ends than \n, so both classes are spelled out.
_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_BRACKETED = _SPACE + r"*\[[^\n]*?\]"
_SEPARATORS = r"[^A-Za-z0-9]+"


def header_name(raw: object) -> str:
    """'2021Q1 [2021Q1]' -> 'q_2021q1'; '' -> 'unknown'."""
    text = re.sub(_BRACKETED, "", str(raw))
    name = "_".join(word for word in re.split(_SEPARATORS, text) if word).lower()
    if not name:
        return EMPTY_NAME
    return DIGIT_PREFIX + name if name[0].isdigit() else name


def unique_names(names: Iterable[str]) -> list[str]:
    """Suffix repeats with _1, _2, ...; a suffixed name that is taken moves on."""
    taken: set[str] = set()
    next_suffix: dict[str, int] = {}
    result = []
    for name in names:
        candidate, k = name, next_suffix.get(name, 0)
        while candidate in taken:
            k += 1
            candidate = f"{name}_{k}"
        next_suffix[name] = k
        taken.add(candidate)
        result.append(candidate)
    return result


def normalize_identifier(col: Column) -> Column:
    """The rule of :func:`header_name` as a column expression."""
    bracketed = F.contains(col, F.lit("["))  # spares all other texts the slower pattern
    bare = F.when(bracketed, F.regexp_replace(col, _BRACKETED, "")).otherwise(col)
    name = F.lower(F.btrim(F.regexp_replace(bare, _SEPARATORS, "_"), F.lit("_")))
    return (
        F.when(name == "", F.lit(EMPTY_NAME))
        .when(name.rlike("^[0-9]"), F.concat(F.lit(DIGIT_PREFIX), name))
        .otherwise(name)
    )
