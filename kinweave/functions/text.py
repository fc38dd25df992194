"""Text functions: folding, phonetic keys, name similarity.

What Catalyst can express is a Column expression; Jaro-Winkler and full Unicode folding are Arrow
batched UDFs, to be called on distinct values before they meet in pairs.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that stand for a name which is not known or not told.
PLACEHOLDERS = ("nn", "living", "privat", "private", "unknown", "unbekannt", "neznan", "neznana", "neznano", "ime", "priimek")


def fold_text(text: str | None) -> str | None:
    """Lower-case without combining marks, blanks squeezed; letters that do not decompose stay."""
    if text is None:
        return None
    bare = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return " ".join(bare.lower().split())


@F.pandas_udf(T.StringType())
def fold(texts: pd.Series) -> pd.Series:
    """Unicode folding of a column."""
    return texts.map(fold_text, na_action="ignore")


def fold_ascii(text: Column) -> Column:
    """Folding inside the JVM for text whose letters are ASCII."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def compare_key(text: Column) -> Column:
    return F.regexp_replace(fold_ascii(text), r"\s+", "")


def is_placeholder(folded: Column) -> Column:
    """Every word of a folded name is a placeholder or a single letter, or it has no letters."""
    words = F.filter(F.split(folded, r"[^\p{L}]+"), lambda w: w != "")
    return F.forall(words, lambda w: (F.length(w) <= 1) | w.isin(*PLACEHOLDERS))


def jaro(a: str, b: str) -> float:
    """Jaro similarity."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used, strict=True) if u]
    moved = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler_value(a: str | None, b: str | None) -> float | None:
    """Jaro-Winkler with a prefix of up to four and a scale of 0.1, at any Jaro similarity."""
    if a is None or b is None:
        return None
    j = jaro(a, b)
    p = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        p += 1
    return j + p * 0.1 * (1 - j)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple[str, str], float | None] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair not in known:
            known[pair] = jaro_winkler_value(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


@lru_cache(maxsize=1 << 16)
def _known_jaro_winkler(a: str | None, b: str | None) -> float | None:
    return jaro_winkler_value(a, b)


@F.pandas_udf(T.DoubleType())
def _kept_jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_known_jaro_winkler(*pair) for pair in zip(a, b, strict=True)], dtype="float64")


#: ``jaro_winkler`` that stays a column: the optimizer does not call it at each reference to its result.
kept_jaro_winkler = _kept_jaro_winkler.asNondeterministic()


def soundex_key(folded: Column) -> Column:
    """Soundex of a folded name; null without letters."""
    letters = F.regexp_replace(folded, "[^a-z]", "")
    return F.when(letters != "", F.soundex(letters))


def canonical_uid(text: Column) -> Column:
    """An identifier without braces, blanks and dashes, upper-case; null if shorter than twelve."""
    bare = F.upper(F.regexp_replace(text, r"[{}\s-]", ""))
    return F.when(F.length(bare) >= 12, bare)


def shape(text: Column) -> Column:
    """Digits as #, letters as A."""
    return F.regexp_replace(F.regexp_replace(text, r"\d", "#"), r"\p{L}", "A")


def set_similarity(a: Column, b: Column) -> Column:
    """Symmetric average of best matches between two word lists, equality as the match."""

    def side(x: Column, y: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, w: s + F.when(F.array_contains(y, w), 1.0).otherwise(0.0)) / F.size(x)

    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise((side(a, b) + side(b, a)) / 2)
