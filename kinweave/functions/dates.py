"""Partial dates: parsing, order and similarity."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: English month names of tagged-line family files, and the qualifiers before a date.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
QUALIFIERS = {"ABT": "about", "CAL": "about", "EST": "about", "CIRCA": "about", "BEF": "before", "AFT": "after", "FROM": "from", "TO": "to", "INT": "interpreted"}
DATE_TYPE = "struct<raw:string,qualifier:string,year:int,month:int,day:int,year2:int,month2:int,day2:int>"

_PART = re.compile(r"^(?:(?:(\d{1,2})\s+)?([A-Z]{3,9})\.?\s+)?(\d{3,4})$")
_ISO = re.compile(r"^(\d{4})-(\d{1,2})(?:-(\d{1,2}))?$")
_DOTTED = re.compile(r"^(\d{1,2})[./]\s?(\d{1,2})[./]\s?(\d{2,4})$")


def _part(text: str, year_now: int) -> tuple[int, int | None, int | None] | None:
    text = text.strip()
    if m := _ISO.match(text):
        return int(m[1]), int(m[2]), int(m[3]) if m[3] else None
    if m := _DOTTED.match(text):
        year = int(m[3])
        if year < 100:  # two digits: the latest such year that is not in the future
            year += year_now // 100 * 100
            year -= 100 if year > year_now else 0
        return year, int(m[2]), int(m[1])
    if m := _PART.match(text):
        month = None
        if m[2]:
            if m[2][:3] not in MONTHS:
                return None
            month = MONTHS.index(m[2][:3]) + 1
        return int(m[3]), month, int(m[1]) if m[1] else None
    return None


def parse_date_value(text: str | None, year_now: int) -> dict | None:
    """A date phrase as a partial date; parts that are not stated are null."""
    if text is None:
        return None
    out = dict.fromkeys(("year", "month", "day", "year2", "month2", "day2")) | {"raw": text, "qualifier": "unknown"}
    rest = re.sub(r"\s+", " ", text.strip().upper())
    qualifier = "exact"
    if m := re.match(r"^(?:BET|FROM) (.+?) (?:AND|TO) (.+)$", rest):
        a, b, qualifier = _part(m[1], year_now), _part(m[2], year_now), "between" if rest.startswith("BET") else "range"
    else:
        first, _, tail = rest.partition(" ")
        if first.rstrip(".") in QUALIFIERS and tail:
            qualifier, rest = QUALIFIERS[first.rstrip(".")], re.sub(r"\(.*\)$", "", tail).strip()
        a, b = _part(rest, year_now), None
    if a is None or not 100 <= a[0] or not (a[1] is None or 1 <= a[1] <= 12) or not (a[2] is None or 1 <= a[2] <= 31):
        return out
    out |= {"qualifier": qualifier, "year": a[0], "month": a[1], "day": a[2]}
    if b:
        out |= {"year2": b[0], "month2": b[1], "day2": b[2]}
    return out


def parse_date(year_now: int):
    """A UDF from date phrases to partial dates; the clock is a parameter."""

    @F.pandas_udf(DATE_TYPE)
    def parse(texts: pd.Series) -> pd.DataFrame:
        known = {t: parse_date_value(t, year_now) for t in texts.dropna().unique()}
        empty = dict.fromkeys(("raw", "qualifier", "year", "month", "day", "year2", "month2", "day2"))
        rows = [known.get(t) or empty for t in texts]
        frame = pd.DataFrame(rows, columns=list(empty))
        return frame.astype({c: "Int32" for c in ("year", "month", "day", "year2", "month2", "day2")})

    return parse


def sort_key(date: Column) -> Column:
    """Order of partial dates: before a year just under it and after one past its end, whatever the month;
    a period by its end; months without a day mid-month, years alone after all their days, no year last."""
    end = (date["qualifier"] == "range") & date["year2"].isNotNull()
    year, month, day = (F.when(end, date[f"{p}2"]).otherwise(date[p]) for p in ("year", "month", "day"))
    return F.coalesce(
        F.when(date["year"].isNull(), F.lit(9_999_999))
        .when(date["qualifier"] == "before", date["year"] * 10000 - 1)
        .when(date["qualifier"] == "after", date["year"] * 10000 + 9999)
        .when(F.coalesce(month, F.lit(0)) == 0, year * 10000 + 9000)
        .when(F.coalesce(day, F.lit(0)) == 0, year * 10000 + month * 100 + 50)
        .otherwise(year * 10000 + month * 100 + day),
        F.lit(9_999_999),
    )


#: Qualifiers that bound a date, the years two dates may be apart, and the scores within a year.
BOUNDS = ("before", "after", "between", "range", "from", "to")
TOLERANCE, LOOSE = 4, 10
OTHER_MONTH, NEAR, EXACT = 0.55, 0.9, 1.0


def date_similarity(a: Column, b: Column) -> Column:
    """Similarity of two partial dates (structs), null if either has no year.

    Bounds that meet are as good as near; others fall linearly with the years apart, more slowly if
    a date is not exact. Within a year only two exact days that agree are the same.
    """
    far = F.lit(1 << 20)

    def low(d: Column) -> Column:
        other = F.when(d["qualifier"].isin("between", "range"), F.least(d["year"], F.coalesce(d["year2"], d["year"])))
        return F.when(d["qualifier"].isin("before", "to"), -far).otherwise(F.coalesce(other, d["year"]))

    def high(d: Column) -> Column:
        other = F.when(d["qualifier"].isin("between", "range"), F.greatest(d["year"], F.coalesce(d["year2"], d["year"])))
        return F.when(d["qualifier"].isin("after", "from"), far).otherwise(F.coalesce(other, d["year"]))

    outside = F.greatest(low(a) - high(b), low(b) - high(a))
    loose = (a["qualifier"] != "exact") | (b["qualifier"] != "exact")
    reach = F.when(loose, LOOSE).otherwise(TOLERANCE)
    gap = F.abs(a["year"] - b["year"])
    differ = [F.coalesce(a[p] != b[p], F.lit(False)) for p in ("month", "day")]
    whole = a["day"].isNotNull() & a["month"].isNotNull() & b["day"].isNotNull() & b["month"].isNotNull()
    return (
        F.when(F.coalesce(a["year"], F.lit(0)) * F.coalesce(b["year"], F.lit(0)) == 0, F.lit(None).cast("double"))
        .when((a["qualifier"].isin(*BOUNDS) | b["qualifier"].isin(*BOUNDS)) & (outside <= 0), NEAR)
        .when(a["qualifier"].isin(*BOUNDS) | b["qualifier"].isin(*BOUNDS), F.when(outside > LOOSE, 0.0).otherwise(1 - outside / F.lit(LOOSE + 1.0)))
        .when(gap > reach, 0.0)
        .when(gap != 0, 1 - gap / (reach + 1.0))
        .when(differ[0], OTHER_MONTH)
        .when(differ[1], NEAR)
        .when(~loose & whole, EXACT)
        .otherwise(NEAR)
    )


def precision(date: Column) -> Column:
    """0 nothing, 1 year, 2 month, 3 day; half a step less if the date is not exact."""
    rank = F.when(date["month"].isNull(), 1.0).when(date["day"].isNull(), 2.0).otherwise(3.0)
    return F.when(date["year"].isNull(), 0.0).otherwise(rank - F.when(date["qualifier"] != "exact", 0.5).otherwise(0.0))


def refines(main: Column, incoming: Column) -> Column:
    """The incoming date says more than the main one and contradicts nothing of it; periods refine nothing."""
    agree = [main[p].isNull() | (main[p] == F.coalesce(incoming[p], F.lit(-1))) for p in ("month", "day")]
    return F.coalesce(
        (main["year"] == incoming["year"]) & main["year2"].isNull() & incoming["year2"].isNull() & agree[0] & agree[1] & (precision(incoming) > precision(main)),
        F.lit(False),
    )


def compare_key(date: Column, folded: Column) -> Column:
    """Equal for dates that mean the same; what is no date falls back to its folded text."""
    parts = F.concat_ws("|", date["qualifier"], *[F.coalesce(date[p].cast("string"), F.lit("")) for p in ("year", "month", "day", "year2", "month2", "day2")])
    return F.when(F.coalesce(date["qualifier"], F.lit("unknown")) == "unknown", F.regexp_replace(folded, r"\s+", "")).otherwise(parts)


def birth_sort_key(date: Column) -> Column:
    """Year, month and day as a number, absent parts 0; infinite without a year."""
    return F.coalesce((date["year"] * 10000 + F.coalesce(date["month"], F.lit(0)) * 100 + F.coalesce(date["day"], F.lit(0))).cast("double"), F.lit(float("inf")))


def lifespan(birth: Column, death: Column, deceased: Column) -> Column:
    """1817–1921, 1817– (dead, no year), 1817, –1921 or nothing."""
    b, d = birth.cast("string"), death.cast("string")
    return (
        F.when(birth.isNotNull() & death.isNotNull(), F.concat(b, F.lit("–"), d))
        .when(birth.isNotNull(), F.concat(b, F.when(deceased, "–").otherwise("")))
        .when(death.isNotNull(), F.concat(F.lit("–"), d))
        .otherwise("")
    )


def age_between(y1: Column, m1: Column, d1: Column, y2: Column, m2: Column, d2: Column) -> Column:
    """Whole years between two partial dates; null outside 0..125."""
    before = (m1.isNotNull() & m2.isNotNull()) & ((m2 < m1) | ((m2 == m1) & F.coalesce(d2 < d1, F.lit(False))))
    age = y2 - y1 - F.when(before, 1).otherwise(0)
    return F.when(age.between(0, 125), age)
