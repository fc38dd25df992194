from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kinweave.functions import dates, geo
from kinweave.functions.text import canonical_uid, fold, fold_text, is_placeholder, jaro_winkler, jaro_winkler_value, set_similarity, shape, soundex_key


@pytest.mark.parametrize(
    ("a", "b", "value"),
    [("joze", "jozef", 0.96), ("william", "bill", 0.73), ("anton", "alojz", 0.64), ("anton", "jakob", 0.60), ("jurij", "georg", 0.47), ("marta", "ursula", 0.58), ("franc", "francisek", 0.91), ("miko", "mihael", 0.69), ("neza", "agnes", 0.0)],
)
def test_jaro_winkler_table(a, b, value):
    assert round(jaro_winkler_value(a, b), 2) == value == round(jaro_winkler_value(b, a), 2)


def test_text_columns(spark):
    df = spark.createDataFrame([("Müller", "muller"), ("  Österreich ", None), (None, "x"), ("Đuro", "nn")], "a string, b string")
    rows = df.select(fold("a"), jaro_winkler("a", "b"), soundex_key(F.lit("smyth")), is_placeholder("b"), shape(F.lit("Ab1-2"))).collect()
    assert [r[0] for r in rows] == ["muller", "osterreich", None, "đuro"]
    assert rows[1][1] is None and rows[0][2] == "S530" and rows[3][3] and not rows[0][3] and rows[0][4] == "AA#-#"
    assert fold_text(None) is None
    one = df.limit(1).select(canonical_uid(F.lit("{ab-cd ef01234567}")), canonical_uid(F.lit("ab")), set_similarity(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a")))).first()
    assert tuple(one) == ("ABCDEF01234567", None, 0.75)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("12 JAN 1850", ("exact", 1850, 1, 12, None)), ("ABT 1900", ("about", 1900, None, None, None)), ("BET 1801 AND MAR 1805", ("between", 1801, None, None, 1805)),
        ("FROM 1801 TO 1805", ("range", 1801, None, None, 1805)), ("BEF FEB 1700", ("before", 1700, 2, None, None)), ("3.4.1922", ("exact", 1922, 4, 3, None)), ("3.4.31", ("exact", 1931, 4, 3, None)),
        ("3.4.22", ("exact", 2022, 4, 3, None)), ("1850-07-02", ("exact", 1850, 7, 2, None)), ("unknown", ("unknown", None, None, None, None)), ("40 JAN 1850", ("unknown", None, None, None, None)), ("5 FOO 1850", ("unknown", None, None, None, None)),
    ],
)
def test_parse_date(text, want):
    p = dates.parse_date_value(text, 2024)
    assert (p["qualifier"], p["year"], p["month"], p["day"], p["year2"]) == want


def test_date_columns(spark):
    df = spark.createDataFrame([("12 JAN 1850",), (None,), ("ABT 1851",)], "t string").withColumn("p", dates.parse_date(2024)("t"))
    assert [r.p.year if r.p else None for r in df.collect()] == [1850, None, 1851]
    d = spark.createDataFrame([(1850, 1, 12, 1850, 1, 12), (1850, 1, 1, 1850, 1, 2), (1850, 1, 1, 1850, 2, 2), (1850, None, None, 1850, None, None), (1850, 1, 1, 1852, 1, 1), (1850, 1, 1, 1900, 1, 1), (None, 1, 1, 1900, 1, 1)], "a int, b int, c int, d int, e int, f int")
    assert [r[0] for r in d.select(dates.age_between(*[F.col(c) for c in "abcdef"])).collect()] == [0, 0, 0, 0, 2, 50, None]


SIMILAR = [
    ("12 JAN 1850", "12 JAN 1850", 1.0), ("12 JAN 1850", "13 JAN 1850", 0.9), ("12 JAN 1850", "12 FEB 1850", 0.55), ("1850", "1850", 0.9), ("12 JAN 1850", "1850", 0.9),
    ("ABT 12 JAN 1850", "12 JAN 1850", 0.9), ("1850", "1851", 0.8), ("1850", "1854", 0.2), ("1850", "1855", 0.0), ("ABT 1850", "1855", 1 - 5 / 11), ("ABT 1850", "1860", 1 / 11), ("ABT 1850", "1861", 0.0),
    ("BEF 1900", "1700", 0.9), ("BEF 1900", "1903", 1 - 3 / 11), ("AFT 1900", "1890", 1 / 11), ("AFT 1900", "1889", 0.0), ("BET 1800 AND 1810", "1805", 0.9), ("BET 1810 AND 1800", "1812", 1 - 2 / 11), ("unknown", "1850", None), (None, "1850", None),
]
SORTED = [
    ("BEF 3 MAY 1900", 18999999), ("AFT 3 MAY 1900", 19009999), ("3 MAY 1900", 19000503), ("MAY 1900", 19000550), ("1900", 19009000), ("FROM 1900 TO 1905", 19059000),
    ("BET 1900 AND 1905", 19009000), ("unknown", 9999999), (None, 9999999),
]
REFINES = [
    ("1949", "12 MAR 1949", True), ("12 MAR 1949", "1949", False), ("MAR 1949", "12 APR 1949", False), ("ABT 1949", "1949", True), ("1949", "1949", False), ("FROM 1949 TO 1950", "12 MAR 1949", False), ("1948", "12 MAR 1949", False),
]


def test_date_rules_by_hand(spark):
    def parsed(rows):
        df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)], "i int, a string, b string")
        return df.withColumns({"x": dates.parse_date(2024)("a"), "y": dates.parse_date(2024)("b")}).orderBy("i")

    got = [r[0] for r in parsed(SIMILAR).select(dates.date_similarity(F.col("x"), F.col("y"))).collect()]
    assert got == [pytest.approx(v) if v is not None else None for *_, v in SIMILAR]
    assert got == [r[0] for r in parsed([(b, a, v) for a, b, v in SIMILAR]).select(dates.date_similarity(F.col("x"), F.col("y"))).collect()]
    assert [r[0] for r in parsed([(a, None, v) for a, v in SORTED]).select(dates.sort_key(F.col("x"))).collect()] == [v for _, v in SORTED]
    assert [r[0] for r in parsed(REFINES).select(dates.refines(F.col("x"), F.col("y"))).collect()] == [v for *_, v in REFINES]
    keys = [r[0] for r in parsed([("Abt. 1900", None, 0), ("ABT 1900", None, 0), ("odd  Text", None, 0)]).select(dates.compare_key(F.col("x"), F.lower("a"))).collect()]
    assert keys[0] == keys[1] and keys[2] == "oddtext"
    spans = [(1817, 1921, True, "1817–1921"), (1817, None, True, "1817–"), (1817, None, False, "1817"), (None, 1921, True, "–1921"), (None, None, False, "")]
    df = spark.createDataFrame(spans, "b int, d int, x boolean, w string")
    assert all(r[0] == r[1] for r in df.select(dates.lifespan(F.col("b"), F.col("d"), F.col("x")), "w").collect())


def test_jaro_keeps_half_transpositions():
    # six letters match, three of them stand elsewhere: one and a half transpositions
    assert jaro_winkler_value("xabcyz", "xbcayz") == pytest.approx((lambda j: j + 0.1 * (1 - j))((1 + 1 + (6 - 1.5) / 6) / 3))


def test_placeholders_and_links(spark):
    from kinweave.functions.links import link_key, parish_lang, with_parish_lang

    words = [("privat", True), ("ime", True), ("j", True), ("n. n.", True), ("?", True), ("neznano", True), ("ana", False), ("ana n", False)]
    df = spark.createDataFrame(words, "t string, w boolean")
    assert all(r[0] == r[1] for r in df.select(is_placeholder("t"), "w").collect())
    urls = [
        ("http://Site.org/a/", "https://site.org/a"), ("https://site.org/a?id=1", "https://site.org/a?id=1"), (" https://site.org/a?id=2/ ", "https://site.org/a?id=2"),
        ("https://data.matricula-online.eu/sl/slovenia/x/", "https://data.matricula-online.eu/xx/slovenia/x"), ("https://de.geneanet.org/friedhof/view/7", "https://xx.geneanet.org/cemetery/view/7"),
        ("https://www.familysearch.org/sl/ark:/61903/1:1:AB-C?lang=en&cat=77&i=3", "https://www.familysearch.org/ark:/61903/1:1:ab-c?cat=77"), ("https://youtu.be/AbC", "https://youtu.be/abc#id=AbC"),
    ]
    df = spark.createDataFrame(urls, "u string, w string")
    assert [r[0] for r in df.select(link_key(F.col("u"))).collect()] == [w for _, w in urls]
    one = df.limit(1).select(parish_lang(F.lit(urls[3][0])), with_parish_lang(F.lit(urls[3][0]), "de")).first()
    assert tuple(one) == ("sl", "https://data.matricula-online.eu/de/slovenia/x/")


def test_geo(spark):
    df = spark.range(1)
    r = df.select(
        geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)), geo.parse_coord(F.lit("46°30'0\"S")), geo.parse_coord(F.lit("N46.05")), geo.parse_coord(F.lit("-14.5")), geo.parse_coord(F.lit("north"))
    ).first()
    assert round(r[0], 1) == 10007.5 and tuple(r)[1:] == (-46.5, 46.05, -14.5, None)


def test_natural_bounds():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcd", k=rng.randint(0, 7))) for _ in range(2))
        v = jaro_winkler_value(a, b)
        assert 0 <= v <= 1 and (v == 1) == (a == b)
