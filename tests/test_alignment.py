from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kinweave.functions.dates import parse_date_value
from kinweave.operators import alignment as A
from kinweave.operators import privacy
from kinweave.operators.people import People, dated, vitals


def relative(given, surname="Novak", born=None, approx=False, died=None, day=None, death_day=None):
    return {"name": (given, surname, f"{given} {surname}"), "birth_year": born, "birth_day": day, "approx": approx, "death_year": died, "death_day": death_day}


@pytest.mark.parametrize(
    ("a", "b", "kind", "value"),
    [
        (relative("Ana", born=1803), relative("Ana", born=1803), "child", 1.15), (relative("Ana", born=1803), relative("Ana", born=1805), "child", 1.05), (relative("Ana", born=1803), relative("Ana", born=1806), "child", 0.75),
        (relative("Ana", born=1803, approx=True), relative("Ana", born=1812), "child", 1.05), (relative("Ana"), relative("Ana", born=1806), "child", 1.0), (relative("Ana", born=1803, day=102), relative("Ana", born=1803, day=102), "child", 1.2),
        (relative("Ana", born=1828, day=102), relative("Ana", born=1828, day=1019), "child", 0.75), (relative("Ana", born=1828, day=102), relative("Ana", born=1828, day=119), "child", 1.0),
        (relative("Ana", born=1881, day=919, died=1938, death_day=1001), relative("Ana", born=1881, day=819, died=1938, death_day=1001), "child", 1.0), (relative("Ana", born=1803, died=1810), relative("Ana", born=1803, died=1810), "child", 1.2),
        (relative("?", born=1803), relative("Ana", born=1803), "partner", 0.85), (relative("?"), relative("?"), "partner", 0.0), (relative("Neža", born=1803), relative("Agnes", born=1803), "child", 1.15),
    ],
)
def test_relative_similarity(a, b, kind, value):
    assert A.relative_similarity_value(a, b, kind) == pytest.approx(value) == A.relative_similarity_value(b, a, kind)


def test_events_side_by_side(spark):
    schema = "owner string, tag string, ord int, date string, place string, address string, value string"
    main = [("m", "BIRT", 0, "1800", "Bled", None, None), ("m", "OCCU", 1, "1830", "Kranj, Slovenia", None, "smith"), ("m", "RESI", 2, "1840", "Bled", None, None), ("m", "RESI", 3, "1860", "Kranj", None, None), ("m", "EMIG", 4, None, None, None, None)]
    other = [("c", "BIRT", 0, "1900", "Celje", None, None), ("c", "OCCU", 1, "1890", "Celje", None, "clerk"), ("c", "RESI", 2, "1861", "Kranj, Slovenija", None, None), ("c", "RESI", 3, "1840", "Bled", None, None), ("c", "RESI", 5, "1700", None, None, None), ("c", "EMIG", 4, None, "Graz", None, None)]
    pairs = spark.createDataFrame([("m", "c")], "main_id string, compare_id string")
    got = A.align_events(pairs, dated(spark.createDataFrame(main, schema)), dated(spark.createDataFrame(other, schema)))
    assert {(r.tag, r.main_event, r.compare_event) for r in got.collect()} == {("BIRT", 0, 0), ("OCCU", 1, None), ("OCCU", None, 1), ("RESI", 2, 3), ("RESI", 3, 2), ("RESI", None, 5), ("EMIG", 4, 4)}


def test_relatives_and_unions(spark):
    def struct(r):
        return {k: list(v) if k == "name" else v for k, v in r.items()}

    kind = "struct<name:array<string>,birth_year:int,birth_day:int,approx:boolean,death_year:int,death_day:int>"
    ours = {"a1": relative("Janez", born=1800), "a2": relative("Ana"), "a3": relative("Luka", born=1805), "a4": relative("Luka", born=1805)}
    theirs = {"b1": relative("Johannes", born=1801), "b2": relative("Ana", born=1810), "b3": relative("Ana", born=1815), "b4": relative("Luka", born=1805), "b5": relative("Luka", born=1805)}
    rows = [("g", i, j, struct(x), struct(y), "child") for i, x in ours.items() for j, y in theirs.items()]
    got = {tuple(r) for r in A.align_relatives(spark.createDataFrame(rows, f"group string, a string, b string, x {kind}, y {kind}, kind string")).collect()}
    # two Anas fit one, so none does; the Lukas say the same, so it does not matter which is which
    assert got == {("g", "a1", "b1"), ("g", "a3", "b4"), ("g", "a4", "b5")}
    none = {k: None for k in struct(relative("x"))}
    unions = [
        ("m", "c", "F1", "G1", struct(relative("Ana", "Kos", 1800)), struct(relative("Ana", "Kos", 1800)), 0.0, 2, 2), ("m", "c", "F1", "G2", struct(relative("Ana", "Kos", 1800)), struct(relative("Meta", "Zupan", 1820)), 0.2, 2, 2),
        ("m", "c", "F2", "G1", none, struct(relative("Ana", "Kos", 1800)), 0.4, 2, 2), ("m", "c", "F2", "G2", none, struct(relative("Meta", "Zupan", 1820)), 0.7, 2, 2), ("n", "d", "F3", "G3", none, struct(relative("Eva")), 0.0, 1, 1),
        ("o", "e", "F4", "G4", struct(relative("Ana", "Kos")), struct(relative("Luka", "Kos")), 0.0, 1, 1), ("p", "f", "F5", "G5", struct(relative("Ana", "Kos")), struct(relative("Ana", "Weiss")), 0.0, 1, 1),
    ]
    got = {tuple(r)[2:] for r in A.pair_unions(spark.createDataFrame(unions, f"main_id string, compare_id string, main_fam string, compare_fam string, x {kind}, y {kind}, overlap double, n_main int, n_compare int")).collect()}
    assert got == {("F1", "G1"), ("F2", "G2"), ("F3", "G3"), ("F5", "G5")}


def test_choices_and_ids(spark):
    rows = [("m", "c", "name", "A", "B", "conflict", "incoming", False), ("m", "c", "links", "x", "y", "conflict", "both", True), ("m", "c", "sex", "", "F", "incoming-only", "both", False), ("m", "c", "father", "", "Z", "incoming-only", "incoming", False),
            ("m", "c", "birth", "1800", "1801", "conflict", "incoming", False), ("m", "c", "note", "n", "", "main-only", "incoming", False), ("m", "c", "death", "", "1900", "incoming-only", "main", False)]
    df = spark.createDataFrame(rows, "main_id string, compare_id string, field string, main string, incoming string, state string, choice string, many boolean")
    now = spark.createDataFrame([("m", "name", "A"), ("m", "birth", "1799"), ("m", "links", "x")], "main_id string, field string, value string")
    got = {(r.field, r.value, r.outcome) for r in A.applied_rows(df, now).collect()}
    assert got == {("name", "B", "applied"), ("links", "y", "both"), ("sex", "F", "applied"), ("birth", "1799", "deferred")}
    taken = spark.createDataFrame([("@I1@",), ("@I3@",), ("@F2@",), ("odd",)], "id string")
    wanted = spark.createDataFrame([(f"k{i}", i) for i in range(5)], "key string, ord int")
    assert {r.key: r.id for r in A.new_ids(wanted, taken, "I").collect()} == {"k0": "@I2@", "k1": "@I4@", "k2": "@I5@", "k3": "@I6@", "k4": "@I7@"}


def test_privacy(spark):
    ind = [("f", "M"), ("m", "F"), ("a", "M"), ("b", "M"), ("c", "F"), ("d", "F"), ("x", "M"), ("k", "F")]
    edges = [("F1", "f", "husband", 0), ("F1", "m", "wife", 1), *[("F1", i, "child", 2 + n) for n, i in enumerate("abcd")], ("F2", "x", "husband", 0), ("F2", "k", "child", 1)]
    ev = [("f", "BIRT", 0, "1920"), ("m", "BIRT", 0, "1925"), ("b", "BIRT", 0, "1950"), ("m", "DEAT", 1, "2020"), ("k", "BIRT", 0, "1961")]
    people = People(spark.createDataFrame(ind, "id string, sex string"), spark.createDataFrame(edges, "fam_id string, person_id string, role string, ord int"), spark.createDataFrame([(*e, None, None) for e in ev], "owner string, tag string, ord int, date string, place string, address string"))
    vital = vitals(people.individuals, dated(people.events)).cache()
    why = {r.id: r.reason for r in privacy.living_reasons(people, vital, spark.createDataFrame([("f",)], "id string"), 2024, recently=10).collect()}
    assert why == {"f": "declared", "m": "recentDeath", "a": "relative", "b": "birth", "c": "relative", "d": "relative", "k": "birth", "x": "relative"}
    years = {r.id: r.year for r in privacy.sibling_estimates(people, vital, people.individuals).collect()}
    assert years == {"a": 1948, "c": 1952, "d": 1954, "x": 1935}
    apart = {r.id: r.year for r in privacy.sibling_estimates(People(people.individuals, people.edges, people.events.filter("owner != 'b'")), vitals(people.individuals, dated(people.events.filter("owner != 'b'"))), spark.createDataFrame([(i,) for i in "abcd"], "id string")).collect()}
    assert apart == {"a": 1953, "b": 1955, "c": 1957, "d": 1959}
    left = privacy.without_people(people, privacy.with_descendants(people, spark.createDataFrame([("x",)], "id string")))
    assert {r.id for r in left.individuals.collect()} == set("fmabcd") and left.families.count() == 1 and left.events.filter("owner = 'k'").count() == 0
    names = spark.createDataFrame([("Ana", "Kos"), (None, "Kos"), ("Ana", None), (None, None)], "g string, s string")
    for strategy, want in {"initials": ["A.K.", "K.", "A.", "Private"], "initialSurname": ["A. /Kos/", "/Kos/", "A.", "Private"], "surnameOnly": ["/Kos/", "/Kos/", "Private", "Private"], "living": ["Living"] * 4, "private": ["Private"] * 4}.items():
        assert [r[0] for r in names.select(privacy.hidden_name(F.col("g"), F.col("s"), strategy)).collect()] == want
    assert parse_date_value("1 JAN 1900", 2024)["day"] == 1
