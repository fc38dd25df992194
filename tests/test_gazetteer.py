from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.operators import gazetteer as G

ENTRIES = [
    (1, "Žiri", "Ziri", ["Sairach"], 46.0, 14.1, "P", "SI", ["Gorenjska"], 3600, False), (2, "Bled", "Bled", [], 46.37, 14.11, "P", "SI", ["Gorenjska"], 5000, False), (3, "Bled", "Bled", [], 46.371, 14.111, "P", "SI", ["Gorenjska"], 10, True),
    (4, "Bled", "Bled", [], 50.0, 20.0, "P", "PL", ["Mazowsze"], 90, False), (5, "Celje", "Celje", [], 46.2, 15.2, "A", "SI", ["Savinjska"], 99999, False), (6, "Celje", "Celje", [], 46.23, 15.26, "P", "SI", ["Savinjska"], 37000, False),
    (7, "Novo Mesto", None, None, 45.8, 15.1, "P", "SI", None, 23000, False),
]
SCHEMA = "entry long, name string, ascii string, alt array<string>, lat double, lon double, fclass string, country string, admin array<string>, population long, register boolean"


def test_lookup(spark):
    reg = spark.createDataFrame(ENTRIES, SCHEMA)
    asked = [
        ("exact", "ziri", None, None), ("other name", "SAIRACH", None, "SI"), ("country", "Bled", None, "PL"), ("twin", "Bled", None, "SI"), ("lived in", "Celje", None, None), ("wrong parent", "Žiri", ["Dolenjska"], None),
        ("parent", "Bled", ["gorenjska"], None), ("typo first letter", "Xovo Mesto", None, None), ("dropped letter", "Nvo Mesto", None, None), ("no country", "Bled", None, "AT"), ("nothing", "Zagreb", None, None), ("empty", "", None, None), ("null", None, None, None),
    ]
    got = {r.id: (r.entry, round(r.score, 2)) for r in G.lookup(spark.createDataFrame(asked, "id string, name string, parents array<string>, country string"), reg).collect()}
    assert got["exact"] == (1, 1.0) and got["other name"] == (1, 0.97) and got["country"] == (4, 1.0) and got["twin"][0] == 3 and got["lived in"] == (6, 1.0)
    assert got["wrong parent"] == (1, 0.94) and got["parent"][0] == 3 and got["typo first letter"][0] == 7 and 0.8 < got["typo first letter"][1] < 0.95 and got["dropped letter"][0] == 7
    assert not {"no country", "nothing", "empty", "null"} & got.keys()
    assert G.lookup(spark.createDataFrame(asked, "id string, name string, parents array<string>, country string").limit(0), reg).count() == 0
    assert [(r.entry, r["rank"]) for r in G.search_names(reg, "mesto").collect()] == [(7, 1)] and G.search_names(reg, "x").count() == 0
    assert [r.entry for r in G.search_names(reg, "ce").collect()] == [5, 6]


def test_votes_and_keys(spark):
    reg = spark.createDataFrame(ENTRIES, SCHEMA)
    names = spark.createDataFrame([("f", n) for n in ("Žiri", "Celje", "novo mesto", "Bled")] + [("g", n) for n in ("Žiri", "x", "y", "z")], "file string, name string")
    assert [tuple(r) for r in G.country_by_register(names, reg, least=3).collect()] == [("f", "SI", 3)]
    parts = spark.createDataFrame([("f", ["a", "Kranj"]), ("f", ["b", "Gorenjska"]), ("f", ["c", "gorenjska"]), ("f", ["d", "Dolenjska"]), ("g", ["x"])], "file string, parts array<string>")
    level = G.parent_levels(parts, spark.createDataFrame([("Gorenjska",), ("Dolenjska",)], "name string"), spark.createDataFrame([("Kranj",)], "name string"))
    assert [tuple(r) for r in level.collect()] == [("f", "division")]
    df = spark.createDataFrame([("Kranj, Kranj, Slovenija", "Kranj,Slovenia"), (None, "x")], "a string, b string")
    assert [tuple(r) for r in df.select(G.place_key("a"), G.place_key("b"), G.place_similarity("a", "b"), G.country_token(F.lit("Avstrija"))).collect()] == [("kranj,slovenia", "kranj,slovenia", 1.0, "austria"), (None, "x", None, "austria")]
