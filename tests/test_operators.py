from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators import graph, linkage, places, profile, quality, review


def test_assignment_equals_sequential_greedy(spark):
    rng = random.Random(4)
    pairs = [(m, c, float(rng.randint(0, 6))) for m in range(30) for c in range(30) if rng.random() < 0.2]
    want, used = set(), (set(), set())
    for m, c, s in sorted(pairs, key=lambda x: (-x[2], x[0], x[1])):
        if m not in used[0] and c not in used[1]:
            want.add((m, c, s))
            used[0].add(m)
            used[1].add(c)
    df = spark.createDataFrame(pairs, "main_id long, compare_id long, score double")
    assert {tuple(r) for r in linkage.assign_one_to_one(df).collect()} == want
    assert linkage.assign_one_to_one(df.limit(0)).count() == 0
    # a chain of falling scores settles one pair a round; what is left is walked in one task
    chain = [(i, i, 1000.0 - 2 * i) for i in range(150)] + [(i + 1, i, 999.0 - 2 * i) for i in range(150)] + [(None, 1, 5.0), (2, 1, None)]
    one = linkage.assign_one_to_one(spark.createDataFrame(chain, "main_id long, compare_id long, score double"), rounds=3)
    assert {(r.main_id, r.compare_id) for r in one.collect()} == {(i, i) for i in range(150)}


def test_tables_are_cleared(spark):
    from kinweave import session

    mark = session.tables_written()
    kept = session.materialize(spark.range(3))
    assert kept.count() == 3 and session.tables_written() == mark + 1
    assert session.clear_tables(spark, mark) == 1 and session.tables_written() == mark
    with pytest.raises(Exception):
        spark.range(1).join(kept, "id").count()


def test_blocking(spark):
    df = spark.createDataFrame([(1, "S530", "ann", 1850), (2, "S530", "bob", 1859), (3, "S530", "ann", 1861), (4, "S530", "", None), (5, None, "ann", 1850)], "id long, code string, given string, year int")
    keyed = df.withColumn("keys", linkage.block_keys(F.col("code"), F.col("given"), F.col("year")))
    wide = df.withColumn("keys", linkage.block_keys(F.col("code"), F.col("given"), F.col("year"), 1))
    assert {tuple(r) for r in linkage.self_pairs(keyed).collect()} == {(1, 2), (1, 3)}
    assert {tuple(r) for r in linkage.block_pairs(keyed, wide).collect()} >= {(2, 3), (3, 2), (4, 4)}


def test_unique_keys_boost_and_links(spark):
    a = spark.createDataFrame([(1, "k"), (2, "x"), (3, "x"), (4, None)], "id long, uid string")
    b = spark.createDataFrame([(7, "k"), (8, "x"), (9, None)], "id long, uid string")
    assert [tuple(r) for r in linkage.unique_key_match(a, b, "uid").collect()] == [(1, 7)]
    cand = spark.createDataFrame([(1, 11, 90.0), (2, 12, 88.0), (3, 13, 50.0)], "main_id long, compare_id long, score double")
    parents = spark.createDataFrame([(1, 3, "father"), (2, 3, "father"), (11, 13, "father"), (12, 13, "father")], "child long, parent long, role string")
    assert [tuple(r) for r in linkage.shared_children(cand, parents).collect()] == [(3, 13, 2)]
    rel = parents.select(F.col("parent").alias("person"), F.col("child").alias("relative"))
    assert {(r.main_id, r.n, r.boosted) for r in linkage.relative_boost(cand, rel).collect()} == {(1, 0, 90.0), (2, 0, 88.0), (3, 2, 91.0)}


def test_weighted_score_and_percent(spark):
    r = spark.range(1).select(
        linkage.weighted_score([(F.lit(1.0), 3.0), (F.lit(None).cast("double"), 2.0)]),
        linkage.weighted_score([(F.lit(1.0), 3.0), (F.lit(None).cast("double"), 1.0)], 0.3),
        linkage.percent(F.lit(0.12345)),
    ).first()
    assert tuple(r) == (1.0, 0.825, 12.3)


def test_components_on_chains_and_random_graphs(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(200)] + [(rng.randint(300, 500), rng.randint(300, 500)) for _ in range(120)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {(r.node, r.component) for r in graph.connected_components(df).collect()} == {(n, find(n)) for n in parent}
    assert graph.connected_components(df.limit(0)).count() == 0


def test_walks(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6)], "src long, dst long")
    start = spark.createDataFrame([(1,)], "node long")
    assert {tuple(r) for r in graph.bfs_distance(e, start).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert graph.shortest_path(e, 1, 4) == [1, 2, 3, 4] and graph.shortest_path(e, 1, 6) == [] and graph.shortest_path(e, 4, 4) == [4]
    assert {r.node for r in graph.cycle_members(e).collect()} == {1, 2, 3}
    # two loops with a way from one to the other: what lies between is on no loop; and a node that is its own parent
    two = spark.createDataFrame([(1, 2), (2, 1), (2, 5), (5, 3), (3, 4), (4, 3), (4, 9), (8, 8), (6, 7)], "src long, dst long")
    assert {r.node for r in graph.cycle_members(two).collect()} == {1, 2, 3, 4, 8}
    p = spark.createDataFrame([(1, 2, "father"), (1, 3, "mother"), (2, 4, "father"), (3, 4, "father"), (4, 5, "father")], "child long, parent long, role string")
    assert {tuple(r) for r in graph.ahnentafel(p, 1).collect()} == {(1, 1, 0, None), (2, 2, 1, None), (3, 3, 1, None), (4, 4, 2, None), (6, 4, 2, 4), (8, 5, 3, None)}
    assert {(r.node, r.generation) for r in graph.closure(p, start).collect()} == {(1, 0), (2, 1), (3, 1), (4, 2), (5, 3)}
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "node long")
    assert {tuple(r) for r in graph.islands(e, nodes).collect()} == {(5, 5, 2), (6, 5, 2)}


def test_loops_against_reachability(spark):
    rng = random.Random(5)
    for _ in range(3):
        edges = [(rng.randint(0, 24), rng.randint(0, 24)) for _ in range(30)]
        reach = {a: {b for x, b in edges if x == a} for a in range(25)}
        for _ in range(25):
            reach = {a: reach[a] | {c for b in reach[a] for c in reach[b]} for a in reach}
        got = {r.node for r in graph.cycle_members(spark.createDataFrame(edges, "src long, dst long")).collect()}
        assert got == {a for a in reach if a in reach[a]}


def test_nearest_against_all_pairs(spark):
    import math

    rng = random.Random(9)
    points = [(i, rng.choice("ab"), rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(60)] + [(100, "a", 46.05, 14.5), (101, "b", None, 3.0), (102, "a", 89.9, 170.0), (103, "b", 0.0, 179.99)]
    entries = [(i, rng.choice("ab"), rng.gauss(46, 3), rng.gauss(14, 4)) for i in range(80)] + [(500, "b", 0.01, -179.99), (501, "a", -30.0, -100.0), (502, "a", -30.0, -100.0), (503, "b", None, 1.0)]

    def km(p, e):
        a = [math.radians(x) for x in (*p[2:], *e[2:])]
        h = math.sin((a[2] - a[0]) / 2) ** 2 + math.cos(a[0]) * math.cos(a[2]) * math.sin((a[3] - a[1]) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(min(1, h)))

    p, e = spark.createDataFrame(points, "id long, key string, lat double, lon double"), spark.createDataFrame(entries, "entry long, key string, elat double, elon double")
    for key in ("key", None):
        want = {x[0]: min((km(x, y), y[0]) for y in entries if y[2] is not None and (key is None or x[1] == y[1])) for x in points if x[2] is not None}
        got = {r.id: (r.km, r.entry) for r in places.nearest(p, e, key).collect()}
        assert got.keys() == want.keys() and all(got[i][1] == want[i][1] and abs(got[i][0] - want[i][0]) < 1e-6 for i in want)


def test_profile(spark):
    df = spark.createDataFrame([("g", "b", 1), ("g", "a", 2), ("g", "a", 4), ("g", "b", 3), ("h", None, 1)], "k string, v string, o long")
    assert [tuple(r) for r in profile.mode_first(df, ["k"], "v", "o").collect()] == [("g", "b", 2)]
    assert spark.range(1).select(profile.upper_median(F.array(*map(F.lit, [9, 1, 3, 2])))).first()[0] == 3
    votes = spark.createDataFrame([("s", "en", 1), ("s", "en", 2), ("s", "en", 3), ("s", "de", 4), ("s", "en", 1)], "g string, v string, u long")
    assert [(r.v, r.n) for r in profile.majority(votes, "g", "v", "u").collect()] == [("en", 3)]
    assert [(r.v, r.n) for r in profile.majority(votes.filter("u != 3").union(votes.filter("u = 4").withColumn("u", F.lit(9))), "g", "v", "u", 0.5).collect()] == [("de", 2)]
    best = spark.createDataFrame([("a", 1, 9.0), ("a", 2, 8.0), ("b", 3, 9.0), ("b", 4, 8.99), ("c", 5, 1.0)], "g string, i long, s double")
    assert {r.i for r in profile.confident_best(best, "g", "s", 0.05, F.col("i")).collect()} == {1, 5}


def test_review(spark):
    a = spark.createDataFrame([(1, "x", "1850"), (2, "y", None)], "id long, name string, born string")
    b = spark.createDataFrame([(1, "z", "1850-02"), (3, "w", "1900")], "id long, name string, born string")
    states = review.field_states(a, b, "id", ["name", "born"])
    got = {(r.id, r.field): (r.state, r.choice) for r in review.default_choice(states).collect()}
    assert got == {(1, "name"): ("conflict", "main"), (1, "born"): ("conflict", "incoming"), (2, "name"): ("main-only", "main"), (2, "born"): ("agree", "main"), (3, "name"): ("incoming-only", "incoming"), (3, "born"): ("incoming-only", "incoming")}
    assert {tuple(r) for r in review.audit_diff(a, b, "id", ["name", "born"]).collect()} == {(1, "changed"), (2, "removed"), (3, "added")}
    log = spark.createDataFrame([(1, 1, None, "a"), (1, 2, "a", "b"), (2, 1, "q", "r"), (2, 2, "r", "q")], "id long, ord int, before string, after string")
    assert [tuple(r) for r in review.coalesce_patches(log, "id", "ord").collect()] == [(1, None, "b")]
    old, new = spark.createDataFrame([(1, 1), (2, 2)], "main_id long, compare_id long"), spark.createDataFrame([(3, 2)], "main_id long, compare_id long")
    assert {tuple(r) for r in review.replace_assignments(old, new).collect()} == {(1, 1), (3, 2)}


def test_places_and_quality(spark):
    uses = spark.createDataFrame([(1, ["A", "B"]), (1, ["A", "B"]), (2, ["A"]), (3, [])], "r long, p array<string>")
    assert {tuple(r) for r in places.place_tree(uses, "p", "r").collect()} == {("A", 1, 1, 2), ("A > B", 2, 1, 1)}
    pts = spark.createDataFrame([("x", 1.0, 1.0), ("x", 1.0, 1.0), ("x", 1.0003, 1.0), ("x", 1.0007, 1.0), ("x", 2.0, 1.0), ("y", 1.0, 1.0)], "place string, lat double, lon double")
    assert {(r.place, r.spot, r.n) for r in places.coord_conflicts(pts, "place", "lat", "lon").collect()} == {("x", 0, 4), ("x", 1, 1)}
    rows = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id long, ref long")
    assert [r.id for r in quality.dangling(rows, "ref", spark.createDataFrame([(5,)], "k long"), "k").collect()] == [2]
    assert spark.range(1).select(quality.redact_text(F.lit("a.b@c.example.com at 10.0.0.1."))).first()[0] == "[mail] at [ip]."


@pytest.mark.parametrize("name", ["ring", "The Ring", "ringlet", "string", "x"])
def test_search_rank(spark, name):
    want = {"ring": 0, "The Ring": 1, "ringlet": 2, "string": 3, "x": None}[name]
    assert spark.range(1).select(places.search_rank(F.lit(name), F.lit("ring"))).first()[0] == want
