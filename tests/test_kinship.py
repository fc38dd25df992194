"""Search, batch criteria and kinship against plain walks over random families."""

from __future__ import annotations

import random
from collections import deque

from pyspark.sql import functions as F

from kinweave.operators import kinship, search
from kinweave.operators.people import People, dated, vitals


def register(seed, n=60):
    """Random people: (sex, birth year, death year) and families with spouses and children, no loops."""
    rng = random.Random(seed)
    people = {f"I{i:02d}": (rng.choice("MFU"), rng.choice([None, 1700 + 4 * i]), rng.choice([None, None, 1760 + 4 * i])) for i in range(n)}
    families, ids = {}, list(people)
    for f in range(22):
        a, b = rng.sample(range(n - 20), 2)
        kids = [k for k in rng.sample(range(max(a, b) + 1, n), min(rng.randint(0, 3), n - max(a, b) - 1)) if sum(ids[k] in x["kids"] for x in families.values()) < 2]
        families[f"F{f:02d}"] = {"h": ids[a] if rng.random() < 0.9 else None, "w": ids[b] if rng.random() < 0.9 else None, "kids": [ids[k] for k in kids]}
    return people, families


class Walk:
    def __init__(self, people, families):
        self.people, self.families = people, families
        self.parents = {i: [p for f in sorted(families) if i in families[f]["kids"] for p in (families[f]["h"], families[f]["w"]) if p] for i in people}
        self.kids = {i: [k for f in sorted(families) if i in (families[f]["h"], families[f]["w"]) for k in families[f]["kids"]] for i in people}
        self.mates = {i: [m for f in sorted(families) if i in (h := (families[f]["h"], families[f]["w"])) for m in h if m and m != i] for i in people}

    def up(self, start):
        seen, queue = {start: 0}, deque([start])
        while queue:
            i = queue.popleft()
            for p in self.parents[i]:
                if p not in seen:
                    seen[p] = seen[i] + 1
                    queue.append(p)
        return seen

    def reach(self, start, steps, without=None):
        seen, queue = {start: 0}, deque([start])
        while queue:
            i = queue.popleft()
            for p in steps(i):
                if p not in seen and p != without:
                    seen[p] = seen[i] + 1
                    queue.append(p)
        return seen


def tables(spark, people, families):
    ind = [(i, n, f"N {i}", "N", i, s) for n, (i, (s, _, _)) in enumerate(people.items())]
    edges = [(k, i, r, n) for k, x in families.items() for n, (i, r) in enumerate([(x["h"], "husband"), (x["w"], "wife"), *[(c, "child") for c in x["kids"]]]) if i]
    ev = [(i, t, n, str(y), None, None) for i, (_, b, d) in people.items() for n, (t, y) in enumerate([("BIRT", b), ("DEAT", d)]) if y]
    return People(
        spark.createDataFrame(ind, "id string, ord int, name string, given string, surname string, sex string"),
        spark.createDataFrame(edges, "fam_id string, person_id string, role string, ord int"),
        spark.createDataFrame(ev, "owner string, tag string, ord int, date string, place string, address string"),
    )


def test_kinship_against_walks(spark):
    people, families = register(4)
    w, t = Walk(people, families), tables(spark, people, families)
    home = max(people, key=lambda i: (len(w.up(i)), i))
    own = w.up(home)
    got = {r.id: (r.ancestor, r.descendant, r.blood) for r in search.kinship_sets(t, home).collect()}
    below = w.reach(home, lambda i: w.kids[i])
    blood = {x for a in own for x in w.reach(a, lambda i: w.kids[i])}
    assert got == {i: (i in own and i != home, i in below and i != home, i in blood) for i in people}

    def family_steps(i):
        return [m for f in families.values() if i in (f["h"], f["w"], *f["kids"]) for m in (f["h"], f["w"], *f["kids"]) if m]

    first = [f for f in sorted(families) if home in families[f]["kids"]]
    sides = {}
    for name, slot in (("maternal", "w"), ("paternal", "h")):
        p = next((families[f][slot] for f in first if families[f][slot]), None)
        sides[name] = w.reach(p, family_steps, home) if p else {}
    far = 10**9
    want = {i: "maternal" if sides["maternal"].get(i, far) < sides["paternal"].get(i, far) else "paternal" for i in people if sides["maternal"].get(i, far) != sides["paternal"].get(i, far)}
    assert {r.id: r.side for r in search.line_sides(t, home).collect()} == want and set(want.values()) == {"maternal", "paternal"}

    labels = {r.id: (r.label, r.lineage) for r in kinship.kinship_labels(t, home).collect()}
    assert labels[home][0] == "start"
    for i in people:
        if i == home:
            continue
        other = w.up(i)
        shared = set(own) & set(other)
        if i in w.mates[home]:
            assert labels[i][0] == "spouse"
        elif shared:
            total = min(own[a] + other[a] for a in shared)
            u, d = min((own[a], other[a]) for a in shared if own[a] + other[a] == total)
            common = len(set(w.parents[i]) & set(w.parents[home]))
            expect = spark.range(1).select(kinship.relation_label(F.lit(u), F.lit(d), F.lit(people[i][0]))).first()[0]
            assert labels[i][0] == (("half-sister" if people[i][0] == "F" else "half-brother") if (u, d) == (1, 1) and common == 1 else expect), i
            assert (labels[i][1] is None) == all(own[a] == 0 for a in shared if own[a] + other[a] == total)
        else:
            step = any(i in w.mates[p] for p in w.parents[home]) or any(m in w.parents[i] for m in w.mates[home]) or any(m in w.parents[i] for p in w.parents[home] for m in w.mates[p])
            assert (i in labels) == step
    # every blood line ends in a common ancestor with none between
    pair = next((a, b) for a in people for b in people if a < b and len(set(w.up(a)) & set(w.up(b)) - {a, b}) >= 2)
    lines = kinship.blood_lines(t, *pair).collect()
    shared = set(w.up(pair[0])) & set(w.up(pair[1]))
    assert lines and all(r.path[0] == pair[0] and r.path[-1] == pair[1] and r.path[r.up] == r.ancestor and shared & set(r.path) == {r.ancestor} for r in lines)
    assert [r.up + r.down for r in lines] == sorted(r.up + r.down for r in lines)


def test_living_and_numbers(spark):
    people, families = register(9)
    w, t = Walk(people, families), tables(spark, people, families)
    vital = vitals(t.individuals, dated(t.events))
    got = {r.id: r.living for r in kinship.presumed_living(t, vital, 1990).collect()}
    for i, (_, born, died) in people.items():
        if died or born:
            assert got[i] == (not died and 1990 - born < 100)
            continue
        seen, front, best = {i}, [(i, 0)], None
        for _ in range(8):
            nxt = {}
            for kind, steps, delta in ((0, w.parents, 28), (1, w.mates, 0), (2, w.kids, -28)):
                for x, o in front:
                    for y in steps[x]:
                        if y not in seen and (y not in nxt or nxt[y][0] > kind):
                            nxt[y] = (kind, o + delta)
            front = [(y, o) for y, (_, o) in nxt.items()]
            seen |= set(nxt)
            best = max([b for y, o in front if people[y][1] and (b := people[y][1] + o)] + ([best] if best is not None else []), default=None)
        assert got[i] == (best is None or 1990 - best < 100) or best is not None
    root = max(people, key=lambda i: (len(w.reach(i, lambda x: w.kids[x])), i))
    rows = kinship.descendant_register(t, root, vital.select("id", "birth_key")).collect()
    below = w.reach(root, lambda i: w.kids[i])
    assert {r.id: r.generation for r in rows} == below
    assert sorted(r.number for r in rows) == list(range(1, len(rows) + 1))
    number = {r.id: r.number for r in rows}
    assert all(a.number < b.number for a in rows for b in rows if a.generation < b.generation)
    assert all(r.of in {number[p] for p in w.parents[r.id] if p in number} for r in rows if r.id != root)
    line = kinship.timeline(t, root, vital, 2).collect()
    assert {r.id for r in line if r.role == "descendant"} == {i for i, g in below.items() if 0 < g <= 2} and any(r.role == "self" for r in line)


def test_every_criterion(spark):
    rows = spark.createDataFrame(
        [("a", "Ana Kos", "F", 1900, 50, True, ["BIRT", "_X"], ["MARR"], True, True, False, "ana kos 1900", "ana", "kos", "bled", "see https://x", True, True, False, True, ["M1"], ["f.jpg"], True, True, True, False, True, "maternal"),
         ("b", None, "U", None, None, False, [], [], False, False, True, "", "", "", "", "", False, False, False, False, [], [], False, False, False, False, False, None)],
        "id string, name string, sex string, birth_year int, age int, deceased boolean, event_tags array<string>, family_tags array<string>, has_spouse boolean, has_child boolean, has_parent boolean, search_text string, given_text string,"
        "surname_text string, place_text string, note_text string, has_given boolean, has_surname boolean, private boolean, private_note boolean, media_xrefs array<string>, media_files array<string>, sources boolean, married_name boolean, ancestor boolean, descendant boolean, blood boolean, side string",
    )
    only_a = [
        {"kind": "name", "text": "KOS ána"}, {"kind": "name", "text": "an", "part": "given"}, {"kind": "nameField", "field": "married", "mode": "has"}, {"kind": "sex", "value": "F"}, {"kind": "birthYear", "end": 1900},
        {"kind": "age", "op": "gte", "years": 50}, {"kind": "age", "op": "lt", "years": 51}, {"kind": "living", "value": False}, {"kind": "event", "tag": "_*", "mode": "has"}, {"kind": "familyEvent", "tag": "*", "mode": "has"},
        {"kind": "place", "text": "Bled"}, {"kind": "note", "text": "https://"}, {"kind": "privateNote", "mode": "has"}, {"kind": "media", "mode": "any"}, {"kind": "media", "mode": "has", "file": "F.JPG"}, {"kind": "sources", "mode": "any"},
        {"kind": "relation", "rel": "spouse", "mode": "has"}, {"kind": "relation", "rel": "parents", "mode": "lacks"}, {"kind": "kinship", "rel": "ancestor"}, {"kind": "line", "side": "maternal"},
    ]
    for c in only_a:
        assert [r.id for r in search.batch_filter(rows, [c]).collect()] == ["a"], c
    only_b = [{"kind": "event", "tag": "BIRT", "mode": "lacks"}, {"kind": "media", "mode": "none"}, {"kind": "kinship", "rel": "notBlood"}, {"kind": "nameField", "field": "given", "mode": "lacks"}, {"kind": "living", "value": True}]
    for c in only_b:
        assert [r.id for r in search.batch_filter(rows, [c]).collect()] == ["b"], c
    assert {c["kind"] for c in only_a + only_b} | {"private"} == set(search.KINDS)
    assert search.batch_filter(rows, []).count() == 2 and search.batch_filter(rows, [{"kind": "private", "value": False}]).count() == 2
    found = search.find_in_chart(rows, "kos", rows.select("id").limit(0)).collect()
    assert [(r.id, r.on_chart) for r in found] == [("a", False)]
