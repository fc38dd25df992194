"""Finding people: rows for search and batch filters, and the criteria over them.

``person_rows`` makes one wide row per person; criteria and facets are column predicates over it,
folded with ``and``. A person without the year or age that a criterion asks for does not pass it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.dates import lifespan
from kinweave.functions.text import fold, fold_text
from kinweave.operators.graph import bfs_distance, closure
from kinweave.operators.people import People, couples, dated, parent_edges, relatives, vitals

#: Search results at most, the tags for any vendor event and for any event at all.
MAX_HITS, ANY_VENDOR, ANY_EVENT = 50, "_*", "*"
KINDS = (
    "name", "nameField", "sex", "birthYear", "age", "living", "event", "familyEvent", "place", "note", "private", "privateNote", "media", "sources", "relation", "kinship", "line",
)


def person_rows(people: People, facts: DataFrame | None = None, year_now: int = 2024, today: tuple[int, int, int] | None = None) -> DataFrame:
    """One row per person. ``facts`` (id, notes, private, private_note, media_xrefs, media_files, sources, links, married_name)
    adds what the file says beside names, events and families; absent facts are empty."""
    ind, events = people.individuals, dated(people.events, year_now)
    vital = vitals(ind, events)
    per = events.groupBy(F.col("owner").alias("id")).agg(F.collect_set("tag").alias("event_tags"), F.concat_ws(" ", F.collect_list("place"), F.collect_list("address")).alias("places"))
    pairs = couples(people.edges)
    spouse_of = people.edges.filter("role != 'child'").select("fam_id", F.col("person_id").alias("id")).distinct()
    union_tags = spouse_of.join(events.select(F.col("owner").alias("fam_id"), "tag"), "fam_id").groupBy("id").agg(F.collect_set("tag").alias("family_tags"))
    rel = relatives(people.edges).groupBy(F.col("person").alias("id")).agg(*[F.max(F.col("rel") == r).alias(f"has_{r}") for r in ("spouse", "child", "parent")])
    out = ind.select("id", "name", "given", "surname", F.coalesce("sex", F.lit("U")).alias("sex"))
    for more in (vital, per, union_tags, rel):
        out = out.join(more, "id", "left")
    y, m, d = today or (year_now, 1, 1)
    until = [F.when(F.col("deceased"), F.col(f"death.{p}")).otherwise(F.lit(v)) for p, v in (("year", y), ("month", m), ("day", d))]
    early = [F.col(f"birth.{p}") for p in ("year", "month", "day")]
    before = (early[1].isNotNull() & until[1].isNotNull()) & ((until[1] < early[1]) | ((until[1] == early[1]) & F.coalesce(until[2] < early[2], F.lit(False))))
    age = F.when(early[0].isNotNull() & until[0].isNotNull(), F.greatest(F.lit(0), until[0] - early[0] - F.when(before, 1).otherwise(0)))
    span = lifespan(F.col("birth_year"), F.col("death_year"), F.col("deceased"))
    strings, none = F.array().cast("array<string>"), F.lit(None).cast("string")
    fact = {"notes": none, "private": F.lit(False), "private_note": F.lit(False), "media_xrefs": strings, "media_files": strings, "sources": F.lit(False), "links": F.lit(False), "married_name": F.lit(False)}
    if facts is not None:
        out = out.join(facts.select("id", *[F.coalesce(c, v).alias(c) for c, v in fact.items() if c in facts.columns]), "id", "left")
    for c, v in fact.items():
        out = out.withColumn(c, F.coalesce(c, v) if c in out.columns else v)
    for c in ("event_tags", "family_tags"):
        out = out.withColumn(c, F.coalesce(c, strings))
    for r in ("spouse", "child", "parent"):
        out = out.withColumn(f"has_{r}", F.coalesce(f"has_{r}", F.lit(False)))
    return out.select(
        "id", "name", "sex", span.alias("span"), "birth_year", "birth_key", "death_year", "deceased", age.cast("int").alias("age"), "event_tags", "family_tags", "has_spouse", "has_child", "has_parent",
        fold(F.concat_ws(" ", "name", F.nullif(span, F.lit("")))).alias("search_text"), fold(F.coalesce("given", F.lit(""))).alias("given_text"), fold(F.coalesce("surname", F.lit(""))).alias("surname_text"),
        fold(F.coalesce("places", F.lit(""))).alias("place_text"), fold(F.coalesce("notes", F.lit(""))).alias("note_text"), (F.trim(F.coalesce("notes", F.lit(""))) != "").alias("has_notes"),
        (F.trim(F.coalesce("given", F.lit(""))) != "").alias("has_given"), (F.trim(F.coalesce("surname", F.lit(""))) != "").alias("has_surname"),
        "private", "private_note", "media_xrefs", F.transform("media_files", F.lower).alias("media_files"), "sources", "links", "married_name",
    )


def contains_terms(text: Column, query: str) -> Column:
    """Every word of the folded query stands in the text, in any order."""
    return reduce(lambda a, b: a & b, [F.contains(text, F.lit(t)) for t in fold_text(query).split()], F.lit(True))


def kinship_sets(people: People, start: str) -> DataFrame:
    """(id, ancestor, descendant, blood): ancestors of a person, descendants, and all who descend from an ancestor or the person."""
    up = parent_edges(people.edges).select("child", "parent").distinct()
    down = up.select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    one = people.individuals.filter(F.col("id") == start).select(F.col("id").alias("node"))
    above = closure(up, one).filter("generation > 0").select("node").distinct()
    below = closure(down, one).filter("generation > 0").select("node").distinct()
    # one walk down from all of them together
    seeds = above.union(one).distinct()
    blood = bfs_distance(up.select(F.col("parent").alias("src"), F.col("child").alias("dst")), seeds).select("node")
    flags = [(above, "ancestor"), (below, "descendant"), (blood, "blood")]
    out = people.individuals.select("id")
    for nodes, name in flags:
        out = out.join(nodes.select(F.col("node").alias("id"), F.lit(True).alias(name)), "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def line_sides(people: People, home: str) -> DataFrame:
    """(id, side): maternal or paternal, by the parent who reaches a person strictly sooner without passing home.

    Here siblings are one step apart, as all members of a family are. Who is reached equally soon, or only through
    home, is on neither side.
    """
    member = people.edges.filter("person_id is not null").filter(F.col("person_id") != home).select("fam_id", F.col("person_id").alias("src"), "role")
    other = member.select("fam_id", F.col("src").alias("dst"), F.col("role").alias("role_d"))
    steps = member.join(other, "fam_id").filter("src != dst").select("src", "dst").distinct()
    parents = parent_edges(people.edges).filter(F.col("child") == home)
    reach = []
    for role, name in (("mother", "m"), ("father", "f")):
        first = parents.filter(F.col("role") == role).agg(F.min_by("parent", "fam_id").alias("node")).filter("node is not null")
        reach.append(bfs_distance(steps, first).withColumnRenamed("distance", name))
    both = reach[0].join(reach[1], "node", "full_outer")
    side = F.when(F.col("m").isNotNull() & (F.col("f").isNull() | (F.col("m") < F.col("f"))), "maternal").when(F.col("f").isNotNull() & (F.col("m").isNull() | (F.col("f") < F.col("m"))), "paternal")
    return both.select(F.col("node").alias("id"), side.alias("side")).filter("side is not null")


def criterion(kind: str, **c) -> Column:
    """A predicate over person rows; kinship and line need the columns of ``kinship_sets`` and ``line_sides``."""

    def has(present: Column) -> Column:
        return present if c.get("mode", "has") == "has" else ~present

    if kind == "name":
        return contains_terms(F.col({"given": "given_text", "surname": "surname_text"}.get(c.get("part"), "search_text")), c["text"])
    if kind == "nameField":
        return has(F.col({"given": "has_given", "surname": "has_surname", "married": "married_name"}[c["field"]]))
    if kind == "sex":
        return F.col("sex") == c["value"]
    if kind == "birthYear":
        return F.col("birth_year").isNotNull() & (F.col("birth_year") >= c.get("start", -(10**9))) & (F.col("birth_year") <= c.get("end", 10**9))
    if kind == "age":
        return F.col("age") < c["years"] if c["op"] == "lt" else F.col("age") >= c["years"]
    if kind == "living":
        return F.col("deceased") != F.lit(c["value"])
    if kind == "event":
        return has(F.exists("event_tags", lambda t: t.startswith("_")) if c["tag"] == ANY_VENDOR else F.array_contains("event_tags", c["tag"]))
    if kind == "familyEvent":
        return has(F.size("family_tags") > 0 if c["tag"] == ANY_EVENT else F.array_contains("family_tags", c["tag"]))
    if kind == "relation":
        return has(F.col({"spouse": "has_spouse", "children": "has_child", "parents": "has_parent"}[c["rel"]]))
    if kind == "kinship":
        return ~F.col("blood") if c["rel"] == "notBlood" else F.col(c["rel"])
    if kind == "line":
        return F.col("side") == c["side"]
    if kind in ("place", "note"):
        return F.contains(F.col(f"{kind}_text"), F.lit(fold_text(c["text"])))
    if kind == "private":
        return F.col("private") == F.lit(c["value"])
    if kind == "privateNote":
        return has(F.col("private_note"))
    if kind == "sources":
        return F.col("sources") == F.lit(c["mode"] == "any")
    if kind == "media":
        some = (F.size("media_xrefs") > 0) | (F.size("media_files") > 0)
        if c["mode"] in ("none", "any"):
            return some if c["mode"] == "any" else ~some
        return has(F.array_contains("media_xrefs", c.get("xref") or "") | F.array_contains("media_files", (c.get("file") or "").lower()))
    raise ValueError(f"unknown criterion {kind}")


def batch_filter(rows: DataFrame, criteria: Sequence[dict]) -> DataFrame:
    """Rows that pass every criterion, each {"kind": ..., ...}; none given, all pass; unknown values fail."""
    keep = reduce(lambda a, b: a & b, [F.coalesce(criterion(**c), F.lit(False)) for c in criteria], F.lit(True))
    return rows.filter(keep)


def search_people(
    rows: DataFrame, query: str = "", sex: str | None = None, born_from: int | None = None, born_to: int | None = None, place: str = "", links: bool = False, notes: bool = False,
    sources: bool = False, edited: bool = False, decision: str | None = None, max_kinship: int | None = None, limit: int | None = MAX_HITS,
) -> DataFrame:
    """The first ``limit`` people (of all, if None) by name, birth, death and id that hold every word of the query and
    every facet. edited, decision and hops are columns of the rows where these facets are used."""
    keep = contains_terms(F.col("search_text"), query)
    if sex is not None:
        keep &= F.col("sex") == sex
    if born_from is not None:
        keep &= F.col("birth_year") >= born_from
    if born_to is not None:
        keep &= F.col("birth_year") <= born_to
    if place.strip():
        keep &= F.contains(F.col("place_text"), F.lit(fold_text(place)))
    for wanted, column in ((links, "links"), (notes, "has_notes"), (sources, "sources"), (edited, "edited")):
        if wanted:
            keep &= F.col(column)
    if decision is not None:
        keep &= F.col("decision") == decision
    if max_kinship is not None:
        keep &= F.col("hops") <= max_kinship
    death = F.coalesce(F.col("death_year").cast("double"), F.lit(float("inf")))
    found = rows.filter(F.coalesce(keep, F.lit(False))).orderBy("name", "birth_key", death, "id")
    return found if limit is None else found.limit(limit)


def find_in_chart(entries: DataFrame, query: str, drawn: DataFrame) -> DataFrame:
    """(id, on_chart): people whose text holds the query's words, those drawn on the chart first, then by name."""
    hits = entries.filter(contains_terms(F.col("search_text"), query)) if query.strip() else entries.limit(0)
    marked = hits.join(drawn.select("id", F.lit(True).alias("on_chart")).distinct(), "id", "left").withColumn("on_chart", F.coalesce("on_chart", F.lit(False)))
    return marked.orderBy(F.desc("on_chart"), "name", "id").select("id", "name", "on_chart")
