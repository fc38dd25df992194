"""Living people: why a person counts as living, names that hide them, and estimates of undated births."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators.graph import closure
from kinweave.operators.people import People, latest_estimates, parent_edges

#: Years by which undated siblings are set apart, and to which estimates are rounded.
SIBLING_STEP, ROUND_TO = 2, 5


def living_reasons(people: People, vital: DataFrame, private: DataFrame | None = None, year_now: int = 2024, threshold: int = 100, recently: int = 0, unknown_living: bool = False) -> DataFrame:
    """(id, reason) of everybody who counts as living: declared private, died recently, born within ``threshold`` years, so
    estimated from a relative, or unknown if such people are to be spared."""
    estimate = latest_estimates(people.edges, vital.select("id", "birth_year")).select("id", "estimate")
    rows = vital.join(estimate, "id", "left")
    if private is not None:
        rows = rows.join(private.select("id", F.lit(True).alias("private")).distinct(), "id", "left")
    else:
        rows = rows.withColumn("private", F.lit(False))
    reason = (
        F.when(F.coalesce("private", F.lit(False)), "declared")
        .when(F.col("deceased"), F.when((F.lit(recently) > 0) & (F.lit(year_now) - F.col("death_year") <= recently), "recentDeath"))
        .when(F.col("birth_year").isNotNull(), F.when(F.lit(year_now) - F.col("birth_year") < threshold, "birth"))
        .when(F.col("estimate").isNotNull(), F.when(F.lit(year_now) - F.col("estimate") < threshold, "relative"))
        .when(F.lit(unknown_living), "unknown")
    )
    return rows.select("id", reason.alias("reason")).filter("reason is not null")


def hidden_name(given: Column, surname: Column, strategy: str, custom: str = "") -> Column:
    """A name that hides a person: living, private, surnameOnly, initials or initialSurname."""

    def initial(c: Column) -> Column:
        return F.upper(F.substring(F.trim(F.coalesce(c, F.lit(""))), 1, 1))

    g, s = initial(given), initial(surname)
    has = F.coalesce(surname, F.lit("")) != ""
    slashed = F.concat(F.lit("/"), surname, F.lit("/"))
    if strategy == "living":
        return F.lit("Living")
    if strategy == "private":
        return F.lit(custom.strip() or "Private")
    if strategy == "surnameOnly":
        return F.when(has, slashed).otherwise("Private")
    dotted = [F.when(i != "", F.concat(i, F.lit("."))).otherwise("") for i in (g, s)]
    if strategy == "initials":
        return F.coalesce(F.nullif(F.concat(*dotted), F.lit("")), F.lit("Private"))
    if strategy == "initialSurname":
        return F.when(has & (g != ""), F.concat(dotted[0], F.lit(" "), slashed)).when(has, slashed).when(g != "", dotted[0]).otherwise("Private")
    raise ValueError(f"unknown strategy {strategy}")


def with_descendants(people: People, ids: DataFrame) -> DataFrame:
    """(id): the people and all who descend from them."""
    down = parent_edges(people.edges).select(F.col("parent").alias("child"), F.col("child").alias("parent")).distinct()
    return closure(down, ids.select(F.col("id").alias("node"))).select(F.col("node").alias("id")).distinct()


def without_people(people: People, gone: DataFrame) -> People:
    """The data set without some people: their records, events and pointers, and families that nobody is left in."""
    ind = people.individuals.join(gone.select("id"), "id", "left_anti")
    edges = people.edges.join(gone.select(F.col("id").alias("person_id")), "person_id", "left_anti")
    families = edges.select("fam_id").distinct()
    owners = ind.select(F.col("id").alias("owner")).union(families.select("fam_id"))
    return People(ind, edges, people.events.join(owners, "owner", "left_semi"), people.sparse_births, families)


def sibling_estimates(people: People, vital: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, year): estimated births of undated people (column id), from relatives; undated siblings are set apart.

    An estimate from spouse or children is rounded to five years. Children dated by a parent follow their nearest dated
    sibling in the family's order, two years a place, or else spread around the common estimate, always
    increasing in the family's order. A family is one group, a handful of rows.
    """
    years = vital.select("id", "birth_year")
    # any birth or baptism date, even one that cannot be read, is the researcher's
    undated = wanted.select("id").distinct().join(vital.filter("birth_year is null"), "id", "left_semi")
    written = people.events.filter("tag in ('BIRT', 'BAPM', 'CHR') and trim(coalesce(date, '')) != ''").select(F.col("owner").alias("id"))
    undated = undated.join(written, "id", "left_anti")
    best = latest_estimates(people.edges, years)
    rounded = (F.floor(F.col("estimate") / ROUND_TO + 0.5) * ROUND_TO).cast("int")
    own = undated.join(best, "id", "left").withColumn("year", rounded)
    alone = own.filter("relation is not null and relation not in ('father', 'mother')").select("id", "year")
    group = own.filter("relation is null or relation in ('father', 'mother')").select("id", "year", "relative")
    kids = people.edges.filter("role = 'child'").select("fam_id", F.col("person_id").alias("id"), "ord").distinct()
    spouses = people.edges.filter("role != 'child'").select("fam_id", F.col("person_id").alias("relative"))
    # the family of the parent who gave the estimate, or, without one, a family with a dated sibling
    by_parent = group.filter("relative is not null").join(kids, "id").join(spouses, ["fam_id", "relative"]).groupBy("id").agg(F.min("fam_id").alias("fam_id"))
    dated = kids.join(years.filter("birth_year is not null"), "id").select("fam_id").distinct()
    by_sibling = group.filter("relative is null").join(kids, "id").join(dated, "fam_id", "left_semi").groupBy("id").agg(F.min("fam_id").alias("fam_id"))
    member = by_parent.unionByName(by_sibling).join(group.select("id", "year"), "id").select("fam_id", "id", "year", F.lit(True).alias("wanted"))
    rows = kids.join(member.select("fam_id").distinct(), "fam_id", "left_semi").join(member, ["fam_id", "id"], "left").join(years, "id", "left").select("fam_id", "id", "ord", "year", F.coalesce("wanted", F.lit(False)).alias("wanted"), "birth_year")

    def spread(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ord", "id"]).reset_index(drop=True)
        anchors = [(i, int(y)) for i, y in enumerate(frame.birth_year) if pd.notna(y)]
        places = [i for i, w in enumerate(frame.wanted) if w]
        if anchors:
            got = [(lambda a: a[1] + SIBLING_STEP * (i - a[0]))(min(anchors, key=lambda a, i=i: abs(a[0] - i))) for i in places]
        else:
            first = int(frame.year[places[0]])
            start = first - SIBLING_STEP * ((len(places) - 1) // 2) if len(places) > 1 else first
            got = [start + SIBLING_STEP * k for k in range(len(places))]
        for k in range(1, len(got)):
            if got[k] <= got[k - 1]:
                got[k] = got[k - 1] + SIBLING_STEP
        return pd.DataFrame({"id": frame.id[places].tolist(), "year": got})

    kind = people.individuals.schema["id"].dataType.simpleString()
    return alone.unionByName(rows.groupBy("fam_id").applyInPandas(spread, f"id {kind}, year int"))
