"""People as wide rows: names, vital dates, relatives and estimates in one row per person.

``People`` bundles the tables of a data set (see ``kinweave.sources.gedcom``): individuals (id, ord,
name, given, surname, sex, uids, fsids), edges (fam_id, person_id, role, ord) and events (owner, tag, ord,
date, place, address). All joins are equi-joins on person and family ids; lists hold one person's relatives.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kinweave.functions.dates import DATE_TYPE, birth_sort_key, parse_date
from kinweave.functions.text import fold, is_placeholder, soundex_key
from kinweave.operators.linkage import block_keys

#: Events that date a birth and a death, in order of preference.
BIRTH_TAGS, DEATH_TAGS = ("BIRT", "BAPM", "CHR"), ("DEAT", "BURI", "CREM")
#: Years between a parent's and a child's birth for estimates.
AT_CHILDBIRTH = {"F": 27, "M": 38}
AT_CHILDBIRTH_ELSE, AT_PARENTHOOD, GENERATION = 32, 29, 28


@dataclass(frozen=True)
class People:
    """The tables of one data set; ``sparse_births``: its format has no birth dates to speak of."""

    individuals: DataFrame
    edges: DataFrame
    events: DataFrame
    sparse_births: bool = False
    #: (fam_id) of all family records, those without members too; taken from the edges if not given
    families: DataFrame | None = None


def dated(events: DataFrame, year_now: int = 2024, raw: str = "date") -> DataFrame:
    """``events`` with the parsed date ``d``; each distinct phrase is parsed once."""
    phrases = events.select(F.col(raw).alias("__raw")).filter("__raw is not null").distinct()
    parsed = phrases.withColumn("d", parse_date(year_now)("__raw"))
    return events.join(parsed, F.col(raw) == F.col("__raw"), "left").drop("__raw")


def first_of(tag: str, value: Column, order: str = "ord") -> Column:
    """Aggregate: ``value`` of the first event of a tag."""
    return F.min_by(F.when(F.col("tag") == tag, value), F.when(F.col("tag") == tag, F.col(order)))


def vitals(individuals: DataFrame, events: DataFrame) -> DataFrame:
    """(id, birt, birt_place, birt_address, deat, deat_place, birth, birth_year, birth_key, death, death_year, deceased, resi_year).

    ``events`` is dated. birt and deat are the first events of that tag; birth and death fall back to
    baptism and burial, tag by tag, where the first such event has a year.
    """
    wanted = events.filter(F.col("tag").isin(*BIRTH_TAGS, *DEATH_TAGS, "RESI", "MARR"))
    date = {t: first_of(t, F.struct(F.col("d").alias("d")))["d"] for t in (*BIRTH_TAGS, *DEATH_TAGS)}

    def best(tags: tuple[str, ...]) -> Column:
        return F.coalesce(*[F.when(date[t]["year"].isNotNull(), date[t]) for t in tags])

    whole = F.struct("d", "place", "address")
    by_owner = wanted.groupBy(F.col("owner").alias("id")).agg(
        first_of("BIRT", whole).alias("b"), first_of("DEAT", whole).alias("x"), best(BIRTH_TAGS).alias("birth"), best(DEATH_TAGS).alias("death"),
        F.max(F.col("tag").isin(*DEATH_TAGS)).alias("deceased"),
        F.min_by(F.when(F.col("tag").isin("RESI", "MARR"), F.struct(F.col("d.year").alias("y"))), F.when(F.col("tag").isin("RESI", "MARR"), F.col("ord")))["y"].alias("resi_year"),
    )
    out = individuals.select("id").join(by_owner, "id", "left")
    return out.select(
        "id", F.col("b.d").alias("birt"), F.col("b.place").alias("birt_place"), F.col("b.address").alias("birt_address"), F.col("x.d").alias("deat"), F.col("x.place").alias("deat_place"),
        "birth", F.col("birth.year").alias("birth_year"), birth_sort_key(F.col("birth")).alias("birth_key"), "death", F.col("death.year").alias("death_year"),
        F.coalesce("deceased", F.lit(False)).alias("deceased"), "resi_year",
    )


def couples(edges: DataFrame) -> DataFrame:
    """(fam_id, husband, wife): the last named in each slot, as a record can hold only one."""
    slot = {r: F.max_by(F.when(F.col("role") == r, F.col("person_id")), F.when(F.col("role") == r, F.col("ord"))) for r in ("husband", "wife")}
    return edges.groupBy("fam_id").agg(slot["husband"].alias("husband"), slot["wife"].alias("wife"))


def parent_edges(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(child, parent, role, fam_id, ord): father and mother of every child, of ``known`` (id) people only if given."""
    pairs = couples(edges)
    kids = edges.filter("role = 'child'").select("fam_id", F.col("person_id").alias("child"), "ord")
    both = kids.join(pairs, "fam_id")
    out = both.select("child", F.explode(F.array(F.struct(F.col("husband").alias("parent"), F.lit("father").alias("role")), F.struct(F.col("wife").alias("parent"), F.lit("mother").alias("role")))).alias("p"), "fam_id", "ord")
    out = out.select("child", "p.parent", "p.role", "fam_id", "ord").filter("parent is not null")
    return out if known is None else out.join(known.select(F.col("id").alias("parent")), "parent", "left_semi").join(known.select(F.col("id").alias("child")), "child", "left_semi")


def relatives(edges: DataFrame) -> DataFrame:
    """(person, relative, rel, fam_id, ord): parents, spouses and children; siblings are children of the parents."""
    up = parent_edges(edges)
    pairs = couples(edges)
    spouses = pairs.filter("husband is not null and wife is not null and husband != wife")
    return (
        up.select(F.col("child").alias("person"), F.col("parent").alias("relative"), F.lit("parent").alias("rel"), "fam_id", F.when(F.col("role") == "father", 0).otherwise(1).alias("ord"))
        .unionByName(up.select(F.col("parent").alias("person"), F.col("child").alias("relative"), F.lit("child").alias("rel"), "fam_id", "ord"))
        .unionByName(spouses.select(F.col("husband").alias("person"), F.col("wife").alias("relative"), F.lit("spouse").alias("rel"), "fam_id", F.lit(0).alias("ord")))
        .unionByName(spouses.select(F.col("wife").alias("person"), F.col("husband").alias("relative"), F.lit("spouse").alias("rel"), "fam_id", F.lit(0).alias("ord")))
    )


def relationship_counts(edges: DataFrame) -> DataFrame:
    """(id, n): distinct linked relatives."""
    return relatives(edges).filter("person != relative").groupBy(F.col("person").alias("id")).agg(F.countDistinct("relative").alias("n"))


def birth_estimates(individuals: DataFrame, edges: DataFrame, years: DataFrame) -> DataFrame:
    """(id, estimate): upper median of the partners' birth years, the oldest child's less a childbirth age by sex,
    and the parents' plus an age of parenthood; recorded years only. years: id, birth_year."""
    found = relatives(edges).join(years.select(F.col("id").alias("relative"), "birth_year").filter("birth_year is not null"), "relative").join(individuals.select(F.col("id").alias("person"), "sex"), "person")
    at_birth = F.when(F.col("sex") == "F", AT_CHILDBIRTH["F"]).when(F.col("sex") == "M", AT_CHILDBIRTH["M"]).otherwise(AT_CHILDBIRTH_ELSE)
    others = F.collect_list(F.when(F.col("rel") == "spouse", F.col("birth_year")).when(F.col("rel") == "parent", F.col("birth_year") + AT_PARENTHOOD))
    oldest = F.min(F.when(F.col("rel") == "child", F.col("birth_year") - at_birth))
    lists = found.groupBy("person").agg(others.alias("o"), oldest.alias("c"))
    values = F.sort_array(F.when(F.col("c").isNotNull(), F.concat("o", F.array("c"))).otherwise(F.col("o")))
    return lists.select(F.col("person").alias("id"), F.get(values, F.floor(F.size(values) / 2).cast("int")).cast("int").alias("estimate"))


def latest_estimates(edges: DataFrame, years: DataFrame) -> DataFrame:
    """(id, estimate, relation, relative): the latest birth that an immediate relative allows, the first of equal ones."""
    shift = F.when(F.col("rel") == "parent", GENERATION).when(F.col("rel") == "child", -GENERATION).otherwise(0)
    found = relatives(edges).join(years.select(F.col("id").alias("relative"), "birth_year").filter("birth_year is not null"), "relative")
    found = found.withColumn("estimate", (F.col("birth_year") + shift).cast("int"))
    # parents are looked at before spouses and children of a family
    rank = F.struct(F.when(F.col("rel") == "parent", 0).otherwise(1), "fam_id", F.when(F.col("rel") == "spouse", -1).otherwise(F.col("ord")))
    first = Window.partitionBy("person").orderBy(F.desc("estimate"), rank)
    relation = F.when((F.col("rel") == "parent") & (F.col("ord") == 0), "father").when(F.col("rel") == "parent", "mother").otherwise(F.col("rel"))
    return found.withColumn("k", F.row_number().over(first)).filter("k = 1").select(F.col("person").alias("id"), "estimate", relation.alias("relation"), "relative")


def profiles(people: People, year_now: int = 2024) -> DataFrame:
    """One row per person with all that pairs are gated and scored by; names are arrays [given, surname, full]."""
    ind, edges = people.individuals, people.edges
    events = dated(people.events, year_now)
    vital = vitals(ind, events)
    name = F.array("given", "surname", "name")
    who = ind.select("id", name.alias("name"))
    named = who.select(F.col("id").alias("relative"), F.col("name").alias("rel_name"))
    rel = relatives(edges).join(named, "relative")

    def listed(kind: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("rel") == kind, F.struct("fam_id", "ord", F.col("rel_name").alias("n"))))), lambda x: x["n"])

    def parent(k: int) -> Column:
        is_it = (F.col("rel") == "parent") & (F.col("ord") == k)
        return F.min_by(F.when(is_it, F.col("rel_name")), F.when(is_it, F.col("fam_id")))

    lists = rel.groupBy(F.col("person").alias("id")).agg(
        parent(0).alias("father"), parent(1).alias("mother"), listed("spouse").alias("partners"), listed("child").alias("children"),
    )
    first = events.filter("tag = 'MARR'").groupBy(F.col("owner").alias("fam_id")).agg(F.min_by(F.struct("d", "place"), "ord").alias("m"))
    spouse_of = edges.filter("role != 'child'").select("fam_id", F.col("person_id").alias("id")).distinct()
    weddings = spouse_of.join(first, "fam_id").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("fam_id", "m"))), lambda x: x["m"]).alias("marriages"))
    estimates = birth_estimates(ind, edges, vital)
    kept = [c for c in ("uids", "fsids", "ord") if c in ind.columns]
    out = ind.select("id", *kept, F.coalesce("sex", F.lit("U")).alias("sex"), name.alias("name"), fold("given").alias("f_given"), fold("surname").alias("f_surname"))
    for more in (vital, lists, weddings, estimates):
        out = out.join(more, "id", "left")
    for c in ("partners", "children"):
        out = out.withColumn(c, F.coalesce(c, F.array().cast("array<array<string>>")))
    out = out.withColumn("marriages", F.coalesce("marriages", F.array().cast(f"array<struct<d:{DATE_TYPE},place:string>>")))
    # a marriage stands among a person's own events only in odd files; a residence dates people who have nothing else
    wed = F.filter(F.transform("marriages", lambda m: m["d"]["year"]), lambda y: y.isNotNull())
    return out.withColumns(
        {
            "era": F.coalesce("birth_year", "estimate", "death_year", "resi_year"),
            "first_wedding": F.get(wed, F.lit(0)),
            "last_wedding": F.array_max(wed),
            "sparse": F.lit(people.sparse_births),
            "keys": _keys(),
        }
    )


def _keys() -> Column:
    """Block keys: the sound of the surname (else of the given name) with the decades around the birth, one either
    side of a recorded one and two of an estimate; without a year the sound alone; and the sound with the initial."""
    given = F.when(~is_placeholder(F.coalesce("f_given", F.lit(""))), F.col("f_given"))
    surname = F.when(~is_placeholder(F.coalesce("f_surname", F.lit(""))), F.col("f_surname"))
    code = soundex_key(F.coalesce(surname, given, F.lit("")))
    year = F.coalesce(F.col("birt.year"), F.col("estimate"))
    near, wide = block_keys(code, F.coalesce(given, F.lit("")), year, 1), block_keys(code, F.coalesce(given, F.lit("")), year, 2)
    return F.when(F.col("birt.year").isNotNull(), near).otherwise(wide)
