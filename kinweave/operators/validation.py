"""Health check of people and families: one query per rule, all findings in one table.

Every rule is an anti-join, a join of relatives with their years, or an aggregate; nothing is looked up
row by row. Loops and islands are graph operators. A finding is (scope, id, category, severity, detail, n);
``n`` tells how often the same finding stands on one record.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kinweave.operators.graph import cycle_members, islands
from kinweave.operators.people import DEATH_TAGS, People, couples, dated, vitals
from kinweave.session import materialize

#: Plausible ages and gaps in years, months between two births, the size up to which a group is an island.
MARRIAGE_AGE, OLDEST, FATHER_AGE, MOTHER_AGE, SPOUSE_GAP, BIRTH_MONTHS, ISLAND = (12, 90), 99, (14, 80), (14, 50), 32, 9, 9
BIOLOGICAL = ("birth", "natural", "")
ERRORS = ("brokenLink", "pedigreeLoop", "roleSexConflict", "deathBeforeBirth", "futureDate")
CATEGORIES = (
    "brokenLink", "duplicatePointer", "pedigreeLoop", "roleSexConflict", "multiSpouseSlot", "multipleParents", "parentlessFamily", "missingSex", "missingName", "missingVitals", "island",
    "orphan", "deathBeforeBirth", "eventOrder", "ageAtDeath", "livingTooOld", "ageAtMarriage", "parentAge", "bornAfterParentDeath", "parallelFamilies", "spouseAgeGap", "futureDate",
)


def _found(rows: DataFrame, category: str, detail: Column, id_col: str = "id", scope: str = "individual") -> DataFrame:
    severity = "error" if category in ERRORS else "warning"
    return rows.groupBy(F.col(id_col).alias("id"), detail.cast("string").alias("detail")).agg(F.count("*").alias("n")).select(
        F.lit(scope).alias("scope"), "id", F.lit(category).alias("category"), F.lit(severity).alias("severity"), "detail", "n"
    )


def birth_links(links: DataFrame, adoptions: DataFrame | None = None) -> DataFrame:
    """FAMC links that say birth or nothing, less those to a family that an adoption event names."""
    born = links.filter("tag = 'FAMC'").filter(F.col("pedi").isNull() | F.lower(F.trim("pedi")).isin(*BIOLOGICAL))
    return born if adoptions is None else born.join(adoptions.select("person_id", "fam_id"), ["person_id", "fam_id"], "left_anti")


def parallel_runs(pairs: DataFrame, children: DataFrame) -> DataFrame:
    """(mother, partner_a, partner_b): a child by b was born well within the run of children by a.

    pairs: fam_id, husband, wife; children: fam_id, month (of birth, counted in months). Runs of one couple's
    several family records are kept apart, as the records are.
    """
    runs = children.groupBy("fam_id").agg(F.min("month").alias("lo"), F.max("month").alias("hi")).join(pairs.filter("husband is not null and wife is not null"), "fam_id")
    a = runs.filter(F.col("hi") - F.col("lo") >= 2 * BIRTH_MONTHS).select(F.col("fam_id").alias("fa"), F.col("wife").alias("mother"), F.col("husband").alias("partner_a"), "lo", "hi")
    b = pairs.filter("husband is not null and wife is not null").select(F.col("fam_id").alias("fb"), F.col("wife").alias("mother"), F.col("husband").alias("partner_b"))
    met = a.join(b, "mother").filter("fa != fb and partner_a != partner_b").join(children.select(F.col("fam_id").alias("fb"), "month"), "fb")
    inside = met.filter(F.col("month").between(F.col("lo") + BIRTH_MONTHS, F.col("hi") - BIRTH_MONTHS))
    # of two families that bracket each other the first is reported
    ends = [F.least("fa", "fb").alias("f1"), F.greatest("fa", "fb").alias("f2")]
    one = inside.groupBy("mother", *ends).agg(F.min(F.struct((F.col("fa") != F.least("fa", "fb")).alias("k"), "partner_a", "partner_b")).alias("m"))
    return one.select("mother", "m.partner_a", "m.partner_b")


def validate(people: People, links: DataFrame, adoptions: DataFrame | None = None, year_now: int = 2024) -> DataFrame:
    """All findings of the 22 rules. links: person_id, fam_id, tag (FAMC or FAMS), ord, pedi, as the person's record has them."""
    ind, edges, events = people.individuals, people.edges, dated(people.events, year_now)
    vital = materialize(vitals(ind, events).join(ind.select("id", F.coalesce("sex", F.lit("U")).alias("sex"), "name"), "id"))
    ids = ind.select("id").distinct()
    families = edges.select("fam_id").union(people.families.select("fam_id") if people.families is not None else edges.select("fam_id").limit(0)).distinct()
    pairs = materialize(families.join(couples(edges), "fam_id", "left"))
    born_to = birth_links(links, adoptions)
    out = [
        _found(vital.filter("name is null or trim(name) = ''"), "missingName", F.lit("")),
        _found(vital.filter("sex = 'U'"), "missingSex", F.lit("")),
        _found(vital.filter("birth_year is null and death_year is null"), "missingVitals", F.lit("")),
        _found(vital.filter("death_year < birth_year"), "deathBeforeBirth", F.col("death_year")),
        _found(vital.filter(f"death_year - birth_year > {OLDEST}"), "ageAtDeath", F.expr("death_year - birth_year")),
        _found(vital.filter(f"not deceased and (death_year is null) and {year_now} - birth_year > {OLDEST}"), "livingTooOld", F.expr(f"{year_now} - birth_year")),
    ]
    # events outside the lifespan, and family events after the death
    own = events.select(F.col("owner").alias("id"), "tag", F.col("d.year").alias("year"), F.col("d.year2").alias("year2")).join(vital, "id")
    late = F.col("tag").isin(*DEATH_TAGS)
    early = (F.col("year") < F.col("birth_year")) & ~(late & F.coalesce(F.col("year") == F.col("death_year"), F.lit(False)))
    after = ~F.coalesce(early, F.lit(False)) & (F.col("year") > F.col("death_year")) & ~late & (F.col("tag") != "PROB")
    spouse_of = links.filter("tag = 'FAMS'").select(F.col("person_id").alias("id"), "fam_id").distinct()
    unions = events.select(F.col("owner").alias("fam_id"), "tag", F.col("d.year").alias("year")).join(spouse_of, "fam_id").join(vital.select("id", "death_year"), "id")
    out += [
        _found(own.filter(early), "eventOrder", F.concat("tag", F.lit(" before birth"))),
        _found(own.filter(after), "eventOrder", F.concat("tag", F.lit(" after death"))),
        _found(unions.filter("year > death_year"), "eventOrder", F.concat("tag", F.lit(" after death"))),
        _found(own.groupBy("id").agg(F.max(F.greatest("year", "year2")).alias("y")).filter(F.col("y") > year_now), "futureDate", F.col("y")),
        _found(ids.join(links.select(F.col("person_id").alias("id")), "id", "left_anti"), "orphan", F.lit("")),
    ]
    known_links = links.join(ids.select(F.col("id").alias("person_id")), "person_id", "left_semi")
    up = known_links.filter("tag = 'FAMC'").join(pairs, "fam_id").select(F.col("person_id").alias("src"), F.explode(F.array("husband", "wife")).alias("dst")).filter("dst is not null")
    up = up.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    out.append(_found(cycle_members(up.select("src", "dst")), "pedigreeLoop", F.lit(""), "node"))
    # pointers of persons to families that are not there or do not point back
    members = edges.select("fam_id", "person_id", F.when(F.col("role") == "child", "FAMC").otherwise("FAMS").alias("tag")).distinct()
    spouses = pairs.select("fam_id", F.explode(F.array("husband", "wife")).alias("person_id")).filter("person_id is not null").withColumn("tag", F.lit("FAMS"))
    mutual = members.filter("tag = 'FAMC'").unionByName(spouses)
    gone = known_links.join(families, "fam_id", "left_anti")
    one_way = known_links.join(families, "fam_id", "left_semi").join(mutual, ["fam_id", "person_id", "tag"], "left_anti")
    out += [
        _found(gone, "brokenLink", F.concat("tag", F.lit(" missing "), "fam_id"), "person_id"),
        _found(one_way, "brokenLink", F.concat("tag", F.lit(" one way "), "fam_id"), "person_id"),
        _found(known_links.groupBy("person_id", "fam_id", "tag").agg(F.count("*").alias("k")).filter("k > 1"), "duplicatePointer", F.concat("tag", F.lit(" "), "fam_id"), "person_id"),
    ]
    several = known_links.filter("tag = 'FAMC'").groupBy("person_id").agg(F.count("*").alias("k")).filter("k > 1").select("person_id")
    rival = born_to.join(several, "person_id", "left_semi").join(ids.select(F.col("id").alias("person_id")), "person_id", "left_semi").join(families, "fam_id", "left_semi")
    empty = known_links.filter("tag = 'FAMC'").join(several, "person_id", "left_semi").join(pairs.filter("husband is null and wife is null").select("fam_id"), "fam_id", "left_semi")
    out += [
        _found(rival.groupBy("person_id").agg(F.countDistinct("fam_id").alias("k")).filter("k > 1"), "multipleParents", F.col("k"), "person_id"),
        _found(empty, "parentlessFamily", F.col("fam_id"), "person_id"),
        _found(families.join(edges.filter("person_id is not null").select("fam_id"), "fam_id", "left_anti"), "parentlessFamily", F.lit("no members"), "fam_id", "family"),
    ]
    # couples and their children
    who = vital.select("id", "sex", "birth_year", "death_year")
    both = pairs
    for role in ("husband", "wife"):
        both = both.join(who.select(*[F.col(c).alias(role if c == "id" else f"{role}_{c}") for c in who.columns], F.lit(True).alias(f"{role}_known")), role, "left")
    both = materialize(both)
    same_sex = F.coalesce((F.col("husband_sex") == F.col("wife_sex")) & F.col("husband_sex").isin("M", "F"), F.lit(False))
    wedding = events.filter("tag = 'MARR'").groupBy(F.col("owner").alias("fam_id")).agg(F.min_by(F.struct(F.col("d.year").alias("y")), "ord")["y"].alias("wed"))
    married = both.join(wedding, "fam_id").select("wed", F.explode(F.array(*[F.struct(F.col(r).alias("id"), F.col(f"{r}_birth_year").alias("b")) for r in ("husband", "wife")])).alias("s")).select("s.id", (F.col("wed") - F.col("s.b")).alias("age"))
    gap = F.abs(F.col("husband_birth_year") - F.col("wife_birth_year"))
    out += [
        _found(both.filter("husband_sex = 'F'").filter(~same_sex), "roleSexConflict", F.lit("husband"), "husband"),
        _found(both.filter("wife_sex = 'M'").filter(~same_sex), "roleSexConflict", F.lit("wife"), "wife"),
        _found(married.filter(~F.col("age").between(*MARRIAGE_AGE)), "ageAtMarriage", F.col("age")),
        _found(both.filter(gap > SPOUSE_GAP).withColumn("id", F.when(F.col("husband_birth_year") <= F.col("wife_birth_year"), F.col("husband")).otherwise(F.col("wife"))).withColumn("gap", gap), "spouseAgeGap", F.col("gap")),
    ]
    kids = edges.filter("role = 'child'").select("fam_id", F.col("person_id").alias("id"), "ord").join(vital.select("id", "birth_year", "birth"), "id").filter("birth_year is not null")
    kids = materialize(kids.join(both.drop("husband_known", "wife_known"), "fam_id"))
    # adopted and foster children are not bound by the couple's lifespans
    first_link = links.filter("tag = 'FAMC'").groupBy(F.col("person_id").alias("id"), "fam_id").agg(F.min_by(F.struct("pedi"), "ord")["pedi"].alias("pedi"))
    bred = kids.join(first_link, ["id", "fam_id"], "left").filter(F.col("pedi").isNull() | F.lower(F.trim("pedi")).isin(*BIOLOGICAL))
    fa, mo = F.col("birth_year") - F.col("husband_birth_year"), F.col("birth_year") - F.col("wife_birth_year")
    month = F.col("birth_year") * 12 + F.coalesce(F.col("birth.month"), F.lit(6)) - 1
    runs = parallel_runs(pairs.join(ids.select(F.col("id").alias("husband")), "husband", "left_semi").join(ids.select(F.col("id").alias("wife")), "wife", "left_semi"), bred.select("fam_id", month.alias("month")))
    out += [
        _found(kids.withColumn("a", fa).filter(~F.col("a").between(*FATHER_AGE)), "parentAge", F.concat(F.lit("father "), F.col("a").cast("string"))),
        _found(kids.withColumn("a", mo).filter(~F.col("a").between(*MOTHER_AGE)), "parentAge", F.concat(F.lit("mother "), F.col("a").cast("string"))),
        _found(bred.filter("birth_year > husband_death_year + 1"), "bornAfterParentDeath", F.lit("father")),
        _found(bred.filter("birth_year > wife_death_year"), "bornAfterParentDeath", F.lit("mother")),
        _found(runs, "parallelFamilies", F.concat_ws(" ", "partner_a", "partner_b"), "mother"),
    ]
    # what families point at
    slots = edges.filter("role != 'child' and person_id is not null").groupBy("fam_id", "role").agg(F.countDistinct(F.trim("person_id")).alias("k")).filter("k > 1")
    lost_spouse = pairs.select("fam_id", F.explode(F.array("husband", "wife")).alias("id")).filter("id is not null").join(ids, "id", "left_anti")
    lost_child = edges.filter("role = 'child' and person_id is not null").select("fam_id", F.col("person_id").alias("id")).join(ids, "id", "left_anti")
    again = edges.filter("role = 'child' and person_id is not null").groupBy("fam_id", "person_id").agg(F.count("*").alias("k")).filter("k > 1")
    out += [
        _found(slots, "multiSpouseSlot", F.col("role"), "fam_id", "family"),
        _found(lost_spouse, "brokenLink", F.concat(F.lit("spouse missing "), "id"), "fam_id", "family"),
        _found(lost_child, "brokenLink", F.concat(F.lit("child missing "), "id"), "fam_id", "family"),
        _found(again, "duplicatePointer", F.concat(F.lit("CHIL "), "person_id"), "fam_id", "family"),
    ]
    # small groups linked to nobody else, reported on the youngest
    person_family = known_links.select("person_id", F.concat(F.lit("f "), "fam_id").alias("f")).union(
        edges.filter("person_id is not null").join(ids.select(F.col("id").alias("person_id")), "person_id", "left_semi").select("person_id", F.concat(F.lit("f "), "fam_id"))
    )
    hub = person_family.groupBy("f").agg(F.min("person_id").alias("dst"))
    joined = person_family.join(hub, "f").filter("person_id != dst").select(F.col("person_id").alias("src"), "dst").distinct()
    small = islands(joined, ids.select(F.col("id").alias("node")), ISLAND)
    rank = F.coalesce(F.col("birth_year"), F.col("death_year") - 60, F.lit(-(10**9)))
    file_order = F.col("ord") if "ord" in ind.columns else F.lit(0)
    aged = small.join(vital.select(F.col("id").alias("node"), rank.alias("rank")), "node").join(ind.select(F.col("id").alias("node"), file_order.alias("file_order")), "node")
    youngest = Window.partitionBy("component").orderBy(F.desc("rank"), "file_order", "node")
    out.append(_found(aged.withColumn("k", F.row_number().over(youngest)).filter("k = 1"), "island", F.col("size"), "node"))
    return reduce(DataFrame.unionByName, out)


def ordered_issues(issues: DataFrame, subjects: DataFrame) -> DataFrame:
    """Errors first, then by category, then by the record's label. subjects: id, subject."""
    named = issues.join(subjects, "id", "left").withColumn("subject", F.coalesce("subject", "id"))
    return named.orderBy(F.when(F.col("severity") == "error", 0).otherwise(1), "category", "subject", "id", "detail")


def issue_counts(issues: DataFrame) -> DataFrame:
    """(category, n) of all 22 categories, those without findings too."""
    every = issues.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    counts = issues.groupBy("category").agg(F.sum("n").alias("n"))
    return every.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))
