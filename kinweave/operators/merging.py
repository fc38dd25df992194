"""Merging records: survivors, pointer remaps, batch changes, privacy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators.graph import connected_components


def survivors(pairs: DataFrame, richness: DataFrame) -> DataFrame:
    """(old, survivor): every member of a duplicate cluster and the richest member, at a tie the smallest id.

    pairs: a_id, b_id; richness: id, n (relatives, fields or whatever decides).
    """
    part = connected_components(pairs, "a_id", "b_id")
    ranked = part.join(richness, F.col("node") == F.col("id"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = ranked.groupBy("component").agg(F.min_by("node", F.struct(-F.col("n"), F.col("node"))).alias("survivor"))
    return part.join(best, "component").select(F.col("node").alias("old"), "survivor")


def remap(rows: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """``rows`` with a pointer column led to the survivors."""
    m = mapping.select(F.col("old").alias("__old"), F.col("survivor").alias("__new"))
    out = rows.join(m, F.col(column) == F.col("__old"), "left")
    return out.select(*[F.coalesce("__new", column).alias(c) if c == column else F.col(c) for c in rows.columns])


def merge_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Family edges after a merge: pointers remapped; only repeats that the remap made are dropped.

    edges: fam_id, person_id, role, ord.
    """
    tagged = edges.withColumn("__was", F.col("person_id"))
    moved = remap(tagged, "person_id", mapping)
    # of rows that became equal the original survivor's stays, else the first
    first = moved.groupBy("fam_id", "person_id", "role").agg(
        F.min_by("ord", F.struct((F.col("__was") != F.col("person_id")).alias("moved"), "ord")).alias("keep"), F.countDistinct("__was").alias("kinds")
    )
    out = moved.join(first, ["fam_id", "person_id", "role"]).filter("kinds = 1 or ord = keep")
    return out.select(*edges.columns)


def fill_spouse_role(edges: DataFrame, sexes: DataFrame) -> DataFrame:
    """(fam_id, person_id, role): husbands known to be female and wives known to be male swap roles, if both spouses agree.

    sexes: person_id, sex.
    """
    e = edges.filter("role in ('husband', 'wife')").join(sexes, "person_id", "left")
    wrong = ((F.col("role") == "husband") & (F.col("sex") == "F")) | ((F.col("role") == "wife") & (F.col("sex") == "M"))
    right = ((F.col("role") == "husband") & (F.col("sex") == "M")) | ((F.col("role") == "wife") & (F.col("sex") == "F"))
    verdict = e.groupBy("fam_id").agg(F.bool_or(wrong).alias("w"), F.bool_or(F.coalesce(right, F.lit(False))).alias("r")).filter("w and not r")
    swapped = F.when(F.col("role") == "husband", "wife").otherwise("husband")
    out = edges.filter("role in ('husband', 'wife')").join(verdict.select("fam_id", F.lit(True).alias("__swap")), "fam_id", "left")
    return out.select("fam_id", "person_id", F.when(F.col("__swap"), swapped).otherwise(F.col("role")).alias("role"))


def infer_sex(edges: DataFrame) -> DataFrame:
    """(person_id, sex) of people who stand in one spouse role only."""
    roles = edges.filter("role in ('husband', 'wife')").groupBy("person_id").agg(F.countDistinct("role").alias("k"), F.min("role").alias("role"))
    return roles.filter("k = 1").select("person_id", F.when(F.col("role") == "husband", "M").otherwise("F").alias("sex"))


def living_reason(declared: Column, death_year: Column, birth_year: Column, relative_year: Column, now: int, lifespan: int = 100, recent: int = 0) -> Column:
    """Why a person counts as living or not: declared, deceased, recent (death), birth, relative, old, unknown."""
    return (
        F.when(declared, "declared")
        .when(death_year.isNotNull() & (death_year < now - recent), "deceased")
        .when(death_year.isNotNull(), "recent")
        .when(birth_year.isNotNull(), F.when(birth_year > now - lifespan, "birth").otherwise("old"))
        .when(relative_year.isNotNull(), F.when(relative_year > now - lifespan, "relative").otherwise("old"))
        .otherwise("unknown")
    )


def redact_people(people: DataFrame, reason: str, private: list[str], name: str = "name") -> DataFrame:
    """``people`` with the names and private columns of the living blanked."""
    living = F.col(reason).isin("declared", "recent", "birth", "relative")
    cols = [F.when(living, F.lit("Living")).otherwise(F.col(c)).alias(c) if c == name else F.when(~living, F.col(c)).alias(c) if c in private else F.col(c) for c in people.columns]
    return people.select(*cols)


def mark_deceased(people: DataFrame, birth_year: str, deceased: str, now: int, lifespan: int = 110) -> DataFrame:
    """``people`` with ``deceased`` set for those born ``lifespan`` years ago or earlier; unknown births stay."""
    old = F.coalesce(F.col(birth_year) <= now - lifespan, F.lit(False))
    return people.withColumn(deceased, F.col(deceased) | old)
