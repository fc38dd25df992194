"""Places in a gazetteer: lookup of written names, ranked search, countries by vote, hierarchy levels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from kinweave.functions import names as N
from kinweave.functions.text import fold, jaro_winkler
from kinweave.operators.profile import top_one

#: Scores are our choice within the ranges that tell exact from fuzzy: a name, another name of the entry, the best fuzzy one.
NAME, OTHER_NAME, FUZZY = 1.0, 0.97, 0.94
LEAST_SIMILAR, WRONG_PARENT, SAME_SPOT = 0.88, 0.06, 0.01


@F.pandas_udf(T.StringType())
def place_key(texts: pd.Series) -> pd.Series:
    """Tokens of a place's parts, countries under one name, repeats left out."""
    known = {t: N.place_key_value(t) for t in texts.dropna().unique()}
    return pd.Series([known.get(t) for t in texts], dtype=object)


@F.pandas_udf(T.StringType())
def country_token(texts: pd.Series) -> pd.Series:
    """The country's key if the text names one, else nothing."""
    return pd.Series([N.COUNTRY_KEY.get(N.place_token(t)) if isinstance(t, str) else None for t in texts], dtype=object)


@F.pandas_udf(T.DoubleType())
def place_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two written places, house numbers counted."""
    return pd.Series([N.place_value_similarity(x if isinstance(x, str) else None, y if isinstance(y, str) else None) for x, y in zip(a, b, strict=True)], dtype="float64")


def deletions(text: Column) -> Column:
    """A word and all it is without one of its letters: words one edit apart have one of these in common."""
    return F.array_union(F.array(text), F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text)))))


def entry_names(register: DataFrame) -> DataFrame:
    """(key, entry, base): folded names of the entries, the best base score of each."""
    strings = F.array().cast("array<string>")
    others = F.concat(F.array("ascii") if "ascii" in register.columns else strings, F.coalesce("alt", strings) if "alt" in register.columns else strings)
    each = register.select("entry", F.explode(F.concat(F.array(F.struct(F.col("name").alias("t"), F.lit(NAME).alias("s"))), F.transform(others, lambda t: F.struct(t.alias("t"), F.lit(OTHER_NAME).alias("s"))))).alias("n"))
    folded = each.filter("n.t is not null").select("entry", fold("n.t").alias("key"), F.col("n.s").alias("base")).filter("key != ''")
    return folded.groupBy("key", "entry").agg(F.max("base").alias("base"))


def lookup(written: DataFrame, register: DataFrame) -> DataFrame:
    """(id, entry, score) for every written place that has an entry, the best one.

    written: id, name (the locality alone), parents (further written parts), country (a code, or null).
    register: entry, name, ascii, alt, lat, lon, fclass, country, admin (names of what it lies in), population, register.
    Names match exactly when folded; only those without an exact entry are compared by spelling, where a common
    deletion of one letter brings them together. Entries of another country never fit. A written parent that the
    entry does not lie in costs it. At a tie populated places go before divisions, larger ones first, an official
    register's entry before its twin on the same spot.
    """
    q = written.select("id", fold("name").alias("key"), F.transform(F.coalesce("parents", F.array().cast("array<string>")), lambda p: F.lower(F.trim(p))).alias("parents"), "country").filter("key != ''")
    names = entry_names(register)
    facts = register.select(
        "entry", F.col("country").alias("e_country"), F.transform(F.coalesce("admin", F.array().cast("array<string>")), lambda p: F.lower(F.trim(p))).alias("admin"), "lat", "lon",
        (F.col("fclass") == "P").alias("lived_in"), F.coalesce("population", F.lit(0)).alias("population"), F.coalesce("register", F.lit(False)).alias("official"),
    )

    def scored(pairs: DataFrame) -> DataFrame:
        both = pairs.join(facts, "entry").filter("country is null or e_country is null or country = e_country")
        stray = (F.size("parents") > 0) & (F.size("admin") > 0) & ~F.arrays_overlap("parents", "admin")
        return both.withColumn("score", F.col("base") - F.when(stray, WRONG_PARENT).otherwise(0.0))

    def best(rows: DataFrame) -> DataFrame:
        # twins on one spot are one place: the official entry stands for them
        spot = [F.floor(F.col(c) / SAME_SPOT) for c in ("lat", "lon")]
        one = rows.withColumn("k", F.row_number().over(Window.partitionBy("id", "score", *spot).orderBy(F.desc("official"), F.desc("lived_in"), F.desc("population"), "entry"))).filter("k = 1")
        return top_one(one, ["id"], F.desc("score"), F.desc("lived_in"), F.desc("population"), F.desc("official"), F.asc("entry")).select("id", "entry", "score")

    exact = best(scored(q.join(names, "key")))
    missed = q.join(exact.select("id"), "id", "left_anti")
    spelt = missed.select("key").distinct().withColumn("d", F.explode(deletions(F.col("key"))))
    known = names.select(F.col("key").alias("e_key")).distinct().withColumn("d", F.explode(deletions(F.col("e_key"))))
    near = spelt.join(known, "d").select("key", "e_key").distinct().withColumn("j", jaro_winkler("key", "e_key")).filter(F.col("j") >= LEAST_SIMILAR)
    fuzzy = missed.join(near, "key").join(names.withColumnRenamed("key", "e_key"), "e_key").withColumn("base", F.col("j") * FUZZY * F.col("base"))
    return exact.unionByName(best(scored(fuzzy.drop("e_key", "j"))))


def search_names(register: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """(entry, rank, name): entries whose folded name is the text (0), has it as a word (1), begins with it (2) or holds it (3)."""
    from kinweave.functions.text import fold_text

    wanted = fold_text(text)
    if len(wanted) < 2:
        return register.select("entry", F.lit(0).alias("rank"), "name").limit(0)
    key = F.col("key")
    rank = F.when(key == wanted, 0).when(F.array_contains(F.split(key, " "), wanted), 1).when(key.startswith(wanted), 2).when(F.contains(key, F.lit(wanted)), 3)
    hits = entry_names(register).withColumn("rank", rank).filter("rank is not null").groupBy("entry").agg(F.min("rank").alias("rank"))
    return hits.join(register.select("entry", "name", F.coalesce("population", F.lit(0)).alias("population")), "entry").orderBy("rank", F.desc("population"), "name", "entry").limit(limit).select("entry", "rank", "name")


def country_by_register(written: DataFrame, register: DataFrame, least: int = 10, share: float = 0.75, coverage: float = 0.5) -> DataFrame:
    """(file, country, n): the country that a file's bare place names vote for.

    written: file, name. Only names that one country alone has count; ``least`` distinct ones at least must, ``share`` of
    them for the winner, and ``coverage`` of the file's distinct names must be known at all.
    """
    keyed = written.select("file", fold("name").alias("key")).filter("key != ''").distinct()
    owner = entry_names(register).join(register.select("entry", "country"), "entry").filter("country is not null").groupBy("key").agg(F.countDistinct("country").alias("c"), F.min("country").alias("country"))
    met = keyed.join(owner, "key", "left")
    votes = met.groupBy("file").agg(F.count("*").alias("names"), F.count("c").alias("known"), F.count_if(F.col("c") == 1).alias("hits"))
    per = met.filter("c = 1").groupBy("file", "country").agg(F.count("*").alias("n"))
    won = per.join(votes, "file").filter((F.col("hits") >= least) & (F.col("n") >= share * F.col("hits")) & (F.col("known") >= coverage * F.col("names")))
    return top_one(won, ["file"], F.desc("n"), F.asc("country")).select("file", "country", "n")


def parent_levels(written: DataFrame, divisions: DataFrame, municipalities: DataFrame) -> DataFrame:
    """(file, level): whether a file's second part names a division or a municipality, by vote of distinct parts."""
    part = written.select("file", F.get("parts", F.lit(1)).alias("p")).filter("p is not null").select("file", fold("p").alias("key")).distinct()
    d = divisions.select(fold("name").alias("key"), F.lit(1).alias("d")).distinct()
    m = municipalities.select(fold("name").alias("key"), F.lit(1).alias("m")).distinct()
    votes = part.join(d, "key", "left").join(m, "key", "left").groupBy("file").agg(F.count("d").alias("d"), F.count("m").alias("m"))
    return votes.select("file", F.when(F.col("d") > F.col("m"), "division").when(F.col("m") > F.col("d"), "municipality").alias("level"))
