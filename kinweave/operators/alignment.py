"""Putting the parts of two records side by side: events, relatives, unions; and what a confirmed choice changes.

All pairings are joins on the pair of records followed by a greedy assignment within the pair; scores of events
are column expressions, those of relatives come from one batched function over names.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from kinweave.functions import names as N
from kinweave.operators import linkage
from kinweave.operators.gazetteer import place_key
from kinweave.operators.registers import align_rows
from kinweave.session import materialize

#: Events a person has once, the bars of a pairing, and what years and days add to a name.
SINGLE_TAGS = ("BIRT", "DEAT", "BURI", "_FNRL", "_INTE")
EVENT_BAR, RELATIVE_BAR, UNION_BAR, PARTNER_SCORE = 0.6, 0.85, 0.5, 0.6
YEARS, LOOSE_YEARS, PENALTY, SAME_DAY, SAME_YEAR, NEAR_YEAR, SAME_DEATH = 2, 10, 0.25, 0.2, 0.15, 0.05, 0.05


def event_score(a: Column, b: Column) -> Column:
    """Score of two events (structs d, place, address, value): 1 if equal, else 0.6 of the dates and 0.4 of the places."""

    def span(e: Column) -> tuple[Column, Column]:
        other = F.coalesce(e["d"]["year2"], e["d"]["year"])
        return F.least(e["d"]["year"], other), F.greatest(e["d"]["year"], other)

    (la, ha), (lb, hb) = span(a), span(b)
    gap = F.greatest(la - hb, lb - ha)
    date = F.when(la.isNull() | lb.isNull(), 0.3).when(gap <= 1, 1.0).when(gap <= 3, 0.7).when(gap <= 5, 0.4).when(gap <= 10, 0.2).otherwise(0.0)

    def words(e: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.coalesce(e["key"], F.lit("")), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3))

    wa, wb = words(a), words(b)
    both, either = F.size(F.array_intersect(wa, wb)), F.size(F.array_union(wa, wb))
    text = [F.lower(F.trim(F.coalesce(e["place"], F.lit("")))) for e in (a, b)]
    address = [F.lower(F.trim(F.coalesce(e["address"], F.lit("")))) for e in (a, b)]
    inside = ((address[0] != "") & F.contains(text[1], address[0])) | ((address[1] != "") & F.contains(text[0], address[1]))
    local = [F.split(F.coalesce(e["key"], F.lit("")), ",")[0] for e in (a, b)]
    empty = [(t == "") & (x == "") for t, x in zip(text, address, strict=True)]
    overlap = F.when(either > 0, both / either).otherwise(0.0)
    place = F.when(empty[0] & empty[1], 0.3).otherwise(F.least(F.lit(1.0), overlap + F.when(inside, 0.4).otherwise(0.0) + F.when((local[0] == local[1]) & (local[0] != ""), 0.3).otherwise(0.0)))
    same = F.lit(True)
    for c in ("date", "place", "address", "value"):
        same = same & F.coalesce(a[c], F.lit("")).eqNullSafe(F.coalesce(b[c], F.lit("")))
    return F.when(same, 1.0).otherwise(0.6 * date + 0.4 * place)


def align_events(pairs: DataFrame, main: DataFrame, compare: DataFrame) -> DataFrame:
    """(main_id, compare_id, tag, main_event, compare_event): events of each pair of records that are one; either
    side is null for an event without counterpart.

    main and compare: owner, tag, ord, date, place, address, value and the parsed date d. Events a person has once
    always pair. Of other tags a single one on each side pairs unless one is dated and they score below the bar;
    several pair best first above it.
    """

    def side(events: DataFrame, name: str) -> DataFrame:
        whole = F.struct("d", "date", "place", "address", "value", place_key("place").alias("key"))
        return events.select(F.col("owner").alias(f"{name}_id"), "tag", F.col("ord").alias(f"{name}_event"), whole.alias(name))

    m, c = side(main, "main"), side(compare, "compare")
    ours, theirs = pairs.select("main_id", "compare_id").distinct().join(m, "main_id"), pairs.select("main_id", "compare_id").distinct().join(c, "compare_id")
    group = ["main_id", "compare_id", "tag"]
    counts = ours.groupBy(*group).agg(F.count("*").alias("nm")).join(theirs.groupBy(*group).agg(F.count("*").alias("nc")), group)
    both = ours.join(theirs, group).join(counts, group).withColumn("score", event_score(F.col("main"), F.col("compare")))
    alone = (F.col("nm") == 1) & (F.col("nc") == 1)
    undated = F.col("main.d.year").isNull() & F.col("compare.d.year").isNull()
    fits = (F.col("score") >= EVENT_BAR) | (alone & (F.col("tag").isin(*SINGLE_TAGS) | undated))
    keyed = both.filter(fits).withColumns({"mk": F.concat_ws("|", *group, "main_event"), "ck": F.concat_ws("|", *group, "compare_event")})
    chosen = linkage.assign_one_to_one(keyed.select(*group, "main_event", "compare_event", "score", "mk", "ck"), "score", "mk", "ck").select(*group, "main_event", "compare_event")
    left = ours.select(*group, "main_event").join(chosen, [*group, "main_event"], "left_anti").withColumn("compare_event", F.lit(None).cast("int"))
    right = theirs.select(*group, "compare_event").join(chosen, [*group, "compare_event"], "left_anti").withColumn("main_event", F.lit(None).cast("int"))
    return chosen.unionByName(left).unionByName(right)


def relative_similarity_value(a: dict, b: dict, kind: str = "partner") -> float:
    """Similarity of two relatives {name, birth_year, birth_day, approx, death_year, death_day}; may pass 1, as it ranks.

    Without a given name on both sides the dates must carry it. Children share the surname, so only given names count
    there. A year within tolerance adds to a name that carries the pairing, one beyond it takes away.
    """
    x, y = N.comparable(a["name"]), N.comparable(b["name"])
    ya, yb, loose = a["birth_year"], b["birth_year"], a["approx"] or b["approx"]
    days = a["birth_day"], b["birth_day"]
    if not (x and y and x[0] and y[0]):
        same = ya is not None and ya == yb and not loose and (None in days or days[0] == days[1]) and (None in (a["death_year"], b["death_year"]) or a["death_year"] == b["death_year"])
        return RELATIVE_BAR if same else 0.0
    given = N.given_similarity(x[0], y[0])
    name = given if kind == "child" else N.name_similarity(x, y) or 0.0
    if ya is None or yb is None:
        return name
    gap = abs(ya - yb)
    if gap > (LOOSE_YEARS if loose else YEARS):
        return max(0.0, name - PENALTY)
    if not (name >= RELATIVE_BAR if kind == "child" else given >= N.GIVEN_CONFLICT):
        return name
    if kind == "child" and gap == 0 and None not in days and days[0] != days[1]:
        one_death = a["death_day"] is not None and a["death_day"] == b["death_day"] and a["death_year"] == b["death_year"]
        return max(0.0, name if days[0] // 100 == days[1] // 100 or one_death else name - PENALTY)
    more = SAME_DAY if kind == "child" and gap == 0 and days[0] is not None and days[0] == days[1] else SAME_YEAR if gap == 0 else NEAR_YEAR
    return name + more + (SAME_DEATH if kind == "child" and a["death_year"] is not None and a["death_year"] == b["death_year"] else 0.0)


@F.pandas_udf(T.DoubleType())
def relative_similarity(a: pd.DataFrame, b: pd.DataFrame, kind: pd.Series) -> pd.Series:
    def rows(frame: pd.DataFrame) -> list[dict]:
        out = frame.astype(object).where(frame.notna(), None).to_dict("records")
        return [r | {"name": None if r["name"] is None else tuple(r["name"])} for r in out]

    return pd.Series([relative_similarity_value(x, y, k) for x, y, k in zip(rows(a), rows(b), kind, strict=True)], dtype="float64")


def relative_struct(prefix: str = "") -> Column:
    """What two relatives are compared by, from the columns of a profile."""
    c = lambda x: F.col(f"{prefix}{x}")
    day = lambda d: F.when(d["month"].isNotNull() & d["day"].isNotNull(), d["month"] * 100 + d["day"])
    return F.struct(
        c("name").alias("name"), c("birth_year").alias("birth_year"), day(c("birth")).alias("birth_day"), (F.coalesce(c("birth.qualifier"), F.lit("exact")) != "exact").alias("approx"),
        c("death_year").alias("death_year"), day(c("death")).alias("death_day"),
    )


def align_relatives(relatives: DataFrame) -> DataFrame:
    """(group, a, b): relatives of one role of a pair of records, one to one, best first, above the bar.

    relatives: group (the pair and role), a, b (their ids), x, y (structs), kind (child or partner). A score that a
    relative shares with two open ones pairs neither, unless the two say exactly the same.
    """
    scored = relatives.withColumn("score", relative_similarity("x", "y", "kind")).filter(F.col("score") >= RELATIVE_BAR)
    # relatives who say the same are interchangeable: the first of them stands in a tie
    same_b = F.xxhash64(F.to_json("y"))
    same_a = F.xxhash64(F.to_json("x"))
    twin_b = F.row_number().over(Window.partitionBy("group", "a", "score", same_b).orderBy("b"))
    twin_a = F.row_number().over(Window.partitionBy("group", "b", "score", same_a).orderBy("a"))
    ranked = scored.withColumns({"rb": twin_b, "ra": twin_a})
    # twins go in step: the first of one side with the first of the other
    return align_rows(ranked.filter("ra = rb").select("group", "a", "b", "score"), "group", "a", "b", "score", RELATIVE_BAR)


def pair_unions(candidates: DataFrame) -> DataFrame:
    """(main_id, compare_id, main_fam, compare_fam): unions of two people that are one, best first.

    candidates: main_id, compare_id, main_fam, compare_fam, x, y (partners as structs, null if none is named), overlap (share of
    the children that pair), n_main, n_compare (unions of either). Named partners decide; if they are two people,
    or none is named, the children do; a lone union on each side with a partner missing pairs.
    """
    named = F.col("x.name").isNotNull() & F.col("y.name").isNotNull()

    @F.pandas_udf(T.DoubleType())
    def partner(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
        def one(frame: pd.DataFrame) -> list[dict]:
            out = frame.astype(object).where(frame.notna(), None).to_dict("records")
            return [r | {"name": None if r["name"] is None else tuple(r["name"])} for r in out]

        found = []
        for x, y in zip(one(a), one(b), strict=True):
            if x["name"] is None or y["name"] is None:
                found.append(None)
                continue
            s = relative_similarity_value(x, y)
            years = x["birth_year"], y["birth_year"]
            given = (x["name"][0] or "").strip(), (y["name"][0] or "").strip()
            same = s >= RELATIVE_BAR or (not (None not in years and years[0] != years[1]) and all(given) and N.given_similarity(*given) >= RELATIVE_BAR)
            found.append(max(s, PARTNER_SCORE) if same else -1.0)
        return pd.Series(found, dtype="float64")

    p = partner("x", "y")
    rows = candidates.withColumn("p", p)
    lone = (F.col("n_main") == 1) & (F.col("n_compare") == 1)
    sim = F.when(named & (F.col("p") >= 0), F.col("p")).when(named, F.col("overlap")).when(lone, 1.0).otherwise(F.col("overlap"))
    keyed = rows.withColumn("score", sim).filter(F.col("score") >= UNION_BAR).select("main_id", "compare_id", "main_fam", "compare_fam", "score").withColumns({"mk": F.concat_ws("|", "main_id", "compare_id", "main_fam"), "ck": F.concat_ws("|", "main_id", "compare_id", "compare_fam")})
    return linkage.assign_one_to_one(keyed, "score", "mk", "ck").select("main_id", "compare_id", "main_fam", "compare_fam")


def applied_rows(rows: DataFrame, now: DataFrame) -> DataFrame:
    """(main_id, compare_id, field, value, outcome) of confirmed field rows: applied, both (of a list), or deferred.

    rows: main_id, compare_id, field, main, incoming, state, choice, many (the field may hold several values). Rows that agree,
    that only main has, parents' and family rows are not applied here. "both" on a field of one value is "incoming". A
    value that changed in ``now`` (main_id, field, value) since it was confirmed is left and reported.
    """
    wanted = rows.filter("state not in ('agree', 'main-only') and field not in ('father', 'mother') and not startswith(field, 'fam.')")
    choice = F.when((F.col("choice") == "both") & ~F.col("many"), "incoming").otherwise(F.col("choice"))
    current = now.select("main_id", "field", F.col("value").alias("current"))
    seen = wanted.withColumn("choice", choice).filter("choice in ('incoming', 'both')").join(current, ["main_id", "field"], "left")
    changed = F.coalesce("current", F.lit("")) != F.coalesce("main", F.lit(""))
    outcome = F.when(changed, "deferred").when(F.col("choice") == "both", "both").otherwise("applied")
    return seen.select("main_id", "compare_id", "field", F.when(changed, F.col("current")).otherwise(F.col("incoming")).alias("value"), outcome.alias("outcome"))


def new_ids(wanted: DataFrame, taken: DataFrame, prefix: str) -> DataFrame:
    """(key, id): the smallest free ``@<prefix>n@`` for each wanted key, in order of ``ord``; ids of ``taken`` stay free of them.

    Free numbers below the largest taken one are found by an anti-join of the numbers, those above follow on.
    """
    spark = wanted.sparkSession
    number = F.regexp_extract("id", f"^@{prefix}(\\d+)@$", 1).try_cast("long")
    used = taken.select(number.alias("n")).filter("n is not null").distinct()
    need, top = wanted.count(), used.agg(F.max("n")).first()[0] or 0
    free = spark.range(1, top + need + 1).select(F.col("id").alias("n")).join(used, "n", "left_anti")
    return _numbered(wanted, "ord", "key").join(_numbered(free, "n", "n").withColumnRenamed("n", "free"), "k").select("key", F.concat(F.lit(f"@{prefix}"), F.col("free").cast("string"), F.lit("@")).alias("id"))


def _numbered(rows: DataFrame, order: str, tie: str) -> DataFrame:
    """``rows`` with k = 0, 1, ... in order, numbered range by range."""
    ranged = materialize(rows.repartitionByRange(order, tie).withColumn("__p", F.spark_partition_id()))
    begin, total = [], 0
    for r in ranged.groupBy("__p").agg(F.count("*").alias("n")).orderBy("__p").collect():  # a row for each task
        begin.append((r["__p"], total))
        total += r.n
    place = F.row_number().over(Window.partitionBy("__p").orderBy(order, tie)) - 1
    offset = rows.sparkSession.createDataFrame(begin, "__p int, __b long")
    return ranged.withColumn("__r", place).join(F.broadcast(offset), "__p").withColumn("k", F.col("__b") + F.col("__r")).drop("__p", "__b", "__r")
