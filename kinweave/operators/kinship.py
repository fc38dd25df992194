"""How people are related: labels, lineage, blood lines, register numbers, presumed living, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kinweave.operators.graph import closure
from kinweave.operators.people import GENERATION, People, couples, parent_edges, relatives
from kinweave.session import materialize

#: How far the network is asked for a dated relative, and for how long a birth counts as living.
NETWORK_HOPS, LIVING_YEARS = 8, 100


def ancestors(people: People, start: DataFrame) -> DataFrame:
    """(start, node, generation) of every start (column node), by the shortest way, the person included."""
    return closure(parent_edges(people.edges).select("child", "parent").distinct(), start)


def relation_label(up: Column, down: Column, sex: Column) -> Column:
    """The name of a blood relation: ``up`` generations from the start to the common ancestor, ``down`` to the other."""

    def by_sex(f: str, m: str) -> Column:
        return F.when(sex == "F", f).otherwise(m)

    def times(name: Column, n: Column) -> Column:
        return F.concat(name, F.lit(" x"), (n - 2).cast("string"))

    line = [("mother", "father"), ("grandmother", "grandfather"), ("great-grandmother", "great-grandfather"), ("great-great-grandmother", "great-great-grandfather")]
    below = [("daughter", "son"), ("granddaughter", "grandson"), ("great-granddaughter", "great-grandson"), ("great-great-granddaughter", "great-great-grandson")]
    out = F.when((up == 0) & (down == 0), F.lit("self"))
    for n, (f, m) in enumerate(line, 1):
        out = out.when((down == 0) & (up == n), by_sex(f, m))
    out = out.when(down == 0, times(by_sex("great-grandmother", "great-grandfather"), up))
    for n, (f, m) in enumerate(below, 1):
        out = out.when((up == 0) & (down == n), by_sex(f, m))
    degree, removed = F.least(up, down) - 1, F.abs(up - down)
    cousin = F.concat(F.lit("cousin "), degree.cast("string"), F.when(removed > 0, F.concat(F.lit(" +"), removed.cast("string"))).otherwise(""))
    return (
        out.when(up == 0, times(by_sex("great-granddaughter", "great-grandson"), down))
        .when((up == 1) & (down == 1), by_sex("sister", "brother"))
        .when((up == 2) & (down == 1), by_sex("aunt", "uncle"))
        .when((up == 1) & (down == 2), by_sex("niece", "nephew"))
        .when((up == 3) & (down == 1), by_sex("great-aunt", "great-uncle"))
        .when(down == 1, times(by_sex("great-aunt", "great-uncle"), up))
        .when((up == 1) & (down == 3), by_sex("grand-niece", "grand-nephew"))
        .when(up == 1, times(by_sex("grand-niece", "grand-nephew"), down))
        .otherwise(cousin)
    )


def _common(people: People, home: str) -> DataFrame:
    """(id, node, up, down, via): common ancestors of home and everybody; via is home's parent on the way."""
    up = parent_edges(people.edges).select("child", "parent").distinct()
    start = people.individuals.select(F.col("id").alias("node"))
    own = materialize(closure(up, start.filter(F.col("node") == home)))
    # everyone's ancestors only as far as they meet those of home: a walk down from home's ancestors instead of one up from all
    down = closure(up.select(F.col("parent").alias("child"), F.col("child").alias("parent")), own.select("node"))
    met = down.select(F.col("start").alias("anc"), F.col("node").alias("id"), F.col("generation").alias("down"))
    return met.join(own.select(F.col("node").alias("anc"), F.col("generation").alias("up")), "anc").select("id", F.col("anc").alias("node"), "up", "down")


def kinship_labels(people: People, home: str) -> DataFrame:
    """(id, label, lineage): the relation of everybody to ``home`` by blood, marriage or a step, where there is one.

    The closest common ancestor decides (fewest generations in all). Siblings with one common parent are half-siblings.
    lineage: through which of home's parents the closest common ancestors are reached; none for descendants.
    """
    sex = people.individuals.select("id", F.coalesce("sex", F.lit("U")).alias("sex"))
    common = materialize(_common(people, home))
    best = common.groupBy("id").agg(F.min(F.struct((F.col("up") + F.col("down")).alias("t"), "up", "down")).alias("m")).select("id", "m.t", "m.up", "m.down")
    parents = parent_edges(people.edges).select("child", "parent", "role").distinct()
    mine = materialize(parents.filter(F.col("child") == home).select("parent", "role"))
    shared = parents.select(F.col("child").alias("id"), "parent").distinct().join(mine.select("parent").distinct(), "parent").groupBy("id").agg(F.countDistinct("parent").alias("shared"))
    blood = best.join(sex, "id").join(shared, "id", "left")
    half = (F.col("up") == 1) & (F.col("down") == 1) & (F.col("shared") == 1)
    label = F.when(half, F.when(F.col("sex") == "F", "half-sister").otherwise("half-brother")).otherwise(relation_label(F.col("up"), F.col("down"), F.col("sex")))
    # lineage over all closest ancestors: which parent of home leads to each
    lead = closure(parents.select("child", "parent").distinct(), mine.select(F.col("parent").alias("node")).distinct()).select(F.col("start").alias("parent"), "node", F.col("generation").alias("g"))
    side = lead.join(mine, "parent").join(sex.select(F.col("id").alias("parent"), F.col("sex").alias("p_sex")), "parent", "left")
    father = F.when(F.col("p_sex") == "M", True).when(F.col("p_sex") == "F", False).otherwise(F.col("role") == "father")
    nearest = side.withColumn("k", F.rank().over(Window.partitionBy("node").orderBy("g"))).filter("k = 1").select("node", father.alias("father"))
    closest = common.join(best.select("id", "t"), "id").filter("up + down = t and up > 0").join(nearest, "node")
    lineage = closest.groupBy("id").agg(F.max("father").alias("p"), F.max(~F.col("father")).alias("m"))
    lineage = lineage.select("id", F.when(F.col("p") & F.col("m"), "both").when(F.col("p"), "paternal").otherwise("maternal").alias("lineage"))
    related = blood.select("id", label.alias("label"), F.lit(1).alias("rank"))
    rel = relatives(people.edges)
    spouse = rel.filter("rel = 'spouse'").select("person", "relative").distinct()
    mates = spouse.filter(F.col("person") == home).select(F.col("relative").alias("id"))
    step_up = mine.select("parent").distinct().join(spouse, F.col("parent") == F.col("person")).select(F.col("relative").alias("id"))
    kids = parents.select("child", "parent").distinct()
    step_down = mates.join(kids, F.col("id") == F.col("parent")).select(F.col("child").alias("id"))
    step_side = step_up.join(kids, F.col("id") == F.col("parent")).select(F.col("child").alias("id"))

    def named(rows: DataFrame, f: str, m: str, rank: int) -> DataFrame:
        return rows.distinct().join(sex, "id").select("id", F.when(F.col("sex") == "F", f).otherwise(m).alias("label"), F.lit(rank).alias("rank"))

    every = related.filter(F.col("id") != home).unionByName(named(mates, "spouse", "spouse", 0)).unionByName(named(step_up, "step-mother", "step-father", 2))
    every = every.unionByName(named(step_down, "step-daughter", "step-son", 3)).unionByName(named(step_side, "step-sister", "step-brother", 4)).filter(F.col("id") != home)
    first = every.groupBy("id").agg(F.min_by("label", "rank").alias("label"))
    own = people.individuals.filter(F.col("id") == home).select("id", F.lit("start").alias("label"))
    return first.unionByName(own).join(lineage, "id", "left")


def blood_lines(people: People, a: str, b: str) -> DataFrame:
    """(ancestor, up, down, path): every most recent common ancestor of two people with the way over it, shortest first.

    An ancestor counts if no other common one lies on the ways to it; of a couple one is shown.
    """
    spark = people.edges.sparkSession
    up = parent_edges(people.edges).select("child", "parent", "role").distinct()

    def ways(start: str) -> DataFrame:
        """Shortest way up to every ancestor, the father's side first among equal ones."""
        level = spark.createDataFrame([(start, [start])], "node string, path array<string>")
        seen = [materialize(level)]
        while True:
            step = seen[-1].join(up, F.col("node") == F.col("child")).select(F.col("parent").alias("node"), F.concat("path", F.array("parent")).alias("path"), (F.col("role") != "father").alias("k"))
            known = seen[0]
            for s in seen[1:]:
                known = known.unionByName(s)
            fresh = materialize(step.join(known.select("node"), "node", "left_anti").groupBy("node").agg(F.min_by("path", F.struct("k", "path")).alias("path")))
            if fresh.isEmpty():
                return materialize(known)
            seen.append(fresh)

    x, y = ways(a), ways(b)
    both = materialize(x.select("node", F.col("path").alias("pa")).join(y.select("node", F.col("path").alias("pb")), "node"))
    inner = both.select("node", F.explode(F.array_union(F.slice("pa", 2, F.greatest(F.size("pa") - 2, F.lit(0))), F.slice("pb", 2, F.greatest(F.size("pb") - 2, F.lit(0))))).alias("mid"))
    covered = inner.join(both.select(F.col("node").alias("mid")), "mid", "left_semi").select("node").distinct()
    kept = both.join(covered, "node", "left_anti")
    legs = F.concat_ws(">", F.slice("pa", 1, F.size("pa") - 1), F.lit("*"), F.slice(F.reverse("pb"), 2, F.size("pb")))
    path = F.concat("pa", F.slice(F.reverse("pb"), 2, F.size("pb")))
    one = kept.select("node", (F.size("pa") - 1).alias("up"), (F.size("pb") - 1).alias("down"), path.alias("path"), legs.alias("legs"))
    out = one.groupBy("legs").agg(F.min(F.struct("node", "up", "down", "path")).alias("m")).select(F.col("m.node").alias("ancestor"), "m.up", "m.down", "m.path")
    return out.orderBy(F.col("up") + F.col("down"), "ancestor")


def descendant_register(people: People, root: str, birth_keys: DataFrame, max_generations: int = 100) -> DataFrame:
    """(id, generation, number, of, place): numbers run on through each generation, by the parent's number and the birth;
    a person met again through another parent keeps the first. birth_keys: id, birth_key."""
    spark = people.edges.sparkSession
    down = parent_edges(people.edges).groupBy("parent", "child").agg(F.min("ord").alias("ord")).join(birth_keys.select(F.col("id").alias("child"), "birth_key"), "child", "left")
    level = materialize(spark.createDataFrame([(root, 0, 1, None, None)], "id string, generation int, number int, of int, place int"))
    out, last = level, 1
    for g in range(1, max_generations + 1):
        kids = level.join(down, F.col("id") == F.col("parent")).select(F.col("child").alias("id"), F.col("number").alias("of"), F.coalesce("birth_key", F.lit(float("inf"))).alias("k"), "ord")
        first = kids.join(out.select("id"), "id", "left_anti").withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("of"))).filter("r = 1")
        placed = materialize(first.withColumn("place", F.row_number().over(Window.partitionBy("of").orderBy("k", "ord", "id"))).select("id", "of", "place"))
        if placed.isEmpty():
            break
        # numbers without one task for all: ranges of parents, and a count for each range
        ranged = materialize(placed.repartitionByRange("of", "place").withColumn("__p", F.spark_partition_id()))
        begin, total = [], last
        for r in ranged.groupBy("__p").agg(F.count("*").alias("n")).orderBy("__p").collect():  # a row for each task
            begin.append((r["__p"], total))
            total += r.n
        row = F.row_number().over(Window.partitionBy("__p").orderBy("of", "place"))
        numbered = ranged.withColumn("__r", row).join(F.broadcast(spark.createDataFrame(begin, "__p int, __b int")), "__p")
        level = materialize(numbered.select("id", F.lit(g).alias("generation"), (F.col("__b") + F.col("__r")).cast("int").alias("number"), "of", "place"))
        last = total
        out = out.unionByName(level)
    return out


def network_estimates(people: People, years: DataFrame, wanted: DataFrame, hops: int = NETWORK_HOPS) -> DataFrame:
    """(id, estimate): the latest birth year that a dated relative within ``hops`` allows, a generation per parent step.

    Each person is met once on the shortest way; all wanted (column id) walk together, a round per hop.
    """
    shift = F.when(F.col("rel") == "parent", GENERATION).when(F.col("rel") == "child", -GENERATION).otherwise(0)
    steps = relatives(people.edges).select(F.col("person").alias("node"), F.col("relative").alias("next"), shift.alias("shift"), F.when(F.col("rel") == "parent", 0).when(F.col("rel") == "spouse", 1).otherwise(2).alias("kind"), "fam_id", "ord")
    front = materialize(wanted.select("id", F.col("id").alias("node"), F.lit(0).alias("offset")).distinct())
    seen = front.select("id", "node")
    best = None
    for _ in range(hops):
        reached = front.join(steps, "node").select("id", F.col("next").alias("node"), (F.col("offset") + F.col("shift")).alias("offset"), "kind", "fam_id", "ord")
        # of several ways in one round the first in the order of the walk counts
        one = reached.groupBy("id", "node").agg(F.min(F.struct("kind", "fam_id", "ord", "offset"))["offset"].alias("offset"))
        front = materialize(one.join(seen, ["id", "node"], "left_anti"))
        if front.isEmpty():
            break
        seen = materialize(seen.unionByName(front.select("id", "node")))
        found = front.join(years.filter("birth_year is not null").select(F.col("id").alias("node"), "birth_year"), "node").select("id", (F.col("birth_year") + F.col("offset")).alias("e"))
        best = found if best is None else best.unionByName(found)
    if best is None:
        return wanted.select("id", F.lit(None).cast("int").alias("estimate")).limit(0)
    return best.groupBy("id").agg(F.max("e").cast("int").alias("estimate"))


def presumed_living(people: People, vital: DataFrame, year_now: int = 2024) -> DataFrame:
    """(id, living): nobody with a death event; else by the birth within a hundred years, or by the network's estimate;
    who cannot be dated at all counts as living."""
    undated = vital.filter("not deceased and birth_year is null").select("id")
    estimate = network_estimates(people, vital.select("id", "birth_year"), undated)
    year = F.coalesce("birth_year", "estimate")
    return vital.join(estimate, "id", "left").select("id", (~F.col("deceased") & (year.isNull() | (F.lit(year_now) - year < LIVING_YEARS))).alias("living"))


def timeline(people: People, home: str, vital: DataFrame, generations: int = 3) -> DataFrame:
    """(id, role, generation, birth_year, death_year): rows of a person's timeline, ancestors up and descendants down to
    ``generations``, siblings, half-siblings, spouses and step-parents."""
    up = parent_edges(people.edges).select("child", "parent").distinct()
    one = people.individuals.filter(F.col("id") == home).select(F.col("id").alias("node"))
    above = closure(up, one, generations).select(F.col("node").alias("id"), (-F.col("generation")).alias("generation"), F.when(F.col("generation") == 0, "self").otherwise("ancestor").alias("role"))
    below = closure(up.select(F.col("parent").alias("child"), F.col("child").alias("parent")), one, generations).filter("generation > 0").select(F.col("node").alias("id"), "generation", F.lit("descendant").alias("role"))
    mine = up.filter(F.col("child") == home).select("parent")
    n = mine.count()
    sib = up.join(mine, "parent").filter(F.col("child") != home).groupBy(F.col("child").alias("id")).agg(F.countDistinct("parent").alias("k"))
    sib = sib.select("id", F.lit(0).alias("generation"), F.when((F.col("k") == 1) & F.lit(n > 1), "half-sibling").otherwise("sibling").alias("role"))
    spouse = relatives(people.edges).filter("rel = 'spouse'")
    mates = spouse.filter(F.col("person") == home).select(F.col("relative").alias("id"), F.lit(0).alias("generation"), F.lit("spouse").alias("role")).distinct()
    step = spouse.join(mine, F.col("person") == F.col("parent")).select(F.col("relative").alias("id")).join(mine.select(F.col("parent").alias("id")), "id", "left_anti").distinct()
    rows = above.unionByName(below).unionByName(sib).unionByName(mates).unionByName(step.select("id", F.lit(-1).alias("generation"), F.lit("step-parent").alias("role")))
    return rows.join(vital.select("id", "birth_year", "death_year"), "id").orderBy("generation", "birth_year", "id")


def unions_by_marriage(people: People, weddings: DataFrame) -> DataFrame:
    """(id, fam_id, place): a person's unions in order of the wedding, undated ones last. weddings: fam_id, key."""
    pairs = couples(people.edges)
    each = pairs.select("fam_id", F.explode(F.array("husband", "wife")).alias("id")).filter("id is not null").join(weddings, "fam_id", "left")
    order = Window.partitionBy("id").orderBy(F.asc_nulls_last("key"), "fam_id")
    return each.select("id", "fam_id", F.row_number().over(order).alias("place"))
