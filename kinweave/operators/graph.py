"""Graph operators on edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.session import materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_levels: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    Contraction: each node goes to the neighbour (or itself) of smallest hash, edges are relabelled
    and made distinct, and the next level works on what is left, a fraction in expectation whatever
    the order of ids, so long chains take a logarithmic number of levels. The levels' maps are
    composed afterwards. Every level is written to the shared folder. Null ends and loops are
    ignored; repeated edges count once; no edges give an empty table.
    """
    e = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).filter("s is not null and d is not null and s != d")
    e = materialize(e.unionByName(e.select(F.col("d").alias("s"), F.col("s").alias("d"))).distinct())
    levels = []
    while len(levels) < max_levels and not e.isEmpty():
        best = e.groupBy("s").agg(F.min(F.struct(F.xxhash64("d").alias("h"), F.col("d").alias("d"))).alias("m"))
        own = F.struct(F.xxhash64("s").alias("h"), F.col("s").alias("d"))
        step = materialize(best.select("s", F.least("m", own)["d"].alias("t")))
        levels.append(step)
        e = materialize(
            e.join(step.select("s", F.col("t").alias("a")), "s")
            .join(step.select(F.col("s").alias("d"), F.col("t").alias("b")), "d")
            .filter("a != b")
            .select(F.col("a").alias("s"), F.col("b").alias("d"))
            .distinct()
        )
    if not levels:
        return e.select(F.col("s").alias("node"), F.col("d").alias("component"))
    if not e.isEmpty():
        raise RuntimeError(f"components are not settled after {max_levels} levels")
    root = levels[0].select(F.col("s").alias("node"), F.col("t").alias("root"))
    for step in levels[1:]:
        step = step.select(F.col("s").alias("root"), F.col("t").alias("__next"))
        root = root.join(step, "root", "left").select("node", F.coalesce("__next", "root").alias("root"))
    root = materialize(root)
    least = root.groupBy("root").agg(F.min("node").alias("component"))
    return root.join(least, "root").select("node", "component")


#: Generations of a walk are merged into one table whenever so many have come together.
MERGE_EVERY = 8


def _merged(tables: list[DataFrame]) -> list[DataFrame]:
    """One written table in place of many, so that a round's anti-join reads few files."""
    if len(tables) < MERGE_EVERY:
        return tables
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return [materialize(out)]


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def bfs_distance(edges: DataFrame, start: DataFrame, max_hops: int = 1000) -> DataFrame:
    """(node, distance) of every node reachable from ``start`` (column node) over ``edges`` (src, dst).

    A frontier per round, without the nodes seen before; cycles end by themselves. Only the last two rounds can be
    met again over edges that go both ways, but edges may be directed, so all seen nodes are kept out.
    """
    e = edges.select("src", "dst")
    frontier = materialize(start.select("node").distinct().withColumn("distance", F.lit(0)))
    seen = [frontier]
    for hop in range(1, max_hops + 1):
        reached = frontier.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = materialize(reached.join(_union(seen).select("node"), "node", "left_anti").withColumn("distance", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = _merged([*seen, frontier])
    return _union(seen)


def closure(parents: DataFrame, start: DataFrame, max_generations: int = 1000) -> DataFrame:
    """(start, node, generation): ancestors of each start node over ``parents`` (child, parent), by the shortest way."""
    up = parents.select(F.col("child").alias("node"), "parent")
    frontier = materialize(start.select(F.col("node").alias("start"), "node").distinct().withColumn("generation", F.lit(0)))
    seen = [frontier]
    for g in range(1, max_generations + 1):
        reached = frontier.join(up, "node").select("start", F.col("parent").alias("node")).distinct()
        frontier = materialize(reached.join(_union(seen).select("start", "node"), ["start", "node"], "left_anti").withColumn("generation", F.lit(g)))
        if frontier.isEmpty():
            break
        seen = _merged([*seen, frontier])
    return _union(seen)


def ahnentafel(parents: DataFrame, root, max_generations: int = 60) -> DataFrame:
    """(number, node, generation, repeat_of): 2n is the father of n, 2n + 1 the mother.

    A person met again keeps the number but is not expanded; ``repeat_of`` names the first.
    ``parents``: child, parent, role (father or mother). Numbers are 64-bit, enough for 62 generations.
    """
    spark = parents.sparkSession
    level = spark.createDataFrame([(1, root, 0)], f"number long, node {parents.schema['child'].dataType.simpleString()}, generation int")
    level = materialize(level.withColumn("repeat_of", F.lit(None).cast("long")))
    out = level
    for g in range(1, min(max_generations, 62) + 1):
        up = level.filter("repeat_of is null").join(parents.select(F.col("child").alias("node"), "parent", "role"), "node")
        found = up.select((F.col("number") * 2 + F.when(F.col("role") == "mother", 1).otherwise(0)).alias("number"), F.col("parent").alias("node"))
        first_here = found.groupBy("node").agg(F.min("number").alias("__here"))
        before = out.filter("repeat_of is null").select("node", F.col("number").alias("__before"))
        marked = found.join(first_here, "node").join(before, "node", "left")
        repeat = F.coalesce("__before", F.when(F.col("number") > F.col("__here"), F.col("__here")))
        level = materialize(marked.select("number", "node", F.lit(g).alias("generation"), repeat.alias("repeat_of")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def shortest_path(edges: DataFrame, source, target, max_hops: int = 1000) -> list:
    """Nodes of a shortest path, ties by smallest node; an empty list if there is none."""
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    if source == target:
        return [source]
    level = materialize(spark.createDataFrame([(source, None)], f"node {kind}, via {kind}"))
    levels = [level]
    seen = level.select("node")
    for _ in range(max_hops):
        step = level.join(edges.select("src", "dst"), F.col("node") == F.col("src")).groupBy("dst").agg(F.min("node").alias("via"))
        level = materialize(step.select(F.col("dst").alias("node"), "via").join(seen, "node", "left_anti"))
        if level.isEmpty():
            return []
        levels.append(level)
        if not level.filter(F.col("node") == target).isEmpty():
            break
        seen = seen.union(level.select("node"))
    path, at = [], target
    for level in reversed(levels):  # one row looked up for each hop
        path.append(at)
        at = level.filter(F.col("node") == at).first().via
    return path[::-1]


def cycle_members(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node): nodes on a directed cycle, loops of one node included; what only lies between two cycles is none.

    Nodes without a way in or out are peeled off; then, round by round, every node takes the largest colour that
    reaches it, and what goes back to the colour's own node within the colour is one strongly connected part and
    leaves, until no edge is left.
    """
    e = edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    loops = materialize(e.filter("src = dst").select(F.col("src").alias("node")))
    e = materialize(e.filter("src != dst"))
    found, rounds = [loops], 0

    def spread(colour: DataFrame, way: DataFrame) -> DataFrame:
        """Each node's colour after it took the largest of those before it, until nothing changes."""
        nonlocal rounds
        while True:
            rounds += 1
            if rounds > max_rounds:
                raise RuntimeError(f"loops are not settled after {max_rounds} rounds")
            came = way.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("c").alias("n"))
            new = materialize(colour.join(came, "node", "left").select("node", F.greatest("c", F.coalesce("n", "c")).alias("c"), (F.coalesce("n", "c") > F.col("c")).alias("moved")))
            colour = new.select("node", "c")
            if new.filter("moved").isEmpty():
                return colour

    while True:
        before = -1
        while (count := e.count()) != before:
            before = count
            e = materialize(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
        if not count:
            break
        nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
        colour = spread(nodes.select("node", F.col("node").alias("c")), e)
        # within one colour, backwards from the node that gave it
        ends = e.join(colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst")
        back = materialize(ends.filter("cs = cd").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("cs").alias("c")))
        core = frontier = materialize(colour.filter("node = c"))
        while not frontier.isEmpty():
            reached = frontier.join(back.withColumnRenamed("src", "node"), ["node", "c"]).select(F.col("dst").alias("node"), "c").distinct()
            frontier = materialize(reached.join(core, ["node", "c"], "left_anti"))
            core = materialize(core.unionByName(frontier))
        size = core.groupBy("c").agg(F.count("*").alias("n")).filter("n > 1")
        found.append(materialize(core.join(size, "c").select("node")))
        e = materialize(e.join(core.select(F.col("node").alias("src")), "src", "left_anti").join(core.select(F.col("node").alias("dst")), "dst", "left_anti"))
    return _union(found).distinct()


def islands(edges: DataFrame, nodes: DataFrame, largest: int = 9) -> DataFrame:
    """(node, component, size) of components of 2 to ``largest`` nodes that are smaller than the largest one."""
    part = connected_components(edges)
    part = nodes.select("node").join(part, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    size = materialize(part.groupBy("component").agg(F.count("*").alias("size")))
    most = size.agg(F.max("size")).first()[0] or 0
    small = size.filter(f"size between 2 and {largest} and size < {most}")
    return part.join(small, "component").select("node", "component", "size")
