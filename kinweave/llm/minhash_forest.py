"""MinHash near-dedup with an LSH forest.

Every text's set of word shingles gets ``TREES`` x ``DEPTH`` minima. A tree is a sorted order of
the sets by its minima; the orders are dealt by range, so a hot region is split between tasks, and
are read as streams. Candidates are neighbours with a common prefix of at least ``MIN_PREFIX``
minima: all within ``WINDOW`` places where the region is that small. In larger regions the
depth adapts: of the window a set takes the ``NEAREST`` with which its common prefix is longest (at a
tie the best agreement of the sketches), so the region is cut as deep as it must be to leave so many;
the region's hubs (rows nearest to its majority sketch) are candidates of all. A candidate must agree
in ``MIN_AGREE`` of 128 one-bit minima, six standard deviations below the expectation at
similarity 0.8.

Links are confirmed on full sets: in ``ROUNDS`` rounds each component's best candidate to another
one, after which few components are left, then every candidate whose ends are still in different
components, so a link that is left out could not change the result. Sets that are equal are one class
from the start, so copies never meet each other as pairs, and after each round components stand for
their sets.

What a window may have cut short, a region above ``WINDOW`` or one at the edge of a task, goes to an
exact join on full sets (``_exact_links``) unless all of it is one component by then.

A pair at similarity 0.8 shares no region with probability (1 - 0.8 ** MIN_PREFIX) ** TREES = 6e-7,
whatever the size of its regions.

Defined edge cases: null, empty and blank texts have no shingles and are linked with nothing; a text
of fewer words than a shingle is one shingle; a row with a null id is its own group (component null,
kept); rows that repeat an id are judged by their own text, under that id; extra columns are
ignored by ``near_duplicates`` and kept by ``drop_near_duplicates``; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm import wordhash as W
from kinweave.operators.graph import connected_components
from kinweave.session import materialize, shuffle_partitions, table

TREES, DEPTH, MIN_PREFIX = 20, 6, 3
HASHES = 128
WINDOW, NEAREST, HUBS = 16, 2, 2
ROUNDS = 2
MIN_AGREE = 96
#: Ids up to this many are sent to every executor when candidates' texts are fetched; beyond, a join.
BROADCAST_IDS = 1_000_000
#: Exact join: a shingle is joined if at most so many of its sets are outside its largest component; each round raises it.
RARE, RAISE = 64, 32

_RNG = np.random.Generator(np.random.PCG64(7))
_XOR = _RNG.integers(0, 2**64, HASHES, dtype=np.uint64)
_MUL = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(words: W.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text of a block, joined, and the n + 1 offsets."""
    n_texts = len(words.first) - 1
    counts = np.diff(words.first)
    g = W.grams(words.hashes, size)
    inside = words.text[: len(g)] == words.text[size - 1 :] if len(g) else np.zeros(0, bool)
    g, owner = g[inside], words.text[: len(inside)][inside]
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):
        g = np.concatenate([g, np.array([W.grams(words.hashes[words.first[i] : words.first[i + 1]], int(counts[i]))[0] for i in few], dtype=np.uint64)])
        owner = np.concatenate([owner, few])
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    g, owner = g[new], owner[new]
    return g, np.searchsorted(owner, np.arange(n_texts + 1))


def signatures(g: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Minima of each set (rows) under each hash (columns), 32 bits; empty sets have zeros."""
    out = np.zeros((len(offsets) - 1, HASHES), dtype=np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        at = offsets[:-1][full]
        for j in range(HASHES):
            out[full, j] = np.minimum.reduceat((((g ^ _XOR[j]) * _MUL[j]) >> np.uint64(32)).astype(np.uint32), at)
    return out


def _sign(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Per row: id, n, two hashes of the whole set, and its minima."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            raw, off = W.buffers(batch.column(1))
            for a, b in W.blocks(off):
                g, offsets = shingle_sets(W.Words(raw, off[a : b + 1], W.NOT_SPACE), size)
                minima = signatures(g, offsets)
                both = [xxhash.xxh3_128_intdigest(g[s:e].tobytes()) for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
                n = np.diff(offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(n.astype(np.int64)),
                        pa.array(np.array([x & 0xFFFFFFFFFFFFFFFF for x in both], np.uint64).view(np.int64)),
                        pa.array(np.array([x >> 64 for x in both], np.uint64).view(np.int64)),
                        pa.array([m.tobytes() if k else None for m, k in zip(minima, n, strict=True)], pa.binary()),
                    ],
                    names=["id", "n", "h", "g", "minima"],
                )

    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {id_type}, n long, h long, g long, minima binary")


def _orders(classes: DataFrame, id_type: str) -> DataFrame:
    """A row for each class and tree: sort key (tree and minima), sketch, representative."""

    def run(batches):
        for batch in batches:
            m = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(-1, HASHES)
            bits = W.mix(m.astype(np.uint64) + _XOR).astype(np.uint8) & 1
            sketch = np.packbits(bits, axis=1).view(np.int64).reshape(-1, 2)
            for t in range(TREES):
                key = np.empty((len(m), 1 + 4 * DEPTH), dtype=np.uint8)
                key[:, 0] = t
                key[:, 1:] = np.ascontiguousarray(m[:, t * DEPTH : (t + 1) * DEPTH]).astype(">u4").view(np.uint8).reshape(len(m), -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k.tobytes() for k in key], pa.binary()), batch.column(0), pa.array(sketch[:, 0].copy()), pa.array(sketch[:, 1].copy())],
                    names=["key", "id", "s0", "s1"],
                )

    return classes.select("id", "minima").mapInArrow(run, f"key binary, id {id_type}, s0 long, s1 long")


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 128 - np.bitwise_count(a ^ b).sum(axis=-1).astype(np.int64)


def _neighbours(orders: DataFrame, id_type: str) -> DataFrame:
    """Candidate pairs (a, b, agree) from the sorted orders, read as streams; and rows (a, region) of
    the regions that the window may cut short, large ones and those at the edges of a task."""
    prefix = 1 + 4 * MIN_PREFIX
    deeper = DEPTH - MIN_PREFIX
    schema = f"a {id_type}, b {id_type}, agree long, region binary"

    def wide_rows(keys, ids, of_type):
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids.tolist(), of_type), pa.nulls(n, of_type), pa.nulls(n, pa.int64()), pa.array(keys.tolist(), pa.binary())],
            names=["a", "b", "agree", "region"],
        )

    def run(batches):
        old = opening = of_type = None
        for batch in batches:
            # a trailing byte keeps zero bytes at the end apart
            keys = np.array([k[:prefix] + b"\x01" for k in batch.column(0).to_pylist()])
            rest_keys = np.frombuffer(b"".join(k[prefix:] for k in batch.column(0).to_pylist()), dtype=np.uint32).reshape(-1, deeper)
            ids = np.array(batch.column(1).to_pylist(), dtype=object)
            sketch = np.stack([batch.column(2).to_numpy(), batch.column(3).to_numpy()], axis=1).view(np.uint64)
            if not len(keys):
                continue
            fresh = 0
            if old is not None:
                fresh = len(old[0])
                keys, ids, sketch, rest_keys = (np.concatenate(x) for x in zip(old, (keys, ids, sketch, rest_keys), strict=True))
            n = len(keys)
            edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.append(edge, n))
            region = np.repeat(np.arange(len(edge)), sizes)
            large = np.repeat(sizes > WINDOW + 1, sizes)
            if old is None:
                opening, of_type = keys[0], batch.column(1).type
            cut = large | (keys == opening)
            if cut.any():
                yield wide_rows(keys[cut], ids[cut], of_type)
            found = []
            for o in range(1, min(WINDOW, n - 1) + 1):
                j = np.arange(max(o, fresh), n)
                j = j[region[j] == region[j - o]]
                if len(j):
                    near = _agree(sketch[j], sketch[j - o])
                    ok = near >= MIN_AGREE
                    found.append(np.stack([j[ok], j[ok] - o, near[ok]], axis=1))
            pairs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            # larger regions: the best of the window
            wide = large[pairs[:, 0]]
            rest, many = pairs[~wide], pairs[wide]
            if len(many):
                common = np.minimum.accumulate(rest_keys[many[:, 0]] == rest_keys[many[:, 1]], axis=1).sum(axis=1)
                many = many[np.lexsort((many[:, 1], -many[:, 2], -common, many[:, 0]))]
                begin = np.flatnonzero(np.concatenate([[True], many[1:, 0] != many[:-1, 0]]))
                rank = np.arange(len(many)) - np.repeat(begin, np.diff(np.append(begin, len(many))))
                rest = np.concatenate([rest, many[rank < NEAREST]])
            # and the hubs
            hubs = []
            for r in np.flatnonzero(sizes > WINDOW + 1).tolist():
                rows = np.arange(edge[r], edge[r] + sizes[r])
                bits = np.unpackbits(sketch[rows].view(np.uint8).reshape(len(rows), -1), axis=1)
                middle = np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(rows)).view(np.uint64)
                for hub in rows[np.argsort(-_agree(sketch[rows], middle), kind="stable")[:HUBS]].tolist():
                    near = _agree(sketch[rows], sketch[hub])
                    ok = (near >= MIN_AGREE) & (rows != hub)
                    hubs.append(np.stack([rows[ok], np.full(ok.sum(), hub), near[ok]], axis=1))
            pairs = np.concatenate([rest, *hubs])
            if len(pairs):
                a, b = ids[pairs[:, 0]], ids[pairs[:, 1]]
                lo, hi = np.minimum(a, b), np.maximum(a, b)
                seen = dict(zip(zip(lo.tolist(), hi.tolist(), strict=True), pairs[:, 2].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _ in seen], batch.column(1).type), pa.array([x for _, x in seen], batch.column(1).type), pa.array(list(seen.values()), pa.int64()), pa.nulls(len(seen), pa.binary())],
                    names=["a", "b", "agree", "region"],
                )
            # one row more than the window: a region that goes on is large here if it is large at all
            old = tuple(x[-WINDOW - 1 :] for x in (keys, ids, sketch, rest_keys))
        if old is not None:
            last = old[0] == old[0][-1]
            yield wide_rows(old[0][last], old[1][last], of_type)

    return orders.mapInArrow(run, schema).filter("b is null or a != b")


def _sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, shingles) of the documents whose ids are asked for."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            raw, off = W.buffers(batch.column(1))
            for a, b in W.blocks(off):
                g, offsets = shingle_sets(W.Words(raw, off[a : b + 1], W.NOT_SPACE), size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(g.view(np.int64)))],
                    names=["id", "shingles"],
                )

    ids = ids.withColumnRenamed("id", "__m_id")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    wanted = docs.select(F.col(id_col).alias("id"), text_col).join(ids, F.col("id") == F.col("__m_id"), "left_semi")
    return wanted.mapInArrow(run, f"id {id_type}, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    both = (
        pairs.select("a", "b")
        .join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        .select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("i"), (F.size("x") + F.size("y")).cast("long").alias("s"))
    )
    return both.filter(f"100 * i >= {percent} * (s - i)").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _exact_links(sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """(src, dst): links that join all components which any pair of ``sets`` (id, shingles) joins.

    A shingle that one component holds alone links nothing new and is dropped. A rare one (at most
    ``RARE`` of its sets outside its largest component) is joined, across components only.
    Pairs without a common rare shingle have all they share among the hot ones, so sets go to the next
    round with their hot shingles only, with a larger ``RARE``, and end where these are under ``percent``
    of the set. Sets of equal hot shingles are then one class; its smallest set links with every one that
    another of the class could be linked with by hot shingles.
    """
    rare = RARE
    sets = materialize(sets)
    classes = sets.select(F.col("id").alias("c"), F.col("shingles").alias("s"))
    members = sets.select(F.col("id").alias("c"), "id", F.size("shingles").cast("long").alias("n"))
    similar = f"100 * {{o}} >= {percent} * ({{a}} + {{b}} - {{o}})"
    new = links.limit(0)
    while not classes.isEmpty():
        part = materialize(connected_components(links.unionByName(new)))
        owner = F.xxhash64(F.coalesce("component", "id"))
        info = materialize(
            members.join(part, F.col("id") == F.col("node"), "left")
            .groupBy("c")
            .agg(F.min(F.struct("n", "id")).alias("r"), F.min(owner).alias("lo"), F.max(owner).alias("hi"))
            # a class of several components is like no other
            .select("c", "r.n", F.col("r.id").alias("rep"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.xxhash64(F.lit("several"), "c")).alias("part"))
        )
        entries = materialize(classes.join(info, "c").select("c", "part", F.explode("s").alias("k")))
        per_part = entries.groupBy("k", "part").agg(F.count("*").alias("x"))
        spread = per_part.groupBy("k").agg(F.sum("x").alias("all"), F.max(F.struct("x", "part")).alias("top"), F.count("*").alias("parts")).filter("parts > 1")
        spread = spread.select("k", F.col("top.part").alias("most"), (F.col("all") - F.col("top.x")).alias("outside"))
        # the rarest first; links need ``percent`` of the larger set, so a common one is among the first of both
        ordered = entries.join(spread, "k").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("outside", "k", "most"))).alias("s"))
        ordered = materialize(ordered.join(info, "c").filter(f"100L * size(s) >= {percent} * n"))
        hot = materialize(ordered.select("c", F.expr(f"array_sort(transform(filter(s, x -> x.outside > {rare}), x -> x.k))").alias("s")).filter("size(s) > 0"))
        first = ordered.select("c", "part", "n", F.size("s").alias("z"), F.posexplode(F.expr(f"slice(s, 1, cast(size(s) - ({percent} * n + 99) div 100 + 1 as int))")).alias("at", "e"))
        first = materialize(first.filter(f"e.outside <= {rare}").select("c", "part", "n", F.col("e.k").alias("k"), F.col("e.most").alias("most"), "at", (F.col("z") - F.col("at") - 1).alias("left")))
        few = first.filter("part != most").select(*[F.col(x).alias(f"x_{x}") for x in ("c", "part", "n", "at", "left")], "k")
        every = first.select(*[F.col(x).alias(f"y_{x}") for x in ("c", "part", "n", "at", "left")], "most", "k")
        met = (
            few.join(every, "k")
            .filter("x_part != y_part and (y_part = most or x_c < y_c)")
            # what they share is at most what stands before in both, this one, and what follows in both
            .filter(similar.format(o="(least(x_at, y_at) + 1 + least(x_left, y_left))", a="x_n", b="y_n"))
            .select(F.least("x_c", "y_c").alias("a"), F.greatest("x_c", "y_c").alias("b"), F.least("x_left", "y_left").alias("left"))
            .groupBy("a", "b")
            .agg(F.count("*").alias("met"), F.min("left").alias("left"))
        )
        for end in ("a", "b"):
            met = met.join(info.select(F.col("c").alias(end), *[F.col(x).alias(f"{end}_{x}") for x in ("n", "rep")]), end)
        met = materialize(met.filter(similar.format(o="(met + left)", a="a_n", b="b_n")))
        both = met
        for end in ("a", "b"):
            both = both.join(ordered.select(F.col("c").alias(end), F.col("s.k").alias(f"{end}_s")), end)
        both = both.withColumn("o", F.size(F.array_intersect("a_s", "b_s")).cast("long")).drop("a_s", "b_s")
        both = materialize(both.filter(similar.format(o="o", a="a_n", b="b_n")))
        found = [
            both.join(members.select(F.col("c").alias(x), "id", "n"), x)
            .filter(similar.format(o="o", a="n", b=f"{y}_n"))
            .select(F.col("id").alias("src"), F.col(f"{y}_rep").alias("dst"))
            for x, y in (("a", "b"), ("b", "a"))
        ]
        # the next round: hot shingles only
        merged = hot.groupBy("s").agg(F.min("c").alias("to"), F.collect_list("c").alias("cs"))
        moved = merged.select("to", F.size("s").cast("long").alias("o"), F.explode("cs").alias("c"))
        members = materialize(
            members.join(moved, "c").filter(f"100 * o >= {percent} * n").select(F.col("to").alias("c"), "id", "n", "o")
        )
        reps = members.groupBy("c").agg(F.min(F.struct("n", "id")).alias("r"))
        found.append(members.join(reps, "c").filter("id != r.id").filter(similar.format(o="o", a="n", b="r.n")).select(F.col("id").alias("src"), F.col("r.id").alias("dst")))
        # between components one link is enough
        for f in found:
            for end in ("src", "dst"):
                f = f.join(part.select(F.col("node").alias(end), F.col("component").alias("into")), end, "left").withColumn(end, F.coalesce("into", end)).drop("into")
            new = new.unionByName(f.filter("src != dst").select("src", "dst").distinct())
        new = materialize(new)
        classes = materialize(merged.select(F.col("to").alias("c"), "s").join(members.select("c").distinct(), "c"))
        members = members.drop("o")
        rare *= RAISE
    return new


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` (node, component) after links (src, dst) between components or sets that have none yet."""
    step = connected_components(links).select(F.col("node").alias("__old"), F.col("component").alias("__new"))
    moved = label.join(step, F.col("component") == F.col("__old"), "left").select("node", F.coalesce("__new", "component").alias("component"))
    fresh = step.join(label.select("node"), F.col("__old") == F.col("node"), "left_anti").select(F.col("__old").alias("node"), F.col("__new").alias("component"))
    return materialize(moved.unionByName(fresh))


def _between(pairs: DataFrame, label: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``pairs`` whose ends are in different components, with these as ca and cb."""
    ends = pairs.join(label.select(F.col("node").alias(a), F.col("component").alias("ca")), a, "left")
    ends = ends.join(label.select(F.col("node").alias(b), F.col("component").alias("cb")), b, "left")
    return ends.withColumns({"ca": F.coalesce("ca", a), "cb": F.coalesce("cb", b)}).filter("ca != cb")


def _component_links(links: DataFrame, label: DataFrame) -> DataFrame:
    """Links as links between components, each once."""
    ends = _between(links, label, "src", "dst")
    return ends.select(F.least("ca", "cb").alias("src"), F.greatest("ca", "cb").alias("dst")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable) and kept."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    signed = materialize(_sign(docs, id_col, text_col, shingle))
    classes = materialize(
        signed.filter("n > 0 and id is not null").groupBy("h", "g", "minima").agg(F.min("id").alias("id"))
    )
    orders = _orders(classes, id_type).repartitionByRange(shuffle_partitions(spark), "key", "id").sortWithinPartitions("key", "id")
    near = materialize(_neighbours(orders, id_type))
    pairs = materialize(near.filter("b is not null").groupBy("a", "b").agg(F.max("agree").alias("agree")))
    sets = materialize(_sets(docs, pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), id_col, text_col, shingle))
    label = materialize(pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0))
    # each component's best candidate, round by round
    left = pairs
    for _ in range(ROUNDS):
        left = materialize(_between(left, label))
        ends = left.select(F.col("ca").alias("c"), "a", "b", "agree").union(left.select(F.col("cb").alias("c"), "a", "b", "agree"))
        best = materialize(ends.groupBy("c").agg(F.max(F.struct("agree", "a", "b")).alias("m")).select("m.a", "m.b").distinct())
        label = _merged(label, _component_links(_confirmed(best, sets, percent), label))
        left = left.join(best, ["a", "b"], "left_anti").select("a", "b", "agree")
    # then every candidate between components, and no others
    part = _merged(label, _component_links(_confirmed(_between(left, label).select("a", "b"), sets, percent), label))
    # then all pairs of the regions that the window cut short and that are not one component
    cut = near.filter("b is null").select("region", F.col("a").alias("id"))
    owner = F.coalesce("component", "id")
    several = cut.join(part, F.col("id") == F.col("node"), "left").groupBy("region").agg(F.min(owner).alias("lo"), F.max(owner).alias("hi")).filter("lo != hi")
    rest = materialize(cut.join(several, "region", "left_semi").select("id").distinct())
    if not rest.isEmpty():
        star = part.filter("node != component").select(F.col("node").alias("src"), F.col("component").alias("dst"))
        links = star.unionByName(_exact_links(_sets(docs, rest, id_col, text_col, shingle), star, percent))
        part = materialize(connected_components(links))
    reps = materialize(
        classes.select("h", "g", "id").join(part, F.col("id") == F.col("node"), "left").select("h", "g", F.coalesce("component", "id").alias("component_id"))
    )
    out = signed.select("id", "n", F.when(F.expr("n > 0 and id is not null"), F.col("h")).alias("h"), "g").join(reps, ["h", "g"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents of smallest id of each group, with the input's columns."""
    gone = near_duplicates(docs, id_col, text_col, shingle, percent).filter("not kept").select(F.col(id_col).alias("__m_id")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("__m_id"), "left_anti")


def op10(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)
