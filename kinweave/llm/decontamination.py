"""Benchmark decontamination by winnowing.

Both sides keep the smallest k-gram hash of every window of k-grams. A window of ``span`` words is
exactly one window of k-grams, so any span of that many shared words has a fingerprint in common, chosen
by both sides. Fingerprints of documents and items are joined; each hit is extended word by word to both
sides, as far as a window reaches, and runs of ``span`` words or more count. Longer shared passages are the
union of the runs of their fingerprints, as each of their windows has one. Items shorter than ``span``
words are one window of their own length, looked up whole.

Scale: documents are scanned once, whatever the size of the benchmark. A bitmap of the benchmark's
fingerprints, of at most ``BITMAP_BITS`` bits, is all that is broadcast: it keeps most documents' fingerprints out
of the join, which is an ordinary one, so a hot passage is split by the skew join. Equal passages of many
items are one class in the join and meet their items afterwards, once for each document.

Defined edge cases: null and empty texts (either side) have no words and no hits; items with a null
id are left out, items that share an id count once; repeated documents each get their row; ids may
be null; texts of any length are read whole; extra columns of either table, whatever their names, are ignored by
``contamination`` and kept by ``remove_contaminated``; an empty benchmark hits nothing, an empty corpus gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm import wordhash as W
from kinweave.session import materialize, table

SPAN = 10
GRAM = 5
#: Bound of the broadcast bitmap; a larger benchmark only lets more fingerprints through to the join.
BITMAP_BITS = 1 << 25
#: Bits for each fingerprint below that bound.
BITS_EACH = 32
_PRINT = "struct<h:bigint,n:int,places:array<bigint>,left:array<bigint>,gram:array<bigint>,right:array<bigint>>"


def winnowed(hashes: np.ndarray, text: np.ndarray, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions and hashes of the k-grams that are smallest in some window within a text."""
    window = span - k + 1
    g = W.grams(hashes, k)
    n = len(g) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = g[:n].copy()
    for j in range(1, window):
        np.minimum(least, g[j : j + n], out=least)
    whole = text[:n] == text[span - 1 : span - 1 + n]
    taken = np.zeros(len(g), dtype=bool)
    for j in range(window):
        taken[j : j + n] |= whole & (g[j : j + n] == least)
    at = np.flatnonzero(taken)
    return at, g[at]


class Fingerprints:
    """Fingerprints of a block's texts: k-grams of windows with the words around them, and whole short texts."""

    def __init__(self, words: W.Words, span: int, k: int):
        self.words, self.span, self.k = words, span, k
        self.signed = words.hashes.view(np.int64)

    def long(self, keep=None):
        """(text, place, hash, words before from the nearest on, the k words, words after) of the windows' k-grams."""
        w, reach = self.words, self.span - self.k
        at, h = winnowed(w.hashes, w.text, self.k, self.span)
        if keep is not None:
            near = keep(h)
            at, h = at[near], h[near]
        for p, x in zip(at.tolist(), h.view(np.int64).tolist(), strict=True):
            doc = int(w.text[p])
            first, end = int(w.first[doc]), int(w.first[doc + 1])
            yield doc, p - first, x, self.signed[max(first, p - reach) : p][::-1].tolist(), self.signed[p : p + self.k].tolist(), self.signed[p + self.k : min(end, p + self.k + reach)].tolist()

    def short(self, n: int, keep):
        """(text, places, hash) of the n-grams that ``keep`` lets pass, each once for a text."""
        w = self.words
        g = W.grams(w.hashes, n)
        if not len(g):
            return
        at = np.flatnonzero((w.text[: len(g)] == w.text[n - 1 :]) & keep(g))
        order = at[np.lexsort((at, g[at], w.text[at]))]
        new = np.flatnonzero(np.concatenate([[True], (g[order][1:] != g[order][:-1]) | (w.text[order][1:] != w.text[order][:-1])])) if len(order) else []
        for places in np.split(order, new[1:]) if len(order) else []:
            doc = int(w.text[places[0]])
            yield doc, (places - int(w.first[doc])).tolist(), int(g[places[:1]].view(np.int64)[0])


def _prints(items: DataFrame, span: int, k: int) -> DataFrame:
    """(item, f): fingerprints of the benchmark."""

    def run(batches):
        for batch in batches:
            raw, offsets = W.buffers(batch.column(1))
            names = batch.column(0).to_pylist()
            for a, b in W.blocks(offsets):
                words = W.Words(raw, offsets[a : b + 1], W.ALNUM)
                sizes = np.diff(words.first)
                out = [(names[a + i], {"h": h, "n": 0, "places": [p], "left": x, "gram": g, "right": y}) for i, p, h, x, g, y in Fingerprints(words, span, k).long()]
                for i in np.flatnonzero((sizes > 0) & (sizes < span)).tolist():
                    h = W.grams(words.hashes[words.first[i] : words.first[i + 1]], int(sizes[i])).view(np.int64)[0]
                    out.append((names[a + i], {"h": int(h), "n": int(sizes[i]), "places": [0], "left": [], "gram": [], "right": []}))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.string()), pa.array([f for _, f in out], _arrow_print())], names=["item", "f"])

    return items.mapInArrow(run, f"item string, f {_PRINT}")


def _arrow_print() -> pa.DataType:
    long = pa.list_(pa.int64())
    return pa.struct([("h", pa.int64()), ("n", pa.int32()), ("places", long), ("left", long), ("gram", long), ("right", long)])


def _bitmap(prints: DataFrame, bits: int) -> np.ndarray:
    """Which hashes modulo ``bits`` the benchmark has; words of 64 bits are put together before they are collected."""
    bit = F.expr(f"h & {bits - 1}L")
    words = prints.select(F.expr("f.h as h")).select(F.shiftright(bit, 6).alias("w"), F.expr(f"shiftleft(1L, cast((h & {bits - 1}L) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    found = words.toArrow()
    out = np.zeros(max(bits // 64, 1), np.uint64)
    out[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return out


def _scan(docs: DataFrame, bitmap, lengths: list[int], span: int, k: int) -> DataFrame:
    """Per row: n_words and the fingerprints that the bitmap lets pass."""
    id_type = docs.schema["__d_id"].dataType.simpleString()

    def run(batches):
        bits = bitmap.value
        mask = np.uint64(len(bits) * 64 - 1)

        def keep(h: np.ndarray) -> np.ndarray:
            at = h & mask
            return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

        for batch in batches:
            raw, offsets = W.buffers(batch.column(3))
            for a, b in W.blocks(offsets):
                words = W.Words(raw, offsets[a : b + 1], W.ALNUM)
                f = Fingerprints(words, span, k)
                found = [[] for _ in range(b - a)]
                for i, p, h, x, g, y in f.long(keep):
                    found[i].append({"h": h, "n": 0, "places": [p], "left": x, "gram": g, "right": y})
                for n in lengths:
                    for i, places, h in f.short(n, keep):
                        found[i].append({"h": h, "n": n, "places": places, "left": [], "gram": [], "right": []})
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(a, b - a) for c in range(3)], pa.array(np.diff(words.first).astype(np.int64)), pa.array(found, pa.list_(_arrow_print()))],
                    names=["__d_id", "k1", "k2", "n_words", "f"],
                )

    return docs.mapInArrow(run, f"__d_id {id_type}, k1 long, k2 long, n_words long, f array<{_PRINT}>")


def _common(a: str, b: str) -> str:
    """SQL for the number of equal elements at the beginning of two lists."""
    least = f"least(size({a}), size({b}))"
    first = f"array_position(zip_with(slice({a}, 1, {least}), slice({b}, 1, {least}), (x, y) -> x = y), false)"
    return f"if({first} = 0, {least}, {first} - 1)"


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", span: int = SPAN, gram: int = GRAM, bitmap_bits: int = BITMAP_BITS,
) -> DataFrame:
    """Per document: id, n_words, hit runs of words and the ids (strings) of the items found."""
    spark = docs.sparkSession
    items = benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).alias("t"))
    raw = materialize(_prints(items, span, gram))
    kinds = {r.n: r.c for r in raw.groupBy("f.n").agg(F.count("*").alias("c")).collect()}  # at most ``span`` rows
    lengths = sorted(n for n in kinds if n)
    wanted = max(64, BITS_EACH * sum(kinds.values()))
    bitmap = spark.sparkContext.broadcast(_bitmap(raw, min(bitmap_bits, 1 << (wanted - 1).bit_length())))
    # equal passages of several items are one class
    classes = materialize(raw.groupBy("f.h", "f.n", "f.left", "f.gram", "f.right").agg(F.collect_set("item").alias("items")))
    keyed = ["xxhash64(__d_id, __d_text) as k1", "xxhash64(1, __d_text, __d_id, 2) as k2"]
    rows = docs.select(F.col(id_col).alias("__d_id"), F.col(text_col).alias("__d_text")).selectExpr("__d_id", *keyed, "__d_text")
    scanned = materialize(_scan(rows, bitmap, lengths, span, gram))
    asked = scanned.filter("size(f) > 0").dropDuplicates(["k1", "k2"]).select("k1", "k2", F.explode("f").alias("f")).select("k1", "k2", *[F.col(f"f.{c}").alias(f"d_{c}") for c in ("h", "n", "places", "left", "gram", "right")])
    members = classes.withColumn("class", F.expr("xxhash64(h, n, left, gram, right)")).withColumn("class2", F.expr("xxhash64(right, gram, left, n, h, 1)"))
    met = asked.join(members.select("h", "n", "left", "gram", "right", "class", "class2"), (F.col("d_h") == F.col("h")) & (F.col("d_n") == F.col("n")))
    before, after = _common("d_left", "left"), _common("d_right", "right")
    met = met.select("k1", "k2", "class", "class2", "d_places", "n", F.expr(f"if(n > 0, 0, {before})").alias("l"), F.expr(f"if(n > 0, n, {gram} + {after})").alias("r"), F.expr("d_gram = gram").alias("same"))
    hits = materialize(
        met.filter(f"same and (n > 0 or l + r >= {span})")
        .select("k1", "k2", "class", "class2", F.expr("transform(d_places, p -> array(p - l, p + r))").alias("runs"))
    )
    runs = hits.groupBy("k1", "k2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("runs")))).alias("__h_runs"))
    found = hits.select("k1", "k2", "class", "class2").distinct().join(members.select("class", "class2", F.explode("items").alias("item")), ["class", "class2"]).select("k1", "k2", "item").distinct()
    named = found.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("item")).alias("__h_items"))
    both = runs.join(named, ["k1", "k2"]).withColumnsRenamed({"k1": "__h1", "k2": "__h2"})
    out = scanned.select("__d_id", "k1", "k2", "n_words").join(both, (F.col("k1") == F.col("__h1")) & (F.col("k2") == F.col("__h2")), "left")
    return out.select(
        F.col("__d_id").alias(id_col), "n_words", F.expr("coalesce(__h_runs, cast(array() as array<array<bigint>>))").alias("runs"), F.expr("coalesce(__h_items, cast(array() as array<string>))").alias("items")
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no window of any item; rows with a null id are kept only if clean themselves."""
    dirty = contamination(docs, benchmark, id_col, text_col, **options).filter("size(items) > 0").select(F.col(id_col).alias("__d_id")).distinct()
    return docs.join(dirty, F.col(id_col).eqNullSafe(F.col("__d_id")), "left_anti")


def op1(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    none = hashlib.sha256(b"").hexdigest()
    hit = F.size("items") > 0
    return found.select(
        "doc_id",
        "n_words",
        F.expr(
            """aggregate(array_sort(runs), struct(0L as total, 0L as reach), (s, r) -> struct(
                s.total + greatest(0L, r[1] - greatest(r[0], s.reach)) as total, greatest(s.reach, r[1]) as reach)).total"""
        ).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.when(hit, F.sha2(F.array_join(F.sort_array("items"), ","), 256)).otherwise(none).alias("items_sha256"),
        hit.alias("contaminated"),
    )


ORACLE = f"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
bl as (select item_id, w, least(len(w), {SPAN}) as n from b where len(w) > 0),
bp as (select item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from bl),
bw as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as g from bp),
ns as (select distinct n from bw),
dp as (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, ns where len(w) >= n),
dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as g from dp),
h as (select distinct doc_id, n, i, item_id from dw join bw using (n, g)),
p as (select doc_id, unnest(generate_series(i, i + n - 1)) as x from (select distinct doc_id, n, i from h) as q),
pc as (select doc_id, count(distinct x) as n_hit from p group by doc_id),
ic as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as ids from (select distinct doc_id, cast(item_id as varchar) as s from h) as q group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pc using (doc_id) left join ic using (doc_id)"""
