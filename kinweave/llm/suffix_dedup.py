"""Suffix-array dedup: remove every byte of a string of ``length`` bytes that starts anywhere else too.

1. Every place at which such a string may start goes to the place of the smallest k-gram hash within
   the string; equal strings choose equal k-grams at equal offsets. Runs of places with one choice are
   the unit of work: (k-gram, hash of the run's text). Runs with equal text are counted as one class
   before anything is shuffled on, so a thousand copies of a text cost one class and a count.
2. Equal strings of different classes have their k-gram at one offset, and share the bytes that all
   strings with the k-gram in this band of offsets have in common. Classes that share a band's bytes with
   another class of their k-gram, and classes that were seen more than once, fetch their text and are
   dealt to shards by the k-gram: the places of the shared bands, or all places of a class seen more than once.
3. A shard's texts are joined, each class once, and their suffixes sorted by external induced sorting
   (``kinweave.llm.induced``), on disk where they outgrow memory; neighbours that share ``length``
   bytes mark their places. A class carries its count, so places of one seen more than once are marked.
4. Marks return to all runs of the class and are merged for each document.

Scale: fingerprints take a few per cent of the input; only text that may repeat is shuffled, once for
each distinct run. A k-gram with more than ``HOT`` classes is split: its runs are cut by offset
and dealt by the hash of the bytes that all strings of a cut have in common, so a passage a third of
the corpus shares goes to many shards.

Defined edge cases: null and empty texts have no bytes, nothing to remove, and the hash of nothing;
rows that repeat a document (id and text) are separate texts and remove each other; ids may be null;
extra columns are ignored by ``repeated_spans`` and ``repeat_digest``; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm import wordhash as W
from kinweave.llm.induced import sort_suffixes
from kinweave.llm.workers import lean
from kinweave.session import materialize, shuffle_partitions, table

LENGTH = 400
GRAM = 32
#: Text of a shard; one that grows larger is sorted on disk.
SHARD_BYTES = 3 << 20
#: Bytes of tuples that a shard's queues hold before they go to disk.
QUEUE_BYTES = 48 << 20
HOT = 2048
CUT = 64
#: Bands of offsets; 16 bits of each make one number.
BANDS = 4
_LOW = np.uint64((1 << 26) - 1)
#: 128 bits that stand for a row's id and text.
KEYS = ["xxhash64(__s_id, __s_text) as k1", "xxhash64(1, __s_text, __s_id, 2) as k2"]


def _bands(length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest offset of the k-gram in its string, by band; a band without offsets ends before it begins."""
    step = -(-(length - gram + 1) // BANDS)
    low = np.arange(BANDS) * step
    return low, np.minimum(low + step - 1, length - gram)


def choices(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place at which a string may start: the place of its chosen k-gram; all k-gram hashes; prefix sums."""
    n = len(data)
    up, down = W._powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(W._BYTE[data] * up[:n], out=sums[1:])
    h = W.mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    # smallest hash, the rightmost of equal ones; places are told apart below a text's 64 million bytes
    m, w = len(h), length - gram + 1
    key = (h & ~_LOW) | (_LOW - (np.arange(m, dtype=np.uint64) & _LOW))
    rows = -(-m // w)
    padded = np.full(rows * w, np.uint64(2**64 - 1))
    padded[:m] = key
    padded = padded.reshape(rows, w)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[: m - w + 1], left[w - 1 : m])
    low = (_LOW - (least & _LOW)).astype(np.int64)
    # the low bits name the place modulo 2**26, and it lies within the string
    start = np.arange(m - w + 1)
    return start + ((low - start) & int(_LOW)), h, sums


def _band_hashes(sums: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """For each place of a k-gram 16 bits for each band: the bytes that all strings of the band have in common.

    Of a band in which a run has no string they mean nothing and are not looked at.
    """
    n = len(sums) - 1
    a, b = np.clip(place[:, None] - low, 0, n), np.clip(place[:, None] + (length - high), 0, n)
    found = W.mix((sums[b] - sums[a]) * W._powers(n)[1][a]) >> np.uint64(48)
    return found.astype("<u2").view("<i8").ravel()


def _runs(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(k1, k2, start, size, shift, f, c, b): runs of places, their k-gram, the hash of their text and those of their bands."""
    low, high = _bands(length, gram)

    def run(batches):
        for batch in batches:
            raw, off = W.buffers(batch.column(0))
            for a, b in W.blocks(off):
                out = {x: [] for x in ("row", "start", "size", "shift", "f", "c", "b")}
                for i in range(a, b):
                    data = raw[off[i] : off[i + 1]]
                    if len(data) < length:
                        continue
                    at, h, sums = choices(data, length, gram)
                    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                    size = np.diff(np.append(start, len(at)))
                    whole = data.tobytes()
                    out["row"].append(np.full(len(start), i))
                    out["start"].append(start)
                    out["size"].append(size)
                    out["shift"].append(at[start] - start)
                    out["f"].append(h[at[start]].view(np.int64))
                    out["b"].append(_band_hashes(sums, at[start], low, high, length))
                    out["c"].append(np.array([xxhash.xxh3_64_intdigest(whole[s : s + z + length - 1]) for s, z in zip(start.tolist(), size.tolist(), strict=True)], np.uint64).view(np.int64))
                if out["row"]:
                    c = {k: np.concatenate(v).astype(np.int64) for k, v in out.items()}
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(1).take(pa.array(c["row"])), batch.column(2).take(pa.array(c["row"])), *[pa.array(c[k]) for k in ("start", "size", "shift", "f", "c", "b")]],
                        names=["k1", "k2", "start", "size", "shift", "f", "c", "b"],
                    )

    return rows.select("__s_text", "k1", "k2").mapInArrow(lean(run), "k1 long, k2 long, start long, size long, shift long, f long, c long, b long")


def _wanted(known: DataFrame, length: int, gram: int) -> DataFrame:
    """(f, c, k1, k2, start, begin, end, shift, n, hot): classes whose strings may stand elsewhere, and their places [begin, end)."""
    low, high = (x.tolist() for x in _bands(length, gram))
    bands = F.array(*[
        F.expr(f"if(shift >= {a} and shift - size < {b}, struct({j} as j, shiftrightunsigned(b, {16 * j}) & 65535 as v, {a} as low, {b} as high), null)")
        for j, (a, b) in enumerate(zip(low, high, strict=True))
        if a <= b
    ])
    known = known.withColumn("bands", F.filter(bands, lambda x: x.isNotNull()))
    # bands that no other class of the k-gram shares, as bits; what many share is counted and goes nowhere
    alone = (
        known.filter("kinds > 1").select("f", "c", F.explode("bands").alias("x")).groupBy("f", "x.j", "x.v").agg(F.count("*").alias("m"), F.min("c").alias("c"))
        .filter("m = 1").groupBy("f", "c").agg(F.sum(F.expr("shiftleft(1, j)")).alias("alone"))
    )
    shared = known.join(alone, ["f", "c"], "left").withColumn("shared", F.expr("filter(bands, x -> (coalesce(alone, 0) & shiftleft(1, x.j)) = 0)"))
    return shared.filter("n > 1 or size(shared) > 0").selectExpr(
        "f", "c", "k1", "k2", "start", "if(n > 1, 0, greatest(0, shift - shared[size(shared) - 1].high)) as begin",
        "if(n > 1, size, least(size, shift - shared[0].low + 1)) as end", "shift", "n", "hot",
    )


def _pieces(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(shard key, f, c, base, again, text) of every class; hot k-grams cut by offset."""
    by_text = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("f", "c", "start", "begin", "end", "shift", "n", "hot")).alias("w"))
    texts = rows.dropDuplicates(["k1", "k2"]).join(by_text, ["k1", "k2"])

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                whole = memoryview((batch.column(0)[at].as_py() or "").encode())
                key, f, c, base, again, text = [], [], [], [], [], []
                for w in batch.column(1)[at].as_py():
                    s, y, z = w["start"], w["begin"], w["end"]
                    if not w["hot"]:
                        cuts = [(y, z)]
                    else:  # by distance to the k-gram, which equal strings share
                        edges = [e for e in range(y + 1, z) if (w["shift"] - e) % CUT == CUT - 1]
                        cuts = list(zip([y, *edges], [*edges, z], strict=True))
                    for a, b in cuts:
                        piece = whole[s + a : s + b + length - 1]
                        k = w["f"]
                        if w["hot"]:
                            # bytes that all strings of a full cut hold, at a fixed distance to the k-gram
                            block = (w["shift"] - a) // CUT
                            low = s + w["shift"] - block * CUT
                            k = xxhash.xxh3_64_intdigest(bytes(whole[low : low + length - CUT + 1]), seed=block & 0xFFFF) ^ (k & 0xFFFFFFFFFFFFFFFF)
                            k -= (k >> 63) << 64
                        key.append(k)
                        f.append(w["f"])
                        c.append(w["c"])
                        base.append(a)
                        again.append(w["n"] > 1)
                        text.append(bytes(piece))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), pa.array(f, pa.int64()), pa.array(c, pa.int64()), pa.array(base, pa.int64()), pa.array(again, pa.bool_()), pa.array(text, pa.binary())],
                    names=["key", "f", "c", "base", "again", "text"],
                )

    return texts.select("__s_text", "w").mapInArrow(lean(run), "key long, f long, c long, base long, again boolean, text binary")


def _marks(pieces: DataFrame, length: int, queue_bytes: int) -> DataFrame:
    """(f, c, begin, end): places of each class, from its start, whose string stands elsewhere."""

    def run(batches):
        with tempfile.TemporaryDirectory(prefix="shard-") as work:
            # the shard's text goes to disk as it comes: bytes as 2.., 1 between pieces, 0 at the end
            n, starts, sizes, names, known = 0, [], [], [], []
            with open(f"{work}/text", "wb") as out:
                for batch in batches:
                    for f, c, base, again, text in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                        out.write((np.frombuffer(text, np.uint8).astype(np.uint16) + 2).tobytes() + b"\x01\x00")
                        starts.append(n)
                        sizes.append(len(text))
                        names.append((f, c, base))
                        if again:
                            known.append(len(names) - 1)
                        n += len(text) + 1
                out.write(b"\x00\x00")
            if not names:
                return
            if n + 1 <= 1 << 24:
                string = np.fromfile(f"{work}/text", dtype=np.uint16)
            else:
                string = np.memmap(f"{work}/text", dtype=np.uint16, mode="r")
            marked = np.zeros(n + 1, dtype=bool) if n < 1 << 28 else np.memmap(f"{work}/marked", dtype=bool, mode="w+", shape=n + 1)
            for i in known:
                marked[starts[i] : starts[i] + sizes[i] - length + 1] = True
            last = -1

            def emit(places, prefix):
                nonlocal last
                deep = prefix >= length
                marked[places[deep]] = True
                before = np.flatnonzero(deep)
                if len(before) and before[0] == 0:
                    marked[last] = True
                    before = before[1:]
                marked[places[before - 1]] = True
                last = int(places[-1])

            sort_suffixes(string, 258, length, f"{work}/sort", queue_bytes, emit)
            out = []
            for at, size, (f, c, base) in zip(starts, sizes, names, strict=True):
                # only places whose string lies within the piece
                here = marked[at : at + size - length + 1]
                if here.any():
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], here, [False]]).view(np.int8)))
                    out += [(f, c, x + base, y + base) for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
            del string, marked
            for k in range(0, len(out), 20_000):
                part = list(zip(*out[k : k + 20_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in part], names=["f", "c", "begin", "end"])

    return pieces.select("f", "c", "base", "again", "text").mapInArrow(lean(run), "f long, c long, begin long, end long")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
                   shard_bytes: int = SHARD_BYTES, queue_bytes: int = QUEUE_BYTES, hot: int = HOT) -> DataFrame:
    """Per row: id, text and ``spans``, the byte ranges [begin, end) to remove, ascending by begin."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("__s_id"), F.col(text_col).alias("__s_text")).selectExpr("__s_id", "__s_text", *KEYS)
    runs = materialize(_runs(rows, length, gram))
    classes = materialize(
        runs.groupBy("f", "c").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "start")).alias("m"), F.first("size").alias("size"), F.first("shift").alias("shift"), F.first("b").alias("b"))
        .select("f", "c", "n", "m.k1", "m.k2", "m.start", "size", "shift", "b")
    )
    grams = materialize(classes.groupBy("f").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).filter("total >= 2").drop("total"))
    known = materialize(classes.join(grams, "f").withColumn("hot", F.col("kinds") > hot))
    wanted = materialize(_wanted(known, length, gram))
    size = wanted.agg(F.sum(F.expr(f"end - begin + {length}"))).first()[0] or 0
    shards = max(shuffle_partitions(spark), -(-size // shard_bytes))
    pieces = _pieces(rows, wanted, length).repartition(shards, "key")
    marks = materialize(_marks(pieces, length, queue_bytes))
    by_class = marks.groupBy("f", "c").agg(F.collect_list(F.struct("begin", "end")).alias("marks"))
    spans = (
        runs.select("k1", "k2", "start", "f", "c")
        .join(materialize(by_class), ["f", "c"])
        .select("k1", "k2", F.expr(f"transform(marks, m -> struct(start + m.begin as b, start + m.end - 1 + {length} as e))").alias("s"))
        .groupBy("k1", "k2")
        .agg(F.flatten(F.collect_list("s")).alias("s"))
    )
    joined = rows.join(spans, ["k1", "k2"], "left")
    return joined.select(F.col("__s_id").alias(id_col), F.col("__s_text").alias(text_col), F.expr("coalesce(array_sort(s), array())").alias("spans"))


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed and the number of removed runs; spans ascend and may overlap."""
    kept, reach, removed, count = [], 0, 0, 0
    for b, e in spans:
        if b > reach or not count:
            kept.append(text[reach:b])
            count += 1
            removed += e - b
            reach = e
        elif e > reach:
            removed += e - reach
            reach = e
    kept.append(text[reach:])
    return b"".join(kept), removed, count


def repeat_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans and the hash of the remaining bytes."""
    found = repeated_spans(docs, id_col, text_col, **options)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                data = (text.as_py() or "").encode()
                kept, removed, count = cut_spans(data, [(x["b"], x["e"]) for x in spans.as_py()])
                out.append((len(data), removed, count, hashlib.sha256(kept).hexdigest()))
            n, r, c, h = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(c, pa.int64()), pa.array(h, pa.string())],
                names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return found.mapInArrow(lean(run), f"`{id_col}` {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op2(spark, sf_dir):
    return repeat_digest(table(spark, sf_dir, "documents"))
