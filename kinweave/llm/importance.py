"""Quality classifier: importance resampling with hashed n-gram models.

The target model counts hashed words and word pairs of labelled good text, the raw model those of
all documents. A document's log importance is the sum, over its n-grams, of the log ratio of the two;
a sample without replacement proportional to importance is drawn by adding Gumbel noise to
the log importance and keeping the top k. Noise comes from a hash of id, text and seed, so a
rerun of a lost task draws the same.

The log importance of a document is a sum over its n-grams, so a long document's would be a hundred times
a short one's, and long documents alone would decide the sample. It is therefore taken as that of ``LENGTH`` n-grams
of the document: the mean times ``LENGTH``. The noise has the scale of one unit of log importance, as the
method says; a larger ``LENGTH`` makes the draw sharper. k is a share of the documents that have words (the
sampling feature itself); without one from the caller it is the share of good ones among the labelled rows.

Scale: counts are summed from one table of ``BUCKETS`` numbers per task and side; the raw model sees
all documents, the target model at most ``TARGET_ROWS`` labelled rows (a documented bound: those of
smallest hash of the id). The k-th largest key is found by refining histograms, never by a sort in
one task; of rows that tie at the boundary, those of smaller hash are taken, so that k rows are kept exactly.

Defined edge cases: null and empty texts have importance 0, no key, and are not kept; null labels
count as not good, a document labelled more than once counts by its highest label; without target
text all documents are equally important; repeated rows draw the same noise, and if the boundary falls among
them as many are kept as k allows; a text of any length is read whole; null ids are allowed; extra columns are ignored by ``importance`` and kept
by ``resample``; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm import wordhash as W
from kinweave.session import materialize, table

BUCKETS = 1 << 16
TARGET_ROWS = 20_000
LENGTH = 400
SEED = 17
SMOOTH = 1.0
BINS = 4096


def _grams(words: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs of a block, and the texts they belong to."""
    pairs = W.grams(words.hashes, 2)
    inside = words.text[: len(pairs)] == words.text[1:] if len(pairs) else np.zeros(0, bool)
    both = np.concatenate([words.hashes, pairs[inside]])
    return (both % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([words.text, words.text[: len(inside)][inside]])


def gram_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """Bucket counts over all texts."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            raw, off = W.buffers(batch.column(0))
            for a, b in W.blocks(off):
                total += np.bincount(_grams(W.Words(raw, off[a : b + 1], W.NOT_SPACE))[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(BUCKETS)
    for r in docs.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def target_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    good = (
        labels.filter(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("__i_id"))
        .agg(F.max(label_col).alias("__i_good"))
        .filter("__i_good > 0")
        .orderBy(F.xxhash64("__i_id"), "__i_id")
        .limit(rows)
    )
    return docs.join(F.broadcast(good), F.col(id_col) == F.col("__i_id"), "left_semi")


def importance(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
               target_rows: int = TARGET_ROWS, seed: int = SEED) -> DataFrame:
    """Per row: id, n_grams, log_ratio (mean over the n-grams) and the Gumbel key (null without n-grams)."""
    raw = gram_counts(docs, text_col) + SMOOTH
    target = gram_counts(target_texts(docs, labels, id_col, text_col, label_col, target_rows), text_col)
    # smoothed towards the raw model, so an n-gram the bounded target never shows is only less likely
    strength = 0.05 * target.sum() + 1.0
    ratio = np.log((target + strength * raw / raw.sum()) / (target.sum() + strength)) - np.log(raw / raw.sum())
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        weight = shared.value
        for batch in batches:
            raw_bytes, off = W.buffers(batch.column(2))
            for a, b in W.blocks(off):
                buckets, text = _grams(W.Words(raw_bytes, off[a : b + 1], W.NOT_SPACE))
                n = np.bincount(text, minlength=b - a)
                total = np.bincount(text, weights=weight[buckets], minlength=b - a)
                mean = total / np.maximum(n, 1)
                u = W.mix(batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                noise = -np.log(-np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53))
                key = mean * LENGTH + noise
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(mean), pa.array(key, mask=n == 0), pa.array(u.view(np.int64))],
                    names=["id", "n_grams", "log_ratio", "gumbel_key", "tie"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"), text_col)
    return rows.mapInArrow(run, f"id {id_type}, n_grams long, log_ratio double, gumbel_key double, tie long")


def kth_largest(rows: DataFrame, key: str, k: int) -> float | None:
    """The k-th largest key, by histograms of ``BINS`` bins refined until one value is left."""
    b = rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    if b.lo is None or k <= 0:
        return None
    lo, hi, left = b.lo, b.hi, k
    while lo < hi:
        width = (hi - lo) / BINS
        if not width > 0 or lo + width == lo:
            break
        inside = rows.filter(F.col(key).between(lo, hi))
        bins = (
            inside.groupBy(F.least(F.lit(BINS - 1), F.floor((F.col(key) - lo) / width)).alias("b"))
            .agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))
            .orderBy(F.desc("b"))
            .collect()
        )
        for r in bins:
            if left <= r.n:
                break
            left -= r.n
        if (r.lo, r.hi) == (lo, hi):
            break
        lo, hi = r.lo, r.hi
    return lo


def good_share(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> float:
    """Share of good documents among the labelled ones, a document counted once by its highest label; 1 without labels."""
    marked = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("q"))
    got = marked.agg(F.avg((F.col("q") > 0).cast("double"))).first()[0]
    return 1.0 if got is None else got


def select_top(rows: DataFrame, share: float) -> DataFrame:
    """``rows`` with ``kept``: the top share by Gumbel key among rows that have one, exactly so many rows.

    ``rows`` is read several times and must be a written table. Ties go by their hash, then by their place in it.
    """
    n = rows.filter("gumbel_key is not null").count()
    k = min(n, -(-int(round(n * share * 1e6)) // 10**6))
    least = kth_largest(rows, "gumbel_key", k)
    if least is None:
        return rows.withColumn("kept", F.lit(False))
    at = F.coalesce(F.col("gumbel_key") == least, F.lit(False))
    left = k - rows.filter(F.col("gumbel_key") > least).count()
    if rows.filter(at).count() == left:
        return rows.withColumn("kept", F.coalesce(F.col("gumbel_key") >= least, F.lit(False)))
    parts = [rows.filter(~at).withColumn("kept", F.coalesce(F.col("gumbel_key") > least, F.lit(False)))]
    # 52 bits of the hash, then the place in the table, as numbers that a double holds exactly
    tied = materialize(rows.filter(at).withColumns({"__h": F.shiftrightunsigned("tie", 12).cast("double"), "__p": F.monotonically_increasing_id().cast("double")}))
    for by in ("__h", "__p"):
        edge = kth_largest(tied, by, left)
        parts.append(tied.filter(F.col(by) != edge).withColumn("kept", F.col(by) > edge))
        left -= tied.filter(F.col(by) > edge).count()
        tied = materialize(tied.filter(F.col(by) == edge))
        if tied.count() == left:
            break
    parts.append(tied.withColumn("kept", F.lit(True)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part.drop("__h", "__p"))
    return out


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float | None = None, **options) -> DataFrame:
    """The sampled documents with the input's columns; documents that share an id are kept if one of them is."""
    share = good_share(labels, id_col) if share is None else share
    chosen = select_top(materialize(importance(docs, labels, id_col, text_col, **options)), share).filter("kept").select(F.col("id").alias("__i_id")).distinct()
    return docs.join(chosen, F.col(id_col).eqNullSafe(F.col("__i_id")), "left_semi")


def op7(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    rows = materialize(importance(table(spark, sf_dir, "documents"), labels))
    return select_top(rows, good_share(labels)).select(F.col("id").alias("doc_id"), "n_grams", "log_ratio", "gumbel_key", "kept")
