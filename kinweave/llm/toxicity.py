"""Toxicity by noisy-channel deobfuscation.

Suspicious strings (digits or symbols between letters, runs of one letter, letters spaced out) become
character lattices: each place may be read as it stands, as the letter that leetspeak puts there, a
run as one or two letters, a separator as nothing. Viterbi search under a character trigram model,
a mixture of the corpus and of the words the training rows mark, takes the likeliest reading, and
the restored text is scored.

The score is a logistic function of a document's word weights. A word's weight is the log ratio of
its rates in toxic and other training rows, the best of the whole word and of its beginnings;
for the fit of the logistic function each training row's own words are taken out of the counts first.

Scale: the trigram counts cover all documents and are summed from one partial table per task, at most
``len(ALPHABET) ** 3`` rows. The classifier is fitted on at most ``TRAIN_ROWS`` labelled rows (a
documented bound, the rows of smallest hash of the id) and has at most ``MODEL_WORDS`` entries, so
what is broadcast has a proven size. Texts are scored where they are read; nothing is shuffled.

Defined edge cases: null and empty texts have no words and get the score of a text without
evidence; labels that are null are left out, a document labelled more than once counts by its highest label; without
a toxic and another training row all scores are 0; ids may be null (they are held in) or repeated,
each row is scored by itself; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.chunks import chunk_codes
from kinweave.llm.wordhash import blocks, buffers
from kinweave.session import materialize, table

TRAIN_ROWS = 20_000
MODEL_WORDS = 50_000
THRESHOLD = 0.7
BLOCK_BYTES = 4 << 20
SMOOTH = 0.5
LEAST_WEIGHT = 1.0
BEGINNINGS = (4, 5, 6, 7)
#: Readings kept at a time: of suspicious strings, and of chunks, most of which are a number only.
CACHE = 200_000
CHUNKS = 600_000
#: Strings up to so many characters are kept in the caches; longer ones are read each time.
KNOWN_CHARS = 128
#: Evidence counts up to so many standard deviations.
REACH = 6.0
#: A toxic training row counts as so many: a missed one costs more than a false alarm.
TOXIC_TIMES = 2.0

#: Letters of the model; others share one class, anything else is the boundary (0).
ALPHABET = "\x00abcdefghijklmnopqrstuvwxyzßàáâäãçèéêëìíîïñòóôöõùúûüœ\x01"
#: What leetspeak may mean.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l",
}
LEET_COST, REPEAT_COST, SPACE_COST, KEEP_COST = 1.0, 1.0, 0.3, 3.0

_CODE = {c: i for i, c in enumerate(ALPHABET)}
_WORD = regex.compile(r"\p{L}+")
_ODD = regex.compile(r"\p{L}[0-9@$!|+€£]+\p{L}|(\p{L})\1\1|(?<!\w)(?:[\p{L}0-9@$!|][.\-_*·]){2,}[\p{L}0-9@$!|](?!\w)|^[0-9@$!|+€£]+\p{L}+$|\p{L}[0-9@$€£]+(?![\w@$€£])")


def _code(c: str) -> int:
    return _CODE.get(c) or (len(ALPHABET) - 1 if c.isalpha() else 0)


def trigram_counts(texts: list[str], times: np.ndarray) -> np.ndarray:
    """Counts of class trigrams of the texts, each padded with boundaries and counted ``times`` times."""
    n = len(ALPHABET)
    joined = "\x00\x00".join(["", *texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    distinct, place = np.unique(points, return_inverse=True)
    classes = np.array([_code(chr(p)) for p in distinct], dtype=np.int64)[place]
    weight = np.repeat(times, [len(t) + 2 for t in texts])
    weight = np.concatenate([weight, np.zeros(len(points) - len(weight), weight.dtype)]) if len(points) > len(weight) else weight[: len(points)]
    codes = (classes[:-2] * n + classes[1:-1]) * n + classes[2:]
    # boundary, boundary, letter opens a word; boundary runs say nothing
    use = (classes[1:-1] != 0) | (classes[2:] != 0)
    return np.bincount(codes[use], weights=weight[: len(codes)][use], minlength=n**3)


def _log_model(counts: np.ndarray) -> np.ndarray:
    """Smoothed conditional probabilities of the third class after two."""
    n = len(ALPHABET)
    c3 = counts.reshape(n, n, n)
    uni = (c3.sum(axis=(0, 1)) + 0.1) / (c3.sum() + 0.1 * n)
    c2 = c3.sum(axis=0)
    bi = (c2 + 5 * uni) / (c2.sum(axis=1, keepdims=True) + 5)
    return (c3 + 5 * bi) / (c3.sum(axis=2, keepdims=True) + 5)


class Restorer:
    """Viterbi decoder of character lattices."""

    def __init__(self, corpus: np.ndarray, marked: np.ndarray | None = None):
        p = _log_model(corpus)
        if marked is not None and marked.any():
            p = 0.5 * p + 0.5 * _log_model(marked)
        self.cost = -np.log(p)
        self.known: dict[str, str] = {}

    @staticmethod
    def arcs(text: str) -> list[list[tuple[str, int, float]]]:
        """From each place: (what is read, next place, channel cost)."""
        spaced = bool(regex.fullmatch(r"(?:\S[ .\-_*·])+\S", text))
        ends = list(range(1, len(text) + 1))
        for i in range(len(text) - 2, -1, -1):
            if text[i] == text[i + 1]:
                ends[i] = ends[i + 1]
        out = []
        for i, (c, end) in enumerate(zip(text, ends, strict=True)):
            here = [(c, i + 1, 0.0 if c.isalpha() else KEEP_COST)]
            here += [(x, i + 1, LEET_COST) for x in LEET.get(c, "")]
            first = i == 0 or text[i - 1] != c
            if first and end - i >= 2:
                letters = c if c.isalpha() else LEET.get(c, "")
                for x in letters:
                    here.append((x, end, REPEAT_COST))
                    if end - i >= 3 or not c.isalpha():
                        here.append((x * 2, end, REPEAT_COST))
            if spaced and c in " .-_*·":
                here = [("", i + 1, SPACE_COST), (c, i + 1, KEEP_COST)]
            out.append(here)
        return out

    def restore(self, text: str) -> str:
        """The likeliest reading of a suspicious string."""
        found = self.known.get(text)
        if found is not None:
            return found
        cost, arcs = self.cost, self.arcs(text)
        # places -> (the two classes before it) -> (cost, reading as a chain of pieces, shared by the states)
        best: list[dict[tuple[int, int], tuple[float, tuple | None]]] = [{} for _ in range(len(text) + 1)]
        best[0][(0, 0)] = (0.0, None)
        for i, here in enumerate(arcs):
            for (a, b), (so_far, read) in best[i].items():
                for piece, j, channel in here:
                    x, y, total = a, b, so_far + channel
                    for c in piece:
                        z = _code(c)
                        total += cost[x, y, z]
                        x, y = y, z
                    old = best[j].get((x, y))
                    if old is None or total < old[0]:
                        best[j][(x, y)] = (total, (read, piece))
            best[i] = {} if i else best[i]
        chain = min(((t + cost[a, b, 0], r) for (a, b), (t, r) in best[-1].items()), key=lambda x: x[0])[1]
        pieces = []
        while chain is not None:
            chain, piece = chain
            pieces.append(piece)
        found = "".join(reversed(pieces))
        if len(self.known) >= CACHE:
            self.known.clear()
        if len(text) <= KNOWN_CHARS:
            self.known[text] = found
        return found


def features(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return [word + "$", *[word[:k] for k in BEGINNINGS if len(word) >= k]]


@dataclass
class ToxicModel:
    """Rates of marked words, the restorer's counts and the logistic function."""

    corpus: np.ndarray
    rates: dict[str, tuple[int, int]] = field(default_factory=dict)
    ratio: float = 0.0
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None
    logistic: np.ndarray | None = None
    cache: dict = field(default_factory=dict)

    @cached_property
    def restorer(self) -> Restorer:
        whole = [(f[:-1], t) for f, (t, n) in self.rates.items() if f[-1] == "$" and self.weight(t, n) >= 2]
        marked = trigram_counts([w for w, _ in whole], np.array([float(t) for _, t in whole])) if whole else None
        return Restorer(self.corpus, marked)

    def weight(self, toxic: float, other: float) -> float:
        return math.log((toxic + SMOOTH * self.ratio) / (other + SMOOTH) / self.ratio)

    def word_weight(self, word: str, own: Counter | None = None, toxic: bool = False) -> float:
        best = 0.0
        for f in features(word):
            if f in self.rates:
                t, n = self.rates[f]
                if own is not None:
                    t, n = (t - own[f], n) if toxic else (t, n - own[f])
                best = max(best, self.weight(max(t, 0), max(n, 0)))
        return best if best >= LEAST_WEIGHT else 0.0

    def words(self, chunk: str) -> list[str]:
        if _ODD.search(chunk):
            # edges that are no letter or leetspeak stay as they are
            chunk = " ".join(self.restorer.restore(p) if _ODD.search(p) else p for p in regex.split(r"[\n,;:?\"()]+|\.(?=\s|$)", chunk))
        return _WORD.findall(chunk)

    def chunk(self, chunk: str) -> tuple[list[float], int]:
        """Weights of a chunk's marked words, and the number of its words."""
        found = self.cache.get(chunk)
        if found is None:
            words = self.words(chunk)
            weights = [x for w in words if (x := self.word_weight(w))]
            # a chunk without marked words is kept as its number of words
            found = (weights, len(words)) if weights else len(words)
            if len(self.cache) >= CHUNKS:
                self.cache.clear()
            if len(chunk) <= KNOWN_CHARS:
                self.cache[chunk] = found
        return found if type(found) is tuple else ([], found)

    @staticmethod
    def evidence(weights: list[float], n: int) -> list[float]:
        top = sorted(weights, reverse=True)
        n = max(n, 1)
        return [sum(top[:1]), sum(top[:3]), sum(top) / math.sqrt(n), len(top) / n, math.log1p(n)]

    def block(self, texts: list[str]) -> list[list[float]]:
        """Evidence of each text; every distinct chunk is read once."""
        codes, offsets, entries = chunk_codes([t.lower() for t in texts])
        read = [self.chunk(c) for c in entries]
        count = np.array([n for _, n in read] or [0])
        hot = np.array([bool(w) for w, _ in read] or [False])
        single = np.array([len(c) == 1 and (c.isalpha() or c in LEET) for c in entries] or [False])
        total = np.concatenate([[0], np.cumsum(count[codes])])[offsets] if len(codes) else np.zeros(len(texts) + 1, np.int64)
        at = np.flatnonzero(hot[codes]) if len(codes) else np.zeros(0, np.int64)
        owner = np.searchsorted(offsets, at, side="right") - 1
        weights: list[list[float]] = [[] for _ in texts]
        for i, c in zip(owner.tolist(), codes[at].tolist(), strict=True):
            weights[i] += read[c][0]
        # letters spaced out: runs of three single characters or more within a text
        alone = np.flatnonzero(single[codes]) if len(codes) else at
        if len(alone) >= 3:
            text = np.searchsorted(offsets, alone, side="right") - 1
            cut = np.flatnonzero((np.diff(alone) != 1) | (np.diff(text) != 0)) + 1
            for run in np.split(np.arange(len(alone)), cut):
                if len(run) >= 3:
                    spelt = " ".join(entries[c] for c in codes[alone[run]])
                    weights[int(text[run[0]])] += [x for w in _WORD.findall(self.restorer.restore(spelt)) if (x := self.word_weight(w))]
        return [self.evidence(w, int(b - a)) for w, a, b in zip(weights, total[:-1], total[1:], strict=True)]

    def scores(self, evidence: list[list[float]]) -> np.ndarray:
        if self.logistic is None:
            return np.zeros(len(evidence))
        # figures far outside those of the training rows say no more than the outermost ones
        z = np.clip((np.array(evidence) - self.centre) / self.spread, -REACH, REACH)
        return 1 / (1 + np.exp(-np.clip(z @ self.logistic[:-1] + self.logistic[-1], -40, 40)))

    def fit(self, evidence: np.ndarray, toxic: np.ndarray) -> None:
        """Newton's method with a small ridge."""
        self.centre, self.spread = evidence.mean(axis=0), np.maximum(evidence.std(axis=0), 1e-3)
        z = np.c_[np.clip((evidence - self.centre) / self.spread, -REACH, REACH), np.ones(len(evidence))]
        w, times = np.zeros(z.shape[1]), np.where(toxic > 0, TOXIC_TIMES, 1.0)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
            slope = z.T @ (times * (p - toxic)) + 0.1 * w
            w -= np.linalg.solve((z * (times * p * (1 - p) + 1e-6)[:, None]).T @ z + 0.1 * np.eye(len(w)), slope)
        self.logistic = w

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "restorer"} | {"cache": {}}


def corpus_trigrams(docs: DataFrame, text_col: str) -> np.ndarray:
    """Class trigram counts over all documents."""

    def run(batches):
        total = np.zeros(len(ALPHABET) ** 3)
        for batch in batches:
            for a, b in blocks(buffers(batch.column(0))[1], BLOCK_BYTES):
                codes, _, entries = chunk_codes([t.lower() for t in batch.column(0).slice(a, b - a).fill_null("").to_pylist()])
                if entries:
                    total += trigram_counts(entries, np.bincount(codes, minlength=len(entries)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["code", "n"])

    rows = docs.select(text_col).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(ALPHABET) ** 3)
    for r in rows:
        out[r.code] = r.n
    return out


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> ToxicModel:
    """Fit on labelled rows that are not held out."""
    model = ToxicModel(corpus_trigrams(docs, text_col))
    marked = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("__t_id"))
        .agg(F.max(label_col).cast("int").alias("__t_toxic"))
        .orderBy(F.xxhash64("__t_id"), "__t_id")
        .limit(train_rows)
    )
    rows = materialize(
        docs.select(F.col(id_col).alias("__t_id"), F.col(text_col).alias("__t_text")).join(F.broadcast(marked), "__t_id").select("__t_text", "__t_toxic")
    )

    def count(batches):
        for batch in batches:
            for a, b in blocks(buffers(batch.column(0))[1], BLOCK_BYTES):
                both = (Counter(), Counter())
                for text, y in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), strict=True):
                    both[y > 0].update(_WORD.findall((text or "").lower()))
                out = {}
                for y, c in enumerate(both):
                    for w, n in c.items():
                        for f in [*features(w), ""]:
                            out.setdefault(f, [0, 0])[y] += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(out)), pa.array([x[1] for x in out.values()], pa.int64()), pa.array([x[0] for x in out.values()], pa.int64())], names=["f", "t", "n"]
                )

    counts = materialize(rows.mapInArrow(count, "f string, t long, n long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("n").alias("n")))
    whole = counts.filter("f = ''").first()
    if whole is None or not whole.t or not whole.n:
        return model
    model.ratio = whole.t / whole.n
    gain = F.log((F.col("t") + SMOOTH * model.ratio) / (F.col("n") + SMOOTH) / model.ratio)
    kept = counts.filter("f != '' and t >= 2").withColumn("w", gain).filter(f"w >= {LEAST_WEIGHT}").orderBy(F.desc(F.col("w") * F.log1p("t")), "f").limit(MODEL_WORDS)
    model.rates = {r.f: (r.t, r.n) for r in kept.collect()}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def weigh(batches):
        m = shared.value
        known: dict[str, tuple[tuple[str, ...], int]] = {}

        def marked_words(chunk: str) -> tuple[tuple[str, ...], int]:
            """Words of a chunk that have a feature with a rate, and the number of all its words."""
            found = known.get(chunk)
            if found is None:
                words = m.words(chunk)
                found = tuple(w for w in words if any(f in m.rates for f in features(w))), len(words)
                if len(known) >= CACHE:
                    known.clear()
                if len(chunk) <= KNOWN_CHARS:
                    known[chunk] = found
            return found

        for batch in batches:
            out, marks = [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                read = [marked_words(c) for c in (text or "").lower().split(" ")]
                words = [w for ws, _ in read for w in ws]
                own = Counter(f for w in words for f in features(w) if f in m.rates)
                out.append(m.evidence([x for w in words if (x := m.word_weight(w, own, y > 0))], sum(n for _, n in read)))
                marks.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64())), pa.array(marks, pa.int32())], names=["x", "y"])

    seen = rows.mapInArrow(weigh, "x array<double>, y int").collect()  # of bounded number
    model.fit(np.array([r.x for r in seen]), np.array([float(r.y > 0) for r in seen]))
    return model


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        m = shared.value
        for batch in batches:
            for a, b in blocks(buffers(batch.column(1))[1], BLOCK_BYTES):
                got = m.scores(m.block(batch.column(1).slice(a, b - a).fill_null("").to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(got, pa.float64())], names=[id_col, "score"])

    return docs.select(F.col(id_col), text_col).mapInArrow(run, f"`{id_col}` {id_type}, score double")


def restored(texts: list[str], model: ToxicModel) -> list[str]:
    """The words of texts as they are scored, for inspection."""
    return [" ".join(w for c in t.lower().split(" ") for w in model.words(c)) for t in texts]


def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
