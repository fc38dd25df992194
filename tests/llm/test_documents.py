"""Operators on documents against brute force, with the edge cases each docstring defines."""

from __future__ import annotations

import hashlib
import os
import platform
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinweave.llm import bpe, decontamination, importance, induced, line_cleaning, line_dedup, minhash_forest, suffix_dedup, token_files, toxicity

RNG = random.Random(5)
WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "Zeta", "eta", "théta", "iota", "kappa", "lambda", "mu9"]


def prose(n: int) -> str:
    return " ".join(RNG.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    shared, other = prose(120), prose(90)
    out = [
        (1, shared), (2, shared), (3, shared.replace("alpha", "omega", 1)), (4, prose(30) + "\n" + shared[:500] + "\n" + prose(30)),
        (5, None), (6, ""), (7, "   \n\t "), (8, "one two"), (9, "One  two"), (10, other + "\n" + other), (11, "x" * 3000),
        (12, "line with text here\nLINE WITH TEXT HERE  \nown line of twelve"), (13, "line with text here\n\nshort\nshort"), (14, "short"),
        (15, "é" * 700 + " fin"), (16, prose(4000)), (17, "a b c d"), (18, "a b c d"),
    ]
    return out + [(1, shared), (19, shared + " tail words")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # extra columns with names the operators use themselves
    return spark.createDataFrame([(i, t, "x", 1, 2.0) for i, t in rows], "doc_id long, text string, n_words string, start int, score double")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_quality_figures(spark, docs, rows, empty):
    got = Counter(tuple(r) for r in line_cleaning.quality_figures(docs).collect())
    want = Counter()
    for i, t in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(zip(words, words[1:], words[2:], strict=False))
        hit = {p + d for p in range(len(words) - 2) if grams[tuple(words[p : p + 3])] > 1 for d in range(3)}
        full = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        want[(i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(hit), failed)] += 1
    assert Counter(k[:7] for k in got.elements()) == want
    assert line_cleaning.quality_figures(empty).count() == 0


def test_clean_lines_removes_failed_lines_and_documents(spark):
    good = "\n".join(f"A{i} sentence{i} of quite{i} ordinary{i} words number{i} that{i} stands here{i}." for i in range(12))
    df = spark.createDataFrame([(1, good), (2, good + "\nhome | news | sport"), (3, "\n".join(["buy!! now!! cheap!!"] * 30)), (None, good)], "doc_id long, text string")
    got = {(r.doc_id, r.text) for r in line_cleaning.clean_lines(df).collect()}
    assert got == {(1, good), (2, good), (None, good)}
    # navigation and punctuation, line by line: (line, whether it stays among good ones)
    lines = [
        ("Home About Contact", False), ("Home / Sport / Wetter", False), ("Startseite Kontakt", False), ("Sport · Politik · Kultur", False), ("A Heading Of Its Own", True),
        ("home is where the heart lies they say and so it goes.", True), ("a line without any mark " * 4, False), ("a short line without a mark", True), ("well-known and/or tried.", True),
        ("mentions légales", False), ("Alle Rechte vorbehalten", False), ("", True),
    ]
    more = "\n".join(f"B{i} sentence{i} of quite{i} ordinary{i} words number{i} that{i} stands here{i}." for i in range(50, 62))
    rows = [(i, f"{good}\n{x}\n{more}") for i, (x, _) in enumerate(lines)]
    rows += [(50, good + "\nFirst Part\nSecond Part\nThird Part 3\n" + more), (51, good + "\nFirst Part\nSecond Part\nthird part\n" + more)]
    kept = {r.doc_id: r.text for r in line_cleaning.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: kept[i] == rows[i][1] for i in range(len(lines))} == {i: stays for i, (_, stays) in enumerate(lines)}
    assert kept[50] == good + "\n" + more and kept[51] == rows[-1][1]


def brute_lines(rows):
    first = {}
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))
            if i is not None and len(k) >= 10:
                holders[k].add(i)
    for k, ids in holders.items():
        if len(ids) > 1:
            first[k] = min(ids)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or i <= first.get("".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\v\f\r")), i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_line_dedup(spark, docs, rows, empty):
    assert Counter(map(tuple, line_dedup.line_digest(docs).collect())) == Counter(brute_lines(rows))
    assert line_dedup.line_digest(empty).count() == 0
    none = spark.createDataFrame([(None, "line with text here"), (1, "line with text here"), (2, "Line with text here")], "doc_id long, text string")
    assert {(r.doc_id, r.n_dropped) for r in line_dedup.line_digest(none).collect()} == {(None, 0), (1, 0), (2, 1)}
    back = line_dedup.dedup_lines(docs)
    assert back.columns == docs.columns and back.count() == docs.count()


def shingles(t, k):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else (frozenset([tuple(w)]) if w else frozenset())


def test_near_duplicates(spark, docs, rows, empty):
    base = [prose(200) for _ in range(6)]
    more = []
    for n, b in enumerate(base):
        for c in range(40):
            w = b.split()
            for _ in range(RNG.randint(0, 9)):
                w[RNG.randrange(len(w))] = f"edit{RNG.random()}"
            more.append((1000 + n * 100 + c, " ".join(w)))
    everything = [(i, t) for i, t in dict(rows).items()] + more
    sets = {i: shingles(t, 4) for i, t in everything}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    df = spark.createDataFrame(everything, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_forest.near_duplicates(df, shingle=4).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in ids}
    assert minhash_forest.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (4, "A b c d e f")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id, r.kept) for r in minhash_forest.near_duplicates(odd).collect()} == {(None, None, True), (3, 3, True), (4, 3, False)}


def test_near_duplicates_in_a_large_boilerplate_family(spark):
    """Pairs above the threshold among many sets just below it, and forms that only their template joins."""
    rng = random.Random(11)

    def fresh(n):
        return [f"w{rng.getrandbits(40):x}" for _ in range(n)]

    common, form = fresh(180), fresh(180)
    texts = [common + fresh(27) for _ in range(1500)]  # similarity of two: 177 / (204 * 2 - 177), 0.77
    for i in range(0, 400, 2):  # hidden pairs share some of what is their own: 0.83
        texts[1499 - i] = texts[i][:187] + texts[1499 - i][187:]
    texts += [form + fresh(40) for _ in range(300)] + [form]  # two of them 0.69, with the template 0.82
    rng.shuffle(texts)
    texts = dict(enumerate(" ".join(t) for t in texts))
    sets = {i: shingles(t, 4) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_forest.near_duplicates(df, shingle=4).collect()}
    want = {i: find(i) for i in sets}
    joined = [i for i in sets if want[i] != i]
    assert len(joined) >= 400
    print("family recall", sum(got[i] == want[i] for i in joined), "of", len(joined))
    assert got == want


def test_suffix_order_against_sorting(tmp_path):
    rng = random.Random(3)
    for trial in range(60):
        s = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(1, 70))] * rng.choice([1, 3]) + [0]
        if trial % 3 == 0:  # long slopes, whose pieces end at any length
            s = [c for _ in range(20) for c in rng.choice([range(1, 14), range(13, 0, -1)])[: rng.randint(1, 13)]] + [0]
        cap, n = rng.choice([3, 400]), len(s)
        induced.BATCH = rng.choice([2, 1 << 17])
        out = []
        # queues of 64 bytes spill, a base of one name recurses to the end
        induced.sort_suffixes(np.array(s, np.uint16), max(s) + 1, cap, str(tmp_path / str(trial)), rng.choice([64, 1 << 20]), lambda p, q, o=out: o.extend(zip(p.tolist(), q.tolist(), strict=True)), rng.choice([1, 1 << 20]))
        induced.BATCH = 1 << 17
        assert sorted(p for p, _ in out) == list(range(n))
        for (a, _), (b, shared) in zip(out, out[1:], strict=False):
            most = min(cap, n - max(a, b))
            assert shared == next((k for k in range(most) if s[a + k] != s[b + k]), most)
            assert s[a : a + cap] >= s[b : b + cap]


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_suffix_dedup(spark, docs, rows, empty, hot):
    length = 60
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[p : p + length] for b in texts for p in range(len(b) - length + 1))
    want = Counter()
    for (i, _), b in zip(rows, texts, strict=True):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        want[(i, len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())] += 1
    got = suffix_dedup.repeat_digest(docs, length=length, gram=16, hot=hot, shard_bytes=20_000)
    assert Counter(map(tuple, got.collect())) == want
    assert suffix_dedup.repeat_digest(empty).count() == 0


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_suffix_dedup_lays_down_what_may_repeat(spark, monkeypatch, hot):
    length, rng, texts = 200, random.Random(11), []
    noise = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    # shared passages just below, at and above the length, some with one byte changed, at many offsets
    shared = [noise(n) for n in (150, 190, 199, 200, 201, 230, 320, 500) for _ in range(4)]
    for _ in range(150):
        part = rng.choice(shared)
        if rng.random() < 0.3:
            at = rng.randrange(len(part))
            part = part[:at] + b"X" + part[at + 1 :]
        texts.append(noise(rng.randrange(120)) + part + noise(rng.randrange(120)))
    texts += [texts[3], texts[3], b"a" * 450, b"ab" * 150]
    # a passage of 60 bytes is in all of these: k-grams are shared, and no string is
    sixty = noise(60)
    alone = [noise(300) + sixty + noise(300) for _ in range(40)]
    texts += alone
    seen = Counter(b[p : p + length] for b in texts for p in range(len(b) - length + 1))
    want = {}
    for i, b in enumerate(texts):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\x01" * length
        want[i] = (sum(gone), hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    laid, marks = [], suffix_dedup._marks

    def kept(pieces, *rest):
        laid.extend(bytes(r.text) for r in pieces.select("text").collect())
        return marks(pieces, *rest)

    monkeypatch.setattr(suffix_dedup, "_marks", kept)
    docs = spark.createDataFrame([(i, b.decode()) for i, b in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.repeat_digest(docs, length=length, gram=16, hot=hot, shard_bytes=20_000).collect()}
    assert got == want
    assert laid
    assert not any(sixty in x for x in laid)


KEPT = """
import random, re
import pyarrow as pa
from kinweave.llm import suffix_dedup

class Taken:
    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run

def held():
    return sum(map(int, re.findall(r"Pss_Anon: *([0-9]+)", open("/proc/self/smaps_rollup").read()))) / 1024

def shard(n):
    text = [random.Random(k % 90).randbytes(30_000).hex().encode()[:30_000] for k in range(n)]
    rows = [pa.array(x, kind) for x, kind in ((range(n), pa.int64()), (range(n), pa.int64()), ([0] * n, pa.int64()), ([False] * n, pa.bool_()), (text, pa.binary()))]
    return iter([pa.RecordBatch.from_arrays(rows, names=["f", "c", "base", "again", "text"])])

run = suffix_dedup._marks(Taken(), 400, suffix_dedup.QUEUE_BYTES)
list(run(shard(2)))
before = held()
assert sum(b.num_rows for b in run(shard(100))) == 20
print(held() - before)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup") or platform.libc_ver()[0] != "glibc", reason="reads Linux's memory figures")
def test_suffix_dedup_workers_give_memory_back():
    # three megabytes are sorted in a process of its own, then what it still holds is read
    env = os.environ | {"PYTHONPATH": str(Path(suffix_dedup.__file__).parents[2]), "OMP_NUM_THREADS": "1"}
    got = subprocess.run([sys.executable, "-c", KEPT], env=env, capture_output=True, text=True, timeout=300, check=True)
    assert float(got.stdout) < 30


ITEMS = [("a", prose(25)), ("b", "one two"), ("c", None), ("d", ""), ("e", prose(12)), (None, prose(14)), ("f", "?!")]
# items that share a passage, one that repeats itself, one of a single word
ITEMS += [("g", ITEMS[0][1] + " " + prose(8)), ("h", "over and over " * 9), ("i", "omega"), ("a", ITEMS[4][1])]


@pytest.mark.parametrize("bits", [1 << 20, 64])
def test_decontamination(spark, docs, rows, empty, bits):
    held = rows + [(50, prose(40) + " " + ITEMS[0][1].upper() + " " + prose(10)), (51, "x " + ITEMS[0][1][20:] + "?"), (None, ITEMS[4][1]), (52, prose(9) + " and " + "over and over " * 40), (53, ITEMS[0][1] * 2), (54, " ".join([ITEMS[4][1]] * 300))]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    want = Counter()
    for i, t in held:
        w, hit, items = split(t), set(), set()
        for name, text in ITEMS:
            b = split(text)
            n = min(10, len(b))
            grams = {tuple(b[p : p + n]) for p in range(len(b) - n + 1)} if n else set()
            for p in range(len(w) - n + 1):
                if name is not None and n and tuple(w[p : p + n]) in grams:
                    hit |= set(range(p, p + n))
                    items.add(name)
        want[(i, len(w), len(hit), tuple(sorted(items)))] += 1
    # extra columns named as the operator's own
    df = spark.createDataFrame([(*h, "x", 1, 2) for h in held], "doc_id long, text string, n_words string, k1 int, f long")
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    got = Counter()
    for r in decontamination.contamination(df, bench, bitmap_bits=bits).collect():
        hit = {p for a, b in r.runs for p in range(a, b)}
        got[(r.doc_id, r.n_words, len(hit), tuple(sorted(r["items"])))] += 1
    assert got == want
    assert decontamination.contamination(empty, bench).count() == 0
    assert decontamination.remove_contaminated(docs, bench.limit(0)).count() == docs.count()


def library(name):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.vocabulary_path(name))
    t.no_truncation()
    t.no_padding()
    return t


ODD_TEXTS = ["ΑΣ ΣΑΣ İ<|endoftext|> naïve", "'S 'T i'LL", "a\n \nb", "a   b ", " \n", "\x1c a\x1d\x85c", "日本語 ½ Ⅷ", "😀😀 x", "\x00\x7f", "ab" * 2000]


def test_bpe_equals_the_library(spark, docs, rows, empty):
    t = library("word_bpe_49k.json")
    held = rows + [(100 + i, x) for i, x in enumerate(ODD_TEXTS)]
    want = Counter()
    for i, x in held:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[(i, len(ids), tuple(ids), t.decode(ids, skip_special_tokens=False))] += 1
    got = bpe.encode_texts(spark.createDataFrame(held, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in got) == want
    assert all(r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() for r in got)
    assert bpe.encode_texts(empty).count() == 0


def test_token_files(spark, docs, rows, empty, tmp_path):
    t = library("byte_bpe_50k.json")
    held = sorted((dict(rows) | {100 + i: x for i, x in enumerate(ODD_TEXTS)}).items())
    out = token_files.write_tokens(spark.createDataFrame(held, "doc_id long, text string"), str(tmp_path / "tokens"), shard_tokens=500)
    start, want = 0, {}
    for i, x in held:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32, r.ids) for r in token_files.read_tokens(spark, out).collect()}
    assert got == want
    token_files.write_tokens(empty, str(tmp_path / "none"))
    assert token_files.read_tokens(spark, str(tmp_path / "none")).count() == 0
    # null and repeated ids, columns whose names clash with the operator's own, a text of a megabyte
    long = " ".join(prose(50) for _ in range(3500))
    more = [(None, "x y", 1, "a"), (7, "b c", 2, "b"), (7, None, 3, "c"), (7, "b c", 4, "d"), (3, long, 5, "e")]
    odd = spark.createDataFrame(more, "doc_id long, text string, start long, data string")
    back = token_files.read_tokens(spark, token_files.write_tokens(odd, str(tmp_path / "odd"), shard_tokens=3)).orderBy("start").collect()
    size = {x: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x, _, _ in more}
    assert [r.doc_id for r in back] == [None, 3, 7, 7, 7] and [r.n_tokens for r in back[:2]] == [size["x y"], size[long]]
    assert Counter(r.n_tokens for r in back[2:]) == Counter([1, size["b c"], size["b c"]])
    assert [r.start for r in back] == [sum(r.n_tokens for r in back[:k]) for k in range(5)]
    with pytest.raises(TypeError):
        token_files.write_tokens(spark.createDataFrame([("a", "x")], "doc_id string, text string"), str(tmp_path / "text"))


def test_byte_encoder_equals_the_library_on_odd_texts():
    t = library("byte_bpe_50k.json")
    rng = random.Random(3)
    letters = [*" \t\n\r\x1c\x1f\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000abé日'Sstl129.,!?<|>", "<|endoftext|>", "  ", "we're", " x", "q" * 600]
    encoder = token_files.ByteBpe(bpe.vocabulary_path("byte_bpe_50k.json"), 40)
    for _ in range(400):
        texts = [None if rng.random() < 0.05 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 6))]
        ids, ends = encoder.encode_block(pa.array(texts, pa.large_string()))
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_wavelet_matrix(tmp_path):
    rng = np.random.default_rng(1)
    for n, top in ((0, 2), (1, 1), (5000, 3), (3000, 50_257), (2000, 70_000)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        token_files.write_shard(str(tmp_path / "s"), [4, None], np.array([n, 0]), ids)
        docs, counts, m = token_files.read_shard(str(tmp_path / "s"))
        assert docs == [4, None] and counts.tolist() == [n, 0] and (m.all() == ids).all()
        for i in rng.integers(0, max(n, 1), 30).tolist() if n else []:
            assert m.access(i) == ids[i]
            at = np.flatnonzero(ids == ids[i])
            assert m.count(int(ids[i])) == len(at) and m.place(int(ids[i]), len(at) - 1) == at[-1]
            assert m.count(int(ids[i]), 10, 500) == ((at >= 10) & (at < 500)).sum()
        assert m.count(1 << 30) == 0


def test_toxicity(spark, empty):
    bad, train = ["grumblord", "snarfle"], []
    for i in range(400):
        w = prose(40).split()
        y = int(i % 4 == 0)
        if y:
            w[7] = bad[(i // 4) % 2]
        train.append((i, " ".join(w), y))
    df = spark.createDataFrame([(i, t) for i, t, _ in train] + [(None, None), (900, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in train] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    held = [(i, y) for i, _, y in train if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 50 and sum((got[i] >= 0.7) == bool(y) for i, y in held) >= 0.97 * len(held)
    assert 0 <= got[900] < 0.7 and 0 <= got[None] < 0.7
    hidden = [f"{prose(10)} {x} {prose(10)}" for x in ("grumbl0rd", "sn4rfle", "g.r.u.m.b.l.o.r.d", "s n a r f l e", "grummmmblord")]
    assert (model.scores(model.block(hidden)) >= 0.7).sum() >= 4
    assert (model.scores(model.block([prose(30) for _ in range(20)])) < 0.7).all()
    assert toxicity.score(empty, model).count() == 0
    blank = toxicity.train(df, labels.limit(0))
    assert {r.score for r in toxicity.score(df, blank).collect()} == {0.0}


def test_toxicity_reads_long_spelt_texts_and_trailing_leetspeak():
    plain = "they know such snarfle when they see the thing that such wrote here".split()
    words = [*plain, "whore", "ass"]
    model = toxicity.ToxicModel(toxicity.trigram_counts(words, np.full(len(words), 500.0)), {"snarfle$": (50, 0), "whore$": (50, 0)}, 0.1)
    assert model.words("whor3") == ["whore"] and model.words("a55") == ["ass"] and model.words("whor3, a55") == ["whore", "ass"]
    assert model.words("hello!") == ["hello"]
    assert "snarfle" in model.words(".".join("".join(plain)))
    for times in (4, 400):
        [evidence, clean] = model.block([" ".join("".join(plain * times)), " ".join("thething" * times)])
        assert evidence[0] == model.word_weight("snarfle") > 0 and evidence[2] > 0 and clean[0] == 0
    assert set(model.restorer.restore("a" * 50_000)) == {"a"}


def test_importance(spark, docs, empty, tmp_path):
    clean = [(i, prose(60)) for i in range(300)]
    junk = [(1000 + i, " ".join(f"zz{RNG.randint(0, 40)}%%%" for _ in range(60))) for i in range(60)]
    df = spark.createDataFrame(clean + junk + [(None, None), (2000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(100)] + [(1000, 0), (None, 1)], "doc_id long, quality int")
    importance.importance(df, labels).write.parquet(str(tmp_path / "rows"))
    got = importance.select_top(spark.read.parquet(str(tmp_path / "rows")), 300 / 360).collect()
    assert {r.id for r in got if r.kept} == {i for i, _ in clean}
    assert all(r.gumbel_key is None for r in got if r.n_grams == 0)
    keys = sorted((r.gumbel_key for r in got if r.gumbel_key is not None), reverse=True)
    frame = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k double")
    assert [importance.kth_largest(frame, "k", k) for k in (1, 17, 360)] == [keys[0], keys[16], keys[359]]
    # exactly k rows, however many tie; those of smaller hash go first, then those that stand first
    ties = [(i, 3.0, i % 4) for i in range(40)] + [(100 + i, 9.0, i) for i in range(5)] + [(200, 1.0, 0), (201, None, 0)]
    held = spark.createDataFrame(ties, "id long, gumbel_key double, code long").withColumn("tie", F.shiftleft("code", 12)).repartition(3)
    held.write.parquet(str(tmp_path / "ties"))
    held = spark.read.parquet(str(tmp_path / "ties"))
    for k in (3, 5, 8, 15, 17, 45, 46):
        chosen = [r for r in importance.select_top(held, k / 46).collect() if r.kept]
        assert len(chosen) == k and sum(r.id >= 100 and r.id < 200 for r in chosen) == min(k, 5)
        codes = sorted((r.code for r in chosen if r.id < 100), reverse=True)
        assert codes == sorted((c for _, g, c in ties if g == 3.0), reverse=True)[: len(codes)]
    assert importance.select_top(held, 0.0).filter("kept").count() == 0 and importance.select_top(held, 1.0).filter("kept").count() == 46
    assert importance.good_share(labels) == 100 / 101 and importance.good_share(labels.limit(0)) == 1.0
    clash = df.limit(5).withColumns({"n_grams": F.lit(1), "kept": F.lit("x"), "h": F.lit(2)})
    assert importance.resample(clash, labels, share=1.0).columns == clash.columns
    assert importance.resample(empty, labels.limit(0)).count() == 0
    assert importance.importance(docs, labels).count() == docs.count()
