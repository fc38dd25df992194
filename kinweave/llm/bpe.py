"""BPE encoding and decoding with a segment tree.

A word's merges are found with a segment tree over the ranks of adjacent pairs: the root holds the
leftmost pair of lowest rank, a merge updates three leaves, and the word is done when the root has
no mergeable pair, O(n log n) for a word of n symbols however long it is.

Texts are normalised and split as the vocabulary file says; a text's words are looked up in a cache
of bounded size, and only words that are not in it are merged. The work is per text, so there is no
shuffle; a vocabulary is loaded once per Python worker from a path that every machine has.

Defined edge cases: null and empty texts have no ids and decode to the empty string; ids may be null
or repeated, each row is encoded by itself; extra columns are ignored; unknown symbols are left
out, as the file has no unknown token; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.chunks import chunk_codes, gather
from kinweave.llm.wordhash import blocks, buffers
from kinweave.session import table

CACHE_WORDS = 300_000
#: White space, as Unicode has it, and the split pattern of the vocabulary's file.
SPACE = regex.compile("[\t-\r \x85\xa0  -     　]+")
#: The same for ASCII texts, with A-Z in lower case.
_ASCII = {c: " " for c in range(9, 14)} | {c: chr(c + 32) for c in range(65, 91)}
#: Texts are encoded in blocks of about so many characters.
BLOCK_CHARS = 4 << 20
NONE = 1 << 62


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


def merge_pairs(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge until no pair can be; ``ranks`` has the rank and the merged symbol of each pair.

    The tree's leaves are the pairs by place, each its rank and place in one number, so the root is
    the leftmost pair of lowest rank. A merge updates three leaves and their ancestors.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    get, bits = ranks.get, n.bit_length()
    size = 1 << (n - 2).bit_length()
    leaves = [NONE if (f := get(p)) is None else f[0] << bits | i for i, p in enumerate(zip(symbols, symbols[1:], strict=False))]
    if min(leaves) == NONE:
        return symbols
    rows = leaves + [NONE] * (size - n + 1)
    levels = [rows]
    while len(rows) > 1:
        rows = [a if a < b else b for a, b in zip(rows[::2], rows[1::2], strict=True)]
        levels.append(rows)
    tree = [NONE]
    for rows in reversed(levels):
        tree += rows
    after, before, mask = list(range(1, n + 1)), list(range(-1, n - 1)), (1 << bits) - 1

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        while i > 1:
            a, b = tree[i], tree[i ^ 1]
            i >>= 1
            if b < a:
                a = b
            if tree[i] == a:
                return
            tree[i] = a

    while (root := tree[1]) != NONE:
        i = root & mask
        j = after[i]
        k = after[j]
        symbols[i] = made = get((symbols[i], symbols[j]))[1]
        symbols[j] = -1
        after[i] = k
        if j < size:
            put(j, NONE)
        if k < n:
            before[k] = i
            f = get((made, symbols[k]))
            put(i, NONE if f is None else f[0] << bits | i)
        else:
            put(i, NONE)
        h = before[i]
        if h >= 0:
            f = get((symbols[h], made))
            put(h, NONE if f is None else f[0] << bits | h)
    return [s for s in symbols if s >= 0]


class WordBpe:
    """Encoder of a vocabulary file whose words end in a suffix, as the file describes itself."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {(self.vocab[a], self.vocab[b]): (i, self.vocab[a + b]) for i, (a, b) in reversed(list(enumerate(merges)))}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.bytes = byte_characters()
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        #: word -> its ids as little-endian 32-bit numbers
        self.cache: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.cache_words = cache_words
        self.decoded = np.array([self.tokens.get(i, "") for i in range(max(self.tokens) + 1)], dtype=object)

    def word(self, word: str) -> bytes:
        found = self.cache.get(word)
        if found is None:
            chars = [self.bytes[b] for b in word.encode()]
            chars[-1] += self.suffix
            ids = [self.vocab[c] for c in chars if c in self.vocab]
            ids = merge_pairs(ids, self.ranks)
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(self.cache) >= self.cache_words:
                self.cache.clear()
            self.cache[word] = found
        return found

    def _normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if not text.isascii():
                # letter by letter: a capital sigma at a word's end is an ordinary sigma
                text = SPACE.sub(" ", text).replace("Σ", "σ").lower()
                return text
        return text.translate(_ASCII)

    def _chunk(self, chunk: str) -> bytes:
        """Words never reach over a space, so what stands between two is looked up as a whole."""
        found = self.chunks.get(chunk)
        if found is None:
            found = b"".join([self.word(w) for w in self.pattern.findall(chunk)])
            if len(self.chunks) >= self.cache_words:
                self.chunks.clear()
            if len(chunk) <= 64:
                self.chunks[chunk] = found
        return found

    def encode_block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts and the n + 1 offsets."""
        special = [i for i, t in enumerate(texts) if self.cut is not None and "<" in t and self.cut.search(t)]
        odd = set(special)
        codes, offsets, entries = chunk_codes(["" if i in odd else self._normal(t) for i, t in enumerate(texts)])
        ids, ends = gather(codes, offsets, [self._chunk(c) for c in entries], 4)
        if special:
            each = np.split(ids, ends[1:-1])
            for i in special:
                each[i] = np.frombuffer(self.encode(texts[i]), "<u4")
            ids, ends = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        return ids, ends

    def _plain(self, text: str) -> bytes:
        return b"".join([self._chunk(c) for c in self._normal(text).split(" ")])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        return b"".join(
            struct.pack("<I", self.special[part]) if i % 2 else self._plain(part) for i, part in enumerate(self.cut.split(text))
        )

    def decode(self, ids: bytes | np.ndarray) -> str:
        """Tokens joined by spaces; the file names no decoder."""
        return " ".join(self.decoded[np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else ids])


@lru_cache(maxsize=2)
def encoder(path: str) -> WordBpe:
    return WordBpe(path)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_texts(docs: DataFrame, path: str | None = None, name: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text",
                 with_ids: bool = True) -> DataFrame:
    """Per row: id, n_tokens, the two digests and, unless switched off, the ids and the decoded text."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = encoder(path or vocabulary_path(name))
        for batch in batches:
            for at, end in blocks(buffers(batch.column(1))[1], BLOCK_CHARS):
                part = batch.slice(at, end - at)
                flat, ends = bpe.encode_block(part.column(1).fill_null("").to_pylist())
                n, a, b, ids, texts = np.diff(ends), [], [], [], []
                for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    plain = bpe.decode(flat[s:e])
                    a.append(hashlib.sha256(flat[s:e].tobytes()).hexdigest())
                    b.append(hashlib.sha256(plain.encode()).hexdigest())
                    if with_ids:
                        ids.append(flat[s:e].astype(np.int32))
                        texts.append(plain)
                columns = {id_col: part.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a), "decoded_sha256": pa.array(b)}
                if with_ids:
                    columns |= {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(texts, pa.string())}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(F.col(id_col), text_col).mapInArrow(run, schema)


def op5(spark, sf_dir):
    return encode_texts(table(spark, sf_dir, "documents"), with_ids=False)
