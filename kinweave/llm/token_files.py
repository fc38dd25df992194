"""Token-ID output: one wavelet matrix per shard.

A shard file holds the ids of a run of documents as bit-planes, the highest bit first; in each plane
the ids stand stably sorted by the bits above it, so with a count of ones before every 512th bit
(rank) and a binary search over those counts (select) a single file gives token access, counting of
an id in any range, and the places where it occurs, without being unpacked.

Layout, little-endian: magic ``KWWM``, version u32, tokens u64, documents u64, planes u32, reserved
u32; documents' ids i64[], a null flag u8[] (padded to 8), token counts u64[]; then for each plane
the number of zeros u64, the counts u32[] before each 512 bits (padded to 8) and the bits u8[]
(padded to 8).

Scale: documents are dealt by range of their id and sorted in each task, so a third of all rows in
one source changes nothing; ids leave a task shard by shard, whole documents of about
``SHARD_TOKENS`` tokens. Shards are written as rows of a Parquet table in the shared folder, the
only store that every executor reaches, one binary per shard; ``write_shard`` and ``read_shard``
are the same bytes as plain files. A document's start needs the tokens before its task, a sum for
each task, and those before its shard, which the shard carries.

Defined edge cases: ids are integers, as the format says (others raise a TypeError); null and empty
texts hold only the end id; null ids sort first and come back null; rows that repeat an id follow each other in the order of their texts' hashes; extra columns
are ignored; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.bpe import vocabulary_path
from kinweave.llm.wordhash import blocks, buffers, range_hashes
from kinweave.session import ensure_checkpoint_dir, shuffle_partitions, table

END_ID = 0
SHARD_TOKENS = 1 << 20
BLOCK_BYTES = 1 << 20
#: Bound of the table of distinct chunks, about 50 bytes each.
CACHE_CHUNKS = 500_000
LONG_CHUNK = 512
#: New chunks go to the library as running text of about so many bytes.
RUNNING_BYTES = 1 << 16
_EVERY = 512
#: White space of one byte; the rest is in ``_wide_blank``.
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True


class WaveletMatrix:
    """Rank and select structure over a sequence of ids, and its bytes."""

    def __init__(self, n: int, zeros: list[int], ranks: list[np.ndarray], planes: list[np.ndarray]):
        self.n, self.zeros, self.ranks, self.planes = n, zeros, ranks, planes

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        ids = np.ascontiguousarray(ids)
        levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        zeros, ranks, planes = [], [], []
        x = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        for k in range(levels - 1, -1, -1):
            ones = (x & x.dtype.type(1 << k)) != 0
            bits = np.packbits(ones, bitorder="little")
            pad = np.zeros(-len(bits) % (_EVERY // 8), np.uint8)
            count = np.bitwise_count(np.concatenate([bits, pad]).view(np.uint64)).reshape(-1, _EVERY // 64).sum(axis=1, dtype=np.uint32)
            ranks.append(np.concatenate([[0], np.cumsum(count)]).astype(np.uint32))
            planes.append(bits)
            low = np.compress(~ones, x)
            zeros.append(len(low))
            x = np.concatenate([low, np.compress(ones, x)])
        return cls(len(ids), zeros, ranks, planes)

    def rank(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // _EVERY
        bits = self.planes[level][block * (_EVERY // 8) : -(-i // 8)]
        total = int(self.ranks[level][block]) + int(np.bitwise_count(bits).sum())
        return total - (int(bits[-1]) >> (i % 8)).bit_count() if i % 8 else total

    def select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) set or clear bit of a plane."""
        before = self.ranks[level] if bit else np.arange(len(self.ranks[level])) * _EVERY - self.ranks[level]
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * (_EVERY // 8) : (block + 1) * (_EVERY // 8)], bitorder="little")
        return block * _EVERY + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        """The id at place i."""
        value = 0
        for level in range(len(self.planes)):
            bit = int(self.planes[level][i // 8]) >> (i % 8) & 1
            ones = self.rank(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, begin: int, end: int) -> tuple[int, int]:
        levels = len(self.planes)
        if value < 0 or value >> levels:
            return 0, 0
        for level in range(levels):
            a, b = self.rank(level, begin), self.rank(level, end)
            if value >> (levels - 1 - level) & 1:
                begin, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                begin, end = begin - a, end - b
        return begin, end

    def count(self, value: int, begin: int = 0, end: int | None = None) -> int:
        """How often an id stands in a range of places."""
        end = self.n if end is None else min(end, self.n)
        a, b = self._range(value, min(max(begin, 0), end), end)
        return b - a

    def place(self, value: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of an id."""
        begin, end = self._range(value, 0, self.n)
        if not 0 <= k < end - begin:
            raise IndexError(k)
        i = begin + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = value >> (len(self.planes) - 1 - level) & 1
            i = self.select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def all(self) -> np.ndarray:
        """All ids in order, from the lowest plane upwards."""
        x = np.zeros(self.n, dtype=np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k, (zeros, bits) in enumerate(zip(reversed(self.zeros), reversed(self.planes), strict=True)):
            ones = np.unpackbits(bits, count=self.n, bitorder="little").astype(bool)
            up = np.empty_like(x)
            up[np.flatnonzero(~ones)] = x[:zeros]
            up[np.flatnonzero(ones)] = x[zeros:] | x.dtype.type(1 << k)
            x = up
        return x


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


def pack_shard(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of a shard file."""
    matrix = WaveletMatrix.of(ids)
    out = [struct.pack("<4sIQQII", b"KWWM", 1, len(ids), len(doc_ids), len(matrix.planes), 0)]
    out.append(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes())
    out.append(_padded(bytes(d is None for d in doc_ids)))
    out.append(np.asarray(counts).astype("<u8").tobytes())
    for zeros, ranks, bits in zip(matrix.zeros, matrix.ranks, matrix.planes, strict=True):
        out += [struct.pack("<Q", zeros), _padded(ranks.astype("<u4").tobytes()), _padded(bits.tobytes())]
    return b"".join(out)


def unpack_shard(data) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, token counts and the matrix over a shard's bytes, which are not copied."""
    magic, version, n, docs, levels, _ = struct.unpack_from("<4sIQQII", data)
    if magic != b"KWWM" or version != 1:
        raise ValueError("not a shard file")
    at = 32

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(data, kind, count, at)
        at += -(-got.nbytes // 8) * 8
        return got

    ids, null, counts = take("<i8", docs), take("u1", docs), take("<u8", docs)
    zeros, ranks, planes = [], [], []
    n_ranks = -(-(-(-n // 8)) // (_EVERY // 8)) + 1
    for _ in range(levels):
        zeros.append(int(take("<u8", 1)[0]))
        ranks.append(take("<u4", n_ranks))
        planes.append(take("u1", -(-n // 8)))
    return [None if z else int(d) for d, z in zip(ids, null, strict=True)], counts.astype(np.int64), WaveletMatrix(n, zeros, ranks, planes)


def write_shard(path: str, doc_ids, counts, ids) -> None:
    with open(path, "wb") as f:
        f.write(pack_shard(doc_ids, counts, ids))


def read_shard(path: str):
    with open(path, "rb") as f:
        return unpack_shard(f.read())


class ChunkTable:
    """Ids of distinct chunks by their hash: open addressing in arrays, for at most ``limit`` chunks."""

    def __init__(self, limit: int, kind: np.dtype):
        self.limit, self.count, self.used = limit, 0, 0
        bits = (2 * limit - 1).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.at, self.n = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        self.flat = np.zeros(1 << 20, kind)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the keys, -1 for those the table lacks."""
        slot, out, left = (keys >> self.shift).astype(np.int64), np.full(len(keys), -1), np.arange(len(keys))
        while len(left):
            here = self.keys[slot[left]]
            hit = here == keys[left]
            out[left[hit]] = slot[left[hit]]
            left = left[~hit & (here != 0)]
            slot[left] = (slot[left] + 1) & self.mask
        return out

    def put(self, keys: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Add distinct keys that the table lacks, with their ids one after the other."""
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + 2 * len(ids), self.flat.dtype)])
        self.flat[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(lengths) - lengths
        self.used, self.count = self.used + len(ids), self.count + len(keys)
        slot, left = (keys >> self.shift).astype(np.int64), np.arange(len(keys))
        while len(left):
            here = slot[left]
            free = self.keys[here] == 0
            self.keys[here[free]] = keys[left[free]]  # of keys that meet, one gets the slot
            own = self.keys[here] == keys[left]
            self.at[here[own]], self.n[here[own]] = at[left[own]], lengths[left[own]]
            left = left[~own]
            slot[left] = (slot[left] + 1) & self.mask


#: Classes of bytes that the split pattern tells apart; 0 is everything else, white space and
#: all of non-ASCII text but Latin-1 letters among it.
_LETTER, _DIGIT, _SIGN, _APOSTROPHE, _BREAK = 1, 2, 3, 4, 5
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = _SIGN
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[0x27], _CLASS[0x0A] = _APOSTROPHE, _BREAK


def cuts(data: np.ndarray) -> np.ndarray:
    """Places at which the split pattern ends a token whatever stands around: a space, and where letters, digits,
    signs and single line breaks meet. What follows an apostrophe stays with it, as it may be a contraction."""
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    second = data[lead + 1]
    lead = lead[(second != 0x97) & (second != 0xB7) & (second >= 0x80) & (second <= 0xBF)]
    kind[lead] = kind[lead + 1] = _LETTER
    known = kind > 0
    out = data == 32
    before, here = kind[:-1], kind[1:]
    out[1:] |= known[:-1] & known[1:] & (before != here) & (before != _APOSTROPHE) & ~((before == _SIGN) & (here == _APOSTROPHE))
    # a line break is a token of its own only between two that are none; others stay as they are
    at = np.flatnonzero(kind == _BREAK)
    at = at[(at > 0) & (at < len(data) - 1)]
    alone = known[at - 1] & known[at + 1] & (kind[at - 1] != _BREAK) & (kind[at + 1] != _BREAK)
    out[at[~alone]] = False
    out[at[~alone] + 1] &= data[at[~alone] + 1] == 32
    return out


def _blank_after(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a blank character starts at the places; ``data`` has three more bytes."""
    a, b, c = data[at], data[at + 1], data[at + 2]
    return _BLANK[a] | (a >= 0xC2) & _wide_blank(a, b, c)


def _blank_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a blank character ends before the places."""
    a, b, c = data[at - 1], data[at - 2], data[at - 3]
    return _BLANK[a] | (a >= 0x80) & (_wide_blank(b, a, a) | _wide_blank(c, b, a))


def _wide_blank(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    general = (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    return two | general | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80)


class ByteBpe:
    """The tokenizers library behind a bounded table of distinct chunks.

    A chunk is what stands between two ``cuts``, a space in front included. The split pattern of byte-level
    files never joins two chunks unless blanks meet, so texts where they do, or that hold a special
    token, go to the library whole. Chunks the table lacks are sent to the library as running text, with
    line breaks between those that have no space in front; a token's number of bytes tells to which
    chunk it belongs.
    """

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        # a task has one core; the library's thread pool would only spin
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        #: other files than byte-level ones with the usual split are encoded text by text
        self.chunked = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not spec.get("normalizer")
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = np.uint16 if max(vocab.values()) < 1 << 16 else np.uint32
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.bytes_of[i] = len(token)
        self.cache_chunks = cache_chunks
        self.table = ChunkTable(cache_chunks, self.kind)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter((len(x) for x in found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), self.kind, int(lengths.sum())), lengths

    def _chunks(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, one after the other, and their numbers."""
        size = ends - starts
        spaced, blank_end = data[starts] == 32, _blank_before(data, ends)
        running = (size > 1) & spaced & ~blank_end
        lines = ~spaced & ~blank_end & ~_blank_after(data, starts)
        ids, lengths, order = [], np.zeros(len(starts), np.int64), []
        for some, gap in ((running, 0), (lines, 1)):
            at = np.flatnonzero(some)
            if not len(at):
                continue
            reach = np.cumsum(size[at] + gap)
            text = data[_spread(starts[at], size[at] + gap)]
            if gap:
                text[reach - 1] = 10
            cut = np.unique(np.append(np.searchsorted(reach, np.arange(RUNNING_BYTES, reach[-1], RUNNING_BYTES)), len(at) - 1))
            edges = np.concatenate([[0], reach[cut]]).tolist()
            got, _ = self._library([text[a:b].tobytes().decode() for a, b in zip(edges, edges[1:], strict=False)])
            token_ends = np.cumsum(self.bytes_of[got])
            last = np.searchsorted(token_ends, reach)
            if (token_ends[last] != reach).any() or (gap and (self.bytes_of[got[last]] != 1).any()):
                some[:] = False  # not the split this class knows: one by one
                continue
            lengths[at] = np.diff(last + 1, prepend=0) - gap
            ids.append(np.delete(got, last) if gap else got)
            order.append(at)
        rest = np.flatnonzero(~running & ~lines)
        if len(rest):
            got, lengths[rest] = self._library([data[a:b].tobytes().decode() for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)])
            ids.append(got)
            order.append(rest)
        flat = np.concatenate(ids) if ids else np.zeros(0, self.kind)
        if len(order) > 1:
            order = np.concatenate(order)
            begin = np.zeros(len(starts), np.int64)
            begin[order] = np.cumsum(lengths[order]) - lengths[order]
            flat = flat[_spread(begin, lengths)]
        return flat, lengths

    def _known(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for chunks that repeat, by way of the table."""
        keys = np.maximum(range_hashes(data, starts, ends), np.uint64(1))
        slot = self.table.find(keys)
        lost = np.flatnonzero(slot < 0)
        if len(lost):
            new, first = np.unique(keys[lost], return_index=True)
            if self.table.count + len(new) > self.table.limit:
                # the table starts anew with this block, whose chunks are fewer than the bound
                self.table = ChunkTable(max(self.cache_chunks, len(starts)), self.kind)
                lost = np.arange(len(keys))
                new, first = np.unique(keys, return_index=True)
            first = lost[first]
            self.table.put(new, *self._chunks(data, starts[first], ends[first]))
            slot[lost] = self.table.find(keys[lost])
        lengths = self.table.n[slot]
        return self.table.flat[_spread(self.table.at[slot], lengths)], lengths

    def encode_block(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (nulls have none) and the n + 1 offsets; every id comes from the library."""
        raw, offsets = buffers(column)
        raw = raw[offsets[0] : offsets[-1]]
        # a few bytes either side, so that neighbours can be looked at everywhere
        offsets, n = offsets - offsets[0] + 4, len(offsets) - 1
        data = np.zeros(len(raw) + 8, np.uint8)
        data[4:-4] = raw
        begin = cuts(data)
        begin[: offsets[0]] = begin[offsets[-1] :] = False
        spaces = np.flatnonzero(data == 32)
        met = spaces[_blank_after(data, spaces + 1) | _blank_before(data, spaces)]
        odd = np.zeros(n, dtype=bool)
        odd[np.searchsorted(offsets, met, side="right") - 1] = True
        whole = data.tobytes()
        for s in self.special:
            at = whole.find(s)
            while at >= 0:
                odd[np.searchsorted(offsets, at, side="right") - 1] = True
                at = whole.find(s, at + 1)
        if not self.chunked:
            odd[:] = True
        begin[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], offsets[-1])[: len(starts)]
        first = np.searchsorted(starts, offsets)
        if odd.any():
            keep = ~np.repeat(odd, np.diff(first))
            starts, ends = starts[keep], ends[keep]
            first = np.concatenate([[0], np.cumsum(np.where(odd, 0, np.diff(first)))])
        # chunks of great length, whose hashes are weaker, are encoded each time they come
        long = ends - starts > LONG_CHUNK
        if long.any():
            parts, lengths = [None, None], np.zeros(len(starts), np.int64)
            for k, (some, way) in enumerate(((~long, self._known), (long, self._chunks))):
                parts[k], lengths[some] = way(data, starts[some], ends[some])
            source = np.where(long, len(parts[0]), 0)
            for some in (~long, long):
                source[some] += np.cumsum(lengths[some]) - lengths[some]
            ids = np.concatenate(parts)[_spread(source, lengths)]
        else:
            ids, lengths = self._known(data, starts, ends)
        out = np.concatenate([[0], np.cumsum(lengths)])[first]
        if odd.any():
            each = np.split(ids, out[1:-1])
            at = np.flatnonzero(odd)
            got, lengths = self._library([whole[a:b].decode() for a, b in zip(offsets[at].tolist(), offsets[at + 1].tolist(), strict=True)])
            for i, x in zip(at.tolist(), np.split(got, np.cumsum(lengths)[:-1]), strict=True):
                each[i] = x
            ids, out = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        return ids, out


def _spread(begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places begin, begin + 1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - lengths), lengths)


@lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteBpe:
    return ByteBpe(path)


def write_tokens(docs: DataFrame, out: str, path: str | None = None, name: str = "byte_bpe_50k.json", id_col: str = "doc_id",
                 text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> str:
    """Encode all documents and write their shards, in ascending order of ids, to the folder ``out``."""
    spark = docs.sparkSession
    if docs.schema[id_col].dataType.typeName() not in {"byte", "short", "integer", "long"}:
        raise TypeError(f"{id_col} must hold integers")

    def run(batches):
        bpe = byte_encoder(path or vocabulary_path(name))
        part, shard, before, held, rows = TaskContext.get().partitionId(), 0, 0, 0, []

        def flush():
            nonlocal shard, before, held, rows
            ids = np.concatenate([x for _, x in rows])
            data = pack_shard([d for d, _ in rows], np.array([len(x) for _, x in rows]), ids)
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([shard], pa.int64()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())],
                names=["part", "shard", "before", "tokens", "data"],
            )
            shard, before, held, rows = shard + 1, before + len(ids), 0, []
            return row

        for batch in batches:
            for a, b in blocks(buffers(batch.column(1))[1], BLOCK_BYTES):
                ids, ends = bpe.encode_block(batch.column(1).slice(a, b - a))
                doc_ids = batch.column(0).slice(a, b - a).to_pylist()
                for d, s, e in zip(doc_ids, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    rows.append((d, np.append(ids[s:e], ids.dtype.type(END_ID))))
                    held += e - s + 1
                    if held >= shard_tokens:
                        yield flush()
        if rows:
            yield flush()

    ordered = docs.select(F.col(id_col).alias("__w_id"), F.col(text_col).alias("__w_text")).repartitionByRange(shuffle_partitions(spark), "__w_id")
    ordered = ordered.sortWithinPartitions(F.col("__w_id"), F.xxhash64("__w_text"))
    ordered.mapInArrow(run, "part long, shard long, before long, tokens long, data binary").write.parquet(out)
    return out


def read_tokens(spark, out: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Per document from the files: id, start, n_tokens, ids_crc32 and, unless switched off, the ids."""
    files = spark.read.schema("part long, shard long, before long, tokens long, data binary").parquet(out)
    # one sum for each task that wrote: as many rows as there are part files
    sums = files.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect()
    starts, total = {}, 0
    for r in sums:
        starts[r.part], total = total, total + r.n

    def run(batches):
        for batch in batches:
            for part, before, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                doc_ids, counts, matrix = unpack_shard(data.as_buffer())
                ids, ends = matrix.all().astype("<u4"), np.concatenate([[0], np.cumsum(counts)])
                crc = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(ends[:-1] + before + starts[part]), pa.array(counts), pa.array(crc, pa.int64())]
                names = [id_col, "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return files.select("part", "before", "data").mapInArrow(run, schema)


def op6(spark, sf_dir):
    out = f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), out)
    return read_tokens(spark, out, with_ids=False)
