"""Texts of a block as codes into a table of their distinct space-separated chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def chunk_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Codes of all chunks in order, the n + 1 offsets of the texts, and the distinct chunks."""
    parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    offsets = parts.offsets.to_numpy()
    coded = parts.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), offsets - offsets[0], coded.dictionary.to_pylist()


def gather(codes: np.ndarray, offsets: np.ndarray, ids: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids in one array and the n + 1 offsets of the texts; ids: of each chunk, ``width`` bytes each."""
    lengths = np.fromiter((len(x) for x in ids), np.int64, len(ids)) // width
    starts = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.frombuffer(b"".join(ids), dtype=f"<u{width}")
    n = lengths[codes]
    ends = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(ends[-1]) + np.repeat(starts[codes] - ends[:-1], n)
    return flat[at], ends[offsets]
