"""External induced sorting of suffixes with common-prefix values.

The suffixes of a string are sorted by induction: the pieces between local
minima (the last of a falling run) are sorted and named, the suffixes at minima are sorted by
recursion on the string of names, and every other suffix is induced from its successor in two scans, upwards for falling and downwards for rising
suffixes. Tuples (place, common prefix with the tuple before it) travel through priority queues
keyed by first character; within a character they arrive in order, so a queue is a list of runs per
character, which go to disk when the queues outgrow ``memory``. A tuple's common-prefix value is one
more than the minimum over the sources scanned since the last tuple for the same character, from a
running minimum per character and a sparse table per batch.

Common prefixes are kept up to ``cap``, and order beyond it is arbitrary: what callers ask is
which neighbours share ``cap`` characters. Work is done in batches with numpy; strings that do not
fit in memory are passed as memory-mapped files. The recursion ends at ``base`` names with prefix
doubling in memory.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np

BATCH = 1 << 17
BASE = 1 << 21


class RunQueue:
    """Priority queue keyed by character, whose runs spill to a file beyond ``memory`` bytes."""

    def __init__(self, path: str, memory: int):
        self.path, self.memory, self.held = path, memory, 0
        self.runs: dict[int, list] = {}
        self.file = None

    def push(self, key: int, places: np.ndarray, prefix: np.ndarray) -> None:
        self.runs.setdefault(key, []).append((places, prefix))
        self.held += places.nbytes + prefix.nbytes
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = open(self.path, "w+b")
        self.file.seek(0, os.SEEK_END)
        for runs in self.runs.values():
            if any(len(r) == 2 for r in runs):
                on_disk = [r for r in runs if len(r) == 3]
                fresh = runs[len(on_disk) :]
                at = self.file.tell()
                p, q = np.concatenate([r[0] for r in fresh]), np.concatenate([r[1] for r in fresh])
                self.file.write(p.tobytes())
                self.file.write(q.tobytes())
                runs[:] = [*on_disk, (at, len(p), p.dtype)]
        self.held = 0

    def pop(self, key: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The runs of a character in the order of arrival."""
        for run in self.runs.pop(key, ()):
            if len(run) == 2:
                self.held -= run[0].nbytes + run[1].nbytes
                yield run
            else:
                at, n, kind = run
                self.file.seek(at)
                p = np.frombuffer(self.file.read(n * kind.itemsize), kind)
                yield p, np.frombuffer(self.file.read(n * 2), np.uint16)

    def __contains__(self, key: int) -> bool:
        return key in self.runs

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            os.unlink(self.path)
            self.file = None


class _Minima:
    """Minimum of the prefix values of the sources scanned since a character was last pushed."""

    def __init__(self, sigma: int, cap: int):
        #: of each character: the batch of its last push, and the minimum over the rest of that batch
        self.batch, self.rest = np.full(sigma, -1, dtype=np.int64), np.full(sigma, cap, dtype=np.uint16)
        #: batches whose minimum is below that of all later ones
        self.at: list[int] = []
        self.least: list[int] = []
        self.count, self.cap = 0, cap

    def scan(self, values: np.ndarray, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``values``: of all sources of a batch; ``at``: those that induce, ``keys``: for which character.

        Returns the order by key, the starts of the keys in it, the keys, and the induced values."""
        n = len(values)
        order = np.argsort(keys, kind="stable")
        where, key = at[order], keys[order]
        first = np.ones(len(key), dtype=bool)
        first[1:] = key[1:] != key[:-1]
        begin = np.zeros(len(key), dtype=np.int64)
        begin[~first] = where[np.flatnonzero(~first) - 1] + 1
        # minima over 1, 2, 4, ... sources from each place on, row by row
        table = np.empty((max(1, n.bit_length()), n), dtype=np.uint16)
        table[0] = values
        for k in range(1, len(table)):
            m, w = n - (1 << k) + 1, 1 << (k - 1)
            np.minimum(table[k - 1, :m], table[k - 1, w : w + m], out=table[k, :m])
        flat = table.ravel()

        def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Minimum over a..b inclusive."""
            level = np.frexp((b - a + 1).astype(np.float64))[1].astype(np.int64) - 1
            row = level * n
            return np.minimum(flat[row + a], flat[row + b + 1 - (1 << level)])

        got = least(begin, where) if len(where) else np.zeros(0, np.uint16)
        starts = np.flatnonzero(first)
        named = key[starts]
        if len(named):
            later = np.searchsorted(np.array(self.at, dtype=np.int64), self.batch[named], side="right")
            since = np.minimum(np.array([*self.least, self.cap], dtype=np.uint16)[later], self.rest[named])
            got[starts] = np.minimum(got[starts], since)
        lowest = int(values.min())
        while self.least and self.least[-1] >= lowest:
            self.at.pop()
            self.least.pop()
        self.at.append(self.count)
        self.least.append(lowest)
        last = where[np.append(starts[1:], len(key)) - 1] if len(starts) else starts
        rest = np.full(len(named), self.cap, dtype=np.uint16)
        more = last + 1 < n
        if more.any():
            rest[more] = least(last[more] + 1, np.full(more.sum(), n - 1))
        self.rest[named], self.batch[named] = rest, self.count
        self.count += 1
        return order, starts, named, np.minimum(got + 1, self.cap).astype(np.uint16)


class _Text:
    """A string with its character kinds: the last character is 0 and stands nowhere else."""

    def __init__(self, text: np.ndarray, cap: int):
        n = len(text)
        self.text, self.n = text, n
        change = np.flatnonzero(text[1:] != text[:-1])
        # place at which the run of equal characters ends
        ends = np.append(change, n - 1)
        length = np.diff(np.concatenate([[-1], ends]))
        self.rising = np.repeat(np.append(text[change] < text[change + 1], True), length)
        run = np.repeat(ends, length) - np.arange(n) + 1
        self.run = np.minimum(run, cap).astype(np.uint16)
        self.minima = np.flatnonzero(self.rising[1:] & ~self.rising[:-1]) + 1


def _batches(places: np.ndarray, prefix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for a in range(0, len(places), BATCH):
        yield places[a : a + BATCH], prefix[a : a + BATCH]


def induce(s: _Text, seeds: np.ndarray, seed_prefix: np.ndarray, sigma: int, cap: int, work: str, memory: int,
           emit: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Scan twice; ``emit`` gets all suffixes in descending order, with the prefix shared with the one before.

    ``seeds`` are the minima, sorted (by character at least), with the prefix each shares with the last.
    """
    text = s.text
    kind = seeds.dtype
    up, falling = RunQueue(f"{work}/up", memory), RunQueue(f"{work}/falling", memory)
    seed_char = text[seeds]
    seed_at = np.searchsorted(seed_char, np.arange(sigma + 1))
    chars = np.flatnonzero(np.bincount(text, minlength=sigma))
    try:
        minima = _Minima(sigma, cap)

        def upward(places: np.ndarray, prefix: np.ndarray, c: int) -> list:
            """Induce the falling suffixes before these; those of the same character come back."""
            again = []
            for p, q in _batches(places, prefix):
                before = text[p - 1]
                at = np.flatnonzero((p > 0) & (before >= c) & ~s.rising[p - 1])
                order, starts, named, value = minima.scan(q, at, before[at])
                made = (p[at] - 1)[order]
                for a, b, key in zip(starts.tolist(), np.append(starts[1:], len(order)).tolist(), named.tolist(), strict=False):
                    if key == c:
                        again.append((made[a:b], value[a:b]))
                    else:
                        up.push(key, made[a:b], value[a:b])
            return again

        for c in chars.tolist():
            last = -1
            first = True
            todo = list(up.pop(c))
            while todo:
                p, q = np.concatenate([x[0] for x in todo]), np.concatenate([x[1] for x in todo])
                if first:
                    q = q.copy()
                    q[0], first = 0, False
                falling.push(c, p, q)
                last = int(p[-1])
                todo = upward(p, q, c)
            a, b = int(seed_at[c]), int(seed_at[c + 1])
            if a < b:
                p, q = seeds[a:b], seed_prefix[a:b].copy()
                q[0] = min(int(s.run[last]), int(s.run[p[0]])) if last >= 0 else 0
                upward(p, q, c)
        up.close()

        down = RunQueue(f"{work}/down", memory)
        minima = _Minima(sigma, cap)

        def downward(places: np.ndarray, prefix: np.ndarray, c: int) -> list:
            again = []
            for p, q in _batches(places, prefix):
                before = text[p - 1]
                at = np.flatnonzero((p > 0) & (before <= c) & s.rising[p - 1])
                order, starts, named, value = minima.scan(q, at, before[at])
                made = (p[at] - 1)[order]
                for a, b, key in zip(starts.tolist(), np.append(starts[1:], len(order)).tolist(), named.tolist(), strict=False):
                    if key == c:
                        again.append((made[a:b], value[a:b]))
                    else:
                        down.push(key, made[a:b], value[a:b])
            return again

        for c in chars[::-1].tolist():
            last, first = -1, True
            todo = list(down.pop(c))
            if c == 0:
                todo = [(np.array([s.n - 1], dtype=kind), np.zeros(1, np.uint16))]
            while todo:
                p, q = np.concatenate([x[0] for x in todo]), np.concatenate([x[1] for x in todo])
                if first:
                    q = q.copy()
                    q[0], first = 0, False
                emit(p, q)
                last = int(p[-1])
                todo = downward(p, q, c)
            if c in falling:
                # downwards: the values move one place
                runs = list(falling.pop(c))
                p = np.concatenate([x[0] for x in runs])[::-1]
                q = np.concatenate([x[1] for x in runs])[::-1]
                q = np.concatenate([[0], q[:-1]]).astype(np.uint16)
                q[0] = min(int(s.run[last]), int(s.run[p[0]])) if last >= 0 else 0
                emit(p, q)
                downward(p, q, c)
        down.close()
    finally:
        for queue in (up, falling, *([down] if "down" in locals() else [])):
            queue.close()


def _doubling(names: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes and shared prefixes (in names, up to ``cap``) of a string that fits in memory."""
    n = len(names)
    order = np.argsort(names)
    rank = np.empty(n, dtype=np.int32)

    def ranks(keys_equal: np.ndarray) -> np.ndarray:
        start = np.where(keys_equal, 0, np.arange(len(keys_equal)))
        return np.maximum.accumulate(start)

    same = np.zeros(n, dtype=bool)
    same[1:] = names[order][1:] == names[order][:-1]
    rank[order] = ranks(same)
    levels, step = [rank.copy()], 1
    while step < cap:
        open_ = same.copy()
        open_[:-1] |= same[1:]
        at = np.flatnonzero(open_)
        if not len(at):
            break
        places = order[at]
        ahead = np.where(places + step < n, rank[np.minimum(places + step, n - 1)], -1)
        own = rank[places]
        # groups stand in order already, so that few neighbours change places
        inner = np.argsort(own.astype(np.int64) << 32 | (ahead + 1), kind="stable")
        places, ahead, own = places[inner], ahead[inner], own[inner]
        order[at] = places
        new = np.zeros(len(at), dtype=bool)
        new[1:] = (own[1:] == own[:-1]) & (ahead[1:] == ahead[:-1])
        same[at] = new
        rank[places] = at[ranks(new)]
        levels.append(rank.copy())
        step *= 2
    prefix = np.zeros(n, dtype=np.int64)
    a, b = order[:-1], order[1:]
    # most neighbours differ in their first name
    alike = np.flatnonzero(levels[0][a] == levels[0][b])
    x, y = a[alike], b[alike]
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        eq = (x < n) & (y < n) & (level[np.minimum(x, n - 1)] == level[np.minimum(y, n - 1)])
        x, y = x + (eq.astype(np.int64) << k), y + (eq.astype(np.int64) << k)
    prefix[alike + 1] = x - a[alike]
    # a suffix that ends inside a comparison shares no more than its length
    if n > 1:
        prefix[1:] = np.minimum(prefix[1:], n - np.maximum(a, b))
    return order, np.minimum(prefix, cap)


def _sorted_names(names: np.ndarray, cap: int, work: str, memory: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    if len(names) <= base:
        return _doubling(names, cap)
    text = np.append(names + 1, 0).astype(np.int32 if len(names) < 2**31 - 2 else np.int64)
    places, prefix = [], []
    sort_suffixes(text, int(text.max()) + 1, cap, work, memory, lambda p, q: (places.append(p), prefix.append(q)), base)
    p, q = np.concatenate(places)[::-1], np.concatenate(prefix)[::-1]
    # upwards, without the closing character, which is the smallest
    return p[1:], np.concatenate([[0], q[1:-1]]).astype(np.int64)[: len(p) - 1]


def _names(text: np.ndarray, lms: np.ndarray, size: np.ndarray, sigma: int) -> np.ndarray:
    """Ranks of the pieces between minima, equal pieces alike.

    A few characters at a time make one number; only pieces that are still equal are read on. Where
    one piece is the beginning of another it ends on a rise and the other goes on falling, so the
    longer one comes first: what lies behind a piece's end counts as the largest character.
    """
    bits = (sigma + 1).bit_length()
    width, pad = max(1, 62 // bits), (1 << bits) - 1
    n = len(lms)

    def key(which: np.ndarray, depth: int) -> np.ndarray:
        out = np.zeros(len(which), dtype=np.int64)
        at, left = lms[which].astype(np.int64) + depth, size[which] - depth
        for j in range(width):
            c = text[np.minimum(at + j, len(text) - 1)].astype(np.int64)
            out = out << bits | np.where(j < left, c, pad)
        return out

    every = np.arange(n)
    keys = key(every, 0)
    order = np.argsort(keys)
    ordered = keys[order]
    same = np.zeros(n, dtype=bool)
    same[1:] = ordered[1:] == ordered[:-1]
    depth = width
    live = np.flatnonzero(same)
    while len(live):
        # groups of equals of which a piece goes on; one that ended with the last number comes after
        group = np.zeros(n, dtype=bool)
        group[live] = group[live - 1] = True
        at = np.flatnonzero(group)
        first = np.flatnonzero(~same[at])
        on = np.logical_or.reduceat(size[order[at]] > depth, first)
        at = at[np.repeat(on, np.diff(np.append(first, len(at))))]
        if not len(at):
            break
        start = np.maximum.accumulate(np.where(same[at], -1, at))
        members = order[at]
        keys = key(members, depth)
        inner = np.lexsort((keys, start))
        order[at] = members[inner]
        keys, start = keys[inner], start[inner]
        still = np.zeros(len(at), dtype=bool)
        still[1:] = (start[1:] == start[:-1]) & (keys[1:] == keys[:-1])
        same[at] = still
        live, depth = at[still], depth + width
    names = np.empty(n, dtype=np.int64)
    names[order] = np.cumsum(~same) - 1
    return names


def sort_suffixes(text: np.ndarray, sigma: int, cap: int, work: str, memory: int, emit: Callable[[np.ndarray, np.ndarray], None], base: int = BASE) -> None:
    """Sort the suffixes of ``text`` (its last character 0, and only that one), in descending order.

    ``emit(places, prefix)`` is called with runs of suffixes; prefix is what each shares with the
    suffix emitted before it, up to ``cap``.
    """
    s = _Text(text, cap)
    kind = np.int32 if s.n < 2**31 else np.int64
    lms = s.minima.astype(kind)
    os.makedirs(work, exist_ok=True)
    # pieces run from a minimum to the next, both included
    size = np.append(lms[1:], s.n - 1) - lms + 1
    names = _names(text, lms, size, sigma)
    # minima are two characters apart at least, so half as many names as characters decide
    rank, shared = _sorted_names(names, cap // 2 + 1, f"{work}/names", memory, base)
    # shared prefixes in characters: whole pieces, then the characters up to the first that differs
    prefix = np.zeros(len(lms), dtype=np.int64)
    if len(rank) > 1:
        x, y = rank[:-1], rank[1:]
        px = lms[np.minimum(x + shared[1:], len(lms) - 1)].astype(np.int64)
        py = lms[np.minimum(y + shared[1:], len(lms) - 1)].astype(np.int64)
        length = px - lms[x]
        bits = sigma.bit_length()
        width = max(1, 52 // bits)

        def packed(at: np.ndarray) -> np.ndarray:
            out = np.zeros(len(at), dtype=np.int64)
            for j in range(width):
                out = out << bits | text[np.minimum(at + j, s.n - 1)]
            return out

        live = np.flatnonzero(length < cap)
        u, v = px[live], py[live]
        while len(live):
            # characters above the highest bit that differs; the closing 0 stands at one place only
            differ = packed(u) ^ packed(v)
            equal = (width * bits - np.frexp(differ.astype(np.float64))[1]) // bits
            length[live] += equal
            on = (differ == 0) & (length[live] < cap)
            live, u, v = live[on], u[on] + width, v[on] + width
        prefix[1:] = np.minimum(length, cap)
    induce(s, lms[rank], prefix.astype(np.uint16), sigma, cap, work, memory, emit)
