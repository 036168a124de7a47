"""External induced suffix sorting with common-prefix lengths.

The sorter induces all suffixes from the sorted left-most-S ones in two scans.  A
scan pops suffix tuples (place, common prefix with the tuple before) from a monotone
priority queue keyed by first symbol; a popped tuple whose predecessor is of the
scan's type pushes that predecessor, and its common prefix is one more than the
least on the stretch since the last push to the same key.  Pushes to a key arrive
in order, so the queue keeps a run for each key and spills runs to an unlinked
temporary file beyond its memory budget, as Spark's own sorter does.

Order and common prefixes are exact up to ``depth`` symbols; suffixes equal that far
may come in any order.  Ranks of the left-most-S suffixes come from the names of
their substrings, found by an induction of the same kind, and prefix doubling on
the reduced string, which stops once ``depth`` symbols are covered.
"""

from __future__ import annotations

import tempfile

import numpy as np

SENTINEL, SEPARATOR, SHIFT = 0, 1, 2


class Queue:
    """Runs of (place, common prefix) by key; pops give a key's tuples in the order of their pushes."""

    def __init__(self, budget: int):
        self.budget, self.held, self.runs, self.file, self.spilled = budget, 0, {}, None, 0

    def push(self, key: int, place: np.ndarray, lcp: np.ndarray) -> None:
        self.runs.setdefault(key, []).append((place, lcp))
        self.held += place.nbytes + lcp.nbytes
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for runs in self.runs.values():
            for k, r in enumerate(runs):
                if len(r) == 2 and isinstance(r[0], np.ndarray):
                    at = self.file.seek(0, 2)
                    self.file.write(r[0].tobytes() + r[1].tobytes())
                    runs[k] = (at, len(r[0]))
        self.spilled += self.held
        self.held = 0

    def pop(self, key: int) -> tuple[np.ndarray, np.ndarray]:
        places, lcps = [], []
        for a, b in self.runs.pop(key, ()):
            if isinstance(a, np.ndarray):
                self.held -= a.nbytes + b.nbytes
            else:
                self.file.seek(a)
                a, b = np.frombuffer(self.file.read(4 * b), np.int32), np.frombuffer(self.file.read(b), np.uint8)
            places.append(a)
            lcps.append(b)
        if len(places) == 1:
            return places[0], lcps[0]
        return (np.concatenate(places), np.concatenate(lcps)) if places else (np.zeros(0, np.int32), np.zeros(0, np.uint8))


def between(lcp: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min of lcp[lo..hi], both inclusive, lo <= hi."""
    out = np.empty(len(lo), np.uint8)
    span = hi - lo + 1
    level, table, k = 1, lcp, np.zeros(len(lo), np.int64)
    width = span.copy()
    while (width > 1).any():
        width >>= 1
        k += width > 0
    order = np.argsort(k, kind="stable")
    cuts = np.searchsorted(k[order], np.arange((int(k.max()) if len(k) else 0) + 2))
    for j in range(len(cuts) - 1):
        some = order[cuts[j] : cuts[j + 1]]
        if len(some):
            out[some] = np.minimum(table[lo[some]], table[hi[some] - level + 1])
        if j < len(cuts) - 2:
            table = np.minimum(table[:-level], table[level:])
            level *= 2
    return out


class Scan:
    """Both scans over one text of unsigned bytes that ends with its only SENTINEL."""

    def __init__(self, text: np.ndarray, depth: int, budget: int):
        self.text, self.depth, self.budget = text, depth, budget
        change = np.flatnonzero(text[1:] != text[:-1])
        self.small = np.append(np.repeat(text[change + 1] > text[change], np.diff(change, prepend=-1)), True)
        self.lms = np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1
        self.keys = np.flatnonzero(np.bincount(text, minlength=256))

    def run(self, place: int) -> int:
        """How often the symbol at a place repeats, up to the depth."""
        stretch = self.text[place : place + self.depth]
        other = np.flatnonzero(stretch != stretch[0])
        return int(other[0]) if len(other) else len(stretch)

    def induce(self, place, lcp, small: bool, queue: Queue, carry, count: bool) -> None:
        before = place - 1
        at = np.flatnonzero((place > 0) & (self.small[before] == small))
        key = self.text[before[at]]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        head = np.concatenate([[0], cut]).astype(np.int64) if len(at) else np.zeros(0, np.int64)
        new = np.zeros(len(at), np.uint8)
        if count:
            if len(at):
                inner = np.ones(len(at), bool)
                inner[head] = False
                inner = np.flatnonzero(inner)
                new[inner] = between(lcp, at[inner - 1] + 1, at[inner]) if len(inner) else 0
                new[head] = np.minimum(np.minimum.accumulate(lcp)[at[head]], carry[key[head]])
                first = carry[key[head]] == 255
                new = np.minimum(new + 1, self.depth).astype(np.uint8)
                new[head[first]] = 0
            live = carry != 255
            carry[live] = np.minimum(carry[live], lcp.min())
            if len(at):
                last = np.append(cut, len(at)) - 1
                tail = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint8(254))
                carry[key[last]] = np.minimum(tail[at[last] + 1], 254)
        before = before[at].astype(np.int32)
        for lo, hi in zip(head.tolist(), np.append(cut, len(at)).tolist(), strict=False):
            queue.push(int(key[lo]), before[lo:hi], new[lo:hi])

    def suffixes(self, seeds: dict[int, tuple[np.ndarray, np.ndarray]], count: bool):
        """Blocks (place, common prefix with the one before) of all suffixes but the last, by falling order."""
        queue, large = Queue(self.budget), Queue(self.budget)
        carry = np.full(256, 255, np.uint8)
        for c in self.keys.tolist():
            last = -1
            while True:
                place, lcp = queue.pop(c)
                if not len(place):
                    break
                large.push(c, place, lcp)
                last = int(place[-1])
                self.induce(place, lcp, False, queue, carry, count)
            if c in seeds:
                place, lcp = seeds[c]
                if count:
                    lcp = lcp.copy()
                    lcp[0] = min(self.run(last), self.run(int(place[0]))) if last >= 0 else 0
                self.induce(place, lcp, False, queue, carry, count)
        carry = np.full(256, 255, np.uint8)
        for c in self.keys[::-1].tolist():
            last = -1
            while True:
                place, lcp = queue.pop(c)
                if not len(place):
                    break
                yield place, lcp
                last = int(place[-1])
                self.induce(place, lcp, True, queue, carry, count)
            place, lcp = large.pop(c)
            if len(place):
                place, lcp = place[::-1], np.concatenate([[0], lcp[:0:-1]]).astype(np.uint8)
                if count and last >= 0:
                    lcp[0] = min(self.run(last), self.run(int(place[0])))
                yield place, lcp
                self.induce(place, lcp, True, queue, carry, count)

    def by_key(self, place: np.ndarray, lcp: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        key = self.text[place]
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        return {int(self.text[p[0]]): (p.astype(np.int32), x) for p, x in zip(np.split(place, cut), np.split(lcp, cut), strict=True) if len(p)}

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray | int) -> np.ndarray:
        """Equal leading symbols at places a and b, up to ``most``; eight at a time."""
        padded = np.concatenate([self.text, np.zeros(8, np.uint8)])
        eight = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(self.text),), (1,))
        out = np.zeros(len(a), np.int64)
        live, k, end = np.arange(len(a)), 0, len(self.text) - 1
        while len(live) and k < self.depth:
            x = eight[np.minimum(a[live] + k, end)] ^ eight[np.minimum(b[live] + k, end)]
            same = x == 0
            low = x & (~x + np.uint64(1))
            out[live] = k + np.where(same, 8, np.bitwise_count(low - np.uint64(1)) // 8)
            live, k = live[same], k + 8
        return np.minimum(out, most)

    def seeds(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """The left-most-S suffixes in order, by key, with common prefixes."""
        lms, n = self.lms, len(self.lms)
        rough = lms[np.argsort(self.text[lms], kind="stable")]
        is_lms = np.zeros(len(self.text), bool)
        is_lms[lms] = True
        found = [p[is_lms[p]] for p, _ in self.suffixes(self.by_key(rough, np.zeros(n, np.uint8)), False)]
        order = np.concatenate([[lms[-1]], np.concatenate(found)[::-1]]) if found else lms
        # names: equal substrings, up to the next left-most-S place, share one
        index = np.zeros(len(self.text), np.int32)
        index[lms] = np.arange(n)
        size = np.append(np.diff(lms) + 1, 1)
        a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
        la, lb = np.minimum(size[index[a]], self.depth), np.minimum(size[index[b]], self.depth)
        differ = (la != lb) | (self.common(a, b, self.depth) < la)
        name = np.zeros(n, np.int64)
        name[index[order]] = np.concatenate([[0], np.cumsum(differ)])
        # every left-most-S place is two symbols or more from the next
        step = 1
        while name.max() < n - 1 and 2 * step < self.depth + 2:
            after = np.append(name[step:] + 1, np.zeros(min(step, n), np.int64))[:n]
            _, name = np.unique(name * (n + 1) + after, return_inverse=True)
            step *= 2
        order = lms[np.argsort(name, kind="stable")]
        lcp = np.zeros(n, np.uint8)
        lcp[1:] = self.common(order[:-1].astype(np.int64), order[1:].astype(np.int64), self.depth)
        return self.by_key(order, lcp)


def sorted_suffixes(text: np.ndarray, depth: int, budget: int = 256 << 20):
    """Blocks (place, common prefix with the one before, at most ``depth``) by falling order."""
    scan = Scan(text, depth, budget)
    yield from scan.suffixes(scan.seeds(), True)


def repeats(text: np.ndarray, depth: int, budget: int = 256 << 20) -> np.ndarray:
    """Places whose ``depth`` symbols also stand at an earlier place."""
    out, group, tail = [], None, None
    for place, lcp in sorted_suffixes(text, depth, budget):
        if tail is not None:  # a run of equal stretches may go on
            joined = lcp[0] >= depth
            place = np.concatenate([tail, place]) if joined else place
            lcp = np.concatenate([np.full(len(tail), depth, np.uint8), lcp]) if joined else lcp
            if not joined and len(tail) > 1:
                out.append(tail[tail != tail.min()])
        start = np.flatnonzero(lcp < depth)
        start = np.concatenate([[0], start[start > 0]])
        tail = place[start[-1] :]
        head, lead = place[: start[-1]], start[:-1]
        if len(head):
            least = np.repeat(np.minimum.reduceat(head, lead), np.diff(start))
            out.append(head[head != least])
    if tail is not None and len(tail) > 1:
        out.append(tail[tail != tail.min()])
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int32)
