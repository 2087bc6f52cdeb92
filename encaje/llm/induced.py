"""Suffix sorting of one shard by external induced sorting, with common-prefix values.

Suffixes that start a rising stretch after a falling one (the seeds) are sorted first: their substrings by
a first induction, the order of whole seeds by doubling over the names of the substrings. All other
suffixes follow by induction: whoever is taken in order hands on the suffix one symbol longer. These
tuples (position, common prefix with the one before) wait in queues by first symbol, which keep
the order of arrival and so act as one priority queue; beyond a memory bound they lie in a
temporary file of the task. Common prefixes travel along: one more symbol than the least
common prefix met since the queue's last arrival. All values are capped at the length asked for.

Steps are taken for whole queues at once with numpy, so a symbol costs array work only.
"""

from __future__ import annotations

import tempfile

import numpy as np

SMALL = 258  # symbols below have a queue each; the larger ones share one
MEMORY = 256 << 20


class Queues:
    """Tuples by first symbol in order of arrival; chunks move to a file beyond the bound."""

    def __init__(self, memory: int) -> None:
        self.parts: list[list] = [[] for _ in range(SMALL + 1)]
        self.memory, self.held, self.file = memory, 0, None

    def push(self, queue: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.parts[queue].append((pos, lcp))
        self.held += pos.nbytes + lcp.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for part in self.parts:
            for i, chunk in enumerate(part):
                if isinstance(chunk[0], np.ndarray):
                    at = self.file.tell()
                    self.file.write(chunk[0].astype(np.int64).tobytes())
                    self.file.write(chunk[1].astype(np.int16).tobytes())
                    part[i] = (at, len(chunk[0]))
        self.held = 0

    def take(self, queue: int) -> tuple[np.ndarray, np.ndarray]:
        chunks = []
        for pos, lcp in self.parts[queue]:
            if isinstance(pos, np.ndarray):
                self.held -= pos.nbytes + lcp.nbytes
            else:
                self.file.seek(pos)
                n = lcp
                pos = np.frombuffer(self.file.read(8 * n), dtype=np.int64)
                lcp = np.frombuffer(self.file.read(2 * n), dtype=np.int16)
            chunks.append((pos, lcp))
        self.parts[queue] = []
        if not chunks:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int16)
        if len(chunks) == 1:
            return chunks[0]
        return np.concatenate([c[0] for c in chunks]), np.concatenate([c[1] for c in chunks])


def range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of ``values[low..high]``, both included."""
    size = high - low + 1
    level = np.frexp(size.astype(np.float64))[1] - 1
    table = [values]
    for k in range(int(level.max(initial=0))):
        half = 1 << k
        t = table[-1].copy()
        np.minimum(t[:-half], t[half:], out=t[:-half])
        table.append(t)
    out = np.empty(len(low), dtype=values.dtype)
    for k, t in enumerate(table):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(t[low[at]], t[high[at] - (1 << k) + 1])
    return out


class Sorter:
    """Sort the suffixes of ``text`` up to ``cap`` symbols; its last symbol is its only 0.

    Symbols of ``SMALL`` and above must be followed by smaller ones.
    """

    def __init__(self, text: np.ndarray, cap: int, memory: int = MEMORY) -> None:
        self.n, self.cap, self.memory = len(text), cap, memory
        self.sigma = int(text.max()) + 1
        self.text = text.astype(np.uint16 if self.sigma <= 1 << 16 else np.int32)
        step = np.diff(text.astype(np.int64))
        change = np.flatnonzero(step)
        rises = np.zeros(self.n, dtype=bool)  # type S
        rises[-1] = True
        if len(change):
            nearest = np.searchsorted(change, np.arange(self.n - 1))
            rises[:-1] = step[change[np.minimum(nearest, len(change) - 1)]] > 0
        self.is_seed = np.zeros(self.n, dtype=bool)
        self.is_seed[1:] = rises[1:] & ~rises[:-1]
        self.seeds = np.flatnonzero(self.is_seed)

    def compare(self, a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Common prefix of suffixes a and b that share ``start`` symbols already."""
        out = np.minimum(start, self.cap).astype(np.int64)
        live = np.flatnonzero(out < self.cap)
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            inside = (x < self.n) & (y < self.n)
            live, x, y = live[inside], x[inside], y[inside]
            live = live[self.text[x] == self.text[y]]
            out[live] += 1
            live = live[out[live] < self.cap]
        return out

    def names(self, order: np.ndarray) -> np.ndarray:
        """Names of seed substrings, sorted by a first induction: equal ones share a name."""
        length = np.zeros(self.n, dtype=np.int64)
        length[self.seeds[:-1]] = np.diff(self.seeds) + 1
        length[self.seeds[-1]] = 1
        a, b = order[:-1], order[1:]
        same = length[a] == length[b]
        live, offset = np.flatnonzero(same), 0
        size = length[a]
        while len(live):
            equal = self.text[a[live] + offset] == self.text[b[live] + offset]
            same[live[~equal]] = False
            live = live[equal]
            offset += 1
            live = live[size[live] > offset]
        name = np.zeros(self.n, dtype=np.int64)
        name[order] = np.concatenate([[0], np.cumsum(~same)])
        return name[self.seeds]

    def sorted_seeds(self) -> tuple[np.ndarray, np.ndarray]:
        """Seeds in order of their suffixes, and common prefixes with the one before."""
        first = self.seeds[np.argsort(self.text[self.seeds], kind="stable")]
        _, falling = self.induce(first, None)
        order = np.concatenate([p[::-1] for p in falling[::-1]]) if falling else first[:0]
        order = np.concatenate([[self.n - 1], order[self.is_seed[order]]])
        name = self.names(order)
        m, k, ranks = len(name), 1, [name]
        while ranks[-1].max() < m - 1 and 2 * k < self.cap + 2:  # a name spans 2 symbols or more
            key = ranks[-1] * (m + 1)
            key[:m - k] += ranks[-1][k:] + 1
            at = np.argsort(key, kind="stable")
            rank = np.empty(m, dtype=np.int64)
            rank[at] = np.concatenate([[0], np.cumsum(key[at][1:] != key[at][:-1])])
            ranks.append(rank)
            k *= 2
        at = np.argsort(ranks[-1], kind="stable")
        i, j = at[:-1].copy(), at[1:].copy()
        for level in range(len(ranks) - 1, -1, -1):
            inside = (i < m) & (j < m)
            equal = np.zeros(len(i), dtype=bool)
            equal[inside] = ranks[level][i[inside]] == ranks[level][j[inside]]
            i[equal] += 1 << level
            j[equal] += 1 << level
        ends = np.concatenate([self.seeds, [self.n]])
        a, b = self.seeds[at[:-1]], self.seeds[at[1:]]
        known = np.minimum(ends[np.minimum(i, m)] - a, ends[np.minimum(j, m)] - b)
        lcp = np.concatenate([[0], self.compare(a, b, known)])
        return self.seeds[at], lcp.astype(np.int16)

    def _push(self, queues: Queues, pos: np.ndarray, lcp: np.ndarray | None, keep: np.ndarray,
              target: np.ndarray) -> None:
        """Hand on the suffixes one symbol longer, in order, with their common prefixes."""
        k = np.flatnonzero(keep)
        if lcp is not None and len(lcp):
            least = lcp.min()
            before = self.since.copy() if len(k) else None
            np.minimum(self.since, least, out=self.since)
        if not len(k):
            return
        by = np.argsort(target[k], kind="stable")
        k = k[by]
        symbol = target[k]
        cut = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
        head = np.concatenate([[0], cut])
        tail = np.concatenate([cut, [len(k)]]) - 1
        if lcp is None:
            value = np.zeros(len(k), dtype=np.int16)
        else:
            value = np.zeros(len(k), dtype=np.int16)
            rest = np.ones(len(k), dtype=bool)
            rest[head] = False
            rest = np.flatnonzero(rest)
            if len(rest):
                value[rest] = range_min(lcp, k[rest - 1] + 1, k[rest]) + 1
            upto = np.minimum.accumulate(lcp)
            d = symbol[head]
            value[head] = np.where(self.met[d], np.minimum(before[d], upto[k[head]]) + 1, 0)
            np.minimum(value, self.cap, out=value)
            after = np.concatenate([np.minimum.accumulate(lcp[::-1])[::-1], [self.cap]])
            self.since[symbol[tail]] = after[k[tail] + 1]
            self.met[symbol[head]] = True
        moved = pos[k] - 1
        for a, b, d in zip(head.tolist(), (tail + 1).tolist(), symbol[head].tolist(),
                           strict=True):
            queues.push(min(d, SMALL), moved[a:b], value[a:b])

    def _link(self, last: int | None, pos: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        """The first common prefix of a batch, seen from the suffix taken before it."""
        lcp = lcp.copy()
        if len(pos):
            lcp[0] = 0 if last is None else self.compare(
                np.array([last]), pos[:1], np.zeros(1, dtype=np.int64))[0]
        return lcp

    def induce(self, seeds: np.ndarray, seed_lcp: np.ndarray | None) -> tuple[list, list]:
        """Order of the falling suffixes, then of the rising ones in descending order.

        Returns chains of (position, common prefix with the one before in the chain), or of
        positions alone if no seed values are given.
        """
        carry, text = seed_lcp is not None, self.text
        self.since = np.full(self.sigma, self.cap, dtype=np.int16)
        self.met = np.zeros(self.sigma, dtype=bool)
        queues = Queues(self.memory)
        edge = np.searchsorted(text[seeds], np.arange(SMALL + 1), side="left")
        store = Queues(self.memory)  # falling suffixes by bucket, kept for the second pass
        chains: list = []

        def hand_on(pos: np.ndarray, lcp: np.ndarray, wanted) -> None:
            before = text[pos - 1]
            self._push(queues, pos, lcp if carry else None, wanted(before) & (pos > 0), before)

        for c in range(SMALL):
            last = None
            while queues.parts[c]:
                pos, lcp = queues.take(c)
                store.push(c, pos, lcp)
                chains.append((pos, lcp))
                hand_on(pos, lcp, lambda s: s >= c)
                last = int(pos[-1])
            a, b = edge[c], edge[c + 1]
            if b > a:
                pos = seeds[a:b]
                lcp = self._link(last, pos, seed_lcp[a:b]) if carry else None
                hand_on(pos, lcp, lambda s: s > c)
        pos, lcp = queues.take(SMALL)
        by = np.argsort(text[pos], kind="stable")
        pos, lcp = pos[by], lcp[by]
        chains.append((pos, lcp))
        self.since[:] = self.cap
        self.met[:] = False
        rising: list = []
        hand_on(pos[::-1], self._descend(lcp), lambda s: s < SMALL)
        for c in range(SMALL - 1, -1, -1):
            last = None
            while queues.parts[c]:
                pos, lcp = queues.take(c)
                rising.append((pos, lcp))
                hand_on(pos, lcp, lambda s: s <= c)
                last = int(pos[-1])
            pos, lcp = store.take(c)
            if len(pos):
                down = pos[::-1]
                hand_on(down, self._link(last, down, self._descend(lcp)) if carry else lcp,
                        lambda s: s < c)
        if not carry:
            return [p for p, _ in chains], [p for p, _ in rising]
        return chains, rising

    @staticmethod
    def _descend(lcp: np.ndarray) -> np.ndarray:
        """Common prefixes of a chain, read from its end."""
        return np.concatenate([[0], lcp[:0:-1]]).astype(np.int16) if len(lcp) else lcp


def repeated_starts(text: np.ndarray, cap: int, memory: int = MEMORY) -> np.ndarray:
    """Marks each position whose next ``cap`` symbols, not all the same, also start elsewhere."""
    mark = np.zeros(len(text), dtype=bool)
    sorter = Sorter(text, cap, memory)
    seeds, lcp = sorter.sorted_seeds()
    for part in sorter.induce(seeds, lcp):
        chain = [c for c in part if len(c[0])]
        if not chain:
            continue
        pos = np.concatenate([c[0] for c in chain])
        hit = np.flatnonzero(np.concatenate([c[1] for c in chain]) >= cap)
        mark[pos[hit]] = True
        mark[pos[hit - 1]] = True
    return mark
