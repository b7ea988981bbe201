"""External induced sorting of suffixes with common-prefix values.

One bucket a symbol; each bucket is a queue of suffix tuples (position, common prefix with its predecessor in the
queue) that is filled in sorted order, so it works as the priority queue of that symbol, and spills to disk beyond a
memory bound.  Reading the buckets in order, every suffix induces the one that starts a symbol earlier: first the
larger-than-next (L) suffixes from the sorted seeds, then the smaller-than-next (S) ones from the L ones.  The
common prefix of two induced neighbours is one more than the minimum over the stretch between their inducers.

Seeds are the leftmost-S (LMS) suffixes.  They are named by one more round of the same induction over unsorted seeds;
if names repeat, the string of names, two base-65536 digits a name, is sorted by recursion; strings of names that fit
into memory are sorted by doubling.  Common prefixes are capped: nothing here needs more than the cap.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

from millrace.llm.common import U64, mixed

#: Tuples handled at a time.
BLOCK = 1 << 16
_TUPLE = np.dtype([("pos", "<i8"), ("lcp", "<i4")])


class Spill:
    """Disk space of one sort: a temporary file that all its queues append to, and what they may hold in memory."""

    def __init__(self, memory: int):
        self.memory, self.held = memory, 0
        self.file = tempfile.TemporaryFile(prefix="millrace-sort-")
        self.end = 0

    def write(self, data: np.ndarray) -> tuple[int, int]:
        self.file.seek(self.end)
        self.file.write(data.tobytes())
        place = (self.end, len(data))
        self.end += data.nbytes
        return place

    def read(self, place: tuple[int, int]) -> np.ndarray:
        self.file.seek(place[0])
        return np.frombuffer(self.file.read(place[1] * _TUPLE.itemsize), _TUPLE)


class Queue:
    """Suffix tuples of one bucket in sorted order; blocks beyond the shared memory bound live on disk."""

    def __init__(self, spill: Spill):
        self.spill, self.blocks, self.size = spill, [], 0

    def append(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        block = np.empty(len(pos), _TUPLE)
        block["pos"], block["lcp"] = pos, lcp
        self.size += len(block)
        last = self.blocks[-1] if self.blocks else None
        if isinstance(last, np.ndarray) and len(last) + len(block) <= BLOCK // 8 and not getattr(self, "reading", False):
            self.blocks[-1] = np.concatenate([last, block])
            self.spill.held += block.nbytes
            return
        if self.spill.held + block.nbytes > self.spill.memory and len(block):
            self.blocks.append(self.spill.write(block))
        else:
            self.spill.held += block.nbytes
            self.blocks.append(block)

    def block(self, k: int) -> np.ndarray:
        return self.blocks[k] if isinstance(self.blocks[k], np.ndarray) else self.spill.read(self.blocks[k])

    def forward(self) -> Iterator[np.ndarray]:
        """Blocks in order, those appended meanwhile too."""
        self.reading, k = True, 0
        while k < len(self.blocks):
            got = [self.block(k)]
            k += 1
            size = len(got[0])
            while k < len(self.blocks) and size + self.length(k) <= BLOCK:
                got.append(self.block(k))
                size += len(got[-1])
                k += 1
            yield np.concatenate(got) if len(got) > 1 else got[0]

    def backward(self) -> Iterator[np.ndarray]:
        k = len(self.blocks) - 1
        while k >= 0:
            got = [self.block(k)]
            k -= 1
            size = len(got[0])
            while k >= 0 and size + self.length(k) <= BLOCK:
                got.append(self.block(k))
                size += len(got[-1])
                k -= 1
            yield np.concatenate(got[::-1]) if len(got) > 1 else got[0]

    def length(self, k: int) -> int:
        return len(self.blocks[k]) if isinstance(self.blocks[k], np.ndarray) else self.blocks[k][1]


def _range_minima(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """min(values[start:stop]) for each pair (start < stop), by a sparse table."""
    table, width = [values], 1
    longest = int((stop - start).max()) if len(start) else 1
    while width * 2 <= longest:
        prev = table[-1]
        table.append(np.minimum(prev[:-width], prev[width:]))
        width *= 2
    level = np.frexp((stop - start).astype(np.float64))[1] - 1
    out = np.empty(len(start), values.dtype)
    for k in range(len(table)):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(table[k][start[at]], table[k][stop[at] - (1 << k)])
    return out


class Inducer:
    """Takes scanned suffixes in order and appends those they induce to the queues of their first symbols."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, queues: dict[int, Queue], spill: Spill, cap: int, alphabet: int):
        self.text, self.wanted, self.queues, self.spill, self.cap = text, wanted, queues, spill, cap
        # minimum of the scanned common prefixes since a bucket was appended to last; -1: nothing there yet
        self.since = np.full(alphabet, -1, np.int32)

    def scan(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        for a in range(0, len(pos), BLOCK):
            self._scan(pos[a:a + BLOCK], lcp[a:a + BLOCK])

    def _scan(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        if not len(pos):
            return
        cap = self.cap
        at = np.flatnonzero(pos > 0)
        before = pos[at] - 1
        ok = self.wanted[before]
        at, before = at[ok], before[ok]
        if not len(at):
            if cap:
                self.since = np.where(self.since >= 0, np.minimum(self.since, lcp.min()), -1)
            return
        symbol = self.text[before].astype(np.int64)
        order = np.argsort(symbol, kind="stable")
        at, before, symbol = at[order], before[order], symbol[order]
        first = np.ones(len(at), bool)
        first[1:] = symbol[1:] != symbol[:-1]
        heads = np.flatnonzero(first)
        used = symbol[heads]
        if cap:
            start = np.zeros(len(at), np.int64)
            start[1:] = np.where(first[1:], 0, at[:-1] + 1)
            low = _range_minima(lcp, start, at + 1)
            low[heads] = np.minimum(low[heads], self.since[used])  # -1 stays where the bucket was empty
            induced = np.minimum(low + 1, cap).astype(np.int32)
            tails = np.append(heads[1:], len(at)) - 1
            suffix_low = np.append(np.minimum.accumulate(lcp[::-1])[::-1], cap)
            self.since = np.where(self.since >= 0, np.minimum(self.since, lcp.min()), -1).astype(np.int32)
            self.since[used] = suffix_low[at[tails] + 1]
        else:
            induced = np.zeros(len(at), np.int32)
        for s, a, b in zip(used.tolist(), heads.tolist(), [*heads[1:].tolist(), len(at)]):
            queue = self.queues.get(s)
            if queue is None:
                queue = self.queues[s] = Queue(self.spill)
            queue.append(before[a:b], induced[a:b])


def types_of(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """S-type flags, and for each position the length of the run of its symbol that starts there."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1]) + 1
    ends = np.append(change, n)
    starts = np.concatenate([[0], change])
    sizes = ends - starts
    run = np.repeat(ends, sizes) - np.arange(n)
    smaller = np.empty(len(starts), bool)
    smaller[:-1] = text[starts[:-1]] < text[starts[1:]]
    smaller[-1] = True  # the sentinel
    return np.repeat(smaller, sizes), run


def induce(text: np.ndarray, is_s: np.ndarray, run: np.ndarray, seeds: dict[int, tuple[np.ndarray, np.ndarray]], cap: int,
           memory: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted suffixes from the largest to the smallest, each with its common prefix with the next *larger* one.

    seeds: positions (sorted) and common prefixes of the LMS suffixes of each symbol.  cap 0: no common prefixes.
    """
    spill = Spill(memory)
    alphabet = int(text.max()) + 1
    lower: dict[int, Queue] = {}
    inducer = Inducer(text, ~is_s, lower, spill, cap, alphabet)
    seams: dict[int, int] = {}
    present = np.unique(text).tolist()
    for c in present:
        last = None
        queue = lower.get(c)
        if queue is None:
            queue = lower[c] = Queue(spill)
        for block in queue.forward():
            inducer.scan(block["pos"], block["lcp"])
            last = int(block["pos"][-1])
        if c in seeds:
            pos, lcp = seeds[c]
            if cap and len(pos):
                lcp = lcp.copy()
                lcp[0] = 0 if last is None else min(run[last], run[pos[0]], cap)
            inducer.scan(pos, lcp)
    upper: dict[int, Queue] = {}
    inducer = Inducer(text, is_s, upper, spill, cap, alphabet)
    n = len(text)
    upper[int(text[n - 1])] = q = Queue(spill)  # the sentinel is the smallest suffix
    q.append(np.array([n - 1]), np.array([0]))
    for c in reversed(present):
        last = None
        queue = upper.get(c)
        if queue is not None:
            for block in queue.forward():
                inducer.scan(block["pos"], block["lcp"])
                last = int(block["pos"][-1])
                yield block["pos"], block["lcp"]
        carried = None
        for block in lower[c].backward():
            pos = block["pos"][::-1]
            lcp = np.empty(len(pos), np.int32)
            lcp[1:] = block["lcp"][::-1][:-1]
            if carried is None:
                lcp[0] = 0 if last is None or not cap else min(run[last], run[pos[0]], cap)
            else:
                lcp[0] = carried
            carried = block["lcp"][0]
            inducer.scan(pos, lcp)
            yield pos, lcp
    spill.file.close()


def _by_doubling(names: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of a string of names that fits into memory."""
    rank, width, n = names.astype(np.int64), 1, len(names)
    while True:
        second = np.full(n, -1, np.int64)
        if width < n:
            second[:-width] = rank[width:]
        order = np.lexsort((second, rank))
        new = np.ones(n, bool)
        a, b = rank[order], second[order]
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if new.all():
            return rank
        width *= 2


def _prefix_hash(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    from millrace.llm.suffix_dedup import _BASES, RollingHash
    h = RollingHash(_BASES[1])
    return h, h.prefix(text)


def sorted_lms(text: np.ndarray, is_s: np.ndarray, run: np.ndarray, memory: int, in_memory: int) -> np.ndarray:
    """LMS positions in suffix order."""
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(lms) <= 1:
        return lms
    # 1. LMS substrings in order: the same induction from unsorted seeds
    order = np.argsort(text[lms], kind="stable")
    grouped, symbols = lms[order], text[lms[order]]
    cut = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
    none = np.zeros(0, np.int32)
    seeds = {int(text[g[0]]): (g, none) for g in np.split(grouped, cut)}
    seeds = {c: (g, np.zeros(len(g), np.int32)) for c, (g, _) in seeds.items()}
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    parts = [pos[is_lms[pos]] for pos, _ in induce(text, is_s, run, seeds, 0, memory)]
    in_order = np.concatenate(parts)[::-1]
    # 2. names: equal substrings get the same one
    index = np.empty(len(text), np.int64)
    index[lms] = np.arange(len(lms))
    stop = np.append(lms[1:] + 1, len(text))
    h, prefix = _prefix_hash(text)
    digest = h.between(prefix, lms, stop)
    which = index[in_order]
    new = np.ones(len(which), bool)
    new[1:] = digest[which[1:]] != digest[which[:-1]]
    names = np.empty(len(lms), np.int64)
    names[which] = np.cumsum(new)
    if new.all():
        return in_order
    # 3. order of the suffixes of the string of names
    if len(names) <= in_memory:
        rank = _by_doubling(names)
    else:
        digits = np.empty(2 * len(names) + 1, np.int32)
        digits[0:-1:2], digits[1:-1:2] = (names >> 16) + 1, (names & 0xFFFF) + 1
        digits[-1] = 0
        suffixes = suffix_order(digits, memory, in_memory)
        mine = suffixes[(suffixes % 2 == 0) & (suffixes < 2 * len(names))] // 2
        rank = np.empty(len(names), np.int64)
        rank[mine] = np.arange(len(names))
    out = np.empty(len(lms), np.int64)
    out[rank] = lms
    return out


def _seeds(text: np.ndarray, ordered: np.ndarray, cap: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The sorted LMS suffixes by first symbol with their common prefixes (by bisection over hashes, up to the cap)."""
    if not len(ordered):
        return {}
    lcp = np.zeros(len(ordered), np.int32)
    if cap and len(ordered) > 1:
        h, prefix = _prefix_hash(text)
        a, b = ordered[:-1], ordered[1:]
        low = np.zeros(len(a), np.int64)
        high = np.minimum(cap, len(text) - np.maximum(a, b))
        while True:
            open_ = low < high
            if not open_.any():
                break
            mid = (low + high + 1) // 2
            same = h.between(prefix, a, a + mid) == h.between(prefix, b, b + mid)
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        lcp[1:] = low
    symbols = text[ordered]
    cut = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
    return {int(text[p[0]]): (p, l) for p, l in zip(np.split(ordered, cut), np.split(lcp, cut))}


def suffix_order(text: np.ndarray, memory: int = 1 << 26, in_memory: int = 1 << 23) -> np.ndarray:
    """Suffix array of a string of small integers whose last symbol is its unique smallest."""
    is_s, run = types_of(text)
    seeds = _seeds(text, sorted_lms(text, is_s, run, memory, in_memory), 0)
    return np.concatenate([pos for pos, _ in induce(text, is_s, run, seeds, 0, memory)])[::-1]


def sorted_suffixes(text: np.ndarray, cap: int, memory: int = 1 << 26, in_memory: int = 1 << 23) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (positions, common prefix with the suffix before in this order, capped), largest suffix first."""
    is_s, run = types_of(text)
    seeds = _seeds(text, sorted_lms(text, is_s, run, memory, in_memory), cap)
    return induce(text, is_s, run, seeds, cap, memory)


def repeated_windows(parts: list[bytes], width: int, memory: int = 1 << 26, in_memory: int = 1 << 23):
    """Runs of windows of ``width`` bytes that also start earlier, in this or an earlier part.

    Returns part, start and stop (of the bytes they cover) of each maximal run of covered bytes within a part.
    """
    lengths = np.array([len(p) for p in parts], np.int64)
    text = np.empty(int(lengths.sum()) + len(parts) + 1, np.int16)
    first = np.cumsum(lengths + 1) - (lengths + 1)
    text[:-1] = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    text[:-1] += 2
    text[first + lengths] = 1  # ends a part
    text[-1] = 0
    # a window stands wholly within a part
    room = np.repeat(first + lengths, lengths + 1) - np.arange(len(text) - 1)
    room = np.append(room, 0)
    again = np.zeros(len(text), bool)
    held: list[np.ndarray] = []

    def settle():
        if held:
            group = np.concatenate(held)
            if len(group) > 1:
                again[group] = True
                again[group.min()] = False
            held.clear()

    for pos, lcp in sorted_suffixes(text, width, memory, in_memory):
        fits = room[pos] >= width
        # a run of equal windows: common prefix of width with the one before
        joined = (lcp >= width) & fits
        starts = np.flatnonzero(~joined)
        if not len(starts):
            held.append(pos)
            continue
        if starts[0] > 0:
            held.append(pos[:starts[0]])
        settle()
        bounds = np.append(starts, len(pos))
        sizes = np.diff(bounds)
        many = np.flatnonzero(sizes[:-1] > 1)
        if len(many):
            low = np.minimum.reduceat(pos, starts)
            inside = np.repeat(sizes > 1, sizes)
            inside[bounds[-2] - starts[0]:] = False
            again[pos[starts[0]:][inside]] = True
            again[low[many]] = False
        tail = pos[bounds[-2]:]
        if fits[bounds[-2]]:
            held.append(tail)
    settle()
    at = np.flatnonzero(again)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z.tolist(), z.tolist(), z.tolist()
    part = np.searchsorted(first, at, side="right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (part[1:] != part[:-1]) | (at[1:] > at[:-1] + width)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    return part[begin].tolist(), (at[begin] - first[part[begin]]).tolist(), (at[end] + width - first[part[end]]).tolist()
