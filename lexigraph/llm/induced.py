"""Suffix and common-prefix arrays by external induced sorting.

The text is a row of symbols whose members (strings) end with separators, symbol 0; separators are all different, in order
of place. Sorting goes by recursive induction. The starts (leftmost-S places and separators) are ordered by one rough
induction, which sorts the substrings between them; equal substrings get one name; if names repeat, the row of names, at
most half as long, is sorted by this same procedure, down to a row whose names all differ. From the ordered starts two
passes over priority queues induce all other suffixes: ascending for L-type, descending for S-type ones.

Queues. A queue entry is a suffix tuple: its place, the symbols before it (as many as fit 63 bits, so that no pass goes
back to the text but to refill), and at the lowest level the common prefix with the entry before. The order of a queue is
(first symbol, time of entry): it is kept as one first-in-first-out file a range of symbols, drained range by range. A
range of one symbol runs in waves, one a repetition; in a range of many, what it induces in itself is ranked by its sources
until nothing new comes. Entries above a budget of bytes go to disk, as do the texts, names and finished buckets.

Common prefixes. Neighbours among the starts are compared symbol by symbol, eight at a time; that of two induced
neighbours is one more than the least value between their sources. Values are capped at CAP.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

CAP = 250
#: Bytes that a queue, or a finished pass, keeps in memory; more goes to disk. Arrays above it are files from the start.
BUDGET = 32 << 20
#: Ranges of symbols that a queue of names is cut into, and the least entries of one.
RANGES, LEAST = 48, 4096
#: Starts whose substrings are hashed at once, and symbols that are typed at once.
SLICE = 1 << 19


class Spool:
    """Tuples of arrays by key, in order of entry; above a budget of bytes they go to disk."""

    spills = 0  # of all spools, for tests

    def __init__(self, budget: int) -> None:
        self.chunks: dict[int, list] = defaultdict(list)
        self.held, self.budget, self.file, self.end = 0, budget, None, 0

    def push(self, key: int, *arrays: np.ndarray) -> None:
        kept = tuple(a.copy() for a in arrays)  # a slice would keep all of its batch alive
        self.chunks[key].append(kept)
        self.held += sum(a.nbytes for a in kept)
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        Spool.spills += 1
        if self.file is None:
            self.file = tempfile.TemporaryFile(prefix="suffix-queues-")
        self.file.seek(self.end)
        for key, chunks in self.chunks.items():
            at = next((i for i, c in enumerate(chunks) if isinstance(c[0], np.ndarray)), len(chunks))
            if at < len(chunks):
                joined = [np.concatenate(x) for x in zip(*chunks[at:], strict=True)]
                for x in joined:
                    self.file.write(x)
                chunks[at:] = [(self.end, [(x.dtype, len(x)) for x in joined])]
                self.end += sum(x.nbytes for x in joined)
        self.held = 0

    def drain(self, key: int) -> list[np.ndarray]:
        """The arrays of a key, joined; an empty list if there are none."""
        parts = []
        for chunk in self.chunks.pop(key, []):
            if isinstance(chunk[0], np.ndarray):
                self.held -= sum(a.nbytes for a in chunk)
            else:
                self.file.seek(chunk[0])
                chunk = tuple(np.frombuffer(self.file.read(kind.itemsize * n), kind) for kind, n in chunk[1])
            parts.append(chunk)
        return [np.concatenate(x) for x in zip(*parts, strict=True)]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def room(n: int, kind: type, budget: int) -> np.ndarray:
    """An array, in a file if it is large."""
    if n * np.dtype(kind).itemsize <= budget:
        return np.empty(n, kind)
    with tempfile.TemporaryFile(prefix="suffix-array-") as f:
        return np.memmap(f, kind, "w+", shape=(n,))


class _Least:
    """Least values of ranges of a batch."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= len(values):
            v, k = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(v[:-k], v[k:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of values[a..b], ends included, a <= b."""
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.uint8)
        for k, row in enumerate(self.rows):
            m = np.flatnonzero(level == k)
            if len(m):
                out[m] = np.minimum(row[a[m]], row[b[m] - (1 << k) + 1])
        return out


class _Level:
    """A text (symbols, of which 0 parts members and ends the text) and what its passes need."""

    def __init__(self, t: np.ndarray, symbols: int, budget: int) -> None:
        self.t, self.symbols, self.budget = t, symbols, budget
        self.place = np.int32 if len(t) < 1 << 31 else np.int64
        self.bits = np.uint64(max(9, symbols.bit_length()))
        self.mask = np.uint64((1 << int(self.bits)) - 1)
        self.per = 63 // int(self.bits)
        if symbols <= 512:
            self.bounds = np.arange(symbols + 1)
        else:
            counts = np.concatenate([np.bincount(t[a : a + SLICE], minlength=symbols)[None] for a in range(0, len(t), SLICE)]).sum(axis=0) if len(t) <= 4 * SLICE else self._counts()
            up_to = np.cumsum(counts) - counts
            size = max(LEAST, len(t) // RANGES)
            self.bounds = np.concatenate([[0], 1 + np.flatnonzero(np.diff(up_to // size)), [symbols]])
            if self.bounds[1] != 1:
                self.bounds = np.insert(self.bounds, 1, 1)

    def _counts(self) -> np.ndarray:
        out = np.zeros(self.symbols, np.int64)
        for a in range(0, len(self.t), SLICE):
            out += np.bincount(self.t[a : a + SLICE], minlength=self.symbols)
        return out

    def before(self, p: np.ndarray) -> np.ndarray:
        """The symbols before places p, the nearest lowest, under a mark. At the text's start what follows the last separator read isn't used."""
        v = np.ones(len(p), np.uint64)
        for i in range(self.per, 0, -1):
            at = p - i if len(self.t) >= self.per else np.maximum(p - i, -1)
            v = (v << self.bits) | self.t[at].astype(np.uint64)
        return v

    def step(self, p: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that begin one symbol earlier."""
        p, v = p - self.place(1), v >> self.bits
        empty = np.flatnonzero(v == 1)
        if len(empty):
            v[empty] = self.before(p[empty])
        return p, v

    def run(self, p: int, c: int) -> int:
        """How often symbol c repeats from place p on, capped."""
        other = np.flatnonzero(self.t[p : p + CAP] != c)
        return int(other[0]) if len(other) else CAP

    def starts(self) -> np.ndarray:
        """Leftmost-S places and separators, in order of place."""
        t, found, after, after_type = self.t, [], 0, True
        n = len(t)
        for b in range(n, 0, -SLICE):
            a = max(0, b - SLICE)
            x = t[a:b].astype(np.int64)
            nxt = np.concatenate([x[1:], [after]])
            known = np.where(x == 0, 1, np.sign(nxt - x))  # 1: S, -1: L, 0: as its successor
            if known[-1] == 0:
                known[-1] = 1 if after_type else -1
            at = np.where(known != 0, np.arange(b - a), b - a)
            s = known[np.minimum.accumulate(at[::-1])[::-1]] > 0
            left = np.concatenate([[True], ~s[:-1]])
            lead = s & left
            # The slice's first place is a leftmost one if the symbol before it is larger.
            lead[0] = s[0] and a > 0 and int(t[a - 1]) > int(x[0])
            found.append(np.flatnonzero(lead | (x == 0)).astype(self.place) + self.place(a))
            after, after_type = int(x[0]), bool(s[0])
        return np.concatenate(found[::-1])

    def one(self, c: int, up: bool, queue: list, given: list, with_common: bool):
        """A bucket: (places, befores, common) of the type that is made, and of all its sources in order."""
        none = [np.zeros(0, self.place), np.zeros(0, np.uint64), np.zeros(0, np.uint8)]
        p, v, lcp = (queue or none)[:2] + ([queue[2].copy() if queue else none[2]] if with_common else [none[2]])
        if len(lcp):
            lcp[0] = 0
        waves, since = [(p, v, lcp)], 0
        while len(p):
            at = np.flatnonzero((v & self.mask) == c)
            if not len(at):
                break
            own = none[2]
            if with_common:
                table = _Least(lcp)
                lo = np.concatenate([[0], at[:-1] + 1])
                least = table.of(lo, at)
                least[0] = min(int(least[0]), since)
                own = np.minimum(least, CAP - 1) + np.uint8(1)
                rest = lcp[at[-1] + 1 :]
                since = int(rest.min()) if len(rest) else CAP
            p, v = self.step(p[at], v[at])
            lcp = own
            waves.append((p, v, lcp))
        made = [np.concatenate(x) for x in zip(*waves, strict=True)]
        if not given:
            return made, made
        sources = [np.concatenate([made[0], given[0]]), np.concatenate([made[1], given[1]]), none[2]]
        if with_common:
            g = given[2].copy()
            g[0] = min(self.run(int(made[0][-1]), c), self.run(int(given[0][0]), c)) if len(made[0]) else 0
            sources[2] = np.concatenate([made[2], g])
        return made, sources

    def many(self, lo: int, hi: int, up: bool, queue: list, given: list):
        """A range of symbols: (symbols, places, befores) of the type that is made, and of all its sources in order."""
        none = [np.zeros(0, np.int32), np.zeros(0, self.place), np.zeros(0, np.uint64)]
        queue, given = queue or none, given or none
        sym, p, v = (np.concatenate(x) for x in zip(queue, given, strict=True))
        n = len(queue[0]), len(given[0])
        kind = np.repeat(np.array([0, 3], np.int8), n)  # from the queue, from this range, a repetition of its own symbol, given
        source = np.concatenate([np.arange(k) for k in n])  # the order of entry, or the entry that induced this one
        zero = np.zeros(sum(n), np.int64)
        wave = [sym, p, v, kind, source, zero, zero]  # also: number of the repetition, depth of ranking
        waves, first = [wave], 0
        while True:
            sym, p, v, kind, source, repeat, depth = wave
            d = (v & self.mask).astype(np.int64)
            own = (d == sym) & (kind < 3)
            at = np.flatnonzero((d >= lo) & (d < hi) & (((d > sym) if up else (d < sym)) | own))
            if not len(at):
                break
            own = own[at]
            again = own & (kind[at] == 2)  # repetitions of one entry are ordered by their number, then as that entry
            wave = [d[at].astype(np.int32), *self.step(p[at], v[at]), np.where(own, np.int8(2), np.int8(1)), np.where(again, source[at], at + first), np.where(own, repeat[at] + 1, 0), depth[at] + ~again]
            first += len(sym)
            waves.append(wave)
        sym, p, v, kind, source, repeat, depth = (np.concatenate(x) for x in zip(*waves, strict=True))
        bucket = (sym - lo if up else hi - 1 - sym).astype(np.int64) * 4 + kind
        total, rank = len(sym), np.zeros(len(sym), np.int64)
        by_source, wide = (kind == 1) | (kind == 2), total * (int(repeat.max(initial=0)) + 1)
        order = np.zeros(0, np.int64)
        for e in range(int(depth.max(initial=-1)) + 1):
            live = np.flatnonzero(depth <= e) if e or depth.any() else np.arange(total)
            second = repeat[live] * total + np.where(by_source[live], rank[source[live]], source[live])
            if 4 * (hi - lo) * wide < 1 << 62:
                order = live[np.argsort(bucket[live] * wide + second)]
            else:
                order = live[np.lexsort((second, bucket[live]))]
            rank[order] = np.arange(len(order))
        sym, p, v, kind = sym[order], p[order], v[order], kind[order]
        made = kind < 3
        return [sym[made], p[made], v[made]], [sym, p, v]

    def one_pass(self, up: bool, given: Spool, with_common: bool) -> Spool:
        """given: sources of the other type, by range, in the pass's order. Returns the suffixes made, likewise."""
        out, queue = Spool(self.budget), Spool(self.budget)
        ranges = range(len(self.bounds) - 1)
        kind = np.uint16 if len(ranges) < 1 << 16 else np.int64
        for r in ranges if up else reversed(ranges):
            lo, hi = int(self.bounds[r]), int(self.bounds[r + 1])
            if hi - lo == 1:
                made, (p, v, lcp) = self.one(lo, up, queue.drain(r), given.drain(r), with_common)
                if len(made[0]):
                    out.push(r, *(made if with_common else made[:2]))
            else:
                own = given.drain(r)
                made, (_, p, v) = self.many(lo, hi, up, queue.drain(r), own)
                lcp = None
                if len(made[0]):
                    out.push(r, *made)
            d = (v & self.mask).astype(np.int32)
            at = np.flatnonzero((d >= hi) if up else (d > 0) & (d < lo))
            if not len(at):
                continue
            to = d[at]
            if len(self.bounds) != self.symbols + 1:
                to = np.searchsorted(self.bounds, to, "right") - 1
            order = np.argsort(to.astype(kind), kind="stable")
            at, to = at[order], to[order]
            heads = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            arrays = [*self.step(p[at], v[at])]
            if with_common:
                begin = np.concatenate([[0], at[:-1] + 1])
                begin[heads] = at[heads]
                least = _Least(lcp).of(begin, at)
                least[heads] = 0  # what the queue holds already came from other symbols
                arrays.append(np.minimum(least, CAP - 1) + np.uint8(1))
            symbols = d[at]
            for h, e in zip(heads.tolist(), [*heads[1:].tolist(), len(at)], strict=True):
                r2 = int(to[h])
                held = [x[h:e] for x in arrays]
                if self.bounds[r2 + 1] - self.bounds[r2] > 1:
                    held = [symbols[h:e], *held]
                queue.push(r2, *held)
        queue.close()
        return out

    def _single(self, r: int) -> bool:
        return self.bounds[r + 1] - self.bounds[r] == 1

    def induce(self, ordered: np.ndarray, common: np.ndarray | None = None) -> Iterator[tuple[int, list, list]]:
        """Of starts in order: (range, L-type, S-type) by falling ranges, both types ascending, from (symbols,) places, befores(, common)."""
        given, t = Spool(self.budget), self.t
        for a in range(0, len(ordered), SLICE):
            p = ordered[a : a + SLICE].astype(self.place)
            sym = t[p].astype(np.int32)
            to = np.searchsorted(self.bounds, sym, "right") - 1
            heads = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            v = self.before(p)
            for h, e in zip(heads.tolist(), [*heads[1:].tolist(), len(p)], strict=True):
                held = [p[h:e], v[h:e]]
                if common is not None:
                    held.append(common[a + h : a + e])
                given.push(int(to[h]), *([] if self._single(int(to[h])) else [sym[h:e]]), *held)
        small = self.one_pass(True, given, common is not None)
        given.close()
        flipped, kept = Spool(self.budget), Spool(self.budget)
        for r in range(len(self.bounds) - 1):
            own = small.drain(r)
            if own:
                kept.push(r, *own)
                turned = [x[::-1] for x in own]
                if common is not None:  # a value belongs to the pair, so it moves by one
                    turned[2] = np.concatenate([[np.uint8(0)], own[2][:0:-1]])
                flipped.push(r, *turned)
        small.close()
        large = self.one_pass(False, flipped, common is not None)
        flipped.close()
        for r in range(len(self.bounds) - 2, -1, -1):
            low, high = kept.drain(r), large.drain(r)
            if high:
                turned = [x[::-1] for x in high]
                if common is not None:
                    c = int(self.bounds[r])
                    seam = min(self.run(int(low[0][-1]), c), self.run(int(turned[0][0]), c)) if low else 0
                    turned[2] = np.concatenate([[np.uint8(seam)], high[2][:0:-1]])
                high = turned
            if low or high:
                yield r, low, high
        kept.close()
        large.close()

    def hashes(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each start's substring, the next start's symbol included: a 64-bit hash, and the length."""
        length = np.diff(np.concatenate([starts, [len(self.t)]])).astype(np.int64)
        power = np.full(int(length.max()) + 2, 0x9E3779B97F4A7C15, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        out = room(len(starts), np.uint64, self.budget)
        for a in range(0, len(starts), SLICE):
            own, size = starts[a : a + SLICE].astype(np.int64), length[a : a + SLICE]
            first = int(own[0])
            x = np.concatenate([self.t[first : first + int(size.sum())], [0]]).astype(np.uint64)
            if first + int(size.sum()) < len(self.t):
                x[-1] = self.t[first + int(size.sum())]
            x = (x + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xC2B2AE3D27D4EB4F)
            from_start = np.arange(len(x) - 1) - np.repeat(own - first, size)
            sums = np.add.reduceat(x[:-1] * power[from_start], own - first)
            out[a : a + SLICE] = sums + x[own - first + size] * power[size]
        return out, length

    def ordered_starts(self) -> np.ndarray:
        """All starts in the order of their suffixes: separators, then the others."""
        starts = self.starts()
        sym = np.concatenate([self.t[starts[a : a + SLICE]] for a in range(0, len(starts), SLICE)])
        parts, others = starts[sym == 0], np.flatnonzero(sym > 0)
        if not len(others):
            return parts
        rough = np.concatenate([parts, starts[others[np.argsort(sym[others], kind="stable")]]])
        found = []
        for r, _, high in self.induce(rough):
            if high:
                p, v = high[-2:]
                symbol = high[0] if len(high) == 3 else int(self.bounds[r])
                found.append(p[(v & self.mask).astype(np.int64) > symbol])  # after a larger symbol: leftmost
        del rough
        ranked = np.concatenate(found[::-1])
        del found
        # Starts are never neighbours but for separators, so half a place tells them apart.
        slot = room(len(self.t) // 2 + 1, self.place, self.budget)
        slot[starts[others] >> 1] = others
        at = slot[ranked >> 1]
        h, length = self.hashes(starts)
        new = np.ones(len(at), bool)
        new[1:] = (h[at[1:]] != h[at[:-1]]) | (length[at[1:]] != length[at[:-1]])
        del h, length, slot
        count = int(new.sum())
        if count == len(at):
            return np.concatenate([parts, ranked])
        names = room(len(starts), np.int32 if count < (1 << 31) - 1 else np.int64, self.budget)
        names[:] = 0
        names[at] = np.cumsum(new)
        del ranked, at, new, sym, others
        inner = _Level(names, count + 1, self.budget)
        return np.concatenate([parts, starts[inner.suffixes()]])

    def suffixes(self) -> np.ndarray:
        """Places of all suffixes but the separators' in order."""
        found = []
        for _, low, high in self.induce(self.ordered_starts()):
            joined = [np.concatenate(x) for x in zip(low, high, strict=True)] if low and high else low or high
            found.append(joined[0] if len(joined) == 2 else joined[1][np.argsort(joined[0], kind="stable")])
        return np.concatenate(found[::-1]) if found else np.zeros(0, self.place)


def _compare(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Common prefixes of places a and b of a text of bytes, up to most; eight bytes at a time."""
    words = np.lib.stride_tricks.as_strided(text[:8].view("<u8"), (len(text) - 7,), (1,))
    if 8 * len(text) <= 2 * BUDGET:
        words = np.ascontiguousarray(words)
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        diff = words[a[live] + out[live]] ^ words[b[live] + out[live]]
        same = diff == 0
        other = live[~same]
        low = diff[~same]
        low = low & (~low + np.uint64(1))  # the lowest bit that differs lies in the first byte that does
        out[other] += (np.frexp(low.astype(np.float64))[1] - 1) >> 3
        live = live[same]
        out[live] += 8
        live = live[out[live] < most[live]]
    return np.minimum(out, most).astype(np.uint8)


def buckets(members: list[bytes], budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Suffixes of all members by first byte, from the largest down, each bucket in order: (member, offset, common).

    common is that with the suffix before, capped at CAP; 0 for a bucket's first. Empty members have no suffix.
    """
    whole = [i for i, m in enumerate(members) if m]
    if not whole:
        return
    sizes = np.array([len(members[i]) for i in whole], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    n = int(ends[-1]) + 1
    text, t = room(n + CAP + 16, np.uint8, budget), room(n, np.int16, budget)
    at = 0
    for k in range(0, len(whole), 4096):
        part = np.frombuffer(b"\0".join(members[i] for i in whole[k : k + 4096]) + b"\0", np.uint8)
        text[at : at + len(part)] = part
        t[at : at + len(part)] = part
        t[at : at + len(part)] += 1
        at += len(part)
    text[n:] = 0
    t[ends] = 0
    level = _Level(t, 257, budget)
    ordered = level.ordered_starts()
    common = room(len(ordered), np.uint8, budget)
    common[:] = 0
    for k in range(len(whole), len(ordered), SLICE):  # separators share nothing
        p = ordered[k - 1 : k + SLICE].astype(np.int64)
        left = ends[np.searchsorted(ends, p)] - p
        common[k : k + SLICE] = _compare(text, p[:-1], p[1:], np.minimum(np.minimum(left[:-1], left[1:]), CAP))
    numbers = np.array(whole, np.int64)
    for _, low, high in level.induce(ordered, common):
        p = np.concatenate([x[0] for x in (low, high) if x]).astype(np.int64)
        lcp = np.concatenate([x[2] for x in (low, high) if x])
        member = np.searchsorted(ends, p)
        yield numbers[member], p - (ends[member] - sizes[member]), lcp


def suffix_array(members: list[bytes], budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes in order: (member, offset, common)."""
    found = [*buckets(members, budget)][::-1]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
