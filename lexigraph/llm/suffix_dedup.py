"""Suffix-array dedup: removes each byte covered by a WIDTH-byte string that starts anywhere else too.

1. Dealing. The anchor of a WIDTH-byte window is the first of its SEED-byte strings that have the least hash there, so equal
   windows have anchors at equal places. An anchor's windows are neighbours; together they are its context. Anchors are
   dealt by the hash of their seed, so all places of a repeated window meet. Contexts that a worker sees twice are
   known to repeat and go on as one. A seed that occurs once is done. A context that occurs twice or more has all its
   windows repeated (the naming step: equal names need no sorting). What is left are contexts at the borders of
   repeats. By the place of the anchor in the window their windows fall into BINS; all windows of a bin share a stretch
   of 183 bytes, so a bin whose stretch no other context of the seed has holds no repeat, and a context is cut to the bins
   that are left: a member.
2. Sorting. Each shard's members go through external induced sorting (see `induced`), in blocks of whole seed groups; queues,
   buckets and arrays above a budget of bytes go to disk. A run of suffixes whose common prefixes reach WIDTH is one
   window's places; it is repeated if two of them start at different bytes of the corpus or one stands for a repeated
   context. The group of a seed whose members take more than HOT bytes is split: its windows are dealt each by its own
   hash, where those of one hash are pre-aggregated, so that no task holds the group.
3. Marking. Intervals of covered bytes go back to their texts, overlaps merge, and the rest is kept.

Removal follows the input alone, not what is left, so the result doesn't depend on any order. Matches never cross texts.
Strings are told apart by 64-bit hashes in dealing and naming, and by their bytes in sorting.

Defined results: null is the empty text; texts under WIDTH bytes lose nothing; repeated rows are places like others, so
each loses all its windows; rows with one doc_id and other texts are told apart; ties don't matter; extra columns pass
through `deduped`, which decodes what is left with replacement where a cut splits a character; an empty table gives an
empty result.
"""

from __future__ import annotations

import gc
import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, induced

WIDTH, SEED = 200, 64
REACH = WIDTH - SEED
#: Windows of an anchor fall into bins by the bytes before the anchor, BIN counts a bin.
BIN = 18
BINS = -(-(REACH + 1) // BIN)
STRETCH = WIDTH - BIN + 1
#: Bytes of members that are sorted together, unless one seed's group alone is larger; above HOT bytes a group is split.
BLOCK, HOT = 3 << 20, 24 << 20
#: Anchors that a worker holds before it deals them, and bytes of a fragment that are named in memory.
HELD, NAMED = 400_000, 64 << 20

_rng = np.random.default_rng(20)
_LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n += n // 2
            out = []
            for base in (_STEP, pow(_STEP, -1, 1 << 64)):
                x = np.full(n, np.uint64(base), np.uint64)
                x[0] = 1
                out.append(np.multiply.accumulate(x))
            self.up, self.down = out
        return self.up, self.down


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _sums(text: bytes, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    """Of what the hash of any piece x..y is (sums[y] - sums[x]) * down[x]."""
    n = len(text)
    up, down = powers.to(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTER[np.frombuffer(text, np.uint8)] * up[:n], dtype=np.uint64, out=sums[1:])
    return sums, down


_ANCHOR = np.dtype([("seed", "<i8"), ("context", "<i8"), ("key", "<i8"), ("at", "<i4"), ("most", "u1"), ("least", "u1"), ("bins", "<u2", (BINS,))])
_KNOWN = np.dtype([("key", "<i8"), ("begin", "<i4"), ("end", "<i4")])


def anchors(text: bytes, key: int, powers: _Powers) -> np.ndarray:
    """The anchors of a text of WIDTH bytes or more.

    most and least: bytes before the anchor in its first and last window; bins: stretch hashes, 0 for a bin without windows.
    """
    n = len(text)
    sums, down = _sums(text, powers)
    seeds = _mixed((sums[SEED:] - sums[:-SEED]) * down[: n - SEED + 1])
    low = np.uint64(0xFFFFFFFF)
    least = (seeds & ~low) | np.arange(len(seeds), dtype=np.uint64)  # of equal hashes the first
    size = 1
    while 2 * size <= REACH + 1:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: len(least) - (REACH + 1 - size)], least[REACH + 1 - size :])
    chosen = (least & low).astype(np.int64)  # of each window
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.concatenate([first[1:], [len(chosen)]]) - 1
    at = chosen[first]
    out = np.empty(len(at), _ANCHOR)
    most, least_ = at - first, at - last
    shape = (most * 256 + least_).astype(np.uint64)
    out["seed"], out["key"], out["at"], out["most"], out["least"] = seeds[at].view(np.int64), key, at, most, least_
    out["context"] = _mixed((sums[last + WIDTH] - sums[first]) * down[first] + _mixed(shape)).view(np.int64)
    for i in range(BINS):
        there = (most >= i * BIN) & (least_ < (i + 1) * BIN)
        x = np.where(there, at - i * BIN, 0)
        h = (_mixed((sums[x + STRETCH] - sums[x]) * down[x]) >> np.uint64(48)).astype(np.uint16)
        out["bins"][:, i] = np.where(there, np.maximum(h, 1), 0)
    return out


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where rows sorted by these columns begin anew."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _deal(fragments: int):
    """(key, text) to rows (fragment, anchors, known): blobs of _ANCHOR rows, and of intervals known to repeat."""

    def dealt(parts: list) -> pa.RecordBatch:
        rows = np.concatenate(parts)
        rows = rows[np.lexsort((rows["context"], rows["seed"]))]
        first = _runs(rows["seed"], rows["context"])
        alone = np.bincount(np.cumsum(first) - 1) == 1
        own, more = rows[first], rows[~first]
        twice = own[~alone]  # stands for a context that repeats: marked by no bytes before nor after
        known = np.empty(len(more) + len(twice), _KNOWN)
        for name, x in (("key", "key"), ("begin", None), ("end", None)):
            both = np.concatenate([more, twice])
            known[name] = both[x] if x else both["at"].astype(np.int64) - (both["most"] if name == "begin" else both["least"]) + (0 if name == "begin" else WIDTH)
        own["at"] = np.where(alone, own["at"], ~own["at"])
        out: dict[int, list] = {}
        for column, (rows_of, cut) in enumerate(((own, (own["seed"] >> 5) % fragments), (known, (known["key"] >> 5) % fragments))):
            order = np.argsort(cut, kind="stable")
            rows_of, cut = rows_of[order], cut[order]
            heads = np.flatnonzero(_runs(cut)) if len(cut) else []
            for h, e in zip(heads, [*heads[1:], len(cut)], strict=False):
                out.setdefault(int(cut[h]), [b"", b""])[column] = rows_of[h:e].tobytes()
        return pa.RecordBatch.from_arrays([pa.array([*out], pa.int32()), *[pa.array([x[i] for x in out.values()], pa.binary()) for i in (0, 1)]], names=["fragment", "anchors", "known"])

    def run(batches):
        powers, parts, held = _Powers(), [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), common.as_bytes(batch.column(1)), strict=True):
                if text is None or len(text) < WIDTH:
                    continue
                parts.append(anchors(text, key, powers))
                held += len(parts[-1])
                if held >= HELD:
                    yield dealt(parts)
                    parts, held = [], 0
        if parts:
            yield dealt(parts)

    return run


def _whole_seeds(blobs: Iterator[bytes], budget: int) -> Iterator[tuple[np.ndarray, bool]]:
    """A fragment's anchors sorted by seed and context, in pieces of whole seeds, or of one seed's whole contexts (then True).

    Above the budget, sorted runs go to disk and are read again range by range.
    """
    parts, held, runs = [], 0, []

    def ordered() -> np.ndarray:
        rows = np.concatenate(parts)
        return rows[np.lexsort((rows["context"], rows["seed"]))]

    for blob in blobs:
        parts.append(np.frombuffer(blob, _ANCHOR))
        held += len(blob)
        if held > budget:
            rows = ordered()
            with tempfile.TemporaryFile(prefix="suffix-runs-") as f:
                f.write(rows)
                f.flush()
                runs.append(np.memmap(f, _ANCHOR, "r", shape=rows.shape))
            parts, held = [], 0
    if not runs:
        if parts:
            yield ordered(), False
        return
    if parts:
        runs.append(ordered())
    step = max(1, budget // _ANCHOR.itemsize // (2 * len(runs)))

    def cut(slices: list, field: str, whole: bool):
        marks = np.unique(np.concatenate([x[field][::step] for x in slices]))
        bounds = [np.concatenate([[0], np.searchsorted(x[field], marks, "left"), np.searchsorted(x[field], marks, "right"), [len(x)]]) for x in slices]
        bounds = [np.sort(b) for b in bounds]  # between marks, and each mark alone
        for i in range(len(bounds[0]) - 1):
            piece = [x[b[i] : b[i + 1]] for x, b in zip(slices, bounds, strict=True) if b[i + 1] > b[i]]
            size = sum(map(len, piece)) * _ANCHOR.itemsize
            if whole and size > budget:
                yield from cut(piece, "context", False)
            elif piece:
                rows = np.concatenate(piece)
                yield rows[np.lexsort((rows["context"], rows["seed"]))], not whole

    yield from cut(runs, "seed", True)


def _grouped(key: np.ndarray, *values: np.ndarray):
    """Arrow lists by key: (keys, list arrays)."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(_runs(key)) if len(key) else np.zeros(0, np.int64)
    offsets = pa.array(np.concatenate([first, [len(key)]]), pa.int32())
    return pa.array(key[first]), [pa.ListArray.from_arrays(offsets, pa.array(v[order])) for v in values]


KNOWN, MEMBER, SPLIT = 1, 2, 3
_NAMED = "kind int, key long, begins array<int>, ends array<int>, seeds array<long>, sure array<boolean>"


def _listed(kind: int, key, begin, end, seed=None, sure=None) -> pa.RecordBatch:
    keys, lists = _grouped(key, begin.astype(np.int32), end.astype(np.int32), *([] if seed is None else [seed, sure]))
    n = len(keys)
    columns = [pa.array(np.full(n, kind, np.int32)), keys, *lists]
    if seed is None:
        columns += [pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.bool_()))]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "key", "begins", "ends", "seeds", "sure"])


def _name_piece(rows: np.ndarray, hot: bool) -> Iterator[pa.RecordBatch]:
    """Anchors of whole seeds, sorted: intervals known to repeat, and members to sort or to split, by text."""
    stands, at = rows["at"] < 0, np.where(rows["at"] < 0, ~rows["at"], rows["at"]).astype(np.int64)
    new_seed = _runs(rows["seed"])
    new_context = new_seed | _runs(rows["context"])
    seed, context = np.cumsum(new_seed) - 1, np.cumsum(new_context) - 1
    count = np.bincount(context) + np.bincount(context, stands)
    sure = count[context] > 1
    pick = sure & ~stands  # what a worker knew itself is listed already
    if pick.any():
        yield _listed(KNOWN, rows["key"][pick], at[pick] - rows["most"][pick], at[pick] - rows["least"][pick] + WIDTH)
    several = np.bincount(seed[new_context])[seed] > 1  # contexts of a seed
    sort = np.flatnonzero(new_context & (several | hot))
    if not len(sort):
        return
    own, at, sure, seed = rows[sort], at[sort], sure[sort], seed[sort]
    most, least = own["most"].astype(np.int64), own["least"].astype(np.int64)
    if not hot:
        low, high = np.full(len(own), REACH + 1), np.full(len(own), -1)
        for i in range(BINS):
            h = own["bins"][:, i]
            _, where, n = np.unique(seed.astype(np.int64) << 16 | h, return_inverse=True, return_counts=True)
            shared = (n[where] > 1) & (h > 0)
            low = np.where(shared & (low > REACH), i * BIN, low)
            high = np.where(shared, (i + 1) * BIN - 1, high)
        most, least = np.minimum(most, high), np.maximum(least, low)
    able = most >= least
    if not able.any():
        return
    own, at, sure, seed, most, least = own[able], at[able], sure[able], seed[able], most[able], least[able]
    begin, end = at - most, at - least + WIDTH
    large = np.bincount(seed, end - begin)[seed] > HOT
    large |= hot
    for kind, pick in ((MEMBER, ~large), (SPLIT, large)):
        if pick.any():
            yield _listed(kind, own["key"][pick], begin[pick], end[pick], own["seed"][pick], sure[pick])


def _name(batches):
    """Rows sorted by fragment; of each fragment, what its anchors say."""
    waiting: list[tuple] = []

    def blobs(batch_iter, current):
        """The current fragment's anchors; stops at the next one, which waits."""
        while waiting:
            fragment, data, known = waiting[-1]
            if fragment != current:
                return
            waiting.pop()
            if known:
                told.append(known)
            if data:
                yield data
            if not waiting:
                batch = next(batch_iter, None)
                while batch is not None and not batch.num_rows:
                    batch = next(batch_iter, None)
                if batch is not None:
                    waiting.extend(reversed([*zip(*(c.to_pylist() for c in batch.columns), strict=True)]))

    batch_iter, told = iter(batches), []
    for batch in batch_iter:
        waiting.extend(reversed([*zip(*(c.to_pylist() for c in batch.columns), strict=True)]))
        while waiting:
            for rows, hot in _whole_seeds(blobs(batch_iter, waiting[-1][0]), NAMED):
                yield from _name_piece(rows, hot)
                for blob in told:
                    x = np.frombuffer(blob, _KNOWN)
                    yield _listed(KNOWN, x["key"], x["begin"], x["end"])
                told.clear()
            for blob in told:
                x = np.frombuffer(blob, _KNOWN)
                yield _listed(KNOWN, x["key"], x["begin"], x["end"])
            told.clear()


def _members(fragments: int):
    """(key, text, begins, ends, seeds, sure) to the members' bytes, by fragment."""

    def run(batches):
        for batch in batches:
            out, size = [], 0
            for key, text, begins, ends, seeds, sure in zip(batch.column(0).to_pylist(), common.as_bytes(batch.column(1)), *[batch.column(i).to_pylist() for i in range(2, 6)], strict=True):
                for b, e, s, x in zip(begins, ends, seeds, sure, strict=True):
                    out.append(((s >> 5) % fragments, s, key, b, x, text[b:e]))
                    size += e - b
                    if size >= 1 << 20:
                        yield _batch(out)
                        out, size = [], 0
            if out:
                yield _batch(out)

    return run


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()))], names=["fragment", "seed", "key", "begin", "sure", "held"])


def _windows(batches):
    """(key, text, begins, ends, seeds, sure) to rows (window's hash, place, key, begin, sure)."""
    powers = _Powers()
    for batch in batches:
        for key, text, begins, ends, seeds, sure in zip(batch.column(0).to_pylist(), common.as_bytes(batch.column(1)), *[batch.column(i).to_pylist() for i in range(2, 6)], strict=True):
            sums, down = _sums(text, powers)
            for b, e, s, x in zip(begins, ends, seeds, sure, strict=True):
                at = np.arange(b, e - WIDTH + 1)
                h = _mixed((sums[at + WIDTH] - sums[at]) * down[at] + np.uint64(s & (2**64 - 1)))
                place = _mixed(np.full(len(at), key, np.int64).view(np.uint64) * np.uint64(31) + at.astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(place.view(np.int64)), pa.array(np.full(len(at), key, np.int64)), pa.array(at.astype(np.int32)), pa.array(np.full(len(at), x, bool))], names=["window", "place", "key", "begin", "sure"])


def _sort_block(keys: list, begins: list, sure: list, held: list) -> Iterator[tuple]:
    """Intervals of repeated windows in the members that aren't sure: (key, begin, end) arrays, one bucket after another."""
    key, begin, known = np.array(keys, np.int64), np.array(begins, np.int64), np.array(sure, bool)
    for owner, offset, shared in induced.buckets(held):
        long = shared >= WIDTH
        long[:-1] |= long[1:]
        if not long.any():
            continue
        owner, offset, shared = owner[long], offset[long], shared[long]
        start = begin[owner] + offset
        place = _mixed(key[owner].view(np.uint64) * np.uint64(31) + start.astype(np.uint64))
        heads = np.flatnonzero(shared < WIDTH)
        twice = (np.minimum.reduceat(place, heads) != np.maximum.reduceat(place, heads)) | np.logical_or.reduceat(known[owner], heads)
        found = np.repeat(twice, np.diff(np.concatenate([heads, [len(shared)]]))) & ~known[owner]
        who, start = owner[found], start[found]
        if not len(who):
            continue
        order = np.lexsort((start, who))
        who, start = who[order], start[order]
        cut = np.concatenate([[True], (who[1:] != who[:-1]) | (start[1:] > start[:-1] + WIDTH)])
        first = np.flatnonzero(cut)
        last = np.concatenate([first[1:] - 1, [len(who) - 1]])
        yield key[who[first]], start[first], start[last] + WIDTH


def _sorted(batches):
    """A task's members, sorted by seed, in blocks of whole groups."""
    block: list[list] = [[], [], [], []]
    size, last = 0, None

    def done():
        found = [*_sort_block(*block)]
        if found:
            keys, begins, ends = (np.concatenate(x) for x in zip(*found, strict=True))
            k, lists = _grouped(keys, begins.astype(np.int32), ends.astype(np.int32))
            yield pa.RecordBatch.from_arrays([k, *lists], names=["key", "begins", "ends"])

    for batch in batches:
        for seed, key, begin, sure, held in zip(*[batch.column(i).to_pylist() for i in range(1, 6)], strict=True):
            if size >= BLOCK and seed != last:
                yield from done()
                block, size = [[], [], [], []], 0
            for x, v in zip(block, (key, begin, sure, held), strict=True):
                x.append(v)
            size, last = size + len(held), seed
    if block[0]:
        yield from done()


def _settle(df: DataFrame) -> None:
    gc.collect()
    df.sparkSession._jvm.System.gc()


def covered(docs: DataFrame) -> DataFrame:
    """key (hash of doc_id and text), begins, ends: lists of covered intervals, which may overlap."""
    p = common.partitions(docs.sparkSession, docs)
    texts = docs.select(_key(), F.col("text").cast("string"))
    # A fragment is named at a time; a worker's rows are one a fragment and HELD anchors, and never more than the anchors.
    dealt = texts.mapInArrow(_deal(4 * p), "fragment int, anchors binary, known binary").repartition(p, "fragment").sortWithinPartitions("fragment")
    named = common.stored(dealt.mapInArrow(_name, _NAMED), "suffix-names")
    _settle(docs)

    def with_texts(kind: int) -> DataFrame:
        lists = named.where(F.col("kind") == kind).groupBy("key").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("begins", "ends", "seeds", "sure")])
        return texts.join(lists, "key").select("key", "text", "begins", "ends", "seeds", "sure")

    members = with_texts(MEMBER).mapInArrow(_members(2 * p), "fragment int, seed long, key long, begin int, sure boolean, held binary")
    sorted_ = members.repartition(p, "fragment").sortWithinPartitions("seed").mapInArrow(_sorted, "key long, begins array<int>, ends array<int>")
    found = [named.where(F.col("kind") == KNOWN).select("key", "begins", "ends"), common.stored(sorted_, "suffix-found")]
    _settle(docs)
    if named.where(F.col("kind") == SPLIT).limit(1).count():
        windows = common.stored(with_texts(SPLIT).mapInArrow(_windows, "window long, place long, key long, begin int, sure boolean"), "suffix-windows")
        again = windows.groupBy("window").agg(F.min("place").alias("a"), F.max("place").alias("b"), F.max("sure").alias("s")).where("a != b or s").select("window")
        found.append(windows.where("not sure").join(again, "window").groupBy("key").agg(F.collect_list("begin").alias("begins")).select("key", "begins", F.transform("begins", lambda b: (b + WIDTH).cast("int")).alias("ends")))
    both = found[0]
    for x in found[1:]:
        both = both.unionByName(x)
    return both.groupBy("key").agg(F.flatten(F.collect_list("begins")).alias("begins"), F.flatten(F.collect_list("ends")).alias("ends"))


def _key():
    return F.xxhash64("doc_id", "text").alias("key")


def cut(text: bytes, begins: list[int] | None, ends: list[int] | None) -> tuple[bytes, int, int]:
    """What is left, bytes removed, and maximal removed runs."""
    if not begins:
        return text, 0, 0
    change = np.zeros(len(text) + 1, np.int32)
    np.add.at(change, np.array(begins), 1)
    np.add.at(change, np.array(ends), -1)
    gone = np.cumsum(change[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def _joined(docs: DataFrame) -> DataFrame:
    """The columns of docs, then the intervals' begins and ends, under names that don't clash."""
    key, begins, ends = common.fresh(docs.columns, "key", "begins", "ends")
    found = covered(docs).withColumnsRenamed({"key": key, "begins": begins, "ends": ends})
    return docs.withColumn(key, F.xxhash64("doc_id", "text")).join(found, key, "left").select(*[F.col(f"`{c}`") for c in docs.columns], begins, ends)


def report(docs: DataFrame) -> DataFrame:
    """One row a document: sizes and the hash of what is left."""

    def each(_, doc_id, text, begins, ends) -> tuple:
        rest, removed, runs = cut(text or b"", begins, ends)
        return doc_id, len(text or b""), removed, runs, hashlib.sha256(rest).hexdigest()

    rows = _joined(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return common.map_rows(rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", each)


def deduped(docs: DataFrame) -> DataFrame:
    """docs with shorter texts; all other columns as they were."""
    names, at = docs.columns, docs.columns.index("text")

    def run(batches):
        for batch in batches:
            n = batch.num_columns
            texts = [None if t is None else cut(t, b, e)[0].decode("utf-8", "replace") for t, b, e in zip(common.as_bytes(batch.column(at)), batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist(), strict=True)]
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(n - 2)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return _joined(docs).mapInArrow(run, docs.schema)
