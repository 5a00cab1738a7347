"""N-gram Jaccard join by vertical partitioning.

A document's set is its distinct 5-word shingles, as 64-bit hashes of lower-cased words; documents with equal sets
collapse into one node at once (the node's id is a hash of the set). The join finds all links between nodes with
`100 * intersection >= 80 * union`, and returns components.

Global order. Three eighths of the hash space, the ranked class, are ordered by document frequency, then hash; the rest
follows by hash. For the frequencies, tokens are dealt by hash to shards, some a task, one after another: each shard sees its
tokens of all nodes, counts frequencies and sends back only tokens that occur in two nodes or more. A node survives
if its share of such tokens allows a link at all (a linked node misses at most a fifth of its tokens elsewhere), and its
prefix, the first `n/5 + 1` tokens of the order, goes to buckets by token; two linked nodes share a token of both prefixes.

Overlaps. The order is cut into PARTS fragments: the ranked class, and ranges of the rest. Candidates of a bucket are counted
fragment by fragment: partial overlaps of the pair in each, then the sum per pair against the threshold. No bucket emits all its pairs: in each round every row is compared
with one hub of its bucket, and rows whose component is the hub's are skipped, so a group of near copies costs its size,
not its square. Once the cross-component pairs that are left are few (linear in the rows of the buckets), or after ROUNDS, all of them
are tested, so the result is exact whatever the hubs were: pair by pair in small buckets, in large ones in blocks, whose
rows' overlaps are products of indicator matrices, cut by cut of the order, and which give no more links than rows.

Defined results: null and empty texts and texts without words have no set, stand alone and have n_shingles 0; texts under
five words have one shingle, the whole sequence; a null doc_id is a value like another, and a component's id is the least
doc_id that isn't null; rows that repeat a doc_id with other texts count each with its own set; repeated rows come out as
often as they come in; extra columns don't matter; an empty table gives an empty result. Ties in the order go by hash.
Sets are compared by 64-bit hashes: a false equality has odds of about 2^-64 a pair.
"""

from __future__ import annotations

import gc
import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph

WORDS = 5
#: Link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: The ranked class: hashes whose last three bits are below this.
RANKED = 3
#: Cuts of the order in which a pair's partial overlaps are counted.
PARTS = 4
#: All cross-component pairs are tested at once when there are at most so many for each row of the buckets; hub rounds, at most.
FEW, ROUNDS = 40, 1
#: Members of a hub that are compared in one task group.
STAR = 256

#: Tokens that a worker holds before it deals them to the fragments.
HELD = 1_000_000
#: A bucket with more strong rows than this is compared in blocks of so many rows, as products of indicator matrices.
MANY, BLOCK = 64, 1024
#: Candidate pairs that are sent to every executor rather than shuffled with the sets; 24 bytes each.
SMALL = 200_000

log = logging.getLogger(__name__)

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh64_intdigest(word, 5)
        return h


def shingles(text: bytes | None, known: dict) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = text.lower().split() if text else []  # bytes.lower() changes A-Z only
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = max(1, len(h) - WORDS + 1)
    s = np.full(k, len(h) if len(h) < WORDS else WORDS, np.uint64)
    for i in range(min(WORDS, len(h))):
        s += h[i : i + k] * _MIX[i]
    s ^= s >> np.uint64(32)
    s *= np.uint64(0x9FB21C651E98DF25)
    s ^= s >> np.uint64(29)
    return np.unique(s.view(np.int64))


def node_id(tokens: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64)) if len(tokens) else 0


def _ranked(tokens: np.ndarray) -> np.ndarray:
    return (tokens & 7) < RANKED


def _fragments(fragments: int):
    """Documents to rows (fragment, nodes, counts, tokens, info): what each fragment gets of HELD tokens."""

    def run(batches):
        known = _Hashes()
        nodes: dict[int, tuple] = {}
        info, sent, owner, held = [], [], [], 0

        def dealt():
            tokens = np.concatenate(sent) if sent else np.zeros(0, np.int64)
            owners = np.concatenate(owner) if owner else np.zeros(0, np.int64)
            cut = ((tokens >> 3) % fragments).astype(np.int64)
            about = np.array([(d, e, n, s, nodes.get(n, (s, 0))[1]) for d, e, n, s in info], np.int64).reshape(-1, 5)
            home = (about[:, 2] >> 7) % fragments
            order = np.argsort(cut, kind="stable")
            bounds = np.searchsorted(cut[order], np.arange(fragments + 1))
            homes = np.argsort(home, kind="stable")
            at_home = np.searchsorted(home[homes], np.arange(fragments + 1))
            rows = []
            for f in range(fragments):
                own, mine = order[bounds[f] : bounds[f + 1]], homes[at_home[f] : at_home[f + 1]]
                if len(own) or len(mine):
                    o = owners[own]
                    first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]])) if len(o) else np.zeros(0, np.int64)
                    counts = np.diff(np.concatenate([first, [len(o)]])).astype(np.int32)
                    rows.append((f, o[first].tobytes(), counts.tobytes(), tokens[own].tobytes(), about[mine].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 5)]], names=["fragment", "nodes", "counts", "tokens", "info"])

        for batch in batches:
            if len(known) > 2_000_000:
                known = _Hashes()
            for doc_id, text in zip(batch.column(0).to_pylist(), common.as_bytes(batch.column(1)), strict=True):
                tokens = shingles(text, known)
                node = node_id(tokens)
                info.append((0 if doc_id is None else doc_id, doc_id is None, node, len(tokens)))
                held += 4
                if node not in nodes and len(tokens) >= 4:  # fewer than four tokens link with equal sets alone
                    ranked = tokens[_ranked(tokens)]
                    nodes[node] = (len(tokens), len(ranked))
                    short = len(tokens) // 5 + 1 - len(ranked)
                    mine = np.concatenate([ranked, tokens[~_ranked(tokens)][:short]]) if short > 0 else ranked
                    sent.append(mine)
                    owner.append(np.full(len(mine), node, np.int64))
                    held += len(mine)
                if held >= HELD:
                    yield dealt()
                    nodes.clear()
                    info, sent, owner, held = [], [], [], 0
        if info:
            yield dealt()

    return run


def _count(batches):
    """Rows sorted by fragment: the counts of each."""
    nodes, tokens, info, last = [], [], [], None
    for batch in batches:
        for f, n, c, t, i in zip(*[batch.column(k).to_pylist() for k in ("fragment", "nodes", "counts", "tokens", "info")], strict=True):
            if f != last and last is not None:
                yield from _counted(nodes, tokens, info)
                nodes, tokens, info = [], [], []
            last = f
            nodes.append(np.repeat(np.frombuffer(n, np.int64), np.frombuffer(c, np.int32)))
            tokens.append(np.frombuffer(t, np.int64))
            info.append(np.frombuffer(i, np.int64).reshape(-1, 5))
    if last is not None:
        yield from _counted(nodes, tokens, info)


def _counted(nodes: list, tokens: list, info: list):
    """A fragment: frequencies, and for each node its tokens that occur elsewhere too."""
    names = ["kind", "node", "n", "ranked", "doc_id", "tokens", "counts"]
    schema = pa.schema([("kind", pa.int32()), ("node", pa.int64()), ("n", pa.int64()), ("ranked", pa.int64()), ("doc_id", pa.int64()), ("tokens", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))])
    if info and len(about := np.concatenate(info)):
        for at in range(0, len(about), 50_000):
            x = about[at : at + 50_000]
            none = pa.nulls(len(x), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(x), np.int32)), pa.array(x[:, 2]), pa.array(x[:, 3]), pa.array(x[:, 4]), pa.array(x[:, 0], mask=x[:, 1] > 0), none, pa.nulls(len(x), pa.list_(pa.int32()))], schema=schema)
    if not tokens:
        return
    t, o = np.concatenate(tokens), np.concatenate(nodes)
    del tokens, nodes
    order = np.lexsort((o, t))
    t, o = t[order], o[order]
    new = np.concatenate([[True], (t[1:] != t[:-1]) | (o[1:] != o[:-1])])[: len(t)]  # a node comes from many batches, if it has copies
    t, o = t[new], o[new]
    if not len(t):
        return
    first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    sizes = np.diff(np.concatenate([first, [len(t)]]))
    df = np.repeat(sizes, sizes)
    t, o, df = t[df > 1], o[df > 1], df[df > 1]
    order = np.argsort(o, kind="stable")
    t, o, df = t[order], o[order], df[order].astype(np.int32)
    first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]])[: len(o)])
    ends = np.concatenate([first[1:], [len(o)]]) if len(first) else first
    for at in range(0, len(first), 20_000):
        a, b = first[at : at + 20_000], ends[at : at + 20_000]
        offsets = pa.array(np.concatenate([a, b[-1:]]) - a[0], pa.int32())
        k, none = len(a), pa.nulls(len(a), pa.int64())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[a[0] : b[-1]])) for x in (t, df)]
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.array(o[a]), none, none, none, *lists], names=names)


def _prefixes(batches):
    """Nodes that can have links: their prefix tokens with positions in the order."""
    for batch in batches:
        out = []
        for node, n, ranked, tokens, counts in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
            t, c = np.array(tokens, np.int64), np.array(counts, np.int64)
            inside = _ranked(t)
            lone = ranked - int(inside.sum())
            if lone > n // 5:
                continue
            mine, freq, rest = t[inside], c[inside], t[~inside]
            order = np.lexsort((mine, freq))
            at = np.arange(lone, lone + len(mine))
            keep = at <= n // 5
            chosen = np.concatenate([mine[order][keep], rest])
            out.append((node, n, chosen.tolist(), [*at[keep].tolist(), *([ranked] * len(rest))]))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.list_(pa.int64())), pa.array([r[3] for r in out], pa.list_(pa.int32()))], names=["node", "n", "tokens", "places"])


def _settle(df: DataFrame) -> None:
    """Lets Spark drop the shuffle files of finished steps."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


def _overlaps(batches):
    """Rows sorted by star and part, the hub's first: partial overlaps of each member with the hub."""
    hub_key, hub = None, None
    for batch in batches:
        out = []
        stars, salts, parts, nodes, sets = (batch.column(i) for i in range(5))
        sets = common.as_bytes(sets) if pa.types.is_string(sets.type) else sets.to_pylist()
        for star, salt, part, node, held in zip(stars.to_pylist(), salts.to_pylist(), parts.to_pylist(), nodes.to_pylist(), sets, strict=True):
            tokens = np.frombuffer(held, np.int64)
            if node == star:
                hub_key, hub = (star, salt, part), tokens
                continue
            if (star, salt, part) != hub_key:
                raise RuntimeError("a star came without its hub")
            at = np.searchsorted(hub, tokens)
            at[at == len(hub)] = 0
            out.append((star, node, int((hub[at] == tokens).sum()) if len(hub) else 0))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["a", "b", "shared"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, na, nb of those pairs whose partial overlaps add up to the threshold."""
    spark = pairs.sparkSession
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("salts"))
    edges = pairs.join(sizes, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    hubs = edges.select("a", "salt").distinct().select("a", "salt", F.col("a").alias("b"))
    wanted = edges.select("a", "salt", "b").unionByName(hubs)
    rows = wanted.join(sets, wanted.b == sets.node).select("a", "salt", "part", "node", "held")
    dealt = rows.repartition(common.partitions(spark), "a", "salt", "part").sortWithinPartitions("a", "salt", "part", F.col("node") != F.col("a"))
    counted = dealt.mapInArrow(_overlaps, "a long, b long, shared long").groupBy("a", "b").agg(F.sum("shared").alias("overlap"))
    full = counted.join(pairs, ["a", "b"])
    return full.where((100 + PERCENT) * F.col("overlap") >= PERCENT * (F.col("na") + F.col("nb"))).select("a", "b", "na", "nb")


def _sets(part_of: int):
    """Documents of nodes to rows (node, part, held): the set, cut along the order (the ranked class, then the rest by hash)."""

    def run(batches):
        known = _Hashes()
        for batch in batches:
            out = []
            for node, text in zip(batch.column(0).to_pylist(), common.as_bytes(batch.column(1)), strict=True):
                tokens = shingles(text, known)
                if node_id(tokens) != node:  # another row of the same doc_id
                    continue
                first, rest = tokens[_ranked(tokens)], tokens[~_ranked(tokens)]
                cut = np.searchsorted(rest, [(-(1 << 63)) + i * ((1 << 64) // (part_of - 1)) for i in range(1, part_of - 1)])
                out += [(node, i, x.tobytes()) for i, x in enumerate([first, *np.split(rest, cut)])]
            if len(known) > 2_000_000:
                known = _Hashes()
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())], names=["node", "part", "held"])

    return run


def _sets_of(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, small: bool) -> DataFrame:
    """Sets of the pairs' nodes, from a text of each. small: the pairs were counted to be few enough to send to all."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    members = wanted.join(nodes, "node").select("node", F.col("doc_id").alias("_id"))
    chosen = texts.join(F.broadcast(members) if small else members, F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "text")
    return chosen.mapInArrow(_sets(PARTS), "node long, part int, held binary").dropDuplicates(["node", "part"])


def _possible(a: str, b: str):
    """Whether rows a and b of a bucket can be linked, if their token is the first they share.

    With `places` before it, a set of n tokens shares n - place at most, and must share 4/9 of both sizes' sum. A row whose
    place is beyond n / 9 therefore needs a partner smaller than itself; two such rows can't both have one.
    """
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    most = F.least(n - F.col(f"{a}.place"), m - F.col(f"{b}.place"))
    return ((100 + PERCENT) * most >= PERCENT * (n + m)) & (100 * F.least(n, m) >= PERCENT * F.greatest(n, m))


def _compared(nodes: list, labels: list, strong: list, cuts: list[list[np.ndarray]]) -> list[tuple[int, int, int, int]]:
    """Links (a, b, na, nb) that connect a block's rows: partial overlaps cut by cut of the order, then the sum per pair."""
    k = len(nodes)
    sizes = np.array([sum(len(p) for p in ps) for ps in cuts], np.int64)
    first = np.flatnonzero(np.array(strong, bool))
    overlap = np.zeros((len(first), k), np.float32)
    for cut in range(PARTS):
        flat = np.concatenate([ps[cut] for ps in cuts])
        owner = np.repeat(np.arange(k), [len(ps[cut]) for ps in cuts])
        _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count[column] > 1
        column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
        width = int(column.max()) + 1 if len(column) else 0
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        for at in range(0, width, 1024):
            lo, hi = np.searchsorted(column, [at, at + 1024])
            held = np.zeros((k, min(1024, width - at)), np.float32)
            held[owner[lo:hi], column[lo:hi] - at] = 1
            overlap += held[first] @ held.T
    label, root, out = np.array(labels, np.int64), np.arange(k), []
    for at in range(0, len(first), 128):  # a few rows at a time, so that nothing but the overlaps is as large as they are
        own = first[at : at + 128]
        linked = ((100 + PERCENT) * overlap[at : at + 128].astype(np.int64) >= PERCENT * (sizes[own][:, None] + sizes[None, :])) & (label[own][:, None] != label[None, :])
        for x, ok in zip(own.tolist(), linked, strict=True):
            others = np.flatnonzero(ok & (root != root[x]))
            if len(others):  # one link to each part that isn't connected yet
                parts, some = np.unique(root[others], return_index=True)
                out += [(nodes[x], nodes[y], int(sizes[x]), int(sizes[y])) for y in others[some].tolist()]
                root[np.isin(root, parts)] = root[x]
    return out


def _block_links(batches):
    """Rows (token, i, j, node, label, strong, part, held), sorted by the first three: links of each block."""
    key, rows = None, {}

    def done():
        found = _compared([*rows], [r[0] for r in rows.values()], [r[1] for r in rows.values()], [[np.frombuffer(r[2].get(c, b""), np.int64) for c in range(PARTS)] for r in rows.values()]) if len(rows) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(4)], names=["a", "b", "na", "nb"])

    for batch in batches:
        for token, i, j, node, label, strong, part, held in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (token, i, j) != key:
                if rows:
                    yield done()
                key, rows = (token, i, j), {}
            rows.setdefault(node, (label, strong, {}))[2][part] = held
    if rows:
        yield done()


def _in_blocks(rows_of: DataFrame, tokens: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links of buckets with many strong rows. A bucket of b blocks is b * b / 2 tasks' worth of rows, none of them pairs.

    Buckets of one hub that overlap so much that comparing their union costs no more than comparing each are compared as one:
    near copies share many frequent tokens.
    """
    own = rows_of.join(tokens.select("token", "all", F.col("hub.pick.node").alias("family")), "token").select("token", "node", "label", "strong", "family")
    own = common.checkpoint(own)
    apart = tokens.groupBy(F.col("hub.pick.node").alias("family")).agg(F.sum(F.col("all").cast("double") * F.col("all")).alias("cost"))
    joint = own.groupBy("family").agg(F.count_distinct("node").alias("rows")).join(apart, "family").select("family", (F.col("rows").cast("double") * F.col("rows") <= F.col("cost")).alias("one"))
    merged = own.join(joint, "family").withColumn("token", F.when(F.col("one"), F.xxhash64(F.lit(1), "family")).otherwise(F.xxhash64(F.lit(2), "token")))
    own = merged.groupBy("token", "node").agg(F.min("label").alias("label"), F.max("strong").alias("strong"))
    sizes = own.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = common.checkpoint(own.join(sizes, "token").withColumn("i", F.pmod(F.xxhash64(F.lit(3), F.col("node")), F.col("blocks")).cast("int")))
    wanted = own.select(F.col("node").alias("a"), F.col("node").alias("b")).distinct()
    sets = _sets_of(wanted, nodes, texts, wanted.count() <= SMALL)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = own.withColumn("j", other).select("token", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "node", "label", "strong").join(sets, "node")
    dealt = dealt.select("token", "i", "j", "node", "label", "strong", "part", "held").repartition(common.partitions(texts.sparkSession), "token", "i", "j").sortWithinPartitions("token", "i", "j")
    return dealt.mapInArrow(_block_links, "a long, b long, na long, nb long").distinct()


def joined(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The operator: rows (doc_id, node, n), links (a, b, na, nb: enough to connect what is linked), labels (node, label)."""
    spark = docs.sparkSession
    p = common.partitions(spark, docs)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    cut = texts.mapInArrow(_fragments(4 * p), "fragment int, nodes binary, counts binary, tokens binary, info binary")
    schema = "kind int, node long, n long, ranked long, doc_id long, tokens array<long>, counts array<int>"
    counted = common.stored(cut.repartition(p, "fragment").sortWithinPartitions("fragment").mapInArrow(_count, schema), "ngram-fragments")
    _settle(docs)
    rows = counted.where("kind = 0").select("doc_id", "node", "n", "ranked")
    nodes = rows.groupBy("node").agg(F.max("n").alias("n"), F.max("ranked").alias("ranked"), F.min("doc_id").alias("doc_id"))
    shared = counted.where("kind = 1").groupBy("node").agg(F.flatten(F.collect_list("tokens")).alias("tokens"), F.flatten(F.collect_list("counts")).alias("counts"))
    prefix = shared.join(nodes, "node").select("node", "n", "ranked", "tokens", "counts").mapInArrow(_prefixes, "node long, n long, tokens array<long>, places array<int>")
    buckets = prefix.select("node", "n", F.explode(F.arrays_zip("tokens", "places")).alias("x")).select(F.col("x.tokens").alias("token"), "node", "n", F.col("x.places").alias("place"))
    # Of two linked rows one at least stands in the first ninth of its set (see _possible): that one is strong.
    buckets = buckets.withColumn("strong", 9 * F.col("place") <= F.col("n"))
    buckets = common.stored(buckets, "ngram-buckets")
    multi = buckets.groupBy("token").agg(F.count("*").alias("k"), F.count_if("strong").alias("s")).where("k > 1 and s > 0")
    buckets = common.stored(buckets.join(multi, "token", "left_semi"), "ngram-shared")
    nodes = common.stored(nodes, "ngram-nodes")
    _settle(docs)

    links = tested = labels = tokens = None
    idle = 0
    for step in range(ROUNDS + 1):
        rows_of = buckets.withColumn("label", F.col("node"))
        if labels is not None:  # only buckets that were mixed before can be
            own = buckets.join(tokens.select("token"), "token", "left_semi").join(F.broadcast(labels) if labels.count() <= SMALL else labels, "node", "left")
            rows_of = common.checkpoint(own.withColumn("label", F.coalesce("label", "node")))
        strong = F.when(F.col("strong"), F.struct(F.xxhash64(F.lit(step), F.col("node")).alias("h"), "node", "n", "place"))
        by = rows_of.groupBy("token", "label").agg(F.count("*").alias("k"), F.count_if("strong").alias("s"), F.min(strong).alias("pick"))
        hub = F.min_by(F.struct("label", "pick"), F.col("pick.h")).alias("hub")
        tokens = by.groupBy("token").agg(F.sum("k").alias("all"), F.sum("s").alias("s"), F.sum(F.col("k") * F.col("s")).alias("own"), hub, F.count("*").alias("labels")).where("labels > 1 and s > 0")
        tokens = common.checkpoint(tokens)
        left = tokens.agg(F.sum(F.col("all") * F.col("s") - F.col("own")).alias("pairs"), F.sum("all").alias("rows")).first()
        if not left.rows:
            break
        last = left.pairs <= FEW * left.rows or idle >= 2 or step == ROUNDS
        live = rows_of.join(tokens.select("token", "hub.label", "hub.pick").withColumnRenamed("label", "hub_label"), "token").where("label != hub_label") if not last else None
        big = None
        if last:
            big = tokens.where(F.col("s") > MANY)
            own = rows_of.join(tokens.where(F.col("s") <= MANY).select("token"), "token", "left_semi")
            x, y = own.alias("x"), own.alias("y")
            found = x.join(y, (F.col("x.token") == F.col("y.token")) & F.col("x.strong") & (~F.col("y.strong") | (F.col("x.node") < F.col("y.node"))) & (F.col("x.label") != F.col("y.label"))).where(_possible("x", "y"))
            swap = F.col("x.node") > F.col("y.node")
            side = lambda c, u, v: F.when(swap, F.col(f"{u}.{c}")).otherwise(F.col(f"{v}.{c}"))
            pairs = found.select(side("node", "y", "x").alias("a"), side("node", "x", "y").alias("b"), side("n", "y", "x").alias("na"), side("n", "x", "y").alias("nb"))
        else:
            found = live.select(F.struct("node", "n", "place").alias("x"), F.col("pick").alias("y")).where(_possible("x", "y"))
            pairs = found.select(F.col("y.node").alias("a"), F.col("x.node").alias("b"), F.col("y.n").alias("na"), F.col("x.n").alias("nb"))
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, (F.least("a", "b") == tested.lo) & (F.greatest("a", "b") == tested.hi), "left_anti")
        pairs = common.checkpoint(pairs)
        count = pairs.count()
        log.info("round %d: %d rows in mixed buckets, %d cross pairs, %d to compare", step, left.rows, left.pairs, count)
        done = pairs.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        tested = done if tested is None else tested.unionByName(done)
        new = common.checkpoint(_verified(pairs, _sets_of(pairs, nodes, texts, count <= SMALL)))
        if big is not None and big.limit(1).count():
            new = new.unionByName(common.checkpoint(_in_blocks(rows_of, big, nodes, texts)))
        _settle(docs)
        idle = 0 if new.limit(1).count() else idle + 1
        links = new if links is None else links.unionByName(new)
        labels = graph.components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
        if last:
            break
    if links is None:
        links = spark.createDataFrame([], "a long, b long, na long, nb long")
        labels = spark.createDataFrame([], "node long, label long")
    return rows, links, labels


def clusters(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    rows, _, labels = joined(docs)
    named = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    full = named.join(least, "label", "left")
    return full.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: of the least doc_id (nulls last; of rows that share it, one). Rows without words stay."""
    # Ids may repeat or be null, so rows are told apart by a number of their own; stored, for it must not change between reads.
    row, = common.fresh(docs.columns, "row")
    numbered = common.stored(docs.withColumn(row, F.monotonically_increasing_id()), "ngram-rows")
    found = clusters(numbered.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "n_shingles", "component_id")
    own = found.join(numbered.select(F.col(row).alias("row"), "doc_id", F.xxhash64("text").alias("t")), "row")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t", "row"))["row"]
    chosen = own.where("n_shingles > 0").groupBy("component_id").agg(first.alias("row")).select("row").unionByName(own.where("n_shingles = 0").select("row"))
    return numbered.join(chosen.withColumnRenamed("row", row), row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
