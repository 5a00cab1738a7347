"""Quality rules with risk-controlled thresholds.

Rules reject a text whose measured feature lies above a cutoff. Cutoffs come from labelled texts in two halves: a text
counts once however many rows repeat it, is good if any of its labels says so, and goes to a half by its hash, so that
draws of the holdout are of different texts. The fitting half proposes, for each stratum (language), a chain of nested rule sets from mild to strict: cutoffs at ever
lower quantiles of the good rows' features. The holdout half tests the chain in that order: the hypothesis "this set
rejects more than ALPHA of the good rows" is rejected by the exact binomial test (the Clopper-Pearson bound), at level
DELTA over the number of strata (Bonferroni between strata; a fixed sequence needs no correction inside one). The last
set that passes is used; a stratum with too few labels for any proof gets no learnt rule and keeps its rows. Every
labelled text takes part, and quantiles and counts are exact.

Defined results: null and empty texts have no words and fail the base rule; a null or unseen language has the stratum
'' and learns from rows like it; repeated rows are each judged alone; a feature equal to its cutoff passes; labels that are null
or for absent rows are ignored; of several texts under one labelled id, that of the least hash is learnt from; an empty table
gives an empty result. Extra columns pass through `filtered` untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Share of good rows that the learnt rules of a stratum may reject, and the chance that any stratum's share is higher.
ALPHA, DELTA = 0.01, 0.05
#: Share of the fitting half's good rows above a cutoff, by step of the chain; 0 is a margin above their maximum.
CHAIN = (0.0, 0.0002, 0.0005, 0.001, 0.002)
#: Base rule, fixed by the contract: least words, and most per cent of words in repeated windows.
MIN_WORDS, MAX_REPEAT = 50, 50

_SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
_UPPER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
FEATURES = ("symbols", "bangs", "upper", "digits", "dup_lines", "repeats", "word_length")
#: No cutoff goes below these: a stray sign or a short heading in capitals is no fault, whatever the labels say.
FLOORS = (0.01, 0.01, 0.2, 0.1, 0.34, 0.35, 12.0)
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, features array<double>"


class _Ids(dict):
    """A dense number for each word, so that three fit in 63 bits."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _repeat_words(ids: np.ndarray) -> int:
    if len(ids) < 4:
        return 0
    key = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(ids) + 2, bool)
    twice[order[1:][same] + 2] = True
    twice[order[:-1][same] + 2] = True  # twice[i + 2]: the window that begins at word i
    return int((twice[2:] | twice[1:-1] | twice[:-2])[: len(ids)].sum())


def measure(text: bytes | None, ids: _Ids | None = None) -> tuple:
    """The base counts and the features of one text."""
    text = text or b""
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, common.SPACE + _CONTINUATION))
    count = lambda of: len(text) - len(text.translate(None, of))
    symbols = count(_SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.strip(common.SPACE)]
    dup_lines = len(lines) - len(set(lines))
    ids = _Ids() if ids is None or len(ids) > 1_000_000 else ids
    if n > 1_000_000:
        ids = _Ids()
    repeats = _repeat_words(np.fromiter(map(ids.__getitem__, words), np.int64, n)) if len(set(words)) < 2_000_000 else _repeat_words_many(words)
    per = lambda x, of: x / of if of else 0.0
    features = [per(symbols, chars), per(count(b"!"), chars), per(count(_UPPER), chars), per(count(_DIGITS), chars), per(dup_lines, len(lines)), per(repeats, n), per(chars, n)]
    return n, chars, symbols, dup_lines, repeats, features


def _repeat_words_many(words: list[bytes]) -> int:
    """For a text of millions of distinct words, whose numbers don't fit 21 bits."""
    from collections import Counter

    grams = list(zip(words, words[1:], words[2:], strict=False))
    seen, covered = Counter(grams), bytearray(len(words))
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered[i : i + 3] = b"\1\1\1"
    return sum(covered)


def measured(docs: DataFrame, keys: tuple[str, ...], cuts: dict[str, list[float]] | None = None) -> DataFrame:
    """keys and the measures of each row, and with cuts base_failed and kept (lang must then be a key); `text` is read whole."""
    kinds, schema = dict(docs.dtypes), MEASURES + (", base_failed boolean, kept boolean" if cuts is not None else "")
    arrow = common.arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        ids = _Ids()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                if len(ids) > 1_000_000:
                    ids = _Ids()
                out = [measure(t, ids) for t in common.as_bytes(part.column(len(keys)))]
                if cuts is not None:
                    out = [(*row, *verdict(row, lang, cuts)) for row, lang in zip(out, common.as_bytes(part.column(keys.index("lang"))), strict=True)]
                made = [pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], *made], names=[*keys, *arrow.names])

    return docs.select(*[F.col(f"`{k}`") for k in keys], F.col("text").cast("string")).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + schema)


def binomial_tail(n: int, k: int, p: float) -> float:
    """P(X <= k) of a binomial, exact to rounding: the p-value of "the rate is above p" after k of n."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    most = max(logs)
    return min(1.0, math.exp(most) * sum(math.exp(x - most) for x in logs))


def upper_bound(n: int, k: int, delta: float) -> float:
    """Clopper-Pearson: the largest rate that k of n doesn't refute at level delta."""
    low, high = k / max(n, 1), 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 0 < mid < 1 and binomial_tail(n, k, mid) > delta else (low, mid)
    return high


def _proven(chain: Iterable[tuple[list[float], int]], n: int, alpha: float, level: float) -> list[float] | None:
    """The last cutoffs of a chain that the n holdout rows, of which each rejects so many, prove safe with all before."""
    found = None
    for top, wrong in chain:
        if binomial_tail(n, wrong, alpha) > level:
            break
        found = top
    return found


def cutoffs(strata: list[str], features: np.ndarray, good: np.ndarray, holdout: np.ndarray, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, list[float]]:
    """For each stratum that the holdout proves safe, a cutoff for each feature: what `learn` finds, of rows in memory."""
    found, names = {}, np.array(strata, object)
    level = delta / max(1, len(set(strata)))
    for stratum in sorted(set(strata)):
        own = (names == stratum) & good
        fit, test = features[own & ~holdout], features[own & holdout]
        if not len(fit) or not len(test):
            continue
        tops = [np.maximum(FLOORS, np.quantile(fit, 1 - share, axis=0, method="higher") if share else fit.max(axis=0) * 1.1 + 1e-9) for share in CHAIN]
        proven = _proven((([float(x) for x in top], int((test > top).any(axis=1).sum())) for top in tops), len(test), alpha, level)
        if proven:
            found[stratum] = proven
    return found


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every labelled text that passes the base rule, once a stratum: lang, good, holdout, features. No text is shuffled."""
    chosen = labels.select(F.col("doc_id").cast("long"), "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.xxhash64("text").alias("t"), "text").where("doc_id is not null")
    rows = measured(own, ("doc_id", "lang", "t")).where(f"n_words >= {MIN_WORDS} and 100 * n_repeat_words <= {MAX_REPEAT} * n_words")
    by_id = rows.groupBy("doc_id").agg(F.min(F.struct("t", "lang", "features")).alias("r")).join(chosen, "doc_id").select("r.*", "quality")
    texts = by_id.groupBy("t", "lang").agg(F.max("quality").alias("quality"), F.min("features").alias("features"))
    return texts.select("lang", F.expr("quality = 1").alias("good"), F.expr("pmod(xxhash64(t, 1L), 2) = 1").alias("holdout"), "features")


def highest(values: DataFrame, ranks: dict[tuple[str, int], list[int]], parts: int) -> dict[tuple[str, int, int], float]:
    """Of (lang, feature, value) rows, the value at each rank of a (lang, feature), 0 being the largest; none beyond the last.

    Distinct values with their counts are sorted over parts ranges. The driver sees the count of each range, which tells
    the range of a rank, and the values found.
    """
    spark = values.sparkSession
    counted = values.groupBy("lang", "feature", "value").agg(F.count("*").alias("n"))
    dealt = common.stored(counted.repartitionByRange(parts, "lang", "feature", F.desc("value")).withColumn("part", F.spark_partition_id()), "quality-values")
    before, wanted = {}, []
    for r in dealt.groupBy("lang", "feature", "part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        key = (r.lang, r.feature)
        low = before.get(key, 0)
        before[key] = low + r.n
        inside = [k for k in ranks.get(key, []) if low <= k < low + r.n]
        if inside:
            wanted.append((*key, r.part, low, inside))
    if not wanted:
        return {}
    window = Window.partitionBy("lang", "feature", "part").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = dealt.join(F.broadcast(spark.createDataFrame(wanted, "lang string, feature int, part int, low long, ranks array<long>")), ["lang", "feature", "part"])
    placed = near.withColumn("until", F.col("low") + F.sum("n").over(window)).withColumn("ranks", F.expr("filter(ranks, k -> k >= until - n and k < until)"))
    return {(r.lang, r.feature, k): r.value for r in placed.where("size(ranks) > 0").collect() for k in r.ranks}


def learn(docs: DataFrame, labels: DataFrame) -> dict[str, list[float]]:
    """`cutoffs` of all labelled texts, which stay on the cluster: the driver sees counts and order statistics of strata.

    A value that is no higher than its floor can't set a cutoff, so only those above are ranked.
    """
    spark, width = docs.sparkSession, len(FEATURES)
    texts = common.stored(labelled(docs, labels), "quality-labelled")
    fit, test = F.col("good") & ~F.col("holdout"), F.col("good") & F.col("holdout")
    strata = texts.groupBy("lang").agg(F.count_if(fit).alias("n_fit"), F.count_if(test).alias("n_test"), *[F.max(F.when(fit, F.col("features")[i])).alias(f"most_{i}") for i in range(width)])
    level = DELTA / max(1, strata.count())
    # With fewer holdout rows than that, not even a set that rejects none of them is proven.
    sized = {r.lang: r for r in strata.where((F.col("n_fit") > 0) & (F.col("n_test") >= math.floor(math.log(level) / math.log1p(-ALPHA)))).collect()}
    if not sized:
        return {}
    rank = lambda n, share: n - 1 - int(np.ceil((n - 1) * (1 - share)))  # noqa: E731  as np.quantile's "higher"
    values = texts.where(fit).select("lang", F.posexplode("features").alias("feature", "value")).where(F.col("value") > F.array(*map(F.lit, FLOORS))[F.col("feature")])
    top = highest(values, {(lang, i): sorted({rank(r.n_fit, share) for share in CHAIN if share}) for lang, r in sized.items() for i in range(width)}, common.partitions(spark, texts))
    cutoff = lambda r, i, share: max(FLOORS[i], top.get((r.lang, i, rank(r.n_fit, share)), 0.0) if share else r[f"most_{i}"] * 1.1 + 1e-9)
    chains = {lang: [[cutoff(r, i, share) for i in range(width)] for share in CHAIN] for lang, r in sized.items()}
    steps = spark.createDataFrame(list(chains.items()), "lang string, chain array<array<double>>")
    over = F.expr("transform(chain, top -> exists(zip_with(features, top, (x, y) -> x > y), z -> z))")
    wrong = texts.where(test).join(F.broadcast(steps), "lang").select("lang", over.alias("over")).groupBy("lang").agg(F.array(*[F.count_if(F.col("over")[k]) for k in range(len(CHAIN))]).alias("wrong"))
    proven = {r.lang: _proven(zip(chains[r.lang], r.wrong, strict=True), sized[r.lang].n_test, ALPHA, level) for r in wrong.collect()}
    return {lang: proven[lang] for lang in sorted(proven) if proven[lang]}


def verdict(row: tuple, lang: bytes | None, cuts: dict[str, list[float]]) -> tuple[bool, bool]:
    """base_failed and kept of one measured row."""
    n, _, _, _, repeats, features = row
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT * n
    top = cuts.get((lang or b"").decode("utf-8", "replace"))
    return failed, not failed and not (top and any(x > y for x, y in zip(features, top, strict=True)))


def judged(docs: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """The operator: one row a document with its measures, base_failed and kept. The cutoffs are a few numbers a stratum."""
    return measured(docs, keys, learn(docs, labels))


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the rules reject; all columns, whatever their names, as they were."""
    cuts = learn(docs, labels)
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches):
        import pyarrow as pa

        ids = _Ids()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = _Ids() if len(ids) > 1_000_000 else ids
                rows = zip(common.as_bytes(part.column(text)), common.as_bytes(part.column(lang)), strict=True)
                yield part.filter(pa.array([verdict(measure(t, ids), x, cuts)[1] for t, x in rows], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
