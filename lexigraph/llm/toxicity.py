"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding: lower case, homoglyphs (Cyrillic, Greek, full-width) to Latin letters, digit and sign substitutions inside words
to letters (so "1d10t" reads "idiot"), everything else that is no letter to a space. Terms are word beginnings or whole
words, learnt with their weights (log-odds of document frequency) from labelled rows; exception phrases, two-word contexts
of a term that clean rows hold as often as toxic ones, take a hit back. The score is a logistic function of the weighted
hits, the hits per hundred words, and the number of distinct terms.

Only labelled rows for which `trainable` holds take part in learning, MAX_LABELLED at most (least hash of the id); what
the driver gathers of them is a table of terms, which such a sample bounds, and three numbers a row. Scores never see
labels, lang, source or id.

Defined results: null and empty texts have no hits and get the score of no hits; whole texts are matched however long;
repeated rows are scored alike; labels that are null are ignored; a text that is labelled both ways is learnt once, as toxic;
of hits that begin at one place the heaviest counts, of equal ones the first term by code points; without labels the lexicon
is empty and every score is PRIOR. Extra columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_LABELLED, PRIOR = 20_000, 0.1
#: A term has at least this many letters, stands in this share of toxic rows, and is so many times as frequent in them.
LEAST, SHARE, LIFT = 4, 0.008, 12.0
PREFIXES = (4, 5, 6, 7)

# Letters that look like Latin ones, and signs written for letters.
_LOOKS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "υ": "u", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "ı": "i", "ɑ": "a", "ɡ": "g"}
_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


class _Fold(dict):
    """str.translate table that fills itself."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        low = c.lower()[:1]
        if 0xFF01 <= code <= 0xFF5E:
            low = chr(code - 0xFEE0).lower()
        out = _LOOKS.get(low) or (low if low.isalpha() or low in _SIGNS else "" if c in "​‌‍­﻿" else " ")
        self[code] = out
        return out


_FOLD = _Fold()


_SIGNED = re.compile(r"\S*[" + re.escape("".join(_SIGNS)) + r"]\S*")
_AS_LETTERS = str.maketrans(_SIGNS)


def _unsigned(m: re.Match) -> str:
    """Signs are letters in a word that has letters; other numbers are none."""
    return m[0].translate(_AS_LETTERS) if any(c.isalpha() for c in m[0]) else " "


def fold(text: str) -> str:
    """Words of folded letters, each with one space before it."""
    return " " + " ".join(_SIGNED.sub(_unsigned, text.translate(_FOLD)).split()) + " "


def candidates(folded: str) -> set[str]:
    """What could be a term: whole words (with the space after) and word beginnings (without)."""
    words = {w for w in folded.split() if len(w) >= LEAST}
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in PREFIXES if len(w) >= n}


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: list[str], model: list[float]) -> None:
        self.weights, self.exceptions, self.model = weights, exceptions, model

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for term, w in self.weights.items():
            a.add_word(term, (term, w))
        for phrase in self.exceptions:
            a.add_word(f" {phrase} ", (None, f" {phrase} "))
        if len(a):
            a.make_automaton()
        return a

    def features(self, automaton, text: str) -> tuple[list[float], list[tuple[int, str]], str]:
        """Numbers of a text; its hits as (end, term); the folded text."""
        folded = fold(text)
        hits: dict[int, tuple[float, str]] = {}
        spared: list[tuple[int, int]] = []
        if len(automaton):
            for end, (term, w) in automaton.iter(folded):
                if term is None:
                    spared.append((end - len(w) + 1, end))
                else:
                    at = end - len(term) + 1  # one hit a word: the heaviest
                    if at not in hits or (-w, term) < (-hits[at][0], hits[at][1]):
                        hits[at] = (w, term)
        if spared:
            hits = {at: h for at, h in hits.items() if not any(a <= at < b for a, b in spared)}
        total = sum(w for w, _ in hits.values())
        words = max(1, folded.count(" ") - 1)
        return [math.log1p(total), 100.0 * total / (words + 20), float(len({t for _, t in hits.values()}))], [(at, t) for at, (_, t) in hits.items()], folded

    def score(self, numbers: list[float]) -> float:
        if not self.model:
            return PRIOR
        z = self.model[0] + sum(a * b for a, b in zip(self.model[1:], numbers, strict=True))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-2) -> list[float]:
    x1 = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x1.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        h = (x1 * (p * (1 - p))[:, None]).T @ x1 + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x1.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def _texts(batch):
    return [(t or b"").decode("utf-8", "replace") for t in common.as_bytes(batch.column("text"))]


def learn(docs: DataFrame, labels: DataFrame, trainable: str = "true", max_labelled: int = MAX_LABELLED) -> Lexicon:
    """Lexicon, exceptions and logistic weights from labelled rows."""
    import pyarrow as pa

    spark = docs.sparkSession
    chosen = labels.where("doc_id is not null and toxic is not null").where(trainable).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    bounded = spark.createDataFrame(common.sample(chosen.select(F.col("doc_id").cast("long"), "toxic"), max_labelled, "doc_id").collect(), "doc_id long, toxic int")
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(bounded), "doc_id")
    sample = common.stored(own.groupBy("text").agg(F.max("toxic").alias("toxic")), "toxic-sample")

    def count(batches):
        seen = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(_texts(batch), batch.column("toxic").to_pylist(), strict=True):
                seen[toxic > 0].update(candidates(fold(text)))
                seen[toxic > 0][""] += 1
        terms = [*{*seen[0], *seen[1]}]
        for at in range(0, len(terms), 20_000):
            own = terms[at : at + 20_000]
            yield pa.RecordBatch.from_pydict({"term": own, "clean": [seen[0][t] for t in own], "toxic": [seen[1][t] for t in own]}, schema=pa.schema({"term": pa.string(), "clean": pa.int64(), "toxic": pa.int64()}))

    counts = common.stored(sample.mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("toxic > 1 or term = ''"), "toxic-terms")
    total = counts.where("term = ''").first()
    if not total or not total.toxic or not total.clean:
        return Lexicon({}, [], [])
    lift = (F.col("toxic") / total.toxic) / ((F.col("clean") + 1) / total.clean)
    found = counts.where("term != ''").where(F.col("toxic") >= max(6, SHARE * total.toxic)).withColumn("lift", lift).where(F.col("lift") >= LIFT).orderBy(F.desc("toxic"), F.desc("lift"), "term").collect()
    weights: dict[str, float] = {}
    covered: list[str] = []
    for r in found:  # a term that a kept word beginning covers adds nothing
        if any(r.term.startswith(k) for k in covered):
            continue
        # The longest term with nearly as many toxic rows stands for it: it hits fewer innocent words.
        best = max((x for x in found if x.term.startswith(r.term) and x.toxic >= 0.9 * r.toxic), key=lambda x: (len(x.term.rstrip()), not x.term.endswith(" ")))
        weights[best.term] = math.log(best.lift)
        covered.append(r.term.rstrip())
    lexicon = Lexicon(weights, [], [])

    def contexts(batches):
        a = lexicon.automaton()
        for batch in batches:
            rows = []
            for text, toxic in zip(_texts(batch), batch.column("toxic").to_pylist(), strict=True):
                numbers, hits, folded = lexicon.features(a, text)
                phrases = set()
                for at, _ in hits:
                    near = folded[max(0, at - 40) : at].split()[-1:], folded[at : at + 80].split()[:2]
                    phrases |= {" ".join([*near[0], *near[1][:1]]), " ".join(near[1])}
                rows.append((numbers, toxic, sorted(p for p in phrases if " " in p)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.float64())), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.string()))], names=["numbers", "toxic", "phrases"])

    phrases = sample.mapInArrow(contexts, "numbers array<double>, toxic int, phrases array<string>")
    by = phrases.select("toxic", F.explode("phrases").alias("phrase")).groupBy("phrase").agg(F.count_if(F.col("toxic") > 0).alias("bad"), F.count_if(F.col("toxic") <= 0).alias("good"))
    lexicon.exceptions = [r.phrase for r in by.where((F.col("good") >= 5) & (F.col("good") / total.clean >= F.col("bad") / total.toxic)).orderBy(F.desc("good"), "phrase").collect()]
    rows = sample.mapInArrow(contexts, "numbers array<double>, toxic int, phrases array<string>").select("numbers", "toxic").orderBy("toxic", "numbers").collect()
    lexicon.model = _logistic(np.array([r.numbers for r in rows]), np.array([r.toxic > 0 for r in rows], float))
    return lexicon


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The operator: doc_id, score, hits (number of lexicon hits after exceptions)."""

    def each(automaton, doc_id, text: bytes | None) -> tuple:
        numbers, hits, _ = lexicon.features(automaton, (text or b"").decode("utf-8", "replace"))
        return doc_id, lexicon.score(numbers), len(hits)

    return common.map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id long, score double, hits long", each, lexicon.automaton)
