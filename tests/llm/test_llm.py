"""The corpus operators against brute force, on rows with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigraph.llm import bpe, graph, induced, lines, media, mixing, ngram_join, pages, pii, quality, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, kept string"


def make(seed: int = 3, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefg", k=rng.randint(1, 6)))
    base = [" ".join(word() for _ in range(80)) for _ in range(4)]
    out = []
    for i in range(n):
        words = rng.choice(base).split() if i % 2 else [word() for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 4)):
            if words:
                words[rng.randrange(len(words))] = word()
        text = "".join(w + ("\n" if k % 9 == 8 else " ") for k, w in enumerate(words))
        out.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), len(text), 1, "x"))
    out += [(n, None, None, None, None, 1, "x"), (n + 1, "", "en", "a", 0, 1, "x"), (n + 2, "one Two", "en", "a", 7, 1, "x"), (n + 3, "ONE two", "en", "b", 7, 1, "x"), (n + 4, out[1][1], "en", "b", 1, 1, "x"), (n + 5, " \n\t", "en", "b", 3, 1, "x"), (n + 6, "é" * 3000, "fr", "c", 3000, 1, "x")]
    return out


ROWS = make()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def components_of(rows):
    sets = {}
    for d, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = frozenset([" ".join(w)] if 0 < len(w) < 5 else [" ".join(w[i : i + 5]) for i in range(len(w) - 4)])
    low = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and low[a] != low[b]:
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
    return {(d, len(s), low[d]) for d, s in sets.items()}


def test_ngram_join(docs, none):
    assert {tuple(r) for r in ngram_join.clusters(docs).collect()} == components_of([r[:2] for r in ROWS])
    assert ngram_join.clusters(none).count() == 0
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for _, _, c in components_of([r[:2] for r in ROWS])}


def test_ngram_join_in_blocks(spark, monkeypatch):
    """A large group of near copies, with the switches set so that hubs and blocks both work."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    for name, value in (("FEW", 0), ("MANY", 2), ("BLOCK", 16), ("ROUNDS", 1)):
        monkeypatch.setattr(ngram_join, name, value)
    got = ngram_join.clusters(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == components_of(rows)


@pytest.mark.parametrize("small", [0, 1000])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL", small)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7), (200, 100)]
    got = {tuple(r) for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got >= {(i, 0) for i in range(1, 41)} | {(101, 100), (200, 100)}


def test_one_of_each_picks_rows(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    rows = [(5, a, "x"), (5, a, "y"), (7, a + " z", "x"), (None, a, "x"), (5, b, "x"), (None, c, "x"), (None, c, "y"), (9, "", "x"), (9, "", "x"), (None, None, "x")]
    got = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in got) == sorted([("5", a), ("5", b), ("None", c), ("9", ""), ("9", ""), ("None", "")])


def test_line_dedup(spark, none):
    block = "a\nb\nc\nd"
    rows = [(1, block), (2, f"x\n{block}\ny"), (3, "a\nb"), (4, None), (5, ""), (6, "q\nq\nq\nq\nq"), (7, block), (1, block)]
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, gone string")
    got = [(r.doc_id, r.text) for r in lines.deduped(df).collect()]
    assert sorted(got, key=str) == sorted([(1, block), (1, block), (2, "x\ny"), (3, "a\nb"), (4, None), (5, ""), (6, "q"), (7, "")], key=str)
    assert {r.doc_id for r in lines.deduped(df, drop_emptied=True).collect()} == {1, 2, 3, 4, 5, 6}
    assert lines.deduped(none).count() == 0 and lines.report(none).count() == 0


def test_line_dedup_is_linear(spark):
    """Two copies of a text of many lines, and columns that clash."""
    long = "\n".join(f"line {i}" for i in range(60_000))
    df = spark.createDataFrame([(1, long, "a", 1), (2, long, "b", 2), (3, "x\n" + long, "c", 3)], "doc_id long, text string, id string, gone int")
    began = time.time()
    got = {r.doc_id: r for r in lines.report(df).collect()}
    assert time.time() - began < 40
    assert (got[1].n_removed, got[2].n_removed, got[3].n_removed) == (0, 60_000, 60_000) and got[3].kept_sha256 == hashlib.sha256(b"x").hexdigest()
    assert lines.deduped(df).columns == df.columns


def removed_by_force(rows):
    seen = Counter((t or "").encode()[i : i + 200] for _, t in rows for i in range(len((t or "").encode()) - 199))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup(docs, none):
    got = sorted((tuple(r) for r in suffix_dedup.report(docs).collect()), key=str)
    assert got == removed_by_force([r[:2] for r in ROWS]) and any(0 < r[2] < r[1] for r in got)
    assert suffix_dedup.report(none).count() == 0 and suffix_dedup.deduped(docs).columns == docs.columns


@pytest.mark.parametrize("letters", [b"ab", b"a", bytes(range(256)), b"\0\xff"])
def test_induced_sorting(letters):
    rng = random.Random(len(letters))
    for _ in range(40):
        members = [bytes(rng.choices(letters, k=rng.randint(0, 14))) for _ in range(rng.randint(1, 7))]
        members += [members[0] * 2, members[-1]]
        suffixes = sorted(((m[i:], k, i) for k, m in enumerate(members) for i in range(len(m))), key=lambda s: ([c + 1 for c in s[0]] + [0], s[1]))
        common = [0] + [next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b))) for (a, *_), (b, *_) in zip(suffixes, suffixes[1:], strict=False)]
        spilt = induced.Spool.spills
        budget = rng.choice([8, 1 << 20])
        owner, offset, shared = induced.suffix_array(members, budget=budget)  # a few bytes: queues, arrays and buckets go to disk
        assert list(zip(owner.tolist(), offset.tolist(), shared.tolist(), strict=True)) == [(k, i, c) for (_, k, i), c in zip(suffixes, common[: len(suffixes)], strict=True)]
        assert (induced.Spool.spills > spilt) == (budget == 8 and len(owner) > 0)


def test_induced_sorting_of_a_shard_above_its_budget():
    """Names repeat for several levels of the recursion, in ranges of many symbols, and all of it is on disk."""
    rng = random.Random(6)
    base = bytes(rng.choices(b"abcd", k=3000))
    members = [base[a : a + rng.randint(50, 700)] + bytes(rng.choices(b"abcd-", k=9)) for a in rng.choices(range(2500), k=60)] + [b"-" * 400, b"ab" * 200]
    spilt, found = induced.Spool.spills, {}
    for budget in (1 << 12, 1 << 30):
        found[budget] = [x.tolist() for x in induced.suffix_array(members, budget)]
    assert induced.Spool.spills - spilt > 50 and found[1 << 12] == found[1 << 30]
    owner, offset, shared = found[1 << 12]
    texts = [members[k][i:] for k, i in zip(owner, offset, strict=True)]
    assert texts == sorted(texts) and len(texts) == sum(map(len, members))
    for a, b, c in list(zip(texts, texts[1:], shared[1:], strict=False))[::7]:
        same = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        assert c == min(same, induced.CAP)


@pytest.mark.parametrize("switches", [{}, {"HELD": 20}, {"NAMED": 2000}, {"HOT": 1000}])
def test_suffix_dedup_of_hot_passages(spark, monkeypatch, switches):
    """Copies, shared passages in different surroundings and periodic texts, with each way of splitting them."""
    for name, value in switches.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 7)))
    base = " ".join(word() for _ in range(120))
    rows = [(i, " ".join(word() for _ in range(15)) + base[a : a + rng.randint(150, 400)] + " ".join(word() for _ in range(15))) for i, a in enumerate(rng.choices(range(400), k=25))]
    rows += [(50, base), (51, base), (51, base), (None, base + "!"), (52, "-" * 500 + "x"), (53, "y" + "-" * 450), (54, "ab" * 150), (55, "é" * 150 + base)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, `key` string, begins int")
    got = sorted((tuple(r) for r in suffix_dedup.report(df).collect()), key=str)
    assert got == removed_by_force(rows) and suffix_dedup.deduped(df).columns == df.columns and suffix_dedup.deduped(df).count() == len(rows)

def test_quality_counts(docs, none, spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, 1, None), (5, None, None)], "doc_id long, quality int, toxic int")
    for r in quality.judged(docs, labels).collect():
        t = next(x[1] for x in ROWS if x[0] == r.doc_id) or ""
        w = words(t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen, covered = Counter(grams), set()
        for i, g in enumerate(grams):
            covered |= {i, i + 1, i + 2} if seen[g] > 1 else set()
        full = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality.judged(none, labels).count() == 0 and quality.filtered(docs, labels).columns == docs.columns
    assert quality.filtered(docs, labels).count() == quality.judged(docs, labels).where("kept").count()


def test_thresholds_hold_their_risk():
    rng = np.random.default_rng(0)
    n = 6000
    x = rng.random((n, len(quality.FEATURES))) * 0.005
    good = rng.random(n) < 0.9
    x[~good, 0] += 0.5
    cuts = quality.cutoffs(["en"] * n, x, good, rng.random(n) < 0.5)
    fresh = rng.random((20000, len(quality.FEATURES))) * 0.005
    assert (fresh > cuts["en"]).any(axis=1).mean() <= quality.ALPHA and cuts["en"][0] < 0.1
    assert quality.cutoffs(["en"] * 40, x[:40], good[:40], np.arange(40) % 2 > 0) == {}  # too few for any proof
    assert abs(quality.binomial_tail(10, 2, 0.3) - 0.3827828) < 1e-6 and abs(quality.upper_bound(20, 0, 0.05) - (1 - 0.05 ** (1 / 20))) < 1e-6


def test_quality_cutoffs_end_to_end(spark):
    """Enough labels for a proof: junk of one kind is rejected beyond the base rule, a value at its cutoff isn't."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(3400):
        text = " ".join(word() for _ in range(60))
        bad = i % 17 == 0
        rows.append((i, text + " ###$$$" * 9 if bad else text, "en", i))
        labels.append((i, int(not bad)))
    rows += [(0, "another text under a labelled id " * 12, "en", 1), (9000, rows[1][1], "en", 1), (9001, rows[17][1], None, 1), (9002, ("word%d " * 60000) % (*range(60000),), "en", 1)]
    labels += [(9000, 0), (9003, 1)]  # equal texts with different labels count as good
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, features int")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    cuts = quality.learn(docs, known)
    assert set(cuts) == {"en"} and cuts == quality.learn(docs.repartition(5), known)
    top = cuts["en"]
    assert quality.FLOORS[0] <= top[0] < 0.1
    edge = (60, 300, 3, 0, 0, list(top))
    assert quality.verdict(edge, b"en", cuts) == (False, True) and quality.verdict((*edge[:5], [top[0] * 1.01, *top[1:]]), b"en", cuts) == (False, False)
    got = {(r.doc_id, r.n_words): r for r in quality.judged(docs, known).collect()}
    for d, text, lang, _ in rows:
        row = quality.measure(text.encode())
        r = got[d, row[0]]
        base = row[0] < 50 or 100 * row[4] > 50 * row[0]
        assert r.base_failed == base and r.kept == (not base and not (lang == "en" and any(x > y for x, y in zip(row[5], top, strict=True))))
    good = [d for d, x in labels[:3400] if x]
    assert sum(not got[d, 60].kept for d in good) <= quality.ALPHA * len(good) and all(not got[i, 69].kept for i in range(17, 3400, 17))
    assert got[9001, 69].kept and not got[9002, 60000].kept  # a stratum without labels has no cutoffs; the last has too many digits
    assert quality.filtered(docs, known).columns == docs.columns


def test_quality_learns_from_every_label(spark):
    """More labels than any bound that was: cutoffs equal those of all texts in memory, and so do the order statistics."""
    rng = random.Random(8)
    stock = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(500)]
    rows = [(i, " ".join(rng.choices(stock, k=50)) + f" W{i}" + "!#" * int(rng.expovariate(0.4)), rng.choice(["en", "en", "en", "de", None])) for i in range(24_000)]
    labels = [(d, int(rng.random() < 0.9)) for d, _, _ in rows]
    rows += [(d, t, lang) for d, (_, t, lang) in zip(range(30_000, 33_000), rows, strict=False)] + [(7, "a second text of one id " * 30, "en"), (8, rows[9][1], "de"), (None, rows[10][1] + "#" * 90, "en"), (33_000, " ".join(stock[:60]) + "#" * 90, "es")]
    labels += [(d, 1) for d in range(30_000, 31_000)] + [(33_000, 1), (40_000, 1), (None, 1), (11, None)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7), spark.createDataFrame(labels, "doc_id long, quality int")
    best, least, texts = {}, {}, {}
    for d, q in labels:
        if d is not None and q is not None:
            best[d] = max(q, best.get(d, 0))
    for r in docs.selectExpr("*", "xxhash64(text) as t", "pmod(xxhash64(xxhash64(text), 1L), 2) as half").collect():
        n, _, _, _, repeats, features = quality.measure(r.text.encode())
        if r.doc_id in best and n >= 50 and 100 * repeats <= 50 * n:
            least[r.doc_id] = min(least.get(r.doc_id, (1 << 63,)), (r.t, r.lang or "", r.half, features))
    for d, (t, lang, half, features) in least.items():
        texts[t, lang] = max(texts.get((t, lang), (0,)), (best[d], half, features))
    made = [(lang, *x) for (_, lang), x in texts.items()]
    want = quality.cutoffs([x[0] for x in made], np.array([x[3] for x in made]), np.array([x[1] == 1 for x in made]), np.array([x[2] == 1 for x in made]))
    assert len(made) > 23_000 and set(want) == {"", "de", "en"} and want["en"][0] > quality.FLOORS[0]
    assert quality.learn(docs, known) == want
    some = [(x[0], i, v) for x in made[:3000] for i, v in enumerate(x[3]) if i < 3]
    ranks = {("en", i): [0, 1, 7, 900, 10_000] for i in range(3)}
    got = quality.highest(spark.createDataFrame(some, "lang string, feature int, value double"), ranks, 5)
    down = {i: sorted((v for lang, j, v in some if lang == "en" and i == j), reverse=True) for i in range(3)}
    assert got == {("en", i, k): down[i][k] for i in range(3) for k in (0, 1, 7, 900)}


def test_toxicity(spark, none):
    rng = random.Random(2)
    w = lambda: "".join(rng.choices("mnopqrst", k=5))
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        text = [w() for _ in range(40)] + ([rng.choice(["idiot", "moron"]) for _ in range(3)] if toxic else ["glue", "sniffer"] if i % 7 == 0 else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = toxicity.learn(df, spark.createDataFrame(labels, "doc_id long, toxic int"), "doc_id % 3 != 0")
    extra = spark.createDataFrame([(1000, "you 1d10t, such an іdioт and m0ron m0ron"), (1001, None), (1002, ""), (1003, "nice words only")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.scored(df.unionByName(extra), lexicon).collect()}
    assert all((got[i].score >= 0.5) == bool(t) for i, t in labels if i % 3 == 0)
    assert got[1000].hits == 4 and got[1000].score >= 0.5 and got[1001].score == got[1002].score < 0.5 and got[1003].score < 0.5
    assert toxicity.learn(df, spark.createDataFrame([], "doc_id long, toxic int")).weights == {} and toxicity.scored(none, lexicon).count() == 0


def scored_by_force(lexicon, text):
    folded = toxicity.fold(text or "")
    hits, spared = {}, [i for x in lexicon.exceptions for i in range(len(folded)) if folded.startswith(f" {x} ", i)]
    for at in range(len(folded)):
        own = sorted((-w, t) for t, w in lexicon.weights.items() if folded.startswith(t, at))
        if own and not any(folded.startswith(f" {x} ", i) and i <= at < i + len(x) + 2 - 1 for i in spared for x in lexicon.exceptions):
            hits[at] = own[0]
    total = -sum(w for w, _ in hits.values())
    z = [math.log1p(total), 100 * total / (max(1, folded.count(" ") - 1) + 20), len({t for _, t in hits.values()})]
    return 1 / (1 + math.exp(-max(-30, min(30, lexicon.model[0] + sum(a * b for a, b in zip(lexicon.model[1:], z, strict=True)))))), len(hits)


def test_toxicity_scores_by_force(spark):
    lexicon = toxicity.Lexicon({" idio": 2.0, " idiot ": 3.0, " moron": 2.5, " mor": 2.5, " trash ": 1.0}, ["trash can", "no moron"], [-3.0, 1.5, 0.05, 0.3])
    rng = random.Random(3)
    words_ = ["idiot", "1d10t", "idiotic", "moron", "more", "trash", "can", "no", "100", "тrаsh", "TRASH,", "nice", "5", "mor0n$", "ｉｄｉｏｔ"]
    rows = [(i, " ".join(rng.choices(words_, k=rng.randint(0, 12)))) for i in range(300)] + [(400, None), (401, ""), (402, "trash trash can " * 30_000), (403, "100 5 7"), (403, "100 5 7"), (None, "idiot")]
    got = toxicity.scored(spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double"), lexicon).collect()
    want = Counter((d, round(x, 9), n) for d, t in rows for x, n in [scored_by_force(lexicon, t) if len(t or "") < 1000 else (toxicity.Lexicon.score(lexicon, lexicon.features(lexicon.automaton(), t)[0]), 30_000)])
    assert Counter((r.doc_id, round(r.score, 9), r.hits) for r in got) == want
    assert toxicity.fold("100 5 1d10t 3") == " idiot "


def test_toxicity_learns_a_text_once(spark):
    rows = [(i, f"word {'abcdefgh'[i % 8]}{'ijklm'[i // 8]} filler text here") for i in range(40)] + [(100, "moron moron text"), (101, "moron moron text"), (102, "moron moron text")] + [(200 + i, f"moron text number {'abcdefghij'[i]}") for i in range(10)]
    labels = [(i, 0) for i in range(40)] + [(100, 1), (101, 0), (102, 0)] + [(200 + i, 1) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    learnt = [toxicity.learn(df.repartition(n), spark.createDataFrame(labels, "doc_id long, toxic int").repartition(n)) for n in (1, 3)]
    assert learnt[0].weights == learnt[1].weights and learnt[0].model == learnt[1].model and any("moron".startswith(t.strip()) for t in learnt[0].weights)


def test_exceptions_take_hits_back():
    lexicon = toxicity.Lexicon({" trash": 3.0}, ["trash can"], [-2.0, 1.0, 0.1, 0.0])
    a = lexicon.automaton()
    assert len(lexicon.features(a, "the trash can of trash")[1]) == 1 and lexicon.features(a, "")[1] == []


def targets_by_force(size):
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, goal = 1.5 * sum(size.values()), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = [s for s in open_ if share[s] >= 2 * size[s]]
        goal |= {s: 2.0 * size[s] for s in full} if full else share
        left, open_ = left - sum(2 * size[s] for s in full), open_ - set(full) if full else set()
    return goal


def test_mixing(docs, none):
    rows = mixing.mixed(docs).collect()
    assert len(rows) == len(ROWS) and sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mixed(docs).collect()), key=str)
    text = {r[0]: (r[1], r[3]) for r in ROWS}
    size = Counter()
    for t, s in text.values():
        size[s] += len(words(t))
    goal = targets_by_force(size)
    taken = Counter()
    for r in rows:
        t, s = text[r.doc_id]
        assert r.size == len(words(t)) and r.source_size == size[s] and abs(r.target - goal[s]) < 1e-6 and r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    out = mixing.epochs(docs)
    assert out.columns == docs.columns and sum(len(words(r.text)) for r in out.collect()) == sum(taken.values())
    assert mixing.mixed(none).count() == 0


def test_mixing_repeated_rows_and_hot_sources(spark):
    rows = [(1, "a b c d", "s", 1, 1), (1, "a b c d", "s", 1, 1), (2, "e f", "s", 1, 1), (None, "g h i", None, 1, 1), (None, "g h i", None, 1, 1), (3, None, "s", 1, 1), (4, "", None, 1, 1), (5, " lead  and " + "long " * 60_000, "t", 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, `row` int, taken int")
    takes, out = mixing.mixed(df).collect(), mixing.epochs(df)
    assert out.columns == df.columns and Counter(r.source for r in out.collect()).keys() == {"s", "t", None}
    by = lambda rows_: {d: sum(n for e, n in rows_ if e == d) for d, _ in rows_}
    want = by([(r.doc_id, r.taken) for r in takes if r.taken])
    assert by([(r.doc_id, len(words(r.text))) for r in out.collect()]) == want
    assert all(any((r.text or "") == (t or "")[: len(r.text)] for _, t, *_ in rows) for r in out.collect())


def test_mixing_buckets_are_even(spark, monkeypatch):
    """Rows of equal and of mixed quality: no bucket of keys is much larger than the others."""
    monkeypatch.setattr(mixing, "BUCKET", 100)
    for text in ("a " * 10, "# " * 10, None):
        rows = [(i, text or ("a " if i % 3 else "# ") * 9 + str(i), "s") for i in range(4000)]
        keyed = mixing._keyed(spark.createDataFrame(rows, "doc_id long, text string, source string"), F.lit(None))
        level = Counter(r.level for r in keyed.collect())
        share = lambda key: sum(k * (1 - math.exp(-math.exp(q) * key)) for q, k in level.items()) / 4000
        sizes = Counter(int(share(r.key) * 40) for r in keyed.collect())
        assert max(sizes.values()) < 200


def test_bpe(docs, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    codec = bpe.Codec(bpe.Codec.load(bpe.default_path()))
    for t in ["", " ", "It's we'LL don'T stop123", "a<|endoftext|>b", "ΑΣ Σ", "İI", "é é 日本語", "\x85a\x1c\x1db", "x" * 3000, *[r[1] or "" for r in ROWS]]:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == ids and codec.encode_decode(t)[1] == lib.decode(ids, skip_special_tokens=False) == codec.decode(ids)
    got = {r.doc_id: r for r in bpe.digests(docs).collect()}
    assert all(got[r[0]].n_tokens == len(lib.encode(r[1] or "", add_special_tokens=False).ids) for r in ROWS) and bpe.encoded(none).count() == 0


def test_bpe_repairs_proposals_by_verdicts(monkeypatch):
    """Words are merged exactly for verdicts on tokens and pairs alone, also where the longest tokens aren't right."""
    from tokenizers import Tokenizer

    lib, rng, calls = Tokenizer.from_file(bpe.default_path()), random.Random(7), []
    codec, merge = bpe.Codec(bpe.Codec.load(bpe.default_path())), bpe.Codec.merge
    monkeypatch.setattr(bpe.Codec, "merge", lambda self, symbols: calls.append(0) or merge(self, symbols))
    syllables = ["th", "er", "on", "in", "ein", "ver", "sch", "é", "ción", "qu", "ou", "ß"]
    texts = [" ".join("".join(rng.choices(syllables, k=rng.randrange(2, 7))) for _ in range(40)) for _ in range(200)]
    texts += ["a<|endoftext|>B<|ENDOFTEXT|>", "<|startoftext|><|endoftext|>\x1c Σ", "\x1c<|endoftext|>", "ab" * 5000 + "the" * 3000, "\x00</w>w</w>", "e\u0301'LL \u0301x"]
    for t, (ids, decoded) in zip(texts, codec.batch(texts), strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want and decoded == lib.decode(want, skip_special_tokens=False)
    assert len(calls) <= len(codec.pairs) + len(codec.single)
    monkeypatch.setattr(bpe, "MEMORY", 0)  # what was learnt is forgotten between batches
    assert [x.tolist() for x, _ in codec.batch(texts[:9])] == [lib.encode(t, add_special_tokens=False).ids for t in texts[:9]]


def test_pages(spark):
    page = '<html><body><header class="top"><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><div class="wrap"><aside>Side</aside><div class="post-content"><h2>Title &eacute;</h2><p>First   para<br>line <a href=x>link</a>.<ul><li>one<li>two</ul></div><section id="comments"><p>nice!</p></section></div><form><label>Mail</label></form><footer>f</footer><script>if(a<b){x="</p>"}</script></body></html>'
    other = '<html><body><nav><a>m</a></nav><article><h1>T%d</h1><p title="a>b">Body %d &amp; more</p></article><div class="ad">Buy</div></body></html>'
    rows = [(i, f"http://h.example/{i}", other % (i, i)) for i in range(5)] + [(9, None, page), (10, "http://h.example/x", None), (11, "http://x.example", ""), (12, "http://x.example", "just text")]
    got = {r.page_id: r.text for r in pages.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "T3\n\nBody 3 & more" and got[9] == "Title é\n\nFirst para line link.\n\none\n\ntwo" and got[10] == got[11] == "" and got[12] == "just text"
    assert pages.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_keep_text_beside_a_larger_part(spark):
    parts = '<html><body><div id=c><div class=intro><p>{0} intro</p></div><div class=rest><p>{0} {1}</p></div></div></body></html>'
    two = "<html><body><article><p>short</p></article><article><p>a much longer second one</p></article></body></html>"
    late = "<html><body><div class=rest><p>{0} long enough</p></div></body>\ntail {0}</html>"
    rows = [(i, "http://h.example", parts.format(i, "rest " * 9)) for i in range(4)] + [(8, "http://two.example", two)] + [(10 + i, "http://late.example", late.format(i)) for i in range(3)]
    got = {r.page_id: r.text for r in pages.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"{i} intro\n\n{i} " + " ".join(["rest"] * 9) for i in range(4))
    assert got[8] == "short\n\na much longer second one" and all(got[10 + i] == f"{i} long enough\n\ntail {i}" for i in range(3))


CHROME = '<html><body><div class=x1><ul><li>Home</li><li>About us</li></ul></div><div class=x2><p>Best site of the web the best</p></div><div class=x3>{0}</div><div class=x4><p>All rights are ours</p><p>write to us</p></div></body></html>'
CHROME_2 = '<html><body><div class=top>Menu of things</div><div class=mid><h2>{1}</h2>{0}</div><div class=end>End of page</div></body></html>'


def site(spark):
    """Three hosts: chrome without telling names, copies of one page, too few pages; and what doesn't fit any."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    rows, want = [], {}
    for i in range(24):
        paras = [" ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 5))]
        extra = "<div class=discussion><p>we discuss " + paras[0] + "</p></div>" if i % 2 else ""
        kept = ["we discuss " + paras[0]] if i % 2 else []
        if i < 14:
            rows.append((i, f"http://a.example/{i}", CHROME.format("".join(f"<p>{x}</p>" for x in paras) + extra)))
            want[i] = "\n\n".join([*paras, *kept])
        else:
            title = word()
            rows.append((i, f"https://B.example/{i}", CHROME_2.format("".join(f"<p class=related-work>{x}</p>" for x in paras), title)))
            want[i] = "\n\n".join([title, *paras])
    copy = "<html><body><div><p>the same text here</p><p>and more of it</p></div></body></html>"
    rows += [(100 + i, "http://copies.example/", copy) for i in range(12)]
    want |= {100 + i: "the same text here\n\nand more of it" for i in range(12)}
    rows += [(200, "http://few.example/", CHROME.format("<p>one</p>")), (201, None, "<p>" + "long words " * 50_000), (202, "http://few.example/", None), (203, "nothing", "")]
    want |= {200: "Home\n\nAbout us\n\nBest site of the web the best\n\none\n\nAll rights are ours\n\nwrite to us", 201: ("long words " * 50_000).strip(), 202: "", 203: ""}
    rows.append(rows[0])  # a repeated row
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, salt int"), want


def classes_by_force(rows):
    """host to the template's words: those whose pages are just the pages of their block."""
    by_host = {}
    for n, (_, url, page) in enumerate(rows):
        m = re.match("[a-zA-Z]+://([^/]*)", url or "")
        by_host.setdefault(m[1].lower() if m else "", []).append((n, page or ""))
    out = {}
    for host, own in by_host.items():
        known = pages._Hashes()
        roles, tokens, text, held = {}, {}, 0, {}
        for n, page in own:
            for b in pages.blocks(page, known):
                inside = roles.setdefault(b.role, [set(), b.inside])[0]
                inside.add(n)
                text += len(b.text)
                for t in set(pages.word_tokens(b, known).tolist()):
                    tokens.setdefault(t, (b.role, set()))[1].add(n)
        fixed = {t for t, (r, at) in tokens.items() if at == roles[r][0] and len(at) >= (pages.FIRM if roles[r][1] else pages.SUPPORT)}
        if fixed:
            out[host] = fixed
    return out


@pytest.mark.parametrize("switches", [{}, {"LOCAL": 10**6, "CHUNK": 2}, {"LOCAL": 1, "REACH": 3000}])
def test_pages_deduce_templates(spark, monkeypatch, switches):
    for name, value in switches.items():
        monkeypatch.setattr(pages, name, value)
    df, want = site(spark)
    got = pages.extracted(df).collect()
    assert len(got) == len(want) + 1 and {r.page_id: r.text for r in got} == want
    rows = [tuple(r)[:3] for r in df.collect()]
    force = classes_by_force(rows)
    found = {r.host: set(r.words) for r in pages.templates(df).collect() if r.words}
    assert set(found) == {"a.example", "b.example"} and "copies.example" in force and all(found[h] == force[h] for h in found)


def test_pages_rule_out_by_whole_names():
    text = lambda inner: pages.extract(f"<body><article><p>keep</p>{inner}</article></body>")
    for name in ("discussion", "related-work", "article-header", "share", "search-results", "side-effects", "notices-of-death"):
        assert text(f'<div class="{name}"><p>more</p></div>') == "keep\n\nmore", name
    for name in ("comments", "comment-list", "cookie-notice", "ad", "site-nav", "sidebar"):
        assert text(f'<div class="{name}"><p>more</p></div>') == "keep", name
    assert text("<p>x <math><mi>y</mi></math> z</p><textarea>t</textarea><svg><text>s</text></svg>") == "keep\n\nx y z\n\ns"


def test_media(docs, none, spark):
    got = {r.doc_id: r for r in media.described(docs).collect()}
    for d, t, *_ in ROWS:
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64) or bytes(64)
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        m = media.to_png(p)
        assert (r.media_bytes, r.media_sha256) == (len(m), hashlib.sha256(m).hexdigest()) and media.from_png(m) == p
    assert media.described(none).count() == 0
    manifest = media.write_archives(docs.repartition(3))
    small = media.read_archives(spark, manifest, range_bytes="500")
    assert small.count() == len(ROWS) and small.select(F.sum("n_bytes")).first()[0] == sum(len((r[1] or "").encode()) for r in ROWS)


def test_a_damaged_member_fails_alone(docs, spark):
    manifest = media.write_archives(docs.coalesce(1))
    path = spark.read.parquet(manifest).first().path.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[media._HEADER.size + 20] ^= 255
    open(path, "wb").write(bytes(data))
    rows = media.read_archives(spark, manifest, on_error="row").collect()
    assert sum(r.error is not None for r in rows) == 1 and len(rows) == len(ROWS)
    with pytest.raises(Exception, match="damaged"):
        media.read_archives(spark, manifest).collect()


def test_pii_patterns():
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda s: re.sub("[^0-9]", "", s)
    ok = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 16 <= len(digits(s)) <= 19 and pii._luhn(digits(s)), "phone": lambda s: 8 <= len(digits(s)) <= 15}
    rng = random.Random(4)
    texts = ["".join(rng.choices("a.@-+1 05(2%)9é", k=rng.randint(0, 60))) for _ in range(5000)] + ["4111 1111 1111 1111", "me@x.example.com", "1.2.3.4.5.6.7.8", "+1 (980) 555-6268"]
    for t in texts:
        assert pii.patterns(t) == {k: [m.span() for m in re.finditer(p, t) if ok[k](m[0])] for k, p in rules.items()}, t


@pytest.fixture(scope="module")
def tagger(docs):
    return pii.fitted(pii.pieces(docs), 2500)


def test_pii_model(docs, none, tagger):
    model = pii.Tagger()
    for k in model.w:
        model.w[k] = model.w[k].astype(np.float64)
    x, y = pii.examples(["hello world this is text"], 4)
    x, y = x[:, :8], y[:, :8]
    _, grads = model.loss(x, y)
    for k, w in model.w.items():
        at = np.unravel_index(np.argmax(np.abs(grads[k])), w.shape)
        w[at] += 1e-4
        up = model.loss(x, y)[0]
        w[at] -= 2e-4
        down = model.loss(x, y)[0]
        w[at] += 1e-4
        assert abs((up - down) / 2e-4 - grads[k][at]) < 1e-4
    again = [pii.fitted(pii.pieces(docs), 60).w["o"] for _ in range(2)]
    assert np.array_equal(*again)
    trained = tagger
    xs, _ = pii.examples([r[1] for r in ROWS if r[1]], 40, seed=77)
    slow = np.stack([np.concatenate([model._run(x[:, None], False)[0], model._run(x[:, None], True)[0]], axis=2)[:, 0] @ model.w["o"] + model.w["b"] for x in xs])
    assert np.abs(slow - model.scores(xs)).max() < 1e-4
    right, found_all, held_all = score(trained, [r[1] for r in ROWS if r[1]], seed=77)
    assert right >= 0.9 * found_all and right >= 0.9 * held_all  # held-out spans, by their exact bounds
    text = "call (980) 555-6268 or 4111111111111111 " + "x" * 500 + " the end"
    found = pii.spans(trained, [text, "", "no digits here"])
    assert ("card", 23, 39) in found[0] and found[1] == found[2] == []
    rows = pii.digests(pii.detected(docs, trained))
    assert rows.count() == len(ROWS) and pii.detected(none, trained).count() == 0


def score(model, backgrounds, seed):
    """Personal data set into held-out texts: (found by exact bounds, found in all, set in)."""
    rng = np.random.default_rng(seed)
    texts, held = [], []
    for b in backgrounds * 3:
        text, own = "", set()
        for _ in range(5):
            text += pii._SUSPECT.sub(" ", b)[: int(rng.integers(5, 60))] + " "
            before, said, after = pii._made(rng)
            text += before
            own |= {(len(text), len(text) + len(said))} if said else set()
            text += said + after + " "
        texts.append(text)
        held.append(own)
    found = [set(x) for x in pii.added(model, texts)]
    return sum(len(a & b) for a, b in zip(found, held, strict=True)), sum(map(len, found)), sum(map(len, held))


def test_pii_model_reads_text_without_digits(docs, tagger):
    model = pii.Tagger()
    rng = np.random.default_rng(5)
    scores = [rng.standard_normal((n, 3)).astype(np.float32) * 3 for n in (1, 2, 127, 128, 129, 700)]
    model.w["t"] = rng.standard_normal((3, 3)).astype(np.float32)
    assert all(np.array_equal(a, model.viterbi(e)) for a, e in zip(pii._decode(model, scores), scores, strict=True))
    lead = "abc fed cab " * 3000
    said = lead + "jane (at) example dot com " + "abc fed cab " * 30 + "Licensed 2.0. or version 4.0. of"
    found = pii.spans(tagger, [said])[0]
    assert ("other", len(lead), len(lead) + 25) in found  # far beyond any prefix, by its exact bounds
    assert not any(a < said.index(v) + 4 and said.index(v) < b for _, a, b in found for v in ("2.0.", "4.0."))


def deduped_by_force(rows):
    """Line dedup, then one of each group of near copies, of rows (doc_id, text, source)."""
    seen, left = set(), []
    for d, t, source in sorted(rows, key=lambda r: r[0]):
        xs, gone = t.split("\n"), set()
        for i in range(len(xs) - 2):
            w = tuple(xs[i : i + 3])
            gone |= {i, i + 1, i + 2} if w in seen else set()
            seen.add(w)
        if len(gone) < len(xs):
            left.append((d, "\n".join(x for i, x in enumerate(xs) if i not in gone), source))
    first = {d: c for d, _, c in components_of([(d, t) for d, t, _ in left])}
    return [r for r in left if first[r[0]] == r[0]]


def test_pipeline(spark, tmp_path):
    """Against a plain pipeline: which documents stay, their whole epochs, the prefix taken of the last, and every token."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    rng = random.Random(9)
    line = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(12))
    long = ["\n".join(line() for _ in range(8)) for _ in range(20)]
    rows = [(i, t, "en", "st"[i % 2], len(t)) for i, t in enumerate(long)] + [(20, long[0], "en", "s", 1), (21, long[1].replace("\n", " ") + " x y", "en", "t", 1), (22, "short", "en", "t", 5), (23, None, None, None, None), (24, "\n".join([line(), *long[3].split("\n")[2:6], *[line() for _ in range(5)]]), None, None, 3)]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, `row` string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = deduped_by_force([(d, t, s) for d, t, _, s, _ in rows if len(words(t)) >= 50])
    assert {d for d, *_ in kept} == {*range(20), 24}
    size = Counter()
    for _, t, s in kept:
        size[s] += len(words(t))
    goal = targets_by_force(size)
    lib = Tokenizer.from_file(bpe.default_path())
    ids = lambda t: lib.encode(t, add_special_tokens=False).ids
    out, taken = corpus_pipeline.run(spark, str(tmp_path)).collect(), Counter()
    assert {r.doc_id for r in out} == {d for d, *_ in kept} and len(corpus_pipeline.STAGES) == 5
    for d, t, s in kept:
        own = sorted((r for r in out if r.doc_id == d), key=lambda r: r.n_tokens)
        full = [r for r in own if r.ids == ids(t)]
        assert int(goal[s] // size[s]) <= len(full) and len(own) - len(full) <= 1
        taken[s] += len(full) * len(words(t))
        for r in own:
            assert r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(lib.decode(r.ids, skip_special_tokens=False).encode()).hexdigest()
            if r not in full:
                ends = [m.end() for m in re.finditer("[^\x20\x09-\x0d]+", t)]
                taken[s] += next(k for k, e in enumerate(ends, 1) if ids(t[:e]) == r.ids)
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)


def test_pipeline_of_nothing(spark, tmp_path, none):
    import corpus_pipeline

    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
