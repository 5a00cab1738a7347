"""The query language and BM25 against SQLite's full-text index."""

import random
import sqlite3

import pytest

from lexigraph.operators import index, keyword
from lexigraph.plans import match

WORDS = "alpha beta gamma delta running runs élan hooks hook title".split()
QUERIES = ["alpha beta", "alpha OR gamma", "alpha beta OR gamma", "alpha NOT beta", "alpha NOT beta gamma", '"alpha beta"', "alpha + beta", "run*", "title:alpha", "^alpha", "NEAR(alpha beta, 2)", "NEAR(alpha beta)", "NEAR(alpha beta gamma, 3)", "(alpha OR beta) AND gamma", "{title source_path}:hook", "- content : delta", "elan", "alpha OR (beta NOT gamma)"]
BAD = ["how to use it?", "next.js", "a-b", "c++", "", "what's", "foo AND", "(a OR b) c", "-a"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [(i, "/a/b", "latest", " ".join(rng.choices(WORDS, k=rng.randint(1, 4))), " ".join(rng.choices(WORDS, k=rng.randint(0, 25))), f"docs/{rng.choice(WORDS)}.md") for i in range(1, 121)]


@pytest.mark.parametrize("profile,tokenizer", [("plain", "unicode61"), ("porter", "porter unicode61")])
def test_ranks_equal_sqlite(spark, rows, profile, tokenizer):
    db = sqlite3.connect(":memory:")
    db.execute(f"create virtual table f using fts5(title, content, source_path, tokenize='{tokenizer}')")
    db.executemany("insert into f(rowid, title, content, source_path) values (?, ?, ?, ?)", [(r[0], *r[3:]) for r in rows])
    df = spark.createDataFrame(rows, "id long, library_id string, library_version string, title string, content string, source_path string")
    postings, stats = index.postings(df, profile).cache(), index.doc_stats(df).cache()
    for q in QUERIES:
        want = dict(db.execute("select rowid, rank from f where f match ?", (q,)).fetchall())
        got = {r.snippet_id: r["rank"] for r in keyword.ranked(postings, stats, q, profile).collect()}
        assert set(want) == set(got), q
        assert all(abs(want[i] - got[i]) < 1e-9 for i in want), q


@pytest.mark.parametrize("q", BAD)
def test_what_is_no_query(q):
    with pytest.raises(match.QuerySyntaxError):
        match.parse(q)


def test_sanitized_text_is_a_query():
    assert match.leaves(match.parse(match.sanitized("What's next.js?")))


def test_stemmer_equals_sqlite():
    from lexigraph.functions.porter import stem

    rng = random.Random(1)
    words = sorted({"".join(rng.choices("abeiostlyngd", k=rng.randint(1, 9))) + rng.choice(["", "ing", "ed", "ation", "iveness", "ies", "eed", "ll", "e", "ement", "ion", "logi", "bli", "al", "ful", "y"]) for _ in range(4000)} | {"a" * n + "ing" for n in range(55, 70)} | {"ies", "sses", "eed", "sky", "hopping"})
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    db.execute("create virtual table v using fts5vocab(t, instance)")
    db.executemany("insert into t(rowid, x) values (?, ?)", enumerate(words))
    assert not [(words[d], s, stem(words[d])) for s, d in db.execute("select term, doc from v") if stem(words[d]) != s]


def test_stems_are_made_without_a_shuffle(spark, rows):
    """Each occurrence has its own stem, in its place; no token goes through a shuffle or a join for it."""
    from lexigraph.functions.porter import stem

    texts = [*rows, (121, "/a/b", "latest", None, "", "x.md"), (122, "/a/b", "v1", "running", "hopping " * 5000, "hoping.md")]
    df = spark.createDataFrame(texts, "id long, library_id string, library_version string, title string, content string, source_path string").coalesce(1)
    got = index.postings(df, "porter")
    want = [(*r[:-1], stem(r.term)) for r in index.postings(df).collect()]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
