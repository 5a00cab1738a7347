"""Behaviours of the retrieval engine on small fixtures."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigraph.functions import text as T
from lexigraph.functions import vectors as V
from lexigraph.operators import catalog, chunking, hybrid, keyword, parsing, providers, render, semantic
from lexigraph.operators.store import Store
from lexigraph.plans import dispatch
from lexigraph.sources import config, docs, presets

LIBRARIES = [
    ("/orbit/kiln", "latest", "Kiln.rs", "d", 120, 9.0, 91.0, 1), ("/orbit/kiln", "v3.1", "Kiln 3.1", "d", 110, 9.0, 91.0, 2), ("/harbor/sail", "latest", "Sail", "d", 640, 9.8, 97.0, 3),
    ("/quarry/slate", "latest", "Slate", "d", 75, 6.5, 80.0, 4), ("/meadow/barn", "latest", "Barn", "d", 40, 5.0, 60.0, 5),
]
SNIPPETS = [
    (1, "/harbor/sail", "latest", "hoistMast Rope", "The hoistMast rope raises a mast in windy weather", "docs/ropes.md", "", 50, "Ropes > Mast", [1.0, 0.0, 0.0]),
    (2, "/harbor/sail", "latest", "lowerMast Rope", "The lowerMast rope lets you undo knots in windy weather", "docs/ropes.md", "", 60, "Ropes > Lowering", [0.9, 0.1, 0.0]),
    (3, "/harbor/sail", "latest", "Weather Basics", "Sail weather is made of wind and water", "docs/weather.md", "", 40, "Weather > Basics", [0.0, 1.0, 0.0]),
    (4, "/harbor/sail", "latest", "Flags Introduction", "Flags are a kind of signal", "docs/flags.md", "", 40, "Flags", [0.0, 0.0, 1.0]),
    (5, "/harbor/sail", "latest", "Without Vector", "Empty here", "docs/none.md", "", 40, "", None),
    (6, "/meadow/barn", "latest", "Barn Doors", "How to open barn doors", "docs/doors.md", "", 70, "Doors", [1.0, 0.0, 0.0]),
]
SAIL = {"library_id": "/harbor/sail", "version": "latest"}


@pytest.fixture(scope="module")
def libraries(spark):
    return spark.createDataFrame(LIBRARIES, "id string, version string, title string, description string, total_snippets long, trust_score double, benchmark_score double, ingest_seq long")


@pytest.fixture(scope="module")
def snippets(spark):
    return spark.createDataFrame(SNIPPETS, "id long, library_id string, library_version string, title string, content string, source_path string, language string, token_count int, breadcrumb string, embedding array<float>")


def ids(df):
    return [r.id for r in df.collect()]


def test_catalog(libraries):
    assert ids(catalog.search(libraries, "SAIL")) == ["/harbor/sail"]
    assert len(ids(catalog.search(libraries, "kiln"))) == 2
    assert ids(catalog.search(libraries, "100%", escape=True)) == []
    assert catalog.resolve(libraries, "/orbit/kiln") == ("/orbit/kiln", "v3.1")
    assert catalog.resolve(libraries, "/a/b/v1") == ("/a/b", "v1")
    assert catalog.resolve(libraries, "/a/b") == ("/a/b", "latest")
    assert dispatch.query_docs(libraries, libraries, "x", "/only").startswith("Invalid library ID format")
    text = dispatch.resolve_library_id(libraries, "kiln")
    assert "- Versions: latest, v3.1" in text and "- Benchmark Score: 91\n" in text
    assert dispatch.resolve_library_id(libraries, "nothing") == render.NO_LIBRARIES


def test_keyword(snippets):
    assert ids(keyword.search(snippets, "hoistMast rope", **SAIL)) == [1]
    assert ids(keyword.search(snippets, "doors", **SAIL)) == []
    assert ids(keyword.search(snippets, "What's a rope?", sanitize=True, **SAIL)) == []
    assert ids(keyword.search(snippets, "rope", limit=1, **SAIL)) == [1]


def test_written_index_gives_the_same(spark, snippets, tmp_path):
    from lexigraph.operators import index

    index.write(snippets, str(tmp_path))
    a = keyword.search(snippets, "rope OR weather", **SAIL)
    b = keyword.search(snippets, "rope OR weather", index_path=str(tmp_path), **SAIL)
    assert [(r.id, round(r["rank"], 9)) for r in a.collect()] == [(r.id, round(r["rank"], 9)) for r in b.collect()]


def test_semantic(snippets):
    assert ids(semantic.search(snippets, [1.0, 0.0, 0.0], limit=2, **SAIL)) == [1, 2]
    assert ids(semantic.search(snippets, [0.0, 0.0, 1.0], limit=1, mode="exact", **SAIL)) == [4]
    assert "embedding" not in semantic.search(snippets, [1.0, 0.0, 0.0]).columns
    assert ids(semantic.search(snippets, [0.0, 0.0, 0.0])) == []
    assert ids(semantic.search(snippets, [1.0, 0.0])) == []  # another size scores null
    assert V.bands_of([0.5, 0.0, 1.0]) == [65535] * 4 and V.bands_of([]) is None


def test_semantic_batch_of_a_table(spark, snippets):
    asked = spark.createDataFrame([(q, [float(q % 7), 1.0, float(q % 3)]) for q in range(300)] + [(300, [0.0, 0.0, 0.0]), (301, None), (302, [1.0, 0.0])], "query_id long, embedding array<float>")
    got = {}
    for r in semantic.batch(snippets, asked, 3).collect():
        got.setdefault(r.query_id, []).append((r.place, r.id, round(r.score, 9)))
    assert sorted(got) == list(range(300))
    for q in (0, 1, 8, 299):
        want = semantic.scores(snippets, [float(q % 7), 1.0, float(q % 3)], limit=3, mode="exact").collect()
        assert sorted(got[q]) == [(i + 1, r.id, round(r.score, 9)) for i, r in enumerate(want)]


def test_semantic_batch_queries_grow_with_the_table(spark):
    from lexigraph import queries

    got = queries.QUERIES["semantic_batch_topk"](spark, "/root/testdata/sf0.01").collect()
    assert {r.query_id for r in got} == {0, 100, 200, 300, 400} and len(got) == 25


def test_hybrid(snippets):
    found = hybrid.search(snippets, "rope", [1.0, 0.0, 0.0], **SAIL).collect()
    assert found[0].id == 1 and len({r.id for r in found}) == len(found) and all(0 <= r.score <= 1 for r in found)
    assert ids(hybrid.search(snippets, "nothing", [0.0, 0.0, 1.0], limit=1, **SAIL)) == [4]
    assert set(ids(hybrid.search(snippets, "rope", None, **SAIL))) == {1, 2}


def test_vector_only_scores_all_rows(spark, tmp_path):
    """A row that shares a band with the query doesn't keep the others from being scored."""
    from lexigraph import queries

    asked = [float((i * 37) % 11 - 5) or 1.0 for i in range(64)]
    vectors = [(7, asked), (1, [-x for x in asked])] + [(i, [-x * (1 if (k + i) % 9 else -0.5) for k, x in enumerate(asked)]) for i in range(10, 40)]
    spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(i, "src1", "en", "plain words", 11) for i, _ in vectors], "doc_id long, source string, lang string, text string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    want = sorted(((-round(cosine([-x for x in asked], v), 9), i) for i, v in vectors))[:20]
    assert ids(queries.QUERIES["hybrid_vector_only"](spark, str(tmp_path))) == [i for _, i in want]


def test_all_candidates_are_scored(spark):
    """Above the former cut (the first 20,000 candidates by id, in 100 * 200), the best candidate still counts."""
    near = spark.range(21_000).select("id", F.lit("/a/b").alias("library_id"), F.lit("v").alias("library_version"), F.lit("t").alias("title"), F.lit("words").alias("content"), F.lit("p").alias("source_path"), F.when(F.col("id") == 20_999, F.array(F.lit(1.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.25))).alias("embedding"))
    assert ids(hybrid.fused(near, "nothing", [1.0, 1.0], limit=2)) == [20_999, 0]
    assert ids(semantic.scores(near, [1.0, 1.0], limit=2)) == [20_999, 0]
    again = near.unionByName(near.where("id = 20999"))
    assert ids(semantic.scores(again, [1.0, 1.0], limit=3)) == [20_999, 20_999, 0]


def test_batches_give_what_single_queries_give(snippets):
    texts = {3: "rope OR weather", 4: "NEAR(undo knots, 3) OR signal", 5: "weather NOT rope", 6: "nothing"}
    for options in ({}, SAIL):
        got = {}
        for r in keyword.batch(snippets, texts, limit=2, **options).collect():
            got.setdefault(r.query_id, []).append((r.place, r.id, round(r["rank"], 9)))
        for q, text in texts.items():
            assert sorted(got.get(q, [])) == [(i + 1, r.id, round(r["rank"], 9)) for i, r in enumerate(keyword.search(snippets, text, limit=2, **options).collect())]
    asked = {1: ("rope", [1.0, 0.0, 0.0]), 2: ("nothing", [0.0, 0.0, 1.0]), 3: ("rope OR weather", None), 4: ("flags", [0.0, 0.0, 0.0])}
    for mode in ("lsh", "exact"):
        got = {}
        for r in hybrid.batch(snippets, asked, limit=3, mode=mode, **SAIL).collect():
            got.setdefault(r.query_id, []).append((r.place, r.id, round(r.score, 9)))
        for q, (text, vector) in asked.items():
            assert sorted(got.get(q, [])) == [(i + 1, r.id, round(r.score, 9)) for i, r in enumerate(hybrid.fused(snippets, text, vector, limit=3, mode=mode, **SAIL).collect())]


def test_dispatch(snippets, libraries):
    text = dispatch.query_docs(snippets, libraries, "hoistMast", "/harbor/sail", mode="keyword")
    assert text.startswith("## hoistMast Rope\n**Breadcrumb:** Ropes > Mast\n**Source:** docs/ropes.md\nThe hoistMast")
    assert dispatch.query_docs(snippets, libraries, "zzz", "/harbor/sail", mode="keyword") == render.NO_SNIPPETS
    fake = type("E", (), {"embed": lambda self, t: [[1.0, 0.0, 0.0]]})()
    got = dispatch.rows(snippets, "mast", "/harbor/sail", "latest", "hybrid", 3, fake, providers.OverlapReranker(), True)
    assert got.first().id == 1
    with pytest.raises(Exception, match="syntax error"):
        dispatch.query_docs(snippets, libraries, "how?", "/harbor/sail", mode="hybrid")


def test_rerank(snippets):
    assert [r.rerank_score for r in providers.noop_rerank(snippets, ["id"], 3).collect()] == [1.0, 0.99, 0.98]


def _sections(spark, rows):
    return spark.createDataFrame([(rows,)], "sections array<struct<heading: string, depth: int, content: string, code_blocks: array<struct<language: string, value: string>>>>")


def test_chunker(spark):
    got = chunking.chunked(_sections(spark, [("Docs", 1, "a", []), ("Empty", 2, " ", []), ("Routing", 2, "b", [("typescript", "x")]), (None, 0, "c", []), ("Deep", 4, "a" * 100, [])])).collect()
    assert [r.breadcrumb for r in got] == ["Docs", "Docs > Routing", "Docs > Routing", "Docs > Routing > Deep"]
    assert got[1].language == "typescript" and got[2].title == "" and got[3].token_count == 25
    got = chunking.chunked(_sections(spark, [("H", 1, "\n\n".join(["p" * 90] * 50), [])]), most=500).collect()
    assert len(got) > 1 and all(len(r.content) <= 500 for r in got)
    assert [len(r.content) for r in chunking.chunked(_sections(spark, [("H", 1, "a" * 2000, [])]), most=1000).collect()] == [1000]
    assert [len(r.content) for r in chunking.chunked(_sections(spark, [("H", 1, "a" * 2000, [])]), most=1000, keep_tail=True).collect()] == [1000, 1000]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text("ab \n", max_size=40), max_size=8), st.integers(3, 30))
def test_packing_keeps_order_and_size(spark, paragraphs, most):
    text = "\n\n".join(paragraphs)
    got = spark.createDataFrame([(text,)], "t string").select(chunking.packed(F.col("t"), most)).first()[0]
    now, want = "", []
    for p in text.split("\n\n"):
        if len(p) > most:
            want += ([now] if now else []) + [p[:most]]
            now = ""
        elif len(now) + len(p) + 2 <= most:
            now = f"{now}\n\n{p}" if now else p
        else:
            want += [now] if now else []
            now = p
    assert got == want + ([now] if now else []) and all(len(c) <= most for c in got)


def test_markdown():
    one = parsing.markdown("---\ntitle: x\n---\n# Hello World\n\nText *em* `code` <Button variant=\"p\">Click me</Button> [link](http://a.b).\n\n- item\n\n| a |\n|---|\n| 1 |\n\n```javascript\nconst a = 1\n```\n")
    assert one == [{"heading": "Hello World", "depth": 1, "content": "Text em  Click me link.", "code_blocks": [{"language": "javascript", "value": "const a = 1"}]}]
    assert [(s["heading"], s["depth"]) for s in parsing.markdown("# A\n## B\n### C\nText\n\nSet\n---\n")] == [("A", 1), ("B", 2), ("C", 3), ("Set", 2)]
    assert parsing.markdown("plain")[0]["heading"] is None and parsing.markdown("```\nx\n```")[0]["code_blocks"][0]["language"] is None


def test_rst():
    got = parsing.rst("API Reference\n=============\n\n.. code-block:: javascript\n\n   // Express\n   app.use();\n")
    assert got == [{"heading": "API Reference", "depth": 1, "content": "", "code_blocks": [{"language": "javascript", "value": "// Express\n   app.use();".replace("   ", "")}]}]
    got = parsing.rst("T\n-\n\n.. note::\n   See :func:`~a.b.c` and ``lit``\n\nBody one\ntwo |x|\n")
    assert got[0]["depth"] == 2 and got[0]["content"] == "See c and lit\n\nBody one two x"
    assert [s["depth"] for s in parsing.rst("".join(f"H{i}\n{c * 3}\n\n" for i, c in enumerate(parsing.UNDERLINES)))] == list(range(1, 9))
    assert parsing.rst("====\nTop\n====\n", fix_overlines=True)[0] == {"heading": "Top", "depth": 1, "content": "", "code_blocks": []}


@pytest.mark.parametrize("ext", ["md", "rst"])
def test_parsers_hold_a_slice_of_a_batch(spark, monkeypatch, ext):
    """Whatever a batch's rows, Python holds the sections of a slice, and sends them on in order; long texts are alone."""
    import tracemalloc

    part = {"md": "## Part\n\nwords\n\n", "rst": "Part\n----\n\nwords\n\n"}[ext]
    texts = [part * (1 + i % 40) for i in range(1500)] + [part * 40_000, None, ""]
    files = spark.createDataFrame([(i, f"{i}.{ext}", t) for i, t in enumerate(texts)], "id int, path string, text string").coalesce(1)
    taken = []
    monkeypatch.setattr(type(files), "mapInArrow", lambda self, run, schema, f=type(files).mapInArrow: taken.append((self, run)) or f(self, run, schema))
    parsing.parsed(files)
    (given, run), got = taken[0], []
    batches = given.where(F.col("id") < 1500).toArrow().combine_chunks().to_batches()
    assert len(batches) == 1
    tracemalloc.start()
    for out in run(iter(batches)):
        got += zip(out.column(0).to_pylist(), (len(x) for x in out.column(out.num_columns - 1)), strict=True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(i, 1 + i % 40) for i in range(1500)]
    assert peak < 5_000_000
    rows = parsing.parsed(files).select("id", "text", F.size("sections").alias("n")).collect()
    assert [r.n for r in rows] == [(t or "").count("Part") for t in texts] and [r.text for r in rows] == texts


def test_parser_queries_read_markup(spark, tmp_path):
    import random

    from lexigraph import queries

    # Texts put together from pieces of which it is known what they say: (text, a new section, what its paragraph says).
    kinds = {
        "parse_markdown_sections": [("## Sub", True, ""), ("plain words", False, "plain words"), ("a *b* [c](d)", False, "a b c"), ("```py\n# no heading\n```", False, ""), ("- item\n- item", False, ""), ("| a | b |\n|---|---|\n| 1 | 2 |", False, "")],
        "parse_rst_sections": [("Sub\n-----", True, ""), ("plain words", False, "plain words"), (".. note::\n\n   said here", False, "said here"), (".. code-block:: py\n\n   x = 1", False, "")],
    }
    for name, pieces in kinds.items():
        rng, rows, want = random.Random(2), [], {}
        for i in range(30):
            chosen = rng.choices(pieces, k=rng.randint(0, 7))
            rows.append((i, "\n\n".join(x for x, *_ in chosen)))
            first = next((k for k, x in enumerate(chosen) if x[1]), len(chosen))
            want[i] = (1 + sum(x[1] for x in chosen), f"Title {i}", len("\n\n".join(x[2] for x in chosen[:first] if x[2])))
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / name / "documents.parquet"))
        got = queries.QUERIES[name](spark, str(tmp_path / name)).collect()
        assert {r.doc_id: (r.n_sections, r.heading, r.size) for r in got} == want


def test_text_functions(spark):
    urls = ["https://github.com/org/repo", "https://github.com/org/repo.git", "https://github.com/org/repo/", "git@github.com:org/repo.git"]
    assert {r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(T.library_id(F.col("u"))).collect()} == {"/org/repo"}
    with pytest.raises(Exception, match="Invalid"):
        spark.createDataFrame([("http://x",)], "u string").select(T.library_id(F.col("u"))).collect()
    one = spark.createDataFrame([("Élan, vital!", "/o/r", 5_000_000)], "t string, l string, n long")
    r = one.select(T.tokens(F.col("t")).alias("t"), T.source_url(F.col("l"), F.lit("/a.md")).alias("u"), T.format_bytes(F.col("n")).alias("b"), T.pad_end(F.lit("abc"), 2).alias("p"), T.eta(F.col("n")).alias("e"), T.is_glob(F.lit("a*b")).alias("g")).first()
    assert (r.t, r.u, r.b, r.p, r.e, r.g) == (["elan", "vital"], "https://github.com/o/r/blob/main/a.md", "4.77 MB", "abc", "41h 40m", True)


def test_store(spark, tmp_path):
    tree = tmp_path / "repo" / "docs"
    tree.mkdir(parents=True)
    (tree / "guide.md").write_text("# Guide\n\nHello world of routing\n\n## Part\n\nMore text\n")
    (tree / "api.rst").write_text("API\n===\n\nSome words\n")
    (tmp_path / "repo" / "README.md").write_text("# Readme\n\nTop\n")
    store = Store(spark, str(tmp_path / "store"))
    files = docs.files(spark, docs.resolve(str(tmp_path / "repo")))
    assert {r.path for r in files.collect()} == {"docs/guide.md", "docs/api.rst", "README.md"}
    assert {r.path for r in docs.files(spark, docs.resolve(str(tmp_path / "repo"), "docs")).collect()} == {"docs/guide.md", "docs/api.rst"}
    assert [r.path for r in docs.files(spark, docs.resolve(str(tmp_path / "repo"), "docs/guide.md")).collect()] == ["docs/guide.md"]
    assert docs.files(spark, docs.resolve(str(tmp_path / "repo"), "nowhere")).count() == 0
    repo = "https://github.com/test/library"
    assert store.ingest(files, repo) == 4
    assert store.ingest(files, repo) == 4 and store.libraries().count() == 1 and store.snippets().count() == 4
    assert "github.com/test/library/blob/main/" in store.snippets().first().source_url
    embedder = providers.HashingEmbedder(16)
    assert store.vectorize(embedder) == 4 and store.vectorize(embedder) == 0 and store.vectorize(embedder, force=True) == 4
    assert store.bands().count() == 4
    store.reindex()
    search = lambda text: keyword.search(store.snippets(), text, index_path=store.index_path())
    assert search("routing").count() == 1
    assert store.ingest(files.where("path = 'README.md'"), repo, "v2") == 1 and store.snippets().count() == 5
    assert {r.library_version for r in search("readme").collect()} == {"latest", "v2"}  # the index follows
    store.split(str(tmp_path / "split"), {"all": ["test"]})
    assert spark.read.parquet(str(tmp_path / "split" / "libraries")).count() == 2
    last = store.snippets().agg(F.max("id")).first()[0]
    assert store.ingest(files.where("false"), repo, "v2") == 0 and store.snippets().count() == 4 and search("readme").count() == 1
    assert store.remove("/test/library") == 2 and store.snippets().count() == 0 and store.libraries().count() == 0
    postings = spark.read.schema("term string").parquet(f"{store.index_path()}/postings") if list((tmp_path / "store" / "index-plain" / "postings").glob("library_id=*")) else None
    assert postings is None or postings.count() == 0
    assert store.ingest(files, repo) == 4 and store.snippets().agg(F.min("id")).first()[0] > last  # no id is used twice
    assert store.remove("/test/library") == 1
    assert store.remove("/test/library") == 0 and store.orphans().count() == 0


def test_hybrid_over_what_is_written(spark, snippets, tmp_path):
    """The written index and the stored bands give what the snippets themselves give, with few scans."""
    from lexigraph.operators import index

    index.write(snippets, str(tmp_path / "index"))
    semantic.with_bands(snippets, 3).write.parquet(str(tmp_path / "bands"))
    bands = spark.read.parquet(str(tmp_path / "bands"))
    for vector in ([1.0, 0.0, 0.0], [-1.0, 0.5, -2.0], None):
        a = hybrid.fused(snippets, "rope OR weather", vector, **SAIL)
        b = hybrid.fused(snippets, "rope OR weather", vector, **SAIL, index_path=str(tmp_path / "index"), bands=bands)
        assert [(r.id, round(r.score, 9)) for r in a.collect()] == [(r.id, round(r.score, 9)) for r in b.collect()]
    plan = keyword.ranked(*index.tables(snippets, "plain", str(tmp_path / "index")), "rope OR weather")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,rope)" in plan or "In(term, [rope,weather])" in plan


def test_names_of_files_that_are_not_utf8(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"# Caf\xe9\n\ntext\n")
    assert docs.files(spark, docs.resolve(str(tmp_path))).first().text == "# Caf\ufffd\n\ntext\n"


def test_render_other_forms(spark):
    row = spark.createDataFrame([("/a/b", "T", "D", -1, 7.5, 0.0, ["v1", "v2"], "", "x")], "id string, title string, description string, total_snippets long, trust_score double, benchmark_score double, versions array<string>, breadcrumb string, content string")
    assert row.select(render.catalog_entry()).first()[0] == "- Title: T\n- Library ID: /a/b\n- Description: D\n- Source Reputation: High\n- Versions: v1, v2"
    assert row.select(render.documentation()).first()[0] == "## T\nx"


def test_band_indices():
    """The places of the published generator, as the index format fixes them."""
    assert tuple(V.band_indices(64)[:8]) == (1, 42, 49, 47, 6, 32, 9, 23) and tuple(V.band_indices(384)[:4]) == (8, 255, 299, 284)


def test_commands(spark, tmp_path, monkeypatch):
    import subprocess

    from lexigraph import cli

    monkeypatch.chdir(tmp_path)
    source = tmp_path / "source"
    (source / "docs").mkdir(parents=True)
    (source / "docs" / "a.md").write_text("# Masts\n\nHow to raise masts\n")
    git = lambda *a: subprocess.run(["git", "-C", str(source), "-c", "user.name=x", "-c", "user.email=x@example.com", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    git("add", ".")
    git("commit", "-q", "-m", "one")
    git("tag", "v1")
    do = lambda *a: cli.run(spark, cli.parser().parse_args(["--store", str(tmp_path / "store"), *a]))
    url = "https://github.com/harbor/masts"
    assert do("ingest", url, "--local-path", str(source)) == "1 snippets"
    assert docs.clone(f"file://{source}", str(tmp_path / "tree"), "v1") and (tmp_path / "tree" / "docs" / "a.md").exists()
    with pytest.raises(RuntimeError, match="git clone failed"):
        docs.clone(f"file://{source}", str(tmp_path / "other"), "v9")
    registry = str(tmp_path / "presets.json")
    (tmp_path / "trees" / "masts").mkdir(parents=True)
    (tmp_path / "trees" / "masts" / "b.md").write_text("# Ropes\n\nKnots\n")
    (tmp_path / "presets.json").write_text(json.dumps({"masts": {"repo": url, "docsPath": "", "title": "Masts", "description": "d", "versions": ["v2", "v1"]}, "absent": {"repo": "file:///nowhere/at/all", "docsPath": "", "title": "", "description": ""}}))
    assert do("preset", registry) == "absent\nmasts" and do("preset", registry, "--name", "nothing") == "no preset named nothing"
    assert do("preset", registry, "--name", "masts", "--trees", str(tmp_path / "trees")) == "masts: 1 snippets"
    with pytest.raises(RuntimeError, match="1 of 2 presets failed: absent"):
        do("preset-all", registry, "--trees", str(tmp_path / "trees"))
    assert "/harbor/masts" in do("list") and do("reindex") == "done"
    assert "Knots" in do("query", "/harbor/masts/v2", "knots") and "Knots" in do("--reranking-provider", "local", "query", "/harbor/masts/v2", "knots", "--rerank")
    assert "- Name: " in do("resolve", "masts") and do("vectorize") == "0 embedded"
    assert "files" in do("preview", "--local-path", str(source))
    (tmp_path / "config.json").write_text(json.dumps({"embedding": {"provider": "openai"}}))
    with pytest.warns(UserWarning), pytest.raises(ValueError, match="API key"):
        do("vectorize", "--force")
    (tmp_path / "config.json").unlink()
    (tmp_path / "domains.json").write_text(json.dumps({"all": ["harbor"]}))
    assert do("split", str(tmp_path / "split"), "--domains", "domains.json") == "done"
    assert do("remove", "/harbor/masts") == "removed 2" and do("remove", "/harbor/masts") == "not found" and do("list") == "No libraries found."


def test_stream(spark, tmp_path):
    from lexigraph.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# A\n\ntext\n")
    store = Store(spark, str(tmp_path / "store"))
    for n in (1, 2):
        ingest.stream(spark, str(tmp_path / "in"), store, "/o/r", "latest", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == n
        (tmp_path / "in" / "b.md").write_text("# B\n\nmore\n")


def test_providers():
    sent = []
    ok = lambda url, body, key: (sent.append(body["input"]) or (200, {"data": [{"embedding": [1.0]} for _ in body["input"]]}))
    assert providers.RemoteEmbedder("u", "k", "m", 1, send=ok).embed(["", "text 1", "   "]) == [None, [1.0], None] and sent == [["text 1"]]
    assert len(providers.RemoteEmbedder("u", "k", "m", 1, send=ok).embed(["t"] * 250)) == 250 and len(sent) == 4
    calls, waits = [], []
    busy = lambda url, body, key: (calls.append(1) or (503, "busy"))
    with pytest.raises(providers.RemoteError):
        providers.post("u", {}, "k", send=busy, sleep=waits.append)
    assert len(calls) == 3 and waits == [1, 2]
    assert providers.post("u", {}, "k", send=lambda *a: (400, "no")) is None
    assert providers.reranker("none") is None and isinstance(providers.reranker("local"), providers.OverlapReranker)
    for name in ("cohere", "jina"):
        said = []
        r = providers.reranker(name, key="k", send=lambda url, body, key: (said.append(url) or (200, {"results": [{"index": 1, "relevance_score": 0.9}, {"index": 0, "relevance_score": 0.1}]})))  # noqa: B023
        assert r.score("q", ["a", "b"]) == [0.1, 0.9] and name in said[0]
        with pytest.raises(ValueError, match="API key"):
            providers.reranker(name)
    assert providers.embedder("openai", key="k").model and isinstance(providers.embedder("local"), providers.HashingEmbedder)
    for make, name in ((providers.embedder, "openai"), (providers.embedder, "nope"), (providers.reranker, "nope"), (providers.embedder, "remote")):
        with pytest.raises(ValueError):
            make(name)
    e = providers.HashingEmbedder(8)
    assert e.embed([" ", None, "a b"])[:2] == [None, None] and e.embed(["a b"]) == e.embed([" a b "])


def test_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"embedding": {"provider": "local", "model": "m"}}))
    c = config.load(str(p))
    assert config.setting("embedding", "model", None, c) == "m" and config.setting("embedding", "model", "x", c) == "x"
    assert config.load(str(tmp_path / "none.json")) is None
    for bad in ("[1]", "{", '{"embedding": {"provider": "nope"}}', '{"embedding": {"model": 3}}'):
        p.write_text(bad)
        with pytest.raises(config.ConfigError):
            config.load(str(p))
    with pytest.warns(UserWarning):
        config.validate({"reranking": {"provider": "jina"}})


def test_presets(spark, tmp_path):
    p = tmp_path / "presets.json"
    p.write_text(json.dumps({"beta": {"repo": "r", "docsPath": "d", "title": "t", "description": "x", "versions": ["v2", "v1"]}, "Alpha": {"repo": "q", "docsPath": "", "title": "a", "description": ""}}))
    assert [r.name for r in presets.listed(spark, str(p)).collect()] == ["Alpha", "beta"]
    assert presets.get(spark, str(p), "beta").versions == ["v2", "v1"] and presets.get(spark, str(p), "alpha") is None
