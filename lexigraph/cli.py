"""python -m lexigraph.cli COMMAND: the engine's commands over a store."""

from __future__ import annotations

import argparse
import json
import os
import tempfile

from . import ship
from .operators import catalog, chunking, providers
from .operators.store import Store
from .plans import dispatch
from .sources import config, docs, presets


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexigraph", allow_abbrev=False)
    p.add_argument("--store", default="./store")
    p.add_argument("--config", help="a JSON file of providers")
    for part in ("embedding", "reranking"):
        for key in ("provider", "api-key", "model", "api-url"):
            p.add_argument(f"--{part}-{key}")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("ingest")
    c.add_argument("repo")
    c.add_argument("--local-path", help="a checked-out tree; else the repository is cloned")
    c.add_argument("--version", default="latest")
    c.add_argument("--docs-path")
    c.add_argument("--title", default="")
    c.add_argument("--description", default="")
    for name in ("preset", "preset-all"):
        c = sub.add_parser(name)
        c.add_argument("registry")
        c.add_argument("--trees", help="a folder of checked-out trees by preset name; what it lacks is cloned into it")
        if name == "preset":
            c.add_argument("--name", help="without it, the presets are listed")
    sub.add_parser("list")
    c = sub.add_parser("remove")
    c.add_argument("library")
    c.add_argument("--keep-snippets", action="store_true")
    c = sub.add_parser("preview")
    c.add_argument("--local-path", required=True)
    c.add_argument("--docs-path")
    c = sub.add_parser("vectorize")
    c.add_argument("--library")
    c.add_argument("--version")
    c.add_argument("--force", action="store_true")
    c = sub.add_parser("reindex")
    c.add_argument("--profile", default="plain", choices=("plain", "porter"))
    c = sub.add_parser("resolve")
    c.add_argument("name")
    c = sub.add_parser("query")
    c.add_argument("library")
    c.add_argument("text")
    c.add_argument("--mode", default="hybrid")
    c.add_argument("--top-k", type=int, default=10)
    c.add_argument("--rerank", action="store_true")
    c = sub.add_parser("split")
    c.add_argument("out")
    c.add_argument("--domains", required=True, help="a JSON file: words of library ids by domain, the first that matches wins")
    return p


def _made(part: str, args: argparse.Namespace, make, default: str):
    """The provider of a part, from options, configuration and environment."""
    conf = config.load(args.config)
    said = lambda key, option: config.setting(part, key, getattr(args, f"{part}_{option}"), conf)
    return make(said("provider", "provider") or default, key=said("apiKey", "api_key"), model=said("model", "model"), url=said("apiUrl", "api_url"))


def _tree(args: argparse.Namespace, name: str, repo: str, version: str | None) -> str:
    folder = args.trees or tempfile.mkdtemp(prefix="lexigraph-trees-")
    path = os.path.join(folder, name)
    return path if os.path.isdir(path) else docs.clone(repo, path, version)


def run(spark, args: argparse.Namespace) -> str:
    ship(spark)
    store = Store(spark, args.store)
    embedder = lambda: _made("embedding", args, providers.embedder, "local")
    if args.command == "ingest":
        tree = args.local_path or docs.clone(args.repo, os.path.join(tempfile.mkdtemp(prefix="lexigraph-trees-"), "tree"), None if args.version == "latest" else args.version)
        n = store.ingest(docs.files(spark, docs.resolve(tree, args.docs_path)), args.repo, args.version, args.title, args.description, embedder())
        return f"{n} snippets"
    if args.command == "preset" and not args.name:
        return "\n".join(r.name for r in presets.listed(spark, args.registry).select("name").collect())
    if args.command in ("preset", "preset-all"):
        found = presets.listed(spark, args.registry).collect() if args.command == "preset-all" else [x for x in [presets.get(spark, args.registry, args.name)] if x]
        said, failed = [], []
        for r in found:
            try:
                version = (r.versions or [None])[0]
                files = docs.files(spark, docs.resolve(_tree(args, r.name, r.repo, version), r.docs_path))
                said.append(f"{r.name}: {store.ingest(files, r.repo, version or 'latest', r.title or '', r.description or '', embedder())} snippets")
            except Exception as x:  # noqa: BLE001  the others go on; all failures are raised at the end
                failed.append(f"{r.name}: {x}")
        if failed:
            raise RuntimeError(f"{len(failed)} of {len(found)} presets failed: " + "; ".join(failed))
        return "\n".join(said) or f"no preset named {args.name}"
    if args.command == "list":
        rows = catalog.listed(store.libraries()).collect()
        return "\n".join(f"{r.id:<40}{r.version:<16}{r.total_snippets:>8}  {r.title}" for r in rows) or "No libraries found."
    if args.command == "remove":
        n = store.remove(args.library, not args.keep_snippets)
        return f"removed {n}" if n else "not found"
    if args.command == "preview":
        files = docs.files(spark, docs.resolve(args.local_path, args.docs_path))
        return str(chunking.preview(store.chunks(files, "/preview/preview", "latest")).first().asDict())
    if args.command == "vectorize":
        return f"{store.vectorize(embedder(), args.library, args.version, args.force)} embedded"
    if args.command == "reindex":
        store.reindex(args.profile)
        return "done"
    if args.command == "resolve":
        return dispatch.resolve_library_id(store.libraries(), args.name)
    if args.command == "query":
        bands = store.bands() if store.exists("bands") else None
        reranker = _made("reranking", args, providers.reranker, "none") if args.rerank else None
        return dispatch.query_docs(store.snippets(), store.libraries(), args.text, args.library, mode=args.mode, top_k=args.top_k, embedder=embedder(), reranker=reranker, rerank=args.rerank, index_path=store.index_path(), bands=bands)
    with open(args.domains, encoding="utf-8") as f:
        store.split(args.out, json.load(f))
    return "done"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    print(run(SparkSession.builder.getOrCreate(), parser().parse_args()))
