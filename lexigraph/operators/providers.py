"""Embedding and reranking functions that the engine calls: protocols, the bundled ones, and clients of remote services."""

from __future__ import annotations

import hashlib
import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


class Embedder(Protocol):
    name: str
    model: str
    dims: int

    def embed(self, texts: list[str | None]) -> list[list[float] | None]: ...


class HashingEmbedder:
    """Seeded feature hashing of tokens, L2-normalised: deterministic and offline, with no semantics beyond shared words."""

    name, model = "hashing", "feature-hashing"

    def __init__(self, dims: int = 384, seed: int = 0) -> None:
        self.dims, self.seed = dims, seed

    def embed(self, texts: list[str | None]) -> list[list[float] | None]:
        return [self._one(t) for t in texts]

    def _one(self, text: str | None) -> list[float] | None:
        from ..plans.match import plain_tokens

        text = (text or "").strip()[:1024]
        if not text:
            return None
        v = [0.0] * self.dims
        for t in plain_tokens(text):
            h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8, key=self.seed.to_bytes(8, "big")).digest(), "big")
            v[h % self.dims] += 1.0 if h >> 63 else -1.0
        size = math.sqrt(sum(x * x for x in v))
        return [x / size for x in v] if size else None


class RemoteError(RuntimeError):
    pass


def post(url: str, body: dict, key: str, tries: int = 3, send=None, sleep=time.sleep) -> dict | None:
    """POST with retries after 1 and 2 s for 429, 5xx and network errors; 401 raises; another 4xx gives None."""
    send = send or _send
    for attempt in range(tries):
        try:
            status, said = send(url, body, key)
        except OSError as x:
            status, said = 0, str(x)
        if status == 200:
            return said
        if status == 401:
            raise RemoteError("the API key was refused")
        if 400 <= status < 500 and status != 429:
            return None
        if attempt + 1 < tries:
            sleep(2**attempt)
    raise RemoteError(f"no answer after {tries} tries: {status} {said}")


def _send(url: str, body: dict, key: str) -> tuple[int, object]:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Authorization": f"Bearer {key}", "Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=60) as r:
            return r.status, json.load(r)
    except urllib.error.HTTPError as x:
        return x.code, str(x)


class RemoteEmbedder:
    """A service that embeds batches of texts; blank texts aren't sent, and a failed batch gives nulls."""

    name = "remote"

    def __init__(self, url: str, key: str, model: str, dims: int = 1536, batch: int = 100, send=None, sleep=time.sleep) -> None:
        self.url, self.key, self.model, self.dims, self.batch, self.send, self.sleep = url, key, model, dims, batch, send, sleep

    def embed(self, texts: list[str | None]) -> list[list[float] | None]:
        out: list[list[float] | None] = [None] * len(texts)
        at = [i for i, t in enumerate(texts) if t and t.strip()]
        for k in range(0, len(at), self.batch):
            own = at[k : k + self.batch]
            try:
                said = post(self.url, {"model": self.model, "input": [texts[i] for i in own]}, self.key, send=self.send, sleep=self.sleep)
            except RemoteError:
                continue
            for i, row in zip(own, (said or {}).get("data", []), strict=False):
                out[i] = row["embedding"]
        return out


# Public addresses and default models of services, by part and provider.
SERVICES = {
    ("embedding", "openai"): ("https://api.openai.com/v1/embeddings", "text-embedding-3-small"),
    ("reranking", "cohere"): ("https://api.cohere.com/v2/rerank", "rerank-v3.5"),
    ("reranking", "jina"): ("https://api.jina.ai/v1/rerank", "jina-reranker-v2-base-multilingual"),
}


def _service(part: str, name: str, url: str | None, model: str | None) -> tuple[str, str]:
    known = SERVICES.get((part, name), (None, None))
    if not (url or known[0]):
        raise ValueError(f"{part} by {name} needs an address")
    return url or known[0], model or known[1] or ""


def embedder(name: str = "hashing", key: str | None = None, model: str | None = None, url: str | None = None, **options) -> Embedder:
    """hashing or local, which need nothing; openai or remote, which need a key."""
    if name in ("hashing", "local"):
        return HashingEmbedder(**options)
    if name not in ("openai", "remote"):
        raise ValueError(f"unknown embedding provider: {name}")
    if not key:
        raise ValueError(f"embedding by {name} needs an API key")
    address, chosen = _service("embedding", name, url, model)
    return RemoteEmbedder(address, key, chosen, **options)


def reranker(name: str = "none", key: str | None = None, model: str | None = None, url: str | None = None, **options):
    """none gives None; local the overlap of tokens; cohere, jina or remote a service, which needs a key."""
    if name == "none":
        return None
    if name == "local":
        return OverlapReranker()
    if name not in ("cohere", "jina", "remote"):
        raise ValueError(f"unknown reranking provider: {name}")
    address, chosen = _service("reranking", name, url, model)
    return RemoteReranker(address, key or "", chosen, **options)


def embedding(text: Column, provider: Embedder) -> Column:
    """An embedding column: Arrow batches, one provider a worker."""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            found = provider.embed([None if pd.isna(t) else t for t in s])
            if any(v is not None and len(v) != provider.dims for v in found):
                raise ValueError("the provider returned another size")
            yield pd.Series(found)

    return embed(T.embedding_text(text))


def noop_rerank(found: DataFrame, order: list, top_n: int | None = None) -> DataFrame:
    """Rows in their order, with rerank_score 1.00, 0.99, ... (the input is a bounded result list)."""
    at = F.row_number().over(W.orderBy(*order)) - 1
    out = found.withColumn("original_index", at).withColumn("rerank_score", F.round(1.0 - 0.01 * F.col("original_index"), 2)).orderBy("original_index")
    return out.limit(top_n) if top_n else out


class OverlapReranker:
    """Share of the query's tokens that a text holds; a stand-in for a cross-encoder, with the same contract."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        from ..plans.match import plain_tokens

        wanted = set(plain_tokens(query))
        return [len(wanted & set(plain_tokens(t or ""))) / len(wanted) if wanted else 0.5 for t in texts]


class RemoteReranker:
    """A service that ranks texts; keeps the service's order. 4xx raises."""

    def __init__(self, url: str, key: str, model: str, send=None, sleep=time.sleep) -> None:
        if not key:
            raise ValueError("a remote reranker needs an API key")
        self.url, self.key, self.model, self.send, self.sleep = url, key, model, send, sleep

    def rank(self, query: str, texts: list[str], top_n: int | None = None) -> list[tuple[int, float]]:
        said = post(self.url, {"model": self.model, "query": query, "documents": texts, "top_n": top_n or len(texts)}, self.key, send=self.send, sleep=self.sleep)
        if said is None:
            raise RemoteError("the request was refused")
        return [(r["index"], r["relevance_score"]) for r in said["results"]]

    def score(self, query: str, texts: list[str]) -> list[float]:
        scores = dict(self.rank(query, texts))
        return [scores.get(i, 0.0) for i in range(len(texts))]


def rerank(found: DataFrame, query: str, order: list, scorer=None, top_n: int | None = None) -> DataFrame:
    """Rows of a bounded result list by a scorer's score; without one, as they are (noop)."""
    if scorer is None:
        return noop_rerank(found, order, top_n)
    at = found.withColumn("original_index", F.row_number().over(W.orderBy(*order)) - 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(rerank_score=scorer.score(query, list(f["content"]))) if len(f) else f.assign(rerank_score=pd.Series([], dtype=float))

    schema = ", ".join(f"`{n}` {t}" for n, t in at.dtypes)
    out = at.coalesce(1).mapInPandas(run, f"{schema}, rerank_score double").orderBy(F.desc("rerank_score"), "original_index")
    return out.limit(top_n) if top_n else out
