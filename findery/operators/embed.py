"""Text embedding: pluggable embedders, a look-aside cache, and embedding of what has no vector yet."""

from __future__ import annotations

import hashlib
import json
import math
import time
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import EMBED_BATCH, EMBED_LETTERS, EMBED_TTL
from ..sources.shared import small_batches
from .filters import live


class Embedder(Protocol):
    """model names what embed would use; embed_named also tells what it has used, which a fallback may change by batch."""

    model: str
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def embed_named(self, texts: list[str]) -> tuple[str, list[list[float]]]: ...


class Named:
    """embed_named for an embedder of one model."""

    def embed_named(self, texts: list[str]) -> tuple[str, list[list[float]]]:
        return self.model, self.embed(texts)


class HashingEmbedder(Named):
    """Words hashed to signed dimensions, normalised: deterministic and without a model file."""

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions, self.model = dimensions, f"hashing-{dimensions}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vector = [0.0] * self.dimensions
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                vector[h % self.dimensions] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in vector)) or 1.0
            out.append([x / norm for x in vector])
        return out


class ApiEmbedder(Named):
    """A remote model behind an HTTP API that takes {model, input} and returns {data: [{index, embedding}]}."""

    timeout = 30

    def __init__(self, url: str, key: str, model: str, dimensions: int = 1024, open_url: Callable = urllib.request.urlopen) -> None:
        self.url, self.key, self.model, self.dimensions, self.open_url = url, key, model, dimensions, open_url

    def embed(self, texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": self.model, "input": texts}).encode()
        head = {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"}
        with self.open_url(urllib.request.Request(self.url, body, head), timeout=self.timeout) as reply:
            if not 200 <= reply.status < 300:
                raise OSError(f"status {reply.status}")
            rows = sorted(json.loads(reply.read())["data"], key=lambda r: r["index"])
        vectors = [r["embedding"] for r in rows]
        if len(vectors) != len(texts) or any(len(v) != self.dimensions for v in vectors):
            raise ValueError("the reply does not fit the request")
        return vectors


class Fallback:
    """The remote embedder, in batches and with retries; the local one where it is missing, overruled or fails."""

    def __init__(self, remote: Embedder | None, local: Embedder, force_local: bool = False) -> None:
        if force_local and remote and remote.model != local.model:
            raise ValueError("the local model may be forced only in place of the same model")
        self.remote, self.local, self.force_local = remote, local, force_local
        first = local if force_local or not remote else remote
        self.model, self.dimensions = first.model, first.dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self.embed_named(texts)[1]

    def embed_named(self, texts: list[str]) -> tuple[str, list[list[float]]]:
        if self.remote and not self.force_local:
            try:
                batches = [texts[i : i + EMBED_BATCH] for i in range(0, len(texts), EMBED_BATCH)]
                return self.remote.model, [v for b in batches for v in retried(lambda b=b: self.remote.embed(b))]
            except Exception:  # noqa: BLE001  any failure of the remote one is the local one's turn
                pass
        return self.local.model, self.local.embed(texts)


def retried(call: Callable, attempts: int = 3, sleep: Callable[[float], None] = time.sleep):
    """The call's result; between attempts a wait of 2, 4, ... seconds."""
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except Exception:
            if attempt == attempts:
                raise
            sleep(2**attempt)


class EmbeddingCache:
    """Vectors by model and text for a day; only what is missing is computed, in one call, order kept.

    An embedder itself, for the queries of a driver: search(..., embed=cache.one). What another model than the expected
    one makes is not held, and nothing held is mixed with it. The oldest vectors go when there are too many.
    """

    def __init__(self, embedder: Embedder, clock: Callable[[], float] = time.time, ttl: int = EMBED_TTL, most: int = 100_000) -> None:
        self.embedder, self.clock, self.ttl, self.most = embedder, clock, ttl, most
        self.model, self.dimensions = embedder.model, embedder.dimensions
        self.held: dict[str, tuple[float, list[float]]] = {}

    def key(self, text: str) -> str:
        return hashlib.sha256(f"{self.embedder.model}\0{text}".encode()).hexdigest()

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self.embed_named(texts)[1]

    def embed_named(self, texts: list[str]) -> tuple[str, list[list[float]]]:
        now = self.clock()
        missing = list(dict.fromkeys(t for t in texts if self.held.get(self.key(t), (0,))[0] <= now))
        model, vectors = self.embedder.embed_named(missing) if missing else (self.model, [])
        if model != self.model:
            return (model, vectors) if missing == texts else self.embedder.embed_named(texts)
        for text, vector in zip(missing, vectors):
            self.held.pop(self.key(text), None)
            self.held[self.key(text)] = (now + self.ttl, vector)
        given = [self.held[self.key(t)][1] for t in texts]
        for key in list(self.held)[: max(0, len(self.held) - self.most)]:
            del self.held[key]
        return model, given

    def one(self, text: str) -> list[float]:
        return self.embed([text])[0]


def embed_text():
    """What is embedded of a project."""
    joined = F.concat(F.coalesce("display_name", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")))
    return F.regexp_replace(joined, r"^\s+|\s+$", "")


def pending(projects: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(project_id, text) of live projects with a long enough description and no vector."""
    waiting = live(projects).where(F.length("description") >= EMBED_LETTERS)
    missing = waiting.join(embeddings.select(F.col("project_id").alias("id")), "id", "left_anti")
    return missing.select(F.col("id").alias("project_id"), embed_text().alias("text"))


def embed_pending(projects: DataFrame, embeddings: DataFrame, embedder: Embedder, now) -> DataFrame:
    """Rows to put into the embeddings; each batch is marked with the model that made it."""

    @F.pandas_udf("model string, embedding array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for i in range(0, len(texts), EMBED_BATCH):
                model, found = embedder.embed_named(texts.iloc[i : i + EMBED_BATCH].tolist())
                rows += [(model, v) for v in found]
            yield pd.DataFrame(rows, columns=["model", "embedding"], index=texts.index)

    small_batches(projects.sparkSession)
    at = F.lit(now).cast("timestamp")
    rows = pending(projects, embeddings).withColumn("made", vectors("text"))
    return rows.select("project_id", "made.embedding", "made.model", at.alias("created_at"), at.alias("updated_at"))


def upsert_embeddings(embeddings: DataFrame, made: DataFrame) -> DataFrame:
    """The next embeddings: made replaces what a project has, but for its created_at; the rest stays. made names a project once."""
    kept = embeddings.join(made.select("project_id"), "project_id", "left_anti")
    before = embeddings.select("project_id", F.col("created_at").alias("_since"))
    new = made.join(before, "project_id", "left").withColumn("created_at", F.coalesce("_since", "created_at"))
    return kept.select(*made.columns).union(new.select(*made.columns))


def with_parent(embeddings: DataFrame, projects: DataFrame) -> DataFrame:
    """Only vectors whose project exists."""
    return embeddings.join(projects.select(F.col("id").alias("project_id")), "project_id", "left_semi")
