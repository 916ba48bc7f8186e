"""Text embedding behind one column function.

An embedder is a picklable object with ``model``, ``dimensions`` and
``embed_batch(texts) -> list of vectors``. It is created lazily once per Python
worker and called with whole Arrow batches.
"""

from __future__ import annotations

import json
import os
import re
import urllib.request
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.errors import EmbeddingFailed

# Vector sizes of the supported models.
LOCAL_DIMENSIONS = 384
SERVICE_DIMENSIONS = 768
LOCAL_MODEL = "sentence-transformers/all-MiniLM-L6-v2"
SERVICE_MODEL = "nomic-embed-text"


class Embedder(Protocol):
    model: str
    dimensions: int

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Deterministic bag-of-tokens vectors of unit length; needs no model."""

    def __init__(self, dimensions: int = 64) -> None:
        self.model = "hashing"
        self.dimensions = dimensions

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in enumerate(texts):
            for token in re.findall("[a-z0-9_]+", text.lower()):
                h = zlib.crc32(token.encode())
                out[row, h % self.dimensions] += 1.0 if h & 0x10000 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms != 0).astype(np.float32).tolist()


class LocalModelEmbedder:
    """Mean-pooled, normalised sentence vectors of a local transformer."""

    def __init__(self, model: str = LOCAL_MODEL, dimensions: int = LOCAL_DIMENSIONS) -> None:
        self.model, self.dimensions, self._loaded = model, dimensions, None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_loaded": None}

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        if self._loaded is None:
            try:
                from sentence_transformers import SentenceTransformer

                self._loaded = SentenceTransformer(self.model)
            except Exception as exc:
                raise EmbeddingFailed(f"cannot load {self.model}: {exc}") from exc
        return self._loaded.encode(texts, normalize_embeddings=True).tolist()


class ServiceEmbedder:
    """Vectors from an HTTP embedding service (``POST /api/embed``)."""

    def __init__(self, url: str, model: str = SERVICE_MODEL, dimensions: int = SERVICE_DIMENSIONS) -> None:
        self.url, self.model, self.dimensions = url.rstrip("/"), model, dimensions

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": self.model, "input": texts}).encode()
        request = urllib.request.Request(f"{self.url}/api/embed", body, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=60) as response:
                vectors = json.load(response).get("embeddings") or []
        except OSError as exc:
            raise EmbeddingFailed(f"request to {self.url} failed: {exc}") from exc
        if len(vectors) != len(texts):
            raise EmbeddingFailed("empty embeddings array")
        return vectors


def create_embedder(env: dict[str, str] | None = None) -> Embedder:
    """Choose an embedder from the environment: a service when its URL is set, else the local model."""
    env = dict(os.environ) if env is None else env
    if url := env.get("OLLAMA_URL"):
        return ServiceEmbedder(
            url, env.get("OLLAMA_MODEL", SERVICE_MODEL), int(env.get("OLLAMA_DIMENSIONS", SERVICE_DIMENSIONS))
        )
    return LocalModelEmbedder()


def embed_udf(embedder: Embedder):
    """Column function ``text -> array<float>``."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(embedder.embed_batch(list(texts)), index=texts.index)

    return embed


def embed_query(embedder: Embedder, query: str) -> list[float]:
    return list(embedder.embed_batch([query])[0])
