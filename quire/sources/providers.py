"""Outside models behind small interfaces, called for batches inside tasks, and stand-ins that need no network."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Embedder(Protocol):
    dimension: int
    batch: int

    def embed(self, texts: list[str], kind: str) -> list[list[float]]: ...


class HashedEmbedder:
    """A stand-in: words add a direction made from their digest; vectors have length 1."""

    def __init__(self, dimension: int = 64, batch: int = 128):
        self.dimension, self.batch = dimension, batch

    def embed(self, texts: list[str], kind: str) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        v = np.zeros(self.dimension)
        for word in text.lower().split():
            seed = int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "little")
            v += np.random.default_rng(seed).normal(size=self.dimension)
        n = np.linalg.norm(v)
        return (v / n if n else v).tolist()


def embedded(rows: DataFrame, make: Callable[[], Embedder], text: str = "text", kind: str = "document") -> DataFrame:
    """Adds embedding; a provider is made once a partition and called with its own batch size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for b in batches:
            texts = b[text].fillna("").tolist()
            found = [v for lo in range(0, len(texts), provider.batch) for v in provider.embed(texts[lo : lo + provider.batch], kind)]
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} embeddings for {len(texts)} texts")
            yield b.assign(embedding=pd.Series(found, index=b.index, dtype=object))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", embedding array<float>"
    return rows.mapInPandas(run, schema)


def overlap_score(question: str, text: str) -> float:
    """A stand-in for a reranker: the share of the question's words that the text has."""
    words = set(question.lower().split())
    return len(words & set(text.lower().split())) / max(1, len(words))


def reranked(pairs: DataFrame, score: Callable[[str, str], float] = overlap_score) -> DataFrame:
    """q, key, relevance of pairs (q, key, question, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"q": b["q"], "key": b["key"], "relevance": [float(score(a, t)) for a, t in zip(b["question"], b["text"])]})

    return pairs.select("q", "key", "question", "text").mapInPandas(run, f"q long, key {pairs.schema['key'].dataType.simpleString()}, relevance double")
