"""Providers of embeddings, as functions of a column and of one text."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text

# Providers and their models, dimensions and batches.
MOCK = ("mock", "deterministic", "test")
MODELS = {"sentence-transformers": "all-MiniLM-L6-v2", "openai": "text-embedding-3-small", "gemini": "text-embedding-004"}
KEYS = {"openai": "OPENAI_API_KEY", "gemini": "GEMINI_API_KEY"}
DIMENSIONS, BATCHES = {"gemini": 768}, {"gemini": 100}


@dataclass(frozen=True)
class Embedder:
    """``column`` embeds a text column, ``one`` a text on the driver."""

    provider: str
    model: str | None
    column: Callable[[Column], Column]
    one: Callable[[str], list[float]]

    @property
    def dimension(self) -> int | None:
        return DIMENSIONS.get(self.provider)


def batched(client: Callable[[list[str]], list[list[float]]], batch: int = 100) -> Callable[[Column], Column]:
    """A client of texts as a function of a column: it is asked ``batch`` texts at a time; null stays null."""

    def column(value: Column) -> Column:
        @F.arrow_udf("array<double>")
        def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for part in parts:
                texts = part.to_pylist()
                asked = [i for i, x in enumerate(texts) if x is not None]
                out: list = [None] * len(texts)
                for at in range(0, len(asked), batch):
                    mine = asked[at : at + batch]
                    for i, vector in zip(mine, client([texts[i] for i in mine]), strict=True):
                        out[i] = [float(x) for x in vector]
                yield pa.array(out, pa.list_(pa.float64()))

        return run(value)

    return column


def embedder(provider: str = "sentence-transformers", model: str | None = None, api_key: str | None = None, client: Callable[[list[str]], list[list[float]]] | None = None) -> Embedder:
    """The embedder of a provider.

    All but the mock need a ``client``, a function of a list of texts: the package brings no
    network code.  Providers with keys refuse without one.
    """
    name = provider.lower().strip()
    if name in MOCK:
        return Embedder("mock", None, text.mock_embedding, text.mock_vector)
    if name not in MODELS:
        raise ValueError(f"unknown provider: {provider}; known are {', '.join((*MODELS, 'mock'))}")
    if name in KEYS and not (api_key or os.environ.get(KEYS[name])):
        raise ValueError(f"{KEYS[name]} is needed for {name}")
    if client is None:
        raise ValueError(f"{name} needs a client that embeds a list of texts")
    return Embedder(name, model or MODELS[name], batched(client, BATCHES.get(name, 100)), lambda value: [float(x) for x in client([value])[0]])


def claim_scorer(one: Callable[[str], list[float]], fallback: Callable[[str, str], float]) -> Callable[[str, str], float]:
    """Similarity of two claims by cosine within 0 and 1; by words where an embedding fails."""

    def score(a: str, b: str) -> float:
        try:
            x, y = one(a), one(b)
            norm = lambda v: sum(z * z for z in v) ** 0.5 or 1.0
            return max(0.0, min(1.0, sum(p * q for p, q in zip(x, y, strict=True)) / (norm(x) * norm(y))))
        except Exception:  # a client may fail in any way
            return fallback(a, b)

    return score


def claim_similarity(a: Column, b: Column, embed: Callable[[Column], Column] = text.mock_embedding) -> Column:
    """The same for columns, in the JVM where the embedder is; without a vector, by words."""
    return F.coalesce(bounded_cosine(a, b, embed), text.jaccard(text.content_words(a), text.content_words(b)))


def bounded_cosine(a: Column, b: Column, embed: Callable[[Column], Column]) -> Column:
    """The cosine of two embedded columns within 0 and 1; null where a vector is."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), text.cosine(embed(a), embed(b))))
