"""Embedders: anything with a name, a width and embed(texts) -> float array. The default needs no model file."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinery.functions.text import TERM

_TERM = regex.compile(TERM)


class Embedder(Protocol):
    name: str
    width: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


@lru_cache(maxsize=200_000)
def _place(term: str, width: int) -> tuple[int, int]:
    digest = hashlib.md5(term.encode(), usedforsecurity=False).hexdigest()
    return int(digest[:8], 16) % width, 1 if digest[8] < "8" else -1


class HashedEmbedder:
    """Signed term hashing: a term adds or takes 1 in the component that its MD5 names; scaled to length 1."""

    def __init__(self, width: int = 64):
        self.width, self.name = width, f"hashed-{width}"

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width))
        for row, text in zip(out, texts):
            for term in _TERM.findall((text or "").lower()):
                at, sign = _place(term, self.width)
                row[at] += sign
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where(norms == 0, 1, norms)


_factories: dict[str, Callable[[], Embedder]] = {"hashed-64": HashedEmbedder}
_made: dict[str, Embedder] = {}


def register(name: str, factory: Callable[[], Embedder]) -> None:
    """Make an embedder known by name; one that is there already stays."""
    _factories.setdefault(name, factory)


def get(name: str) -> Embedder:
    """The embedder, made on first use."""
    if name not in _made:
        _made[name] = _factories[name]()
    return _made[name]


def with_embedding(df: DataFrame, embedder: Embedder, text: str = "text", into: str = "embedding") -> DataFrame:
    """``df`` with the text's vector as array<float>. Marked so that no filter that Spark infers runs the embedder a second time."""

    @F.arrow_udf("array<float>")
    def vector(texts: pa.Array) -> pa.Array:
        got = np.asarray(embedder.embed([t.as_py() or "" for t in texts]), np.float32)
        return pa.array(list(got), pa.list_(pa.float32()))

    return df.withColumn(into, vector.asNondeterministic()(F.col(text)))
