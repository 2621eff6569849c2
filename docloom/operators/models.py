"""What models do, as protocols, and plain stand-ins: hashed vectors, word overlap, extracted sentences.

The stand-ins are lexical: they know no meaning, and their results say nothing about neural models.
"""

from __future__ import annotations

import hashlib
import math
import re
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = re.compile("[a-z0-9]+")


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    def generate(self, prompt: str) -> str: ...


class Scorer(Protocol):
    def score(self, query: str, text: str) -> float: ...


class OcrEngine(Protocol):
    def recognise(self, pages: DataFrame) -> DataFrame:
        """doc, page and text of pages (doc, page, content: the bytes of the page's file)."""


class HashedEmbedder:
    """Words and their letter triples, hashed with signs into a vector of unit length; all zero without words."""

    def __init__(self, dimension: int = 384):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self._vector(t) for t in texts]

    def _vector(self, text: str) -> list[float]:
        out = [0.0] * self.dimension
        for word in _WORD.findall(text.lower()):
            for part, weight in [(word, 1.0), *((f"#{word}#"[i : i + 3], 0.3) for i in range(len(word)))]:
                h = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "little")
                out[h % self.dimension] += weight if h >> 63 else -weight
        norm = math.sqrt(sum(x * x for x in out))
        return [x / norm for x in out] if norm else out


class OverlapScorer:
    """The share of the query's words that a text has."""

    def score(self, query: str, text: str) -> float:
        words = set(_WORD.findall(query.lower()))
        return len(words & set(_WORD.findall(text.lower()))) / len(words) if words else 0.0


class ExtractiveGenerator:
    """The sentences of a prompt's passages that share most words with its question."""

    def __init__(self, sentences: int = 2):
        self.sentences = sentences

    def generate(self, prompt: str) -> str:
        body, _, question = prompt.rpartition("Question:")
        scorer = OverlapScorer()
        told = [s.strip() for part in re.split(r"(?m)^\[\d+\] \(.*\)$", body)[1:] for s in re.split(r"(?<=[.!?])\s+", part) if s.strip()]
        best = sorted(range(len(told)), key=lambda i: -scorer.score(question, told[i]))[: self.sentences]
        return " ".join(told[i] for i in sorted(best))


def embedded(rows: DataFrame, text: str, embedder: Embedder, name: str = "embedding") -> DataFrame:
    """rows with the vector of a text column; null texts count as empty."""

    def run(texts: pa.Array) -> pa.Array:
        values = [x or "" for x in texts.to_pylist()]
        made = embedder.embed(values) if values else []
        if any(len(v) != embedder.dimension for v in made):
            raise ValueError(f"vectors must have {embedder.dimension} values")
        return pa.array(made, pa.list_(pa.float32()))

    return rows.withColumn(name, F.arrow_udf(run, "array<float>")(F.col(text).cast("string")))


def generated(prompt: Column, generator: Generator) -> Column:
    return F.arrow_udf(lambda p: pa.array([generator.generate(x or "").strip() for x in p.to_pylist()], pa.string()), "string")(prompt)
