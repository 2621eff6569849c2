"""The engine as one object: take files in, list them, search, answer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators import answering, retrieval
from docloom.operators.models import Embedder, ExtractiveGenerator, Generator, HashedEmbedder, Scorer, embedded
from docloom.operators.store import Library
from docloom.sources.files import read_files
from docloom.streaming.arrivals import take_in


@dataclass(frozen=True)
class Settings:
    """Fixed values that queries fall back on."""

    strategy: str = "hybrid"
    rerank: bool = False
    k: int = 5
    most: int = 50
    threshold: float = 0.4


class Engine:
    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None, generator: Generator | None = None, scorer: Scorer | None = None, ocr=None, settings: Settings | None = None):
        self.spark, self.library = spark, Library(spark, path)
        self.embedder, self.generator, self.scorer, self.ocr = embedder or HashedEmbedder(), generator or ExtractiveGenerator(), scorer, ocr
        self.settings = settings or Settings()

    def health(self) -> dict:
        return {"status": "ok" if self.spark.range(1).count() == 1 else "failed", "documents": self.library.documents().count(), "generator": type(self.generator).__name__}

    def ingest(self, paths: list[str]) -> DataFrame:
        return self.library.ingest(read_files(self.spark, paths), self.embedder, self.ocr)

    def take_in(self, folder: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """A started query that ingests the files that arrive in a folder; without every it ends when those there are in."""
        return take_in(self.spark, folder, self.library.path, self.embedder, checkpoint, self.ocr, every)

    def documents(self) -> DataFrame:
        return self.library.documents().orderBy("id")

    def document(self, document_id: int) -> dict:
        row = self.library.document(document_id).first()
        if row is None:
            raise KeyError(f"no document {document_id}")
        return row.asDict()

    def delete(self, source_path: str) -> bool:
        return self.library.delete(source_path)

    def chunks(self) -> DataFrame:
        return self.library.chunks().withColumnRenamed("id", "chunk_id")

    def search(self, questions: list[str], k: int | None = None, strategy: str | None = None, rerank: bool | None = None) -> DataFrame:
        """The k best chunks with payload for each question, named by its place in the list."""
        return self._search(self._asked(questions), *self._checked(questions, k), strategy, rerank)

    def _checked(self, questions: list[str], k: int | None) -> tuple[int]:
        k = self.settings.k if k is None else k
        if not questions or any(not q for q in questions):
            raise ValueError("a question must have a character at least")
        if not 1 <= k <= self.settings.most:
            raise ValueError(f"k must lie between 1 and {self.settings.most}")
        return (k,)

    def _asked(self, questions: list[str]) -> DataFrame:
        rows = self.spark.createDataFrame(list(enumerate(questions)), "query_id long, query string")
        return embedded(rows, "query", self.embedder, "query_embedding")

    def _search(self, asked: DataFrame, k: int, strategy: str | None, rerank: bool | None) -> DataFrame:
        chunks = self.chunks()
        reranked = self.settings.rerank if rerank is None else rerank
        return retrieval.with_payload(retrieval.search(strategy or self.settings.strategy, asked, chunks, k, reranked, scorer=self.scorer), chunks)

    def query(self, question: str, k: int | None = None, strategy: str | None = None, rerank: bool | None = None, with_answer: bool = True) -> dict:
        """query, retrieved (without character places) and the answer; the search runs once for both."""
        asked = self._asked([question])
        found = self._search(asked, *self._checked([question], k), strategy, rerank).cache()
        retrieved = [r.asDict() for r in found.drop("query_id", "char_start", "char_end").orderBy("rank").collect()]
        out = {"query": question, "retrieved": retrieved, "answer": None}
        if with_answer:
            row = answering.answer(asked, found, self.generator, self.settings.threshold).first()
            out["answer"] = {"raw_text": row["raw_text"], "sentences": [s.asDict(True) for s in row["sentences"] or ()], "retrieved_chunk_ids": row["retrieved_chunk_ids"] or []}
        found.unpersist()
        return out

    def has(self, source_path: str) -> bool:
        return not self.library.documents().where(F.col("source_path") == source_path).isEmpty()
