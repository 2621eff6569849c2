"""Toxicity: FTRL-proximal logistic regression over hashed n-grams and skip-grams (operator 1).

Features of a text are the distinct words, word pairs and pairs of words one apart, lower-cased and
free of ASCII punctuation, hashed into 2**BITS places. The model is fitted by FTRL-proximal with
per-coordinate rates; its L1 term leaves few weights, which every task gets. It learns from at most
TRAIN_POSITIVE and TRAIN_NEGATIVE labelled texts, those first by a hash of their id. Their features are
made on the executors, 2**BITS / 8 bytes for a text at most (so 0.43 GB for all), and one task fits the
model; the driver gets the weights that are not zero. Scores use the whole text and nothing else.

Defined results: null counts as empty; an empty text gets the score of the bias alone. Rows of one
doc_id with several labels count as that many examples; without usable labels every score is 0.5.
Repeated rows repeat; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import _words
from docloom.llm._shared import fitted, map_texts, small_batches

BITS = 18
TRAIN_POSITIVE, TRAIN_NEGATIVE = 5000, 8000
#: Of 15 settings the one of least log loss on rows with crc32(doc_id) mod 4 = 3, fitted on remainders 0 and 1; remainder 2 was not read.
EPOCHS, ALPHA, BETA, L1, L2 = 4, 2.0, 1.0, 12.0, 1.0
THRESHOLD = 0.3


def text_features(chunk: _words.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Text and place of every feature occurrence."""
    h = chunk.word_hashes()
    texts, places = [chunk.doc], [h]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        at = np.flatnonzero(chunk.doc[gap:] == chunk.doc[: max(0, len(h) - gap)])
        texts.append(chunk.doc[at])
        places.append(_words.mix(h[at] * np.uint64(salt) + h[at + gap]))
    return np.concatenate(texts), (np.concatenate(places) >> np.uint64(64 - BITS)).astype(np.int64)


def packed(places: np.ndarray) -> bytes:
    """Distinct places as 32-bit integers or, where that is no shorter, as one bit for each of all places: 2**BITS / 8 bytes at most."""
    if 4 * len(places) < 1 << BITS >> 3:
        return places.astype("<i4").tobytes()
    bits = np.zeros(1 << BITS, bool)
    bits[places] = True
    return np.packbits(bits).tobytes()


def unpacked(places: bytes) -> np.ndarray:
    if len(places) == 1 << BITS >> 3:
        return np.flatnonzero(np.unpackbits(np.frombuffer(places, np.uint8)))
    return np.frombuffer(places, "<i4")


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in _words.chunks(batch.column("text"), _words.SPACE_OR_PUNCT, _words.LOWER):
            texts, places = text_features(chunk)
            key = np.unique(texts << BITS | places)
            texts, places = key >> BITS, (key & ((1 << BITS) - 1)).astype(np.int32)
            off = np.searchsorted(texts, np.arange(chunk.n + 1))
            rows = slice(chunk.first, chunk.first + chunk.n)
            lists = [packed(places[a:b]) for a, b in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("label")[rows], pa.array(lists, pa.binary())], ["label", "places"])


def fit(examples: list[tuple[int, bytes]]) -> tuple[np.ndarray, float]:
    """Weights and bias after EPOCHS passes of FTRL-proximal over labels and packed places in a fixed shuffled order."""
    size = 1 << BITS
    z, n, weights = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    order = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for i in order.permutation(len(examples)):
            label, places = examples[i]
            at = np.append(unpacked(places), size)
            zi, ni = z[at], n[at]
            l1 = np.full(len(at), L1)
            l1[-1] = 0.0
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
            n[at] = ni + g * g
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
    l1 = np.full(size + 1, L1)
    l1[-1] = 0.0
    weights = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return weights[:-1].astype(np.float32), float(weights[-1])


def score_texts(weights: np.ndarray, bias: float):
    places_kept, values = np.flatnonzero(weights).astype(np.int32), weights[np.flatnonzero(weights)]

    def run(texts: pa.Array) -> pa.Array:
        dense = np.zeros(1 << BITS)
        dense[places_kept] = values
        out = []
        for chunk in _words.chunks(texts, _words.SPACE_OR_PUNCT, _words.LOWER):
            t, places = text_features(chunk)
            hit = dense[places] != 0
            key = np.unique(t[hit] << BITS | places[hit])
            out.append(np.bincount(key >> BITS, dense[key & ((1 << BITS) - 1)], chunk.n))
        total = np.concatenate(out) if out else np.zeros(0)
        return pa.StructArray.from_arrays([pa.array(1 / (1 + np.exp(-np.clip(total + bias, -30, 30))))], ["score"])

    return run


def training_rows(docs: DataFrame, labels: DataFrame, label: str, usable, positive: int, negative: int) -> DataFrame:
    """text and label of a bounded sample of usable labels, by hash of the id; no shuffle of texts."""
    small_batches(docs.sparkSession)
    known = labels.where(usable & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    rank = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = [known.where(F.col("label") == v).orderBy(rank, "doc_id").limit(most) for v, most in ((1, positive), (0, negative))]
    sample = chosen[0].unionByName(chosen[1])  # at most positive + negative ids
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")


def _fit_table(examples: pa.Table) -> list[np.ndarray]:
    weights, bias = fit(list(zip(examples.column("label").to_pylist(), examples.column("places").to_pylist())))
    at = np.flatnonzero(weights)
    return [at.astype(np.int32), weights[at], np.array([bias])]


def trained(docs: DataFrame, labels: DataFrame, usable) -> tuple[np.ndarray, float]:
    rows = training_rows(docs, labels, "toxic", usable, TRAIN_POSITIVE, TRAIN_NEGATIVE)
    made = rows.mapInArrow(_examples, "label int, places binary")
    at, values, bias = fitted(made, ["label", "places"], _fit_table)  # sorted: the same whatever order tasks end in
    weights = np.zeros(1 << BITS, np.float32)
    weights[at] = values
    return weights, float(bias[0])


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    scored = map_texts(docs, "text", ["doc_id"], score_texts(*trained(docs, labels, ~held_out)), "score double").select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
