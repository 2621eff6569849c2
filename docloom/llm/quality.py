"""Quality: attention-based multiple-instance learning (operator 6).

A text is a bag of passages of PASSAGE words. Each passage becomes a vector of shares of character
classes, word lengths and repetition. A small network encodes it, gated attention (tanh times
sigmoid) weighs the passages of a text, and the weighted sum is scored. Weights are learnt from
document labels alone, on the driver, from at most TRAIN_GOOD and TRAIN_BAD labelled texts, those
first by a hash of their id; passage vectors are made on the executors.

Defined results: null counts as empty; a text without words is one passage of zeros. Without usable
labels every score is 0.5. Repeated rows repeat; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import _words
from docloom.llm._shared import map_texts
from docloom.llm.toxicity import training_rows

PASSAGE = 64
TRAIN_GOOD, TRAIN_BAD = 4000, 2500
HIDDEN, GATE, STEPS, RATE = 16, 8, 300, 0.02
THRESHOLD = 0.3
_CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:", b"!?", b"|", b"#*$%&<>", b"@+=_/\\")
_CLASS = np.full(256, len(_CLASSES))
_CLASS[0x80:] = len(_CLASSES) + 1
for _i, _c in enumerate(_CLASSES):
    _CLASS[np.frombuffer(_c, np.uint8)] = _i
N_CLASSES = len(_CLASSES) + 2
WIDTH = N_CLASSES + 5


def passages(chunk: _words.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Text and vector of each passage; every text has one at least."""
    per = np.maximum(1, -(-chunk.counts // PASSAGE))
    text = np.repeat(np.arange(chunk.n), per)
    first = np.cumsum(per) - per
    place = np.arange(len(text)) - np.repeat(first, per)
    a = np.minimum(chunk.word_off[text] + place * PASSAGE, chunk.word_off[text + 1])
    b = np.minimum(a + PASSAGE, chunk.word_off[text + 1])
    words = b - a
    out = np.zeros((len(text), WIDTH))
    if len(chunk.start):
        of_word = np.repeat(np.arange(len(text)), words)
        # bytes from a passage's first word to its last
        lo, hi = chunk.start[np.minimum(a, len(chunk.start) - 1)], chunk.end[np.maximum(b - 1, 0)]
        sizes = np.where(words > 0, hi - lo, 0)
        at = np.repeat(lo - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        of_byte = np.repeat(np.arange(len(text)), sizes)
        share = np.bincount(of_byte * N_CLASSES + _CLASS[chunk.buf[at]], minlength=len(text) * N_CLASSES).reshape(-1, N_CLASSES)
        out[:, :N_CLASSES] = share / np.maximum(sizes, 1)[:, None]
        h, length = chunk.word_hashes(), (chunk.end - chunk.start).astype(float)
        n = np.maximum(words, 1)
        mean = np.bincount(of_word, length, len(text)) / n
        out[:, N_CLASSES] = mean / 10
        out[:, N_CLASSES + 1] = np.sqrt(np.maximum(np.bincount(of_word, length**2, len(text)) / n - mean**2, 0)) / 10
        key = np.unique(_words.mix(h ^ (of_word.astype(np.uint64) << np.uint64(40))), return_index=True)[1]
        out[:, N_CLASSES + 2] = np.bincount(of_word[key], minlength=len(text)) / n
        same = np.flatnonzero((h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1]))
        out[:, N_CLASSES + 3] = np.bincount(of_word[same], minlength=len(text)) / n
        out[:, N_CLASSES + 4] = words / PASSAGE
    return text, out


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in _words.chunks(batch.column("text")):
            text, x = passages(chunk)
            off = np.searchsorted(text, np.arange(chunk.n + 1))
            lists = [x[a:b].astype(np.float32).tobytes() for a, b in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("label")[chunk.first : chunk.first + chunk.n], pa.array(lists, pa.binary())], ["label", "x"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class GatedAttention:
    """Encoder, gated attention and scorer; p holds the parameters."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    @classmethod
    def fresh(cls, width: int) -> GatedAttention:
        rng = np.random.default_rng(7)
        shapes = {"w": (width, HIDDEN), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE)}
        p = {k: rng.normal(0, s[0] ** -0.5, s) for k, s in shapes.items()}
        return cls(p | {"wb": np.zeros(HIDDEN), "a": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN), "b": np.zeros(1)})

    def forward(self, x: np.ndarray, off: np.ndarray):
        """off: start of each bag, ascending, none empty."""
        p = self.p
        sizes = np.diff(np.append(off, len(x)))
        h = np.tanh(x @ p["w"] + p["wb"])
        t, s = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (t * s) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, off), sizes))
        weight = e / np.repeat(np.add.reduceat(e, off), sizes)
        z = np.add.reduceat(weight[:, None] * h, off)
        return _sigmoid(z @ p["c"] + p["b"]), (h, t, s, weight, z, sizes)

    def gradients(self, x: np.ndarray, off: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        score, (h, t, s, weight, z, sizes) = self.forward(x, off)
        d = (score - y) / len(y)
        g = {"c": z.T @ d, "b": np.array([d.sum()])}
        dz = np.repeat(d, sizes)[:, None] * p["c"]
        along = (dz * h).sum(1)
        de = weight * (along - np.repeat(np.add.reduceat(weight * along, off), sizes))
        g["a"] = (t * s).T @ de
        dt, ds = de[:, None] * p["a"] * s * (1 - t * t), de[:, None] * p["a"] * t * s * (1 - s)
        g["v"], g["u"] = h.T @ dt, h.T @ ds
        dh = (weight[:, None] * dz + dt @ p["v"].T + ds @ p["u"].T) * (1 - h * h)
        return g | {"w": x.T @ dh, "wb": dh.sum(0)}


def fit(bags: list[np.ndarray], labels: np.ndarray) -> tuple[GatedAttention, np.ndarray, np.ndarray]:
    """Model, and the mean and scale its inputs are brought to."""
    x = np.concatenate(bags) if bags else np.zeros((0, WIDTH))
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(WIDTH), np.ones(WIDTH))
    model = GatedAttention.fresh(WIDTH)
    if len(set(labels.tolist())) < 2:
        model.p["c"][:] = 0
        return model, mean, scale
    x = (x - mean) / scale
    off = np.cumsum([0, *map(len, bags[:-1])])
    m, v = ({k: np.zeros_like(q) for k, q in model.p.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        for k, g in model.gradients(x, off, labels).items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            model.p[k] = model.p[k] - RATE * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + 1e-4 * model.p[k])
    return model, mean, scale


def score_texts(model: GatedAttention, mean: np.ndarray, scale: np.ndarray):
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for chunk in _words.chunks(texts):
            text, x = passages(chunk)
            out.append(model.forward((x - mean) / scale, np.searchsorted(text, np.arange(chunk.n)))[0])
        return pa.StructArray.from_arrays([pa.array(np.concatenate(out) if out else np.zeros(0))], ["score"])

    return run


def trained(docs: DataFrame, labels: DataFrame, usable) -> tuple[GatedAttention, np.ndarray, np.ndarray]:
    rows = training_rows(docs, labels, "quality", usable, TRAIN_GOOD, TRAIN_BAD)
    made = rows.mapInArrow(_examples, "label int, x binary").toArrow()
    pairs = sorted(zip(made.column("label").to_pylist(), made.column("x").to_pylist()))  # the same whatever order tasks end in
    return fit([np.frombuffer(x, np.float32).reshape(-1, WIDTH).astype(float) for _, x in pairs], np.array([y for y, _ in pairs], float))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    scored = map_texts(docs, "text", ["doc_id"], score_texts(*trained(docs, labels, ~held_out)), "score double").select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
