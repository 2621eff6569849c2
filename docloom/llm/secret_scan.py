"""Secrets: base patterns, and runs of characters that look random rather than like identifiers (operator 13).

Base spans (assign, access, hex) are found by fixed patterns and always stay. Beside them every other
run of key characters of LEAST_RUN or more is scored: first-order Markov models over characters, one
for each alphabet that keys are written in, against one of ordinary words, identifiers and numbers.
The score is the log-likelihood ratio of the mixture of random models to the ordinary one. A run is
added (kind random) where the score reaches log(ODDS), as secrets are that rare, and its mean over the
characters exceeds that of all but RATE of held-out ordinary runs.

The models are trained from labelled samples: random strings are values that base patterns find in a
sample of the corpus, sorted by alphabet, and strings drawn from each alphabet; ordinary ones are the
sample's other words, and identifiers, paths and numbers made of these. The sample is bounded: the
SAMPLE_TEXTS texts of least hash, of which at most SAMPLE_WORDS words of each label, of least hash and
at most LONGEST_WORD bytes. One task fits; the driver gets the two tables of logarithms alone.

Defined results: null counts as empty; an empty text has no spans. An added span never overlaps a base
span, is not a UUID, and has no letter or digit of another script right beside it. Repeated rows
repeat; any length is handled in time linear in the text; an empty table gives an empty result, and a
table without words is scored by models of drawn strings alone. Kept columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import _words
from docloom.llm._shared import fitted, map_texts, small_batches

KINDS = ("assign", "access", "hex", "random")
LEAST_RUN, LEAST_HEX, LEAST_ACCESS, LEAST_VALUE = 16, 24, 20, 6
ODDS, RATE = 1e6, 0.001
SAMPLE_TEXTS, SAMPLE_WORDS, LONGEST_WORD = 3000, 40_000, 256
#: Weight of the uniform distribution in each model.
UNSEEN = 0.05
#: Drawn strings of each alphabet, and identifiers made of words.
DRAWN, MADE = 400, 6000

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_RUN = re.compile(rb"[A-Za-z0-9+/_-]{16,}+={0,2}")
_UUID = re.compile(rb"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\Z")

_LOWER, _UPPER, _DIGITS = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_SYMBOLS = _LOWER + _UPPER + _DIGITS + b"+/_=-."
#: The alphabets that keys are written in.
ALPHABETS = (_DIGITS + b"abcdef", _DIGITS + b"ABCDEF", _UPPER + b"234567", _DIGITS + _LOWER, _DIGITS + _LOWER + _UPPER, _DIGITS + _LOWER + _UPPER + b"+/", _DIGITS + _LOWER + _UPPER + b"-_")
START = len(_SYMBOLS)
_CODE = np.full(256, -1, np.int16)
_CODE[np.frombuffer(_SYMBOLS, np.uint8)] = np.arange(len(_SYMBOLS))
#: All but the characters of runs end a word of _words.Chunk.
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[np.frombuffer(_LOWER + _UPPER + _DIGITS + b"+/_=-", np.uint8)] = False


def assigned(text: bytes) -> list[tuple[str, int, int]]:
    return [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]


def keyed(text: bytes) -> list[tuple[str, int, int]]:
    return [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS] + [("hex", *m.span()) for m in _HEX.finditer(text)]


def _transitions(words: list[bytes], weights: float = 1.0) -> np.ndarray:
    counts = np.zeros((START + 1, START))
    for w in words:
        c = _CODE[np.frombuffer(w, np.uint8)]
        if len(c) and (c >= 0).all():
            np.add.at(counts, (np.concatenate(([START], c[:-1])), c), weights)
    return counts


def _logs(counts: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Logarithms of smoothed shares, mixed with UNSEEN of any character."""
    return np.log((1 - UNSEEN) * (counts + prior) / (counts + prior).sum(axis=1, keepdims=True) + UNSEEN / START)


def llr(word: bytes, random: np.ndarray, ordinary: np.ndarray) -> float:
    """Log-likelihood ratio of the mixture of random models to the ordinary one."""
    c = _CODE[np.frombuffer(word, np.uint8)]
    before = np.concatenate(([START], c[:-1]))
    each = random[:, before, c].sum(axis=1)
    top = each.max()
    return float(top + np.log(np.exp(each - top).mean()) - ordinary[before, c].sum())


def _alphabet(word: bytes) -> int | None:
    """The first alphabet that has all characters of a word but those that pad it."""
    for k, alphabet in enumerate(ALPHABETS):
        if not word.rstrip(b"=").strip(alphabet):
            return k
    return None


def identifiers(words: list[bytes], n: int, rng: np.random.Generator) -> list[bytes]:
    """Names, paths and numbers of LEAST_RUN bytes or more, made of words."""
    out = []
    while len(out) < n:
        some = [words[i] for i in rng.integers(0, len(words), int(rng.integers(1, 6)))]
        number = b"%d" % rng.integers(0, 10 ** int(rng.integers(1, 5)))
        form = int(rng.integers(8))
        made = (
            b"_".join(some), b"-".join(some), b"/".join([b"", *some]), some[0] + b"".join(w.capitalize() for w in some[1:]), b"_".join(w.upper() for w in some), b"-".join([*some, number]),
            b"".join(b"%d" % x for x in rng.integers(0, 10, int(rng.integers(16, 40)))), bytes([_SYMBOLS[int(rng.integers(START - 1))]]) * int(rng.integers(16, 60)),
        )[form]
        made = b"_".join([made] * (1 + LEAST_RUN // max(1, len(made)))) if len(made) < LEAST_RUN else made
        out.append(made)
    return out


#: Ordinary words that names in programs are made of, for tables without words.
_PLAIN = b"get set list name value user file path data index count total item page line text code type test main size key map node time date first last next open close read write".split()


def train(words: list[bytes], secrets: list[bytes]) -> tuple[np.ndarray, np.ndarray, float]:
    """The random models, the ordinary one and the threshold of the mean."""
    rng = np.random.default_rng(13)
    drawn = [[bytes(rng.choice(np.frombuffer(a, np.uint8), int(rng.integers(16, 48))).tolist()) for _ in range(DRAWN)] for a in ALPHABETS]
    for s in secrets:
        if (k := _alphabet(s)) is not None:
            drawn[k].append(s.rstrip(b"="))
    random = []
    for alphabet, found in zip(ALPHABETS, drawn):
        prior = np.full(START, 1e-3)
        prior[_CODE[np.frombuffer(alphabet, np.uint8)]] = 1.0
        random.append(_logs(_transitions(found), prior))
    kept = [w for w in words if zlib.crc32(w) % 3]
    held = [w for w in words if not zlib.crc32(w) % 3]
    ordinary = kept + _PLAIN + identifiers([w for w in kept if len(w) < LEAST_RUN] + _PLAIN, MADE, rng)
    table = _logs(_transitions(ordinary), np.full(START, 0.05))
    held = [w for w in held if _RUN.fullmatch(w)] + identifiers([w for w in held if len(w) < LEAST_RUN] + _PLAIN, MADE, rng)
    scores = np.sort([llr(w, np.array(random), table) / len(w) for w in held])
    return np.array(random), table, float(scores[min(len(scores) - 1, int(np.ceil(len(scores) * (1 - RATE))))])


def looks_random(word: bytes, random: np.ndarray, ordinary: np.ndarray, least: float) -> bool:
    score = llr(word, random, ordinary)
    return score >= np.log(ODDS) and score > least * len(word)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of a batch, 1: values that base patterns find, 0: runs outside of them, but for long ones with more than letters, of which nobody says what they are."""
    for batch in batches:
        found: set[tuple[bytes, int]] = set()
        for text in batch.column(0).to_pylist():
            text, at = (text or "").encode(), 0
            spans = [(m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE] + [(a, b) for _, a, b in keyed(text)]
            rest = []
            for a, b in sorted(spans):
                found.add((text[a:b], 1))
                rest.append(text[at:a])
                at = max(at, b)
            others = re.findall(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{3,}+(?![\x80-\xff])", b" ".join([*rest, text[at:]]))
            found |= {(w, 0) for w in others if len(w) < LEAST_RUN or w.isalpha()}
        pairs = [(w, y) for w, y in found if len(w) <= LONGEST_WORD]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in pairs], pa.binary()), pa.array([y for _, y in pairs], pa.int32())], ["word", "label"])


def sample(docs: DataFrame, text: str) -> DataFrame:
    """At most SAMPLE_WORDS distinct words of each label: word, label."""
    texts = docs.select(F.col(f"`{text}`").cast("string").alias("t")).where("t <> ''").withColumn("h", F.xxhash64("t"))
    last = texts.select("h").distinct().orderBy("h").limit(SAMPLE_TEXTS).agg(F.max("h")).first()[0]
    small_batches(docs.sparkSession)
    words = texts.where(F.col("h") <= F.lit(last)).select("t").mapInArrow(_labelled, "word binary, label int").distinct()
    # a word that stands in both places, as a name that was given as a value, counts as ordinary
    words = words.groupBy("word").agg(F.min("label").alias("label"))
    parts = [words.where(F.col("label") == y).orderBy(F.xxhash64("word"), "word").limit(SAMPLE_WORDS) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def models(docs: DataFrame, text: str = "text") -> list[np.ndarray]:
    """The random models, the ordinary one and the threshold, fitted on the sample of docs."""

    def fit(examples: pa.Table) -> list[np.ndarray]:
        rows = list(zip(examples.column("word").to_pylist(), examples.column("label").to_pylist()))
        random, ordinary, least = train([w for w, y in rows if not y], [w for w, y in rows if y])
        return [random, ordinary, np.array([least])]

    return fitted(sample(docs, text), ["label", "word"], fit)


def _taken(spans: list[tuple[str, int, int]], n: int) -> np.ndarray:
    """total[b] - total[a]: places of a to b, of n, that lie in a span."""
    step, total = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    np.add.at(step, [a for _, a, _ in spans], 1)
    np.add.at(step, [b for _, _, b in spans], -1)
    np.cumsum(np.cumsum(step[:-1]) > 0, out=total[1:])
    return total


def spans_of(texts: pa.Array, fit: list[np.ndarray]) -> list[tuple[list, list]]:
    """For each text its base spans and its added ones, in code points."""
    random, ordinary, least = fit[0], fit[1], float(fit[2][0])
    out: list[tuple[list, list]] = [([], []) for _ in range(len(texts))]
    for chunk in _words.chunks(texts, _OUTSIDE):
        raw, low = chunk.buf.tobytes(), _words.LOWER[chunk.buf].tobytes()
        base: dict[int, list] = {}
        for name in _NAMES:
            at = low.find(name)
            while at >= 0:
                base.setdefault(int(np.searchsorted(chunk.off, at, "right")) - 1, [])
                at = low.find(name, at + 1)
        base = {i: assigned(raw[chunk.off[i] : chunk.off[i + 1]]) for i in base}
        long = np.flatnonzero(chunk.end - chunk.start >= LEAST_RUN)
        runs: dict[int, list] = {}
        for k in long.tolist():
            i = int(chunk.doc[k])
            a = int(chunk.off[i])
            start, word = int(chunk.start[k]) - a, raw[chunk.start[k] : chunk.end[k]]
            keys = [(kind, start + x, start + y) for kind, x, y in keyed(word)] if len(word) >= LEAST_ACCESS else []
            if keys:
                base.setdefault(i, []).extend(keys)
            runs.setdefault(i, []).extend((start + m.start(), start + m.end(), m[0]) for m in _RUN.finditer(word) if not _UUID.match(m[0]))
        for i in base.keys() | runs.keys():
            text, spans = raw[chunk.off[i] : chunk.off[i + 1]], base.get(i, [])
            taken = _taken(spans, len(text)) if spans else None
            added = [("random", a, b) for a, b, w in runs.get(i, ()) if (taken is None or taken[a] == taken[b]) and looks_random(w, random, ordinary, least) and not _beside(text, a, b)]
            if spans or added:
                count = np.concatenate(([0], np.cumsum(~_words.CONTINUATION[np.frombuffer(text, np.uint8)])))
                out[chunk.first + i] = tuple([(kind, int(count[a]), int(count[b])) for kind, a, b in found] for found in (spans, added))
    return out


def _beside(text: bytes, a: int, b: int) -> bool:
    """Whether a letter or digit of another script touches text[a:b]."""
    return (a > 0 and text[a - 1] >= 0x80 and text[max(0, a - 4) : a].decode(errors="ignore")[-1:].isalnum()) or (b < len(text) and text[b] >= 0x80 and text[b : b + 4].decode(errors="ignore")[:1].isalnum())


def _listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


FOUND = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def scanned(docs: DataFrame, kept: list[str], text: str = "text") -> DataFrame:
    """The kept columns of docs, the numbers of base spans, a digest of them, and all spans."""
    fit = models(docs, text)

    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for base, added in spans_of(texts, fit):
            kinds = [k for k, _, _ in base]
            rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(base + added)))
        names = [x.split()[0] for x in FOUND.split(", ")]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i < 3 else pa.string()) for i in range(5)], names)

    return map_texts(docs, text, kept, run, FOUND)


def op13_secrets(spark, sf_dir: str) -> DataFrame:
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
