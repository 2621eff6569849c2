"""Substring deduplication with suffix automata of routed reference shards (operator 9).

A window is WINDOW consecutive words of one text. Words covered by a window whose word sequence
also starts anywhere else are removed.

One automaton of a shard of the corpus, broadcast to all texts, would mean as many passes over the
corpus as it has shards. So references are routed instead: each window is named by its minimizer,
the least hash among its GRAM-word grams, which equal windows share. Minimizers met once cannot
repeat. Around the others, the runs of windows that share a minimizer are cut out as contexts, equal
contexts are counted by partial aggregation, and the distinct contexts of a minimizer are one shard.
Its suffix automaton counts every word sequence of the shard; the contexts are streamed over it for
matching statistics, and windows that end in a state met twice or more are repeated. Spans return to
their texts by join. Texts of one word sequence are one text with a count from the start.

Defined results: null text has no words; texts shorter than WINDOW words lose nothing. Repeated
rows are elsewhere for each other, so all their windows repeat. An empty table gives an empty
result; only key and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import _words
from docloom.llm._shared import bit_filter, partitions, passes, small_batches, written

WINDOW = 35
GRAM = 8
FLUSH = 400_000
_PLACE_BITS = np.uint64(28)
_POSTING = np.dtype([("key", "<u8"), ("uid", "<i8"), ("s", "<u4"), ("r", "<u4")])


def text_ids(chunk: _words.Chunk, h: np.ndarray) -> np.ndarray:
    """A 64-bit name of each text's word sequence."""
    return chunk.sequence_hashes(h, np.arange(chunk.n)).view(np.int64)


def minimizers(chunk: _words.Chunk, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number and minimizer of the runs of windows of one text that choose the same gram."""
    empty = np.zeros(0, np.int64)
    if len(h) < WINDOW:
        return empty, empty, np.zeros(0, np.uint64)
    at, window = chunk.windows(h, GRAM)
    gram = np.full(len(h), np.iinfo(np.uint64).max, np.uint64)
    gram[at] = window
    places = np.arange(len(h), dtype=np.uint64) & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))
    least = (gram >> _PLACE_BITS << _PLACE_BITS) | places  # of equal hashes the first place
    width, span = WINDOW - GRAM + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    least = np.minimum(least[: len(h) - WINDOW + 1], least[width - span : width - span + len(h) - WINDOW + 1])
    starts = np.flatnonzero(chunk.doc[WINDOW - 1 :] == chunk.doc[: len(h) - WINDOW + 1])
    if not len(starts):
        return empty, empty, np.zeros(0, np.uint64)
    low = int((1 << int(_PLACE_BITS)) - 1)
    place = (least[starts] & np.uint64(low)).astype(np.int64)
    place = starts + ((place - starts) & low)
    cut = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1) | (chunk.doc[starts[1:]] != chunk.doc[starts[:-1]])))
    return starts[cut], np.diff(np.append(cut, len(starts))), gram[place[cut]]


def _poster(buckets: int):
    def blobs(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        bucket = (_words.mix(rows["key"]) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array([b"".join(rows[c][a:b].tobytes() for c in _POSTING.names) for a, b in zip(cuts, np.append(cuts[1:], len(rows)))], pa.binary())], ["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, seen = [], 0, set()
        for batch in batches:
            for chunk in _words.chunks(batch.column("text")):
                h = chunk.word_hashes()
                uid = text_ids(chunk, h)
                s, r, key = minimizers(chunk, h)
                text = chunk.doc[s] if len(s) else s
                fresh = np.zeros(chunk.n, bool)
                for i, x in enumerate(uid.tolist()):
                    if x not in seen:
                        fresh[i] = True
                        seen.add(x)
                if len(seen) > 500_000:
                    seen = set()
                keep = fresh[text] if len(s) else np.zeros(0, bool)
                p = np.zeros(int(keep.sum()), _POSTING)
                p["key"], p["uid"], p["s"], p["r"] = key[keep], uid[text[keep]], (s - chunk.word_off[text])[keep], r[keep]
                held.append(p)
                count += len(p)
                if count >= FLUSH:
                    yield blobs(held)
                    held, count = [], 0
        if count:
            yield blobs(held)

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings whose minimizer stands at two places or more."""
    held = []
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            n, at = len(blob) // _POSTING.itemsize, 0
            p = np.zeros(n, _POSTING)
            for c in _POSTING.names:
                p[c] = np.frombuffer(blob, _POSTING[c], n, at)
                at += n * _POSTING[c].itemsize
            held.append(p)
    if not held:
        return
    rows = np.concatenate(held)
    del held
    rows = rows[np.lexsort((rows["s"], rows["uid"], rows["key"]))]
    new_key = np.append(True, rows["key"][1:] != rows["key"][:-1])
    fresh = new_key | np.append(True, (rows["uid"][1:] != rows["uid"][:-1]) | (rows["s"][1:] != rows["s"][:-1]))
    rows, new_key = rows[fresh], new_key[fresh]
    starts = np.flatnonzero(new_key)
    many = np.repeat(np.diff(np.append(starts, len(rows))) > 1, np.diff(np.append(starts, len(rows))))
    rows = rows[many]
    for at in range(0, len(rows), 50_000):
        part = rows[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part["key"].view(np.int64)), pa.array(part["uid"]), pa.array(part["s"].astype(np.int64)), pa.array(part["r"].astype(np.int64))], ["key", "uid", "s", "r"])


def _with_ids(keep: bytes | None, texts_too: bool = False):
    """key, uid, n words, and of texts that the filter lets through the text; of others the digest of their words, with these if texts_too. Without a filter only key, uid and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for chunk in _words.chunks(batch.column("text")):
                uid.append(text_ids(chunk, chunk.word_hashes()))
                n.append(chunk.counts)
            uid, n = np.concatenate(uid), np.concatenate(n)
            if keep is not None:
                texts = batch.column("text").to_pylist()
                ok = passes(keep, uid)
                words = [None if o else b" ".join((t or "").encode().split()) for t, o in zip(texts, ok.tolist())]
                sha = [None if w is None else hashlib.sha256(w).hexdigest() for w in words]
                texts = [t if w is None else w.decode() if texts_too else None for t, w in zip(texts, words)]
            else:
                texts = sha = [None] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(uid), pa.array(n), pa.array(texts, pa.string()), pa.array(sha, pa.string())], ["key", "uid", "n", "text", "sha"])

    return run


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for uid, text, runs in zip(batch.column("uid").to_pylist(), batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
            words = text.encode().split()
            for x in runs:
                out.append((x["key"], uid, x["s"], b" ".join(words[x["s"] : x["s"] + x["r"] + WINDOW - 1]).decode()))
        for at in range(0, len(out), 5000):
            part = out[at : at + 5000]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in part], pa.int64()) for i in range(3)), pa.array([r[3] for r in part], pa.string())], ["key", "uid", "s", "context"])


class SuffixAutomaton:
    """All word sequences of some texts, with the number of places where each starts."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        self.last = 0

    def _add(self, symbol: int, weight: int) -> None:
        new, at = len(self.next), self.last
        self.next.append({})
        self.length.append(self.length[at] + 1)
        self.link.append(0)
        self.count.append(weight)
        while at >= 0 and symbol not in self.next[at]:
            self.next[at][symbol] = new
            at = self.link[at]
        if at >= 0:
            there = self.next[at][symbol]
            if self.length[there] == self.length[at] + 1:
                self.link[new] = there
            else:
                twin = len(self.next)
                self.next.append(dict(self.next[there]))
                self.length.append(self.length[at] + 1)
                self.link.append(self.link[there])
                self.count.append(0)
                while at >= 0 and self.next[at].get(symbol) == there:
                    self.next[at][symbol] = twin
                    at = self.link[at]
                self.link[there] = self.link[new] = twin
        self.last = new

    def add_text(self, symbols: list[int], weight: int) -> None:
        """symbols must end in one that no other text has."""
        for x in symbols:
            self._add(x, weight)

    def finish(self) -> None:
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] >= 0:
                self.count[self.link[state]] += self.count[state]

    def repeated(self, symbols: list[int], size: int) -> list[bool]:
        """For each run of `size` symbols: whether it starts at two places or more."""
        out, state, matched = [], 0, 0
        for i, x in enumerate(symbols):
            while state and x not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if x in self.next[state]:
                state, matched = self.next[state][x], matched + 1
            while state and self.length[self.link[state]] >= size:
                state = self.link[state]
            matched = min(matched, self.length[state])
            if i >= size - 1:
                out.append(matched >= size and self.count[state] > 1)
        return out


def repeated_windows(contexts: list[str], counts: list[int], size: int = WINDOW) -> list[list[bool]]:
    """For distinct contexts with their counts: which of their windows start at two places or more among all."""
    if len(contexts) == 1 and counts[0] == 1:
        words = contexts[0].split(" ")
        if len({tuple(words[i : i + size]) for i in range(len(words) - size + 1)}) == len(words) - size + 1:
            return [[False] * (len(words) - size + 1)]
    if all(c > 1 for c in counts):
        return [[True] * (c.count(" ") + 2 - size) for c in contexts]
    names: dict[str, int] = {}
    texts = [[names.setdefault(w, len(names)) for w in c.split(" ")] for c in contexts]
    automaton = SuffixAutomaton()
    for i, (symbols, count) in enumerate(zip(texts, counts)):
        automaton.add_text([*symbols, -1 - i], count)
    automaton.finish()
    return [[True] * (len(s) + 1 - size) if c > 1 else automaton.repeated(s, size) for s, c in zip(texts, counts)]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, ctx, first and number of repeated windows in a row. Rows come sorted by key."""
    held, current, out = [], None, []

    def close() -> None:
        for (_, ctx, _, _), marks in zip(held, repeated_windows([x[2] for x in held], [x[3] for x in held])):
            step = np.diff(np.array([False, *marks, False], np.int8))
            out.extend((current, ctx, int(a), int(b - a)) for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1)))

    def taken() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], ["key", "ctx", "lo", "m"])
        out.clear()
        return batch

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "ctx", "context", "c"))):
            if held and row[0] != current:
                close()
                held = []
            current = row[0]
            held.append(row)
        if len(out) > 20_000:
            yield taken()
    if held:
        close()
    yield taken()


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, text, spans, all_of in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("spans").to_pylist(), batch.column("every").to_pylist()):
            words = (text or "").encode().split()
            gone = np.zeros(len(words), bool)
            if all_of and len(words) >= WINDOW:
                gone[:] = True
            for x in spans or ():
                gone[x["a"] : x["b"]] = True
            rows.append((key, len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist()) if not g)))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3].decode() for r in rows], pa.string())], ["key", "n_words", "n_removed", "kept_text"])


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", texts: bool = True) -> DataFrame:
    """A row for each input row: key, n_words, n_removed, kept_sha256, and kept_text if texts."""
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark)
    docs = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = f"key {docs.schema['key'].dataType.simpleString()}, uid long, n long, text string, sha string"
    posted = docs.select("text").mapInArrow(_poster(8 * n), "bucket int, blob binary").repartition(n, "bucket").select("blob")
    runs = written(posted.mapInArrow(_repeated, "key long, uid long, s long, r long"), "runs")
    per_text = runs.groupBy("uid").agg(F.collect_list(F.struct("key", "s", "r")).alias("runs"))  # as long as one text
    candidates = docs.mapInArrow(_with_ids(bit_filter(runs, "uid")), schema).where("text IS NOT NULL").select("uid", "text")
    contexts = per_text.join(candidates.dropDuplicates(["uid"]), "uid").mapInArrow(_contexts, "key long, uid long, s long, context string")
    contexts = written(contexts.withColumn("ctx", F.xxhash64("context")), "contexts")
    distinct = contexts.groupBy("key", "ctx", "context").agg(F.count("*").alias("c"))
    marks = distinct.repartition(n, "key").sortWithinPartitions("key", "ctx").mapInArrow(_shards, "key long, ctx long, lo long, m long")
    spans = contexts.select("key", "ctx", "uid", "s").join(marks, ["key", "ctx"])
    spans = spans.select("uid", F.struct((F.col("s") + F.col("lo")).alias("a"), (F.col("s") + F.col("lo") + F.col("m") + WINDOW - 1).alias("b")).alias("x"))
    spans = written(spans.groupBy("uid").agg(F.collect_list("x").alias("spans")), "spans")  # as long as one text
    named = docs.mapInArrow(_with_ids(None), schema).select("uid", "n")
    copies = written(named.groupBy("uid").agg(F.count("*").alias("c"), F.max("n").alias("n")).where(f"c > 1 AND n >= {WINDOW}").select("uid", F.lit(True).alias("every")), "copies")
    hit = written(spans.join(copies, "uid", "full"), "hits")
    rows = docs.mapInArrow(_with_ids(bit_filter(hit, "uid"), texts), schema)
    plain = rows.where("sha IS NOT NULL").select("key", F.col("n").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), F.col("text").alias("kept_text"))
    cut = rows.where("sha IS NULL").join(hit, "uid", "left").select("key", "text", "spans", "every")
    cut = cut.mapInArrow(_removed, schema.split(",")[0] + ", n_words long, n_removed long, kept_text string")
    out = plain.unionByName(cut.withColumn("kept_sha256", F.sha2(F.encode("kept_text", "UTF-8"), 256)))
    return out.select(F.col("key").alias(key), "n_words", "n_removed", "kept_sha256", *(["kept_text"] if texts else []))


def op9_substring(spark, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), texts=False)


def op9_sql(table: str = "documents") -> str:
    return rf"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {table}),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW})),
t AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM s) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM t, range({WINDOW}) AS r(k)),
g AS (SELECT doc_id, count(*) AS n, list(i) AS l FROM gone GROUP BY doc_id),
u AS (SELECT w.doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
kept AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.i) AS t FROM u LEFT JOIN gone ON gone.doc_id = u.doc_id AND gone.i = u.i WHERE gone.i IS NULL GROUP BY u.doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)"""
