"""Phrase collocations by hierarchical pair naming (operator 11).

Words are counted per language, and frequent ones get an id. Level by level, each place of a text
holds the id of the frequent (k-1)-gram that starts there, if any; adjacent ids are a pair, pairs are
counted over all texts, and frequent ones become k-grams with an id of their own. A k-gram's pair are
its parents: its first k-1 words and its last k-1. Followed down, they give the frequencies of both
sides of every cut; followed up, they say which longer candidates hold it. A longer candidate that
occurs as often as one of its parts makes all between them as frequent, so the next level is enough
to look at.

Texts are kept as slices: the words of some SLICE_BYTES of texts as numbers into the slice's own list of
names. Only names move: a slice counts its distinct words or pairs and offers them, packed, to the
buckets that their hashes name; a bucket adds all offers up, names what is frequent and tells each
slice the ids of those that it offered; the slice, joined with what it was told, puts the ids in their
places. So a word or pair that stands everywhere is one entry for each slice, and there are as many
buckets as keep a bucket at the size of some slices. Words and pairs are compared whole, never by hash.

Defined results: null text counts as empty; null lang as `und`, together with the texts of that
language. Texts without words add nothing, and a table without candidates gives an empty result.
Repeated rows each count. Ties of score are ordered by frequency, then by the phrase's UTF-8 bytes.
A text is never cut, so a very long one is a slice of its own. Further columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm import _words
from docloom.llm._shared import new_folder, partitions, remove, small_batches, written

LEAST, LONGEST, TOP, FACTOR = 100, 5, 2000, 1000
#: Bytes of text of a slice: what one task holds at once, unless one text is longer.
SLICE_BYTES = 1 << 22

_SEPARATES = np.zeros(256, bool)
_SEPARATES[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = True
_BLANK = _SEPARATES.copy()
_BLANK[[0x20, 0x09]] = True

#: Slices whose offers a bucket holds, in the mean.
SLICES_A_BUCKET = 4

SLICES = "slice long, tongues array<string>, sums array<long>, langs array<int>, words array<string>, counts array<long>, gaps binary, codes binary"
NAMED = "slice long, ids binary, gaps binary, codes binary"


def _packed(*arrays: np.ndarray) -> bytes:
    """Integer arrays of one length, their bytes by significance, compressed."""
    return zstandard.compress(b"".join(np.ascontiguousarray(a, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays), 1)


def _unpacked(data: bytes, n: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(n, 8, -1)
    return [np.ascontiguousarray(part.T).view(np.int64).ravel() for part in raw]


def _words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All lower-cased words, the text of each, and whether it follows the word before it in one piece."""
    words, of, joined = [], [], []
    for chunk in _words.chunks(texts, _BLANK, _words.LOWER):
        inside = ~_BLANK[chunk.buf]
        sizes = np.concatenate(([0], np.cumsum(chunk.end - chunk.start)))
        words.append(pa.LargeStringArray.from_buffers(len(chunk.start), pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(_words.LOWER[chunk.buf[inside]])))
        breaks = np.concatenate(([0], np.cumsum(_SEPARATES[chunk.buf])))
        follows = np.zeros(len(chunk.start), bool)
        follows[1:] = (chunk.doc[1:] == chunk.doc[:-1]) & (breaks[chunk.start[1:]] == breaks[chunk.end[:-1]])
        of.append(chunk.doc + chunk.first)
        joined.append(follows)
    if not words:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, bool)
    return pa.concat_arrays(words), np.concatenate(of), np.concatenate(joined)


def _slice(batches: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
    """One row of SLICES. tongues, sums: its languages and their numbers of words; gaps: 1 where a word follows the one before in one piece, else 2; codes: its number among the words."""
    table = pa.Table.from_batches(batches)
    langs = table.column("lang").combine_chunks().dictionary_encode()
    words, of, follows = _words_of(table.column("text"))
    words = words.dictionary_encode()
    kinds = max(1, len(words.dictionary))
    both = langs.indices.to_numpy().astype(np.int64)[of] * kinds + words.indices.to_numpy().astype(np.int64)
    distinct, codes, counts = np.unique(both, return_inverse=True, return_counts=True)
    often = np.argsort(-counts, kind="stable")  # small numbers for what is frequent keep slices small
    place = np.empty(len(often), np.int64)
    place[often] = np.arange(len(often))
    distinct, counts = distinct[often], counts[often]
    sums = np.zeros(len(langs.dictionary), np.int64)
    np.add.at(sums, distinct // kinds, counts)
    lists = [langs.dictionary, pa.array(sums), pa.array((distinct // kinds).astype(np.int32)), words.dictionary.take(pa.array(distinct % kinds)).cast(pa.string()), pa.array(counts.astype(np.int64))]
    held = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
    packed = [pa.array([_packed(x)], pa.binary()) for x in (np.where(follows, 1, 2), place[codes])]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *held, *packed], [x.split()[0] for x in SLICES.split(", ")])


def slices(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """SLICES of the texts. A slice's number holds its task's, and is kept with what the task wrote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                length = len(one.column("text")[0].as_buffer() or b"") if one.column("text")[0].is_valid else 0
                if held and size + length > SLICE_BYTES:
                    yield _slice(held, number)
                    held, size, number = [], 0, number + 1
                held.append(one)
                size += length
        if held:
            yield _slice(held, number)

    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).where("text <> ''")
    return rows.mapInArrow(run, SLICES)


def _hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _words.mix(left.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ _words.mix(right.view(np.uint64)))


def _dealt(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that has any, and which they are, in ascending order."""
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for a, b in zip(at, [*at[1:], len(order)]):
        yield int(bucket[order[a]]), order[a:b]


OFFERED_WORDS = "bucket long, slice long, tongues array<string>, numbers binary, letters binary"
OFFERED_PAIRS = "bucket long, slice long, numbers binary"
#: A row without slice is a frequent word or pair; one with a slice tells it, packed, which of its own have which ids.
NAMED_WORDS = "slice long, told binary, id long, lang string, word string, f long"
NAMED_PAIRS = "slice long, told binary, id long, l long, r long, f long"


def _word_offers(cut: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                number, tongues, langs, words, counts = (batch.column(c)[row] for c in ("slice", "tongues", "langs", "words", "counts"))
                words, langs, counts = words.values, langs.values.to_numpy(), counts.values.to_numpy()
                hashes = [c.word_hashes() for c in _words.chunks(words, _BLANK)]
                for bucket, at in _dealt(np.concatenate(hashes), buckets) if hashes else ():
                    some = words.take(pa.array(at)).cast(pa.binary())
                    numbers = _packed(langs[at], pc.binary_length(some).to_numpy(), counts[at], np.diff(at, prepend=0))
                    yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([number.as_py()]), pa.array([tongues.as_py()], pa.list_(pa.string())), pa.array([numbers], pa.binary()), pa.array([zstandard.compress(b"".join(some.to_pylist()), 1)], pa.binary())], [x.split()[0] for x in OFFERED_WORDS.split(", ")])

    return cut.select("slice", "tongues", "langs", "words", "counts").mapInArrow(run, OFFERED_WORDS)


def _told(slices_: np.ndarray, of: np.ndarray, at: np.ndarray, ids: np.ndarray) -> tuple[list, list]:
    """Slices and what each is told; of: which of slices_ an entry is from, ascending."""
    edges = np.searchsorted(of, np.arange(len(slices_) + 1))
    rows = [(int(slices_[k]), _packed(np.diff(at[a:b], prepend=0), ids[a:b])) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if a < b]
    return [r[0] for r in rows], [r[1] for r in rows]


def _named_rows(names: list[str], told: tuple[list, list], columns: list[pa.Array]) -> pa.Table:
    """What slices are told, then the frequent names (id and its columns)."""
    n, m = len(told[0]), len(columns[0])
    first = [pa.array([*told[0], *[None] * m], pa.int64()), pa.array([*told[1], *[None] * m], pa.binary())]
    return pa.Table.from_arrays([*first, *[pa.concat_arrays([pa.nulls(n, c.type), c]) for c in columns]], names)


def _word_names(least: int):
    names = [x.split()[0] for x in NAMED_WORDS.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        langs, words, counts, at, of = [], [], [], [], []
        for k, row in enumerate(table.select(["tongues", "numbers", "letters"]).to_pylist()):
            lang, size, count, step = _unpacked(row["numbers"], 4)
            langs.append(pa.array(row["tongues"], pa.string()).take(pa.array(lang)))
            offsets = np.concatenate(([0], np.cumsum(size)))
            words.append(pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(zstandard.decompress(row["letters"]))))
            counts.append(count)
            at.append(np.cumsum(step))
            of.append(np.full(len(size), k))
        langs, words = pa.concat_arrays(langs).dictionary_encode(), pa.concat_arrays(words).dictionary_encode()
        both = langs.indices.to_numpy().astype(np.int64) * len(words.dictionary) + words.indices.to_numpy()
        distinct, which = np.unique(both, return_inverse=True)
        sums = np.zeros(len(distinct), np.int64)
        np.add.at(sums, which, np.concatenate(counts))
        often = np.flatnonzero(sums >= least)
        ids = np.full(len(distinct), -1, np.int64)
        ids[often] = (table.column("bucket")[0].as_py() << 32) + np.arange(len(often))
        kept = np.flatnonzero(ids[which] >= 0)
        told = _told(table.column("slice").to_numpy(), np.concatenate(of)[kept], np.concatenate(at)[kept], ids[which[kept]])
        return _named_rows(names, told, [pa.array(ids[often]), langs.dictionary.take(pa.array(distinct[often] // len(words.dictionary))), words.dictionary.take(pa.array(distinct[often] % len(words.dictionary))).cast(pa.string()), pa.array(sums[often])])

    return run


def _pairs(ids: bytes, gaps: bytes, codes: bytes) -> tuple[np.ndarray, ...]:
    """Of a row of NAMED: the distinct pairs of adjacent ids with their counts, the places (in codes) of each pair's first, which pair stands there, and the gaps."""
    (ids,), (gaps,), (codes,) = (_unpacked(x, 1) for x in (ids, gaps, codes))
    at = np.flatnonzero(gaps[1:] == 1)
    distinct, which, counts = np.unique(codes[at] * max(1, len(ids)) + codes[at + 1], return_inverse=True, return_counts=True)
    left, right = np.divmod(distinct, max(1, len(ids)))
    return ids[left], ids[right], counts, at, which, gaps


def _pair_offers(named: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, gaps, codes in zip(*(batch.column(c).to_pylist() for c in ("slice", "ids", "gaps", "codes"))):
                left, right, counts, _, _, _ = _pairs(ids, gaps, codes)
                rows = [(bucket, _packed(left[at], right[at], counts[at], np.diff(at, prepend=0))) for bucket, at in _dealt(_hash(left, right), buckets)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([number] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "slice", "numbers"])

    return named.mapInArrow(run, OFFERED_PAIRS)


def _pair_names(least: int):
    names = [x.split()[0] for x in NAMED_PAIRS.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        offers = [_unpacked(x, 4) for x in table.column("numbers").to_pylist()]
        left, right, counts, _ = (np.concatenate(x) for x in zip(*offers))
        at, of = np.concatenate([np.cumsum(x[3]) for x in offers]), np.repeat(np.arange(len(offers)), [len(x[0]) for x in offers])
        order = np.lexsort((right, left))
        new = np.flatnonzero((np.diff(left[order], prepend=-1) != 0) | (np.diff(right[order], prepend=-1) != 0))
        sums = np.add.reduceat(counts[order], new)
        often = np.flatnonzero(sums >= least)
        ids = np.full(len(new), -1, np.int64)
        ids[often] = (table.column("bucket")[0].as_py() << 32) + np.arange(len(often))
        each = np.empty(len(order), np.int64)
        each[order] = np.repeat(ids, np.diff(np.append(new, len(order))))
        kept = np.flatnonzero(each >= 0)
        told = _told(table.column("slice").to_numpy(), of[kept], at[kept], each[kept])
        first = order[new[often]]
        return _named_rows(names, told, [pa.array(ids[often]), pa.array(left[first]), pa.array(right[first]), pa.array(sums[often])])

    return run


def _renamed(pairs: bool):
    """A slice under the ids that its words or pairs (right: rows of told) got; without a row where none did."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        told = [_unpacked(x, 2) for x in right.column("told").to_pylist()]
        rows = []
        for row in left.to_pylist() if told else []:
            at, ids = np.concatenate([np.cumsum(x[0]) for x in told]), np.concatenate([x[1] for x in told])
            if pairs:
                l, _, _, places, which, gaps = _pairs(row["ids"], row["gaps"], row["codes"])
                n = len(l)
            else:
                (gaps,), (which,) = _unpacked(row["gaps"], 1), _unpacked(row["codes"], 1)
                places, n = np.arange(len(which)), int(which.max()) + 1
            order = np.argsort(at)
            new = np.full(n, -1, np.int64)
            new[at[order]] = np.arange(len(at))
            code = new[which]
            kept = np.flatnonzero(code >= 0)
            here = np.cumsum(gaps)[places[kept]]
            steps = np.minimum(np.diff(here, prepend=here[:1] - 2), 2)  # further than 1 is apart, however far
            rows.append((row["slice"], _packed(ids[order]), _packed(steps), _packed(code[kept])))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i == 0 else pa.binary()) for i in range(4)], ["slice", "ids", "gaps", "codes"])

    return run


def _back(texts: DataFrame, names: DataFrame, pairs: bool) -> DataFrame:
    """NAMED: the slices under their new ids."""
    kept = ["slice", "ids", "gaps", "codes"] if pairs else ["slice", "gaps", "codes"]
    told = names.where("slice IS NOT NULL").select("slice", "told").toDF("of", "told")
    return texts.select(*kept).groupBy("slice").cogroup(told.groupBy("of")).applyInArrow(_renamed(pairs), NAMED)


def grams(docs: DataFrame, text: str, lang: str, least: int, longest: int) -> tuple[list[DataFrame], DataFrame]:
    """Frequent words (id, lang, word, f), then for 2 to `longest` words the frequent pairs (id, l, r, f); and the number of words (lang, n)."""
    spark, last = docs.sparkSession, new_folder(docs.sparkSession, "slices")
    cut = written(slices(docs, text, lang), "slices", path=last)
    total = cut.select(F.explode(F.arrays_zip("tongues", "sums")).alias("x")).groupBy(F.col("x.tongues").alias("lang")).agg(F.sum("x.sums").alias("n"))
    total = written(total, "totals")
    buckets = max(partitions(docs.sparkSession), cut.count() // SLICES_A_BUCKET)
    names = written(_word_offers(cut, buckets).groupBy("bucket").applyInArrow(_word_names(least), NAMED_WORDS), "words", release=True)
    levels = [names.where("slice IS NULL").select("id", "lang", "word", "f")]
    named, last = _replaced(spark, _back(cut, names, False), last, "named-1")
    for k in range(2, longest + 1):
        names = written(_pair_offers(named, buckets).groupBy("bucket").applyInArrow(_pair_names(least), NAMED_PAIRS), f"pairs-{k}", release=True)
        levels.append(names.where("slice IS NULL").select("id", "l", "r", "f"))
        if k < longest:
            named, last = _replaced(spark, _back(named, names, True), last, f"named-{k}")
    return levels, total


def _replaced(spark: SparkSession, texts: DataFrame, last: str, label: str) -> tuple[DataFrame, str]:
    """texts, written, and its folder; the table in the folder `last`, which it was made of, is removed."""
    path = new_folder(spark, label)
    out = written(texts, label, release=True, path=path)
    remove(spark, last)
    return out, path


def phrases(levels: list[DataFrame]) -> DataFrame:
    """lang, phrase, a, and heads and tails of frequent phrases of two words or more, without those that a longer one holds as often.

    heads[j], tails[j]: how often its first and its last j + 1 words occur.
    """
    none = F.array().cast("array<long>")
    below = levels[0].select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("heads"), none.alias("tails"))
    out = None
    for k, level in enumerate(levels[1:], 1):
        first = below.select(F.col("id").alias("l"), "lang", "phrase", F.concat("heads", F.array("f")).alias("heads"))
        rest = below.select(F.col("id").alias("r"), "last", F.concat("tails", F.array("f")).alias("tails"))
        joined = level.join(first, "l").join(rest, "r").select("id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f", "heads", "tails")
        below = written(joined, f"phrases-{k + 1}")
        kept = below
        if k + 1 < len(levels):
            held = levels[k + 1].select(F.explode(F.array("l", "r")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("most"))
            kept = below.join(held, "id", "left").where("most IS NULL OR most < f")
        kept = kept.select("lang", "phrase", F.col("f").alias("a"), "heads", "tails", F.lit(k + 1).alias("words"))
        out = kept if out is None else out.unionByName(kept)
    return out


def score(a: str, l: str, r: str, n: str) -> Column:
    """floor(FACTOR * a * n / (l * r)), of SQL expressions: products of decimals, which are exact up to 38 digits."""
    wide = lambda x: f"cast({x} as decimal(38,0))"
    return F.expr(f"cast({wide(FACTOR)} * {wide(a)} * {wide(n)} div ({wide(l)} * {wide(r)}) as long)")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best `top` phrases."""
    levels, total = grams(docs, text, lang, least, longest)
    scored = phrases(levels).join(total, "lang")

    def cuts(n: int) -> Column:
        each = [F.struct(score("a", f"element_at(heads, {k})", f"element_at(tails, {n - k})", "n").alias("score"), F.lit(k).alias("k"), F.element_at("heads", k).alias("l"), F.element_at("tails", n - k).alias("r")) for k in range(1, n)]
        return F.array_min(F.array(*each))

    best = None
    for n in range(2, longest + 1):
        best = F.when(F.col("words") == n, cuts(n)) if best is None else best.when(F.col("words") == n, cuts(n))
    scored = scored.withColumn("cut", best).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(partitions(docs.sparkSession)))
    # of each part of a language no more than its own best can be among the language's best
    some = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


def op11_sql(table: str = "documents", least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> str:
    cuts = " UNION ALL ".join(f"SELECT lang, phrase, w, a, {k} AS k, array_to_string(w[1:{k}], ' ') AS first_part, array_to_string(w[{k + 1}:], ' ') AS rest FROM kept WHERE len(w) > {k}" for k in range(1, longest))
    return f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM {table}),
  words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
  total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
  starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
  grams AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM starts, range(1, {longest + 1}) AS r(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
  often AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, f FROM grams WHERE f >= {least}),
  parts AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(f) AS most FROM often, range(1, {longest + 1}) AS a(i), range(1, {longest}) AS b(k) WHERE i + k - 1 <= len(w) AND k < len(w) GROUP BY ALL),
  kept AS (SELECT o.lang, o.phrase, o.w, o.f AS a FROM often o LEFT JOIN parts p ON p.lang = o.lang AND p.phrase = o.phrase WHERE len(o.w) > 1 AND (most IS NULL OR most < o.f)),
  cuts AS ({cuts}),
  scored AS (SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, n, k, ({FACTOR}::HUGEINT * c.a * n // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM cuts c JOIN often x ON x.lang = c.lang AND x.phrase = c.first_part JOIN often y ON y.lang = c.lang AND y.phrase = c.rest JOIN total t ON t.lang = c.lang),
  lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored),
  ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM lowest WHERE place = 1)
SELECT * FROM ranked WHERE rank <= {top}"""
