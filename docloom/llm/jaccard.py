"""Exact n-gram Jaccard self-join with set-relation skipping (operator 7).

Sets are the distinct SIZE-word shingles of texts, as 64-bit hashes. Texts of one set are one
representative from the start. Two sets of similarity t or more share a shingle among the first
n - ceil(t n) + 1 of each in any common order; the order here puts shingles frequent in a bounded
sample last, since it only decides the cost, never the result. Index lists are built per shingle
from blobs of whole batches, dealt out by a hash of the shingle.

Skipping in lists: an entry whose position, or whose place after its leader's, leaves too few
shingles to reach the threshold is passed over. In each list a leader is compared first, by a quarter
of each set, which bounds what two sets can share, and by whole sets only where that bound allows a
link. Lists of one leader are one cell; a cell whose sets are one component by then is done, and of
others only components stay that by the quarters may be linked with another.

Skipping of sets: the sets of other cells are written as differences to the cell's consensus, the
shingles that most of them have. What two sets share follows from the consensus, the sizes of their
differences, and the differences they share: sets whose differences are small enough are linked
without a look at each other, and others only if they share differences, which an index of the rarest
differences finds. A cell leaves at most one row for each of its sets. Cells of more than CELL_SETS
sets or CELL_SHINGLES shingles are dealt out as pairs of blocks, so that no task holds more; each set
then goes to as many tasks as the cell has blocks.

Defined results: null text and text without words have no shingles and are linked with nothing.
Fewer than SIZE words: the whole sequence is the one shingle. Repeated rows share their component.
Null keys are ignored when the smallest key of a component is taken. An empty table gives an empty
result; only key and text are read. keep_near tells rows apart by their place in the input, so of
linked rows with one key one stays, the first read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import _words
from docloom.llm._shared import bit_filter, numbered, partitions, passes, small_batches, written
from docloom.llm.components import components

SIZE = 5
#: The threshold as parts of OF.
PARTS, OF = 75, 100
#: Texts sampled to find frequent shingles, the counts from which one is frequent, and how many are sent out at most (8 bytes each).
SAMPLE, FREQUENT, MOST_FREQUENT = 20_000, 3, 500_000
#: Postings a map task gathers before it sends blobs on.
FLUSH = 400_000
#: Parts into which comparisons with one leader are dealt.
SALTS = 16
#: Sets and shingles of a cell that one task holds; larger cells are dealt out as pairs of blocks of half as many.
CELL_SETS, CELL_SHINGLES = 20_000, 1_000_000

_POSTING = np.dtype([("token", "<u8"), ("sid", "<i8"), ("n", "<u4"), ("pos", "<u4")])


def text_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for chunk in _words.chunks(texts, fold=_words.LOWER):
        h = chunk.word_hashes()
        at, window = chunk.windows(h, SIZE)
        off = np.searchsorted(at, chunk.word_off)
        short = np.flatnonzero((chunk.counts > 0) & (chunk.counts < SIZE))
        whole = dict(zip(short.tolist(), chunk.sequence_hashes(h, short)))
        for i in range(chunk.n):
            if i in whole:
                yield np.array([whole[i]], np.uint64)
            else:
                yield np.unique(window[off[i] : off[i + 1]])


def set_id(s: np.ndarray) -> int:
    """A 64-bit name of the set."""
    with np.errstate(over="ignore"):
        mixed = _words.mix(s + np.uint64(0x632BE59BD9B4E019))
        both = np.array([mixed.sum(dtype=np.uint64) * np.uint64(3) + np.bitwise_xor.reduce(mixed) + np.uint64(len(s))])
    return int(_words.mix(both).view(np.int64)[0])


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(text_sets(batch.column("text")))
        sid = pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("at"), sid, pa.array([len(s) for s in sets], pa.int64())], ["key", "at", "sid", "n"])


def _frequencies(wanted: bytes):
    """Shingles of the texts whose `at` passes the filter, and in how many texts of a batch each is.

    Only the lower half of all hashes: the order puts low ones first, so others hardly come to stand in a prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(text_sets(batch.column("text").filter(pa.array(passes(wanted, batch.column("at").to_numpy(zero_copy_only=False))))))
            if sets:
                token, c = np.unique(np.concatenate([s[: np.searchsorted(s, np.uint64(1 << 63))] for s in sets]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(c)], ["token", "c"])

    return run


def needed(n_a, n_b):
    """Shared shingles of a link between sets of these sizes."""
    return -(-PARTS * (n_a + n_b) // (PARTS + OF))


def prefix_length(n: int) -> int:
    return n - -(-PARTS * n // OF) + 1


def _poster(frequent: np.ndarray, rank: np.ndarray, buckets: int):
    """Blobs of postings, one for each bucket of shingles and flush. frequent: sorted shingles, rank: their place in the order."""

    def blobs(postings: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(postings)
        bucket = (_words.mix(rows["token"]) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        ends = np.append(cuts[1:], len(rows))
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array([_planes(rows[a:b]) for a, b in zip(cuts, ends)], pa.binary())], ["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, count = [], 0
        for batch in batches:
            for s in text_sets(batch.column("text")):
                if not len(s) or (sid := set_id(s)) in seen:
                    continue
                seen = seen if len(seen) < 500_000 else set()
                seen.add(sid)
                at = np.minimum(np.searchsorted(frequent, s), max(len(frequent) - 1, 0))
                order = np.where(frequent[at] == s, rank[at], 0) if len(frequent) else np.zeros(len(s), np.int64)
                first = s[np.lexsort((s, order))[: prefix_length(len(s))]] if order.any() else s[: prefix_length(len(s))]
                p = np.zeros(len(first), _POSTING)
                p["token"], p["sid"], p["n"], p["pos"] = first, sid, len(s), np.arange(len(first))
                held.append(p)
                count += len(p)
                if count >= FLUSH:
                    yield blobs(held)
                    held, count = [], 0
        if held:
            yield blobs(held)

    return run


def _planes(rows: np.ndarray) -> bytes:
    """Column after column, the numbers' upper halves apart from the lower ones, since those are mostly zero."""
    halves = [np.ascontiguousarray(rows[c]).view("<u2").reshape(-1, 2).T.tobytes() for c in ("n", "pos")]
    return b"".join([rows["token"].tobytes(), rows["sid"].tobytes(), *halves])


def _unpacked(blob: bytes) -> np.ndarray:
    n = len(blob) // _POSTING.itemsize
    out = np.zeros(n, _POSTING)
    out["token"], out["sid"] = np.frombuffer(blob, "<u8", n), np.frombuffer(blob, "<i8", n, 8 * n)
    for c, at in (("n", 16 * n), ("pos", 20 * n)):
        out[c] = np.ascontiguousarray(np.frombuffer(blob, "<u2", 2 * n, at).reshape(2, n).T).view("<u4")[:, 0]
    return out


def reaches(n_a, pos_a, n_b, pos_b):
    """Whether sets whose first shared shingle stands at these positions can be linked."""
    return np.minimum(n_a - pos_a, n_b - pos_b) >= needed(n_a, n_b)


def stars(rows: np.ndarray) -> tuple[list[tuple[int, int]], int]:
    """Of one list: the (leader, follower) pairs that its positions allow, and its first leader."""
    n, pos, sid = rows["n"].astype(np.int64), rows["pos"].astype(np.int64), rows["sid"]
    left, pairs = np.argsort(_words.mix(sid.view(np.uint64))), []
    first = int(sid[left[0]])
    while len(left) > 1:
        top, rest = left[0], left[1:]
        ok = reaches(n[top], pos[top], n[rest], pos[rest])
        pairs += [(int(sid[top]), x) for x in sid[rest[ok]].tolist()]
        left = rest[~ok]
    return pairs, first


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs a, b to compare (s null), and for lists of three sets or more in s the sets, with their sizes, of part b of cell a."""
    held = [_unpacked(x) for batch in batches for x in batch.column("blob").to_pylist()]
    if not held:
        return
    rows = np.concatenate(held)
    del held
    rows = rows[np.lexsort((rows["sid"], rows["token"]))]
    fresh = np.append(True, (rows["token"][1:] != rows["token"][:-1]) | (rows["sid"][1:] != rows["sid"][:-1]))
    rows = rows[fresh]
    starts = np.flatnonzero(np.append(True, rows["token"][1:] != rows["token"][:-1]))
    sizes = np.diff(np.append(starts, len(rows)))
    two = starts[sizes == 2]
    a, b = rows[two], rows[two + 1]
    ok = reaches(a["n"].astype(np.int64), a["pos"].astype(np.int64), b["n"].astype(np.int64), b["pos"].astype(np.int64))
    swap = _words.mix(a["sid"].view(np.uint64)) > _words.mix(b["sid"].view(np.uint64)) if len(a) else np.zeros(0, bool)
    first, second = np.where(swap, b["sid"], a["sid"])[ok], np.where(swap, a["sid"], b["sid"])[ok]
    pairs = set(zip(first.tolist(), second.tolist()))
    merged: dict[bytes, np.ndarray] = {}  # lists of the same sets are one, with the least positions
    for s, size in zip(starts[sizes > 2], sizes[sizes > 2]):
        entries = rows[s : s + size]
        key = entries["sid"].tobytes()
        if key in merged:
            merged[key]["pos"] = np.minimum(merged[key]["pos"], entries["pos"])
        else:
            merged[key] = entries.copy()
    cells: dict[int, dict[int, int]] = {}
    for entries in merged.values():
        found, top = stars(entries)
        if found:  # else no two of them can be linked
            pairs.update(found)
            cells.setdefault(top, {}).update(zip(entries["sid"].tolist(), entries["n"].tolist()))
    found = sorted(pairs)
    for at in range(0, len(found), 50_000):
        part = found[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in part], pa.int64()) for i in range(2)), pa.nulls(len(part), pa.binary())], ["a", "b", "s"])
    out: list[tuple] = []
    for top, sets in cells.items():
        rows = np.array(list(sets.items()), np.int64)
        salt = (_words.mix(rows[:, 0].astype(np.uint64)) % np.uint64(SALTS)).astype(np.int64) if len(rows) > 64 else np.zeros(len(rows), np.int64)
        out += [(top, int(x), rows[salt == x].tobytes()) for x in np.unique(salt)]
    for at in range(0, len(out), 5_000):
        part = out[at : at + 5_000]
        yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in part], pa.int64()) for i in range(2)), pa.array([r[2] for r in part], pa.binary())], ["a", "b", "s"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by a, b: each set of a part of a cell once."""
    held, current = [], None

    def done() -> pa.RecordBatch:
        rows = np.unique(np.concatenate(held), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), current[0])), pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["cell", "v", "n"])

    for batch in batches:
        for a, b, s in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "s"))):
            if held and (a, b) != current:
                yield done()
                held = []
            current = (a, b)
            held.append(np.frombuffer(s, np.int64).reshape(-1, 2))
    if held:
        yield done()


def joined(comp: list[int], sets: list[np.ndarray], n: list[int] | None = None) -> list[tuple[int, int]]:
    """Pairs of components that a link between two of the sets joins, no more than joining them takes.

    With m the consensus, r and r' the numbers of its shingles that two sets lack and s the differences
    from it (of either sort) that they share, the sets share |m| - r - r' + s shingles. n: their whole
    sizes, if the sets are samples; then any number of the other shingles may be shared, up to half of both.
    """
    k, unit = len(sets), 2 * (PARTS + OF)
    label, have = np.unique(np.asarray(comp), return_inverse=True)[1], np.array([len(s) for s in sets])
    sizes = have if n is None else np.asarray(n)
    owner, out = np.repeat(np.arange(k), have), []
    token, of, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.flatnonzero(2 * count > k)
    place = np.full(len(token), -1)
    place[common] = np.arange(len(common))
    inside = place[of] >= 0
    lacks = np.ones((k, len(common)), bool)  # no more bytes than the sets have shingles, twice
    lacks[owner[inside], place[of[inside]]] = False
    lacking, lacked = np.nonzero(lacks)
    has = len(common) - lacks.sum(1)
    del lacks
    # linked: shared >= PARTS / (PARTS + OF) of both sizes, so cost + cost' <= room + unit * s
    cost = unit * (len(common) - has) + 2 * PARTS * sizes - (PARTS + OF) * (sizes - have)
    room = unit * len(common)

    def join(x: int, others: np.ndarray) -> None:
        for y in np.unique(label[others]).tolist():
            if y != label[x]:
                out.append((comp[x], comp[others[np.flatnonzero(label[others] == y)[0]]]))
                label[label == y] = label[x]

    least = int(np.argmin(cost))
    join(least, np.flatnonzero(cost + cost[least] <= room))
    far = np.flatnonzero(cost + cost[least] > room)  # of any linked sets, one here at least shares a difference with the other
    mine, what = np.concatenate((owner[~inside], lacking)), np.concatenate((of[~inside], common[lacked]))
    order = np.argsort(what, kind="stable")
    start = np.searchsorted(what[order], np.arange(len(token) + 1))
    listed, length = mine[order], np.diff(start)
    by_set = np.lexsort((length[what], mine))  # each set's differences, the rarest first
    what, first = what[by_set], np.searchsorted(mine[by_set], np.arange(k + 1))
    pending = np.zeros(k, bool)
    pending[far] = True
    for x in far.tolist():
        pending[x] = False
        if (label == label[0]).all():
            break
        own = what[first[x] : first[x + 1]]
        least_shared = max(1, -(-int(cost[x] + cost[least] - room) // unit), -(-PARTS * int(sizes[x]) // OF) - int(sizes[x] - have[x]) - int(has[x]))
        prefix = own[: max(0, len(own) - least_shared + 1)]
        prefix = prefix[length[prefix] > 1]
        if not len(prefix):
            continue
        near = np.unique(np.concatenate([listed[start[t] : start[t + 1]] for t in prefix]))
        # a far set that has had its turn has met all it can be linked with
        near = near[(label[near] != label[x]) & (pending[near] | (cost[near] + cost[least] <= room)) & (np.minimum(sizes[near], sizes[x]) * OF >= PARTS * np.maximum(sizes[near], sizes[x]))]
        if not len(near):
            continue
        if len(near) < 32:
            shared = np.array([len(np.intersect1d(own, what[first[y] : first[y + 1]], assume_unique=True)) for y in near.tolist()])
        else:
            shared = np.bincount(np.concatenate([listed[start[t] : start[t + 1]] for t in own]), minlength=k)[near]
        join(x, near[cost[x] + cost[near] <= room + unit * shared])
    return out


def _by_cell(made, names: list[str]):
    """Rows sorted by cell, i, j: the rows that made gives for the sid, comp and s of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current, out = [], None, []

        def close() -> None:
            once = {sid: (comp, s) for sid, comp, s in held}
            if len(once) > 1:
                out.extend(made(current, list(once), [c for c, _ in once.values()], [s for _, s in once.values()]))

        def taken() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(len(names))], names)
            out.clear()
            return batch

        for batch in batches:
            for cell, i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("cell", "i", "j", "sid", "comp", "s"))):
                if (cell, i, j) != current:
                    close()
                    held, current = [], (cell, i, j)
                held.append(row)
            if len(out) > 20_000:
                yield taken()
        close()
        yield taken()

    return run


def _links(_, sids: list[int], comp: list[int], s: list[bytes]) -> list[tuple]:
    return joined(comp, [np.frombuffer(x, "<u8") for x in s])


def _possible(cell: tuple, sids: list[int], comp: list[int], s: list[bytes]) -> list[tuple]:
    """Of the components that may be linked with another by their samples: cell, i, j, the least of those together as part, sid and comp."""
    samples = [np.frombuffer(x, "<u4") for x in s]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in joined(comp, [x[2:] for x in samples], [int(x[0]) for x in samples]):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [(*cell, find(c), sid, c) for sid, c in zip(sids, comp) if c in root]


def _sampled(s: np.ndarray) -> bytes:
    """Size of the set, size of its part below 2**62, and that part's lower halves."""
    part = s[: np.searchsorted(s, np.uint64(1 << 62))]
    return np.array([len(s), len(part)], "<u4").tobytes() + np.unique(part.astype("<u4")).tobytes()


def _wanted_sets(wanted: bytes, sample: bool):
    """sid and set (or its sample) of the texts whose `at` passes the filter, each once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = batch.column("text").filter(pa.array(passes(wanted, batch.column("at").to_numpy(zero_copy_only=False))))
            out = []
            for s in text_sets(texts):
                if not len(s) or (sid := set_id(s)) in seen:
                    continue
                seen = seen if len(seen) < 500_000 else set()
                seen.add(sid)
                out.append((sid, _sampled(s) if sample else s.tobytes()))
            for at in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out[at : at + 64]], pa.int64()), pa.array([x[1] for x in out[at : at + 64]], pa.binary())], ["sid", "s"])

    return run


def sets_of(wanted: DataFrame, docs: DataFrame, ids: DataFrame, sample: bool = False) -> DataFrame:
    """sid, s: the sets (or samples of them) of at least the sids in wanted, of one text for each."""
    one = ids.where("sid IS NOT NULL").groupBy("sid").agg(F.min("at").alias("at"))
    places = wanted.select("sid").distinct().join(one, "sid").select("at")
    texts = docs.select("at", "text").mapInArrow(_wanted_sets(bit_filter(places, "at"), sample), "sid long, s binary")
    return texts.dropDuplicates(["sid"])


def most_shared(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """No fewer shingles than two sets share, by their samples; and the sets' sizes.

    Of the sampled shingles no more are shared than lower halves are, but for shingles of one set with equal
    lower halves; of the others at most all of the smaller rest.
    """
    (n_a, part_a), (n_b, part_b) = a[:2].tolist(), b[:2].tolist()
    halves = len(np.intersect1d(a[2:], b[2:], assume_unique=True))
    return halves + min(part_a - len(a) + 2, part_b - len(b) + 2) + min(n_a - part_a, n_b - part_b), n_a, n_b


def _compare(sample: bool):
    """Rows sorted by a, its own set first: shingles that a shares with each b (at most shares, if samples), and sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, mine = None, None
        for batch in batches:
            out = []
            for a, b, s in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("s").to_pylist()):
                theirs = np.frombuffer(s, "<u4" if sample else "<u8")
                if b is None:
                    current, mine = a, theirs
                elif a == current:
                    out.append((a, b, *(most_shared(mine, theirs) if sample else (len(np.intersect1d(mine, theirs, assume_unique=True)), len(mine), len(theirs)))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], ["a", "b", "shared", "n_a", "n_b"])

    return run


def compared(pairs: DataFrame, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The pairs (a, b of set ids) that are linked."""
    possible = _against(pairs, docs, ids, True).where(linked()).select("a", "b")
    return _against(possible, docs, ids, False).where(linked()).select("a", "b")


def _against(pairs: DataFrame, docs: DataFrame, ids: DataFrame, sample: bool) -> DataFrame:
    """pairs with shared and sizes, from whole sets or, as an upper bound, from samples of a quarter of each."""
    spark = pairs.sparkSession
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    mine = salted.select(F.col("a").alias("sid"), "a", "salt", F.lit(None).cast("long").alias("b")).distinct()
    wanted = written(salted.select(F.col("b").alias("sid"), "a", "salt", "b").unionByName(mine), "wanted")
    rows = wanted.join(sets_of(wanted, docs, ids, sample), "sid").select("a", "salt", "b", "s")
    ordered = rows.repartition(partitions(spark), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return written(ordered.mapInArrow(_compare(sample), "a long, b long, shared long, n_a long, n_b long"), "compared", release=True)


def linked() -> F.Column:
    return F.lit(OF) * F.col("shared") >= F.lit(PARTS) * (F.col("n_a") + F.col("n_b") - F.col("shared"))


def _grouped(docs: DataFrame) -> DataFrame:
    """docs: key, text. key, sid, n, and comp: the smallest sid reachable by links; a row for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark)
    docs = docs.select("key", "text", F.xxhash64("text").alias("at"))
    ids = written(docs.mapInArrow(_ids, f"key {docs.schema['key'].dataType.simpleString()}, at long, sid long, n long"), "set-ids")

    sample = ids.where("sid IS NOT NULL").groupBy("sid").agg(F.min("at").alias("at")).orderBy(F.xxhash64("sid"), "sid").limit(SAMPLE)
    counts = docs.select("at", "text").mapInArrow(_frequencies(bit_filter(sample, "at")), "token long, c long")
    top = counts.groupBy("token").agg(F.sum("c").alias("c")).where(F.col("c") >= FREQUENT).orderBy(F.desc("c"), "token").limit(MOST_FREQUENT).toArrow()
    frequent = top.column("token").to_numpy().view(np.uint64)
    order = np.argsort(frequent)
    frequent, rank = frequent[order], top.column("c").to_numpy()[order]

    blobs = docs.select("text").mapInArrow(_poster(frequent, rank, 8 * n), "bucket int, blob binary")
    found = written(blobs.repartition(n, "bucket").select("blob").mapInArrow(_lists, "a long, b long, s binary"), "lists", release=True)
    pairs = written(found.where("s IS NULL").select("a", "b").distinct(), "pairs")
    first = components(compared(pairs, docs, ids))

    members = found.where("s IS NOT NULL").repartition(n, "a", "b").sortWithinPartitions("a", "b").mapInArrow(_members, "cell long, v long, n long").distinct()
    cells = members.join(first, "v", "left")
    cells = written(cells.select("cell", F.col("v").alias("sid"), "n", F.coalesce("root", "v").alias("comp")), "cells")
    parts = F.greatest(F.ceil(2 * F.sum("n") / CELL_SHINGLES), F.ceil(2 * F.count("*") / CELL_SETS)).cast("int")
    mixed = cells.groupBy("cell").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), parts.alias("parts")).where("x <> y").select("cell", "parts")
    block = F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")
    rows = cells.join(mixed, "cell").select("cell", "sid", "comp", block.alias("mine"), F.explode(F.sequence(F.lit(0), F.greatest(F.col("parts") - 1, F.lit(0)))).alias("other"), "parts")
    rows = rows.where("mine <> other OR parts <= 1").select("cell", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "sid", "comp")
    rows = written(rows, "mixed-cells")

    def cellwise(rows: DataFrame, sample: bool, made, names: list[str]) -> DataFrame:
        whole = rows.join(sets_of(rows, docs, ids, sample), "sid").repartition(n, "cell", "i", "j").sortWithinPartitions("cell", "i", "j")
        return whole.mapInArrow(_by_cell(made, names), ", ".join(f"{x} long" for x in names))

    rows = written(cellwise(rows, True, _possible, ["of", "i", "j", "part", "sid", "comp"]), "possible-cells", release=True)
    rows = rows.select(F.xxhash64("of", "part").alias("cell"), "i", "j", "sid", "comp")  # cells of one name are one larger cell
    second = components(cellwise(rows, False, _links, ["a", "b"])).select(F.col("v").alias("comp"), F.col("root").alias("last"))

    sids = ids.where("sid IS NOT NULL").select("sid").distinct().join(first, F.col("sid") == F.col("v"), "left").select("sid", F.coalesce("root", "sid").alias("comp"))
    sids = written(sids.join(second, "comp", "left").select("sid", F.coalesce("last", "comp").alias("comp")), "set-components")
    return ids.select("key", "sid", "n").join(sids, "sid", "left")


def near_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each input row: key, n_shingles, component_id (smallest key reachable by links)."""
    rows = _grouped(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")))
    rows = written(rows, "grouped")
    smallest = rows.where("comp IS NOT NULL").groupBy("comp").agg(F.min("key").alias("component_id"), F.count("*").alias("c")).where("c > 1").drop("c")
    out = rows.join(written(smallest.withColumn("several", F.lit(True)), "smallest"), "comp", "left")  # no aggregation beside the join, so that Spark can split a large component
    least = F.when(F.col("several"), F.col("component_id")).otherwise(F.col("key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), least.alias("component_id"))


def keep_near(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one row of each group of linked texts: the one with the smallest key, of equal keys the first read; nulls come last."""
    whole, row = numbered(docs)
    rows = _grouped(whole.select(F.struct(F.col(f"`{key}`").isNull().alias("none"), F.col(f"`{key}`").alias("key"), F.col(row)).alias("key"), F.col(f"`{text}`").cast("string").alias("text")))
    rows = written(rows.select("key", "comp"), "grouped")
    # the rows that go are fewer than those that stay
    least = rows.where("comp IS NOT NULL").groupBy("comp").agg(F.min("key").alias("least"), F.count("*").alias("c")).where("c > 1").drop("c")
    least = written(least, "least")
    gone = rows.join(least, "comp").where(F.col(f"key.{row}") != F.col(f"least.{row}")).select(F.col(f"key.{row}").alias(row))
    return whole.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op7_sql(table: str = "documents") -> str:
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {table}),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {OF} * k >= {PARTS} * (x.n + y.n - k)),
r AS (SELECT doc_id AS v, doc_id AS c FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id FROM w JOIN r ON r.v = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id, n.n"""
