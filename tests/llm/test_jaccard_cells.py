"""Cells of the set join: every link found, and no more rows than sets."""

import random

import numpy as np
import pytest
from docloom.llm import jaccard
from pyspark.sql import functions as F


def linked(a, b):
    shared = len(np.intersect1d(a, b))
    return 100 * shared >= 75 * (len(a) + len(b) - shared)


def roots(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return [find(i) for i in range(n)]


def changed(rng, base, k, fresh):
    out = set(base)
    out -= set(rng.sample(sorted(out), min(k, len(out) - 1)))
    return out | {rng.randrange(fresh) for _ in range(k)}


@pytest.mark.parametrize("seed", range(40))
def test_cells_find_every_link(seed):
    rng = random.Random(seed)
    fresh = rng.choice((50, 400, 1 << 40))
    bases = [{rng.randrange(fresh) for _ in range(rng.randrange(1, 60))} for _ in range(rng.randrange(1, 4))]
    sets = [np.array(sorted(changed(rng, rng.choice(bases), rng.randrange(0, 14), fresh)), np.uint64) for _ in range(rng.randrange(2, 70))]
    comp = [i if rng.random() < 0.8 else 0 for i in range(len(sets))]
    start = [(i, c) for i, c in enumerate(comp)]
    names = {c: i for i, c in reversed(list(enumerate(comp)))}
    got = jaccard.joined(comp, sets)
    assert len(got) < len(sets)
    every = [(i, j) for i in range(len(sets)) for j in range(i) if linked(sets[i], sets[j])]
    start = [(i, names[c]) for i, c in enumerate(comp)]
    assert roots(len(sets), start + [(names[a], names[b]) for a, b in got]) == roots(len(sets), start + every)


@pytest.mark.parametrize("seed", range(40))
def test_samples_leave_every_link_possible(seed):
    rng = random.Random(seed)
    bases = [{rng.randrange(1 << 64) for _ in range(rng.randrange(8, 90))} for _ in range(3)]
    sets = [np.array(sorted(changed(rng, rng.choice(bases), rng.randrange(0, 9), 1 << 64)), np.uint64) for _ in range(60)]
    comp = list(range(len(sets)))
    kept = jaccard._possible((1, 0, 0), comp, comp, [jaccard._sampled(s) for s in sets])
    part = {sid: part for _, _, _, part, sid, _ in kept}
    for i in comp:
        for j in range(i):
            if linked(sets[i], sets[j]):
                assert i in part and part[i] == part[j]


def texts(size, changes, seed=3):
    """A group of texts that each change some words of one base, which is not among them."""
    rng = random.Random(seed)
    base = ["w%d" % i for i in range(120)]
    out = []
    for i in range(size):
        words = list(base)
        for at in rng.sample(range(len(words)), changes):
            words[at] = f"x{i}-{at}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("changes", "sizes", "limits"), [(3, (300,), None), (5, (90,), (60, 4_000_000))])
def test_rows_grow_with_a_group_and_components_hold(spark, monkeypatch, changes, sizes, limits):
    if limits:
        monkeypatch.setattr(jaccard, "CELL_SETS", limits[0])
        monkeypatch.setattr(jaccard, "CELL_SHINGLES", limits[1])
    made = {}
    plain = jaccard.written

    def noted(df, label, **how):
        out = plain(df, label, **how)
        made.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard, "written", noted)
    rows = {}
    for size in sizes:
        made.clear()
        group = texts(size, changes)
        docs = spark.createDataFrame(list(enumerate(group)), "doc_id long, text string")
        got = {r["doc_id"]: r["component_id"] for r in jaccard.near_groups(docs).collect()}
        sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in group)]
        want = roots(size, [(i, j) for i in range(size) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])])
        assert [got[i] for i in range(size)] == want
        rows[size] = {label: max(found) for label, found in made.items() if label != "mixed-cells" or not limits}
        assert all(most <= 14 * size for most in rows[size].values()), rows  # all pairs would be size / 2 for each text


def test_keep_near_tells_rows_apart(spark):
    group = texts(4, 1)
    rows = [(1, group[0], "a", 1), (1, group[1], "b", 2), (None, group[2], "c", 3), (2, None, "d", 4), (2, None, "e", 5), (3, "", "f", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, comp int")
    got = jaccard.keep_near(docs)
    assert got.columns == docs.columns
    kept = got.collect()
    assert sorted(r["comp"] for r in kept) in ([1, 4, 5, 6], [2, 4, 5, 6])
    assert {r["doc_id"] for r in kept if r["comp"] < 3} == {1}
    assert jaccard.keep_near(docs.where(F.lit(False))).count() == 0
