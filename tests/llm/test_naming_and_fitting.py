"""Names over borders of ranges where different keys share a lead; FTRL against a plain loop; gradients; labels that are missing or repeat."""

import math
import random

import numpy as np
import pytest
from docloom.llm import blocks, bpe, quality, toxicity
from docloom.llm._shared import map_texts
from pyspark.sql import functions as F


@pytest.mark.parametrize("leads", [1, 3, 1000])
def test_names_are_one_for_one_with_keys(spark, leads):
    rng = random.Random(leads)
    rows = [(i, "k%d" % rng.choice([0, 0, 0, rng.randrange(40)])) for i in range(600)]
    df = spark.createDataFrame(rows, "row long, k string").withColumn("lead", F.pmod(F.xxhash64("k"), F.lit(leads)))
    got = {r["row"]: r["name"] for r in blocks.named(df, ["lead"], ["k"], ["row"], ["row"]).collect()}
    pairs = {(k, got[i]) for i, k in rows}
    keys = {k for _, k in rows}
    assert len(got) == len(rows) and len(pairs) == len(keys)
    assert {n for _, n in pairs} == set(range(1, len(keys) + 1))
    assert blocks.named(df.where("false"), ["lead"], ["k"], ["row"], ["row"]).count() == 0


def test_packed_places_come_back():
    for n in (0, 1, 8191, 8192, 8193, 100_000):
        places = np.sort(np.random.default_rng(n).choice(1 << toxicity.BITS, n, replace=False))
        data = toxicity.packed(places)
        assert len(data) <= 1 << toxicity.BITS >> 3 and np.array_equal(toxicity.unpacked(data), places)


def test_ftrl_is_the_plain_loop():
    rng = random.Random(2)
    examples = [(i % 2, sorted(rng.sample(range(30), 6)) + ([40] if i % 2 else [])) for i in range(60)]
    z, n, size = {}, {}, 1 << toxicity.BITS

    def weight(j):
        l1 = 0.0 if j == size else toxicity.L1
        zj = z.get(j, 0.0)
        if abs(zj) <= l1:
            return 0.0
        return -(zj - math.copysign(l1, zj)) / ((toxicity.BETA + math.sqrt(n.get(j, 0.0))) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(5)
    for _ in range(toxicity.EPOCHS):
        for i in order.permutation(len(examples)):
            label, places = examples[i]
            w = {j: weight(j) for j in [*places, size]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for j in w:
                before = n.get(j, 0.0)
                n[j] = before + g * g
                z[j] = z.get(j, 0.0) + g - (math.sqrt(n[j]) - math.sqrt(before)) / toxicity.ALPHA * w[j]
    weights, bias = toxicity.fit([(y, toxicity.packed(np.array(p))) for y, p in examples])
    assert bias == pytest.approx(weight(size), abs=1e-6)
    want = {j: weight(j) for j in z if j != size and weight(j)}
    assert set(np.flatnonzero(weights)) == set(want) and want
    assert all(weights[j] == pytest.approx(w, abs=1e-5) for j, w in want.items())


def test_attention_gradients_are_the_numeric_ones():
    rng = np.random.default_rng(1)
    x, off, y = rng.normal(size=(9, quality.WIDTH)), np.array([0, 1, 5]), np.array([1.0, 0.0, 1.0])
    model = quality.GatedAttention.fresh(quality.WIDTH)

    def loss():
        p = model.forward(x, off)[0]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, g in model.gradients(x, off, y).items():
        p = model.p[name]
        for at in list(np.ndindex(p.shape))[:: max(1, p.size // 7)]:
            held, step = p[at], 1e-5
            p[at] = held + step
            up = loss()
            p[at] = held - step
            down = loss()
            p[at] = held
            assert g[at] == pytest.approx((up - down) / (2 * step), abs=1e-6)


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_labels_that_miss_or_repeat(spark, module, label):
    docs = spark.createDataFrame([(1, "a fine day"), (1, "a fine day"), (2, None), (3, ""), (None, "no id")], "doc_id long, text string")
    for rows, usable in (([], F.lit(True)), ([(1, 1), (1, 0), (2, None), (3, 7)], F.lit(False)), ([(1, 1), (1, 0), (2, 1), (2, 1), (3, 0), (None, 1)], F.lit(True))):
        model = module.trained(docs, spark.createDataFrame(rows, f"doc_id long, {label} int"), usable)
        got = [r["score"] for r in map_texts(docs, "text", ["doc_id"], module.score_texts(*model), "score double").collect()]
        assert len(got) == 5 and all(0 <= s <= 1 for s in got)
        if len(rows) != 6:
            assert got == [0.5] * 5
        assert map_texts(docs.where("false"), "text", ["doc_id"], module.score_texts(*model), "score double").count() == 0


def test_words_of_many_texts_are_looked_up_once():
    class Counted(dict):
        asked = 0

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

        def get(self, key, default=None):
            Counted.asked += 1
            return super().get(key, default)

    coder = bpe.WordBpe(bpe.default_path(), True)
    coder.ids = Counted()
    text = "The quick brown fox doesn't jump; it's 12 lazy dogs'"
    want = coder.library.encode(text, add_special_tokens=False).ids
    assert all(np.frombuffer(ids, "<u4").tolist() == want for ids, _ in coder.encode_texts([text] * 200, show=False))
    assert Counted.asked <= 40  # some 15 words, looked up and learnt; 200 times as many before


def test_contractions_and_cut_texts_are_the_librarys(monkeypatch):
    coder = bpe.WordBpe(bpe.default_path(), True)
    texts = ["'", "'l", "x'l", "''s", "'s's'", "5's'1", "'twas 'rear we'LL 'LLama I'D", "\x00'\x00're", "é's\x85ÀB'd 's", "a's <|endoftext|>'s", "Σ's", "", " \n "]
    texts += ["word's  and\n" * 40, "x" * 300, "y" * 200 + "\t" + "12's " * 50]
    for size in (bpe.BATCH_CHARS, 64):
        monkeypatch.setattr(bpe, "BATCH_CHARS", size)
        for text, (ids, _) in zip(texts, coder.encode_texts(texts, show=False)):
            assert np.frombuffer(ids, "<u4").tolist() == coder.library.encode(text, add_special_tokens=False).ids, text
