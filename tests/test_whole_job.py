"""The queries over whole tables, against brute force on small ones."""

import hashlib
import math
import random

import pytest

from docloom.operators import retrieval
from docloom.plans import queries as plans


def table(spark, folder, name, rows, ddl):
    spark.createDataFrame(rows, ddl).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)], i % 3) for i in range(203)]
    rows[7] = (7, None, 0)
    rows[9] = (9, [0.0] * 4, 0)
    for i in range(50, 90):
        rows[i] = (i, rows[40][1], i % 3)
    folder = str(tmp_path_factory.mktemp("vectors"))
    table(spark, folder, "embeddings", rows, "vec_id long, embedding array<double>, label int")
    best = {}
    for q, a, _ in rows[::20]:
        cos = lambda b: sum(x * y for x, y in zip(a, b)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)))
        best[q] = sorted((-round(cos(b), 6), c) for c, b, _ in rows if b and any(b))
    return folder, best, {i: label for i, _, label in rows}


@pytest.mark.parametrize("values", [1 << 19, 48])
def test_dense_queries_are_all_multiples_of_twenty(spark, vectors, monkeypatch, values):
    folder, best, _ = vectors
    monkeypatch.setattr(retrieval, "BLOCK_VALUES", values)
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in plans.dense_topk(spark, folder).collect()}
    assert got == {(q, k + 1): (c, -s) for q, found in best.items() for k, (s, c) in enumerate(found[:10])}


def test_hybrid_fuses_vectors_with_whole_texts(spark, vectors):
    folder, best, _ = vectors
    rng = random.Random(3)
    texts = {i: " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 9))) for i in range(203)}
    table(spark, folder, "documents", [(i, t, "s") for i, t in texts.items()], "doc_id long, text string, source string")
    want = {}
    for q in best:
        asked = set(texts[q].split())
        found = sorted((-round(0.1 * sum(w in asked for w in t.split()), 6), i) for i, t in texts.items() if asked <= set(t.split()))
        fused = {}
        for src, hits in enumerate((best[q], found)):
            for k, (_, c) in enumerate(hits[:40]):
                score, seen = fused.get(c, (0.0, (src, k)))
                fused[c] = score + 1 / (61 + k), seen
        order = sorted(fused, key=lambda c: (-round(fused[c][0], 9), fused[c][1]))
        want |= {(q, k + 1): c for k, c in enumerate(order[:10])}
    assert {(r["query_id"], r["rank"]): r["chunk_id"] for r in plans.hybrid_rrf(spark, folder).collect()} == want
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["document_id"], r["text"]) for r in plans.retrieved_payload(spark, folder).collect()}
    assert got == {(q, k + 1): (c, c, texts[c]) for q, found in best.items() for k, (_, c) in enumerate(found[:10])}


def test_metrics_over_all_queries(spark, vectors):
    folder, best, labels = vectors
    metrics = {}
    for q, found in best.items():
        right = [k + 1 for k, (_, c) in enumerate(found[:10]) if c != q and labels[c] == labels[q]]
        metrics[q] = (float(bool(right)), round(1 / right[0], 6) if right else 0.0)
    assert {r["query_id"]: (r["hit"], r["rr"]) for r in plans.hit_and_mrr(spark, folder).collect()} == metrics


def test_every_assistant_turn_is_an_answer(spark, tmp_path):
    turns = [(1, 0, "user", "red fox"), (1, 1, "assistant", "The red fox. It ran."), (1, 2, "user", "it ran home"), (1, 3, "assistant", "It ran home. Red fox!"), (1, 4, "user", "red fox ran"), (2, 0, "assistant", "Hello.")]
    table(spark, tmp_path, "conversations", turns, "conv_id long, turn long, role string, text string")
    answers = {(1, 1): ["The red fox.", "It ran."], (1, 3): ["It ran home.", "Red fox!"], (2, 0): ["Hello."]}
    got = {(r["query_id"], r["turn"], r["i"]): r["sentence"] for r in plans.sentences(spark, str(tmp_path)).collect()}
    assert got == {(*key, i): x for key, found in answers.items() for i, x in enumerate(found)}
    got = {(r["query_id"], r["turn"], r["rank"]): r["score"] for r in plans.word_overlap(spark, str(tmp_path)).collect()}
    assert got == {(1, 1, 1): 0.4, (1, 3, 1): 0.4, (1, 3, 3): 0.6}
    got = {(r["query_id"], r["turn"], r["i"]): (r["support_score"], r["n_citations"], r["grounded"]) for r in plans.ground_sentences(spark, str(tmp_path)).collect()}
    assert got == {(1, 1, 0): (0.666667, 1, True), (1, 1, 1): (0.0, 0, False), (1, 3, 0): (1.0, 1, True), (1, 3, 1): (1.0, 1, True), (2, 0, 0): (0.0, 0, False)}


def test_whole_items_are_searched(spark, tmp_path):
    table(spark, tmp_path, "benchmark", [(1, "Red fox ran home, home"), (2, "blue sky"), (3, "red fox ran away")], "item_id long, text string")
    table(spark, tmp_path, "documents", [(1, "red fox ran far"), (2, "home: the red, red fox ran"), (3, "blue blue sky")], "doc_id long, text string")
    assert {(r["query_id"], r["chunk_id"], r["score"]) for r in plans.lexical_simple_topk(spark, str(tmp_path)).collect()} == {(1, 2, 0.5), (2, 3, 0.3)}
    assert {(r["query_id"], r["chunk_id"], r["score"]) for r in plans.rerank_topk(spark, str(tmp_path)).collect()} == {(1, 2, 1.0), (2, 3, 1.0)}


def test_captions_of_all_lines(spark, tmp_path):
    table(spark, tmp_path, "documents", [(1, "a\n\nb\nTable 1: c\nfig. 2\nTables"), (2, None), (5, "x\ny\nz")], "doc_id long, text string")
    got = sorted((r["doc"], r["ord"], r["is_caption"], r["next_ord"]) for r in plans.caption_flags(spark, str(tmp_path)).collect())
    assert got == [(1, 0, False, 1), (1, 1, False, 2), (1, 2, True, 3), (1, 3, True, 4), (1, 4, False, None), (5, 0, True, 1), (5, 1, True, 2), (5, 2, True, None)]


def test_all_documents_are_put_in(spark, tmp_path):
    table(spark, tmp_path, "documents", [(i, f"text {i}") for i in range(12)], "doc_id long, text string")
    table(spark, tmp_path, "labels", [(1, 0, 0), (5, 1, 0), (6, None, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    state = {r["source_path"]: r["status"] for r in plans.content_hash_diff(spark, str(tmp_path)).collect()}
    assert state == {f"doc-{i}": "changed" if i in (1, 7) else "skipped_unchanged" if i in (5, 6) else "new" for i in range(12)}
    ids = {f"doc-{i}": i + 1 for i in (1, 5, 6, 7)}
    ids |= {path: 9 + k for k, path in enumerate(sorted(f"doc-{i}" for i in range(12) if f"doc-{i}" not in ids))}
    got = {r["source_path"]: (r["id"], r["content_hash"]) for r in plans.upsert_documents(spark, str(tmp_path)).collect()}
    assert got == {f"doc-{i}": (ids[f"doc-{i}"], hashlib.sha256(f"text {i}".encode()).hexdigest()) for i in range(12)}
