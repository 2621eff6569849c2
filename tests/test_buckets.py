import hashlib

import pytest
from docloom.operators.buckets import Buckets
from docloom.operators.models import HashedEmbedder
from docloom.operators.store import CHUNKS, DOCUMENTS, Library

FILES = "source_path string, content binary"


def files(spark, **texts):
    return spark.createDataFrame([(f"{name}.txt", bytearray(text.encode())) for name, text in texts.items()], FILES)


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def stored(library):
    return sorted((r["source_document"], r["text"]) for r in library.chunks().collect())


def test_chunks_join_their_documents_without_a_shuffle(spark, tmp_path, no_broadcast):
    library = Library(spark, str(tmp_path / "library"), buckets=8)
    library.ingest(files(spark, a="One.", b="Two.", c="Three."), HashedEmbedder(4))
    assert stored(library) == [("a.txt", "One."), ("b.txt", "Two."), ("c.txt", "Three.")]
    assert "Exchange" not in plan(library.chunks())
    assert "Exchange" in plan(library.chunks(whole=False)) and sorted(r["text"] for r in library.chunks(whole=False).collect()) == ["One.", "Three.", "Two."]


def test_a_document_is_read_from_its_bucket(spark, tmp_path, no_broadcast):
    library = Library(spark, str(tmp_path / "library"), buckets=8)
    library.ingest(files(spark, a="One.", b="Two."), HashedEmbedder(4))
    number = {r["source_path"]: r["id"] for r in library.documents().collect()}["b.txt"]
    found = library.document(number)
    assert found.first()["source_path"] == "b.txt" and "SelectedBucketsCount: 1 out of 8" in plan(found)
    assert library.count_chunks(number) == 1 and library.count_chunks(99) == 0 and library.document(99).isEmpty()
    one = library.chunks().where(f"document_id = {number}")
    assert plan(one).count("SelectedBucketsCount: 1 out of 8") == 2


def test_compaction_leaves_what_counts_and_gives_no_id_again(spark, tmp_path):
    path = str(tmp_path / "library")
    library = Library(spark, path, buckets=4)
    library.ingest(files(spark, a="One.", b="Two.", c="Three."), HashedEmbedder(4))
    library.ingest(files(spark, a="One anew."), HashedEmbedder(4))
    gone = max(r["id"] for r in library.documents().collect())
    assert library.delete({r["id"]: r["source_path"] for r in library.documents().collect()}[gone])
    before = stored(library), sorted(library.documents().collect())
    for buckets in (None, 3, 4):
        library.compact(buckets)
        assert (stored(library), sorted(library.documents().collect())) == before
        assert library._rows("chunks").count() == 2 and library._rows("documents").count() == 3
    assert {p.name for p in (tmp_path / "library").iterdir()} == {"generations", "generation-3", "generation-4"}
    assert stored(Library(spark, path)) == before[0] and Library(spark, path).store.buckets == 4
    library.ingest(files(spark, d="Four."), HashedEmbedder(4))
    assert {r["source_path"]: r["id"] for r in library.documents().collect()}["d.txt"] == gone + 1


def test_what_breaks_off_leaves_the_state_before(spark, tmp_path, monkeypatch):
    library = Library(spark, str(tmp_path / "library"), buckets=4)
    library.ingest(files(spark, a="One.", b="Two."), HashedEmbedder(4))
    before, write = stored(library), Buckets._write

    def broken(at):
        def run(self, name, *rest):
            if name == at:
                raise RuntimeError("lost")
            write(self, name, *rest)

        return run

    monkeypatch.setattr(Buckets, "_write", broken("documents"))  # chunks are there, their documents are not
    with pytest.raises(RuntimeError):
        library.ingest(files(spark, a="One anew.", c="Three."), HashedEmbedder(4))
    monkeypatch.setattr(Buckets, "_write", broken("chunks"))
    with pytest.raises(RuntimeError):
        library.compact(2)
    monkeypatch.setattr(Buckets, "_write", write)
    assert stored(library) == before == stored(Library(spark, library.path)) and library.store.buckets == 4
    library.compact(2)  # over what the broken one left
    assert stored(library) == before and library._rows("chunks").count() == 2
    library.ingest(files(spark, a="One anew.", c="Three."), HashedEmbedder(4))
    assert stored(library) == [("a.txt", "One anew."), ("b.txt", "Two."), ("c.txt", "Three.")]


def test_another_session_appends_and_compacts(spark, tmp_path):
    path = str(tmp_path / "it's here")
    reader = Library(spark, path, buckets=4)
    assert stored(reader) == [] and reader.documents().isEmpty()
    writer = Library(spark.newSession(), path)
    writer.ingest(files(writer.spark, a="One."), HashedEmbedder(4))
    assert stored(reader) == [("a.txt", "One.")]
    writer.compact()
    assert stored(reader) == [("a.txt", "One.")]  # of the generation before, which stays once
    reader.ingest(files(spark, b="Two."), HashedEmbedder(4))  # writers take up the newest
    assert stored(reader) == stored(writer) == [("a.txt", "One."), ("b.txt", "Two.")]


def test_plain_tables_of_before_are_taken_over(spark, tmp_path):
    path = str(tmp_path / "library")
    row = (5, "a.txt", "plain_text", "h", 1, 1, 0, 0, 0, 4, [], None, None, 2, False)
    spark.createDataFrame([row, (*row[:2], "html", *row[3:-2], 1, False)], DOCUMENTS).write.parquet(f"{path}/documents")
    spark.createDataFrame([(i, 5, i, "structure", f"v{v}", None, [], 0, 2, False, [0.5], v) for i, v in enumerate((1, 2))], CHUNKS).write.parquet(f"{path}/chunks")
    assert stored(Library(spark, path)) == [("a.txt", "v2")] == stored(Library(spark, path))
    assert Library(spark, path).document(5).first()["doc_type"] == "plain_text"


def test_repeated_paths_null_keys_and_empty_tables(spark, tmp_path):
    library = Library(spark, str(tmp_path / "library"))
    library.ingest(files(spark), HashedEmbedder(4))
    library.compact()
    assert stored(library) == []
    texts = ["One.", "Two.", "Three."]
    rows = [("a.txt", bytearray(t.encode())) for t in texts]
    library.ingest(spark.createDataFrame(rows + rows, FILES), HashedEmbedder(4))
    assert stored(library) == [("a.txt", max(texts, key=lambda t: hashlib.sha256(t.encode()).hexdigest()))]

    plain = Buckets(spark, str(tmp_path / "plain"), {"t": ("k bigint, v string", "k", ["k", "v"])}, 2)
    plain.append("t", spark.createDataFrame([(None, "x"), (1, None), (1, "y")], "k int, v string"))
    assert sorted(map(str, plain.rows("t").collect())) == ["Row(k=1, v='y')", "Row(k=1, v=None)", "Row(k=None, v='x')"]
    with pytest.raises(ValueError):
        Buckets(spark, str(tmp_path / "none"), {}, 0)
