from docloom.operators.models import HashedEmbedder
from docloom.operators.store import CHUNKS, Library
from docloom.streaming.arrivals import take_in
from pyspark.sql import functions as F


def test_files_arrive_in_batches(spark, tmp_path):
    folder, library, checkpoint = (str(tmp_path / x) for x in ("in", "library", "checkpoint"))
    (tmp_path / "in").mkdir()

    def run():
        take_in(spark, folder, library, HashedEmbedder(), checkpoint, most=2).awaitTermination()
        return {r["source_path"].rsplit("/", 1)[1] for r in Library(spark, library).documents().collect()}

    assert run() == set()
    for name, text in (("a.txt", "One passage."), ("b.html", "<html><body><p>Two passages.</p></body></html>"), ("c.txt", "Three."), ("_d.txt", "left aside"), ("e.txt", "")):
        (tmp_path / "in" / name).write_text(text)
    assert run() == {"a.txt", "b.html", "c.txt"}
    chunks = Library(spark, library).count_chunks()
    assert chunks >= 3
    (tmp_path / "in" / "f.txt").write_text("Four.")
    assert run() == {"a.txt", "b.html", "c.txt", "f.txt"}
    assert Library(spark, library).count_chunks() == chunks + 1
    assert spark.read.parquet(f"{library}/arrivals").where(F.col("status") == "indexed").count() == 4


def test_a_take_in_that_broke_off_leaves_no_chunk_twice(spark, tmp_path):
    store = Library(spark, str(tmp_path / "library"))
    files = spark.createDataFrame([("a.txt", bytearray(b"One passage."))], "source_path string, content binary")
    # what a run leaves that ends between its chunks and its documents
    store.store.append("chunks", spark.createDataFrame([(1, 1, 0, "structure", "One passage.", None, [], 0, 12, False, [0.5], 1)], CHUNKS))
    store.ingest(files, HashedEmbedder())
    assert store.count_chunks() == 1
