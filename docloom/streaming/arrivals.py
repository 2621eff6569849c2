"""Files that arrive in a folder, taken into a library batch by batch.

A batch that is run again after a failure finds its files unchanged or takes them in anew; a library
publishes a document's chunks with the document, so no chunk counts twice. A file is seen once: one
that changes in place under its name is not read again (scan_corpus with Library.ingest does that).

Defined results: names that begin with _ or a dot are left aside, as are files of no bytes, which the
reader does not give. An empty folder starts no batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.store import Library

FILES = "path string, modificationTime timestamp, length long, content binary"
#: Files of one batch at most; those beyond come with the batches after it.
FILES_A_BATCH = 10_000


def arriving(spark: SparkSession, folder: str, most: int = FILES_A_BATCH) -> DataFrame:
    """source_path and content of the files of a folder, as a stream."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", most).load(folder)
    return files.where(~F.element_at(F.split("path", "/"), -1).rlike(r"^[_.]")).select(F.col("path").alias("source_path"), "content")


def take_in(spark: SparkSession, folder: str, library: str, embedder, checkpoint: str, ocr=None, every: str | None = None, most: int = FILES_A_BATCH) -> StreamingQuery:
    """A started query that takes what arrives in folder into the library at a path; what became of each file is under library/arrivals, by batch.

    every: how often to look, as "1 minute"; without it the query ends when all that lies there is in.
    checkpoint: a folder that all executors share, the same at each start.
    """

    def batch(files: DataFrame, number: int) -> None:
        report = Library(files.sparkSession, library).ingest(files, embedder, ocr)
        report.write.mode("overwrite").parquet(f"{library.rstrip('/')}/arrivals/batch={number}")

    started = arriving(spark, folder, most).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (started.trigger(processingTime=every) if every else started.trigger(availableNow=True)).start()
