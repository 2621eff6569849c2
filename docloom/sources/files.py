"""Files, corpora and questions in; results out."""

from __future__ import annotations

import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_COLUMNS = ("extraction", "chunking", "retrieval", "rerank", "n_questions", "n_graded", "recall_at_k", "mrr", "latency_p50_ms", "latency_p95_ms", "groundedness_rate", "unanswerable_decline_rate", "avg_response_tokens", "total_wall_seconds")


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """source_path and content of files; null content for those that are not there. Paths are read as Spark reads them."""
    wanted = spark.createDataFrame([(p, "/" + p.split(":", 1)[-1].lstrip("/")) for p in paths], "source_path string, place string")
    if not paths:
        return wanted.select("source_path", F.lit(None).cast("binary").alias("content"))
    globbed = [p.replace("\\", "\\\\").replace("{", "\\{").replace("[", "\\[").replace("*", "\\*").replace("?", "\\?") for p in paths]
    # folders are listed with a filter by name, so that a missing file is no error
    folders = sorted({os.path.dirname(p) or "." for p in paths})
    found = None
    for folder in folders:
        names = ",".join(os.path.basename(g) for g, p in zip(globbed, paths) if (os.path.dirname(p) or ".") == folder)
        try:
            part = spark.read.format("binaryFile").option("pathGlobFilter", "{" + names + "}").load(folder).select("path", "content")
        except Exception as wrong:  # noqa: BLE001 - a missing folder is a missing file
            if "PATH_NOT_FOUND" not in str(wrong):
                raise
            continue
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "path string, content binary")
    found = found.withColumn("place", F.url_decode(F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), r"\+", "%2B")))
    # the reader leaves files of no bytes out
    content = F.when(F.col("source_path").isin(_empty(spark, paths)), F.encode(F.lit(""), "UTF-8")).otherwise(F.col("content"))
    return wanted.join(found, "place", "left").select("source_path", content.alias("content"))


def _empty(spark: SparkSession, paths: list[str]) -> list[str]:
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for p in paths:
        place = jvm.org.apache.hadoop.fs.Path(p)
        files = place.getFileSystem(conf)
        if files.exists(place) and files.getFileStatus(place).isFile() and not files.getFileStatus(place).getLen():
            out.append(p)
    return out


def scan_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """source_path and content of the files in a folder, not below it, whose names begin with neither _ nor a dot."""
    files = spark.read.format("binaryFile").load(folder)
    return files.where(~F.element_at(F.split("path", "/"), -1).rlike(r"^[_.]")).select(F.col("path").alias("source_path"), "content")


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """id, question, expected_documents and category, from the list `questions` of a JSON object; other keys are left aside."""
    schema = "questions array<struct<id: string, question: string, expected_documents: array<string>, category: string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("questions").alias("q")).select("q.*")


def _shown(value) -> str:
    return "" if value is None else str(value)


def write_results(rows: list[dict], folder: str) -> str:
    """The few rows of an evaluation as a CSV file named by the time, and the same as latest.csv; the file's path."""
    import csv
    import io

    out = io.StringIO(newline="")
    made = csv.writer(out)
    made.writerow(RESULT_COLUMNS)
    made.writerows([[_shown(r.get(c)) for c in RESULT_COLUMNS] for r in rows])
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"results_{datetime.now(timezone.utc):%Y%m%dT%H%M%SZ}.csv")
    for p in (path, os.path.join(folder, "latest.csv")):
        with open(p, "w", newline="", encoding="utf-8") as f:
            f.write(out.getvalue())
    return path


def results_table(rows: list[dict]) -> str:
    """The rows as padded columns; those about answers only where any has one."""
    columns = [("extraction", "extraction", "{}"), ("chunking", "chunking", "{}"), ("retrieval", "retrieval", "{}"), ("rerank", "rerank", "{}"), ("recall_at_k", "recall@k", "{:.2f}"), ("mrr", "MRR", "{:.2f}"), ("latency_p50_ms", "p50 ms", "{:.0f}"), ("latency_p95_ms", "p95 ms", "{:.0f}")]
    if any(r.get("groundedness_rate") is not None for r in rows):
        columns += [("groundedness_rate", "grounded", "{:.2f}"), ("unanswerable_decline_rate", "declined", "{:.2f}"), ("avg_response_tokens", "tokens", "{:.0f}")]
    cells = [[title for _, title, _ in columns]] + [["-" if r.get(c) is None else form.format(r[c]) for c, _, form in columns] for r in rows]
    wide = [max(map(len, x)) for x in zip(*cells)]
    cells.insert(1, ["-" * w for w in wide])
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(line, wide)).rstrip() for line in cells)


