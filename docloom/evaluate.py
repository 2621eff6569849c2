"""python -m docloom.evaluate CORPUS QUESTIONS [--k K] [--with-answers] [--results FOLDER]: the evaluation matrix."""

from __future__ import annotations

import argparse
import tempfile

from pyspark.sql import SparkSession

from docloom.operators.evaluation import run_matrix
from docloom.operators.models import ExtractiveGenerator
from docloom.sources.files import load_questions, results_table, scan_corpus, write_results


def main(argv: list[str] | None = None) -> int:
    options = argparse.ArgumentParser(description=__doc__)
    options.add_argument("corpus")
    options.add_argument("questions")
    options.add_argument("--k", type=int, default=5)
    options.add_argument("--with-answers", action="store_true")
    options.add_argument("--results", default="results")
    options.add_argument("--index", help="folder for the indexed chunks; must be shared on a cluster")
    given = options.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if given.index is None and not spark.sparkContext.master.startswith("local"):
        options.error("--index must name a shared folder on a cluster")
    path = given.index or tempfile.mkdtemp(prefix="docloom-")
    rows = run_matrix(scan_corpus(spark, given.corpus), load_questions(spark, given.questions), path, given.k, generator=ExtractiveGenerator() if given.with_answers else None)
    print(results_table(rows))
    print("wrote", write_results(rows, given.results))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
