"""Connected components of an edge table by alternating large and small stars, with no edge on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._shared import written


def components(edges: DataFrame) -> DataFrame:
    """v, root: the smallest vertex of v's component, for every v that is not itself the smallest. edges: a, b of one type."""
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("w")).distinct(), "edges")
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("w").alias("v"), F.col("v").alias("w")))
        # least is written each time: with no aggregation beside the join, Spark can split the rows of a hub
        least = written(both.groupBy("v").agg(F.least(F.min("w"), F.first("v")).alias("m")), "least")
        large = written(both.join(least, "v").where("w > v").select(F.col("w").alias("v"), F.col("m").alias("w")).where("v <> w").distinct(), "large")
        least = written(large.groupBy("v").agg(F.min("w").alias("m")), "least")
        small = large.join(least, "v").where("w <> m").select(F.col("w").alias("v"), F.col("m").alias("w"))
        e = written(small.unionByName(least.select("v", F.col("m").alias("w"))).distinct(), "edges")
        now = _state(e)
        if now == state:
            break
        state = now
    return e.select("v", F.col("w").alias("root"))


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("v", "w") % 1_000_003), F.bit_xor(F.xxhash64("w", "v"))).first())
