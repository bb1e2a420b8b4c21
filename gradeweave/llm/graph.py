"""Connected components of a graph whose edges are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeweave.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges of longs to (node, root), for every node of an edge.

    Rounds of contraction: each node joins the neighbour of lowest random
    rank, if that is below its own; chains are halved twice; the edges between
    what is left go on. Edges shrink by a constant factor a round, hubs cost
    one row per neighbour after the partial aggregation, and every round's
    tables are written to the shared folder.
    """
    spark = edges.sparkSession
    left = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "graph-edges")
    roots = None
    salt = 0
    while left.limit(1).count():
        salt += 1
        rank = lambda c, s=salt: F.struct(F.xxhash64(F.lit(s), F.col(c)), F.col(c))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("low"))
        step = step.select("node", F.when(F.col("low") < rank("node"), F.col("low.b")).otherwise(F.col("node")).alias("to"))
        step = materialize(step, "graph-step")
        for _ in range(2):
            far = step.select(F.col("node").alias("to"), F.col("to").alias("far"))
            step = step.join(far, "to").select("node", F.col("far").alias("to"))
        step = materialize(step, "graph-step")
        a, b = (step.select(F.col("node").alias(c), F.col("to").alias(f"{c}2")) for c in "ab")
        left = left.join(a, "a").join(b, "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).where("a <> b").distinct()
        left = materialize(left, "graph-edges")
        if roots is None:
            roots = step.select("node", F.col("to").alias("root"))
        else:
            roots = roots.join(step.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = materialize(roots, "graph-roots")
    return roots if roots is not None else spark.createDataFrame([], "node bigint, root bigint")
