"""Connected components of an edge table, by large-star and small-star rounds on DataFrames.

Each round is two min-aggregations (combined before the shuffle) joined back to their edges; a vertex with very many edges is
therefore a skewed join side, which adaptive execution splits, and never one task's group. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import discard, written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: u, v long. Returns node, root (least node of the component) for every node of an edge between different nodes.

    Rounds grow with the logarithm of the longest path in practice; if max_rounds do not settle them, the run ends with an error,
    never with a partial answer. A round's table goes as soon as the next one is written.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    e, path = written(e, "edges")
    last = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u goes to the least of u and its neighbours
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        e, after = written(small, "edges")
        discard(spark, path)
        path = after
        state = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
