"""Connected components by contraction: every round each node points to its smallest neighbour, the pointers are
followed to their roots, and the edges between roots go on. Only shuffles and map-side combined minima; nothing but
row counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import cut


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)``: undirected links between long ids. Returns ``(id, component)`` for every id in an edge, with
    the smallest id of its component. Loops and repeated edges are allowed; no edges give no rows."""
    spark = edges.sparkSession
    pairs, n = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while n:
        both = pairs.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(
            pairs.select(F.col("b").alias("id"), F.col("a").alias("to")))
        up, _ = cut(both.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("to")))
        while True:  # follow the pointers; each pass doubles the distance covered
            over = up.select(F.col("id").alias("to"), F.col("to").alias("root"))
            stepped, _ = cut(up.join(over, "to").select("id", F.col("root").alias("to"), (F.col("root") != F.col("to")).alias("moved")))
            up = stepped.select("id", "to")
            if stepped.where("moved").isEmpty():
                break
        root = up.select(F.col("id").alias("was"), F.col("to").alias("root"))
        if labels is None:
            labels = up.select("id", F.col("to").alias("component"))
        else:
            labels = labels.join(root, labels.component == root.was, "left").select(
                "id", F.coalesce("root", "component").alias("component"))
        pairs, n = cut(
            pairs.join(root, pairs.a == root.was).select(F.col("root").alias("a"), "b")
            .join(root.withColumnRenamed("root", "to"), F.col("b") == F.col("was"))
            .select(F.least("a", "to").alias("a"), F.greatest("a", "to").alias("b")).where("a <> b").distinct())
    if labels is None:
        return spark.createDataFrame([], "id long, component long")
    return cut(labels)[0]
