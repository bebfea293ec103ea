"""Connected components, evidence families, exact-text groups and lineage checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ranking import cut


def exact_groups(df: DataFrame, text: str, row: str) -> DataFrame:
    """(sha256, copies, first_id) of texts that occur more than once; partial aggregation, no lists."""
    g = df.groupBy(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("sha256"))
    return g.agg(F.count("*").alias("copies"), F.min(row).alias("first_id")).where("copies > 1")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable, for every node.

    Minima travel over edges while each node's label also follows its label's label, so long chains halve;
    each round is checkpointed, and no neighbourhood is gathered."""
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    both = cut(both)
    label = cut(nodes.select("id").distinct().withColumn("root", F.col("id")))
    while True:
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        step = label.join(near, "id", "left").select("id", F.least("root", F.coalesce("near", "root")).alias("mid"), F.col("root").alias("was"))
        jump = label.select(F.col("id").alias("mid"), F.col("root").alias("far"))
        now = cut(step.join(jump, "mid").select("id", F.least("mid", "far").alias("root"), "was"))
        if now.where("root <> was").isEmpty():
            return now.select("id", "root")
        label = now.select("id", "root")


def families(df: DataFrame, row: str, keys: list[str]) -> DataFrame:
    """(id, root): rows that share a value of any key column are one family. A value links each row to its
    smallest row only, so a value that a third of all rows share gives one edge a row."""
    edges = None
    for k in keys:
        first = df.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(row).alias("b"))
        e = df.select(F.col(row).alias("a"), k).join(first, k).select("a", "b")
        edges = e if edges is None else edges.union(e)
    return components(df.select(F.col(row).alias("id")), edges)


def reachable(spark, edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(root, id, steps): shortest walks of up to `depth` steps along a -> b from the starting ids."""
    found = start.select(F.col("id").alias("root"), "id", F.lit(0).alias("steps"))
    edge = found
    for k in range(1, depth + 1):
        edge = edge.join(edges, edge.id == edges.a).select("root", F.col("b").alias("id"), F.lit(k).alias("steps")).distinct()
        found = found.union(edge)
    return found.groupBy("root", "id").agg(F.min("steps").alias("steps"))
