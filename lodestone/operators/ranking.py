"""Ranks over groups of any size, reliable checkpoints, and round-robin merges."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only where none is set and all runs on this machine."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestone-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(True)


def shards(spark: SparkSession) -> int:
    """How many parts rows are dealt to that cost much time and few bytes each: AQE would put small bytes into few tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt by columns to a fixed number of parts, so that one file or row group is not one task."""
    return df.repartition(shards(df.sparkSession), *by)


def global_rank(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """row_number() within `by`, whatever the size of a group: rows are dealt by range, numbered in their
    partition, and shifted by the counts of the partitions before (one small row for each partition and group)."""
    dealt = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    dealt = cut(dealt.withColumn("_id", F.monotonically_increasing_id()))
    at = F.shiftright("_id", 33)
    parts = dealt.groupBy(*by, at.alias("_part")).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("_before", before).drop("_n")
    return dealt.withColumn("_part", at).join(parts, [*by, "_part"]).withColumn(name, F.col("_id") - F.col("_first") + F.col("_before") + 1).drop("_id", "_part", "_first", "_before")


def top_rows(df: DataFrame, by: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group. Spark keeps n rows a group and task before the shuffle (a group limit)."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)


def with_totals(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """top_rows() with the true number of rows of the group; counts are aggregated apart, so no group is gathered."""
    total = df.groupBy(*by).agg(F.count("*").alias("total"))
    return top_rows(df, by, order, n).join(total, by)


def round_robin(df: DataFrame, query: str, source: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each query when its sources take turns, each in its own order."""
    own = top_rows(df, [query, source], order, n, "turn")
    return top_rows(own, [query], [F.col("turn"), F.col(source)], n, "place")


def fuse(ranks: DataFrame, keys: list[str], k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of (keys, rank): the sum of 1 / (k + rank)."""
    return ranks.groupBy(*keys).agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("rrf"))
