"""Published tables with a receipt, and their verification on reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digest(df: DataFrame) -> DataFrame:
    """One row (rows, digest) that any change of a row changes: sums of 64-bit row hashes, whatever the order."""
    h = F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in df.columns])
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def publish(df: DataFrame, path: str, new: bool = True, fmt: str = "parquet") -> None:
    """Writes data and receipt; with `new`, an existing table is an error."""
    mode = "errorifexists" if new else "overwrite"
    df.write.mode(mode).format(fmt).save(f"{path}/data")
    back = df.sparkSession.read.format(fmt).schema(df.schema).load(f"{path}/data")
    digest(back).withColumn("format", F.lit(fmt)).coalesce(1).write.mode(mode).json(f"{path}/receipt")


def read_published(spark: SparkSession, path: str, schema) -> DataFrame:
    """The data, after its receipt was compared; a difference is an error."""
    want = spark.read.json(f"{path}/receipt").first()
    df = spark.read.format(want["format"]).schema(schema).load(f"{path}/data")
    have = digest(df).first()
    if (have["rows"], have["digest"]) != (want["rows"], want["digest"]):
        raise ValueError("RECEIPT_MISMATCH")
    return df


# What a packet never claims.
AUTHORITY = {"execute": False, "deploy": False, "market_validated": False, "novelty_established": False}


def publish_packet(tables: dict[str, DataFrame], path: str) -> None:
    """A new folder with each table as gzipped JSON lines, a receipt for each and what the packet claims; an existing one is an error."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in sorted(tables.items()):
        df.write.mode("errorifexists").option("compression", "gzip").json(f"{path}/{name}")
        back = spark.read.schema(df.schema).json(f"{path}/{name}")
        digest(back).withColumn("name", F.lit(name)).coalesce(1).write.mode("errorifexists").json(f"{path}/receipts/{name}")
    spark.createDataFrame(sorted(AUTHORITY.items()), "claim string, granted boolean").coalesce(1).write.mode("errorifexists").json(f"{path}/authority")


def verify_packet(spark: SparkSession, path: str, schemas: dict) -> DataFrame:
    """(name, rows, code) of each expected table: what is on disk held against its receipt; any granted claim refuses them all."""
    granted = spark.read.schema("claim string, granted boolean").json(f"{path}/authority").agg(F.coalesce(F.max("granted"), F.lit(True)).alias("granted"))
    out = None
    for name, schema in sorted(schemas.items()):
        have = digest(spark.read.schema(schema).json(f"{path}/{name}")).withColumn("name", F.lit(name))
        want = spark.read.schema("rows long, digest string, name string").json(f"{path}/receipts/{name}")
        j = have.join(want.select("name", F.col("rows").alias("_rows"), F.col("digest").alias("_digest")), "name", "left").crossJoin(granted)  # one row each
        code = F.when(F.col("granted"), "AUTHORITY_CLAIMED").when(F.col("_digest").isNull(), "RECEIPT_MISSING").when((F.col("_rows") != F.col("rows")) | (F.col("_digest") != F.col("digest")), "RECEIPT_MISMATCH").otherwise("VERIFIED")
        part = j.select("name", "rows", code.alias("code"))
        out = part if out is None else out.union(part)
    return out
