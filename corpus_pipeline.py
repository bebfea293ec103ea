"""The corpus pipeline: language, near duplicates, benchmark copies, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; run() writes each
stage's result as Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common as C
from lodestone.llm import contamination, language, near_dedup, pieces, secrets

#: A document goes if no language reaches this probability (four even ones have 0.25).
LEAST_SURE = 0.35


def own_name(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have, in any case of its letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (null and empty texts too) and those whose language is unsure: texts that mix languages evenly
    or resemble none that was learned. An unlabelled corpus keeps all texts with letters. Rows are judged one by one."""
    net = language.train(docs)
    C.tune(spark)
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    seen = own_name(docs, "seen")
    both = docs.withColumn(seen, language.label_texts(net)("text"))
    return both.where((F.col(f"{seen}.lang_pred") != "und") & (F.col(f"{seen}.score") >= LEAST_SURE)).select(docs.columns)


def near_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays, that of the smallest doc_id (null last). A document is an id with its text, so rows
    that share an id, or have none, are compared by what they say; rows of the same id and text are one document. Null and empty
    texts resemble nothing: one row of each id stays."""
    columns = docs.columns
    key = own_name(docs, "key")
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), "text"))
    groups = near_dedup.near_groups(keyed.select(F.col(key).alias("doc_id"), "text"))
    groups = groups.groupBy(F.col("doc_id").alias(key)).agg(F.min("component_id").alias("group"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), F.col(key).alias("key"))
    ids = keyed.groupBy(key).agg(F.min(order).alias("order"))
    kept = ids.join(groups, key).groupBy("group").agg(F.min("order").alias("order")).select(F.col("order.key").alias(key))
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).select(columns)


def benchmark_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a test item go. Null and empty texts hold none and stay; so do all where there are no items."""
    C.tune(spark)
    blocks = contamination.prepare(docs, C.table(spark, sf_dir, "benchmark"))
    return docs.where(~contamination.holds_copy(blocks)("text")) if blocks else docs


def secret_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; n_chars follows. A null text stays null, and so does its n_chars."""
    C.tune(spark)
    return docs.withColumn("text", secrets.redact("text")).withColumn("n_chars", F.length("text").cast("long"))


def token_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of each document, with their digests. Null texts count as empty ones: no ids."""
    import public_tokenizers

    return pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language ID", language_stage),
    ("near-duplicates", near_stage),
    ("decontamination", benchmark_stage),
    ("secret scans", secret_stage),
    ("SentencePiece", token_stage),
]

#: Trained and learnt stages aren't SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    at = f"{C.checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
