"""Job ledgers as tables: hash-chained events, latest states, leases, status, resumption."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed value: the digest before the first event.
GENESIS = "0" * 64


def chain_events(events: DataFrame, job: str, seq: str, body: Column) -> DataFrame:
    """(job, seq, previous, sha256): each event's digest covers its body and the digest before it.

    A chain is sequential by nature: jobs are dealt by hash, sorted, and read as a stream in which only the last digest is held, so a
    job of any length takes linear time and no memory. Jobs side by side."""
    e = events.select(job, F.col(seq).cast("long").alias(seq), body.alias("body"))
    kind = e.schema[job].dataType.simpleString()
    return e.repartition(job).sortWithinPartitions(job, seq).mapInArrow(_chained, f"{job} {kind}, {seq} long, previous string, sha256 string")


def _chained(batches):
    job, last = None, GENESIS
    for batch in batches:
        before, after = [], []
        for j, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if j != job:
                job, last = j, GENESIS
            before.append(last)
            last = hashlib.sha256((last + (body or "")).encode()).hexdigest()
            after.append(last)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(before, pa.string()), pa.array(after, pa.string())], [*batch.schema.names[:2], "previous", "sha256"])


def verify_chain(events: DataFrame, job: str, seq: str, body: Column) -> DataFrame:
    """(job, events, broken): rows whose `previous` or `sha256` does not follow; one window over each job."""
    w = W.partitionBy(job).orderBy(seq)
    want = F.coalesce(F.lag("sha256").over(w), F.lit(GENESIS))
    bad = (F.col("previous") != want) | (F.col("sha256") != F.sha2(F.concat(F.col("previous"), body), 256))
    return events.withColumn("_bad", bad.cast("long")).groupBy(job).agg(F.count("*").alias("events"), F.sum("_bad").alias("broken"))


def latest(events: DataFrame, keys: list[str], seq: str, columns: list[str]) -> DataFrame:
    """Each key's columns at its highest seq: an aggregation (max_by), no window and no sort."""
    return events.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.col(seq)).alias("x"), F.max(seq).alias(seq)).select(*keys, seq, *[f"x.{c}" for c in columns])


def attempts_left(tasks: DataFrame, now: Column, most: int = 2) -> DataFrame:
    """Tasks with their state after expired leases went back: queued while attempts are left, else failed."""
    expired = (F.col("status") == "LEASED") & (F.col("expires") <= now)
    return tasks.withColumn("next_status", F.when(expired & (F.col("attempts") < most), "QUEUED").when(expired, "FAILED").otherwise(F.col("status")))


def status_counts(tasks: DataFrame, status: str, attempts: str) -> DataFrame:
    return tasks.groupBy(status).agg(F.count("*").alias("tasks"), F.sum(attempts).alias("attempts"))


def job_state(counts: DataFrame, job: str) -> DataFrame:
    """Each job's overall state from its task counts (failed, leased, queued, done), by precedence."""
    state = F.when(F.col("failed") > 0, "BLOCKED_TASK_FAILURE").when((F.col("leased") > 0) | (F.col("queued") > 0), "WORK_REMAINS").when(F.col("done") > 0, "COMPLETED").otherwise("EMPTY")
    return counts.withColumn("state", state).select(job, "state", "failed", "leased", "queued", "done")


def pending(inputs: DataFrame, done: DataFrame, key: str, digest: str) -> DataFrame:
    """Inputs without a checkpoint of the same key and digest: an anti join on both."""
    return inputs.join(done.select(key, digest).distinct(), [key, digest], "left_anti")


def verdicts(baseline: DataFrame, candidate: DataFrame, case: str, least_gain: int) -> DataFrame:
    """One row: correct cases, regressions, net gain and status of a candidate against its baseline.

    baseline and candidate hold (case, correct)."""
    j = baseline.select(case, F.col("correct").alias("_b")).join(candidate.select(case, F.col("correct").alias("_c")), case, "full_outer")
    c, b = F.coalesce("_c", F.lit(False)), F.coalesce("_b", F.lit(False))
    s = j.agg(
        F.count("*").alias("cases"),
        F.sum(c.cast("long")).alias("correct"),
        F.sum((b & ~c).cast("long")).alias("regressions"),
        (F.sum(c.cast("long")) - F.sum(b.cast("long"))).alias("gain"),
    )
    status = F.when((F.col("regressions") > 0) | (F.col("gain") < least_gain), "REJECTED").when(F.col("correct") < F.col("cases"), "IMPROVED_BUT_INCOMPLETE").otherwise("READY_FOR_ADOPTION_REVIEW")
    return s.withColumn("status", status)
