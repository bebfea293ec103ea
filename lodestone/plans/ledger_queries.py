"""Queries over job ledgers; `events` stands for one: user_id is the job, event_id the sequence, event_type the kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import ledger
from lodestone.plans.text_queries import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def body():
    return F.concat_ws("|", F.col("event_id").cast("string"), "event_type")


_CHAIN = """o AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
c(user_id, event_id, k, previous, sha256) AS (SELECT user_id, event_id, k, repeat('0', 64), sha256(repeat('0', 64) || event_id || '|' || event_type) FROM o WHERE k = 1
  UNION ALL SELECT o.user_id, o.event_id, o.k, c.sha256, sha256(c.sha256 || o.event_id || '|' || o.event_type) FROM c JOIN o ON o.user_id = c.user_id AND o.k = c.k + 1)"""


@query("event_chain", f"WITH RECURSIVE {_CHAIN} SELECT user_id, event_id, previous, sha256 FROM c")
def event_chain(spark, sf_dir):
    return ledger.chain_events(table(spark, sf_dir, "events"), "user_id", "event_id", body())


@query("verified_chain", f"WITH RECURSIVE {_CHAIN} SELECT user_id, count(*) AS events, sum(CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END)::BIGINT AS broken FROM c GROUP BY user_id")
def verified_chain(spark, sf_dir):
    """Chains in which every 97th event was altered after it was written: each such event is found."""
    e = table(spark, sf_dir, "events")
    chain = ledger.chain_events(e, "user_id", "event_id", body()).join(e.select("user_id", "event_id", "event_type"), ["user_id", "event_id"])
    changed = F.when(F.col("event_id") % 97 == 0, F.concat("event_type", F.lit("!"))).otherwise(F.col("event_type"))
    return ledger.verify_chain(chain.withColumn("event_type", changed), "user_id", "event_id", body())


@query("latest_states", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def latest_states(spark, sf_dir):
    return ledger.latest(table(spark, sf_dir, "events"), ["user_id"], "event_id", ["event_type", "value"])


@query("status_counts", "SELECT o_orderstatus, count(*) AS tasks, round(sum(o_totalprice), 2) AS attempts FROM orders GROUP BY 1")
def status_counts(spark, sf_dir):
    return ledger.status_counts(table(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice").withColumn("attempts", F.round("attempts", 2))


@query(
    "job_states",
    """WITH c AS (SELECT o_custkey AS job, count(*) FILTER (o_orderstatus = 'X') AS failed, count(*) FILTER (o_orderstatus = 'P') AS leased, count(*) FILTER (o_orderstatus = 'O') AS queued, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY 1)
    SELECT job, CASE WHEN failed > 0 THEN 'BLOCKED_TASK_FAILURE' WHEN leased > 0 OR queued > 0 THEN 'WORK_REMAINS' WHEN done > 0 THEN 'COMPLETED' ELSE 'EMPTY' END AS state, failed, leased, queued, done FROM c""",
)
def job_states(spark, sf_dir):
    """Each customer's orders as tasks: F done, P leased, O queued."""
    n = lambda s: F.sum((F.col("o_orderstatus") == s).cast("long"))
    c = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("job")).agg(n("X").alias("failed"), n("P").alias("leased"), n("O").alias("queued"), n("F").alias("done"))
    return ledger.job_state(c, "job")


@query(
    "lease_expiry",
    """SELECT next_status, count(*) AS tasks FROM (SELECT CASE WHEN l_linestatus = 'O' AND l_shipdate <= TIMESTAMP '1996-06-01' THEN CASE WHEN l_linenumber < 2 THEN 'QUEUED' ELSE 'FAILED' END WHEN l_linestatus = 'O' THEN 'LEASED' ELSE 'DONE' END AS next_status FROM lineitem) GROUP BY 1""",
)
def lease_expiry(spark, sf_dir):
    """Open lines as leases that end at their ship date, line numbers as attempts."""
    li = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linestatus") == "O", "LEASED").otherwise("DONE").alias("status"), F.col("l_shipdate").alias("expires"), F.col("l_linenumber").alias("attempts"))
    t = ledger.attempts_left(li, F.to_timestamp(F.lit("1996-06-01")))
    return t.groupBy("next_status").agg(F.count("*").alias("tasks"))


@query("pending_inputs", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND sha256(l.quality || '') = sha256((d.n_chars % 2) || ''))")
def pending_inputs(spark, sf_dir):
    """Documents without a checkpoint of the same id and digest."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2((F.col("n_chars") % 2).cast("string"), 256).alias("sha256"))
    done = table(spark, sf_dir, "labels").select("doc_id", F.sha2(F.col("quality").cast("string"), 256).alias("sha256"))
    return ledger.pending(d, done, "doc_id", "sha256").select("doc_id")


@query(
    "candidate_verdict",
    """WITH j AS (SELECT coalesce(b.doc_id, c.doc_id), coalesce(b.quality = 1, false) AS b, coalesce(c.ok, false) AS c FROM labels b FULL JOIN (SELECT doc_id, n_chars > 500 AS ok FROM documents) c USING (doc_id)),
    s AS (SELECT count(*) AS cases, sum(c::INT)::BIGINT AS correct, sum((b AND NOT c)::INT)::BIGINT AS regressions, (sum(c::INT) - sum(b::INT))::BIGINT AS gain FROM j)
    SELECT *, CASE WHEN regressions > 0 OR gain < 1 THEN 'REJECTED' WHEN correct < cases THEN 'IMPROVED_BUT_INCOMPLETE' ELSE 'READY_FOR_ADOPTION_REVIEW' END AS status FROM s""",
)
def candidate_verdict(spark, sf_dir):
    """A length rule held against the quality labels as a baseline."""
    b = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("correct"))
    c = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 500).alias("correct"))
    return ledger.verdicts(b, c, "doc_id", 1)
