"""Job control on the tables: customers are missions, nations providers, orders tasks. Days since 1992 stand for clock times."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import control
from lodestone.plans.text_queries import table

QUERIES, SQL = {}, {}
NOW = 2000


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def tasks(spark, sf_dir):
    day = F.datediff("o_orderdate", F.lit("1992-01-01"))
    state = F.when(F.col("o_orderstatus") == "F", "DONE").when(F.col("o_orderstatus") == "P", "LEASED").when(F.col("o_orderkey") % 5 == 0, "BLOCKED").otherwise("READY")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("task"),
        F.col("o_custkey").alias("mission"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderpriority").alias("kind"),
        state.alias("state"),
        (F.col("o_orderkey") % 4).alias("attempts"),
        (day - 30).alias("not_before"),
        F.when(F.col("o_orderkey") % 50 == 0, day + 5000).otherwise(F.least(day, F.lit(NOW))).alias("expires"),
        F.concat(F.lit("k"), F.col("o_orderkey") % 7).alias("token"),
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("response_hash"),
    )


_TASKS = f"""t AS (SELECT o_orderkey AS task, o_custkey AS mission, o_orderkey AS seq, o_orderpriority AS kind,
  CASE WHEN o_orderstatus = 'F' THEN 'DONE' WHEN o_orderstatus = 'P' THEN 'LEASED' WHEN o_orderkey % 5 = 0 THEN 'BLOCKED' ELSE 'READY' END AS state, o_orderkey % 4 AS attempts, day - 30 AS not_before,
  CASE WHEN o_orderkey % 50 = 0 THEN day + 5000 ELSE least(day, {NOW}) END AS expires, 'k' || (o_orderkey % 7) AS token, sha256(o_orderkey::VARCHAR) AS response_hash
  FROM (SELECT *, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS day FROM orders))"""


def missions(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("mission"),
        F.col("c_nationkey").alias("provider"),
        (F.col("c_acctbal") < 0).alias("cancelled"),
        (F.col("c_custkey") % 12).alias("requests"),
        F.lit(10).alias("max_requests"),
        (F.col("c_custkey") % 100).alias("source_bytes"),
        F.lit(120).alias("max_source_bytes"),
        (F.col("c_nationkey") % 7 == 0).alias("hold"),
        (F.col("c_nationkey") % 5 * 501).alias("cooldown"),
        (F.col("c_custkey") % 4).alias("gaps"),
        (F.col("c_custkey") % 3).alias("findings"),
    )


_MISSIONS = """m AS (SELECT c_custkey AS mission, c_nationkey AS provider, c_acctbal < 0 AS cancelled, c_custkey % 12 AS requests, 10 AS max_requests, c_custkey % 100 AS source_bytes, 120 AS max_source_bytes,
  c_nationkey % 7 = 0 AS hold, c_nationkey % 5 * 501 AS cooldown, c_custkey % 4 AS gaps, c_custkey % 3 AS findings FROM customer)"""


@query(
    "task_claims",
    f"""WITH {_TASKS}, {_MISSIONS}, live AS (SELECT DISTINCT provider FROM t JOIN m USING (mission) WHERE state = 'LEASED' AND expires > {NOW} AND task % 100 = 0),
    f AS (SELECT mission, arg_min(task, seq) AS task FROM t WHERE attempts < 3 AND not_before <= {NOW} AND (state = 'READY' OR (state = 'LEASED' AND (expires <= {NOW} OR task % 100 <> 0))) GROUP BY 1),
    x AS (SELECT m.mission, f.task, CASE WHEN cancelled THEN 'MISSION_CANCELLED' WHEN hold THEN 'PROVIDER_HOLD' WHEN cooldown > {NOW} THEN 'RATE_WAIT' WHEN live.provider IS NOT NULL THEN 'LEASE_OUTSTANDING'
      WHEN requests >= max_requests THEN 'REQUEST_BUDGET' WHEN f.task IS NULL THEN 'NO_OPEN_TASK' ELSE 'CLAIMED' END AS outcome FROM m LEFT JOIN live USING (provider) LEFT JOIN f ON f.mission = m.mission)
    SELECT mission, outcome, CASE WHEN outcome = 'CLAIMED' THEN task END AS task FROM x""",
)
def task_claims(spark, sf_dir):
    t = tasks(spark, sf_dir).withColumn("expires", F.when((F.col("task") % 100 != 0) & (F.col("expires") > NOW), F.lit(NOW)).otherwise(F.col("expires")))
    providers = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("provider"), (F.col("n_nationkey") % 7 == 0).alias("hold"), (F.col("n_nationkey") % 5 * 501).alias("cooldown"))
    return control.claims(missions(spark, sf_dir).select("mission", "provider", "cancelled", "requests", "max_requests"), t, providers, F.lit(NOW), 3)


@query("exhausted_tasks", f"WITH {_TASKS} SELECT task, 'ATTEMPTS_EXHAUSTED' AS error FROM t WHERE state = 'LEASED' AND expires <= {NOW} AND attempts >= 3")
def exhausted_tasks(spark, sf_dir):
    return control.exhausted(tasks(spark, sf_dir), F.lit(NOW), 3)


@query(
    "judged_answers",
    f"""WITH {_TASKS}, {_MISSIONS}, a AS (SELECT l_orderkey * 10 + l_linenumber AS answer, l_orderkey AS task, o_custkey + (l_linenumber = 7)::INT AS mission, o_orderpriority AS kind, 'k' || (l_orderkey % 7 + (l_linenumber = 6)::INT) AS token,
      sha256((l_orderkey + (l_linenumber = 5)::INT)::VARCHAR) AS response_hash, l_quantity::BIGINT AS bytes FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT answer, a.task, CASE WHEN t.mission IS NULL OR t.mission <> a.mission OR t.kind <> a.kind THEN 'REQUEST_BINDING' WHEN t.token <> a.token THEN 'STALE_CLAIM' WHEN cancelled THEN 'MISSION_CANCELLED'
      WHEN state = 'DONE' AND t.response_hash <> a.response_hash THEN 'CHANGED_REPLAY' WHEN state = 'DONE' THEN 'REPLAY' WHEN state <> 'LEASED' OR expires <= {NOW} THEN 'STALE_CLAIM'
      WHEN source_bytes + bytes > max_source_bytes THEN 'MISSION_SOURCE_BUDGET' ELSE 'ACCEPTED' END AS code FROM a LEFT JOIN t ON t.task = a.task LEFT JOIN m ON m.mission = a.mission""",
)
def judged_answers(spark, sf_dir):
    """Order lines as answers to their order's task; the seventh has the wrong mission, the sixth the wrong token, the fifth another body."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    nth = lambda n: (F.col("l_linenumber") == n).cast("int")
    a = j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("answer"),
        F.col("l_orderkey").alias("task"),
        (F.col("o_custkey") + nth(7)).alias("mission"),
        F.col("o_orderpriority").alias("kind"),
        F.concat(F.lit("k"), F.col("l_orderkey") % 7 + nth(6)).alias("token"),
        F.sha2((F.col("l_orderkey") + nth(5)).cast("string"), 256).alias("response_hash"),
        F.col("l_quantity").cast("long").alias("bytes"),
    )
    return control.judge_answers(a, tasks(spark, sf_dir), missions(spark, sf_dir), F.lit(NOW))


@query("failed_tasks", f"WITH {_TASKS} SELECT task, CASE WHEN task % 3 > 0 AND attempts < 2 THEN 'READY' ELSE 'BLOCKED' END AS state, {NOW} + task % 90 AS not_before FROM t WHERE state = 'LEASED'")
def failed_tasks(spark, sf_dir):
    t = tasks(spark, sf_dir).where("state = 'LEASED'")
    return control.failed_tasks(t.select("task", (F.col("task") % 3 > 0).alias("retry"), (F.col("task") % 90).alias("delay")), t, F.lit(NOW), 2)


@query(
    "rate_delays",
    """SELECT event_id, round(greatest(60.0::DOUBLE, CASE event_id % 4 WHEN 0 THEN (event_id % 300)::DOUBLE WHEN 1 THEN greatest(0.0, epoch(date_trunc('second', ts) + INTERVAL 90 SECOND) - 1704067200) ELSE 0.0::DOUBLE END,
      CASE event_id % 3 WHEN 0 THEN (event_id % 500)::DOUBLE ELSE 0.0::DOUBLE END), 3) AS wait FROM events""",
)
def rate_delays(spark, sf_dir):
    """Seconds to wait by headers made from events: a number, a date, something else or nothing."""
    k, now = F.col("event_id"), F.lit(1704067200)
    date = F.concat(F.lit("Mon, "), F.date_format(F.timestamp_seconds(F.unix_timestamp("ts") + 90), "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    after = F.when(k % 4 == 0, (k % 300).cast("string")).when(k % 4 == 1, date).when(k % 4 == 2, "soon")
    reset = F.when(k % 3 == 0, (now + k % 500).cast("string")).when(k % 3 == 1, "never")
    return table(spark, sf_dir, "events").select("event_id", F.round(control.wait_seconds(after, reset, now), 3).alias("wait"))


@query(
    "mission_states",
    f"""WITH {_TASKS}, {_MISSIONS}, n AS (SELECT mission, count(*) FILTER (state IN ('READY', 'LEASED')) AS o, count(*) FILTER (state = 'BLOCKED') AS b FROM t WHERE task % 3 = 0 GROUP BY 1)
    SELECT m.mission, CASE WHEN cancelled THEN 'CANCELLED' WHEN hold AND o > 0 THEN 'PROVIDER_REVIEW_REQUIRED' WHEN o > 0 AND requests >= max_requests THEN 'BUDGET_EXHAUSTED' WHEN o > 0 AND cooldown > {NOW} THEN 'RATE_WAIT'
      WHEN o > 0 THEN 'WORK_REMAINS' WHEN b > 0 OR gaps > 0 THEN 'COMPLETED_WITH_GAPS' WHEN findings = 0 THEN 'COMPLETED_NO_MATCH' ELSE 'COMPLETED' END AS status FROM m LEFT JOIN n USING (mission)""",
)
def mission_states(spark, sf_dir):
    return control.mission_states(missions(spark, sf_dir), tasks(spark, sf_dir).where("task % 3 = 0"), F.lit(NOW))


@query(
    "next_by_candidate",
    """SELECT l_suppkey % 10 AS run, arg_min(task, (s, kind, input_id)) AS task, count(*) AS queued FROM (SELECT l_orderkey * 10 + l_linenumber AS task, l_suppkey, (l_suppkey * 7919) % 101 AS s, l_returnflag AS kind, l_partkey * 100000000 + l_orderkey * 10 + l_linenumber AS input_id
      FROM lineitem WHERE l_linestatus = 'O') GROUP BY 1""",
)
def next_by_candidate(spark, sf_dir):
    """Open order lines as queued tasks, suppliers as candidates in an order of their own."""
    li = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_linestatus") == "O", "QUEUED").otherwise("DONE")
    t = li.select((F.col("l_suppkey") % 10).alias("run"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("task"), F.col("l_suppkey").alias("candidate"), F.col("l_returnflag").alias("kind"), (F.col("l_partkey") * 100000000 + F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("input_id"), status.alias("status"))
    c = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("candidate"), ((F.col("s_suppkey") * 7919) % 101).alias("seq"))
    return control.next_by_candidate(t, c, ["run"])


@query("stale_locks", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'GONE' WHEN doc_id % 5 = 0 THEN 'STALE' ELSE 'CURRENT' END AS state FROM documents")
def stale_locks(spark, sf_dir):
    """Digests of all texts, recomputed after some were changed and some taken away."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sha = lambda df: df.select("doc_id", F.sha2("text", 256).alias("sha256"))
    later = d.where("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return control.stale(sha(d), sha(later), "doc_id", "sha256")


@query(
    "admitted_proposals",
    """WITH p AS (SELECT p_partkey AS proposal, CASE WHEN p_size % 11 = 0 THEN 'old' ELSE 'base' END AS baseline, CASE WHEN p_size % 7 = 0 THEN ['s1', 's1'] WHEN p_size % 7 = 1 THEN ['s999'] ELSE ['s1', 's2'] END AS refs,
      CASE WHEN p_size % 5 = 0 THEN []::VARCHAR[] WHEN p_size % 5 = 1 THEN ['os.' || split_part(p_name, ' ', 1)] ELSE ['hashlib.' || split_part(p_name, ' ', 1), 'json.' || split_part(p_name, ' ', 2)] END AS targets FROM part),
    f AS (SELECT list_sort(targets) AS k, min(proposal) AS first FROM p GROUP BY 1)
    SELECT proposal, CASE WHEN baseline <> 'base' THEN 'STALE_PROPOSAL' WHEN len(list_distinct(refs)) < len(refs) OR list_contains(refs, 's999') THEN 'UNBOUND_SOURCE_REFERENCES' WHEN len(targets) = 0 THEN 'TARGET_BUDGET'
      WHEN list_contains(list_transform(targets, lambda t: split_part(t, '.', 1)), 'os') THEN 'TARGET_SCOPE' WHEN first <> proposal THEN 'DUPLICATE' ELSE 'ADMITTED' END AS code FROM p JOIN f ON list_sort(targets) = k""",
)
def admitted_proposals(spark, sf_dir):
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    lits = lambda *x: F.array(*map(F.lit, x))
    size = F.col("p_size")
    refs = F.when(size % 7 == 0, lits("s1", "s1")).when(size % 7 == 1, lits("s999")).otherwise(lits("s1", "s2"))
    targets = F.when(size % 5 == 0, F.array().cast("array<string>")).when(size % 5 == 1, F.array(F.concat(F.lit("os."), word(1)))).otherwise(F.array(F.concat(F.lit("hashlib."), word(1)), F.concat(F.lit("json."), word(2))))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("proposal"), F.when(size % 11 == 0, "old").otherwise("base").alias("baseline"), refs.alias("references"), targets.alias("targets"))
    sources = table(spark, sf_dir, "nation").select(F.concat(F.lit("s"), "n_nationkey").alias("source_id"))
    return control.admit_proposals(p, sources, ["hashlib", "json"], "base", 4)


@query("recorded_notes", "SELECT event_id AS note, CASE WHEN (event_id % 3 = 0) THEN CASE WHEN h IS NULL THEN 'RECORDED' ELSE 'HEAD_CHANGED' END WHEN event_id % 3 = 1 THEN CASE WHEN h IS NOT NULL THEN 'RECORDED' ELSE 'HEAD_CHANGED' END ELSE 'HEAD_CHANGED' END AS code FROM events e LEFT JOIN (SELECT user_id AS u, max(event_id) AS h FROM events WHERE user_id % 2 = 0 GROUP BY 1) ON u = user_id")
def recorded_notes(spark, sf_dir):
    """Events as notes on a user: one that claims no predecessor, the true one, or a wrong one."""
    e = table(spark, sf_dir, "events")
    heads = e.where("user_id % 2 = 0").groupBy("user_id").agg(F.max("event_id").alias("note"))
    h = heads.withColumnRenamed("note", "head")
    claim = F.when(F.col("event_id") % 3 == 1, F.coalesce("head", F.lit(-1))).when(F.col("event_id") % 3 == 2, F.lit(-7))
    notes = e.join(h, "user_id", "left").select(F.col("event_id").alias("note"), "user_id", claim.alias("supersedes"))
    return control.record_notes(notes, heads, ["user_id"])


@query("feedback_log", """SELECT 'f_' || substr(sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}'), 1, 32) AS id, user_id, event_type FROM (SELECT DISTINCT user_id, event_type FROM events)""")
def feedback_log(spark, sf_dir):
    """All events appended to the first half of them: content-addressed, so what was there is not added again."""
    e = table(spark, sf_dir, "events")
    return control.add_feedback(e.where("event_id % 2 = 0"), e, ["user_id", "event_type"])


@query(
    "task_levels",
    """WITH RECURSIVE e AS (SELECT p_partkey AS node, p_partkey // 3 AS needs FROM part WHERE p_partkey > 2 UNION SELECT p_partkey, p_partkey - 1 FROM part WHERE p_partkey % 3 = 2 AND p_partkey > 2 UNION SELECT p_partkey, p_partkey FROM part WHERE p_partkey = 19),
    bad(node) AS (SELECT 19 UNION SELECT e.node FROM e JOIN bad ON e.needs = bad.node), l(node, level) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey <= 2 UNION SELECT e.node, l.level + 1 FROM e JOIN l ON e.needs = l.node WHERE e.node <> 19)
    SELECT p_partkey AS node, CASE WHEN p_partkey IN (SELECT node FROM bad) THEN NULL ELSE (SELECT max(level) FROM l WHERE l.node = p_partkey) END AS level FROM part""",
)
def task_levels(spark, sf_dir):
    """Parts as tasks that need a third of their number and, some, the one before; task 19 needs itself."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    e = part.where("node > 2").select("node", F.floor(F.col("node") / 3).alias("needs"))
    e = e.union(part.where("node > 2 AND node % 3 = 2").select("node", F.col("node") - 1)).union(part.where("node = 19").select("node", "node"))
    return control.topological_levels(e, part)
