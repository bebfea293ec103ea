"""Job control as tables: who may claim what, which answers count, what a job's state is. All are relational passes over task
tables; the transaction that applies a decision is the caller's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_code(*checks: tuple[str, Column], otherwise: str = "OK") -> Column:
    """The code of the first check that holds; null counts as not holding."""
    return reduce(lambda c, x: c.when(F.coalesce(x[1], F.lit(False)), x[0]), checks[1:], F.when(F.coalesce(checks[0][1], F.lit(False)), checks[0][0])).otherwise(otherwise)


def claims(missions: DataFrame, tasks: DataFrame, providers: DataFrame, now: Column, most_attempts: int) -> DataFrame:
    """(mission, outcome, task): the task that each mission may claim at `now`, or why none.

    missions: mission, provider, cancelled, requests, max_requests; tasks: task, mission, seq, state, attempts, not_before,
    expires; providers: provider, hold, cooldown. One live lease of a provider, in whatever mission, holds all others."""
    leased = F.col("state") == "LEASED"
    t = tasks.join(missions.select("mission", "provider"), "mission")
    live = t.where(leased & (F.col("expires") > now)).select("provider").distinct().withColumn("live", F.lit(True))
    open_ = (F.col("attempts") < most_attempts) & (F.col("not_before") <= now) & ((F.col("state") == "READY") | (leased & (F.col("expires") <= now)))
    first = t.where(open_).groupBy("mission").agg(F.min_by("task", "seq").alias("task"))
    j = missions.join(providers, "provider", "left").join(live, "provider", "left").join(first, "mission", "left")
    why = first_code(
        ("MISSION_CANCELLED", F.col("cancelled")),
        ("PROVIDER_HOLD", F.col("hold")),
        ("RATE_WAIT", F.col("cooldown") > now),
        ("LEASE_OUTSTANDING", F.col("live")),
        ("REQUEST_BUDGET", F.col("requests") >= F.col("max_requests")),
        ("NO_OPEN_TASK", F.col("task").isNull()),
        otherwise="CLAIMED",
    )
    j = j.withColumn("outcome", why)
    return j.select("mission", "outcome", F.when(F.col("outcome") == "CLAIMED", F.col("task")).alias("task"))


def exhausted(tasks: DataFrame, now: Column, most_attempts: int) -> DataFrame:
    """Leased tasks whose lease ran out and that have no attempt left."""
    return tasks.where((F.col("state") == "LEASED") & (F.col("expires") <= now) & (F.col("attempts") >= most_attempts)).select("task", F.lit("ATTEMPTS_EXHAUSTED").alias("error"))


def judge_answers(answers: DataFrame, tasks: DataFrame, missions: DataFrame, now: Column) -> DataFrame:
    """answers (answer, task, mission, kind, token, response_hash, bytes) with a code: ACCEPTED, REPLAY of what was accepted, or why not.

    tasks: task, mission, kind, state, token, expires, response_hash; missions: mission, cancelled, source_bytes, max_source_bytes."""
    t = tasks.select("task", *[F.col(c).alias(f"t_{c}") for c in ("mission", "kind", "state", "token", "expires", "response_hash")])
    j = answers.join(t, "task", "left").join(missions.select("mission", "cancelled", "source_bytes", "max_source_bytes"), "mission", "left")
    done = F.col("t_state") == "DONE"
    code = first_code(
        ("REQUEST_BINDING", F.col("t_mission").isNull() | (F.col("t_mission") != F.col("mission")) | (F.col("t_kind") != F.col("kind"))),
        ("STALE_CLAIM", ~F.col("t_token").eqNullSafe(F.col("token"))),
        ("MISSION_CANCELLED", F.col("cancelled")),
        ("CHANGED_REPLAY", done & (F.col("t_response_hash") != F.col("response_hash"))),
        ("REPLAY", done),
        ("STALE_CLAIM", (F.col("t_state") != "LEASED") | (F.col("t_expires") <= now)),
        ("MISSION_SOURCE_BUDGET", F.col("source_bytes") + F.col("bytes") > F.col("max_source_bytes")),
        otherwise="ACCEPTED",
    )
    return j.select("answer", "task", code.alias("code"))


def failed_tasks(failures: DataFrame, tasks: DataFrame, now: Column, most_attempts: int) -> DataFrame:
    """(task, state, not_before): tasks after a failure (task, retry, delay): ready again while attempts are left and a retry is asked for."""
    again = F.col("retry") & (F.col("attempts") < most_attempts)
    j = failures.join(tasks.select("task", "attempts"), "task")
    return j.select("task", F.when(again, "READY").otherwise("BLOCKED").alias("state"), (now + F.col("delay")).alias("not_before"))


def wait_seconds(retry_after: Column, reset: Column, now: Column) -> Column:
    """Seconds to wait by a provider's headers, as text: a number or a date for retry-after, a number for the reset; 60 at least."""
    finite = lambda c: F.when(F.abs(c.try_cast("double")) < float("inf"), c.try_cast("double"))
    plain = F.coalesce(finite(retry_after), F.lit(0.0))
    date = F.try_to_timestamp(F.regexp_replace(retry_after, r"^[A-Za-z]{3}, (.*) GMT$", "$1"), F.lit("dd MMM yyyy HH:mm:ss")).cast("double")
    retry = F.when(plain != 0, plain).otherwise(F.coalesce(F.greatest(F.lit(0.0), date - now), F.lit(0.0)))
    return F.greatest(F.lit(60.0), retry, F.coalesce(finite(reset), now.cast("double")) - now)


def mission_states(missions: DataFrame, tasks: DataFrame, now: Column) -> DataFrame:
    """(mission, status): missions (mission, cancelled, hold, requests, max_requests, cooldown, gaps, findings) by precedence."""
    n = tasks.groupBy("mission").agg(F.count_if(F.col("state").isin("READY", "LEASED")).alias("open"), F.count_if(F.col("state") == "BLOCKED").alias("blocked"))
    j = missions.join(n, "mission", "left")
    some = F.coalesce("open", F.lit(0)) > 0
    status = first_code(
        ("CANCELLED", F.col("cancelled")),
        ("PROVIDER_REVIEW_REQUIRED", F.col("hold") & some),
        ("BUDGET_EXHAUSTED", some & (F.col("requests") >= F.col("max_requests"))),
        ("RATE_WAIT", some & (F.col("cooldown") > now)),
        ("WORK_REMAINS", some),
        ("COMPLETED_WITH_GAPS", (F.coalesce("blocked", F.lit(0)) > 0) | (F.col("gaps") > 0)),
        ("COMPLETED_NO_MATCH", F.col("findings") == 0),
        otherwise="COMPLETED",
    )
    return j.select("mission", status.alias("status"))


def next_by_candidate(tasks: DataFrame, candidates: DataFrame, by: list[str]) -> DataFrame:
    """The first queued task of each run, in the order of its candidates, then kind and input."""
    key = F.struct("candidate_seq", "kind", "input_id")
    j = tasks.where("status = 'QUEUED'").join(candidates.select("candidate", F.col("seq").alias("candidate_seq")), "candidate")
    return j.groupBy(*by).agg(F.min_by("task", key).alias("task"), F.count("*").alias("queued"))


def stale(locked: DataFrame, now: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, state): locked digests against recomputed ones: CURRENT, STALE or GONE."""
    j = locked.select(key, digest).join(now.select(key, F.col(digest).alias("_now")), key, "left")
    return j.select(key, first_code(("GONE", F.col("_now").isNull()), ("STALE", F.col("_now") != F.col(digest)), otherwise="CURRENT").alias("state"))


def admit_proposals(proposals: DataFrame, sources: DataFrame, roots: list[str], baseline: str, most_targets: int) -> DataFrame:
    """proposals (proposal, baseline, references, targets) with a code: the first rule that one breaks, DUPLICATE or ADMITTED.

    The first of equal sets of targets counts; references are joined, so any number of sources is fine."""
    each = proposals.select("proposal", F.explode("references").alias("source_id"))
    unknown = each.join(sources.select("source_id"), "source_id", "left_anti").select("proposal").distinct().withColumn("unknown", F.lit(True))
    target = F.array_sort("targets")
    first = proposals.groupBy(target.alias("target_set")).agg(F.min("proposal").alias("first"))
    j = proposals.withColumn("target_set", target).join(unknown, "proposal", "left").join(first, "target_set")
    code = first_code(
        ("STALE_PROPOSAL", F.col("baseline") != baseline),
        ("UNBOUND_SOURCE_REFERENCES", (F.size("references") == 0) | (F.size("references") > 20) | (F.size(F.array_distinct("references")) < F.size("references")) | F.col("unknown")),
        ("TARGET_BUDGET", (F.size("targets") == 0) | (F.size("targets") > most_targets)),
        ("TARGET_SCOPE", F.exists("targets", lambda t: ~F.split_part(t, F.lit("."), F.lit(1)).isin(roots))),
        ("DUPLICATE", F.col("first") != F.col("proposal")),
        otherwise="ADMITTED",
    )
    return j.select("proposal", code.alias("code"))


def record_notes(notes: DataFrame, heads: DataFrame, keys: list[str]) -> DataFrame:
    """notes (note, keys, supersedes) with a code: a note must supersede the head of its keys (or nothing, where there is none)."""
    j = notes.join(heads.select(*keys, F.col("note").alias("_head")), keys, "left")
    return j.select("note", F.when(F.col("supersedes").eqNullSafe(F.col("_head")), "RECORDED").otherwise("HEAD_CHANGED").alias("code"))


def add_feedback(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Feedback by content: id and columns of all rows, each content once; repeated rows collapse in partial aggregations."""
    both = old.select(*columns).unionByName(new.select(*columns)).distinct()
    return both.select(F.concat(F.lit("f_"), F.substring(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), 1, 32)).alias("id"), *columns)


def topological_levels(edges: DataFrame, nodes: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, level): 0 for nodes that depend on nothing, else one more than their highest dependency; null: on a cycle or behind one.

    edges: node, needs. Each round settles the nodes whose dependencies are all settled; as many rounds as there are levels. Edges and
    counts are kept and joined by merge: by Spark's estimate of their size they would be broadcast in every round."""
    from lodestone.operators.ranking import cut

    e = cut(edges.select("node", "needs").distinct()).hint("merge")
    want = cut(e.groupBy("node").agg(F.count("*").alias("n"))).hint("merge")
    done = cut(nodes.select("node").join(want, "node", "left_anti").withColumn("level", F.lit(0)))
    for level in range(1, most_rounds + 1):
        ready = e.join(done.select(F.col("node").alias("needs")), "needs").groupBy("node").agg(F.count("*").alias("have"))
        fresh = ready.join(want, "node").where("have = n").join(done.hint("merge"), "node", "left_anti").select("node", F.lit(level).alias("level"))
        fresh = cut(fresh)
        if fresh.isEmpty():
            break
        done = done.union(fresh)
    return nodes.select("node").join(done, "node", "left")
