"""Workflow opportunities: inferred needs, mechanism options, priorities, next tasks, and comparison of citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import infer_pattern
from lodestone.operators.evidence import workflow_trace
from lodestone.operators.ranking import top_rows

# States that settle a need before any code is looked for, and the kinds of next task by state.
SETTLED = ["EXISTING_OPTION_TO_VERIFY", "CONFLICT_REQUIRES_REVIEW", "COUNTEREVIDENCE_REVIEW", "STALE_EVIDENCE_RECHECK"]
FIRST_TASK = {
    "EXISTING_OPTION_TO_VERIFY": "existing_solution_fit",
    "CONFLICT_REQUIRES_REVIEW": "resolve_conflict",
    "COUNTEREVIDENCE_REVIEW": "resolve_conflict",
    "STALE_EVIDENCE_RECHECK": "refresh_evidence",
}
MOST_OPTIONS = 6


def inferred_needs(workflows: DataFrame, declared: DataFrame) -> DataFrame:
    """(workflow, step, field, pattern, basis): declared needs (workflow, step, field, pattern) and, for each
    field that a step lacks and nobody declared, an inferred one."""
    lacking = workflow_trace(workflows).select("workflow", "step", F.explode("missing").alias("field"))
    new = lacking.join(declared.select("workflow", "step", "field"), ["workflow", "step", "field"], "left_anti")
    new = new.select("workflow", "step", "field", infer_pattern("field").alias("pattern"), F.lit("inferred").alias("basis"))
    return declared.select("workflow", "step", "field", "pattern", F.lit("reported").alias("basis")).unionByName(new)


def mechanism_options(needs: DataFrame, mechanisms: DataFrame) -> DataFrame:
    """The first six mechanisms of each need: fewest missing inputs, then those that supply the field, then by id.

    needs: need, pattern, field, available array; mechanisms: id, addresses, requires, provides (arrays)."""
    m = mechanisms.select("id", "requires", "provides", F.explode(F.array_distinct("addresses")).alias("pattern"))
    j = needs.join(m, "pattern").withColumn("missing", F.array_sort(F.array_except("requires", "available")))
    j = j.withColumn("fits", F.array_contains("provides", F.col("field")))
    ranked = top_rows(j, ["need"], [F.size("missing"), F.desc("fits"), F.col("id")], MOST_OPTIONS)
    status = F.when(F.size("missing") > 0, "PREREQUISITES_UNCONFIRMED").otherwise("INPUTS_DECLARED_REVIEW_REQUIRED")
    return ranked.select("need", "id", "rank", "missing", status.alias("status"), F.when(F.col("fits"), "DECLARED_OUTPUT_MATCH").otherwise("SUPPORTING_COMPONENT_ONLY").alias("output_fit"))


def priorities(states: DataFrame, options: DataFrame, preferences: dict[str, int]) -> DataFrame:
    """(need, problem, groups, preference, ready): what orders the investigation, highest first, ties by need.

    states: need, pattern, state, origin_groups. Preferences order; they don't change a state."""
    ready = options.groupBy("need").agg(F.sum((F.size("missing") == 0).cast("int")).alias("ready"))
    pref = F.lit(2)
    for k, v in preferences.items():
        pref = F.when(F.col("pattern") == k, v).otherwise(pref)
    s = states.join(ready, "need", "left")
    return s.select("need", F.col("state").isin("CORROBORATED_WORKFLOW_PROBLEM", "SINGLE_SOURCE_PROBLEM").cast("int").alias("problem"), F.least("origin_groups", F.lit(3)).alias("groups"), pref.alias("preference"), F.coalesce("ready", F.lit(0)).alias("ready"))


def next_tasks(states: DataFrame, options: DataFrame) -> DataFrame:
    """(need, place, kind): the tasks that each state calls for, in order."""
    lacks = options.where(F.size("missing") > 0).select("need").distinct().withColumn("lacks", F.lit(True))
    s = states.join(lacks, "need", "left")
    open_ = ~F.col("state").isin(SETTLED)
    first = F.lit("observe_workflow")
    for state, kind in FIRST_TASK.items():
        first = F.when(F.col("state") == state, kind).otherwise(first)
    tasks = F.array(
        first,
        F.when(F.col("state") == "SINGLE_SOURCE_PROBLEM", "independent_observation"),
        F.when(open_ & F.coalesce("lacks", F.lit(False)), "prerequisite"),
        F.when(open_, "existing_solution_fit"),
        F.lit("bounded_comparison"),
    )
    return s.select("need", F.posexplode(F.filter(tasks, lambda t: t.isNotNull())).alias("place", "kind"))


def compare_citations(old: DataFrame, new: DataFrame, old_sources: DataFrame, new_sources: DataFrame) -> DataFrame:
    """Each citation (owner, source, start, end, quote) of two runs with its fate.

    Exact places are matched first and can't be taken by another; a quote that moved is paired in order, and only
    where it occurs once on each side. sources: source, uri, text."""
    keys = ["owner", "source", "start", "end", "quote"]
    a = old.select(*keys).distinct()
    b = new.select(*keys).distinct()
    kept = a.join(b, keys)
    gone, fresh = a.join(kept, keys, "left_anti"), b.join(kept, keys, "left_anti")
    nth = lambda df: df.withColumn("_n", F.row_number().over(W.partitionBy("owner", "source", "quote").orderBy("start", "end")))
    to = nth(fresh).select("owner", "source", "quote", "_n", F.col("start").alias("new_start"))
    pairs = nth(gone).join(to, ["owner", "source", "quote", "_n"], "left")
    # a second place may overlap the first, so it is looked for from the next character on
    again = lambda c: F.expr(f"locate(quote, {c}, locate(quote, {c}) + 1) > 0")
    x = pairs.join(old_sources.select("source", F.col("uri").alias("_u"), F.col("text").alias("_t")), "source", "left").join(new_sources.select("source", F.col("uri").alias("_v"), F.col("text").alias("_s")), "source", "left")
    status = (
        F.when(F.col("_v").isNull(), "SOURCE_REMOVED")
        .when(F.col("_u") != F.col("_v"), "SOURCE_REPLACED")
        .when(~F.contains("_s", "quote"), "PASSAGE_MISSING")
        .when(F.col("new_start").isNull(), "NO_LONGER_CITED")
        .when(again("_t") | again("_s"), "OCCURRENCE_UNCERTAIN")
        .otherwise("MOVED")
    )
    x = x.withColumn("status", status)
    taken = x.where("status = 'MOVED'").select("owner", "source", "quote", F.col("new_start").alias("start"))
    added = fresh.join(taken, ["owner", "source", "quote", "start"], "left_anti")
    return kept.withColumn("status", F.lit("RETAINED")).unionByName(x.select(*keys, "status")).unionByName(added.withColumn("status", F.lit("NEW_CITATION")))
