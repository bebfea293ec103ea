"""Rule-based evidence states, workflow traces, recorded cases and requirement matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of observation that report a problem, and kinds of source that can.
PROBLEMS, WITNESSES = ["pain", "manual", "missing"], ["firsthand", "issue"]


def evidence_states(obs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, state, origin_groups, fresh_sources) of each need.

    obs: one row an observation and source: keys, kind, scope, source, source_kind, fresh, family, gap (whether
    the declared workflow lacks the field). Nine states by precedence, from one conditional aggregation."""
    on = (F.col("scope") == "target") & F.col("fresh")
    some = lambda c: F.max(F.coalesce(c, F.lit(False)))
    problem = on & F.col("kind").isin(PROBLEMS) & F.col("source_kind").isin(WITNESSES)
    a = obs.groupBy(*keys).agg(
        some(on & (F.col("kind") == "supported")).alias("_supported"),
        some(on & (F.col("kind") == "refutes")).alias("_refuted"),
        some(problem).alias("_problem"),
        F.countDistinct(F.when(problem, F.col("family"))).alias("origin_groups"),
        F.countDistinct(F.when(on, F.col("source"))).alias("fresh_sources"),
        some(~F.col("fresh")).alias("_stale"),
        some(on & (F.col("kind") == "not_described")).alias("_silent"),
        some(F.col("gap")).alias("_gap"),
    )
    state = (
        F.when((F.col("_supported") | F.col("_refuted")) & F.col("_problem"), "CONFLICT_REQUIRES_REVIEW")
        .when(F.col("_refuted"), "COUNTEREVIDENCE_REVIEW")
        .when(F.col("_supported"), "EXISTING_OPTION_TO_VERIFY")
        .when(F.col("origin_groups") >= 2, "CORROBORATED_WORKFLOW_PROBLEM")
        .when(F.col("_problem"), "SINGLE_SOURCE_PROBLEM")
        .when(F.col("_stale") & (F.col("fresh_sources") == 0), "STALE_EVIDENCE_RECHECK")
        .when(F.col("_silent"), "INFORMATION_GAP_ONLY")
        .when(F.col("_gap"), "INFERRED_HANDOFF_GAP")
        .otherwise("UNTESTED_GAP_HYPOTHESIS")
    )
    return a.select(*keys, state.alias("state"), "origin_groups", "fresh_sources")


def workflow_trace(workflows: DataFrame) -> DataFrame:
    """(workflow, step, missing, roots, unconfirmed, status): what each step lacks when earlier steps supply only what they can.

    workflows: workflow, initial array<string>, steps array<struct<id, requires, produces>> in order. A step that lacks an input
    supplies nothing; what it would have supplied stays pending, with the inputs that it goes back to (roots), until another step
    supplies it. A later producer never repairs an earlier step. The fold stays in the JVM."""
    texts, pending = "array<string>", "array<struct<field:string,roots:array<string>>>"
    row = "array<struct<step:string,missing:array<string>,roots:array<string>,unconfirmed:array<string>>>"
    start = F.struct(F.col("initial").alias("have"), F.array().cast(pending).alias("pending"), F.array().cast(row).alias("out"))

    def step(acc, s):
        missing = F.array_sort(F.array_distinct(F.array_except(s["requires"], acc["have"])))
        known = F.filter(acc["pending"], lambda p: F.array_contains(missing, p["field"]))
        plain = F.array_except(missing, F.transform(known, lambda p: p["field"]))
        roots = F.array_sort(F.array_distinct(F.flatten(F.concat(F.array(plain), F.transform(known, lambda p: p["roots"])))))
        new = F.array_distinct(F.array_except(s["produces"], acc["have"]))
        held = F.transform(acc["pending"], lambda p: F.struct(p["field"].alias("field"), F.when(F.array_contains(new, p["field"]), F.array_union(p["roots"], roots)).otherwise(p["roots"]).alias("roots")))
        added = F.transform(F.array_except(new, F.transform(acc["pending"], lambda p: p["field"])), lambda f: F.struct(f.alias("field"), roots.alias("roots")))
        blocked = F.size(missing) > 0
        have = F.when(blocked, acc["have"]).otherwise(F.array_union(acc["have"], s["produces"]))
        left = F.when(blocked, F.concat(held, added)).otherwise(F.filter(acc["pending"], lambda p: ~F.array_contains(s["produces"], p["field"])))
        unconfirmed = F.when(blocked, F.array_sort(new)).otherwise(F.array().cast(texts))
        one = F.struct(s["id"].alias("step"), missing.alias("missing"), roots.alias("roots"), unconfirmed.alias("unconfirmed"))
        return F.struct(have.alias("have"), left.alias("pending"), F.concat(acc["out"], F.array(one)).alias("out"))

    t = workflows.select("workflow", F.explode(F.aggregate("steps", start, step)["out"]).alias("x"))
    status = F.when(F.size("x.missing") > 0, "BLOCKED_BY_DECLARED_INPUTS").otherwise("INPUTS_DECLARED_NOT_EXECUTED")
    return t.select("workflow", "x.step", "x.missing", "x.roots", "x.unconfirmed", status.alias("status"))


def check_cases(assertions: DataFrame, observations: DataFrame) -> DataFrame:
    """(case_id, status): required cases held against what was recorded for them.

    assertions: case_id, field, op (equal / finite_range), expected (canonical text), minimum, maximum;
    observations: case_id, outcome, field, value (canonical text). A case without a record is MISSING."""
    outcome = observations.groupBy("case_id").agg(F.min("outcome").alias("outcome"))
    seen = observations.select("case_id", "field", F.col("value").alias("_v"), F.lit(True).alias("_seen"))
    a = assertions.join(seen, ["case_id", "field"], "left").join(outcome, "case_id", "left")
    number = F.when(F.col("_v").rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), F.col("_v").cast("double"))
    ok = F.when(F.col("op") == "equal", F.col("_v") == F.col("expected")).otherwise(F.coalesce(number.between(F.col("minimum"), F.col("maximum")), F.lit(False)))
    some = lambda c: F.max(F.coalesce(c, F.lit(False)))
    g = a.groupBy("case_id").agg(F.min("outcome").alias("outcome"), some(F.col("_seen") & ~ok).alias("_no"), some(F.col("_seen").isNull()).alias("_absent"))
    status = (
        F.when(F.col("outcome").isNull(), "MISSING")
        .when(F.col("outcome") != "OBSERVED", F.col("outcome"))
        .when(F.col("_no"), "FAIL")
        .when(F.col("_absent"), "INCOMPLETE_OBSERVATIONS")
        .otherwise("PASS")
    )
    return g.select("case_id", status.alias("status"))


MOST_REQUIREMENTS = 1000


def requirement_verdicts(requirements: DataFrame, candidates: DataFrame, states: DataFrame) -> DataFrame:
    """(candidate, verdict, open): each candidate against all requirements.

    The requirements are a list written by a person: MOST_REQUIREMENTS at most, so each candidate carries them; states: candidate,
    requirement, state (the latest of each); a pair without one is UNKNOWN."""
    listed = requirements.select("requirement", "required").limit(MOST_REQUIREMENTS + 1).collect()
    if len(listed) > MOST_REQUIREMENTS:
        raise ValueError("REQUIREMENT_LIMIT")
    each = F.array(*[F.struct(F.lit(r[0]).alias("requirement"), F.lit(r[1]).alias("required")) for r in listed])
    m = candidates.select("candidate", F.inline(each)) if listed else candidates.select("candidate", F.lit("").alias("requirement"), F.lit(False).alias("required"))
    m = m.join(states, ["candidate", "requirement"], "left").withColumn("state", F.coalesce("state", F.lit("UNKNOWN")))
    bad, unknown = F.col("state").isin("CONTRADICTED", "TEST_FAILED"), F.col("state") == "UNKNOWN"
    g = m.where("required").groupBy("candidate").agg(F.max(bad).alias("_bad"), F.max(unknown).alias("_unknown"), F.sum((bad | unknown).cast("long")).alias("open"))
    return g.select("candidate", F.when(F.col("_bad"), "CONTRADICTED").when(F.col("_unknown"), "NEEDS_EVIDENCE").otherwise("READY_FOR_INTEGRATION_REVIEW").alias("verdict"), "open")


def rounded(x: Column, digits: int) -> Column:
    """x rounded on its scaled binary value, half away from zero, as SQL engines in C do; F.round() rounds its decimal text."""
    y = F.abs(x) * 10.0**digits
    whole = F.floor(y).cast("double")
    return F.when(F.isnan(x) | (y >= 1e15), x).otherwise(F.signum(x) * (whole + F.when(y - whole >= 0.5, 1.0).otherwise(0.0)) / 10.0**digits)


def measured_value(rows: DataFrame, direction: Column, threshold: Column) -> DataFrame:
    """rows (baseline, candidate, regressions, checks_passed) with a verdict and the change to six digits, which is what meets the
    threshold: the last bits of a difference of means decide nothing. The first reason wins."""
    change = rounded(F.when(direction == "higher", F.col("candidate") - F.col("baseline")).otherwise(F.col("baseline") - F.col("candidate")), 6)
    verdict = (
        F.when(~F.coalesce("checks_passed", F.lit(False)), "REQUIRED_CHECKS_OR_CASES_MISSING")
        .when(F.coalesce("regressions", F.lit(1)) != 0, "REQUIRED_REGRESSION_OR_MISSING_EVIDENCE")
        .when(F.col("baseline").isNull() | F.col("candidate").isNull() | F.isnan("baseline") | F.isnan("candidate"), "INVALID_METRICS")
        .when(threshold <= 0, "POSITIVE_PREDECLARED_THRESHOLD_REQUIRED")
        .when(change < threshold, "NO_MEASURED_ADVANTAGE")
        .otherwise("MEASURED_ADVANTAGE_REVIEW_REQUIRED")
    )
    return rows.withColumn("change", change).withColumn("verdict", verdict)
