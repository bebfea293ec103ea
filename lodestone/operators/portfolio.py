"""Opportunity bundles as tables: what is wrong with a bundle, plans in words, transfer reviews, plans of cases, gates, discovery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.admission import on_cycles
from lodestone.operators.control import first_code
from lodestone.operators.matching import FIT_ORDER
from lodestone.operators.opportunity import SETTLED
from lodestone.operators.ranking import top_rows

# Gap patterns, kinds of observation and scope that a bundle may use; forms; licences; limits of a mission.
PATTERNS = ["identity_loss", "verification_gap", "format_gap", "recovery_gap", "information_gap"]
OBSERVATIONS = ["pain", "manual", "missing", "supported", "refutes", "not_described", "unknown"]
SCOPES = ["target", "analogy", "unspecified"]
FORM_OBSERVATIONS = ["manual", "missing", "pain", "unknown", "not_described", "supported"]
LICENSES = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC"]
LIMITS = {
    "max_requests": (1, 100),
    "max_repos": (1, 10),
    "max_files": (1, 30),
    "files_per_repo": (1, 10),
    "max_source_bytes": (1, 250_000),
    "max_total_source_bytes": (1, 4_000_000),
    "max_response_bytes": (100, 2_000_000),
    "max_attempts": (1, 2),
}


def bundle_faults(sources: DataFrame, steps: DataFrame, needs: DataFrame, observations: DataFrame, mechanisms: DataFrame) -> DataFrame:
    """(record, code) of every record of a bundle that breaks a rule; a sound bundle gives no rows.

    sources: id, derived_from; steps: workflow, step, requires; needs: need, workflow, step, field, pattern; observations: id, workflow,
    need, kind, scope; mechanisms: id, addresses, limits. References are anti-joins, cycles a fixpoint."""
    lineage = sources.select("id", F.explode("derived_from").alias("from"))
    unknown = lineage.join(sources.select(F.col("id").alias("from")), "from", "left_anti").union(lineage.where("id = from").select("from", "id"))
    round_ = on_cycles(lineage.where("id <> from").select(F.col("id").alias("a"), F.col("from").alias("b")))
    slots = steps.select("workflow", "step", F.explode("requires").alias("field")).distinct()
    out = [
        unknown.select(F.col("id").alias("record"), F.lit("SOURCE_LINEAGE").alias("code")),
        round_.select("id", F.lit("SOURCE_LINEAGE_CYCLE")),
        needs.join(slots, ["workflow", "step", "field"], "left_anti").select("need", F.lit("NEED_STEP_CONTRACT")),
        needs.where(~F.col("pattern").isin(PATTERNS)).select("need", F.lit("NEED_CLASSIFICATION")),
        needs.groupBy("workflow", "step", "field").agg(F.min("need").alias("first"), F.count("*").alias("n")).where("n > 1").select("first", F.lit("DUPLICATE_NEED_SLOT")),
        observations.join(needs.select("workflow", "need"), ["workflow", "need"], "left_anti").select("id", F.lit("OBSERVATION_TARGET")),
        observations.where(~F.col("kind").isin(OBSERVATIONS) | ~F.col("scope").isin(SCOPES)).select("id", F.lit("OBSERVATION_KIND")),
        mechanisms.where((F.size("addresses") == 0) | (F.size(F.array_except("addresses", F.array(*map(F.lit, PATTERNS)))) > 0) | (F.size("limits") == 0)).select("id", F.lit("MECHANISM_SCOPE")),
    ]
    as_text = [d.select(F.col(d.columns[0]).cast("string").alias("record"), F.col(d.columns[1]).alias("code")) for d in out]
    return reduce(DataFrame.union, as_text).distinct()


def counter_questions(title: Column, domain: Column, field: Column) -> Column:
    """array<struct(kind, question)>: what would speak against a need."""
    say = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("question"))
    return F.array(
        say("existing_solution", F.format_string("What already supplies %s for %s?", field, title)),
        say("search", F.substring(F.concat_ws(" ", domain, field, F.lit("existing solution manual workflow")), 1, 200)),
        say("disconfirm_need", F.format_string("Can the task be completed without %s?", field)),
        say("experiment", F.format_string("Does the proposed intervention reduce the effort of obtaining %s?", field)),
    )


def recommended_action(state: Column) -> Column:
    return F.when(state == "EXISTING_OPTION_TO_VERIFY", "EVALUATE_EXISTING_OPTION").when(state.isin([s for s in SETTLED if s != "EXISTING_OPTION_TO_VERIFY"]), "RESOLVE_EVIDENCE_FIRST").otherwise("INVESTIGATE_WORKFLOW_HYPOTHESIS")


def transfer_review(hypotheses: DataFrame, assessed: DataFrame, most: int = 6) -> DataFrame:
    """(need, status, pairs, candidates): of hypotheses (need, state) that their evidence doesn't settle, the first `most` mechanisms that
    fit by declaration, best contract first. assessed: need, mechanism, status."""
    rank = F.array_position(F.array(*map(F.lit, FIT_ORDER)), F.col("status"))
    open_ = hypotheses.where(~F.col("state").isin(SETTLED))
    j = assessed.join(open_.select("need"), "need", "left_semi")
    n = j.groupBy("need").agg(F.count("*").alias("pairs"))
    fit = top_rows(j.where(F.col("status").isin(FIT_ORDER[:2])), ["need"], [rank, F.col("mechanism")], most, "place")
    best = fit.groupBy("need").agg(F.array_sort(F.collect_list(F.struct("place", "mechanism"))).alias("x"))
    r = hypotheses.join(n, "need", "left").join(best, "need", "left")
    status = F.when(F.col("state").isin(SETTLED), "ORIGINAL_EVIDENCE_GATE_RETAINED").otherwise("DECLARATION_REVIEW_ONLY")
    return r.select("need", status.alias("status"), F.coalesce("pairs", F.lit(0)).alias("pairs"), F.coalesce(F.transform("x", lambda x: x["mechanism"]), F.array().cast(assessed.select(F.array("mechanism")).schema[0].dataType)).alias("candidates"))


def plan_status(cases: DataFrame, plan: str) -> DataFrame:
    """(plan, status, passed, failed, incomplete) of cases (plan, status): no evidence at all is only a plan."""
    s = F.col("status")
    bad, gap = s.isin("FAIL", "ERROR"), ~s.isin("PASS", "FAIL", "ERROR")
    g = cases.groupBy(plan).agg(F.count("*").alias("n"), F.count_if(s == "PASS").alias("passed"), F.count_if(bad).alias("failed"), F.count_if(gap).alias("incomplete"), F.count_if(s == "MISSING").alias("_missing"))
    status = first_code(("PLAN_ONLY", F.col("_missing") == F.col("n")), ("REPORTED_FAIL", F.col("failed") > 0), ("REPORTED_INCOMPLETE", F.col("incomplete") > 0), otherwise="REPORTED_PASS")
    return g.select(plan, status.alias("status"), "passed", "failed", "incomplete")


def gate(cases: DataFrame, required: dict[str, int]) -> DataFrame:
    """(kind, required, cases, passed, open) of each kind of case that a gate asks for: open if exactly as many as asked were run and all passed."""
    want = cases.sparkSession.createDataFrame(sorted(required.items()), "kind string, required long")
    g = cases.groupBy("kind").agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"))
    j = want.join(g, "kind", "left").select("kind", "required", F.coalesce("cases", F.lit(0)).alias("cases"), F.coalesce("passed", F.lit(0)).alias("passed"))
    return j.withColumn("open", (F.col("cases") == F.col("required")) & (F.col("passed") == F.col("required")))


def form_code(note: Column, pattern: Column, observation: Column, fields: list[Column]) -> Column:
    """Whether a guided form can become a bundle."""
    empty = reduce(lambda a, b: a | b, [(F.coalesce(F.length(F.trim(f)), F.lit(0)) == 0) | (F.length(f) > 160) for f in fields])
    return first_code(("GUIDED_FIELD", empty), ("GUIDED_NOTE", (F.coalesce(F.length(F.trim(note)), F.lit(0)) == 0) | (F.length(note) > 6000)), ("GUIDED_CLASSIFICATION", ~pattern.isin(PATTERNS) | ~observation.isin(FORM_OBSERVATIONS)))


def guided_bundle(forms: DataFrame) -> DataFrame:
    """(form, step, requires, produces, need, basis): the two steps of the workflow that a form (form, received, needed, observation) states."""
    reported = F.col("observation").isin("manual", "missing", "pain")
    steps = F.array(
        F.struct(F.lit("receive").alias("step"), F.array("received").alias("requires"), F.array("received").alias("produces"), F.lit(None).cast("string").alias("need")),
        F.struct(F.lit("review").alias("step"), F.array_sort(F.array_distinct(F.array("received", "needed"))).alias("requires"), F.array(F.lit("task_result")).alias("produces"), F.col("needed").alias("need")),
    )
    return forms.select("form", F.when(reported, "reported").otherwise("inferred").alias("basis"), F.explode(steps).alias("s")).select("form", "s.step", "s.requires", "s.produces", "s.need", "basis")


def changed_plans(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """(need, code): stored plans (need, place, kind) held against recomputed ones."""
    j = stored.select("need", "place", F.col("kind").alias("_a")).join(recomputed.select("need", "place", F.col("kind").alias("_b")), ["need", "place"], "full")
    changed = F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))) > 0
    return j.groupBy("need").agg(F.when(changed, "INVESTIGATION_PLAN_CHANGED").otherwise("OK").alias("code"))


def mission_code(queries: Column, path_terms: Column, licenses: Column, limits: dict[str, Column]) -> Column:
    """The first rule that a mission's specification breaks."""
    bounds = reduce(lambda a, b: a | b, [~F.coalesce(limits[k].between(*LIMITS[k]), F.lit(False)) for k in LIMITS])
    return first_code(
        ("QUERY_COUNT", ~F.size(queries).between(1, 4)),
        ("PATH_TERMS", ~F.size(path_terms).between(1, 12) | F.exists(path_terms, lambda t: ~t.rlike("^[a-z0-9_-]{1,30}$"))),
        ("LIMIT_KEYS", bounds),
        ("LICENSE_POLICY", (F.size(licenses) == 0) | (F.size(F.array_distinct(licenses)) < F.size(licenses)) | (F.size(F.array_except(licenses, F.array(*map(F.lit, LICENSES)))) > 0)),
    )


def bind_hits(hits: DataFrame, records: DataFrame) -> DataFrame:
    """(query, id, code): hits (query, id, sha256) with the bound record (id, sha256) of the same occurrence."""
    j = hits.join(records.select("id", F.col("sha256").alias("_sha")), "id", "left")
    return j.select("query", "id", first_code(("NOT_BOUND", F.col("_sha").isNull()), ("EVIDENCE_BINDING", F.col("_sha") != F.col("sha256")), otherwise="BOUND").alias("code"))


def observed_needs(workflows: DataFrame, needs: DataFrame, observations: DataFrame) -> DataFrame:
    """(workflow, need, observations): every need of every workflow with the number of its observations."""
    o = observations.groupBy("workflow", "need").agg(F.count("*").alias("observations"))
    return workflows.join(needs, "workflow").join(o, ["workflow", "need"], "left").select("workflow", "need", F.coalesce("observations", F.lit(0)).alias("observations"))


def linked_sections(links: DataFrame) -> DataFrame:
    """(document, heading, targets): what each section links to, each target once, in order of first mention; links: document, heading,
    line, reference, target."""
    first = links.where("target IS NOT NULL").groupBy("document", "heading", "target").agg(F.min(F.struct("line", "reference")).alias("at"))
    g = first.groupBy("document", "heading").agg(F.array_sort(F.collect_list(F.struct("at", "target"))).alias("x"))
    return g.select("document", "heading", F.transform("x", lambda x: x["target"]).alias("targets"))


def response_action(status: Column) -> Column:
    """struct(action, wait): what an HTTP status means for a task."""
    wait = status.isin(403, 429)
    action = F.when(wait, "RETRY_GLOBAL_WAIT").when(status >= 500, "RETRY").when(status != 200, "BLOCKED").otherwise("ACCEPT")
    return F.struct(action.alias("action"), F.when(status >= 500, 60).alias("wait"))


def new_repositories(found: DataFrame, known: DataFrame, budget: DataFrame) -> DataFrame:
    """(mission, repository): repositories found (mission, seq, repository) that aren't known yet, in any spelling, as far as the mission's
    budget (mission, most) goes."""
    low = lambda df: df.select("mission", F.lower("repository").alias("key"))
    had = low(known).distinct()
    n = had.groupBy("mission").agg(F.count("*").alias("had"))
    fresh = found.withColumn("key", F.lower("repository")).join(had, ["mission", "key"], "left_anti")
    fresh = fresh.groupBy("mission", "key").agg(F.min_by("repository", "seq").alias("repository"), F.min("seq").alias("seq"))
    most = budget.select("mission", "most").groupBy("mission").agg(F.min("most").alias("most")).join(n, "mission", "left")
    # a mission asks for ten at most, so ranks beyond that need not be known
    ranked = top_rows(fresh, ["mission"], [F.col("seq"), F.col("key")], LIMITS["max_repos"][1], "place").join(most, "mission")
    return ranked.where("place <= most - coalesce(had, 0)").select("mission", "repository")


def repository_code(private: Column, license: Column) -> Column:
    return first_code(("REPOSITORY_NOT_PUBLIC", private), ("LICENSE_METADATA_ONLY", ~F.coalesce(license.isin(LICENSES), F.lit(False))), otherwise="READ_COMMIT")


def files_to_read(tree: DataFrame, terms: list[str], per_repo: int, total: int) -> DataFrame:
    """(mission, repository, path): eligible files of trees (mission, repository, path) by priority, at most per_repo a repository and
    `total` a mission."""
    hits = sum((F.contains(F.lower("path"), F.lit(t)).cast("int") for t in terms), F.lit(0))
    order = [F.desc("hits"), F.length("path"), F.col("path")]
    own = top_rows(tree.withColumn("hits", hits), ["mission", "repository"], order, per_repo, "place")
    return top_rows(own, ["mission"], [F.col("place"), F.col("repository")], total, "turn").select("mission", "repository", "path")
