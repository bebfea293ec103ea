"""What is let in: manifests, paths, search strings, profiles, approved spans, lineage; and cues in texts.

Each check gives a code column: `OK` or the first refusal that holds. Uniqueness is an aggregation on the key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators.ranking import cut

# Providers and licences allowed, folders left out, substrings no search string may hold, cue patterns.
PROVIDERS = ["gdrive", "synthetic", "github", "local"]
LICENSES = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "Unlicense"]
EXCLUDED = [".git", ".venv", "venv", "node_modules", "__pycache__", "vendor", "site-packages", "fixtures", "test", "tests"]
PRIVATE = ["http:", "https:", "password", "api_key", "token=", "ghp_", "github_pat_", "-----begin", "is:private"]
CUES = {
    "manual": r"\b(manually|manual|re-enter|copy and paste)\b",
    "requirement": r"\b(must|requires?|need(?:s)? to)\b",
    "limitation": r"\b(cannot|not supported|does not|missing|without)\b",
}
MAX_CONTAINER = 8_000_000


def _first(*checks: tuple[Column, str]) -> Column:
    """The code of the first check that is true; nulls count as true, so that missing values are refused."""
    return reduce(lambda c, x: c.when(F.coalesce(x[0], F.lit(True)), x[1]), checks[1:], F.when(F.coalesce(checks[0][0], F.lit(True)), checks[0][1])).otherwise("OK")


def plain_text(c: Column, most: int) -> Column:
    return (F.trim(c) != "") & (F.length(c) <= most) & ~c.rlike(r"[\x00-\x1F]")


def repository_path(c: Column) -> Column:
    """A normalised relative path without parent steps, back slashes or colons."""
    parts = F.split(c, "/")
    return plain_text(c, 500) & ~c.contains("\\") & ~c.contains(":") & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def manifest_codes(files: DataFrame) -> DataFrame:
    """files (provider, file_id, path, size, sha256, source_url) with a code; repeated ids or paths are refused."""
    provider = F.coalesce("provider", F.lit("gdrive"))
    url = F.when(provider == "synthetic", F.concat(F.lit("fixture://"), "file_id")).when(provider == "local", F.concat(F.lit("local://"), "path")).otherwise(F.concat(F.lit("https://drive.google.com/file/d/"), "file_id", F.lit("/view")))
    ids = files.groupBy("file_id").agg(F.count("*").alias("_ids"))
    paths = files.groupBy("path").agg(F.count("*").alias("_paths"))
    j = files.join(ids, "file_id", "left").join(paths, "path", "left")
    code = _first(
        (~plain_text(F.col("file_id"), 200), "TEXT_BOUNDS"),
        (~repository_path(F.col("path")), "REPOSITORY_PATH"),
        (~F.col("size").between(0, MAX_CONTAINER), "INTEGER_BOUNDS"),
        (~F.col("sha256").rlike("^[0-9a-f]{64}$"), "CORPUS_SOURCE_SHA"),
        (~provider.isin(PROVIDERS), "CORPUS_PROVIDER"),
        ((provider != "github") & (F.col("source_url") != url), "CORPUS_SOURCE_URL"),
        ((F.col("_ids") > 1) | (F.col("_paths") > 1), "DUPLICATE_CORPUS_SOURCE"),
    )
    return j.select(*files.columns, code.alias("code"))


def eligible_file(path: Column, size: Column, mode: Column, most: int) -> Column:
    """A regular Python file of bounded size outside of test, vendor and hidden folders."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    return repository_path(path) & path.endswith(".py") & mode.isin("100644", "100755") & size.between(1, most) & ~F.arrays_overlap(parts, F.array(*map(F.lit, EXCLUDED))) & ~name.rlike(r"^(test_|\.)")


def public_query(c: Column) -> Column:
    """Code of a search string that would leave the house."""
    low = F.lower(c)
    private = reduce(lambda a, b: a | b, [F.contains(low, F.lit(s)) for s in PRIVATE])
    return _first((~plain_text(c, 220), "TEXT_BOUNDS"), (private, "PUBLIC_QUERY_REQUIRED"), (~c.rlike(r'^[A-Za-z0-9_ :,".\-]+$'), "QUERY_CHARACTERS"))


def profile_codes(targets: DataFrame) -> DataFrame:
    """targets (api, capability) of one profile with a code."""
    n = targets.groupBy("api").agg(F.count("*").alias("_n"))
    j = targets.join(n, "api", "left")
    code = _first(
        (~F.col("api").rlike(r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)+$") | (F.col("_n") > 1), "EXACT_API_REQUIRED"),
        (~F.col("capability").rlike("^[a-z][a-z0-9_]{0,79}$"), "CAPABILITY_LABEL"),
    )
    return j.select(*targets.columns, code.alias("code"))


def outside_approved(findings: DataFrame, approved: DataFrame) -> DataFrame:
    """findings (path, start, end) that no approved span (path, start, end) of the same path holds wholly.

    A finding is inside one exactly if, of the spans that begin no later, the farthest end reaches its own. Both are dealt by range of
    (path, start) and read in order with a running maximum; what earlier partitions reached is a small table. So a path with any number
    of spans and findings is spread, and no pairs are made."""
    columns = findings.columns
    spans = approved.select(F.col("path").alias("_p"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.lit(0).alias("_k"))
    both = spans.unionByName(findings.select("*", F.col("path").alias("_p"), F.col("start").alias("_s"), F.lit(None).cast("long").alias("_e"), F.lit(1).alias("_k")), allowMissingColumns=True)
    dealt = cut(both.repartitionByRange("_p", "_s", "_k").sortWithinPartitions("_p", "_s", "_k").withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    reach = dealt.groupBy("_p", part.alias("_part")).agg(F.max("_e").alias("_far"))
    before = F.max("_far").over(W.partitionBy("_p").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    reach = reach.select("_p", "_part", before.alias("_before"))
    here = F.max("_e").over(W.partitionBy("_p", "_part").orderBy("_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    j = dealt.withColumn("_part", part).join(reach, ["_p", "_part"]).withColumn("_reach", F.greatest(here, F.col("_before")))
    return j.where("_k = 1 AND (_reach IS NULL OR _reach < `end`)").select(*columns)


def cues(df: DataFrame, row: str, text: str, most: int = 12) -> DataFrame:
    """(row, cue, n, first): how often each cue stands in a text (up to `most` are drafted), and its first spelling."""
    t = F.coalesce(F.col(text), F.lit(""))
    each = [F.struct(F.lit(k).alias("cue"), F.regexp_extract_all(t, F.lit(f"(?i){p}"), F.lit(0)).alias("found")) for k, p in CUES.items()]
    x = df.select(row, F.explode(F.array(*each)).alias("x")).where(F.size("x.found") > 0)
    return x.select(row, "x.cue", F.least(F.size("x.found"), F.lit(most)).cast("long").alias("n"), F.lower(F.get("x.found", F.lit(0))).alias("first"))


def on_cycles(edges: DataFrame) -> DataFrame:
    """(id): sources that are derived from themselves along edges (a, b), however long the way.

    Nodes without a way in or out are peeled off until none is left (a checkpoint a round); only what remains, the cycles and what lies
    between them, is closed transitively, doubling the length of ways each round."""
    e = cut(edges.select("a", "b").distinct())
    while True:
        inner = e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(e.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        inner = cut(inner.select("a", "b"))
        if inner.count() == e.count():
            break
        e = inner
    walk = e
    while True:
        longer = walk.alias("w").join(walk.alias("v"), F.col("w.b") == F.col("v.a")).select(F.col("w.a").alias("a"), F.col("v.b").alias("b"))
        longer = cut(walk.union(longer).distinct())
        if longer.count() == walk.count():
            return walk.where("a = b").select(F.col("a").alias("id")).distinct()
        walk = longer


def producing_steps(workflows: DataFrame) -> DataFrame:
    """(workflow, target, step): the steps before a target that supply what it needs, directly or through others.

    workflows: workflow, target, initial array, steps array<struct<id, requires, produces>> in order, up to and with
    the target. A reverse fold inside the JVM."""
    start = F.struct(F.array().cast("array<string>").alias("wanted"), F.array().cast("array<string>").alias("chosen"))
    last = F.element_at("steps", -1)

    def step(acc, s):
        use = (s["id"] == F.col("target")) | (F.size(F.array_intersect(acc["wanted"], s["produces"])) > 0)
        wanted = F.when(use, F.array_union(acc["wanted"], F.array_except(s["requires"], F.col("initial")))).otherwise(acc["wanted"])
        return F.struct(wanted.alias("wanted"), F.when(use, F.concat(acc["chosen"], F.array(s["id"]))).otherwise(acc["chosen"]).alias("chosen"))

    w = workflows.where(last["id"] == F.col("target"))
    return w.select("workflow", "target", F.explode(F.aggregate(F.reverse("steps"), start, step)["chosen"]).alias("step"))


def attempt_states(attempts: DataFrame, retryable: list[str], most: int = 3) -> DataFrame:
    """(source, attempts, state): DONE once any attempt succeeded; else RETRY while attempts and a retryable reason are left."""
    g = attempts.groupBy("source").agg(F.count("*").alias("attempts"), F.max(F.col("outcome") == "DONE").alias("_done"), F.max_by("outcome", "n").alias("_last"))
    state = F.when(F.col("_done"), "DONE").when((F.col("attempts") < most) & F.col("_last").isin(retryable), "RETRY").otherwise("GAP")
    return g.select("source", "attempts", state.alias("state"))
