"""Opportunity bundles on the tables: customers as sources, order lines as steps, parts as needs, suppliers as mechanisms."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import portfolio
from lodestone.operators.opportunity import SETTLED
from lodestone.plans import modules as M
from lodestone.plans.module_queries import _PROBED, code, profile
from lodestone.plans.text_queries import table
from lodestone.sources import code as C

QUERIES, SQL = {}, {}
_STATES = ["CORROBORATED_WORKFLOW_PROBLEM", "SINGLE_SOURCE_PROBLEM", "EXISTING_OPTION_TO_VERIFY", "CONFLICT_REQUIRES_REVIEW", "STALE_EVIDENCE_RECHECK", "INFORMATION_GAP_ONLY"]


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def pick(items, c):
    return F.element_at(F.array(*map(F.lit, items)), (c % len(items) + 1).cast("int"))


def pick_sql(items, c: str) -> str:
    return f"[{', '.join(repr(x) for x in items)}][(({c}) % {len(items)} + 1)::INT]"


_PATTERN_LIST = [*portfolio.PATTERNS, "odd_pattern"]
_KINDS = [*portfolio.OBSERVATIONS, "rumour"]
_BUNDLE = f"""src AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 3 THEN [c_custkey - 1] WHEN c_custkey % 10 = 4 THEN [c_custkey - 1, c_custkey] WHEN c_custkey % 10 = 5 THEN [c_custkey + 1] WHEN c_custkey % 10 = 6 THEN [c_custkey - 1] WHEN c_custkey % 10 = 7 THEN [-1] ELSE [] END::BIGINT[] AS df FROM customer),
lin AS (SELECT id, unnest(df) AS f FROM src), st AS (SELECT DISTINCT l_orderkey AS workflow, l_linenumber AS step, 'f' || (l_partkey % 4) AS field FROM lineitem),
nd AS (SELECT p_partkey AS need, p_partkey % 500 AS workflow, 1 + p_partkey % 3 AS step, 'f' || (p_size % 4) AS field, {pick_sql(_PATTERN_LIST, "p_size")} AS pattern FROM part),
ob AS (SELECT o_orderkey AS id, (o_orderkey % 400) % 500 AS workflow, o_orderkey % 400 AS need, {pick_sql(_KINDS, "o_orderkey")} AS kind, CASE WHEN o_orderkey % 13 = 0 THEN 'elsewhere' ELSE 'target' END AS scope FROM orders),
me AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN [] WHEN s_suppkey % 5 = 1 THEN ['odd_pattern'] ELSE ['format_gap'] END::VARCHAR[] AS addresses, CASE WHEN s_suppkey % 7 = 0 THEN [] ELSE ['small'] END::VARCHAR[] AS limits FROM supplier)"""


@query(
    "bundle_faults",
    f"""WITH {_BUNDLE} SELECT DISTINCT id::VARCHAR AS record, 'SOURCE_LINEAGE' AS code FROM lin WHERE id = f OR f NOT IN (SELECT id FROM src)
    UNION ALL SELECT DISTINCT a.id::VARCHAR, 'SOURCE_LINEAGE_CYCLE' FROM lin a JOIN lin b ON a.f = b.id AND b.f = a.id WHERE a.id <> a.f
    UNION ALL SELECT need::VARCHAR, 'NEED_STEP_CONTRACT' FROM nd WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.workflow = nd.workflow AND st.step = nd.step AND st.field = nd.field)
    UNION ALL SELECT need::VARCHAR, 'NEED_CLASSIFICATION' FROM nd WHERE pattern = 'odd_pattern'
    UNION ALL SELECT min(need)::VARCHAR, 'DUPLICATE_NEED_SLOT' FROM nd GROUP BY workflow, step, field HAVING count(*) > 1
    UNION ALL SELECT id::VARCHAR, 'OBSERVATION_TARGET' FROM ob WHERE NOT EXISTS (SELECT 1 FROM nd WHERE nd.need = ob.need AND nd.workflow = ob.workflow)
    UNION ALL SELECT id::VARCHAR, 'OBSERVATION_KIND' FROM ob WHERE kind = 'rumour' OR scope = 'elsewhere'
    UNION ALL SELECT id::VARCHAR, 'MECHANISM_SCOPE' FROM me WHERE len(addresses) = 0 OR list_contains(addresses, 'odd_pattern') OR len(limits) = 0""",
)
def bundle_faults(spark, sf_dir):
    k = F.col("c_custkey")
    m = k % 10
    arr = lambda *x: F.array(*[v.cast("long") for v in x])
    lineage = F.when(m == 3, arr(k - 1)).when(m == 4, arr(k - 1, k)).when(m == 5, arr(k + 1)).when(m == 6, arr(k - 1)).when(m == 7, arr(F.lit(-1))).otherwise(F.array().cast("array<bigint>"))
    sources = table(spark, sf_dir, "customer").select(k.alias("id"), lineage.alias("derived_from"))
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("workflow"), F.col("l_linenumber").alias("step"), F.array(F.concat(F.lit("f"), F.col("l_partkey") % 4)).alias("requires"))
    p = F.col("p_partkey")
    needs = table(spark, sf_dir, "part").select(p.alias("need"), (p % 500).alias("workflow"), (1 + p % 3).alias("step"), F.concat(F.lit("f"), F.col("p_size") % 4).alias("field"), pick(_PATTERN_LIST, F.col("p_size")).alias("pattern"))
    o = F.col("o_orderkey")
    obs = table(spark, sf_dir, "orders").select(o.alias("id"), (o % 400 % 500).alias("workflow"), (o % 400).alias("need"), pick(_KINDS, o).alias("kind"), F.when(o % 13 == 0, "elsewhere").otherwise("target").alias("scope"))
    s = F.col("s_suppkey")
    none = F.array().cast("array<string>")
    mech = table(spark, sf_dir, "supplier").select(s.alias("id"), F.when(s % 5 == 0, none).when(s % 5 == 1, F.array(F.lit("odd_pattern"))).otherwise(F.array(F.lit("format_gap"))).alias("addresses"), F.when(s % 7 == 0, none).otherwise(F.array(F.lit("small"))).alias("limits"))
    return portfolio.bundle_faults(sources, steps, needs, obs, mech)


@query(
    "counter_questions",
    """SELECT p_partkey, unnest(['existing_solution', 'search', 'disconfirm_need', 'experiment']) AS kind, unnest(['What already supplies ' || p_name || ' for ' || p_brand || '?', substr(p_type || ' ' || p_name || ' existing solution manual workflow', 1, 200),
    'Can the task be completed without ' || p_name || '?', 'Does the proposed intervention reduce the effort of obtaining ' || p_name || '?']) AS question FROM part""",
)
def counter_questions(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", F.inline(portfolio.counter_questions(F.col("p_brand"), F.col("p_type"), F.col("p_name"))))


@query("recommended_actions", f"SELECT p_partkey, CASE WHEN s = 'EXISTING_OPTION_TO_VERIFY' THEN 'EVALUATE_EXISTING_OPTION' WHEN s IN ('CONFLICT_REQUIRES_REVIEW', 'STALE_EVIDENCE_RECHECK') THEN 'RESOLVE_EVIDENCE_FIRST' ELSE 'INVESTIGATE_WORKFLOW_HYPOTHESIS' END AS action FROM (SELECT p_partkey, {pick_sql(_STATES, 'p_size')} AS s FROM part)")
def recommended_actions(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", portfolio.recommended_action(pick(_STATES, F.col("p_size"))).alias("action"))


_FITS = ["DECLARED_DIRECT_FIT", "CONTRACT_MISMATCH", "DECLARED_SUPPORT_FIT", "MISSING_INPUTS", "UNRESOLVED_CONTRACT"]


@query(
    "transfer_reviews",
    f"""WITH h AS (SELECT p_partkey AS need, {pick_sql(_STATES, 'p_size')} AS state FROM part), a AS (SELECT l_partkey AS need, l_suppkey AS mechanism, {pick_sql(_FITS, 'min(l_linenumber + l_orderkey)')} AS status FROM lineitem GROUP BY ALL),
    o AS (SELECT * FROM h WHERE state NOT IN ({', '.join(repr(s) for s in SETTLED)})), j AS (SELECT a.* FROM a JOIN o USING (need)), n AS (SELECT need, count(*) AS pairs FROM j GROUP BY 1),
    f AS (SELECT need, mechanism, row_number() OVER (PARTITION BY need ORDER BY status <> 'DECLARED_DIRECT_FIT', mechanism) AS place FROM j WHERE status IN ('DECLARED_DIRECT_FIT', 'DECLARED_SUPPORT_FIT')), b AS (SELECT need, list(mechanism ORDER BY place) AS c FROM f WHERE place <= 6 GROUP BY 1)
    SELECT h.need, CASE WHEN o.need IS NULL THEN 'ORIGINAL_EVIDENCE_GATE_RETAINED' ELSE 'DECLARATION_REVIEW_ONLY' END AS status, coalesce(pairs, 0) AS pairs, coalesce(c, []) AS candidates FROM h LEFT JOIN o USING (need) LEFT JOIN n USING (need) LEFT JOIN b USING (need)""",
)
def transfer_reviews(spark, sf_dir):
    """Parts as hypotheses, suppliers of their lines as mechanisms with an assessed contract."""
    h = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("need"), pick(_STATES, F.col("p_size")).alias("state"))
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("need"), F.col("l_suppkey").alias("mechanism")).agg(F.min(F.col("l_linenumber") + F.col("l_orderkey")).alias("k"))
    return portfolio.transfer_review(h, a.select("need", "mechanism", pick(_FITS, F.col("k")).alias("status")))


_CASES = ["PASS", "PASS", "FAIL", "MISSING", "INCOMPLETE_OBSERVATIONS", "ERROR", "PASS"]


@query(
    "plan_states",
    f"""SELECT plan, CASE WHEN count(*) FILTER (s = 'MISSING') = count(*) THEN 'PLAN_ONLY' WHEN count(*) FILTER (s IN ('FAIL', 'ERROR')) > 0 THEN 'REPORTED_FAIL' WHEN count(*) FILTER (s NOT IN ('PASS', 'FAIL', 'ERROR')) > 0 THEN 'REPORTED_INCOMPLETE' ELSE 'REPORTED_PASS' END AS status,
    count(*) FILTER (s = 'PASS') AS passed, count(*) FILTER (s IN ('FAIL', 'ERROR')) AS failed, count(*) FILTER (s NOT IN ('PASS', 'FAIL', 'ERROR')) AS incomplete FROM (SELECT o_custkey AS plan, {pick_sql(_CASES, 'o_orderkey')} AS s FROM orders WHERE o_orderkey % 3 = 0) GROUP BY 1""",
)
def plan_states(spark, sf_dir):
    """Customers as plans, every third order as a case (a case per order would leave no plan without failures)."""
    c = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("plan"), pick(_CASES, F.col("o_orderkey")).alias("status"))
    return portfolio.plan_status(c, "plan")


@query("trial_gate", "WITH c AS (SELECT event_type AS kind, count(*) AS cases, count(*) FILTER (value >= 0) AS passed FROM events GROUP BY 1), w(kind, required) AS (VALUES ('click', 7), ('error', 100000), ('vector', 28), ('view', 1)) SELECT w.kind, required::BIGINT AS required, coalesce(cases, 0) AS cases, coalesce(passed, 0) AS passed, coalesce(cases, 0) = required AND coalesce(passed, 0) = required AS open FROM w LEFT JOIN c USING (kind)")
def trial_gate(spark, sf_dir):
    cases = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), (F.col("value") >= 0).alias("passed"))
    return portfolio.gate(cases, {"click": 7, "error": 100000, "vector": 28, "view": 1})


_OBSERVED = [*portfolio.FORM_OBSERVATIONS, "heard"]


def forms(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("form"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("received"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("needed"), F.when(F.col("p_size") % 9 == 0, "").otherwise(F.col("p_type")).alias("note"), F.when(F.col("p_size") % 8 == 0, " ").otherwise(F.col("p_brand")).alias("actor"), pick(_PATTERN_LIST, F.col("p_size")).alias("pattern"), pick(_OBSERVED, F.col("p_partkey")).alias("observation"))


@query("form_codes", f"SELECT p_partkey AS form, CASE WHEN p_size % 8 = 0 THEN 'GUIDED_FIELD' WHEN p_size % 9 = 0 THEN 'GUIDED_NOTE' WHEN {pick_sql(_PATTERN_LIST, 'p_size')} = 'odd_pattern' OR {pick_sql(_OBSERVED, 'p_partkey')} = 'heard' THEN 'GUIDED_CLASSIFICATION' ELSE 'OK' END AS code FROM part")
def form_codes(spark, sf_dir):
    f = forms(spark, sf_dir)
    return f.select("form", portfolio.form_code(F.col("note"), F.col("pattern"), F.col("observation"), [F.col("actor"), F.col("received"), F.col("needed")]).alias("code"))


@query("guided_bundles", f"""WITH f AS (SELECT p_partkey AS form, split_part(p_name, ' ', 1) AS r, split_part(p_name, ' ', 2) AS n, CASE WHEN {pick_sql(_OBSERVED, 'p_partkey')} IN ('manual', 'missing', 'pain') THEN 'reported' ELSE 'inferred' END AS basis FROM part)
SELECT form, 'receive' AS step, [r] AS requires, [r] AS produces, NULL AS need, basis FROM f UNION ALL SELECT form, 'review', list_sort(list_distinct([r, n])), ['task_result'], n, basis FROM f""")
def guided_bundles(spark, sf_dir):
    return portfolio.guided_bundle(forms(spark, sf_dir))


@query("changed_plans", "SELECT need, CASE WHEN need % 6 IN (1, 2, 3) THEN 'INVESTIGATION_PLAN_CHANGED' ELSE 'OK' END AS code FROM (SELECT DISTINCT l_orderkey AS need FROM lineitem)")
def changed_plans(spark, sf_dir):
    """Plans of three tasks each, after some lost one, some gained one and some had one rewritten."""
    o = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("need")).distinct()
    place = F.explode(F.array(*map(F.lit, range(4)))).alias("place")
    each = o.select("need", place).withColumn("kind", F.concat(F.lit("k"), "place"))
    k = F.col("need") % 6
    stored = each.where("place < 3")
    now = each.where(F.when(k == 1, F.col("place") < 2).when(k == 2, F.lit(True)).otherwise(F.col("place") < 3)).withColumn("kind", F.when((k == 3) & (F.col("place") == 1), "other").otherwise(F.col("kind")))
    return portfolio.changed_plans(stored, now)


@query(
    "mission_codes",
    """SELECT c_custkey, CASE WHEN c_custkey % 7 IN (0, 5, 6) THEN 'QUERY_COUNT' WHEN c_custkey % 5 = 0 THEN 'PATH_TERMS' WHEN c_custkey % 120 NOT BETWEEN 1 AND 100 THEN 'LIMIT_KEYS' WHEN c_custkey % 3 = 0 THEN 'LICENSE_POLICY' ELSE 'OK' END AS code FROM customer""",
)
def mission_codes(spark, sf_dir):
    """Customers as missions with none to six queries, odd path terms, budgets out of range and a licence that isn't allowed."""
    k = F.col("c_custkey")
    queries = F.when(k % 7 == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), (k % 7).cast("int")))
    terms = F.when(k % 5 == 0, F.array(F.lit("Not ok"))).otherwise(F.array(F.lit("io"), F.lit("parse-2")))
    limits = {name: F.lit(low) for name, (low, _) in portfolio.LIMITS.items()} | {"max_requests": k % 120}
    licenses = F.when(k % 3 == 0, F.array(F.lit("MIT"), F.lit("GPL-3.0"))).otherwise(F.array(F.lit("MIT"), F.lit("ISC")))
    return table(spark, sf_dir, "customer").select("c_custkey", portfolio.mission_code(queries, terms, licenses, limits).alias("code"))


@query("bound_hits", "SELECT l_orderkey * 10 + l_linenumber AS query, l_partkey AS id, CASE WHEN l_partkey % 7 = 0 THEN 'NOT_BOUND' WHEN l_partkey % 5 = 0 THEN 'EVIDENCE_BINDING' ELSE 'BOUND' END AS code FROM lineitem")
def bound_hits(spark, sf_dir):
    p = F.col("p_partkey")
    records = table(spark, sf_dir, "part").where(p % 7 != 0).select(p.alias("id"), F.when(p % 5 == 0, "other").otherwise(F.sha2(p.cast("string"), 256)).alias("sha256"))
    hits = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("query"), F.col("l_partkey").alias("id"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("sha256"))
    return portfolio.bind_hits(hits, records)


@query("observed_needs", "WITH o AS (SELECT o_custkey % 25 AS workflow, o_custkey AS need, count(*) AS n FROM orders GROUP BY ALL) SELECT n_nationkey AS workflow, c_custkey AS need, coalesce(n, 0) AS observations FROM nation JOIN customer ON c_custkey % 25 = n_nationkey LEFT JOIN o ON o.workflow = n_nationkey AND o.need = c_custkey")
def observed_needs(spark, sf_dir):
    w = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("workflow"))
    n = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 25).alias("workflow"), F.col("c_custkey").alias("need"))
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("workflow"), F.col("o_custkey").alias("need"))
    return portfolio.observed_needs(w, n, o)


@query("linked_sections", "SELECT 'part ' || replace(regexp_extract(source_id, 'm[0-9]+'), 'm', '') AS document, heading, targets FROM (" + M.expected("heading targets", {0: [("Part {k}", ["box{n}/m{k}.py:Store{k}.save", "box{n}/m{k}.py:digest_{k}"]), ("More", ["box{n}/m{k}.py:digest_{k}"])]}) + ")")
def linked_sections(spark, sf_dir):
    """What each section of the notes on every part links to."""
    from lodestone.plans.module_queries import document_links

    return portfolio.linked_sections(document_links(spark, sf_dir))


@query("finding_counts", "SELECT capability, count(*) AS findings, count(DISTINCT source_id) AS sources FROM (" + M.expected("scope api capability line", _PROBED) + ") GROUP BY 1")
def finding_counts(spark, sf_dir):
    p = C.probe(code(spark, sf_dir), profile(spark))
    return p.groupBy("capability").agg(F.count("*").alias("findings"), F.countDistinct("source_id").alias("sources"))


@query("card_traits", "SELECT source_id, list_sort(list(DISTINCT capability)) AS traits FROM (" + M.expected("scope api capability line", _PROBED) + ") GROUP BY 1")
def card_traits(spark, sf_dir):
    """The distinct operations observed in each source (as many as a profile has at most)."""
    p = C.probe(code(spark, sf_dir), profile(spark))
    return p.groupBy("source_id").agg(F.array_sort(F.collect_set("capability")).alias("traits"))


@query("hypothesis_summary", f"SELECT {pick_sql(_STATES, 'p_size')} AS state, count(*) AS hypotheses, count(DISTINCT p_brand) AS source_groups FROM part GROUP BY 1")
def hypothesis_summary(spark, sf_dir):
    h = table(spark, sf_dir, "part").select(pick(_STATES, F.col("p_size")).alias("state"), "p_brand")
    return h.groupBy("state").agg(F.count("*").alias("hypotheses"), F.countDistinct("p_brand").alias("source_groups"))


@query("recovery_totals", "SELECT o_orderpriority AS reason, count(DISTINCT o_custkey) AS sources, count(*) AS attempts, count(*) FILTER (o_orderstatus = 'F') AS recovered FROM orders GROUP BY 1")
def recovery_totals(spark, sf_dir):
    """Attempts by reason: how many, over how many sources, and how many ended well."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("reason"), "o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("ok"))
    return o.groupBy("reason").agg(F.count("*").alias("sources"), F.sum("n").alias("attempts"), F.sum("ok").alias("recovered"))


# -- discovery

_HTTP = [200, 200, 403, 404, 429, 500, 503, 301]


@query("response_actions", f"SELECT event_id, CASE s WHEN 403 THEN 'RETRY_GLOBAL_WAIT' WHEN 429 THEN 'RETRY_GLOBAL_WAIT' WHEN 500 THEN 'RETRY' WHEN 503 THEN 'RETRY' WHEN 200 THEN 'ACCEPT' ELSE 'BLOCKED' END AS action, CASE WHEN s >= 500 THEN 60 END AS wait FROM (SELECT event_id, {_HTTP}[(event_id % {len(_HTTP)} + 1)::INT] AS s FROM events)")
def response_actions(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", portfolio.response_action(pick(_HTTP, F.col("event_id"))).alias("x")).select("event_id", "x.action", "x.wait")


@query(
    "new_repositories",
    """WITH f AS (SELECT o_custkey AS mission, o_orderkey AS seq, CASE WHEN o_orderkey % 2 = 0 THEN 'Own/R' ELSE 'own/r' END || (o_orderkey % 9) AS r FROM orders), kn AS (SELECT DISTINCT o_custkey AS mission, 'own/r' || (o_orderkey % 9) AS key FROM orders WHERE o_orderkey % 5 = 0),
    x AS (SELECT mission, lower(r) AS key, arg_min(r, seq) AS repository, min(seq) AS seq FROM f WHERE NOT EXISTS (SELECT 1 FROM kn WHERE kn.mission = f.mission AND kn.key = lower(f.r)) GROUP BY ALL),
    y AS (SELECT *, row_number() OVER (PARTITION BY mission ORDER BY seq, key) AS place FROM x), h AS (SELECT mission, count(*) AS had FROM kn GROUP BY 1)
    SELECT y.mission, repository FROM y JOIN customer ON c_custkey = y.mission LEFT JOIN h ON h.mission = y.mission WHERE place <= c_custkey % 10 + 1 - coalesce(had, 0)""",
)
def new_repositories(spark, sf_dir):
    """Orders as search results of their customer; some of the repositories are known, in other spellings."""
    o = F.col("o_orderkey")
    found = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("mission"), o.alias("seq"), F.concat(F.when(o % 2 == 0, "Own/R").otherwise("own/r"), (o % 9).cast("string")).alias("repository"))
    known = table(spark, sf_dir, "orders").where(o % 5 == 0).select(F.col("o_custkey").alias("mission"), F.concat(F.lit("OWN/r"), (o % 9).cast("string")).alias("repository"))
    budget = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mission"), (F.col("c_custkey") % 10 + 1).alias("most"))
    return portfolio.new_repositories(found, known, budget)


@query("repository_codes", "SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN 'REPOSITORY_NOT_PUBLIC' WHEN s_suppkey % 4 IN (2, 3) THEN 'LICENSE_METADATA_ONLY' ELSE 'READ_COMMIT' END AS code FROM supplier")
def repository_codes(spark, sf_dir):
    s = F.col("s_suppkey")
    license = F.when(s % 4 == 0, "MIT").when(s % 4 == 1, "Apache-2.0").when(s % 4 == 2, "GPL-3.0")
    return table(spark, sf_dir, "supplier").select(s, portfolio.repository_code(s % 6 == 0, license).alias("code"))


@query(
    "files_to_read",
    """WITH t AS (SELECT l_suppkey AS mission, l_partkey % 20 AS repository, 'src/' || replace(p_name, ' ', '_') || '_' || l_partkey || '.py' AS path FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
    a AS (SELECT *, row_number() OVER (PARTITION BY mission, repository ORDER BY contains(lower(path), 'red')::INT + contains(lower(path), 'ring')::INT DESC, length(path), path) AS place FROM t),
    b AS (SELECT *, row_number() OVER (PARTITION BY mission ORDER BY place, repository) AS turn FROM a WHERE place <= 3) SELECT mission, repository, path FROM b WHERE turn <= 30""",
)
def files_to_read(spark, sf_dir):
    """Parts of a supplier's lines as files: three a repository, thirty a mission, those that name a term first."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    path = F.concat(F.lit("src/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), "l_partkey", F.lit(".py"))
    t = j.select(F.col("l_suppkey").alias("mission"), (F.col("l_partkey") % 20).alias("repository"), path.alias("path")).distinct()
    return portfolio.files_to_read(t, ["red", "ring"], 3, 30)
