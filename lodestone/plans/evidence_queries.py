"""Queries that evaluate evidence: division, citations, comparison, states, contracts, cases, matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import evidence, matching
from lodestone.plans.text_queries import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@query(
    "requirement_division",
    """SELECT l_orderkey, sum((l_returnflag = 'R')::INT + (l_returnflag <> 'R' AND l_quantity > 30)::INT)::BIGINT AS evidence FROM lineitem GROUP BY 1
    HAVING bool_or(l_returnflag = 'R') AND bool_or(l_quantity > 30) AND NOT bool_or(l_tax > 0.07)""",
)
def requirement_division(spark, sf_dir):
    """Orders with a returned line and a large line, and none of high tax."""
    li = table(spark, sf_dir, "lineitem")
    return matching.divide(li, "l_orderkey", {"returned": F.col("l_returnflag") == "R", "large": F.col("l_quantity") > 30}, F.col("l_tax") > 0.07)


@query("eligible_documents", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def eligible_documents(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return matching.eligible(d, "doc_id", lab.where("quality = 1"), lab.where("toxic = 1")).select("doc_id", "source")


@query(
    "checked_citations",
    """SELECT code, count(*) AS citations FROM (SELECT CASE WHEN d.doc_id IS NULL THEN 'UNKNOWN_EVIDENCE_SOURCE' WHEN e <= s OR e > length(t) THEN 'EVIDENCE_SPAN' WHEN substr(t, s + 1, e - s) <> q THEN 'EVIDENCE_QUOTE_MISMATCH' ELSE 'OK' END AS code
      FROM (SELECT doc_id + CASE WHEN doc_id % 11 = 0 THEN 1000000000 ELSE 0 END AS k, doc_id % 50 AS s, doc_id % 50 + 20 AS e, substr(coalesce(text, ''), (doc_id % 50 + 1)::INT, 20 - (doc_id % 7 = 0)::INT) AS q FROM documents) c
      LEFT JOIN (SELECT doc_id, coalesce(text, '') AS t FROM documents) d ON c.k = d.doc_id) GROUP BY 1""",
)
def checked_citations(spark, sf_dir):
    """Citations of 20 characters, some cut short and some of unknown sources, held against their texts."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    start = F.col("doc_id") % 50
    quote = F.substring(F.col("text"), (start + 1).cast("int"), F.lit(20) - (F.col("doc_id") % 7 == 0).cast("int"))
    c = d.select((F.col("doc_id") + F.when(F.col("doc_id") % 11 == 0, 1_000_000_000).otherwise(0)).alias("doc_id"), start.cast("int").alias("start"), (start + 20).cast("int").alias("end"), quote.alias("quote"))
    return matching.check_citations(c, d, "doc_id", "text").groupBy("code").agg(F.count("*").alias("citations"))


@query(
    "compared_versions",
    """WITH b AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents WHERE lang <> 'fr'), a AS (SELECT doc_id, sha256(CASE WHEN source = 'src1' THEN coalesce(text, '') || '.' ELSE coalesce(text, '') END) AS h FROM documents WHERE lang <> 'de')
    SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'ADDED' WHEN a.doc_id IS NULL THEN 'REMOVED' WHEN a.h = b.h THEN 'UNCHANGED' ELSE 'CHANGED' END AS change FROM b FULL JOIN a ON a.doc_id = b.doc_id""",
)
def compared_versions(spark, sf_dir):
    """Two versions of the corpus: one without French, one without German and with a source changed."""
    d = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    before = d.where("lang <> 'fr'").select("doc_id", F.sha2("text", 256).alias("h"))
    after = d.where("lang <> 'de'").select("doc_id", F.sha2(F.when(F.col("source") == "src1", F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("h"))
    return matching.compare_versions(before, after, "doc_id", "h")


@query(
    "verified_listing",
    """WITH m AS (SELECT url, sha256(html) AS h FROM pages WHERE page_id % 5 <> 1), l AS (SELECT url, CASE WHEN page_id % 5 = 2 THEN 'x' ELSE sha256(html) END AS h FROM pages WHERE page_id % 5 <> 3)
    SELECT coalesce(m.url, l.url) AS url, CASE WHEN m.url IS NULL THEN 'UNEXPECTED_MEMBER' WHEN l.url IS NULL THEN 'MISSING_MEMBER' ELSE 'MEMBER_CHANGED' END AS problem FROM m FULL JOIN l ON m.url = l.url WHERE m.h IS DISTINCT FROM l.h""",
)
def verified_listing(spark, sf_dir):
    """A listing of pages held against a manifest from which it differs in three ways."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.sha2("html", 256).alias("h"))
    k = F.col("page_id") % 5
    manifest = p.where(k != 1).select("url", "h")
    listing = p.where(k != 3).select("url", F.when(k == 2, "x").otherwise(F.col("h")).alias("h"))
    return matching.verify_listing(listing, manifest, "url", "h")


@query(
    "suffix_links",
    """WITH m AS (SELECT page_id, list_filter(regexp_split_to_array(url, '[^A-Za-z0-9]+'), lambda x: x <> '') AS parts FROM pages), s AS (SELECT page_id, array_to_string(parts[i:], '.') AS suffix FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM m)),
    n AS (SELECT DISTINCT array_to_string(parts[len(parts) - 1 :], '.') AS name FROM m)
    SELECT name, count(*) AS pages, min(page_id) AS first_page FROM n JOIN s ON name = suffix GROUP BY name""",
)
def suffix_links(spark, sf_dir):
    """The last two parts of each address, and the pages whose dotted address ends so."""
    parts = F.filter(F.split("url", "[^A-Za-z0-9]+"), lambda x: x != "")
    m = table(spark, sf_dir, "pages").select("page_id", parts.alias("parts"))
    n = m.select(F.array_join(F.slice("parts", F.greatest(F.size("parts") - 1, F.lit(1)), F.lit(2)), ".").alias("name")).distinct()
    return matching.match_suffixes(n, m, "name", "parts").groupBy("name").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


_SYMBOLS = ["BUILDING", "Customer.n000000001", "MACHINERY", "n000000007", "absent", "Customer.absent"]


@query(
    "symbol_lookup",
    f"""WITH d AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'Customer.n' || substr(c_name, 10) ELSE 'seg.' || c_mktsegment END AS name FROM customer),
    s AS (SELECT unnest([{", ".join(repr(s) for s in _SYMBOLS)}]) AS symbol), j AS (SELECT symbol, id FROM s JOIN d ON name = symbol OR (NOT contains(symbol, '.') AND split_part(name, '.', -1) = symbol))
    SELECT symbol, count(*) AS definitions, min(id) AS first_id FROM j GROUP BY symbol""",
)
def symbol_lookup(spark, sf_dir):
    """Definitions made from customers; dotted symbols match in full, plain ones the last part."""
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Customer.n"), F.substring("c_name", 10, 20))).otherwise(F.concat(F.lit("seg."), "c_mktsegment"))
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), name.alias("name"))
    s = spark.createDataFrame([(x,) for x in _SYMBOLS], "symbol string")
    return matching.match_symbols(d, F.broadcast(s)).groupBy("symbol").agg(F.count("*").alias("definitions"), F.min("id").alias("first_id"))


_ROLES = [("t1", "r1", "direct", "BRUSHED", "Brand#11"), ("t1", "r2", "support", "unknown", "unknown"), ("t2", "r3", "direct", "STEEL", "Brand#22"), ("t2", "r4", "support", "BRUSHED", "Brand#11"), ("t3", "r5", "direct", "unknown", "Brand#33")]


@query(
    "contract_fit",
    f"""WITH roles(task, role_id, mode, kind, brand) AS (VALUES {", ".join(map(str, _ROLES))}),
    o AS (SELECT p_partkey AS capability, CASE WHEN p_size % 9 = 0 THEN 'unknown' ELSE split_part(p_type, ' ', -1) END AS k, p_brand AS b, p_size % 4 AS missing FROM part),
    p AS (SELECT capability, task, role_id, mode, missing, (b <> brand AND brand <> 'unknown')::INT AS c, (brand = 'unknown')::INT AS u FROM o JOIN roles ON k = kind OR k = 'unknown' OR kind = 'unknown'),
    s AS (SELECT *, CASE WHEN c > 0 THEN 'CONTRACT_MISMATCH' WHEN u > 0 THEN 'UNRESOLVED_CONTRACT' WHEN missing > 0 THEN 'MISSING_INPUTS' WHEN mode = 'direct' THEN 'DECLARED_DIRECT_FIT' ELSE 'DECLARED_SUPPORT_FIT' END AS status FROM p)
    SELECT capability, task, status, role_id FROM (SELECT *, row_number() OVER (PARTITION BY capability, task ORDER BY list_position(['DECLARED_DIRECT_FIT', 'DECLARED_SUPPORT_FIT', 'MISSING_INPUTS', 'UNRESOLVED_CONTRACT', 'CONTRACT_MISMATCH'], status), mode <> 'direct', role_id) AS n FROM s) WHERE n = 1""",
)
def contract_fit(spark, sf_dir):
    """Parts as capabilities (kind: the last word of the type; attribute: the brand) in a list of roles."""
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 9 == 0, "unknown").otherwise(F.element_at(F.split("p_type", " "), -1))
    o = p.select(F.col("p_partkey").alias("capability"), kind.alias("kind"), F.col("p_brand").alias("brand"), (F.col("p_size") % 4).alias("missing"))
    roles = spark.createDataFrame(_ROLES, "task string, role_id string, mode string, kind string, brand string")
    return matching.assess_contracts(o, roles, ["brand"], "missing")


_KINDS = ["pain", "manual", "missing", "supported", "refutes", "not_described"]


@query(
    "evidence_states",
    f"""WITH o AS (SELECT o_custkey AS need, [{", ".join(repr(k) for k in _KINDS)}][(o_orderkey % 6 + 1)::INT] AS kind, CASE WHEN o_orderkey % 5 = 0 THEN 'analogy' ELSE 'target' END AS scope, o_orderkey AS source,
      CASE WHEN o_orderkey % 3 = 0 THEN 'listing' ELSE 'firsthand' END AS sk, o_orderdate >= TIMESTAMP '1995-01-01' AS fresh, o_orderkey % 4 AS family, o_custkey % 2 = 0 AS gap FROM orders),
    a AS (SELECT need, bool_or(scope = 'target' AND fresh AND kind = 'supported') AS su, bool_or(scope = 'target' AND fresh AND kind = 'refutes') AS re,
      bool_or(scope = 'target' AND fresh AND kind IN ('pain', 'manual', 'missing') AND sk = 'firsthand') AS pr, count(DISTINCT CASE WHEN scope = 'target' AND fresh AND kind IN ('pain', 'manual', 'missing') AND sk = 'firsthand' THEN family END) AS origin_groups,
      count(DISTINCT CASE WHEN scope = 'target' AND fresh THEN source END) AS fresh_sources, bool_or(NOT fresh) AS st, bool_or(scope = 'target' AND fresh AND kind = 'not_described') AS si, bool_or(gap) AS ga FROM o GROUP BY need)
    SELECT need, CASE WHEN (su OR re) AND pr THEN 'CONFLICT_REQUIRES_REVIEW' WHEN re THEN 'COUNTEREVIDENCE_REVIEW' WHEN su THEN 'EXISTING_OPTION_TO_VERIFY' WHEN origin_groups >= 2 THEN 'CORROBORATED_WORKFLOW_PROBLEM'
      WHEN pr THEN 'SINGLE_SOURCE_PROBLEM' WHEN st AND fresh_sources = 0 THEN 'STALE_EVIDENCE_RECHECK' WHEN si THEN 'INFORMATION_GAP_ONLY' WHEN ga THEN 'INFERRED_HANDOFF_GAP' ELSE 'UNTESTED_GAP_HYPOTHESIS' END AS state, origin_groups, fresh_sources FROM a""",
)
def evidence_states(spark, sf_dir):
    """Each customer as a need, each order as an observation of it."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("need"),
        F.element_at(F.array(*map(F.lit, _KINDS)), (k % 6 + 1).cast("int")).alias("kind"),
        F.when(k % 5 == 0, "analogy").otherwise("target").alias("scope"),
        k.alias("source"),
        F.when(k % 3 == 0, "listing").otherwise("firsthand").alias("source_kind"),
        (F.col("o_orderdate") >= F.to_timestamp(F.lit("1995-01-01"))).alias("fresh"),
        (k % 4).alias("family"),
        (F.col("o_custkey") % 2 == 0).alias("gap"),
    )
    return evidence.evidence_states(o, ["need"])


@query(
    "recorded_cases",
    """WITH a AS (SELECT l_orderkey AS c, l_linenumber AS f, CASE WHEN l_linenumber % 2 = 0 THEN 'equal' ELSE 'finite_range' END AS op FROM lineitem),
    b AS (SELECT l_orderkey AS c, l_linenumber AS f, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE (l_quantity::INT)::VARCHAR END AS v, CASE WHEN l_orderkey % 7 = 0 THEN 'SKIPPED' ELSE 'OBSERVED' END AS outcome FROM lineitem WHERE l_orderkey % 10 <> 3 AND NOT (l_orderkey % 4 = 0 AND l_linenumber = 1)),
    o AS (SELECT c, min(outcome) AS outcome FROM b GROUP BY c),
    j AS (SELECT a.c, o.outcome, b.v IS NOT NULL AS seen, CASE WHEN op = 'equal' THEN v IN ('N', 'A') AND v = 'N' ELSE v::DOUBLE BETWEEN 2 AND 49 END AS ok FROM a LEFT JOIN b ON a.c = b.c AND a.f = b.f LEFT JOIN o ON a.c = o.c)
    SELECT c AS case_id, CASE WHEN max(outcome) IS NULL THEN 'MISSING' WHEN max(outcome) <> 'OBSERVED' THEN max(outcome) WHEN bool_or(seen AND NOT ok) THEN 'FAIL' WHEN bool_or(NOT seen) THEN 'INCOMPLETE_OBSERVATIONS' ELSE 'PASS' END AS status FROM j GROUP BY c""",
)
def recorded_cases(spark, sf_dir):
    """Orders as cases, lines as assertions; some records are missing, some cases skipped."""
    li = table(spark, sf_dir, "lineitem")
    even = F.col("l_linenumber") % 2 == 0
    a = li.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("field"), F.when(even, "equal").otherwise("finite_range").alias("op"), F.lit("N").alias("expected"), F.lit(2.0).alias("minimum"), F.lit(49.0).alias("maximum"))
    k = F.col("l_orderkey")
    o = li.where((k % 10 != 3) & ~((k % 4 == 0) & (F.col("l_linenumber") == 1)))
    o = o.select(k.alias("case_id"), F.when(k % 7 == 0, "SKIPPED").otherwise("OBSERVED").alias("outcome"), F.col("l_linenumber").alias("field"), F.when(even, F.col("l_returnflag")).otherwise(F.col("l_quantity").cast("int").cast("string")).alias("value"))
    return evidence.check_cases(a, o)


_REQUIREMENTS = [("BUILDING", True), ("FURNITURE", True), ("MACHINERY", False)]


@query(
    "requirement_matrix",
    f"""WITH req(requirement, required) AS (VALUES {", ".join(f"('{r}', {str(q).lower()})" for r, q in _REQUIREMENTS)}),
    s AS (SELECT c_nationkey AS candidate, c_mktsegment AS requirement, CASE WHEN max(c_acctbal) < 9000 THEN 'CONTRADICTED' ELSE 'OBSERVED' END AS state FROM customer GROUP BY ALL),
    m AS (SELECT n_nationkey AS candidate, required, coalesce(state, 'UNKNOWN') AS state FROM nation CROSS JOIN req LEFT JOIN s ON s.candidate = n_nationkey AND s.requirement = req.requirement WHERE required)
    SELECT candidate, CASE WHEN bool_or(state = 'CONTRADICTED') THEN 'CONTRADICTED' WHEN bool_or(state = 'UNKNOWN') THEN 'NEEDS_EVIDENCE' ELSE 'READY_FOR_INTEGRATION_REVIEW' END AS verdict, sum((state IN ('CONTRADICTED', 'UNKNOWN'))::INT)::BIGINT AS open FROM m GROUP BY candidate""",
)
def requirement_matrix(spark, sf_dir):
    """Nations as candidates, market segments as requirements."""
    req = spark.createDataFrame(_REQUIREMENTS, "requirement string, required boolean")
    cand = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("candidate"))
    s = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("candidate"), F.col("c_mktsegment").alias("requirement")).agg(F.when(F.max("c_acctbal") < 9000, "CONTRADICTED").otherwise("OBSERVED").alias("state"))
    return evidence.requirement_verdicts(req, cand, s)


#: Orders as workflows, their lines as steps: a line requires two fields by its part and supplier, and supplies one.
_FIELDS = ("'f' || (l_partkey % 7)", "'f' || (l_suppkey % 5)", "'f' || ((l_partkey + l_suppkey) % 7)")
_INITIAL = ["f0", "f1"]
STEPS_SQL = f"""s AS (SELECT l_orderkey AS workflow, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n,
  list_distinct([{_FIELDS[0]}, {_FIELDS[1]}]) AS requires, [{_FIELDS[2]}] AS produces FROM lineitem)"""
TRACE_SQL = f"""{STEPS_SQL}, r(workflow, k, missing, have) AS (
  SELECT workflow, k, list_sort(list_filter(requires, lambda f: NOT list_contains({_INITIAL}, f))), CASE WHEN len(list_filter(requires, lambda f: NOT list_contains({_INITIAL}, f))) = 0 THEN list_distinct({_INITIAL} || produces) ELSE {_INITIAL} END FROM s WHERE k = 1
  UNION ALL SELECT s.workflow, s.k, list_sort(list_filter(requires, lambda f: NOT list_contains(have, f))), CASE WHEN len(list_filter(requires, lambda f: NOT list_contains(have, f))) = 0 THEN list_distinct(have || produces) ELSE have END FROM r JOIN s ON s.workflow = r.workflow AND s.k = r.k + 1)"""


def workflows(spark, sf_dir):
    field = lambda c, n: F.concat(F.lit("f"), (c % n).cast("string"))
    p, q = F.col("l_partkey"), F.col("l_suppkey")
    step = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.array_distinct(F.array(field(p, 7), field(q, 5))).alias("requires"), F.array(field(p + q, 7)).alias("produces"))
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("workflow")).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    steps = F.transform("steps", lambda s, i: F.struct((i + 1).cast("string").alias("id"), s["requires"].alias("requires"), s["produces"].alias("produces")))
    return g.select("workflow", F.array(*map(F.lit, _INITIAL)).alias("initial"), steps.alias("steps"))


@query("workflow_traces", f"WITH RECURSIVE {TRACE_SQL} SELECT workflow, k::VARCHAR AS step, missing, CASE WHEN len(missing) > 0 THEN 'BLOCKED_BY_DECLARED_INPUTS' ELSE 'INPUTS_DECLARED_NOT_EXECUTED' END AS status FROM r")
def workflow_traces(spark, sf_dir):
    return evidence.workflow_trace(workflows(spark, sf_dir)).select("workflow", "step", "missing", "status")


@query(
    "producing_steps",
    f"""WITH RECURSIVE {STEPS_SQL}, b(workflow, k, chosen, wanted) AS (SELECT workflow, k, TRUE, list_filter(requires, lambda f: NOT list_contains({_INITIAL}, f)) FROM s WHERE k = n
      UNION ALL SELECT s.workflow, s.k, list_has_any(wanted, produces), CASE WHEN list_has_any(wanted, produces) THEN list_distinct(wanted || list_filter(requires, lambda f: NOT list_contains({_INITIAL}, f))) ELSE wanted END FROM b JOIN s ON s.workflow = b.workflow AND s.k = b.k - 1)
    SELECT b.workflow, n::VARCHAR AS target, b.k::VARCHAR AS step FROM b JOIN (SELECT DISTINCT workflow, n FROM s) USING (workflow) WHERE chosen""",
)
def producing_steps(spark, sf_dir):
    """The steps that each order's last line goes back to."""
    from lodestone.operators import admission

    w = workflows(spark, sf_dir)
    return admission.producing_steps(w.withColumn("target", F.element_at("steps", -1)["id"]))


@query(
    "measured_values",
    """SELECT ps, CASE WHEN n < 20 THEN 'REQUIRED_CHECKS_OR_CASES_MISSING' WHEN r > 12 THEN 'REQUIRED_REGRESSION_OR_MISSING_EVIDENCE' WHEN round(c - b, 6) < 0.5 THEN 'NO_MEASURED_ADVANTAGE' ELSE 'MEASURED_ADVANTAGE_REVIEW_REQUIRED' END AS verdict, round(c - b, 6) AS change
    FROM (SELECT l_partkey AS ps, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r, avg(l_quantity) FILTER (l_linestatus = 'F') AS b, avg(l_quantity) FILTER (l_linestatus = 'O') AS c FROM lineitem GROUP BY 1) WHERE b IS NOT NULL AND c IS NOT NULL""",
)
def measured_values(spark, sf_dir):
    """Parts: mean quantity of open lines (candidate) against closed ones (baseline)."""
    mean = lambda s: F.avg(F.when(F.col("l_linestatus") == s, F.col("l_quantity")))
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("ps")).agg((F.count("*") >= 20).alias("checks_passed"), F.greatest(F.sum((F.col("l_returnflag") == "R").cast("long")) - 12, F.lit(0)).alias("regressions"), mean("F").alias("baseline"), mean("O").alias("candidate")).where("baseline IS NOT NULL AND candidate IS NOT NULL")
    v = evidence.measured_value(g, F.lit("higher"), F.lit(0.5))
    return v.select("ps", "verdict", "change")


@query("inferred_patterns", "SELECT p_partkey, CASE WHEN list_has_any(w, ['identity', 'id', 'provenance']) THEN 'identity_loss' WHEN list_has_any(w, ['verification', 'evidence', 'integrity', 'accuracy', 'verdict']) THEN 'verification_gap' WHEN list_has_any(w, ['unit', 'units', 'format', 'schema']) THEN 'format_gap' WHEN list_has_any(w, ['restore', 'recovery', 'startup']) THEN 'recovery_gap' ELSE 'information_gap' END AS pattern FROM (SELECT p_partkey, regexp_extract_all(lower(['unit ', 'record id ', 'recovery ', 'verdict ', ''][(p_partkey % 5 + 1)::INT] || p_name), '[a-z]+') AS w FROM part)")
def inferred_patterns(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    head = F.element_at(F.array(*map(F.lit, ["unit ", "record id ", "recovery ", "verdict ", ""])), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select("p_partkey", T.infer_pattern(F.concat(head, "p_name")).alias("pattern"))
