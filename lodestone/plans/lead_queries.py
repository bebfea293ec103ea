"""Queries that link: calls to definitions, documents to code, findings to cards, needs to options, runs to runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import linking, opportunity
from lodestone.plans.evidence_queries import TRACE_SQL, workflows
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
    "bound_cards",
    """WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS card_id, l_orderkey AS s, l_returnflag AS n, l_linenumber AS a, l_linenumber + l_quantity::INT % 3 AS e FROM lineitem),
    f AS (SELECT l_orderkey * 10 + l_linenumber AS finding_id, l_orderkey AS s, l_returnflag AS n, l_linenumber + (l_linenumber % 2) AS a, l_linenumber + l_quantity::INT % 3 AS e FROM lineitem),
    j AS (SELECT finding_id, card_id, (c.a < f.a)::INT AS how FROM f JOIN c ON f.s = c.s AND f.n = c.n AND f.e = c.e AND c.a <= f.a),
    g AS (SELECT finding_id, how, count(*) AS k, min(card_id) AS card_id FROM j GROUP BY ALL), b AS (SELECT finding_id, arg_min(k, how) AS k, arg_min(card_id, how) AS card_id FROM g GROUP BY 1)
    SELECT f.finding_id, CASE WHEN k IS NULL THEN 'CARD_NOT_FOUND' WHEN k > 1 THEN 'CARD_NOT_UNIQUE' ELSE 'BOUND' END AS code, CASE WHEN k = 1 THEN card_id END AS card_id FROM f LEFT JOIN b ON f.finding_id = b.finding_id""",
)
def bound_cards(spark, sf_dir):
    """Lines as cards; findings begin at the card's line, or one later as behind a decorator."""
    li = table(spark, sf_dir, "lineitem")
    k = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("card_id")
    end = (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 3).alias("end_line")
    c = li.select(k, F.col("l_orderkey").alias("source_id"), F.col("l_returnflag").alias("name"), F.col("l_linenumber").alias("start_line"), end)
    f = c.select(F.col("card_id").alias("finding_id"), "source_id", "name", (F.col("start_line") + F.col("start_line") % 2).alias("start_line"), "end_line")
    return linking.bind_cards(f, c)


@query(
    "mission_candidates",
    """WITH g AS (SELECT l_partkey AS card_id, sum((l_returnflag = 'R')::INT + (l_returnflag <> 'R' AND l_discount > 0.08)::INT)::BIGINT AS evidence FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'R') AND bool_or(l_discount > 0.08) AND NOT bool_or(l_quantity < 2)),
    o AS (SELECT card_id, evidence, row_number() OVER (ORDER BY evidence DESC, p_brand, p_name, card_id) AS rank, count(*) OVER () AS eligible FROM g JOIN part ON p_partkey = card_id)
    SELECT * FROM o WHERE rank <= 25""",
)
def mission_candidates(spark, sf_dir):
    """Parts as cards, lines as findings: a returned line and a large discount, and no tiny line. The first 25."""
    f = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "card_id")
    cards = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("card_id"), F.col("p_brand").alias("path"), F.col("p_name").alias("name"))
    return linking.mission_candidates(f, {"returned": F.col("l_returnflag") == "R", "discount": F.col("l_discount") > 0.08}, F.col("l_quantity") < 2, cards, 25)


MECHANISMS = [
    ("m1", ["identity_loss", "format_gap"], ["a", "b"], ["id"]),
    ("m2", ["identity_loss"], ["a"], ["other"]),
    ("m3", ["format_gap", "recovery_gap"], [], ["unit"]),
    ("m4", ["information_gap"], ["z"], []),
]
_NEEDS_SQL = f"""n AS (SELECT p_partkey AS need, ['identity_loss', 'format_gap', 'recovery_gap', 'information_gap'][(p_partkey % 4 + 1)::INT] AS pattern, CASE WHEN p_size % 2 = 0 THEN 'id' ELSE 'unit' END AS field, CASE WHEN p_size % 3 = 0 THEN ['a', 'b'] ELSE ['a'] END AS have FROM part),
m(id, addresses, req, prov) AS (VALUES {", ".join(f"('{i}', {a}, {r}::VARCHAR[], {p}::VARCHAR[])" for i, a, r, p in MECHANISMS)}),
j AS (SELECT need, id, list_sort(list_filter(req, lambda x: NOT list_contains(have, x))) AS missing, list_contains(prov, field) AS fits FROM n JOIN m ON list_contains(addresses, pattern)),
o AS (SELECT *, row_number() OVER (PARTITION BY need ORDER BY len(missing), fits DESC, id) AS rank FROM j)"""


def needs(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    pattern = F.element_at(F.array(*map(F.lit, ["identity_loss", "format_gap", "recovery_gap", "information_gap"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    have = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    return p.select(F.col("p_partkey").alias("need"), pattern.alias("pattern"), F.when(F.col("p_size") % 2 == 0, "id").otherwise("unit").alias("field"), have.alias("available"), "p_size")


def options(spark, sf_dir):
    m = spark.createDataFrame(MECHANISMS, "id string, addresses array<string>, requires array<string>, provides array<string>")
    return opportunity.mechanism_options(needs(spark, sf_dir), m)


@query("mechanism_options", f"WITH {_NEEDS_SQL} SELECT need, id, rank, missing, CASE WHEN len(missing) > 0 THEN 'PREREQUISITES_UNCONFIRMED' ELSE 'INPUTS_DECLARED_REVIEW_REQUIRED' END AS status, CASE WHEN fits THEN 'DECLARED_OUTPUT_MATCH' ELSE 'SUPPORTING_COMPONENT_ONLY' END AS output_fit FROM o WHERE rank <= 6")
def mechanism_options(spark, sf_dir):
    """Parts as needs; the first mechanisms of each."""
    return options(spark, sf_dir)


_STATES = ["SINGLE_SOURCE_PROBLEM", "CORROBORATED_WORKFLOW_PROBLEM", "EXISTING_OPTION_TO_VERIFY", "CONFLICT_REQUIRES_REVIEW", "STALE_EVIDENCE_RECHECK", "INFORMATION_GAP_ONLY"]
_STATE_SQL = f"s AS (SELECT p_partkey AS need, [{', '.join(repr(s) for s in _STATES)}][(p_size % 6 + 1)::INT] AS state, p_size % 5 AS origin_groups FROM part)"


def states(spark, sf_dir):
    state = F.element_at(F.array(*map(F.lit, _STATES)), (F.col("p_size") % 6 + 1).cast("int"))
    return needs(spark, sf_dir).select("need", "pattern", state.alias("state"), (F.col("p_size") % 5).alias("origin_groups"))


@query("investigation_order", f"WITH {_NEEDS_SQL}, {_STATE_SQL}, r AS (SELECT need, count(*) FILTER (len(missing) = 0) AS ready FROM o WHERE rank <= 6 GROUP BY 1) SELECT s.need, (state IN ('CORROBORATED_WORKFLOW_PROBLEM', 'SINGLE_SOURCE_PROBLEM'))::INT AS problem, least(origin_groups, 3) AS groups, CASE WHEN pattern = 'format_gap' THEN 5 ELSE 2 END AS preference, coalesce(ready, 0) AS ready FROM s JOIN n ON s.need = n.need LEFT JOIN r ON r.need = s.need")
def investigation_order(spark, sf_dir):
    return opportunity.priorities(states(spark, sf_dir), options(spark, sf_dir), {"format_gap": 5})


@query(
    "next_tasks",
    f"""WITH {_NEEDS_SQL}, {_STATE_SQL}, l AS (SELECT DISTINCT need FROM o WHERE rank <= 6 AND len(missing) > 0), x AS (SELECT s.need, state, l.need IS NOT NULL AS lacks, state NOT IN ('EXISTING_OPTION_TO_VERIFY', 'CONFLICT_REQUIRES_REVIEW', 'COUNTEREVIDENCE_REVIEW', 'STALE_EVIDENCE_RECHECK') AS op FROM s LEFT JOIN l ON s.need = l.need),
    t AS (SELECT need, list_filter([CASE state WHEN 'EXISTING_OPTION_TO_VERIFY' THEN 'existing_solution_fit' WHEN 'CONFLICT_REQUIRES_REVIEW' THEN 'resolve_conflict' WHEN 'STALE_EVIDENCE_RECHECK' THEN 'refresh_evidence' ELSE 'observe_workflow' END,
      CASE WHEN state = 'SINGLE_SOURCE_PROBLEM' THEN 'independent_observation' END, CASE WHEN op AND lacks THEN 'prerequisite' END, CASE WHEN op THEN 'existing_solution_fit' END, 'bounded_comparison'], lambda v: v IS NOT NULL) AS k FROM x)
    SELECT need, i AS place, k[i + 1] AS kind FROM (SELECT need, k, unnest(range(0, len(k))) AS i FROM t)""",
)
def next_tasks(spark, sf_dir):
    return opportunity.next_tasks(states(spark, sf_dir), options(spark, sf_dir))


@query(
    "inferred_needs",
    f"""WITH RECURSIVE {TRACE_SQL}, d AS (SELECT o_orderkey AS workflow, '1' AS step, 'f3' AS field FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey IN (SELECT workflow FROM s)),
    l AS (SELECT workflow, k::VARCHAR AS step, unnest(missing) AS field FROM r)
    SELECT workflow, step, field, 'information_gap' AS pattern, 'reported' AS basis FROM d UNION ALL SELECT workflow, step, field, 'information_gap', 'inferred' FROM l WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.workflow = l.workflow AND d.step = l.step AND d.field = l.field)""",
)
def inferred_needs(spark, sf_dir):
    """Fields that order lines lack, but for those that every third order declares."""
    w = workflows(spark, sf_dir)
    declared = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("workflow"), F.lit("1").alias("step"), F.lit("f3").alias("field"), F.lit("information_gap").alias("pattern"))
    return opportunity.inferred_needs(w, declared.join(w.select("workflow"), "workflow", "left_semi"))


_CITED = """d AS (SELECT doc_id AS source, 'u' || doc_id AS uri, text, doc_id % 6 AS k FROM documents WHERE text IS NOT NULL),
nw AS (SELECT source, CASE WHEN k = 1 THEN 'elsewhere' ELSE uri END AS uri, CASE WHEN k = 2 THEN 'Note. ' || text WHEN k = 3 THEN 'rewritten' ELSE text END AS text, k FROM d WHERE k <> 0),
ls AS (SELECT source, k, string_split(text, chr(10)) AS l FROM d), li AS (SELECT source, k, l, unnest(range(0, len(l))) AS i FROM ls),
c AS (SELECT source, k, source % 3 AS owner, l[i + 1] AS quote, coalesce(list_sum(list_transform(l[1:i], lambda x: length(x) + 1)), 0)::BIGINT AS "start" FROM li WHERE l[i + 1] <> ''),
o AS (SELECT DISTINCT owner, source, "start", "start" + length(quote) AS "end", quote FROM c), n AS (SELECT DISTINCT owner, source, "start" + 6 * (k = 2)::INT AS "start", "start" + 6 * (k = 2)::INT + length(quote) AS "end", quote FROM c WHERE k IN (1, 2, 5)),
kept AS (SELECT * FROM o INTERSECT SELECT * FROM n), gone AS (SELECT *, row_number() OVER (PARTITION BY owner, source, quote ORDER BY "start", "end") AS nth FROM (SELECT * FROM o EXCEPT SELECT * FROM kept)),
fresh AS (SELECT *, row_number() OVER (PARTITION BY owner, source, quote ORDER BY "start", "end") AS nth FROM (SELECT * FROM n EXCEPT SELECT * FROM kept)),
x AS (SELECT gone.*, fresh."start" AS ns, CASE WHEN nw.uri IS NULL THEN 'SOURCE_REMOVED' WHEN d.uri <> nw.uri THEN 'SOURCE_REPLACED' WHEN NOT contains(nw.text, gone.quote) THEN 'PASSAGE_MISSING' WHEN fresh."start" IS NULL THEN 'NO_LONGER_CITED'
  WHEN contains(substr(d.text, strpos(d.text, gone.quote) + 1), gone.quote) OR contains(substr(nw.text, strpos(nw.text, gone.quote) + 1), gone.quote) THEN 'OCCURRENCE_UNCERTAIN' ELSE 'MOVED' END AS status
  FROM gone LEFT JOIN fresh ON fresh.owner = gone.owner AND fresh.source = gone.source AND fresh.quote = gone.quote AND fresh.nth = gone.nth LEFT JOIN d ON d.source = gone.source LEFT JOIN nw ON nw.source = gone.source),
al AS (SELECT 'RETAINED' AS status FROM kept UNION ALL SELECT status FROM x UNION ALL SELECT 'NEW_CITATION' FROM fresh WHERE NOT EXISTS (SELECT 1 FROM x WHERE status = 'MOVED' AND x.owner = fresh.owner AND x.source = fresh.source AND x.quote = fresh.quote AND x.ns = fresh."start"))"""


@query("compared_citations", f"WITH {_CITED} SELECT status, count(*) AS citations FROM al GROUP BY 1")
def compared_citations(spark, sf_dir):
    """Citations of every line of every document, against the texts after some were shifted, rewritten, moved away or are cited no more."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("source"), F.concat(F.lit("u"), "doc_id").alias("uri"), "text")
    k = F.col("source") % 6
    new = d.where(k != 0).select("source", F.when(k == 1, "elsewhere").otherwise(F.col("uri")).alias("uri"), F.when(k == 2, F.concat(F.lit("Note. "), "text")).when(k == 3, F.lit("rewritten")).otherwise(F.col("text")).alias("text"))
    lines = d.select("source", F.split("text", "\n", -1).alias("l")).select("source", "l", F.posexplode("l").alias("i", "quote"))
    at = F.aggregate(F.slice("l", 1, F.col("i")), F.lit(0).cast("long"), lambda acc, x: acc + F.length(x) + 1)
    c = lines.where("quote <> ''").select((F.col("source") % 3).alias("owner"), "source", at.alias("start"), "quote")
    cite = lambda df, shift: df.select("owner", "source", (F.col("start") + shift).alias("start"), (F.col("start") + shift + F.length("quote")).alias("end"), "quote")
    now = cite(c.where(k.isin(1, 2, 5)), F.when(k == 2, 6).otherwise(0))
    return opportunity.compare_citations(cite(c, F.lit(0)), now, d, new).groupBy("status").agg(F.count("*").alias("citations"))
