"""Queries over what is let in: manifests, files, search strings, approved spans, cues, attempts, lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import admission
from lodestone.plans.text_queries import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


_FILES_SQL = """f AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'local' WHEN 1 THEN 'synthetic' WHEN 2 THEN 'gdrive' ELSE 'other' END AS provider, 'f' || (page_id // 2 * CASE WHEN page_id % 10 = 1 THEN 1 ELSE 2 END + CASE WHEN page_id % 10 = 1 THEN 0 ELSE page_id % 2 END) AS file_id,
  CASE WHEN page_id % 7 = 3 THEN '../p' WHEN page_id % 7 = 4 THEN '/p' ELSE 'src/p' END || page_id AS path, length(html)::BIGINT AS size, CASE WHEN page_id % 6 = 5 THEN 'short' ELSE sha256(html) END AS sha256 FROM pages)"""


@query(
    "manifest_codes",
    f"""WITH {_FILES_SQL}, u AS (SELECT *, CASE provider WHEN 'synthetic' THEN 'fixture://' || file_id WHEN 'local' THEN 'local://' || path ELSE 'https://drive.google.com/file/d/' || file_id || '/view' END AS url FROM f)
    SELECT page_id, CASE WHEN path LIKE '../%' OR path LIKE '/%' THEN 'REPOSITORY_PATH' WHEN length(sha256) < 64 THEN 'CORPUS_SOURCE_SHA' WHEN provider = 'other' THEN 'CORPUS_PROVIDER' WHEN page_id % 5 = 2 THEN 'CORPUS_SOURCE_URL'
      WHEN count(*) OVER (PARTITION BY file_id) > 1 THEN 'DUPLICATE_CORPUS_SOURCE' ELSE 'OK' END AS code FROM u""",
)
def manifest_codes(spark, sf_dir):
    """Pages as a manifest with several kinds of faults."""
    k = F.col("page_id")
    odd = k % 10 == 1
    number = F.expr("page_id div 2") * F.when(odd, 1).otherwise(2) + F.when(odd, 0).otherwise(k % 2)
    p = table(spark, sf_dir, "pages").select(
        "page_id",
        F.when(k % 4 == 0, "local").when(k % 4 == 1, "synthetic").when(k % 4 == 2, "gdrive").otherwise("other").alias("provider"),
        F.concat(F.lit("f"), number).alias("file_id"),
        F.concat(F.when(k % 7 == 3, "../p").when(k % 7 == 4, "/p").otherwise("src/p"), "page_id").alias("path"),
        F.length("html").cast("long").alias("size"),
        F.when(k % 6 == 5, "short").otherwise(F.sha2("html", 256)).alias("sha256"),
    )
    url = F.when(F.col("provider") == "synthetic", F.concat(F.lit("fixture://"), "file_id")).when(F.col("provider") == "local", F.concat(F.lit("local://"), "path")).otherwise(F.concat(F.lit("https://drive.google.com/file/d/"), "file_id", F.lit("/view")))
    p = p.withColumn("source_url", F.concat(url, F.when(k % 5 == 2, "?").otherwise("")))
    return admission.manifest_codes(p).select("page_id", "code")


@query(
    "eligible_files",
    """SELECT p_partkey FROM (SELECT p_partkey, p_size * 5000 AS size, ['src/a', 'tests/a', 'src/test_a', 'src/.a', 'vendor/a', '/a'][(p_partkey % 6 + 1)::INT] || p_partkey || CASE WHEN p_partkey % 5 = 0 THEN '.js' ELSE '.py' END AS path, CASE WHEN p_partkey % 7 = 0 THEN '120000' ELSE '100644' END AS mode FROM part)
    WHERE path LIKE 'src/a%.py' AND mode = '100644' AND size BETWEEN 1 AND 200000""",
)
def eligible_files(spark, sf_dir):
    k = F.col("p_partkey")
    head = F.element_at(F.array(*map(F.lit, ["src/a", "tests/a", "src/test_a", "src/.a", "vendor/a", "/a"])), (k % 6 + 1).cast("int"))
    p = table(spark, sf_dir, "part").select(k, (F.col("p_size") * 5000).alias("size"), F.concat(head, k, F.when(k % 5 == 0, ".js").otherwise(".py")).alias("path"), F.when(k % 7 == 0, "120000").otherwise("100644").alias("mode"))
    return p.where(admission.eligible_file(F.col("path"), F.col("size"), F.col("mode"), 200_000)).select("p_partkey")


@query(
    "public_queries",
    """SELECT p_partkey, CASE WHEN length(q) > 220 OR trim(q) = '' THEN 'TEXT_BOUNDS' WHEN contains(lower(q), 'https:') OR contains(lower(q), 'password') THEN 'PUBLIC_QUERY_REQUIRED' WHEN NOT regexp_full_match(q, '[A-Za-z0-9_ :,".\\-]+') THEN 'QUERY_CHARACTERS' ELSE 'OK' END AS code
    FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN 'PassWord ' || p_name WHEN 2 THEN 'https://x' WHEN 3 THEN p_name || ' ?' ELSE '  ' END AS q FROM part)""",
)
def public_queries(spark, sf_dir):
    k = F.col("p_partkey") % 5
    q = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.lit("PassWord "), "p_name")).when(k == 2, "https://x").when(k == 3, F.concat("p_name", F.lit(" ?"))).otherwise("  ")
    return table(spark, sf_dir, "part").select("p_partkey", admission.public_query(q).alias("code"))


@query(
    "outside_approved",
    """WITH f AS (SELECT l_orderkey AS path, l_linenumber * 10 AS s, l_linenumber * 10 + l_quantity::INT % 15 AS e FROM lineitem), a AS (SELECT l_orderkey AS path, l_linenumber * 10 - 2 AS s, l_linenumber * 10 + 8 AS e FROM lineitem WHERE l_returnflag = 'N')
    SELECT path, s AS start, e AS "end" FROM f WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.path = f.path AND a.s <= f.s AND f.e <= a.e)""",
)
def outside_approved(spark, sf_dir):
    """Lines as findings with spans, lines that were not returned as approvals."""
    li = table(spark, sf_dir, "lineitem")
    s = F.col("l_linenumber") * 10
    f = li.select(F.col("l_orderkey").alias("path"), s.alias("start"), (s + F.col("l_quantity").cast("int") % 15).alias("end"))
    a = li.where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("path"), (s - 2).alias("start"), (s + 8).alias("end"))
    return admission.outside_approved(f, a)


_CUE_SQL = " UNION ALL ".join(f"SELECT item_id, '{k}' AS cue, regexp_extract_all(t, '(?i){p}') AS f FROM d" for k, p in admission.CUES.items())


@query("draft_cues", f"WITH d AS (SELECT item_id, ['It must be done manually. ', 'You need to copy and paste it; it cannot be saved. ', 'Missing. ', ''][(item_id % 4 + 1)::INT] || text AS t FROM benchmark) SELECT item_id, cue, least(len(f), 12)::BIGINT AS n, lower(f[1]) AS first FROM ({_CUE_SQL}) WHERE len(f) > 0")
def draft_cues(spark, sf_dir):
    """Items behind a sentence with cues."""
    heads = F.array(*map(F.lit, ["It must be done manually. ", "You need to copy and paste it; it cannot be saved. ", "Missing. ", ""]))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.element_at(heads, (F.col("item_id") % 4 + 1).cast("int")), "text").alias("t"))
    return admission.cues(b, "item_id", "t")


@query(
    "attempt_states",
    """WITH a AS (SELECT o_custkey AS source, o_orderkey AS n, CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'DONE' ELSE 'TIMEOUT' END WHEN 'O' THEN 'MEMORY' ELSE 'SYNTAX' END AS outcome FROM orders)
    SELECT source, attempts, CASE WHEN done THEN 'DONE' WHEN attempts < 12 AND last IN ('TIMEOUT', 'MEMORY') THEN 'RETRY' ELSE 'GAP' END AS state FROM (SELECT source, count(*) AS attempts, bool_or(outcome = 'DONE') AS done, arg_max(outcome, n) AS last FROM a GROUP BY 1)""",
)
def attempt_states(spark, sf_dir):
    """Customers as sources, their orders as attempts, of which they have twelve."""
    k = F.col("o_orderkey")
    outcome = F.when(F.col("o_orderstatus") == "F", F.when(k % 3 == 0, "DONE").otherwise("TIMEOUT")).when(F.col("o_orderstatus") == "O", "MEMORY").otherwise("SYNTAX")
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), k.alias("n"), outcome.alias("outcome"))
    return admission.attempt_states(a, ["TIMEOUT", "MEMORY"], 12)


@query(
    "lineage_cycles",
    """WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation), w(a, b, k) AS (SELECT a, b, 1 FROM e UNION SELECT w.a, e.b, k + 1 FROM w JOIN e ON w.b = e.a WHERE k < 25) SELECT DISTINCT a AS id FROM w WHERE a = b""",
)
def lineage_cycles(spark, sf_dir):
    """Nations that come back to themselves along a fixed map (25 steps are the longest way there is)."""
    e = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 3 + 1) % 25).alias("b"))
    return admission.on_cycles(e)
