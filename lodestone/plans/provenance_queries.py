"""Provenance on the tables: documents as members of envelopes and located sources, modules as pinned sources, order lines as artifacts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.functions import canon, views
from lodestone.operators import provenance
from lodestone.operators.ranking import checkpoint_dir
from lodestone.plans import modules as M
from lodestone.plans.text_queries import table
from lodestone.sources import code as C
from lodestone.sources import publish

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))


def _entries(spark, sf_dir):
    """(members, entries): every document is a member of its source's envelope; some entries were changed, lost, doubled or added."""
    d = documents(spark, sf_dir)
    k = F.col("doc_id")
    path = F.concat(F.lit("d"), "doc_id", F.lit(".py"))
    base = d.select("doc_id", F.coalesce("source", F.lit("none")).alias("envelope"), path.alias("path"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"), canon.git_blob_sha1("text").alias("git_sha1"))
    members = base.where(k % 23 != 0).drop("doc_id")
    e = base.where(k % 11 != 0).withColumn("packed", F.when(k % 17 == 0, F.lit(0)).otherwise(F.col("size")))
    e = e.withColumn("regular", k % 29 != 0).withColumn("sha256", F.when(k % 13 == 0, F.lit("0")).otherwise(F.col("sha256")))
    e = e.select("envelope", "path", "size", "packed", "regular", "sha256", "git_sha1", "doc_id")
    return members, e.union(e.where(k % 19 == 0)).drop("doc_id")


_ENVELOPES = """e AS (SELECT doc_id, coalesce(source, 'none') AS envelope, 'd' || doc_id || '.py' AS path, CASE WHEN doc_id % 11 = 0 THEN 'MEMBER_MISSING' WHEN doc_id % 23 = 0 THEN 'MEMBER_NOT_LISTED' WHEN doc_id % 19 = 0 THEN 'MEMBER_AMBIGUOUS' WHEN doc_id % 29 = 0 THEN 'MEMBER_MODE'
  WHEN strlen(coalesce(text, '')) > 200 * greatest(CASE WHEN doc_id % 17 = 0 THEN 0 ELSE strlen(coalesce(text, '')) END, 1) THEN 'MEMBER_SIZE_OR_RATIO' WHEN doc_id % 13 = 0 THEN 'MEMBER_CHANGED' ELSE 'OK' END AS code FROM documents WHERE NOT (doc_id % 11 = 0 AND doc_id % 23 = 0))"""


@query("envelope_members", f"WITH {_ENVELOPES} SELECT envelope, path, code FROM e")
def envelope_members(spark, sf_dir):
    return provenance.check_envelope(*_entries(spark, sf_dir))


@query("envelope_status", f"WITH {_ENVELOPES} SELECT envelope, count(*) FILTER (code = 'OK') AS members_verified, CASE WHEN bool_and(code = 'OK') THEN 'PINNED_SELECTED_BYTES_VERIFIED' ELSE 'REFUSED' END AS status FROM e GROUP BY 1")
def envelope_status(spark, sf_dir):
    return provenance.envelope_status(provenance.check_envelope(*_entries(spark, sf_dir)))


@query(
    "located_sources",
    """SELECT doc_id AS source_id, CASE WHEN doc_id % 11 = 0 THEN 'LOCATOR_MISSING' WHEN doc_id % 13 = 0 THEN 'SOURCE_NOT_READ' WHEN doc_id % 2 = 1 AND doc_id % 17 = 0 THEN 'ARCHIVE_VERSION_MISMATCH' WHEN doc_id % 7 = 0 THEN 'SOURCE_VERSION_MISMATCH' ELSE 'OK' END AS code,
    CASE WHEN doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND NOT (doc_id % 2 = 1 AND doc_id % 17 = 0) AND doc_id % 7 <> 0 THEN sha256(coalesce(text, '')) END AS content_sha256 FROM documents""",
)
def located_sources(spark, sf_dir):
    """Documents read by locator, half of them as members of an archive; bytes come only where all digests agree."""
    d = documents(spark, sf_dir)
    k = F.col("doc_id")
    member = F.when(k % 2 == 1, "m.py").otherwise("")
    sources = d.select(k.alias("source_id"), F.when(k % 7 == 0, "changed").otherwise(F.sha2("text", 256)).alias("sha256"), F.concat(F.lit("a"), k % 5).alias("archive_sha256"))
    locators = d.where(k % 11 != 0).select(k.alias("source_id"), F.concat(F.lit("f"), k).alias("path"), member.alias("member"))
    files = d.where(k % 13 != 0).select(F.concat(F.lit("f"), k).alias("path"), member.alias("member"), F.sha2("text", 256).alias("sha256"), F.when(k % 17 == 0, "other").otherwise(F.concat(F.lit("a"), k % 5)).alias("archive_sha256"), F.col("text").alias("content"))
    return provenance.read_located(locators, sources, files).select("source_id", "code", F.sha2("content", 256).alias("content_sha256"))


@query("changed_snapshot", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'APPEARED' WHEN doc_id % 7 = 1 THEN 'DISAPPEARED' ELSE 'CHANGED' END AS change FROM documents WHERE doc_id % 7 <= 2")
def changed_snapshot(spark, sf_dir):
    """What a second pass over all texts finds changed."""
    d = documents(spark, sf_dir)
    k = F.col("doc_id") % 7
    before = d.where(k != 0).select("doc_id", F.sha2("text", 256).alias("sha256"))
    after = d.where(k != 1).select("doc_id", F.sha2(F.when(k == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return provenance.compare_snapshots(before, after, "doc_id")


@query("listed_runs", "SELECT c_custkey AS run, CASE WHEN c_custkey % 3 = 2 THEN c_mktsegment ELSE 'BLOCKED_INVALID_REPORT' END AS status FROM customer")
def listed_runs(spark, sf_dir):
    """Customers as saved runs; a third lack their receipt, a third have a wrong one."""
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run"), F.col("c_mktsegment").alias("status"), F.sha2("c_name", 256).alias("sha256"))
    receipts = runs.where("run % 3 <> 0").select("run", F.when(F.col("run") % 3 == 1, "wrong").otherwise(F.col("sha256")).alias("sha256"))
    return provenance.list_runs(runs, receipts)


@query(
    "artifact_preflight",
    """WITH a AS (SELECT l_orderkey AS contract, l_partkey, l_partkey % 90 * 100000 AS size FROM lineitem), g AS (SELECT contract, count(*) AS files, sum(size)::BIGINT AS bytes, count(DISTINCT l_partkey) AS paths, count(*) FILTER (l_partkey % 31 = 0) AS lost, count(*) FILTER (l_partkey % 31 <> 0 AND l_partkey % 37 = 0) AS wrong FROM a GROUP BY 1)
    SELECT contract, files, bytes, CASE WHEN files > 64 THEN 'ARTIFACT_COUNT' WHEN bytes > 32000000 THEN 'ARTIFACT_BYTES' WHEN paths < files THEN 'ARTIFACT_DUPLICATE' WHEN lost > 0 THEN 'ARTIFACT_READ' WHEN wrong > 0 THEN 'ARTIFACT_MISMATCH' ELSE 'SELECTED_ARTIFACT_BYTES_VERIFIED' END AS status FROM g""",
)
def artifact_preflight(spark, sf_dir):
    """Order lines as the artifacts of their order, parts as the files that are there."""
    size = lambda k: k % 90 * 100000
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("contract"), F.concat(F.lit("f"), "l_partkey").alias("path"), size(F.col("l_partkey")).alias("size"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("sha256"))
    k = F.col("p_partkey")
    files = table(spark, sf_dir, "part").where(k % 31 != 0).select(F.concat(F.lit("f"), k).alias("path"), size(k).alias("size"), F.when(k % 37 == 0, "wrong").otherwise(F.sha2(k.cast("string"), 256)).alias("sha256"))
    return provenance.preflight(a, files)


_RETURNS = {
    0: [("digest_{k}", 4, True), ("Store{k}.save", 9, True), ("Store{k}.check", 12, True), ("Store{k}.check.inner", 13, True)],
    1: [("use_{k}", 4, True)],
    2: [("restore_{k}", 4, True)],
    4: [("Base{k}.run", 2, False), ("Base{k}.__call__", 4, True), ("Child{k}.__init__", 8, False), ("Child{k}.count", 11, True)],
    6: [("late_{k}", 4, True)],
    7: [("rows_{k}_to_table", 1, True), ("table_from_rows", 5, True)],
}


@query("inspected_definitions", "SELECT source_id, name, start_line, CASE WHEN b % 5 = 1 THEN 'SOURCE_GONE' WHEN b % 3 = 0 AND returns THEN 'DEFINITION_CHANGED' ELSE 'EXACT_BYTES_VERIFIED' END AS code FROM (SELECT *, regexp_extract(source_id, 'box([0-9]+)', 1)::INT AS b FROM (" + M.expected("name start_line returns", _RETURNS) + "))")
def inspected_definitions(spark, sf_dir):
    """Definitions held against their sources after some sources went and in others every return was written otherwise."""
    m = M.modules(spark, sf_dir)
    box = F.regexp_extract("source_id", "box([0-9]+)", 1).cast("int")
    now = m.where(box % 5 != 1).select("source_id", F.when(box % 3 == 0, F.replace("code", F.lit("return "), F.lit("return  "))).otherwise(F.col("code")).alias("code"))
    return provenance.inspect_definitions(C.definitions(m), now)


@query("evidence_ages", "SELECT o_orderkey AS evidence, c_mktsegment AS kind, date_diff('day', DATE '1998-01-01' - (c_custkey % 500)::INT, DATE '1998-06-01') AS age_days, c_nationkey AS origin_group, date_diff('day', DATE '1998-01-01' - (c_custkey % 500)::INT, DATE '1998-06-01') <= 365 AS fresh FROM orders JOIN customer ON o_custkey = c_custkey")
def evidence_ages(spark, sf_dir):
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source"), F.col("c_mktsegment").alias("kind"), F.date_sub(F.lit("1998-01-01").cast("date"), (F.col("c_custkey") % 500).cast("int")).alias("observed_on"), F.col("c_nationkey").alias("origin_group"))
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("evidence"), F.col("o_custkey").alias("source"))
    return provenance.evidence_age(e, s, F.lit("1998-06-01").cast("date"), 365).drop("source")


@query(
    "intake_codes",
    """WITH d AS (SELECT doc_id, ['implementation', 'reference'][(doc_id % 2 + 1)::INT] AS kind, ['py', 'md', 'js', 'bin'][(doc_id % 4 + 1)::INT] AS ext, strlen(coalesce(text, '')) * (1 + doc_id % 100) AS size, doc_id % 9 <> 0 AS readable FROM documents)
    SELECT doc_id, CASE WHEN kind <> 'implementation' AND size > 250000 THEN 'REFERENCE_TEXT_LIMIT' WHEN kind <> 'implementation' AND NOT readable THEN 'REFERENCE_ENCODING' WHEN kind <> 'implementation' THEN 'REFERENCE_INDEXED' WHEN ext IN ('py', 'md') THEN 'CODE_INDEXED'
      WHEN size > 250000 THEN 'TEXT_FALLBACK_LIMIT' WHEN NOT readable THEN 'UNSUPPORTED_BINARY' ELSE 'TEXT_ONLY_UNSUPPORTED_LANGUAGE' END AS code FROM d""",
)
def intake_codes(spark, sf_dir):
    pick = lambda n, *x: F.element_at(F.array(*map(F.lit, x)), (F.col("doc_id") % n + 1).cast("int"))
    size = F.octet_length("text") * (1 + F.col("doc_id") % 100)
    return documents(spark, sf_dir).select("doc_id", provenance.code_of_intake(pick(2, "implementation", "reference"), pick(4, "py", "md", "js", "bin"), size, F.col("doc_id") % 9 != 0).alias("code"))


_CODE = M.expected("code", {k: [(t,)] for k, t in enumerate(M.TEMPLATES)})
_CARDS = {
    0: [("digest_{k}", 4, 4, 6), ("Store{k}.save", 9, 10, 11), ("Store{k}.check", 12, 12, 15), ("Store{k}.check.inner", 13, 13, 14)],
    1: [("use_{k}", 4, 4, 8)],
    2: [("restore_{k}", 4, 4, 7)],
    4: [("Base{k}.run", 2, 2, 3), ("Base{k}.__call__", 4, 4, 5), ("Child{k}.__init__", 8, 8, 10), ("Child{k}.count", 11, 11, 14)],
    6: [("late_{k}", 4, 4, 8)],
    7: [("rows_{k}_to_table", 1, 1, 3), ("table_from_rows", 5, 5, 7)],
}
_CATALOG = f"s AS (SELECT source_id, sha256(code) AS sha256, 'observation_' || sha256(source_id || '|' || sha256(code)) AS observation_id FROM ({_CODE}))"


@query("catalog_sources", f"WITH {_CATALOG} SELECT * FROM s")
def catalog_sources(spark, sf_dir):
    m = M.modules(spark, sf_dir)
    return provenance.catalog(m, C.definitions(m))[0]


@query("catalog_cards", f"WITH {_CATALOG}, d AS ({M.expected('name start definition_line end_line', _CARDS)}) SELECT 'card_' || sha256(concat_ws('|', source_id, name, definition_line, end_line, observation_id)) AS card_id, source_id, observation_id, name, start, end_line AS \"end\" FROM d JOIN s USING (source_id)")
def catalog_cards(spark, sf_dir):
    m = M.modules(spark, sf_dir)
    return provenance.catalog(m, C.definitions(m))[1]


@query("note_sources", "SELECT conv_id, turn, 'notes-' || role || '-' || conv_id AS id, 'file-ref://local/' || role || '-' || conv_id AS uri, sha256(coalesce(text, '')) AS sha256 FROM conversations")
def note_sources(spark, sf_dir):
    """Turns as notes in files named after their speaker."""
    c = table(spark, sf_dir, "conversations")
    name = F.concat(F.lit("in/box 1/"), "role", F.lit(" "), "conv_id", F.lit(".txt"))
    s = c.select("conv_id", "turn", provenance.note_source(F.coalesce("text", F.lit("")), name, F.lit("2024-01-01")).alias("s"))
    return s.select("conv_id", "turn", "s.id", "s.uri", F.sha2("s.text", 256).alias("sha256"))


@query("refusal_codes", "SELECT 'SIZE_' || p_size AS code, count(*) AS sources FROM part GROUP BY 1 UNION ALL SELECT 'EVERY', count(*) FROM part")
def refusal_codes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    body = F.concat(F.lit('if x:\n    raise Refused("SIZE_'), "p_size", F.lit('")\nraise Refused("EVERY")\nraise Refused("EVERY")\nraise Refused(code)\n'))
    return provenance.refusal_codes(part.select(F.col("p_partkey").alias("source_id"), body.alias("code")))


@query("relative_imports", M.expected("target resolved", {6: [(".m{c}.restore_{c}", "box{n}.m{c}.restore_{c}"), ("json", "json")]}))
def relative_imports(spark, sf_dir):
    """All imports of the modules that import relatively."""
    i = C.imports(M.modules(spark, sf_dir)).withColumn("resolved", provenance.resolve_relative(F.col("source_id"), F.col("target")))
    late = i.where("startswith(target, '.')").select("source_id").distinct()
    return i.join(late, "source_id", "left_semi").select("source_id", "target", "resolved")


@query("script_calls", M.expected("call line", {5: [("print", 2), ("json.dumps", 2)]}))
def script_calls(spark, sf_dir):
    """Calls that modules make by themselves, outside of any definition."""
    from lodestone.sources import scopes

    return scopes.call_sites(M.modules(spark, sf_dir)).where("scope = '<module>'").select("source_id", "call", "line")


@query("packet_export", "SELECT 'cards' AS name, (SELECT count(*) FROM part) AS rows, 'VERIFIED' AS code UNION ALL SELECT 'events', (SELECT count(*) FROM events), 'VERIFIED' UNION ALL SELECT 'questions', (SELECT count(*) FROM benchmark), 'VERIFIED'")
def packet_export(spark, sf_dir):
    """Three tables written as a packet and read again against their receipts."""
    path = f"{checkpoint_dir(spark)}/packet-{uuid.uuid4().hex}"
    tables = {"cards": table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), "events": table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "questions": table(spark, sf_dir, "benchmark")}
    publish.publish_packet(tables, path)
    return publish.verify_packet(spark, path, {k: v.schema for k, v in tables.items()})


# -- views


@query("fence_views", r"SELECT conv_id, turn, sha256((CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN ' ' WHEN 2 THEN '  ' ELSE '  ' END) || replace(coalesce(text, ''), chr(10), chr(10) || ' ')) AS sha256 FROM conversations")
def fence_views(spark, sf_dir):
    """Turns as fenced blocks whose fence is indented by two: with no blanks, three, a tab, and a blank and a tab before the first line, and
    three blanks before every other line."""
    blanks = F.element_at(F.array(*map(F.lit, ("", "   ", "\t", " \t"))), (F.col("turn") % 4 + 1).cast("int"))
    body = F.concat(blanks, F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n   ")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(views.fence_view(body, 2), 256).alias("sha256"))


@query("line_windows", r"""SELECT conv_id, turn, l AS n_lines, CASE WHEN l >= 2 THEN strlen(a[1]) + 1 END AS "start", CASE WHEN l >= 2 THEN strlen(a[1]) + 1 + strlen(a[2]) + (len(a) > 2)::INT END AS "end" FROM (SELECT conv_id, turn, a, len(a) - (a[len(a)] = '')::INT AS l FROM (SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS a FROM conversations))""")
def line_windows(spark, sf_dir):
    """Number of lines and the bytes of the second line of each turn."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", views.line_offsets("text").alias("o"))
    w = views.window(F.col("o"), F.lit(2), F.lit(2))
    return c.select("conv_id", "turn", (F.size("o") - 1).cast("long").alias("n_lines"), w["start"].alias("start"), w["end"].alias("end"))


@query("same_records", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN FALSE WHEN 3 THEN FALSE ELSE NULL END AS same FROM events")
def same_records(spark, sf_dir):
    """Pairs of JSON texts: equal, equal but for order and blanks, 1 against 1.0, 1 against true, and no JSON."""
    k = F.col("event_id")
    number = (k % 97 + 1).cast("string")
    a = F.concat(F.lit('{"a": 1, "k": '), number, F.lit("}"))
    b = F.when(k % 5 == 0, a).when(k % 5 == 1, F.concat(F.lit('{ "k":'), number, F.lit(',"a":1 }'))).when(k % 5 == 2, F.concat(F.lit('{"a": 1, "k": '), number, F.lit(".0}"))).when(k % 5 == 3, F.concat(F.lit('{"a": true, "k": '), number, F.lit("}"))).otherwise("{")
    return table(spark, sf_dir, "events").select("event_id", views.same_json(a, b).alias("same"))


_RECORD = {"equal": ("""{"a":1,"k":KK}""", """{"k":KK,"a":1}"""), "different": ("""{"k":KK}""", """{"k":KK.0}"""), "reject": ("""{"k":1,"k":KK}""", "")}


@query("reuse_trial", "SELECT mode, candidate, count(*) AS cases, CASE WHEN candidate = 'strict' OR mode = 'different' THEN count(*) ELSE 0 END AS passed FROM (SELECT ['different', 'equal', 'reject'][(event_id % 3 + 1)::INT] AS mode, unnest(['plain', 'strict']) AS candidate FROM events) GROUP BY 1, 2")
def reuse_trial(spark, sf_dir):
    """Two digests of JSON records tried on pairs that should be equal, should differ, or should be refused."""
    e = table(spark, sf_dir, "events")
    mode = F.element_at(F.array(*map(F.lit, sorted(_RECORD))), (F.col("event_id") % 3 + 1).cast("int"))
    pick = lambda i: F.replace(F.element_at(F.create_map(*[F.lit(x) for k, v in _RECORD.items() for x in (k, v[i])]), F.col("mode")), F.lit("KK"), (F.col("event_id") % 89).cast("string"))
    d = e.select("event_id", mode.alias("mode")).withColumn("a", views.record_digests(pick(0))).withColumn("b", views.record_digests(pick(1)))
    ok = lambda c: F.when(F.col("mode") == "reject", F.col(f"a.{c}").isNull()).when(F.col("mode") == "equal", F.col(f"a.{c}") == F.col(f"b.{c}")).otherwise(F.col(f"a.{c}") != F.col(f"b.{c}"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("candidate"), F.coalesce(ok(c), F.lit(False)).alias("ok")) for c in ("plain", "strict")])).alias("x")
    return d.select("mode", each).groupBy("mode", "x.candidate").agg(F.count("*").alias("cases"), F.count_if("x.ok").alias("passed"))


@query("record_refusals", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'OK' WHEN 1 THEN 'DUPLICATE_JSON_KEY' WHEN 2 THEN 'JSON_OBJECT_REQUIRED' WHEN 3 THEN 'NONFINITE_JSON' ELSE 'INVALID_JSON' END AS code, CASE event_id % 5 WHEN 0 THEN sha256('{"k":' || event_id || '}') END AS sha256 FROM events""")
def record_refusals(spark, sf_dir):
    k = F.col("event_id")
    n = k.cast("string")
    text = F.when(k % 5 == 0, F.concat(F.lit('{ "k": '), n, F.lit("}"))).when(k % 5 == 1, F.concat(F.lit('{"k":1,"k":'), n, F.lit("}"))).when(k % 5 == 2, F.concat(F.lit("["), n, F.lit("]"))).when(k % 5 == 3, '{"k":NaN}').otherwise("{'k'}")
    d = table(spark, sf_dir, "events").select("event_id", views.record_digests(text).alias("d"))
    return d.select("event_id", "d.code", F.col("d.strict").alias("sha256"))


@query("folded_texts", r"SELECT doc_id, sha256(trim(regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '\s+', ' ', 'g'))) AS sha256 FROM documents")
def folded_texts(spark, sf_dir):
    """Digests of case-folded texts with single spaces."""
    return documents(spark, sf_dir).select("doc_id", F.sha2(views.folded("text"), 256).alias("sha256"))


_CUE_TEXT = "{x} is copied manually. You must check {x}.\nIt does not scale without {x}"


@query(
    "cue_spans",
    """WITH t AS (SELECT p_partkey, p_name AS x, length(p_name) AS n FROM part) SELECT p_partkey, 'manual' AS cue, 0 AS "start", n + 20 AS "end", x || ' is copied manually.' AS quote FROM t
    UNION ALL SELECT p_partkey, 'requirement', n + 20, 2 * n + 37, ' You must check ' || x || '.' FROM t
    UNION ALL SELECT p_partkey, 'limitation', 2 * n + 38, 3 * n + 64, 'It does not scale without ' || x FROM t, range(2)""",
)
def cue_spans(spark, sf_dir):
    """Sentences with a cue, with their places."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.replace(F.lit(_CUE_TEXT), F.lit("{x}"), F.col("p_name")).alias("text"))
    return views.draft_cues(part, "p_partkey", "text")


@query("escaped_pages", """SELECT page_id, sha256('<tr><td>' || replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</td></tr>') AS sha256 FROM pages""")
def escaped_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(views.table_rows(["html"]), 256).alias("sha256"))


@query("listed_words", "SELECT item_id, array_to_string(list_transform(w[1:20], lambda x: '- ' || x), chr(10)) || CASE WHEN len(w) > 20 THEN chr(10) || '... ' || (len(w) - 20) || ' more' ELSE '' END AS listed FROM (SELECT item_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM benchmark)")
def listed_words(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", views.listed(F.filter(F.split("text", " "), lambda x: x != "")).alias("listed"))
