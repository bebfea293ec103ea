"""Queries over text: tokenisers, search, groups, chunks, markers. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import canon as J
from lodestone.functions import text as T
from lodestone.operators import graph, packing, ranking, retrieval
from lodestone.operators.ranking import cut

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _in(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def words_sql(c: str) -> str:
    """DuckDB: identifier words of an expression."""
    split = rf"regexp_replace(regexp_replace(coalesce({c}, ''), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')"
    return f"list_filter(regexp_extract_all(lower({split}), '[a-z][a-z0-9]{{0,63}}'), lambda w: w NOT IN {_in(T.IDENTIFIER_STOP)})"


@query("identifier_words", f"SELECT doc_id, len(w)::BIGINT AS n_words, sha256(array_to_string(w, ' ')) AS words_sha256 FROM (SELECT doc_id, {words_sql('text')} AS w FROM documents)")
def identifier_words(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.identifier_words("text").alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n_words"), F.sha2(F.array_join("w", " "), 256).alias("words_sha256"))


@query(
    "intake_tokens",
    rf"""SELECT conv_id, turn, list_sort(list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '([a-z])([A-Z])', '\1 \2', 'g')),
    '[a-z][a-z0-9]{{1,39}}'), lambda w: w NOT IN {_in(T.IDENTIFIER_STOP)}))) AS tokens FROM conversations""",
)
def intake_tokens(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.intake_tokens("text").alias("tokens"))


@query(
    "question_terms",
    rf"""SELECT item_id, list_filter(regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-z][a-z0-9]*'),
    lambda w: w NOT IN {_in(T.QUESTION_STOP)}) AS terms FROM benchmark""",
)
def question_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.question_terms("text").alias("terms"))


@query(
    "bounded_counts",
    f"""WITH w AS (SELECT page_id, unnest({words_sql("html")}) AS token FROM pages), n AS (SELECT page_id, token, count(*) AS n FROM w GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, token) AS r FROM n)
    SELECT page_id, token, least(n, 100)::BIGINT AS n FROM r WHERE r <= 256""",
)
def bounded_counts(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", T.identifier_words("html").alias("w"))
    return T.bounded_counts(p, ["page_id"], "w").withColumn("n", F.col("n").cast("long"))


@query("normalized_groups", r"""SELECT sha256(lower(trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\v]+', ' ', 'g')))) AS sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1""")
def normalized_groups(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.normalized("text").alias("t"))
    return graph.exact_groups(d, "t", "doc_id")


@query("exact_text_groups", "SELECT sha256(coalesce(text, '')) AS sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_text_groups(spark, sf_dir):
    return graph.exact_groups(table(spark, sf_dir, "documents"), "text", "doc_id")


@query("locators", r"""SELECT page_id, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*')) || substr(u, length(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*')) + 1) AS locator FROM (SELECT page_id, regexp_replace(coalesce(url, ''), '#.*$', '') AS u FROM pages)""")
def locators(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.locator("url").alias("locator"))


@query(
    "symbol_queries",
    r"""WITH q AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'symbol: ' || c_mktsegment WHEN 1 THEN replace(c_name, '#', '.n') WHEN 2 THEN c_mktsegment ELSE replace(c_name, '#', ' ') END AS q FROM customer),
    n AS (SELECT *, starts_with(q, 'symbol:') AS e, CASE WHEN starts_with(q, 'symbol:') THEN trim(substr(q, 8)) ELSE q END AS name FROM q),
    m AS (SELECT *, regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*') AS ok FROM n)
    SELECT c_custkey, name, CASE WHEN e THEN ok ELSE ok AND (contains(q, '_') OR contains(q, '.')) END AS exact FROM m""",
)
def symbol_queries(spark, sf_dir):
    """What each of a list of search strings asks for; the strings are made from customers' names."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 4
    q = F.when(k == 0, F.concat(F.lit("symbol: "), "c_mktsegment")).when(k == 1, F.replace("c_name", F.lit("#"), F.lit(".n"))).when(k == 2, F.col("c_mktsegment")).otherwise(F.replace("c_name", F.lit("#"), F.lit(" ")))
    return c.select("c_custkey", T.symbol_query(q).alias("x")).select("c_custkey", "x.name", "x.exact")


@query("spdx_markers", r"""SELECT doc_id, regexp_extract_all(substr('# SPDX-License-Identifier: ' || lang || chr(10) || coalesce(text, ''), 1, 8192), 'SPDX-License-Identifier:\s*([^\r\n]+)', 1) AS markers FROM documents WHERE lang IS NOT NULL""")
def spdx_markers(spark, sf_dir):
    """Each document under a header line that names its language as the licence."""
    d = table(spark, sf_dir, "documents").where("lang IS NOT NULL")
    return d.select("doc_id", T.spdx_markers(F.concat(F.lit("# SPDX-License-Identifier: "), "lang", F.lit("\n"), F.coalesce("text", F.lit("")))).alias("markers"))


_PLAIN_LINT = {k: v for k, v in T.LINT.items() if "(?!" not in v and "(?<!" not in v}
#: Made-up strings that each rule should find, put before every document in turn.
_PLANTED = {
    "private_key": "-----BEGIN TEST PRIVATE KEY-----",
    "aws_access_key": "AKIA" + "X" * 16,
    "github_token": "ghp_" + "x" * 24,
    "slack_token": "xoxb-" + "x" * 12,
    "stripe_key": "sk_test_" + "x" * 10,
    "openai_style_key": "sk-" + "x" * 40,
    "google_api_key": "AIza" + "x" * 32,
    "jwt": "eyJ" + ".".join(["x" * 12, "y" * 12, "z" * 12]),
    "bearer_token": "Authorization: Bearer " + "x" * 16,
    "cookie_token": "Set-Cookie: " + "x" * 14,
    "credential_url_parameter": "/a?b=1&token=" + "x" * 8,
    "url_credentials": "ftp://user:" + "x" * 8 + "@host",
    "env_file_line": "export MY_TOKEN=" + "x" * 8,
    "drive_link": "docs.google.com/x",
    "nothing": "no secret here",
}
_BEFORE = [_PLANTED[k] for k in sorted(_PLANTED)]
_BEFORE_SQL = "[" + ", ".join(f"'{x}'" for x in _BEFORE) + f"][(doc_id % {len(_BEFORE)} + 1)::INT] || chr(10) || coalesce(text, '')"
_LINT_SQL = " UNION ALL ".join("SELECT doc_id, '{}' AS rule, len(regexp_extract_all(t, '{}'))::BIGINT AS n FROM p".format(k, v.replace("'", "''")) for k, v in _PLAIN_LINT.items())


def planted(spark, sf_dir):
    before = F.element_at(F.array(*map(F.lit, _BEFORE)), (F.col("doc_id") % len(_BEFORE) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(before, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))


@query("secret_lint", f"WITH p AS (SELECT doc_id, {_BEFORE_SQL} AS t FROM documents) SELECT rule, count(*) AS documents, sum(n)::BIGINT AS hits FROM ({_LINT_SQL}) WHERE n > 0 GROUP BY rule")
def secret_lint(spark, sf_dir):
    """Documents and hits for each pattern (those without look-around, which the SQL engine lacks), over texts with a planted string each."""
    d = planted(spark, sf_dir).select(F.explode(T.lint_hits("text", _PLAIN_LINT)).alias("x"))
    return d.groupBy("x.rule").agg(F.count("*").alias("documents"), F.sum("x.n").alias("hits"))


_SENSITIVE = [".env", "a/.env.local", "x/id_rsa", "deploy/credentials.json", "secrets.yaml", "b/service-account-1.json", "src/main.py", "environment.txt", ".npmrc", "my.env"]


@query("sensitive_files", f"SELECT doc_id, [{', '.join(str(x not in ('src/main.py', 'environment.txt', 'my.env')).upper() for x in _SENSITIVE)}][(doc_id % {len(_SENSITIVE)} + 1)::INT] AS sensitive FROM documents")
def sensitive_files(spark, sf_dir):
    """Whether a file's name alone keeps it from being published."""
    name = F.element_at(F.array(*map(F.lit, _SENSITIVE)), (F.col("doc_id") % len(_SENSITIVE) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", T.is_sensitive(name).alias("sensitive"))


@query("personal_data_lint")
def personal_data_lint(spark, sf_dir):
    """Hits of all patterns by document; some look around, so without SQL."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.lint_hits("text")).alias("x"))
    return d.select("doc_id", "x.rule", "x.n")


@query("negated_questions", f"SELECT item_id, list_has_any({words_sql('text')}, [{', '.join(repr(w) for w in T.NEGATIONS)}]) AS negated FROM benchmark")
def negated_questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.is_negated(T.identifier_words("text")).alias("negated"))


@query(
    "text_chunks",
    r"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), s AS (SELECT doc_id, l, unnest(range(0, len(l), 32)) AS s FROM l)
    SELECT doc_id, (s + 1)::BIGINT AS start_line, least(s + 40, len(l))::BIGINT AS end_line, sha256(array_to_string(l[s + 1 : s + 40], chr(10))) AS chunk_sha256 FROM s""",
)
def text_chunks(spark, sf_dir):
    c = packing.text_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return c.select("doc_id", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.sha2("chunk", 256).alias("chunk_sha256"))


@query("source_blocks", "SELECT doc_id AS row_id, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, ''))::BIGINT AS bytes, 'OK' AS code FROM documents WHERE strlen(coalesce(text, '')) > 0")
def source_blocks(spark, sf_dir):
    """Every text cut into blocks of 4096 bytes and put together again; the digest is the text's own."""
    b = packing.blocks(table(spark, sf_dir, "documents"), "doc_id", "text", 4096)
    return packing.rebuild(b).select("row_id", "sha256", "bytes", "code")


@query("canonical_events", """SELECT event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') AS sha256 FROM events""")
def canonical_events(spark, sf_dir):
    """Digest of each event's canonical JSON; the fields are given in another order than the canonical one."""
    e = table(spark, sf_dir, "events")
    raw = F.to_json(F.struct("user_id", "event_type", "event_id"))
    return e.select("event_id", F.sha2(J.canonical_json(raw)["json"], 256).alias("sha256"))


_RECORDS = [
    ('{"k": KK}', "OK"),
    ('{"k": 1, "k": KK}', "DUPLICATE_JSON_KEY"),
    ('{"k": NaN}', "NONFINITE_JSON"),
    ('{"k": ' + "[" * 70 + "]" * 70 + "}", "JSON_DEPTH_LIMIT"),
    ('{"k": 9007199254740992}', "UNSAFE_INTEGER_USE_STRING"),
    ('{"k": 1e-400}', "NUMBER_UNDERFLOW"),
    ('{"k": 0.' + "1" * 130 + "}", "NUMBER_TOKEN_LIMIT"),
    ("[KK]", "OBJECT_REQUIRED"),
    ('{"k": KK', "INVALID_JSON_OR_UNICODE"),
    ("", "JSON_SIZE_LIMIT"),
    ('{"k": 1e999}', "UNSAFE_INTEGER_USE_STRING"),
    (None, "NULL"),
    ('{"k": {"b": [KK, true, "x"]}, "a": -0.0}', "OK"),
]


@query(
    "admitted_props",
    f"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CASE WHEN props IS NULL THEN 'NULL' WHEN NOT json_valid(props) THEN 'INVALID_JSON_OR_UNICODE' WHEN json_type(props) <> 'OBJECT' THEN 'OBJECT_REQUIRED' ELSE 'OK' END ELSE [{', '.join(repr(c) for _, c in _RECORDS)}][(event_id % {len(_RECORDS)} + 1)::INT] END AS code FROM events",
)
def admitted_props(spark, sf_dir):
    """The properties of every second event, and records that break one rule each in place of the others."""
    made = F.element_at(F.array(*[F.lit(r) for r, _ in _RECORDS]), (F.col("event_id") % len(_RECORDS) + 1).cast("int"))
    text = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.replace(made, F.lit("KK"), F.col("event_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", J.admitted_json(text)["code"].alias("code"))


@query("git_blob_ids", r"SELECT doc_id, sha1(encode('blob ' || strlen(coalesce(text, ''))) || '\x00'::BLOB || encode(coalesce(text, ''))) AS git_sha1, sha256(coalesce(text, '')) AS sha256 FROM documents")
def git_blob_ids(spark, sf_dir):
    """Git blob ids and digests of all texts."""
    return table(spark, sf_dir, "documents").select("doc_id", J.git_blob_sha1("text").alias("git_sha1"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


@query("priority_files", "SELECT host, url, hits, rank FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY hits DESC, length(url), url, page_id) AS rank FROM (SELECT page_id, url, regexp_extract(url, '://([^/]*)', 1) AS host, contains(lower(url), 'a')::INT + contains(lower(url), '1')::INT AS hits FROM pages)) WHERE rank <= 3")
def priority_files(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "://([^/]*)", 1).alias("host"))
    low = F.lower("url")
    p = p.withColumn("hits", F.contains(low, F.lit("a")).cast("int") + F.contains(low, F.lit("1")).cast("int"))
    return ranking.top_rows(p, ["host"], [F.desc("hits"), F.length("url"), F.col("url"), F.col("page_id")], 3).select("host", "url", "hits", "rank")


# -- search

#: Search rows over documents: language and source stand for a symbol, dotted names and addresses in the text for declared calls.
FIELDS = {"symbol": "symbol", "documentation": "text", "path": "source", "declared_call": "called"}
WANTED = {"q1": "the and thing", "q2": "idiot snapshot backup", "q3": "license apache version", "q4": "verify restore", "q5": "password token secret key", "q6": "zzzz unheard"}
_CALLED = r"[A-Za-z0-9]+(?:[.@][A-Za-z0-9]+)+"


def search_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    called = F.array_join(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_CALLED), F.lit(0)), " ")
    return d.select(F.col("doc_id").alias("row_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("group_id"), F.concat_ws(".", "lang", "source").alias("symbol"), "text", "source", called.alias("called"))


_DOCUMENT_ROWS = f"SELECT doc_id AS row_id, sha256(coalesce(text, '')) AS group_id, concat_ws('.', lang, source) AS symbol, text AS documentation, source AS path, array_to_string(regexp_extract_all(coalesce(text, ''), '{_CALLED}'), ' ') AS declared_call FROM documents"


def _weights():
    return "CASE field " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in retrieval.WEIGHTS.items()) + " END"


def scores_sql(rows: str, fields: list[str], wanted: dict[str, str]) -> str:
    """CTEs up to rs, the scores of rows (a SELECT of row_id, group_id and the fields)."""
    values = ", ".join(f"('{k}', '{v}')" for k, v in wanted.items())
    pairs = ", ".join(f"('{k}', '{x}')" for k, v in retrieval.SYNONYMS.items() for x in v)
    long = " UNION ALL ".join(f"SELECT row_id, group_id, '{f}' AS field, {f} AS x FROM r" for f in fields)
    return f"""q(query_id, query) AS (VALUES {values}), syn(term, variant) AS (VALUES {pairs}),
t AS (SELECT DISTINCT query_id, unnest({words_sql("query")}) AS term FROM q),
terms AS (SELECT query_id, t.term, coalesce(variant, t.term) AS variant, CASE WHEN coalesce(variant, t.term) = t.term THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS weight FROM t LEFT JOIN syn ON t.term = syn.term),
r AS ({rows}), long AS ({long}),
w AS (SELECT row_id, group_id, field, unnest({words_sql("x")}) AS token FROM long),
n AS (SELECT row_id, group_id, field, token, count(*) AS n FROM w GROUP BY ALL),
f AS (SELECT row_id, group_id, field, token, least(n, 100) AS tf FROM (SELECT *, row_number() OVER (PARTITION BY row_id, field ORDER BY n DESC, token) AS k FROM n) WHERE k <= 256),
merged AS (SELECT group_id, field, token, max(tf) AS tf FROM f GROUP BY ALL),
g AS (SELECT count(DISTINCT group_id) AS groups FROM f),
idf AS (SELECT token, ln(1 + (groups - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT token, count(DISTINCT group_id) AS df FROM merged GROUP BY token), g),
av AS (SELECT field, sum(tf)::DOUBLE / max(groups) AS average FROM merged, g GROUP BY field),
ln AS (SELECT row_id, field, sum(tf)::DOUBLE AS length FROM f GROUP BY ALL),
s AS (SELECT query_id, f.row_id, f.group_id, f.field, term, max(idf * tf * (1.2::DOUBLE + 1) / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * length / greatest(average, 1.0))) * weight) AS score
  FROM f JOIN terms ON f.token = variant JOIN idf ON idf.token = f.token JOIN av ON av.field = f.field JOIN ln ON ln.row_id = f.row_id AND ln.field = f.field GROUP BY ALL),
rs0 AS (SELECT query_id, row_id, group_id, list(DISTINCT term) AS terms, list(DISTINCT field) AS fields, count(DISTINCT term) AS matched, sum(score * w) AS lexical, sum(CASE WHEN field = 'symbol' THEN score * w ELSE 0 END) AS symbol,
  sum(CASE WHEN field IN ('observed_api', 'declared_call') THEN score * w ELSE 0 END) AS call FROM (SELECT *, {_weights()} AS w FROM s) GROUP BY ALL)"""


def ranked_sql(rows: str, fields: list[str], wanted: dict[str, str], kept: str = "TRUE", directed: str | None = None, about: str = "NULL AS role, NULL AS class_name, FALSE AS stub") -> str:
    """CTEs up to `a`, every kept row of each query with its sort keys. directed: a SELECT of query_id, row_id, group_id, endpoints;
    about: role, class_name and stub of a row of r."""
    building = "[" + ", ".join(f"'{w}'" for w in retrieval.CONSTRUCTION) + "]"
    extra = directed or "SELECT NULL::VARCHAR AS query_id, row_id, group_id, NULL::VARCHAR[] AS endpoints FROM r WHERE FALSE"
    return f"""{scores_sql(rows, fields, wanted)}, dir AS ({extra}), wanted AS (SELECT query_id, list_sort(list(DISTINCT term)) AS wanted FROM terms GROUP BY 1),
kept AS (SELECT row_id, coalesce(symbol, '') AS name, list_distinct({words_sql("symbol")}) AS nw, list_sort(list_distinct({words_sql("list_last(string_split(symbol, '.'))")})) AS lw, {about} FROM r WHERE {kept}),
both0 AS (SELECT coalesce(rs0.query_id, dir.query_id) AS query_id, coalesce(rs0.row_id, dir.row_id) AS row_id, coalesce(rs0.group_id, dir.group_id) AS group_id, coalesce(terms, []) AS terms, coalesce(fields, []) AS fields,
  coalesce(lexical, 0) AS lexical, coalesce(symbol, 0) AS symbol, coalesce(call, 0) AS call, endpoints FROM rs0 FULL JOIN dir ON rs0.query_id = dir.query_id AND rs0.row_id = dir.row_id),
rs AS (SELECT both0.*, wanted, name, nw, lw, role, class_name, stub, len(list_distinct(terms || list_intersect(wanted, coalesce(endpoints, [])))) AS matched FROM both0 JOIN wanted USING (query_id) JOIN kept USING (row_id)),
best AS (SELECT query_id, channel, group_id, max(value) AS value FROM (SELECT query_id, group_id, 'lexical' AS channel, lexical AS value FROM rs WHERE matched > 0
  UNION ALL SELECT query_id, group_id, 'symbol', symbol FROM rs WHERE matched > 0 UNION ALL SELECT query_id, group_id, 'call', call FROM rs WHERE matched > 0) WHERE value > 0 GROUP BY ALL),
ranks AS (SELECT query_id, channel, group_id, row_number() OVER (PARTITION BY query_id, channel ORDER BY round(value, 9) DESC, group_id) AS rank FROM best),
fused AS (SELECT query_id, group_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM ranks GROUP BY ALL),
a AS (SELECT rs.* EXCLUDE (matched), matched, matched = len(wanted) AS all_terms, endpoints IS NOT NULL AS directional, lw = wanted AS exact, len(list_intersect(wanted, nw)) AS sm, coalesce(rrf, 0) AS rrf,
  CASE WHEN NOT stub AND (list_has_any(wanted, {words_sql("class_name")}) OR list_contains(fields, 'class_documentation')) THEN
    (CASE role WHEN 'CONSTRUCTOR' THEN 1 WHEN 'CALL_OPERATION' THEN -1 ELSE 0 END) * (CASE WHEN list_has_any(wanted, {building}) THEN 1 ELSE -1 END) ELSE 0 END AS preference
  FROM rs LEFT JOIN fused USING (query_id, group_id) WHERE matched > 0)"""


ORDER_SQL = "all_terms DESC, matched + directional::INT DESC, directional DESC, coalesce(exact, FALSE) DESC, sm DESC, preference DESC, round(rrf, 12) DESC, round(lexical, 9) DESC, name, row_id"
DISTINCT_SQL = f"""o AS (SELECT *, row_number() OVER (PARTITION BY query_id, group_id ORDER BY {ORDER_SQL}) AS k, count(*) OVER (PARTITION BY query_id, group_id) AS occurrences FROM a),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {ORDER_SQL}) AS position FROM o WHERE k = 1)"""
FOUND_SQL = "query_id, position, row_id, group_id, matched, all_terms, round(rrf, 6) AS rrf, round(lexical, 6) AS bm25"
_NAMES = list(FIELDS)


@query("bm25_scores", f"WITH {scores_sql(_DOCUMENT_ROWS, _NAMES, WANTED)} SELECT query_id, row_id, matched, round(lexical, 6) AS lexical, round(symbol, 6) AS symbol, round(call, 6) AS call FROM rs0")
def bm25_scores(spark, sf_dir):
    s = retrieval.row_scores(search_rows(spark, sf_dir), FIELDS, retrieval.query_terms(spark, WANTED))
    return s.select("query_id", "row_id", "matched", *[F.round(c, 6).alias(c) for c in retrieval.CHANNELS])


@query("search_distinct", f"WITH {ranked_sql(_DOCUMENT_ROWS, _NAMES, WANTED)}, {DISTINCT_SQL} SELECT {FOUND_SQL}, occurrences FROM p WHERE position <= 20")
def search_distinct(spark, sf_dir):
    """The first 20 exact-text groups of each query."""
    return retrieval.search(search_rows(spark, sf_dir), FIELDS, WANTED)


@query("search_filtered", f"""WITH {ranked_sql(_DOCUMENT_ROWS, _NAMES, WANTED, "symbol LIKE 'en.%' AND NOT contains(coalesce(documentation, ''), '@')")} SELECT {FOUND_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {ORDER_SQL}) AS position FROM a) WHERE position <= 20""")
def search_filtered(spark, sf_dir):
    """The first 20 rows of each query among English texts without an address; statistics are those of all texts."""
    checks = [("kind", F.col("symbol").startswith("en.")), ("excluded_api_observed", ~F.contains(F.coalesce("text", F.lit("")), F.lit("@")))]
    return retrieval.search(search_rows(spark, sf_dir), FIELDS, WANTED, checks=checks, distinct=False)


@query("group_occurrences", f"WITH {ranked_sql(_DOCUMENT_ROWS, _NAMES, WANTED)}, {DISTINCT_SQL}, top AS (SELECT query_id, group_id FROM p WHERE position <= 5) SELECT query_id, group_id, row_number() OVER (PARTITION BY query_id, group_id ORDER BY row_id) AS place, row_id FROM top JOIN r USING (group_id)")
def group_occurrences(spark, sf_dir):
    """All occurrences of the first five groups of each query."""
    rows = search_rows(spark, sf_dir)
    return retrieval.occurrences(retrieval.search(rows, FIELDS, WANTED, 5), rows)


@query("search_status", f"""WITH {scores_sql(_DOCUMENT_ROWS, _NAMES, WANTED)}, nt AS (SELECT query_id, count(DISTINCT term) AS wanted FROM terms GROUP BY 1),
z AS (SELECT nt.query_id, wanted, count(rs0.row_id) AS matching_rows, count(rs0.row_id) FILTER (matched = wanted) AS full_rows, max(matched) AS best FROM nt LEFT JOIN rs0 USING (query_id) GROUP BY ALL)
SELECT query_id, CASE WHEN full_rows > 0 THEN 'MATCHES_FOUND' WHEN matching_rows > 0 THEN 'PARTIAL_TERM_MATCHES_ONLY' ELSE 'NO_METADATA_MATCH' END AS status, matching_rows, full_rows,
CASE WHEN best IS NULL THEN 'NO_TERM_OVERLAP' WHEN best = wanted THEN 'ALL_QUERY_TERMS' WHEN best = 1 THEN 'SINGLE_TERM_OVERLAP' ELSE 'MULTIPLE_TERM_OVERLAP' END AS coverage FROM z""")
def search_status(spark, sf_dir):
    terms = cut(retrieval.query_terms(spark, WANTED))
    return retrieval.search_status(retrieval.row_scores(search_rows(spark, sf_dir), FIELDS, terms), terms)


_LEGACY = {"old1": "snapshot the idiot", "old2": "en src1", "old3": "apache license version"}
_TOKENS = lambda x: rf"list_sort(list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(coalesce({x}, ''), '([a-z])([A-Z])', '\1 \2', 'g')), '[a-z][a-z0-9]{{1,39}}'), lambda w: w NOT IN {_in(T.IDENTIFIER_STOP)})))"


@query("legacy_order", f"""WITH q(query_id, query) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in _LEGACY.items())}), t AS (SELECT query_id, {_TOKENS("query")} AS wanted FROM q),
syn(term, variants) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in retrieval.LEGACY_SYNONYMS.items())}), u AS (SELECT query_id, wanted, term, coalesce(variants, [term]) AS variants FROM (SELECT query_id, wanted, unnest(wanted) AS term FROM t) x LEFT JOIN syn USING (term)),
d AS (SELECT doc_id AS row_id, concat_ws('.', lang, source) AS name, {_TOKENS("text")} AS st FROM documents),
m AS (SELECT query_id, row_id, any_value(name) AS name, any_value(wanted) AS wanted, count(*) AS matched FROM u JOIN d ON list_has_any(variants, st) GROUP BY query_id, row_id),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, ({_TOKENS("list_last(string_split(name, '.'))")} = wanted) DESC, len(list_intersect(wanted, {_TOKENS("name")})) DESC, name, row_id) AS position FROM m)
SELECT query_id, position, row_id, matched FROM p WHERE position <= 20""")
def legacy_order(spark, sf_dir):
    """The older order of results, by term coverage and symbols only."""
    rows = search_rows(spark, sf_dir).select("row_id", F.col("symbol").alias("name"), T.intake_tokens("text").alias("search_terms"))
    return retrieval.legacy_search(rows, _LEGACY)


@query("filter_reasons", "SELECT CASE WHEN lang <> 'en' THEN 'kind' WHEN source IN ('src0', 'src1') THEN 'container' WHEN NOT contains(text, 'the') THEN 'required_api_not_observed' WHEN contains(text, '@') THEN 'excluded_api_observed' ELSE 'kept' END AS reason, count(*) AS rows FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL GROUP BY 1")
def filter_reasons(spark, sf_dir):
    """Documents by the first search filter that they fail."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL")
    checks = [("kind", F.col("lang") == "en"), ("container", ~F.col("source").isin("src0", "src1")), ("required_api_not_observed", F.contains("text", F.lit("the"))), ("excluded_api_observed", ~F.contains("text", F.lit("@")))]
    return retrieval.first_failing_filter(d, checks)


@query("fused_ranks", """WITH a AS (SELECT part, supp, value, row_number() OVER (PARTITION BY part ORDER BY value DESC, supp) AS r FROM (SELECT l_partkey AS part, l_suppkey AS supp, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)),
b AS (SELECT part, supp, row_number() OVER (PARTITION BY part ORDER BY value DESC, supp) AS r FROM (SELECT l_partkey AS part, l_suppkey AS supp, count(*) AS value FROM lineitem GROUP BY ALL))
SELECT part, supp, round(sum(1.0::DOUBLE / (60 + r)), 9) AS rrf FROM (SELECT part, supp, r FROM a UNION ALL SELECT part, supp, r FROM b) GROUP BY ALL""")
def fused_ranks(spark, sf_dir):
    """Two rankings of each part's suppliers (by quantity, by lines) fused by reciprocal rank."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp")).agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("lines"))
    each = F.explode(F.array(F.struct(F.lit("quantity").alias("channel"), F.col("quantity").alias("value")), F.struct(F.lit("lines").alias("channel"), F.col("lines").cast("double").alias("value")))).alias("x")
    r = ranking.global_rank(g.select("part", "supp", each).select("part", "supp", "x.channel", "x.value"), ["part", "channel"], [F.desc("value"), F.col("supp")], "rank")
    return ranking.fuse(r, ["part", "supp"]).withColumn("rrf", F.round("rrf", 9))


@query("round_robin_merge", """WITH t AS (SELECT l_shipmode, l_returnflag, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_shipmode, l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS turn FROM (SELECT l_linestatus AS l_shipmode, * FROM lineitem)),
p AS (SELECT *, row_number() OVER (PARTITION BY l_shipmode ORDER BY turn, l_returnflag) AS place FROM t WHERE turn <= 10) SELECT l_shipmode AS question, l_returnflag AS source, l_orderkey, l_linenumber, turn, place FROM p WHERE place <= 10""")
def round_robin_merge(spark, sf_dir):
    """The first ten lines of each status when the return flags take turns."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("question"), F.col("l_returnflag").alias("source"), "l_orderkey", "l_linenumber", "l_extendedprice")
    r = ranking.round_robin(li, "question", "source", [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 10)
    return r.select("question", "source", "l_orderkey", "l_linenumber", "turn", "place")


@query("limited_lists", "SELECT c_nationkey, c_custkey, rank, total FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank, count(*) OVER (PARTITION BY c_nationkey) AS total FROM customer) WHERE rank <= 5")
def limited_lists(spark, sf_dir):
    """Five customers of each nation, with the true number of its customers."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return ranking.with_totals(c, ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 5).select("c_nationkey", "c_custkey", "rank", "total")


@query("evidence_families", rf"""WITH RECURSIVE d AS (SELECT doc_id, lower(trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\v]+', ' ', 'g'))) AS t, list_sort(list_distinct({words_sql("text")})) AS p FROM documents),
e AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY t) AS b FROM d UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY p) FROM d),
l AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
c(id, x) AS (SELECT doc_id, doc_id FROM d UNION SELECT c.id, l.b FROM c JOIN l ON c.x = l.a)
SELECT id, min(x) AS root FROM c GROUP BY id""")
def evidence_families(spark, sf_dir):
    """Documents with the same normalised text or the same set of words, transitively."""
    words = F.array_join(F.array_sort(F.array_distinct(T.identifier_words("text"))), " ")
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalized("text"), 256).alias("t"), F.sha2(words, 256).alias("p"))
    return graph.families(d, "doc_id", ["t", "p"])


@query("corpus_summary", "SELECT source, count(*) AS documents, count(DISTINCT text) AS distinct_texts, sum(n_chars)::BIGINT AS chars, count(*) FILTER (lang = 'en') AS english, max(n_chars) AS longest FROM documents GROUP BY source")
def corpus_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    # distinct texts by (source, digest) first, so that a source with a third of all rows is aggregated in parts
    t = d.groupBy("source", F.when(F.col("text").isNotNull(), F.sha2("text", 256)).alias("sha")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.sum((F.col("lang") == "en").cast("long")).alias("english"), F.max("n_chars").alias("longest"))
    return t.groupBy("source").agg(F.sum("n").alias("documents"), F.count("sha").alias("distinct_texts"), F.sum("chars").alias("chars"), F.sum("english").alias("english"), F.max("longest").alias("longest"))
