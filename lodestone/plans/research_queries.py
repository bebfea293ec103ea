"""Research questions on the tables: documents as records, turns of conversations as references."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import research, retrieval
from lodestone.plans import text_queries as X
from lodestone.plans.text_queries import table, words_sql

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


QUESTIONS = {"r1": "license version copy", "r2": "idiot worthless trash", "r3": "apache license", "r4": "zzzz unheard", "r5": "en.src1"}
REQUIRED = {"r3": "http"}


def question_terms_sql(c: str) -> str:
    stop = ", ".join(f"'{w}'" for w in T.QUESTION_STOP)
    return rf"list_filter(regexp_extract_all(lower(regexp_replace(coalesce({c}, ''), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-z][a-z0-9]*'), lambda w: w NOT IN ({stop}))"


def _values(d: dict[str, str]) -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in d.items())


@query("question_codes", f"SELECT conv_id, turn, CASE WHEN coalesce(length(trim(text)), 0) = 0 THEN 'QUERY_TEXT' WHEN length(text) > 200 THEN 'QUERY_LENGTH' WHEN len(w) = 0 THEN 'QUERY_TERMS_REQUIRED' WHEN len(w) > 32 THEN 'QUERY_TERM_LIMIT' ELSE 'ADMITTED' END AS code FROM (SELECT *, list_distinct({words_sql('text')}) AS w FROM conversations)")
def question_codes(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", research.question_codes(F.col("text")).alias("code"))


def records(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    name = F.concat_ws(".", "lang", "source")
    return d.select(F.col("doc_id").alias("id"), name.alias("name"), name.alias("symbol"), F.col("source").alias("classdoc"), F.coalesce("text", F.lit("")).alias("source"), F.coalesce("source", F.lit("")).alias("path"), F.col("doc_id").alias("start_line"))


_LEXICAL = f"""WITH q(query_id, query) AS (VALUES {_values(QUESTIONS)}), t AS (SELECT DISTINCT query_id, query, unnest({question_terms_sql("query")}) AS term FROM q),
r AS (SELECT doc_id AS id, concat_ws('.', lang, source) AS name, coalesce(source, '') AS path, doc_id AS start_line, {question_terms_sql("concat_ws('.', lang, source)")} AS a, {question_terms_sql("source")} AS b, {question_terms_sql("text")} AS c FROM documents),
w AS (SELECT id, unnest(a) AS term, 4.0::DOUBLE AS weight FROM r UNION ALL SELECT id, unnest(b), 1.0::DOUBLE FROM r UNION ALL SELECT id, unnest(c), 1.0::DOUBLE FROM r),
tot AS (SELECT count(*) AS n, avg(len(a) + len(b) + len(c)) AS average FROM r),
h AS (SELECT id, term, sum(weight) AS tf FROM w WHERE term IN (SELECT term FROM t) GROUP BY ALL),
idf AS (SELECT term, greatest(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM h, tot GROUP BY term),
s AS (SELECT query_id, query, id, count(*) AS matched, sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (len(a) + len(b) + len(c)) / average))) AS score FROM h JOIN t USING (term) JOIN idf USING (term) JOIN r USING (id), tot GROUP BY ALL),
x AS (SELECT s.*, name, path, start_line, query = name OR query = list_last(string_split(name, '.')) AS exact FROM s JOIN r USING (id)),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, matched DESC, round(score, 9) DESC, path, start_line, id) AS position FROM x)
SELECT query_id, position, id, matched, exact, round(score, 6) AS score FROM p WHERE position <= 10"""


@query("lexical_search", _LEXICAL)
def lexical_search(spark, sf_dir):
    """The first ten documents of each question by full-text rank."""
    return research.lexical_search(records(spark, sf_dir), QUESTIONS)


_WANTED = f"wn AS (SELECT query_id, count(DISTINCT term) AS wanted FROM (SELECT query_id, unnest({question_terms_sql('query')}) AS term FROM (VALUES {_values(QUESTIONS)}) q(query_id, query)) GROUP BY 1)"
_STRUCTURED = f"WITH {X.ranked_sql(X._DOCUMENT_ROWS, X._NAMES, QUESTIONS)} SELECT query_id, position, row_id AS id, matched FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {X.ORDER_SQL}) AS position FROM a) WHERE position <= 10"
_FUSED = f"""lex AS ({_LEXICAL}), st AS ({_STRUCTURED}), {_WANTED},
ch AS (SELECT query_id, position, id, matched, exact, 'lexical' AS channel FROM lex UNION ALL SELECT query_id, position, id, matched, FALSE, 'structured' FROM st),
ob AS (SELECT doc_id AS id, contains(coalesce(text, ''), 'http') AS has FROM documents),
fu AS (SELECT query_id, id, list_sort(list(DISTINCT channel)) AS channels, sum(1.0::DOUBLE / (60 + position)) AS rrf, max(matched) AS matched, bool_or(exact) AS exact FROM ch JOIN ob USING (id) WHERE query_id <> 'r3' OR has GROUP BY ALL),
fx AS (SELECT *, matched = wanted AS "full" FROM fu JOIN wn USING (query_id)),
fp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY "full" DESC, matched DESC, exact DESC, round(rrf, 12) DESC, id) AS position FROM fx)"""


def _channels(spark, sf_dir):
    wanted = spark.createDataFrame(sorted(QUESTIONS.items()), "query_id string, query string").select("query_id", F.size(F.array_distinct(T.question_terms("query"))).cast("long").alias("wanted"))
    lex = research.lexical_search(records(spark, sf_dir), QUESTIONS).join(F.broadcast(wanted), "query_id")
    st = retrieval.search(X.search_rows(spark, sf_dir), X.FIELDS, QUESTIONS, 10, distinct=False).select("query_id", "position", F.col("row_id").alias("id"), "matched", F.lit(False).alias("exact")).join(F.broadcast(wanted), "query_id")
    observed = table(spark, sf_dir, "documents").where("contains(text, 'http')").select(F.col("doc_id").alias("id"), F.array(F.lit("http")).alias("observed_apis"))
    required = spark.createDataFrame(sorted(REQUIRED.items()), "query_id string, api string")
    return wanted, research.fuse_channels({"lexical": lex, "structured": st}, observed, required)


@query("fused_channels", f'WITH {_FUSED} SELECT query_id, position, id, channels, round(rrf, 9) AS rrf, matched, "full" FROM fp WHERE position <= 5')
def fused_channels(spark, sf_dir):
    """Full-text and structured search fused; a question that requires an API keeps only records in which it is observed."""
    return _channels(spark, sf_dir)[1]


@query(
    "investigated_questions",
    f"""WITH {_FUSED}, top AS (SELECT * FROM fp WHERE position <= 5),
    rf AS (SELECT DISTINCT query_id FROM (SELECT query_id, unnest({question_terms_sql('query')}) AS term FROM (VALUES {_values(QUESTIONS)}) q(query_id, query)) JOIN (SELECT DISTINCT unnest({question_terms_sql('text')}) AS term FROM conversations) USING (term)),
    ag AS (SELECT query_id, bool_or("full") AS f, max(matched) FILTER (position = 1) AS best, bool_or("full") FILTER (position = 1) AS first FROM top GROUP BY 1)
    SELECT wn.query_id, CASE WHEN f THEN 'STATIC_LEADS_REVIEW_REQUIRED' WHEN f IS NOT NULL THEN 'PARTIAL_QUERY_ONLY' WHEN rf.query_id IS NOT NULL THEN 'REFERENCE_OR_TEXT_ONLY' WHEN wn.query_id = 'r4' THEN 'EVALUATION_BLOCKED' ELSE 'NO_EVIDENCE_IN_SELECTED_SOURCES' END AS status,
      CASE WHEN f IS NOT NULL AND NOT first AND (best = 1 OR 2 * best < wanted) THEN 'INSPECT_SOURCE_OR_REFINE_QUERY' WHEN f IS NOT NULL THEN 'REVIEW_EVIDENCE_AND_DECLARE_BEHAVIOR_TEST' ELSE 'ACQUIRE_ADDITIONAL_PERMITTED_EVIDENCE' END AS next_action
    FROM wn LEFT JOIN ag USING (query_id) LEFT JOIN rf USING (query_id)""",
)
def investigated_questions(spark, sf_dir):
    """What each question's records, references and gaps amount to."""
    wanted, fused = _channels(spark, sf_dir)
    q = spark.createDataFrame(sorted(QUESTIONS.items()), "query string, text string").select("query", T.question_terms("text").alias("words"))
    refs = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("ref"), T.question_terms("text").alias("words"))
    found = research.overlapping(q, refs).select(F.col("query").alias("query_id"))
    gaps = spark.createDataFrame([("r4",)], "query_id string")
    return research.question_status(wanted, fused, found, gaps)


@query("reference_hits", f"""WITH q AS (SELECT item_id, list_distinct({words_sql("text")}) AS qt FROM benchmark), x AS (SELECT item_id, unnest(qt) AS term FROM q),
c AS (SELECT conv_id, turn, unnest(list_distinct({words_sql("text")})) AS term FROM conversations), h AS (SELECT item_id, conv_id, turn, count(*) AS overlap FROM x JOIN c USING (term) GROUP BY ALL)
SELECT item_id, conv_id, turn, overlap, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, conv_id, turn) AS rank FROM h) WHERE rank <= 5""")
def reference_hits(spark, sf_dir):
    """The five turns of conversation that share most words with each item, by all words of both."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.array_distinct(T.identifier_words("text")).alias("words"))
    refs = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("ref"), T.identifier_words("text").alias("words"))
    return research.overlapping(q, refs).select(F.col("query").alias("item_id"), "ref.conv_id", "ref.turn", "overlap", "rank")


@query(
    "packed_evidence",
    """WITH RECURSIVE o AS (SELECT user_id AS packet, event_id AS question, event_id % 3 AS rank, length(event_type || ':' || event_id) + 3 AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3, event_id) AS k FROM events),
    p AS (SELECT packet, question, rank, k, size <= 400 AS kept, 400 - CASE WHEN size <= 400 THEN size ELSE 0 END AS room FROM o WHERE k = 1
      UNION ALL SELECT o.packet, o.question, o.rank, o.k, o.size <= p.room, p.room - CASE WHEN o.size <= p.room THEN o.size ELSE 0 END FROM p JOIN o ON o.packet = p.packet AND o.k = p.k + 1)
    SELECT packet, question, rank, kept FROM p""",
)
def packed_evidence(spark, sf_dir):
    """Each user's events as a packet of 400 bytes: summaries first, then two rounds of evidence."""
    body = F.concat_ws(":", "event_type", F.col("event_id").cast("string"))
    items = table(spark, sf_dir, "events").select(F.col("user_id").alias("packet"), F.col("event_id").alias("question"), (F.col("event_id") % 3).alias("rank"), body.alias("body"))
    return research.compact_packet(items, 400)


@query("code_leads", """WITH h AS (SELECT l_suppkey AS mechanism, l_orderkey * 10 + l_linenumber AS seq, l_returnflag AS corpus, l_partkey % 50 AS definition_id, l_linestatus AS source_id, 'q' || l_linenumber AS query FROM lineitem),
g AS (SELECT mechanism, corpus, definition_id, source_id, min(seq) AS first, max({'s': seq, 'q': query}).q AS query FROM h GROUP BY ALL)
SELECT mechanism, place, corpus, definition_id, source_id, query FROM (SELECT *, row_number() OVER (PARTITION BY mechanism ORDER BY first, corpus, definition_id, source_id) AS place FROM g) WHERE place <= 12""")
def code_leads(spark, sf_dir):
    """Order lines as search hits of their supplier: each candidate once, with its last route."""
    li = table(spark, sf_dir, "lineitem")
    h = li.select(F.col("l_suppkey").alias("mechanism"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_returnflag").alias("corpus"), (F.col("l_partkey") % 50).alias("definition_id"), F.col("l_linestatus").alias("source_id"), F.concat(F.lit("q"), "l_linenumber").alias("query"))
    return research.code_leads(h)


@query("excerpts", "SELECT doc_id, length(substr(text, 1, 192)) AS shown FROM documents")
def excerpts(spark, sf_dir):
    """Documents with an excerpt of 192 characters, as results are shown (the feature is the cut)."""
    return research.project(table(spark, sf_dir, "documents"), "text", 192).select("doc_id", F.length("text").cast("long").alias("shown"))
