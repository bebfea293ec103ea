"""Research questions: full-text search over three fields, fusion of two channels, references, budgeted packets."""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.control import first_code
from lodestone.operators.ranking import cut, top_rows

# Field weights and constants of the full-text ranking; the fusion constant; query limits.
WEIGHTS, K1, B, LEAST_IDF, RRF_K = {"symbol": 4.0, "classdoc": 1.0, "source": 1.0}, 1.2, 0.75, 1e-6, 60
MOST_TERMS, MOST_CHARACTERS = 32, 200
#: Queries that a task looks for at once.
QUERY_BLOCK = 4096


def question_codes(query: Column) -> Column:
    """Whether a question may be asked: its length and its distinct terms."""
    terms = F.array_distinct(T.identifier_words(query))
    return first_code(("QUERY_TEXT", F.coalesce(F.length(F.trim(query)), F.lit(0)) == 0), ("QUERY_LENGTH", F.length(query) > MOST_CHARACTERS), ("QUERY_TERMS_REQUIRED", F.size(terms) == 0), ("QUERY_TERM_LIMIT", F.size(terms) > MOST_TERMS), otherwise="ADMITTED")


def lexical_search(records: DataFrame, queries: dict[str, str], limit: int = 10) -> DataFrame:
    """(query_id, position, id, matched, exact, score): records (id, name, symbol, classdoc, source, path, start_line) that hold any query
    term, by exact symbol, matched terms, score, path and line.

    The score is full-text BM25 over the weighted sum of a term's frequencies in the three fields; records are dealt by id once, so
    only lengths and query terms leave a row."""
    spark = records.sparkSession
    q = spark.createDataFrame(sorted(queries.items()), "query_id string, query string")
    terms = cut(q.select("query_id", F.trim("query").alias("query"), F.explode(F.array_distinct(T.question_terms("query"))).alias("term")))
    wanted = [r[0] for r in terms.select("term").distinct().collect()]
    words = {f: T.question_terms(f) for f in WEIGHTS}
    length = sum((F.size(w) for w in words.values()), F.lit(0))
    weighted = lambda words, weight: F.transform(F.filter(words, lambda x: x.isin(wanted)), lambda x: F.struct(x.alias("term"), F.lit(weight).alias("weight")))
    each = F.explode(F.concat(*[weighted(words[f], w) for f, w in WEIGHTS.items()])).alias("h")
    r = records.repartition("id").withColumn("length", length)
    total = r.agg(F.count("*").alias("n"), F.avg("length").alias("average"))
    hits = r.select("id", "length", each).groupBy("id", "length", "h.term").agg(F.sum("h.weight").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    # one row for each query term
    df = df.crossJoin(F.broadcast(total)).select("term", idf.alias("idf"), "average")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    s = hits.join(F.broadcast(df), "term").join(F.broadcast(terms), "term").groupBy("query_id", "query", "id").agg(F.count("*").alias("matched"), F.sum(part).alias("score"))
    s = s.join(records.select("id", "name", "path", "start_line"), "id")
    s = s.withColumn("exact", (F.col("query") == F.col("name")) | (F.col("query") == F.substring_index("name", ".", -1)))
    order = [F.desc("exact"), F.desc("matched"), F.desc(F.round("score", 9)), F.col("path"), F.col("start_line"), F.col("id")]
    top = top_rows(s, ["query_id"], order, limit, "position")
    return top.select("query_id", F.col("position").cast("long").alias("position"), "id", F.col("matched").cast("long").alias("matched"), "exact", F.round("score", 6).alias("score"))


def fuse_channels(channels: dict[str, DataFrame], observed: DataFrame, required: DataFrame, limit: int = 5) -> DataFrame:
    """(query_id, position, id, channels, rrf, matched, full): hits (query_id, position, id, matched, wanted, exact) of several channels.

    Only records with the API that a query requires (required: query_id, api; observed: id, observed_apis) take part; ranks are
    those before. All terms first, then matches, exact symbols and fused ranks."""
    all_hits = None
    for name, hits in sorted(channels.items()):
        h = hits.select("query_id", "position", "id", "matched", "wanted", "exact", F.lit(name).alias("channel"))
        all_hits = h if all_hits is None else all_hits.union(h)
    j = all_hits.join(F.broadcast(required), "query_id", "left").join(observed, "id", "left")
    ok = F.col("api").isNull() | F.coalesce(F.array_contains("observed_apis", F.col("api")), F.lit(False))
    g = j.where(ok).groupBy("query_id", "id").agg(F.array_sort(F.collect_set("channel")).alias("channels"), F.sum(F.lit(1.0) / (RRF_K + F.col("position"))).alias("rrf"), F.max("matched").alias("matched"), F.max("wanted").alias("wanted"), F.max("exact").alias("exact"))
    g = g.withColumn("full", F.col("matched") == F.col("wanted"))
    top = top_rows(g, ["query_id"], [F.desc("full"), F.desc("matched"), F.desc("exact"), F.desc(F.round("rrf", 12)), F.col("id")], limit, "position")
    return top.select("query_id", F.col("position").cast("long").alias("position"), "id", "channels", F.round("rrf", 9).alias("rrf"), "matched", "full")


def question_status(questions: DataFrame, fused: DataFrame, references: DataFrame, gaps: DataFrame) -> DataFrame:
    """(query_id, status, next_action) of each question: what its results amount to."""
    f = fused.groupBy("query_id").agg(F.max("full").alias("full"), F.max(F.when(F.col("position") == 1, F.col("matched"))).alias("best"), F.max(F.when(F.col("position") == 1, F.col("full"))).alias("all"))
    r = references.select("query_id").distinct().withColumn("referenced", F.lit(True))
    g = gaps.select("query_id").distinct().withColumn("gap", F.lit(True))
    j = questions.join(f, "query_id", "left").join(r, "query_id", "left").join(g, "query_id", "left")
    some = F.col("full").isNotNull()
    status = first_code(("STATIC_LEADS_REVIEW_REQUIRED", F.col("full")), ("PARTIAL_QUERY_ONLY", some), ("REFERENCE_OR_TEXT_ONLY", F.col("referenced")), ("EVALUATION_BLOCKED", F.col("gap")), otherwise="NO_EVIDENCE_IN_SELECTED_SOURCES")
    refine = some & ~F.col("all") & ((F.col("best") == 1) | (2 * F.col("best") < F.col("wanted")))
    action = first_code(("INSPECT_SOURCE_OR_REFINE_QUERY", refine), ("REVIEW_EVIDENCE_AND_DECLARE_BEHAVIOR_TEST", some), otherwise="ACQUIRE_ADDITIONAL_PERMITTED_EVIDENCE")
    return j.select("query_id", status.alias("status"), action.alias("next_action"))


def overlapping(queries: DataFrame, refs: DataFrame, limit: int = 5) -> DataFrame:
    """(query, ref, overlap, rank): of each query (query, words) the references (ref, words) with most words in common, ties by ref.

    Queries are taken block by block; a task keeps the best `limit` of each query only, so what is shuffled is at most limit rows a
    query and task, however many references share a common word."""
    spark = queries.sparkSession
    kind, query = refs.schema["ref"].dataType.simpleString(), queries.schema["query"].dataType.simpleString()
    n = queries.count()
    blocks = -(-n // QUERY_BLOCK)
    out = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        held = [(r["query"], frozenset(r["words"])) for r in part.select("query", "words").collect()]
        found = refs.select("ref", "words").mapInArrow(_best(held, limit), f"query {query}, ref {kind}, overlap long")
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], f"query {query}, ref {kind}, overlap long, rank int")
    return top_rows(out, ["query"], [F.desc("overlap"), F.col("ref")], limit)


class _Later:
    """Orders references the other way round, so that a heap drops the last of equal ones."""

    __slots__ = ("ref",)

    def __init__(self, ref):
        self.ref = ref

    def __lt__(self, other):
        return other.ref < self.ref


def _best(queries, limit: int):
    def run(batches):
        index: dict[str, list[int]] = {}
        for k, (_, words) in enumerate(queries):
            for w in words:
                index.setdefault(w, []).append(k)
        heaps: list[list] = [[] for _ in queries]
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for ref, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                r = tuple(ref.values()) if isinstance(ref, dict) else ref
                count: dict[int, int] = {}
                for w in set(words or ()):
                    for k in index.get(w, ()):
                        count[k] = count.get(k, 0) + 1
                for k, c in count.items():
                    item = (c, _Later(r), ref)
                    if len(heaps[k]) < limit:
                        heapq.heappush(heaps[k], item)
                    elif item[:2] > heaps[k][0][:2]:
                        heapq.heapreplace(heaps[k], item)
        rows = [(queries[k][0], x[2], x[0]) for k, h in enumerate(heaps) for x in h]
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string() if queries and isinstance(queries[0][0], str) else pa.int64()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())], ["query", "ref", "overlap"])

    return run


def compact_packet(items: DataFrame, most: int) -> DataFrame:
    """(packet, question, rank, kept) of a packet's entries: all summaries (rank 0) first, then evidence in rounds of rank, question by
    question, as long as an entry's JSON fits into `most` bytes. One that is too large is skipped, later ones may fit.

    items: packet, question, rank, body. A packet's entries are read as a stream in order; only the bytes left are held."""
    kind = items.schema["packet"].dataType.simpleString()

    def run(batches):
        at, left = None, 0
        for batch in batches:
            kept = []
            for packet, body in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if packet != at:
                    at, left = packet, most
                size = len(json.dumps(body, ensure_ascii=True)) + 1
                kept.append(size <= left)
                left -= size if kept[-1] else 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(kept, pa.bool_())], ["packet", "question", "rank", "kept"])

    dealt = items.select("packet", F.col("question").cast("long"), F.col("rank").cast("long"), "body").repartition("packet").sortWithinPartitions("packet", "rank", "question")
    return dealt.mapInArrow(run, f"packet {kind}, question long, rank long, kept boolean")


def project(records: DataFrame, text: str, most: int = 1600) -> DataFrame:
    """Records with their text cut to an excerpt for display."""
    return records.withColumn(text, F.substring(text, 1, most))


def code_leads(hits: DataFrame, limit: int = 12) -> DataFrame:
    """(mechanism, place, corpus, definition_id, source_id, query): hits (mechanism, seq, corpus, definition_id, source_id, query), each
    candidate once: at the place of its first hit, with the query of its last."""
    keys = ["mechanism", "corpus", "definition_id", "source_id"]
    g = hits.groupBy(*keys).agg(F.min("seq").alias("first"), F.max(F.struct("seq", "query"))["query"].alias("query"))
    return top_rows(g, ["mechanism"], [F.col("first"), *map(F.col, keys[1:])], limit, "place").select("mechanism", F.col("place").cast("long").alias("place"), "corpus", "definition_id", "source_id", "query")
