"""Operators on small fixtures: known facts, edge cases, skew."""

import io
import json
import math
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.functions import canon as J
from lodestone.functions import direction
from lodestone.functions import text as T
from lodestone.operators import admission, evidence, graph, ledger, matching, opportunity, packing, ranking, retrieval
from lodestone.sources import code, containers, publish
from lodestone.streaming import ledger as stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, words",
    [("HTTPServer parseJSONValue", ["http", "server", "parse", "json", "value"]), ("", []), (None, []), ("the SHA256 of x", ["sha256", "x"])],
)
def test_identifier_words(spark, text, words):
    assert one(spark, T.identifier_words(F.lit(text).cast("string"))) == words


def test_symbol_query_and_locator(spark):
    ask = lambda s: tuple(one(spark, T.symbol_query(F.lit(s))))
    assert ask("symbol: run") == ("run", True)
    assert ask("a.b") == ("a.b", True)
    assert ask("plain") == ("plain", False)
    assert ask("two words") == ("two words", False)
    assert one(spark, T.locator(F.lit("HTTPS://Ex.COM/A?b#c"))) == "https://ex.com/A?b"


def test_bm25_term(spark):
    got = one(spark, retrieval.bm25(F.lit(2), F.lit(100), F.lit(100.0), F.lit(3.0)))
    assert math.isclose(got, 3 * 2 * 2.2 / 3.2)


def test_fusion(spark):
    r = spark.createDataFrame([("a", 1), ("b", 2), ("b", 1), ("a", 2)], "k string, rank long")
    assert {x.k: round(x.rrf, 12) for x in ranking.fuse(r, ["k"]).collect()} == {"a": round(1 / 61 + 1 / 62, 12), "b": round(1 / 61 + 1 / 62, 12)}


def test_copies_leave_search_unchanged(spark):
    rows = [("r1", "g1", "align rows", "alignment of rows"), ("r2", "g2", "other", "rows and rows"), ("r3", "g3", "none", "nothing")]
    more = rows + [(f"c{i}", "g2", "other", "rows and rows") for i in range(30)]
    fields = {"symbol": "name", "documentation": "doc"}
    run = lambda x: {r.group_id: (r.position, r.rrf, r.bm25) for r in retrieval.search(spark.createDataFrame(x, "row_id string, group_id string, name string, doc string"), fields, {"q": "align rows"}).collect()}
    assert run(rows) == run(more)


def test_global_rank_over_one_hot_group(spark):
    rng = random.Random(3)
    data = [(("hot" if i % 3 else f"k{i % 7}"), rng.randint(0, 40), i) for i in range(900)]
    df = spark.createDataFrame(data, "k string, v int, i int").repartition(7)
    got = {(r.k, r.i): r.n for r in ranking.global_rank(df, ["k"], [F.desc("v"), F.col("i")], "n").collect()}
    for k in {x[0] for x in data}:
        own = sorted((x for x in data if x[0] == k), key=lambda x: (-x[1], x[2]))
        assert [got[k, x[2]] for x in own] == list(range(1, len(own) + 1))


def test_components_match_union_find(spark):
    rng = random.Random(5)
    n = 120
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(60, n), rng.randrange(60, n)) for _ in range(35)]
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.id: r.root for r in graph.components(spark.range(n), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in range(n)}


def test_families_of_an_empty_table(spark):
    assert graph.families(spark.createDataFrame([], "i long, t string"), "i", ["t"]).count() == 0


def test_reachable(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "a long, b long")
    got = {(r.root, r.id): r.steps for r in graph.reachable(spark, edges, spark.createDataFrame([(1,)], "id long"), 8).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 2, (1, 4): 3}


def test_workflow_trace_is_not_retroactive(spark):
    w = [("w", ["a"], [("s1", ["b"], ["c"]), ("s2", ["a"], ["b"]), ("s3", ["c"], ["d"]), ("s4", ["b"], [])])]
    df = spark.createDataFrame(w, "workflow string, initial array<string>, steps array<struct<id: string, requires: array<string>, produces: array<string>>>")
    got = {r.step: (r.missing, r.status) for r in evidence.workflow_trace(df).collect()}
    assert got["s1"] == (["b"], "BLOCKED_BY_DECLARED_INPUTS")
    assert got["s2"] == ([], "INPUTS_DECLARED_NOT_EXECUTED")
    assert got["s3"][0] == ["c"]
    assert got["s4"][0] == []


def test_blocks_prefer_line_ends_and_rebuild(spark):
    text = "".join(f"line {i}\n" for i in range(400)) + "é" * 300
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "x" * 250)], "i long, t string")
    b = packing.blocks(df, "i", "t", 100)
    assert all(r.end - r.start <= 100 for r in b.collect())
    assert bytes(b.where("row_id = 1 AND block = 0").first().body).endswith(b"\n")
    got = {r.row_id: (r.bytes, r.code) for r in packing.rebuild(b).collect()}
    assert got == {1: (len(text.encode()), "OK"), 4: (250, "OK")}
    swapped = b.withColumn("block", F.when(F.col("row_id") == 4, 2 - F.col("block")).otherwise(F.col("block")))
    assert {r.code for r in packing.rebuild(swapped).where("row_id = 4").collect()} == {"SOURCE_BLOCK_ORDER"}
    torn = b.withColumn("body", F.when(F.col("row_id") == 4, F.lit(b"x")).otherwise(F.col("body")))
    assert {r.code for r in packing.rebuild(torn).where("row_id = 4").collect()} == {"SOURCE_BLOCK_HASH"}


def test_packing_skips_what_is_too_large(spark):
    df = spark.createDataFrame([(1, 60), (2, 50), (3, 30), (4, 20)], "i int, n int")
    assert [r["i"] for r in packing.fits(df, ["i"], [F.col("i")], "n", 100)] == [1, 3]


@pytest.mark.parametrize(
    "x, s",
    [(0.0, "0"), (-0.0, "0"), (1.0, "1"), (-1.5, "-1.5"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (1e-6, "0.000001"), (1e-7, "1e-7"), (333333333.3333333, "333333333.3333333"), (9007199254740994.0, "9007199254740994"), (5e-324, "5e-324"), (1.7976931348623157e308, "1.7976931348623157e+308"), (0.002, "0.002"), (123e-20, "1.23e-18")],
)
def test_es_numbers(x, s):
    assert J._es_number(x) == s


@pytest.mark.parametrize(
    "text, code",
    [('{"a":1}', "OK"), ('{"a":1,"a":2}', "DUPLICATE_JSON_KEY"), ("[1]", "OBJECT_REQUIRED"), ('{"a":NaN}', "NONFINITE_JSON"), ('{"a":9007199254740992}', "UNSAFE_INTEGER_USE_STRING"), ('{"a":1e-400}', "NUMBER_UNDERFLOW"), ("{", "INVALID_JSON_OR_UNICODE"), ("", "JSON_SIZE_LIMIT"), ('{"a":' + "[" * 70 + "]" * 70 + "}", "JSON_DEPTH_LIMIT"), ('{"a":"\\ud800"}', "INVALID_UNICODE"), (None, "NULL")],
)
def test_admission(spark, text, code):
    assert one(spark, J.admitted_json(F.lit(text).cast("string"))).code == code


def test_canonical_text(spark):
    assert one(spark, J.admitted_json(F.lit('{"€":1.0,"a":[true,null,"\\u000f\\n"]}'))).json == '{"a":[true,null,"\\u000f\\n"],"€":1}'
    assert one(spark, J.canonical_json(F.lit('{"b": 1, "a": "é"}'))).json == '{"a":"\\u00e9","b":1}'


def test_git_blob(spark):
    assert one(spark, J.git_blob_sha1(F.lit("hello\n"))) == "ce013625030ba8dba906f756967f9e9ca394464a"


def test_leases_and_verdicts(spark):
    t = spark.createDataFrame([("LEASED", 5, 1), ("LEASED", 5, 2), ("LEASED", 50, 1), ("DONE", None, 1)], "status string, expires int, attempts int")
    assert [r.next_status for r in ledger.attempts_left(t, F.lit(10)).collect()] == ["QUEUED", "FAILED", "LEASED", "DONE"]
    base = spark.createDataFrame([("a", True), ("b", False)], "c string, correct boolean")
    good = spark.createDataFrame([("a", True), ("b", True)], "c string, correct boolean")
    assert ledger.verdicts(base, good, "c", 1).first().status == "READY_FOR_ADOPTION_REVIEW"
    assert ledger.verdicts(good, base, "c", 1).first().status == "REJECTED"


def test_producing_steps(spark):
    steps = [("s1", ["a"], ["b"]), ("s2", ["x"], ["y"]), ("s3", ["b"], ["c"]), ("s4", ["c", "a"], [])]
    df = spark.createDataFrame([("w", "s4", ["a"], steps)], "workflow string, target string, initial array<string>, steps array<struct<id: string, requires: array<string>, produces: array<string>>>")
    assert [r.step for r in admission.producing_steps(df).collect()] == ["s4", "s3", "s1"]


def test_citations_that_move(spark):
    cols = "owner string, source string, start int, end int, quote string"
    old = spark.createDataFrame([("o", "a", 0, 3, "abc"), ("o", "b", 0, 2, "xy"), ("o", "c", 0, 1, "q"), ("o", "d", 0, 1, "z"), ("o", "e", 2, 4, "mm")], cols)
    new = spark.createDataFrame([("o", "a", 5, 8, "abc"), ("o", "b", 0, 2, "xy"), ("o", "e", 5, 7, "mm"), ("o", "a", 9, 10, "!")], cols)
    texts = "source string, uri string, text string"
    before = spark.createDataFrame([("a", "u", "abc"), ("b", "u", "xy"), ("c", "u", "q"), ("d", "u", "z"), ("e", "u", "..mmm")], texts)
    after = spark.createDataFrame([("a", "u", "-----abc ! "), ("b", "u", "xy"), ("d", "v", "z"), ("e", "u", ".....mm")], texts)
    got = {(r.source, r.start): r.status for r in opportunity.compare_citations(old, new, before, after).collect()}
    assert got[("a", 0)] == "MOVED" and got[("b", 0)] == "RETAINED" and got[("c", 0)] == "SOURCE_REMOVED" and got[("d", 0)] == "SOURCE_REPLACED"
    assert got[("e", 2)] == "OCCURRENCE_UNCERTAIN" and got[("a", 9)] == "NEW_CITATION" and ("a", 5) not in got


def test_direction(spark):
    assert direction.parse("convert rows to columns") == (["rows"], ["columns"])
    assert direction.parse("convert rows to columns and back") is None
    assert direction.parse("turn a into b from c") is None
    df = spark.createDataFrame([(["rows"], ["columns"], [("N", ["rows"], ["columns"])]), (["rows"], ["columns"], [("N", ["rows"], ["columns"]), ("D", ["columns"], ["rows"])]), (None, None, [("N", ["rows"], ["columns"])])], "i array<string>, o array<string>, d array<struct<basis: string, input: array<string>, output: array<string>>>")
    got = [r.x for r in df.select(direction.agreeing_declaration(F.col("i"), F.col("o"), F.col("d")).alias("x")).collect()]
    assert got[0].basis == "N" and got[1] is None and got[2] is None


def test_division_with_nulls(spark):
    rows = spark.createDataFrame([("x", 1, None), ("x", 2, None), ("y", 1, None), ("z", 1, True), ("z", 2, None)], "k string, v int, bad boolean")
    got = matching.divide(rows, "k", {"a": F.col("v") == 1, "b": F.col("v") == 2}, F.col("bad")).collect()
    assert [(r.k, r.evidence) for r in got] == [("x", 2)]


def test_definitions_calls_and_failures(spark):
    df = spark.createDataFrame([("s", "from a import b as c\nc(1)\ndef f():\n    c.d()\n"), ("n", None), ("bad", "x = (")], "source_id string, code string")
    assert {(r.scope, r.api) for r in code.calls(df).collect()} == {("<module>", "a.b"), ("f", "a.b.d")}
    assert [r.name for r in code.definitions(df).collect()] == ["f"]
    assert [r.source_id for r in code.failures(df).collect()] == ["bad"]


def test_containers(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.py", "x = 1\n")
        z.writestr("../up.py", "y = 1\n")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.py", "a = 1\n")
        z.writestr("in.zip", inner.getvalue())
        z.writestr("blob.bin", b"\0")
    (tmp_path / "n.ipynb").write_text(json.dumps({"metadata": {"language_info": {"name": "python"}}, "cells": [{"cell_type": "code", "source": ["p = 1\n"]}, {"cell_type": "markdown", "source": "x"}]}))
    files = containers.folder(spark, str(tmp_path))
    got = {(r.path.rsplit("/", 1)[-1], r.member, r.status) for r in containers.segments(files).collect()}
    assert got == {("a.zip", "one.py", "PYTHON_SEGMENT"), ("a.zip", "in.zip!deep.py", "PYTHON_SEGMENT"), ("a.zip", "in.zip!../up.py", "UNSAFE_MEMBER"), ("a.zip", "blob.bin", "NON_CODE_PAYLOAD_NOT_READ"), ("n.ipynb", "", "PYTHON_SEGMENT")}


def test_container_limits():
    def packed(body, name="x.zip", n=1):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for _ in range(n):
                z.writestr(name, body)
        return out.getvalue()

    deep = packed(packed(packed(packed(b"x = 1\n", "x.py"))))
    assert [r[6] for r in containers.read_container("d.zip", deep)] == ["DEPTH_LIMIT"]
    assert [r[6] for r in containers.read_container("r.zip", packed(b"#" * 1_000_000, "x.py"))] == ["RATIO_LIMIT"]
    assert [r[6] for r in containers.read_container("b.zip", b"no archive")] == ["INVALID_ARCHIVE"]
    assert [r[6] for r in containers.read_container("n.txt", b"plain words, no code")] == ["TEXT_CONTAINER_INSPECTED"]
    assert [r[2] for r in containers.read_container("n.txt", b"x = 1\n")] == ["python_text"]
    assert [r[6] for r in containers.read_container("node_modules/x.py", b"")] == ["DEPENDENCY_OR_GENERATED_EXCLUDED"]


def test_publish_and_tamper(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, t string")
    at = str(tmp_path / "t")
    publish.publish(df, at)
    assert publish.read_published(spark, at, df.schema).count() == 2
    with pytest.raises(Exception):
        publish.publish(df, at)
    df.limit(1).write.mode("append").parquet(f"{at}/data")
    with pytest.raises(ValueError, match="RECEIPT_MISMATCH"):
        publish.read_published(spark, at, df.schema)


def test_streamed_ledger(spark, tmp_path):
    df = spark.createDataFrame([("j", k, "A" if k < 3 else "B") for k in range(5)], "job string, seq long, kind string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    s = stream.latest_states(stream.read_events(spark, str(tmp_path / "in"), df.schema, 1), "job", "seq", "kind")
    q = s.writeStream.outputMode("complete").format("memory").queryName("latest_jobs").start()
    try:
        q.processAllAvailable()
        assert [tuple(r) for r in spark.table("latest_jobs").collect()] == [("j", 4, "B")]
    finally:
        q.stop()


def brute_trace(initial, steps):
    """Each step's missing fields, the inputs that they go back to, and the outputs that it can't confirm."""
    have, pending, out = set(initial), {}, []
    for name, requires, produces in steps:
        absent = set(requires) - have
        roots = set()
        for f in absent:
            roots |= pending.get(f, {f})
        out.append((name, sorted(absent), sorted(roots), sorted(set(produces) - have) if absent else []))
        for f in produces:
            if absent and f not in have:
                pending[f] = pending.get(f, set()) | roots
            if not absent:
                have.add(f)
                pending.pop(f, None)
    return out


def test_workflow_roots_against_brute_force(spark):
    rng = random.Random(3)
    pick = lambda n: [f"f{rng.randint(0, 9)}" for _ in range(rng.randint(0, n))]
    flows = [(k, sorted(set(pick(3))), [(f"s{i}", pick(3), pick(3)) for i in range(rng.randint(1, 9))]) for k in range(60)]
    df = spark.createDataFrame(flows, "workflow long, initial array<string>, steps array<struct<id:string,requires:array<string>,produces:array<string>>>")
    got = {}
    for r in evidence.workflow_trace(df).collect():
        got.setdefault(r.workflow, []).append((r.step, r.missing, r.roots, r.unconfirmed))
    for k, initial, steps in flows:
        assert sorted(got[k]) == sorted(brute_trace(initial, steps)), steps


def test_blocks_end_where_a_greedy_cut_would(spark):
    from lodestone.operators import packing

    rng = random.Random(5)
    texts = ["".join(rng.choice("ab\n é") for _ in range(rng.randint(0, 300))) for _ in range(80)] + ["x" * 100, "\n" * 50, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    ends = {}
    for r in packing.blocks(df, "row", "text", 32).collect():
        ends.setdefault(r.row_id, []).append((r.start, r.end))
    for k, t in enumerate(texts):
        data, at, want = t.encode(), 0, []
        while at < len(data):
            end = min(at + 32, len(data))
            if end < len(data):
                cut = data.rfind(b"\n", at, end)
                end = cut + 1 if cut >= at else end
            want.append((at, end))
            at = end
        assert sorted(ends.get(k, [])) == want, t


def test_lint_with_look_around_against_python(spark):
    texts = ['password = "longenough1"', "x_password: 'longenough2'", "mail a.b@host.com or c@example.com", "/home/user/x and a/home/user", "C:\\Users\\me\\x", "token='short'", '{"api_key": "0123456789"}', None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    got = {(r.row, x.rule): x.n for r in df.select("row", T.lint_hits("text").alias("h")).collect() for x in r.h}
    want = {(k, rule): n for k, t in enumerate(texts) for rule, p in T.LINT.items() if (n := len(list(re.finditer(p, t or ""))))}
    assert got == want and len(want) >= 5


def test_cycles_of_any_length_and_approved_spans(spark):
    n = 40
    ring = [(i, (i + 1) % n) for i in range(n)] + [(100, 0), (n // 2, 200), (300, 300), (400, 401), (401, 402)]
    got = {r.id for r in admission.on_cycles(spark.createDataFrame(ring, "a long, b long")).collect()}
    assert got == {*range(n), 300}
    assert admission.on_cycles(spark.createDataFrame([], "a long, b long")).count() == 0
    rng = random.Random(8)
    span = lambda: (rng.choice("ppq"), a := rng.randint(0, 60), a + rng.randint(0, 12))
    found, approved = [(k, *span()) for k in range(300)], [span() for _ in range(60)]
    left = admission.outside_approved(spark.createDataFrame(found, "id long, path string, start long, end long"), spark.createDataFrame(approved, "path string, start long, end long")).collect()
    want = {k for k, p, s, e in found if not any(p == q and a <= s and e <= b for q, a, b in approved)}
    assert {r.id for r in left} == want and 0 < len(want) < 300


def test_references_in_blocks_and_packets(spark, monkeypatch):
    from lodestone.operators import research

    rng = random.Random(9)
    words = lambda n: [rng.choice("abcdefghijkl") for _ in range(n)]
    queries, refs = [(k, sorted(set(words(5)))) for k in range(30)], [(k, words(6)) for k in range(200)]
    q, r = spark.createDataFrame(queries, "query long, words array<string>"), spark.createDataFrame(refs, "ref long, words array<string>").repartition(5)
    want = set()
    for k, w in queries:
        hits = sorted(((-len(set(w) & set(x)), i) for i, x in refs if set(w) & set(x)))[:5]
        want |= {(k, i, -n, rank) for rank, (n, i) in enumerate(hits, 1)}
    for block in (7, 4096):
        monkeypatch.setattr(research, "QUERY_BLOCK", block)
        assert {tuple(x) for x in research.overlapping(q, r).select("query", "ref", "overlap", "rank").collect()} == want
    assert research.overlapping(q.where("false"), r).count() == 0


def test_scopes_of_odd_modules():
    from lodestone.sources import scopes

    code = "from x import *\ndef f[T](a: T = q):\n    nonlocal_ = a\n    def g():\n        global h\n        h = 1\n        return h\n    return [y for y in a]\nclass C:\n    z = 1\n    def m(self):\n        return z\ntry:\n    pass\nexcept E as e:\n    del e\nmatch 1:\n    case {'k': v, **rest}:\n        pass\n"
    reads = {(r[1], r[3]): r[6] for r in scopes.read_rows("m", code)}
    assert reads["f", "a"] in ("LEXICAL_BINDING_CANDIDATE", "COMPREHENSION_SCOPE_UNRESOLVED")
    assert reads["<module>", "q"] == "DECLARATION_SCOPE_UNRESOLVED"
    assert reads["C.m", "z"] == "WILDCARD_IMPORT_BINDING_UNRESOLVED"
    kinds = {(b[3], b[5]) for b in scopes.binding_rows("m", code)}
    assert {("e", "exception_target"), ("v", "pattern_capture"), ("rest", "pattern_capture"), ("e", "delete")} <= kinds
    assert not list(scopes.read_rows("m", "def broken(:")) and not list(scopes.site_rows("m", None))
