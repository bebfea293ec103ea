"""Queries over Python source, on the modules that plans.modules makes from the rows of `part`."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import direction
from lodestone.operators import context, linking, retrieval
from lodestone.operators.ranking import cut
from lodestone.plans import modules as M
from lodestone.plans import text_queries as T
from lodestone.sources import code as C
from lodestone.sources import containers, scopes

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


# Profile of the probe: API and capability.
PROFILE = [("hashlib.sha256", "digest"), ("json.loads", "parse"), ("json.dumps", "write"), ("os.path.join", "path")]
ONE, FREE = scopes.ONE, scopes.FREE


def profile(spark):
    return spark.createDataFrame(PROFILE, "api string, capability string")


def code(spark, sf_dir):
    return M.modules(spark, sf_dir).select("source_id", "code")


@query(
    "python_definitions",
    M.expected(
        "name start_line definition_line end_line parameters doc",
        {
            0: [
                ("digest_{k}", 4, 4, 6, ["data", "name"], "Convert data to digest."),
                ("Store{k}.save", 9, 10, 11, ["self", "rows"], ""),
                ("Store{k}.check", 12, 12, 15, ["self", "rows", "**kw"], ""),
                ("Store{k}.check.inner", 13, 13, 14, ["x"], ""),
            ],
            1: [("use_{k}", 4, 4, 8, ["value"], "")],
            2: [("restore_{k}", 4, 4, 7, ["text"], "")],
            4: [("Base{k}.run", 2, 2, 3, ["self", "n"], ""), ("Base{k}.__call__", 4, 4, 5, ["self"], ""), ("Child{k}.__init__", 8, 8, 10, ["self", "n"], ""), ("Child{k}.count", 11, 11, 14, ["self", "n"], "")],
            6: [("late_{k}", 4, 4, 8, ["items", "most"], "")],
            7: [("rows_{k}_to_table", 1, 1, 3, ["rows"], "Turn rows into a table."), ("table_from_rows", 5, 5, 7, ["rows"], "Render no rows.")],
        },
    ),
)
def python_definitions(spark, sf_dir):
    return C.definitions(code(spark, sf_dir)).drop("sha256")


@query(
    "python_imports",
    M.expected(
        "binding target line",
        {
            0: [("hashlib", "hashlib", 1), ("p", "os.path", 2)],
            1: [("digest_{a}", "m{a}.digest_{a}", 1), ("other", "m{b}", 2)],
            2: [("h", "hashlib", 1), ("json", "json", 2)],
            5: [("json", "json", 1)],
            6: [("restore_{c}", ".m{c}.restore_{c}", 1), ("json", "json", 7)],
        },
    ),
)
def python_imports(spark, sf_dir):
    return C.imports(code(spark, sf_dir))


@query("parse_failures", M.expected("code", {3: [("PYTHON_SYNTAX",)]}))
def parse_failures(spark, sf_dir):
    return C.failures(code(spark, sf_dir))


_PROBED = {
    0: [("digest_{k}", "hashlib.sha256", "digest", 6), ("Store{k}.check.inner", "os.path.join", "path", 14)],
    2: [("restore_{k}", "json.loads", "parse", 5)],
    5: [("<module>", "json.dumps", "write", 2)],
}


@query("api_probe", M.expected("scope api capability line", _PROBED))
def api_probe(spark, sf_dir):
    """Observed calls of a profile's APIs; a name that is bound again elsewhere gives none."""
    return C.probe(code(spark, sf_dir), profile(spark)).select("source_id", "scope", "api", "capability", "line")


@query("coverage_by_source", "WITH p AS (" + M.expected("scope api", {k: [r[:2] for r in v] for k, v in _PROBED.items()}) + """), n AS (SELECT source_id, count(*) AS findings FROM p GROUP BY 1), m AS (""" + M.expected("state", {k: [("BLOCKED" if k == 3 else "SCANNED",)] for k in range(M.KINDS)}) + """)
SELECT m.source_id, CASE WHEN state = 'BLOCKED' THEN 'BLOCKED' WHEN findings > 0 THEN 'FINDINGS' ELSE 'NO_FINDING' END AS coverage, coalesce(findings, 0) AS findings FROM m LEFT JOIN n ON n.source_id = m.source_id""")
def coverage_by_source(spark, sf_dir):
    """Every source with what the hunt did with it; no source is left out."""
    m = code(spark, sf_dir)
    return C.coverage(m, C.probe(m, profile(spark)))


@query("role_probe", "SELECT * FROM (VALUES " + ", ".join(f"('{api}', '{'reader' if i % 2 else 'writer'}')" for i, (api, _) in enumerate(PROFILE)) + ") r(api, role) JOIN (" + M.expected("scope api capability line", _PROBED) + ") USING (api)")
def role_probe(spark, sf_dir):
    """Several profiles over the same sources in one pass: each observation with the role that asked for it."""
    roles = {role: [x for i, x in enumerate(PROFILE) if ("reader" if i % 2 else "writer") == role] for role in ("reader", "writer")}
    got = C.probe_roles(code(spark, sf_dir), roles)
    return got.select("api", "role", "source_id", "scope", "capability", "line")


@query("validated_findings", "SELECT source_id, api, line, CASE WHEN line % 3 = 0 THEN 'SPAN_MISMATCH' WHEN source_id LIKE '%2.py' THEN 'SOURCE_DIGEST_MISMATCH' ELSE 'VALID' END AS code FROM (" + M.expected("scope api capability line", _PROBED) + ")")
def validated_findings(spark, sf_dir):
    """Findings held against the sources again, after some lines and some digests were changed on purpose."""
    m = code(spark, sf_dir)
    p = C.probe(m, profile(spark))
    wrong = F.col("source_id").like("%2.py")
    sha = m.select("source_id", F.sha2("code", 256).alias("sha256"))
    claimed = p.join(sha, "source_id").withColumn("sha256", F.when(wrong, F.lit("0" * 64)).otherwise(F.col("sha256")))
    claimed = claimed.withColumn("claimed_line", F.when(F.col("line") % 3 == 0, F.col("line") + 1000).otherwise(F.col("line")))
    claims = claimed.select("source_id", "sha256", "scope", "api", "capability", F.col("claimed_line").alias("line"), F.col("line").alias("true_line"))
    return C.validate_findings(claims, m, profile(spark)).select("source_id", "api", F.col("true_line").alias("line"), "code")


@query("remaining_sources", "SELECT source_id, CASE WHEN p_size % 3 = 0 THEN 'CACHED' WHEN p_size % 3 = 1 THEN 'ALTERED' ELSE 'NEW' END AS state FROM (" + " UNION ALL ".join(f"SELECT replace(replace('{path}', '{{k}}', p_partkey::VARCHAR), '{{n}}', (p_partkey // 16)::VARCHAR) AS source_id, p_size FROM part WHERE p_partkey % {M.KINDS} = {kind}" for kind, path in enumerate(M.PATHS)) + ") WHERE p_size % 3 <> 0")
def remaining_sources(spark, sf_dir):
    """What a resumed hunt still has to scan: sources without a stored result, and those whose bytes have changed since."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_size", M.source_path().alias("source_id"))
    m = code(spark, sf_dir).withColumn("sha256", F.sha2("code", 256))
    stored = m.join(part, "source_id").where("p_size % 3 <> 2").select("source_id", F.when(F.col("p_size") % 3 == 1, F.lit("changed")).otherwise(F.col("sha256")).alias("sha256"))
    return C.remaining(m, stored)


@query(
    "observed_functions",
    M.expected(
        "name observed_apis",
        {
            0: [("digest_{k}", ["hashlib.sha256"]), ("Store{k}.save", []), ("Store{k}.check", []), ("Store{k}.check.inner", ["os.path.join"])],
            1: [("use_{k}", [])],
            2: [("restore_{k}", ["json.loads"])],
            4: [("Base{k}.run", []), ("Base{k}.__call__", []), ("Child{k}.__init__", []), ("Child{k}.count", [])],
            6: [("late_{k}", [])],
            7: [("rows_{k}_to_table", []), ("table_from_rows", [])],
        },
    ),
)
def observed_functions(spark, sf_dir):
    return C.function_rows(code(spark, sf_dir), profile(spark)).select("source_id", "name", "observed_apis")


_SCOPE_ROWS = {5: [("<module>", ["json.dumps"])]}


@query("source_scopes", M.expected("name observed_apis", _SCOPE_ROWS))
def source_scopes(spark, sf_dir):
    """Scripts: modules whose own statements are observed, or that define nothing but do something."""
    return C.source_rows(code(spark, sf_dir), profile(spark)).select("source_id", "name", "observed_apis")


@query("record_kinds", "SELECT record_kind, test_path, count(*) AS rows FROM (" + "SELECT 'function' AS record_kind, source_id LIKE '%/tests/%' AS test_path FROM (" + M.expected("n", {0: [(i,) for i in range(4)], 1: [(0,)], 2: [(0,)], 4: [(i,) for i in range(4)], 6: [(0,)], 7: [(0,), (1,)]}) + ") UNION ALL SELECT 'source_scope', FALSE FROM (" + M.expected("n", {5: [(0,)]}) + ")) GROUP BY ALL")
def record_kinds(spark, sf_dir):
    """Function rows and source rows as one frame, by kind."""
    both = C.all_rows(code(spark, sf_dir), profile(spark))
    return both.groupBy("record_kind", F.col("source_id").contains("/tests/").alias("test_path")).agg(F.count("*").alias("rows"))


@query(
    "definition_coverage",
    "SELECT namespace, count(*) AS sources, count(*) FILTER (kind <> 3) AS parsed, sum(n) AS definitions, sum(o) AS with_observations, CASE WHEN bool_or(kind = 3) THEN 'COMPLETED_WITH_GAPS' ELSE 'COMPLETED_FOR_SELECTED_CONTAINERS' END AS status FROM "
    f"(SELECT 'box' || (p_partkey // 16) AS namespace, p_partkey % {M.KINDS} AS kind, [4, 1, 1, 0, 4, 0, 1, 2][p_partkey % {M.KINDS} + 1] AS n, [2, 0, 1, 0, 0, 0, 0, 0][p_partkey % {M.KINDS} + 1] AS o FROM part) GROUP BY 1",
)
def definition_coverage(spark, sf_dir):
    """What was read of each namespace: sources, definitions, those with observations, and whether there are gaps."""
    m = M.modules(spark, sf_dir)
    return C.coverage_report(m, profile(spark))


@query(
    "name_bindings",
    M.expected(
        "scope name line kind module symbol level",
        {
            0: [
                ("<module>", "hashlib", 1, "import", "hashlib", None, 0),
                ("<module>", "p", 2, "from_import", "os", "path", 0),
                ("<module>", "digest_{k}", 4, "function", None, None, 0),
                ("<module>", "Store{k}", 8, "class", None, None, 0),
                ("Store{k}", "save", 10, "function", None, None, 0),
                ("Store{k}", "check", 12, "function", None, None, 0),
                ("Store{k}.check", "inner", 13, "function", None, None, 0),
            ],
            1: [("<module>", "digest_{a}", 1, "from_import", "m{a}", "digest_{a}", 0), ("<module>", "other", 2, "import", "m{b}", None, 0), ("<module>", "use_{k}", 4, "function", None, None, 0)],
            2: [
                ("<module>", "h", 1, "import", "hashlib", None, 0),
                ("<module>", "json", 2, "import", "json", None, 0),
                ("<module>", "restore_{k}", 4, "function", None, None, 0),
                ("restore_{k}", "value", 5, "assignment", None, None, 0),
                ("restore_{k}", "h", 6, "assignment", None, None, 0),
            ],
            4: [
                ("<module>", "Base{k}", 1, "class", None, None, 0),
                ("<module>", "Child{k}", 7, "class", None, None, 0),
                ("Base{k}", "run", 2, "function", None, None, 0),
                ("Base{k}", "__call__", 4, "function", None, None, 0),
                ("Child{k}", "__init__", 8, "function", None, None, 0),
                ("Child{k}", "count", 11, "function", None, None, 0),
                ("Child{k}.count", "TOTAL", 13, "assignment", None, None, 0),
            ],
            5: [("<module>", "json", 1, "import", "json", None, 0)],
            6: [
                ("<module>", "restore_{c}", 1, "from_import", "m{c}", "restore_{c}", 1),
                ("<module>", "LIMIT", 2, "assignment", None, None, 0),
                ("<module>", "late_{k}", 4, "function", None, None, 0),
                ("late_{k}", "json", 7, "import", "json", None, 0),
            ],
            7: [("<module>", "rows_{k}_to_table", 1, "function", None, None, 0), ("<module>", "table_from_rows", 5, "function", None, None, 0)],
        },
    ),
)
def name_bindings(spark, sf_dir):
    """What each scope binds, parameters aside."""
    return scopes.bindings(code(spark, sf_dir)).where("kind <> 'parameter'").drop("scope_kind")


@query(
    "name_reads",
    M.expected(
        "scope name line status site_scope site_line site_kind",
        {
            0: [
                ("digest_{k}", "hashlib", 6, ONE, "<module>", 1, "import"),
                ("digest_{k}", "data", 6, ONE, "digest_{k}", 4, "parameter"),
                ("Store{k}", "staticmethod", 9, FREE, None, None, None),
                ("Store{k}.save", "self", 11, ONE, "Store{k}.save", 10, "parameter"),
                ("Store{k}.save", "rows", 11, ONE, "Store{k}.save", 10, "parameter"),
                ("Store{k}.check", "inner", 15, ONE, "Store{k}.check", 13, "function"),
                ("Store{k}.check", "rows", 15, ONE, "Store{k}.check", 12, "parameter"),
                ("Store{k}.check.inner", "p", 14, ONE, "<module>", 2, "from_import"),
                ("Store{k}.check.inner", "x", 14, ONE, "Store{k}.check.inner", 13, "parameter"),
            ],
            1: [
                ("use_{k}", "digest_{a}", 5, ONE, "<module>", 1, "from_import"),
                ("use_{k}", "other", 6, ONE, "<module>", 2, "import"),
                ("use_{k}", "missing_{k}", 7, FREE, None, None, None),
                ("use_{k}", "len", 8, FREE, None, None, None),
                *[("use_{k}", "value", line, ONE, "use_{k}", 4, "parameter") for line in (5, 6, 7, 8)],
            ],
            2: [
                ("restore_{k}", "json", 5, ONE, "<module>", 2, "import"),
                ("restore_{k}", "text", 5, ONE, "restore_{k}", 4, "parameter"),
                ("restore_{k}", "value", 6, ONE, "restore_{k}", 5, "assignment"),
                ("restore_{k}", "h", 7, ONE, "restore_{k}", 6, "assignment"),
                ("restore_{k}", "text", 7, ONE, "restore_{k}", 4, "parameter"),
            ],
            4: [
                ("<module>", "Base{k}", 7, ONE, "<module>", 1, "class"),
                ("Base{k}.run", "NotImplementedError", 3, FREE, None, None, None),
                ("Base{k}.__call__", "self", 5, ONE, "Base{k}.__call__", 4, "parameter"),
                ("Child{k}.__init__", "super", 9, FREE, None, None, None),
                ("Child{k}.__init__", "n", 9, ONE, "Child{k}.__init__", 8, "parameter"),
                ("Child{k}.__init__", "super", 10, FREE, None, None, None),
                ("Child{k}.__init__", "n", 10, ONE, "Child{k}.__init__", 8, "parameter"),
                ("Child{k}.count", "n", 13, ONE, "Child{k}.count", 11, "parameter"),
                ("Child{k}.count", "TOTAL", 14, "REDIRECTED_BINDING_EFFECT_UNRESOLVED", None, None, None),
                ("Child{k}.count", "n", 14, ONE, "Child{k}.count", 11, "parameter"),
            ],
            5: [("<module>", "print", 2, FREE, None, None, None), ("<module>", "json", 2, ONE, "<module>", 1, "import")],
            6: [
                ("<module>", "LIMIT", 4, ONE, "<module>", 2, "assignment"),
                ("<module>", "int", 4, FREE, None, None, None),
                ("late_{k}", "restore_{c}", 5, ONE, "<module>", 1, "from_import"),
                ("late_{k}", "items", 5, ONE, "late_{k}", 4, "parameter"),
                ("late_{k}", "json", 6, ONE, "late_{k}", 7, "import"),
                ("late_{k}", "items", 6, ONE, "late_{k}", 4, "parameter"),
                *[("late_{k}", name, 8, "COMPREHENSION_SCOPE_UNRESOLVED", None, None, None) for name in ("cut_{k}", "i", "items")],
            ],
            7: [
                ("<module>", "Rows", 1, FREE, None, None, None),
                ("<module>", "Table", 1, FREE, None, None, None),
                ("rows_{k}_to_table", "rows", 3, ONE, "rows_{k}_to_table", 1, "parameter"),
                ("table_from_rows", "rows", 7, ONE, "table_from_rows", 5, "parameter"),
            ],
        },
    ),
)
def name_reads(spark, sf_dir):
    """What each read of a name may be bound by, and why it can't be told."""
    return scopes.reads(code(spark, sf_dir)).select("source_id", "scope", "name", "line", "status", "site_scope", "site_line", "site_kind")


@query(
    "declared_inputs",
    M.expected(
        "name kind parameter line symbol reads statuses",
        {
            0: [("digest_{k}", "keyword_default", "name", 4, None, [], []), ("Store{k}.save", "decorator", None, 9, "staticmethod", ["staticmethod"], [FREE])],
            4: [("Child{k}", "class_base", None, 7, "Base{k}", ["Base{k}"], [ONE])],
            6: [("late_{k}", "positional_default", "most", 4, "LIMIT", ["LIMIT"], [ONE]), ("late_{k}", "parameter_annotation", "most", 4, "int", ["int"], [FREE])],
            7: [("rows_{k}_to_table", "parameter_annotation", "rows", 1, "Rows", ["Rows"], [FREE]), ("rows_{k}_to_table", "return_annotation", None, 1, "Table", ["Table"], [FREE])],
        },
    ),
)
def declared_inputs(spark, sf_dir):
    """Decorators, defaults, annotations and bases, with what they read."""
    return scopes.declarations(code(spark, sf_dir))


_BODY, _STUB = "BODY_PRESENT_NOT_VERIFIED", "DECLARATION_OR_STUB"


@query(
    "definition_roles",
    M.expected(
        "name role implementation enclosing_class ancestors attribute_reads comparisons",
        {
            0: [
                ("digest_{k}", "FUNCTION", _BODY, None, [], ["hashlib.sha256"], []),
                ("Store{k}.save", "METHOD", _BODY, "Store{k}", [], ["self.check"], []),
                ("Store{k}.check", "METHOD", _BODY, "Store{k}", [], [], []),
                ("Store{k}.check.inner", "FUNCTION", _BODY, "Store{k}", [], ["p.join"], []),
            ],
            1: [("use_{k}", "FUNCTION", _BODY, None, [], ["other.digest_{b}"], [])],
            2: [("restore_{k}", "FUNCTION", _BODY, None, [], ["h.sha256", "json.loads"], [])],
            4: [
                ("Base{k}.run", "METHOD", _STUB, "Base{k}", [], [], []),
                ("Base{k}.__call__", "CALL_OPERATION", _BODY, "Base{k}", [], ["self.run"], []),
                ("Child{k}.__init__", "CONSTRUCTOR", _BODY, "Child{k}", ["Base{k}"], [], []),
                ("Child{k}.count", "METHOD", _BODY, "Child{k}", ["Base{k}"], [], ["Eq"]),
            ],
            6: [("late_{k}", "FUNCTION", _BODY, None, [], ["json.loads"], [])],
            7: [("rows_{k}_to_table", "FUNCTION", _BODY, None, [], [], []), ("table_from_rows", "FUNCTION", _BODY, None, [], [], [])],
        },
    ),
)
def definition_roles(spark, sf_dir):
    d = scopes.descriptions(code(spark, sf_dir))
    return d.select("source_id", "name", "role", "implementation", "enclosing_class", "ancestors", "attribute_reads", "comparisons")


@query(
    "conversion_endpoints",
    M.expected(
        "name basis input output",
        {
            0: [("digest_{k}", "DOCSTRING_SUMMARY", ["data"], ["digest"])],
            7: [
                ("rows_{k}_to_table", "FUNCTION_NAME", ["rows"], ["table"]),
                ("rows_{k}_to_table", "DOCSTRING_SUMMARY", ["rows"], ["table"]),
                ("rows_{k}_to_table", "TYPE_ANNOTATIONS", ["rows"], ["table"]),
                ("table_from_rows", "FUNCTION_NAME", ["rows"], ["table"]),
            ],
        },
    ),
)
def conversion_endpoints(spark, sf_dir):
    """What functions declare to turn into what."""
    return scopes.endpoints(code(spark, sf_dir)).drop("line")


_ASKED = {"forward": "convert rows to table", "back": "convert table to rows", "other": "turn data into digest"}


@query(
    "agreeing_functions",
    "SELECT * FROM (SELECT 'forward' AS ask, * FROM ("
    + M.expected("name basis", {7: [("rows_{k}_to_table", "FUNCTION_NAME"), ("table_from_rows", "FUNCTION_NAME")]})
    + ") UNION ALL SELECT 'other', * FROM ("
    + M.expected("name basis", {0: [("digest_{k}", "DOCSTRING_SUMMARY")]})
    + "))",
)
def agreeing_functions(spark, sf_dir):
    """Functions that declare the asked direction; one that declares the reverse never agrees."""
    e = scopes.endpoints(code(spark, sf_dir)).groupBy("source_id", "name").agg(F.array_sort(F.collect_list(F.struct("basis", "input", "output"))).alias("d"))
    first = F.transform("d", lambda x: F.struct(F.when(x["basis"] == "FUNCTION_NAME", 0).when(x["basis"] == "DOCSTRING_SUMMARY", 1).otherwise(2).alias("o"), x["basis"].alias("basis"), x["input"].alias("input"), x["output"].alias("output")))
    e = e.withColumn("d", F.transform(F.array_sort(first), lambda x: F.struct(x["basis"].alias("basis"), x["input"].alias("input"), x["output"].alias("output"))))
    asked = spark.createDataFrame(sorted(_ASKED.items()), "ask string, phrase string").withColumn("x", direction.requested_direction("phrase"))
    j = e.crossJoin(F.broadcast(asked))  # a stated list of queries against all rows
    return j.withColumn("got", direction.agreeing_declaration(F.col("x.inputs"), F.col("x.outputs"), F.col("d"))).where("got IS NOT NULL").select("ask", "source_id", "name", F.col("got.basis").alias("basis"))


@query(
    "call_bindings",
    M.expected(
        "call line status site_kind",
        {
            0: [("hashlib.sha256", 6, ONE, "import"), ("self.check", 11, ONE, "parameter"), ("p.join", 14, ONE, "from_import"), ("inner", 15, ONE, "function")],
            1: [("digest_{a}", 5, ONE, "from_import"), ("other.digest_{b}", 6, ONE, "import"), ("missing_{k}", 7, FREE, None), ("len", 8, FREE, None)],
            2: [("json.loads", 5, ONE, "import"), ("h.sha256", 7, ONE, "assignment")],
            4: [("self.run", 5, ONE, "parameter"), ("super().run", 9, FREE, None), ("super", 9, FREE, None), ("super", 10, FREE, None), ("super().gone", 10, FREE, None), ("TOTAL", 14, "REDIRECTED_BINDING_EFFECT_UNRESOLVED", None)],
            5: [("print", 2, FREE, None), ("json.dumps", 2, ONE, "import")],
            6: [("restore_{c}", 5, ONE, "from_import"), ("json.loads", 6, ONE, "import"), ("cut_{k}", 8, "COMPREHENSION_SCOPE_UNRESOLVED", None)],
        },
    ),
)
def call_bindings(spark, sf_dir):
    """Each call joined to the one read of its first name."""
    m = code(spark, sf_dir)
    return context.bound_calls(m).select("source_id", "call", "line", "status", "site_kind")


@query(
    "dependency_context",
    M.expected(
        "scope call line status candidates target",
        {
            0: [
                ("digest_{k}", "hashlib.sha256", 6, context.IMPORT_GONE, 0, None),
                ("Store{k}.save", "self.check", 11, "SAME_CLASS_CANDIDATE_DYNAMIC_DISPATCH_UNRESOLVED", 1, "box{n}/m{k}.py:Store{k}.check"),
                ("Store{k}.check.inner", "p.join", 14, context.IMPORT_GONE, 0, None),
                ("Store{k}.check", "inner", 15, "LEXICAL_DEFINITION_CANDIDATE", 1, "box{n}/m{k}.py:Store{k}.check.inner"),
            ],
            1: [
                ("use_{k}", "digest_{a}", 5, context.IMPORT_FOUND, 1, "box{n}/m{a}.py:digest_{a}"),
                ("use_{k}", "other.digest_{b}", 6, context.IMPORT_GONE, 0, None),
                ("use_{k}", "missing_{k}", 7, context.FREE, 0, None),
                ("use_{k}", "len", 8, context.FREE, 0, None),
            ],
            2: [("restore_{k}", "json.loads", 5, context.IMPORT_GONE, 0, None), ("restore_{k}", "h.sha256", 7, "AMBIGUOUS_OR_REBOUND_IMPORT", 0, None)],
            4: [
                ("Base{k}.__call__", "self.run", 5, "SAME_CLASS_CANDIDATE_DYNAMIC_DISPATCH_UNRESOLVED", 1, "box{n}/m{k}.py:Base{k}.run"),
                ("Child{k}.__init__", "super().run", 9, context.SUPER_FOUND, 1, "box{n}/m{k}.py:Base{k}.run"),
                ("Child{k}.__init__", "super().gone", 10, context.SUPER_OPEN, 0, None),
                ("Child{k}.count", "TOTAL", 14, "REDIRECTED_BINDING_EFFECT_UNRESOLVED", 0, None),
                *[("Child{k}.__init__", "super", line, context.FREE, 0, None) for line in (9, 10)],
            ],
            6: [
                ("late_{k}", "restore_{c}", 5, context.IMPORT_FOUND, 1, "box{n}/m{c}.py:restore_{c}"),
                ("late_{k}", "json.loads", 6, context.IMPORT_LATE, 0, None),
                ("late_{k}", "cut_{k}", 8, "COMPREHENSION_SCOPE_UNRESOLVED", 0, None),
            ],
        },
    ),
)
def dependency_context(spark, sf_dir):
    m = code(spark, sf_dir)
    return context.dependency_context(m, M.places(spark, sf_dir), C.definitions(m)).drop("scope_line")


@query(
    "declared_apis",
    M.expected(
        "scope api line import_line",
        {
            0: [("digest_{k}", "hashlib.sha256", 6, 1), ("Store{k}.check.inner", "os.path.join", 14, 2)],
            1: [("use_{k}", "m{a}.digest_{a}", 5, 1), ("use_{k}", "m{b}.digest_{b}", 6, 2)],
            2: [("restore_{k}", "json.loads", 5, 2)],
            5: [("<module>", "json.dumps", 2, 1)],
            6: [("late_{k}", ".m{c}.restore_{c}", 5, 1)],
        },
    ),
)
def declared_apis(spark, sf_dir):
    return context.declared_apis(code(spark, sf_dir))


@query("context_trails", M.expected("scope call line status targets", {6: [("late_{k}", "restore_{c}", 5, "LEXICAL_CONTEXT_CANDIDATE_NOT_RUNTIME_EDGE", ["box{n}/m{c}.py:restore_{c}"])]}))
def context_trails(spark, sf_dir):
    m = code(spark, sf_dir)
    return context.context_trails(m, M.places(spark, sf_dir), C.definitions(m))


@query("recovered_imports", M.expected("scope name target", {0: [("Store{k}.check.inner", "p", "os.path")]}))
def recovered_imports(spark, sf_dir):
    return scopes.recovered_imports(code(spark, sf_dir))


_OK, _BIG = "ANALYZED", "AST_UNIT_LIMIT"
_UNITS = {
    0: [(0, "import", 1, 1, _OK), (1, "import", 2, 2, _OK), (2, "function", 4, 6, _OK), (3, "class", 8, 15, _BIG)],
    1: [(0, "import", 1, 1, _OK), (1, "import", 2, 2, _OK), (2, "function", 4, 8, _OK)],
    2: [(0, "import", 1, 1, _OK), (1, "import", 2, 2, _OK), (2, "function", 4, 7, _OK)],
    4: [(0, "class", 1, 5, _OK), (1, "class", 7, 14, _BIG)],
    5: [(0, "import", 1, 1, _OK), (1, "statement", 2, 2, _OK)],
    6: [(0, "import", 1, 1, _OK), (1, "statement", 2, 2, _OK), (2, "function", 4, 8, _BIG)],
    7: [(0, "function", 1, 3, _OK), (1, "function", 5, 7, _OK)],
}


@query("structural_units", M.expected("unit kind start_line end_line status", _UNITS))
def structural_units(spark, sf_dir):
    """Top-level units of every module; those of more than 30 nodes are left out of analysis."""
    return scopes.structural_units(code(spark, sf_dir), 30).select("source_id", "unit", "kind", "start_line", "end_line", "status")


_FIRST_LINES = {k: [(t.split("\n")[0] + "\n",)] for k, t in enumerate(M.TEMPLATES) if k not in (3, 7, 4)}


@query("unit_bytes", "SELECT source_id, 0::BIGINT AS byte_start, strlen(line) AS byte_end, sha256(line) AS sha256 FROM (" + M.expected("line", _FIRST_LINES) + ")")
def unit_bytes(spark, sf_dir):
    """The bytes of each module's first unit where that is one line."""
    u = scopes.structural_units(code(spark, sf_dir)).where("unit = 0 AND start_line = end_line")
    return u.select("source_id", "byte_start", "byte_end", "sha256")


@query("partition_labels", "SELECT source_id, count(*) AS units, count(*) FILTER (status <> 'ANALYZED') AS omitted, CASE WHEN bool_and(status = 'ANALYZED') THEN 'COMPLETE' ELSE 'PARTIAL' END AS status FROM (" + M.expected("unit kind start_line end_line status", _UNITS) + ") GROUP BY 1")
def partition_labels(spark, sf_dir):
    return scopes.partition_status(scopes.structural_units(code(spark, sf_dir), 30))


#: A document for each module: what its spans refer to.
DOCUMENT = "# Part {k}\n\nCall `m{k}.digest_{k}()` or `Store{k}.save`, not `m{k}.gone`.\n\n```\n`m{k}.digest_{k}`\n```\n\n## More ##\n\nAlso `box{n}.m{k}.digest_{k}` and `plain`.\n<!-- `m{k}.digest_{k}` -->\n> `m{k}.digest_{k}`\n"
_DIGEST, _SAVE = "box{n}/m{k}.py:digest_{k}", "box{n}/m{k}.py:Store{k}.save"


@query(
    "document_links",
    "SELECT 'part ' || replace(regexp_extract(source_id, 'm[0-9]+'), 'm', '') AS document, * EXCLUDE (source_id) FROM ("
    + M.expected(
        "heading line reference state target",
        {
            k: [
                ("Part {k}", 3, "m{k}.digest_{k}()", "linked" if k == 0 else "unresolved", _DIGEST if k == 0 else None),
                ("Part {k}", 3, "Store{k}.save", "linked" if k == 0 else "unresolved", _SAVE if k == 0 else None),
                ("Part {k}", 3, "m{k}.gone", "unresolved", None),
                ("More", 11, "box{n}.m{k}.digest_{k}", "linked" if k == 0 else "unresolved", _DIGEST if k == 0 else None),
            ]
            for k in range(M.KINDS)
        },
    )
    + ")",
)
def document_links(spark, sf_dir):
    part = M.parts(spark, sf_dir)
    notes = part.select(F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("document"), M.filled(DOCUMENT).alias("text"))
    links = linking.link_references(linking.references(notes), C.definitions(code(spark, sf_dir)))
    return links.select("document", "heading", "line", "reference", "state", "target")


#: Phrases about the two words {x} and {y} of a part's name, with the direction that they ask for.
PHRASES = [
    ("convert {x} to {y}", True),
    ("turn {x} into {y} and back", False),
    ("{y} from {x}", False),
    ("parse {y} from {x}", True),
    ("How are {x} converted to {y} with care?", True),
    ("map {x} to {y} to both", False),
    ("{x} -> {y}", True),
    ("render without {x} to {y}", False),
]


@query(
    "requested_directions",
    "WITH w AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS x, split_part(p_name, ' ', 2) AS y FROM part) "
    + " UNION ALL ".join(
        f"SELECT p_partkey, replace(replace('{p}', '{{x}}', x), '{{y}}', y) AS phrase, {'[x]' if asked else 'NULL'} AS inputs, {'[y]' if asked else 'NULL'} AS outputs FROM w WHERE p_partkey % {len(PHRASES)} = {i}" for i, (p, asked) in enumerate(PHRASES)
    ),
)
def requested_directions(spark, sf_dir):
    part = M.parts(spark, sf_dir, "p_name")
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    phrase = F.element_at(F.array(*[F.lit(p) for p, _ in PHRASES]), (F.col("p_partkey") % len(PHRASES) + 1).cast("int"))
    df = part.select("p_partkey", F.replace(F.replace(phrase, F.lit("{x}"), word(1)), F.lit("{y}"), word(2)).alias("phrase"))
    return df.withColumn("d", direction.requested_direction("phrase")).select("p_partkey", "phrase", "d.inputs", "d.outputs")


_NOTE = "# Notes\n\n`m{k}.py`\n\n```\nimport json\n```\n\n~~~sql\nSELECT {k}\n~~~\n\n```text\nplain\n```\n\n```python\nopen\n"


@query(
    "container_segments",
    "SELECT source_id AS path, * EXCLUDE (source_id) FROM ("
    + M.expected("format start_line status", {k: [("python_file", 1, "PYTHON_SEGMENT")] for k in range(M.KINDS)})
    + ") UNION ALL SELECT replace(source_id, '.py', '.md'), * EXCLUDE (source_id) FROM ("
    + M.expected(
        "format start_line status",
        {k: [("python_fence", 6, "PYTHON_SEGMENT"), ("python_fence", 10, "LANGUAGE_NOT_ANALYZED"), ("python_fence", 14, "NON_CODE_BLOCK"), ("python_fence", 18, "UNCLOSED_FENCE")] for k in range(M.KINDS)},
    )
    + ") UNION ALL SELECT 'node_modules/' || source_id, * EXCLUDE (source_id) FROM ("
    + M.expected("format start_line status", {k: [(None, None, "DEPENDENCY_OR_GENERATED_EXCLUDED")] for k in range(M.KINDS)})
    + ")",
)
def container_segments(spark, sf_dir):
    """Files, fenced notes and excluded copies of every module."""
    m = M.modules(spark, sf_dir)
    part = M.parts(spark, sf_dir)
    notes = part.select(F.replace(M.source_path(), F.lit(".py"), F.lit(".md")).alias("path"), M.filled(_NOTE).alias("content"))
    files = m.select(F.col("source_id").alias("path"), F.col("code").alias("content")).union(notes).union(m.select(F.concat(F.lit("node_modules/"), "source_id"), "code"))
    return containers.segments(files.select("path", F.encode("content", "UTF-8").alias("content"))).select("path", "format", "start_line", "status")


@query(
    "archive_members",
    """SELECT 'a' || p_partkey || '.zip' AS path, v.* FROM part, (VALUES ('m.py', 'python_file', 'PYTHON_SEGMENT'), ('note.md', 'text', 'TEXT_CONTAINER_INSPECTED'), ('../up.py', NULL, 'UNSAFE_MEMBER'), ('x.bin', NULL, 'NON_CODE_PAYLOAD_NOT_READ'), ('in.zip!deep.py', 'python_file', 'PYTHON_SEGMENT'), ('.env', NULL, 'SENSITIVE_PATH_EXCLUDED')) v(member, format, status)
UNION ALL SELECT 'b' || p_partkey || '.ipynb', '', 'notebook_cell', 'PYTHON_SEGMENT' FROM part, range(p_size % 3) WHERE p_size % 2 = 0
UNION ALL SELECT 'b' || p_partkey || '.ipynb', '', 'notebook_cell', 'NOTEBOOK_LANGUAGE_UNSUPPORTED' FROM part WHERE p_size % 2 = 1
UNION ALL SELECT 'c' || p_partkey || '.txt', '', CASE WHEN p_size % 3 = 0 THEN 'python_text' ELSE 'text' END, CASE WHEN p_size % 3 = 0 THEN 'PYTHON_SEGMENT' ELSE 'TEXT_CONTAINER_INSPECTED' END FROM part WHERE p_size % 3 <> 2
UNION ALL SELECT 'c' || p_partkey || '.txt', '', NULL, 'UNSUPPORTED_ENCODING' FROM part WHERE p_size % 3 = 2""",
)
def archive_members(spark, sf_dir):
    """Archives two levels deep, notebooks and plain texts made from every part."""
    part = M.parts(spark, sf_dir, "p_size")
    return containers.segments(part.mapInArrow(_made_files, "path string, content binary")).select("path", F.coalesce("member", F.lit("")).alias("member"), "format", "status")


def _made_files(batches):
    import io
    import json
    import zipfile

    import pyarrow as pa

    def packed(*members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in members:
                z.writestr(zipfile.ZipInfo(name), body)
        return out.getvalue()

    for batch in batches:
        rows = []
        for k, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            inner = packed(("deep.py", f"deep = {k}\n"))
            rows.append((f"a{k}.zip", packed(("m.py", f"x = {k}\n"), ("note.md", "only words here\n"), ("../up.py", "x = 1\n"), ("x.bin", "x"), ("in.zip", inner), (".env", "A=1"))))
            cells = [{"cell_type": "code", "source": [f"y = {k}\n"]}] * (size % 3) + [{"cell_type": "markdown", "source": "words"}]
            rows.append((f"b{k}.ipynb", json.dumps({"metadata": {"language_info": {"name": "python" if size % 2 == 0 else "julia"}}, "cells": cells}).encode()))
            rows.append((f"c{k}.txt", [f"z = {k}\n".encode(), b"some words, no code", b"\xff\xfe\x00"][size % 3]))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary())], ["path", "content"])


#: Rows of function search by kind of module: name, doc, parameters, observed APIs, called names, attribute reads, role, class, stub.
_ROWS = {
    0: [
        ("digest_{k}", "Convert data to digest.", "data name", "hashlib.sha256", "hashlib.sha256", "hashlib.sha256", "FUNCTION", None, False),
        ("Store{k}.save", "", "self rows", "", "self.check", "self.check", "METHOD", "Store{k}", False),
        ("Store{k}.check", "", "self rows **kw", "", "inner", "", "METHOD", "Store{k}", False),
        ("Store{k}.check.inner", "", "x", "os.path.join", "p.join", "p.join", "FUNCTION", "Store{k}", False),
    ],
    1: [("use_{k}", "", "value", "", "digest_{a} len missing_{k} other.digest_{b}", "other.digest_{b}", "FUNCTION", None, False)],
    2: [("restore_{k}", "", "text", "json.loads", "h.sha256 json.loads", "h.sha256 json.loads", "FUNCTION", None, False)],
    4: [
        ("Base{k}.run", "", "self n", "", "", "", "METHOD", "Base{k}", True),
        ("Base{k}.__call__", "", "self", "", "self.run", "self.run", "CALL_OPERATION", "Base{k}", False),
        ("Child{k}.__init__", "", "self n", "", "super super super().gone super().run", "", "CONSTRUCTOR", "Child{k}", False),
        ("Child{k}.count", "", "self n", "", "TOTAL", "", "METHOD", "Child{k}", False),
    ],
    6: [("late_{k}", "", "items most", "", "cut_{k} json.loads restore_{c}", "json.loads", "FUNCTION", None, False)],
    7: [("rows_{k}_to_table", "Turn rows into a table.", "rows", "", "", "", "FUNCTION", None, False), ("table_from_rows", "Render no rows.", "rows", "", "", "", "FUNCTION", None, False)],
}
_ROLE_SQL = "CASE role " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in scopes.ROLE_WORDS.items()) + " ELSE '' END"
_SEARCH_ROWS = (
    f"SELECT source_id || ':' || name AS row_id, sha256(source_id || ':' || name || ':' || apis) AS group_id, name AS symbol, doc AS documentation, params AS parameters, source_id AS path, apis AS observed_api, called AS declared_call, reads AS state_read, {_ROLE_SQL} AS method_role, role AS kind, class_name, stub FROM ("
    + M.expected("name doc params apis called reads role class_name stub", _ROWS)
    + ")"
)
_SEARCH_FIELDS = ["symbol", "documentation", "parameters", "path", "observed_api", "declared_call", "state_read", "method_role"]
_SEARCHED = {"s1": "convert rows to table", "s2": "digest hash", "s3": "restore loads", "s4": "base16 call", "s5": "child20 init new", "s6": "turn data into digest"}
_DIRECTED = (
    "SELECT 's1' AS query_id, source_id || ':' || name AS row_id, sha256(source_id || ':' || name || ':') AS group_id, ['rows', 'table'] AS endpoints FROM ("
    + M.expected("name", {7: [("rows_{k}_to_table",), ("table_from_rows",)]})
    + ") UNION ALL SELECT 's6', source_id || ':' || name, sha256(source_id || ':' || name || ':hashlib.sha256'), ['data', 'digest'] FROM ("
    + M.expected("name", {0: [("digest_{k}",)]})
    + ")"
)


def function_search_rows(spark, sf_dir):
    # read several times, so parsed once
    return cut(C.search_rows(code(spark, sf_dir), profile(spark)))


@query(
    "function_search",
    f"WITH {T.ranked_sql(_SEARCH_ROWS, _SEARCH_FIELDS, _SEARCHED, 'NOT contains(path, ' + chr(39) + '/none/' + chr(39) + ')', _DIRECTED, 'kind AS role, class_name, stub')}, {T.DISTINCT_SQL} SELECT {T.FOUND_SQL}, occurrences FROM p WHERE position <= 20",
)
def function_search(spark, sf_dir):
    """Functions by nine fields, with directions that they declare and the role that a query asks for."""
    return retrieval.search(function_search_rows(spark, sf_dir), C.SEARCH_FIELDS, _SEARCHED)


@query(
    "function_search_without_tests",
    f"WITH {T.ranked_sql(_SEARCH_ROWS, _SEARCH_FIELDS, _SEARCHED, 'NOT contains(path, ' + chr(39) + '/tests/' + chr(39) + ')', _DIRECTED, 'kind AS role, class_name, stub')}, {T.DISTINCT_SQL} SELECT {T.FOUND_SQL}, occurrences FROM p WHERE position <= 20",
)
def function_search_without_tests(spark, sf_dir):
    """The same search as users get it: rows of tests are left out, but count in the statistics."""
    return retrieval.search(function_search_rows(spark, sf_dir), C.SEARCH_FIELDS, _SEARCHED, checks=[("test_occurrences", ~F.contains("path", F.lit("/tests/")))])
