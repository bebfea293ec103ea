"""Tables from Python source: definitions, calls, imports and API observations. The source is parsed, never run.

A module is one row in and many rows out, which Catalyst can't express, so these are Arrow functions over
(source_id, code); what follows (joins, counts, search) is DataFrame work. A text that doesn't parse gives a row
in `failures` and none elsewhere. Null code counts as empty.
"""

from __future__ import annotations

import ast
import functools
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_S, _I = pa.string(), pa.int64()
DEFINITIONS = [("source_id", _S), ("name", _S), ("start_line", _I), ("definition_line", _I), ("end_line", _I), ("parameters", pa.list_(_S)), ("doc", _S), ("sha256", _S)]
CALLS = [("source_id", _S), ("scope", _S), ("name", _S), ("api", _S), ("line", _I)]
IMPORTS = [("source_id", _S), ("binding", _S), ("target", _S), ("line", _I)]
FAILURES = [("source_id", _S), ("code", _S)]


@functools.lru_cache(1)  # the tables of one module are made in turn
def parse(code: str | None) -> ast.Module | None:
    try:
        return ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def dotted(node: ast.AST) -> str | None:
    """`a.b.c` of a chain of attributes that starts at a name; None for anything else."""
    names = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    if not isinstance(node, ast.Name):
        return None
    return ".".join([node.id, *reversed(names)])


def scopes(tree: ast.AST, owner: str = ""):
    """(qualified scope, node) of every node below tree; a function's or class's own name opens a scope."""
    for child in ast.iter_child_nodes(tree):
        yield owner, child
        inner = owner
        if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            inner = f"{owner}.{child.name}" if owner else child.name
        yield from scopes(child, inner)


def parameters(a: ast.arguments) -> list[str]:
    plain = [x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs)]
    if a.vararg:
        plain.append(f"*{a.vararg.arg}")
    if a.kwarg:
        plain.append(f"**{a.kwarg.arg}")
    return plain


def definition_rows(source: str, code: str | None):
    tree = parse(code)
    if tree is None:
        return
    # lines as the parser counts them
    lines = (code or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    for owner, n in scopes(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            first = min([n.lineno, *(d.lineno for d in n.decorator_list)])
            body = "\n".join(lines[first - 1 : n.end_lineno])
            yield source, f"{owner}.{n.name}" if owner else n.name, first, n.lineno, n.end_lineno, parameters(n.args), ast.get_docstring(n) or "", hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest()


def imported(n: ast.AST):
    """(binding, target) that an import statement makes; none for other nodes."""
    if isinstance(n, ast.Import):
        for a in n.names:
            # `import a.b` binds a
            yield a.asname or a.name.split(".")[0], a.name if a.asname else a.name.split(".")[0]
    elif isinstance(n, ast.ImportFrom):
        head = "." * n.level + (n.module or "")
        for a in n.names:
            if a.name != "*":
                yield a.asname or a.name, f"{head}.{a.name}" if n.module else f"{head}{a.name}"


def import_rows(source: str, code: str | None):
    tree = parse(code)
    for n in ast.walk(tree) if tree else ():
        yield from ((source, *x, n.lineno) for x in imported(n))


def stable_imports(tree: ast.Module) -> dict[str, str]:
    """Bindings that module-level imports make, without names that are bound in any other way as well."""
    made: dict[str, set[str]] = {}
    for n in tree.body:
        for binding, target in imported(n):
            made.setdefault(binding, set()).add(target)
    other = set()
    for n in ast.walk(tree):
        if isinstance(n, ast.Name) and not isinstance(n.ctx, ast.Load):
            other.add(n.id)
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            other.add(n.name)
        elif isinstance(n, ast.arg):
            other.add(n.arg)
        elif isinstance(n, ast.ExceptHandler) and n.name:
            other.add(n.name)
    return {k: next(iter(v)) for k, v in made.items() if len(v) == 1 and k not in other}


def call_rows(source: str, code: str | None):
    """Calls of dotted names; `api` is the full name where the first part is a stable import, else null."""
    tree = parse(code)
    if tree is None:
        return
    known = stable_imports(tree)
    for owner, n in scopes(tree):
        if isinstance(n, ast.Call) and (name := dotted(n.func)):
            head, _, rest = name.partition(".")
            api = f"{known[head]}.{rest}" if rest and head in known else known.get(name)
            yield source, owner or "<module>", name, None if api is None or api.startswith(".") else api, n.lineno


def failure_rows(source: str, code: str | None):
    if parse(code) is None:
        yield source, "PYTHON_SYNTAX"


def _spark_type(t: pa.DataType) -> str:
    if pa.types.is_list(t):
        return f"array<{_spark_type(t.value_type)}>"
    if pa.types.is_struct(t):
        return f"struct<{', '.join(f'{f.name}: {_spark_type(f.type)}' for f in t)}>"
    return {_I: "bigint", _S: "string", pa.bool_(): "boolean"}[t]


def _table(rows, schema):
    def run(batches):
        for batch in batches:
            out = [r for i, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in rows(i, code)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(schema)], [n for n, _ in schema])

    return run, ", ".join(f"{n} {_spark_type(t)}" for n, t in schema)


def over(df: DataFrame, rows, schema) -> DataFrame:
    """The table that rows(source_id, code) gives for each module of df.

    Spark takes its size for that of the rows it came from, which is far less: without the hint it would be broadcast."""
    f, ddl = _table(rows, schema)
    return df.select(F.col("source_id").cast("string"), F.col("code").cast("string")).mapInArrow(f, ddl).hint("merge")


def definitions(df: DataFrame) -> DataFrame:
    return over(df, definition_rows, DEFINITIONS)


def calls(df: DataFrame) -> DataFrame:
    return over(df, call_rows, CALLS)


def imports(df: DataFrame) -> DataFrame:
    return over(df, import_rows, IMPORTS)


def failures(df: DataFrame) -> DataFrame:
    return over(df, failure_rows, FAILURES)


MOST_APIS = 128


def listed_apis(profile: DataFrame) -> list:
    """(api, capability) of a profile; more than MOST_APIS are refused."""
    rows = profile.select("api", "capability").limit(MOST_APIS + 1).collect()
    if len(rows) > MOST_APIS:
        raise ValueError("PROFILE_LIMIT")
    return rows


def probe(df: DataFrame, profile: DataFrame) -> DataFrame:
    """(source_id, scope, name, api, capability, line): calls of the profile's APIs (MOST_APIS at most, so broadcast; more are refused)."""
    rows = listed_apis(profile)
    listed = df.sparkSession.createDataFrame(rows, "api string, capability string")
    return calls(df).where("api IS NOT NULL").join(F.broadcast(listed), "api").select("source_id", "scope", "name", "api", "capability", "line")


def probe_roles(df: DataFrame, roles: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """Observations of several profiles (role -> (api, capability) pairs), with the role; the sources are parsed once."""
    listed = df.sparkSession.createDataFrame([(role, *x) for role, p in sorted(roles.items()) for x in p], "role string, api string, capability string")
    if sum(map(len, roles.values())) > 3 * MOST_APIS:
        raise ValueError("PROFILE_LIMIT")
    return calls(df).where("api IS NOT NULL").join(F.broadcast(listed), "api").select("role", "source_id", "scope", "name", "api", "capability", "line")


def coverage(df: DataFrame, findings: DataFrame) -> DataFrame:
    """(source_id, coverage, findings) of every source: what a hunt did with it."""
    n = findings.groupBy("source_id").agg(F.count("*").alias("n"))
    j = df.select("source_id").join(failures(df), "source_id", "left").join(n, "source_id", "left")
    state = F.when(F.col("code").isNotNull(), "BLOCKED").when(F.col("n") > 0, "FINDINGS").otherwise("NO_FINDING")
    return j.select("source_id", state.alias("coverage"), F.coalesce("n", F.lit(0)).alias("findings"))


def validate_findings(claims: DataFrame, df: DataFrame, profile: DataFrame) -> DataFrame:
    """claims (source_id, sha256, scope, api, capability, line, ...) with a code: the first check that a claim fails, or VALID.

    The source must exist with the same bytes, and a fresh probe must give the same observation at the same line."""
    sha = df.select("source_id", F.sha2("code", 256).alias("_sha"))
    again = probe(df, profile).groupBy("source_id", "scope", "api", "capability").agg(F.collect_set("line").alias("_lines"))
    j = claims.join(sha, "source_id", "left").join(again, ["source_id", "scope", "api", "capability"], "left")
    code = (
        F.when(F.col("_sha").isNull(), "SOURCE_MISSING")
        .when(~F.coalesce(F.array_contains("_lines", F.col("line")), F.lit(False)), "SPAN_MISMATCH")
        .when(F.col("_sha") != F.col("sha256"), "SOURCE_DIGEST_MISMATCH")
        .otherwise("VALID")
    )
    return j.select(*claims.columns, code.alias("code"))


def remaining(df: DataFrame, stored: DataFrame) -> DataFrame:
    """(source_id, state) of sources (source_id, sha256) that a resumed run has to scan: NEW, or ALTERED since they were stored."""
    j = df.select("source_id", "sha256").join(stored.select("source_id", F.col("sha256").alias("_had")), "source_id", "left")
    state = F.when(F.col("_had").isNull(), "NEW").when(F.col("_had") != F.col("sha256"), "ALTERED")
    return j.select("source_id", state.alias("state")).where("state IS NOT NULL")


def observed_in(called: dict[str, set[str]], scope: str) -> list[str]:
    return sorted(called.get(scope, ()))


def called_apis(source: str, code: str | None) -> dict[str, set[str]]:
    """The full names that each scope's calls have by stable imports."""
    out: dict[str, set[str]] = {}
    for _, scope, _, api, _ in call_rows(source, code):
        if api is not None:
            out.setdefault(scope, set()).add(api)
    return out


def function_table_rows(source: str, code: str | None):
    called = called_apis(source, code)
    for d in definition_rows(source, code):
        yield *d, observed_in(called, d[1])


def of_profile(apis, profile: DataFrame):
    """Those of an array of APIs that a profile lists."""
    known = [r[0] for r in listed_apis(profile)]
    return F.filter(apis, lambda x: x.isin(known)) if known else F.array().cast("array<string>")


def function_rows(df: DataFrame, profile: DataFrame) -> DataFrame:
    """One row a definition with the APIs observed in it, by qualified name. A module's calls and definitions meet where it is parsed."""
    d = over(df, function_table_rows, [*DEFINITIONS, ("observed_apis", pa.list_(_S))])
    return d.withColumn("observed_apis", of_profile("observed_apis", profile))


def _does_something(s: ast.stmt) -> bool:
    plain = isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str)
    return not plain and not isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Import, ast.ImportFrom))


SOURCES = [("source_id", _S), ("acts", pa.bool_()), ("defines", pa.bool_()), ("apis", pa.list_(_S))]


def source_state_rows(source: str, code: str | None):
    """Whether a module's own statements do something, whether it defines functions, and the APIs of its own calls."""
    tree = parse(code)
    if tree is not None:
        defines = any(isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) for n in ast.walk(tree))
        yield source, any(map(_does_something, tree.body)), defines, observed_in(called_apis(source, code), "<module>")


def source_rows(df: DataFrame, profile: DataFrame) -> DataFrame:
    """One row `<module>` a source whose own statements hold an observation, or that defines nothing but does something."""
    s = over(df, source_state_rows, SOURCES).select("source_id", "acts", "defines", of_profile("apis", profile).alias("apis"))
    apis = F.array_sort(F.array_distinct(F.flatten(F.collect_list("apis"))))
    g = s.groupBy("source_id").agg(F.max("acts").alias("acts"), F.max("defines").alias("defines"), apis.alias("observed_apis"))
    g = g.where((F.col("acts") & ~F.col("defines")) | (F.size("observed_apis") > 0))
    return g.select("source_id", F.lit("<module>").alias("name"), "observed_apis")


def all_rows(df: DataFrame, profile: DataFrame) -> DataFrame:
    """Function rows and source rows as one frame; what a source row lacks is null."""
    f = function_rows(df, profile).withColumn("record_kind", F.lit("function"))
    return f.unionByName(source_rows(df, profile).withColumn("record_kind", F.lit("source_scope")), allowMissingColumns=True)


def coverage_report(df: DataFrame, profile: DataFrame) -> DataFrame:
    """(namespace, sources, parsed, definitions, with_observations, status) of sources (source_id, code, namespace)."""
    bad = failures(df).select("source_id", F.lit(1).alias("bad"))
    d = function_rows(df, profile).groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(F.size("observed_apis") > 0).alias("o"))
    j = df.select("source_id", "namespace").join(bad, "source_id", "left").join(d, "source_id", "left")
    status = F.when(F.count("bad") > 0, "COMPLETED_WITH_GAPS").otherwise("COMPLETED_FOR_SELECTED_CONTAINERS")
    return j.groupBy("namespace").agg(
        F.count("*").alias("sources"),
        (F.count("*") - F.count("bad")).alias("parsed"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("definitions"),
        F.coalesce(F.sum("o"), F.lit(0)).alias("with_observations"),
        status.alias("status"),
    )


SEARCH_FIELDS = {
    "symbol": "name",
    "documentation": "doc",
    "parameters": "params",
    "path": "path",
    "observed_api": "apis",
    "declared_call": "called",
    "state_read": "reads",
    "method_role": "role_words",
}


def search_rows(df: DataFrame, profile: DataFrame) -> DataFrame:
    """Functions as rows of retrieval.search(): the columns of SEARCH_FIELDS, row_id, group_id, role, class_name, stub, declarations."""
    from lodestone.sources import scopes as S

    j = over(df, S.function_entry_rows, S.ENTRIES).withColumn("observed_apis", of_profile("observed_apis", profile))
    words = F.create_map(*[F.lit(x) for kv in S.ROLE_WORDS.items() for x in kv])
    apis = F.array_join("observed_apis", " ")
    row_id = F.concat_ws(":", "source_id", "name")
    return j.select(
        row_id.alias("row_id"),
        F.sha2(F.concat_ws(":", "source_id", "name", apis), 256).alias("group_id"),
        "name",
        "doc",
        F.array_join("parameters", " ").alias("params"),
        F.col("source_id").alias("path"),
        apis.alias("apis"),
        F.array_join("calls", " ").alias("called"),
        F.array_join("attribute_reads", " ").alias("reads"),
        F.coalesce(words[F.col("role")], F.lit("")).alias("role_words"),
        "role",
        "class_name",
        (F.col("implementation") == "DECLARATION_OR_STUB").alias("stub"),
        "declarations",
    )
