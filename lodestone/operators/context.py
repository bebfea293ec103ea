"""Dependency context: which definition a call in a function may mean, and by which rule.

A lead is a candidate, never a proven call. Eight rules are tried in order; the first that applies gives the status:
a member of super(), an import, a read that can't be tied to one binding, a function of the same module, a method of the
same class, an import that is bound again, a name that is bound several times, any other binding. Rules are columns; their
candidates come from equi-joins (module paths are exploded into their suffixes once).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.matching import suffixes
from lodestone.operators.ranking import top_rows
from lodestone.sources import code as C
from lodestone.sources import scopes as S

# What a lead is called by the rule that gave it.
IMPORT_LATE, IMPORT_FOUND, IMPORT_GONE = "IMPORT_AFTER_CALL_REQUIRES_REVIEW", "DECLARED_IMPORT_CANDIDATE", "DECLARED_IMPORT_TARGET_NOT_IN_SNAPSHOT"
SUPER_FOUND, SUPER_OPEN, SUPER_DEEP = "DECLARED_SINGLE_BASE_CANDIDATE_RUNTIME_MRO_UNRESOLVED", "SUPER_RUNTIME_MRO_UNRESOLVED", "SUPER_CONTEXT_DEPTH_LIMIT"
NOT_CAPTURED, FREE = "CALL_ROOT_BINDING_NOT_CAPTURED_REINDEX_REQUIRED", "UNRESOLVED_OR_EXTERNAL"


def bound_calls(modules: DataFrame) -> DataFrame:
    """Call sites with the binding of their first name: by name and place, which must be one read."""
    return C.over(modules, S.bound_site_rows, [*S.SITES, *S.BOUND]).withColumn("status", F.coalesce("status", F.lit(NOT_CAPTURED)))


def stem(path: Column) -> Column:
    """Parts of a Python file's path without its suffix; null for other files."""
    return F.when(path.rlike(r"\.(py|pyi|pyw)$"), F.split(F.regexp_replace(path, r"\.(py|pyi|pyw)$", ""), "/"))


def module_keys(path: Column) -> Column:
    """What a module is imported by: each suffix of its path, and the whole path for relative imports; a package also without __init__."""
    parts = stem(path)
    package = F.when(F.element_at(parts, -1) == "__init__", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))
    tails = lambda p: F.transform(suffixes(p, "/"), lambda s: F.concat(F.lit("any:"), s))
    whole = lambda p: F.array(F.concat(F.lit("abs:"), F.array_join(p, "/")))
    return F.array_distinct(F.concat(tails(parts), whole(parts), F.when(package.isNotNull(), F.concat(tails(package), whole(package))).otherwise(F.array().cast("array<string>"))))


def import_targets(path: Column, parts: Column) -> Column:
    """array<struct(key, name)> that a call through an import may mean: module key and the name of a definition in it."""
    rest = F.slice(parts, 2, 1000)
    dotted = lambda a: F.array_join(a, ".")
    module, symbol, level = F.col("module"), F.col("symbol"), F.col("level")
    is_from = F.col("site_kind") == "from_import"
    bare = is_from & (module == "") & (F.size(rest) > 0)
    head = F.split(module, r"\.")
    plain = F.when((F.col("root") == F.get(head, 0)) & (F.size(head) > 1), F.slice(parts, F.size(head) + 1, 1000)).otherwise(rest)
    first = F.struct(F.when(bare, symbol).otherwise(module).alias("module"), F.when(bare, dotted(rest)).when(is_from, dotted(F.concat(F.array(symbol), rest))).otherwise(dotted(plain)).alias("name"))
    # `from a import b; b.c()`: b may be a module of a, or an object in it
    second = F.struct(F.concat_ws(".", "module", "symbol").alias("module"), dotted(rest).alias("name"))
    pairs = F.when(is_from & (module != "") & (F.size(rest) > 0), F.array(first, second)).otherwise(F.array(first))
    folder = F.slice(stem(path), 1, F.greatest(F.size(stem(path)) - level, F.lit(0)).cast("int"))
    near = lambda m: F.array_join(F.concat(folder, F.filter(F.split(m, r"\."), lambda x: x != "")), "/")
    key = lambda m: F.when(level > 0, F.concat(F.lit("abs:"), near(m))).otherwise(F.concat(F.lit("any:"), F.translate(m, ".", "/")))
    reachable = (level == 0) | (level <= F.size(stem(path)) - 1)
    return F.when(reachable, F.transform(pairs, lambda p: F.struct(key(p["module"]).alias("key"), p["name"].alias("name")))).otherwise(F.array().cast("array<struct<key:string,name:string>>"))


def dependency_context(modules: DataFrame, places: DataFrame, definitions: DataFrame) -> DataFrame:
    """(source_id, scope, scope_line, call, line, status, candidates, target) of each call in each function of modules (source_id, code).

    places: source_id, namespace, path, cell; only sources of one namespace see one another, and a notebook's cell only itself."""
    c = C.over(modules, S.call_context_rows, S.CALL_CONTEXT).join(places.hint("merge"), "source_id").withColumn("status", F.coalesce("status", F.lit(NOT_CAPTURED)))
    c = c.withColumn("call_id", F.xxhash64("source_id", "scope", "scope_line", "call", "line", "root_line", "column")).withColumn("parts", F.split("call", r"\."))

    one = F.col("status") == S.ONE
    up = F.startswith("call", F.lit("super()."))
    is_import = one & F.col("site_kind").isin("import", "from_import") & (F.coalesce("symbol", F.lit("")) != "*")
    late = (F.col("site_scope") == F.col("scope")) & (F.col("site_line") >= F.col("line"))
    walked = (F.col("status") == S.FREE) & F.col("enclosing_class").isNotNull() & (F.col("first_parameter") == "self") & ~F.col("super_shadowed")
    open_read = ~F.col("status").isin(S.ONE, S.SEVERAL, S.FREE)
    local = one & (F.col("site_kind") == "function") & (F.size("parts") == 1)
    own = (F.col("root") == "self") & one & (F.col("site_kind") == "parameter") & (F.col("site_scope") == F.col("scope")) & F.col("enclosing_class").isNotNull()
    rule = F.when(up, "super").when(is_import & late, "late").when(is_import, "import").when(open_read, "open").when(local, "local").when(own, "own").when(F.col("aliased"), "aliased").when(F.col("status") == S.SEVERAL, "several").when(one, "bound").otherwise("free")
    c = c.withColumn("rule", F.coalesce(rule, F.lit("free")))

    # names of the module itself are counted where it is parsed; what imports lead to is looked up by module key and name
    rule = F.col("rule")
    inside = lambda x: F.when(rule == "local", F.col(f"local_{x}")).when(rule == "own", F.col(f"own_{x}")).when((rule == "super") & walked, F.col(f"base_{x}"))
    c = c.withColumn("inside", F.coalesce(inside("n"), F.lit(0))).withColumn("inside_target", F.concat_ws(":", "source_id", inside("name"))).withColumn("walked", walked)
    targets = F.when(rule == "import", import_targets(F.col("path"), F.col("parts")))
    # a call without an import target keeps its row, under a key of its own, so that such rows don't meet in one task
    lone = F.array(F.struct(F.concat(F.lit("none:"), F.col("call_id").cast("string")).alias("key"), F.lit("").alias("name")))
    c = c.withColumn("t", F.explode(F.when(F.size(targets) > 0, targets).otherwise(lone)))
    c = c.select("call_id", "source_id", "scope", "scope_line", "call", "line", "rule", "status", "walked", "walk_cut", "inside", "inside_target", "namespace", "cell", F.col("t.key").alias("key"), F.col("t.name").alias("d_name"))
    d = definitions.select(F.col("source_id").alias("d_source"), F.col("name").alias("d_name"), F.col("definition_line").alias("d_line")).distinct()
    keyed = d.join(places.withColumnsRenamed({"source_id": "d_source", "cell": "d_cell"}).hint("merge"), "d_source").withColumn("key", F.explode(module_keys(F.col("path")))).select("namespace", "key", "d_source", "d_name", "d_line", "d_cell")
    seen = F.when((F.col("source_id") == F.col("d_source")) | ~(F.col("cell") | F.col("d_cell")), F.struct("d_source", "d_name", "d_line"))
    kept = ["source_id", "scope", "scope_line", "call", "line", "rule", "status", "walked", "walk_cut", "inside", "inside_target"]
    j = c.join(keyed.hint("merge"), ["namespace", "key", "d_name"], "left").withColumn("d", seen)
    # a call has two targets at most, which may lead to one definition: the distinct ones count
    j = j.groupBy("call_id", *kept, "d").agg(F.lit(1).alias("_")).groupBy("call_id", *kept).agg(F.count("d").alias("imported"), F.min("d").alias("d"))
    j = j.withColumn("candidates", F.when(F.col("rule") == "import", F.col("imported")).otherwise(F.col("inside")))
    hit = F.col("candidates") > 0
    reason = (
        F.when(F.col("candidates") > 1, "AMBIGUOUS_CANDIDATES")
        .when(F.col("rule") == "super", F.when(F.col("status") != S.FREE, F.col("status")).when(hit, SUPER_FOUND).when(F.col("walked") & F.col("walk_cut"), SUPER_DEEP).otherwise(SUPER_OPEN))
        .when(F.col("rule") == "late", IMPORT_LATE)
        .when(F.col("rule") == "import", F.when(hit, IMPORT_FOUND).otherwise(IMPORT_GONE))
        .when(F.col("rule").isin("open", "several"), F.col("status"))
        .when(F.col("rule") == "local", F.when(hit, "LEXICAL_DEFINITION_CANDIDATE").otherwise(FREE))
        .when(F.col("rule") == "own", F.when(hit, "SAME_CLASS_CANDIDATE_DYNAMIC_DISPATCH_UNRESOLVED").otherwise(FREE))
        .when(F.col("rule") == "aliased", "AMBIGUOUS_OR_REBOUND_IMPORT")
        .when(F.col("rule") == "bound", "LOCAL_OR_PARAMETER_BINDING_UNRESOLVED")
        .otherwise(FREE)
    )
    target = F.when(F.col("candidates") == 1, F.when(F.col("rule") == "import", F.concat_ws(":", "d.d_source", "d.d_name")).otherwise(F.col("inside_target")))
    return j.select("source_id", "scope", "scope_line", "call", "line", reason.alias("status"), "candidates", target.alias("target"))


def declared_apis(modules: DataFrame) -> DataFrame:
    """(source_id, scope, api, line, import_line): the full names that calls have by their imports; an import at or after the call in its
    own scope is no evidence for it."""
    c = bound_calls(modules).where(F.col("site_kind").isin("import", "from_import") & (F.col("status") == S.ONE) & (F.coalesce("symbol", F.lit("")) != "*"))
    c = c.where(~((F.col("site_scope") == F.col("scope")) & (F.col("site_line") >= F.col("line"))) & ~F.startswith("call", F.lit("super().")))
    rest = F.slice(F.split("call", r"\."), 2, 1000)
    plain = (F.col("site_kind") == "import") & (F.col("root") == F.split_part("module", F.lit("."), F.lit(1)))
    named = F.concat_ws(".", F.filter(F.concat(F.array("module", "symbol"), rest), lambda x: x.isNotNull() & (x != "")))
    return c.select("source_id", "scope", F.when(plain, F.col("call")).otherwise(F.concat(F.repeat(F.lit("."), F.col("level").cast("int")), named)).alias("api"), "line", F.col("site_line").alias("import_line"))


def context_trails(modules: DataFrame, places: DataFrame, definitions: DataFrame, most: int = 30) -> DataFrame:
    """(source_id, scope, call, line, status, targets): calls whose name leads, by the module's imports or in the module itself, to
    definitions of the same namespace with exactly that module and name; a scope has `most` at most, the rest follow from its calls."""
    dotted = F.regexp_replace(F.translate(F.regexp_replace("path", r"\.py$", ""), "/", "."), r"\.__init__$", "")
    place = places.where("endswith(path, '.py')").select("source_id", "namespace", dotted.alias("module_name"), F.endswith("path", F.lit("__init__.py")).alias("is_package"))
    c = C.over(modules, S.trail_rows, S.TRAILS).withColumn("i", F.when(F.col("imported"), F.struct("module", "symbol", "level"))).drop("imported", "module", "symbol", "level")
    c = c.join(place.hint("merge"), "source_id")
    tail = F.when(F.contains("call", F.lit(".")), F.regexp_replace("call", r"^[^.]*\.", ""))
    own = F.split("module_name", r"\.")
    package = F.when(F.col("is_package"), own).otherwise(F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))))
    up = F.coalesce(F.col("i.level"), F.lit(0)).cast("int")
    parent = F.slice(package, 1, F.greatest(F.size(package) - F.greatest(up - 1, F.lit(0)), F.lit(0)))
    named = F.array_join(F.concat(parent, F.filter(F.split(F.coalesce("i.module", F.lit("")), r"\."), lambda x: x != "")), ".")
    module = F.when(F.col("i").isNull(), F.col("module_name")).when(up > 0, F.when(up - 1 <= F.size(package), named)).otherwise(F.col("i.module"))
    symbol = F.when(F.col("i").isNull(), F.when(tail.isNull(), F.col("call"))).when(F.col("i.symbol").isNotNull(), F.concat_ws(".", "i.symbol", tail)).otherwise(tail)
    c = c.withColumn("module_name", module).withColumn("name", symbol).where("module_name IS NOT NULL AND name IS NOT NULL")
    d = definitions.select(F.col("source_id").alias("d_source"), "name").distinct().join(place.select(F.col("source_id").alias("d_source"), "namespace", "module_name").hint("merge"), "d_source")
    found = c.join(d.hint("merge"), ["namespace", "module_name", "name"]).groupBy("source_id", "scope", "call", "line").agg(F.array_sort(F.collect_set(F.concat_ws(":", "d_source", "name"))).alias("targets"))
    top = top_rows(found, ["source_id", "scope"], [F.col("line"), F.col("call")], most)
    status = F.when(F.size("targets") > 1, "AMBIGUOUS_CONTEXT_TARGET").otherwise("LEXICAL_CONTEXT_CANDIDATE_NOT_RUNTIME_EDGE")
    return top.select("source_id", "scope", "call", "line", status.alias("status"), "targets")
