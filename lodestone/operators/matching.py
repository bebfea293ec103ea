"""Joins that the evidence engine is made of: division, eligibility, citations, comparison, suffixes, contracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def divide(rows: DataFrame, key: str, clauses: dict[str, Column], against: Column | None = None) -> DataFrame:
    """(key, evidence): keys for which every clause has a row, and no row is `against`.

    One aggregation on the key with a flag for each clause, instead of a join for each."""
    flags = [F.max(F.coalesce(c, F.lit(False))).alias(f"_{name}") for name, c in clauses.items()]
    any_of = reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in clauses.values()])
    bad = F.max(F.coalesce(against if against is not None else F.lit(False), F.lit(False))).alias("_bad")
    g = rows.groupBy(key).agg(*flags, bad, F.sum(any_of.cast("long")).alias("evidence"))
    return g.where(reduce(lambda a, b: a & b, [F.col(f"_{name}") for name in clauses]) & ~F.col("_bad")).select(key, "evidence")


def eligible(rows: DataFrame, key: str, allowed: DataFrame, refused: DataFrame) -> DataFrame:
    """Rows whose key is allowed and not refused: a semi and an anti join."""
    return rows.join(allowed.select(key).distinct(), key, "left_semi").join(refused.select(key).distinct(), key, "left_anti")


def check_citations(citations: DataFrame, sources: DataFrame, key: str, text: str) -> DataFrame:
    """Citations (key, start, end, quote) with a code: the quote must be text[start:end], by code points."""
    own = sources.select(key, F.col(text).alias("_t"))
    j = citations.join(own, key, "left")
    code = (
        F.when(F.col("_t").isNull(), "UNKNOWN_EVIDENCE_SOURCE")
        .when((F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.length("_t")), "EVIDENCE_SPAN")
        .when(F.expr("substring(_t, start + 1, end - start)") != F.col("quote"), "EVIDENCE_QUOTE_MISMATCH")
        .otherwise("OK")
    )
    return j.withColumn("code", code).drop("_t")


def compare_versions(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): ADDED, REMOVED, CHANGED or UNCHANGED, by a full outer join on the key."""
    a = before.select(key, F.col(digest).alias("_a"), F.lit(True).alias("_in_a"))
    b = after.select(key, F.col(digest).alias("_b"), F.lit(True).alias("_in_b"))
    j = a.join(b, key, "full_outer")
    change = F.when(F.col("_in_a").isNull(), "ADDED").when(F.col("_in_b").isNull(), "REMOVED").when(F.col("_a").eqNullSafe(F.col("_b")), "UNCHANGED").otherwise("CHANGED")
    return j.select(key, change.alias("change"))


def verify_listing(listing: DataFrame, manifest: DataFrame, path: str, digest: str) -> DataFrame:
    """(path, problem) of members that are missing, unexpected or changed; empty if all is well."""
    c = compare_versions(manifest, listing, path, digest).where("change <> 'UNCHANGED'")
    return c.select(path, F.when(F.col("change") == "ADDED", "UNEXPECTED_MEMBER").when(F.col("change") == "REMOVED", "MISSING_MEMBER").otherwise("MEMBER_CHANGED").alias("problem"))


def suffixes(parts: Column, glue: str = ".") -> Column:
    """All suffixes of an array, itself included, joined by dots or otherwise."""
    n = F.size(parts)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), glue))).otherwise(F.array().cast("array<string>"))


def match_suffixes(names: DataFrame, modules: DataFrame, name: str, parts: str) -> DataFrame:
    """names joined to the modules of which they are a suffix, by exploding suffixes into an equi-join."""
    long = modules.withColumn("_suffix", F.explode(suffixes(F.col(parts))))
    return names.join(long, names[name] == long["_suffix"]).drop("_suffix")


def match_symbols(definitions: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbols (symbol) joined to definitions (name): a dotted symbol in full, a plain one by the last part."""
    d = definitions.withColumn("_key", F.explode(F.array_distinct(F.array("name", F.element_at(F.split("name", r"\."), -1)))))
    s = symbols.withColumn("_dotted", F.col("symbol").contains("."))
    j = s.join(d, s.symbol == d["_key"])
    return j.where(~F.col("_dotted") | (F.col("name") == F.col("symbol"))).drop("_key", "_dotted")


# Order of contract states, best first.
FIT_ORDER = ["DECLARED_DIRECT_FIT", "DECLARED_SUPPORT_FIT", "MISSING_INPUTS", "UNRESOLVED_CONTRACT", "CONTRACT_MISMATCH", "NO_DECLARED_ROLE"]


MOST_KINDS = 1000


def assess_contracts(outputs: DataFrame, roles: DataFrame, attributes: list[str], missing: str) -> DataFrame:
    """(capability, task, status, role_id): each capability's best role in each task.

    outputs: capability, kind, attributes, `missing` (inputs it lacks); roles: task, role_id, mode, kind, attributes. Kinds must agree;
    `unknown` agrees with any. So a role of unknown kind is dealt to each kind of output and any other to its own and to unknown ones,
    and all pairs come from one equi-join on the output's kind. Kinds are a vocabulary: MOST_KINDS at most."""
    o = outputs.select("capability", F.col("kind").alias("_k"), *[F.col(a).alias(f"_o_{a}") for a in attributes], F.col(missing).alias("_missing"))
    kinds = [r[0] for r in o.select("_k").distinct().limit(MOST_KINDS + 1).collect()]
    if len(kinds) > MOST_KINDS:
        raise ValueError("CONTRACT_KIND_LIMIT")
    every = F.array(*map(F.lit, kinds)) if kinds else F.array().cast("array<string>")
    reach = F.when(F.col("kind") == "unknown", every).otherwise(F.array(F.col("kind"), F.lit("unknown")))
    pairs = roles.withColumn("_k", F.explode(reach)).join(o, "_k")
    either = lambda a: (F.col(a) == "unknown") | (F.col(f"_o_{a}") == "unknown")
    conflicts = sum((F.when(~either(a) & (F.col(a) != F.col(f"_o_{a}")), 1).otherwise(0) for a in attributes), F.lit(0))
    unknowns = sum((F.when(either(a), 1).otherwise(0) for a in attributes), F.lit(0))
    p = pairs.withColumn("conflicts", conflicts).withColumn("unknowns", unknowns)
    status = (
        F.when(F.col("conflicts") > 0, "CONTRACT_MISMATCH")
        .when(F.col("unknowns") > 0, "UNRESOLVED_CONTRACT")
        .when(F.col("_missing") > 0, "MISSING_INPUTS")
        .when(F.col("mode") == "direct", "DECLARED_DIRECT_FIT")
        .otherwise("DECLARED_SUPPORT_FIT")
    )
    p = p.withColumn("status", status)
    rank = F.array_position(F.array(*map(F.lit, FIT_ORDER)), F.col("status"))
    best = F.min_by(F.struct("status", "role_id"), F.struct(rank.alias("a"), (F.col("mode") != "direct").alias("b"), F.col("role_id").alias("c"), F.col("conflicts").alias("d"), F.col("unknowns").alias("e")))
    return p.groupBy("capability", "task").agg(best.alias("x")).select("capability", "task", "x.status", "x.role_id")
