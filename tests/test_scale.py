"""Plans that hold at any size: rows dealt before long work, modules parsed once, nothing long broadcast."""

import pytest

from lodestone.plans import modules as M
from lodestone.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    """The plan as it stands before anything has run."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_modules_of_one_file_are_dealt(spark):
    assert M.modules(spark, SF).rdd.getNumPartitions() >= 12


@pytest.mark.parametrize("name", ["archive_members", "relative_imports", "catalog_cards", "finding_counts", "script_calls", "name_bindings", "recovered_imports", "conversion_endpoints", "declared_inputs"])
def test_parsing_follows_a_deal(spark, name):
    p = plan(registry.QUERIES[name](spark, SF))
    assert "REPARTITION_BY_NUM" in p[p.index("MapInArrow") :]


@pytest.mark.parametrize("name", ["call_bindings", "dependency_context", "context_trails", "document_links", "linked_sections", "declared_apis", "catalog_cards", "relative_imports"])
def test_tables_of_modules_are_not_broadcast(spark, name):
    assert "Broadcast" not in plan(registry.QUERIES[name](spark, SF))


@pytest.mark.parametrize(("name", "times"), [("call_bindings", 1), ("declared_apis", 1), ("dependency_context", 2), ("context_trails", 2), ("document_links", 2), ("source_scopes", 1), ("record_kinds", 2)])
def test_modules_are_parsed_once_for_each_side(spark, name, times):
    assert plan(registry.QUERIES[name](spark, SF)).count("MapInArrow") == times


def test_a_change_of_exactly_the_threshold(spark, tmp_path):
    """13/6 - 5/3 is a half; taken from means of nine digits it was less."""
    import duckdb

    lines = [("F", q) for q in (1, 2, 2) * 3] + [("O", q) for q in (2, 2, 2, 2, 2, 3) * 2]
    df = spark.createDataFrame([(1, float(q), s, "N") for s, q in lines], "l_partkey long, l_quantity double, l_linestatus string, l_returnflag string")
    df.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = registry.QUERIES["measured_values"](spark, str(tmp_path)).select("ps", "verdict", "change").collect()
    assert [tuple(r) for r in got] == con.execute(f"SELECT ps, verdict, change FROM ({registry.SQL['measured_values']})").fetchall()


def test_levels_broadcast_nothing(spark, monkeypatch):
    from lodestone.operators import ranking

    plans, cut = [], ranking.cut
    monkeypatch.setattr(ranking, "cut", lambda df: plans.append(plan(df)) or cut(df))
    assert registry.QUERIES["task_levels"](spark, SF).count() == 200
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)


def test_words_are_counted_inside_rows(spark):
    from pyspark.sql import functions as F

    from lodestone.functions import text as T
    from lodestone.operators import retrieval
    from lodestone.plans import text_queries as Q

    rows = Q.search_rows(spark, SF)
    assert "Aggregate" not in plan(retrieval.profiles(rows, Q.FIELDS, retrieval.query_terms(spark, Q.WANTED)))
    # the same as counting over all rows, with no words, many tokens, ties, and rows that share a key
    texts = [(1, "b a b c a b"), (2, ""), (3, None), (4, "x y"), (4, "y z"), (5, " ".join(f"w{i % 300}" for i in range(1000))), (6, "q " * 150), (None, "n m"), (None, "m")]
    df = spark.createDataFrame(texts, "id long, text string").select("id", T.identifier_words("text").alias("w"))
    for most, cap in ((256, 100), (2, 2)):
        want = sorted(map(str, T.merged_counts(df, ["id"], "w", most, cap).collect()))
        assert sorted(map(str, T.bounded_counts(df, ["id"], "w", most, cap).collect())) == want
    fields = {"symbol": "s", "documentation": "t"}
    twice = spark.createDataFrame([(1, "g", "a", "x x"), (1, "g", "b", "x"), (2, "h", "a", "z")], "row_id long, group_id string, s string, t string")
    got = retrieval.features(twice, fields).select("row_id", "field", F.explode("counts").alias("x")).select("row_id", "field", "x.token", "x.n")
    assert ("1", "documentation", "x", "3") in {tuple(map(str, r)) for r in got.collect()} and got.count() == 2 + 1
