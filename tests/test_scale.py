"""What joins and shuffles get of wide columns and of large tables."""

import pytest


@pytest.mark.parametrize("name", ["schema_check", "check_summary"])
def test_counts_of_what_is_there_shuffle_no_texts(spark, sf_dir, name):
    """what the joins get of a text or vector is whether it is null; the counts are those of the tables themselves."""
    from skein import schemas
    from skein.fixtures import Filled, Tables
    from skein.plans.queries import CHECKED, QUERIES

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Join" in plan and "CASE WHEN isnotnull(text#" in plan
    counts = [{tuple(r) for r in schemas.filled_columns({n: getattr(kind(spark, sf_dir), n) for n in CHECKED}).collect()} for kind in (Tables, Filled)]
    assert counts[0] == counts[1] and len(counts[0]) > 40


def test_relations_broadcast_no_symbols(spark):
    """symbols compress so well that Spark takes a large table of them for a small one; no join may trust that."""
    from pyspark.sql import functions as F

    from skein.operators import chunking, graph

    n = graph.NAMES + 200
    text = "namespace A;\nclass B# : C#, IThing {\n  void Go() { Stop#(); Log(); }\n  void Stop#() { }\n}\nclass C# { }\n"
    files = spark.range(n).select(F.col("id").cast("string").alias("path"), F.replace(F.lit(text), F.lit("#"), F.col("id").cast("string")).alias("content"))
    found = chunking.build_relations(chunking.build_symbols(files))
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == 2 * n and set(rows) == {(f"A.B{k}", f"A.C{k}", "inherits") for k in range(n)} | {(f"A.B{k}.Go", f"A.B{k}.Stop{k}", "calls") for k in range(n)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_many_and_few_names_find_the_same_symbols(spark):
    """only few names are broadcast; a name that many symbols share has its first one found ahead of the shuffle."""
    from pyspark.sql import functions as F

    from skein.operators import graph

    number = F.col("id").cast("string")
    symbols = spark.range(3000).select(F.concat(F.lit("N.C"), number, F.lit(".Run"), (F.col("id") % 7).cast("string")).alias("full_name"), (-F.col("id")).alias("seq"), (F.col("id") % 3).alias("kind"))
    few = spark.createDataFrame([("Run3",), ("Run3",), ("un12",), (None,), ("C7.Run0",), ("C8.Run0",)], "name string")
    many = few.unionByName(spark.range(2 * graph.NAMES).select(F.concat(F.lit("none"), number).alias("name")))
    for exact in (False, True):
        a, b = graph.suffix_join(few, symbols, exact, told=["kind"]), graph.suffix_join(many, symbols, exact, told=["kind"])
        first = [("Run3", "N.C2999.Run3", 2)] * 2
        whole = [("C7.Run0", None, None) if exact else ("C7.Run0", "N.C7.Run0", 1)]
        want = sorted([*first, *whole, ("C8.Run0", None, None), ("un12", None, None), (None, None, None)], key=repr)
        assert sorted(map(tuple, a.collect()), key=repr) == want
        assert sorted((tuple(r) for r in b.collect() if not (r["name"] or "").startswith("none")), key=repr) == want and b.count() == many.count()
        assert "Broadcast" not in b._jdf.queryExecution().executedPlan().toString()


def test_a_target_is_of_the_kind_of_its_first_symbol(spark):
    """kinds come with the types; the first symbol of a name may be no type."""
    from skein.operators import chunking

    texts = [("p1", "namespace A;\nclass B { void C() { } }\n"), ("p2", "namespace A.B;\ninterface C { }\ninterface D { }\n"), ("p3", "namespace A.B;\nclass D { }\nclass X : C, D { }\n")]
    found = chunking.build_relations(chunking.build_symbols(spark.createDataFrame(texts, "path string, content string")))
    assert {tuple(r) for r in found.collect()} == {("A.B.X", "A.B.C", "inherits"), ("A.B.X", "A.B.D", "implements")}


def test_rows_of_a_name_that_many_want_are_not_shuffled(spark, monkeypatch):
    """they would meet in one task; the symbols of such names alone are broadcast, and are few."""
    from pyspark.sql import functions as F

    from skein.operators import graph

    monkeypatch.setattr(graph, "NAMES", 3)
    monkeypatch.setattr(graph, "HOT", 50)
    number = F.col("id").cast("string")
    symbols = spark.range(40).select(F.concat(F.lit("N.C.Run"), number).alias("full_name"), F.col("id").alias("seq"))
    wanted = spark.range(400).select("id", F.when(F.col("id") % 4 == 0, "Run7").when(F.col("id") % 4 == 1, "Gone").when(F.col("id") % 40 == 2, F.lit(None)).otherwise(F.concat(F.lit("Run"), (F.col("id") % 50).cast("string"))).alias("name"))
    known = {f"Run{k}" for k in range(40)}
    for exact in (False, True):
        found = graph.suffix_join(wanted, symbols, exact)
        rows = found.collect()
        assert len(rows) == 400 and {r["id"] for r in rows} == set(range(400)) and all(r["full_name"] == (f"N.C.{r['name']}" if r["name"] in known else None) for r in rows)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" in plan
