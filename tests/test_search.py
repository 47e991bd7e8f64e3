import pytest
from pyspark.sql import functions as F

from skein.functions import lexical
from skein.functions.vector import cosine_distance
from skein.operators import search


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, 0.0])], "id long, embedding array<float>")


def test_null_and_zero_vectors_come_last(vectors):
    rows = search.vector_topk(vectors, [1.0, 0.0], 10, keep_null=True).orderBy("rank").collect()
    assert [r["id"] for r in rows] == [1, 5, 2, 3, 4] and rows[3]["distance"] is None and rows[4]["distance"] is None
    assert [r["id"] for r in search.vector_topk(vectors, [1.0, 0.0], 10).orderBy("rank").collect()] == [1, 5, 2, 4]


def test_distance_of_columns(vectors):
    assert [r[0] for r in vectors.filter("id < 3").select(cosine_distance(F.col("embedding"), F.array(F.lit(0.0), F.lit(2.0)))).collect()] == [1.0, 0.0]


def test_fusion_of_overlapping_ranks(spark):
    near = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank int")
    text = spark.createDataFrame([(2, 1), (3, 2)], "id long, rank int")
    got = [(r["id"], round(r["rrf_score"], 9)) for r in search.fused(near, text, 10).collect()]
    assert got == [(2, round(1 / 61 + 1 / 62, 9)), (1, round(1 / 61, 9)), (3, round(1 / 62, 9))]


def test_rerank_boosts_and_penalties(spark):
    rows = spark.createDataFrame([(1, "Shop.Order", "csharp", 0.03), (2, None, "json", 1.0), (3, "", "markdown", 0.9), (4, "Other", "csharp", 0.02)], "id long, symbol_name string, language string, rrf_score double")
    got = {r["id"]: round(r["rerank_score"], 6) for r in search.reranked(rows, "public class Shop.Order").collect()}
    assert got == {1: 0.43, 2: 0.85, 3: 0.8, 4: 0.02}
    assert search.reranked(rows.limit(0), "x").count() == 0
    assert {r["id"]: round(r["rerank_score"], 6) for r in search.reranked(rows, "of it").collect()}[2] == 1.0


def test_web_queries(spark):
    words = spark.createDataFrame([(1, ["big", "red", "dog"]), (2, ["red", "big"]), (3, ["cat"]), (4, [])], "id long, w array<string>")
    fits = lambda q: [r["id"] for r in words.filter(lexical.matches(F.col("w"), q)).orderBy("id").collect()]
    assert fits("big red") == [1, 2] and fits('"big red"') == [1] and fits("red -dog") == [2] and fits("dog OR cat") == [1, 3] and fits("") == [] and fits("OR") == [] and fits("big red OR cat") == [1, 2]


def test_cover_density():
    assert lexical.cover_density([[0], [1]]) == 1.0 and lexical.cover_density([[0, 10], [4]]) == pytest.approx(2 / 5 + 2 / 7) and lexical.cover_density([[0], []]) == 0.0


def test_stemming(spark):
    df = spark.createDataFrame([("running",), ("as",), ("walked",)], "w string")
    assert [r[0] for r in df.select(lexical.stemmed(F.col("w"))).collect()] == ["run", "as", "walk"]


def test_budget(spark):
    rows = spark.createDataFrame([(1, "aaaaa"), (2, "bbb"), (3, "cc")], "id long, content string").withColumn("k", F.lit(1))
    assert [(r["id"], r["content"]) for r in search.char_budget(rows, 7, ["k"], F.length("content"), "id").orderBy("id").collect()] == [(1, "aaaaa"), (2, "bb")]


def test_language_of_full_text(spark):
    rows = spark.createDataFrame([(1, "The dogs were walking"), (2, "a cat walks"), (3, "the the")], "id long, x string")
    found = lambda q, language: [r["id"] for r in search.text_topk(rows, F.col("x"), q, 9, language).orderBy("id").collect()]
    assert found("the walked", "english") == [1, 2] and found("dog -cats", "english") == [1] and found("the", "english") == [] and found("the", None) == [1, 3] and found("walk", None) == []
