"""The inverted index against reading every text."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.fixtures import Tables
from skein.functions import lexical
from skein.operators import postings, search
from skein.operators.postings import TextIndex

def scans_of(df, name):
    """The scans of a table in df's plan, in full."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        again = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    return [x for x in again.split("\n") if "FileScan" in x and name in x]


QUERIES = ["the", "of the", '"of the"', "thble OR thatin", "the -of", '"of the" OR "in the" and', "-the", "-the OR and", "nosuchword", "", "the nosuchword", "OR", 'the OR -of and "the of"']


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(9)
    words = ["the", "of", "and", "in", "thble", "thatin", "é9", "Big", "x"]
    made = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 20, 60])))) for i in range(400)]
    made += [(1000, None), (1001, ""), (1002, "the " * 500), (1003, ", ; !"), (1004, "of the " * 3000)] + [(2000 + i, "the same text of all") for i in range(50)]
    return spark.createDataFrame(made, "id long, x string")


@pytest.mark.parametrize("language", [None, "english"])
def test_like_reading_every_text(spark, rows, tmp_path, language):
    index = TextIndex.build(rows, F.col("x"), str(tmp_path), language)
    live = rows.filter("id % 3 <> 0").select("id")
    for k, query in enumerate(QUERIES if language is None else QUERIES[:5]):
        words = lexical.tokens(F.col("x"), language)
        assert {r["id"] for r in index.matches(query).collect()} == {r["id"] for r in rows.filter(lexical.matches(words, query, language)).collect()}, query
        n, only = ((3, None), (30, live))[k % 2]
        found = [tuple(r) for r in index.topk(query, n, only).orderBy("rank").collect()]
        assert found == [tuple(r) for r in search.text_topk(rows, F.col("x"), query, n, language, only).orderBy("rank").collect()], query


def test_only_the_terms_and_blocks_that_can_win_are_read(spark, tmp_path):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 500 == 0, F.concat(F.repeat(F.lit("red "), (F.col("id") / 500 + 2).cast("int")), F.lit("dog"))).otherwise("red cat").alias("x"))
    index = TextIndex.build(rows, F.col("x"), str(tmp_path))
    found = index.topk("red", 5).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in found] == [(19_500 - 500 * k, 41.0 - k) for k in range(5)]
    assert index.known_blocks == postings.BLOCKS and index.read_blocks < 40
    scans = scans_of(index.matches("red dog", [3], score=True), "postings")
    assert scans and all("In(term, [dog,red])" in x and "EqualTo(block,3)" in x for x in scans)


def test_rows_are_read_late(spark, sf_dir):
    """Whole rows are read for the k ids alone: their filter reaches both tables' scans."""
    found = search.search_rules(Tables(spark, sf_dir), [0.1] * 64, "the", 5)
    assert all("In(doc_id, [" in x for name in ("documents", "labels") for x in scans_of(found, f"{name}.parquet") if "text" in x or name == "labels")
    assert found.count() == 5


def test_postings_are_unpacked_by_generated_code(spark):
    n, per = 20_000, 10
    found = spark.range(1).select(F.lit("w").alias("term"), F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")).alias("ids"), F.sequence(F.lit(1), F.lit((n - 1) * per + 1), F.lit(per)).alias("starts"), F.sequence(F.lit(0), F.lit(n * per - 1)).alias("places"))
    one = postings.unpacked(found)
    ids, places, wrong = one.agg(F.count_distinct("id"), F.sum("n"), F.count_if((F.size("places") != per) | (F.col("places")[0] != F.col("id") * per) | (F.col("places")[per - 1] != F.col("id") * per + per - 1))).head()
    assert (ids, places, wrong) == (n, n * per, 0)
    assert "lambda" not in one._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_postings_are_in_the_order_of_files():
    words = pa.array([["a", "b"], ["b"], ["b", "a", "b"], []] * 50)
    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array([(k * 37) % 1024 for k in range(200)], pa.int32()), words], ["id", "block", "words"])
    blocks, seen = batch.column("block").to_pylist(), set()
    for out in postings.places(iter([batch])):
        for term, ids, starts, where in zip(*(out.column(c).to_pylist() for c in ("term", "ids", "starts", "places")), strict=True):
            assert ids == sorted(ids, key=lambda i: (blocks[i], i))
            for i, begin, end in zip(ids, starts, [*starts[1:], len(where) + 1], strict=True):
                assert where[begin - 1 : end - 1] == [k for k, w in enumerate(words[i].as_py()) if w == term]
                seen.add((term, i))
    assert seen == {(w, i) for i, ws in enumerate(words.to_pylist()) for w in ws}
