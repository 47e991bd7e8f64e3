"""Chunks that change batch by batch, against a table in memory."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skein.fixtures import Tables
from skein.plans.queries import QUERIES, _least_chunks
from skein.sources.folders import glob
from skein.sources.store import ChunkStore

CHUNK = "id long, project_id int, file_path string, language string, content string, content_hash string, updated_at timestamp"


def rows_of(df):
    return {(r["project_id"], r["file_path"], r["content_hash"]): (r["id"], r["language"], r["content"]) for r in df.collect()}


def batch(spark, rows):
    return spark.createDataFrame([(i, 1, path, language, content, digest, datetime(2024, 1, 1)) for i, path, language, content, digest in rows], CHUNK)


def bucket_of(spark, store, path):
    return spark.createDataFrame([(1, path)], "project_id int, file_path string").select(store.bucket()).head()[0]


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_against_a_table_in_memory(spark, tmp_path, seed):
    rng, store, told = random.Random(seed), ChunkStore(spark, str(tmp_path), buckets=4), {}
    for number in range(6):
        put = [(rng.randint(1, 99), f"f{rng.randint(0, 7)}", rng.choice("ab"), f"c{number}", f"h{rng.randint(0, 2)}") for _ in range(rng.randint(0, 6))]
        put = list({(p[1], p[4]): p for p in put}.values())
        gone = {f"f{rng.randint(0, 7)}" for _ in range(rng.randint(0, 2))}
        store.write(batch(spark, put), spark.createDataFrame([(1, g) for g in gone], "project_id int, file_path string"))
        told = {k: v for k, v in told.items() if k[1] not in gone}
        for i, path, language, content, digest in put:
            old = told.get((1, path, digest))
            told[1, path, digest] = (old[0], old[1], content) if old else (i, language, content)
        if rng.random() < 0.4:
            store.compact(rng.choice([1, 2]))
        assert rows_of(store.read()) == told
    store.compact()
    assert rows_of(ChunkStore(spark, str(tmp_path)).read()) == told and not store.changes()
    assert store.next_number() == 6


def test_a_batch_touches_its_buckets_alone(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path), buckets=16)
    store.write(batch(spark, [(k, f"file{k}", "x", "old", "h") for k in range(200)]))
    assert store.compact() == [] and len(glob(spark, f"{tmp_path}/rows/bucket=*")) == 16  # the first batch is rows at once
    before = {p: tuple(glob(spark, f"{p}/*.parquet")) for p in glob(spark, f"{tmp_path}/rows/bucket=*")}
    store.write(batch(spark, [(k, f"file{k}", "x", "new", "h") for k in (3, 5)]))
    mine = {bucket_of(spark, store, f"file{k}") for k in (3, 5)}
    assert {b for _, b in store.changes()} == mine
    one = store.read_files(spark.createDataFrame([(1, "file3")], "project_id int, file_path string"))
    assert [(r["file_path"], r["content"]) for r in one.collect()] == [("file3", "new")]
    scans = [x for x in one._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in x]
    number = bucket_of(spark, store, "file3")
    assert scans and all(f"(bucket#" in x and f" = {number})" in x for x in scans)  # of every scan
    scans = [x for x in store.read()._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in x and "/rows" in x]
    assert sum("NOT bucket" in x for x in scans) == 1 and all("PartitionFilters: [" in x and "bucket#" in x.split("PartitionFilters: [")[1] for x in scans)  # the others without a shuffle, the changed ones apart
    assert sorted(store.compact()) == sorted(mine)
    after = {p: tuple(glob(spark, f"{p}/*.parquet")) for p in before}
    assert {int(p.rsplit("=", 1)[1]) for p in before if before[p] != after[p]} == mine


def test_what_is_cut_off_is_done_again(spark, tmp_path, monkeypatch):
    store = ChunkStore(spark, str(tmp_path), buckets=2)
    store.write(batch(spark, [(1, "a", "x", "1", "h"), (2, "b", "x", "1", "h")]), number=0)
    store.write(batch(spark, [(9, "a", "y", "2", "h")]), spark.createDataFrame([(1, "b")], "project_id int, file_path string"), number=1)
    store.write(batch(spark, [(9, "a", "y", "2", "h")]), spark.createDataFrame([(1, "b")], "project_id int, file_path string"), number=1)  # the batch comes again
    wanted = {(1, "a", "h"): (1, "x", "2")}
    assert rows_of(store.read()) == wanted
    import skein.sources.store as module

    calls, real = [], module.delete

    def failing(spark_, folder):
        calls.append(folder)
        if len(calls) == 2:
            raise OSError("lost")
        real(spark_, folder)

    monkeypatch.setattr(module, "delete", failing)
    with pytest.raises(OSError):
        store.compact()
    assert rows_of(ChunkStore(spark, str(tmp_path)).read()) == wanted and not ChunkStore(spark, str(tmp_path)).changes()
    store.write(batch(spark, []), spark.createDataFrame([(1, "a")], "project_id int, file_path string"))
    store.compact()
    assert rows_of(store.read()) == {} and store.next_number() == 3


def test_equal_keys_in_a_batch_and_empty_batches(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path))
    assert store.read().count() == 0 and store.compact() == []
    twice = batch(spark, [(1, "a", "x", "old", "h")]).unionByName(batch(spark, [(2, "a", "x", "new", "h")]).withColumn("updated_at", F.lit(datetime(2025, 1, 1))))
    store.write(twice)
    assert rows_of(store.read()) == {(1, "a", "h"): (2, "x", "new")}
    store.write(batch(spark, []))
    assert store.read().count() == 1


def test_store_merge_makes_its_batches_from_what_is_stored(spark, sf_dir, monkeypatch):
    plans, real = [], ChunkStore.write

    def told(store, put, *more):
        plans.append(put._jdf.queryExecution().executedPlan().toString())
        return real(store, put, *more)

    monkeypatch.setattr(ChunkStore, "write", told)
    assert QUERIES["store_merge"](spark, sf_dir).count()
    assert "Window" not in plans[0] and all("Exchange" not in p for p in plans[1:])  # texts go to the joins of the first batch, and to buckets


def test_what_is_wanted_of_a_content(spark, tmp_path):
    """over changed buckets and others, the same as of whole contents; only that goes through the shuffle."""
    store, of = ChunkStore(spark, str(tmp_path), buckets=4), lambda content: F.length(content)
    store.write(batch(spark, [(k, f"f{k}", "x", "a" * k, "h") for k in range(9)]))
    assert rows_of(store.read(of)) == {(1, f"f{k}", "h"): (k, "x", k) for k in range(9)}
    store.write(batch(spark, [(50, "f3", "y", "b" * 40, "h"), (51, "f4", "y", "c" * 41, "h")]), spark.createDataFrame([(1, "f4")], "project_id int, file_path string"))
    told = {(1, f"f{k}", "h"): (k, "x", k) for k in range(9)} | {(1, "f3", "h"): (3, "x", 40), (1, "f4", "h"): (51, "y", 41)}
    assert rows_of(store.read(of)) == told == {k: (i, language, len(content)) for k, (i, language, content) in rows_of(store.read()).items()}
    lines = store.read(of)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    dealt = next(k for k, x in enumerate(lines) if "RepartitionByExpression" in x)
    assert any("length(content" in x for x in lines[dealt:])


def test_least_chunks_of_copies(spark, tmp_path):
    rows = [(3, "same", "de", "src1"), (53, "same", "de", "src1"), (103, "other", "de", "src1"), (153, None, "de", "src1"), (203, None, "de", "src1"), (4, "same", "de", "src1")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(53, [1.0]), (103, [2.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {r["id"]: r["embedding"] for r in _least_chunks(Tables(spark, str(tmp_path))).collect()}
    assert found == {3: None, 4: None, 103: [2.0], 153: None}
