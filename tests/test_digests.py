"""Vectors by content and digests of trees."""

import random

import pytest
from pyspark.sql import functions as F

from skein.sources.digests import TreeStore, tree_digests
from skein.sources.vectors import VectorStore, asked, batches

LISTING = "project_id int, path string, content_hash string"


def test_a_failing_batch_is_halved():
    calls = []

    def embed(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise ValueError("no")
        return [[float(len(t))] for t in texts]

    told = asked(["a", "bb", "bad", "cccc"], embed)
    assert told == [([1.0], None), ([2.0], None), (None, "ValueError: no"), ([4.0], None)] and calls == [4, 2, 2, 1, 1]
    assert asked(["a", "b"], lambda texts: [[1.0]]) == [([1.0], None), ([1.0], None)]  # too few vectors: one by one
    assert list(batches(["aa", "b", "cccc", "", "d"], 2, 3)) == [(0, 2), (2, 3), (3, 5)] and list(batches([])) == []


def test_a_text_is_embedded_once(spark, tmp_path):
    store, seen = VectorStore(spark, str(tmp_path / "v")), spark.sparkContext.accumulator(0)

    def embed(texts):
        seen.add(len(texts))
        if any(t == "bad" for t in texts):
            raise ValueError("no")
        return [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, None), (5, "bad")], "id int, text string")
    assert store.missing(rows).count() == 3 and store.fill(rows, embed) == (2, 1)
    assert {r["id"]: r["embedding"] for r in store.attach(rows).collect()} == {1: [1.0, 1.0], 2: [1.0, 1.0], 3: [0.0, 1.0], 4: None, 5: None}
    assert [r["error"] for r in store.errors().collect()] == ["ValueError: no"]
    before = seen.value
    assert store.fill(rows, embed) == (0, 1) and seen.value == before + 1  # only the one that failed is asked for again
    assert store.fill(rows, lambda texts: [[0.0, 0.0] for _ in texts]) == (1, 0) and store.read().count() == 3
    assert store.fill(rows, embed) == (0, 0) and store.fill(rows.filter("false"), embed) == (0, 0)
    scans = [x for x in store.missing(rows)._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x]
    assert scans and not any("embedding" in x for x in scans)  # no stored vector is read to find what is missing
    assert store.attached(rows, embed).filter("embedding IS NOT NULL").count() == 4


def test_digests_of_folders(spark):
    files = [(1, "a/x", "h1"), (1, "a/b/y", "h2"), (1, "z", None), (2, "a/x", "h1")]
    told = {(r["project_id"], r["folder"]): (r["files"], r["digest"]) for r in tree_digests(spark.createDataFrame(files, LISTING)).collect()}
    assert {k: n for k, (n, _) in told.items()} == {(1, ""): 3, (1, "a"): 2, (1, "a/b"): 1, (2, ""): 1, (2, "a"): 1}
    assert told[2, ""][1] == told[2, "a"][1] != told[1, "a"][1] and all(len(d) == 60 for _, d in told.values())
    shuffled = spark.createDataFrame(files[::-1], LISTING).repartition(3)
    assert {(r["project_id"], r["folder"]): (r["files"], r["digest"]) for r in tree_digests(shuffled).collect()} == told


def listing(spark, files):
    return spark.createDataFrame([(p, path, h) for (p, path), h in files.items()], LISTING)


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_against_a_tree_in_memory(spark, tmp_path, seed):
    rng, store, old = random.Random(seed), TreeStore(spark, str(tmp_path / "t"), buckets=4), {}
    for step in range(4):
        new = {k: h for k, h in old.items() if rng.random() > 0.2}
        for k in list(new):
            if rng.random() < 0.2:
                new[k] = f"c{step}"
        for _ in range(rng.randint(1, 6)):
            new[rng.randint(1, 3), f"{rng.choice('abc')}/{rng.randint(0, 5)}"] = rng.choice([None, f"h{rng.randint(0, 9)}"])
        if old and (p := rng.choice(list(old))) in new:
            new[p[0], f"moved/{step}"] = new.pop(p)
        told = {(r["project_id"], r["path"], r["change"], r["old_path"]) for r in store.changes(listing(spark, new)).collect()}
        came, went = [k for k in new if k not in old], [k for k in old if k not in new]
        wanted, gone = set(), set()
        for k in came:
            same = [w for w in went if new[k] is not None and w[0] == k[0] and old[w] == new[k]]
            if len(same) == 1 and sum(c[0] == k[0] and new[c] == new[k] for c in came) == 1:
                wanted.add((*k, "renamed", same[0][1]))
                gone.add(same[0])
            else:
                wanted.add((*k, "created", None))
        wanted |= {(*k, "deleted", None) for k in went if k not in gone}
        edited = {(*k, "changed", None) for k in new if k in old and old[k] != new[k]}
        # a file without a hash is told of if its folder is compared, so it may be but need not
        unsure = {(*k, "changed", None) for k in new if k in old and old[k] is None and new[k] is None}
        assert wanted | edited <= told <= wanted | edited | unsure
        store.commit(listing(spark, new))
        assert store.changes(listing(spark, new)).count() == 0 and store.commit(listing(spark, new)) == []
        old = new


def test_only_changed_buckets_are_read(spark, tmp_path):
    store = TreeStore(spark, str(tmp_path / "t"), buckets=16)
    files = {(p, f"f{d}/{k}"): f"h{k}" for p in range(8) for d in range(10) for k in range(3)}
    assert len(store.commit(listing(spark, files))) == 16
    files[3, "f4/1"] = "new"
    above, dirty, folders = store.changed(listing(spark, files))
    assert len(above) == len(dirty) == 1 and [tuple(r) for r in folders.collect()] == [(3, "f4")]
    told = store.changes(listing(spark, files))
    assert [tuple(r) for r in told.collect()] == [(3, "changed", "f4/1", None)]
    scans = [x for x in told._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x and "path#" in x]
    assert scans and all("(bucket#" in x and f" = {dirty[0]})" in x for x in scans)
    assert store.commit(listing(spark, files)) == dirty
    del files[3, "f4/0"], files[3, "f4/1"], files[3, "f4/2"]
    assert {r["path"] for r in store.changes(listing(spark, files)).filter("change = 'deleted'").collect()} == {"f4/0", "f4/1", "f4/2"}
    store.commit(listing(spark, files))
    assert store.changes(listing(spark, files)).count() == 0 and store.changes(listing(spark, {})).count() == len(files)


def test_rows_without_project_or_path_and_a_tree_that_vanishes(spark, tmp_path):
    store = TreeStore(spark, str(tmp_path / "t"))
    odd = spark.createDataFrame([(None, "a", "h"), (1, None, "h"), (1, "x:y/z", "h")], LISTING)
    assert [tuple(r) for r in store.changes(odd).collect()] == [(1, "created", "x:y/z", None)]
    store.commit(odd)
    assert [tuple(r) for r in store.changes(odd.filter("false")).collect()] == [(1, "deleted", "x:y/z", None)]
    store.commit(odd.filter("false"))
    assert store.changes(odd.filter("false")).count() == 0
    assert store.changes(odd.withColumn("digest", F.lit("d"))).count() == 1
