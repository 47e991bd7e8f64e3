"""Nearest vectors with pruning against a full scan."""

import random

import pytest

from skein.operators import search
from skein.operators.pivots import VectorIndex


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(30)]
    made = [(i, [x + rng.gauss(0, 0.05) for x in centres[i % 30]]) for i in range(3000)]
    made += [(4000, None), (4001, [0.0] * 8), (4002, [1.0] * 3), (4003, [float("nan")] + [1.0] * 7), (4004, [None] + [1.0] * 7)] + [(5000 + i, centres[0]) for i in range(40)]
    return spark.createDataFrame(made, "id long, embedding array<double>")


def test_like_a_full_scan(spark, rows, tmp_path):
    plain = rows.filter("id NOT IN (4003)")  # a vector of no number has no place among distances
    index = VectorIndex.build(plain, str(tmp_path), pivots=32)
    live = plain.filter("id % 7 <> 0").select("id")
    by_id = {r["id"]: r["embedding"] for r in plain.collect()}
    for query, n, only in ((by_id[3], 10, None), ([-x for x in by_id[4]], 50, live), (by_id[5000], 60, None), ([1.0] * 8, 4000, None)):
        wanted = plain if only is None else plain.join(only, "id", "left_semi")
        found = index.topk(query, n, only).orderBy("rank").collect()
        told = search.vector_topk(wanted, query, n).orderBy("rank").collect()
        assert [(r["id"], r["rank"]) for r in found] == [(r["id"], r["rank"]) for r in told]
        assert [r["distance"] for r in found] == pytest.approx([r["distance"] for r in told], abs=1e-12)
    index.topk(by_id[3], 10)
    assert index.read_rows < index.all_rows / 4


def test_odd_tables(spark, rows, tmp_path):
    empty = VectorIndex.build(rows.limit(0), str(tmp_path / "a"))
    assert empty.topk([1.0] * 8, 3).count() == 0
    odd = VectorIndex.build(rows.filter("id BETWEEN 4000 AND 4002"), str(tmp_path / "b"))
    assert [r["id"] for r in odd.topk([1.0] * 3, 5).orderBy("rank").collect()] == [4002, 4001]
    zero = VectorIndex.build(rows.filter("id IN (1, 4001)"), str(tmp_path / "c"))
    assert [r["id"] for r in zero.topk([0.0] * 8, 5).orderBy("rank").collect()] == [1, 4001]
