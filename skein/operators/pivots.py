"""Exact nearest vectors with pruning: vectors lie in buckets around pivots, with their distance to the pivot, and the
triangle inequality tells which buckets, and which rows of them, can hold one of the nearest."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.vector import cosine_distance
from skein.operators.search import ranked

#: Pivots are so many vectors at most, the first by a hash of their ids: a fixed number, so they fit in every task.
PIVOTS = 256
#: Room for the rounding of distances.
ROOM = 1e-6


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def around(pivots: np.ndarray):
    """bucket and radius of (id, embedding): the nearest pivot and the distance to it, of vectors of length one. Bucket -1:
    without a distance, as they are all zero or not as long as the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding").cast(pa.list_(pa.float64()))
            fit = pc.fill_null(pc.equal(pc.list_value_length(vectors), pivots.shape[1]), False).to_numpy(zero_copy_only=False)
            bucket, radius = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            flat = vectors.filter(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).reshape(-1, pivots.shape[1])
            known = np.isfinite(flat).all(1) & (flat != 0).any(1)
            at = np.flatnonzero(fit)[known]
            if len(at):
                cosine = unit(flat[known]) @ pivots.T
                bucket[at] = cosine.argmax(1)
                radius[at] = np.sqrt(np.maximum(0, 2 - 2 * cosine.max(1)))
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(radius), *batch.columns], ["bucket", "radius", *batch.schema.names])

    return run


class VectorIndex:
    """The index under a folder. A bucket is a folder, sorted by radius."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.rows = spark.read.schema("radius double, id long, embedding array<double>, bucket int").parquet(f"{folder}/rows")
        self.pivots = np.array([r["pivot"] for r in spark.read.parquet(f"{folder}/pivots").orderBy("bucket").collect()])
        #: bucket, least and greatest radius, vectors: PIVOTS rows at most
        self.stats = [tuple(r) for r in spark.read.parquet(f"{folder}/stats").collect()]
        #: Vectors that the last query's scans were asked for, and all.
        self.read_rows, self.all_rows = 0, sum(n for *_, n in self.stats)

    @classmethod
    def build(cls, rows: DataFrame, folder: str, pivots: int = PIVOTS) -> VectorIndex:
        """Of rows (id, embedding) with a different id each; null vectors are left out. Without a usable vector all are in
        bucket -1."""
        spark = rows.sparkSession
        some = rows.filter("embedding IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
        whole = some.filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf)) & F.exists("embedding", lambda x: x != 0))
        told = [r["embedding"] for r in whole.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()]
        chosen = unit(np.array([v for v in told if len(v) == len(told[0])], np.float64)) if told else np.zeros((1, 1))
        spark.createDataFrame([(k, p) for k, p in enumerate(chosen.tolist())], "bucket int, pivot array<double>").write.parquet(f"{folder}/pivots")
        placed = some.mapInArrow(around(chosen), "bucket int, radius double, id long, embedding array<double>")
        placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "radius", "id").write.partitionBy("bucket").parquet(f"{folder}/rows")
        known = spark.read.schema("radius double, id long, embedding array<double>, bucket int").parquet(f"{folder}/rows")
        known.groupBy("bucket").agg(F.min("radius").alias("low"), F.max("radius").alias("high"), F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/stats")
        return cls(spark, folder)

    def _scored(self, query: Sequence[float], rows: DataFrame, n: int, live: DataFrame | None) -> DataFrame:
        told = rows.select("id", cosine_distance(F.col("embedding"), query).alias("distance"))
        told = told if live is None else told.join(live.select("id"), "id", "left_semi")
        return told.orderBy(F.col("distance").asc_nulls_last(), F.col("id").asc()).limit(n)

    def topk(self, query: Sequence[float], n: int, live: DataFrame | None = None) -> DataFrame:
        """id, distance, rank of the n nearest; live: of these ids (id) alone. Vectors without a distance come last. The
        nearest buckets are scored first; of the others only rows that may be as near as the n-th are read."""
        order = F.col("distance").asc_nulls_last(), F.col("id").asc()
        q = np.array(query, np.float64)
        usable = bool(len(q) == self.pivots.shape[1] and np.isfinite(q).all() and q.any())
        if not usable:
            self.read_rows = self.all_rows
            return ranked(self._scored(query, self.rows, n, live), *order)
        far = np.sqrt(np.maximum(0, 2 - 2 * (self.pivots @ (q / np.linalg.norm(q)))))
        bound = lambda b, low, high: max(0.0, far[b] - high, low - far[b])
        buckets = sorted(((bound(b, low, high), b, n_) for b, low, high, n_ in self.stats if b >= 0), key=lambda r: (r[0], far[r[1]]))
        seeds, seen = [], 0
        for _, b, n_ in buckets:
            if seen >= 2 * n:
                break
            seeds.append(b)
            seen += n_
        best = [tuple(r) for r in self._scored(query, self.rows.filter(F.col("bucket").isin(*seeds)), n, live).collect()] if seeds else []
        # distance = (length of the difference of unit vectors) ** 2 / 2
        reach = math.sqrt(max(0.0, 2 * best[-1][1])) + ROOM if len(best) == n and best[-1][1] is not None else math.inf
        rest = [b for low, b, _ in buckets[len(seeds) :] if low <= reach] + ([-1] if math.isinf(reach) else [])
        self.read_rows = sum(n_ for b, *_, n_ in self.stats if b in seeds or b in rest)
        found = self.spark.createDataFrame(best, "id long, distance double")
        if rest:
            rows = self.rows.filter(F.col("bucket").isin(*rest))
            if not math.isinf(reach):
                near = F.element_at(F.array(*map(F.lit, far.tolist())), F.col("bucket") + 1)
                rows = rows.filter(F.abs(F.col("radius") - near) <= reach)
            found = found.unionByName(self._scored(query, rows, n, live))
        return ranked(found.orderBy(*order).limit(n), *order)
