"""Product codes of vectors by Lloyd's rounds that are maintained by differences.

Each vector is cut into parts, and each part is coded by the nearest entry of its codebook. The codes of the last round are
kept with the vectors, and so are the running whole-number sums and counts of every entry. A round recodes each vector; only
parts whose code changed give a minus for the old entry and a plus for the new one, which are summed in the tasks before they
are shuffled, so at most one row a part and entry leaves a task whatever the sizes of the groups. Codebooks are of a fixed
size (parts x entries x width, 4096 numbers for 64 components), so they go to the tasks with their code.

Cases: a null vector, or one with a null, NaN or infinite component, is dropped; so is one that isn't as long as that of the
least kept id, or whose length isn't a positive multiple of the parts. Components beyond +-2 ** 18 count as that, which keeps
sums of squares exact. Fewer vectors than entries give a codebook of as many entries. Null ids come last, ties of ids go by
the vector; equal rows each count; labels that are null are one; an empty table gives no rows; further columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import bounded_batches, passing_tables, stored, table, trimmed

PARTS, ENTRIES, ROUNDS, SCALE, LIMIT = 16, 64, 2, 256, 1 << 26


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (array of int) of the vectors whose components are all finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("e")).filter("e IS NOT NULL").filter(F.forall("e", finite))
    number = lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x * SCALE))).cast("int")
    return kept.select("vec_id", "label", F.transform("e", number).alias("v"))


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """parts x entries x width numbers: the parts of the least ids. None if there is nothing to code."""
    first = [v for _, v in rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()]
    if not first or not first[0] or len(first[0]) % parts:
        return None
    width = len(first[0])
    least = rows.filter(F.size("v") == width).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    return np.array([r["v"] for r in least], np.int64).reshape(len(least), parts, width // parts).transpose(1, 0, 2)


def nearest(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes (rows x parts) and the summed squared distances of vectors; ties go to the lower entry. All in int64."""
    parts, _, width = books.shape
    codes, error = np.empty((len(vectors), parts), np.uint8), np.zeros(len(vectors), np.int64)
    for p in range(parts):
        x, c = vectors[:, p * width : (p + 1) * width], books[p]
        distance = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
        codes[:, p] = distance.argmin(1)
        error += distance.min(1)
    return codes, error


def matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().astype(np.int64).reshape(-1, width)


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """rows with code, its last one as before (empty in the first round) and error."""
    width = books.shape[0] * books.shape[2]

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 4096):
                batch = whole.slice(begin, 4096)
                codes, error = nearest(matrix(batch, width), books)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("vec_id", "label", "v")), batch.column("code"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)],
                    ["vec_id", "label", "v", "before", "code", "error"])

    return rows.mapInArrow(run, "vec_id long, label string, v array<int>, before binary, code binary, error long")


def differences(rows: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """part, entry, n, sums (array): what the parts whose code changed add to and take from each entry."""
    parts, entries, width = shape

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            v = matrix(batch, parts * width).reshape(-1, parts, width)
            new = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            first = np.array([len(x.as_py()) == 0 for x in batch.column("before")], bool)
            old = np.frombuffer(b"".join(x or bytes(parts) for x in batch.column("before").to_pylist()), np.uint8).reshape(-1, parts)
            moved = (old != new) | first[:, None]
            for sign, codes, which in ((1, new, moved), (-1, old, moved & ~first[:, None])):
                row, part = np.nonzero(which)
                np.add.at(n, (part, codes[row, part]), sign)
                np.add.at(sums, (part, codes[row, part]), sign * v[row, part])
        part, entry = np.nonzero((n != 0) | (sums != 0).any(2))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    changed = rows.filter("code <> before").select("v", "before", "code")
    partial = changed.mapInArrow(run, "part int, entry int, n long, sums array<long>")
    return partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(width))).alias("sums"))


def trained(rows: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """rows with the codes of the last round before the end, and the final codebooks."""
    n, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
    for _ in range(rounds):
        rows = stored(coded(rows, books).select("vec_id", "label", "v", "before", "code"), "codes")
        for part, entry, more, plus in differences(rows, books.shape).collect():  # at most one row a part and entry
            n[part, entry] += more
            sums[part, entry] += np.array(plus, np.int64)
        books = np.where(n[..., None] > 0, np.floor_divide(sums, np.maximum(n, 1)[..., None]), books)
        rows = rows.drop("before")
    return rows, books


def product_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code (a byte a part), error of every kept vector, and the codebooks. At most 256 entries."""
    if not 1 <= entries <= 256:
        raise ValueError("entries: 1 to 256")
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = whole_numbers(vectors)
    books = first_books(rows, parts, entries)
    if books is None:
        return spark.createDataFrame([], "vec_id long, label string, code binary, error long"), np.zeros((parts, 0, 0), np.int64)
    rows = rows.filter(F.size("v") == books.shape[0] * books.shape[2]).withColumn("code", F.lit(b""))
    with passing_tables(spark):
        rows, books = trained(rows, books, rounds)
        return stored(coded(rows, books).select("vec_id", "label", "code", "error"), "coded", outside=True), books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = product_codes(table(spark, sf_dir, "embeddings"))
    per = found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return found.join(per, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


OP13_SQL = """
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT r, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS x FROM v, range(16) t(p)),
b0 AS (SELECT p, r - 1 AS k, x AS c FROM x WHERE r <= 64),
a0 AS (SELECT r, p, min(d * 256 + k) % 256 AS k FROM (SELECT r, p, k, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN b0 USING (p)) GROUP BY r, p),
m0 AS (SELECT p, k, i, (sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS m FROM a0 JOIN x USING (r, p), range(1, 5) t(i) GROUP BY p, k, i),
b1 AS (SELECT p, k, coalesce(n.c, b0.c) AS c FROM b0 LEFT JOIN (SELECT p, k, list(m ORDER BY i) AS c FROM m0 GROUP BY p, k) n USING (p, k)),
a1 AS (SELECT r, p, min(d * 256 + k) % 256 AS k FROM (SELECT r, p, k, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN b1 USING (p)) GROUP BY r, p),
m1 AS (SELECT p, k, i, (sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS m FROM a1 JOIN x USING (r, p), range(1, 5) t(i) GROUP BY p, k, i),
b2 AS (SELECT p, k, coalesce(n.c, b1.c) AS c FROM b1 LEFT JOIN (SELECT p, k, list(m ORDER BY i) AS c FROM m1 GROUP BY p, k) n USING (p, k)),
e AS (SELECT r, p, min(d * 256 + k) AS e FROM (SELECT r, p, k, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN b2 USING (p)) GROUP BY r, p),
f AS (SELECT r, string_agg(lpad(lower(hex(e % 256)), 2, '0'), '' ORDER BY p) AS code, sum(e // 256)::BIGINT AS error FROM e GROUP BY r),
s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS s FROM b2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, s.s AS codebooks_sha256 FROM v JOIN f USING (r), s
"""
