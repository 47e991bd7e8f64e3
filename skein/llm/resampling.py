"""Importance resampling towards a target distribution: documents are scored by how much likelier their hashed word runs
are in a target corpus than in all documents, and the k best of scores with Gumbel noise are drawn, which is a sample
without replacement in proportion to the exponentials of the weights.

Runs of words fall into BUCKETS buckets. Tasks count them in an array each; the summed arrays of both corpora give an array
of gains, of a fixed size, with which every document is scored. The draw finds the exact k-th key (score, then id) by radix
passes over digits of the stored scores; only the rows up to it are range-sorted and ranked.

Cases: a null or empty text, or one without words, has no features and weighs 0; texts of any length are read whole; a null
id is hashed as an empty one and comes after all others among equal scores; equal rows each count, and of rows equal in
score and id those with fewer features come first; with an empty target or no documents at all every gain comes from the
smoothing alone; under 20 words a document is scored but never drawn; an empty table gives no rows; further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import SEPARATORS, bounded_batches, stored, table, trimmed
from skein.llm.ranking import kth_key, ranked, up_to

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
KEY = ["key_score", "key_null", "key_id", "key_features", "key_row"]


def bucketed(texts: pa.Array, buckets: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2... longest words: the text and the bucket of each."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")), SEPARATORS)
    words, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
    some = pc.not_equal(words, "")
    words, owner = words.filter(some), owner.filter(some).to_numpy()
    runs = words
    for n in range(1, longest + 1):
        if n > 1:
            runs = pc.binary_join_element_wise(runs[: max(0, len(runs) - 1)], words[n - 1 :], pa.scalar(" ", words.type))
        whole = owner[: max(0, len(owner) - n + 1)] == owner[n - 1 :]
        found = runs.filter(pa.array(whole)).dictionary_encode()
        places = np.fromiter((zlib.crc32(w) % buckets for w in found.dictionary.cast(pa.large_binary()).to_pylist()), np.int64, len(found.dictionary))
        yield owner[: len(whole)][whole], places[found.indices.to_numpy()]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket that has any."""

    @trimmed
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, places in bucketed(batch.column(0), buckets, longest):
                seen += np.bincount(places, minlength=buckets)
        full = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(seen[full], pa.int64())], ["bucket", "n"])

    return texts.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def counts_array(counts: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for bucket, n in counts.collect():  # at most one row a bucket
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket: thousandths of the logarithm of the smoothed ratio of its shares, rounded down."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""

    @trimmed
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total, words = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for length, (owner, places) in enumerate(bucketed(batch.column("text"), len(gain), longest)):
                here = np.bincount(owner, minlength=batch.num_rows)
                words, n = words if length else here, n + here
                total += np.bincount(owner, gain[places], batch.num_rows).astype(np.int64)  # exact: far below 2 ** 53
            weight = np.floor_divide(total, np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from 32 bits of a hash of the seed and the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def drawn(scores: DataFrame, k: int) -> DataFrame:
    """scores (doc_id, n_features, weight, score; stored) of the rows that may be drawn, with rank: 1 to k, else null."""
    row = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))  # tells equal rows apart
    keys = {"key_score": F.bitwise_not("score"), "key_null": F.col("doc_id").isNull().cast("long"), "key_id": F.coalesce("doc_id", F.lit(0).cast("long")), "key_features": F.col("n_features"), "key_row": row}
    keyed = scores.select("doc_id", "n_features", "weight", "score", *(c.alias(n) for n, c in keys.items()))
    last = kth_key(keyed, KEY, k) if k else None
    none = F.lit(None).cast("long").alias("rank")
    if last is None:
        return scores.select("doc_id", "n_features", "weight", "score", none)
    best = ranked(keyed.filter(up_to(KEY, last)), [F.col(c) for c in KEY], "rank").select("doc_id", "n_features", "weight", "score", "rank")
    return best.unionByName(keyed.filter(~up_to(KEY, last)).select("doc_id", "n_features", "weight", "score", none))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs; percent of those of least_words are drawn."""
    bounded_batches(docs.sparkSession)
    gain = gains(*(counts_array(bucket_counts(t, buckets, longest), buckets) for t in (docs, target)))
    rows = weighed(docs, gain, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    rows = stored(rows, "scores")
    may = F.col("n_words") >= least_words
    found = drawn(rows.filter(may), percent * rows.filter(may).count() // 100)
    return found.unionByName(rows.filter(~may).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: crc32 is written out: the CRC's table, then a step for each byte of each different word.
OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS w FROM benchmark),
sw AS (SELECT rid, unnest(w) AS w FROM d),
k AS (SELECT list(c ORDER BY i) AS k FROM (SELECT i, list_reduce([i] || range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) t(i))),
v AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM sw UNION SELECT w FROM b)),
c AS (SELECT w, xor(list_reduce([4294967295] || list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT), lambda a, x: xor(a >> 8, k[1 + (xor(a, x) & 255)])), 4294967295) % 10000 AS g FROM v, k),
s AS (SELECT g, count(*) AS s FROM sw JOIN c USING (w) GROUP BY g),
t AS (SELECT g, count(*) AS t FROM b JOIN c USING (w) GROUP BY g),
n AS (SELECT (SELECT count(*) FROM sw) AS s, (SELECT count(*) FROM b) AS t),
gain AS (SELECT s.g, floor(1000 * ln((coalesce(t.t, 0) + 1)::DOUBLE * (n.s + 10000) / ((s.s + 1)::DOUBLE * (n.t + 10000))))::BIGINT AS x FROM s LEFT JOIN t USING (g), n),
e AS (SELECT rid, count(*) AS n, floor(sum(x) / count(*))::BIGINT AS weight FROM sw JOIN c USING (w) JOIN gain USING (g) GROUP BY rid),
h AS (SELECT rid, doc_id, coalesce(e.n, 0) AS n_features, coalesce(e.weight, 0) AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN e USING (rid)),
f AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM h),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS n FROM f WHERE n_features >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= 10 * r.n // 100 THEN rank END::BIGINT AS rank FROM f LEFT JOIN r USING (rid)
"""
