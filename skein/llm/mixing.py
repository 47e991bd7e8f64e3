"""Mixing sources to target weights: sizes are summed a source, a target size over the size is a source's rate, and each
document is emitted floor(rate) times, and once more if its hash-seeded draw falls under the fraction of the rate.

All sizes times SHARE / 100 are shared among the sources by weight. A target stops at MOST times its source's size, and the
excess is shared again by weight until no target is above; that is one level for all, target = min(MOST * size, level *
weight), found exactly by radix passes over the sizes at which sources stop, so that there may be any number of sources.

The draw of a document is a hash of the seed, its id and its text: it does not depend on order or partitions, so reruns
agree. Documents are drawn independently of each other: a source's taken words have the target as their mean, and the
square root of fraction * (1 - fraction) * the sum of its documents' squared sizes as their deviation.

Cases: a null text has no words, and neither it nor an empty one takes any; very long texts count whole; null is a source of
its own, the last; a null id is hashed as an empty one; equal rows are drawn alike and count each; a source without words
has the target 0; an empty table gives no rows; further columns, whatever their names, are ignored by mixed() and passed on
by emitted().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import stored, table
from skein.llm.ranking import first_value, ranked

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, MOST, SEED = 150, 2, 11


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def draw_of(doc_id: Column, text: Column, seed: int) -> Column:
    """0 to 1, from 52 bits of a hash."""
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.sha2(name, 256), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def cycled(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size and the weight of each source: the weights in turn, sources by code point, null last."""
    places = ranked(sizes, [F.col("source").asc_nulls_last()], "place")
    chosen = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    return places.select("source", "source_size", chosen.alias("weight"))


def targets(weighted: DataFrame, share: int = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target of sources with a positive whole weight. weighted: a stored table."""
    kinds = [w for (w,) in weighted.select("weight").distinct().limit(1001).collect()]
    if len(kinds) > 1000 or any(w is None or w < 1 for w in kinds):
        raise ValueError("weights: at most 1000 different whole numbers from 1")
    unit = math.lcm(*kinds)
    total, total_weight, largest = weighted.agg(F.sum("source_size"), F.sum("weight"), F.max("source_size")).head()
    if (largest or 0) * most * unit >= 1 << 63:
        raise ValueError("weights have too large a common multiple")
    stops = weighted.withColumn("stop", F.col("source_size") * most * F.expr(f"{unit} div weight"))  # unit * the level at which it stops

    def fits(here: dict[str, int], stop: int) -> bool:
        """Whether the share lasts until the level at which this source stops."""
        return 100 * (unit * most * here["size"] + (total_weight - here["weight"]) * stop) <= unit * share * total

    first, full = first_value(stops, "stop", {"size": F.sum("source_size"), "weight": F.sum("weight")}, fits)
    cap = F.col("source_size") * F.lit(float(most))
    if first is None:
        return stops.select("source", "source_size", cap.alias("target"))
    level = (share / 100 * total - most * full["size"]) / (total_weight - full["weight"])
    return stops.select("source", "source_size", F.when(F.col("stop") < first, cap).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def copies_of(source_size: Column, target: Column, draw: Column) -> Column:
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    return F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")


def with_rates(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """rows with source_size and target of their source."""
    goals = goals.select(F.col("source").alias("mx_source"), F.col("source_size").alias("mx_source_size"), F.col("target").alias("mx_target"))
    return rows.join(goals, F.col("source").eqNullSafe(F.col("mx_source"))).drop("mx_source")


def measured(docs: DataFrame, seed: int = SEED) -> DataFrame:
    return stored(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), draw_of(F.col("doc_id"), F.col("text"), seed).alias("draw")), "sizes")


def rates(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size and target from measured() rows."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    return stored(targets(stored(cycled(sources, weights), "weights"), share, most), "targets")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every row. The texts are read once."""
    sizes = measured(docs, seed)
    rows = with_rates(sizes, rates(sizes, weights, share, most))
    return rows.select("doc_id", "source", "size", F.col("mx_source_size").alias("source_size"), F.col("mx_target").alias("target"), copies_of(F.col("mx_source_size"), F.col("mx_target"), F.col("draw")).alias("copies"))


def emitted(docs: DataFrame, goals: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: every row of docs as often as the source's target asks. goals: of rates()."""
    rows = with_rates(docs.select(F.struct("*").alias("row"), "source"), goals)
    copies = copies_of(F.col("mx_source_size"), F.col("mx_target"), draw_of(F.col("row.doc_id"), F.col("row.text"), seed))
    often = F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies)).otherwise(F.array().cast("array<bigint>"))
    return rows.select("row", F.explode(often)).select("row.*")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || substr(sha256('11:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT / 4503599627370496::DOUBLE AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
k AS (SELECT *, 2 * n * (10 // w) AS stop FROM s),
c AS (SELECT stop, sum(2 * n) OVER (ORDER BY stop) AS full_n, sum(w) OVER (ORDER BY stop) AS full_w FROM k),
t AS (SELECT sum(n) AS n, sum(w) AS w FROM s),
b AS (SELECT coalesce(max(full_n), 0) AS full_n, coalesce(max(full_w), 0) AS full_w, coalesce(max(stop), -1) AS last FROM c, t WHERE 100 * (10 * full_n + (t.w - full_w) * stop) <= 10 * 150 * t.n),
g AS (SELECT source, k.n AS source_size, CASE WHEN stop <= last THEN k.n * 2::DOUBLE ELSE k.w * ((1.5::DOUBLE * t.n - b.full_n) / (t.w - b.full_w)) END AS target FROM k, t, b),
r AS (SELECT doc_id, size, draw, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM r
"""
