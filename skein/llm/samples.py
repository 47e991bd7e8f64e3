"""Bounded, repeatable samples of rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: How many times the wanted ids pass the first sieve: room for the error of the estimated counts.
ROOM = 4


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def picked_ids(known: DataFrame, label: str, most: Column) -> DataFrame:
    """Of known (doc_id, label): for each value of the label most distinct ids at most, first in the order of a hash.

    Two passes over two columns, for all values at once: estimated counts of ids, then the ids whose hash lies in the
    share that is needed; only those are shuffled. The label's values are a classifier's classes, hence the broadcast."""
    held = known.groupBy(label).agg(F.approx_count_distinct("doc_id").alias("held"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).cast("double") / (1 << 30)
    near = known.join(F.broadcast(held), label).filter(place * F.col("held") <= most * ROOM).select(label, "doc_id").distinct()
    order = W.partitionBy(label).orderBy(F.xxhash64("doc_id"), "doc_id")
    return near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select(label, "doc_id")


def bounded_texts(texts: DataFrame, label: str, most_bytes: int) -> DataFrame:
    """Of texts (doc_id, label, text), with a bounded number of ids: label and text, one row an id (the least text); in
    the order of the ids' hash, as long as they have most_bytes at most together for a value of the label."""
    one = texts.groupBy(label, "doc_id").agg(F.min("text").alias("text")).withColumn("size", F.octet_length("text").cast("long"))
    order = W.partitionBy(label).orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return one.withColumn("seen", F.sum("size").over(order)).filter(F.col("seen") <= most_bytes).select(label, "text")
