"""What has changed between two listings of a source tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def listing_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """change (created, changed, deleted, renamed), path and, of a renamed file, old_path; both listings: path (a row each)
    and content_hash. A file is renamed if its content is that of exactly one new and one vanished path; else both are told
    of apart. Files without a hash are changed if they are in both, and never renamed."""
    old = before.select("path", F.col("content_hash").alias("old"), F.lit(True).alias("was"))
    new = after.select("path", F.col("content_hash").alias("new"), F.lit(True).alias("is"))
    both = old.join(new, "path", "full_outer")
    change = F.when(F.col("was").isNull(), "created").when(F.col("is").isNull(), "deleted").when(F.coalesce(F.col("old") == F.col("new"), F.lit(False)), "same").otherwise("changed")
    told = both.select(change.alias("change"), "path", F.coalesce("new", "old").alias("content_hash")).filter("change <> 'same'")
    came, went = F.col("change") == "created", F.col("change") == "deleted"
    moved = told.filter((came | went) & F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.count_if(came).alias("came"), F.count_if(went).alias("went"), F.max(F.when(came, F.col("path"))).alias("to"), F.max(F.when(went, F.col("path"))).alias("from"))
    moved = moved.filter("came = 1 AND went = 1").select(F.col("content_hash").alias("hash"), "to", "from")
    joined = told.join(moved, (F.col("content_hash") == F.col("hash")) & (came | went), "left").filter(F.col("hash").isNull() | came)
    return joined.select(F.when(F.col("hash").isNotNull(), "renamed").otherwise(F.col("change")).alias("change"), "path", F.col("from").alias("old_path"))
