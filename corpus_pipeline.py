"""A corpus pipeline of five stages; each one's rows are written as Parquet and read again by the next.

1. toxicity: documents that the grammar rejects go.
2. near join: of each class of near copies the row of least doc_id (then key) stays.
3. suffix-array dedup: bytes of repeated 200-byte windows go, and documents of which nothing but white space is left.
4. decontamination: documents that hold a benchmark window go.
5. BPE: every document gets its token ids, and whether they decode to its text.

Cases, for every stage: an empty table gives no rows; further columns, whatever their names, are dropped; a null doc_id,
lang, source or n_chars is a value like others; texts of any length are read whole. What else each stage does with null,
empty and equal texts and with ties is in its docstring.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm import bpe, decontamination, near_join, suffix_dedup, toxicity
from skein.llm.common import delete, passing_tables, semi, shared_dir, stored, table

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null, empty and wordless texts have the base score, which is under one half unless most labels are toxic; equal
    rows go or stay alike; a score of exactly one half is toxic. Without usable labels the built-in weights decide."""
    scorer = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs.select(*DOCUMENT), scorer).filter("toxicity < 0.5").select(*DOCUMENT)


def keep_one_of_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal rows (id and text) one stays, wordless ones too: the least by lang, source and n_chars, nulls first.
    Wordless texts (null and empty ones, white space) of different ids are no copies of each other; nor are different
    wordless texts. Texts of fewer than five words are copies if their words are equal. Among ids a null one is the least
    only if its class has no other."""
    found = stored(near_join.near_classes(docs), "classes")
    kept = found.groupBy("r1", "r2").agg(F.min(F.struct("doc_id", "d1", "d2")).alias("k"))
    alone = kept.select("k.d1", "k.d2").distinct()
    rows = semi(near_join.row_keyed(docs.select(*DOCUMENT)), stored(alone, "kept"), ["d1", "d2"])
    order = W.partitionBy("d1", "d2").orderBy("lang", "source", "n_chars")
    return rows.withColumn("place", F.row_number().over(order)).filter("place = 1").select(*DOCUMENT)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null stays null, texts of under 200 bytes stay as they are, also if nothing is in them. Equal texts of 200 bytes or
    more are repeats of each other, so all of them go. A character of which a byte is removed goes as a whole. n_chars is
    that of what is left, null for a null text."""
    cut = suffix_dedup.dedup_bytes(docs.withColumn("missing", F.col("text").isNull()), "lang", "source", "missing")
    text = F.when(~F.col("missing"), F.col("kept"))
    left = cut.filter((F.col("n_removed") == 0) | F.col("kept").rlike(r"\S"))
    return left.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and wordless texts hold no window and stay; rows of equal texts go or stay alike; null and wordless items have
    no window, so an empty benchmark rejects nothing."""
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("n_hit > 0").select("h1", "h2").distinct()
    return semi(decontamination.hashed(docs.select(*DOCUMENT)), stored(found, "contaminated"), ["h1", "h2"], inverse=True).select(*DOCUMENT)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts have no tokens, and decode to the empty text; equal rows each have theirs."""
    found = bpe.encode_documents(docs.select(*DOCUMENT), bpe.vocabulary_path())
    return found.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [("toxicity", reject_toxic), ("near join", keep_one_of_class), ("suffix dedup", cut_repeats), ("decontamination", reject_contaminated), ("bpe", encode)]
#: SQL cannot express the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Its table stays; those of the other stages and what they stored are deleted when the
    next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/skein/stage-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        with passing_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
