"""Upserts and deletes as functions from tables to tables; callers write the new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_of(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the first in that order."""
    return rows.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_place = 1").drop("_place")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], overwrite: list[str]) -> DataFrame:
    """target with source's rows: on equal keys only the overwrite columns are replaced; action says what happened.
    Columns that source lacks are null in new rows."""
    rest = [c for c in target.columns if c not in keys]
    mine = target.select(*keys, F.struct(*rest).alias("_old"))
    given = source.select(*keys, F.struct(*[F.col(c) if c in source.columns else F.lit(None).cast(target.schema[c].dataType).alias(c) for c in rest]).alias("_new"))
    both = mine.join(given, keys, "full_outer")
    pick = lambda c: F.when(F.col("_old").isNull(), F.col(f"_new.{c}")).when(F.col("_new").isNull() | ~F.lit(c in overwrite), F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}")).alias(c)
    action = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "inserted").otherwise("updated")
    return both.select(*keys, *map(pick, rest), action.alias("action"))


#: What a chunk is known by, and what an upsert of it overwrites.
CHUNK_KEY, CHUNK_OVERWRITE = ["project_id", "file_path", "content_hash"], ["content", "embedding", "updated_at"]


def upsert_chunks(target: DataFrame, source: DataFrame) -> DataFrame:
    return upsert(target, source, CHUNK_KEY, CHUNK_OVERWRITE)


def upsert_projects(target: DataFrame, source: DataFrame) -> DataFrame:
    """By root path; a known one is renamed."""
    return upsert(target, source, ["root_path"], ["name"])


def insert_ignore(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """target and those distinct rows of source whose key it lacks."""
    fresh = source.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def upsert_state(target: DataFrame, source: DataFrame) -> DataFrame:
    """By chunk and stage the last writer wins; errors have at most 2000 characters."""
    told = source.withColumn("error", F.substring("error", 1, 2000))
    both = target.withColumn("_new", F.lit(0)).unionByName(told.select(*target.columns).withColumn("_new", F.lit(1)))
    return last_of(both, ["chunk_id", "stage"], F.col("_new").desc(), F.col("updated_at").desc_nulls_first(), F.col("id").desc()).drop("_new")


def upsert_symbols(found: DataFrame, order: str = "seq") -> DataFrame:
    """By project and full name the last one found stays: overloads collapse."""
    return last_of(found, ["project_id", "full_name"], F.col(order).desc())


def upsert_facts(stored: DataFrame, candidates: DataFrame, chunks: DataFrame, by_kind: bool = False) -> DataFrame:
    """What becomes of each candidate (cand_id, chunk_id, title, content_hash, confidence and, for knowledge, kind).

    A stored fact of the same project that isn't rejected matches by hash or by title (and kind) whatever the case.
    All matches are updated (reported: the least id); with none the candidate is inserted; without its chunk it is
    skipped. Returns cand_id, id, status, action, reported."""
    known = candidates.join(chunks.select(F.col("id").alias("chunk_id"), "project_id"), "chunk_id")
    live = stored.filter(F.col("status") != "rejected").select("id", "project_id", "status", F.col("content_hash").alias("_hash"), F.lower("title").alias("_title"), *(["kind"] if by_kind else []))
    by_hash = known.join(live.withColumnRenamed("project_id", "_p"), (F.col("_p") == F.col("project_id")) & (F.col("_hash") == F.col("content_hash")))
    title = known.withColumn("_key", F.concat_ws("\x00", F.lower("title"), *([F.lower("kind")] if by_kind else [])))
    other = live.withColumn("_key2", F.concat_ws("\x00", "_title", *([F.lower("kind")] if by_kind else []))).withColumnRenamed("project_id", "_p")
    by_title = title.join(other, (F.col("_p") == F.col("project_id")) & (F.col("_key") == F.col("_key2")))
    hit = by_hash.select("cand_id", "id", "status").unionByName(by_title.select("cand_id", "id", "status")).distinct()
    updated = hit.select("cand_id", "id", "status", F.lit("updated").alias("action"), (F.col("id") == F.min("id").over(W.partitionBy("cand_id"))).alias("reported"))
    rest = candidates.join(hit.select("cand_id"), "cand_id", "left_anti")
    fresh = rest.join(chunks.select(F.col("id").alias("chunk_id"), F.lit(True).alias("_there")), "chunk_id", "left")
    new = fresh.select("cand_id", F.lit(None).cast("bigint").alias("id"), F.when(F.col("_there"), "candidate").alias("status"), F.when(F.col("_there"), "inserted").otherwise("skipped").alias("action"), F.lit(True).alias("reported"))
    return updated.unionByName(new)


def action_counts(actions: DataFrame) -> DataFrame:
    return actions.filter("reported").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def delete_files(chunks: DataFrame, doomed: DataFrame) -> DataFrame:
    """Chunks outside the doomed files (project_id, file_path)."""
    return chunks.join(doomed.select("project_id", "file_path").distinct(), ["project_id", "file_path"], "left_anti")


def delete_orphans(chunks: DataFrame, present: DataFrame, project: int) -> DataFrame:
    """The project's chunks whose path is no longer present go; with no path at all nothing does."""
    if present.isEmpty():
        return chunks
    mine = chunks.filter(F.col("project_id") == project).join(present.select("file_path").distinct(), "file_path", "left_semi")
    return chunks.filter(F.col("project_id") != project).unionByName(mine.select(*chunks.columns))
