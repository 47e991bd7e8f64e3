"""The write path: source files to chunks, symbols and facts, each stage from tables to tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions.text import contextual
from skein.operators import chunking, extraction, merge, predicates
from skein.sources.embedding import embedded
from skein.sources.vectors import VectorStore

Embed = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def new_chunks(files: DataFrame, project_id: int, project: str, now: datetime, embed: Embed | None = None, vectors: VectorStore | None = None) -> DataFrame:
    """Chunks of files (path relative to the project's root, language, content), with vectors of their contextual text.
    vectors: where vectors are kept by text; only texts that it lacks are embedded, and one that fails has no vector."""
    pieces = chunking.chunk_files(files)
    # equal chunks of a file are one, the last
    once = merge.last_of(pieces, ["path", "content_hash"], F.col("seq").desc())
    text = contextual(F.lit(project), F.col("path"), F.col("language"), F.col("symbol_name"), F.col("chunk_type"), F.col("content"))
    key = F.xxhash64(F.lit(project_id), "path", "content_hash")
    shape = [key.alias("id"), F.lit(project_id).alias("project_id"), F.col("path").alias("file_path"), "language", "chunk_type", "symbol_name", "content", "content_hash"]
    stamp = F.lit(now).cast("timestamp").alias("updated_at")
    if vectors is None:
        return once.select(*shape, embedded(text, embed).alias("embedding"), stamp)
    rows = vectors.attached(once.select(*shape, text.alias("asked"), stamp), embed, "asked")
    return rows.select(*(c for c in rows.columns if c != "asked"))


def index_changes(stored: DataFrame, projects: DataFrame, files: DataFrame, project_id: int, project: str, now: datetime, embed: Embed | None = None, vectors: VectorStore | None = None, listed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What indexing one project puts into the stored chunks, and which files (project_id, file_path) it takes away: those
    that hold migrations or tests, and those of the project that are no longer there, if any file is. listed: all paths of
    the project, where files are only those that have changed."""
    where = ["project_id", "file_path"]
    known = stored.select(*where).distinct()
    unfit = predicates.unfit_files(stored, projects).select(*where)
    paths = files if listed is None else listed
    present = paths.select(F.lit(project_id).alias("project_id"), F.col("path").alias("file_path")).distinct()
    gone = unfit if paths.isEmpty() else unfit.unionByName(known.filter(F.col("project_id") == project_id).join(present, where, "left_anti"))
    return new_chunks(files, project_id, project, now, embed, vectors), gone.distinct()


def index_symbols(files: DataFrame, chunks: DataFrame, project_id: int) -> tuple[DataFrame, DataFrame]:
    """The project's symbols and relations. A symbol's chunk is the least one of its name."""
    found = chunking.build_symbols(files.filter(F.col("language") == "csharp"))
    once = merge.upsert_symbols(found.withColumn("project_id", F.lit(project_id)))
    of = chunks.filter(F.col("project_id") == project_id).groupBy(F.col("symbol_name").alias("full_name")).agg(F.min("id").alias("chunk_id"))
    key = lambda c: F.xxhash64(F.lit(project_id), c)
    symbols = once.join(of, "full_name", "left").select(key("full_name").alias("id"), "project_id", "chunk_id", "kind", "full_name", F.col("path").alias("file_path"), "line_start", "line_end")
    relations = chunking.build_relations(found).select(key("source").alias("source_id"), key("target").alias("target_id"), "relation")
    return symbols, relations


def merge_facts(stored: DataFrame, candidates: DataFrame, chunks: DataFrame, now: datetime, by_kind: bool = False) -> DataFrame:
    """The facts after candidates (chunk_id, title, content_hash, confidence, ...) were merged in as a set.

    Of candidates of one project and hash, and of those that update one fact, the one of most confidence, then of the
    least chunk wins. An updated fact keeps its id and status; a new one is a candidate."""
    where = chunks.select(F.col("id").alias("chunk_id"), "project_id")
    key = F.xxhash64("chunk_id", "content_hash")
    named = candidates.withColumn("cand_id", key).join(where, "chunk_id")
    best = F.col("confidence").desc(), F.col("chunk_id"), F.col("content_hash")
    once = merge.last_of(named, ["project_id", "content_hash"], *best)
    told = merge.upsert_facts(stored, once.drop("project_id"), chunks, by_kind)
    stamp = F.lit(now).cast("timestamp")
    given = [c for c in stored.columns if c in once.columns and c not in ("id", "project_id", "status", "created_at", "updated_at")]
    hit = told.filter(F.col("action") == "updated").select("cand_id", "id").join(once, "cand_id")
    update = merge.last_of(hit, ["id"], *best).select("id", F.struct(*given).alias("u"))
    rows = stored.join(update, "id", "left")
    renewed = F.col("u").isNotNull()
    kept = [F.when(renewed, stamp).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.when(renewed, F.col(f"u.{c}")).otherwise(F.col(c)).cast(stored.schema[c].dataType).alias(c) if c in given else F.col(c) for c in stored.columns]
    fresh = told.filter(F.col("action") == "inserted").select("cand_id").join(once, "cand_id")
    value: dict[str, Column] = {"id": F.col("cand_id"), "status": F.lit("candidate"), "created_at": stamp, "updated_at": stamp}
    new = [(value.get(c) if c in value else F.col(c) if c in once.columns else F.lit(None)).cast(stored.schema[c].dataType).alias(c) for c in stored.columns]
    return rows.select(*kept).unionByName(fresh.select(*new))


def mark_state(state: DataFrame, chunks: DataFrame, stage: str, now: datetime, error: str | None = None) -> DataFrame:
    """The extraction state after chunks (id, content_hash) were processed or, with an error, failed."""
    stamp = F.lit(now).cast("timestamp")
    value = {"id": F.xxhash64("id", F.lit(stage)), "chunk_id": F.col("id"), "stage": F.lit(stage), "content_hash": F.col("content_hash"), "status": F.lit("processed" if error is None else "failed"), "processed_at": stamp, "error": F.lit(error), "updated_at": stamp}
    done = chunks.select(*(value[c].cast(state.schema[c].dataType).alias(c) for c in state.columns))
    return merge.upsert_state(state, done)


def fact_candidates(queue: DataFrame, stage: str, replies: DataFrame | None = None) -> DataFrame:
    """Deduplicated candidates of the queued chunks (id, project, file_path, symbol_name, content) by patterns and, if
    there are any, a model's replies (id, reply)."""
    named = queue.select(F.col("id").alias("chunk_id"), "file_path", "symbol_name")
    if stage == "rules":
        shape = ["chunk_id", "title", "description", "evidence", "content_hash", "confidence", "seq"]
        found = extraction.extract_rules(queue).withColumn("seq", F.col("pass") * F.lit(1 << 20) + F.col("pos")).select(*shape)
        told = None if replies is None else extraction.semantic_rules(queue, replies).withColumn("seq", F.col("seq") + F.lit(1 << 24)).select(*shape)
        best = extraction.dedup_rules(found if told is None else found.unionByName(told))
        return best.join(named.withColumnRenamed("file_path", "source_file"), "chunk_id").drop("seq")
    shape = ["chunk_id", "kind", "title", "content", "evidence", "content_hash", "confidence", "seq"]
    found = extraction.keyword_knowledge(queue).withColumn("seq", F.lit(0)).select(*shape)
    told = None if replies is None else extraction.semantic_knowledge(queue, replies).withColumn("seq", F.col("seq") + 1).select(*shape)
    best = extraction.dedup_knowledge(found if told is None else found.unionByName(told), ("seq", "content_hash"))
    return best.join(named.withColumnRenamed("file_path", "source"), "chunk_id").drop("seq")
