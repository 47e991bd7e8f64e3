"""Overview, listing, health and extraction reports. Facts are aggregated before they are joined."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.predicates import multi_contains
from skein.operators.scope import Scope, filtered_projects, in_list, normal

KEY = "project_id"


def _ids(projects: DataFrame) -> DataFrame:
    return projects.select(F.col("id").alias(KEY))


def _joined(rows: list[DataFrame]) -> DataFrame:
    """One-row tables side by side: each has a constant key, so no cross join is needed."""
    return reduce(lambda a, b: a.join(b, "one"), (r.withColumn("one", F.lit(1)) for r in rows)).drop("one")


def overview(tables, workspace: str | None = None, project: str | None = None) -> DataFrame:
    workspace, project = normal(workspace), normal(project)
    own = Scope(_ids(filtered_projects(tables, workspace, project)))
    spaces = tables.workspaces if workspace is None else tables.workspaces.filter(F.col("name") == workspace)
    if project is not None:
        spaces = spaces.join(own(tables.workspace_projects).select(F.col("workspace_id").alias("id")), "id", "left_semi")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return _joined([
        spaces.agg(F.count_distinct("id").alias("workspaces")), count(own(_ids(tables.projects)), "projects"),
        own(tables.chunks_text).agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct(F.concat(F.col(KEY).cast("string"), F.lit(":"), "file_path")).alias("files"), F.max("updated_at").alias("last_updated")),
        count(own(tables.rules_text), "business_rules"), count(own(tables.knowledge_text), "knowledge"),
    ])


def _per_project(tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    chunks = tables.chunks_text.groupBy(KEY).agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("file_path").alias("files"), F.max("updated_at").alias("last_updated"))
    count = lambda df, name: df.groupBy(KEY).agg(F.count(F.lit(1)).alias(name))
    return chunks, count(tables.rules_text, "business_rules"), count(tables.knowledge_text, "knowledge")


def workspace_summary(tables, workspace: str | None = None, project: str | None = None) -> DataFrame:
    workspace, project = normal(workspace), normal(project)
    own = _ids(filtered_projects(tables, workspace, project))
    facts = reduce(lambda a, b: a.join(b, KEY, "left"), [own, *_per_project(tables)])
    links = tables.workspace_projects.join(facts, KEY)
    spaces = tables.workspaces if workspace is None else tables.workspaces.filter(F.col("name") == workspace)
    joined = spaces.join(links, spaces["id"] == links["workspace_id"], "left" if project is None else "inner")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return joined.groupBy("name").agg(F.count(KEY).alias("projects"), total("chunks"), total("business_rules"), total("knowledge"), F.max("last_updated").alias("last_updated")).orderBy("name")


def project_summary(tables, workspace: str | None = None, project: str | None = None, limit: int = 50) -> DataFrame:
    own = filtered_projects(tables, workspace, project).withColumnRenamed("id", KEY)
    names = tables.workspace_projects.join(tables.workspaces.select(F.col("id").alias("workspace_id"), F.col("name").alias("w")), "workspace_id").groupBy(KEY).agg(F.array_sort(F.collect_set("w")).alias("workspaces"))
    spoken = tables.chunks_text.groupBy(KEY).agg(F.array_sort(F.collect_set("language")).alias("languages"))
    rows = reduce(lambda a, b: a.join(b, KEY, "left"), [own, *_per_project(tables), names, spoken])
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    text = lambda c, sep: F.coalesce(F.array_join(c, sep), F.lit("")).alias(c)
    out = rows.select("name", "root_path", text("workspaces", " | "), zero("chunks"), zero("files"), zero("business_rules"), zero("knowledge"), "last_updated", text("languages", ", "))
    return out.orderBy(F.col("chunks").desc(), "name").limit(limit)


def chunk_listing(tables, workspace: str | None = None, project: str | None = None, search: str | None = None, limit: int = 100) -> DataFrame:
    own = filtered_projects(tables, workspace, project).select(F.col("id").alias(KEY), F.col("name").alias("project"))
    found = tables.chunks.filter(multi_contains([F.col(c) for c in ("file_path", "language", "chunk_type", "symbol_name")], search)).join(own, KEY)
    top = found.orderBy(F.col("updated_at").desc_nulls_first(), F.col("id").desc()).limit(limit)
    names = tables.workspace_projects.join(tables.workspaces.select(F.col("id").alias("workspace_id"), F.col("name").alias("w")), "workspace_id").groupBy(KEY).agg(F.array_join(F.array_sort(F.collect_set("w")), " | ").alias("workspaces"))
    return top.join(names, KEY, "left").select("id", "project", F.coalesce("workspaces", F.lit("")).alias("workspaces"), "file_path", "language", "chunk_type", "symbol_name", F.length("content").cast("bigint").alias("content_length"), F.col("embedding").isNotNull().alias("has_embedding"), "updated_at")


def _facts(rows: DataFrame, tables, workspace: str | None, project: str | None, search: str | None, columns: list[str], limit: int) -> DataFrame:
    own = filtered_projects(tables, workspace, project).select(F.col("id").alias(KEY), F.col("name").alias("project"))
    text = [c for c in columns if c not in ("confidence", "updated_at")]
    found = rows.filter(multi_contains([F.col(c) for c in text], search)).join(own, KEY)
    return found.select("id", "project", *columns).orderBy(F.col("updated_at").desc_nulls_first(), F.col("id").desc()).limit(limit)


def rules_listing(tables, workspace: str | None = None, project: str | None = None, search: str | None = None, limit: int = 100) -> DataFrame:
    return _facts(tables.rules_text, tables, workspace, project, search, ["title", "description", "source_file", "symbol_name", "status", "evidence", "confidence", "updated_at"], limit)


def knowledge_listing(tables, workspace: str | None = None, project: str | None = None, search: str | None = None, limit: int = 100) -> DataFrame:
    return _facts(tables.knowledge_text, tables, workspace, project, search, ["kind", "title", "content", "source", "symbol_name", "status", "evidence", "confidence", "updated_at"], limit)


def duplicate_names(projects: DataFrame) -> DataFrame:
    return projects.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def blank(column: str) -> Column:
    return F.trim(F.coalesce(column, F.lit(""))) == ""


def health(tables, workspace: str | None = None, project: str | None = None) -> DataFrame:
    projects = filtered_projects(tables, workspace, project, by_path=False)
    ids, all_ids = _ids(projects), _ids(tables.projects)
    own = Scope(ids)
    live = F.col("status") != "rejected"
    rules, knowledge = own(tables.rules_text), own(tables.knowledge_text)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    facts = lambda df, name, source: df.agg(F.count_if(F.col("status") == "candidate").alias(f"candidate_{name}"), F.count_if(live & blank("evidence")).alias(f"{name}_without_evidence"), F.count_if(live & blank(source)).alias(f"{name}_without_source"))
    return _joined([
        count(own(tables.chunks.filter(F.col("embedding").isNull())), "chunks_without_embedding"), count(ids.join(own(tables.chunks_text).select(KEY).distinct(), KEY, "left_anti"), "projects_without_chunks"),
        count(duplicate_names(projects), "duplicate_project_names"), count(tables.chunks_text.join(all_ids, KEY, "left_anti"), "broken_chunk_references"), facts(rules, "business_rules", "source_file"), facts(knowledge, "knowledge", "source"),
    ])


def chunks_per_project(tables) -> DataFrame:
    names = tables.projects.select(F.col("id").alias(KEY), "name")
    return names.join(tables.chunks_text.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")), KEY, "left").groupBy("name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))


def _work(tables, chunks: DataFrame, workspace: str, projects: Sequence[str], stage: str) -> DataFrame:
    """Chunks of the workspace with their state (state_status, state_hash, both null if new)."""
    named = in_list(tables.projects, "name", projects).select(F.col("id").alias(KEY), F.col("name").alias("project"))
    inside = tables.workspace_projects.join(tables.workspaces.filter(F.col("name") == workspace).select(F.col("id").alias("workspace_id")), "workspace_id", "left_semi").select(KEY).distinct()
    state = tables.extraction_state.filter(F.col("stage") == stage).select(F.col("chunk_id").alias("id"), F.col("content_hash").alias("state_hash"), F.col("status").alias("state_status"))
    return chunks.join(named, KEY).join(inside, KEY, "left_semi").join(state, "id", "left")


def _fresh() -> Column:
    return F.col("state_status").isNull() | (F.col("state_hash") != F.col("content_hash"))


def extraction_stats(tables, chunks: DataFrame, candidate: Column, workspace: str, projects: Sequence[str] = (), stage: str = "rules") -> DataFrame:
    """chunks: the indexable ones."""
    rows = _work(tables, chunks, workspace, projects, stage).withColumn("c", candidate)
    status, same = F.col("state_status"), F.col("state_hash") == F.col("content_hash")
    n = lambda p, name: F.count_if(F.col("c") & p).alias(f"{name}candidate_chunks")
    return rows.agg(F.count(F.lit(1)).alias("total_chunks"), F.count_if("c").alias("candidate_chunks"), n((status == "processed") & same, "processed_"), n(status.isNull(), "pending_"), n((status == "failed") & same, "failed_"), n(status.isNotNull() & ~same, "changed_"), n(_fresh() | (status == "failed"), "actionable_"))


def extraction_queue(tables, chunks: DataFrame, candidate: Column, workspace: str, projects: Sequence[str] = (), stage: str = "rules", refresh: bool = False, limit: int | None = None) -> DataFrame:
    """The chunks to extract from: failed ones first, then new and changed ones, then (on refresh) the rest."""
    rows = _work(tables, chunks, workspace, projects, stage).filter(candidate)
    failed = F.col("state_status") == "failed"
    if not refresh:
        rows = rows.filter(_fresh() | failed)
    bucket = F.when(failed, 0).when(_fresh(), 1).otherwise(2)
    out = rows.withColumn("bucket", bucket).select("bucket", "id", "project", "file_path", "language", "chunk_type", "symbol_name", "content", "content_hash", "updated_at")
    out = out.orderBy("bucket", F.col("updated_at").desc_nulls_first(), F.col("id").desc())
    return out if limit is None else out.limit(limit)
