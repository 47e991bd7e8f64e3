"""python -m skein: index, search, doctor and report over snapshots of the logical tables."""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skein import schemas
from skein.api import Engine
from skein.operators import indexing, merge, predicates, reports
from skein.sources.files import read_tree
from skein.sources.snapshot import Snapshot

STAGES = ("chunks", "rules", "knowledge")


def index(tables: Snapshot, root: str, project: str, workspace: str, stages: list[str], refresh: bool = False) -> None:
    """Indexes one project from a folder: chunks and symbols, then facts of the chunks that are due. Only files that have
    changed since the last time are cut into chunks, and only texts without a vector embedded; refresh takes all files."""
    spark, now = tables.spark, datetime.now(UTC).replace(tzinfo=None)
    key = spark.range(1).select(F.pmod(F.hash(F.lit(root)), F.lit(2**31 - 1)).cast("int")).head()[0]
    tables.write("workspaces", merge.insert_ignore(tables.workspaces, spark.createDataFrame([(workspace, workspace)], tables.workspaces.schema), ["id"]))
    tables.write("projects", merge.upsert_projects(tables.projects, spark.createDataFrame([(key, project, root)], tables.projects.schema)))
    tables.write("workspace_projects", merge.insert_ignore(tables.workspace_projects, spark.createDataFrame([(workspace, key)], tables.workspace_projects.schema), ["workspace_id", "project_id"]))
    if "chunks" in stages:
        found = read_tree(spark, root)
        files = found.withColumn("path", F.regexp_replace("path", "^.*?" + "".join(f"\\{c}" if not c.isalnum() else c for c in root.rstrip("/")) + "/", ""))
        listed = files.select(F.lit(key).alias("project_id"), "path", F.sha2("content", 256).alias("content_hash"))
        tree = tables.tree(key)
        changed = files if refresh else files.join(tree.changes(listed).filter("change <> 'deleted'").select("path"), "path", "left_semi")
        tables.store.write(*indexing.index_changes(tables.chunks, tables.projects, changed, key, project, now, vectors=tables.vectors, listed=listed))
        tables.store.compact()
        tree.commit(listed)
        symbols, relations = indexing.index_symbols(files, tables.chunks, key)
        tables.write("symbols", tables.symbols.filter(F.col("project_id") != key).unionByName(symbols.select(*tables.symbols.columns)))
        tables.write("relations", merge.insert_ignore(tables.relations, relations, ["source_id", "target_id", "relation"]))
    for stage in ("rules", "knowledge"):
        if stage in stages:
            candidate = predicates.rule_candidate() if stage == "rules" else predicates.knowledge_candidate()
            queue = reports.extraction_queue(tables, predicates.indexable(tables.chunks_text, tables.projects), candidate, workspace, [project], stage, refresh)
            tables.write(stage, indexing.merge_facts(getattr(tables, stage), indexing.fact_candidates(queue, stage), tables.chunks_text, now, stage == "knowledge"))
            tables.write("extraction_state", indexing.mark_state(tables.extraction_state, queue, stage, now))


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="skein", description=__doc__)
    parser.add_argument("--tables", required=True, help="folder of the snapshots")
    verbs = parser.add_subparsers(dest="verb", required=True)
    one = verbs.add_parser("index")
    one.add_argument("root")
    one.add_argument("stages", nargs="*", default=[])
    one.add_argument("--project", required=True)
    one.add_argument("--workspace", default="default")
    one.add_argument("--refresh", action="store_true")
    one = verbs.add_parser("search")
    one.add_argument("query")
    one.add_argument("-k", type=int, default=10)
    verbs.add_parser("doctor")
    one = verbs.add_parser("report")
    one.add_argument("name", choices=["overview", "workspaces", "projects", "chunks", "rules", "knowledge", "health"])
    told = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    tables = Snapshot(spark, told.tables)
    if told.verb == "index":
        if unknown := [s for s in told.stages if s not in STAGES]:
            parser.error(f"no such stage: {', '.join(unknown)}")
        index(tables, told.root, told.project, told.workspace, told.stages or list(STAGES), told.refresh)
    elif told.verb == "search":
        for r in Engine(tables).search(told.query, told.k).collect():
            print(f"{r['rrf_score']:.4f} {r['project']} {r['file_path']} {r['symbol_name'] or ''}\n{r['content'][:600]}\n")
    elif told.verb == "doctor":
        checks = schemas.schema_check(schemas.required_columns(spark), schemas.columns_of(spark, {t: tables.read(t) for t in schemas.TABLES}))
        checks.orderBy("table_name", "column_name").show(200, truncate=False)
        return 0 if schemas.check_summary(checks).head()["all_ok"] else 1
    else:
        getattr(Engine(tables), told.name)().show(100, truncate=60)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
