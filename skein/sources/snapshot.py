"""Logical tables as Parquet snapshots: each write is a new version, and readers take the newest complete one. Chunks, the
large table, are a store of changes instead."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.schemas import TABLES
from skein.sources.digests import TreeStore
from skein.sources.folders import delete, glob
from skein.sources.store import ChunkStore
from skein.sources.vectors import VectorStore

#: Versions of a table that stay, for readers that have begun with the one before.
KEEP = 2


class Snapshot:
    """The logical tables under one folder of any file system that Spark reads; a table not yet written is empty."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.store = ChunkStore(spark, f"{self.folder}/chunks")
        self.vectors = VectorStore(spark, f"{self.folder}/vectors")

    def tree(self, project_id: int) -> TreeStore:
        """What the project's files were when they were last indexed."""
        return TreeStore(self.spark, f"{self.folder}/trees/{project_id}")

    def versions(self, name: str) -> list[int]:
        return sorted(int(p.rsplit("/", 2)[1][2:]) for p in glob(self.spark, f"{self.folder}/{name}/v=*/_SUCCESS"))

    def read(self, name: str) -> DataFrame:
        if name == "chunks":
            return self.store.read()
        known = self.versions(name)
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}/v={known[-1]}") if known else self.spark.createDataFrame([], TABLES[name])

    def write(self, name: str, rows: DataFrame) -> None:
        """Columns that rows lacks are null; others are left out. Of two writers of one version the second fails."""
        if name == "chunks":
            raise ValueError("chunks are changed through their store")
        shape = TABLES[name]
        known = self.versions(name)
        own = rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape))
        own.write.mode("error").parquet(f"{self.folder}/{name}/v={known[-1] + 1 if known else 1}")
        for v in known[: 1 - KEEP]:
            delete(self.spark, f"{self.folder}/{name}/v={v}")

    def __getattr__(self, name: str) -> DataFrame:
        table = {"chunks_text": "chunks", "rules_text": "rules", "knowledge_text": "knowledge"}.get(name, name)
        if table not in TABLES:
            raise AttributeError(name)
        rows = self.read(table)
        return rows.drop("embedding") if name != table else rows
