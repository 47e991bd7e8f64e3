"""The logical tables over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Each logical table of one folder of Parquet tables, as a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def workspaces(self) -> DataFrame:
        return self.raw("documents").select(F.col("lang").alias("id"), F.col("lang").alias("name")).distinct()

    @property
    def projects(self) -> DataFrame:
        return self.raw("documents").select(project_id().alias("id"), F.col("source").alias("name"), F.concat(F.lit("/src/"), "source").alias("root_path")).distinct()

    @property
    def workspace_projects(self) -> DataFrame:
        return self.raw("documents").select(F.col("lang").alias("workspace_id"), project_id().alias("project_id")).distinct()

    @property
    def chunks_text(self) -> DataFrame:
        """Chunks without vectors, which are stored apart here."""
        return self.raw("documents").select(
            F.col("doc_id").alias("id"), project_id().alias("project_id"), file_path().alias("file_path"), F.col("lang").alias("language"), F.lit("file").alias("chunk_type"), symbol_name().alias("symbol_name"),
            F.col("text").alias("content"), F.sha2("text", 256).alias("content_hash"), stamp("doc_id").alias("updated_at"),
        )

    def _with_vectors(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id", "left")

    @property
    def chunks(self) -> DataFrame:
        return self._with_vectors(self.chunks_text)

    def _bodies(self, body: str) -> DataFrame:
        """The texts of facts, which are stored apart from what is told of them here."""
        return self.raw("documents").select(F.col("doc_id").alias("id"), title(), F.col("text").alias(body), evidence())

    @property
    def rules_bodies(self) -> DataFrame:
        return self._bodies("description")

    @property
    def knowledge_bodies(self) -> DataFrame:
        return self._bodies("content")

    def _facts(self) -> DataFrame:
        status = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "accepted").otherwise("candidate")
        return self.raw("documents").join(self.raw("labels"), "doc_id").select(
            F.col("doc_id").alias("id"), project_id().alias("project_id"), F.col("doc_id").alias("chunk_id"), title(), F.col("text").alias("body"),
            F.when(F.col("doc_id") % 13 != 0, file_path()).alias("source"), symbol_name().alias("symbol_name"), status.alias("status"), evidence(), F.sha2("text", 256).alias("content_hash"),
            ((F.col("n_chars") % 86 + 10) / 100).cast("decimal(5,2)").alias("confidence"), stamp("doc_id").alias("updated_at"),
        )

    @property
    def rules(self) -> DataFrame:
        return self._with_vectors(self.rules_text)

    @property
    def knowledge(self) -> DataFrame:
        return self._with_vectors(self.knowledge_text)

    @property
    def rules_text(self) -> DataFrame:
        return self._facts().withColumnsRenamed({"body": "description", "source": "source_file"})

    @property
    def knowledge_text(self) -> DataFrame:
        kinds = F.array(*map(F.lit, ("integration", "pattern", "technical_risk", "architecture", "configuration")))
        return self._facts().withColumnRenamed("body", "content").withColumn("kind", F.get(kinds, (F.col("id") % 5).cast("int")))

    @property
    def extraction_state(self) -> DataFrame:
        digest = F.sha2("text", 256)
        return self.raw("labels").join(self.raw("documents").select("doc_id", "text"), "doc_id").select(
            F.col("doc_id").alias("id"), F.col("doc_id").alias("chunk_id"), F.lit("rules").alias("stage"), F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("old"), digest)).otherwise(digest).alias("content_hash"),
            F.when(F.col("quality") == 1, "processed").otherwise("failed").alias("status"),
        )

    @property
    def symbols(self) -> DataFrame:
        name = lambda column, key: F.concat(F.lit("ns."), F.regexp_replace(column, r"[^A-Za-z0-9]+", "_"), F.lit("_"), F.col(key).cast("string"))
        suppliers = self.raw("supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 20).cast("int").alias("project_id"), F.lit("class").alias("kind"), name("s_name", "s_suppkey").alias("full_name"))
        parts = self.raw("part").select((F.col("p_partkey") + PART_OFFSET).alias("id"), (F.col("p_partkey") % 20).cast("int").alias("project_id"), F.when(F.col("p_size") % 2 == 0, "interface").otherwise("method").alias("kind"), name("p_name", "p_partkey").alias("full_name"))
        return suppliers.unionByName(parts).withColumn("file_path", F.concat(F.lit("src"), F.col("project_id").cast("string"), F.lit("/"), "kind", F.lit(".cs")))

    @property
    def relations(self) -> DataFrame:
        kind = F.when(F.col("l_returnflag") == "A", "calls").when(F.col("l_returnflag") == "N", "inherits").otherwise("implements")
        return self.raw("lineitem").select(F.col("l_suppkey").alias("source_id"), (F.col("l_partkey") + PART_OFFSET).alias("target_id"), kind.alias("relation")).distinct()

    @property
    def watch_events(self) -> DataFrame:
        return self.raw("events").select("event_id", F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("change"), F.col("ts").cast("timestamp").alias("ts"))


class Filled(Tables):
    """The same tables for counts of what is there: texts and vectors are read, and then empty where they aren't null, so that
    none is shuffled. Columns made of a text alone are null where it is."""

    def raw(self, name: str) -> DataFrame:
        rows, empty = super().raw(name), {"text": F.lit(""), "embedding": F.array().cast("array<float>")}
        return rows.select(*(F.when(F.col(c).isNotNull(), empty[c]).alias(c) if c in empty else F.col(c) for c in rows.columns))


PART_OFFSET = 10_000_000


def project_id():
    return F.substring("source", 4, 20).cast("int")


def file_path():
    return F.concat("source", F.lit("/"), "lang", F.lit("/"), (F.col("doc_id") % 50).cast("string"), F.lit(".txt"))


def symbol_name():
    return F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("ns.Sym"), (F.col("doc_id") % 97).cast("string")))


def title():
    return F.substring("text", 1, 40).alias("title")


def evidence():
    return F.when(F.col("doc_id") % 11 == 0, F.lit("  ")).otherwise(F.substring("text", 1, 80)).alias("evidence")


def stamp(column: str):
    return F.timestamp_seconds(F.lit(1_704_067_200) + F.col(column) * 60)


#: The same tables for DuckDB, as common table expressions.
CTES = f"""
d AS (SELECT *, substr(source, 4)::INT AS pid, source || '/' || lang || '/' || (doc_id % 50)::VARCHAR || '.txt' AS fp, CASE WHEN doc_id % 3 <> 0 THEN 'ns.Sym' || (doc_id % 97)::VARCHAR END AS sym, make_timestamp((1704067200 + doc_id * 60) * 1000000) AS stamped FROM documents),
workspaces AS (SELECT DISTINCT lang AS id, lang AS name FROM documents),
projects AS (SELECT DISTINCT pid AS id, source AS name, '/src/' || source AS root_path FROM d),
workspace_projects AS (SELECT DISTINCT lang AS workspace_id, pid AS project_id FROM d),
chunks AS (SELECT doc_id AS id, pid AS project_id, fp AS file_path, lang AS language, 'file' AS chunk_type, sym AS symbol_name, text AS content, sha256(text) AS content_hash, embedding, stamped AS updated_at FROM d LEFT JOIN embeddings ON vec_id = doc_id),
facts AS (SELECT d.doc_id AS id, pid AS project_id, d.doc_id AS chunk_id, substr(text, 1, 40) AS title, text AS body, CASE WHEN d.doc_id % 13 <> 0 THEN fp END AS source, sym AS symbol_name, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'accepted' ELSE 'candidate' END AS status,
  CASE WHEN d.doc_id % 11 = 0 THEN '  ' ELSE substr(text, 1, 80) END AS evidence, sha256(text) AS content_hash, ((n_chars % 86 + 10) / 100.0)::DECIMAL(5, 2) AS confidence, embedding, stamped AS updated_at FROM d JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings ON vec_id = d.doc_id),
rules AS (SELECT * EXCLUDE (body, source), body AS description, source AS source_file FROM facts),
knowledge AS (SELECT * EXCLUDE (body), body AS content, ['integration', 'pattern', 'technical_risk', 'architecture', 'configuration'][(id % 5)::INT + 1] AS kind FROM facts),
extraction_state AS (SELECT d.doc_id AS id, d.doc_id AS chunk_id, 'rules' AS stage, CASE WHEN d.doc_id % 7 = 0 THEN 'old' || sha256(text) ELSE sha256(text) END AS content_hash, CASE WHEN quality = 1 THEN 'processed' ELSE 'failed' END AS status FROM d JOIN labels l ON l.doc_id = d.doc_id),
syms0 AS (SELECT s_suppkey AS id, (s_suppkey % 20)::INT AS project_id, 'class' AS kind, 'ns.' || regexp_replace(s_name, '[^A-Za-z0-9]+', '_', 'g') || '_' || s_suppkey::VARCHAR AS full_name FROM supplier
  UNION ALL SELECT p_partkey + {PART_OFFSET}, (p_partkey % 20)::INT, CASE WHEN p_size % 2 = 0 THEN 'interface' ELSE 'method' END, 'ns.' || regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g') || '_' || p_partkey::VARCHAR FROM part),
symbols AS (SELECT *, 'src' || project_id::VARCHAR || '/' || kind || '.cs' AS file_path FROM syms0),
relations AS (SELECT DISTINCT l_suppkey AS source_id, l_partkey + {PART_OFFSET} AS target_id, CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'inherits' ELSE 'implements' END AS relation FROM lineitem),
watch_events AS (SELECT event_id, user_id::VARCHAR AS path, event_type AS change, ts FROM events)
"""
