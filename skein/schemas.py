"""Schemas of the logical tables, and checks of actual tables against them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(**columns: str) -> T.StructType:
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "t": T.TimestampType(), "c": T.DecimalType(5, 2), "v": T.ArrayType(T.FloatType())}
    return T.StructType([T.StructField(name, kinds[kind[0]], not kind.endswith("!")) for name, kind in columns.items()])


TABLES: dict[str, T.StructType] = {
    "workspaces": _struct(id="s!", name="s!"),
    "projects": _struct(id="i!", name="s!", root_path="s!"),
    "workspace_projects": _struct(workspace_id="s!", project_id="i!"),
    "chunks": _struct(id="l!", project_id="i!", file_path="s!", language="s", chunk_type="s", symbol_name="s", content="s!", content_hash="s!", embedding="v", updated_at="t"),
    "rules": _struct(id="l!", project_id="i", chunk_id="l", title="s!", description="s!", source_file="s", symbol_name="s", status="s!", evidence="s", content_hash="s!", confidence="c", embedding="v", created_at="t", updated_at="t"),
    "knowledge": _struct(id="l!", project_id="i", chunk_id="l", kind="s!", title="s!", content="s!", source="s", symbol_name="s", status="s!", evidence="s", content_hash="s!", confidence="c", embedding="v", updated_at="t"),
    "extraction_state": _struct(id="l!", chunk_id="l!", stage="s!", content_hash="s!", status="s!", processed_at="t", error="s", updated_at="t"),
    "symbols": _struct(id="l!", project_id="i!", chunk_id="l", kind="s!", full_name="s!", file_path="s!", line_start="i", line_end="i"),
    "relations": _struct(source_id="l!", target_id="l!", relation="s!"),
    "migrations": _struct(name="s!", content_hash="s!", applied_at="t!"),
}
#: The closed sets of text columns.
CLOSED = {
    "status": ("candidate", "accepted", "rejected"),
    "stage": ("rules", "knowledge"),
    "relation": ("calls", "inherits", "implements", "uses", "references"),
    "kind": ("class", "interface", "struct", "enum", "record", "type", "method", "property"),
}


def required_columns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, f.name) for t, s in TABLES.items() for f in s], "table_name string, column_name string")


def schema_check(required: DataFrame, actual: DataFrame) -> DataFrame:
    """Each required column with whether it is there; both: table_name, column_name."""
    found = actual.select("table_name", "column_name").distinct().withColumn("found", F.lit(True))
    return required.join(found, ["table_name", "column_name"], "left").select("table_name", "column_name", F.when(F.col("found"), "OK").otherwise("MISSING").alias("status"))


def filled_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name and filled: how many values each column holds, from one pass over each table."""
    per = [df.agg(*(F.count(c).alias(c) for c in df.columns)).select(F.lit(name).alias("table_name"), F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("filled")) for c in df.columns))).alias("f")).select("table_name", "f.*") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, per)


def check_summary(checks: DataFrame) -> DataFrame:
    """Counts over a check report, and whether all and any are well; with a column filled, its sum."""
    ok = F.col("status") == "OK"
    return checks.agg(*([F.coalesce(F.sum("filled"), F.lit(0).cast("long")).alias("filled")] if "filled" in checks.columns else []), F.count(F.lit(1)).alias("checks"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("missing"), F.coalesce(F.bool_and(ok), F.lit(True)).alias("all_ok"), F.coalesce(F.bool_or(ok), F.lit(False)).alias("any_ok"))


def columns_of(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """What the check compares with, from the tables' own schemas."""
    return spark.createDataFrame([(name, c) for name, df in tables.items() for c in df.columns], "table_name string, column_name string")


def create_tables(spark: SparkSession, database: str = "default") -> list[str]:
    """Creates the tables that the catalog lacks; returns their names."""
    there = {t.name for t in spark.catalog.listTables(database)}
    made = [name for name in TABLES if name not in there]
    for name in made:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in TABLES[name])}) USING parquet")
    return made


def pending_migrations(files: DataFrame, applied: DataFrame) -> DataFrame:
    """Migrations (name, content) not yet applied, in order of name; like the applied table, known by name alone."""
    return files.join(applied.select("name"), "name", "left_anti").select("name", F.sha2("content", 256).alias("content_hash")).orderBy("name")
