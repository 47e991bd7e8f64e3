"""Tables from Parquet or, where a driver is there, over JDBC; and JSON out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 32, **options: str) -> DataFrame:
    """A table, read in parts by ranges of a numeric key if its bounds are given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as a JSON object with camelCase names."""
    return df.select(F.to_json(F.struct(*(F.col(c).alias(camel(c)) for c in df.columns)), {"ignoreNullFields": "false"}).alias("json"))
