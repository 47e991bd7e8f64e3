"""Chunks that change batch by batch: a batch appends its changes to the buckets of its files, readers merge, and
compaction folds the changes of changed buckets into their rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.merge import CHUNK_KEY, CHUNK_OVERWRITE, last_of
from skein.schemas import TABLES
from skein.sources.folders import delete, glob

FILE = ["project_id", "file_path"]
BUCKETS = 64


def _shape(more: str) -> T.StructType:
    return T.StructType([*TABLES["chunks"], *T.StructType.fromDDL(more)])


class ChunkStore:
    """The chunks table under one folder of any file system that Spark reads, for one writer at a time.

    `rows/bucket=b` holds chunks with the number of the batch that last wrote them, `changes/batch=n/bucket=b` what batch n
    puts or takes away. A bucket is a hash of project and file, so a batch writes to its files' buckets alone and reads
    nothing. As in an upsert, a chunk that is put again keeps all but content, vector and time. A batch that is written
    again under its number replaces itself, and merging changes that are already in the rows leaves them as they are, so
    a failed batch or compaction is simply done again. Readers that began before a compaction may have to begin again."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder = spark, folder.rstrip("/")
        told = [p.rsplit("=", 1)[1] for p in glob(spark, f"{self.folder}/buckets=*")]
        self.buckets = int(told[0]) if told else buckets
        if not told:
            spark.range(0).write.mode("overwrite").parquet(f"{self.folder}/buckets={buckets}")

    def bucket(self) -> Column:
        return F.pmod(F.hash(*FILE), F.lit(self.buckets))

    def changes(self) -> list[tuple[int, int]]:
        """(batch, bucket) of all changes that are not in the rows yet, in order."""
        found = glob(self.spark, f"{self.folder}/changes/batch=*/_SUCCESS")
        whole = {p.rsplit("/", 2)[1] for p in found}
        parts = (p.rsplit("/", 2)[1:] for p in glob(self.spark, f"{self.folder}/changes/batch=*/bucket=*"))
        return sorted((int(batch[6:]), int(bucket[7:])) for batch, bucket in parts if batch in whole)

    def next_number(self) -> int:
        newest = [int(p.rsplit("=", 1)[1]) for name in ("changes/batch", "folded/batch") for p in glob(self.spark, f"{self.folder}/{name}=*")]
        return max(newest, default=-1) + 1

    def write(self, put: DataFrame, gone: DataFrame | None = None, number: int | None = None) -> int:
        """One batch: takes away the files that are gone (project_id, file_path), then puts chunks. Columns that put lacks
        are null. The first batch of all, if nothing is gone, is written as rows at once. Of chunks of one key the newest is put. number: for writers that may come again with the same batch."""
        number = self.next_number() if number is None else number
        own = put.select(*((F.col(f.name) if f.name in put.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES["chunks"]), F.lit("put").alias("op"))
        rows = self._newest(own)
        if not number and gone is None and not glob(self.spark, f"{self.folder}/rows/bucket=*") and not self.changes():
            self.spark.range(0).write.mode("overwrite").parquet(f"{self.folder}/folded/batch={number}")
            rows.drop("op").withColumn("written", F.lit(number).cast("long")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/rows")
            return number
        if gone is not None:
            out = gone.select(*FILE, F.lit("gone").alias("op")).distinct().withColumn("bucket", self.bucket())
            rows = rows.unionByName(out, allowMissingColumns=True)
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/changes/batch={number}")
        return number

    def _newest(self, rows: DataFrame) -> DataFrame:
        """The newest row of each key, with its bucket. One shuffle, by bucket, serves the choice and the writing."""
        dealt = rows.withColumn("bucket", self.bucket()).repartition("bucket")
        return last_of(dealt, ["bucket", *CHUNK_KEY], F.col("updated_at").desc_nulls_last(), F.col("id"))

    def _rows(self) -> DataFrame:
        shape = _shape("written long, bucket int")
        if not glob(self.spark, f"{self.folder}/rows/bucket=*"):
            return self.spark.createDataFrame([], shape)
        return self.spark.read.schema(shape).parquet(f"{self.folder}/rows")

    def _merged(self, buckets: list[int], upto: int, of: Callable[[Column], Column] | None = None) -> DataFrame:
        """The rows of these buckets with their changes, and the batch that last wrote each."""
        names = TABLES["chunks"].names
        old = self._rows().filter(F.col("bucket").isin(*buckets)).select("bucket", *names, F.col("written").alias("batch"))
        batches = sorted({batch for batch, bucket in self.changes() if batch <= upto and bucket in set(buckets)})
        new = self.spark.read.schema(_shape("op string, batch long, bucket int")).option("basePath", f"{self.folder}/changes").parquet(*(f"{self.folder}/changes/batch={n}" for n in batches))
        changed = new.filter(F.col("bucket").isin(*buckets))
        ends = changed.filter("op = 'gone'").groupBy("bucket", *FILE).agg(F.max("batch").alias("ended"))
        live = old.unionByName(changed.filter("op = 'put'").select("bucket", *names, "batch"))
        live = (live if of is None else live.withColumn("content", of(F.col("content")))).repartition("bucket").join(ends, ["bucket", *FILE], "left").filter("ended IS NULL OR batch >= ended")
        first = [c for c in names if c not in CHUNK_KEY and c not in CHUNK_OVERWRITE]
        # all by bucket: one shuffle serves the join, the choice of values and the writing
        one = live.groupBy("bucket", *CHUNK_KEY).agg(F.min_by(F.struct(*first), "batch").alias("f"), F.max_by(F.struct(*CHUNK_OVERWRITE), "batch").alias("l"), F.max("batch").alias("written"))
        return one.select("bucket", *CHUNK_KEY, "f.*", "l.*", "written").select("bucket", *names, "written")

    def _read(self, only: list[int] | None = None, of: Callable[[Column], Column] | None = None) -> DataFrame:
        self._finish()
        names, told = TABLES["chunks"].names, self.changes()
        changed = sorted({bucket for _, bucket in told if only is None or bucket in only})
        rows = self._rows() if only is None else self._rows().filter(F.col("bucket").isin(*only))
        shown = lambda df: df.select(*names) if of is None else df.withColumn("content", of(F.col("content"))).select(*names)
        if not changed:
            return shown(rows)
        rest = shown(rows.filter(~F.col("bucket").isin(*changed)))
        return rest.unionByName(self._merged(changed, max(batch for batch, _ in told), of).select(*names))

    def read(self, of: Callable[[Column], Column] | None = None) -> DataFrame:
        """All chunks. Buckets without changes are read as they are; only those with changes are shuffled. of: what is wanted
        of a content, in its place, such as a digest; a merge takes a content whole, so only what is wanted is shuffled."""
        return self._read(of=of)

    def read_files(self, files: DataFrame) -> DataFrame:
        """The chunks of these files (project_id, file_path); other buckets are not read."""
        only = [b for (b,) in files.select(self.bucket()).distinct().collect()]  # as many as there are buckets at most
        return self._read(only).join(files.select(*FILE).distinct(), FILE, "left_semi").select(*TABLES["chunks"].names) if only else self._read().filter("false")

    def compact(self, least: int = 1) -> list[int]:
        """Folds the changes of every bucket with at least so many batches of them into its rows; returns these buckets."""
        self._finish()
        told = self.changes()
        due = sorted(bucket for bucket, n in Counter(bucket for _, bucket in told).items() if n >= least)
        if due:
            upto = max(batch for batch, _ in told)
            self._merged(due, upto).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/folding/rows")
            self.spark.createDataFrame([(b, upto) for b in due], "bucket int, upto long").write.mode("overwrite").parquet(f"{self.folder}/folding/due")
            self._finish()
        return due

    def _finish(self) -> None:
        """Puts rows that a compaction has written in the place of the old ones; what was cut off before is done again."""
        if not glob(self.spark, f"{self.folder}/folding/due/_SUCCESS"):
            return
        due = self.spark.read.parquet(f"{self.folder}/folding/due").collect()  # one row a bucket
        staged = {int(p.rsplit("=", 1)[1]) for p in glob(self.spark, f"{self.folder}/folding/rows/bucket=*")}
        if staged:
            self.spark.read.parquet(f"{self.folder}/folding/rows").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.folder}/rows")
        buckets, upto = {b for b, _ in due}, max(n for _, n in due)
        for b in buckets - staged:
            delete(self.spark, f"{self.folder}/rows/bucket={b}")
        self.spark.range(0).write.mode("overwrite").parquet(f"{self.folder}/folded/batch={upto}")
        for batch, bucket in self.changes():  # oldest first: what a later batch took away must not come back
            if bucket in buckets and batch <= upto:
                delete(self.spark, f"{self.folder}/changes/batch={batch}/bucket={bucket}")
        delete(self.spark, f"{self.folder}/folding")
