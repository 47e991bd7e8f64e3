"""Digests of trees: a folder's digest is a sum over the files beneath it, so equal subtrees are known without their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.changes import listing_changes
from skein.sources.folders import delete, glob

BUCKETS = 64
#: A digest is four sums of 60 bits each.
PARTS, DIGITS = 4, 15
NODE = "project_id int, folder string, files long, digest string"
FILE = "project_id int, folder string, path string, content_hash string"


def folder_of(path: Column) -> Column:
    """The folder that a file lies in, empty at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def _summed(files: DataFrame, *keys: str) -> DataFrame:
    """files and digest by keys. Sums can be taken in any order and ahead of the shuffle, however large a folder is."""
    told = F.sha2(F.concat_ws("\0", F.col("path"), F.coalesce("content_hash", F.lit(""))), 256)
    named = files.withColumn("_sha", told)
    parts = [F.conv(F.substring("_sha", 1 + k * DIGITS, DIGITS), 16, 10).cast("decimal(20,0)") for k in range(PARTS)]
    sums = [F.sum(part).alias(f"_s{k}") for k, part in enumerate(parts)]
    some = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"), *sums)
    shown = [F.lower(F.lpad(F.hex((F.col(f"_s{k}") % F.lit(1 << 60)).cast("long")), DIGITS, "0")) for k in range(PARTS)]
    return some.select(*keys, "files", F.concat(*shown).alias("digest"))


def tree_digests(files: DataFrame) -> DataFrame:
    """project_id, folder, files and digest of every folder at any depth, of all files beneath it; the folder of a whole
    project is empty. files: project_id, path (a row each), content_hash. Files without a hash count with an empty one."""
    parts = F.split("path", "/")
    ends = F.sequence(F.lit(0), F.size(parts) - 1)
    above = F.transform(ends, lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return _summed(files.select("project_id", F.explode(F.array_distinct(above)).alias("folder"), "path", "content_hash"), "project_id", "folder")


class TreeStore:
    """What a tree looked like when it was last committed, under one folder that Spark reads, for one writer at a time.

    `projects` holds a digest a project, `folders/bucket=b` one of each folder's own files, `files/bucket=b` the files. A
    comparison reads the projects, then the folders of the buckets of changed projects, then the files of the buckets
    of changed folders: what it reads grows with the change. A commit writes the files first and the digests last, so
    after one that was cut off the folders still count as changed and are compared, file by file, again."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder = spark, folder.rstrip("/")
        told = [p.rsplit("=", 1)[1] for p in glob(spark, f"{self.folder}/buckets=*")]
        self.buckets = int(told[0]) if told else buckets
        if not told:
            spark.range(0).write.mode("overwrite").parquet(f"{self.folder}/buckets={buckets}")

    def _bucket(self, *columns: str) -> Column:
        return F.pmod(F.hash(*columns), F.lit(self.buckets))

    def _read(self, name: str, shape: str, only: list[int] | None = None) -> DataFrame:
        if not glob(self.spark, f"{self.folder}/{name}/*"):
            return self.spark.createDataFrame([], shape)
        if only is None:
            return self.spark.read.schema(shape).parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(f"{shape}, bucket int").parquet(f"{self.folder}/{name}").filter(F.col("bucket").isin(*only)).drop("bucket")

    def _listed(self, listing: DataFrame) -> DataFrame:
        own = listing.filter("project_id IS NOT NULL AND path IS NOT NULL")
        return own.select(F.col("project_id").cast("int"), folder_of(F.col("path")).alias("folder"), "path", "content_hash")

    @staticmethod
    def _differ(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
        a, b = old.select(*keys, F.col("digest").alias("was")), new.select(*keys, F.col("digest").alias("now"))
        return a.join(b, keys, "full_outer").filter(~F.col("was").eqNullSafe(F.col("now"))).select(*keys)

    def _numbers(self, rows: DataFrame, *columns: str) -> list[int]:
        return sorted(b for (b,) in rows.select(self._bucket(*columns)).distinct().collect())  # at most one row a bucket

    def changed(self, listing: DataFrame) -> tuple[list[int], list[int], DataFrame]:
        """Buckets of changed projects and of changed folders, and the changed folders (project_id, folder)."""
        files = self._listed(listing)
        new = _summed(files, "project_id", "folder")
        projects = self._differ(self._read("projects", NODE), _summed(files, "project_id"), ["project_id"])
        above = self._numbers(projects, "project_id")
        if not above:
            return [], [], projects.withColumn("folder", F.lit(None).cast("string"))
        folders = self._differ(self._read("folders", NODE, above), new.filter(self._bucket("project_id").isin(*above)), ["project_id", "folder"])
        return above, self._numbers(folders, "project_id", "folder"), folders

    def changes(self, listing: DataFrame) -> DataFrame:
        """project_id, change, path and old_path, as listing_changes tells them; a file is renamed within its project.
        listing: project_id, path (a row each) and content_hash of all files of all projects; rows without project or path
        are passed over."""
        _, dirty, folders = self.changed(listing)
        if not dirty:
            return self.spark.createDataFrame([], "project_id int, change string, path string, old_path string")
        # a path is told with its project, so that equal contents in two projects are not one file
        named = lambda rows: rows.join(folders, ["project_id", "folder"], "left_semi").select(F.concat("project_id", F.lit(":"), "path").alias("path"), F.concat("project_id", F.lit(":"), "content_hash").alias("content_hash"))
        mine = self._listed(listing).filter(self._bucket("project_id", "folder").isin(*dirty))
        told = listing_changes(named(self._read("files", FILE, dirty)), named(mine))
        plain = lambda c: F.regexp_replace(c, "^[^:]*:", "")
        return told.select(F.regexp_extract("path", "^([^:]*):", 1).cast("int").alias("project_id"), "change", plain("path").alias("path"), plain("old_path").alias("old_path"))

    def commit(self, listing: DataFrame) -> list[int]:
        """Takes the listing as what the tree looks like now; the buckets of files that were written."""
        above, dirty, _ = self.changed(listing)
        if not above:
            return []
        files = self._listed(listing)
        self._put("files", files.withColumn("bucket", self._bucket("project_id", "folder")), dirty)
        nodes = _summed(files, "project_id", "folder").select(*(c.split()[0] for c in NODE.split(", ")))
        self._put("folders", nodes.withColumn("bucket", self._bucket("project_id")), above)
        _summed(files, "project_id").withColumn("folder", F.lit("")).write.mode("overwrite").parquet(f"{self.folder}/projects")
        return dirty

    def _put(self, name: str, rows: DataFrame, buckets: list[int]) -> None:
        """These buckets anew, from rows alone; those without rows go."""
        # up to 8 tasks a bucket, as one folder may hold much of the tree
        some = rows.filter(F.col("bucket").isin(*buckets)).repartition("bucket", F.pmod(F.xxhash64(*(c for c in rows.columns if c != "bucket")), F.lit(8)))
        some.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.folder}/{name}")
        there = {b for (b,) in rows.select("bucket").distinct().collect()}  # at most one row a bucket
        for b in set(buckets) - there:
            delete(self.spark, f"{self.folder}/{name}/bucket={b}")
