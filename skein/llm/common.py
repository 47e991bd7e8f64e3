"""What the training-data operators share: tables, words, shared storage and row identity."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Everything in ASCII that is neither a digit nor a lower-case letter separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NEAR_WORDS = 5
NEAR_SIMILARITY = 0.8

#: A key filter has one bit in BITS_A_KEY set or fewer, and at most MOST_BITS bits (32 MB).
BITS_A_KEY, MOST_BITS = 16, 1 << 28
BITMAP = 1 << 15

#: Bytes of a batch for Python workers, the setting that bounds them, and Spark's own value of it.
BATCH_BYTES, BATCH_SETTING, SPARK_BATCH = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="skein-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master may do without spark.checkpoint.dir."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(_local_folder())
    return f"file://{_local_folder()}"


#: Folders below which stored() writes, the innermost last.
_scopes: list[str] = []


def stored(df: DataFrame, name: str, outside: bool = False) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: cuts lineage and survives lost executors. outside: it
    outlives the innermost passing_tables()."""
    path = f"{shared_dir(df.sparkSession)}/skein/{''.join(_scopes[: len(_scopes) - outside])}{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Python workers get BATCH_BYTES at a time, and one row at least, unless the session says otherwise than Spark."""
    if spark.conf.get(BATCH_SETTING, SPARK_BATCH) == SPARK_BATCH:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


#: What a worker keeps for later tasks: the module whose tasks use it, and how it is dropped.
_kept: dict[str, Callable[[], None]] = {}


def kept_for(module: str, drop: Callable[[], None]) -> None:
    """Tasks of other modules call drop before they begin: a Python worker serves one stage after the other."""
    _kept[module] = drop


def make_room(module: str = "") -> None:
    """Drops what other modules keep, if one is named, and gives free memory back to the system."""
    for owner, drop in _kept.items():
        if module not in ("", owner):
            drop()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def trimmed(run: Callable) -> Callable:
    """run over batches, with room made before and after."""

    @functools.wraps(run)
    def whole(batches):
        make_room(run.__module__)
        try:
            yield from run(batches)
        finally:
            make_room()

    return whole


def words(text: Column) -> Column:
    """The words of a text (A-Z lower-cased); a null text has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def utf8(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def windows(array: str, width: int) -> Column:
    """A 64-bit hash of each run of width elements of the array column; of a shorter array that isn't empty, one of all."""
    n = F.size(array)
    runs = F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.xxhash64(*(F.get(F.col(array), i + (k - 1)) for k in range(width))))
    return F.when(n >= width, runs).when(n > 0, F.array(F.xxhash64(F.col(array)))).otherwise(F.array().cast("array<bigint>"))


def key_filter(keys: DataFrame, key: str, n: int):
    """A function that drops most rows of a DataFrame whose column isn't among keys; none that is. n: how many."""
    bits = BITMAP
    while bits < min(MOST_BITS, BITS_A_KEY * n):
        bits *= 2
    place = lambda c: F.col(c).bitwiseAND(F.lit(bits - 1).cast("long"))
    maps = keys.select(F.shiftright(place(key), 15).alias("kf_map"), place(key).bitwiseAND(F.lit(BITMAP - 1).cast("long")).alias("kf_bit"))
    maps = maps.groupBy("kf_map").agg(F.bitmap_construct_agg("kf_bit").alias("kf_bits"))

    def kept(df: DataFrame, column: str, inverse: bool = False) -> DataFrame:
        bit = place(column).bitwiseAND(F.lit(BITMAP - 1).cast("long"))
        byte = F.conv(F.hex(F.substring(F.col("kf_bits"), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        told = df.withColumn("kf_map", F.shiftright(place(column), 15)).join(F.broadcast(maps), "kf_map", "left")
        there = F.coalesce(F.getbit(byte, bit.bitwiseAND(F.lit(7).cast("long")).cast("int")) == 1, F.lit(False))
        return told.filter(~there if inverse else there).drop("kf_map", "kf_bits")

    return kept


def semi(df: DataFrame, keys: DataFrame, on: list[str], inverse: bool = False) -> DataFrame:
    """The rows of df whose on is among keys (stored); or, inverse, the others. Few of the rest are shuffled; on: longs."""
    sieve = key_filter(keys, on[0], keys.count())
    joined = sieve(df, on[0]).join(keys.select(*on), on, "left_anti" if inverse else "left_semi")
    return sieve(df, on[0], inverse=True).unionByName(joined) if inverse else joined


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """What stored() writes within is deleted at the end; by then all that is made of it has to be written."""
    scope = f"passing-{uuid.uuid4().hex}/"
    _scopes.append(scope)
    try:
        yield
    finally:
        folder = f"{shared_dir(spark)}/skein/{''.join(_scopes)}"
        _scopes.pop()
        delete(spark, folder)


def forget(spark: SparkSession) -> None:
    """Deletes every intermediate table in the shared folder; results that still read them are void."""
    delete(spark, f"{shared_dir(spark)}/skein")
