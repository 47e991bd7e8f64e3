"""Vectors by content: a text is embedded once, wherever and however often it is met."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.embedding import hashed_vector
from skein.sources.folders import glob

Embed = Callable[[Sequence[str]], Sequence[Sequence[float]]]
SHAPE = "content_hash string, embedding array<float>, error string"
#: Texts, and letters of texts, that are asked for at once.
TEXTS, LETTERS = 64, 1 << 20


def asked(texts: Sequence[str], embed: Embed) -> list[tuple[list[float] | None, str | None]]:
    """Vector and error of each text. A batch that fails, or gets another number of vectors, is asked for by halves, so in
    the end only the texts that fail by themselves have an error."""
    try:
        found = [list(map(float, v)) for v in embed(texts)]
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
        return [(v, None) for v in found]
    except Exception as e:
        if len(texts) == 1:
            return [(None, f"{type(e).__name__}: {e}"[:2000])]
        half = len(texts) // 2
        return asked(texts[:half], embed) + asked(texts[half:], embed)


def batches(texts: Sequence[str], most: int = TEXTS, letters: int = LETTERS) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of at most so many texts and letters; a longer text is a run of its own."""
    begin = held = 0
    for k, text in enumerate(texts):
        if k > begin and (k - begin == most or held + len(text) > letters):
            yield begin, k
            begin, held = k, 0
        held += len(text)
    if begin < len(texts):
        yield begin, len(texts)


class VectorStore:
    """Vectors by the SHA-256 of their texts, under one folder that Spark reads, for one writer at a time.

    `batch=n` holds what the n-th filling asked for. Texts that had an error are kept with it and asked for again by the
    next filling. A null text has no vector and is not asked for; the empty one is a text like others. A filling that
    was cut off left no whole batch, and is simply done again."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _batches(self) -> list[int]:
        return sorted(int(p.rsplit("/", 2)[1][6:]) for p in glob(self.spark, f"{self.folder}/batch=*/_SUCCESS"))

    def _read(self, numbers: Sequence[int]) -> DataFrame:
        paths = [f"{self.folder}/batch={n}" for n in numbers]
        return self.spark.read.schema(SHAPE).parquet(*paths) if paths else self.spark.createDataFrame([], SHAPE)

    def read(self) -> DataFrame:
        """content_hash and embedding, one row a text that has a vector."""
        return self._read(self._batches()).filter("error IS NULL").select("content_hash", "embedding")

    def missing(self, texts: DataFrame, text: str = "text") -> DataFrame:
        """content_hash and text of the texts without a vector, once each. Copies are dropped before the shuffle, and the
        same partitions by hash serve the comparison with the stored hashes, of which no vector is read."""
        own = texts.filter(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("content_hash"), F.col(text).alias("text"))
        known = self._read(self._batches()).filter("error IS NULL").select("content_hash")
        return own.dropDuplicates(["content_hash"]).join(known, "content_hash", "left_anti")

    def fill(self, texts: DataFrame, embed: Embed | None = None, text: str = "text", size: int = 64) -> tuple[int, int]:
        """Embeds what is missing; how many texts got a vector and how many an error. Without embed, the local hash."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ask = embed or (lambda some: [hashed_vector(t, size) for t in some])
            for frame in frames:
                told = frame["text"].tolist()
                for begin, end in batches(told):
                    got = asked(told[begin:end], ask)
                    yield pd.DataFrame({"content_hash": frame["content_hash"].iloc[begin:end].tolist(), "embedding": [v for v, _ in got], "error": [e for _, e in got]})

        number = max(self._batches(), default=-1) + 1
        self.missing(texts, text).mapInPandas(run, SHAPE).write.mode("overwrite").parquet(f"{self.folder}/batch={number}")
        done = self._read([number]).agg(F.count("embedding"), F.count("error")).head()
        return done[0], done[1]

    def errors(self) -> DataFrame:
        """content_hash and error of the texts that the last filling could not embed."""
        return self._read(self._batches()[-1:]).filter("error IS NOT NULL").select("content_hash", "error")

    def attach(self, rows: DataFrame, text: str = "text", name: str = "embedding") -> DataFrame:
        """The rows with the vector of their text, null where there is none."""
        found = self.read().select(F.col("content_hash").alias("_hash"), F.col("embedding").alias(name))
        return rows.withColumn("_hash", F.sha2(text, 256)).join(found, "_hash", "left").drop("_hash")

    def attached(self, rows: DataFrame, embed: Embed | None = None, text: str = "text", name: str = "embedding") -> DataFrame:
        """fill and attach in one; rows are written once, so that what they are made of is not done twice."""
        rows.write.mode("overwrite").parquet(f"{self.folder}/asked")
        kept = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/asked")
        self.fill(kept, embed, text)
        return self.attach(kept, text, name)
