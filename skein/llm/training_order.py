"""Training-order materialisation: fixed-size sequences of token ids in a keyed random order, in binary shards.

All texts, encoded by a vocabulary and each followed by the END id, are one stream in the order of the input's files and
of the rows in them, whatever way Spark splits the files. The stream is cut into sequences of SEQUENCE ids; only its last
one is filled up with PAD. A keyed Feistel network over the next power of four, walked until it falls below the number of
sequences, permutes their numbers; the result is a sequence's global slot.

The texts are read and encoded once, to a table of ids with each row's place in its file split. One sum a split turns
these into places in the stream. Sequences then go, compressed, to range partitions of slots with exact bounds: partition k
is shard k and holds slots k * size to (k + 1) * size - 1 in order, each a record of the same stride. So a reader finds slot s at
byte (s mod size) * stride of shard s div size, seeks there and may resume anywhere. The payload is shuffled once. Shards
are written by Spark's text writer, whose commit protocol survives lost executors: a record is SEQUENCE ids of the
vocabulary's width (2 or 4 bytes, little-endian), and the writer's line end. The manifest, from the table of ids without the ids, says
which ids of which document each sequence holds.

Cases: null and empty texts are one END; long texts go over as many sequences as they need; equal rows each stand for
themselves; ties in the order do not occur, as a file and a place in it belong to one row; an empty table has no slot and
no shard; further columns are ignored, whatever their names; a table that is not a scan of files is written first, and its order is that of the written files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.anchors import mixed
from skein.llm.bpe import Codec, id_codec, vocabulary_path
from skein.llm.common import bounded_batches, shared_dir, stored, table, trimmed

SEQUENCE = 512
SHARD = 1 << 14
#: Bytes of ids that a task holds before it sends them on, and how hard they are compressed.
HELD, LEVEL = 16 << 20, 3
ROUNDS = 6
KEY = 20240229
U = np.uint64


class Form(NamedTuple):
    """How ids are written: numpy type, bytes an id, and the two ids that no text has."""

    kind: str
    width: int
    end: int
    pad: int


def form_of(vocabulary: str) -> Form:
    """END is the vocabulary's first special id, or the first free one; PAD the greatest of the width."""
    codec = Codec(vocabulary)
    end = min(codec.special.values(), default=max(codec.bytes_of) + 1)
    width = 2 if max(end, *codec.bytes_of) < 0xFFFF else 4
    return Form(f"<u{width}", width, end, (1 << 8 * width) - 1)


def feistel(numbers: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of 0 to n - 1, or its inverse."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, keys = U((1 << half) - 1), mixed(np.arange(1, ROUNDS + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(key))
    out, open_ = numbers.astype(U), np.arange(len(numbers))
    while len(open_):
        left, right = out[open_] >> U(half), out[open_] & mask
        for k in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (mixed(left ^ k) & mask), left
            else:
                left, right = right, left ^ (mixed(right ^ k) & mask)
        out[open_] = (left << U(half)) | right
        open_ = open_[out[open_] >= U(n)]  # cycle-walking
    return out.astype(np.int64)


def binaries(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    """Values that end at these bytes of data."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def encode(vocabulary: str, form: Form):
    """Python over (doc_id, text, file, block), a file's rows in their order: place in the split, count and ids of each row."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for whole in batches:
            for begin in range(0, whole.num_rows, 1000):
                batch = whole.slice(begin, 1000)
                ids, n = id_codec(vocabulary).ids_of(batch.column("text").to_pylist())
                sizes = n + 1
                ends = np.cumsum(sizes)
                stream = np.full(int(ends[-1]), form.end, form.kind)
                stream[np.repeat(np.arange(len(n)), n) + np.arange(len(ids))] = ids
                places = np.empty(len(n), np.int64)
                for k, split in enumerate(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True)):
                    if split != last:
                        last, seen = split, 0
                    places[k] = seen
                    seen += int(sizes[k])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("file"), batch.column("block"), pa.array(places), pa.array(sizes), binaries(ends * form.width, stream)], ["doc_id", "file", "block", "place", "n", "ids"])

    return run, "doc_id long, file string, block long, place long, n long, ids binary"


def encoded(docs: DataFrame, vocabulary: str, form: Form) -> DataFrame:
    """doc_id, place (in the whole stream), n (END counts), ids of every row: a table, and places from one sum a split."""
    try:
        rows = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    except AnalysisException:
        return encoded(stored(docs.select("doc_id", "text"), "documents"), vocabulary, form)
    told = stored(rows.mapInArrow(*encode(vocabulary, form)), "ids")
    splits = told.groupBy("file", "block").agg(F.sum("n").alias("held"))
    before = F.sum("held").over(W.orderBy("file", "block")) - F.col("held")
    splits = splits.select("file", "block", before.alias("before"))
    # one row a split of the input's files: at 128 MB a split some 8 MB for every 10 TB
    return told.join(F.broadcast(splits), ["file", "block"]).select("doc_id", (F.col("before") + F.col("place")).alias("place"), "n", "ids")


def cut(n: int, key: int, form: Form, shard: int):
    """Python over (place, ids): sequences, and parts of those that go over several tasks, packed for each shard; what goes
    to one shard from HELD bytes is compressed as a whole: slots, places in the record, sizes, ids."""
    stride = SEQUENCE * form.width

    def packed(held: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """held: runs of bytes with the place of their first."""
        bounds = [np.unique(np.concatenate([[p], np.arange(-(-p // stride) * stride, p + len(x), stride), [p + len(x)]])) for p, x in held]
        begins, sizes = np.concatenate([x[:-1] for x in bounds]), np.concatenate([np.diff(x) for x in bounds])
        slots = feistel(begins // stride, n, key)
        data, ends = memoryview(np.concatenate([x for _, x in held])), np.cumsum(sizes)
        order, codec = np.argsort(slots // shard, kind="stable"), pa.Codec("zstd", compression_level=LEVEL)
        shards = slots[order] // shard
        cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = order[a:b]
            raw = b"".join([slots[own].tobytes(), (begins[own] % stride).tobytes(), sizes[own].tobytes(), *(data[e - k : e] for e, k in zip(ends[own].tolist(), sizes[own].tolist(), strict=True))])
            rows.append((int(shards[a]), b - a, len(raw), codec.compress(raw, asbytes=True)))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["shard", "parts", "size", "packed"])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, end = [], 0, None
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                places = batch.column("place").to_numpy() * form.width
                texts = [np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column("ids")]
                ends = places + np.fromiter(map(len, texts), np.int64, len(texts))
                cuts = [0, *(np.flatnonzero(places[1:] != ends[:-1]) + 1).tolist(), len(texts)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    data = np.concatenate(texts[a:b])
                    if held and places[a] == end:
                        held[-1] = (held[-1][0], np.concatenate([held[-1][1], data]))
                    else:
                        held.append((int(places[a]), data))
                    size, end = size + len(data), int(ends[b - 1])
                if size >= HELD:
                    last, data = held[-1]
                    full = max(0, end // stride * stride - last)  # the sequence that is still open stays
                    held[-1] = (last, data[:full])
                    yield from packed([x for x in held if len(x[1])])
                    held, size = [(last + full, data[full:])], len(data) - full
        held = [x for x in held if len(x[1])]
        if held:
            yield from packed(held)

    return run, "shard int, parts int, size int, packed binary"


def assemble(n: int, form: Form, shard: int):
    """Python over cut's rows in the order of shards: each shard's records, filled up with PAD. A shard's size is fixed."""
    stride = SEQUENCE * form.width

    def records(k: int, table: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(table), k)), binaries(np.arange(1, len(table) + 1) * stride, table.ravel())], ["shard", "record"])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table = None, None
        for batch in batches:
            for k, parts, size, packed in zip(*(batch.column(c) for c in ("shard", "parts", "size", "packed")), strict=True):
                k, parts = k.as_py(), parts.as_py()
                if k != now:
                    if now is not None:
                        yield records(now, table)
                    now = k
                    table = np.full((min(shard, n - k * shard), SEQUENCE), form.pad, form.kind).view(np.uint8)
                raw = np.frombuffer(pa.decompress(packed.as_buffer(), size.as_py(), "zstd"), np.uint8)
                slots, at, sizes = raw[: 24 * parts].view(np.int64).reshape(3, parts)
                data = raw[24 * parts :]
                whole = sizes == stride
                ends = np.cumsum(sizes)
                if whole.all():
                    table[slots - k * shard] = data.reshape(parts, stride)
                    continue
                for s, a, length, end in zip((slots - k * shard).tolist(), at.tolist(), sizes.tolist(), ends.tolist(), strict=True):
                    table[s, a : a + length] = data[end - length : end]
        if now is not None:
            yield records(now, table)

    return run, "shard long, record binary"


def write_shards(rows: DataFrame, path: str, n: int, key: int, form: Form, shard: int = SHARD) -> None:
    """rows (place, ids) as shards under path/shard=k, each one file of records and line ends."""
    dealt = rows.select("place", "ids").mapInArrow(*cut(n, key, form, shard)).repartitionById(max(1, -(-n // shard)), "shard").sortWithinPartitions("shard")
    records = dealt.mapInArrow(*assemble(n, form, shard))
    # a cast of bytes to text leaves them as they are
    records.select("shard", F.col("record").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", "\n").text(path)


def manifest(rows: DataFrame, n: int, key: int, form: Form, shard: int = SHARD) -> DataFrame:
    """A row for each document in each sequence: number, slot, shard, offset (of the record in its shard's file), at (the
    first of its ids there), n_ids (END counts), doc_id, doc_offset (of that id in the document)."""

    @F.pandas_udf("long")
    def slot_of(numbers: pd.Series) -> pd.Series:
        return pd.Series(feistel(numbers.to_numpy(), n, key))

    ends = F.col("place") + F.col("n")
    spread = rows.select("doc_id", "place", ends.alias("ends"), F.explode(F.sequence(F.expr(f"place div {SEQUENCE}"), F.expr(f"(place + n - 1) div {SEQUENCE}"))).alias("number"))
    begin = F.greatest(F.col("place"), F.col("number") * SEQUENCE)
    held = spread.select("number", slot_of("number").alias("slot"), (begin - F.col("number") * SEQUENCE).cast("int").alias("at"),
                         (F.least(F.col("ends"), (F.col("number") + 1) * SEQUENCE) - begin).cast("int").alias("n_ids"), "doc_id", (begin - F.col("place")).alias("doc_offset"))
    return held.select("number", "slot", F.expr(f"slot div {shard}").alias("shard"), (F.col("slot") % shard * (SEQUENCE * form.width + 1)).alias("offset"), "at", "n_ids", "doc_id", "doc_offset")


def read_slots(spark: SparkSession, path: str, first: int, last: int, form: Form, shard: int = SHARD) -> list[np.ndarray]:
    """The ids of slots first to last, in order: only their bytes are read."""
    stride = SEQUENCE * form.width + 1
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    out = []
    for k in range(first // shard, last // shard + 1):
        files = hadoop.Path(f"{path}/shard={k}")
        fs = files.getFileSystem(conf)
        (file,) = (x.getPath() for x in fs.listStatus(files) if x.getPath().getName().startswith("part-"))
        a, b = max(first, k * shard), min(last, (k + 1) * shard - 1)
        stream = fs.open(file)
        try:
            stream.seek((a - k * shard) * stride)
            data = bytes(stream.readNBytes((b - a + 1) * stride))
        finally:
            stream.close()
        out += [np.frombuffer(data, form.kind, SEQUENCE, x) for x in range(0, len(data), stride)]
    return out


def materialise(docs: DataFrame, path: str, vocabulary: str, key: int = KEY, shard: int = SHARD) -> DataFrame:
    """Writes the shards under path; returns the manifest."""
    bounded_batches(docs.sparkSession)
    form = form_of(vocabulary)
    rows = encoded(docs, vocabulary, form)
    n = -(-(rows.agg(F.sum("n")).head()[0] or 0) // SEQUENCE)
    if n:
        write_shards(rows, path, n, key, form, shard)
    return manifest(rows, n, key, form, shard)


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/skein/shards-{uuid.uuid4().hex}", vocabulary_path())
