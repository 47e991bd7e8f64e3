"""Removal of every byte covered by a window (200 bytes) that starts anywhere else too.

A depth-limited radix sort: suffixes are ordered through their first WINDOW bytes, by passes over digits of DIGIT bytes,
most significant first. What stands alone after a pass leaves; groups left after the last pass are exactly the repeated
windows. Three lossless steps before it keep most suffixes out of the sort:

1. Sampling. Every window selects the 64-byte gram in it of least hash. Equal windows select equal grams, at equal
   offsets; so a window whose gram is seen once in all texts is not repeated. All windows that select one occurrence of a
   gram are a run of starts, and one row stands for the run.
2. Runs that are equal in all the bytes they span (by a 128-bit hash) and in the gram's place are collapsed. Of those seen
   twice or more every window is repeated; and one occurrence of each goes on if its gram has other runs too.
3. The suffixes of these runs begin in buckets by gram and offset. Only suffixes of one bucket can be equal, so a bucket
   is sorted in one task, with the bytes of its runs. A gram with more than LOCAL suffixes would be too much for a task:
   its suffixes go to the cluster, where all their digits are one hash of 128 bits, counted by partial sums.

Hot grams cost no more than others elsewhere: counts are partial sums, and the ways back to places are joins of written
tables, which Spark may split. Sets of keys that filter before a shuffle are bitmaps of bounded size.

Cases: null and empty texts have no bytes; texts shorter than the window lose nothing; texts of any length are read whole,
in slices that overlap by a window less a byte; of equal gram hashes in a window the last is selected; equal texts are
occurrences of each other, whatever their ids; overlaps within one text count; a null doc_id is kept; an empty table gives
no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import anchors
from skein.llm.common import bounded_batches, key_filter, stored, table, trimmed, utf8

WINDOW = 200
GRAM = 64
DIGIT = 8
#: Starts of one slice of a long text; suffixes that a task sorts at once; and those of one gram that it may have.
SLICE = 1 << 19
AT_ONCE = 1 << 18
LOCAL = 1 << 19


def keyed(docs: DataFrame, carried: list[str]) -> DataFrame:
    """rest (doc_id and the carried columns), data (the text's bytes) and d1, d2, a 128-bit key of the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.struct("doc_id", *carried).alias("rest"), F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(1), text).alias("d2"), utf8(F.col("text")).alias("data"))


def slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of the data column, about CHUNK bytes at a time: bytes end to end, where each slice ends, and its row and its
    first place in the row's text."""
    held, size = [], 0
    for row, value in enumerate(batch.column("data")):
        text = value.as_buffer()
        for at in range(0, max(1, len(text) - WINDOW + 1), SLICE):
            part = text[at : at + SLICE + WINDOW - 1]
            if held and size + len(part) > anchors.CHUNK:
                yield laid(held)
                held, size = [], 0
            held.append((row, at, part))
            size += len(part)
    if held:
        yield laid(held)


def laid(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows, at, parts = zip(*held, strict=True)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), np.array(rows), np.array(at)


@trimmed
def find_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The gram of each anchor."""
    for batch in batches:
        for data, ends, _, _ in slices(batch):
            hashed, at, _, _, _ = anchors.select(data, ends, WINDOW, GRAM)
            yield pa.RecordBatch.from_arrays([pa.array(hashed(at, at + GRAM).astype(np.int64))], ["gram"])


@trimmed
def find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each anchor with its run: a hash of its gram, one of all that the run spans and of the gram's place in it, and
    the text, the gram's place there, and the run's first and last start."""
    for batch in batches:
        d1, d2 = (batch.column(c).to_numpy() for c in ("d1", "d2"))
        for data, ends, rows, base in slices(batch):
            first, at, lo, hi, part = anchors.select(data, ends, WINDOW, GRAM)
            second, place = anchors.RunHash(data, 1), (at - lo).astype(np.uint64)
            c1 = (first(lo, hi + WINDOW) + place * anchors.MIX).astype(np.int64)
            c2 = (second(lo, hi + WINDOW) ^ anchors.mixed(place)).astype(np.int64)
            shift = base[part] - np.concatenate([[0], ends[:-1]])[part]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (first(at, at + GRAM).astype(np.int64), c1, c2, d1[rows[part]], d2[rows[part]], (at + shift).astype(np.int32), (lo + shift).astype(np.int32), (hi + shift).astype(np.int32))],
                ["gram", "c1", "c2", "d1", "d2", "at", "lo", "hi"])


RUNS = "gram long, c1 long, c2 long, d1 long, d2 long, at int, lo int, hi int"


@trimmed
def cut_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs of each text."""
    for batch in batches:
        d1, d2, found = batch.column("d1").to_numpy(), batch.column("d2").to_numpy(), batch.column("runs")
        for row in range(batch.num_rows):
            text, runs = batch.column("data")[row].as_buffer(), found[row].values
            lo, hi = runs.field("lo").to_numpy(), runs.field("hi").to_numpy()
            spans = [text[a : b + WINDOW].to_pybytes() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [runs.field("gram"), runs.field("hot"), runs.field("alone"), pa.array(np.full(len(lo), d1[row])), pa.array(np.full(len(lo), d2[row])), pa.array(runs.field("at").to_numpy() - lo), pa.array(lo), pa.array(spans, pa.binary())],
                ["gram", "hot", "alone", "d1", "d2", "place", "lo", "span"])


SPANS = "gram long, hot boolean, alone boolean, d1 long, d2 long, place int, lo int, span binary"


def suffix_groups(data: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The radix sort: of the suffixes of data at starts, in groups, those that share their first depth bytes with others of
    their group, in the order of group and bytes, and numbers that say which are equal. depth: a multiple of DIGIT."""
    padded = np.concatenate([data, np.zeros(DIGIT, np.uint8)])
    digits = np.zeros(len(data), np.uint64)
    for k in range(DIGIT):  # the DIGIT bytes from each place on, as one number
        digits <<= np.uint64(8)
        digits |= padded[k : k + len(data)]
    order = np.argsort(group, kind="stable")
    at, told = starts[order], group[order]
    for done in range(-1, depth // DIGIT):
        digit = digits[at + DIGIT * done] if done >= 0 else np.zeros(len(at), np.uint64)
        same = told[1:] == told[:-1]
        if done >= 0 and len(at):
            unequal = np.zeros(int(told[-1]) + 1, bool)
            unequal[told[1:][same & (digit[1:] != digit[:-1])]] = True
            some = np.flatnonzero(unequal[told])
            moved = some[np.lexsort((digit[some], told[some]))]
            at[some], digit[some] = at[moved], digit[moved]
        new = np.append(True, ~same | (digit[1:] != digit[:-1]))[: len(at)]
        number = np.cumsum(new) - 1
        shared = np.bincount(number, minlength=1)[number] > 1
        at, number = at[shared], number[shared]
        told = np.cumsum(np.append(False, number[1:] != number[:-1]))[: len(at)]  # dense again
    return at, told


@trimmed
def sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of SPANS sorted by gram: the starts (first, last) whose windows are found again, of runs that stand alone."""

    def one(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        spans = t.column("span").to_pylist()
        sizes = np.fromiter(map(len, spans), np.int64, len(spans))
        base, n = np.cumsum(sizes) - sizes, sizes - WINDOW + 1
        gram = np.unique(t.column("gram").to_numpy(), return_inverse=True)[1]
        owner = np.repeat(np.arange(len(n)), n)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        offset = t.column("place").to_numpy()[owner] - inner
        data = np.frombuffer(b"".join(spans), np.uint8)
        at, _ = suffix_groups(data, base[owner] + inner, gram[owner] * WINDOW + offset)
        at.sort()
        run = np.searchsorted(base, at, "right") - 1
        alone = t.column("alone").to_numpy()[run]
        at, run = at[alone], run[alone]
        new = np.append(True, (at[1:] != at[:-1] + 1) | (run[1:] != run[:-1]))[: len(at)]
        first, last = at[new], at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] if len(at) else at
        run = run[new]
        shift = t.column("lo").to_numpy()[run] - base[run]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (t.column("d1").to_numpy()[run], t.column("d2").to_numpy()[run], (first + shift).astype(np.int32), (last + shift).astype(np.int32))], ["d1", "d2", "lo", "hi"])

    held, size, last = [], 0, None
    for batch in batches:
        grams = batch.column("gram").to_numpy()
        cuts = [0, *(np.flatnonzero(grams[1:] != grams[:-1]) + 1).tolist(), len(grams)]
        lengths = np.concatenate([[0], np.cumsum([len(x.as_buffer()) - WINDOW + 1 for x in batch.column("span")])])
        begin = 0
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if grams[a] != last and size >= AT_ONCE:
                yield one([*held, batch.slice(begin, a - begin)])
                held, size, begin = [], 0, a
            last = grams[a]
            size += int(lengths[b] - lengths[a])
        held.append(batch.slice(begin))
    if held and sum(map(len, held)):
        yield one(held)


STARTS = "d1 long, d2 long, lo int, hi int"


@trimmed
def hash_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of SPANS, all digits of each suffix as one, with the gram and the offset."""
    for batch in batches:
        for row, span in enumerate(batch.column("span")):
            data = np.frombuffer(span.as_buffer(), np.uint8)
            w1, w2 = (anchors.RunHash(data, k).each(WINDOW).astype(np.int64) for k in (0, 1))
            n = len(w1)
            same = [pa.array(np.full(n, batch.column(c)[row].as_py())) for c in ("gram", "d1", "d2", "alone")]
            yield pa.RecordBatch.from_arrays([same[0], pa.array(batch.column("place")[row].as_py() - np.arange(n, dtype=np.int32)), pa.array(w1), pa.array(w2), *same[1:], pa.array(batch.column("lo")[row].as_py() + np.arange(n, dtype=np.int32))],
                                             ["gram", "offset", "w1", "w2", "d1", "d2", "alone", "s"])


WINDOWS = "gram long, offset int, w1 long, w2 long, d1 long, d2 long, alone boolean, s int"


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left without the spans (sorted by start), bytes removed, and maximal removed runs."""
    parts, done, removed, runs = [], 0, 0, 0
    for a, b in spans:
        if a > done or not runs:
            parts.append(data[done:a])
            removed, runs, done = removed + b - a, runs + 1, b
        elif b > done:
            removed, done = removed + b - done, b
    return b"".join([*parts, data[done:]]), removed, runs


@trimmed
def remove_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            rows = []
            for data, spans in zip(batch.column("data"), batch.column("spans"), strict=True):
                data = data.as_py()
                kept, removed, runs = kept_bytes(data, list(zip(*(spans.values.field(k).to_pylist() for k in ("a", "b")), strict=True)) if spans.is_valid else [])
                # a character of which a byte went goes as a whole
                rows.append((len(data), removed, runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            n, removed, runs, digest, text = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string()), pa.array(text, pa.string())],
                                             ["rest", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Of keyed documents: d1, d2 and spans (sorted, of a, b) to remove of each text that has any."""
    texts = docs.select("d1", "d2", "data")
    grams = texts.mapInArrow(find_grams, "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram")
    grams = stored(grams, "grams")
    runs = stored(key_filter(grams, "gram", grams.count())(texts.mapInArrow(find_runs, RUNS), "gram"), "runs")
    span = ["gram", "c1", "c2"]
    kinds = stored(runs.groupBy(*span).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d1", "d2", "at", "lo", "hi")).alias("own")), "kinds")
    # written tables, so that both sides of a join are plain shuffles, which Spark can split at a hot gram
    many = stored(kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("own.hi") - F.col("own.lo") + 1).alias("suffixes")).filter("kinds > 1"), "many")
    listed = kinds.join(many, "gram").select("own.d1", "own.d2", F.struct("gram", "own.at", "own.lo", "own.hi", (F.col("n") == 1).alias("alone"), (F.col("suffixes") > LOCAL).alias("hot")).alias("run"))
    listed = stored(listed.groupBy("d1", "d2").agg(F.collect_list("run").alias("runs")), "listed")
    # one of each of these texts; a text's own runs are a list no longer than it
    own = key_filter(listed, "d1", listed.count())(texts, "d1").groupBy("d1", "d2").agg(F.first("data").alias("data"))
    spans = stored(own.join(listed, ["d1", "d2"]).mapInArrow(cut_runs, SPANS), "spans")
    found = spans.filter("NOT hot").repartition("gram").sortWithinPartitions("gram").mapInArrow(sort_buckets, STARTS)
    if not spans.filter("hot").isEmpty():
        windows = stored(spans.filter("hot").mapInArrow(hash_windows, WINDOWS), "windows")
        twice = stored(windows.groupBy("gram", "offset", "w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "twice")
        found = found.unionByName(windows.filter("alone").join(twice, ["gram", "offset", "w1", "w2"]).select("d1", "d2", F.col("s").alias("lo"), F.col("s").alias("hi")))
    whole = runs.join(kinds.filter("n > 1").select(*span), span).select("d1", "d2", "lo", "hi")
    starts = found.unionByName(whole)
    return starts.groupBy("d1", "d2").agg(F.sort_array(F.collect_set(F.struct(F.col("lo").alias("a"), (F.col("hi") + WINDOW).alias("b")))).alias("spans"))


def dedup_bytes(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, the carried columns, n_bytes, n_removed, n_spans, kept_sha256, kept (text) per document row."""
    bounded_batches(docs.sparkSession)
    docs = keyed(docs, list(carried))
    spans = stored(repeated_spans(docs), "cuts")
    sieve = key_filter(spans, "d1", spans.count())
    cut = sieve(docs, "d1").join(spans, ["d1", "d2"], "left").select("rest", "data", "spans")
    none = F.lit(0).cast("long")
    whole = sieve(docs, "d1", inverse=True).select("rest", F.octet_length("data").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2("data", 256).alias("kept_sha256"), F.col("data").cast("string").alias("kept"))
    return whole.unionByName(cut.mapInArrow(remove_spans, whole.schema)).select("rest.*", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: DuckDB, by every window of every text; for tables of small size.
OP5_SQL = """
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT rid, s, md5(substr(x, 2 * s + 1, 400)) AS k FROM (SELECT rid, x, unnest(range(0, len(x) // 2 - 199)) AS s FROM t WHERE len(x) >= 400)),
r AS (SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
g AS (SELECT rid, s, sum(CASE WHEN s - p <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY s) AS g FROM (SELECT rid, s, lag(s) OVER (PARTITION BY rid ORDER BY s) AS p FROM r)),
runs AS (SELECT rid, min(s) AS a, max(s) + 200 AS b FROM g GROUP BY rid, g),
cuts AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS e FROM runs),
kept AS (SELECT t.rid, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(x, 2 * e + 1, 2 * (a - e)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS y FROM cuts JOIN t USING (rid) GROUP BY t.rid)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256 FROM t LEFT JOIN kept USING (rid)
"""
