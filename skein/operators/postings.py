"""A positional inverted index on Parquet: postings sorted by term and block of texts, and the best matches of a query from
the postings of its terms, without the places in blocks that can't hold any of them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.batches import portions
from skein.functions.lexical import cover_terms, covers, tokens, websearch
from skein.operators.search import ranked

#: Blocks of texts by a hash of their ids: a fixed number, so that a query's bounds of blocks fit in the driver. A part of a
#: frequent term has so many of them, to the power of two; in how many texts of a batch a frequent term is.
BLOCKS, SPREAD, OFTEN = 1024, 6, 64
#: Words that a task sorts at once.
AT_ONCE = 1 << 21


def _order(keys: np.ndarray) -> np.ndarray:
    """The places of keys (0 to 2 ** 31) in their order, of equal keys the first one first. Numbers that hold both are all different, so the fast sort of plain numbers does."""
    both = keys.astype(np.int64) << 32
    both |= np.arange(len(keys))
    both.sort()
    return both.astype(np.int32)


def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (id, block, words): term, part, and arrays of the ids of the batch's texts that hold it and of their places. A term of
    over OFTEN texts of the batch is dealt into parts by block, so that no task gets all of a frequent term."""
    for batch in (part for whole in batches if whole.num_rows for part in portions(whole, pc.list_value_length(whole.column("words")), AT_ONCE)):
        batch = batch.take(pc.sort_indices(batch, sort_keys=[("block", "ascending"), ("id", "ascending")]))  # so a row's ids are in the order of files
        lists = batch.column("words")
        words = pc.list_flatten(lists).dictionary_encode()
        terms, code = words.dictionary, words.indices.to_numpy()
        owner = pc.list_parent_indices(lists).to_numpy().astype(np.int32)
        del words
        if not len(owner):
            continue
        begin = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=batch.num_rows))]).astype(np.int32)
        order = _order(code)
        sorted_code, sorted_owner = code[order], owner[order]
        starts = np.flatnonzero(np.append(True, (sorted_code[1:] != sorted_code[:-1]) | (sorted_owner[1:] != sorted_owner[:-1]))).astype(np.int32)
        del sorted_code, sorted_owner  # arrays of a number a word go as soon as they have served: a task holds few of them at once
        first, ends = order[starts], np.append(starts, np.int32(len(order)))
        term, text = code[first], owner[first]
        places = (np.arange(len(owner), dtype=np.int32) - begin[owner])[order]
        del code, owner, order, first, starts
        part = np.where(np.bincount(term)[term] > OFTEN, batch.column("block").to_numpy()[text] >> SPREAD, -1).astype(np.int32)
        dealt = _order(term.astype(np.int64) * (1 + (BLOCKS >> SPREAD)) + 1 + part)  # a posting of a text each, by term and part
        term, text, part, sizes = term[dealt], text[dealt], part[dealt], np.diff(ends)[dealt]
        heads = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (part[1:] != part[:-1]))).astype(np.int32)
        inner = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        places = places[np.repeat(ends[:-1][dealt] - inner[:-1], sizes) + np.arange(inner[-1], dtype=np.int32)]
        del ends, dealt, sizes
        bounds = np.append(heads, np.int32(len(term)))
        row = np.repeat(np.arange(len(heads), dtype=np.int32), np.diff(bounds))
        # of each row the ids, where the places of each id begin, from 1, and the places end to end
        lists = ((bounds, batch.column("id").take(pa.array(text))), (bounds, pa.array(inner[:-1] - inner[heads][row] + 1)), (inner[bounds], pa.array(places)))
        yield pa.RecordBatch.from_arrays(
            [terms.take(pa.array(term[heads])).cast(pa.string()), pa.array(part[heads]), *(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values) for offsets, values in lists)],
            ["term", "part", "ids", "starts", "places"])


def block() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(BLOCKS)).cast("int")


def unpacked(found: DataFrame) -> DataFrame:
    """A posting a row of what places() gives: term, block, id, n and places. Its places are cut out once it is a row, by
    generated code; in a lambda over the ids each cut is interpreted."""
    end = F.coalesce(F.get("starts", F.col("i") + 1), F.size("places") + 1)
    each = found.select("term", "starts", "places", F.posexplode("ids").alias("i", "id")).select("term", "id", "places", F.get("starts", F.col("i")).alias("start"), end.alias("end"))
    n = F.col("end") - F.col("start")
    return each.select("term", block().alias("block"), "id", n.alias("n"), F.slice("places", F.col("start"), n).alias("places"))


def fits(groups: list[list[tuple[bool, list[str]]]], column: dict[str, Column]) -> Column:
    """Whether a text with these places of terms fits a web-style query."""

    def shifted(w: str, k: int) -> Column:
        return F.transform(column[w], lambda p: p - k)

    def holds(words: list[str]) -> Column:
        starts = [shifted(w, k) for k, w in enumerate(words)]
        return column[words[0]].isNotNull() if len(words) == 1 else F.coalesce(F.size(reduce(F.array_intersect, starts)) > 0, F.lit(False))

    return reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, (~holds(words) if neg else holds(words) for neg, words in group)) for group in groups))


class TextIndex:
    """The index of one language under a folder. A query reads the postings of its terms: files are sorted by term, block and
    id, so that Parquet's statistics leave out the rest; the best blocks are told by the numbers of places alone."""

    def __init__(self, spark: SparkSession, folder: str, language: str | None = None):
        self.language = language
        self.postings = spark.read.schema("term string, block int, id long, n int, places array<int>").parquet(f"{folder}/postings")
        self.ids = spark.read.schema("id long, block int").parquet(f"{folder}/ids")
        #: Blocks that the last top-k read, and those that hold any of its terms.
        self.read_blocks = self.known_blocks = 0

    @classmethod
    def build(cls, rows: DataFrame, text: Column, folder: str, language: str | None = None) -> TextIndex:
        """Of rows with a different long id each. A null text has no words."""
        spark = rows.sparkSession
        texts = rows.select(F.col("id").cast("long").alias("id"), tokens(text, language).alias("words")).select("id", block().alias("block"), "words")
        # rows of many postings, by term and each in the order of files, so that the sort of single postings mostly merges runs
        found = texts.mapInArrow(places, "term string, part int, ids array<long>, starts array<int>, places array<int>").repartition("term", "part").sortWithinPartitions("term")
        unpacked(found).sortWithinPartitions("term", "block", "id").write.option("parquet.block.size", 16 << 20).option("compression", "zstd").parquet(f"{folder}/postings")
        rows.select(F.col("id").cast("long").alias("id")).withColumn("block", block()).write.parquet(f"{folder}/ids")
        return cls(spark, folder, language)

    def matches(self, query: str, blocks: list[int] | None = None, score: bool = False) -> DataFrame:
        """id, and score if asked for, of the texts that fit; blocks: in these alone."""
        groups = websearch(query, self.language)
        terms = sorted({w for group in groups for _, words in group for w in words})
        if not terms:
            return self.ids.filter("false").select("id", *([F.lit(0.0).alias("score")] if score else []))
        here = lambda df: df if blocks is None else df.filter(F.col("block").isin(*blocks))
        rows = here(self.postings.filter(F.col("term").isin(*terms)))
        per = rows.groupBy("id").agg(*(F.max(F.when(F.col("term") == w, F.col("places"))).alias(f"p{k}") for k, w in enumerate(terms)))
        if self._needs_all(groups):
            per = here(self.ids).select("id").join(per, "id", "left")
        column = {w: F.col(f"p{k}") for k, w in enumerate(terms)}
        per = per.filter(fits(groups, column))
        if not score:
            return per.select("id")
        none = F.array().cast("array<struct<i:int,w:string>>")
        of = lambda w: F.coalesce(F.transform(column[w], lambda p: F.struct(p.alias("i"), F.lit(w).alias("w"))), none)
        found = F.array_sort(F.concat(*map(of, terms)))
        return per.select("id", F.round(covers(found, cover_terms(query, self.language)), 9).alias("score"))

    @staticmethod
    def _needs_all(groups: list[list[tuple[bool, list[str]]]]) -> bool:
        """Whether a text without any of the words may fit: each alternative has a negated part."""
        return all(any(neg for neg, _ in group) for group in groups)

    def _bounds(self, query: str) -> list[tuple[int, float, int]]:
        """block, the best score that a text of it may have, how many texts may fit; best first. Each minimal cover holds an
        occurrence of every term, scores 1 at most, and n of n terms' covers at most share one occurrence."""
        slots = cover_terms(query, self.language)
        terms = sorted({w for group in websearch(query, self.language) for _, words in group for w in words})
        most = lambda w: F.coalesce(F.max(F.when(F.col("term") == w, F.col("n"))), F.lit(0))
        sums = [reduce(lambda a, b: a + b, map(most, words)) for words in slots]
        texts = [reduce(lambda a, b: a + b, (F.count_if(F.col("term") == w) for w in words)) for words in slots]
        least = lambda cs: F.array_min(F.array(*cs)) if cs else F.lit(0)
        per = self.postings.filter(F.col("term").isin(*terms)).groupBy("block").agg((least(sums) * len(slots)).cast("double").alias("bound"), least(texts).cast("long").alias("texts"))
        return sorted(((b, bound, n) for b, bound, n in per.collect()), key=lambda r: (-r[1], r[0]))  # BLOCKS rows at most

    def topk(self, query: str, n: int, live: DataFrame | None = None) -> DataFrame:
        """id, score, rank of the n best matches by cover density; live: of these ids (id) alone. The blocks of the highest
        bounds are scored first; of the others only those are read whose bound reaches the n-th score."""
        order = F.col("score").desc(), F.col("id").asc()
        scored = lambda blocks: (lambda df: df if live is None else df.join(live.select("id"), "id", "left_semi"))(self.matches(query, blocks, score=True))
        groups = websearch(query, self.language)
        if not groups or self._needs_all(groups):
            return ranked(scored(None).orderBy(*order).limit(n), *order)
        bounds = self._bounds(query)
        self.known_blocks, seeds, seen = len(bounds), [], 0
        for b, _, texts in bounds:
            if seen >= 2 * n and len(seeds) >= n:
                break
            seeds.append(b)
            seen += texts
        best = [(r["id"], r["score"]) for r in scored(seeds).orderBy(*order).limit(n).collect()] if seeds else []
        least = best[-1][1] if len(best) == n else 0.0
        rest = [b for b, bound, _ in bounds[len(seeds) :] if bound + 1e-6 >= least]
        self.read_blocks = len(seeds) + len(rest)
        found = self.postings.sparkSession.createDataFrame(best, "id long, score double")
        if rest:
            found = found.unionByName(scored(rest).orderBy(*order).limit(n))
        return ranked(found.orderBy(*order).limit(n), *order)
