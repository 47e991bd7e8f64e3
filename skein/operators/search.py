"""Hybrid search: exact vector and full-text rankings, fused by reciprocal rank."""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions.lexical import cover_density_rank, matches, may_match, tokens
from skein.functions.vector import cosine_distance
from skein.operators.predicates import suffix_match
from skein.operators.scope import Scope, in_scope, normal, scope_ids

if TYPE_CHECKING:
    from skein.operators.postings import TextIndex

RRF = 60.0


def candidates(k: int) -> int:
    return max(10 * k, 100)


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """The rows with rank 1, 2, ...; for a few rows only, as they meet in one task."""
    return rows.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def vector_topk(rows: DataFrame, query: Sequence[float], n: int, keep_null: bool = False) -> DataFrame:
    """id, distance, rank of the n nearest; rows without a vector come last, or not at all."""
    if not keep_null:
        rows = rows.filter(F.col("embedding").isNotNull())
    order = F.col("distance").asc_nulls_last(), F.col("id").asc()
    return ranked(rows.select("id", cosine_distance(F.col("embedding"), query).alias("distance")).orderBy(*order).limit(n), *order)


def text_topk(rows: DataFrame, text: Column, query: str, n: int, language: str | None = None, live: DataFrame | None = None) -> DataFrame:
    """id, score, rank of the n best matches by cover density; live: of these ids (id) alone."""
    found = rows.filter(may_match(text, query, language)).select("id", tokens(text, language).alias("words")).filter(matches(F.col("words"), query, language)).select("id", F.round(cover_density_rank(F.col("words"), query, language), 9).alias("score"))
    found = found if live is None else found.join(live.select("id"), "id", "left_semi")
    order = F.col("score").desc(), F.col("id").asc()
    return ranked(found.orderBy(*order).limit(n), *order)


def rrf_score(vector_rank: Column, text_rank: Column) -> Column:
    part = lambda r: F.coalesce(F.lit(1.0) / (F.lit(RRF) + r), F.lit(0.0))
    return part(vector_rank) + part(text_rank)


def fused(nearest: DataFrame, matched: DataFrame, k: int) -> DataFrame:
    """id and rrf_score of the k best of both rankings."""
    both = nearest.select("id", F.col("rank").alias("v")).join(matched.select("id", F.col("rank").alias("t")), "id", "full_outer")
    return both.select("id", rrf_score(F.col("v"), F.col("t")).alias("rrf_score")).orderBy(F.col("rrf_score").desc(), F.col("id").asc()).limit(k)



def chunk_text() -> Column:
    return F.concat_ws(" ", "symbol_name", "file_path", "content")


def fact_text(body: str) -> Column:
    return F.concat_ws(" ", "title", body, "evidence")


def _hybrid(tables, vectors: DataFrame, matched: DataFrame, rows: DataFrame, query: Sequence[float], k: int, columns: list[str], keep_null: bool = False) -> DataFrame:
    """vectors: id and embedding of the rows that may be found; matched: the best of them by text; rows: what is shown. The
    k ids are found first, from narrow rows; whole rows are read for them alone, by a filter that reaches the scans."""
    best = fused(vector_topk(vectors, query, candidates(k), keep_null), matched, k).collect()
    projects = tables.projects.select(F.col("id").alias("project_id"), F.col("name").alias("project"))
    scores = tables.spark.createDataFrame(best, "id long, rrf_score double")
    found = rows.filter(F.col("id").isin(*(r["id"] for r in best)) if best else F.lit(False))
    return F.broadcast(scores).join(found, "id").join(projects, "project_id", "left").select("id", "project", *columns, "rrf_score").orderBy(F.col("rrf_score").desc(), "id")


def search(tables, query: Sequence[float], words: str, k: int = 10, language: str | None = None, index: TextIndex | None = None) -> DataFrame:
    """Over all chunks, with or without a vector. index: of chunk_text(), in place of reading the texts."""
    matched = index.topk(words.strip(), candidates(k)) if index else text_topk(tables.chunks_text, chunk_text(), words.strip(), candidates(k), language)
    return _hybrid(tables, tables.chunks, matched, tables.chunks_text, query, k, ["file_path", "symbol_name", "content"], keep_null=True)


def search_code(tables, query: Sequence[float], words: str, k: int = 10, scope: str | None = None, language: str | None = None, index: TextIndex | None = None) -> DataFrame:
    own = Scope(scope_ids(tables, scope))
    rows = own(tables.chunks_text)
    matched = index.topk(words.strip(), candidates(k), rows) if index else text_topk(rows, chunk_text(), words.strip(), candidates(k), language)
    return _hybrid(tables, own(tables.chunks), matched, rows, query, k, ["file_path", "language", "chunk_type", "symbol_name", "content"])


def _search_facts(tables, name: str, body: str, query: Sequence[float], words: str, k: int, scope: str | None, language: str | None, index: TextIndex | None, columns: list[str]) -> DataFrame:
    own = Scope(scope_ids(tables, scope))
    live = lambda rows: own(rows.filter(F.col("status") != "rejected"))
    rows = live(getattr(tables, f"{name}_text"))
    bodies = getattr(tables, f"{name}_bodies", None)
    if index:
        matched = index.topk(words.strip(), candidates(k), rows)
    elif bodies is None:
        matched = text_topk(rows, fact_text(body), words.strip(), candidates(k), language)
    else:  # texts are apart from what is told of them: only the ids and scores of matches are joined
        matched = text_topk(bodies, fact_text(body), words.strip(), candidates(k), language, rows)
    return _hybrid(tables, live(getattr(tables, name)), matched, rows, query, k, columns)


def search_rules(tables, query: Sequence[float], words: str, k: int = 10, scope: str | None = None, language: str | None = None, index: TextIndex | None = None) -> DataFrame:
    """index: of fact_text("description")."""
    return _search_facts(tables, "rules", "description", query, words, k, scope, language, index, ["title", "description", "source_file", "symbol_name", "status", "evidence", "confidence"])


def search_knowledge(tables, query: Sequence[float], words: str, k: int = 10, scope: str | None = None, language: str | None = None, index: TextIndex | None = None) -> DataFrame:
    """index: of fact_text("content")."""
    return _search_facts(tables, "knowledge", "content", query, words, k, scope, language, index, ["kind", "title", "content", "source", "symbol_name", "status", "evidence", "confidence"])


def related_files(tables, query: Sequence[float], k: int = 10, scope: str | None = None, exclude: str | None = None) -> DataFrame:
    """The k files of least distance, with their number of chunks and their symbols."""
    rows = in_scope(tables.chunks.filter(F.col("embedding").isNotNull()), scope_ids(tables, scope))
    if (exclude := normal(exclude)) is not None:
        rows = rows.filter(~suffix_match(F.col("file_path"), exclude))
    per = rows.select("project_id", "file_path", "symbol_name", cosine_distance(F.col("embedding"), query).alias("distance")).groupBy("project_id", "file_path")
    symbols = F.nullif(F.array_join(F.array_sort(F.collect_set("symbol_name")), ", "), F.lit(""))
    files = per.agg(F.min("distance").alias("distance"), F.count(F.lit(1)).cast("int").alias("matched_chunks"), symbols.alias("symbols"))
    named = files.join(tables.projects.select(F.col("id").alias("project_id"), F.col("name").alias("project")), "project_id")
    return named.select("project", "file_path", "distance", "matched_chunks", "symbols").orderBy(F.col("distance").asc_nulls_last(), "project", "file_path").limit(k)


def char_budget(rows: DataFrame, most: int, key: list[str], length: Column, *tie: str) -> DataFrame:
    """Of each key's rows, longest first, those that begin within most characters; the last one is cut."""
    order = W.partitionBy(*key).orderBy(length.desc(), *tie).rowsBetween(W.unboundedPreceding, -1)
    spent = rows.withColumn("spent", F.coalesce(F.sum(length).over(order), F.lit(0)).cast("long")).filter(F.col("spent") < most)
    return spent.withColumn("content", F.substring(F.col("content"), F.lit(1), (most - F.col("spent")).cast("int"))).drop("spent")


def file_chunks(tables, path: str, scope: str | None = None, most: int = 20_000) -> DataFrame:
    """A file's chunks under a character budget."""
    rows = in_scope(tables.chunks_text, scope_ids(tables, scope)).filter(suffix_match(F.col("file_path"), path))
    # longest first, no row after most of them begins within most characters
    rows = rows.orderBy(F.length("content").desc(), "id").limit(most).withColumn("all", F.lit(1))
    return char_budget(rows, most, ["all"], F.length("content"), "id").drop("all")


#: What reranking adds and takes off, and the words of a query after structure.
SYMBOL_BOOST, WHOLE_BOOST, CONFIG_MALUS, DOC_MALUS = 0.25, 0.15, 0.15, 0.10
CONFIGS, DOCS = ("json", "yaml", "yml", "config", "xml"), ("markdown", "md", "text", "txt")
STRUCTURAL = ("class", "public", "void", "async", "interface")


def reranked(results: DataFrame, query: str, score: str = "rrf_score", prior: str = "id") -> DataFrame:
    """The results with rerank_score, in its order; ties stay in their former order."""
    low = query.lower()
    terms = [t for part in low.replace(".", " ").replace("_", " ").replace("(", " ").replace(")", " ").split(" ") if len(t := part.strip()) > 2]
    symbol = F.lower(F.coalesce("symbol_name", F.lit("")))
    hit = F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(symbol, t)) if terms else F.lit(False)
    whole = F.lit(bool(terms)) & F.contains(F.lit(low), symbol)
    bonus = F.when(symbol != "", F.when(hit, SYMBOL_BOOST).otherwise(0.0) + F.when(whole, WHOLE_BOOST).otherwise(0.0)).otherwise(0.0)
    malus = F.when(F.col("language").isin(*CONFIGS), CONFIG_MALUS).when(F.col("language").isin(*DOCS), DOC_MALUS).otherwise(0.0) if any(s in low for s in STRUCTURAL) else F.lit(0.0)
    return results.withColumn("rerank_score", F.col(score) + bonus - malus).orderBy(F.col("rerank_score").desc(), F.col(score).desc(), prior)
