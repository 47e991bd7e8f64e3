"""The engine: one object with a method for each question."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import compress_evidence, truncated
from skein.operators import graph, reports, search
from skein.operators.compress import compressed
from skein.operators.predicates import indexable, knowledge_candidate, rule_candidate, semantic_candidate
from skein.operators.scope import clamp
from skein.sources.embedding import QueryCache, hashed_vector


class Engine:
    """tables: the logical tables as attributes (see skein.fixtures.Tables); embed: a query's vector; code_language and
    fact_language: whose stop words and endings are left out of full text (None: plain words)."""

    def __init__(self, tables, embed: Callable[[str], Sequence[float]] = hashed_vector, code_language: str | None = "english", fact_language: str | None = "portuguese"):
        self.tables, self.embed, self.code_language, self.fact_language = tables, QueryCache(embed), code_language, fact_language

    def search(self, query: str, k: int | None = None) -> DataFrame:
        return search.search(self.tables, self.embed(query), query, clamp(k, 10, 1, 50), self.code_language)

    def search_code(self, query: str, k: int | None = None, project: str | None = None, max_content_chars: int | None = None) -> DataFrame:
        found = search.search_code(self.tables, self.embed(query), query, clamp(k, 10, 1, 50), project, self.code_language)
        best = search.reranked(found, query)
        return best.withColumn("content", truncated(compressed("content", "symbol_name"), clamp(max_content_chars, 1200, 200, 10_000)))

    def search_business_rules(self, query: str, k: int | None = None, project: str | None = None) -> DataFrame:
        return search.search_rules(self.tables, self.embed(query), query, clamp(k, 10, 1, 50), project, self.fact_language).withColumn("evidence", compress_evidence(F.col("evidence")))

    def search_knowledge(self, query: str, k: int | None = None, project: str | None = None) -> DataFrame:
        return search.search_knowledge(self.tables, self.embed(query), query, clamp(k, 10, 1, 50), project, self.fact_language).withColumn("evidence", compress_evidence(F.col("evidence")))

    def find_related_files(self, query: str, k: int | None = None, project: str | None = None, exclude: str | None = None) -> DataFrame:
        return search.related_files(self.tables, self.embed(query), clamp(k, 10, 1, 50), project, exclude)

    def file_content(self, path: str, project: str | None = None, max_chars: int | None = None) -> DataFrame:
        return search.file_chunks(self.tables, path, project, clamp(max_chars, 20_000, 200, 200_000))

    def get_symbol_callers(self, symbol: str, project: str | None = None) -> DataFrame:
        return graph.callers(self.tables, symbol, project)

    def get_symbol_callees(self, symbol: str, project: str | None = None) -> DataFrame:
        return graph.callees(self.tables, symbol, project)

    def get_class_hierarchy(self, name: str, project: str | None = None) -> DataFrame:
        return graph.hierarchy(self.tables, name, project)

    def overview(self, workspace: str | None = None, project: str | None = None) -> DataFrame:
        return reports.overview(self.tables, workspace, project)

    def workspaces(self, workspace: str | None = None, project: str | None = None) -> DataFrame:
        return reports.workspace_summary(self.tables, workspace, project)

    def projects(self, workspace: str | None = None, project: str | None = None, limit: int | None = None) -> DataFrame:
        return reports.project_summary(self.tables, workspace, project, clamp(limit, 100, 1, 500))

    def chunks(self, workspace: str | None = None, project: str | None = None, search: str | None = None, limit: int | None = None) -> DataFrame:
        return reports.chunk_listing(self.tables, workspace, project, search, clamp(limit, 100, 1, 500))

    def rules(self, workspace: str | None = None, project: str | None = None, search: str | None = None, limit: int | None = None) -> DataFrame:
        return reports.rules_listing(self.tables, workspace, project, search, clamp(limit, 100, 1, 500))

    def knowledge(self, workspace: str | None = None, project: str | None = None, search: str | None = None, limit: int | None = None) -> DataFrame:
        return reports.knowledge_listing(self.tables, workspace, project, search, clamp(limit, 100, 1, 500))

    def health(self, workspace: str | None = None, project: str | None = None) -> DataFrame:
        return reports.health(self.tables, workspace, project)

    def _candidate(self, stage: str, semantic: bool) -> Column:
        if stage == "rules":
            return semantic_candidate() if semantic else rule_candidate()
        return F.lit(True) if semantic else knowledge_candidate()

    def extraction_stats(self, workspace: str, projects: Sequence[str] = (), stage: str = "rules", semantic: bool = False) -> DataFrame:
        return reports.extraction_stats(self.tables, indexable(self.tables.chunks_text, self.tables.projects), self._candidate(stage, semantic), workspace, projects, stage)

    def extraction_queue(self, workspace: str, projects: Sequence[str] = (), stage: str = "rules", semantic: bool = False, refresh: bool = False, limit: int | None = None) -> DataFrame:
        return reports.extraction_queue(self.tables, indexable(self.tables.chunks_text, self.tables.projects), self._candidate(stage, semantic), workspace, projects, stage, refresh, limit)
