"""Which projects a query may see."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.predicates import like_pattern


def normal(value: str | None) -> str | None:
    """Blank is none."""
    return (value or "").strip() or None


def clamp(value: int | None, default: int, low: int, high: int) -> int:
    return min(max(default if value is None else value, low), high)


def members(tables) -> DataFrame:
    """project id, name and root_path with each workspace's name, null for none."""
    links = tables.workspace_projects.join(tables.workspaces.select(F.col("id").alias("workspace_id"), F.col("name").alias("workspace")), "workspace_id").select(F.col("project_id").alias("id"), "workspace")
    return tables.projects.join(links, "id", "left")


def scope_ids(tables, scope: str | None) -> DataFrame | None:
    """Ids of projects of that name, in the workspace of that name, or 'workspace/project'; None: all."""
    if (scope := normal(scope)) is None:
        return None
    fits = (F.col("name") == scope) | (F.col("workspace") == scope) | (F.concat("workspace", F.lit("/"), "name") == scope)
    return members(tables).filter(fits).select(F.col("id").alias("project_id")).distinct()


#: So many project ids at most go into a plan as values; more are joined.
VALUES = 1000


class Scope:
    """Restricts tables to project ids (project_id). Few ids become a filter that reaches the scan; they are looked up
    once, whatever number of tables are restricted. None: no restriction."""

    def __init__(self, ids: DataFrame | None):
        self.ids = None if ids is None else ids.select("project_id").distinct()
        found = [] if ids is None else self.ids.limit(VALUES + 1).collect()
        self.values = None if ids is None or len(found) > VALUES else [r["project_id"] for r in found]

    def __call__(self, df: DataFrame) -> DataFrame:
        if self.ids is None:
            return df
        if self.values is None:
            return df.join(self.ids, "project_id", "left_semi")
        return df.filter(F.col("project_id").isin(*self.values) if self.values else F.lit(False))


def in_scope(df: DataFrame, ids: DataFrame | None) -> DataFrame:
    return Scope(ids)(df)


def filtered_projects(tables, workspace: str | None = None, project: str | None = None, by_path: bool = True) -> DataFrame:
    """id, name, root_path of the projects that a report is about."""
    workspace, project = normal(workspace), normal(project)
    rows = members(tables)
    if workspace is not None:
        rows = rows.filter(F.col("workspace") == workspace)
    if project is not None:
        fits = (F.col("name") == project) | (F.concat("workspace", F.lit("/"), "name") == project)
        rows = rows.filter(fits | F.col("root_path").ilike(f"%{like_pattern('%' + project)[1:]}%") if by_path else fits)
    return rows.select("id", "name", "root_path").distinct()


def in_list(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows whose column is among the values; all rows for an empty list."""
    return df.filter(F.col(column).isin(*values)) if values else df
