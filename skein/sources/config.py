"""Configuration of workspaces, projects and pattern lists, as JSON."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHAPE = "activeWorkspace string, workspaces array<struct<name: string, projects: array<struct<name: string, path: string>>>>"


def read_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHAPE).option("multiLine", True).json(path)


def flattened(config: DataFrame) -> DataFrame:
    """workspace, project, path, active: one row a project; of names equal but for case the last one stays."""
    rows = config.select(F.col("activeWorkspace").alias("a"), F.posexplode("workspaces").alias("i", "w")).select("a", "i", F.col("w.name").alias("workspace"), F.posexplode_outer("w.projects").alias("j", "p"))
    named = rows.select("a", "i", "j", "workspace", F.col("p.name").alias("project"), F.col("p.path").alias("path"))
    last = dedup_keep_last(dedup_keep_last(named, ["workspace", "project"], ["i", "j"]), ["workspace", "project"], ["i", "j"])
    return last.select("workspace", "project", "path", (F.lower("workspace") == F.lower(F.coalesce("a", F.lit("")))).alias("active"))


def dedup_keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows whose keys are equal but for case the last one."""
    last = W.partitionBy(*(F.lower(F.coalesce(k, F.lit(""))) for k in keys)).orderBy(*(F.col(o).desc() for o in order))
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def save_json(value: object, path: str) -> None:
    """A driver-side file, put in place in one step."""
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as out:
        json.dump(value, out, ensure_ascii=False, indent=2)
    os.replace(out.name, path)


def load_json(path: str, default: object) -> object:
    """The file's value; the default if there is none or it isn't JSON."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return default


def edit_config(config: dict, action: str, workspace: str, project: str | None = None, path: str | None = None) -> dict:
    """A new configuration after adding, removing or activating a workspace, or adding or removing its project."""
    spaces = {w["name"].lower(): {**w, "projects": list(w.get("projects", []))} for w in config.get("workspaces", [])}
    active, key = config.get("activeWorkspace"), workspace.lower()
    if action == "add":
        own = spaces.setdefault(key, {"name": workspace, "projects": []})
        if project is not None:
            own["projects"] = [p for p in own["projects"] if p["name"].lower() != project.lower()] + [{"name": project, "path": path}]
    elif action == "remove" and project is not None and key in spaces:
        spaces[key]["projects"] = [p for p in spaces[key]["projects"] if p["name"].lower() != project.lower()]
    elif action == "remove":
        spaces.pop(key, None)
    elif action == "use" and key in spaces:
        active = spaces[key]["name"]
    names = [w["name"] for w in spaces.values()]
    active = active if active in names else (sorted(names)[0] if names else None)
    return {**config, "workspaces": sorted(spaces.values(), key=lambda w: w["name"].lower()), "activeWorkspace": active}
