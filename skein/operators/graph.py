"""The symbol graph: one-hop questions, name joins, and closure as an extension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.predicates import few_lengths, like_pattern
from skein.operators.scope import normal


def _edges(tables) -> DataFrame:
    names = tables.projects.select(F.col("id").alias("project_id"), F.col("name").alias("project"))
    own = tables.symbols.join(names, "project_id")
    side = lambda s: own.select(F.col("id").alias(f"{s}_id"), F.col("project").alias(f"{s}_project"), F.col("full_name").alias(f"{s}_name"), F.col("file_path").alias(f"{s}_file"))
    return tables.relations.join(side("source"), "source_id").join(side("target"), "target_id")


def _one_hop(tables, symbol: str, project: str | None, at: str, other: str) -> DataFrame:
    rows = _edges(tables).filter(F.col(f"{at}_name").ilike("%" + like_pattern("%" + symbol)[1:]))
    if (project := normal(project)) is not None:
        rows = rows.filter(F.col(f"{at}_project") == project)
    return rows.select(F.col(f"{other}_project").alias("project"), F.col(f"{other}_name").alias("symbol"), F.col(f"{other}_file").alias("file_path"), "relation")


def callers(tables, symbol: str, project: str | None = None) -> DataFrame:
    """What points at symbols ending in the name; the project is the target's."""
    return _one_hop(tables, symbol, project, "target", "source").orderBy("project", "symbol", "relation")


def callees(tables, symbol: str, project: str | None = None) -> DataFrame:
    return _one_hop(tables, symbol, project, "source", "target").orderBy("project", "symbol", "relation")


def hierarchy(tables, name: str, project: str | None = None) -> DataFrame:
    rows = _one_hop(tables, name, project, "source", "target").filter(F.col("relation").isin("inherits", "implements"))
    return rows.select("project", F.col("symbol").alias("parent"), "relation").orderBy("parent", "project", "relation")


def lookup_ids(rows: DataFrame, names: DataFrame, column: str, missing: int | None = None) -> DataFrame:
    """The least id of each asked name."""
    found = rows.groupBy(F.col(column).alias("name")).agg(F.min("id").alias("id"))
    out = names.join(found, "name", "left")
    return out if missing is None else out.withColumn("id", F.coalesce("id", F.lit(missing)))


#: Of so many names at most what is found is broadcast to the rows that want it: of all, if there are no more, else of the
#: most frequent ones of HOT rows each at least.
NAMES, HOT = 1000, 10_000


def suffix_join(wanted: DataFrame, symbols: DataFrame, exact_segment: bool = False, told: Sequence[str] = ()) -> DataFrame:
    """wanted (name) with the first symbol (by seq) whose full name ends in it; or, exact, has it as last part. told: more
    columns of that symbol.

    Each full name is joined by its own endings of the lengths asked for (of all, above LENGTHS), so no pair is tried in
    vain. An ending that many symbols share has its first one found ahead of the shuffle, and rows of a name that many ask
    for stay where they are. Spark takes tables that compress well for far too small, so names are counted for that."""
    own = ["full_name", *told]
    if exact_segment:
        ends = symbols.select(F.substring_index("full_name", ".", -1).alias("name"), *own, "seq")
    else:
        lengths = few_lengths(wanted, "name")
        parts = F.transform(F.sequence(F.lit(0), F.length("full_name")), lambda n: F.right("full_name", n)) if lengths is None else F.array(*(F.when(F.length("full_name") >= n, F.right("full_name", F.lit(n))) for n in lengths)) if lengths else F.array().cast("array<string>")
        ends = symbols.select(F.explode(F.array_compact(parts)).alias("name"), *own, "seq")
    often = wanted.filter("name IS NOT NULL").groupBy("name").count().orderBy(F.desc("count"), "name").limit(NAMES + 1).collect()
    few = len(often) <= NAMES
    hot = [r["name"] for r in often[:NAMES] if few or r["count"] >= HOT]
    first = lambda rows: rows.groupBy("name").agg(F.min_by(F.struct(*own), "seq").alias("best")).select("name", "best.*")
    if not (few or hot):
        return wanted.join(first(ends).hint("merge"), "name", "left")
    apart = F.col("name").isNull() | (F.col("name").isin(*hot) if hot else F.lit(False))
    # found beforehand: a broadcast that waits for a long stage runs out of time
    known = wanted.sparkSession.createDataFrame(first(ends.filter(apart)).toArrow())
    some = wanted.filter(apart).join(F.broadcast(known), "name", "left")
    return some if few else some.unionByName(wanted.filter(~apart).join(first(ends.filter(~apart)).hint("merge"), "name", "left"))


def closure(edges: DataFrame, rounds: int = 32) -> DataFrame:
    """All (source_id, target_id) over one or more edges, by doubling; an extension. rounds bounds the depth (2 ** rounds)."""
    paths = edges.select("source_id", "target_id").distinct()
    count = paths.count()
    for _ in range(rounds):
        longer = paths.join(paths.select(F.col("source_id").alias("target_id"), F.col("target_id").alias("end")), "target_id").select("source_id", F.col("end").alias("target_id"))
        paths = paths.unionByName(longer).distinct().checkpoint()
        now = paths.count()
        if now == count:
            break
        count = now
    return paths
