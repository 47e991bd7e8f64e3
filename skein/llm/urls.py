"""URL filters by a path-template tree per host, in DataFrame operations only.

Level by level below each host, a path segment stays literal if it holds a fair share of its node's urls, else it
becomes a wildcard. What the explicit rules say of a url is its label. Templates of one host whose blocked shares
don't differ by a two-proportion z test are merged; a template is rejected if its smoothed share of blocked labels
(SMOOTHING more labels count as allowed, so that a few or no labels reject nothing) reaches a threshold.

Cases: a null url or one without "://" has an empty host and path and is judged like the others of that host;
paths of any depth are split whole; equal rows each give their row; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.common import UPPER, stored, table

#: Fixed values: (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Levels of one plan; for deeper paths the rows are written in between.
DEPTH = 4
#: A literal segment holds one url in SHARE of its node's, and LEAST urls.
SHARE, LEAST = 16, 3
Z = 1.96
MIN_LABELS = 5
SMOOTHING = 4.0
REJECT = 0.5


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, UPPER.lower()), part(2)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as host and path in one string, and its verdict; null if none fits."""
    name = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def levels(rows: DataFrame, begin: int, end: int) -> DataFrame:
    """rows (host, segs, template) with the segments from begin to end added to the templates."""
    for level in range(begin, end):
        seg = F.get("segs", F.lit(level))
        rows = rows.withColumn("seg", seg)
        counts = rows.filter(F.col("seg").isNotNull()).groupBy("host", "template", "seg").agg(F.count(F.lit(1)).alias("n"))
        node = counts.groupBy("host", "template").agg(F.sum("n").alias("total"))
        kept = counts.join(node, ["host", "template"]).filter((F.col("n") >= LEAST) & (F.col("n") * SHARE >= F.col("total"))).select("host", "template", "seg", F.lit(True).alias("literal"))
        rows = rows.join(kept, ["host", "template", "seg"], "left")
        mark = F.when(F.col("seg").isNull(), F.col("template")).when(F.col("literal"), F.concat("template", F.lit("/"), "seg")).otherwise(F.concat("template", F.lit("/*")))
        rows = rows.withColumn("template", mark).drop("seg", "literal")
    return rows


def templates(parts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """parts (uid, host, path, verdict) with the path template of each url's leaf in its host's tree."""
    segs = F.split(F.regexp_replace("path", "^/", ""), "/")
    deepest = lambda rows, size: rows.agg(F.max(size)).head()[0] or 0
    rows = levels(parts.withColumn("segs", segs).withColumn("template", F.lit("")), 0, depth)
    ended, level = [], depth
    more = deepest(parts, F.size(segs)) > level
    while more:
        rows = stored(rows, "template-levels")
        ended.append(rows.filter(F.size("segs") <= level))
        deeper = rows.filter(F.size("segs") > level)
        held = deeper.join(deeper.groupBy("host", "template").agg(F.count(F.lit(1)).alias("held")), ["host", "template"])
        # below a node of fewer than LEAST urls all is wildcard
        ended.append(held.filter(F.col("held") < LEAST).withColumn("template", F.concat("template", F.repeat(F.lit("/*"), F.size("segs") - level))).drop("held"))
        deeper = held.filter(F.col("held") >= LEAST).drop("held")
        rows, level = levels(deeper, level, level + depth), level + depth
        more = deepest(deeper, F.size("segs")) > level
    for part in ended:
        rows = rows.unionByName(part)
    return rows.drop("segs")


def judged_templates(rows: DataFrame) -> DataFrame:
    """host, template, branch (the merged templates' first), rate (smoothed share of blocked labels), rejected."""
    per = rows.groupBy("host", "template").agg(F.count("verdict").alias("labels"), F.count(F.when(F.col("verdict") == "block", 1)).alias("blocked"))
    share = F.when(F.col("labels") >= MIN_LABELS, F.col("blocked") / F.col("labels"))
    order = W.partitionBy("host", F.col("share").isNull()).orderBy("share", "template")
    chained = per.withColumn("share", share).withColumn("p0", F.lag("share").over(order)).withColumn("n0", F.lag("labels").over(order))
    pooled = (F.col("share") * F.col("labels") + F.col("p0") * F.col("n0")) / (F.col("labels") + F.col("n0"))
    error = F.sqrt(F.greatest(F.lit(0.0), pooled * (1 - pooled) * (1 / F.col("labels") + 1 / F.col("n0"))))
    apart = F.coalesce(F.col("share") - F.col("p0") > Z * error, F.lit(True))
    grouped = chained.withColumn("branch", F.sum(apart.cast("int")).over(order)).withColumn("open", F.col("share").isNull())
    total = grouped.groupBy("host", "open", "branch").agg(F.sum("labels").alias("all_labels"), F.sum("blocked").alias("all_blocked"))
    merged = grouped.join(total, ["host", "open", "branch"])
    rate = F.col("all_blocked") / (F.col("all_labels") + SMOOTHING)
    return merged.select("host", "template", "branch", "all_labels", rate.alias("rate"), (rate >= REJECT).alias("rejected"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, depth: int = DEPTH) -> DataFrame:
    """page_id, host, path, rule, verdict, template, blocked_share per page row."""
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = stored(templates(parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict")), depth), "templates")
    judged = judged_templates(rows).select("host", "template", "rate", "rejected")
    joined = rows.join(judged, ["host", "template"], "left")
    said = F.coalesce("verdict", F.when(F.col("rejected"), "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", "rule", said.alias("verdict"), "template", F.round("rate", 6).alias("blocked_share"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    """The same in DuckDB."""
    ordered = sorted(RULES, key=lambda r: (len(r[1] + r[2]), r), reverse=True)
    case = lambda k: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(said, h + p)[k]}'" for said, h, p in ordered) + " END"
    part = lambda k: f"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', {k}), '')"
    levels = ""
    for k in range(DEPTH):
        seg = f"parts[{k + 1}]" if k < DEPTH - 1 else f"CASE WHEN len(parts) >= {DEPTH} THEN array_to_string(parts[{DEPTH}:], '/') END"
        levels += f""",
s{k} AS (SELECT *, {seg} AS seg FROM t{k}), c{k} AS (SELECT host, template, seg, count(*) AS n FROM s{k} WHERE seg IS NOT NULL GROUP BY ALL),
l{k} AS (SELECT host, template, seg FROM (SELECT *, sum(n) OVER (PARTITION BY host, template) AS total FROM c{k}) WHERE n >= {LEAST} AND n * {SHARE} >= total),
t{k + 1} AS (SELECT s.page_id, s.host, s.path, s.rule, s.verdict, s.parts, CASE WHEN s.seg IS NULL THEN s.template WHEN l.seg IS NOT NULL THEN s.template || '/' || s.seg ELSE s.template || '/*' END AS template FROM s{k} s LEFT JOIN l{k} l ON l.host = s.host AND l.template = s.template AND l.seg = s.seg)"""
    return f"""WITH u AS (SELECT page_id, translate({part(1)}, '{UPPER}', '{UPPER.lower()}') AS host, {part(2)} AS path FROM pages),
t0 AS (SELECT page_id, host, path, {case(1)} AS rule, {case(0)} AS verdict, string_split(CASE WHEN starts_with(path, '/') THEN path[2:] ELSE path END, '/') AS parts, '' AS template FROM u){levels},
p AS (SELECT host, template, count(verdict) AS labels, count(*) FILTER (verdict = 'block') AS blocked FROM t{DEPTH} GROUP BY ALL),
q AS (SELECT *, CASE WHEN labels >= {MIN_LABELS} THEN blocked / labels END AS share FROM p),
x AS (SELECT *, lag(share) OVER w AS p0, lag(labels) OVER w AS n0 FROM q WINDOW w AS (PARTITION BY host, share IS NULL ORDER BY share, template)),
y AS (SELECT *, coalesce(share - p0 > {Z} * sqrt(greatest(0, (share * labels + p0 * n0) / (labels + n0) * (1 - (share * labels + p0 * n0) / (labels + n0)) * (1 / labels + 1 / n0))), true) AS apart FROM x),
z AS (SELECT *, sum(apart::INT) OVER (PARTITION BY host, share IS NULL ORDER BY share, template) AS branch FROM y),
j AS (SELECT host, template, sum(blocked) OVER b / (sum(labels) OVER b + {SMOOTHING}) >= {REJECT} AS rejected FROM z WINDOW b AS (PARTITION BY host, share IS NULL, branch))
SELECT page_id, t.host, path, rule, coalesce(verdict, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict FROM t{DEPTH} t LEFT JOIN j ON j.host = t.host AND j.template = t.template"""


OP3_SQL = _sql()
