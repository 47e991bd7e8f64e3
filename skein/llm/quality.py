"""Quality rules with adaptive thresholds, in DataFrame operations only.

Each document gets integer rates, of any size. For every (lang, source) group and rate a mergeable quantile sketch is
built by partial sums: counts of log-linear levels, a level being a rate's first BITS binary digits. So a quantile of the
sketch is at most the exact one and less than a 2 ** (1 - BITS) part of it below (exact under 2 ** BITS), a sketch has at
most 64 * 2 ** (BITS - 1) levels, and sketches merge by adding counts, in any order, with the same error. A group of
fewer than LEAST documents takes the merged sketch of its language, and if that has fewer too, that of all; its tail it takes
of its language from fewer than TAIL_LEAST on. All thresholds are quantiles of a group's own sketch: the median and a multiple
of the quartiles' distance for what texts consist of, the median and a multiple of the way to the 99th percentile for
repetition, which most documents have none of. A join by group applies them to every document. Only sketches meet in one
place, so a hot group costs no more.

Cases: a null text has no words and fails the base rule; texts of any length are read whole; a null lang or source is a
group of its own; a rate equal to its threshold passes; a group without a document that passes the base rule has no sketch
and needs none; equal rows each give their row, and each counts; an empty table gives no rows; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import stored, table, windows

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
MIN_WORDS = 20
BITS = 7
LEAST = 30
TAIL_LEAST = 1000
#: How many times the distance of the quartiles (one unit of the rate at least) a rate may be away from the median.
SPREAD = {"symbol_pm": 8, "word_len10": 8}
#: How many times the distance from the median to the 99th percentile (one unit at least) a rate may be over the median.
TAIL = {"dup_line_pm": 3, "repeat_pm": 3}
RATES = [*SPREAD, *TAIL]
QUANTILES = (25, 50, 75, 99)


def repeated_words(hashes: Column, ordered: str) -> Column:
    """Words in windows whose hash comes twice or more; ordered: the name of the sorted (hash, place) column."""
    place = F.sort_array(F.transform(
        F.filter(ordered, lambda p, i: (p["h"] == F.get(F.col(ordered), i - 1)["h"]) | (p["h"] == F.get(F.col(ordered), i + 1)["h"])), lambda p: p["i"]))
    step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(REPEAT_WINDOW), i - a["last"])).alias("n"))
    return F.aggregate(place, F.struct(F.lit(-REPEAT_WINDOW).alias("last"), F.lit(0).alias("n")), step, lambda a: a["n"])


def base_features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = docs.select(
        "doc_id", "lang", "source", F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"), F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("w"),
    )
    b = a.select("doc_id", "lang", "source", "word_chars", "n_symbols", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.size("w").cast("long").alias("n_words"), F.when(F.size("w") > REPEAT_WINDOW, windows("w", REPEAT_WINDOW)).alias("h"))
    some = F.size(F.array_distinct("h")) < F.size("h")
    c = b.select("doc_id", "lang", "source", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_words",
                 F.when(some, F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("o"))
    repeated = F.when(F.col("o").isNull(), F.lit(0)).otherwise(repeated_words(F.col("h"), "o"))
    return c.select("doc_id", "lang", "source", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_words", repeated.cast("long").alias("n_repeat_words"))


def rates(features: DataFrame) -> DataFrame:
    """The integer rates and base_failed."""
    rate = lambda x, of: F.expr(f"{x} div greatest({of}, 1)")
    return features.select(
        "*", rate("1000 * n_symbols", "word_chars").alias("symbol_pm"), rate("1000 * n_dup_lines", "n_lines").alias("dup_line_pm"), rate("1000 * n_repeat_words", "n_words").alias("repeat_pm"),
        rate("10 * word_chars", "n_words").alias("word_len10"), F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words").alias("base_failed"),
    )


def level(rate: Column) -> Column:
    """The rate with zeros after its first BITS binary digits."""
    shift = F.greatest(F.length(F.bin(rate)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", rate, shift), shift)


def sketches(rated: DataFrame, names: list[str]) -> DataFrame:
    """lang, source, rate, level, n of the documents that pass the base rule."""
    spread = F.explode(F.array(*(F.struct(F.lit(k).alias("rate"), level(F.col(k)).alias("level")) for k in names))).alias("x")
    return rated.filter(~F.col("base_failed")).select("lang", "source", spread).groupBy("lang", "source", "x.rate", "x.level").agg(F.count(F.lit(1)).alias("n"))


def merged(one: DataFrame, other: DataFrame) -> DataFrame:
    """The sketches of both."""
    return one.unionByName(other).groupBy("lang", "source", "rate", "level").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, *by: str) -> DataFrame:
    """by, rate, total and q25, q50, q75, q99 of the sketches merged over all else."""
    levels = sketch.groupBy(*by, "rate", "level").agg(F.sum("n").alias("n"))
    per = levels.groupBy(*by, "rate").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("level", "n"))).alias("h"))
    begin = F.struct(F.lit(0).cast("long").alias("n"), *(F.lit(None).cast("long").alias(f"q{p}") for p in QUANTILES))
    step = lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), *(F.coalesce(a[f"q{p}"], F.when(100 * (a["n"] + x["n"]) >= p * F.col("total"), x["level"])).alias(f"q{p}") for p in QUANTILES))
    return per.select(*by, "rate", "total", F.aggregate("h", begin, step).alias("q")).select(*by, "rate", "total", *(f"q.q{p}" for p in QUANTILES))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per lang and source; hi_<rate> and lo_word_len10."""
    names = ["lang", "total", *(f"q{p}" for p in QUANTILES)]
    own, wide, all_ = (quantiles(sketch, *by).withColumnsRenamed({c: f"{c}_{len(by)}" for c in names}) for by in (("lang", "source"), ("lang",), ()))
    pooled = own.withColumnRenamed("rate", "r2").join(wide.withColumnRenamed("rate", "r1"), F.col("lang_2").eqNullSafe(F.col("lang_1")) & (F.col("r2") == F.col("r1"))).join(all_, F.col("r2") == F.col("rate"))
    pick = lambda c, least: F.when(F.col("total_2") >= least, F.col(f"{c}_2")).when(F.col("total_1") >= least, F.col(f"{c}_1")).otherwise(F.col(f"{c}_0")).alias(c)
    seen = pooled.select(F.col("lang_2").alias("lang"), "source", "rate", *(pick(f"q{p}", TAIL_LEAST if p == 99 else LEAST) for p in QUANTILES))
    times = lambda factors, spread: F.coalesce(*(F.when(F.col("rate") == k, v) for k, v in factors.items())) * F.greatest(spread, F.lit(1))
    slack = F.coalesce(times(SPREAD, F.col("q75") - F.col("q25")), times(TAIL, F.col("q99") - F.col("q50")))
    fences = seen.select("lang", "source", "rate", (F.col("q50") + slack).alias("hi"), (F.col("q50") - slack).alias("lo"))
    return fences.groupBy("lang", "source").agg(*(F.max(F.when(F.col("rate") == k, F.col("hi"))).alias(f"hi_{k}") for k in RATES), F.max(F.when(F.col("rate") == "word_len10", F.col("lo"))).alias("lo_word_len10"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """The features, rates, base_failed and kept of each document row."""
    rated = stored(rates(base_features(docs.select("doc_id", "text", "lang", "source"))), "rates")
    fences = stored(thresholds(sketches(rated, RATES)), "thresholds")
    fences = fences.withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    joined = rated.join(fences, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    odd = F.col("word_len10") < F.col("lo_word_len10")
    for k in RATES:
        odd = odd | (F.col(k) > F.col(f"hi_{k}"))
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False))).drop("f_lang", "f_source")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP8_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS x FROM documents),
w AS (SELECT rid, doc_id, lang, source, list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '') AS w, length(x) - length(translate(x, '#*$%&|<>', '')) AS n_symbols,
  list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS l FROM t),
win AS (SELECT rid, s, array_to_string(w[s:s + 7], ' ') AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS s FROM w WHERE len(w) >= 8)),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(s, s + 8)) AS p FROM (SELECT rid, s, count(*) OVER (PARTITION BY rid, win) AS c FROM win) WHERE c > 1) GROUP BY rid),
f AS (SELECT rid, doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0)::BIGINT AS word_chars, n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (rid)),
r AS (SELECT *, 1000 * n_symbols // greatest(word_chars, 1) AS symbol_pm, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_pm, 1000 * n_repeat_words // greatest(n_words, 1) AS repeat_pm, 10 * word_chars // greatest(n_words, 1) AS word_len10,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
v AS (UNPIVOT (SELECT rid, coalesce(lang, chr(1)) AS lang, coalesce(source, chr(1)) AS source, symbol_pm::BIGINT AS symbol_pm, dup_line_pm::BIGINT AS dup_line_pm, repeat_pm::BIGINT AS repeat_pm, word_len10::BIGINT AS word_len10 FROM r WHERE NOT base_failed) ON symbol_pm, dup_line_pm, repeat_pm, word_len10 INTO NAME rate VALUE x),
m AS (SELECT lang, source, rate, (x >> greatest(length(bin(x)) - 7, 0)) << greatest(length(bin(x)) - 7, 0) AS lvl FROM v),
q2 AS (SELECT lang, source, rate, count(*) AS n, quantile_disc(lvl, [0.25, 0.5, 0.75, 0.99]) AS q FROM m GROUP BY ALL),
q1 AS (SELECT lang, rate, count(*) AS n, quantile_disc(lvl, [0.25, 0.5, 0.75, 0.99]) AS q FROM m GROUP BY ALL),
q0 AS (SELECT rate, quantile_disc(lvl, [0.25, 0.5, 0.75, 0.99]) AS q FROM m GROUP BY ALL),
p0 AS (SELECT q2.lang, q2.source, q2.rate, CASE WHEN q2.n >= 30 THEN q2.q WHEN q1.n >= 30 THEN q1.q ELSE q0.q END AS q, CASE WHEN q2.n >= 1000 THEN q2.q WHEN q1.n >= 1000 THEN q1.q ELSE q0.q END AS t FROM q2 JOIN q1 USING (lang, rate) JOIN q0 USING (rate)),
q AS (SELECT lang, source, rate, q[2] AS q50, CASE WHEN rate IN ('symbol_pm', 'word_len10') THEN 8 * greatest(q[3] - q[1], 1) ELSE 3 * greatest(t[4] - q[2], 1) END AS slack FROM p0),
b AS (SELECT lang, source, rate, q50 + slack AS hi, q50 - slack AS lo FROM q),
p AS (SELECT lang, source, max(hi) FILTER (rate = 'symbol_pm') AS h1, max(hi) FILTER (rate = 'dup_line_pm') AS h2, max(hi) FILTER (rate = 'repeat_pm') AS h3, max(hi) FILTER (rate = 'word_len10') AS h4, max(lo) FILTER (rate = 'word_len10') AS l4 FROM b GROUP BY ALL)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(symbol_pm > h1 OR dup_line_pm > h2 OR repeat_pm > h3 OR word_len10 > h4 OR word_len10 < l4, false) AS kept
FROM r LEFT JOIN p ON coalesce(r.lang, chr(1)) = p.lang AND coalesce(r.source, chr(1)) = p.source
"""
