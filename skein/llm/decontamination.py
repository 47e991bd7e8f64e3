"""Benchmark decontamination: a prefix-filtered set join, in DataFrame operations only.

A window is a run of item words. Its words are ordered by how rare they are in the corpus; an occurrence of the
window must hold its rarest word at that word's offset, so this prefix token is enough to find all candidates.
Candidates pass the length and positional bounds and are then compared word by word. Windows of up to BROADCAST_BYTES go
to every executor. For more, only words that pass a bitmap of the prefix tokens are shuffled, each with the words around
it, and only such words of the vocabulary are counted.

Cases: null or wordless texts give n_words 0 and no hit; texts of any length are read whole; null, empty and repeated items
are allowed (an item of no words has no window); of equally rare words the first is the prefix; equal rows each give their
row; a null doc_id is kept as one; an empty benchmark or corpus gives zero hits or no rows; further columns on either side
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import key_filter, stored, table, words

WINDOW = 10
#: Window tables up to this many bytes go to every executor; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20


def benchmark_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """window_words, window_len and the sorted item ids of each distinct window."""
    items = benchmark.select(F.col("item_id"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    n = F.size("w")
    starts = F.when(n >= width, F.sequence(F.lit(1), n - width + 1)).otherwise(F.array(F.lit(1)))
    rows = items.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at"), F.lit(width)).alias("window_words"))
    return rows.groupBy("window_words").agg(F.collect_set(F.col("item_id").cast("string")).alias("items")).withColumn("window_len", F.size("window_words"))


def sieved(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """rows (word, ...) without most of those whose word is not in the vocabulary (word)."""
    keys = vocabulary.select(F.xxhash64("word").alias("word_key"))
    return key_filter(keys, "word_key", keys.count())(rows.withColumn("word_key", F.xxhash64("word")), "word_key").drop("word_key")


def word_counts(docs: DataFrame, vocabulary: DataFrame, small: bool) -> DataFrame:
    """How often each vocabulary word stands in all documents (0 if nowhere)."""
    found = docs.select(F.explode(words(F.col("text"))).alias("word"))
    found = found.join(F.broadcast(vocabulary), "word") if small else sieved(found, vocabulary)
    counts = found.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return vocabulary.join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def prefix_tokens(windows: DataFrame, counts: DataFrame, small: bool) -> DataFrame:
    """Each window with its rarest word (ties: the first) and that word's offset. small: counts fit into a broadcast."""
    placed = windows.select("window_words", "window_len", "items", F.posexplode("window_words").alias("offset", "word"))
    ranked = placed.join(F.broadcast(counts) if small else counts, "word").groupBy("window_words").agg(F.min_by(F.struct("word", "offset", "window_len", "items"), F.struct("n", "offset")).alias("p"))
    return ranked.select("window_words", "p.*")


def covered(intervals: Column) -> Column:
    """How many positions the (start, len) pairs of an array cover."""
    step = lambda acc, x: F.struct(
        F.greatest(acc["end"], x["start"] + x["len"]).alias("end"),
        (acc["total"] + F.greatest(F.lit(0), x["start"] + x["len"] - F.greatest(acc["end"], x["start"]))).alias("total"),
    )
    return F.aggregate(F.array_sort(intervals), F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")), step, lambda acc: acc["total"])


def hashed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, h1, h2 (a 128-bit key of the text), n_words, n_hit, items (sorted strings) per document row."""
    docs = hashed(docs.select("doc_id", "text"))
    windows = stored(benchmark_windows(benchmark, width), "windows")
    # 64 bytes a word is over what a word, its offset and its share of the row take
    size = windows.agg(F.coalesce(F.sum(F.length(F.concat_ws(" ", "window_words")) + 64 * F.col("window_len")), F.lit(0)).alias("b")).head()["b"]
    small = size <= broadcast_bytes
    vocabulary = windows.select(F.explode("window_words").alias("word")).distinct()
    vocabulary = vocabulary if small else stored(vocabulary, "vocabulary")
    tokens = prefix_tokens(windows, word_counts(docs, vocabulary, small), small).withColumnRenamed("word", "token")
    tokens = stored(tokens, "prefix-tokens").select("window_words", "token", "offset", "window_len", "items")
    return with_windows_everywhere(docs, tokens) if small else with_windows_shuffled(docs, tokens, width)


def matches(n: Column, base: Column) -> Column:
    """Whether the candidate c, by its prefix token at pos, stands in w, whose first word is the one at base of n words."""
    start = F.col("pos") - F.col("c.offset")
    fits = (start >= 0) & (start + F.col("c.window_len") <= n)
    return F.when(fits, F.slice("w", start - base + 1, F.col("c.window_len")) == F.col("c.window_words")).otherwise(F.lit(False))


def with_windows_everywhere(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    # an empty word after the last one carries each document's own row through the join
    sentinel = tokens.sparkSession.sql("SELECT cast(NULL AS array<string>) window_words, '' token, -1 offset, 0 window_len, cast(NULL AS array<string>) items")
    tokens = tokens.unionByName(sentinel).groupBy("token").agg(F.collect_list(F.struct("window_words", "offset", "window_len", "items")).alias("cands"))
    spread = docs.select("doc_id", "h1", "h2", F.concat(words(F.col("text")), F.array(F.lit(""))).alias("w"))
    spread = spread.select("doc_id", "h1", "h2", "w", F.posexplode("w").alias("pos", "word"))
    joined = spread.join(F.broadcast(tokens), spread["word"] == tokens["token"])
    marked = joined.select("doc_id", "h1", "h2", "pos", "w", (F.size("w") - 1).alias("n_words"), F.explode("cands").alias("c"))
    own = F.col("c.offset") < 0
    place = F.struct((F.col("pos") - F.col("c.offset")).alias("start"), F.col("c.window_len").alias("len"))
    per = marked.filter(own | matches(F.col("n_words"), F.lit(0))).groupBy("doc_id", "h1", "h2").agg(
        F.max(F.when(own, F.col("n_words"))).alias("n_words"),
        F.sum(own.cast("int")).alias("rows"),
        F.collect_set(F.when(~own, place)).alias("found"),
        F.collect_set(F.when(~own, F.col("c.items"))).alias("items"),
    )
    result = per.select(
        "doc_id", "h1", "h2", F.col("n_words").cast("long").alias("n_words"), covered(F.col("found")).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"), F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("copy"),
    )
    return result.drop("copy")


def with_windows_shuffled(docs: DataFrame, tokens: DataFrame, width: int) -> DataFrame:
    spread = docs.select("h1", "h2", words(F.col("text")).alias("w")).select("h1", "h2", "w", F.posexplode("w").alias("pos", "word"))
    # the words around each place go along, not the whole document
    near = sieved(spread, tokens.select(F.col("token").alias("word")).distinct()).select(
        "h1", "h2", "pos", "word", F.size("w").alias("n_words"), F.slice("w", F.greatest(F.lit(1), F.col("pos") + 2 - width), F.lit(2 * width - 1)).alias("w"))
    joined = near.join(tokens.select("token", F.struct("window_words", "offset", "window_len", "items").alias("c")), F.col("word") == F.col("token"))
    hits = joined.filter(matches(F.col("n_words"), F.greatest(F.lit(0), F.col("pos") + 1 - width)))
    place = F.struct((F.col("pos") - F.col("c.offset")).alias("start"), F.col("c.window_len").alias("len"))
    per = hits.groupBy("h1", "h2").agg(F.collect_set(place).alias("found"), F.collect_set("c.items").alias("items"))
    per = stored(per.select("h1", "h2", covered(F.col("found")).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items")), "hits")
    rows = docs.select("doc_id", "h1", "h2", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    return rows.join(per, ["h1", "h2"], "left").select("doc_id", "h1", "h2", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


#: DuckDB, by hashing every window of every text; only for tables of small or middling size.
OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS win, len(w[s:s + 9]) AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT rid, s, k, array_to_string(w[s:s + k - 1], ' ') AS win FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT dw.rid, dw.s, dw.k, bw.item_id FROM dw JOIN bw USING (win, k)),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + k)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS i FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
