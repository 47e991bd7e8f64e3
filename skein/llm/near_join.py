"""N-gram Jaccard join by a MinHash LSH forest.

A document's set is its hashed runs of five words. Equal sets are one class from the start. Each tree of the forest is
the prefix trie of all sets' signatures, strings of DEPTH minhashes of a byte each, in one 64-bit number, so that a prefix
is a shift. A set begins with its whole signature in every tree and shortens its matched prefix one minhash at a time, in
the tree where that adds fewest sets for the recall it gains, until sets at the similarity threshold would meet it with
the target recall. So prefixes stay long where many sets share them, and are short where few do. The tries are cut at the
shortest prefix that any set has chosen; below a cut are the candidates. Cuts that overlap much are joined to clusters.
Candidates are compared exactly (on 64-bit hashes), in blocks of bounded size, each pair once; out come link counts and a
spanning forest, never all pairs. Classes are the connected components.

Cases: fewer than five words are one run; wordless and null texts are in a class of their own and have no links; texts of
any length are one set each, of all their runs; equal rows are copies; ties go to the least doc_id; a null doc_id is kept;
an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.anchors import MIX, mixed
from skein.llm.common import NEAR_SIMILARITY, NEAR_WORDS, bounded_batches, key_filter, stored, table, trimmed, windows, words
from skein.llm.components import components

#: Trees, minhashes of a signature (a byte each), and the shortest prefix.
TREES, DEPTH, SHORTEST = 20, 8, 3
#: Of sets at exactly the similarity; more of those above it.
RECALL = 0.9999
#: Sets compared at once: two blocks.
BLOCK = 256
U = np.uint64


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(2).integers(0, 1 << 63, n, dtype=np.int64).astype(U) * U(2) + U(1)


def shingled(docs: DataFrame, *kept: str) -> DataFrame:
    """kept and shingles: the distinct hashed runs of words."""
    return docs.select(*kept, words(F.col("text")).alias("w")).select(*kept, F.array_distinct(windows("w", NEAR_WORDS)).alias("shingles"))


def sign(trees: int, depth: int = DEPTH):
    """Python over (doc_id, d1, d2, shingles): the set's 128-bit key, size, and its signature in each tree."""
    times = multipliers(trees * depth)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                lists = batch.column("shingles")
                x = lists.flatten().to_numpy().astype(U)
                n = lists.value_lengths().to_numpy().astype(np.int64)
                some = n > 0
                starts = (np.cumsum(n) - n)[some]
                keys = np.zeros((len(n), trees), U)
                s1 = np.zeros(len(n), U)
                s2 = np.zeros(len(n), U)
                if len(starts):
                    s1[some] = np.add.reduceat(mixed(x), starts)
                    s2[some] = np.add.reduceat(mixed(x ^ MIX), starts)
                    part = np.zeros((len(starts), trees), U)
                    for k in range(trees * depth):
                        least = mixed(np.minimum.reduceat(x * times[k], starts) + U(k))
                        part[:, k // depth] = (part[:, k // depth] << U(8)) | (least >> U(56))
                    keys[some] = part
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * trees), pa.array(keys.astype(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("d1"), batch.column("d2"), pa.array(s1.astype(np.int64)), pa.array(s2.astype(np.int64)), pa.array(n.astype(np.int32)), rows],
                                                 ["doc_id", "d1", "d2", "s1", "s2", "n", "signature"])

    return run, "doc_id long, d1 long, d2 long, s1 long, s2 long, n int, signature array<long>"


def chosen_depths(sizes: np.ndarray, similarity: float, recall: float) -> np.ndarray:
    """sizes (sets, trees, depths from SHORTEST on): how many sets are below each set's prefixes. Returns each set's depth
    in each tree, as a place in the last axis: the prefixes shortened, cheapest first, until the recall."""
    depths = np.arange(SHORTEST, SHORTEST + sizes.shape[2])
    # by a prefix in every tree, sets at the similarity are missed with the product of 1 - similarity ** depth
    worth = -np.log1p(-(similarity**depths))
    need = -np.log1p(-recall)
    at = np.full(sizes.shape[:2], sizes.shape[2] - 1)
    row, tree = np.indices(at.shape, sparse=True)
    while True:
        open_ = (worth[at].sum(1) < need) & (at > 0).any(1)
        if not open_.any():
            return at
        shorter = np.maximum(at - 1, 0)
        price = (sizes[row, tree, shorter] - sizes[row, tree, at]) / np.maximum(worth[shorter] - worth[at], 1e-12)
        price[at == 0] = np.inf
        best = price.argmin(1)
        rows = np.flatnonzero(open_)
        at[rows, best[rows]] -= 1


def choose(trees: int, similarity: float, recall: float):
    """Python over (shared: tree, depth, size, node): the nodes at which each set cuts its paths."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 2000):
                lists = whole.column("shared").slice(begin, 2000)
                n = lists.value_lengths().to_numpy().astype(np.int64)
                flat = lists.flatten()
                tree, depth, size, node = (flat.field(k).to_numpy() for k in range(4))
                row = np.repeat(np.arange(len(n)), n)
                sizes = np.ones((len(n), trees, DEPTH - SHORTEST + 1))
                sizes[row, tree, depth - SHORTEST] = size
                at = chosen_depths(sizes, similarity, recall)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(node[at[row, tree] == depth - SHORTEST]))], ["node"])

    return run, "node long"


def cut_tries(sets: DataFrame, similarity: float, recall: float, trees: int = TREES) -> DataFrame:
    """sets (s1, s2, signature): s1, s2 and keys, the cut above each set in each tree, of the sets that share any; where a
    set shares none its key is its own."""
    prefix = lambda depth: F.xxhash64("tree", F.lit(depth), F.shiftrightunsigned("sig", 8 * (DEPTH - depth)))
    paths = sets.select("s1", "s2", F.posexplode("signature").alias("tree", "sig")).withColumn("top", prefix(SHORTEST))
    tops = stored(paths.groupBy("top").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("top"), "tops")
    # a set alone at the shortest prefix is alone in that tree
    shared = stored(key_filter(tops, "top", tops.count())(paths, "top").join(tops, "top", "left_semi").drop("top"), "paths")
    levels = shared.select("s1", "s2", "tree", F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), prefix(d).alias("node")) for d in range(SHORTEST, DEPTH + 1)))).alias("x")).select("s1", "s2", "tree", "x.*")
    nodes = stored(levels.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "nodes")
    told = levels.join(nodes, "node").groupBy("s1", "s2").agg(F.collect_list(F.struct("tree", "depth", "size", "node")).alias("shared"))
    cuts = stored(told.select("shared").mapInArrow(*choose(trees, similarity, recall)).distinct(), "cuts")
    # the first cut on the way down; each set has one at most in a tree, and all sets below a cut have the same
    first = levels.join(cuts, "node").groupBy("s1", "s2").agg(*(F.min_by("node", F.when(F.col("tree") == t, F.col("depth"))).alias(f"k{t}") for t in range(trees)))
    return first.select("s1", "s2", F.array(*(F.coalesce(f"k{t}", F.xxhash64(F.lit(t), "s2", "s1")) for t in range(trees))).alias("keys"))


class Forest:
    """Union-find over the rows of one group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def shared_counts(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many values each two lists share. flat: the lists of distinct values end to end; n: their lengths."""
    values, column, often = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(n)), n)
    place = np.cumsum(often > 1) - 1
    keep = often[column] > 1
    row, column = row[keep], place[column[keep]]
    total = np.zeros((len(n), len(n)), np.float32)
    width = 8192
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (begin, begin + width))
        some = np.zeros((len(n), width if b < len(column) else int(column[-1]) + 1 - begin), np.float32)
        some[row[a:b], column[a:b] - begin] = 1
        total += some @ some.T
    return total


def compare(similarity: float):
    """Python over rows sorted by group (g1, g2, i, j): links of each set and a spanning forest of each group."""

    def one(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows)
        n = t.column("n").to_numpy().astype(np.int64)
        if len(n) < 2:
            return None
        mine, tree = t.column("block").to_numpy(), t.column("tree")[0].as_py()
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        label = t.column("label").combine_chunks()
        clustered, label = label.is_valid().to_numpy(zero_copy_only=False), label.fill_null(0).to_numpy()
        keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(len(n), -1)
        total = shared_counts(t.column("shingles").combine_chunks().flatten().to_numpy(), n)
        both = n[:, None] + n[None, :] - total
        near = np.triu(total >= np.float32(similarity) * both - 1e-3, 1)
        if i != j:
            near &= mine[:, None] != mine[None, :]
        a, b = np.nonzero(near)
        fits = total[a, b].astype(np.int64) * 1000 >= (both[a, b].astype(np.int64) * round(similarity * 1000))
        if tree >= 0:  # pairs of one cluster are compared there, all of them; others in the first tree where they meet
            equal = keys[a] == keys[b]
            together = clustered[a] & clustered[b] & (label[a] == label[b])
            fits &= ~together & (equal.argmax(1) == tree)
        a, b = a[fits], b[fits]
        if not len(a):
            return None
        links = np.bincount(np.concatenate([a, b]), minlength=len(n))
        forest = Forest(len(n))
        edges = [(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if forest.join(x, y)]
        s1, s2 = t.column("s1").to_numpy(), t.column("s2").to_numpy()
        some = np.flatnonzero(links)
        x, y = np.array(edges).T
        none = np.zeros(len(some), np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(p)) for p in ((s1[some], s1[x]), (s2[some], s2[x]), (none, s1[y]), (none, s2[y]), (links[some], np.zeros(len(x), np.int64)))], ["s1", "s2", "t1", "t2", "links"])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            ids = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("g1", "tree", "i", "j")], 1)
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1).tolist(), len(ids)]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if end == begin:
                    continue
                now = tuple(ids[begin].tolist())
                if now != key and held:
                    out = one(held)
                    if out is not None:
                        yield out
                    held = []
                key = now
                held.append(batch.slice(begin, end - begin))
        if held and (out := one(held)) is not None:
            yield out

    return run, "s1 long, s2 long, t1 long, t2 long, links long"


def comparisons(sets: DataFrame) -> DataFrame:
    """sets (s1, s2, keys), one row a set: s1, s2, tree (-1: a cluster's), g1, size, label (null without a
    cluster) of every group that a set has to be compared in."""
    spread = sets.select("s1", "s2", F.posexplode("keys").alias("tree", "key"))
    # one bucket for each group of members, though many trees have it; a member's hash for the group's
    buckets = spread.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("s1", "s2").cast("decimal(20,0)")).alias("who")).filter("size > 1")
    buckets = buckets.groupBy("size", "who").agg(F.min(F.struct("tree", "key")).alias("first")).select("size", "first.*")
    buckets = stored(buckets, "buckets")
    sieve = key_filter(buckets, "key", buckets.count())
    members = stored(sieve(spread, "key").join(buckets, ["tree", "key"]), "members")
    # two rounds of least labels find most clusters; they only decide where pairs are compared
    labels = members.select("s1", "s2", F.col("s1").alias("label")).distinct()
    for _ in range(2):
        # written, so that both sides of the next join are plain shuffles, which Spark can split at a hot bucket
        told = stored(members.join(labels, ["s1", "s2"]).groupBy("tree", "key").agg(F.min("label").alias("label")), "bucket-labels")
        labels = stored(members.join(told, ["tree", "key"]).groupBy("s1", "s2").agg(F.min("label").alias("label")), "labels")
    labelled = members.join(labels, ["s1", "s2"])
    inside = stored(labelled.groupBy("tree", "key").agg(F.min("label").alias("label"), F.max("label").alias("other"), F.first("size").alias("size")), "inside")
    work = inside.filter("label = other").groupBy("label").agg(F.sum(F.col("size") * F.col("size")).alias("pairs"))
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    # compared as one cluster where that is less work than bucket by bucket
    clusters = sizes.join(work, "label").filter(F.col("size").cast("double") * F.col("size") <= 2 * F.col("pairs")).select("label", F.col("size").alias("cluster"))
    clusters = stored(clusters, "clusters")
    whole = labels.join(clusters, "label").select("s1", "s2", F.lit(-1).alias("tree"), F.col("label").alias("g1"), F.col("cluster").alias("size"), "label")
    left = inside.join(clusters, "label", "left").filter("cluster IS NULL OR label <> other").select("tree", "key")
    # a set without a cluster has no label, so that its pairs count as apart: its s1 may be a cluster's label
    apart = labelled.join(left, ["tree", "key"], "left_semi").join(clusters.select("label", F.lit(True).alias("in")), "label", "left")
    apart = apart.select("s1", "s2", "tree", F.col("key").alias("g1"), "size", F.when(F.col("in"), F.col("label")).alias("label"))
    return stored(whole.unionByName(apart), "groups")


def row_keyed(docs: DataFrame) -> DataFrame:
    """docs and d1, d2, a 128-bit key that rows of equal id and text share."""
    return docs.withColumns({"d1": F.xxhash64("doc_id", "text"), "d2": F.xxhash64(F.lit(1), "text", "doc_id")})


def near_classes(docs: DataFrame, similarity: float = NEAR_SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, d1, d2 (row key), r1, r2 (class key), class_id (least doc_id), n_links (other texts within the
    similarity), n_copies."""
    bounded_batches(docs.sparkSession)
    docs = row_keyed(docs.select("doc_id", "text"))
    signed = stored(shingled(docs, "doc_id", "d1", "d2").mapInArrow(*sign(TREES)), "signed")
    some = signed.filter("n > 0")
    sets = some.groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.min(F.struct("d1", "d2")).alias("d"))
    sets = stored(sets.select("s1", "s2", "rows", "least", "n", "signature", "d.*"), "sets")
    cut = stored(cut_tries(sets, similarity, recall), "cut-tries")
    groups = comparisons(cut)
    wanted = groups.groupBy("s1", "s2").agg(F.collect_list(F.struct("tree", "g1", "size", "label")).alias("groups"))
    wanted = stored(wanted.join(cut, ["s1", "s2"]).join(sets.select("s1", "s2", "n", "d1", "d2"), ["s1", "s2"]), "wanted")
    texts = key_filter(wanted, "d1", wanted.count())(docs, "d1").select("d1", "d2", "text")
    loaded = shingled(wanted.join(texts, ["d1", "d2"]).dropDuplicates(["d1", "d2"]), "s1", "s2", "n", "keys", "groups")
    rows = loaded.select("s1", "s2", "n", "keys", "shingles", F.explode("groups").alias("g")).select("s1", "s2", "n", "keys", "shingles", "g.*")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("s2", "s1"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    dealt = rows.select("g1", "tree", "i", "j", "block", "label", "s1", "s2", "n", "keys", "shingles").repartition(F.col("g1"), F.col("tree"), F.col("i"), F.col("j"))
    found = stored(dealt.sortWithinPartitions("g1", "tree", "i", "j").mapInArrow(*compare(similarity)), "links")
    edges = found.filter("links = 0").select(F.struct("s1", "s2").alias("u"), F.struct(F.col("t1").alias("s1"), F.col("t2").alias("s2")).alias("v"))
    links = found.filter("links > 0").groupBy("s1", "s2").agg(F.sum("links").alias("links"))
    roots = components(edges).select("node.s1", "node.s2", "root")
    known = sets.select("s1", "s2", "rows", "least").join(roots, ["s1", "s2"], "left").join(links, ["s1", "s2"], "left")
    known = known.withColumn("root", F.coalesce("root", F.struct("s1", "s2")))
    least = known.groupBy("root").agg(F.min("least").alias("class_id"))
    known = known.join(least, "root").select("s1", "s2", F.col("root.s1").alias("r1"), F.col("root.s2").alias("r2"), "class_id", F.coalesce("links", F.lit(0)).alias("n_links"), (F.col("rows") - 1).alias("n_copies"))
    result = some.select("doc_id", "d1", "d2", "s1", "s2").join(known, ["s1", "s2"]).drop("s1", "s2")
    none = signed.filter("n = 0").select("doc_id", "d1", "d2", F.col("d1").alias("r1"), F.col("d2").alias("r2"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_copies"))
    return result.unionByName(none)


def op2_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


#: DuckDB, by all shared runs of words; for tables of small size.
OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM d),
k AS (SELECT sh, row_number() OVER () AS sid, n_rows, least FROM (SELECT sh, count(*) AS n_rows, min(doc_id) AS least FROM s WHERE len(sh) > 0 GROUP BY sh)),
e AS (SELECT sid, len(sh) AS n, unnest(sh) AS x FROM k),
l AS (SELECT a.sid AS u, b.sid AS v FROM e a JOIN e b ON a.x = b.x AND a.sid < b.sid GROUP BY a.sid, b.sid, a.n, b.n HAVING 10 * count(*) >= 8 * (a.n + b.n - count(*))),
both_ways AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
deg AS (SELECT u AS sid, count(*) AS n_links FROM both_ways GROUP BY u),
reach(sid, r) AS (SELECT sid, sid FROM k UNION SELECT reach.sid, both_ways.v FROM reach JOIN both_ways ON both_ways.u = reach.r),
cls AS (SELECT reach.sid, min(k.least) AS class_id FROM reach JOIN k ON k.sid = reach.r GROUP BY reach.sid)
SELECT s.doc_id, CASE WHEN k.sid IS NULL THEN s.doc_id ELSE cls.class_id END AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n_rows - 1, 0)::BIGINT AS n_copies
FROM s LEFT JOIN k ON k.sh = s.sh LEFT JOIN cls ON cls.sid = k.sid LEFT JOIN deg ON deg.sid = k.sid
"""
