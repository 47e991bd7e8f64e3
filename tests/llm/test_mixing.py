"""Mixing, importance resampling and vector codes against brute force, and their cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import mixing, ranking, resampling, vector_codes
from skein.llm.common import stored

DOCS = "doc_id long, text string, source string"
NAMES = ("size", "draw", "weight", "target", "rank", "score", "stop", "digit", "n", "v", "code", "before", "error", "bucket", "key_score", "mx_target", "rk_at", "place", "low", "high")


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in NAMES})


def brute_targets(sizes, weights, share, most):
    """By the rule itself: share, stop, share the excess again."""
    left, open_, out = Fraction(sum(sizes.values()) * share, 100), dict(weights), {}
    while open_:
        level = left / sum(open_.values())
        above = [s for s in open_ if level * open_[s] >= most * sizes[s]]
        if not above:
            return out | {s: level * w for s, w in open_.items()}
        for s in above:
            out[s] = Fraction(most * sizes[s])
            left -= out[s]
            del open_[s]
    return out


def test_first_value_and_kth_key(spark):
    rng = random.Random(3)
    rows = [(rng.choice([-(1 << 63), (1 << 63) - 1, 0, -1, 5, rng.randint(-(1 << 62), 1 << 62)]), rng.randint(-3, 3), i) for i in range(500)]
    df = stored(spark.createDataFrame(rows, "a long, b long, c long"), "keys")
    for k in (1, 2, 77, 250, 499, 500):
        assert ranking.kth_key(df, ["a", "b", "c"], k) == sorted(rows)[k - 1]
    assert ranking.kth_key(df, ["a"], 501) is None and ranking.kth_key(df.filter("false"), ["a"], 1) is None
    assert {tuple(r) for r in df.filter(ranking.up_to(["a", "b", "c"], sorted(rows)[99])).collect()} == set(sorted(rows)[:100])
    value, below = ranking.first_value(df, "b", {"n": F.count(F.lit(1)), "s": F.sum("c")}, lambda here, v: v < 2)
    assert value == 2 and below == {"n": sum(b < 2 for _, b, _ in rows), "s": sum(c for _, b, c in rows if b < 2)}
    order = [F.col("b").desc(), F.col("a").asc()]
    places = {r["rank"]: (r["a"], r["b"]) for r in ranking.ranked(df.repartition(7), order, "rank").collect()}
    assert [places[i + 1] for i in range(500)] == [(a, b) for a, b, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]


@pytest.mark.parametrize("seed", range(4))
def test_targets_by_sharing_again(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i:02}": rng.choice([0, 1, rng.randint(1, 50), rng.randint(100, 10_000)]) for i in range(rng.choice([1, 3, 40]))}
    if seed == 3:
        sizes = dict.fromkeys(sizes, 7)
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    df = mixing.cycled(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    assert {r["source"]: r["weight"] for r in df.collect()} == weights
    found = {r["source"]: r["target"] for r in mixing.targets(stored(df, "w")).collect()}
    wanted = brute_targets(sizes, weights, 150, 2)
    assert found.keys() == wanted.keys() and all(math.isclose(found[s], wanted[s], rel_tol=1e-12) for s in wanted)


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 60))), rng.choice(["hot", "hot", "hot", "a", "é", "z", None])) for i in range(3000)]
    rows += [(None, "no id here", "a"), (5000, None, "a"), (5001, "", "alone"), (5002, "\x0b \t", "alone"), (5003, "x " * 100_000, "long"), (7, "twice the same", "z"), (7, "twice the same", "z")]
    docs = clashing(spark.createDataFrame(rows, DOCS))
    found = mixing.mixed(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in found) == Counter((i, size(t), s) for i, t, s in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    wanted = brute_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 150, 2)
    taken, squares = Counter(), Counter()
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], wanted[r["source"]], rel_tol=1e-12)
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert r["copies"] in (math.floor(rate), math.ceil(rate))
        taken[r["source"]] += r["size"] * r["copies"]
        squares[r["source"]] += r["size"] ** 2 * (rate % 1) * (1 - rate % 1)
    assert all(abs(taken[s] - wanted[s]) <= 4 * math.sqrt(squares[s]) for s in sizes)
    assert sorted(map(repr, found)) == sorted(map(repr, mixing.mixed(docs.repartition(3)).collect()))
    goals = mixing.rates(mixing.measured(docs))
    out = mixing.emitted(docs, goals)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == Counter({k: n for k, n in sum((Counter({r["doc_id"]: r["copies"]}) for r in found), Counter()).items() if n})
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.emitted(docs.limit(0), goals).count() == 0


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def brute_resampled(docs, target, longest=1, buckets=10_000, least=20, percent=10):
    runs = lambda t: [" ".join(w[i : i + n]) for w in [words(t)] for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(place(f) for _, x, _ in docs for f in runs(x)), Counter(place(f) for x in target for f in runs(x))
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets))))
    out = []
    for i, x, _ in docs:
        f = runs(x)
        weight = sum(gain(place(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x)) >= least])
    may = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(may[: percent * len(may) // 100], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling(spark, longest):
    rng = random.Random(2)
    vocabulary = ["Al", "bé", "ça", "d3", "eX", "ß", "東京", "gg", "hh"]
    rows = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 70))), None) for i in range(600)]
    rows += [(i, "one text of many copies " * 5, None) for i in range(1000, 1200)] + [(3, "equal rows " * 30, None)] * 90 + [(None, "no id " * 40, None)] * 2 + [(9000, None, None), (9001, "", None), (9002, "?!", None), (9003, "long " * 200_000, None)]
    target = ["Al bé Al bé equal rows", None, "", "東京 gg"]
    docs, bench = clashing(spark.createDataFrame(rows, DOCS)), spark.createDataFrame([(t,) for t in target], "text string").withColumn("bucket", F.lit(1))
    found = resampling.resampled(docs, bench, longest=longest)
    assert Counter(tuple(r) for r in found.collect()) == brute_resampled(rows, target, longest)
    if longest == 1:
        assert Counter(tuple(r) for r in resampling.resampled(docs, bench.limit(0)).collect()) == brute_resampled(rows, [])
        assert resampling.resampled(docs.limit(0), bench).count() == 0
        assert {r["rank"] for r in resampling.resampled(docs, bench, percent=0).collect()} == {None}


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(parts)]
    cuts = [cut(v) for _, v, _ in kept]
    books = [[c[p] for c in cuts[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))
    for _ in range(rounds):
        held = defaultdict(list)
        for c in cuts:
            for p in range(parts):
                held[p, near(c[p], books[p])[1]].append(c[p])
        books = [[tuple(sum(x) // len(held[p, k]) for x in zip(*held[p, k], strict=True)) if held[p, k] else old for k, old in enumerate(books[p])] for p in range(parts)]
    best = [[near(c[p], books[p]) for p in range(parts)] for c in cuts]
    total = Counter()
    for (_, _, label), b in zip(kept, best, strict=True):
        total[label] += sum(d for d, _ in b)
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for _, k in b), sum(d for d, _ in b), total[label], digest) for (i, _, label), b in zip(kept, best, strict=True))


def test_vector_codes(spark, tmp_path):
    rng = random.Random(4)
    vector = lambda: [rng.choice([0.0, rng.uniform(-1, 1), rng.uniform(-300, 300)]) for _ in range(32)]
    twin = vector()
    rows = [(i, vector(), rng.choice([1, 2, None])) for i in range(700)] + [(800 + i, twin, 3) for i in range(300)] + [(5, twin, None), (5, twin, None), (None, vector(), 1)]
    rows += [(2000, None, 1), (2001, [None] + twin[1:], 1), (2002, [float("nan")] + twin[1:], 1), (2003, twin[:-1] + [float("inf")], 1), (-1, [float("-inf")] * 32, 1)]
    schema = "vec_id long, embedding array<float>, label int"
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows]
    clashing(spark.createDataFrame(exact, schema)).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = vector_codes.op13_vector_codes(spark, str(tmp_path))
    assert Counter(tuple(r) for r in found.collect()) == brute_codes(exact)


def test_vector_codes_cases(spark):
    schema = "vec_id long, embedding array<double>, label int"
    none, books = vector_codes.product_codes(spark.createDataFrame([], schema))
    assert none.count() == 0 and books.size == 0
    assert vector_codes.product_codes(spark.createDataFrame([(1, [], 1), (2, None, 1)], schema))[0].count() == 0
    few, books = vector_codes.product_codes(spark.createDataFrame([(1, [1.0] * 16, 1), (2, [2.0] * 16, 1), (3, [2.0] * 32, 1), (4, [1e30] * 16, None)], schema))
    assert books.shape == (16, 3, 1) and {r["vec_id"]: (bytes(r["code"]), r["error"]) for r in few.collect()} == {1: (bytes(16), 0), 2: (bytes([1] * 16), 0), 4: (bytes([2] * 16), 0)}


def test_differences_are_those_of_changed_parts(spark):
    """The running sums equal sums anew; rows whose code stays give nothing."""
    rows = [(1, [1, 2, 3, 4], b"\x00\x01", b"\x00\x00"), (2, [5, 6, 7, 8], b"\x01\x01", b"\x01\x01"), (3, [9, 10, 11, 12], b"", b"\x02\x01")]
    df = spark.createDataFrame([(i, None, v, bytearray(b), bytearray(a)) for i, v, b, a in rows], "vec_id long, label string, v array<int>, before binary, code binary")
    found = {(r["part"], r["entry"]): (r["n"], r["sums"]) for r in vector_codes.differences(df, (2, 3, 2)).collect()}
    assert found == {(0, 2): (1, [9, 10]), (1, 1): (0, [8, 8]), (1, 0): (1, [3, 4])}
