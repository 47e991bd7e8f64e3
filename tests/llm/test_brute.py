"""The operators against brute-force versions, exact round trips and held-out accuracy."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import anchors, bpe, components, html_extract, html_pages, langid, near_join, quality, samples, suffix_dedup, toxicity, training_order, urls

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return [w for w in re.split(SEPARATORS, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def brute_repeats(texts, width=200):
    count = Counter(t[s : s + width] for t in texts for s in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for s in range(len(t) - width + 1):
            if count[t[s : s + width]] > 1:
                gone[s : s + width] = b"\1" * width
        runs = sum(1 for i in range(len(t)) if gone[i] and (not i or not gone[i - 1]))
        out.append((bytes(b for b, g in zip(t, gone, strict=True) if not g), sum(gone), runs))
    return out


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def brute_classes(rows):
    """(class id, links, copies) of each (id, text)."""
    sets = [shingles(t) for _, t in rows]
    owners = defaultdict(list)
    for i, s in enumerate(sets):
        owners[s].append(i)
    kinds = [s for s in owners if s]
    up, links = list(range(len(kinds))), Counter()

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(kinds):
        for j in range(i):
            both = len(a & kinds[j])
            if 10 * both >= 8 * (len(a) + len(kinds[j]) - both):
                links[i] += 1
                links[j] += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = defaultdict(list)
    for i, s in enumerate(kinds):
        least[root(i)] += [rows[r][0] for r in owners[s]]
    out = {}
    for i, s in enumerate(kinds):
        for r in owners[s]:
            out[r] = (min(least[root(i)]), links[i], len(owners[s]) - 1)
    for r in owners.get(frozenset(), []):
        out[r] = (rows[r][0], 0, 0)
    return [out[r] for r in range(len(rows))]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in ("al", "be", "gé", "de", "ep") for b in ("ta", "mo", "ri", "ß", "x")]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 90))) for _ in range(25)]
    rows = []
    for i in range(90):
        rows.append((i, " ".join(rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 80))) for _ in range(rng.randint(0, 4)))))
    for i in range(90, 140):
        base = rows[rng.randrange(30)][1].split(" ")
        for _ in range(rng.randint(0, 2)):
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
        rows.append((i, " ".join(base)))
    return rows


def test_repeats(spark, texts):
    found = {r["doc_id"]: r for r in suffix_dedup.dedup_bytes(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for (i, t), (kept, removed, runs) in zip(texts, brute_repeats([t.encode() for _, t in texts]), strict=True):
        assert (found[i]["n_bytes"], found[i]["n_removed"], found[i]["n_spans"], found[i]["kept_sha256"]) == (len(t.encode()), removed, runs, hashlib.sha256(kept).hexdigest())


def test_repeats_of_hot_grams(spark, texts, monkeypatch):
    """Suffixes of grams that are too many for a task are told apart in the cluster."""
    monkeypatch.setattr(suffix_dedup, "LOCAL", 150)
    test_repeats(spark, texts)


def test_buckets_are_sorted_alike_in_any_portions(monkeypatch):
    rng = random.Random(7)
    parts = [rng.randbytes(150) for _ in range(6)]
    rows = []
    for gram in range(40):
        for k in range(rng.randint(1, 6)):
            rows.append({"gram": gram, "hot": False, "alone": rng.random() < 0.8, "d1": len(rows), "d2": 7, "place": 136, "lo": 5 * k, "span": b"".join(rng.choice(parts) for _ in range(2))[rng.randint(0, 3) :]})
    schema = pa.schema([("gram", pa.int64()), ("hot", pa.bool_()), ("alone", pa.bool_()), ("d1", pa.int64()), ("d2", pa.int64()), ("place", pa.int32()), ("lo", pa.int32()), ("span", pa.binary())])
    whole = pa.RecordBatch.from_pylist(rows, schema)
    told = lambda batches: sorted(tuple(r.values()) for b in suffix_dedup.sort_buckets(iter(batches)) for r in b.to_pylist())
    want = []
    seen = Counter((r["gram"], r["place"] - s, r["span"][s : s + 200]) for r in rows for s in range(len(r["span"]) - 199))
    for r in rows:
        starts = [s for s in range(len(r["span"]) - 199) if r["alone"] and seen[r["gram"], r["place"] - s, r["span"][s : s + 200]] > 1]
        for s in starts:
            if s - 1 not in starts:
                want.append((r["d1"], 7, r["lo"] + s, r["lo"] + next(e for e in range(s, 400) if e + 1 not in starts)))
    assert told([whole]) == sorted(want) and want
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", 150)
    assert told([whole.slice(k, 7) for k in range(0, len(rows), 7)]) == sorted(want) == told([whole])


def test_slices_of_long_texts(monkeypatch):
    text = random.Random(5).randbytes(1000)
    batch = pa.RecordBatch.from_pylist([{"data": text, "d1": 1, "d2": 2}, {"data": b"", "d1": 3, "d2": 4}, {"data": text[:300], "d1": 5, "d2": 6}], pa.schema([("data", pa.binary()), ("d1", pa.int64()), ("d2", pa.int64())]))
    starts = lambda: sorted((r["d1"], s, r["at"]) for b in suffix_dedup.find_runs([batch]) for r in b.to_pylist() for s in range(r["lo"], r["hi"] + 1))
    whole = starts()
    assert [x[:2] for x in whole] == [(1, s) for s in range(801)] + [(5, s) for s in range(101)]
    monkeypatch.setattr(suffix_dedup, "SLICE", 33)
    assert starts() == whole


def test_suffix_groups_are_in_order():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[2000:2400] = data[100:500]
    starts, group = np.arange(2976), rng.integers(0, 2, 2976)
    at, told = suffix_dedup.suffix_groups(data, starts, group, 24)
    text = data.tobytes()
    count = Counter((g, text[s : s + 24]) for s, g in zip(starts.tolist(), group.tolist(), strict=True))
    want = sorted((g, text[s : s + 24], s) for s, g in zip(starts.tolist(), group.tolist(), strict=True) if count[g, text[s : s + 24]] > 1)
    assert sorted((group[s], text[s : s + 24], s) for s in at.tolist()) == want and [(group[s], text[s : s + 24]) for s in at.tolist()] == [w[:2] for w in want]
    assert [len({told[k] for k in range(len(at)) if (group[at[k]], text[at[k] : at[k] + 24]) == w}) for w in {w[:2] for w in want}] == [1] * len({w[:2] for w in want}) and len(set(told.tolist())) == len({w[:2] for w in want})


def test_repeats_in_a_text_of_seventeen_million_bytes(spark):
    """A periodic passage stands across byte 2 ** 24 and at the beginning of another text."""
    rng = np.random.default_rng(2)
    half = bytes(rng.integers(97, 123, 100).astype(np.uint8))
    noise = rng.integers(33, 127, 17_000_000).astype(np.uint8).tobytes()
    place = (1 << 24) - 150
    long = noise[:place] + b"\n" + half * 4 + b"\n" + noise[place:]
    short = b" " + half * 3 + b" " + noise[:199]
    rows = [(1, long.decode()), (2, short.decode()), (3, noise[5_000_000:5_000_200].decode())]
    found = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kept = noise[:5_000_000] + noise[5_000_200:place] + b"\n" + b"\n" + noise[place:]
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert found == {1: (600, 2, sha(kept)), 2: (300, 1, sha(b" " + b" " + noise[:199])), 3: (200, 1, sha(b""))}


def test_many_equal_rows(spark):
    from pyspark.sql import functions as F

    text = " ".join(f"w{k}" for k in range(200))
    rows = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    found = suffix_dedup.dedup_bytes(rows.unionByName(rows.limit(1).select("doc_id", F.lit("short").alias("text"))))
    assert sorted(tuple(r) for r in found.groupBy("n_bytes", "n_removed", "n_spans").count().collect()) == [(5, 0, 0, 1), (len(text), len(text), 1, 100_000)]


def test_run_hashes_do_not_depend_on_the_place():
    data = np.frombuffer(b"abcdefghij" * 30, np.uint8)
    h = anchors.RunHash(data, 0)
    assert h(np.array([3]), np.array([103]))[0] == h(np.array([53]), np.array([153]))[0] == h.each(100)[3] != h.each(100)[4]


def test_near_classes(spark, texts):
    found = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in near_join.near_classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [found[i] for i, _ in texts] == brute_classes(texts)


def test_one_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_join, "BLOCK", 16)
    rng = random.Random(1)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(100)]
    found = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in near_join.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[i] for i, _ in rows] == brute_classes(rows)


def test_a_set_outside_the_cluster_that_has_its_name(spark):
    # 10 takes label 1, which becomes no cluster; 11 to 15 keep label 10, which becomes one
    buckets = [(0, {10, 11, 12, 13, 14, 15}), (1, {11, 12, 13, 14, 15}), (2, {1, 50}), (3, {50, 10}), *((4 + k, {1, 60 + k}) for k in range(7))]
    ids = sorted(set().union(*(b for _, b in buckets)))
    keys = {s: [next((-1 - tree for tree, b in buckets if tree == t and s in b), 100 * s + t) for t in range(len(buckets))] for s in ids}
    sets = spark.createDataFrame([(s, s, 10, keys[s], s, s) for s in ids], "s1 long, s2 long, n int, keys array<long>, d1 long, d2 long")
    groups = near_join.comparisons(sets).orderBy("g1", "tree").toArrow().to_pylist()
    assert {r["s1"] for r in groups if r["tree"] == -1} == {11, 12, 13, 14, 15}
    rows = [{**r, "i": 0, "j": 0, "block": 0, "n": 10, "keys": keys[r["s1"]], "shingles": list(range(10))} for r in groups]
    kinds = {"label": pa.int64(), "n": pa.int32(), "keys": pa.list_(pa.int64()), "shingles": pa.list_(pa.int64())}
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([(c, kinds.get(c, pa.int64())) for c in rows[0]]))
    links = Counter()
    for out in near_join.compare(0.8)[0]([batch]):
        for r in out.to_pylist():
            links[r["s1"]] += r["links"]
    assert links == {1: 8, **{60 + k: 1 for k in range(7)}, 50: 2, 10: 6, 11: 5, 12: 5, 13: 5, 14: 5, 15: 5}


def test_a_cluster_keeps_near_pairs_without_a_common_key():
    rows = [{"g1": 1, "tree": -1, "i": 0, "j": 0, "block": 0, "label": 1, "s1": s, "s2": s, "n": 10, "keys": [s, s], "shingles": list(range(10))} for s in (1, 2)]
    kinds = {"keys": pa.list_(pa.int64()), "shingles": pa.list_(pa.int64())}
    out = near_join.compare(0.8)[0]([pa.RecordBatch.from_pylist(rows, pa.schema([(c, kinds.get(c, pa.int64())) for c in rows[0]]))])
    assert sorted((r["s1"], r["links"]) for b in out for r in b.to_pylist()) == [(1, 0), (1, 1), (2, 1)]


def test_prefixes_shorten_until_the_recall_where_it_is_cheap():
    depths = near_join.DEPTH - near_join.SHORTEST + 1
    sizes = np.ones((4, near_join.TREES, depths))
    sizes[1] = 50  # near copies all the way: shorter prefixes add nothing
    sizes[2] = 4.0 ** np.arange(depths)[::-1]
    sizes[3, :10] = 10.0 ** np.arange(depths)[::-1]  # crowded in half the trees, alone in the others
    at = near_join.chosen_depths(sizes, 0.8, 0.9999) + near_join.SHORTEST
    missed = (1 - 0.8**at).prod(1)
    assert (missed <= 1e-4).all() and (missed > 1e-6).all()
    assert set(at[2].tolist()) <= {4, 5} and at[3, :10].min() > at[3, 10:].max()
    assert (near_join.chosen_depths(sizes, 0.8, 0.5) == depths - 1).all()


def test_cuts_are_the_shortest_prefix_that_a_set_below_has_chosen(spark):
    """By hand, over all prefixes of few trees."""
    rng = random.Random(6)
    base = [rng.getrandbits(63) for _ in range(6)]
    sets = []
    for i in range(120):
        b = rng.choice(base)
        sets.append((i, i, [(b >> 8 * d << 8 * d) | rng.getrandbits(8 * d) for d in (rng.randrange(8) for _ in range(5))]))
    prefix = lambda s, t, d: (t, d, s[2][t] >> 8 * (8 - d))
    below = defaultdict(set)
    for s in sets:
        for t in range(5):
            for d in range(3, 9):
                below[prefix(s, t, d)].add(s[0])
    sizes = np.array([[[len(below[prefix(s, t, d)]) for d in range(3, 9)] for t in range(5)] for s in sets], float)
    at = near_join.chosen_depths(sizes, 0.8, 0.9) + 3
    cuts = {prefix(s, t, int(at[i, t])) for i, s in enumerate(sets) for t in range(5) if len(below[prefix(s, t, int(at[i, t]))]) > 1}
    want = defaultdict(set)
    for s in sets:
        for t in range(5):
            if first := next((prefix(s, t, d) for d in range(3, 9) if prefix(s, t, d) in cuts), None):
                want[first].add(s[0])
    found = defaultdict(set)
    for r in near_join.cut_tries(spark.createDataFrame(sets, "s1 long, s2 long, signature array<long>"), 0.8, 0.9, 5).collect():
        for t, k in enumerate(r["keys"]):
            found[t, k].add(r["s1"])
    assert sorted(map(sorted, want.values())) == sorted(sorted(x) for x in found.values() if len(x) > 1)


def test_quantile_sketches_merge_within_their_error(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(0, 200, 3000), rng.integers(0, 10**6, 3000), rng.integers(0, 10**15, 500)])
    rated = spark.createDataFrame([("l", "s" if k % 3 else None, False, int(v)) for k, v in enumerate(values)], "lang string, source string, base_failed boolean, x long")
    whole = quality.sketches(rated, ["x"])
    parts = [quality.sketches(rated.filter(F.pmod("x", F.lit(3)) == k), ["x"]) for k in range(3)]
    key = lambda df: sorted(df.select("lang", "source", "rate", "level", "n").collect(), key=repr)
    assert key(quality.merged(quality.merged(parts[2], parts[0]), parts[1])) == key(whole) and whole.count() < 2 * 64 * 64
    (found,) = quality.quantiles(whole, "lang").collect()
    ordered = np.sort(values)
    for p in quality.QUANTILES:
        exact = int(ordered[-(-p * len(ordered) // 100) - 1])
        assert exact * (1 - 2 ** (1 - quality.BITS)) <= found[f"q{p}"] <= exact


def test_small_groups_are_judged_by_their_language(spark):
    plain = lambda i: " ".join(f"w{(i * 31 + k * 17) % 500:03}" for k in range(40))
    rows = [(i, plain(i), "a", "big") for i in range(60)] + [(100 + i, plain(i) + " #" * 60, "a", "tiny") for i in range(3)] + [(200, plain(1), "b", "one")]
    found = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {i for i, kept in found.items() if not kept} == {100, 101, 102}


def test_the_same_rate_is_usual_in_one_group_and_odd_in_another(spark):
    words = lambda i, n, of=1: [f"w{(i * 31 + k * 17) % 500:03}" * of for k in range(n)]
    symbols = lambda i, n: " ".join([*words(i, 40), "#" * n])
    rows = [(i, symbols(i, 3 * (i % 4)), "a", "code") for i in range(40)] + [(100 + i, symbols(i, 0), "a", "prose") for i in range(40)]
    rows += [(200, symbols(7, 9), "a", "code"), (201, symbols(7, 9), "a", "prose"), (202, symbols(7, 200), "a", "code")]
    rows += [(300 + i, " ".join(words(i, 30 - i % 9) + words(i + 40, i % 9, 4)), "a", "long") for i in range(45)] + [(400, " ".join(words(9, 20) + words(3, 10, 4)), "a", "long"), (401, " ".join(words(9, 20) + words(3, 10, 4)), "a", "prose")]
    found = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {i for i, kept in found.items() if not kept} == {201, 202, 401}


def test_a_tail_is_the_language_s_where_a_group_is_small(spark):
    rows = [("l", "small", False, 0)] * 200 + [("l", "large", False, 0)] * 980 + [("l", "large", False, 100)] * 20
    rated = spark.createDataFrame(rows, "lang string, source string, base_failed boolean, repeat_pm long").selectExpr("*", *(f"0L AS {k}" for k in quality.RATES if k != "repeat_pm"))
    found = {r["source"]: r["hi_repeat_pm"] for r in quality.thresholds(quality.sketches(rated, quality.RATES)).collect()}
    assert found == {"small": 300, "large": 300}


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 102), (100, 102), (200, 201), (201, 201)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {k: 0 for k in range(31)} | {100: 100, 101: 100, 102: 100, 200: 200, 201: 200}


def test_bpe_equals_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.vocabulary_path()
    own, other = bpe.Codec(path), tokenizers.Tokenizer.from_file(path)
    rng = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "\t", "'s", "é", "ß", "1", "²", "!", "<|endoftext|>", "日本", " ", "\xa0", "\x85", "\x1c", "😀", "́", "\x00", "'S", "ɐ", "_", "word"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)] + ["x" * 3000, "ab" * 900, "", "a" * 129]
    for text, (ids, data) in zip(texts, own.encoded(texts), strict=True):
        want = other.encode(text, add_special_tokens=False).ids
        assert ids.decode() == ",".join(map(str, want)) and data.decode("utf-8", "replace") == other.decode(want, skip_special_tokens=False) == own.decode(want)


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 5, 17, 1000, 4097):
        p = training_order.feistel(np.arange(n), n)
        assert sorted(p) == list(range(n)) and (training_order.feistel(p, n, inverse=True) == np.arange(n)).all()
    assert (training_order.feistel(np.arange(1000), 1000, 1) != training_order.feistel(np.arange(1000), 1000, 2)).any()


def test_held_out_toxicity():
    rng = random.Random(2)
    plain = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(1200):
        w = [rng.choice(plain) for _ in range(60)]
        if toxic := int(i % 5 == 0):
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(60)] = rng.choice(("idiot", f"grumpf{rng.choice('abcdefgh')}"))
        rows.append((" ".join(w), toxic))
    scorer = toxicity.fit(rows[:900], 0.2)
    assert sum((scorer.score(t) >= 0.5) == y for t, y in rows[900:]) >= 290
    assert any("grumpf".startswith(s) for s in scorer.lexicon.stems if s.startswith("gr"))


def test_grammar_tells_context():
    lexicon = toxicity.Lexicon({"idiot": 1.0, "moron": 1.0})
    events = lambda t: {e: round(x, 6) for e, x in zip(toxicity.EVENTS, lexicon.events(t), strict=True) if x}
    near, far = toxicity.NEARNESS[1], toxicity.NEARNESS[3]
    assert events("An idiot.") == {"insult": 1} and events("You idiot.") == {"insult at target": near} and events("You are an idiot.") == {"insult at target": far}
    assert events("idiot, all of you") == {"insult at target": far} == events("Idiot, all of you! All is well.") and events("idiot and all of you") == {"insult": 1}
    assert events("moron idiot you") == {"insult at target": 2 * near} and events("It was not an idiot.") == {"insult negated": 1}
    assert events("The paper wrote of an idiot.") == {"insult reported": 1} and events("I will kill you.") == {"threat at target": 1} and events("I will never kill you.") == {"threat negated or reported": 1}
    assert events("All is well.") == events("They kill. You go.") == {}


def test_a_clause_of_any_length_is_one_clause():
    lexicon = toxicity.Lexicon({"idiot": 1.0})
    for n in (1, 100, 1000, 200_000):
        found = dict(zip(toxicity.EVENTS, lexicon.events("Fine. She said " + "and so on " * n + "idiot. You idiot"), strict=True))
        assert found["insult reported"] == 1 and found["insult at target"] == toxicity.NEARNESS[1] and sum(found.values()) == 1 + toxicity.NEARNESS[1]


def test_the_composed_machine_equals_its_parts_in_a_row():
    rng = random.Random(4)
    machines = [toxicity.reported_speech(), toxicity.negation(), toxicity.threat(), toxicity.target(), toxicity.insult()]
    for _ in range(500):
        words = [*(rng.choice(toxicity.CLASS_NAMES[:-1]) for _ in range(rng.randint(0, 14))), toxicity.END]
        tape = [[(w, 1.0)] for w in words]
        for m in machines:
            state, after = m.start, []
            for step in tape:
                out = []
                for symbol, weight in step:
                    state, told = m.step(state, symbol)
                    out += [(z, weight * w) for z, w in told]
                after.append(out)
            tape = after
        state, whole = toxicity.GRAMMAR.start, []
        for w in words:
            state, told = toxicity.GRAMMAR.step(state, w)
            whole.append(list(told))
        assert whole == tape and state == toxicity.GRAMMAR.start


def test_language_gradients_and_accuracy(monkeypatch):
    monkeypatch.setattr(langid, "f32", np.float64)
    rng = np.random.default_rng(0)
    h = langid.HIDDEN
    weights = [rng.normal(0, 0.3, s) for s in ((3 * h, 257), (3 * h, h), (3 * h, 257), (3 * h, h), (3, 2 * h), (3,))]
    x, y = rng.integers(0, 4, (7, 5)), np.array([0, 1, 2, 1, 0])
    x[5:, 0] = langid.PAD

    def loss(ws):
        p, real = langid.Network(["a", "b", "c"], ws).positions(x), x != langid.PAD
        return -sum(np.log(p[:, y[i], i])[real[:, i]].sum() for i in range(5)) / real.sum()

    gradient = langid.Network(["a", "b", "c"], weights).train_step(x, y)
    for k, w in enumerate(weights):
        at = (1, 1) if w.ndim == 2 else (1,)
        up, down = [v.copy() for v in weights], [v.copy() for v in weights]
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert abs(gradient[k][at] - (loss(up) - loss(down)) / 2e-5) < 1e-6
    monkeypatch.setattr(langid, "f32", np.float32)
    parts = {"x": ("tha", "ing", "ou", "er"), "y": ("ció", "ar", "que", "os")}
    r = random.Random(1)
    rows = [(" ".join("".join(r.choice(parts[c]) for _ in range(3)) for _ in range(20)), c) for c in "xy" for _ in range(80)]
    cut = lambda t: [t.encode()[k : k + langid.WIDTH] for k in range(0, len(t.encode()), langid.WIDTH)][: langid.WINDOWS]
    network = langid.train([(cut(t), c) for t, c in rows[20:80] + rows[100:]])
    spread = network.documents([t.encode() for t, _ in rows[:20] + rows[80:100]])
    assert [network.languages[k] for k in spread.argmax(1)] == ["x"] * 20 + ["y"] * 20


def test_every_one_of_seventy_languages_is_learnt(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(70 * k + c, f"l{c:02}", (letters[c % 26] + letters[c // 26] + " ") * (20 + k)) for c in range(70) for k in range(9)]
    docs = spark.createDataFrame([*rows, (0, "l00", "ab " * 5), (5000, "l00", None)], "doc_id long, lang string, text string")
    network = langid.fitted(docs)
    assert network.languages == [f"l{c:02}" for c in range(70)]
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identified(docs.filter("doc_id > 0"), network).collect()}
    assert sum(found[i] == lang for i, lang, _ in rows if i) > 550 and found[5000] == "und"


def test_a_sample_is_bounded_by_ids_and_bytes(spark):
    rows = [(i % 500, "a", "x" * 10) for i in range(5000)] + [(7000, "b", "y")] * 3000 + [(8000 + i, "c", "z" * 1000) for i in range(50)]
    known = spark.createDataFrame(rows, "doc_id long, label string, text string")
    picked = samples.picked_ids(known.select("doc_id", "label"), "label", F.when(F.col("label") == "a", 40).otherwise(30))
    found = Counter(r["label"] for r in picked.collect())
    assert found == {"a": 40, "b": 1, "c": 30} and picked.distinct().count() == 71
    texts = Counter(r["label"] for r in samples.bounded_texts(known.join(picked, ["doc_id", "label"]), "label", 5500).collect())
    assert texts == {"a": 40, "b": 1, "c": 5}


def test_held_out_pages():
    model, right, total = html_extract.fitted(), 0, 0
    for source in html_pages.labelled_pages(150, seed=99):
        page = html_extract.Page(source, marks=True)
        odds = model.marginals(page)
        for k, _ in page.blocks:
            if page.marked[k] is not None:
                total, right = total + 1, right + ((odds[k] >= 0) == page.marked[k])
    assert right / total > 0.95


def test_held_out_pages_whose_names_tell_nothing():
    """Every class and id is a random word."""
    rng = random.Random(8)
    model, right, total = html_extract.fitted(), 0, 0
    for source in html_pages.labelled_pages(300, seed=98):
        source = re.sub(r'(class|id)="[^"]*"', lambda m: f'{m[1]}="x{rng.randrange(10**6)}"', source)
        page = html_extract.Page(source, marks=True)
        odds = model.marginals(page)
        for k, text in page.blocks:
            if page.marked[k] is not None:
                total, right = total + len(text), right + len(text) * ((odds[k] >= 0) == page.marked[k])
    print("share of letters told right without names", right / total)
    assert right / total > 0.8


HOSTILE = {
    "unclosed tags": "<a " * 350_000, "unclosed quotes": '<a "' * 250_000 + ">", "quotes": "<a '\">" * 200_000, "deep": "<div>" * 100_000 + "x" + "</p>" * 100_000 + "</div>" * 100_000, "raw": "<svg>" * 200_000,
    "labels": "<svg>" + "<text>" * 100_000 + "</foreignobject>" * 50_000 + "</svg>", "comments": "<!--" * 250_000, "headings in a paragraph": "<p><td>" + "<h1>" * 200_000, "rows": "<table>" + "<tr><td>x" * 100_000,
    "brackets": "<" * 1_000_000, "declarations": "<!" * 500_000, "objects": "<object>" * 120_000, "names": "<div " + 'class="' * 140_000 + ">",
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_hostile_pages_take_linear_time(kind):
    model, begun = html_extract.fitted(), time.process_time()
    model.text(HOSTILE[kind])
    assert time.process_time() - begun < 8


def test_url_templates(spark):
    rows = [(f"http://a.net/{lang}/{k}", None) for lang in ("es", "fr", "en") for k in range(40)]
    rows += [(f"http://shop.org/{p}/{k}/x", None) for p in ("list", "item") for k in range(30)] + [(f"http://c.com/{k}", None) for k in range(10)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    found = {r["page_id"]: r for r in urls.filter_urls(pages).collect()}
    for i, (u, _) in enumerate(rows):
        host, path = re.match(r"http://([^/]*)(.*)", u).groups()
        first = path.split("/")[1]
        literal = sum(x.startswith(f"http://{host}/{first}/") or x == f"http://{host}/{first}" for x, _ in rows) * urls.SHARE >= sum(x.startswith(f"http://{host}/") for x, _ in rows)
        assert found[i]["template"].split("/")[1] == (first if literal and host != "c.com" else "*")
        assert found[i]["verdict"] == ("block" if host == "a.net" and first in ("es", "fr") else "allow")
    assert {r["template"] for r in found.values() if r["host"] == "shop.org"} == {"/list/*/x", "/item/*/x"}


def test_templates_of_deep_paths(spark):
    deep = [f"http://d.org/a/b/c/d/{p}/e/{k}/f/g/h" for p in ("blocked", "fine") for k in range(40)] + ["http://e.org" + "/s" * 300, "http://d.org/a"]
    pages = spark.createDataFrame(list(enumerate(deep)), "page_id long, url string")
    found = {r["page_id"]: r["template"] for r in urls.filter_urls(pages).collect()}
    assert found == {k: f"/a/b/c/d/{'blocked' if k < 40 else 'fine'}/e/*/f/g/h" for k in range(80)} | {80: "/*" * 300, 81: "/a"}


def test_pipeline(spark, texts, tmp_path):
    rng = random.Random(9)
    item = " ".join(f"q{k}" for k in range(14))
    extra = [(500, f"some words here {item} and there"), (501, "you idiot scum idiot trash " * 4), (502, " ".join(f"clean{rng.randrange(10**6)}" for _ in range(60)))]
    rows = [(i, t, "en", "s", len(t)) for i, t in texts + extra]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    known = [(i, 1, 0) for i in range(60)]
    spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    left = [(i, t) for i, t in texts + extra if i != 501]
    left = [(i, t) for (i, t), (c, _, _) in zip(left, brute_classes(left), strict=True) if c == i]
    cut = [(i, k.decode("utf-8", "ignore"), n) for (i, _), (k, n, _) in zip(left, brute_repeats([t.encode() for _, t in left]), strict=True)]
    want = {i: t for i, t, n in cut if (not n or t.strip()) and i != 500}
    assert {i: r["text"] for i, r in found.items()} == want and 502 in want
    codec = bpe.Codec(bpe.vocabulary_path())
    assert all(r["token_ids"] == codec.encode(r["text"]) and r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) for r in found.values())


