import json

from pyspark.sql import functions as F

from skein import schemas
from skein.api import Engine
from skein.fixtures import Tables
from skein.operators import graph, merge, predicates, reports, scope, search
from skein.sources import changes, config, embedding, files
from skein.sources.store import ChunkStore
from skein.streaming import watch

CHUNK = "id long, project_id int, file_path string, content string, content_hash string, language string, embedding array<float>, updated_at timestamp"


def test_upsert_is_idempotent(spark):
    target = spark.createDataFrame([(1, 1, "a", "old", "h1", "x", None, None), (2, 1, "b", "old", "h2", "x", None, None)], CHUNK)
    source = spark.createDataFrame([(None, 1, "a", "new", "h1", "y", [1.0], None), (None, 1, "c", "new", "h3", "y", None, None)], CHUNK)
    first = merge.upsert_chunks(target, source)
    assert {(r["file_path"], r["content"], r["language"], r["action"]) for r in first.collect()} == {("a", "new", "x", "updated"), ("b", "old", "x", "kept"), ("c", "new", "y", "inserted")}
    again = merge.upsert_chunks(first.drop("action"), source)
    assert sorted(map(repr, again.drop("action").collect())) == sorted(map(repr, first.drop("action").collect()))


def test_fact_upsert_rules(spark):
    facts = "id long, project_id int, title string, content_hash string, status string, kind string"
    stored = spark.createDataFrame([(1, 1, "A", "h1", "accepted", "k"), (2, 1, "B", "h2", "candidate", "k"), (3, 1, "C", "h3", "rejected", "k"), (4, 2, "A", "h1", "accepted", "k")], facts)
    chunks = spark.createDataFrame([(10, 1)], "id long, project_id int")
    cands = spark.createDataFrame([(100, 10, "b", "h1"), (101, 10, "C", "h3"), (102, 99, "x", "y")], "cand_id long, chunk_id long, title string, content_hash string")
    got = sorted((r["cand_id"], r["id"], r["status"], r["action"], r["reported"]) for r in merge.upsert_facts(stored, cands, chunks).collect())
    assert got == [(100, 1, "accepted", "updated", True), (100, 2, "candidate", "updated", False), (101, None, "candidate", "inserted", True), (102, None, None, "skipped", True)]
    assert {r["action"]: r["n"] for r in merge.action_counts(merge.upsert_facts(stored, cands, chunks)).collect()} == {"updated": 1, "inserted": 1, "skipped": 1}


def test_orphans(spark):
    chunks = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 2, "b")], "id long, project_id int, file_path string")
    left = lambda present: sorted(r["id"] for r in merge.delete_orphans(chunks, spark.createDataFrame(present, "file_path string"), 1).collect())
    assert left([("a",)]) == [1, 3] and left([]) == [1, 2, 3]


class Few:
    """A chunk in a project of two workspaces."""

    def __init__(self, spark):
        self.spark = spark
        self.workspaces = spark.createDataFrame([("w1", "w1"), ("w2", "w2"), ("w3", "w3")], "id string, name string")
        self.projects = spark.createDataFrame([(1, "p", "/a/p"), (2, "q", "/a/q")], "id int, name string, root_path string")
        self.workspace_projects = spark.createDataFrame([("w1", 1), ("w2", 1)], "workspace_id string, project_id int")
        self.chunks = spark.createDataFrame([(7, 1, "f", "c", "h", "en", None, None)], CHUNK).withColumns({"chunk_type": F.lit("file"), "symbol_name": F.lit(None).cast("string")})
        facts = "id long, project_id int, status string, evidence string, {} string"
        self.rules = spark.createDataFrame([(1, 1, "candidate", " ", None)], facts.format("source_file"))
        self.knowledge = spark.createDataFrame([], facts.format("source"))
        self.chunks_text, self.rules_text, self.knowledge_text = self.chunks, self.rules, self.knowledge


def test_fan_out_is_not_counted_twice(spark):
    t = Few(spark)
    assert {(r["name"], r["projects"], r["chunks"], r["business_rules"]) for r in reports.workspace_summary(t).collect()} == {("w1", 1, 1, 1), ("w2", 1, 1, 1), ("w3", 0, 0, 0)}
    assert {(r["name"], r["workspaces"], r["chunks"]) for r in reports.project_summary(t).collect()} == {("p", "w1 | w2", 1), ("q", "", 0)}
    assert reports.overview(t).head()["chunks"] == 1 and reports.overview(t, None, "w1/p").head()["projects"] == 1 and reports.overview(t, "w3").head()["chunks"] == 0
    h = reports.health(t).head()
    assert (h["projects_without_chunks"], h["business_rules_without_evidence"], h["business_rules_without_source"], h["candidate_knowledge"]) == (1, 1, 1, 0)
    assert [r["project_id"] for r in scope.scope_ids(t, " w2/p ").collect()] == [1] and scope.scope_ids(t, " ") is None


def test_facts_carry_whole_texts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    told = {r["doc_id"]: r["text"] for r in t.raw("documents").collect()}
    for rows, body in ((t.rules_text, "description"), (t.knowledge_text, "content")):
        found = {r["id"]: r[body] for r in rows.collect()}
        assert found and found == {k: told[k] for k in found}
    late = t.rules_text.filter("length(description) > 400").orderBy("id").head()
    word = next(w for w in late["description"][200:].split()[1:-1] if w.isascii() and w.isalpha() and len(w) > 5 and w.lower() not in late["description"][:200].lower())
    assert late["id"] in {r["id"] for r in search.text_topk(t.rules_text, search.fact_text("description"), word, 1000).collect()}


def test_prefixes_and_suffixes(spark):
    paths = spark.createDataFrame([("/a/b/c",), ("/a/bc",), ("/x",)], "path string")
    assert sorted(r[0] for r in predicates.anti_prefix(paths, spark.createDataFrame([("/a/b",)], "folder string")).collect()) == ["/a/bc", "/x"]
    roots = spark.createDataFrame([("/A", 2), ("/a/b", 1)], "root string, position int")
    assert {r["path"]: r["root"] for r in predicates.prefix_assign(paths, roots).collect()} == {"/a/b/c": "/a/b", "/a/bc": "/a/b", "/x": None}
    symbols = spark.createDataFrame([("N.Foo.Run", 2), ("N.Bar.XRun", 1)], "full_name string, seq int")
    wanted = spark.createDataFrame([("Run",), ("None",)], "name string")
    assert {r["name"]: r["full_name"] for r in graph.suffix_join(wanted, symbols).collect()} == {"Run": "N.Bar.XRun", "None": None}
    assert {r["name"]: r["full_name"] for r in graph.suffix_join(wanted, symbols, exact_segment=True).collect()} == {"Run": "N.Foo.Run", "None": None}


def test_names_of_more_lengths_than_a_plan_lists(spark):
    whole = "".join(chr(97 + k * k % 23) for k in range(1100))
    ends = spark.range(1, 1101).select(F.right(F.lit(whole), F.col("id").cast("int")).alias("name"))
    found = graph.suffix_join(ends, spark.createDataFrame([(whole, 1)], "full_name string, seq int"))
    assert found.filter(F.col("full_name") == whole).count() == 1100
    roots = spark.range(1, 1101).select(F.left(F.lit(whole), F.col("id").cast("int")).alias("root"), (1101 - F.col("id")).alias("position"))
    paths = roots.select(F.col("root").alias("path"))
    assert predicates.prefix_assign(paths, roots).filter("path = root").count() == 1100


def test_closure(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "source_id long, target_id long")
    assert {tuple(r) for r in graph.closure(edges).collect()} == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)}


def test_configuration(spark, tmp_path):
    path = str(tmp_path / "c.json")
    made = config.edit_config(config.edit_config({}, "add", "Main", "P", "/p"), "add", "other")
    made = config.edit_config(made, "use", "MAIN")
    config.save_json(made, path)
    assert json.load(open(path)) == config.load_json(path, None) == made and made["activeWorkspace"] == "Main" and config.load_json(path + "x", 3) == 3
    assert sorted(map(tuple, config.flattened(config.read_config(spark, path)).collect()), key=repr) == [("Main", "P", "/p", True), ("other", None, None, False)]
    assert config.edit_config(made, "remove", "main")["activeWorkspace"] == "other"


def test_source_tree(spark, tmp_path):
    body = "class A { }"
    for name, text in {"a/A.cs": body, "a/bin/B.cs": body, "a/note.txt": "x", "a/Mig.cs": "class M : Migration {}", "a/T.cs": "using Xunit; [Fact]", "t/T.Tests.csproj": "<Project/>", "t/In.cs": body, "a/big.md": "x" * 512_001, "a/ok.md": "# hi"}.items():
        file = tmp_path / "tree" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    found = {r["path"].rsplit("/", 1)[1]: r["language"] for r in files.read_tree(spark, str(tmp_path / "tree")).collect()}
    assert found == {"A.cs": "csharp", "ok.md": "markdown"}


def test_watch(spark, tmp_path):
    events = spark.createDataFrame([("a", None), ("a", None), ("b", "c")], "path string, old_path string")
    assert sorted(r[0] for r in watch.changed_paths(events).collect()) == ["a", "b", "c"]
    fresh = spark.createDataFrame([(3, 1, "a", "new", "h9", "y", None, None)], CHUNK)

    def after(folder, **how):
        store = ChunkStore(spark, str(tmp_path / folder), buckets=4)
        store.write(spark.createDataFrame([(1, 1, "a", "old", "h1", "x", None, None), (2, 1, "c", "old", "h2", "x", None, None)], CHUNK))
        watch.apply_batch(watch.changed_paths(events), store, lambda paths: fresh, 1, **how)
        return sorted((r["file_path"], r["content_hash"]) for r in store.read().collect())

    assert after("s1") == [("a", "h1"), ("a", "h9"), ("c", "h2")] and after("s2", delete_vanished=True) == [("a", "h1"), ("a", "h9")]
    events.select("path").write.parquet(str(tmp_path / "in"))
    seen = []

    def handle(paths, number):
        seen.extend(r[0] for r in paths.collect())
        raise ValueError("passed over")

    stream = spark.readStream.schema("path string").parquet(str(tmp_path / "in"))
    watch.watch(stream, handle, str(tmp_path / "state"), once=True).awaitTermination()
    assert sorted(seen) == ["a", "b"]


def test_schema_and_migrations(spark):
    required = schemas.required_columns(spark)
    assert required.count() == sum(len(s) for s in schemas.TABLES.values())
    assert schemas.check_summary(schemas.schema_check(required, required)).head()["all_ok"]
    known = spark.createDataFrame([("001",)], "name string")
    assert [r["name"] for r in schemas.pending_migrations(spark.createDataFrame([("002", "b"), ("001", "changed"), ("003", "c")], "name string, content string"), known).collect()] == ["002", "003"]


def test_engine(spark, sf_dir):
    engine = Engine(Tables(spark, sf_dir))
    assert 0 < engine.search_code("thble", 5, max_content_chars=200).count() <= 5
    assert max(len(r["content"]) for r in engine.search_code("thble", 5, max_content_chars=200).collect()) <= 203
    assert engine.search("thble", 3).count() == 3 and engine.search_business_rules("the").count() > 0 and engine.search_knowledge("the").count() > 0 and engine.find_related_files("thble", 3).count() == 3
    assert engine.get_symbol_callers("_1").count() > 0 and engine.get_symbol_callees("_1").count() > 0 and engine.get_class_hierarchy("_1").count() > 0
    assert engine.extraction_stats("en").head()["total_chunks"] > 0 and engine.overview().head()["chunks"] == 200 and engine.health().count() == 1 and engine.file_content("1.txt").count() > 0


def test_embedding_cache():
    asked = []
    cache = embedding.QueryCache(lambda t: asked.append(t) or [1.0], most=2)
    for t in ("a", "a", "b", "c", "a"):
        cache(t)
    assert asked == ["a", "b", "c", "a"]
    tries = []

    def flaky(x):
        tries.append(x)
        if len(tries) < 3:
            raise OSError
        return x

    assert embedding.with_retries(flaky, base=0)(5) == 5 and len(tries) == 3


def test_package_reaches_workers(spark, monkeypatch):
    from skein.sources import shipping

    added = []
    monkeypatch.setattr(type(spark.sparkContext), "addPyFile", lambda self, path: added.append(path))
    monkeypatch.setattr(shipping, "_shipped", set())
    monkeypatch.setenv("PYTHONPATH", str(shipping.ROOT))
    shipping.ship(spark)
    assert not added
    monkeypatch.setenv("PYTHONPATH", "")
    shipping.ship(spark)
    shipping.ship(spark)
    assert len(added) == 1


def test_a_session_that_spans_micro_batches_is_told_once(spark, tmp_path):
    at = lambda s: f"2024-01-01 00:00:{s:06.3f}"
    batches = [[("a", at(1.0)), ("a", at(1.2)), ("b", at(1.1))], [("a", at(1.6)), ("a", at(1.9)), ("b", at(3.0))], [("a", at(1.0)), ("c", at(30.0))]]
    seen = []
    for batch in batches:
        spark.createDataFrame(batch, "path string, at string").selectExpr("path", "CAST(at AS TIMESTAMP) AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        told = watch.debounced(spark.readStream.schema("path string, ts timestamp").parquet(str(tmp_path / "in")))
        told.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        seen.append(sorted((r["path"], r["start"].second + r["start"].microsecond / 1e6, r["events"]) for r in spark.read.schema("path string, start timestamp, end timestamp, events long").parquet(str(tmp_path / "out")).collect()))
    assert seen[0] == [] and seen[1] == [("a", 1.0, 4), ("b", 1.1, 1)]
    assert seen[2] == [("a", 1.0, 4), ("b", 1.1, 1), ("b", 3.0, 1)]  # the late event of a is dropped, c is still open


def test_listing_changes(spark):
    listing = lambda rows: spark.createDataFrame(rows, "path string, content_hash string")
    before = listing([("same", "1"), ("edited", "2"), ("gone", "3"), ("old name", "4"), ("twin a", "5"), ("twin b", "5"), ("unknown", None), ("lost", None)])
    after = listing([("same", "1"), ("edited", "9"), ("new", "7"), ("new name", "4"), ("twin c", "5"), ("unknown", None), ("found", None), ("swapped", "2")])
    found = {tuple(r) for r in changes.listing_changes(before, after).collect()}
    assert found == {("changed", "edited", None), ("deleted", "gone", None), ("created", "new", None), ("renamed", "new name", "old name"), ("deleted", "twin a", None), ("deleted", "twin b", None), ("created", "twin c", None),
                     ("changed", "unknown", None), ("deleted", "lost", None), ("created", "found", None), ("created", "swapped", None)}
    assert {r[0] for r in watch.changed_paths(changes.listing_changes(before, after)).collect()} >= {"new name", "old name"}
    assert changes.listing_changes(before, before.filter("content_hash IS NOT NULL").unionByName(before.filter("content_hash IS NULL"))).count() == 2  # without a hash nothing tells that they are the same
