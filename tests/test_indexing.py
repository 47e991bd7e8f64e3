from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skein.__main__ import index, main
from skein.api import Engine
from skein.operators import extraction, indexing
from skein.sources.snapshot import Snapshot

ORDER = 'namespace Shop;\npublic class Order : Base\n{\n    public void Pay() { throw new BusinessException("Pedido deve ter um cliente"); }\n    void Send() { Pay(); }\n}\npublic class Base { public int Id { get; set; } /* some more text to be long enough */ }\n'


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "shop"
    (root / "src").mkdir(parents=True)
    (root / "src/Order.cs").write_text(ORDER)
    (root / "notes.md").write_text("# Payment\nWe use Kafka for the payment messages. TODO: check it.\n")
    return root


def test_index_search_and_reindex(spark, tree, tmp_path):
    tables = Snapshot(spark, str(tmp_path / "tables"))
    assert tables.chunks.count() == 0
    index(tables, str(tree), "shop", "main", ["chunks", "rules", "knowledge"])
    assert {(r["file_path"], r["chunk_type"], r["symbol_name"]) for r in tables.chunks.collect()} == {("src/Order.cs", "type", "Shop.Order"), ("src/Order.cs", "type", "Shop.Base"), ("notes.md", "section", "Payment")}
    assert {(r["title"], r["status"]) for r in tables.rules.collect()} == {("Pedido deve ter um cliente", "candidate"), ('public void Pay() { throw new BusinessException("Pedido deve ter um cliente"); }', "candidate")}
    assert {r["kind"] for r in tables.knowledge.collect()} == {"integration", "technical_risk"}
    assert {(r["kind"], r["full_name"]) for r in tables.symbols.collect()} >= {("class", "Shop.Order"), ("method", "Shop.Order.Pay"), ("property", "Shop.Base.Id")}
    engine = Engine(tables)
    assert engine.search_code("payment kafka", 3).head()["file_path"] == "notes.md"
    assert {(r["symbol"], r["relation"]) for r in engine.get_symbol_callers("Order.Pay").collect()} == {("Shop.Order.Send", "calls")} and engine.get_class_hierarchy("Shop.Order").head()["parent"] == "Shop.Base"
    assert engine.extraction_stats("main").head()["actionable_candidate_chunks"] == 0 and engine.overview().head()["chunks"] == 3
    (tree / "notes.md").unlink()
    accepted = tables.rules.withColumn("status", F.lit("accepted"))
    tables.write("rules", accepted)
    index(tables, str(tree), "shop", "main", ["chunks", "rules"], refresh=True)
    assert {r["file_path"] for r in tables.chunks.collect()} == {"src/Order.cs"} and {r["status"] for r in tables.rules.collect()} == {"accepted"} and tables.rules.count() == 2


def test_command_line(spark, tree, tmp_path, capsys):
    where = ["--tables", str(tmp_path / "t")]
    assert main([*where, "index", str(tree), "chunks", "--project", "shop"]) == 0 and main([*where, "search", "kafka", "-k", "1"]) == 0 and main([*where, "doctor"]) == 0 and main([*where, "report", "overview"]) == 0
    assert "notes.md" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main([*where, "index", str(tree), "nonsense", "--project", "shop"])


def test_state_and_model_replies(spark):
    state = spark.createDataFrame([], "id long, chunk_id long, stage string, content_hash string, status string, processed_at timestamp, error string, updated_at timestamp")
    chunks = spark.createDataFrame([(1, "p", "f", None, "O pedido deve ter um cliente", "h", "csharp", "type")], "id long, project string, file_path string, symbol_name string, content string, content_hash string, language string, chunk_type string")
    failed = indexing.mark_state(state, chunks, "rules", datetime(2024, 1, 1), "x" * 3000)
    assert [(r["status"], len(r["error"])) for r in failed.collect()] == [("failed", 2000)]
    assert [r["status"] for r in indexing.mark_state(failed, chunks, "rules", datetime(2024, 1, 2)).collect()] == ["processed"]
    reply = '{"rules": [{"title": "Pedido deve ter cliente", "description": "O pedido deve ter um cliente", "evidence": "pedido deve ter", "confidence": 7}, {"title": "Invented rule deve", "description": "O pedido deve ter nada", "evidence": "not in the chunk"}]}'
    replies = extraction.generated(chunks, lambda p: reply if "pedido" in p else "", extraction.rules_prompt())
    found = indexing.fact_candidates(chunks, "rules", replies).collect()
    assert {(r["title"], str(r["confidence"])) for r in found} == {("Pedido deve ter cliente", "0.95"), ("O pedido deve ter um cliente", "0.64")}
    known = '{"knowledge": [{"kind": "Pattern", "title": "Usa pedidos", "content": "Trata de pedidos", "evidence": "O pedido deve"}]}'
    found = indexing.fact_candidates(chunks, "knowledge", extraction.generated(chunks, lambda p: known, extraction.knowledge_prompt())).collect()
    assert [(r["kind"], r["title"], str(r["confidence"])) for r in found] == [("pattern", "p: Usa pedidos", "0.70")]


def test_relations_scan_the_files_once(spark):
    """the symbols of all files are read several times, but scanned once."""
    from skein.operators import chunking

    text = "namespace A;\nclass B : C {\n  void Go() { Stop(); }\n  void Stop() { }\n}\ninterface C { }\n"
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: (seen.add(1), x)[1]).asNondeterministic()
    found = chunking.build_relations(chunking.build_symbols(spark.createDataFrame([("p", text)], "path string, content string").select("path", count("content").alias("content"))))
    assert {tuple(r) for r in found.collect()} == {("A.B", "A.C", "implements"), ("A.B.Go", "A.B.Stop", "calls")}
    assert seen.value == 1
