import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import chunking, compress, extraction, predicates
from skein.operators.scope import clamp


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).head()[0]


def test_normalising(spark):
    assert one(spark, X.normal_sentence(F.col("x")), x="  hello   world\twith\nnewlines  ") == "hello world with newlines"
    assert one(spark, X.normal_sentence(F.col("x")), x="\"'hello world.';,") == "hello world"
    assert one(spark, X.to_title(F.col("x"), 5), x="hello world") == "hello..." and one(spark, X.to_title(F.col("x"), 6), x="hello world") == "hello..."
    assert one(spark, X.normal_key(F.col("x")), x=" A  b ") == "a b"
    assert one(spark, X.looks_like_rule(F.col("x")), x="O cliente não pode comprar") and not one(spark, X.looks_like_rule(F.col("x")), x="Nothing to see here") and not one(spark, X.looks_like_rule(F.col("x")), x="deve")
    assert one(spark, X.truncated(F.col("x"), 3), x="abcd") == "abc..." and one(spark, X.truncated(F.col("x"), 4), x="abcd") == "abcd"
    assert one(spark, F.sha2("x", 256), x="") == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize(("language", "symbol", "want"), [
    ("csharp", "Foo", "[CONTEXT: Project: p | File: f | Lang: C# | Symbol: Foo | ChunkType: type]\nbody"), ("csharp", "", "[CONTEXT: Project: p | File: f | Lang: C# | ChunkType: type]\nbody"), ("sql", "x", "[CONTEXT: Project: p | File: f | Lang: SQL | Symbol: x]\nbody"),
    ("markdown", "Head", "[CONTEXT: Project: p | File: f | Lang: Markdown | Section: Head]\nbody"), ("json", "x", "[CONTEXT: Project: p | File: f | Lang: json]\nbody"), (None, None, "[CONTEXT: Project: p | File: f]\nbody"),
])
def test_context(spark, language, symbol, want):
    df = spark.createDataFrame([("p", "f", language, symbol, "type", "body")], "p string, f string, l string, s string, t string, c string")
    assert df.select(X.contextual(*map(F.col, "pflstc"))).head()[0] == want


def test_compression():
    usings = "".join(f"using A{k};\n" for k in range(4))
    assert compress.compress_code(usings + "class X {}") == "// [usings omitted]\nclass X {}"
    assert compress.compress_code("using A;\nusing B;\nclass X {}") == "using A;\nusing B;\nclass X {}" and compress.compress_code("using A;\nusing B;") == ""
    assert compress.compress_code("// Copyright me\n// more\nclass X {}") == "// [license header omitted]\nclass X {}"
    assert compress.compress_code("") == "" and compress.compress_code("  ") == "  " and compress.compress_code(None) is None and compress.compress_code("int x = 1;") == "int x = 1;"
    assert compress.compress_code("a\n\n \n\nb") == "a\n\nb"
    code = "public void Alpha() {\n  x();\n}\npublic void Beta()\n{\n  if (y) { z(); }\n}\nint c;"
    assert compress.compress_code(code, "N.T.Beta(int)") == "public void Alpha() { /* body omitted */ }\npublic void Beta()\n{\n  if (y) { z(); }\n}\nint c;"
    assert compress.compress_code(code, "N.Alpha") == "public void Alpha() {\n  x();\n}\npublic void Beta() { /* body omitted */ }\nint c;"
    assert len(compress.compress_code("/// " + "d" * 200 + "\nx").split("\n")[0]) == 4 + 117 + 3 and compress.compress_code("/// <summary>\n/// text\n/// </summary>\nx") == "/// text\nx"


def test_chunkers():
    (kind, symbol, content, digest), = chunking.chunks_of("namespace A.B;\npublic class Foo\n{\n  public int X { get; set; }\n}\n", "csharp")
    assert kind == "type" and symbol == "A.B.Foo" and content.startswith("public class Foo") and digest == hashlib.sha256(content.encode()).hexdigest()
    assert not list(chunking.chunks_of("", "csharp"))
    (kind, symbol, _, _), = chunking.chunks_of("create procedure dbo.MyProc as select 1 from a_table where b = 2", "sql")
    assert (kind, symbol) == ("procedure", "dbo.MyProc")
    body = "some words that make the section long enough\n"
    assert [c[:2] for c in chunking.chunks_of(f"lost text\n# One\n{body}## Two\n{body}", "markdown")] == [("section", "One"), ("section", "Two")]
    parts = [c[2] for c in chunking.chunks_of("\n".join("x" * 100 for _ in range(70)), "json")]
    assert len(parts) > 1 and all(len(p) <= 6000 for p in parts)
    assert [len(p) for p in chunking.split_by_size("y" * 13_000)] == [6000, 6000, 1000]
    assert [c[0] for c in chunking.chunks_of("select a from b where c = 1 and d = 2 and e = 3\nGO\n \ngo\nselect f from g where h = 1 and i = 2 and j = 3", "sql")] == ["sql", "sql"]


def test_long_type_by_member():
    members = "".join(f"    public void M{k}(int a)\n    {{\n        Call({k}); // }} not a brace\n        var s = \"{{\";\n    }}\n" for k in range(120))
    found = list(chunking.chunks_of(f"using System;\nnamespace N\n{{\n  public class Big\n  {{\n{members}  }}\n}}\n", "csharp"))
    assert len(found) == 120 and found[0][:2] == ("member", "N.Big.M0(int a)") and found[0][2].startswith("using System;") and "namespace N;" in found[0][2]


def test_symbols():
    code = "namespace N;\npublic interface IThing { void Go(); }\npublic class Base { }\npublic class Thing : Base, IThing\n{\n  public string Name { get; set; }\n  public void Go() { Help(1); }\n  void Help(int x) => x.ToString();\n}\n"
    found = list(chunking.symbols_of(code))
    assert [(s[0], s[1]) for s in found] == [("interface", "N.IThing"), ("method", "N.IThing.Go"), ("class", "N.Base"), ("class", "N.Thing"), ("property", "N.Thing.Name"), ("method", "N.Thing.Go"), ("method", "N.Thing.Help")]
    assert found[3][4] == ["Base", "IThing"] and "Help" in found[5][5] and found[3][2:4] == (4, 9)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=600), st.integers(300, 400))
def test_splitter_keeps_order(text, most):
    at = 0
    for part in chunking.split_by_size(text, most):
        assert 40 <= len(part) <= most and text.find(part, at) >= at
        at = text.find(part, at)


def test_wildcards(spark):
    df = spark.createDataFrame([("a/use_case/x",), ("a/useXcase/x",), ("100%",), ("a\\b",), (None,)], "x string")
    hit = lambda c: [r[0] for r in df.filter(c).collect()]
    assert hit(predicates.ilike_any(F.col("x"), ["use_case"])) == ["a/use_case/x", "a/useXcase/x"] and hit(predicates.ilike_any(F.col("x"), ["a\\b"])) == ["a\\b"] and hit(predicates.ilike_any(F.col("x"), [])) == []
    assert hit(predicates.suffix_match(F.col("x"), "case/X")) == ["a/use_case/x", "a/useXcase/x"] and hit(predicates.suffix_match(F.col("x"), "a\\b")) == ["a\\b"]
    assert len(hit(predicates.multi_contains([F.col("x")], " "))) == 5 and df.select(predicates.ilike_any(F.col("x"), ["a", "a_b%"])).collect()[4][0] is None


def test_lenient_json(spark):
    replies = [
        '{"RULES": [{"Title": "a,]", /* c */ "confidence": 1,},], // x\n}', "no", None, "[]", '{"rules": 3}', "", '{"rules": null}', '{"Rules": ["x", 3, null, {"TITLE": "b // \\" /* no */", "title": "last", "confidence": "0.5"}]}',
        '{"rules": [{"title": null, "evidence": 7, "confidence": 0.25, "content": {"a": [1]}}], "more": {"x": 1}}', '{"rules": [{"title": "' + "long \\n" * 300_000 + '"}]}', '{"rules": [', '{"other": []}',
    ]
    rows = spark.createDataFrame(list(enumerate(replies)), "id long, reply string")
    found = {r["id"]: [(i["title"], i["evidence"], i["content"], i["confidence"]) for i in r["items"]] for r in extraction.parsed_replies(rows, "rules").collect()}
    assert found[0] == [("a,]", None, None, 1.0)] and found[7] == [("last", None, None, None)] and found[8] == [(None, "7", '{"a":[1]}', 0.25)] and found[9] == [("long \n" * 300_000, None, None, None)]
    assert all(found[k] == [] for k in (1, 2, 3, 4, 5, 6, 10, 11))


def test_matches_of_rules_stand_in_their_lines(spark):
    code = 'a(); x.WithMessage("Campo um deve existir"); y.WithMessage("Campo dois deve existir");\nthrow new\n  BusinessException("Cliente\ndeve pagar sempre");\nx.WithMessage("Campo um deve existir"); // later\n'
    rows = spark.createDataFrame([(1, "p", "f", None, code), (2, "p", "f", None, None), (3, "p", "f", None, "")], "id long, project string, file_path string, symbol_name string, content string")
    found = {r["title"]: (r["evidence"], str(r["confidence"])) for r in extraction.extract_rules(rows, line_words=("nothing",)).collect()}
    first = 'a(); x.WithMessage("Campo um deve existir"); y.WithMessage("Campo dois deve existir")'
    assert found == {"Campo um deve existir": (first, "0.78"), "Campo dois deve existir": (first, "0.78"), "Cliente deve pagar sempre": ("throw new", "0.88")}


def test_rules_of_lines(spark):
    rows = spark.createDataFrame([(1, "p", "f", None, 'x = 1\n  O pedido deve ter um cliente valido.\nthrow new BusinessException("Cliente Bloqueado não pode");\nnada')], "id long, project string, file_path string, symbol_name string, content string")
    found = {(r["title"], str(r["confidence"])) for r in extraction.extract_rules(rows).collect()}
    assert found == {("Cliente Bloqueado não pode", "0.88"), ("O pedido deve ter um cliente valido", "0.64"), ('throw new BusinessException("Cliente Bloqueado não pode")', "0.64")}


def test_clamp():
    assert clamp(None, 10, 1, 50) == 10 and clamp(0, 10, 1, 50) == 1 and clamp(99, 10, 1, 50) == 50


def test_blanks_and_marks_at_ends(spark):
    blanks = "".join(chr(k) for k in range(0x3100) if chr(k).isspace() and k not in range(0x1C, 0x20))
    texts = [f"{blanks}a b{blanks}", "a \n b", "a b", " \"',a.b;'\n", "", blanks, "x", None, "a\r\nb  c\x1cd", "'\"  q"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, x string")
    old = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    found = rows.select(
        X.trimmed(F.col("x")), F.regexp_replace("x", r"(?U)^\s+|\s+$", ""), X.squeezed(F.col("x")), old("x"), X.normal_sentence(F.col("x")), F.regexp_replace(old("x"), "^[\"'.;,]+|[\"'.;,]+$", ""),
        X.normal_evidence(F.col("x")), F.regexp_replace(old("x"), "^[\"']+|[\"']+$", "")).collect()
    assert all(r[k] == r[k + 1] for r in found for k in (0, 2, 4, 6))


def test_texts_are_read_once_and_not_shuffled_for_projects(spark):
    """one parse of a reply, and projects that are broadcast."""
    from skein.fixtures import Tables
    from skein.plans import queries

    told = spark.createDataFrame([(1, "{}")], "id long, reply string")
    chunks = spark.createDataFrame([(1, "p", "c", "f", "s")], "id long, project string, content string, file_path string, symbol_name string")
    for found in (extraction.semantic_rules(chunks, told), extraction.semantic_knowledge(chunks, told)):
        assert found._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") + found._jdf.queryExecution().optimizedPlan().toString().lower().count("parse_json") == 1
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries._code(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
