"""Cutting source files into chunks. The scanners are sequential, so they run over Arrow batches of whole files."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.batches import texts
from skein.sources.folders import scratch_dir

MOST, LEAST, HEAD = 6_000, 40, 200
#: The patterns of headings, batch ends and routines.
HEADING = re.compile(r"(?m)^#{1,3}\s+(.+)$")
BATCH = re.compile(r"(?im)^\s*GO\s*$")
ROUTINE = re.compile(r"(?i)\b(?:create|alter)\s+(procedure|proc|view|function|trigger)\s+([\[\]\w.]+)")
Piece = tuple[str, str | None, str]


def split_by_size(text: str, most: int = MOST) -> Iterator[str]:
    """Windows of most characters, each ended after its last line end if that is far enough in; short ones go."""
    at = 0
    while at < len(text):
        end = min(at + most, len(text))
        if end < len(text):
            line = text.rfind("\n", at, end)
            end = line + 1 if line > at + HEAD else end
        if len(part := text[at:end].strip()) >= LEAST:
            yield part
        at = end


def markdown_sections(text: str) -> Iterator[Piece]:
    """From each heading of up to three marks to the next; what stands before the first goes."""
    heads = list(HEADING.finditer(text))
    if not heads:
        yield from (("markdown", None, p) for p in split_by_size(text))
    for head, end in zip(heads, [*(h.start() for h in heads[1:]), len(text)], strict=False):
        yield "section", head[1].strip(), text[head.start() : end]


def sql_batches(text: str) -> Iterator[Piece]:
    """Batches between GO lines, with the routine that each one makes."""
    for part in BATCH.split(text):
        if part.strip():
            m = ROUTINE.search(part)
            yield (m[1].lower(), m[2], part) if m else ("sql", None, part)


def masked_code(text: str) -> str:
    """C# text of the same length in which comments, strings and characters are blank."""
    token = re.compile(r'//[^\n]*|/\*.*?\*/|@"(?:[^"]|"")*"|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)+\'', re.S)
    return token.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


TYPE = re.compile(r"(?:\b(?:public|private|protected|internal|sealed|static|abstract|partial|readonly|file|new)\s+)*\b(class|interface|struct|enum|record(?:\s+(?:class|struct))?)\s+([A-Za-z_]\w*)([^{;]*)")
NAMESPACE = re.compile(r"\bnamespace\s+([\w.]+)\s*([;{])")
MEMBER = re.compile(r"([~A-Za-z_]\w*)\s*(?:<[\w\s,]*>)?\s*(\([^{};]*?\))?\s*(?:where[^{;]*|:\s*(?:base|this)\s*\([^{]*\))?\s*(\{|=>|=(?!=)|;)")
KEYWORDS = frozenset("if for foreach while switch catch lock using return new typeof nameof sizeof default await throw base this get set init add remove when else do try finally".split())


def closing(code: str, opening: int) -> int:
    """Where the brace at opening is closed; the end of the text if nowhere."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, opening):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return len(code) - 1


def csharp_types(text: str, code: str | None = None) -> list[dict]:
    """Type declarations with kind, names, bases, span and body; nested ones too (outer: the index of the outer type)."""
    code = masked_code(text) if code is None else code
    spaces = [(m.start(), m[1], len(code) if m[2] == ";" else closing(code, m.end() - 1)) for m in NAMESPACE.finditer(code)]
    found: list[dict] = []
    for m in TYPE.finditer(code):
        mark = code[m.end() : m.end() + 1]
        end = closing(code, m.end()) if mark == "{" else m.end()
        bases = re.sub(r"^[^:(]*(?:\([^)]*\))?[^:]*:", "", m[3], count=1) if ":" in m[3] else ""
        bases = re.sub(r"\bwhere\b.*", "", bases, flags=re.S)
        outer = next((k for k in range(len(found) - 1, -1, -1) if found[k]["start"] < m.start() <= found[k]["end"]), None)
        space = next((n for s, n, e in reversed(spaces) if s < m.start() <= e), "")
        found.append({"kind": m[1].split()[0], "name": m[2], "space": space, "bases": [b.strip() for b in re.split(r",(?![^<]*>)", bases) if b.strip()], "start": m.start(), "body": m.end() if mark == "{" else None, "end": end, "outer": outer})
    return found


def qualified(types: list[dict], k: int, nested: bool = True) -> str:
    parts, at = [types[k]["name"]], types[k]["outer"] if nested else None
    while at is not None:
        parts.append(types[at]["name"])
        at = types[at]["outer"]
    return ".".join([*([types[k]["space"]] if types[k]["space"] else []), *reversed(parts)])


def csharp_members(code: str, one: dict) -> list[dict]:
    """Members at the top level of a type's body, with name, kind, parameters and span."""
    if one["body"] is None:
        return []
    out, at = [], one["body"] + 1
    while at < one["end"]:
        m = re.compile(r"[;{]|=>").search(code, at, one["end"])
        if not m:
            break
        head = code[at : m.start()]
        if m[0] == "{":
            end = closing(code, m.start())
            follow = re.compile(r"\s*=[^;]*;").match(code, end + 1)
            end = follow.end() - 1 if follow else end
        else:
            stop = code.find(";", m.start(), one["end"])
            end = stop if stop >= 0 else one["end"] - 1
        plain = re.sub(r"^\s*(?:\[[^\]]*\]\s*)*", "", head)
        declared = TYPE.match(plain.lstrip())
        call = re.search(r"([~A-Za-z_]\w*|this|operator\s*\S+)\s*(?:<[^<>()]*>)?\s*([(\[].*[)\]])\s*(?:where.*|:.*)?$", plain.split("=", 1)[0] if "operator" not in plain else plain, re.S)
        word = re.search(r"([A-Za-z_]\w*)\s*(?:=.*)?$", plain, re.S)
        if declared:
            out.append({"name": declared[2], "kind": "type", "parameters": "", "start": at, "end": end + 1})
        elif call and call[1] not in KEYWORDS:
            out.append({"name": call[1], "kind": "method", "parameters": " ".join(call[2].split()), "start": at, "end": end + 1})
        elif word:
            out.append({"name": word[1], "kind": "property" if m[0] in ("{", "=>") else "field", "parameters": "", "start": at, "end": end + 1})
        at = end + 1
    return out


def csharp_chunks(text: str) -> Iterator[Piece]:
    """A type as one chunk, or one a member under usings, namespace and the type's head if it is long."""
    code = masked_code(text)
    types = csharp_types(text, code)
    if not types:
        yield from csharp_regex_chunks(text)
    usings = "\n".join(u.strip() for u in re.findall(r"(?m)^\s*(?:global\s+)?using\s+[^;(]+;", text))
    for k, one in enumerate(types):
        if one["outer"] is not None:
            continue
        start = text.rfind("\n", 0, one["start"]) + 1
        whole, name = text[start : one["end"] + 1].strip(), qualified(types, k)
        members = csharp_members(code, one)
        if len(whole) <= MOST or not members:
            yield "type", name, whole
            continue
        head = text[start : one["body"] + 1].strip()
        space = f"namespace {one['space']};" if one["space"] else ""
        for m in members:
            body = "\n\n".join(x for x in (usings, space, head, text[m["start"] : m["end"]].strip(), "}") if x)
            yield "type" if m["kind"] == "type" else "member", f"{name}.{m['name']}{m['parameters']}", body


#: Fixed value: the pattern of a declaration.
DECLARED = re.compile(r"(?m)^[ \t]*(?:(?:public|private|protected|internal|sealed|static|abstract|async|partial)\s+)+(class|interface|record|enum|struct|Task<[^>]+>|Task|void|[A-Za-z0-9_<>,]+)\s+([A-Za-z0-9_]+)\s*[(:{]")


def csharp_regex_chunks(text: str) -> Iterator[Piece]:
    """From each declaration to the next; without any, by size."""
    heads = list(DECLARED.finditer(text))
    if not heads:
        yield from (("file", None, p) for p in split_by_size(text))
    for head, end in zip(heads, [*(h.start() for h in heads[1:]), len(text)], strict=False):
        kind = "type" if head[1] in ("class", "record") else "member"
        body = text[head.start() : end]
        yield from ((kind, head[2], p) for p in (split_by_size(body) if len(body) > MOST else [body]))


SCANNERS: dict[str, Callable[[str], Iterator[Piece]]] = {"csharp": csharp_chunks, "sql": sql_batches, "markdown": markdown_sections}


def chunks_of(text: str, language: str | None) -> Iterator[tuple[str, str | None, str, str]]:
    """chunk_type, symbol_name, content, content_hash of each chunk of a file."""
    scan = SCANNERS.get(language or "", lambda t: (("file", None, p) for p in split_by_size(t)))
    for kind, symbol, content in scan(text):
        whole = content.strip()
        if len(whole) >= LEAST:
            for part in split_by_size(whole):
                yield kind, symbol, part, hashlib.sha256(part.encode()).hexdigest()


def scanned(rows: DataFrame, text: str, scan: Callable[[dict], Iterator[tuple]], schema: str) -> DataFrame:
    """What scan makes of each row (a dict), in batches of one portion of texts."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
    shape = pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts(batches, text):
            found = [made for row in batch.to_pylist() for made in scan(row)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*found, strict=True), shape, strict=True)], schema=shape)

    return rows.mapInArrow(run, schema)


def chunk_files(files: DataFrame) -> DataFrame:
    """files (path, language, content) as chunks, in order (seq)."""
    scan = lambda f: ((f["path"], f["language"], k, *c) for k, c in enumerate(chunks_of(f["content"] or "", f["language"])))
    return scanned(files.select("path", "language", "content"), "content", scan, "path string, language string, seq int, chunk_type string, symbol_name string, content string, content_hash string")


def split_documents(docs: DataFrame, most: int = MOST) -> DataFrame:
    """docs (id, content) as windows by size: id, seq, content."""
    scan = lambda d: ((d["id"], k, p) for k, p in enumerate(split_by_size((d["content"] or "").strip(), most)))
    return scanned(docs.select("id", "content"), "content", scan, "id long, seq int, content string")


def sections(docs: DataFrame, heading: str) -> DataFrame:
    """docs (id, content) cut at lines that fit a pattern: id, seq, heading, content; native, with the text before the
    first heading left out."""
    parts = F.split(F.col("content"), rf"(?m)^(?={heading})")
    rows = docs.select("id", F.posexplode(parts).alias("seq", "part")).filter(F.col("part").rlike(rf"\A(?:{heading})"))
    return rows.select("id", "seq", F.trim(F.substring_index("part", "\n", 1)).alias("heading"), F.col("part").alias("content"))


def symbols_of(text: str) -> Iterator[tuple[str, str, int, int, list[str], list[str]]]:
    """kind, full_name, first and last line, bases, invoked names of the types, methods and properties of a C# text."""
    code = masked_code(text)
    line = lambda k: text.count("\n", 0, k) + 1
    types = csharp_types(text, code)
    for k, one in enumerate(types):
        name = qualified(types, k, nested=False)
        yield one["kind"], name, line(one["start"]), line(one["end"]), one["bases"], []
        for m in csharp_members(code, one):
            if m["kind"] in ("method", "property") and m["name"] != one["name"]:
                start = m["start"] + len(code[m["start"] : m["end"]]) - len(code[m["start"] : m["end"]].lstrip())
                body = code[m["start"] : m["end"]].split("(", 1)[-1]
                calls = [c for c in re.findall(r"([A-Za-z_]\w*)\s*\(", body) if c not in KEYWORDS] if m["kind"] == "method" else []
                yield m["kind"], f"{name}.{m['name']}", line(start), line(m["end"] - 1), [], calls


def build_symbols(files: DataFrame) -> DataFrame:
    """files (path, content) as symbols, in order of path and place (seq)."""
    scan = lambda f: ((f["path"], k, *s) for k, s in enumerate(symbols_of(f["content"] or "")))
    found = scanned(files.select("path", "content"), "content", scan, "path string, place int, kind string, full_name string, line_start int, line_end int, bases array<string>, calls array<string>")
    return found.withColumn("seq", F.struct("path", "place"))


def build_relations(symbols: DataFrame) -> DataFrame:
    """source, target, relation: bases and calls, each resolved to the first symbol whose name ends in it. The symbols are
    stored first: they are read several times, and each time would scan all files again."""
    from skein.operators.graph import suffix_join

    told = symbols.select("full_name", "kind", "seq", "bases", "calls")
    told.write.option("compression", "zstd").parquet(folder := f"{scratch_dir(symbols.sparkSession)}/skein/symbols-{uuid.uuid4().hex}")
    symbols = symbols.sparkSession.read.schema(told.schema).parquet(folder)
    # each name once: the kind of its first symbol, and the place of the first that is a type
    first = F.min(F.when(F.col("kind").isin("class", "interface"), F.col("seq"))).alias("first")
    types = symbols.groupBy("full_name").agg(F.min_by("kind", "seq").alias("kind"), first).filter("first IS NOT NULL").withColumnRenamed("first", "seq")
    up = suffix_join(symbols.select(F.col("full_name").alias("source"), F.explode("bases").alias("name")), types, told=["kind"]).filter("full_name IS NOT NULL")
    up = up.select("source", F.col("full_name").alias("target"), F.when(F.col("kind") == "interface", "implements").otherwise("inherits").alias("relation"))
    methods = symbols.filter(F.col("kind") == "method").select("full_name", "seq")
    calls = suffix_join(symbols.select(F.col("full_name").alias("source"), F.explode("calls").alias("name")), methods, exact_segment=True).filter("full_name IS NOT NULL")
    return up.unionByName(calls.select("source", F.col("full_name").alias("target"), F.lit("calls").alias("relation"))).distinct()
