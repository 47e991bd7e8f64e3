"""Shorter code for a reader: heads of licences, imports, verbose comments and other methods' bodies are left out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from skein.functions.batches import texts

#: Marks that stand for what is left out, and what tells a licence, an import and a method.
LICENCE_MARK, IMPORT_MARK, BODY_MARK = "// [license header omitted]", "// [usings omitted]", "/* body omitted */ }"
LICENCE = re.compile(r"(?i)copyright|license|all\s+rights\s+reserved|auto-generated|created\s+by\s+code\s+generator")
IMPORT = re.compile(r"using\s+[A-Za-z0-9_.]+;")
XML_TAGS = ("/// <summary>", "/// <param", "/// <returns>", "/// </summary>")
MODIFIERS = ("public ", "private ", "internal ", "protected ", "async ", "static ")
NOT_METHODS = ("class ", "interface ", "record ", "namespace ")
HEAD, FEW, LONG = 35, 3, 120


def licence_lines(lines: list[str]) -> set[int]:
    """Comment lines at the top from the first that tells a licence on."""
    out: set[int] = set()
    for k, line in enumerate(lines[:HEAD]):
        text = line.strip()
        if text.startswith(("//", "/*", "*")):
            if out or LICENCE.search(text):
                out.add(k)
        elif text:
            break
    return out


def is_method(line: str) -> bool:
    return line.startswith(MODIFIERS) and "(" in line and ")" in line and not any(w in line for w in NOT_METHODS)


def simple_name(symbol: str) -> str:
    return symbol.split("(")[0].split("<")[0].rsplit(".", 1)[-1].strip()


def end_of_body(lines: list[str], opened: int) -> int:
    """The line on which the brace opened at the end of a line is closed."""
    depth = 1
    for k in range(opened + 1, len(lines)):
        depth += lines[k].count("{") - lines[k].count("}")
        if depth <= 0:
            return k
    return len(lines)


def compress_code(content: str | None, symbol: str | None = None) -> str | None:
    """Up to FEW imports stay, unless nothing follows them; blank texts come back as they are."""
    if not content or not content.strip():
        return content
    lines, wanted = content.split("\n"), simple_name(symbol).lower() if (symbol or "").strip() else None
    licence, out, imports, k = licence_lines(lines), [], [], 0
    while k < len(lines):
        line, text = lines[k].rstrip(), lines[k].strip()
        if k in licence:
            out += [LICENCE_MARK] if k == min(licence) else []
        elif IMPORT.fullmatch(text):
            imports.append(line)
        else:
            out += [IMPORT_MARK] if len(imports) > FEW else imports
            imports = []
            rest = text[4:].strip() if text.startswith("/// ") else ""
            if text.startswith(XML_TAGS):
                pass
            elif len(rest) > LONG:
                out.append(f"/// {rest[: LONG - 3]}...")
            elif wanted is not None and is_method(text) and wanted not in text.lower() and text.endswith("{"):
                out.append(f"{line} {BODY_MARK}")
                k = end_of_body(lines, k)
            elif wanted is not None and is_method(text) and wanted not in text.lower() and k + 1 < len(lines) and lines[k + 1].strip() == "{":
                out.append(f"{line} {{ {BODY_MARK}")
                k = end_of_body(lines, k + 1)
            else:
                out.append(line)
        k += 1
    out += [IMPORT_MARK] if len(imports) > FEW else []
    kept = [x for x, before in zip(out, [None, *out], strict=False) if x.strip() or before is None or before.strip()]
    return "\n".join(x if x.strip() else "" for x in kept).strip()


@F.arrow_udf(StringType())
def compressed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """compress_code of content and symbol, one portion of texts at a time."""
    for part in texts((pa.RecordBatch.from_arrays(list(pair), ["content", "symbol"]) for pair in batches), "content"):
        yield pa.array([compress_code(c, s) for c, s in zip(*(x.to_pylist() for x in part.columns), strict=True)], pa.string())
