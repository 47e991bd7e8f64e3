"""Normalising, classifying and cutting text, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words that tell a sentence of a business rule.
RULE_WORDS = (
    "não pode", "nao pode", "deve", "obrigatório", "obrigatorio", "inválido", "invalido", "bloquead", "cancelad", "vencid", "ErroContext", "ErrosContext", "AdicionarErro", "AdicionaErro", "AddErro", "AddError", "AddFailure",
    "AddNotification", "Notificar", "RuleFor", "Elegivel", "Elegível", "Permite",
)
#: The words of a rule that a model wrote, and those of technical facts that are none.
SEMANTIC_WORDS = ("nao pode", "não pode", "deve", "obrigator", "invalid", "inválid", "invalido", "bloque", "cancel", "venc", "eleg", "permitid", "proibid", "restri", "valid", "status", "regra", "permiss", "limite")
TECHNICAL_WORDS = (
    "codigo corretor", "código corretor", "codigo representante", "código representante", "identificador unico", "identificador único", "const string", "public const", "permite obter", "permite buscar", "permite listar",
    "obtencao de", "obtenção de", "busca de", "consulta de", "retorna ", "criação de lista", "criacao de lista", "cria uma lista", "ienumerable", "task<ienumerable",
)
#: The words of a line worth reading.
LINE_WORDS = (
    "não pode", "nao pode", "deve", "obrigatório", "obrigatorio", "inválido", "invalido", "ErroContext", "ErrosContext", "AdicionarErro", "AdicionaErro", "AddErro", "AddError", "AddFailure",
    "AddNotification", "Notificar", "RuleFor", "Elegivel", "Elegível", "Permite", "Bloqueado", "Cancelado", "Vencido",
)
KINDS = ("integration", "pattern", "technical_risk", "architecture", "configuration")
#: White space other than single spaces, which stay as they are.
SPACES = r"(?U)\s{2,}|[\s&&[^ ]]"


#: What (?U)\\s stands for.
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is worked out once, however often use names it and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), use), 0)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Whether the lower-cased text holds any of the words, whatever their case. It is lower-cased once; a search of bytes a
    word takes a fraction of a pattern of all words, which tries each of them at every character."""
    return once(F.lower(text), lambda low: reduce(lambda a, b: a | b, (F.contains(low, F.lit(w.lower())) for w in words))) if words else F.lit(False)


def any_of(words: Sequence[str]) -> str:
    """A pattern that finds any of the words as they are, lower-cased."""
    return "|".join(re.sub(r"([^\w\s])", r"\\\1", w.lower()) for w in words)


def squeezed(text: Column) -> Column:
    """White space as single spaces, none at either end."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def trimmed(text: Column) -> Column:
    """No white space of any kind at either end."""
    return F.trim(text, F.lit(BLANKS))


def normal_sentence(text: Column) -> Column:
    return F.trim(squeezed(text), F.lit("\"'.;,"))


def normal_evidence(text: Column) -> Column:
    return F.trim(squeezed(text), F.lit("\"'"))


def normal_key(text: Column) -> Column:
    return squeezed(F.lower(text))


def to_title(text: Column, most: int) -> Column:
    """The normalised sentence, cut with dots if longer."""
    whole = normal_sentence(text)
    cut = F.regexp_replace(F.substring(whole, 1, most), r"(?U)\s+$", "")
    return F.when(F.length(whole) <= most, whole).otherwise(F.concat(cut, F.lit("...")))


def truncated(text: Column, most: int) -> Column:
    """The first most characters and dots, of longer texts."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("...")))


def evidence_line(text: Column, place: Column) -> Column:
    """The trimmed line that holds the character at place (from 1)."""
    before = F.substring_index(F.left(text, place - 1), "\n", -1)
    after = F.substring_index(F.substring(text, place, F.length(text)), "\n", 1)
    return trimmed(F.concat(before, after))


def evidence_holds(content: Column, evidence: Column) -> Column:
    """Whether evidence of eight letters or more stands in the content, as it is or normalised."""
    low = F.lower(content)
    return (F.length(evidence) >= 8) & (low.contains(F.lower(evidence)) | low.contains(F.lower(normal_sentence(evidence))))


def normal_confidence(value: Column, fallback: float) -> Column:
    known = F.when(value > 0, value).otherwise(F.lit(fallback))
    return F.least(F.greatest(known.cast("decimal(5,2)"), F.lit(0.10).cast("decimal(5,2)")), F.lit(0.95).cast("decimal(5,2)"))


def normal_kind(value: Column) -> Column:
    key = normal_key(F.coalesce(value, F.lit("")))
    return F.when(key.isin(*KINDS), key).otherwise("technical")


def looks_like_rule(text: Column, words: Sequence[str] = RULE_WORDS) -> Column:
    return (F.length(text) >= 12) & contains_any(text, words)


def looks_technical(text: Column, words: Sequence[str] = TECHNICAL_WORDS) -> Column:
    return contains_any(text, words)


def looks_like_semantic_rule(title: Column, description: Column, evidence: Column) -> Column:
    return once(normal_key(F.concat_ws(" ", title, description, evidence)), lambda whole: ~looks_technical(whole) & contains_any(whole, SEMANTIC_WORDS))


def relevant_lines(content: Column, words: Sequence[str] = LINE_WORDS) -> Column:
    """The trimmed lines of 18 to 260 characters that hold any of the words, in order."""
    return F.filter(F.transform(F.split(content, "\n"), trimmed), lambda x: F.length(x).between(18, 260) & contains_any(x, words))


def compress_evidence(text: Column) -> Column:
    """Lines with single spaces, without blank ones; blank texts as they are."""
    lines = F.filter(F.transform(F.split(text, "\n"), squeezed), lambda x: x != "")
    return F.when(squeezed(text) == "", text).otherwise(F.array_join(lines, "\n"))


def squeeze_blank_lines(text: Column) -> Column:
    """Runs of blank lines as one empty line, none at either end."""
    return trimmed(F.regexp_replace(text, r"\n(?:[ \t\r]*\n){2,}", "\n\n"))


def query_terms(query: Column) -> Column:
    """Lower-cased parts of more than two letters."""
    return F.filter(F.split(F.lower(query), r"[ ._()]"), lambda t: F.length(t) > 2)


def simple_symbol(name: Column) -> Column:
    """The last part of a symbol's name, without parameters and type arguments."""
    return F.trim(F.substring_index(F.substring_index(F.substring_index(name, "(", 1), "<", 1), ".", -1))


def contextual(project: Column, path: Column, language: Column, symbol: Column, chunk_type: Column, content: Column) -> Column:
    """The content under a line that tells where it stands."""
    named = lambda label: F.when(F.coalesce(symbol, F.lit("")) != "", F.concat(F.lit(label), symbol))
    # Labels and their order by language
    where = [
        F.concat(F.lit("Project: "), project), F.concat(F.lit("File: "), path),
        F.when(language == "csharp", "Lang: C#").when(language == "sql", "Lang: SQL").when(language == "markdown", "Lang: Markdown").when(F.coalesce(language, F.lit("")) != "", F.concat(F.lit("Lang: "), language)),
        F.when(language.isin("csharp", "sql"), named("Symbol: ")).when(language == "markdown", named("Section: ")),
        F.when(language == "csharp", F.concat(F.lit("ChunkType: "), chunk_type)),
    ]
    return F.concat(F.lit("[CONTEXT: "), F.concat_ws(" | ", *where), F.lit("]\n"), content)


def language_of(path: Column) -> Column:
    """The language that a file's extension tells; else the extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))
    # Extensions and languages
    names = {"cs": "csharp", "sql": "sql", "md": "markdown", "json": "json", "razor": "razor", "cshtml": "cshtml"}
    return reduce(lambda rest, item: F.when(ext == item[0], item[1]).otherwise(rest), names.items(), ext)
