"""Rules and knowledge from chunks, by patterns or by a model's JSON replies."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import text as X

#: Where messages stand in code, and the confidence in each.
PASSES = (
    (r'(?i)throw\s+new\s+[A-Za-z0-9_.]*(?:Business|Domain|Validation)?Exception\s*\(\s*"([^"]{12,240})"', 0.88),
    (r'(?i)(?=[WA])(?:WithMessage|AddFailure|AddNotification)\s*\(\s*"([^"]{12,240})"', 0.78),
    (r'(?is)(?=[EAN])(?:ErroContext|ErrosContext|AdicionarErro|AdicionaErro|AddErro|AddError|AddFailure|AddNotification|Notificar|AddNotification)\s*(?:<[^>]+>)?\s*\([^\)]*?"([^"]{8,240})"', 0.84),
)
LINE_CONFIDENCE, LONGEST_LINE = 0.64, 220
#: Keywords of knowledge, with title, kind and confidence, and each kind's sentence.
KEYWORDS = (
    ("HttpClient", "usa HttpClient para comunicação externa", "integration", 0.72),
    ("MassTransit", "usa MassTransit para mensageria", "integration", 0.82),
    ("RabbitMQ", "usa RabbitMQ para mensageria", "integration", 0.82),
    ("Kafka", "usa Kafka para mensageria", "integration", 0.82),
    ("MediatR", "usa MediatR para handlers e dispatch interno", "pattern", 0.78),
    ("EntityFramework", "usa Entity Framework para persistência", "pattern", 0.78),
    ("TODO", "possui marcador TODO", "technical_risk", 0.62),
    ("FIXME", "possui marcador FIXME", "technical_risk", 0.72),
    ("HACK", "possui marcador HACK", "technical_risk", 0.72),
)
SENTENCES = {
    "integration": "O projeto {0} possui indício de integração ou comunicação externa relacionada a {1}.",
    "pattern": "O projeto {0} possui indício de uso do padrão ou biblioteca {1}.",
    "technical_risk": "O projeto {0} contém marcador técnico que precisa de revisão: {1}.",
    "": "O projeto {0} contém evidência técnica relacionada a {1}.",
}


def rule_record(message: Column, evidence: Column) -> list[Column]:
    title = X.to_title(message, 90)
    return [
        title.alias("title"), F.when(message.endswith("."), message).otherwise(F.concat(message, F.lit("."))).alias("description"), X.to_title(evidence, 500).alias("evidence"),
        F.sha2(F.concat(F.col("project"), F.lit("|rule|"), X.normal_key(title)), 256).alias("content_hash"),
    ]


#: A character of no text, put where a match begins.
MARK = "\uE000"
#: What a text must hold, in lower case, for a pass to be worth its pattern.
NEEDED = (("exception",), ("withmessage", "addfailure", "addnotification"), ("errocontext", "erroscontext", "erro", "adderror", "addfailure", "addnotification", "notificar"))


def marked_messages(content: Column, pattern: str) -> Column:
    """The first group of each match of the pattern, with the trimmed line in which the match begins, in order: matches are
    marked in one pass over the text, and its lines tell their marks."""
    clean = F.replace(content, F.lit(MARK), F.lit(""))
    lines = F.split(F.regexp_replace(clean, pattern, f"{MARK}$0"), "\n")
    bare = lambda x: F.replace(x, F.lit(MARK), F.lit(""))
    told = F.flatten(F.transform(F.filter(lines, lambda x: F.contains(x, F.lit(MARK))), lambda x: F.array_repeat(X.trimmed(bare(x)), F.length(x) - F.length(bare(x)))))
    return F.arrays_zip(F.regexp_extract_all(clean, F.lit(pattern), F.lit(1)).alias("message"), told.alias("line"))


def extract_rules(chunks: DataFrame, words: Sequence[str] = X.RULE_WORDS, line_words: Sequence[str] = X.LINE_WORDS) -> DataFrame:
    """Rules of chunks (id, project, file_path, symbol_name, content): messages in code and telling lines. Of equal
    messages of a chunk the first pass's first one stays. One scan: a chunk's finds are one array."""
    kind = "array<struct<pass:int,pos:int,message:string,line:string,confidence:double,most:int>>"

    def finds(k: int, pairs: Column, confidence: float, most: int) -> Column:
        row = lambda m, i: F.struct(F.lit(k).alias("pass"), i.alias("pos"), X.normal_sentence(m["message"]).alias("message"), m["line"].alias("line"), F.lit(confidence).alias("confidence"), F.lit(most).alias("most"))
        return F.coalesce(F.transform(pairs, row), F.array()).cast(kind)

    coded = [finds(k, F.when(X.contains_any(F.col("content"), NEEDED[k]), marked_messages(F.col("content"), pattern)), confidence, 1 << 20) for k, (pattern, confidence) in enumerate(PASSES)]
    lines = F.transform(X.relevant_lines(F.col("content"), line_words), lambda x: F.struct(x.alias("message"), x.alias("line")))
    told = F.concat(*coded, finds(len(PASSES), lines, LINE_CONFIDENCE, LONGEST_LINE))
    rows = chunks.select("id", "project", "file_path", "symbol_name", F.explode(told).alias("m")).select("id", "project", "file_path", "symbol_name", "m.*")
    rows = rows.filter(X.looks_like_rule(F.col("message"), words) & (F.length("message") <= F.col("most")))
    first = W.partitionBy("id", F.lower("message")).orderBy("pass", "pos")
    once = rows.withColumn("place", F.row_number().over(first)).filter("place = 1")
    return once.select(F.col("id").alias("chunk_id"), "project", "file_path", "symbol_name", "pass", "pos", *rule_record(F.col("message"), F.col("line")), F.col("confidence").cast("decimal(5,2)").alias("confidence"))


def keyword_knowledge(chunks: DataFrame, keywords: Sequence[tuple[str, str, str, float]] = KEYWORDS) -> DataFrame:
    """Knowledge of chunks that hold a keyword, with the line of its first place as evidence."""
    rows = F.array(*(F.struct(F.lit(w).alias("keyword"), F.lit(t).alias("title"), F.lit(k).alias("kind"), F.lit(c).cast("decimal(5,2)").alias("confidence")) for w, t, k, c in keywords))
    hit = chunks.withColumn("low", F.lower("content")).select("*", F.explode(rows).alias("k")).filter(F.expr("contains(low, lower(k.keyword))"))
    body = F.lit(SENTENCES[""])
    for kind, sentence in SENTENCES.items():
        body = F.when(F.col("k.kind") == kind, F.lit(sentence)).otherwise(body) if kind else body
    text = F.replace(F.replace(body, F.lit("{0}"), F.col("project")), F.lit("{1}"), F.col("k.keyword"))
    digest = F.sha2(F.concat("project", F.lit("|knowledge|"), "k.kind", F.lit("|"), X.normal_key(F.col("k.title")), F.lit("|"), "file_path"), 256)
    line = X.evidence_line(F.col("content"), F.expr("locate(lower(k.keyword), low)"))
    return hit.select(F.col("id").alias("chunk_id"), "k.kind", F.concat("project", F.lit(": "), "k.title").alias("title"), text.alias("content"), "file_path", "symbol_name", X.to_title(line, 500).alias("evidence"), "k.confidence", digest.alias("content_hash"))


def dedup_rules(rules: DataFrame, tie: Sequence[str] = ("seq",), by: Sequence[Column] | None = None) -> DataFrame:
    """Of equal titles (whatever case and spacing) of a chunk the one of most confidence, then the first."""
    key = by or [F.col("chunk_id"), X.normal_key(F.col("title"))]
    order = W.partitionBy(*key).orderBy(F.col("confidence").desc(), *tie)
    return rules.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def dedup_knowledge(records: DataFrame, tie: Sequence[str] = ("seq",)) -> DataFrame:
    return dedup_rules(records, tie, [F.col("chunk_id"), X.normal_key(F.col("kind")), X.normal_key(F.col("title"))])


FIELDS = ("kind", "title", "description", "content", "evidence")
#: Characters of no text, in place of an escaped backslash and an escaped quote: strings then end at the next quote.
BACKSLASH, QUOTE = "\uE001", "\uE002"


def repaired(reply: Column) -> Column:
    """A reply without comments and trailing commas; what stands in strings is let be."""
    plain = F.replace(F.replace(F.replace(F.replace(reply, F.lit(BACKSLASH), F.lit("")), F.lit(QUOTE), F.lit("")), F.lit("\\\\"), F.lit(BACKSLASH)), F.lit('\\"'), F.lit(QUOTE))
    bare = F.regexp_replace(F.regexp_replace(plain, r'(?s)("[^"]*+")|//[^\n]*+|/\*.*?\*/', "$1"), r'("[^"]*+")|,(?=\s*+[\]}])', "$1")
    return F.replace(F.replace(bare, F.lit(QUOTE), F.lit('\\"')), F.lit(BACKSLASH), F.lit("\\\\"))


def named(entries: Column, name: str) -> Column:
    """The last value under the name, in any case."""
    return F.try_element_at(F.filter(F.map_entries(entries), lambda e: F.lower(e["key"]) == name), F.lit(-1))["value"]


def json_items(reply: Column, root: str) -> Column:
    """The objects under root, as maps of names to values; what isn't an object is passed over. Empty for anything else than
    such a reply, and for one with a name twice in an object in the same case."""
    whole = F.try_variant_get(F.try_parse_json(repaired(reply)), F.lit("$"), "map<string, variant>")
    items = F.try_variant_get(named(whole, root), F.lit("$"), "array<variant>")
    maps = F.transform(items, lambda v: F.try_variant_get(v, F.lit("$"), "map<string, variant>"))
    return F.coalesce(F.filter(maps, lambda m: m.isNotNull()), F.array().cast("array<map<string, variant>>"))


def _items(root: str) -> Column:
    """What the column reply says, field by field. A confidence that isn't a number is none."""
    text = lambda m, f: F.try_variant_get(named(m, f), F.lit("$"), "string").alias(f)
    number = lambda v: F.when(F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, F.lit("$"), "double"))
    row = lambda m: F.struct(*(text(m, f) for f in FIELDS), number(named(m, "confidence")).alias("confidence"))
    return F.transform(json_items(F.col("reply"), root), row)


def parsed_replies(replies: DataFrame, root: str) -> DataFrame:
    """replies (id, reply) with items: what a model said, field by field."""
    return replies.select("id", _items(root).alias("items"))


def _told(replies: DataFrame, root: str, body: str) -> DataFrame:
    """id, seq, r, and what is said in normal form: t (title), b (body) and e (evidence). The generator takes the expressions
    themselves: of a column of items Spark would infer a filter, and of columns push one down, and so parse a reply twice."""
    blank = F.lit("")
    normal = lambda r: F.struct(r.alias("r"), X.normal_sentence(F.coalesce(r["title"], blank)).alias("t"), X.normal_sentence(F.coalesce(r[body], blank)).alias("b"), X.normal_evidence(F.coalesce(r["evidence"], blank)).alias("e"))
    rows = replies.select("id", F.posexplode(F.transform(_items(root), normal)).alias("seq", "x"))
    return rows.select("id", "seq", F.col("x.r.kind").alias("said"), F.col("x.r.confidence").alias("sure"), "x.t", "x.b", "x.e").filter((F.length("t") >= 8) & (F.length("b") >= 12) & (F.length("e") >= 8))


def semantic_rules(chunks: DataFrame, replies: DataFrame) -> DataFrame:
    """Rules of a model's replies that stand up to the chunk's text."""
    rows = _told(replies, "rules", "description").filter(X.looks_like_semantic_rule(F.col("t"), F.col("b"), F.col("e")))
    good = rows.join(chunks, "id").filter(X.evidence_holds(F.col("content"), F.col("e")))
    return good.select(F.col("id").alias("chunk_id"), "seq", X.to_title(F.col("t"), 90).alias("title"), F.when(F.col("b").endswith("."), F.col("b")).otherwise(F.concat("b", F.lit("."))).alias("description"), X.to_title(F.col("e"), 500).alias("evidence"),
                       X.normal_confidence(F.col("sure"), 0.72).alias("confidence"), F.sha2(F.concat("project", F.lit("|rule|"), X.normal_key(F.col("t"))), 256).alias("content_hash"))


def semantic_knowledge(chunks: DataFrame, replies: DataFrame) -> DataFrame:
    rows = _told(replies, "knowledge", "content").join(chunks, "id").filter(X.evidence_holds(F.col("content"), F.col("e")))
    good = rows.withColumn("kind", X.normal_kind(F.col("said")))
    full = F.when(F.lower("t").startswith(F.concat(F.lower("project"), F.lit(":"))), F.col("t")).otherwise(F.concat("project", F.lit(": "), "t"))
    return good.select(F.col("id").alias("chunk_id"), "seq", "kind", X.to_title(full, 140).alias("title"), F.when(F.col("b").endswith("."), F.col("b")).otherwise(F.concat("b", F.lit("."))).alias("content"), X.to_title(F.col("e"), 500).alias("evidence"),
                       X.normal_confidence(F.col("sure"), 0.70).alias("confidence"), F.sha2(F.concat("project", F.lit("|knowledge|"), "kind", F.lit("|"), X.normal_key(F.col("t")), F.lit("|"), "file_path"), 256).alias("content_hash"))


def generated(chunks: DataFrame, generate: Callable[[str], str], prompt: Column) -> DataFrame:
    """id and reply of a text model for each chunk, one call a row in batches; the model runs on the executors."""

    @F.pandas_udf("string")
    def ask(prompts: pd.Series) -> pd.Series:
        return prompts.map(generate)

    return chunks.select("id", ask(prompt).alias("reply"))


def prompt(root: str, fields: str, about: str) -> Column:
    """What to ask a text model about each chunk; fields: the JSON object of one item."""
    head = f'Read the chunk and list {about}. Answer with JSON alone, as {{"{root}": [{fields}]}}. Copy each evidence word by word from the chunk; leave out what has none. An empty list is fine.\n\n'
    where = F.concat_ws("\n", *(F.concat(F.lit(f"{c}: "), F.coalesce(c, F.lit(""))) for c in ("project", "file_path", "language", "chunk_type", "symbol_name")))
    return F.concat(F.lit(head), where, F.lit("\n\n"), F.col("content"))


def rules_prompt() -> Column:
    return prompt("rules", '{"title": "", "description": "", "evidence": "", "confidence": 0.0}', "the rules of the business that it states or enforces (limits, permissions, validations, states, required data), and no technical detail")


def knowledge_prompt() -> Column:
    return prompt("knowledge", f'{{"kind": "{"|".join(X.KINDS)}", "title": "", "content": "", "evidence": "", "confidence": 0.0}}', "what it tells about the technology in use (integrations, patterns, storage, configuration, risks), and no rule of the business")
