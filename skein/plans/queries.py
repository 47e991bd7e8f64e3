"""The registered queries, each with the SQL that checks it (none where SQL can't express it)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import schemas
from skein.fixtures import CTES, Filled, Tables
from skein.functions import lexical, vector
from skein.functions import stems as stemmers
from skein.functions import text as X
from skein.operators import chunking, compress, extraction, graph, merge, predicates, reports, scope, search
from skein.operators.pivots import VectorIndex
from skein.operators.postings import TextIndex
from skein.sources import changes, config, digests, embedding, files, tables
from skein.sources.folders import scratch_dir
from skein.sources.store import ChunkStore
from skein.sources.vectors import VectorStore
from skein.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TERMS = "thble thatin"
K = 10


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of the logical tables under its name."""

    def put(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = f"WITH RECURSIVE {CTES.strip()}{',' if sql.lstrip().startswith(',') else ''} {sql.strip().removeprefix(',')}"
        return f

    return put


def query_vector(t: Tables, key: int = 0) -> list[float]:
    return t.raw("embeddings").filter(F.col("vec_id") == key).select("embedding").head()[0]


def _scratch(t, name: str) -> str:
    return f"{scratch_dir(t.spark)}/skein/{name}-{uuid.uuid4().hex}"


def epoch(column: str):
    return F.unix_timestamp(column).alias(column)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# vectors and text -----------------------------------------------------------------------------------------------

Q_VEC = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
DIST = f"1 - list_cosine_similarity(embedding::DOUBLE[], {Q_VEC})"
TOKENS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
CHUNK_TEXT = "concat_ws(' ', symbol_name, file_path, content)"
#: Cover density of one term, or of any of some; and of two terms, whose minimal covers are neighbouring places of both.
EVENTS = "list_filter(list_transform(w, lambda x, i: CASE x WHEN 'thble' THEN i WHEN 'thatin' THEN -i END), lambda x: x IS NOT NULL)"
TWO = "round(list_sum(list_transform(range(1, len(e)), lambda j: CASE WHEN e[j] * e[j + 1] < 0 THEN 2.0::DOUBLE / (abs(e[j + 1]) - abs(e[j]) + 1) ELSE 0 END)), 9)"
ONE = "len(list_filter(w, lambda x: x IN ({})))::DOUBLE"


def hybrid(rows: str, text: str, columns: str, keep_null: bool = False, terms: str = "list_contains(w, 'thble') AND list_contains(w, 'thatin')", score: str = TWO) -> str:
    return f""", base AS ({rows}),
vec AS (SELECT id, row_number() OVER (ORDER BY dist NULLS LAST, id) AS r FROM (SELECT id, {DIST} AS dist FROM base {'' if keep_null else 'WHERE embedding IS NOT NULL'}) ORDER BY dist NULLS LAST, id LIMIT 100),
tok AS (SELECT id, w, {EVENTS} AS e FROM (SELECT id, {TOKENS.format(text)} AS w FROM base)),
txt AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS r FROM (SELECT id, {score} AS s FROM tok WHERE {terms}) ORDER BY s DESC, id LIMIT 100),
best AS (SELECT id, coalesce(1.0::DOUBLE / (60.0::DOUBLE + vec.r), 0) + coalesce(1.0::DOUBLE / (60.0::DOUBLE + txt.r), 0) AS rrf_score FROM vec FULL OUTER JOIN txt USING (id) ORDER BY rrf_score DESC, id LIMIT 10)
SELECT b.id, p.name AS project, {columns}, round(rrf_score, 6) AS rrf_score FROM best JOIN base b USING (id) LEFT JOIN projects p ON p.id = b.project_id"""


SCOPED = "p.name = 'src1' OR EXISTS (SELECT 1 FROM workspace_projects wp JOIN workspaces w ON w.id = wp.workspace_id WHERE wp.project_id = p.id AND (w.name = 'src1' OR w.name || '/' || p.name = 'src1'))"


@query(hybrid(f"SELECT c.* FROM chunks c JOIN projects p ON p.id = c.project_id WHERE {SCOPED.replace('src1', 'de')}", CHUNK_TEXT, "file_path, language, chunk_type, symbol_name, content"))
def rrf_code(t):
    return rounded(search.search_code(t, query_vector(t), TERMS, K, "de"), "rrf_score")


@query(hybrid("SELECT * FROM chunks", CHUNK_TEXT, "file_path, symbol_name, content", keep_null=True))
def rrf_search(t):
    return rounded(search.search(t, query_vector(t), TERMS, K), "rrf_score")


FACTS = "title, {} symbol_name, status, evidence, confidence::DOUBLE AS confidence"


@query(hybrid("SELECT * FROM rules WHERE status <> 'rejected'", "concat_ws(' ', title, description, evidence)", FACTS.format("description, source_file,"), terms="list_contains(w, 'the')", score=ONE.format("'the'")))
def rrf_rules(t):
    return rounded(search.search_rules(t, query_vector(t), "the", K).withColumn("confidence", F.col("confidence").cast("double")), "rrf_score")


@query(hybrid("SELECT * FROM knowledge WHERE status <> 'rejected'", "concat_ws(' ', title, content, evidence)", "kind, " + FACTS.format("content, source,"), terms="list_contains(w, 'the') OR list_contains(w, 'and')", score=ONE.format("'the', 'and'")))
def rrf_knowledge(t):
    return rounded(search.search_knowledge(t, query_vector(t), "the OR and", K).withColumn("confidence", F.col("confidence").cast("double")), "rrf_score")


def _best(score: str, holds: str) -> str:
    return f"SELECT id, s AS score, row_number() OVER (ORDER BY s DESC, id) AS rank FROM (SELECT id, {score} AS s FROM (SELECT id, w, {EVENTS} AS e FROM (SELECT id, {TOKENS.format('content')} AS w FROM chunks)) WHERE {holds}) ORDER BY s DESC, id LIMIT 100"


@query(f"SELECT w AS term, count(*) AS texts, sum(n)::BIGINT AS occurrences, sum(s)::BIGINT AS place_sum FROM (SELECT doc_id, w, count(*) AS n, sum(p) AS s FROM (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS p FROM (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents)) GROUP BY doc_id, w) GROUP BY w")
def text_index(t):
    """What the index knows of each term: texts, occurrences, and the sum of their places."""
    index = TextIndex.build(t.chunks_text, F.col("content"), _scratch(t, "index"))
    of = F.aggregate("places", F.lit(0).cast("long"), lambda a, p: a + p)
    return index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("occurrences"), F.sum(of).alias("place_sum"))


@query(_best(TWO, "list_contains(w, 'thble') AND list_contains(w, 'thatin')"))
def text_topk_indexed(t):
    return TextIndex.build(t.chunks_text, F.col("content"), _scratch(t, "index")).topk(TERMS, 100)


@query(f"SELECT doc_id AS id FROM (SELECT doc_id, ' ' || array_to_string({TOKENS.format('text')}, ' ') || ' ' AS w FROM documents) WHERE (contains(w, ' thble ') OR contains(w, ' la ')) AND contains(w, ' of the ') AND NOT contains(w, ' thatin ')")
def fts_match_indexed(t):
    return TextIndex.build(t.chunks_text, F.col("content"), _scratch(t, "index")).matches('thble OR la "of the" -thatin')


@query(hybrid("SELECT * FROM rules WHERE status <> 'rejected'", "concat_ws(' ', title, description, evidence)", FACTS.format("description, source_file,"), terms="list_contains(w, 'thble') AND list_contains(w, 'thatin')"))
def rrf_rules_indexed(t):
    index = TextIndex.build(t.rules_bodies, search.fact_text("description"), _scratch(t, "index"))
    return rounded(search.search_rules(t, query_vector(t), TERMS, K, index=index).withColumn("confidence", F.col("confidence").cast("double")), "rrf_score")


@query(f"SELECT id, round({DIST}, 6) AS distance, row_number() OVER (ORDER BY {DIST}, id) AS rank FROM chunks WHERE embedding IS NOT NULL ORDER BY {DIST}, id LIMIT 100")
def vector_topk(t):
    return rounded(search.vector_topk(t.chunks, query_vector(t), 100), "distance")


@query(f"SELECT id, s AS score, row_number() OVER (ORDER BY s DESC, id) AS rank FROM (SELECT id, {ONE.format("'thble'")} AS s FROM (SELECT id, {TOKENS.format('content')} AS w FROM chunks) WHERE list_contains(w, 'thble')) ORDER BY s DESC, id LIMIT 100")
def text_topk(t):
    return search.text_topk(t.chunks_text, F.col("content"), "thble", 100)


@query(f"SELECT id, round({DIST}, 6) AS distance, row_number() OVER (ORDER BY {DIST}, id) AS rank FROM chunks WHERE embedding IS NOT NULL ORDER BY {DIST}, id LIMIT 100")
def vector_topk_indexed(t):
    index = VectorIndex.build(t.chunks.select("id", "embedding"), _scratch(t, "vectors"))
    return rounded(index.topk(query_vector(t), 100), "distance")


@query(f"SELECT id, round({DIST}, 6) AS distance FROM chunks WHERE embedding IS NOT NULL")
def cosine_distance(t):
    return t.chunks.filter("embedding IS NOT NULL").select("id", F.round(vector.cosine_distance(F.col("embedding"), query_vector(t)), 6).alias("distance"))


@query("SELECT doc_id, round(coalesce(1.0::DOUBLE / (60.0::DOUBLE + doc_id), 0) + coalesce(1.0::DOUBLE / (60.0::DOUBLE + CASE WHEN doc_id % 2 = 0 THEN doc_id END), 0), 9) AS score FROM documents")
def rrf_score(t):
    return t.raw("documents").select("doc_id", F.round(search.rrf_score(F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))), 9).alias("score"))


@query(f"SELECT doc_id, len(w)::INT AS n, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents)")
def tokenize(t):
    return t.raw("documents").select("doc_id", lexical.tokens(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


@query(f"SELECT doc_id FROM (SELECT doc_id, ' ' || array_to_string({TOKENS.format('text')}, ' ') || ' ' AS w FROM documents) WHERE (contains(w, ' thble ') OR contains(w, ' la ')) AND contains(w, ' of the ') AND NOT contains(w, ' thatin ')")
def fts_match(t):
    return t.raw("documents").filter(lexical.matches(lexical.tokens(F.col("text")), 'thble OR la "of the" -thatin')).select("doc_id")


@query(f"SELECT doc_id, round(s, 6) AS score FROM (SELECT doc_id, {TWO} AS s FROM (SELECT doc_id, w, {EVENTS} AS e FROM (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents)) WHERE list_contains(w, 'thble') AND list_contains(w, 'thatin'))")
def ts_rank_cd(t):
    found = t.raw("documents").select("doc_id", lexical.tokens(F.col("text")).alias("w")).filter(lexical.matches(F.col("w"), TERMS))
    return found.select("doc_id", F.round(lexical.cover_density_rank(F.col("w"), TERMS), 6).alias("score"))


STEMMED = f""", words AS (SELECT word, count(*) AS n FROM (SELECT unnest({TOKENS.format('text')}) AS word FROM documents) GROUP BY word),
en_stems AS ({stemmers.stems_sql('words', 'english')}), pt_stems AS ({stemmers.stems_sql('words', 'portuguese')})
SELECT word, n, en_stems.stem AS english, pt_stems.stem AS portuguese FROM words JOIN en_stems USING (word) JOIN pt_stems USING (word)"""


@query(STEMMED)
def stems(t):
    words = t.raw("documents").select(F.explode(lexical.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.select("word", "n", *(lexical.stemmed(F.col("word"), x).alias(x) for x in ("english", "portuguese")))


@query()
def embed_hash(t):
    return t.raw("documents").select("doc_id", embedding.embedded(F.col("text")).alias("embedding"))


@query(f""", f AS (SELECT p.name AS project, file_path, min({DIST}) AS dist, count(*)::INT AS matched_chunks, string_agg(DISTINCT symbol_name, ', ' ORDER BY symbol_name) AS symbols
FROM chunks c JOIN projects p ON p.id = c.project_id WHERE embedding IS NOT NULL AND ({SCOPED.replace('src1', 'en')}) AND NOT (file_path = '7.txt' OR file_path ILIKE '%7.txt') GROUP BY ALL)
SELECT project, file_path, round(dist, 6) AS distance, matched_chunks, symbols FROM f ORDER BY dist, project, file_path LIMIT 20""")
def related_files(t):
    return rounded(search.related_files(t, query_vector(t), 20, "en", "7.txt"), "distance")


@query(""", s AS (SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM conversations)
SELECT conv_id, turn, substr(text, 1, (400 - spent)::INT) AS content FROM s WHERE spent < 400""")
def char_budget(t):
    rows = t.raw("conversations").select("conv_id", "turn", F.col("text").alias("content"))
    return search.char_budget(rows, 400, ["conv_id"], F.length("content"), "turn")


RERANK = f""", base AS (SELECT *, row_number() OVER (ORDER BY {DIST}, id) AS r FROM chunks WHERE embedding IS NOT NULL ORDER BY r LIMIT 50)
SELECT id, round(1.0::DOUBLE / (60 + r) + CASE WHEN coalesce(symbol_name, '') = '' THEN 0.0 ELSE CASE WHEN contains(lower(symbol_name), 'sym1') OR contains(lower(symbol_name), 'class') THEN 0.25 ELSE 0.0 END + CASE WHEN contains('class ns.sym12', lower(symbol_name)) THEN 0.15 ELSE 0.0 END END - CASE WHEN language = 'de' THEN 0.0 ELSE 0.0 END, 6) AS rerank_score FROM base"""


@query(RERANK.replace("'sym1')", "'sym12')"))
def rerank(t):
    near = search.vector_topk(t.chunks, query_vector(t), 50).select("id", "rank")
    rows = t.chunks.join(near, "id").select("id", "symbol_name", "language", (F.lit(1.0) / (F.lit(60.0) + F.col("rank"))).alias("rrf_score"))
    return search.reranked(rows, "class ns.Sym12").select("id", F.round("rerank_score", 6).alias("rerank_score"))


# predicates and scope -------------------------------------------------------------------------------------------

WORDS = ("licensed", "thble", "copyright", "deve")
LIKE = " OR ".join(f"content ILIKE '%{w}%'" for w in WORDS)


def _any_like(column: str, patterns) -> str:
    return "(" + " OR ".join(f"coalesce({column} ILIKE '{p if '%' in p else f'%{p}%'}', false)" for p in patterns) + ")"


#: Every word of the default lists, put behind some of the texts, and folders before some of the paths: the test tables hold none.
WORDS_PUT, FOLDERS_PUT = predicates.RULE_CONTENT + predicates.KNOWLEDGE_CONTENT + predicates.NOT_CONTENT, predicates.SEMANTIC_PATHS + predicates.NOT_FOLDERS
PLANTED = f", chunks2 AS (SELECT * REPLACE (content || ' ' || coalesce({list(WORDS_PUT)}[(id % 50)::INT + 1], '') AS content, coalesce({list(FOLDERS_PUT)}[(id // 50 % 25)::INT + 1], 'r') || '/' || file_path AS file_path) FROM chunks)"
RULE_LIKE = _any_like("content", predicates.RULE_CONTENT)


def _planted(t):
    of = lambda names, n: F.get(F.array(*map(F.lit, names)), n.cast("int"))
    word, folder = of(WORDS_PUT, F.col("id") % 50), of(FOLDERS_PUT, F.floor(F.col("id") / 50) % 25)
    return t.chunks_text.withColumns({"content": F.concat("content", F.lit(" "), F.coalesce(word, F.lit(""))), "file_path": F.concat(F.coalesce(folder, F.lit("r")), F.lit("/"), "file_path")})


@query(f"{PLANTED} SELECT id FROM chunks2 WHERE {RULE_LIKE}")
def pred_ilike_any(t):
    return _planted(t).filter(predicates.rule_candidate()).select("id")


@query(f"{PLANTED} SELECT id FROM chunks2 WHERE {_any_like('file_path', predicates.KNOWLEDGE_PATHS)} OR {_any_like('content', predicates.KNOWLEDGE_CONTENT)}")
def pred_knowledge(t):
    return _planted(t).filter(predicates.knowledge_candidate()).select("id")


@query(f"""{PLANTED} SELECT id FROM chunks2 WHERE ({RULE_LIKE} OR {_any_like('file_path', predicates.SEMANTIC_PATHS)} OR {_any_like('symbol_name', predicates.SEMANTIC_SYMBOLS)}) AND NOT ({_any_like('file_path', [f'%/{f}/%' for f in predicates.NOT_FOLDERS])}
OR {_any_like('file_path', predicates.NOT_FILES)} OR {_any_like('content', predicates.NOT_CONTENT)} OR (chunk_type = 'type' AND content ILIKE '% interface %'))""")
def pred_semantic(t):
    return _planted(t).filter(predicates.semantic_candidate()).select("id")


@query("SELECT id FROM chunks WHERE content ILIKE '%public license%' OR content ILIKE 'the%' OR symbol_name ILIKE '%m_2%'")
def pred_dynamic(t):
    return t.chunks_text.filter(predicates.ilike_any(F.col("content"), ["public license", "the%"]) | predicates.ilike_any(F.col("symbol_name"), ["m_2"])).select("id")


MARK = "content ILIKE '%licensed under%'"


@query(f"SELECT DISTINCT project_id, file_path FROM chunks WHERE {MARK}")
def marker_files(t):
    return predicates.marked_files(t.chunks_text, predicates.ilike_any(F.col("content"), ["licensed under"]))


@query(f"SELECT id FROM chunks c WHERE EXISTS (SELECT 1 FROM chunks m WHERE m.project_id = c.project_id AND m.file_path = c.file_path AND m.{MARK})")
def marker_semi(t):
    return predicates.with_marker(t.chunks_text, predicates.ilike_any(F.col("content"), ["licensed under"])).select("id")


@query(f"SELECT id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM chunks m WHERE m.project_id = c.project_id AND m.file_path = c.file_path AND m.{MARK})")
def marker_anti(t):
    return predicates.without_marker(t.chunks_text, predicates.ilike_any(F.col("content"), ["licensed under"])).select("id")


PATHS = "CASE id % 5 WHEN 0 THEN '/tests/' WHEN 1 THEN '/bin/' WHEN 2 THEN '/Spec/' ELSE '/src/' END"


@query(f""", f AS (SELECT id, 'p' || project_id || CASE WHEN project_id % 4 = 0 THEN '.Tests' ELSE '' END AS project, 'a' || {PATHS} || id || CASE WHEN id % 7 = 0 THEN 'Tests.cs' ELSE '.cs' END AS path FROM chunks)
SELECT id FROM f WHERE regexp_matches(project, '(?i)(^|[._-])(test|tests|unittests|integrationtests|functionaltests|acceptancetests|spec|specs)([._-]|$)') OR regexp_matches(project, '(?i)(tests|specs)$') OR path ILIKE '%/test/%' OR path ILIKE '%/tests/%' OR path ILIKE '%/spec/%' OR path ILIKE '%/specs/%' OR regexp_matches(path, '(?i)(tests|specs)\\.cs$')""")
def test_file_pred(t):
    folder = F.when(F.col("id") % 5 == 0, "/tests/").when(F.col("id") % 5 == 1, "/bin/").when(F.col("id") % 5 == 2, "/Spec/").otherwise("/src/")
    rows = t.chunks_text.select("id", F.concat(F.lit("p"), F.col("project_id").cast("string"), F.when(F.col("project_id") % 4 == 0, ".Tests").otherwise("")).alias("project"),
                           F.concat(F.lit("a"), folder, F.col("id").cast("string"), F.when(F.col("id") % 7 == 0, "Tests.cs").otherwise(".cs")).alias("path"))
    return rows.filter(predicates.test_path(F.col("project"), F.col("path"))).select("id")


INDEXABLE = f"NOT EXISTS (SELECT 1 FROM chunks m WHERE m.project_id = c.project_id AND m.file_path = c.file_path AND (m.{MARK} OR m.content ILIKE '%[Fact%'))"


def indexable_chunks(t):
    return predicates.indexable(t.chunks_text, t.projects, predicates.ilike_any(F.col("content"), ["licensed under"]), predicates.ilike_any(F.col("content"), ["[Fact"]))


@query(f"SELECT id FROM chunks c WHERE {INDEXABLE}")
def indexable(t):
    return indexable_chunks(t).select("id")


@query(f"SELECT c.id FROM chunks c JOIN projects p ON p.id = c.project_id WHERE {SCOPED.replace('src1', 'fr/src3')}")
def scope_filter(t):
    return scope.in_scope(t.chunks_text, scope.scope_ids(t, "fr/src3")).select("id")


FILTERED = "SELECT DISTINCT p.id, p.name, p.root_path FROM projects p LEFT JOIN workspace_projects wp ON wp.project_id = p.id LEFT JOIN workspaces w ON w.id = wp.workspace_id WHERE w.name = 'de' AND (p.name = 'src1' OR p.root_path ILIKE '%src1%' OR w.name || '/' || p.name = 'src1')"


@query(FILTERED)
def filtered_projects(t):
    return scope.filtered_projects(t, "de", "src1")


@query("SELECT id, name FROM projects WHERE len([]::VARCHAR[]) = 0 AND name IN ('src1', 'src5')")
def list_filter(t):
    return scope.in_list(scope.in_list(t.projects, "name", []), "name", ["src1", "src5"]).select("id", "name")


@query("SELECT id FROM chunks WHERE file_path ILIKE '%/de/1%' OR language ILIKE '%/de/1%' OR chunk_type ILIKE '%/de/1%' OR symbol_name ILIKE '%/de/1%'")
def multi_contains(t):
    return t.chunks_text.filter(predicates.multi_contains([F.col(c) for c in ("file_path", "language", "chunk_type", "symbol_name")], " /de/1 ")).select("id")


@query("SELECT id FROM chunks WHERE file_path = 'en/1_.txt' OR file_path ILIKE '%en/1_.txt'")
def suffix_match(t):
    return t.chunks_text.filter(predicates.suffix_match(F.col("file_path"), "en/1_.txt")).select("id")


# text -----------------------------------------------------------------------------------------------------------

SENTENCE = "regexp_replace(trim(regexp_replace({}, '\\s+', ' ', 'g')), '^[\"''.;,]+|[\"''.;,]+$', '', 'g')"
KEY = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({SENTENCE.format('text')}) AS sentence, md5(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '^[\"'']+|[\"'']+$', '', 'g')) AS evidence, md5({KEY.format('text')}) AS key FROM documents")
def normalize_text(t):
    x = F.col("text")
    return t.raw("documents").select("doc_id", F.md5(X.normal_sentence(x).cast("binary")).alias("sentence"), F.md5(X.normal_evidence(x).cast("binary")).alias("evidence"), F.md5(X.normal_key(x).cast("binary")).alias("key"))


@query(f"SELECT doc_id, CASE WHEN length(s) <= 30 THEN s ELSE rtrim(substr(s, 1, 30)) || '...' END AS title FROM (SELECT doc_id, {SENTENCE.format('text')} AS s FROM documents)")
def to_title(t):
    return t.raw("documents").select("doc_id", X.to_title(F.col("text"), 30).alias("title"))


@query("SELECT doc_id, CASE WHEN length(text) <= 600 THEN text ELSE substr(text, 1, 600) || '...' END AS content FROM documents")
def truncate_content(t):
    return t.raw("documents").select("doc_id", X.truncated(F.col("text"), 600).alias("content"))


@query("SELECT doc_id, trim(string_split(substr(text, 1, strpos(text, 'thble') - 1), chr(10))[-1] || string_split(substr(text, strpos(text, 'thble')), chr(10))[1]) AS line FROM documents WHERE contains(text, 'thble')")
def evidence_line(t):
    return t.raw("documents").filter(F.col("text").contains("thble")).select("doc_id", X.evidence_line(F.col("text"), F.locate("thble", F.col("text"))).alias("line"))


@query("SELECT doc_id, least(greatest(CASE WHEN v > 0 THEN v ELSE 0.72 END, 0.10), 0.95)::DOUBLE AS confidence FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE ((n_chars % 130) / 100.0)::DECIMAL(5, 2) END AS v FROM documents)")
def normalize_confidence(t):
    value = F.when(F.col("doc_id") % 9 != 0, ((F.col("n_chars") % 130) / 100).cast("decimal(5,2)"))
    return t.raw("documents").select("doc_id", X.normal_confidence(value, 0.72).cast("double").alias("confidence"))


@query("SELECT event_id, CASE WHEN lower(k) IN ('integration', 'pattern') THEN lower(k) ELSE 'technical' END AS kind FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Integration' WHEN 1 THEN 'pattern' WHEN 2 THEN event_type END AS k FROM events)")
def normalize_kind(t):
    told = F.when(F.col("event_id") % 4 == 0, " Integration ").when(F.col("event_id") % 4 == 1, "pattern").when(F.col("event_id") % 4 == 2, F.col("event_type"))
    return t.raw("events").select("event_id", X.normal_kind(told).alias("kind"))


@query("SELECT doc_id, unnest(regexp_extract_all(text, '(?i)([a-z]+) under the ([A-Z][A-Za-z ]+)', 2)) AS found FROM documents")
def regex_extract(t):
    return t.raw("documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("(?i)([a-z]+) under the ([A-Z][A-Za-z ]+)"), F.lit(2))).alias("found"))


@query("SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) BETWEEN 18 AND 260 AND (contains(lower(x), 'licensed') OR contains(lower(x), 'thble')))) AS line FROM documents")
def relevant_lines(t):
    return t.raw("documents").select("doc_id", F.explode(X.relevant_lines(F.col("text"), ("Licensed", "thble"))).alias("line"))


@query("SELECT doc_id, length(text) >= 12 AND (contains(lower(text), 'thble') OR contains(lower(text), 'license')) AS is_rule, contains(lower(text), 'all rights') OR contains(lower(text), 'retorna ') AS is_technical FROM documents")
def classify_text(t):
    return t.raw("documents").select("doc_id", X.looks_like_rule(F.col("text"), ("thble", "license")).alias("is_rule"), X.looks_technical(F.col("text"), ("all rights", "retorna ")).alias("is_technical"))


@query(f"SELECT d.doc_id, length(e) >= 8 AND (contains(lower(text), lower(e)) OR contains(lower(text), lower({SENTENCE.format('e')}))) AS holds FROM d JOIN (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lower(substr(text, 3, 20)) WHEN 1 THEN '\"' || substr(text, 1, 12) || '\"' ELSE substr(text, 1, 5) END AS e FROM documents) USING (doc_id)")
def evidence_gate(t):
    e = F.when(F.col("doc_id") % 3 == 0, F.lower(F.substring("text", 3, 20))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit('"'), F.substring("text", 1, 12), F.lit('"'))).otherwise(F.substring("text", 1, 5))
    return t.raw("documents").select("doc_id", X.evidence_holds(F.col("text"), e).alias("holds"))


@query("SELECT id, content_hash FROM chunks")
def content_hash(t):
    return t.chunks_text.select("id", "content_hash")


LANGS = "CASE id % 5 WHEN 0 THEN 'csharp' WHEN 1 THEN 'sql' WHEN 2 THEN 'markdown' WHEN 3 THEN 'json' END"


@query(f"""SELECT c.id, md5('[CONTEXT: ' || concat_ws(' | ', 'Project: ' || p.name, 'File: ' || file_path, CASE l WHEN 'csharp' THEN 'Lang: C#' WHEN 'sql' THEN 'Lang: SQL' WHEN 'markdown' THEN 'Lang: Markdown' ELSE 'Lang: ' || l END,
CASE WHEN l IN ('csharp', 'sql') THEN 'Symbol: ' || symbol_name WHEN l = 'markdown' THEN 'Section: ' || symbol_name END, CASE WHEN l = 'csharp' THEN 'ChunkType: ' || chunk_type END) || ']' || chr(10) || content) AS digest
FROM (SELECT *, {LANGS} AS l FROM chunks) c JOIN projects p ON p.id = c.project_id""")
def contextual_content(t):
    lang = F.get(F.array(*map(F.lit, ("csharp", "sql", "markdown", "json"))), (F.col("id") % 5).cast("int"))
    rows = t.chunks_text.join(t.projects.select(F.col("id").alias("project_id"), "name"), "project_id")
    return rows.select("id", F.md5(X.contextual(F.col("name"), F.col("file_path"), lang, F.col("symbol_name"), F.col("chunk_type"), F.col("content")).cast("binary")).alias("digest"))


@query("SELECT id, CASE id % 4 WHEN 0 THEN 'csharp' WHEN 1 THEN 'markdown' WHEN 2 THEN 'yml' ELSE '' END AS language FROM chunks")
def lang_map(t):
    ext = F.get(F.array(*map(F.lit, (".CS", ".md", ".Yml", ""))), (F.col("id") % 4).cast("int"))
    return t.chunks_text.select("id", X.language_of(F.concat(F.lit("a.b/c"), ext)).alias("language"))


@query("SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS digest FROM documents")
def compress_evidence(t):
    return t.raw("documents").select("doc_id", F.md5(X.compress_evidence(F.col("text")).cast("binary")).alias("digest"))


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(text, '. ', '.' || chr(10) || chr(10) || chr(10) || chr(10)), '\\n([ \\t\\r]*\\n){2,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g'))) AS digest FROM documents")
def squeeze_blank_lines(t):
    return t.raw("documents").select("doc_id", F.md5(X.squeeze_blank_lines(F.replace(F.col("text"), F.lit(". "), F.lit(".\n\n\n\n"))).cast("binary")).alias("digest"))


@query("SELECT id, array_to_string(list_filter(regexp_split_to_array(lower(full_name), '[ ._()]'), lambda x: length(x) > 2), ',') AS terms FROM symbols")
def query_terms(t):
    return t.symbols.select("id", F.array_join(X.query_terms(F.col("full_name")), ",").alias("terms"))


@query("SELECT id, string_split(full_name, '.')[-1] AS name FROM symbols")
def simple_symbol(t):
    return t.symbols.select("id", X.simple_symbol(F.concat("full_name", F.lit("<T>(int a, b.C d)"))).alias("name"))


@query()
def compress_code(t):
    return t.chunks_text.select("id", compress.compressed("content", "symbol_name").alias("content"))


# reports --------------------------------------------------------------------------------------------------------


@query(f""", fp AS ({FILTERED}) SELECT (SELECT count(DISTINCT w.id) FROM workspaces w JOIN workspace_projects wp ON wp.workspace_id = w.id JOIN fp ON fp.id = wp.project_id WHERE w.name = 'de') AS workspaces, (SELECT count(*) FROM fp) AS projects, (SELECT count(*) FROM chunks c JOIN fp ON fp.id = c.project_id) AS chunks,
(SELECT count(DISTINCT c.project_id::VARCHAR || ':' || c.file_path) FROM chunks c JOIN fp ON fp.id = c.project_id) AS files, (SELECT count(*) FROM rules r JOIN fp ON fp.id = r.project_id) AS business_rules, (SELECT count(*) FROM knowledge k JOIN fp ON fp.id = k.project_id) AS knowledge, (SELECT epoch(max(c.updated_at))::BIGINT FROM chunks c JOIN fp ON fp.id = c.project_id) AS last_updated""")
def overview_counts(t):
    return reports.overview(t, "de", "src1").withColumn("last_updated", F.unix_timestamp("last_updated"))


@query("SELECT w.name, count(DISTINCT p.id) AS projects, count(DISTINCT c.id) AS chunks, count(DISTINCT r.id) AS business_rules, count(DISTINCT k.id) AS knowledge, epoch(max(c.updated_at))::BIGINT AS last_updated FROM workspaces w LEFT JOIN workspace_projects wp ON wp.workspace_id = w.id LEFT JOIN projects p ON p.id = wp.project_id LEFT JOIN chunks c ON c.project_id = p.id LEFT JOIN rules r ON r.project_id = p.id LEFT JOIN knowledge k ON k.project_id = p.id GROUP BY w.name")
def workspace_summary(t):
    return reports.workspace_summary(t).withColumn("last_updated", F.unix_timestamp("last_updated"))


PROJECTS = """, fp AS (SELECT * FROM projects) SELECT fp.name, fp.root_path, coalesce((SELECT string_agg(DISTINCT w.name, ' | ' ORDER BY w.name) FROM workspace_projects wp JOIN workspaces w ON w.id = wp.workspace_id WHERE wp.project_id = fp.id), '') AS workspaces,
(SELECT count(*) FROM chunks c WHERE c.project_id = fp.id) AS chunks, (SELECT count(DISTINCT file_path) FROM chunks c WHERE c.project_id = fp.id) AS files, (SELECT count(*) FROM rules r WHERE r.project_id = fp.id) AS business_rules, (SELECT count(*) FROM knowledge k WHERE k.project_id = fp.id) AS knowledge,
(SELECT epoch(max(updated_at))::BIGINT FROM chunks c WHERE c.project_id = fp.id) AS last_updated, coalesce((SELECT string_agg(DISTINCT language, ', ' ORDER BY language) FROM chunks c WHERE c.project_id = fp.id), '') AS languages FROM fp ORDER BY chunks DESC, name LIMIT 15"""


@query(PROJECTS)
def project_summary(t):
    return reports.project_summary(t, limit=15).withColumn("last_updated", F.unix_timestamp("last_updated"))


@query("SELECT c.id, p.name AS project, coalesce((SELECT string_agg(DISTINCT w.name, ' | ' ORDER BY w.name) FROM workspace_projects wp JOIN workspaces w ON w.id = wp.workspace_id WHERE wp.project_id = p.id), '') AS workspaces, file_path, language, chunk_type, symbol_name, length(content)::BIGINT AS content_length, embedding IS NOT NULL AS has_embedding, epoch(updated_at)::BIGINT AS updated_at FROM chunks c JOIN projects p ON p.id = c.project_id WHERE symbol_name ILIKE '%Sym1%' ORDER BY updated_at DESC, c.id DESC LIMIT 100")
def chunk_listing(t):
    return reports.chunk_listing(t, search="Sym1").withColumn("updated_at", F.unix_timestamp("updated_at"))


@query("SELECT r.id, p.name AS project, title, description, source_file, symbol_name, status, evidence, confidence::DOUBLE AS confidence, epoch(updated_at)::BIGINT AS updated_at FROM rules r JOIN projects p ON p.id = r.project_id WHERE title ILIKE '%the%' OR description ILIKE '%the%' OR source_file ILIKE '%the%' OR symbol_name ILIKE '%the%' OR status ILIKE '%the%' OR evidence ILIKE '%the%' ORDER BY r.updated_at DESC, r.id DESC LIMIT 100")
def rules_listing(t):
    return reports.rules_listing(t, search="the").withColumns({"updated_at": F.unix_timestamp("updated_at"), "confidence": F.col("confidence").cast("double")})


@query("SELECT k.id, p.name AS project, kind, title, content, source, symbol_name, status, evidence, confidence::DOUBLE AS confidence, epoch(updated_at)::BIGINT AS updated_at FROM knowledge k JOIN projects p ON p.id = k.project_id WHERE kind ILIKE '%pattern%' OR title ILIKE '%pattern%' OR content ILIKE '%pattern%' OR source ILIKE '%pattern%' OR symbol_name ILIKE '%pattern%' OR status ILIKE '%pattern%' OR evidence ILIKE '%pattern%' ORDER BY k.updated_at DESC, k.id DESC LIMIT 100")
def knowledge_listing(t):
    return reports.knowledge_listing(t, search="pattern").withColumns({"updated_at": F.unix_timestamp("updated_at"), "confidence": F.col("confidence").cast("double")})


def _fact_counts(name: str, source: str) -> str:
    table = "rules" if name == "business_rules" else name
    return f"(SELECT count(*) FROM {table} WHERE status = 'candidate') AS candidate_{name}, " + ", ".join(f"(SELECT count(*) FROM {table} WHERE status <> 'rejected' AND nullif(trim(coalesce({c}, '')), '') IS NULL) AS {name}_without_{label}" for c, label in (("evidence", "evidence"), (source, "source")))


@query(f"SELECT (SELECT count(*) FROM chunks WHERE embedding IS NULL) AS chunks_without_embedding, (SELECT count(*) FROM projects p WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.project_id = p.id)) AS projects_without_chunks, (SELECT count(*) FROM (SELECT name FROM projects GROUP BY name HAVING count(*) > 1)) AS duplicate_project_names, (SELECT count(*) FROM chunks c LEFT JOIN projects p ON p.id = c.project_id WHERE p.id IS NULL) AS broken_chunk_references, {_fact_counts('business_rules', 'source_file')}, {_fact_counts('knowledge', 'source')}")
def health_report(t):
    return reports.health(t)


@query("SELECT p.name, count(c.id) AS chunks FROM projects p LEFT JOIN chunks c ON c.project_id = p.id GROUP BY p.name")
def chunks_per_project(t):
    return reports.chunks_per_project(t)


@query("SELECT text AS name, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(t):
    return reports.duplicate_names(t.raw("documents").select(F.col("text").alias("name")))


@query("SELECT id, name FROM projects p WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.project_id = p.id AND c.language = 'es' AND c.id % 3 = 0)")
def projects_without_chunks(t):
    some = t.chunks_text.filter("language = 'es' AND id % 3 = 0").select(F.col("project_id").alias("id"))
    return t.projects.join(some, "id", "left_anti").select("id", "name")


@query("SELECT c.id FROM chunks c LEFT JOIN (SELECT * FROM projects WHERE id % 2 = 0) p ON p.id = c.project_id WHERE p.id IS NULL")
def broken_refs(t):
    return t.chunks_text.join(t.projects.filter("id % 2 = 0").select(F.col("id").alias("project_id")), "project_id", "left_anti").select("id")


@query("SELECT c.id, p.name AS project FROM chunks c JOIN projects p ON p.id = c.project_id")
def join_inner(t):
    return t.chunks_text.join(t.projects.select(F.col("id").alias("project_id"), F.col("name").alias("project")), "project_id").select("id", "project")


@query("SELECT w.id AS workspace_id, p.id AS project_id FROM (SELECT * FROM workspaces WHERE name = 'de') w, (SELECT * FROM projects WHERE name = 'src2') p")
def cross_link(t):
    one = t.workspaces.filter("name = 'de'").select(F.col("id").alias("workspace_id"), F.lit(1).alias("k"))
    return one.join(t.projects.filter("name = 'src2'").select(F.col("id").alias("project_id"), F.lit(1).alias("k")), "k").drop("k")


@query("SELECT project_id, string_agg(DISTINCT symbol_name, ', ' ORDER BY symbol_name) AS symbols FROM chunks GROUP BY project_id")
def string_agg_distinct(t):
    return t.chunks_text.groupBy("project_id").agg(F.nullif(F.array_join(F.array_sort(F.collect_set("symbol_name")), ", "), F.lit("")).alias("symbols"))


WORK = f", work AS (SELECT c.*, p.name AS project, s.status AS state, s.content_hash AS state_hash FROM chunks c JOIN projects p ON p.id = c.project_id JOIN workspace_projects wp ON wp.project_id = p.id JOIN workspaces w ON w.id = wp.workspace_id LEFT JOIN extraction_state s ON s.chunk_id = c.id AND s.stage = 'rules' WHERE w.name = 'en' AND ({INDEXABLE}))"
CAND = f"({LIKE})"


@query(f"""{WORK} SELECT count(*) AS total_chunks, count(*) FILTER ({CAND}) AS candidate_chunks, count(*) FILTER ({CAND} AND state = 'processed' AND state_hash = content_hash) AS processed_candidate_chunks, count(*) FILTER ({CAND} AND state IS NULL) AS pending_candidate_chunks, count(*) FILTER ({CAND} AND state = 'failed' AND state_hash = content_hash) AS failed_candidate_chunks,
count(*) FILTER ({CAND} AND state IS NOT NULL AND state_hash <> content_hash) AS changed_candidate_chunks, count(*) FILTER ({CAND} AND (state IS NULL OR state_hash <> content_hash OR state = 'failed')) AS actionable_candidate_chunks FROM work""")
def extraction_stats(t):
    return reports.extraction_stats(t, indexable_chunks(t), predicates.rule_candidate(WORDS), "en")


@query(f"{WORK} SELECT CASE WHEN state = 'failed' THEN 0 WHEN state IS NULL OR state_hash <> content_hash THEN 1 ELSE 2 END::INT AS bucket, id, project, file_path, language, chunk_type, symbol_name, content, content_hash, epoch(updated_at)::BIGINT AS updated_at FROM work WHERE {CAND} AND (state IS NULL OR state_hash <> content_hash OR state = 'failed') AND project IN ('src1', 'src2', 'src3') ORDER BY bucket, work.updated_at DESC, id DESC LIMIT 40")
def extraction_queue(t):
    return reports.extraction_queue(t, indexable_chunks(t), predicates.rule_candidate(WORDS), "en", ["src1", "src2", "src3"], limit=40).withColumn("updated_at", F.unix_timestamp("updated_at"))


# graph ----------------------------------------------------------------------------------------------------------

EDGES = ", e AS (SELECT ps.name AS sp, s.full_name AS sn, s.file_path AS sf, pt.name AS tp, g.full_name AS tn, g.file_path AS tf, relation FROM relations r JOIN symbols s ON s.id = r.source_id JOIN symbols g ON g.id = r.target_id JOIN projects ps ON ps.id = s.project_id JOIN projects pt ON pt.id = g.project_id)"


@query(f"{EDGES} SELECT sp AS project, sn AS symbol, sf AS file_path, relation FROM e WHERE tn ILIKE '%_1_' AND tp = 'src3'")
def symbol_callers(t):
    return graph.callers(t, "_1_", "src3")


@query(f"{EDGES} SELECT tp AS project, tn AS symbol, tf AS file_path, relation FROM e WHERE sn ILIKE '%_7'")
def symbol_callees(t):
    return graph.callees(t, "_7")


@query(f"{EDGES} SELECT tp AS project, tn AS parent, relation FROM e WHERE sn ILIKE '%_3' AND relation IN ('inherits', 'implements') AND sp = 'src3'")
def class_hierarchy(t):
    return graph.hierarchy(t, "_3", "src3")


@query("SELECT n.name, coalesce(min(s.id), -1) AS id FROM (SELECT 'src' || (range::VARCHAR) AS name FROM range(30)) n LEFT JOIN projects s ON s.name = n.name GROUP BY n.name")
def lookup_ids(t):
    return graph.lookup_ids(t.projects.withColumn("id", F.col("id").cast("bigint")), t.spark.range(30).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("name")), "name", -1)


@query(", w AS (SELECT '_' || range::VARCHAR AS name FROM range(40)) SELECT w.name, arg_min(s.full_name, s.id) AS full_name FROM w LEFT JOIN symbols s ON ends_with(s.full_name, w.name) GROUP BY w.name")
def suffix_join(t):
    wanted = t.spark.range(40).select(F.concat(F.lit("_"), F.col("id").cast("string")).alias("name"))
    return graph.suffix_join(wanted, t.symbols.withColumn("seq", F.col("id"))).select("name", "full_name")


FILES = ", f AS (SELECT DISTINCT '/src/' || file_path AS path FROM chunks), r AS (SELECT root_path AS root, id AS position FROM projects)"


@query(f"{FILES} SELECT path, arg_min(root, position) AS root FROM f LEFT JOIN r ON starts_with(lower(path), lower(root)) GROUP BY path")
def prefix_assign(t):
    paths = t.chunks_text.select(F.concat(F.lit("/src/"), "file_path").alias("path")).distinct()
    return predicates.prefix_assign(paths, t.projects.select(F.col("root_path").alias("root"), F.col("id").alias("position")))


@query(f"{FILES} SELECT path FROM f WHERE NOT EXISTS (SELECT 1 FROM r WHERE position % 3 = 0 AND starts_with(path, root || '/'))")
def anti_prefix_join(t):
    paths = t.chunks_text.select(F.concat(F.lit("/src/"), "file_path").alias("path")).distinct()
    return predicates.anti_prefix(paths, t.projects.filter("id % 3 = 0").select(F.col("root_path").alias("folder")))


# merges ---------------------------------------------------------------------------------------------------------

NEW = ", src AS (SELECT project_id, file_path, CASE WHEN id % 4 = 0 THEN 'n' || id ELSE content_hash END AS content_hash, 'xx' AS language, 'new ' || content AS content, id AS nid FROM chunks WHERE id % 2 = 0 AND id IN (SELECT min(id) FROM chunks GROUP BY project_id, file_path, content_hash)), tgt AS (SELECT * FROM chunks WHERE id IN (SELECT min(id) FROM chunks GROUP BY project_id, file_path, content_hash))"


def _least_chunks(t):
    # the least ids are told by narrow rows, so a text is shuffled once, for both joins
    least = t.chunks_text.groupBy("project_id", "file_path", "content_hash").agg(F.min("id").alias("id")).select("id")
    return t.chunks.join(least, "id", "left_semi")


def _renewed(target):
    return target.filter("id % 2 = 0").select("project_id", "file_path", F.when(F.col("id") % 4 == 0, F.concat(F.lit("n"), F.col("id").cast("string"))).otherwise(F.col("content_hash")).alias("content_hash"), F.lit("xx").alias("language"), F.concat(F.lit("new "), "content").alias("content"), "updated_at", "embedding")


def _chunk_merge(t):
    target = _least_chunks(t)
    return target, _renewed(target)


@query(f"{NEW} SELECT project_id, file_path, content_hash, CASE WHEN t.id IS NULL THEN s.language ELSE t.language END AS language, md5(CASE WHEN s.nid IS NULL THEN t.content ELSE s.content END) AS digest, CASE WHEN s.nid IS NULL THEN 'kept' WHEN t.id IS NULL THEN 'inserted' ELSE 'updated' END AS action FROM tgt t FULL OUTER JOIN src s USING (project_id, file_path, content_hash)")
def upsert_chunks(t):
    return merge.upsert_chunks(*_chunk_merge(t)).select("project_id", "file_path", "content_hash", "language", F.md5(F.col("content").cast("binary")).alias("digest"), "action")


@query(", s AS (SELECT '/src/src' || range::VARCHAR AS root_path, 'new' || range::VARCHAR AS name FROM range(15, 25)) SELECT coalesce(p.root_path, s.root_path) AS root_path, coalesce(s.name, p.name) AS name, CASE WHEN s.name IS NULL THEN 'kept' WHEN p.name IS NULL THEN 'inserted' ELSE 'updated' END AS action FROM projects p FULL OUTER JOIN s ON s.root_path = p.root_path")
def upsert_projects(t):
    source = t.spark.range(15, 25).select(F.concat(F.lit("/src/src"), F.col("id").cast("string")).alias("root_path"), F.concat(F.lit("new"), F.col("id").cast("string")).alias("name"))
    return merge.upsert_projects(t.projects, source).select("root_path", "name", "action")


@query(", s AS (SELECT 'de' AS workspace_id, range::INT AS project_id FROM range(15, 25)) SELECT workspace_id, project_id FROM workspace_projects UNION SELECT workspace_id, project_id FROM s")
def insert_ignore(t):
    source = t.spark.range(15, 25).select(F.lit("de").alias("workspace_id"), F.col("id").cast("int").alias("project_id"))
    return merge.insert_ignore(t.workspace_projects, source.unionByName(source), ["workspace_id", "project_id"])


@query("SELECT chunk_id, stage, CASE WHEN chunk_id % 3 = 0 THEN 'failed' ELSE status END AS status, CASE WHEN chunk_id % 3 = 0 THEN length(substr(content, 1, 2000)) END::INT AS error_length FROM extraction_state s JOIN (SELECT id AS cid, content FROM chunks) c ON c.cid = s.chunk_id")
def upsert_state(t):
    state = t.extraction_state.withColumn("error", F.lit(None).cast("string")).withColumn("updated_at", F.timestamp_seconds(F.col("id")))
    fresh = state.filter("chunk_id % 3 = 0").join(t.chunks_text.select(F.col("id").alias("chunk_id"), "content"), "chunk_id").withColumns({"error": F.col("content"), "status": F.lit("failed")}).select(*state.columns)
    return merge.upsert_state(state, fresh).select("chunk_id", "stage", "status", F.length("error").alias("error_length"))


@query("SELECT project_id, regexp_replace(full_name, '_[0-9]+$', '') AS full_name, max(id) AS id FROM symbols GROUP BY ALL")
def upsert_symbols(t):
    """Symbols without the number at the end of their names, so that many collapse."""
    found = t.symbols.select("id", "project_id", F.regexp_replace("full_name", "_[0-9]+$", "").alias("full_name"), F.col("id").alias("seq"))
    return merge.upsert_symbols(found).select("project_id", "full_name", "id")


def _candidates(t, kind: bool = False):
    rows = t.knowledge_text if kind else t.rules_text
    odd = rows.select((F.col("id") + 1_000_000).alias("cand_id"), F.when(F.col("id") % 10 == 0, F.lit(-1)).otherwise(F.col("chunk_id")).alias("chunk_id"), F.when(F.col("id") % 3 == 0, F.lower("title")).otherwise(F.concat(F.lit("x"), "title")).alias("title"),
                      F.when(F.col("id") % 5 == 0, F.col("content_hash")).otherwise(F.concat(F.lit("n"), "content_hash")).alias("content_hash"), *([F.upper("kind").alias("kind")] if kind else []))
    return odd


CANDS = ", c AS (SELECT id + 1000000 AS cand_id, CASE WHEN id % 10 = 0 THEN -1 ELSE chunk_id END AS chunk_id, CASE WHEN id % 3 = 0 THEN lower(title) ELSE 'x' || title END AS title, CASE WHEN id % 5 = 0 THEN content_hash ELSE 'n' || content_hash END AS content_hash{} FROM {})"
UPSERT = """{}, k AS (SELECT c.*, h.project_id FROM c LEFT JOIN chunks h ON h.id = c.chunk_id), hit AS (SELECT DISTINCT cand_id, r.id, r.status FROM k JOIN {} r ON r.project_id = k.project_id AND r.status <> 'rejected' AND (r.content_hash = k.content_hash OR (lower(r.title) = lower(k.title){})))
SELECT cand_id, id, status, 'updated' AS action, id = min(id) OVER (PARTITION BY cand_id) AS reported FROM hit UNION ALL SELECT cand_id, NULL, CASE WHEN project_id IS NOT NULL THEN 'candidate' END, CASE WHEN project_id IS NOT NULL THEN 'inserted' ELSE 'skipped' END, true FROM k WHERE cand_id NOT IN (SELECT cand_id FROM hit)"""
UPSERT_RULES = UPSERT.format(CANDS.format("", "rules"), "rules", "")


@query(UPSERT_RULES)
def upsert_rules(t):
    return merge.upsert_facts(t.rules_text, _candidates(t), t.chunks_text)


@query(UPSERT.format(CANDS.format(", upper(kind) AS kind", "knowledge"), "knowledge", " AND lower(r.kind) = lower(k.kind)"))
def upsert_knowledge(t):
    return merge.upsert_facts(t.knowledge_text, _candidates(t, True), t.chunks_text, by_kind=True)


@query(", u AS (SELECT * FROM (WITH RECURSIVE " + CTES.strip() + UPSERT_RULES + ")) SELECT action, count(*) AS n FROM u WHERE reported GROUP BY action")
def upsert_action_counts(t):
    return merge.action_counts(merge.upsert_facts(t.rules_text, _candidates(t), t.chunks_text))


@query(f"SELECT id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM chunks m WHERE m.project_id = c.project_id AND m.file_path = c.file_path AND m.{MARK} AND m.project_id % 2 = 0)")
def delete_marker_files(t):
    doomed = predicates.marked_files(t.chunks_text.filter("project_id % 2 = 0"), predicates.ilike_any(F.col("content"), ["licensed under"]))
    return merge.delete_files(t.chunks_text, doomed).select("id")


@query("SELECT id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM chunks m WHERE m.project_id = c.project_id AND m.file_path = c.file_path AND m.content ILIKE '%public license%')")
def delete_test_files(t):
    return merge.delete_files(t.chunks_text, predicates.test_files(t.chunks_text, t.projects, predicates.ilike_any(F.col("content"), ["public license"]))).select("id")


@query("SELECT id FROM chunks WHERE project_id <> 3 OR file_path ILIKE '%/en/%'")
def orphan_delete(t):
    return merge.delete_orphans(t.chunks_text, t.chunks_text.filter(F.col("file_path").contains("/en/")).select("file_path"), 3).select("id")


# extraction and chunks ------------------------------------------------------------------------------------------

def _titled(x: str, most: int) -> str:
    return f"CASE WHEN length({SENTENCE.format(x)}) <= {most} THEN {SENTENCE.format(x)} ELSE rtrim(substr({SENTENCE.format(x)}, 1, {most})) || '...' END"


def _holds_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), '{w.lower()}')" for w in words) + ")"


#: Projects that are broadcast to texts.
FEW_PROJECTS = 10_000


def _with_project(t, rows):
    """rows with the name of their project. So few are broadcast, and no text is shuffled for them; more are joined."""
    names = t.projects.select(F.col("id").alias("project_id"), F.col("name").alias("project"))
    return rows.join(F.broadcast(names) if names.limit(FEW_PROJECTS + 1).count() <= FEW_PROJECTS else names, "project_id")


def _code(t):
    """Code of the texts: every line without quotes, three of four as the message of a statement if it is of fitting length."""

    def line(x, i):
        bare = F.replace(x, F.lit('"'), F.lit(""))
        n = F.length(bare)
        told = F.when((i % 4 == 0) & n.between(12, 240), F.concat(F.lit('throw new My.BusinessException("'), bare, F.lit('");')))
        told = told.when((i % 4 == 1) & n.between(12, 240), F.concat(F.lit('  x.WithMessage("'), bare, F.lit('");')))
        return told.when((i % 4 == 2) & n.between(8, 240), F.concat(F.lit('AddErro<T>(a, "'), bare, F.lit('");'))).otherwise(bare)

    text = F.array_join(F.transform(F.split("content", "\n"), line), "\n")
    return _with_project(t, t.chunks_text).select("id", "project", "file_path", "symbol_name", text.alias("content"))


@query(f"""{chr(44)} l AS (SELECT id, project, i - 1 AS i, replace(x, chr(34), '') AS x FROM (SELECT c.id, p.name AS project, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM chunks c JOIN projects p ON p.id = c.project_id)),
k AS (SELECT *, CASE WHEN i % 4 < 2 AND length(x) BETWEEN 12 AND 240 OR i % 4 = 2 AND length(x) BETWEEN 8 AND 240 THEN [0, 1, 2, 3][(i % 4 + 1)::INT] ELSE 3 END AS pass FROM l),
c AS (SELECT *, regexp_replace(CASE pass WHEN 0 THEN 'throw new My.BusinessException("' || x || '");' WHEN 1 THEN '  x.WithMessage("' || x || '");' WHEN 2 THEN 'AddErro<T>(a, "' || x || '");' ELSE x END, '^\\s+|\\s+$', '', 'g') AS line FROM k),
m AS (SELECT id, project, i, pass, {SENTENCE.format('x')} AS message, line, [0.88, 0.78, 0.84][pass + 1]::DOUBLE AS confidence FROM c WHERE pass < 3
UNION ALL SELECT id, project, i, 3, {SENTENCE.format('line')}, line, 0.64 FROM c WHERE length(line) BETWEEN 18 AND 260 AND {_holds_any('line', X.LINE_WORDS)}),
r AS (SELECT * FROM m WHERE length(message) >= 12 AND {_holds_any('message', X.RULE_WORDS)} AND (pass < 3 OR length(message) <= 220) QUALIFY row_number() OVER (PARTITION BY id, lower(message) ORDER BY pass, i) = 1),
o AS (SELECT id AS chunk_id, project, {_titled('message', 90)} AS title, CASE WHEN ends_with(message, '.') THEN message ELSE message || '.' END AS description, {_titled('line', 500)} AS evidence, confidence FROM r)
SELECT chunk_id, title, description, evidence, sha256(project || '|rule|' || {KEY.format('title')}) AS content_hash, confidence FROM o""")
def extract_rules(t):
    found = extraction.extract_rules(_code(t))
    return found.select("chunk_id", "title", "description", "evidence", "content_hash", F.col("confidence").cast("double").alias("confidence"))


KNOWN = ", ".join(f"('{w}', '{title}', '{kind}', {c}, '{extraction.SENTENCES[kind]}')" for w, title, kind, c in extraction.KEYWORDS)


@query(f"""{PLANTED} SELECT c.id AS chunk_id, kind, p.name || ': ' || title AS title, replace(replace(body, '{{0}}', p.name), '{{1}}', word) AS content, confidence::DOUBLE AS confidence, sha256(p.name || '|knowledge|' || kind || '|' || {KEY.format('title')} || '|' || file_path) AS content_hash
FROM chunks2 c JOIN projects p ON p.id = c.project_id JOIN (VALUES {KNOWN}) v(word, title, kind, confidence, body) ON contains(lower(c.content), lower(word))""")
def keyword_knowledge(t):
    rows = _planted(t).join(t.projects.select(F.col("id").alias("project_id"), F.col("name").alias("project")), "project_id").select("id", "project", "file_path", "symbol_name", "content")
    found = extraction.keyword_knowledge(rows)
    return found.select("chunk_id", "kind", "title", "content", F.col("confidence").cast("double").alias("confidence"), "content_hash")


DEDUP = "row_number() OVER (PARTITION BY doc_id % 50, {} trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) ORDER BY n_chars % 90 DESC, doc_id) = 1"


@query(f"SELECT doc_id FROM (SELECT doc_id, {DEDUP.format('')} AS k FROM documents) WHERE k")
def dedup_rules(t):
    return extraction.dedup_rules(t.raw("documents").select("doc_id", (F.col("doc_id") % 50).alias("chunk_id"), F.col("text").alias("title"), (F.col("n_chars") % 90).alias("confidence"), F.col("doc_id").alias("seq"))).select("doc_id")


@query(f"SELECT doc_id FROM (SELECT doc_id, {DEDUP.format('lang,')} AS k FROM documents) WHERE k")
def dedup_knowledge(t):
    return extraction.dedup_knowledge(t.raw("documents").select("doc_id", (F.col("doc_id") % 50).alias("chunk_id"), F.upper("lang").alias("kind"), F.col("text").alias("title"), (F.col("n_chars") % 90).alias("confidence"), F.col("doc_id").alias("seq"))).select("doc_id")


@query("SELECT max(event_id) AS event_id FROM events GROUP BY lower(event_type || (user_id % 9))")
def dedup_keep_last(t):
    rows = t.raw("events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("a"), (F.col("user_id") % 9).cast("string").alias("b"))
    return config.dedup_keep_last(rows, ["a", "b"], ["event_id"]).select("event_id")


EVIDENCE = "regexp_replace(trim(regexp_replace({}, '\\s+', ' ', 'g')), '^[\"'']+|[\"'']+$', '', 'g')"
WHOLE = KEY.format("'Pedido deve ter cliente O pedido deve ter um cliente ' || e")


@query(f"""{chr(44)} e AS (SELECT c.id, p.name AS project, content, {EVIDENCE.format('content')} AS e FROM chunks c JOIN projects p ON p.id = c.project_id),
g AS (SELECT * FROM e WHERE length(e) >= 8 AND (contains(lower(content), lower(e)) OR contains(lower(content), lower({SENTENCE.format('e')}))) AND NOT {_holds_any(WHOLE, X.TECHNICAL_WORDS)})
SELECT id AS chunk_id, 0::INT AS seq, 'Pedido deve ter cliente' AS title, 'O pedido deve ter um cliente.' AS description, {_titled('e', 500)} AS evidence, 0.95::DOUBLE AS confidence, sha256(project || '|rule|pedido deve ter cliente') AS content_hash FROM g""")
def json_rules_parse(t):
    """Replies with comments, trailing commas and names of odd case, whose evidence is the whole text."""
    told = F.to_json(F.struct("content"))
    text = F.concat(F.lit('{"Rules": [ // found\n {"TITLE": "Pedido deve ter cliente", "description": "O pedido deve ter um cliente", "evidence": '), F.substring(told, F.lit(12), F.length(told) - 12), F.lit(', "confidence": 2.0,},]}'))
    rows = _with_project(t, t.chunks_text).select("id", "project", "content")
    return extraction.semantic_rules(rows, t.chunks_text.select("id", text.alias("reply"))).withColumn("confidence", F.col("confidence").cast("double"))


@query(r""", s AS (SELECT doc_id AS id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS x FROM documents),
w AS (SELECT id, x, 0 AS seq, 0::BIGINT AS start, substr(x, 1, 6000) AS piece FROM s WHERE length(x) > 0
UNION ALL SELECT id, x, seq + 1, start + CASE WHEN start + length(piece) < length(x) AND length(piece) - strpos(reverse(piece), chr(10)) > 200 AND strpos(reverse(piece), chr(10)) > 0 THEN length(piece) - strpos(reverse(piece), chr(10)) + 1 ELSE length(piece) END,
 substr(x, (start + CASE WHEN start + length(piece) < length(x) AND length(piece) - strpos(reverse(piece), chr(10)) > 200 AND strpos(reverse(piece), chr(10)) > 0 THEN length(piece) - strpos(reverse(piece), chr(10)) + 1 ELSE length(piece) END + 1)::INT, 6000) FROM w WHERE start + CASE WHEN start + length(piece) < length(x) AND length(piece) - strpos(reverse(piece), chr(10)) > 200 AND strpos(reverse(piece), chr(10)) > 0 THEN length(piece) - strpos(reverse(piece), chr(10)) + 1 ELSE length(piece) END < length(x)),
c AS (SELECT id, seq, regexp_replace(CASE WHEN start + length(piece) < length(x) AND length(piece) - strpos(reverse(piece), chr(10)) > 200 AND strpos(reverse(piece), chr(10)) > 0 THEN substr(piece, 1, length(piece) - strpos(reverse(piece), chr(10)) + 1) ELSE piece END, '^\s+|\s+$', '', 'g') AS content FROM w)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY seq) - 1)::INT AS seq, content FROM c WHERE length(content) >= 40""")
def split_chunks(t):
    return chunking.split_documents(t.raw("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))


@query(r""", l AS (SELECT doc_id, n, line, sum(CASE WHEN starts_with(line, 'The ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents))
SELECT doc_id AS id, min(trim(line)) FILTER (starts_with(line, 'The ')) AS heading, md5(regexp_replace(string_agg(line, chr(10) ORDER BY n), '\n+$', '')) AS digest FROM l WHERE s > 0 GROUP BY doc_id, s""")
def md_sections(t):
    found = chunking.sections(t.raw("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")), "The ")
    return found.select("id", "heading", F.md5(F.regexp_replace("content", r"\n+\z", "").cast("binary")).alias("digest"))


def _as_files(t, text, language: str) -> DataFrame:
    return t.raw("documents").select(F.col("doc_id").cast("string").alias("path"), F.lit(language).alias("language"), text.alias("content"))


@query("""SELECT doc_id::VARCHAR AS path, 0::INT AS seq, 'procedure' AS chunk_type, 'dbo.P' || doc_id AS symbol_name FROM documents UNION ALL SELECT doc_id::VARCHAR, 1::INT, 'sql', NULL FROM documents""")
def sql_batches(t):
    text = F.concat(F.lit("create procedure dbo.P"), F.col("doc_id").cast("string"), F.lit(" as select 1 from some_table where x = 2\n go \nselect a, b, c, d, e from another_table where y = 3\nGO\n \nGO"))
    return chunking.chunk_files(_as_files(t, text, "sql")).select("path", "seq", "chunk_type", "symbol_name")


CSHARP = "using System;\nnamespace Shop.Core;\npublic class Order{0} : Base{0}, IThing<int>\n{{\n    public int Size {{ get; set; }}\n    public Order{0}(int size) {{ Size = size; }}\n    public void Ship(string to) {{ Log(to); Check{0}(); }}\n    private bool Check{0}() => Size > 0;\n}}\npublic interface Base{0} {{ }}\n"


def _csharp(t):
    return F.replace(F.lit(CSHARP.format("@")), F.lit("@"), F.col("doc_id").cast("string"))


@query("""SELECT doc_id::VARCHAR AS path, 0::INT AS seq, 'type' AS chunk_type, 'Shop.Core.Order' || doc_id AS symbol_name FROM documents""")
def csharp_chunks(t):
    return chunking.chunk_files(_as_files(t, _csharp(t), "csharp")).select("path", "seq", "chunk_type", "symbol_name")


LONG_CSHARP = "using System;\nnamespace Shop.Core\n{{\n    public class Big{0}\n    {{\n        public int Size {{ get; set; }}\n        public void First(string to) {{ Log(to); /*#*/ }}\n        private bool Second() => Check(); /*#*/\n        public class Inner {{ }}\n    }}\n}}\n"


@query("SELECT doc_id::VARCHAR AS path, seq::INT AS seq, kind AS chunk_type, 'Shop.Core.Big' || doc_id || '.' || name AS symbol_name FROM documents, (VALUES (0, 'member', 'Size'), (1, 'member', 'First(string to)'), (2, 'member', 'Second()'), (3, 'type', 'Inner')) v(seq, kind, name)")
def csharp_member_chunks(t):
    text = F.replace(F.replace(F.lit(LONG_CSHARP.format("@")), F.lit("#"), F.repeat(F.lit("-"), 4000)), F.lit("@"), F.col("doc_id").cast("string"))
    return chunking.chunk_files(_as_files(t, text, "csharp")).select("path", "seq", "chunk_type", "symbol_name")


@query("SELECT doc_id::VARCHAR AS path, seq::INT AS seq, 'member' AS chunk_type, name || doc_id AS symbol_name, sha256(name || doc_id) AS told FROM documents, (VALUES (0, 'Load'), (1, 'Save')) v(seq, name)")
def csharp_regex_chunks(t):
    """A text without a type: each declaration to the next; what stands before the first goes."""
    n = F.col("doc_id").cast("string")
    text = F.concat(F.lit("// a fragment without a type, as in a note\n  private async Task<int> Load"), n, F.lit("(int id)\n  { return await Find(id, 1, 2, 3); }\npublic void Save"), n, F.lit("(Order order)\n{ Store(order, 1, 2, 3, 4, 5, 6); }\n"))
    found = chunking.chunk_files(_as_files(t, text, "csharp"))
    return found.select("path", "seq", "chunk_type", "symbol_name", F.sha2(F.regexp_extract("content", r"(\w+)\((?:int id|Order order)\)", 1), 256).alias("told"))


@query()
def chunk_documents(t):
    return chunking.chunk_files(t.raw("documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit("markdown").alias("language"), F.col("text").alias("content")))


@query("SELECT doc_id::VARCHAR AS path, kind, 'Shop.Core.' || replace(name, '@', doc_id::VARCHAR) AS full_name FROM documents, (VALUES ('class', 'Order@'), ('property', 'Order@.Size'), ('method', 'Order@.Ship'), ('method', 'Order@.Check@'), ('interface', 'Base@')) v(kind, name)")
def build_symbols(t):
    return chunking.build_symbols(_as_files(t, _csharp(t), "csharp")).select("path", "kind", "full_name")


@query("SELECT 'Shop.Core.Order' || doc_id AS source, 'Shop.Core.Base' || doc_id AS target, 'implements' AS relation FROM documents UNION ALL SELECT 'Shop.Core.Order' || doc_id || '.Ship', 'Shop.Core.Order' || doc_id || '.Check' || doc_id, 'calls' FROM documents")
def build_relations(t):
    return chunking.build_relations(chunking.build_symbols(_as_files(t, _csharp(t), "csharp")))


@query("SELECT 'r/' || CASE doc_id % 6 WHEN 0 THEN 'Bin' ELSE 'a' || (doc_id % 6) END || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.cs' WHEN 1 THEN '.MD' WHEN 2 THEN '.exe' ELSE '.sql' END AS path FROM documents WHERE doc_id % 6 <> 0 AND doc_id % 4 <> 2 AND n_chars * 100 < 512000")
def scan_files(t):
    folder = F.when(F.col("doc_id") % 6 == 0, "Bin").otherwise(F.concat(F.lit("a"), (F.col("doc_id") % 6).cast("string")))
    ext = F.get(F.array(*map(F.lit, (".cs", ".MD", ".exe", ".sql"))), (F.col("doc_id") % 4).cast("int"))
    listed = t.raw("documents").select(F.concat(F.lit("r/"), folder, F.lit("/"), F.col("doc_id").cast("string"), ext).alias("path"), (F.col("n_chars") * 100).alias("length"))
    return files.wanted_paths(listed).select("path")


# checks, configuration, JSON and streams ------------------------------------------------------------------------

CHECKED = ("projects", "workspaces", "workspace_projects", "chunks", "rules", "knowledge", "extraction_state", "symbols", "relations")
#: Columns that the logical tables over the test tables lack.
LACKING = {("rules", "created_at"), ("extraction_state", "processed_at"), ("extraction_state", "error"), ("extraction_state", "updated_at"), ("symbols", "chunk_id"), ("symbols", "line_start"), ("symbols", "line_end")}


def _checks(t):
    """The columns that the tables must have, with how many values each holds."""
    narrow = Filled(t.spark, t.sf_dir)
    there = schemas.filled_columns({name: getattr(narrow, name) for name in CHECKED})
    checks = schemas.schema_check(schemas.required_columns(t.spark).filter(F.col("table_name").isin(*CHECKED)), there)
    return checks.join(there, ["table_name", "column_name"], "left").select("table_name", "column_name", "status", "filled")


CHECKS = ", k AS (" + " UNION ALL ".join(f"SELECT '{name}' AS table_name, '{c}' AS column_name, " + (f"'MISSING' AS status, NULL::BIGINT AS filled" if (name, c) in LACKING else f"'OK' AS status, (SELECT count({c}) FROM {name}) AS filled") for name in CHECKED for c in schemas.TABLES[name].names) + ")"


@query(f"{CHECKS} SELECT * FROM k")
def schema_check(t):
    return _checks(t)


@query(f"{CHECKS} SELECT sum(filled)::BIGINT AS filled, count(*) AS checks, count(*) FILTER (status = 'OK') AS ok, count(*) FILTER (status <> 'OK') AS missing, bool_and(status = 'OK') AS all_ok, bool_or(status = 'OK') AS any_ok FROM k")
def check_summary(t):
    return schemas.check_summary(_checks(t))


@query("SELECT n_name AS name, sha256(n_name || r_name) AS content_hash FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey >= 12")
def pending_migrations(t):
    found = t.raw("nation").join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.concat("n_name", "r_name").alias("content"), "n_nationkey")
    return schemas.pending_migrations(found.select("name", "content"), found.filter("n_nationkey < 12").select("name"))


@query()
def config_flatten(t):
    listed = t.workspace_projects.join(t.projects.select(F.col("id").alias("project_id"), "name", F.col("root_path").alias("path")), "project_id").groupBy("workspace_id").agg(F.sort_array(F.collect_list(F.struct("name", "path"))).alias("projects"))
    whole = listed.agg(F.sort_array(F.collect_list(F.struct(F.col("workspace_id").alias("name"), "projects"))).alias("workspaces")).select(F.lit("EN").alias("activeWorkspace"), "workspaces")
    return config.flattened(whole)


@query("SELECT '{\"nNationkey\":' || n_nationkey || ',\"nName\":\"' || n_name || '\",\"nRegionkey\":' || n_regionkey || '}' AS json FROM nation")
def to_json_rows(t):
    return tables.json_rows(t.raw("nation").select("n_nationkey", "n_name", "n_regionkey"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS shown FROM orders")
def format_ts(t):
    return t.raw("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("shown"))


@query("SELECT change, count(*) AS n, count(DISTINCT path) AS paths FROM watch_events GROUP BY change")
def watch_events(t):
    return t.watch_events.groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("paths"))


@query("SELECT epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS start, count(DISTINCT path) AS paths, count(*) AS events FROM watch_events GROUP BY 1")
def watch_microbatch(t):
    return watch.micro_batches(t.watch_events, "1 hour").withColumn("start", F.unix_timestamp("start"))


@query("SELECT DISTINCT path FROM watch_events")
def watch_dedup(t):
    return watch.changed_paths(t.watch_events)


@query(""", g AS (SELECT path, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts) <= INTERVAL '1 hour' THEN 0 ELSE 1 END AS fresh FROM watch_events), s AS (SELECT path, ts, sum(fresh) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT path, epoch_us(min(ts)) AS start_us, count(*) AS events FROM s GROUP BY path, k""")
def watch_sessions(t):
    return watch.sessions(t.watch_events, "1 hour").select("path", F.unix_micros("start").alias("start_us"), "events")


@query(""", b AS (SELECT 'r/' || doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0), a AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'moved/' ELSE 'r/' END || doc_id AS path, sha256(CASE WHEN doc_id % 13 = 0 THEN 'x' ELSE '' END || text) AS h FROM documents WHERE doc_id % 5 <> 0),
f AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'created' WHEN a.path IS NULL THEN 'deleted' ELSE 'changed' END AS change, coalesce(a.h, b.h) AS h FROM a FULL OUTER JOIN b ON a.path = b.path WHERE a.h IS DISTINCT FROM b.h),
m AS (SELECT h, max(path) FILTER (change = 'deleted') AS old_path FROM f WHERE change <> 'changed' GROUP BY h HAVING count(*) FILTER (change = 'created') = 1 AND count(*) FILTER (change = 'deleted') = 1)
SELECT CASE WHEN m.h IS NOT NULL THEN 'renamed' ELSE change END AS change, path, old_path FROM f LEFT JOIN m ON m.h = f.h AND change <> 'changed' WHERE NOT (change = 'deleted' AND m.h IS NOT NULL)""")
def listing_changes(t):
    """Two listings of the documents: new, vanished, edited and moved ones, with equal texts among them."""
    at = lambda folder: F.concat(folder, F.col("doc_id").cast("string")).alias("path")
    docs = t.raw("documents")
    before = docs.filter("doc_id % 7 <> 0").select(at(F.lit("r/")), F.sha2("text", 256).alias("content_hash"))
    text = F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("x"), "text")).otherwise(F.col("text"))
    after = docs.filter("doc_id % 5 <> 0").select(at(F.when(F.col("doc_id") % 11 == 0, "moved/").otherwise("r/")), F.sha2(text, 256).alias("content_hash"))
    return changes.listing_changes(before, after)


SESSIONS = ORACLES["watch_sessions"]


@query()
def watch_debounce(t):
    """The sessions of the events, told by a stream that gets them in four runs; a last event ends all others."""
    root, spark = _scratch(t, "debounce"), t.spark
    events = t.watch_events.select("path", "ts")
    first, last = events.agg(F.min("ts"), F.max("ts")).head()
    if first is None:
        return t.watch_events.select("path", F.unix_micros("ts").alias("start_us"), F.lit(1).cast("long").alias("events"))
    part = F.least(F.lit(2), F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(first))) * 3 / F.greatest(F.lit(1), F.unix_micros(F.lit(last)) - F.unix_micros(F.lit(first)))))
    steps = [*(events.filter(part == k) for k in range(3)), spark.range(1).select(F.lit("").alias("path"), (F.lit(last) + F.expr("INTERVAL 2 DAYS")).alias("ts"))]
    for step in steps:
        step.write.mode("append").parquet(f"{root}/events")
        told = watch.debounced(spark.readStream.schema("path string, ts timestamp").parquet(f"{root}/events"), "1 hour", "1 hour")
        told.writeStream.outputMode("append").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/sessions").awaitTermination()
    return spark.read.schema("path string, start timestamp, end timestamp, events long").parquet(f"{root}/sessions").select("path", F.unix_micros("start").alias("start_us"), "events")


ORACLES["watch_debounce"] = SESSIONS


@query("""SELECT doc_id::VARCHAR AS file_path, sha256(text) AS content_hash, text AS content FROM documents WHERE doc_id % 5 <> 0
UNION ALL SELECT doc_id::VARCHAR, sha256('v2 ' || text), 'v2 ' || text FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 3 = 0""")
def watch_upsert(t):
    """A stream of paths over three states of the documents: all are there, some are edited, some vanish. An edited file
    keeps the chunks of its former content."""
    root, docs, spark = _scratch(t, "watch"), t.raw("documents"), t.spark
    store = ChunkStore(spark, f"{root}/chunks")
    states = [("true", docs), ("doc_id % 3 = 0", docs.withColumn("text", F.concat(F.lit("v2 "), "text"))), ("doc_id % 5 = 0", docs.filter("doc_id % 5 <> 0"))]
    for step, (changed, now) in enumerate(states):
        docs.filter(changed).select(F.col("doc_id").cast("string").alias("path")).write.mode("append").parquet(f"{root}/events")
        files = now.select(F.col("doc_id").alias("id"), F.lit(1).alias("project_id"), F.col("doc_id").cast("string").alias("file_path"), F.sha2("text", 256).alias("content_hash"), F.col("text").alias("content"), F.timestamp_seconds(F.lit(step)).alias("updated_at"))
        read = lambda paths, files=files: files.join(paths.withColumnRenamed("path", "file_path"), "file_path")
        stream = spark.readStream.schema("path string").parquet(f"{root}/events")
        watch.watch(stream, lambda paths, number, read=read: watch.apply_batch(paths, store, read, 1, number, delete_vanished=True, compact=2), f"{root}/state", once=True).awaitTermination()
    return store.read().select("file_path", "content_hash", "content")


@query(f"""{NEW}, u AS (SELECT project_id, file_path, content_hash, CASE WHEN t.id IS NULL THEN s.language ELSE t.language END AS language, CASE WHEN s.nid IS NULL THEN t.content ELSE s.content END AS content FROM tgt t FULL OUTER JOIN src s USING (project_id, file_path, content_hash))
SELECT project_id, file_path, content_hash, language, md5(content) AS digest FROM u WHERE project_id % 3 <> 0 UNION ALL SELECT project_id, file_path, content_hash, language, md5(content) FROM src WHERE project_id % 6 = 0""")
def store_merge(t):
    """The chunks after four batches: all, an upsert, and files taken away of which some are put again."""
    store = ChunkStore(t.spark, _scratch(t, "store"))
    store.write(_least_chunks(t))
    target = store.read()  # as it is after the first batch: later batches leave its files alone
    source = _renewed(target)
    store.write(source)
    store.write(source.filter("project_id % 6 = 0"), target.filter("project_id % 3 = 0"))
    digests = store.read(lambda content: F.md5(content.cast("binary")))
    return digests.select("project_id", "file_path", "content_hash", "language", F.col("content").alias("digest"))


@query("""SELECT doc_id, sha256(text) AS content_hash, CASE WHEN text IS NOT NULL THEN 64 END AS dims, (SELECT count(DISTINCT text) FROM benchmark) AS asked_first,
(SELECT count(DISTINCT text) FROM documents WHERE text NOT IN (SELECT text FROM benchmark WHERE text IS NOT NULL)) AS asked_then, 0::BIGINT AS asked_again FROM documents""")
def embed_reuse(t):
    """Vectors by content: the benchmark's texts are embedded, then the documents', then the documents' again; how many
    texts each filling asked for, and the vectors that the documents got."""
    docs, store = t.raw("documents"), VectorStore(t.spark, _scratch(t, "vectors"))
    told = [sum(store.fill(df)) for df in (t.raw("benchmark"), docs, docs)]
    counts = [F.lit(n).cast("long").alias(name) for n, name in zip(told, ("asked_first", "asked_then", "asked_again"), strict=True)]
    found = store.attach(docs.select("doc_id", "text"))
    size = F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dims")
    return found.select("doc_id", F.sha2("text", 256).alias("content_hash"), size, *counts)


TREE = "SELECT pid AS project_id, coalesce(lang, '') || '/' || (doc_id % 20) || '/' || doc_id || '.txt' AS path, sha256(text) AS content_hash, doc_id, text FROM d WHERE pid IS NOT NULL"


def _tree(docs: DataFrame) -> DataFrame:
    """The documents as files of a tree: three levels of folders below a source."""
    path = F.concat_ws("/", F.coalesce("lang", F.lit("")), (F.col("doc_id") % 20).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", F.substring("source", 4, 20).cast("int").alias("project_id"), path.alias("path"), F.sha2("text", 256).alias("content_hash"), "text").filter("project_id IS NOT NULL")


@query(f""", t AS ({TREE}), u AS (SELECT project_id, sha256(path || chr(0) || coalesce(content_hash, '')) AS h, unnest(list_distinct(['', split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)])) AS folder FROM t)
SELECT project_id, folder, count(*) AS files, {' || '.join(f"lpad(lower(to_hex((sum(('0x' || substr(h, {1 + 15 * k}, 15))::BIGINT) % 1152921504606846976)::BIGINT)), 15, '0')" for k in range(4))} AS digest FROM u GROUP BY ALL""")
def tree_digests(t):
    return digests.tree_digests(_tree(t.raw("documents")))


@query(f""", b AS ({TREE}), a AS (SELECT project_id, CASE WHEN project_id % 4 = 0 AND doc_id % 11 = 0 THEN 'moved/' ELSE '' END || path AS path, sha256(CASE WHEN project_id % 4 = 0 AND doc_id % 13 = 0 THEN 'x' ELSE '' END || text) AS content_hash FROM b WHERE project_id % 4 <> 0 OR doc_id % 5 <> 0),
f AS (SELECT project_id, path, CASE WHEN max(s) = 1 THEN 'deleted' WHEN min(s) = 2 THEN 'created' ELSE 'changed' END AS change, max_by(content_hash, s) AS h FROM (SELECT project_id, path, content_hash, 1 AS s FROM b UNION ALL SELECT project_id, path, content_hash, 2 FROM a) GROUP BY ALL HAVING count(*) = 1 OR min(content_hash) IS NULL OR min(content_hash) <> max(content_hash)),
m AS (SELECT project_id, h, max(path) FILTER (change = 'deleted') AS old_path FROM f WHERE change <> 'changed' AND h IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (change = 'created') = 1 AND count(*) FILTER (change = 'deleted') = 1)
SELECT f.project_id, CASE WHEN m.h IS NOT NULL THEN 'renamed' ELSE change END AS change, path, old_path FROM f LEFT JOIN m ON m.project_id = f.project_id AND m.h = f.h AND change <> 'changed' WHERE NOT (change = 'deleted' AND m.h IS NOT NULL)""")
def tree_changes(t):
    """A tree of all documents is committed; in some projects files are edited, moved and deleted; what has changed."""
    before = _tree(t.raw("documents"))
    store = digests.TreeStore(t.spark, _scratch(t, "tree"))
    store.commit(before)
    touched = F.col("project_id") % 4 == 0
    path = F.when(touched & (F.col("doc_id") % 11 == 0), F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    text = F.when(touched & (F.col("doc_id") % 13 == 0), F.concat(F.lit("x"), "text")).otherwise(F.col("text"))
    after = before.filter(~touched | (F.col("doc_id") % 5 != 0)).select("project_id", path.alias("path"), F.sha2(text, 256).alias("content_hash"))
    return store.changes(after)


#: Ignore rules by folder, the last that fits counts: names, an exception, a folder at the top, folders at any depth.
IGNORE = {"": ["*7.txt", "!*77.txt", "/de/", "1[0123]/"], "en": ["!*7.txt"]}


@query("""SELECT pid AS project_id, path FROM (SELECT pid, lang, doc_id, coalesce(lang, '') || '/' || (doc_id % 20) || '/' || doc_id || '.txt' AS path FROM d WHERE pid IS NOT NULL)
WHERE coalesce(lang, '') <> 'de' AND doc_id % 20 NOT BETWEEN 10 AND 13 AND (doc_id % 10 <> 7 OR doc_id % 100 = 77 OR coalesce(lang, '') = 'en')""")
def ignored_files(t):
    """The documents as files of a tree, without those that ignore rules leave out."""
    rules = [(folder, line, n) for folder, lines in IGNORE.items() for n, line in enumerate(lines)]
    listed = _tree(t.raw("documents")).select("project_id", "path")
    return files.not_ignored(listed, t.spark.createDataFrame(rules, "folder string, line string, number int"))
