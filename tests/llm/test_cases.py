"""Every operator over nulls in any column, empty and very long texts, ties, repeated rows, empty tables, and further
columns with clashing names."""

import numpy as np
import pytest

from skein.llm import bpe, decontamination, html_extract, langid, near_join, quality, suffix_dedup, toxicity, training_order, urls

LONG = " ".join(f"word{k % 997}" for k in range(60_000))
ROWS = [
    (1, "the cat sat on the mat and then it ran away from the big bad dog", "en", "a", None), (1, "the cat sat on the mat and then it ran away from the big bad dog", "en", "a", None),
    (2, None, "en", None, 3), (3, "", None, "a", 0), (4, "  \n\t ", "en", "a", None), (None, "tie tie tie", None, None, None), (5, LONG, "en", "a", None), (6, LONG, "de", "b", None), (7, "one", "de", "b", 1), (7, "two", "de", "b", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    """With further columns under names that the operators use inside."""
    from pyspark.sql import functions as F

    extra = {c: F.lit("clash") for c in ("d1", "d2", "h1", "w", "words", "shingles", "runs", "keys", "n", "word", "pos", "copy", "lines", "slot", "score", "rest", "kf_map", "data", "toxic", "item_id", "h", "o", "label")}
    return spark.createDataFrame(ROWS, SCHEMA).withColumns(extra)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "sat on the mat and then it ran away from the big", "x"), (2, None, "x"), (3, "", "x"), (4, "tie tie", "x"), (1, "sat on the mat and then it ran away from the big", "x"), (None, "one", "x")], "item_id long, text string, w string")


def empty(spark, df):
    return spark.createDataFrame([], df.schema)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_decontamination(spark, docs, bench):
    found = rows(decontamination.decontaminate(docs, bench), "doc_id", "n_words", "n_hit", "items")
    assert len(found) == len(ROWS)
    assert found.count((1, 16, 12, ["1"])) == 2 and (2, 0, 0, []) in found and (3, 0, 0, []) in found and (None, 3, 3, ["4"]) in found and (5, 60_000, 0, []) in found
    assert rows(decontamination.decontaminate(docs, empty(spark, bench)), "n_hit") == [(0,)] * len(ROWS)
    assert decontamination.decontaminate(empty(spark, docs), bench).count() == 0


def test_decontamination_without_broadcast(docs, bench):
    columns = "doc_id", "n_words", "n_hit", "items"
    assert rows(decontamination.decontaminate(docs, bench, broadcast_bytes=0), *columns) == rows(decontamination.decontaminate(docs, bench), *columns)


def test_near_join(spark, docs):
    found = rows(near_join.near_classes(docs), "doc_id", "class_id", "n_links", "n_copies")
    assert len(found) == len(ROWS)
    assert found.count((1, 1, 0, 1)) == 2 and (5, 5, 0, 1) in found and (6, 5, 0, 1) in found and (2, 2, 0, 0) in found and (3, 3, 0, 0) in found and (None, None, 0, 0) in found
    assert near_join.near_classes(empty(spark, docs)).count() == 0


def test_suffix_dedup(spark, docs):
    found = rows(suffix_dedup.dedup_bytes(docs), "doc_id", "n_bytes", "n_removed", "n_spans")
    size = len(LONG)
    assert len(found) == len(ROWS) and (5, size, size, 1) in found and (6, size, size, 1) in found and (2, 0, 0, 0) in found and found.count((1, 64, 0, 0)) == 2
    assert suffix_dedup.dedup_bytes(empty(spark, docs)).count() == 0


def test_quality(spark, docs):
    found = rows(quality.quality_rules(docs), "doc_id", "n_words", "word_chars", "n_repeat_words", "base_failed", "kept")
    assert len(found) == len(ROWS) and (2, 0, 0, 0, True, False) in found and (4, 0, 0, 0, True, False) in found
    assert [r for r in found if r[0] == 5][0][3] == 60_000
    assert quality.quality_rules(empty(spark, docs)).count() == 0


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 1), (5, 1, 0), (None, 1, 1), (6, None, None), (7, 1, 9)], "doc_id long, quality int, toxic int")
    scorer = toxicity.fitted(docs, labels)
    found = rows(toxicity.scored(docs, scorer), "doc_id", "toxicity")
    assert len(found) == len(ROWS) and all(0 <= s <= 1 for _, s in found)
    assert toxicity.scored(docs, toxicity.fitted(docs, empty(spark, labels))).count() == len(ROWS)
    assert toxicity.scored(empty(spark, docs), toxicity.fitted(empty(spark, docs), labels)).count() == 0


def test_language(spark, docs):
    found = rows(langid.identified(docs, langid.fitted(docs)), "doc_id", "lang_pred", "score")
    assert len(found) == len(ROWS) and (2, "und", 0.0) in found and (3, "und", 0.0) in found and (4, "und", 0.0) in found
    assert {r[1] for r in rows(langid.identified(docs, langid.fitted(empty(spark, docs))), "doc_id", "lang_pred")} == {"und"}
    assert langid.identified(empty(spark, docs), None).count() == 0
    # signs that are numbers but no letters
    signs = spark.createDataFrame([(1, "½ ²³ ③ 12 _"), (2, "½ é")], "doc_id long, text string")
    assert [(r["doc_id"], r["lang_pred"] == "und") for r in langid.identified(signs, langid.fitted(docs)).collect()] == [(1, True), (2, False)]


def test_bpe(spark, docs):
    path = bpe.vocabulary_path()
    coded = bpe.decode_documents(bpe.encode_documents(docs, path), path)
    assert all((r["text"] or "") == r["decoded"] and r["round_trip"] for r in coded.collect()) and coded.count() == len(ROWS)
    assert bpe.digests(empty(spark, docs), path).count() == 0 and bpe.encode_documents(empty(spark, docs), path).count() == 0
    assert [r["n_tokens"] for r in bpe.digests(docs.filter("doc_id = 2"), path).collect()] == [0]


@pytest.mark.parametrize("held", [training_order.HELD, 3000])
def test_training_order(spark, docs, tmp_path, monkeypatch, held):
    """Against the stream made by hand: every id, slot, shard, byte offset and manifest row; the same for any splits."""
    monkeypatch.setattr(training_order, "HELD", held)
    path = bpe.vocabulary_path()
    form, codec = training_order.form_of(path), bpe.Codec(path)
    docs.coalesce(1).write.option("parquet.block.size", 50_000).parquet(str(tmp_path / "docs"))
    scan = spark.read.parquet(str(tmp_path / "docs"))
    order = [(r["doc_id"], [*codec.encode(r["text"]), form.end]) for r in scan.coalesce(1).collect()]
    stream = [x for _, ids in order for x in ids]
    n = -(-len(stream) // training_order.SEQUENCE)
    slots = training_order.feistel(np.arange(n), n).tolist()
    want, at = [], 0
    for doc_id, ids in order:
        done = 0
        while done < len(ids):
            number, first = divmod(at + done, training_order.SEQUENCE)
            take = min(len(ids) - done, training_order.SEQUENCE - first)
            slot = slots[number]
            want.append((number, slot, slot // 64, slot % 64 * (2 * training_order.SEQUENCE + 1), first, take, doc_id, done))
            done += take
        at += len(ids)
    assert form.width == 2 and sorted(slots) == list(range(n)) and n > 128
    whole = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for bytes_a_split in (whole, "20000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_a_split)
            out = str(tmp_path / f"shards-{bytes_a_split}")
            found = training_order.materialise(spark.read.parquet(str(tmp_path / "docs")), out, path, shard=64)
            assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, want))
            records = training_order.read_slots(spark, out, 0, n - 1, form, shard=64)
            told = np.concatenate([records[s] for s in slots]).tolist()
            assert told[: len(stream)] == stream and set(told[len(stream) :]) <= {form.pad}
            assert [x.tolist() for x in training_order.read_slots(spark, out, 63, 65, form, shard=64)] == [records[s].tolist() for s in (63, 64, 65)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", whole)
    unscanned = spark.createDataFrame(ROWS, SCHEMA)
    assert training_order.materialise(unscanned, str(tmp_path / "unscanned"), path).select("doc_id").distinct().count() == 8
    assert training_order.materialise(empty(spark, docs), str(tmp_path / "none"), path).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "no host"), (4, "http://A.Net/es/1?x"), (4, "http://A.Net/es/1?x"), (None, "x://h/" + "a/" * 5000), (5, "http://www.example.com/en/2#top"), (6, "http://b.example.com/en/2"), (7, "://")], "page_id long, url string").selectExpr("*", "'x' host", "'y' template", "'z' rule", "1 segs")
    found = rows(urls.filter_urls(pages), "page_id", "host", "path", "rule", "verdict")
    assert len(found) == 9 and (1, "", "", None, "allow") in found and found.count((4, "a.net", "/es/1", "net/es/", "block")) == 2
    assert (5, "www.example.com", "/en/2", "www.example.com/en/", "allow") in found and (6, "b.example.com", "/en/2", "example.com/en/", "block") in found and (3, "", "", None, "allow") in found
    assert urls.filter_urls(empty(spark, pages)).count() == 0


def test_formulas_and_labels_of_drawings():
    def shown(inner):
        return [t for _, t in html_extract.Page(f"<article><p>Before{inner}after.</p></article>").blocks]

    assert shown('<math display="block"><mrow><mi>E</mi><mo>=</mo><mfrac><mn>17</mn><mi>k</mi></mfrac></mrow></math> ') == ["Before E = 17 k after."]
    assert shown('<svg><style>p {}</style><title>T</title><!-- <text>no</text> --><path d="M0"/><g><text x="1">Sales &amp; <tspan>costs</tspan></text><text/></g><foreignObject><div>label</div></foreignObject></svg>') == ["Before Sales & costs label after."]
    assert shown("<svg><path/></svg><script>x</script> ") == ["Before after."]


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<nav><a href=x>Home page</a></nav><article><p>A long text, with words. And &amp; more of it, too.</p></article>"), (3, "u", "<div>" * 20_000 + "x"), (3, "u", "<p" * 1000)], "page_id long, url string, html string").selectExpr("*", "1 text", "2 n_chars")
    found = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    assert found[1]["text"] == found[2]["text"] == "" and found[None]["text"] == "A long text, with words. And & more of it, too." and found[None]["n_chars"] == 47
    assert html_extract.extract(empty(spark, pages)).count() == 0


def test_intermediate_tables_pass(spark):
    from pathlib import Path

    from skein.llm import common

    folder = Path(common.shared_dir(spark).removeprefix("file://")) / "skein"
    with common.passing_tables(spark):
        found = common.stored(spark.range(3), "three")
        with common.passing_tables(spark):
            common.stored(found, "inner")
        assert found.count() == 3 and len(list(folder.glob("passing-*/three-*"))) == 1 and not list(folder.glob("passing-*/passing-*"))
    assert not list(folder.glob("passing-*"))


PIPELINE_LABELS = [(900 + i, 0, int(i % 2 == 0)) for i in range(20)]


@pytest.fixture(scope="module")
def pipeline_tables(spark, tmp_path_factory):
    """The tables beside documents, with repeated and null labels and items."""
    folder = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame([*PIPELINE_LABELS, (900, 0, 1), (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "sat on the mat and then it ran away from the big", "x"), (2, None, "x"), (3, "", "x"), (None, "tie tie tie", "x")], "item_id long, text string, w string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def stage(spark, name, docs, folder):
    import corpus_pipeline

    out = dict(corpus_pipeline.STAGES)[name](spark, docs, folder)
    return out.columns, sorted((r.asDict() for r in out.collect()), key=repr)


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", ["toxicity", "near join", "suffix dedup", "decontamination", "bpe"])
def test_pipeline_stages_of_empty_tables(spark, docs, pipeline_tables, name):
    columns, found = stage(spark, name, empty(spark, docs), pipeline_tables)
    assert found == [] and columns[:5] == COLUMNS and (name == "bpe") == (len(columns) > 5)


def test_pipeline_toxicity(spark, docs, pipeline_tables):
    """Null, empty, very long and repeated rows that say nothing stay as they are; toxic ones go, all copies of them."""
    toxic = spark.createDataFrame([(50, "You idiot. You stupid idiot. Idiot, you!", "en", "a", 9)] * 2 + [(51, LONG + " you idiot scum, you worthless idiot, you moron", "en", "a", 9)], SCHEMA)
    columns, found = stage(spark, "toxicity", docs.unionByName(toxic, allowMissingColumns=True), pipeline_tables)
    assert columns == COLUMNS and [tuple(r.values()) for r in found] == [tuple(r.values()) for r in sorted((dict(zip(COLUMNS, r, strict=True)) for r in ROWS), key=repr)]


def test_pipeline_near_join(spark, docs, pipeline_tables):
    """Of equal rows and of near copies the least stays; wordless texts are classes of their own, but equal wordless rows are one."""
    blank = spark.createDataFrame([(4, "  \n\t ", "en", "a", None), (2, None, "en", None, 3), (8, "  \n\t ", "en", "a", None)], SCHEMA)
    columns, found = stage(spark, "near join", docs.unionByName(blank, allowMissingColumns=True), pipeline_tables)
    ids = [r["doc_id"] for r in found]
    assert columns == COLUMNS and sorted(ids, key=repr) == sorted([1, 2, 3, 4, 8, None, 5, 7, 7], key=repr)
    assert [r["lang"] for r in found if r["doc_id"] == 5] == ["en"]


def test_pipeline_suffix_dedup(spark, docs, pipeline_tables):
    """Null and short texts stay as they are; texts of which nothing but white space is left go."""
    columns, found = stage(spark, "suffix dedup", docs, pipeline_tables)
    assert columns == COLUMNS and [(r["doc_id"], r["text"]) for r in found] == [(r["doc_id"], r["text"]) for r in sorted((dict(zip(COLUMNS, r, strict=True)) | {"n_chars": None if r[1] is None else len(r[1])} for r in ROWS if r[1] != LONG), key=repr)]
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in found)


def test_pipeline_decontamination(spark, docs, pipeline_tables):
    """Every row that holds a window goes, equal ones alike, the rest stays as it is."""
    columns, found = stage(spark, "decontamination", docs, pipeline_tables)
    assert columns == COLUMNS and [tuple(r.values()) for r in found] == [tuple(r.values()) for r in sorted((dict(zip(COLUMNS, r, strict=True)) for r in ROWS if r[0] not in (1, None)), key=repr)]


def test_pipeline_bpe(spark, docs, pipeline_tables):
    columns, found = stage(spark, "bpe", docs, pipeline_tables)
    codec = bpe.Codec(bpe.vocabulary_path())
    assert columns == [*COLUMNS, "token_ids", "round_trip", "n_tokens"] and len(found) == len(ROWS) and all(r["round_trip"] and r["token_ids"] == codec.encode(r["text"]) and r["n_tokens"] == len(r["token_ids"]) for r in found)


def test_tasks_of_other_modules_drop_what_a_worker_keeps():
    from skein.llm import common

    path, uses = bpe.vocabulary_path(), lambda module: type("Run", (), {"__module__": module, "__call__": lambda self, batches: iter(batches)})()
    kept = bpe.codec(path, True)
    list(common.trimmed(uses("skein.llm.bpe"))([1]))
    assert bpe.codec(path, True) is kept
    assert list(common.trimmed(uses("skein.llm.suffix_dedup"))([1, 2])) == [1, 2] and bpe.codec(path, True) is not kept
