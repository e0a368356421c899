"""Nulls, empty and long texts, ties, repeated rows, empty tables and columns whose names clash, for every operator and stage."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallywright.llm import binary_output, decontaminate, jaccard, language, line_dedup, packing, pivots, token_counts, toxicity, warc
from tallywright.llm.common import saved
from tallywright.llm.queries import tokenizer

LINE = "the quick brown fox jumps over the lazy dog near the river bank today"
LONG = " ".join(f"word{k % 977} and {k}" for k in range(120_000))
DOCS = [
    (1, LINE + "\nshort", "en", "s", 5), (2, LINE + "\nshort", "en", "s", 5), (2, LINE + "\nshort", "en", "s", 5), (3, LINE.replace("quick", "quack"), None, None, None),
    (4, None, "en", "s", 0), (5, "", None, "s", 0), (None, LINE, "en", None, 3), (None, None, None, None, None), (6, "   \n\n ", "de", "t", 4),
    (7, LONG, "en", "s", len(LONG)), (8, "!!! ??? 123", "xx", "t", 9), (9, "ein kleiner satz auf deutsch mit wörtern", "de-AT", "t", 9), (10, "a<|endoftext|>b'll   ", "en", "s", 2),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "v n id key line bands pivot p q second bytes copies size component links head first group stays number piece length start label score toxic declared suffix host said letters guess value file ok one u m shingles values offset sequence_id kept".split()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, SCHEMA)
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts(docs, empty):
    got = token_counts.token_counts(docs, tokenizer("byte_bpe_50k.json")).collect()
    assert len(got) == len(DOCS)
    assert {(r.n_bytes, r.n_tokens, r.over_limit) for r in got if r.doc_id in (4, 5)} == {(0, 0, False)}
    assert [r.over_limit for r in got if r.doc_id == 7] == [True]
    assert token_counts.token_counts(empty, tokenizer("byte_bpe_50k.json")).collect() == []


def test_packing(docs, empty):
    got = packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), size=4096).collect()
    assert sum(r.piece == 0 for r in got) == len(DOCS)
    assert {r.length for r in got if r.doc_id in (4, 5)} == {1}
    assert packing.pack_documents(empty, tokenizer("word_bpe_49k.json")).collect() == []


def test_matrices(docs, empty):
    got = binary_output.segments(binary_output.matrices_in_shared_folder(docs, tokenizer("byte_bpe_50k.json"))).collect()
    assert sum(r.piece == 0 for r in got) == len(DOCS)
    assert binary_output.segments(binary_output.matrices_in_shared_folder(empty, tokenizer("byte_bpe_50k.json"))).collect() == []


def test_near_documents(docs, empty):
    got = {r.doc_id: r for r in jaccard.near_documents(docs).collect()}
    assert sorted(got) == list(range(1, 11))
    assert (got[1].n_links, got[2].group_id, got[2].kept, got[1].kept) == (1, 1, False, True)
    assert all(got[k].n_links == 0 and got[k].kept for k in (3, 4, 5, 6, 7, 8, 9, 10))
    assert jaccard.near_documents(empty).collect() == []


def test_lines(docs, empty):
    got = {r.doc_id: r for r in line_dedup.line_report(docs).collect()}
    assert sorted(got) == list(range(1, 11))
    assert (got[1].dropped, got[2].dropped, got[3].dropped, got[4].n_lines, got[5].n_lines, got[6].n_lines) == ([], [0], [0], 0, 1, 3)
    left = line_dedup.without_repeated_lines(docs)
    assert left.columns == docs.columns
    rows = left.select("doc_id", "text").collect()
    assert sorted(r.text for r in rows if r.doc_id == 2) == ["short", "short"]
    assert not [r for r in rows if r.doc_id == 3]
    assert len([r for r in rows if r.doc_id is None]) == 2 and len([r for r in rows if r.doc_id in (4, 5, 6)]) == 3
    assert line_dedup.line_report(empty).collect() == [] and line_dedup.without_repeated_lines(empty).collect() == []


def test_leaks(spark, docs, empty):
    items = spark.createDataFrame([(1, LINE), (1, LINE), (2, None), (3, ""), (None, "word1 and 1 word2 and 2 word3 and 3 word4 and 4"), (4, "nothing of this stands in any of the documents here")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (None, 1), (7, None)}
    assert decontaminate.leaks(empty, items).collect() == [] and decontaminate.leaks(docs, items.filter("false")).collect() == []


def test_language(spark, docs, empty):
    got = language.identify(docs, "doc_id", declared="lang", host=F.col("source")).collect()
    assert len(got) == len(DOCS)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert (by[9].language, by[8].language, by[8].kept, by[4].language) == ("de", "und", False, "und")
    assert all(0 <= r.probability <= 1 for r in got)
    assert language.identify(empty, "doc_id", declared="lang", host=F.col("source")).collect() == []


def test_language_evidence(spark):
    """A text that says little goes with its markup, its suffix and its host; one that says much does not."""
    en, de = "the weather in the north was colder than they thought", "das wetter im norden war kälter als sie gedacht hatten"
    rows = [(k, (en, de)[k % 2], ("en", "de-DE")[k % 2], ("com", "de")[k % 2], ("a.com", "b.de")[k % 2]) for k in range(60)]
    rows += [(100, "ok", "de", None, None), (101, "ok", None, "de", "b.de"), (102, "ok", None, "com", "a.com"), (103, en, "de", "de", "b.de")]
    df = spark.createDataFrame(rows, "k long, text string, declared string, suffix string, host string")
    got = {r.k: r for r in language.identify(df, "k", declared="declared", suffix=F.col("suffix"), host=F.col("host"), languages=("de", "en")).collect()}
    assert [got[k].language for k in (0, 1, 100, 101, 102, 103)] == ["en", "de", "de", "de", "en", "en"]


def test_pages(spark):
    pages = spark.createDataFrame([(1, "https://a.example.de/x", "<html lang='de'><p>der kleine hund</p></html>"), (2, None, None), (None, "not a url", "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in language.page_evidence(pages).collect()}
    assert (got[1].declared, got[1].host, got[1].suffix, got[1].text.strip()) == ("de", "a.example.de", "de", "der kleine hund")
    assert got[2].host is None and got[None].suffix is None


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (3, None), (None, 1), (7, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(DOCS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len(toxicity.toxicity(docs, labels.filter("false")).collect()) == len(DOCS)
    assert toxicity.toxicity(empty, labels).collect() == []


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (10, [1.0]), (None, [1.0, 0.0]), (11, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("pivot", F.lit(2)).withColumn("id", F.lit(3))
    got = pivots.near_vectors(df).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    assert (by[1].n_links, by[2].n_links, by[9].n_links, by[10].n_links, by[3].n_links) == (4, 4, 4, 4, 0)
    assert {by[k].component_id for k in (1, 2, 9, 10)} == {1} and by[1].kept and not by[2].kept
    assert all(by[k].n_links == 0 and by[k].kept for k in (4, 5, 6, 7, 8, 11, None))
    assert pivots.near_vectors(df.filter("false")).collect() == []


def test_archives(spark):
    body = "x" * 120 + "é\r\n\r\nWARC/1.1\r\n"
    rows = [(2, "http://a/ b", body), (1, None, body), (1, "http://c", body), (3, "http://d", "small"), (4, "http://d", "small"), (5, "http://e", None), (6, "", ""), (None, "http://f", body)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit(1)).withColumn("id", F.lit(1)).withColumn("value", F.lit(1))
    got = sorted(((r.page_id or 99, r.payload_bytes, r.record_type, r.refers_to) for r in warc.pages_through_archives(df).collect()), key=str)
    n = len(body.encode())
    assert got == sorted([(1, n, "response", None), (1, n, "revisit", 1), (2, n, "revisit", 1), (99, n, "revisit", 1), (3, 5, "response", None), (4, 5, "response", None), (5, 0, "response", None), (6, 0, "response", None)], key=str)
    assert warc.pages_through_archives(df.filter("false")).collect() == []


def test_stages(spark, docs, empty, tmp_path):
    spark.createDataFrame([(1, "word1 and 1 word2 and 2 word3 and 3 word4 and 4")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = saved(stage(spark, now, str(tmp_path)), name)
        assert after.columns == docs.columns
        now = after
    left = {r.doc_id for r in now.select("doc_id").collect()}
    assert left == {1, 9, 10, None}  # 2 holds nothing but lines of 1
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()} == left
    now = empty
    for name, stage in corpus_pipeline.STAGES:
        now = saved(stage(spark, now, str(tmp_path)), name)
        assert now.count() == 0


def test_leaks_of_other_scripts(spark):
    """Items without an ASCII letter or digit are items."""
    texts = ["сколько планет вращается вокруг нашего солнца\nвосемь планет", "πόσοι πλανήτες υπάρχουν στο ηλιακό μας σύστημα"]
    df = spark.createDataFrame([(k, "a b c " + t + " d e f") for k, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([*enumerate(texts), (9, "?! ...")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, items).collect()} == {(0, 0), (1, 1)}
