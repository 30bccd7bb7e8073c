"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns through every core operator."""

import pytest
from pyspark.sql import functions as F

from quirewright.functions import score, sections, text
from quirewright.operators import analyses, chunking, context, store, vectors
from quirewright.sources import arxiv

LONG = "Some words, and more. " * 20_000

FUNCTIONS = {
    "strip": text.strip,
    "clean_text": text.clean_text,
    "word_count": text.word_count,
    "token_count": text.token_count,
    "paragraphs": text.paragraphs,
    "sentences": text.sentences,
    "arxiv_id": text.arxiv_id,
    "file_stem": text.file_stem,
    "one_line": text.one_line,
    "preview": lambda c: text.preview(c, 10, 7),
    "join_pages": lambda c: text.join_pages(F.array(c, F.lit(None), F.lit(""))),
    "detect_sections": sections.detect_sections,
    "extract_abstract": sections.extract_abstract,
    "has_abstract": sections.has_abstract,
    "score": score.parse,
    "robust": lambda c: score.parse(c, robust=True),
    "messages": lambda c: context.messages(c, c),
}


@pytest.mark.parametrize("name", FUNCTIONS)
def test_functions(spark, name):
    df = spark.createDataFrame([(1, None), (2, ""), (3, LONG), (4, " \n\t "), (4, " \n\t ")], "id int, x string")
    rows = df.select("id", FUNCTIONS[name](F.col("x")).alias("y")).collect()
    assert len(rows) == 5
    assert df.limit(0).select(FUNCTIONS[name](F.col("x")).alias("y")).count() == 0


KIND = "paper_path string, title string, abstract string, text string, sections array<struct<name:string,content:string,start_pos:int,end_pos:int>>, chunk_index string, spec string"
PAPERS = [
    ("/a", None, None, None, None, "c", "s"),
    ("/b", "", "", "", [], "c", "s"),
    ("/c", "t", "a", LONG, [], "c", "s"),
    ("/d", "t", "a", "x", [(None, None, None, None), ("Methods", "", 0, 0), ("METHODS", "we did", 0, 5)], "c", "s"),
    ("/d", "t", "a", "x", [("Methods", "we did", 0, 5)], "c", "s"),
    (None, "t", "a", "no path", [], "c", "s"),
]


def test_papers(spark):
    df = spark.createDataFrame(PAPERS, KIND)
    chunks = chunking.chunk_papers(df, "sections", None, 100, 10)
    assert set(chunks.columns) == {"paper_path", "title", "abstract", "spec", "chunk_text", "start_pos", "end_pos", "token_count", "source_section", "chunk_index", "total_chunks"}
    by = {}
    for r in chunks.collect():
        by.setdefault(r["paper_path"], []).append(r)
    assert "/a" not in by and "/b" not in by and len(by["/d"]) == 2 and len(by["/c"]) > 500 and len(by[None]) == 1
    assert chunking.chunk_papers(df.limit(0)).count() == 0
    unique = df.where("paper_path in ('/a', '/b', '/c')")
    assert analyses.analyse(unique, ["summarize", "summarize_brief", "rigor_score"]).count() == 6
    assert analyses.analyse(unique.limit(0)).count() == 0


def test_tables(spark):
    df = spark.createDataFrame([("/a", None, None, None, 1), ("/a", None, None, None, 1), (None, "t", 0, "x", None), ("/b", "t", 1, "y", 2)], "paper_path string, paper_title string, chunk_index int, text string, tokens int")
    listed = {r["paper_path"]: (r["title"], r["chunk_count"]) for r in store.list_papers(df, ["chunk_index"]).collect()}
    assert listed == {"/a": ("Unknown", 2), None: ("t", 1), "/b": ("t", 1)}
    assert store.stats(df.limit(0), "m", "x").head()["total_chunks"] == 0
    assert [r["paper_path"] for r in store.new_papers(df, df.where("paper_path = '/a'")).collect()] == ["/b"]
    assert store.new_papers(df.limit(0), df).count() == 0
    fit = context.budget_prefix(df, ["paper_path"], ["chunk_index"], "tokens", 1)
    assert fit.count() >= 2 and fit.columns == df.columns
    assert context.assemble(fit.limit(0), ["paper_path"], ["chunk_index"], "text", "paper_title").count() == 0


def test_vectors_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "d", 9.0), (1, [1.0, 0.0], "d", 9.0), (2, [0.0, 0.0], "d", 9.0), (3, None, "d", 9.0), (None, [1.0, 0.0], "d", 9.0)], "id long, vector array<double>, distance string, score double")
    assert [r["distance"] for r in vectors.search(df, [1.0, 0.0], 3).collect()] == [0.0, 0.0, 0.0]
    asked = df.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    assert {r["query_id"] for r in vectors.search_many(df, asked, 2, metric="cosine").collect()} == {1}
    assert vectors.search_many(df.limit(0), asked, 2).count() == 0


def test_arxiv_rows(spark):
    df = spark.createDataFrame([(None,), ("",), ("2301.07041",), ("2301.07041",)], "x string")
    assert sorted(r["status"] for r in arxiv.plan(df, "x").collect()) == ["fetch", "fetch", "invalid", "invalid"]
    assert arxiv.plan(df.limit(0), "x").count() == 0
