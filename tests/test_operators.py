"""Chunking, search, contexts, analyses: invariants and edge cases."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirewright.functions.prompts import TEMPLATES
from quirewright.operators import analyses, chunking, context, models, vectors


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .!?\nÄ中", max_size=600), st.integers(1, 40), st.integers(0, 60))
def test_chunks_cover_the_text(text, size, overlap):
    chunks = chunking.chunk_text(text, size, overlap)
    if not text.strip():
        assert chunks == []
        return
    assert chunks[0][1] == 0 or not text[: chunks[0][1]].strip()
    assert chunks[-1][2] == len(text) or not text[chunks[-1][2] :].strip()
    for a, b in zip(chunks, chunks[1:]):
        assert a[1] < b[1] and not text[a[2] : b[1]].strip()
    for piece, start, end, tokens in chunks:
        assert piece == text[start:end].strip() and tokens == len(chunking.token_starts(text[start:end])) or tokens >= 0


def test_chunk_edges():
    assert chunking.chunk_text(None) == [] and chunking.chunk_text(" \n") == []
    assert chunking.chunk_text("  one  ", 5) == [("one", 0, 7, 1)]
    long = "word " * 5000
    for _, _, _, tokens in chunking.chunk_text(long, 100, 10):
        assert tokens <= 110
    with pytest.raises(ValueError):
        chunking.chunk_text("a", 0)


def test_breaks():
    text = "x" * 180 + "\n\n" + "y" * 300
    assert chunking.semantic_break(text, 200) == 182
    text = "x" * 150 + ". " + "y" * 300
    assert chunking.semantic_break(text, 200) == 152
    assert chunking.semantic_break("x" * 500, 200) == 200


def papers(spark):
    rows = [
        ("/a.pdf", "A", "long abstract " * 8, "whole text of a", [("Methods", "We did. It went well.", 0, 5), ("Results", "It worked.", 5, 9)], 1),
        ("/b.pdf", "B", None, "whole text of b. It has no sections.", [], 2),
        ("/c.pdf", "C", "", None, None, 3),
        ("/d.pdf", None, None, "text", [("Outlook", "Later.", 0, 3)], 4),
    ]
    kind = "paper_path string, title string, abstract string, text string, sections array<struct<name:string,content:string,start_pos:int,end_pos:int>>, chunk_index int"
    return spark.createDataFrame(rows, kind)


def test_chunk_papers(spark):
    rows = chunking.chunk_papers(papers(spark), "sections").collect()
    assert [(r["paper_path"], r["source_section"], r["chunk_index"], r["total_chunks"]) for r in rows] == [("/a.pdf", "Methods", 0, 2), ("/a.pdf", "Results", 1, 2), ("/b.pdf", None, 0, 1), ("/d.pdf", "Outlook", 0, 1)]
    picked = chunking.chunk_papers(papers(spark), "sections", ["METHODS"]).collect()
    assert {r["paper_path"] for r in picked} == {"/a.pdf", "/b.pdf"}
    assert chunking.chunk_papers(papers(spark).limit(0)).count() == 0


def table(spark):
    rows = [(1, [0.0, 0.0], "g", "m"), (2, [1.0, 0.0], "g", "m"), (3, [1.0, 0.0], "h", "n"), (4, [3.0, 4.0], "h", "n"), (5, None, "h", "m"), (6, [1.0], "h", "m"), (7, [None, 1.0], "h", "m")]
    return spark.createDataFrame(rows, "id long, vector array<float>, grp string, section string")


def test_search(spark):
    hits = vectors.search(table(spark), [1.0, 0.0], 3).collect()
    assert [(r["id"], r["distance"], r["score"]) for r in hits] == [(2, 0.0, 1.0), (3, 0.0, 1.0), (1, 1.0, 0.5)]
    assert [r["id"] for r in vectors.search(table(spark), [1.0, 0.0], 5, {"section": "n"}).collect()] == [3, 4]
    assert [r["id"] for r in vectors.search(table(spark), [1.0, 0.0], 5, {"section": "N"}).collect()] == []
    assert vectors.search(table(spark).limit(0), [1.0, 0.0]).count() == 0
    assert vectors.search(table(spark), [1.0, 0.0], 5, metric="cosine").count() == 3
    with pytest.raises(ValueError):
        vectors.search(table(spark), [1.0], metric="other")


def test_search_plan(spark, folder):
    df = vectors.search(spark.read.parquet(f"{folder}/papers.parquet"), [0.0] * 768, 5, {"section": "Methods"}, id_col="row_id").select("row_id", "score")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(section,Methods)" in plan and "text" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_search_many_agrees_with_search(spark, metric):
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (60, 5)).astype(float)
    t = spark.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(x)], "id long, vector array<double>, grp int")
    asked = t.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"), F.col("grp").alias("exclude_value"))
    many = vectors.search_many(t, asked, 4, metric=metric, block=2).collect()
    for q in (0, 20, 40):
        single = [(r["id"], round(r["distance"], 9)) for r in vectors.search(t, x[q].tolist(), 4, metric=metric).collect()]
        assert [(r["id"], round(r["distance"], 9)) for r in sorted(many, key=lambda r: r["rank"]) if r["query_id"] == q] == single


def test_search_many_excludes(spark):
    asked = table(spark).where("id = 2").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"), F.col("grp").alias("exclude_value"))
    assert [r["id"] for r in vectors.search_many(table(spark), asked, 2, exclude="grp").orderBy("rank").collect()] == [3, 4]
    assert [r["id"] for r in vectors.search_many(table(spark), asked, 1, exclude="grp", strict=False).orderBy("rank").collect()] == [3]
    assert vectors.search_many(table(spark), asked.limit(0), 2).count() == 0


def test_budget_and_context(spark):
    rows = spark.createDataFrame([("p", 0, "a", 3, "S"), ("p", 1, "b", None, None), ("p", 2, "c", 4, "T"), ("p", 3, "d", 1, "S"), ("q", 0, "e", 9, "S")], "k string, i int, t string, n int, s string")
    fit = context.budget_prefix(rows, ["k"], ["i"], "n", 6)
    assert sorted(r["t"] for r in fit.collect()) == ["a", "b"]
    c = context.assemble(fit, ["k"], ["i"], "t", "s").head()
    assert (c["context"], c["sections_analyzed"], c["chunks_processed"], c["n_chunks"]) == ("a\n\n---\n\nb", ["S"], 1, 2)


def test_render(spark):
    t = TEMPLATES["rag_query"]
    _, user = context.render(t, {"question": F.lit("why {context}?"), "context": F.lit(None).cast("string")})
    assert spark.range(1).select(user.alias("u")).head()["u"].startswith("Question: why {context}?")
    with pytest.raises(KeyError):
        context.render(t, {"context": F.lit("x")})
    with pytest.raises(ValueError):
        context.get_template("none")
    assert len(TEMPLATES) == 13


def test_analyses(spark):
    rows = {(r["paper_path"], r["analysis"]): r for r in analyses.analyse(papers(spark), ["summarize_brief", "rigor_score", "critique_methodology"]).collect()}
    assert ("/a.pdf", "summarize_brief") in rows and ("/b.pdf", "summarize") in rows and ("/b.pdf", "summarize_brief") not in rows
    assert rows["/a.pdf", "critique_methodology"]["sections_analyzed"] == ["Methods", "Results"]
    # No target section: all sections are taken.
    assert rows["/d.pdf", "critique_methodology"]["sections_analyzed"] == ["Outlook"]
    assert rows["/c.pdf", "rigor_score"]["context_empty"]
    assert rows["/a.pdf", "rigor_score"]["model_used"] == "offline-heuristic"
    scores = {r["paper_path"]: r for r in analyses.rigor_scores(papers(spark)).collect()}
    assert len(scores) == 4 and all(r["parse_ok"] for r in scores.values())
    with pytest.raises(ValueError):
        analyses.analyse(papers(spark), ["none"])


def test_embedder(spark):
    e = models.HashEmbedder(32)
    rows = spark.createDataFrame([("a b",), (None,), ("",)], "t string").select(models.embed(F.col("t"), e, 1).alias("v")).collect()
    assert abs(sum(x * x for x in rows[0]["v"]) - 1) < 1e-5 and rows[1]["v"] is None and set(rows[2]["v"]) == {0.0}


def test_analyses_do_not_shuffle(spark):
    df = analyses.rigor_scores(papers(spark))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_search_many_against_brute_force(spark):
    import numpy as np

    from quirewright.operators import vectors

    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6)).round(1)
    x[20:40] = x[3]  # ties
    rows = [(i, v.tolist(), f"g{i % 4}" if i % 9 else None) for i, v in enumerate(x)] + [(900, None, "g1"), (901, [1.0, None] + [0.0] * 4, "g1"), (902, [1.0, 2.0], "g1"), (903, [0.0] * 6, "g1"), (None, [1.0] * 6, "g1")]
    table = spark.createDataFrame(rows, "id long, vector array<float>, group string")
    asked = [(i, x[i].tolist(), f"g{i % 4}" if i % 2 else None) for i in range(0, 60, 3)] + [(777, None, "g1"), (778, [], "g1")]
    queries = spark.createDataFrame(asked, "query_id long, query_vector array<float>, exclude_value string")
    x32 = np.vstack([x.astype("f4").astype("f8"), np.zeros((1, 6))])
    ids = [*range(300), 903]
    groups = [f"g{i % 4}" if i % 9 else None for i in range(300)] + ["g1"]
    for metric in vectors.METRICS:
        for block in (7, 8_192):
            got = {}
            for r in vectors.search_many(table, queries, 4, metric=metric, exclude="group", block=block).collect():
                got.setdefault(r["query_id"], {})[r["rank"]] = (r["id"], r["distance"])
            for q, v, own in asked[:20]:
                d = vectors._pairwise(x32, np.broadcast_to(np.array(v, "f4").astype("f8"), x32.shape), metric)
                want = sorted((round(float(d[k]), 9), ids[k]) for k in range(301) if not np.isnan(d[k]) and (own is None or groups[k] != own))[:4]
                assert [got[q][k + 1][0] for k in range(4)] == [i for _, i in want], (metric, q)
    first = vectors.search(table, x[3].tolist(), 3)
    assert [r["id"] for r in first.collect()] == [3, 20, 21] and vectors.search(table, [1.0, 2.0], 5).count() == 1


def test_true_token_counts(spark):
    import os

    from quirewright.operators.chunking import BpeSpans, chunk_papers, chunk_text

    vocabulary = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not os.path.exists(vocabulary):
        pytest.skip("no vocabulary file here")
    spans = BpeSpans(vocabulary)
    text = "Hydroacoustic métres étaient 測定 counted again. " * 60
    starts = spans(text)
    assert starts == sorted(starts) and starts[0] == 0 and len(starts) > len(text.split())
    made = chunk_text(text, 100, 10, spans)
    assert all(n <= 110 for *_, n in made) and made[-1][2] == len(text)
    df = spark.createDataFrame([("/a", text, [])], "paper_path string, text string, sections array<struct<name:string,content:string,start_pos:int,end_pos:int>>")
    assert [r["token_count"] for r in chunk_papers(df, "full", None, 100, 10, spans).collect()] == [n for *_, n in made]


def test_budgets_of_hot_groups(spark):
    import random

    r = random.Random(2)
    rows = [("hot" if i % 3 else None, i % 250, i, r.choice([0, 1, 5, None]), f"t{i}") for i in range(900)] + [(f"k{i}", 0, i, 3, "x") for i in range(20)]
    df = spark.createDataFrame(rows, "paper string, a int, b int, n int, text string").repartition(5)
    want = set()
    for key in {x[0] for x in rows}:
        total = 0
        for x in sorted((x for x in rows if x[0] == key), key=lambda x: (x[1], x[2])):
            total += x[3] or 0
            if total <= 400:
                want.add(x)
    for hot in (50, 10_000):
        assert {tuple(x) for x in context.budget_prefix(df, ["paper"], ["a", "b"], "n", 400, hot_rows=hot).collect()} == want
