"""Analyses of papers: chunk once, take each analysis's sections within its budget, render, complete, parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewright.functions import score
from quirewright.functions.prompts import ANALYSES, FULL_ANALYSIS
from quirewright.functions.sections import has_abstract
from quirewright.operators.chunking import chunk_lists
from quirewright.operators.context import SEPARATOR, assemble, budget_prefix, get_template, messages, render
from quirewright.operators.models import Completer, HeuristicCompleter, complete


def _specs(names: list[str]):
    """The analyses as an array of structs: fixed and small, so each paper gets it without a join."""
    return F.array(*(F.struct(F.lit(a.name).alias("analysis"), F.array(*(F.lit(s.lower()) for s in a.sections)).cast("array<string>").alias("targets"), F.lit(a.budget).alias("budget")) for a in (ANALYSES[n] for n in names)))


def _fitting(chunks: Column, budget: Column) -> Column:
    """The chunks before the first that would exceed the budget."""
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("n"))

    def step(acc: Column, c: Column) -> Column:
        total = acc["total"] + c["token_count"]
        return F.struct(total.alias("total"), (acc["n"] + F.when(total <= budget, 1).otherwise(0)).alias("n"))

    return F.slice(chunks, F.lit(1), F.aggregate(chunks, zero, step, lambda acc: acc["n"]))


def contexts(papers: DataFrame, names: list[str], size: int = 2_000, overlap: int = 200) -> DataFrame:
    """Each paper with each analysis: its other columns, analysis, context, sections_analyzed, chunks_processed, n_chunks, context_empty.

    papers: (text, sections, and any others). A paper is cut once; its chunks stay in one row, so
    nothing is shuffled. Where no target section is found, all sections are taken.
    """
    cut = chunk_lists(papers, "sections", None, size, overlap).withColumn("__spec", F.explode(_specs(names)))
    spec = F.col("__spec")
    named = F.filter("chunks", lambda c: (F.size(spec["targets"]) == 0) | c["source_section"].isNull() | F.array_contains(spec["targets"], F.lower(c["source_section"])))
    own, every = _fitting(named, spec["budget"]), _fitting(F.col("chunks"), spec["budget"])
    used = cut.withColumn("__used", F.when(F.size(own) > 0, own).otherwise(every))
    sections = F.array_distinct(F.filter(F.transform("__used", lambda c: c["source_section"]), lambda s: s.isNotNull()))
    made = {
        "analysis": spec["analysis"],
        "context": F.array_join(F.transform("__used", lambda c: c["chunk_text"]), SEPARATOR),
        "sections_analyzed": sections,
        "chunks_processed": F.size(sections),
        "n_chunks": F.size("__used"),
        "context_empty": F.size("__used") == 0,
    }
    return used.withColumns(made).drop("chunks", "__spec", "__used")


def analyse(papers: DataFrame, names: list[str] | None = None, completer: Completer | None = None, size: int = 2_000, overlap: int = 200) -> DataFrame:
    """One row per paper and analysis (default: the six of the full analysis).

    papers: (paper_path, title, abstract, text, sections). A brief summary of a paper without abstract
    is a full one. Columns: paper_path, paper_title, analysis, analysis_type, content,
    sections_analyzed, chunks_processed, n_chunks, context_empty, model_used.
    """
    names = list(names or FULL_ANALYSIS)
    for n in names:
        if n not in ANALYSES:
            raise ValueError(f"unknown analysis {n!r}; there are {', '.join(ANALYSES)}")
    completer = completer or HeuristicCompleter()
    own = list(dict.fromkeys([*names, *(["summarize"] if "summarize_brief" in names else [])]))
    ready = contexts(papers.select("paper_path", F.col("title").alias("paper_title"), "abstract", "text", "sections"), own, size, overlap)
    brief = has_abstract(F.col("abstract"))
    if "summarize_brief" in names and "summarize" not in names:
        ready = ready.where(((F.col("analysis") != "summarize") | ~brief) & ((F.col("analysis") != "summarize_brief") | brief))
    elif "summarize_brief" in names:
        ready = ready.where((F.col("analysis") != "summarize_brief") | brief)
    system, user, kind = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for n in own:
        t = get_template(ANALYSES[n].template)
        s, u = render(t, {"context": F.col("context"), "abstract": F.col("abstract")})
        here = F.col("analysis") == n
        system, user, kind = F.when(here, s).otherwise(system), F.when(here, u).otherwise(user), F.when(here, t.description).otherwise(kind)
    done = ready.withColumn("analysis_type", kind).withColumn("reply", complete(messages(system, user), completer))
    return done.select("paper_path", "paper_title", "analysis", "analysis_type", F.col("reply.content").alias("content"), "sections_analyzed", "chunks_processed", "n_chunks", "context_empty", F.col("reply.model").alias("model_used"))


def rigor_scores(papers: DataFrame, completer: Completer | None = None, robust: bool = False) -> DataFrame:
    """paper_path, paper_title and the parsed score of each paper."""
    replies = analyse(papers, ["rigor_score"], completer)
    return replies.select("paper_path", "paper_title", score.parse(F.col("content"), robust).alias("score")).select("paper_path", "paper_title", "score.*")


def ask(hits: DataFrame, template: str, variables: dict[str, str], budget: int = 8_000, completer: Completer | None = None) -> DataFrame:
    """One reply from search hits (text, paper_title, chunk order columns) for rag_query, compare_papers, cross_reference or critique_claims.

    hits: (text, paper_title, score, id); they are taken by score within the budget. No hits: an empty context.
    """
    from quirewright.functions.text import token_count

    spark = hits.sparkSession
    rows = hits.select(F.lit(0).alias("k"), (-F.col("score")).alias("order"), "id", F.concat(F.lit("["), F.coalesce("paper_title", F.lit("Unknown")), F.lit("] "), "text").alias("text"), "paper_title", token_count(F.col("text")).alias("n"))
    context = assemble(budget_prefix(rows, ["k"], ["order", "id"], "n", budget), ["k"], ["order", "id"], "text", "paper_title")
    one = spark.range(1).select(F.lit(0).alias("k")).join(context, "k", "left")
    t = get_template(template)
    system, user = render(t, {"context": F.col("context")} | {n: F.lit(v) for n, v in variables.items()})
    reply = complete(messages(system, user), completer or HeuristicCompleter())
    return one.withColumn("reply", reply).select(F.lit(t.description).alias("analysis_type"), F.col("reply.content").alias("content"), F.coalesce("sections_analyzed", F.array().cast("array<string>")).alias("papers"), F.col("reply.model").alias("model_used"))
