"""Prompt templates. Names, variables and the reply format of the score are fixed; the wording is our own."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Template:
    name: str
    description: str
    system: str
    user: str

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys(re.findall(r"\{(\w+)\}", self.user)))

    def format(self, **values: str) -> tuple[str, str]:
        """(system, user); a missing variable is a KeyError."""
        return self.system, self.user.format(**values)


_CRITIC = "You review scientific work. Judge design, data, analysis and claims by what the text says, quote what you rely on, and say when the text isn't enough."
_RAG = "You answer questions from excerpts of papers. Use only the excerpts, name the paper each statement comes from, and say plainly when they don't answer."
_SUMMARY = "You summarise papers for informed readers: plain sentences, exact numbers, no praise."
_RIGOR = "You rate scientific rigor from 0 (sound) to 10 (not to be relied on). Be strict and fair, and follow the reply format to the letter."

_ALL = [
    Template("critique_methods", "Critique of methods", _CRITIC, "Assess the methods below: design, controls, sample, measurement, reproducibility.\n\n{context}\n\nGive strengths, weaknesses and what is missing."),
    Template("critique_statistics", "Critique of statistics", _CRITIC, "Assess the statistics below: choice of tests, sample sizes, multiple comparisons, effect sizes, uncertainty.\n\n{context}\n\nList each problem with its place."),
    Template("critique_claims", "Critique of claims", _CRITIC, "Compare the claims below with their evidence.\n\n{context}\n\nMark each as supported, overstated or unsupported."),
    Template("critique_full", "Full critique", _CRITIC, "Review the paper below as a whole: question, methods, statistics, results, claims, limits.\n\n{context}\n\nEnd with a verdict."),
    Template("summarize_paper", "Summary", _SUMMARY, "Summarise the paper below: question, approach, main results, meaning.\n\n{context}"),
    Template("summarize_brief", "Brief summary", _SUMMARY, "Summarise in three sentences.\n\nAbstract:\n{abstract}\n\nExcerpts:\n{context}"),
    Template("extract_claims", "Claims", _CRITIC, "List the main claims of the text below, each with its evidence and how strong it is.\n\n{context}"),
    Template("identify_limitations", "Limitations", _CRITIC, "List limitations, those stated and those not.\n\n{context}"),
    Template("rag_query", "Question about papers", _RAG, "Question: {question}\n\nExcerpts:\n{context}\n\nAnswer:"),
    Template("compare_papers", "Comparison of papers", _RAG, "Compare what these papers say about {topic}.\n\n{context}\n\nName agreements, conflicts and gaps."),
    Template("cross_reference", "Cross-reference of a claim", _RAG, "Claim: {claim}\n\nExcerpts of other papers:\n{context}\n\nWhich support it, which contradict it, which say nothing?"),
    Template(
        "bullshit_score",
        "Score of scientific rigor, 0 to 10",
        _RIGOR,
        "Rate the paper below; 0 to 2 excellent, 3 to 4 good, 5 to 6 concerning, 7 to 8 poor, 9 to 10 severe.\n\n{context}\n\nReply in this form:\n\nBULLSHIT SCORE: [X/10]\n\nBREAKDOWN:\n- Methodology: [X/10] - reason\n- Statistics: [X/10] - reason\n- Claims: [X/10] - reason\n- Transparency: [X/10] - reason\n\nRED FLAGS:\n- one per line, or None identified\n\nSUMMARY:\ntwo or three sentences",
    ),
    Template("quick_assess", "Quick check", _CRITIC, "Name obvious red flags and strengths of this text in a few lines.\n\n{context}"),
]
TEMPLATES: dict[str, Template] = {t.name: t for t in _ALL}


def list_templates(spark: SparkSession) -> DataFrame:
    """(name, description) of every template."""
    return spark.createDataFrame([(t.name, t.description) for t in TEMPLATES.values()], "name string, description string")


@dataclass(frozen=True)
class Analysis:
    """Which template runs over which sections (none: all) within how many tokens."""

    name: str
    template: str
    sections: tuple[str, ...]
    budget: int
    fallback: bool = True


#: Sections and budgets of each analysis.
ANALYSES: dict[str, Analysis] = {
    a.name: a
    for a in (
        Analysis("summarize", "summarize_paper", (), 8000),
        Analysis("summarize_brief", "summarize_brief", ("Introduction", "Results", "Conclusion"), 4000),
        Analysis("critique_methodology", "critique_methods", ("Methods", "Methodology", "Materials And Methods", "Experimental", "Results"), 6000),
        Analysis("critique_statistics", "critique_statistics", ("Methods", "Results", "Statistics", "Analysis"), 6000),
        Analysis("critique_full", "critique_full", (), 8000),
        Analysis("extract_claims", "extract_claims", ("Abstract", "Results", "Discussion", "Conclusion"), 6000),
        Analysis("identify_limitations", "identify_limitations", ("Methods", "Results", "Discussion", "Limitations", "Conclusion"), 6000),
        Analysis("rigor_score", "bullshit_score", (), 8000),
        Analysis("quick_assess", "quick_assess", (), 4000),
    )
}
FULL_ANALYSIS = ("summarize", "critique_methodology", "critique_statistics", "extract_claims", "identify_limitations", "rigor_score")
