"""Parsing of rigor scores out of model replies, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirewright.functions.text import first_group, strip

#: The forms of a reply.
_NUMBER = r":\s*\[?(\d+(?:\.\d+)?)\s*(?:/\s*10)?\]?"
OVERALL = r"(?iU)(?:BULLSHIT|RIGOR) SCORE" + _NUMBER
COMPONENTS = {n.lower(): rf"(?idU){n}.*?" + _NUMBER for n in ("Methodology", "Statistics", "Claims", "Transparency")}
FLAGS = r"(?isdU)RED FLAGS:\s*\n(.*?)(?=\n\n|SUMMARY:|Final|$)"
FLAGS_ROBUST = r"(?isdU)\**RED FLAGS:?\**\s*\n(.*?)(?=\n\s*\**SUMMARY|\n\s*\**FINAL [A-Z]+:|\z)"
SUMMARY = r"(?isdU)SUMMARY:\s*\n?(.*?)\z"


def overall(reply: Column) -> Column:
    """The overall score; 5 where the reply has none or is null."""
    return F.coalesce(first_group(reply, OVERALL).try_cast("double"), F.lit(5.0))


def parse_ok(reply: Column) -> Column:
    """Whether the reply states an overall score between 0 and 10."""
    return F.coalesce(first_group(reply, OVERALL).try_cast("double").between(0, 10), F.lit(False))


def component(reply: Column, name: str) -> Column:
    """One of methodology, statistics, claims, transparency; null where it is missing."""
    return first_group(reply, COMPONENTS[name]).try_cast("double")


def red_flags(reply: Column, robust: bool = False) -> Column:
    """The lines below RED FLAGS without bullets, template text and 'none'; an empty array without the heading.

    The plain form ends at the first blank line or the word 'final'; the robust one at the summary.
    """
    block = F.regexp_extract(reply, FLAGS_ROBUST if robust else FLAGS, 1)
    lines = F.transform(F.split(block, "\n"), lambda s: strip(F.regexp_replace(strip(s), r"^(?:\d+[.)]\s*)?[•\-*]+" if robust else r"^[•\-*]+", "")))
    low = F.lower
    return F.filter(
        lines,
        lambda s: (F.length(s) > 3) & ~low(s).startswith("none") & ~low(s).contains("list any serious") & ~low(s).contains("[list") & ~low(s).contains("if clean"),
    )


def summary(reply: Column) -> Column:
    """All after the first SUMMARY: heading; '' without one."""
    return strip(F.regexp_extract(reply, SUMMARY, 1))


def rating(score: Column) -> Column:
    return F.when(score <= 2, "Excellent").when(score <= 4, "Good").when(score <= 6, "Concerning").when(score <= 8, "Poor").otherwise("Severe Issues")


def severity(score: Column) -> Column:
    return F.when(score <= 4, "good").when(score <= 6, "warning").otherwise("bad")


def parse(reply: Column, robust: bool = False) -> Column:
    """The whole score as one struct."""
    s = overall(reply)
    return F.struct(
        s.alias("overall"),
        *(component(reply, c).alias(c) for c in COMPONENTS),
        red_flags(reply, robust).alias("red_flags"),
        summary(reply).alias("summary"),
        reply.alias("raw"),
        rating(s).alias("rating"),
        severity(s).alias("severity"),
        parse_ok(reply).alias("parse_ok"),
    )
