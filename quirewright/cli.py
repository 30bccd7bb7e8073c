"""Command line: python -m quirewright.cli <command>, or through spark-submit."""

from __future__ import annotations

import argparse
import sys
from dataclasses import asdict

from pyspark.sql import SparkSession

from quirewright.config import Settings
from quirewright.functions.prompts import list_templates
from quirewright.library import Library
from quirewright.sources import papers


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quirewright")
    p.add_argument("--store")
    p.add_argument("--plain", action="store_true", help="files are UTF-8 text with form feeds between pages")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("add", "analyze", "summarize", "score", "critique"):
        c = sub.add_parser(name)
        c.add_argument("path")
        if name == "analyze":
            c.add_argument("--full", action="store_true")
        if name == "summarize":
            c.add_argument("--brief", action="store_true")
        if name == "critique":
            c.add_argument("--focus", default="full")
    sub.add_parser("add-arxiv").add_argument("ids", nargs="+")
    sub.add_parser("remove").add_argument("title")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("-n", type=int, default=5)
    s.add_argument("-s", "--section")
    s.add_argument("-p", "--paper")
    for name in ("list", "stats", "config", "templates"):
        sub.add_parser(name)
    return p


#: Which analyses a focus stands for; another word means the full critique.
FOCUS = {"methods": "critique_methodology", "statistics": "critique_statistics", "claims": "extract_claims", "full": "critique_full"}


def run(argv: list[str], spark: SparkSession) -> int:
    """0, or 1 after an error that is printed."""
    a = _parser().parse_args(argv)
    decoder = papers.plain_decoder if a.plain else papers.pdf_decoder
    try:
        if a.command == "config":
            for k, v in asdict(Settings.load(spark)).items():
                print(f"{k} = {v}")
            return 0
        if a.command == "templates":
            list_templates(spark).show(truncate=False)
            return 0
        library = Library(spark, a.store, decoder=decoder)
        if a.command == "add":
            print(library.add_file(a.path), "chunks added")
        elif a.command == "add-arxiv":
            n, rows = library.add_arxiv(a.ids)
            rows.show(truncate=False)
            print(n, "chunks added")
        elif a.command == "list":
            library.list_papers().orderBy("title").show(1000, truncate=60)
        elif a.command == "stats":
            library.stats().show(truncate=False)
        elif a.command == "remove":
            print(library.remove(a.title), "chunks removed")
        elif a.command == "search":
            library.search(a.query, a.n, a.paper, a.section).show(truncate=200)
        else:
            paper = papers.read_file(spark, a.path, decoder)
            names = {"analyze": None if getattr(a, "full", False) else ["summarize_brief", "rigor_score"], "summarize": ["summarize_brief" if getattr(a, "brief", False) else "summarize"], "score": ["rigor_score"], "critique": [FOCUS.get(getattr(a, "focus", ""), "critique_full")]}[a.command]
            for r in library.analyse(paper, names).collect():
                print(f"== {r['paper_title']}: {r['analysis_type']} ({r['model_used']})\n{r['content']}\n")
        return 0
    except (OSError, ValueError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def main() -> None:
    spark = SparkSession.builder.appName("quirewright").getOrCreate()
    sys.exit(run(sys.argv[1:], spark))


if __name__ == "__main__":
    main()
