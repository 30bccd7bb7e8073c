"""Overlapping chunks of bounded token counts, cut at natural breaks.

A document is cut in order, as each cut depends on the one before; documents are cut in parallel.
Token counts come from one pass over a text, so that counting a rest is a subtraction.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirewright.functions.sections import pick_sections
from quirewright.functions.text import ABBREVIATIONS

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_SENTENCE = re.compile(r"[.!?]\s+")
CHUNK = T.StructType([T.StructField(n, k) for n, k in (("chunk_text", T.StringType()), ("start_pos", T.IntegerType()), ("end_pos", T.IntegerType()), ("token_count", T.IntegerType()), ("source_section", T.StringType()), ("chunk_index", T.IntegerType()), ("total_chunks", T.IntegerType()))])
_ARROW = pa.list_(pa.struct([(f.name, pa.string() if isinstance(f.dataType, T.StringType) else pa.int32()) for f in CHUNK]))

Spans = Callable[[str], list[int]]


def token_starts(text: str) -> list[int]:
    """Where the approximate tokens of a text begin."""
    return [m.start() for m in _TOKEN.finditer(text)]


@dataclass(frozen=True)
class BpeSpans:
    """Where the tokens of a byte-level BPE begin: to be passed as ``starts`` for true counts.

    vocabulary: a file of base64 tokens and their ranks, which every executor can read; pattern: how
    the tokenizer cuts texts into words. Needs tiktoken.
    """

    vocabulary: str
    pattern: str = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __call__(self, text: str) -> list[int]:
        encoding = _encoding(self.vocabulary, self.pattern)
        sizes = [len(encoding.decode_single_token_bytes(t)) for t in encoding.encode_ordinary(text)]
        # A token may begin inside a character; it counts from the next one then.
        at, out, byte, start = 0, [], 0, 0
        widths = [len(c.encode("utf-8", "surrogatepass")) for c in text]
        for n in sizes:
            while at < len(text) and byte < start:
                byte += widths[at]
                at += 1
            out.append(at)
            start += n
        return out


@lru_cache(4)
def _encoding(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _protected(text: str, at: int) -> bool:
    """Whether the full stop at a place belongs to an abbreviation."""
    return any(text.startswith(a, at + 1 - len(a)) for a in ABBREVIATIONS if len(a) <= at + 1) or text.startswith(".D.", at)


def semantic_break(text: str, target: int, window: int = 200) -> int:
    """The last paragraph break near the target, else sentence break, else space, else the target.

    The first two count only beyond half a window from the region's begin.
    """
    start, end = max(0, target - window), min(len(text), target + window)
    region = text[start:end]
    paragraph = region.rfind("\n\n")
    if paragraph > window // 2:
        return start + paragraph + 2
    best = -1
    for m in _SENTENCE.finditer(region):
        if region[m.start()] != "." or not _protected(text, start + m.start()):
            best = m.end()
    if best > window // 2:
        return start + best
    space = region.rfind(" ")
    return start + space + 1 if space > 0 else min(target, len(text))


def chunk_text(text: str | None, size: int = 2_000, overlap: int = 200, starts: Spans = token_starts) -> list[tuple[str, int, int, int]]:
    """(text, start, end, tokens) of the chunks; none for a null or blank text.

    A chunk holds at most 1.1 * size tokens unless three attempts to shrink it fail. Each chunk begins
    after the one before it, whatever the overlap; an overlap of 0 is none.
    """
    if text is None or not text.strip():
        return []
    if size < 1 or overlap < 0:
        raise ValueError("size must be at least 1 and overlap at least 0")
    tokens = starts(text)
    count = lambda a, b: bisect_left(tokens, b) - bisect_left(tokens, a)
    out, pos, n = [], 0, len(text)
    while pos < n:
        rest = count(pos, n)
        if rest <= size:
            piece = text[pos:].strip()
            if piece:
                out.append((piece, pos, n, rest))
            break
        per_token = (n - pos) / rest
        estimate = pos + int(size * per_token)
        end = semantic_break(text, estimate)
        if end <= pos:
            end = min(max(estimate, pos + 1), n)
        for _ in range(3):
            if count(pos, end) <= 1.1 * size:
                break
            estimate = pos + max(1, int(0.8 * (end - pos)))
            shorter = semantic_break(text, estimate)
            end = shorter if pos < shorter <= end else estimate
        piece = text[pos:end].strip()
        if piece:
            out.append((piece, pos, end, count(pos, end)))
        begin = semantic_break(text, max(pos, end - int(overlap * per_token)), 100) if overlap else end
        pos = begin if pos < begin < end else end
    return out


def chunk_lists(papers: DataFrame, mode: str = "sections", targets: list[str] | None = None, size: int = 2_000, overlap: int = 200, starts: Spans = token_starts) -> DataFrame:
    """Papers (text, sections, and any others) with their chunks as an array, in place of text and sections.

    Mode 'sections' cuts each section, or the whole text where there are none; 'full' the whole text.
    With ``targets`` only sections of these names (case ignored) are cut; a paper whose sections have
    none of them has an empty array. Chunk numbers and totals run over the paper; offsets over the text
    that was cut. A column named chunks is replaced. No rows move between tasks.
    """
    if mode not in ("sections", "full"):
        raise ValueError("mode must be 'sections' or 'full'")
    sections: Column = F.coalesce("sections", F.array().cast("array<struct<name:string,content:string,start_pos:int,end_pos:int>>"))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.col("text").alias("content")))
    named = F.transform(pick_sections(sections, F.array(*(F.lit(t.lower()) for t in targets))) if targets else sections, lambda s: F.struct(s["name"].alias("name"), s["content"].alias("content")))
    units = whole if mode == "full" else F.when(F.size(sections) > 0, named).otherwise(whole)
    keep = [c for c in papers.columns if c not in ("text", "sections", "chunks")]
    rows = papers.select(*keep, units.alias("__units"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = []
            for units in b.column("__units").to_pylist():
                made = [(*c, u["name"]) for u in units or [] for c in chunk_text(u["content"], size, overlap, starts)]
                lists.append([dict(zip(CHUNK.names, (*c, k, len(made)))) for k, c in enumerate(made)])
            yield pa.RecordBatch.from_arrays([*b.select(keep).columns, pa.array(lists, _ARROW)], names=[*keep, "chunks"])

    return rows.mapInArrow(run, rows.drop("__units").schema.add("chunks", T.ArrayType(CHUNK)))


def chunk_papers(papers: DataFrame, mode: str = "sections", targets: list[str] | None = None, size: int = 2_000, overlap: int = 200, starts: Spans = token_starts) -> DataFrame:
    """One row per chunk, as chunk_lists makes them; columns named like those of a chunk are replaced."""
    keep = [c for c in papers.columns if c not in ("text", "sections", "chunks") and c not in CHUNK.names]
    lists = chunk_lists(papers.select(*keep, "text", "sections"), mode, targets, size, overlap, starts)
    return lists.select(*keep, F.inline("chunks"))


def chunk_metadata() -> Column:
    """The seven facts of a chunk as one struct."""
    words = F.size(F.filter(F.split("chunk_text", r"(?U)\s+"), lambda w: w != ""))
    return F.struct("start_pos", "end_pos", "token_count", words.alias("word_count"), "source_section", "chunk_index", "total_chunks")
