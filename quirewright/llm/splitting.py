"""Cutting oversized items into balanced pieces at natural boundaries.

Plan. The engine counts tokens natively and only oversized items reach Python. For each of them the
least possible number of pieces gives equal-length targets; each target snaps to the strongest
boundary nearby. After each cut the rest is balanced anew, so a cut for which the rest needs one more
piece costs no restart; such a cut is made only for a boundary that is clearly stronger than those
which keep the least number. Items are cut independently, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WHITE = " \t\n\r 　"
_TOKEN = regex.compile(rf"[A-Za-z0-9]+|[^{WHITE}]")
_GAP = regex.compile(rf"[{WHITE}]*")
_STOPS = frozenset(".!?。！？।؟…॥．")
_CLAUSES = frozenset(",;:，、；：،؛—–")
_CLOSERS = frozenset("\"'”’»)]）」』】》")


def token_count(text: Column) -> Column:
    """Maximal runs of ASCII letters and digits, and other single characters that aren't white space."""
    return F.length(F.regexp_replace(F.regexp_replace(text, "[A-Za-z0-9]+", "a"), "[ \\t\\n\\r\\u00A0\\u3000]+", "")).cast("long")


def _strengths(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For the gap before each token: 5 paragraph, 4 sentence, 3 line, 2 clause, 1 white space, 0 none."""
    out = np.zeros(len(starts) + 1, np.int8)
    for i in range(1, len(starts)):
        lo, hi = ends[i - 1], starts[i]
        before = text[lo - 1]
        if hi > lo:
            gap = text[lo:hi]
            lines = gap.count("\n")
            if lines > 1:
                out[i] = 5
                continue
            j = i - 1
            while j > 0 and before in _CLOSERS and starts[j] == ends[j - 1]:
                j -= 1
                before = text[ends[j] - 1]
            out[i] = 4 if before in _STOPS else 3 if lines else 2 if before in _CLAUSES else 1
        elif before in "。！？" and text[hi] not in _CLOSERS and text[hi] not in "。！？":
            out[i] = 4
        elif before in "，、；：":
            out[i] = 2
    return out


def plan_pieces(strength: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(first token, token after the last, boundary strength) of each piece; strength[i] is the gap's before token i."""
    n = len(strength) - 1
    if n <= limit:
        return [(0, n, 5)]
    overlap = max(0, min(overlap, limit - 1))
    out, start = [], 0
    while n - start > limit:
        pieces = -(-(n - start - overlap) // (limit - overlap))
        length = (n - start + (pieces - 1) * overlap) / pieces
        reach = max(1, int(length / 4))
        target = start + round(length)
        low, high = max(start + overlap + 1, target - reach), min(start + limit, target + reach, n - 1)
        # From here on the rest fits into the pieces that are left.
        fits = n - (pieces - 1) * (limit - overlap)
        gaps = np.arange(low, high + 1)
        # The strongest gap wins; a nearer one is worth up to one step of strength, one piece less two steps.
        best = int(gaps[np.argmax(strength[low : high + 1] - np.abs(gaps - target) / (reach + 1) - 2.0 * (gaps < fits))])
        out.append((start, best, int(strength[best])))
        start = best - overlap
    out.append((start, n, 5))
    return out


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int, int]]:
    """(start, end, tokens, shared tokens, strength) of each piece; the pieces cover the whole text."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    if not spans:
        return []
    starts, ends = np.array([s for s, _ in spans]), np.array([e for _, e in spans])
    plan = plan_pieces(_strengths(text, starts, ends), limit, overlap)
    out = []
    for i, (a, b, strength) in enumerate(plan):
        lo = 0 if i == 0 else int(starts[a])
        hi = len(text) if i == len(plan) - 1 else int(starts[b])
        out.append((lo, hi, b - a, plan[i - 1][1] - a if i else 0, strength))
    return out


_OUT = "item_type string, item_id long, section_idx int, piece int, pieces int, start_pos int, end_pos int, tokens int, shared_tokens int, boundary int, max_tokens int, overlap_tokens int, text string"


def split_oversized(items: DataFrame, limits: DataFrame) -> DataFrame:
    """The pieces of every item over its limit.

    items: (item_type, item_id, section_idx, name, text); limits: (item_kind, section_name,
    max_tokens, overlap_tokens), '*' for any other name. Names are compared trimmed and without case.
    Items without a limit, with a null limit or one below 1, and null or blank texts give no rows; a
    null overlap is 0. Consecutive pieces share exactly the overlap, or one token less than the limit
    where the overlap isn't smaller than it. Of several limits for one name the smallest counts.
    """
    white = F.lit(WHITE)
    name = F.lower(F.btrim(F.coalesce("name", F.lit("")), white))
    rules = limits.where(F.col("max_tokens") >= 1).groupBy(F.col("item_kind").alias("item_type"), F.lower(F.btrim("section_name", white)).alias("rule"))
    rules = rules.agg(F.min(F.struct("max_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("overlap"))).alias("limit"))
    own, other = rules.withColumnRenamed("limit", "own"), rules.where(F.col("rule") == "*").select("item_type", F.col("limit").alias("other"))
    rows = items.where(F.col("text").isNotNull()).select("item_type", F.col("item_id").cast("long").alias("item_id"), F.col("section_idx").cast("int").alias("section_idx"), name.alias("rule"), "text")
    rows = rows.withColumn("n", token_count(F.col("text")))
    bound = rows.join(own, ["item_type", "rule"], "left").join(other, "item_type", "left").withColumn("limit", F.coalesce("own", "other"))
    over = bound.where(F.col("n") > F.col("limit.max_tokens")).select("item_type", "item_id", "section_idx", "text", F.col("limit.max_tokens").cast("int").alias("most"), F.col("limit.overlap").cast("int").alias("overlap"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for kind, i, s, text, most, overlap in zip(*(b.column(c).to_pylist() for c in ("item_type", "item_id", "section_idx", "text", "most", "overlap"))):
                parts = split_text(text, most, overlap)
                rows += [(kind, i, s, j, len(parts), *p, most, overlap, text[p[0] : p[1]]) for j, p in enumerate(parts)]
            if rows:
                types = (pa.string(), pa.int64(), *[pa.int32()] * 10, pa.string())
                names = [c.split()[0] for c in _OUT.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return over.mapInArrow(run, _OUT)


def checked(pieces: DataFrame) -> DataFrame:
    """(item_type, item_id, section_idx, covers, within, shares) of cut items: whether their pieces leave no gap, keep the limit, and share the overlap, all counted anew from the pieces' texts."""
    order = Window.partitionBy("item_type", "item_id", "section_idx").orderBy("piece")  # the pieces of one item
    before = {c: F.lag(c).over(order) for c in ("end_pos", "text")}
    shared = F.col("before_end") - F.col("start_pos")
    head = F.substring(F.col("text"), F.lit(1), shared)
    last = F.col("piece") == F.col("pieces") - 1
    alike = (shared >= 0) & (head == F.when(shared > 0, F.expr("right(before_text, before_end - start_pos)")).otherwise(""))
    each = pieces.withColumns({"before_end": before["end_pos"], "before_text": before["text"]}).select(
        "item_type", "item_id", "section_idx",
        F.when(F.col("piece") == 0, F.col("start_pos") == 0).otherwise(alike).alias("covers"),
        (token_count(F.col("text")) <= F.col("max_tokens")).alias("within"),
        ((F.col("piece") == 0) | (token_count(head) == F.least(F.col("overlap_tokens"), F.col("max_tokens") - 1))).alias("shares"),
        (F.col("end_pos") == F.col("start_pos") + F.length("text")).alias("measured"), last.alias("last"),
    )
    by = each.groupBy("item_type", "item_id", "section_idx")
    return by.agg((F.bool_and(F.col("covers") & F.col("measured")) & (F.count_if("last") == 1)).alias("covers"), F.bool_and("within").alias("within"), F.bool_and("shares").alias("shares"))
