"""Passages of evaluation items inside documents, exact or with changed numbers, names and units.

Plan. Words are canonicalised: numbers and units become typed placeholders in one template, names too
in a second one (the first doesn't depend on case, so a passage in capitals is still found). Hashed
template windows of the items are joined with those of the documents, which are read once: a bitmap of
bounded size lets only windows leave their task that an item is likely to have, and a hash join, with
hot windows spread, tells which do. Each hit is judged by its slots: equal words make it exact, a
one-to-one renaming makes it a re-parameterised passage. Runs of consecutive hits give the lengths.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirewright.llm.joins import bitmap_of, marked, spread_join
from quirewright.llm.shingles import code_points, hash_runs, mix, windows
from quirewright.plans.storage import materialise

#: Units of measurement that may follow a number.
UNITS = "mm cm km nm kg mg ml kpa mpa hz khz mhz ghz ms min kw mw kwh mv kv db rpm ppm kb mb gb".split()
_NUM, _UNIT, _NAME = np.uint64(0xA1), np.uint64(0xB2), np.uint64(0xC3)


@dataclass(frozen=True)
class LeakParams:
    """words: window length; least_fixed: words of a window that must be the same where others are changed (a template of more slots says too little); filter_bits: the bitmap has at most 2**filter_bits bits."""

    words: int = 13
    least_fixed: int = 7
    filter_bits: int = 30


@lru_cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per code point up to the last letter: part of a word, digit, capital, lower-case form."""
    n = 0x323B0
    word, digit, upper, lower = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool), np.arange(n, dtype=np.uint32)
    for i in range(n):
        c = chr(i)
        kind = unicodedata.category(c)
        word[i] = kind[0] == "L" or kind == "Nd"
        digit[i] = kind == "Nd"
        upper[i] = kind in ("Lu", "Lt")
        if len(low := c.lower()) == 1:
            lower[i] = ord(low)
    return word, digit, upper, lower


@dataclass
class Words:
    """The words of many texts: hashes, template hashes, slot marks, and where each text's words begin."""

    hashes: np.ndarray
    plain: np.ndarray
    named: np.ndarray
    slot: np.ndarray
    first: np.ndarray


def read_words(texts: list[str]) -> Words:
    word, digit, upper, lower = _tables()
    points, bounds = code_points(texts)
    safe = np.where(points < len(word), points, 0xFFFF)
    low = lower[safe]
    starts, ends, hashes = hash_runs(low, word[safe])
    first = np.searchsorted(starts, bounds)
    if not len(starts):
        e = np.array([], np.uint64)
        return Words(e, e, e, np.array([], bool), first)
    digits = np.add.reduceat(np.append(digit[safe], False).astype(np.int32), np.stack([starts, ends], 1).ravel())[::2]
    number = digits == ends - starts
    _, _, unit_hashes = hash_runs(*(lambda p: (lower[p], word[p]))(code_points(UNITS)[0]))
    unit = np.isin(hashes, unit_hashes)
    before = points[np.maximum(starts - 2, 0)]
    opens = np.isin(before, np.frombuffer(".!?:\n".encode("utf-32-le"), "<u4")) | (starts < 2)
    opens[first[:-1][first[:-1] < len(starts)]] = True
    name = upper[safe[starts]] & ~opens & ~number & ~unit
    plain = np.where(number, _NUM, np.where(unit, _UNIT, hashes))
    return Words(hashes, plain, np.where(name, _NAME, plain), number | unit | name, first)


def _consistent(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the words of each row of a are a one-to-one renaming of b's."""
    out = np.empty(len(a), bool)
    for lo in range(0, len(a), 4096):
        x, y = a[lo : lo + 4096], b[lo : lo + 4096]
        out[lo : lo + 4096] = ((x[:, :, None] == x[:, None, :]) == (y[:, :, None] == y[:, None, :])).all(axis=(1, 2))
    return out


def _windows(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """(text, place, key) of all template windows of both kinds, each once, and the words."""
    w = read_words(texts)
    if len(w.hashes) < n:
        return np.array([], int), np.array([], int), np.array([], np.uint64), w
    of = np.repeat(np.arange(len(texts)), np.diff(w.first))
    at = np.nonzero(of[: len(of) - n + 1] == of[n - 1 :])[0]
    plain, named = windows(w.plain, n)[at], windows(w.named, n)[at]
    other = plain != named
    at = np.concatenate([at, at[other]])
    return of[at], at, np.concatenate([plain, named[other]]), w


def _probes(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a key in a bitmap."""
    mask = np.uint64((1 << bits) - 1)
    return (key & mask).astype(np.int64), (mix(key) & mask).astype(np.int64)


_WINDOW = "id long, owner long, at int, key long, words binary"


def _window_table(rows: DataFrame, params: LeakParams, bits: int = 0, filter_: np.ndarray | None = None) -> DataFrame:
    """The windows of texts (id, owner, text), of which a filter lets some pass."""
    n = params.words
    shared = rows.sparkSession.sparkContext.broadcast(filter_)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = np.arange(n)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                of, at, key, w = _windows(b.column("text").to_pylist(), n)
                if shared.value is not None and len(key):
                    first, second = _probes(key, bits)
                    keep = np.nonzero(marked(shared.value, first))[0]
                    keep = keep[marked(shared.value, second[keep])]
                    of, at, key = of[keep], at[keep], key[keep]
                if len(key):
                    ids, owner = (b.column(c).to_numpy(zero_copy_only=False)[of] for c in ("id", "owner"))
                    words = w.hashes[at[:, None] + span].astype("<u8")
                    data = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer((np.arange(len(key) + 1) * 8 * n).astype("<i4").tobytes()), pa.py_buffer(words.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(owner), pa.array(at - w.first[of], pa.int32()), pa.array(key.view(np.int64)), data], names=["id", "owner", "at", "key", "words"])

    return rows.mapInArrow(scan, _WINDOW)


def leaks(docs: DataFrame, items: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """(doc_id, item_id, exact_words, template_words, item_words) of documents (id, text) that hold passages of items (id, text).

    exact_words: the longest run of the item's words that stands in the document, 0 if it is shorter
    than a window; template_words: the same where numbers, units and names may differ consistently.
    Null or empty texts and texts of fewer words than a window give no rows, nor do empty tables.
    Where an id stands in several rows its texts are searched one by one, and the longest runs count.
    Columns other than id and text are not read.
    """
    n = params.words
    full = lambda df: df.where(F.col("text").isNotNull() & F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), F.xxhash64("text").alias("owner"), "text")
    asked, read = full(items), full(docs)
    theirs = materialise(_window_table(asked.dropDuplicates(["text"]), params), "item-windows")
    bits = min(params.filter_bits, max(15, (64 * theirs.count()).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_probes(b.column("key").to_numpy().view(np.uint64), bits)))], names=["h"])

    held = bitmap_of(theirs.select("key").mapInArrow(places, "h long"), bits)
    mine = materialise(_window_table(read, params, bits, held).distinct(), "document-windows")
    met = spread_join(mine, theirs.select("key", F.col("owner").alias("item"), F.col("at").alias("there"), F.col("words").alias("item_words")), ["key"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a, c = (np.frombuffer(b"".join(b.column(x).to_pylist()), "<u8").reshape(-1, n) for x in ("words", "item_words"))
                exact = (a == c).all(axis=1)
                open_ = ~exact & ((a == c).sum(axis=1) >= params.least_fixed)
                same = exact.copy()
                same[open_] = _consistent(a[open_], c[open_])
                at = b.column("at").to_numpy(zero_copy_only=False)
                r = pa.RecordBatch.from_arrays([b.column("id"), b.column("owner"), b.column("item"), pa.array(at - b.column("there").to_numpy(zero_copy_only=False), pa.int32()), b.column("at"), pa.array(exact)], names=["id", "owner", "item", "shift", "at", "exact"])
                yield r.filter(pa.array(same))

    hits = met.select("id", "owner", "item", "at", "there", "words", "item_words").mapInArrow(judge, "id long, owner long, item long, shift int, at int, exact boolean").distinct()
    # A run is a set of places in a row on one shift: its places less their ranks are all the same.
    line = Window.partitionBy("id", "owner", "item", "shift").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    runs = F.array(F.struct(F.lit(False).alias("exact"), (F.col("at") - F.count("*").over(line)).alias("run")), F.struct(F.lit(True).alias("exact"), F.when(F.col("exact"), F.col("at") - F.count_if("exact").over(line)).alias("run")))
    each = hits.select("id", "owner", "item", "shift", runs.alias("runs")).select("id", "owner", "item", "shift", F.explode("runs").alias("r")).where(F.col("r.run").isNotNull()).groupBy("id", "owner", "item", "shift", "r").agg((F.count("*") + n - 1).cast("int").alias("n"))
    found = each.groupBy(F.col("id").alias("doc_id"), "item").agg(F.coalesce(F.max(F.when(F.col("r.exact"), F.col("n"))), F.lit(0)).alias("exact_words"), F.max(F.when(~F.col("r.exact"), F.col("n"))).alias("template_words"))

    size = F.size(F.filter(F.split("text", "[^\\p{L}\\p{Nd}]+"), lambda w: w != "")).cast("int")
    named = asked.select(F.col("id").alias("item_id"), F.col("owner").alias("item"), size.alias("item_words")).distinct()
    return found.join(named, "item").groupBy("doc_id", "item_id").agg(F.max("exact_words").alias("exact_words"), F.max("template_words").alias("template_words"), F.max("item_words").alias("item_words"))
