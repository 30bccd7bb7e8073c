"""Joins whose hot keys don't meet in one task, and filters of bounded size for them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "inner", sizes: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``facts``, which has one row per key at most; how: inner or left.

    Keys of a thousandth of all rows or more, so a thousand keys at most, are joined by broadcast;
    the others by shuffling. sizes: (keys, n), how many rows have each key, if it is known already.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")) if sizes is None else sizes
    total = sizes.agg(F.sum("n")).head()[0] or 0
    hot = sizes.where(F.col("n") >= max(1_000, -(-total // 1_000))).select(*keys).collect()
    if not hot:
        return rows.join(facts, keys, how)
    names = F.broadcast(rows.sparkSession.createDataFrame(hot, rows.select(*keys).schema))
    often = rows.join(names, keys, "left_semi").join(F.broadcast(facts.join(names, keys, "left_semi")), keys, how)
    return often.unionByName(rows.join(names, keys, "left_anti").join(facts.join(names, keys, "left_anti"), keys, how))


def bitmap_of(h: DataFrame, bits: int) -> np.ndarray:
    """A packed bitmap of 2**bits bits over the column h of whole numbers from 0 to 2**bits - 1: a filter that may let others pass, and loses none."""
    maps = h.groupBy(F.bitmap_bucket_number("h").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")).collect()
    out = np.zeros((1 << bits) // 8 + 4_096, np.uint8)
    for r in maps:
        # Buckets of positive values begin at a multiple of 32768 plus 1; 0 is alone in its own.
        got = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[r["bucket"] * 4_096 : r["bucket"] * 4_096 + len(got)] |= got
    return out


def marked(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the numbers the bitmap holds."""
    bucket = np.where(h > 0, 1 + (h - 1) // 32_768, 0)
    at = np.where(h > 0, (h - 1) % 32_768, 0)
    return (bitmap[bucket * 4_096 + at // 8] >> (at % 8).astype(np.uint8) & 1).astype(bool)
