"""Functions for use in SQL text: chunks as a table function, and the score's readings."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quirewright.operators.chunking import chunk_text


@udtf(returnType="chunk_index int, chunk_text string, start_pos int, end_pos int, token_count int")
class Chunk:
    """chunk(text, size, overlap): one row per chunk; none for a null or blank text."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        for i, (piece, start, end, tokens) in enumerate(chunk_text(text, size, overlap)):
            yield i, piece, start, end, tokens


def register(spark: SparkSession) -> None:
    """Register chunk, rigor_rating, rigor_severity and similarity for this session."""
    spark.udtf.register("chunk", Chunk)
    for name, kind, body in (
        ("rigor_rating", "STRING", "CASE WHEN x <= 2 THEN 'Excellent' WHEN x <= 4 THEN 'Good' WHEN x <= 6 THEN 'Concerning' WHEN x <= 8 THEN 'Poor' ELSE 'Severe Issues' END"),
        ("rigor_severity", "STRING", "CASE WHEN x <= 4 THEN 'good' WHEN x <= 6 THEN 'warning' ELSE 'bad' END"),
        ("similarity", "DOUBLE", "try_divide(1D, 1 + x)"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x DOUBLE) RETURNS {kind} RETURN {body}")
