"""Incremental ingest: new files of a folder are added to a store as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quirewright.operators.store import VectorStore
from quirewright.sources.papers import Decoder, decode, pdf_decoder, structure

FILES = "path string, modificationTime timestamp, length long, content binary"


def ingest_folder(spark: SparkSession, folder: str, store: VectorStore, checkpoint: str, decoder: Decoder = pdf_decoder, pattern: str = "*.pdf", once: bool = True) -> StreamingQuery:
    """Start a stream over a folder. A repeated batch adds nothing, as stored paths are skipped."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).load(folder)

    def add(batch: DataFrame, _: int) -> None:
        decoded = decode(batch.select("path", "content"), decoder)
        store.add(structure(decoded.where(F.col("error").isNull())))

    writer = files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def arrivals(stream: DataFrame, time: str, kind: str, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Rows per time window and kind of a stream; rows later than ``late`` are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")
