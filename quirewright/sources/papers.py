"""Paper files: a folder scan with a pluggable decoder, errors as rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewright.functions.sections import detect_sections, extract_abstract
from quirewright.functions.text import clean_text, join_pages, title_or_stem
from quirewright.sources.pdf import decode_pdf

Decoder = Callable[[bytes], tuple[list[str], dict[str, str]]]
_DECODED = "struct<pages:array<string>,metadata:map<string,string>,error:string>"


def plain_decoder(content: bytes) -> tuple[list[str], dict[str, str]]:
    """UTF-8 text with form feeds between pages; for files that were extracted elsewhere."""
    return content.decode("utf-8").split("\f"), {}


def pdf_decoder(content: bytes) -> tuple[list[str], dict[str, str]]:
    """Pages and metadata of a PDF, by pypdf where it is installed, else by the plain decoder of this package."""
    import io

    try:
        from pypdf import PdfReader
    except ImportError:
        return decode_pdf(content)
    reader = PdfReader(io.BytesIO(content))
    return [p.extract_text() or "" for p in reader.pages], {str(k).lstrip("/").lower(): str(v) for k, v in (reader.metadata or {}).items()}


def decode(files: DataFrame, decoder: Decoder) -> DataFrame:
    """files (path, content) with pages, metadata and error: null, or why the file could not be read."""

    @F.pandas_udf(_DECODED)
    def run(content: pd.Series) -> pd.DataFrame:
        rows = []
        for c in content:
            try:
                pages, metadata = decoder(bytes(c))
                rows.append((pages, metadata, None))
            except Exception as e:  # a decoder may fail in any way; the file becomes an error row
                rows.append((None, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["pages", "metadata", "error"])

    return files.withColumn("d", run("content")).select("path", "d.pages", "d.metadata", "d.error")


def structure(pages: DataFrame) -> DataFrame:
    """Papers out of (path, pages, metadata): title, cleaned text, kept pages, abstract, sections."""
    kept = pages.withColumn("p", join_pages(F.col("pages")))
    text = kept.select("path", "metadata", clean_text(F.col("p.text")).alias("text"), F.col("p.page_count").alias("page_count"))
    return text.select(
        F.col("path").alias("paper_path"),
        title_or_stem(F.col("metadata"), F.col("path")).alias("title"),
        "text",
        "page_count",
        "metadata",
        extract_abstract(F.col("text")).alias("abstract"),
        detect_sections(F.col("text")).alias("sections"),
    )


def read_folder(spark: SparkSession, folder: str, decoder: Decoder = pdf_decoder, pattern: str = "*.pdf") -> tuple[DataFrame, DataFrame]:
    """(papers, errors) of the files of a folder, not of its subfolders; errors: (path, error)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(folder)
    decoded = decode(files.select("path", "content"), decoder)
    return structure(decoded.where(F.col("error").isNull())), decoded.where(F.col("error").isNotNull()).select("path", "error")


def read_file(spark: SparkSession, path: str, decoder: Decoder = pdf_decoder) -> DataFrame:
    """One paper; a missing file is a FileNotFoundError, another suffix than .pdf a ValueError."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(path)
    if not path.lower().endswith(".pdf"):
        raise ValueError(f"not a PDF: {path}")
    decoded = decode(spark.read.format("binaryFile").load(path).select("path", "content"), decoder)
    return structure(decoded)
