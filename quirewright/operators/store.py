"""A store of chunk vectors: Parquet parts and numbered lists of the parts that are valid.

Each change writes parts beside those being read and then a list with the next number, by a rename
that fails if that list is there already. Readers take the list with the highest number, so they see
the old or the new state, and a lost executor leaves neither half written. A writer whose number
was taken reads the new list, mends its change by what the other one did, and tries again. Appends add
one part, deletes rewrite only the parts that hold deleted rows, and compact() merges small parts.
"""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewright.config import Settings
from quirewright.functions.text import file_stem
from quirewright.operators.chunking import chunk_papers
from quirewright.operators.models import Embedder, HashEmbedder, embed
from quirewright.operators.vectors import search, search_many
from quirewright.schema import STORED


_KEPT_LISTS = 10


def chunk_ids(path: Column, index: Column) -> Column:
    """<file stem>-<hash of the path>_chunk_<i>: unlike the stem alone, unique across folders."""
    return F.concat(file_stem(path), F.lit("-"), F.substring(F.sha2(path, 256), 1, 12), F.lit("_chunk_"), index)


def plain_ids(path: Column, index: Column) -> Column:
    """<file stem>_chunk_<i>; clashes where two folders hold the same file name."""
    return F.concat(file_stem(path), F.lit("_chunk_"), index)


def list_papers(chunks: DataFrame, order: list[str]) -> DataFrame:
    """(paper_path, title, chunk_count) of each path; the title of its first chunk, 'Unknown' if null."""
    first = F.min(F.struct(*order, F.col("paper_title").alias("t")))
    return chunks.groupBy("paper_path").agg(F.coalesce(first["t"], F.lit("Unknown")).alias("title"), F.count("*").alias("chunk_count"))


def stats(chunks: DataFrame, embedding_model: str, location: str) -> DataFrame:
    """One row: total_papers, total_chunks, embedding_model, location."""
    return chunks.agg(F.count_distinct("paper_path").alias("total_papers"), F.count("*").alias("total_chunks")).withColumns({"embedding_model": F.lit(embedding_model), "location": F.lit(location)})


def new_papers(papers: DataFrame, stored: DataFrame) -> DataFrame:
    """Papers whose paper_path isn't stored yet, one per path; null paths are left out."""
    return papers.where(F.col("paper_path").isNotNull()).dropDuplicates(["paper_path"]).join(stored.select("paper_path").distinct(), "paper_path", "left_anti")


class VectorStore:
    """The chunks of papers with their vectors, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None, embedder: Embedder | None = None, settings: Settings | None = None):
        self.spark = spark
        self.settings = settings or Settings.load(spark)
        self.path = (path or f"{self.settings.store_path}/{self.settings.store_table}").rstrip("/")
        self.embedder = embedder or HashEmbedder(self.settings.embedding_dimensions)
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _file(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _lists(self) -> list[int]:
        """The numbers of the lists, the latest last."""
        if not self._fs.exists(self._hadoop.Path(self.path)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._hadoop.Path(self.path))]
        return sorted(int(n[5:]) for n in names if re.fullmatch(r"list-\d+", n))

    def _state(self) -> tuple[int, list[str]]:
        """The number and the parts of the latest list; 0 and none before the first change."""
        numbers = self._lists()
        if not numbers:
            return 0, []
        stream = self._fs.open(self._file(f"list-{numbers[-1]:010d}"))
        try:
            return numbers[-1], json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _parts(self) -> list[str]:
        return self._state()[1]

    def _publish(self, seen: int, parts: list[str]) -> bool:
        """Write the list that follows number ``seen``; False if another writer was first."""
        jvm = self.spark.sparkContext._jvm
        fresh, target = self._file(f"_new-{uuid.uuid4().hex}"), self._file(f"list-{seen + 1:010d}")
        out = self._fs.create(fresh, False)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        options = jvm.org.apache.hadoop.fs.Options.Rename
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(options, 1)
        never[0] = options.NONE
        try:
            context.rename(self._fs.makeQualified(fresh), self._fs.makeQualified(target), never)
        except Py4JJavaError as e:
            if not self._fs.exists(target):
                raise e
            self._fs.delete(fresh, False)
            return False
        for n in self._lists()[:-_KEPT_LISTS]:
            self._fs.delete(self._file(f"list-{n:010d}"), False)
        return True

    def _change(self, revise) -> int:
        """Publish ``revise(parts)``, a pair of new parts and a number to return, until no other writer was first; None leaves all as it is."""
        while True:
            seen, parts = self._state()
            made = revise(parts)
            if made is None:
                return 0
            if self._publish(seen, made[0]):
                return made[1]

    def _read(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).parquet(*(f"{self.path}/{p}" for p in parts))

    def table(self) -> DataFrame:
        """All rows; an empty table of the same schema before the first add."""
        return self._read(self._parts())

    def _write(self, rows: DataFrame) -> str:
        name = f"part-{uuid.uuid4().hex}"
        rows.select(*STORED.names).write.parquet(f"{self.path}/{name}")
        return name

    def _drop(self, part: str) -> None:
        """Delete a part that no list has named."""
        self._fs.delete(self._file(part), True)

    def add(self, papers: DataFrame, mode: str = "sections") -> int:
        """Chunk, embed and append papers (paper_path, title, text, sections) that aren't stored; the chunks added.

        Paths are compared after dropping 'file:' and doubled or trailing slashes.
        """
        path = F.regexp_replace(F.regexp_replace(F.regexp_replace("paper_path", "^file:/*", "/"), "/{2,}", "/"), "(?<=.)/$", "")
        before = self._parts()
        fresh = new_papers(papers.withColumn("paper_path", path), self._read(before))
        chunks = chunk_papers(fresh.select("paper_path", F.col("title").alias("paper_title"), "text", "sections"), mode, None, self.settings.chunk_size, self.settings.chunk_overlap)
        rows = chunks.select(
            chunk_ids(F.col("paper_path"), F.col("chunk_index")).alias("id"),
            F.col("chunk_text").alias("text"),
            embed(F.col("chunk_text"), self.embedder, self.settings.embedding_batch_size).alias("vector"),
            "paper_title",
            "paper_path",
            F.coalesce("source_section", F.lit("")).alias("section"),
            *("chunk_index", "total_chunks", "token_count", "start_pos", "end_pos"),
        )
        made = {"part": self._write(rows), "known": set(before)}

        def revise(parts: list[str]) -> tuple[list[str], int] | None:
            others = [p for p in parts if p not in made["known"]]
            if others:
                # What another writer has added since isn't added again.
                stored = self._read(others).select("paper_path").distinct()
                part = self._write(self._read([made["part"]]).join(stored, "paper_path", "left_anti"))
                self._drop(made["part"])
                made.update(part=part, known=made["known"] | set(others))
            n = self._read([made["part"]]).count()
            if not n:
                self._drop(made["part"])
                return None
            return [*parts, made["part"]], n

        return self._change(revise)

    def delete(self, paper_path: str | None = None, paper_title: str | None = None) -> int:
        """Delete by exact path, else by exact title (every paper of it); the rows deleted. Parts without such rows stay as they are."""
        if paper_path is None and paper_title is None:
            raise ValueError("give a paper_path or a paper_title")
        gone = F.col("paper_path").eqNullSafe(paper_path) if paper_path is not None else F.col("paper_title").eqNullSafe(paper_title)

        def revise(parts: list[str]) -> tuple[list[str], int] | None:
            name = F.regexp_extract(F.input_file_name(), r"(part-[0-9a-f]{32})", 1)
            hit = {r["part"]: r["n"] for r in self._read(parts).where(gone).select(name.alias("part")).groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row per part
            if not hit:
                return None
            rest = self._write(self._read([p for p in parts if p in hit]).where(~gone))
            return [*(p for p in parts if p not in hit), rest], sum(hit.values())

        return self._change(revise)

    def compact(self, small: int = 128 << 20) -> int:
        """Merge the parts of fewer than ``small`` bytes into one; how many were merged. Merged parts stay on disk for readers of older lists, until vacuum()."""

        def revise(parts: list[str]) -> tuple[list[str], int] | None:
            merge = [p for p in parts if self._fs.getContentSummary(self._file(p)).getLength() < small]
            if len(merge) < 2:
                return None
            size = sum(self._fs.getContentSummary(self._file(p)).getLength() for p in merge)
            one = self._write(self._read(merge).coalesce(max(1, -(-size // small))))
            return [*(p for p in parts if p not in merge), one], len(merge)

        return self._change(revise)

    def vacuum(self) -> int:
        """Delete the parts that no kept list names; how many. Not while others write or read older lists."""
        named: set[str] = set()
        for n in self._lists():
            stream = self._fs.open(self._file(f"list-{n:010d}"))
            named |= set(json.loads(bytes(stream.readAllBytes()).decode()))
            stream.close()
        gone = [f.getPath() for f in self._fs.listStatus(self._hadoop.Path(self.path)) if f.getPath().getName().startswith("part-") and f.getPath().getName() not in named] if self._lists() else []
        for path in gone:
            self._fs.delete(path, True)
        return len(gone)

    def find_title(self, part: str) -> DataFrame:
        """The stored papers whose title contains a text, case ignored."""
        return self.list_papers().where(F.contains(F.lower("title"), F.lit(part.lower())))

    def list_papers(self) -> DataFrame:
        return list_papers(self.table(), ["chunk_index", "id"])

    def stats(self) -> DataFrame:
        return stats(self.table(), self.embedder.name, self.path)

    def search(self, query: str, n: int = 5, paper: str | None = None, section: str | None = None, metric: str = "l2sq") -> DataFrame:
        """text, score, paper_title, section, chunk_index, metadata of the n chunks nearest to a text."""
        where = {k: v for k, v in (("paper_title", paper), ("section", section)) if v is not None}
        hits = search(self.table(), self.embedder.embed([query])[0], n, where, metric=metric)
        return _as_hits(hits)

    def search_similar(self, text: str, n: int = 5, source_path: str | None = None, strict: bool = True) -> DataFrame:
        """Chunks of other papers nearest to a text.

        The source is ``source_path``, or the nearest chunk's paper. Strict leaves it out before the
        ranking; else 3n are ranked first, so fewer than n may remain.
        """
        rows, vector = self.table(), self.embedder.embed([text])[0]
        if source_path is None:
            nearest = search(rows, vector, 1).select("paper_path").head()
            source_path = nearest["paper_path"] if nearest else None
        other = ~F.col("paper_path").eqNullSafe(source_path)
        hits = search(rows.where(other), vector, n) if strict else search(rows, vector, 3 * n).where(other).orderBy("distance", "id").limit(n)
        return _as_hits(hits)


def _as_hits(hits: DataFrame) -> DataFrame:
    return hits.select(
        "id",
        "text",
        "score",
        F.coalesce("paper_title", F.lit("Unknown")).alias("paper_title"),
        F.nullif("section", F.lit("")).alias("section"),
        F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"),
        F.struct("paper_path", "token_count", "total_chunks").alias("metadata"),
    )


__all__ = ["VectorStore", "chunk_ids", "list_papers", "new_papers", "plain_ids", "search_many", "stats"]
