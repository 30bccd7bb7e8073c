"""The facade: add, list, search, analyse and remove papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirewright.config import Settings
from quirewright.operators import analyses
from quirewright.operators.models import Completer, Embedder, HeuristicCompleter, Streamed
from quirewright.operators.store import VectorStore
from quirewright.plans.ship import ship
from quirewright.sources import arxiv, papers


class Library:
    """A store with its sources and analyses. Nothing is created before the first add."""

    def __init__(self, spark: SparkSession, path: str | None = None, embedder: Embedder | None = None, completer: Completer | None = None, settings: Settings | None = None, decoder: papers.Decoder = papers.pdf_decoder):
        ship(spark)
        self.spark, self.completer, self.decoder = spark, completer, decoder
        self.settings = settings or Settings.load(spark)
        self.store = VectorStore(spark, path, embedder, self.settings)

    def add_papers(self, rows: DataFrame) -> int:
        return self.store.add(rows)

    def add_file(self, path: str) -> int:
        return self.store.add(papers.read_file(self.spark, path, self.decoder))

    def add_folder(self, folder: str) -> tuple[int, DataFrame]:
        """The chunks added, and the files that could not be read."""
        found, errors = papers.read_folder(self.spark, folder, self.decoder)
        return self.store.add(found), errors

    def add_arxiv(self, inputs: list[str], get: arxiv.Fetch = arxiv.http_get) -> tuple[int, DataFrame]:
        """Fetch and add; the chunks added, and one row per input with its path or error."""
        rows = self.spark.createDataFrame([(i,) for i in inputs], "input string")
        got = arxiv.fetch(arxiv.plan(rows, "input"), self.settings.papers_dir, get).collect()
        paths = [r["path"] for r in got if r["path"]]
        n = 0
        if paths:
            files = self.spark.read.format("binaryFile").load(paths).select("path", "content")
            decoded = papers.decode(files, self.decoder)
            n = self.store.add(papers.structure(decoded.where("error is null")))
        return n, self.spark.createDataFrame(got, "input string, arxiv_id string, path string, error string")

    def list_papers(self) -> DataFrame:
        return self.store.list_papers()

    def stats(self) -> DataFrame:
        return self.store.stats()

    def search(self, query: str, n: int = 5, paper: str | None = None, section: str | None = None) -> DataFrame:
        return self.store.search(query, n, paper, section)

    def search_similar(self, text: str, n: int = 5, source_path: str | None = None, strict: bool = True) -> DataFrame:
        return self.store.search_similar(text, n, source_path, strict)

    def remove(self, title_part: str) -> int:
        """Delete the one paper whose title contains a text; none or several are a ValueError that lists them."""
        titles = [r["title"] for r in self.store.find_title(title_part).select("title").distinct().orderBy("title").limit(21).collect()]
        if len(titles) != 1:
            raise ValueError("no paper matches" if not titles else "several papers match: " + "; ".join(titles))
        return self.store.delete(paper_title=titles[0])

    def analyse(self, rows: DataFrame, names: list[str] | None = None) -> DataFrame:
        return analyses.analyse(rows, names, self.completer, self.settings.chunk_size, self.settings.chunk_overlap)

    def rigor(self, rows: DataFrame) -> DataFrame:
        return analyses.rigor_scores(rows, self.completer)

    def chat(self, messages: list[dict]) -> dict:
        """One reply to a conversation of any length: content, model and token counts (0 where unknown)."""
        completer = self.completer or HeuristicCompleter()
        r = completer.complete(messages)
        p, c = r.get("prompt_tokens") or 0, r.get("completion_tokens") or 0
        return {"content": r["content"], "model": completer.name, "prompt_tokens": p, "completion_tokens": c, "total_tokens": p + c}

    def generate(self, prompt: str, system: str | None = None) -> dict:
        return self.chat([*([{"role": "system", "content": system}] if system is not None else []), {"role": "user", "content": prompt}])

    def stream(self, prompt: str, system: str | None = None) -> Streamed:
        """The reply in pieces, with its counts at the end; whole at once where the completer can't stream."""
        messages = [*([{"role": "system", "content": system}] if system is not None else []), {"role": "user", "content": prompt}]
        return Streamed(self.completer or HeuristicCompleter(), messages)

    def ask(self, question: str, n: int = 5) -> DataFrame:
        return analyses.ask(self.search(question, n), "rag_query", {"question": question}, completer=self.completer)

    def compare(self, topic: str, n: int = 10) -> DataFrame:
        return analyses.ask(self.search(topic, n), "compare_papers", {"topic": topic}, completer=self.completer)

    def cross_reference(self, claim: str, n: int = 5) -> DataFrame:
        return analyses.ask(self.search_similar(claim, n), "cross_reference", {"claim": claim}, completer=self.completer)

    def critique_claims(self, claim: str, n: int = 5) -> DataFrame:
        return analyses.ask(self.search(claim, n), "critique_claims", {}, completer=self.completer)


_DEFAULT: dict[str, Library] = {}


def default(spark: SparkSession | None = None) -> Library:
    """The library of the settings' store, one per application."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("there is no active session")
    app = spark.sparkContext.applicationId
    if app not in _DEFAULT:
        _DEFAULT.clear()
        _DEFAULT[app] = Library(spark)
    return _DEFAULT[app]


def add_folder(folder: str) -> tuple[int, DataFrame]:
    return default().add_folder(folder)


def search(query: str, n: int = 5, paper: str | None = None, section: str | None = None) -> DataFrame:
    return default().search(query, n, paper, section)


def search_similar(text: str, n: int = 5, source_path: str | None = None) -> DataFrame:
    return default().search_similar(text, n, source_path)


def list_papers() -> DataFrame:
    return default().list_papers()


def analyse(rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    return default().analyse(rows, names)


def rigor(rows: DataFrame) -> DataFrame:
    return default().rigor(rows)
