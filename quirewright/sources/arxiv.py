"""Papers from arXiv: ids, what is already there, and an idempotent download on the executors."""

from __future__ import annotations

import http.client
import os
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewright.functions.text import arxiv_file, arxiv_id, arxiv_url

#: The content of a URL, whole or in pieces.
Fetch = Callable[[str], bytes | Iterable[bytes]]


class _Patient:
    """Gives up connecting sooner than reading."""

    connect_timeout, read_timeout = 10.0, 30.0

    def connect(self) -> None:
        self.timeout = self.connect_timeout
        super().connect()
        self.sock.settimeout(self.read_timeout)


class _Http(_Patient, http.client.HTTPConnection):
    pass


class _Https(_Patient, http.client.HTTPSConnection):
    pass


class _HttpHandler(urllib.request.HTTPHandler):
    def http_open(self, request):
        return self.do_open(_Http, request)


class _HttpsHandler(urllib.request.HTTPSHandler):
    def https_open(self, request):
        return self.do_open(_Https, request)


def http_get(url: str, piece: int = 8_192) -> Iterator[bytes]:
    """The content in pieces; 10 s to connect, 30 s for each read."""
    with urllib.request.build_opener(_HttpHandler, _HttpsHandler).open(url) as reply:
        while part := reply.read(piece):
            yield part


def plan(inputs: DataFrame, column: str, landed: DataFrame | None = None) -> DataFrame:
    """(input, arxiv_id, url, file, status) of inputs: 'invalid', 'cached' if the file is among ``landed`` (file), else 'fetch'."""
    rows = inputs.select(F.col(column).alias("input"), arxiv_id(F.col(column)).alias("arxiv_id"))
    rows = rows.withColumns({"url": arxiv_url(F.col("arxiv_id")), "file": arxiv_file(F.col("arxiv_id"))})
    rows = rows.withColumn("url", F.when(F.col("arxiv_id").isNotNull(), F.col("url")))
    if landed is not None:
        rows = rows.join(landed.select("file").distinct().withColumn("there", F.lit(True)), "file", "left")
    else:
        rows = rows.withColumn("there", F.lit(None).cast("boolean"))
    status = F.when(F.col("arxiv_id").isNull(), "invalid").when(F.col("there"), "cached").otherwise("fetch")
    return rows.select("input", "arxiv_id", "url", "file", status.alias("status"))


def save(content: bytes | Iterable[bytes], folder: str, file: str) -> str:
    """Write beside the target and rename, so that no partial file can pass for a whole one."""
    os.makedirs(folder, exist_ok=True)
    target = os.path.join(folder, file)
    fresh = f"{target}.{uuid.uuid4().hex}.part"
    try:
        with open(fresh, "wb") as f:
            for part in [content] if isinstance(content, bytes) else content:
                f.write(part)
        os.replace(fresh, target)
    finally:
        if os.path.exists(fresh):
            os.remove(fresh)
    return target


def fetch(planned: DataFrame, folder: str, get: Fetch = http_get) -> DataFrame:
    """(input, arxiv_id, path, error) of planned rows; the folder must be shared by all executors.

    A repeated task finds its file and doesn't ask again.
    """

    @F.pandas_udf("struct<path:string,error:string>")
    def run(status: pd.Series, url: pd.Series, file: pd.Series) -> pd.DataFrame:
        rows = []
        for s, u, f in zip(status, url, file):
            target = os.path.join(folder, f) if f else None
            if s == "invalid":
                rows.append((None, "ValueError: no arXiv id"))
            elif s == "cached" or os.path.exists(target):
                rows.append((target, None))
            else:
                try:
                    rows.append((save(get(u), folder, f), None))
                except urllib.error.HTTPError as e:
                    rows.append((None, "FileNotFoundError: no such paper" if e.code == 404 else f"ConnectionError: status {e.code}"))
                except Exception as e:  # whatever a network does becomes an error row
                    rows.append((None, f"ConnectionError: {e}"))
        return pd.DataFrame(rows, columns=["path", "error"])

    return planned.withColumn("r", run("status", "url", "file")).select("input", "arxiv_id", "r.path", "r.error")
