"""The store, the sources, the stream, the facade and the command line."""

import pytest

from quirewright.cli import run
from quirewright.config import Settings
from quirewright.library import Library
from quirewright.operators.models import HashEmbedder
from quirewright.operators.store import VectorStore
from quirewright.sources import arxiv, papers
from quirewright.streaming.ingest import ingest_folder

KIND = "paper_path string, title string, text string, sections array<struct<name:string,content:string,start_pos:int,end_pos:int>>"
TEXT = "On herons\n\nAbstract\n" + "We count herons at ponds in spring. " * 3 + "\n\nIntroduction\nWe begin.\n\nMethods\nWe walked.\n\nResults\nMany herons."


@pytest.fixture
def store(spark, tmp_path):
    return VectorStore(spark, str(tmp_path / "store"), HashEmbedder(16), Settings())


def rows(spark):
    return spark.createDataFrame([("/x/a.pdf", "It's a \"title\"", "herons fly", []), ("/y/a.pdf", "Other", "ponds freeze", [("Methods", "we swam", 0, 3)]), ("/x//a.pdf", "Again", "dup", []), (None, "No path", "t", [])], KIND)


def test_store(spark, store):
    assert store.table().count() == 0 and store.search("x").count() == 0
    assert store.add(rows(spark)) == 2
    assert store.add(rows(spark)) == 0
    ids = {r["id"] for r in store.table().collect()}
    assert len(ids) == 2  # the same stem in two folders
    assert {r["paper_path"] for r in store.list_papers().collect()} == {"/x/a.pdf", "/y/a.pdf"}
    s = store.stats().head()
    assert (s["total_papers"], s["total_chunks"]) == (2, 2)
    best = store.search("herons fly", 1).head()
    assert best["text"] in ("herons fly", "dup") or best["score"] > 0
    assert [r["section"] for r in store.search("we swam", 5, section="Methods").collect()] == ["Methods"]
    assert {r["metadata"]["paper_path"] for r in store.search_similar("ponds", 5, "/y/a.pdf").collect()} == {"/x/a.pdf"}
    title = next(r["title"] for r in store.list_papers().collect() if r["paper_path"] == "/x/a.pdf")
    assert store.delete(paper_title=title) == 1
    assert store.delete(paper_path="/nowhere") == 0
    assert store.table().count() == 1
    with pytest.raises(ValueError):
        store.delete()


def test_folder_and_errors(spark, tmp_path):
    d = tmp_path / "in"
    (d / "sub").mkdir(parents=True)
    (d / "a.pdf").write_text(TEXT + "\f \f" + "Page two.", encoding="utf-8")
    (d / "b.pdf").write_bytes(b"\xff\xfe\xff")
    (d / "c.txt").write_text("no")
    (d / "sub" / "d.pdf").write_text("deeper")
    found, errors = papers.read_folder(spark, str(d), papers.plain_decoder)
    paper = found.collect()
    assert len(paper) == 1 and paper[0]["page_count"] == 2 and paper[0]["title"] == "a"
    assert [s["name"] for s in paper[0]["sections"]] == ["Abstract", "Introduction", "Methods", "Results"]
    assert paper[0]["abstract"].startswith("We count")
    assert errors.count() == 1 and "UnicodeDecodeError" in errors.head()["error"]
    with pytest.raises(FileNotFoundError):
        papers.read_file(spark, str(d / "none.pdf"), papers.plain_decoder)
    with pytest.raises(ValueError):
        papers.read_file(spark, str(d / "c.txt"), papers.plain_decoder)


def test_arxiv(spark, tmp_path):
    calls = []

    def get(url):
        if "1111.11111" in url:
            raise OSError("down")
        return TEXT.encode()

    inputs = spark.createDataFrame([("2301.07041",), ("bad",), ("1111.11111",)], "input string")
    got = {r["input"]: r for r in arxiv.fetch(arxiv.plan(inputs, "input"), str(tmp_path), get).collect()}
    assert got["2301.07041"]["path"].endswith("arxiv_2301.07041.pdf") and got["bad"]["error"].startswith("ValueError")
    assert got["1111.11111"]["error"].startswith("ConnectionError")
    assert [p.name for p in tmp_path.iterdir()] == ["arxiv_2301.07041.pdf"] and not calls

    def never(url):
        raise AssertionError(url)

    again = arxiv.fetch(arxiv.plan(inputs.limit(1), "input"), str(tmp_path), never).head()
    assert again["error"] is None


def test_stream(spark, store, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.pdf").write_text(TEXT)
    for _ in range(2):
        q = ingest_folder(spark, str(d), store, str(tmp_path / "cp"), papers.plain_decoder)
        q.awaitTermination(60)
    assert store.list_papers().count() == 1


def test_library_and_cli(spark, tmp_path, capsys):
    f = tmp_path / "herons.pdf"
    f.write_text(TEXT)
    base = ["--store", str(tmp_path / "s"), "--plain"]
    assert run([*base, "add", str(f)], spark) == 0 and "4 chunks added" in capsys.readouterr().out
    assert run([*base, "list"], spark) == 0 and "herons" in capsys.readouterr().out
    assert run([*base, "search", "herons", "-n", "1"], spark) == 0
    assert run([*base, "score", str(f)], spark) == 0 and "BULLSHIT SCORE" in capsys.readouterr().out
    assert run([*base, "critique", str(f), "--focus", "unknown"], spark) == 0 and "Full critique" in capsys.readouterr().out
    assert run([*base, "remove", "nothing"], spark) == 1
    library = Library(spark, str(tmp_path / "s"))
    assert library.ask("Where are herons?").head()["model_used"] == "offline-heuristic"
    assert "".join(library.stream("One. Two.")).split() == library.generate("One. Two.", "sys")["content"].split()
    assert library.chat([{"role": "user", "content": "Hi there."}])["total_tokens"] > 0
    assert library.remove("HERON") == 4
    assert run([*base, "add", str(tmp_path / "none.pdf")], spark) == 1
    assert run([*base, "config"], spark) == 0


def test_settings(spark, tmp_path):
    env = tmp_path / ".env"
    env.write_text("CHUNK_SIZE=10\n# comment\nOLLAMA_MODEL='m'\n")
    s = Settings.load(None, {"chunk_overlap": "3"}, str(env))
    assert (s.chunk_size, s.chunk_overlap, s.ollama_model, s.embedding_dimensions) == (10, 3, "m", 768)


def test_sql_functions(spark):
    from quirewright.plans.sql import register

    register(spark)
    assert spark.sql("SELECT c.* FROM VALUES ('one two three four') t(x), LATERAL chunk(x, 2, 0) c").count() >= 2
    row = spark.sql("SELECT rigor_rating(3.5) AS a, rigor_severity(7) AS b, similarity(1) AS c").head()
    assert (row["a"], row["b"], row["c"]) == ("Good", "bad", 0.5)


def test_arrivals(spark, tmp_path):
    from quirewright.streaming.ingest import arrivals

    folder = str(tmp_path / "rows")
    spark.sql("SELECT * FROM VALUES (TIMESTAMP '2024-01-01 10:00:00', 'a'), (TIMESTAMP '2024-01-01 11:00:00', 'a'), (TIMESTAMP '2024-01-20 00:00:00', 'b') t(ts, kind)").write.parquet(folder)
    stream = spark.readStream.schema("ts timestamp, kind string").parquet(folder)
    q = arrivals(stream, "ts", "kind").writeStream.format("memory").queryName("arrived").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["kind"], r["n"]) for r in spark.table("arrived").collect()) == [("a", 2), ("b", 1)]


def test_http_model():
    """Against a small server of our own."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from quirewright.operators.models import HttpModel

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def _send(self, *parts):
            self.send_response(200)
            self.end_headers()
            self.wfile.write("\n".join(json.dumps(p) for p in parts).encode())

        def do_GET(self):
            self._send({"models": [{"name": "m:latest"}]})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if self.path == "/api/embed":
                self._send({"embeddings": [[float(len(t))] for t in body["input"]]})
            elif body.get("stream"):
                self._send({"message": {"content": "a "}}, {"message": {"content": "b"}, "done": True})
            elif self.path == "/api/chat":
                self._send({"message": {"content": "reply"}, "eval_count": 2})
            else:
                self._send({"name": body["model"]})

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        m = HttpModel(f"http://127.0.0.1:{server.server_port}", "m:7b")
        assert m.embed(["ab", "c"]) == [[2.0], [1.0]] and m.is_available() and m.info() == {"name": "m:7b"}
        assert m.complete([{"role": "user", "content": "x"}]) == {"content": "reply", "prompt_tokens": 0, "completion_tokens": 2}
        assert list(m.stream([{"role": "user", "content": "x"}])) == ["a ", "b"]
    finally:
        server.shutdown()
    assert not HttpModel("http://127.0.0.1:9", "m", timeout=1).is_available() and HttpModel("http://127.0.0.1:9", "m", timeout=1).info() is None


def test_tables_in_the_shared_folder(spark, tmp_path):
    from quirewright.plans.storage import materialise, release, shared_dir

    folder = shared_dir(spark)
    assert folder.rstrip("/") == folder
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or folder == configured.rstrip("/")
    df = materialise(spark.range(5), "five")
    assert df.count() == 5 and folder.removeprefix("file://") + "/tables/five-" in df.inputFiles()[0]
    assert release(spark) >= 1 and release(spark) == 0


def parts_of(store):
    return store._state()[1]


def test_delete_leaves_other_parts_alone(spark, store):
    for i in range(3):
        store.add(spark.createDataFrame([(f"/x/{i}.pdf", f"T{i}", f"text number {i}", []), (f"/z/{i}.pdf", f"Z{i}", f"other text {i}", [])], KIND))
    before = parts_of(store)
    assert len(before) == 3 and store.delete(paper_path="/x/1.pdf") == 1
    after = parts_of(store)
    assert set(before) - set(after) == {before[1]} and len(after) == 3
    assert {r["paper_path"] for r in store.table().collect()} == {"/x/0.pdf", "/z/0.pdf", "/z/1.pdf", "/x/2.pdf", "/z/2.pdf"}
    assert store.compact() == 3 and len(parts_of(store)) == 1 and store.table().count() == 5
    assert store.compact() == 0
    store.vacuum()
    assert store.table().count() == 5


def test_two_writers_lose_nothing(spark, store):
    other = VectorStore(spark, store.path, HashEmbedder(16), Settings())
    store.add(spark.createDataFrame([("/a.pdf", "A", "first text", [])], KIND))
    publish, came = store._publish, []

    def late(seen, parts):
        # Another writer adds a paper of ours and one of its own, and deletes one, just before we publish.
        if not came:
            came.append(other.add(spark.createDataFrame([("/b.pdf", "B", "second text", []), ("/c.pdf", "C", "third text", [])], KIND)))
            other.delete(paper_path="/a.pdf")
        return publish(seen, parts)

    store._publish = late
    assert store.add(spark.createDataFrame([("/b.pdf", "B", "second text", []), ("/d.pdf", "D", "fourth text", [])], KIND)) == 1
    assert came == [2] and sorted(r["paper_path"] for r in store.table().collect()) == ["/b.pdf", "/c.pdf", "/d.pdf"]
    came.clear()
    late_delete = store.delete(paper_path="/d.pdf")
    assert late_delete == 1 and sorted(r["paper_path"] for r in store.table().collect()) == ["/b.pdf", "/c.pdf"]


def test_a_list_is_never_overwritten(store, spark):
    store.add(spark.createDataFrame([("/a.pdf", "A", "first text", [])], KIND))
    seen, parts = store._state()
    assert store._publish(seen, [*parts]) and not store._publish(seen, [])
    assert parts_of(store) == parts


def pdf_file(pages: list[str], packed: bool, title: str = "On ponds") -> bytes:
    """A small PDF file: one font, one content stream per page; packed: compressed."""
    import zlib

    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", 4: b"<< /Title (" + title.encode("latin-1") + b") >>"}
    kids = []
    for i, page in enumerate(pages):
        lines = b"".join(b"0 -14 Td (" + x.encode("latin-1").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj\n" for x in page.split("\n"))
        data = b"BT /F1 12 Tf 72 720 Td\n" + lines + b"ET"
        data = zlib.compress(data) if packed else data
        n = 5 + 2 * i
        objects[n] = b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (n + 1)
        objects[n + 1] = b"<< /Length %d %s>>\nstream\n" % (len(data), b"/Filter /FlateDecode " if packed else b"") + data + b"\nendstream"
        kids.append(b"%d 0 R" % n)
    objects[2] = b"<< /Type /Pages /Count %d /Kids [ %s ] >>" % (len(pages), b" ".join(kids))
    body = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in sorted(objects.items()))
    return body + b"trailer << /Root 1 0 R /Info 4 0 R /Size 99 >>\n%%EOF"


@pytest.mark.parametrize("packed", [False, True])
def test_pdf_files(spark, tmp_path, packed):
    from quirewright.sources.pdf import decode_pdf

    pages = ["On ponds\nAbstract\nWe count (all) herons\\ducks.", "Caf\xe9 notes\nend."]
    assert decode_pdf(pdf_file(pages, packed)) == (pages, {"title": "On ponds"})
    (tmp_path / "a.pdf").write_bytes(pdf_file([TEXT.replace("\n\n", "\n"), "Page two."], packed))
    (tmp_path / "b.pdf").write_bytes(b"no PDF at all")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4\n1 0 obj\n<< /Length 3 /Filter /FlateDecode >>\nstream\nxyz\nendstream\nendobj")
    found, errors = papers.read_folder(spark, str(tmp_path))
    got = found.collect()
    assert len(got) == 1 and got[0]["title"] == "On ponds" and got[0]["page_count"] == 2
    assert {"Methods", "Results"} <= {x["name"] for x in got[0]["sections"]} and errors.count() == 2


def test_pdf_unicode_tables():
    from quirewright.sources.pdf import _text, _unicode_table

    table = _unicode_table(b"1 beginbfchar <0003> <0416> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange")
    assert _text(b"BT /F2 9 Tf [<0003> -250 <00100011>] TJ 0 -11 Td <0012> Tj ET", {b"F2": table}) == "\u0416 ab\nc"


def test_streamed_counts(spark, tmp_path):
    library = Library(spark, str(tmp_path / "s"))
    reply = library.stream("One. Two.", "sys")
    assert "".join(reply) == reply.content and reply.completion_tokens == len(reply.content.split()) and reply.total_tokens > reply.completion_tokens


def test_downloads_come_in_pieces(tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"x" * 20_000)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/a"
        assert max(map(len, arxiv.http_get(url))) <= 8_192
        path = arxiv.save(arxiv.http_get(url), str(tmp_path), "a.pdf")
        assert open(path, "rb").read() == b"x" * 20_000 and [p.name for p in tmp_path.iterdir()] == ["a.pdf"]
    finally:
        server.shutdown()


def test_default_library(spark, tmp_path, monkeypatch):
    from quirewright import library

    library._DEFAULT.clear()
    made = Library(spark, str(tmp_path / "s"))
    library._DEFAULT[spark.sparkContext.applicationId] = made
    made.add_papers(rows(spark))
    assert library.default(spark) is made and library.list_papers().count() == 2 and library.search("herons fly", 1).count() == 1
    library._DEFAULT.clear()
