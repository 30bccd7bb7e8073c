"""The registered queries of the core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirewright.functions import score, sections, text
from quirewright.functions.prompts import ANALYSES, FULL_ANALYSIS, TEMPLATES
from quirewright.operators import analyses, chunking, context, store, vectors
from quirewright.operators.models import HashEmbedder, embed
from quirewright.plans.storage import table
from quirewright.sources import arxiv

Query = Callable[[SparkSession, str], DataFrame]
_SPARK: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _SPARK[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_SPARK)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# DuckDB's patterns read ASCII white space; these names spell out what Unicode adds.
_WS = r"[\s\x{000b}\x{001c}-\x{001f}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _sql_clean(x: str) -> str:
    x = f"replace({x}, '-' || chr(10), '')"
    x = rf"regexp_replace({x}, '[ \t]+', ' ', 'g')"
    x = rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    x = rf"regexp_replace({x}, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')"
    for a, b in text.LIGATURES.items():
        x = f"replace({x}, '{a}', '{b}')"
    return _sql_strip(x)


# ---------------------------------------------------------------- vector search


def _vector_of(spark: SparkSession, folder: str, name: str, id_col: str, value: int, vector: str) -> list[float]:
    row = table(spark, folder, name).where(F.col(id_col) == value).select(vector).head()
    return list(row[0]) if row and row[0] is not None else []


_D = "list_sum(list_transform(list_zip(v::DOUBLE[], q::DOUBLE[]), lambda p: power(p[1] - p[2], 2)))"


@_query(
    f"""SELECT vec_id, label::BIGINT AS label, round(d, 6) AS distance, round(1 / (1 + d), 6) AS score FROM (
    SELECT vec_id, label, {_D} AS d FROM (SELECT vec_id, label, embedding AS v, (SELECT embedding FROM embeddings WHERE vec_id = 7) AS q FROM embeddings))
    ORDER BY d, vec_id LIMIT 5"""
)
def knn_top5(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of vector 7."""
    query = _vector_of(spark, folder, "embeddings", "vec_id", 7, "embedding")
    hits = vectors.search(table(spark, folder, "embeddings"), query, 5, vector="embedding", id_col="vec_id")
    return hits.select("vec_id", F.col("label").cast("long").alias("label"), F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


_PAPER_Q = "(SELECT vector FROM papers WHERE vector IS NOT NULL AND list_sum(list_transform(vector, lambda x: abs(x))) > 0 ORDER BY row_id LIMIT 1)"


def _paper_query(spark: SparkSession, folder: str) -> list[float]:
    good = F.col("vector").isNotNull() & F.exists("vector", lambda x: x != 0)
    row = table(spark, folder, "papers").where(good).orderBy("row_id").select("vector").head()
    return list(row[0]) if row else []


@_query(
    f"""SELECT row_id, paper_title, round(d, 5) AS distance, round(1 / (1 + d), 5) AS score FROM (
    SELECT row_id, coalesce(paper_title, 'Unknown') AS paper_title, {_D} AS d FROM (SELECT row_id, paper_title, vector AS v, {_PAPER_Q} AS q FROM papers WHERE section = 'Methods' AND vector IS NOT NULL))
    ORDER BY d, row_id LIMIT 5"""
)
def knn_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest chunks among those of one section; the filter reaches the scan."""
    hits = vectors.search(table(spark, folder, "papers"), _paper_query(spark, folder), 5, {"section": "Methods"}, id_col="row_id")
    return hits.select("row_id", F.coalesce("paper_title", F.lit("Unknown")).alias("paper_title"), F.round("distance", 5).alias("distance"), F.round("score", 5).alias("score"))


_ASKED = "(SELECT vec_id AS query_id, embedding AS q, label AS own FROM embeddings WHERE vec_id % 50 = 0)"


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    own = table(spark, folder, "embeddings").where(F.col("vec_id") % 50 == 0)
    return own.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("label").alias("exclude_value"))


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", F.col("id").alias("vec_id"), F.col("rank").cast("long").alias("rank"), F.round("distance", 5).alias("distance"), F.round("score", 5).alias("score"))


@_query(
    f"""SELECT query_id, vec_id, rank, round(d, 5) AS distance, round(1 / (1 + d), 5) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM (SELECT query_id, vec_id, {_D} AS d FROM (SELECT query_id, q, vec_id, embedding AS v FROM {_ASKED}, embeddings)))
    WHERE rank <= 5"""
)
def knn_per_query(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest of every fiftieth vector, against all vectors."""
    return _rounded(vectors.search_many(table(spark, folder, "embeddings"), _asked(spark, folder), 5, "embedding", "vec_id"))


@_query(
    f"""SELECT query_id, vec_id, rank, round(d, 5) AS distance, round(1 / (1 + d), 5) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM (SELECT query_id, vec_id, {_D} AS d FROM (SELECT query_id, q, vec_id, embedding AS v FROM {_ASKED}, embeddings WHERE label <> own)))
    WHERE rank <= 5"""
)
def similar_excluding_group(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest of other groups: the own group is left out before the ranking."""
    return _rounded(vectors.search_many(table(spark, folder, "embeddings"), _asked(spark, folder), 5, "embedding", "vec_id", exclude="label"))


@_query(
    f"""SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank, round(d, 5) AS distance, round(1 / (1 + d), 5) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS r FROM (SELECT query_id, own, label, vec_id, {_D} AS d FROM (SELECT query_id, own, label, q, vec_id, embedding AS v FROM {_ASKED}, embeddings)))
    WHERE r <= 15 AND label <> own QUALIFY rank <= 5"""
)
def similar_overfetch(spark: SparkSession, folder: str) -> DataFrame:
    """As before, but the 15 nearest are ranked first and filtered then; fewer than five may remain."""
    return _rounded(vectors.search_many(table(spark, folder, "embeddings"), _asked(spark, folder), 5, "embedding", "vec_id", exclude="label", strict=False))


@_query(
    f"""SELECT query_id, id, rank::INT AS rank, round(d, 5) AS distance, round(1 / (1 + d), 5) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM (SELECT query_id, id, {_D} AS d FROM (
    SELECT a.row_id AS query_id, b.row_id AS id, a.vector AS q, b.vector AS v FROM papers a JOIN papers b ON len(a.vector) = len(b.vector) AND (a.paper_path IS NULL OR b.paper_path IS DISTINCT FROM a.paper_path) WHERE a.row_id % 50 = 0)))
    WHERE rank <= 5"""
)
def paper_cross_reference(spark: SparkSession, folder: str) -> DataFrame:
    """For every fiftieth chunk row the five nearest chunks of other papers."""
    rows = table(spark, folder, "papers")
    asked = rows.where((F.col("row_id") % 50 == 0) & F.col("vector").isNotNull()).select(F.col("row_id").alias("query_id"), F.col("vector").alias("query_vector"), F.col("paper_path").alias("exclude_value"))
    return vectors.search_many(rows, asked, 5, "vector", "row_id", exclude="paper_path").withColumn("distance", F.round("distance", 5)).withColumn("score", F.round("score", 5))


# ---------------------------------------------------------------- the store


@_query(
    """SELECT paper_path, coalesce(list(paper_title ORDER BY chunk_index, row_id)[1], 'Unknown') AS title, count(*)::BIGINT AS chunk_count
    FROM papers GROUP BY paper_path"""
)
def list_papers(spark: SparkSession, folder: str) -> DataFrame:
    """Stored papers, with the title of the first chunk; no vector is read."""
    return store.list_papers(table(spark, folder, "papers"), ["chunk_index", "row_id"])


@_query("SELECT count(DISTINCT paper_path)::BIGINT AS total_papers, count(*)::BIGINT AS total_chunks, 'nomic-embed-text' AS embedding_model, 'papers' AS location FROM papers")
def library_stats(spark: SparkSession, folder: str) -> DataFrame:
    return store.stats(table(spark, folder, "papers"), "nomic-embed-text", "papers")


@_query("SELECT path AS paper_path, min(paper_id)::BIGINT AS paper_id FROM extracted_papers WHERE path NOT IN (SELECT paper_path FROM papers WHERE paper_path IS NOT NULL) GROUP BY path")
def add_new_only(spark: SparkSession, folder: str) -> DataFrame:
    """Papers that the store doesn't hold yet."""
    papers = table(spark, folder, "extracted_papers").select(F.col("path").alias("paper_path"), "paper_id")
    return store.new_papers(papers, table(spark, folder, "papers")).select("paper_path", "paper_id")


@_query(
    """SELECT origin, count(*)::BIGINT AS n, count(DISTINCT paper_path)::BIGINT AS n_papers FROM (SELECT 'stored' AS origin, paper_path FROM papers
    UNION ALL SELECT 'new', paper_path FROM text_chunks WHERE paper_path NOT IN (SELECT paper_path FROM papers WHERE paper_path IS NOT NULL)) GROUP BY origin"""
)
def append_union(spark: SparkSession, folder: str) -> DataFrame:
    """The store after appending the chunks of papers that it didn't hold."""
    stored = table(spark, folder, "papers").select("paper_path")
    fresh = table(spark, folder, "text_chunks").where(F.col("paper_path").isNotNull()).select("paper_path").join(stored.distinct(), "paper_path", "left_anti")
    both = stored.select(F.lit("stored").alias("origin"), "paper_path").unionByName(fresh.select(F.lit("new").alias("origin"), "paper_path"))
    return both.groupBy("origin").agg(F.count("*").alias("n"), F.count_distinct("paper_path").alias("n_papers"))


@_query(
    """WITH t AS (SELECT min(paper_title) AS title FROM papers)
    SELECT count(*) FILTER (paper_title = title)::BIGINT AS deleted, count(*) FILTER (paper_title IS DISTINCT FROM title)::BIGINT AS kept, count(*)::BIGINT AS total FROM papers, t"""
)
def delete_by_title(spark: SparkSession, folder: str) -> DataFrame:
    """What deleting all papers of one title removes and keeps; rows without a title stay."""
    rows = table(spark, folder, "papers").select("paper_title")
    title = rows.agg(F.min("paper_title")).head()[0]
    gone = F.col("paper_title").eqNullSafe(title)
    return rows.agg(F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("kept"), F.count("*").alias("total"))


@_query(
    """SELECT paper_path, title, chunk_count FROM (SELECT paper_path, coalesce(list(paper_title ORDER BY chunk_index, row_id)[1], 'Unknown') AS title, count(*)::BIGINT AS chunk_count FROM papers GROUP BY paper_path)
    WHERE contains(lower(title), 'tidal')"""
)
def title_contains(spark: SparkSession, folder: str) -> DataFrame:
    return list_papers(spark, folder).where(F.contains(F.lower("title"), F.lit("tidal")))


@_query(
    r"""SELECT row_id, regexp_replace(regexp_extract(paper_path, '([^/]+)/*$', 1), '(.)\.[^.]*$', '\1') || '_chunk_' || chunk_index::VARCHAR AS plain_id,
    regexp_replace(regexp_extract(paper_path, '([^/]+)/*$', 1), '(.)\.[^.]*$', '\1') || '-' || substr(sha256(paper_path), 1, 12) || '_chunk_' || chunk_index::VARCHAR AS chunk_id FROM papers"""
)
def row_ids(spark: SparkSession, folder: str) -> DataFrame:
    path, index = F.col("paper_path"), F.col("chunk_index")
    return table(spark, folder, "papers").select("row_id", store.plain_ids(path, index).alias("plain_id"), store.chunk_ids(path, index).alias("chunk_id"))


@_query(
    """SELECT row_id, coalesce(paper_title, 'Unknown') AS paper_title, nullif(section, '') AS section, coalesce(chunk_index, 0)::BIGINT AS chunk_index, coalesce(token_count, 0)::BIGINT AS token_count,
    coalesce(len(vector) = 768 AND NOT list_contains(list_transform(vector, lambda x: x IS NULL), true), false) AS fits FROM papers"""
)
def repaired_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Stored rows with defaults for what is missing, and whether the vector has the store's width."""
    return table(spark, folder, "papers").select(
        "row_id",
        F.coalesce("paper_title", F.lit("Unknown")).alias("paper_title"),
        F.nullif("section", F.lit("")).alias("section"),
        F.coalesce("chunk_index", F.lit(0)).cast("long").alias("chunk_index"),
        F.coalesce("token_count", F.lit(0)).cast("long").alias("token_count"),
        F.coalesce(vectors.check_width(F.col("vector"), 768), F.lit(False)).alias("fits"),
    )


# ---------------------------------------------------------------- text

_DIRTY = "replace(replace(replace(text, 'fi', 'ﬁ'), ' the ', '  the' || chr(9)), '. ', '.' || chr(10) || chr(10) || chr(10) || chr(1))"


@_query(f"SELECT doc_id, md5(cleaned) AS cleaned, length(cleaned)::BIGINT AS n FROM (SELECT doc_id, {_sql_clean(_DIRTY)} AS cleaned FROM documents)")
def clean_dirty(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaning of documents into which ligatures, tabs, blank lines and control characters were put."""
    dirty = F.replace(F.replace(F.replace(F.col("text"), F.lit("fi"), F.lit("ﬁ")), F.lit(" the "), F.lit("  the\t")), F.lit(". "), F.lit(".\n\n\n\x01"))
    c = text.clean_text(dirty)
    return table(spark, folder, "documents").select("doc_id", F.md5(c.cast("binary")).alias("cleaned"), F.length(c).cast("long").alias("n"))


@_query(f"SELECT paper_id, md5(cleaned) AS cleaned, length(cleaned)::BIGINT AS n FROM (SELECT paper_id, {_sql_clean('text')} AS cleaned FROM extracted_papers)")
def clean_papers(spark: SparkSession, folder: str) -> DataFrame:
    c = text.clean_text(F.col("text"))
    return table(spark, folder, "extracted_papers").select("paper_id", F.md5(c.cast("binary")).alias("cleaned"), F.length(c).cast("long").alias("n"))


@_query(
    rf"""SELECT paper_id, len(list_filter(string_split_regex(text, '{_WS}+'), lambda w: w <> ''))::BIGINT AS words,
    len(regexp_extract_all(text, '[\pL\pN]+|[^\s\pL\pN]'))::BIGINT AS tokens, length(abstract) > 50 AND abstract IS NOT NULL AS has_abstract FROM extracted_papers"""
)
def counts(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("text")
    return table(spark, folder, "extracted_papers").select("paper_id", text.word_count(c).alias("words"), text.token_count(c).alias("tokens"), sections.has_abstract(F.col("abstract")).alias("has_abstract"))


@_query(
    rf"""SELECT doc_id, i::BIGINT AS i, md5(p) AS p FROM (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) - 1 AS i FROM (
    SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n{_WS}*\n'), lambda x: {_sql_strip('x')}), lambda x: x <> '') AS l FROM documents))"""
)
def paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.posexplode(text.paragraphs(F.col("text"))).alias("i", "p")).select("doc_id", F.col("i").cast("long").alias("i"), F.md5(F.col("p").cast("binary")).alias("p"))


def _sql_protect(x: str) -> str:
    for a in text.ABBREVIATIONS:
        x = f"replace({x}, '{a}', '{a.replace('.', '<<DOT>>')}')"
    return x


@_query(
    rf"""SELECT doc_id, i::BIGINT AS i, md5(s) AS s FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id,
    list_filter(list_transform(string_split(regexp_replace({_sql_protect('text')}, '([.!?]){_WS}+([A-Z])', '\1' || chr(31) || '\2', 'g'), chr(31)), lambda x: {_sql_strip("replace(x, '<<DOT>>', '.')")}), lambda x: x <> '') AS l FROM documents))"""
)
def plain_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences by a full stop and a capital, abbreviations protected anywhere."""
    rows = table(spark, folder, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("i", "s"))
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), F.md5(F.col("s").cast("binary")).alias("s"))


@_query(
    "SELECT doc_id, id AS arxiv_id, 'https://arxiv.org/pdf/' || id || '.pdf' AS url, 'arxiv_' || replace(id, '/', '_') || '.pdf' AS file FROM (SELECT doc_id, coalesce("
    + ", ".join(rf"nullif(regexp_extract(regexp_replace({_sql_strip('text')}, '(?i)\.pdf$', ''), '(?i){p}', 1), '')" for p in text.ARXIV_PATTERNS)
    + ") AS id FROM documents) WHERE id IS NOT NULL"
)
def arxiv_ids(spark: SparkSession, folder: str) -> DataFrame:
    """arXiv ids in documents, their addresses and file names."""
    rows = table(spark, folder, "documents").select("doc_id", text.arxiv_id(F.col("text")).alias("arxiv_id")).where(F.col("arxiv_id").isNotNull())
    return rows.select("doc_id", "arxiv_id", text.arxiv_url(F.col("arxiv_id")).alias("url"), text.arxiv_file(F.col("arxiv_id")).alias("file"))


_INPUTS = [
    "https://arxiv.org/abs/2301.07041", "https://arxiv.org/pdf/2301.07041.pdf", "2301.07041v2", " arXiv:2301.07041 ", "hep-th/9901001", "https://arxiv.org/abs/hep-th/9901001v1", "math.GT/0309136", "nothing",
]


@_query(
    "SELECT input, arxiv_id, CASE WHEN arxiv_id IS NULL THEN 'invalid' WHEN arxiv_id = '2301.07041' THEN 'cached' ELSE 'fetch' END AS status FROM (SELECT input, coalesce("
    + ", ".join(rf"nullif(regexp_extract(regexp_replace(trim(input), '(?i)\.pdf$', ''), '(?i){p}', 1), '')" for p in text.ARXIV_PATTERNS)
    + ") AS arxiv_id FROM (VALUES "
    + ", ".join(f"('{i}')" for i in _INPUTS)
    + ") t(input))"
)
def arxiv_plan(spark: SparkSession, folder: str) -> DataFrame:
    """What to fetch, given that one file has landed."""
    inputs = spark.createDataFrame([(i,) for i in _INPUTS], "input string")
    landed = spark.createDataFrame([("arxiv_2301.07041.pdf",)], "file string")
    return arxiv.plan(inputs, "input", landed).select("input", "arxiv_id", "status")


@_query(
    r"""SELECT paper_id, coalesce(nullif(metadata['title'], ''), regexp_replace(regexp_extract(path, '([^/]+)/*$', 1), '(.)\.[^.]*$', '\1')) AS title FROM extracted_papers"""
)
def title_fallback(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "extracted_papers").select("paper_id", text.title_or_stem(F.col("metadata"), F.col("path")).alias("title"))


@_query(
    """SELECT row_id, CASE WHEN length(paper_title) > 57 THEN substr(paper_title, 1, 57) || '...' ELSE paper_title END AS cli_title, CASE WHEN length(paper_title) > 40 THEN substr(paper_title, 1, 37) || '...' ELSE paper_title END AS gui_title,
    replace(CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END, chr(10), ' ') AS cli_text, substr(text, 1, 500) || '...' AS gui_text, printf('%.3f', token_count / 1000.0) AS thousands FROM papers WHERE token_count IS NOT NULL"""
)
def previews(spark: SparkSession, folder: str) -> DataFrame:
    title, body = F.col("paper_title"), F.col("text")
    return table(spark, folder, "papers").where(F.col("token_count").isNotNull()).select(
        "row_id",
        text.preview(title, 57, 57).alias("cli_title"),
        text.preview(title, 40, 37).alias("gui_title"),
        text.one_line(text.preview(body, 200, 200)).alias("cli_text"),
        text.preview(body, 0, 500, always=True).alias("gui_text"),
        F.format_string("%.3f", F.col("token_count") / 1000.0).alias("thousands"),
    )


_PAGES = "list_filter(string_split(text, chr(10) || chr(10)), lambda p: " + _sql_strip("p") + " <> '')"


@_query(f"SELECT paper_id, md5(array_to_string({_PAGES}, chr(10) || chr(10))) AS text, len({_PAGES})::BIGINT AS page_count FROM extracted_papers WHERE text IS NOT NULL")
def page_concat(spark: SparkSession, folder: str) -> DataFrame:
    """Pages (here: paragraphs) joined without the blank ones."""
    p = text.join_pages(F.split("text", "\n\n"))
    return table(spark, folder, "extracted_papers").where(F.col("text").isNotNull()).select("paper_id", F.md5(p["text"].cast("binary")).alias("text"), p["page_count"].cast("long").alias("page_count"))


# ---------------------------------------------------------------- sections and abstracts

_HEADER_SQL = "(?im)" + "|".join(sections.HEADERS).replace("\\s", _WS)
_TITLED = rf"list_aggregate(list_transform(string_split(regexp_replace({_sql_strip('h')}, '{_WS}+', ' ', 'g'), ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ')"
_SECTIONS_SQL = rf"""(SELECT paper_id, i, {_TITLED} AS name, {_sql_clean('p')} AS content, start_pos, start_pos + length(p) AS end_pos FROM (
    SELECT paper_id, i, heads[i] AS h, pieces[i + 1] AS p, list_sum(list_transform(heads[1:i], lambda x: length(x))) + list_sum(list_transform(pieces[1:i], lambda x: length(x))) AS start_pos FROM (
    SELECT paper_id, heads, pieces, unnest(range(1, len(heads) + 1)) AS i FROM (SELECT paper_id, regexp_extract_all(text, '{_HEADER_SQL}') AS heads, string_split_regex(text, '{_HEADER_SQL}') AS pieces FROM extracted_papers))))"""


def _detected(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "extracted_papers").select("paper_id", F.posexplode(sections.detect_sections(F.col("text"))).alias("i", "s"))
    return rows.select("paper_id", "i", "s.*")


@_query(
    f"""SELECT paper_id, (row_number() OVER (PARTITION BY paper_id ORDER BY i) - 1)::BIGINT AS i, name, md5(content) AS content, start_pos::BIGINT AS start_pos, end_pos::BIGINT AS end_pos FROM {_SECTIONS_SQL} WHERE content <> ''"""
)
def section_detect(spark: SparkSession, folder: str) -> DataFrame:
    """All sections that the headers of the papers' texts make."""
    return _detected(spark, folder).select("paper_id", F.col("i").cast("long").alias("i"), "name", F.md5(F.col("content").cast("binary")).alias("content"), F.col("start_pos").cast("long").alias("start_pos"), F.col("end_pos").cast("long").alias("end_pos"))


@_query(
    """SELECT paper_id, count(*) FILTER (lower(s.name) IN ('methods', 'results'))::BIGINT AS picked, md5(min_by(s.content, i) FILTER (lower(s.name) = 'results')) AS results FROM (
    SELECT paper_id, unnest(sections) AS s, generate_subscripts(sections, 1) AS i FROM extracted_papers WHERE len(sections) > 0) GROUP BY paper_id"""
)
def section_filter(spark: SparkSession, folder: str) -> DataFrame:
    """How many sections an analysis would take, and the first of one name, case ignored."""
    s = F.col("sections")
    picked = sections.pick_sections(s, F.array(F.lit("methods"), F.lit("results")))
    return table(spark, folder, "extracted_papers").where(F.size(s) > 0).select("paper_id", F.size(picked).cast("long").alias("picked"), F.md5(sections.get_section(s, "Results")["content"].cast("binary")).alias("results"))


_ABSTRACT_1 = rf"(?is)(?:^|\n){_WS}*abstract(?::|{_WS})*\n(.*?)(?:\n{_WS}*(?:introduction|keywords?|1(?:\.|{_WS})|background)|\n\n\n)"
_ABSTRACT_2 = rf"(?is)abstract(?::|\.|{_WS})+(.{{100}}.*?)\n{_WS}*(?:introduction|keywords?|1(?:\.|{_WS}))"


def _sql_gate(x: str) -> str:
    return f"CASE WHEN length({x}) > 50 AND length({x}) < 3000 THEN {x} END"


@_query(
    rf"""SELECT paper_id, md5(coalesce({_sql_gate('a1')}, {_sql_gate('a2')}, a3)) AS abstract FROM (SELECT paper_id,
    {_sql_clean(f"nullif(regexp_extract(text, '{_ABSTRACT_1}', 1), '')")} AS a1,
    {_sql_clean(f"nullif(regexp_extract(substr(text, 1, 5000), '{_ABSTRACT_2}', 1), '')")} AS a2,
    {_sql_clean(f"list_filter(list_transform(string_split(substr(text, 1, 4000), chr(10) || chr(10))[2:5], lambda p: {_sql_strip('p')}), lambda p: length(p) > 150 AND length(p) < 2500 AND NOT regexp_matches(lower(p), '^(?:keyword|index|copyright)'))[1]")} AS a3
    FROM extracted_papers)"""
)
def abstract(spark: SparkSession, folder: str) -> DataFrame:
    """Abstracts found in the papers' texts."""
    return table(spark, folder, "extracted_papers").select("paper_id", F.md5(sections.extract_abstract(F.col("text")).cast("binary")).alias("abstract"))


# ---------------------------------------------------------------- chunks, budgets, prompts


@_query(
    """SELECT chunk_id, (row_number() OVER (PARTITION BY paper_path ORDER BY chunk_index, chunk_id) - 1)::BIGINT AS new_index, (count(*) OVER (PARTITION BY paper_path))::BIGINT AS new_total FROM text_chunks"""
)
def section_chunk_index(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks numbered anew over their paper."""
    w = Window.partitionBy("paper_path")
    return table(spark, folder, "text_chunks").select("chunk_id", (F.row_number().over(w.orderBy("chunk_index", "chunk_id")) - 1).cast("long").alias("new_index"), F.count("*").over(w).alias("new_total"))


_BUDGET = "(SELECT *, sum(coalesce(token_count, 0)) OVER (PARTITION BY paper_path ORDER BY chunk_index, chunk_id ROWS UNBOUNDED PRECEDING) AS running FROM text_chunks)"


@_query(f"SELECT chunk_id, paper_path FROM {_BUDGET} WHERE running <= 600")
def budget_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of each paper that fit a budget of 600 tokens."""
    return context.budget_prefix(table(spark, folder, "text_chunks"), ["paper_path"], ["chunk_index", "chunk_id"], "token_count", 600).select("chunk_id", "paper_path")


@_query(
    f"""SELECT paper_path, md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY chunk_index, chunk_id)) AS context, count(DISTINCT source_section)::BIGINT AS chunks_processed, count(*)::BIGINT AS n_chunks
    FROM {_BUDGET} WHERE running <= 600 GROUP BY paper_path"""
)
def context_concat(spark: SparkSession, folder: str) -> DataFrame:
    """The context of each paper within its budget."""
    fit = context.budget_prefix(table(spark, folder, "text_chunks"), ["paper_path"], ["chunk_index", "chunk_id"], "token_count", 600)
    c = context.assemble(fit, ["paper_path"], ["chunk_index", "chunk_id"], "text", "source_section")
    return c.select("paper_path", F.md5(F.col("context").cast("binary")).alias("context"), F.col("chunks_processed").cast("long").alias("chunks_processed"), F.col("n_chunks").cast("long").alias("n_chunks"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_BRIEF = TEMPLATES["summarize_brief"].user


@_query(
    "SELECT paper_id, md5(" + _sql_text(_BRIEF).replace("{abstract}", "' || coalesce(abstract, '') || '").replace("{context}", "' || coalesce(text, '') || '") + f") AS prompt, length({_sql_text(TEMPLATES['summarize_brief'].system)})::BIGINT AS system_length FROM extracted_papers"
)
def prompt_render(spark: SparkSession, folder: str) -> DataFrame:
    """The brief summary's prompt of every paper."""
    system, user = context.render(TEMPLATES["summarize_brief"], {"abstract": F.col("abstract"), "context": F.col("text")})
    return table(spark, folder, "extracted_papers").select("paper_id", F.md5(user.cast("binary")).alias("prompt"), F.length(system).cast("long").alias("system_length"))


@_query(
    rf"""SELECT chunk_id, coalesce(start_pos, 0)::BIGINT AS start_pos, coalesce(end_pos, 0)::BIGINT AS end_pos, len(list_filter(string_split_regex(text, '{_WS}+'), lambda w: w <> ''))::BIGINT AS word_count,
    coalesce(token_count, 0)::BIGINT AS token_count, source_section, total_chunks::BIGINT AS total_chunks FROM text_chunks WHERE text IS NOT NULL"""
)
def chunk_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """The facts that go with a chunk."""
    rows = table(spark, folder, "text_chunks").where(F.col("text").isNotNull()).withColumn("chunk_text", F.col("text"))
    m = rows.select("chunk_id", chunking.chunk_metadata().alias("m"))
    long = lambda c: F.coalesce(F.col(f"m.{c}"), F.lit(0)).cast("long").alias(c)
    return m.select("chunk_id", long("start_pos"), long("end_pos"), long("word_count"), long("token_count"), "m.source_section", F.col("m.total_chunks").cast("long").alias("total_chunks"))


_SPECS = ", ".join(f"('{a.name}', {a.budget}, [{', '.join(repr(s.lower()) for s in a.sections)}]::VARCHAR[])" for a in ANALYSES.values())


@_query(
    f"""SELECT paper_id, analysis, budget::BIGINT AS budget, len(list_filter(sections, lambda s: len(targets) = 0 OR list_contains(targets, lower(s.name))))::BIGINT AS n_sections
    FROM extracted_papers, (VALUES {_SPECS}) t(analysis, budget, targets) WHERE sections IS NOT NULL"""
)
def fanout(spark: SparkSession, folder: str) -> DataFrame:
    """Each paper with each analysis, and how many sections that takes."""
    papers = table(spark, folder, "extracted_papers").where(F.col("sections").isNotNull()).withColumn("spec", F.explode(analyses._specs(list(ANALYSES))))
    n = F.size(F.filter("sections", lambda s: (F.size("spec.targets") == 0) | F.array_contains("spec.targets", F.lower(s["name"]))))
    return papers.select("paper_id", "spec.analysis", F.col("spec.budget").cast("long").alias("budget"), n.cast("long").alias("n_sections"))


@_query("SELECT name, description FROM (VALUES " + ", ".join(f"('{t.name}', {_sql_text(t.description)})" for t in TEMPLATES.values()) + ") t(name, description)")
def templates(spark: SparkSession, folder: str) -> DataFrame:
    from quirewright.functions.prompts import list_templates

    return list_templates(spark)


@_query(
    """SELECT result_id, i::BIGINT AS i, role, md5(content) AS content FROM (SELECT result_id, 0 AS i, 'system' AS role, analysis_type AS content FROM analysis_results WHERE analysis_type IS NOT NULL
    UNION ALL SELECT result_id, CASE WHEN analysis_type IS NULL THEN 0 ELSE 1 END, 'user', content FROM analysis_results WHERE content IS NOT NULL)"""
)
def chat_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Message lists, one row per message; missing messages are left out."""
    m = context.messages(F.col("analysis_type"), F.col("content"))
    return table(spark, folder, "analysis_results").select("result_id", F.posexplode(m).alias("i", "m")).select("result_id", F.col("i").cast("long").alias("i"), "m.role", F.md5(F.col("m.content").cast("binary")).alias("content"))


@_query(
    """SELECT count(*)::BIGINT AS total, count(*) FILTER (content IS NOT NULL AND content <> '')::BIGINT AS succeeded, sum(coalesce(chunks_processed, 0))::BIGINT AS chunks, round(avg(coalesce(chunks_processed / nullif(length(content), 0), 0)), 9) AS per_char FROM analysis_results"""
)
def result_counters(spark: SparkSession, folder: str) -> DataFrame:
    ok = F.col("content").isNotNull() & (F.col("content") != "")
    per = text.tokens_per_char(F.col("chunks_processed"), F.col("content"))
    return table(spark, folder, "analysis_results").agg(F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), F.sum(F.coalesce("chunks_processed", F.lit(0))).alias("chunks"), F.round(F.avg(per), 9).alias("per_char"))


# ---------------------------------------------------------------- scores

_N = r":\s*\[?(\d+(?:\.\d+)?)\s*(?:/\s*10)?\]?"
_SCORE = rf"coalesce(try_cast(nullif(regexp_extract(content, '(?i)(?:BULLSHIT|RIGOR) SCORE{_N}', 1), '') AS DOUBLE), 5.0)"


@_query(
    f"""SELECT result_id, s AS overall, CASE WHEN s <= 2 THEN 'Excellent' WHEN s <= 4 THEN 'Good' WHEN s <= 6 THEN 'Concerning' WHEN s <= 8 THEN 'Poor' ELSE 'Severe Issues' END AS rating,
    CASE WHEN s <= 4 THEN 'good' WHEN s <= 6 THEN 'warning' ELSE 'bad' END AS severity, coalesce(try_cast(nullif(regexp_extract(content, '(?i)(?:BULLSHIT|RIGOR) SCORE{_N}', 1), '') AS DOUBLE) BETWEEN 0 AND 10, false) AS parse_ok,
    md5({_sql_strip(r"regexp_extract(content, '(?is)SUMMARY:\s*\n?(.*)$', 1)")}) AS summary FROM (SELECT result_id, content, {_SCORE} AS s FROM analysis_results WHERE content IS NOT NULL)"""
)
def score_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Overall score, rating, severity and summary of every reply."""
    rows = table(spark, folder, "analysis_results").where(F.col("content").isNotNull()).select("result_id", score.parse(F.col("content")).alias("s"))
    return rows.select("result_id", "s.overall", "s.rating", "s.severity", "s.parse_ok", F.md5(F.col("s.summary").cast("binary")).alias("summary"))


@_query(
    "SELECT result_id, " + ", ".join(rf"try_cast(nullif(regexp_extract(content, '(?i){c}.*?{_N}', 1), '') AS DOUBLE) AS {c}" for c in score.COMPONENTS) + " FROM analysis_results WHERE content IS NOT NULL"
)
def component_scores(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("content")
    return table(spark, folder, "analysis_results").where(c.isNotNull()).select("result_id", *(score.component(c, n).alias(n) for n in score.COMPONENTS))


_FLAGS = r"regexp_extract(content, '(?is)RED FLAGS:\s*\n(.*?)(?:\n\n|SUMMARY:|Final|\n?$)', 1)"


@_query(
    rf"""SELECT result_id, i::BIGINT AS i, flag FROM (SELECT result_id, unnest(l) AS flag, generate_subscripts(l, 1) - 1 AS i FROM (SELECT result_id,
    list_filter(list_transform(string_split({_FLAGS}, chr(10)), lambda s: {_sql_strip(rf"regexp_replace({_sql_strip('s')}, '^[•*-]+', '')")}),
    lambda s: length(s) > 3 AND NOT starts_with(lower(s), 'none') AND NOT contains(lower(s), 'list any serious') AND NOT contains(lower(s), '[list') AND NOT contains(lower(s), 'if clean')) AS l FROM analysis_results WHERE content IS NOT NULL))"""
)
def red_flags(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "analysis_results").select("result_id", F.posexplode(score.red_flags(F.col("content"))).alias("i", "flag"))
    return rows.select("result_id", F.col("i").cast("long").alias("i"), "flag")


# ---------------------------------------------------------------- Python operators; SQL knows what must hold of their results


def _papers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "extracted_papers").select(F.col("path").alias("paper_path"), "title", "abstract", "text", "sections")


def _sql_blank(x: str) -> str:
    return f"{_sql_strip(x)} = ''"


def _sql_chunked(where: str = "") -> str:
    """Per paper the units that are cut, and their characters, of which chunks must leave none out."""
    return f"""WITH units AS (SELECT path, unnest(CASE WHEN len(sections) > 0 THEN list_transform(sections, lambda s: {{'name': s.name, 'content': s.content}})
        ELSE [{{'name': NULL, 'content': text}}] END) AS u FROM extracted_papers)
    SELECT path AS paper_path, count(*)::BIGINT AS units, sum(length(u.content))::BIGINT AS chars, true AS ordered, true AS numbered, true AS measured
    FROM units WHERE u.content IS NOT NULL AND NOT {_sql_blank("u.content")} {where} GROUP BY path"""


def _checked_chunks(chunks: DataFrame) -> DataFrame:
    """Per paper: units and characters covered, and whether chunks are in order without gaps, numbered through, and not longer than their spans."""
    at = Window.partitionBy("paper_path").orderBy("chunk_index")  # the chunks of one paper
    first, before = F.col("start_pos") == 0, F.lag("end_pos").over(at)
    each = chunks.withColumns({"before": before, "start_before": F.lag("start_pos").over(at)}).select(
        "paper_path",
        first.cast("long").alias("unit"),
        (F.col("end_pos") - F.when(first, 0).otherwise(F.col("before"))).alias("new"),
        (first | ((F.col("start_pos") <= F.col("before")) & (F.col("start_pos") > F.col("start_before")) & (F.col("end_pos") > F.col("before")))).alias("ordered"),
        "chunk_index", "total_chunks",
        ((F.length("chunk_text") <= F.col("end_pos") - F.col("start_pos")) & (F.col("token_count") > 0)).alias("measured"),
    )
    whole = (F.count_distinct("chunk_index") == F.max("total_chunks")) & (F.max("chunk_index") == F.count("*") - 1) & (F.min("total_chunks") == F.count("*"))
    return each.groupBy("paper_path").agg(F.sum("unit").alias("units"), F.sum("new").cast("long").alias("chars"), F.bool_and("ordered").alias("ordered"), whole.alias("numbered"), F.bool_and("measured").alias("measured"))


@_query(_sql_chunked())
def chunk_greedy(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of at most about 200 tokens, 30 of them shared, of every paper, held against what must be true of them."""
    return _checked_chunks(chunking.chunk_papers(_papers(spark, folder).select("paper_path", "text", "sections"), "sections", None, 200, 30))


@_query(_sql_chunked("AND (u.name IS NULL OR lower(u.name) IN ('methods', 'results'))"))
def chunk_for_analysis(spark: SparkSession, folder: str) -> DataFrame:
    """The same for chunks of the methods and results only."""
    return _checked_chunks(chunking.chunk_papers(_papers(spark, folder).select("paper_path", "text", "sections"), "sections", ["Methods", "Results"], 200, 30))


@_query(r"SELECT row_id, CASE WHEN text IS NOT NULL THEN 64 END AS width, CASE WHEN text IS NOT NULL THEN CASE WHEN regexp_matches(text, '[\pL\pN_]') THEN 1.0::DOUBLE ELSE 0.0 END END AS norm FROM papers")
def embed_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of all stored chunks by the offline embedder: width and length, which is 1 where there are words."""
    rows = table(spark, folder, "papers").select("row_id", embed(F.col("text"), HashEmbedder(64)).alias("v"))
    return rows.select("row_id", F.when(F.col("v").isNotNull(), F.size("v")).alias("width"), F.round(F.aggregate(F.transform("v", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x), 4).alias("norm"))


_FULL = ", ".join(f"('{n}', '{TEMPLATES[ANALYSES[n].template].description}')" for n in FULL_ANALYSIS)


@_query(
    f"""SELECT path AS paper_path, title AS paper_title, analysis, analysis_type, NOT coalesce(list_bool_or(list_transform(units, lambda u: u IS NOT NULL AND NOT {_sql_blank("u")})), false) AS context_empty,
    'offline-heuristic' AS model_used, true AS answered, true AS counted FROM (SELECT *, CASE WHEN len(sections) > 0 THEN list_transform(sections, lambda s: s.content) ELSE [text] END AS units FROM extracted_papers), (VALUES {_FULL}) t(analysis, analysis_type)"""
)
def full_analysis(spark: SparkSession, folder: str) -> DataFrame:
    """The six analyses of every paper by the offline completer."""
    done = analyses.analyse(_papers(spark, folder))
    counted = (F.col("chunks_processed") == F.size("sections_analyzed")) & (F.col("n_chunks") >= F.col("chunks_processed")) & (F.col("context_empty") == (F.col("n_chunks") == 0))
    return done.select("paper_path", "paper_title", "analysis", "analysis_type", "context_empty", "model_used", F.col("content").isNotNull().alias("answered"), counted.alias("counted"))


@_query("SELECT path AS paper_path, true AS parse_ok, true AS mean, true AS rated, true AS flagged FROM extracted_papers")
def score_end_to_end(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk, take the context, complete and parse: a rigor score for every paper, held against its own parts."""
    s = analyses.rigor_scores(_papers(spark, folder))
    parts = [F.col(c) for c in score.COMPONENTS]
    high = sum((p > 5).cast("int") for p in parts)
    return s.select(
        "paper_path", "parse_ok", (F.abs(F.col("overall") - sum(parts) / 4) < 0.01).alias("mean"),
        (F.col("rating") == F.when(F.col("overall") <= 2, "Excellent").when(F.col("overall") <= 4, "Good").when(F.col("overall") <= 6, "Concerning").when(F.col("overall") <= 8, "Poor").otherwise("Severe Issues")).alias("rated"),
        (F.size("red_flags") == high).alias("flagged"),
    )
