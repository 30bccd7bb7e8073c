"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirewright.llm import leakage, mixing, near_duplicates, neighbours, personal, scan_repair, sentences, splitting, truncation
from quirewright.llm.tokens import with_tokens
from quirewright.plans.storage import table


def _ends(spark: SparkSession, folder: str) -> DataFrame:
    papers, replies = table(spark, folder, "extracted_papers"), table(spark, folder, "analysis_results")
    records = papers.select(F.lit("abstract").alias("kind"), F.col("paper_id").alias("id"), F.col("abstract").alias("text")).unionByName(
        replies.select(F.lit("analysis").alias("kind"), F.col("result_id").alias("id"), F.col("content").alias("text"))
    )
    copies = papers.select(F.explode("sections.content").alias("text")).unionByName(papers.select("text"))
    return truncation.ends(records, copies, papers.select(F.col("title").alias("line")).unionByName(replies.select(F.col("paper_title").alias("line"))))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _ends(spark, folder).where("truncated").select(F.col("kind").alias("record_type"), F.col("id").alias("record_id"))


def p1_sources(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source of papers and each model cuts its texts."""
    papers = table(spark, folder, "extracted_papers").select(F.lit("abstract").alias("kind"), F.col("paper_id").alias("id"), F.try_element_at("metadata", F.lit("source")).alias("origin"))
    replies = table(spark, folder, "analysis_results").select(F.lit("analysis").alias("kind"), F.col("result_id").alias("id"), F.nullif(F.lower(F.trim("model_used")), F.lit("")).alias("origin"))
    named = _ends(spark, folder).join(papers.unionByName(replies), ["kind", "id"])
    rates = named.groupBy(F.col("kind").alias("record_type"), "origin").agg(F.count("*").alias("records"), F.count_if("truncated").alias("cut"))
    return rates.withColumn("share", F.round(F.col("cut") / F.col("records"), 6))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.neighbour_pairs(table(spark, folder, "papers"), "row_id", "vector", k=5, min_cosine=0.8)


def p2_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar rows of every row whose row_id is divisible by 50, with their rank and cosine."""
    near = neighbours.nearest_rows(table(spark, folder, "papers"), "row_id", "vector", k=5, min_cosine=0.8).where(F.col("id") % 50 == 0)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))
    return near.select("id", "neighbour", rank.alias("rank"), F.round("cosine", 6).alias("cosine"))


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of all oversized chunks and sections."""
    chunks = table(spark, folder, "text_chunks").select(F.lit("chunk").alias("item_type"), F.col("chunk_id").alias("item_id"), F.lit(-1).alias("section_idx"), F.col("source_section").alias("name"), "text")
    papers = table(spark, folder, "extracted_papers").select("paper_id", F.posexplode("sections").alias("i", "s"))
    sections = papers.select(F.lit("section").alias("item_type"), F.col("paper_id").alias("item_id"), F.col("i").alias("section_idx"), F.col("s.name").alias("name"), F.col("s.content").alias("text"))
    return splitting.split_oversized(chunks.unionByName(sections), table(spark, folder, "size_limits"))


def p4_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Of every item that was cut, whether its pieces cover it, keep the limit and share the overlap."""
    return splitting.checked(p4_pieces(spark, folder))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_pieces(spark, folder).where((F.col("piece") == 0) & (F.col("pieces") > 1)).select("item_type", "item_id", "section_idx")


def _scanned() -> Column:
    return F.coalesce(F.startswith("path", F.lit("/library/scans/")), F.lit(False))


def _units(spark: SparkSession, folder: str, scanned: bool | None = False) -> DataFrame:
    """Sections of the papers that are or aren't scanned (None: of all), or their whole text where they have none."""
    papers = table(spark, folder, "extracted_papers")
    papers = papers if scanned is None else papers.where(_scanned() == scanned)
    whole = F.array(F.struct(F.lit(-1).alias("i"), F.col("text").alias("text")))
    split = F.transform("sections", lambda s, i: F.struct(i.alias("i"), s["content"].alias("text")))
    units = papers.select("paper_id", "title", F.explode(F.when(F.size("sections") > 0, split).otherwise(whole)).alias("u"))
    return units.select("paper_id", "title", F.col("u.i").alias("section_idx"), F.col("u.text").alias("text"))


def _repaired(spark: SparkSession, folder: str) -> DataFrame:
    papers = table(spark, folder, "extracted_papers").select("paper_id", "title", "text", _scanned().alias("scanned"))
    return scan_repair.repair(_units(spark, folder, scanned=True), papers)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    lines = _repaired(spark, folder).select("paper_id", "section_idx", F.explode("found").alias("f"))
    return lines.select("paper_id", "section_idx", F.col("f.line").alias("line_no"), F.col("f.kind").alias("kind"))


def p3_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """The scanned papers' units as continuous paragraphs."""
    return _repaired(spark, folder).select("paper_id", "section_idx", "text")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentences(_units(spark, folder)).select("paper_id", "section_idx", "end_pos")


def p5_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences of every paper, scanned ones included."""
    return sentences.sentences(_units(spark, folder, scanned=None), with_text=True)


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    papers = table(spark, folder, "extracted_papers").select(F.lit("paper").alias("kind"), F.col("paper_id").alias("id"), "text")
    chunks = table(spark, folder, "papers").select(F.lit("chunk").alias("kind"), F.col("row_id").alias("id"), "text")
    return papers.unionByName(chunks)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates.near_duplicates(_texts(spark, folder), near_duplicates.JoinParams(threshold=0.6, words=3))
    return near_duplicates.expand(found).select(F.col("kind").alias("record_type"), "id_a", "id_b")


def p6_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per text with its class and the number of other classes that it is similar to, at the default five words and 0.8."""
    found = near_duplicates.near_duplicates(_texts(spark, folder))
    ends = found.pairs.select("kind", F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("kind", "rep").agg(F.count("*").alias("links"))
    return found.members.join(ends, ["kind", "rep"], "left").select(F.col("kind").alias("record_type"), "id", F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, folder, "eval_items").select(F.col("item_id").alias("id"), "text")
    return leakage.leaks(docs, items)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).where(F.col("exact_words") > 0).select("doc_id", "item_id").distinct()


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Exact and re-parameterised leaks, with the share of the item that leaked."""
    return _leaks(spark, folder).withColumn("share", F.round(F.greatest("exact_words", "template_words") / F.col("item_words"), 6))


def _mix(spark: SparkSession, folder: str, params: mixing.MixParams) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source", "lang", F.col("doc_kind").alias("domain"))
    return mixing.mix(docs, table(spark, folder, "mix_targets"), params)


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of each mix, which is as large as its sources; what some lack goes to their siblings first."""
    return _mix(spark, folder, mixing.MixParams())


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(p8_mix(spark, folder))


def p8_shares_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The shares reached by mixes just as large as lets every source reach its target."""
    return mixing.shares(_mix(spark, folder, mixing.MixParams(budget=None)))


def p8_reached(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each source of these mixes has its target share of all tokens, but for what half a document of each source makes."""
    chosen = _mix(spark, folder, mixing.MixParams(budget=None))
    longest = with_tokens(table(spark, folder, "documents").select("source", "text"), ["source"]).groupBy("source").agg((F.max("tokens") / 2).alias("half"))
    by = chosen.groupBy("mix_name", "source", "target_share").agg(F.sum("tokens").alias("tokens")).join(longest, "source")
    of_mix = Window.partitionBy("mix_name")  # one row per source
    share = F.col("target_share") / F.sum("target_share").over(of_mix)
    missed = F.abs(F.col("tokens") - share * F.sum("tokens").over(of_mix))
    return by.select("mix_name", "source", (missed <= F.col("half") + share * F.sum("half").over(of_mix) + 1).alias("reached"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal.personal_spans(table(spark, folder, "documents"))


def p9_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The documents with placeholders."""
    return personal.redact(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (p1_found, p1_sources, p2_found, p2_nearest, p3_found, p3_repaired, p4_found, p4_pieces, p4_checked, p5_found, p5_sentences, p6_found, p6_classes, p7_found, p7_leaks, p8_mix, p8_shares, p8_shares_exact, p8_reached, p9_found, p9_redacted)}


_WHITE = r"[ \t\n\r\x{00a0}\x{3000}]"

P2_NEAREST = """WITH v AS (SELECT row_id, vector::DOUBLE[] AS v FROM papers WHERE vector IS NOT NULL AND len(vector) = 768 AND list_aggregate(list_transform(vector, lambda x: abs(x)), 'max') > 0),
near AS (SELECT a.row_id AS id, b.row_id AS neighbour, round(list_cosine_similarity(a.v, b.v), 9) AS c FROM v a JOIN v b ON a.row_id <> b.row_id WHERE a.row_id % 50 = 0),
ranked AS (SELECT id, neighbour, row_number() OVER (PARTITION BY id ORDER BY c DESC, neighbour)::INT AS rank, round(c, 6) AS cosine FROM near WHERE c >= 0.8)
SELECT * FROM ranked WHERE rank <= 5"""

P4_FOUND = rf"""WITH items AS (
    SELECT 'chunk' AS item_type, chunk_id AS item_id, -1 AS section_idx, source_section AS name, text FROM text_chunks
    UNION ALL SELECT 'section', paper_id, i, s.name, s.content FROM (SELECT paper_id, unnest(sections) AS s, generate_subscripts(sections, 1) - 1 AS i FROM extracted_papers)),
counted AS (SELECT item_type, item_id, section_idx, lower(regexp_replace(coalesce(name, ''), '^{_WHITE}+|{_WHITE}+$', '', 'g')) AS rule,
    length(regexp_replace(regexp_replace(text, '[A-Za-z0-9]+', 'a', 'g'), '{_WHITE}+', '', 'g')) AS n FROM items),
rules AS (SELECT item_kind, lower(section_name) AS rule, min(max_tokens) AS most FROM size_limits GROUP BY ALL)
SELECT item_type, item_id::BIGINT AS item_id, section_idx::INT AS section_idx FROM counted
LEFT JOIN rules o ON o.item_kind = item_type AND o.rule = counted.rule LEFT JOIN rules r ON r.item_kind = item_type AND r.rule = '*'
WHERE n > coalesce(o.most, r.most)"""

P4_CHECKED = f"SELECT *, true AS covers, true AS within, true AS shares FROM ({P4_FOUND})"

P6_FOUND = rf"""WITH texts AS (SELECT 'paper' AS kind, paper_id AS id, text FROM extracted_papers UNION ALL SELECT 'chunk', row_id, text FROM papers),
words AS (SELECT kind, id, list_filter(string_split_regex(lower(text), '{_WHITE}+'), lambda w: w <> '') AS w FROM texts WHERE text IS NOT NULL),
shingles AS (SELECT DISTINCT kind, id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM words WHERE len(w) >= 3),
sizes AS (SELECT kind, id, count(*) AS n FROM shingles GROUP BY ALL),
shared AS (SELECT a.kind, a.id AS id_a, b.id AS id_b, count(*) AS n FROM shingles a JOIN shingles b ON a.kind = b.kind AND a.s = b.s AND a.id < b.id GROUP BY ALL)
SELECT shared.kind AS record_type, id_a::BIGINT AS id_a, id_b::BIGINT AS id_b FROM shared
JOIN sizes x ON x.kind = shared.kind AND x.id = id_a JOIN sizes y ON y.kind = shared.kind AND y.id = id_b WHERE shared.n / (x.n + y.n - shared.n) >= 0.6"""

P6_CLASSES = rf"""WITH texts AS (SELECT 'paper' AS kind, paper_id AS id, text FROM extracted_papers UNION ALL SELECT 'chunk', row_id, text FROM papers),
words AS (SELECT kind, id, list_filter(string_split_regex(lower(text), '{_WHITE}+'), lambda w: w <> '') AS w FROM texts WHERE text IS NOT NULL),
sets AS (SELECT kind, id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM words WHERE len(w) >= 5),
members AS (SELECT kind, id, s, min(id) OVER (PARTITION BY kind, md5(array_to_string(s, chr(10)))) AS class_id FROM sets),
shingles AS (SELECT kind, id, len(s) AS n, unnest(s) AS s FROM members WHERE id = class_id),
pairs AS (SELECT a.kind, a.id, b.id AS other, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS j FROM shingles a JOIN shingles b ON a.kind = b.kind AND a.s = b.s AND a.id <> b.id GROUP BY ALL),
links AS (SELECT kind, id AS class_id, count(*) AS links FROM pairs WHERE j >= 0.8 GROUP BY ALL)
SELECT m.kind AS record_type, m.id::BIGINT AS id, m.class_id::BIGINT AS class_id, coalesce(links, 0)::BIGINT AS links FROM members m LEFT JOIN links USING (kind, class_id)"""

P7_FOUND = """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\pL\\p{Nd}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\pL\\p{Nd}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) AS s FROM d WHERE len(w) >= 13),
iw AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) AS s FROM i WHERE len(w) >= 13)
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (s)"""


P8_REACHED = """SELECT DISTINCT mix_name, source, true AS reached FROM mix_targets t
WHERE target_share > 0 AND coalesce(max_repeats, 1) >= 1 AND EXISTS (SELECT 1 FROM documents d WHERE d.source = t.source AND d.text <> '')"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the query; the others are tested against brute force, round trips or labelled noise."""
    return {"p2_nearest": P2_NEAREST, "p4_found": P4_FOUND, "p4_checked": P4_CHECKED, "p6_found": P6_FOUND, "p6_classes": P6_CLASSES, "p7_found": P7_FOUND, "p8_reached": P8_REACHED}
