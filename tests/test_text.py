"""Text functions against values that were worked out by reading the rules."""

import pytest
from pyspark.sql import functions as F

from quirewright.functions import score, sections, text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).head()["y"]


@pytest.mark.parametrize(
    "dirty,clean",
    [
        ("exam-\nple", "example"),
        ("a \t b", "a b"),
        ("a\n\n\n\nb", "a\n\nb"),
        ("a\x00\x07b", "ab"),
        ("ﬁne ﬂow eﬀort oﬃce waﬄe", "fine flow effort office waffle"),
        ("  x 　", "x"),
        ("a\rb", "a\rb"),
        ("", ""),
        (None, None),
    ],
)
def test_clean_text(spark, dirty, clean):
    assert one(spark, text.clean_text, dirty) == clean


def test_counts(spark):
    assert one(spark, text.word_count, " a b\n c ") == 3
    assert one(spark, text.word_count, "") == 0
    assert one(spark, text.token_count, "don't stop, 3.5!") == 9


def test_sentences(spark):
    assert one(spark, text.sentences, "Dr. Roe came. He left! Did it? Yes") == ["Dr. Roe came.", "He left!", "Did it?", "Yes"]
    # The plain form protects any word that ends like an abbreviation.
    assert one(spark, text.sentences, "It was final. Then came more.") == ["It was final. Then came more."]
    assert one(spark, lambda c: text.sentences(c, word_boundary=True), "It was final. Then came more.") == ["It was final.", "Then came more."]


def test_paragraphs(spark):
    assert one(spark, text.paragraphs, "a\n  \nb\n\n\n c ") == ["a", "b", "c"]


@pytest.mark.parametrize(
    "given,found",
    [
        ("https://arxiv.org/abs/2301.07041", "2301.07041"),
        ("https://arxiv.org/pdf/2301.07041v3.PDF", "2301.07041v3"),
        (" arXiv:2301.07041 ", "2301.07041"),
        ("hep-th/9901001", "hep-th/9901001"),
        ("arxiv.org/pdf/hep-th/9901001v2", "hep-th/9901001v2"),
        ("math.GT/0309136", None),
        ("x2301.07041", None),
        ("", None),
        (None, None),
    ],
)
def test_arxiv(spark, given, found):
    assert one(spark, text.arxiv_id, given) == found


def test_paths(spark):
    assert one(spark, text.file_stem, "/a/b.c/report.v2.pdf") == "report.v2"
    assert one(spark, text.file_stem, "/a/.hidden") == ".hidden"
    assert one(spark, text.arxiv_file, "hep-th/9901001") == "arxiv_hep-th_9901001.pdf"


def test_previews(spark):
    assert one(spark, lambda c: text.preview(c, 5, 5), "abcdef") == "abcde..."
    assert one(spark, lambda c: text.preview(c, 5, 5), "abcde") == "abcde"
    assert one(spark, lambda c: text.preview(c, 0, 5, always=True), "ab") == "ab..."


def test_pages(spark):
    row = spark.createDataFrame([(["a", " \n", None, "b"],)], "x array<string>").select(text.join_pages(F.col("x")).alias("y")).head()["y"]
    assert (row["text"], row["page_count"]) == ("a\n\nb", 2)


PAPER = "A title\n\nAbstract\n" + "We measured many things in many ways. " * 3 + "\n\nINTRODUCTION\nWe begin.\n\nRelated\nWork\nOthers did.\nAppendix A extra\nMore."


def test_sections(spark):
    found = one(spark, sections.detect_sections, PAPER)
    assert [s["name"] for s in found] == ["Abstract", "Introduction", "Related Work", "Appendix"]
    for s in found:
        assert PAPER[s["start_pos"] : s["end_pos"]].strip() == s["content"]
    assert one(spark, sections.detect_sections, "no header") == []
    assert one(spark, sections.detect_sections, "Methods\n\nResults\n") == []
    front = one(spark, lambda c: sections.detect_sections(c, include_front_matter=True), PAPER)
    assert front[0]["content"] == "A title"


def test_headers_that_are_none(spark):
    assert one(spark, sections.detect_sections, "Conclusions\nx\n1. Introduction\ny\nExperimental\nText") == []


def test_abstract(spark):
    assert one(spark, sections.extract_abstract, PAPER).startswith("We measured")
    inline = "Title Abstract: " + "word " * 40 + "\nKeywords: a"
    assert one(spark, sections.extract_abstract, inline).startswith("word")
    plain = "Title\n\n" + "word " * 40 + "\n\nrest"
    assert one(spark, sections.extract_abstract, plain).startswith("word")
    assert one(spark, sections.extract_abstract, "Title\n\nshort") is None


REPLY = "BULLSHIT SCORE: [3.5/10]\n\nBREAKDOWN:\n- Methodology: [2/10] - ok\n- Statistics: 4\n- Claims: [7/10]\n\nRED FLAGS:\n• small sample\n- None here\n* no controls\n\nSUMMARY:\nMostly fine.\nYes."


def test_score(spark):
    s = one(spark, score.parse, REPLY)
    assert (s["overall"], s["methodology"], s["statistics"], s["claims"], s["transparency"]) == (3.5, 2.0, 4.0, 7.0, None)
    assert s["red_flags"] == ["small sample", "no controls"]
    assert (s["rating"], s["severity"], s["parse_ok"], s["summary"]) == ("Good", "good", True, "Mostly fine.\nYes.")
    empty = one(spark, score.parse, "nothing")
    assert (empty["overall"], empty["parse_ok"], empty["red_flags"], empty["summary"]) == (5.0, False, [], "")
    assert not one(spark, score.parse, "RIGOR SCORE: 12")["parse_ok"]


def test_robust_flags(spark):
    reply = "**RED FLAGS:**\n1. - first flag\n\n2. finally a second\n\nSUMMARY:\nx"
    assert one(spark, score.red_flags, reply) == []
    assert len(one(spark, lambda c: score.red_flags(c, robust=True), reply)) == 2
