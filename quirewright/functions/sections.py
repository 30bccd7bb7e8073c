"""Sections and abstracts of papers, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirewright.functions.text import clean_text, first_group, strip

#: Lines that are section headers.
HEADERS = [
    r"^abstract\s*$",
    r"^introduction\s*$",
    r"^background\s*$",
    r"^related\s+work\s*$",
    r"^literature\s+review\s*$",
    r"^methods?\s*$",
    r"^methodology\s*$",
    r"^materials?\s+and\s+methods?\s*$",
    r"^experimental?\s+(?:setup|design|methods?)?\s*$",
    r"^results?\s*$",
    r"^findings?\s*$",
    r"^results?\s+and\s+discussion\s*$",
    r"^discussion\s*$",
    r"^analysis\s*$",
    r"^conclusion\s*$",
    r"^conclusions?\s+and\s+future\s+work\s*$",
    r"^summary\s*$",
    r"^limitations?\s*$",
    r"^future\s+work\s*$",
    r"^acknowledg[e]?ments?\s*$",
    r"^references?\s*$",
    r"^bibliography\s*$",
    r"^appendix\s*",
    r"^supplementary\s+materials?\s*$",
]
# All begin at a line's start, which is so tested once per place.
HEADER = "(?imdU)^(?:" + "|".join(h.removeprefix("^") for h in HEADERS) + ")"

#: How an abstract is introduced and ended.
ABSTRACT_AFTER_HEADER = r"(?isdU)(?:^|\n)\s*abstract[:\s]*\n(.*?)(?=\n\s*(?:introduction|keywords?|1[\.\s]|background)|\n\n\n)"
ABSTRACT_INLINE = r"(?isdU)abstract[:\.\s]+(.{100,2000}?)(?=\n\s*(?:introduction|keywords?|1[\.\s]))"


def title_case(c: Column) -> Column:
    """Each word with a capital, words parted by single spaces."""
    return F.initcap(F.regexp_replace(strip(c), r"(?U)\s+", " "))


def detect_sections(text: Column, include_front_matter: bool = False) -> Column:
    """array<struct<name, content, start_pos, end_pos>> of a text's sections; empty where there is no header.

    A header's text and the pieces between headers line up one to one, so no row-wise code is needed.
    Contents are cleaned; sections without content, and text before the first header unless
    ``include_front_matter``, are left out. Offsets point into the text.
    """
    # Cut the text once: a lambda's variable is computed once, however often it is used.
    cut = F.struct(F.regexp_extract_all(text, F.lit(HEADER), 0).alias("heads"), F.split(text, HEADER, -1).alias("pieces"))
    made = F.get(F.transform(F.array(cut), lambda c: _aligned(c["heads"], c["pieces"], include_front_matter)), F.lit(0))
    return F.filter(made, lambda s: s["content"] != "")


def _aligned(heads: Column, pieces: Column, include_front_matter: bool) -> Column:
    """The sections of headers and the pieces around them."""
    after = F.slice(pieces, F.lit(2), F.size(heads))
    sizes = F.zip_with(heads, after, lambda h, p: F.struct(F.length(h).alias("h"), F.length(p).alias("p")))
    first = F.length(F.get(pieces, F.lit(0)))
    start = F.struct(first.alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["h"]
        end = begin + x["p"]
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), end.alias("end")))).alias("spans"))

    spans = F.aggregate(sizes, start, step, lambda acc: acc["spans"])
    named = F.zip_with(heads, after, lambda h, p: F.struct(title_case(h).alias("name"), clean_text(p).alias("content")))
    made = F.zip_with(named, spans, lambda a, s: F.struct(a["name"].alias("name"), a["content"].alias("content"), s["start"].alias("start_pos"), s["end"].alias("end_pos")))
    if include_front_matter:
        front = F.struct(F.lit("Front Matter").alias("name"), clean_text(F.get(pieces, F.lit(0))).alias("content"), F.lit(0).alias("start_pos"), first.alias("end_pos"))
        made = F.when(F.size(heads) > 0, F.concat(F.array(front), made)).otherwise(made)
    return made


def get_section(sections: Column, name: str) -> Column:
    """The first section of that name, case ignored; null if there is none."""
    return F.get(F.filter(sections, lambda s: F.lower(s["name"]) == name.lower()), F.lit(0))


def pick_sections(sections: Column, targets: Column) -> Column:
    """The sections whose names are among the lower-case targets, case ignored."""
    return F.filter(sections, lambda s: F.array_contains(targets, F.lower(s["name"])))


def _gated(c: Column, low: int, high: int) -> Column:
    return F.when((F.length(c) > low) & (F.length(c) < high), c)


def extract_abstract(text: Column) -> Column:
    """After a header, else inline, else an early long paragraph; null if none passes its length gate."""
    after = _gated(clean_text(first_group(text, ABSTRACT_AFTER_HEADER)), 50, 3000)
    inline = _gated(clean_text(first_group(F.substring(text, 1, 5000), ABSTRACT_INLINE)), 50, 3000)
    early = F.slice(F.split(F.substring(text, 1, 4000), "\n\n"), 2, 4)
    plain = F.filter(F.transform(early, strip), lambda p: (F.length(p) > 150) & (F.length(p) < 2500) & ~F.lower(p).rlike("^(?:keyword|index|copyright)"))
    return F.coalesce(after, inline, clean_text(F.get(plain, F.lit(0))))


def has_abstract(abstract: Column) -> Column:
    return F.coalesce(F.length(abstract) > 50, F.lit(False))
