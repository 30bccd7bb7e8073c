"""Text functions as native column expressions.

Patterns carry Java's (?d) and (?U) where line ends and white space must be read as Unicode does.
Every function gives null for a null text unless its docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ligatures and their letters.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}

#: Abbreviations that do not end a sentence.
ABBREVIATIONS = [
    "Dr.", "Mr.", "Mrs.", "Ms.", "Prof.", "Sr.", "Jr.",
    "vs.", "etc.", "i.e.", "e.g.", "cf.", "al.", "Fig.",
    "Eq.", "Ref.", "Vol.", "No.", "pp.", "et al.", "Ph.D.",
    "Inc.", "Ltd.", "Corp.", "Co.", "St.", "Mt.", "Ft.",
]
_DOT = "\ue000"  # of the private use area; sentences() sets aside the ones that a text has

#: The forms of an arXiv id, tried in this order.
ARXIV_PATTERNS = [
    r"arxiv\.org/abs/(\d{4}\.\d{4,5}(?:v\d+)?)",
    r"arxiv\.org/pdf/(\d{4}\.\d{4,5}(?:v\d+)?)",
    r"^(\d{4}\.\d{4,5}(?:v\d+)?)$",
    r"arxiv:(\d{4}\.\d{4,5}(?:v\d+)?)",
    r"arxiv\.org/abs/([a-z-]+/\d{7}(?:v\d+)?)",
    r"arxiv\.org/pdf/([a-z-]+/\d{7}(?:v\d+)?)",
    r"^([a-z-]+/\d{7}(?:v\d+)?)$",
]


def strip(c: Column) -> Column:
    """Without white space at both ends, in the Unicode sense."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null where nothing matches (an empty match is null too)."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def clean_text(c: Column) -> Column:
    """Joined line-end hyphens, single blanks, at most one blank line, no control characters or ligatures, stripped."""
    c = F.replace(c, F.lit("-\n"), F.lit(""))
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    for ligature, letters in LIGATURES.items():
        c = F.replace(c, F.lit(ligature), F.lit(letters))
    return strip(c)


def word_count(c: Column) -> Column:
    """Pieces between white space."""
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")).cast("long")


def token_count(c: Column) -> Column:
    """An approximate token count: runs of letters and digits, and single other visible characters."""
    return F.size(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), 0)).cast("long")


def paragraphs(c: Column) -> Column:
    """Parts between blank lines, stripped, empty ones left out."""
    return F.filter(F.transform(F.split(c, r"(?U)\n\s*\n"), strip), lambda p: p != "")


def _protected_dots(word_boundary: bool) -> str:
    """A pattern of the full stops inside and at the end of abbreviations: each is told by what stands before and after it."""
    start = r"(?<![\w])" if word_boundary else ""
    places: dict[str, list[str]] = {}
    for a in ABBREVIATIONS:
        for i, c in enumerate(a):
            if c == ".":
                places.setdefault(a[i + 1 :].replace(".", r"\."), []).append(start + a[:i].replace(".", r"\."))
    # The stop comes first, so that nothing is tried at other letters.
    return ("(?U)" if word_boundary else "") + r"\.(?:" + "|".join(rf"(?<=(?:{'|'.join(before)})\.)" + (f"(?={after})" if after else "") for after, before in places.items()) + ")"


def sentences(c: Column, word_boundary: bool = False) -> Column:
    """Parts that end with . ! or ? before white space and a capital, but not after an abbreviation.

    As abbreviations count anywhere, one also protects longer words that end like it;
    ``word_boundary`` protects whole words only.
    """
    c = F.regexp_replace(F.replace(c, F.lit(_DOT), F.lit("\ue001\ue002")), _protected_dots(word_boundary), _DOT)
    parts = F.split(c, r"(?U)(?<=[.!?])\s+(?=[A-Z])")
    return F.filter(F.transform(parts, lambda s: strip(F.replace(F.replace(s, F.lit(_DOT), F.lit(".")), F.lit("\ue001\ue002"), F.lit(_DOT)))), lambda s: s != "")


def arxiv_id(c: Column) -> Column:
    """The arXiv id, with its version, in a URL or text; null if there is none."""
    bare = F.regexp_replace(strip(c), r"(?i)\.pdf$", "")
    return F.coalesce(*(first_group(bare, "(?i)" + p) for p in ARXIV_PATTERNS))


def arxiv_url(c: Column) -> Column:
    return F.format_string("https://arxiv.org/pdf/%s.pdf", c)


def arxiv_file(c: Column) -> Column:
    """The file name of an arXiv id."""
    return F.concat(F.lit("arxiv_"), F.replace(c, F.lit("/"), F.lit("_")), F.lit(".pdf"))


def file_stem(path: Column) -> Column:
    """The last part of a path without its last suffix."""
    name = F.regexp_extract(path, r"([^/]+)/*$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def title_or_stem(metadata: Column, path: Column) -> Column:
    """The title of the metadata unless it is missing or empty, else the file's stem."""
    return F.coalesce(F.nullif(F.try_element_at(metadata, F.lit("title")), F.lit("")), file_stem(path))


def preview(c: Column, longest: int, keep: int, always: bool = False) -> Column:
    """The first ``keep`` characters and '...' for a text over ``longest`` characters, or always."""
    short = F.concat(F.substring(c, 1, keep), F.lit("..."))
    return short if always else F.when(F.length(c) > longest, short).otherwise(c)


def one_line(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit(" "))


def join_pages(pages: Column) -> Column:
    """struct(text, page_count) of the pages that aren't blank."""
    kept = F.filter(pages, lambda p: p.isNotNull() & (strip(p) != ""))
    return F.struct(F.array_join(kept, "\n\n").alias("text"), F.size(kept).alias("page_count"))


def tokens_per_char(completion_tokens: Column, content: Column) -> Column:
    """0 for an empty content."""
    return F.coalesce(completion_tokens / F.nullif(F.length(content), F.lit(0)), F.lit(0.0))
