"""Repair of text from scanned pages: broken words, misread characters, running headers and page numbers.

Plan. Document frequencies of words are counted over all papers. Words of scanned pages that the
other papers don't know meet all correction candidates within the edit distance, and all that look alike,
through an inverted join of keys that no such pair can miss, and boosted trees rank the candidates. Two more
boosted models look at pairs of lines: whether a line is furniture, and then whether a word broken at
its end continues on the next line that isn't, however much furniture stands between. All three are
trained on the driver on a bounded sample of paragraphs of clean papers that are wrapped, hyphenated,
misread and paginated artificially and go through the very same joins; ``RepairParams`` has the bounds.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirewright.llm.boosting import Boosted, calibrate
from quirewright.llm.joins import spread_join
from quirewright.plans.storage import materialise


@dataclass(frozen=True)
class RepairParams:
    """common: papers that must know a candidate.

    The training text: train_papers clean papers, of each train_chars characters or a little more in
    paragraphs drawn from its whole text, and of each of their unknown words the true candidate and
    train_candidates others.
    familiar: how many of the commonest words every task knows without a join; no result depends on it.
    """

    train_papers: int = 160
    train_chars: int = 6_000
    train_candidates: int = 24
    common: int = 3
    familiar: int = 20_000
    seed: int = 23


#: What scanners read for what; the right side is the true text.
CONFUSIONS = [("rn", "m"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("0", "o"), ("1", "l"), ("5", "s"), ("@", "a"), ("9", "g"), ("c", "e"), ("e", "c"), ("b", "h"), ("h", "b"), ("6", "é"), ("6", "ó"), ("6", "ö"), ("h", "li"), ("j", "i"), ("l", "i"), ("i", "l"), ("ﬁ1", "fi"), ("6", "b"), ("8", "B"), ("m", "rn"), ("f", "t"), ("!", "l"), ("|", "l"), ("n", "u"), ("u", "n"), ("O", "0"), ("l", "1")]
#: A look-alike class for each of these; words of one look share a skeleton.
_LOOK = [("ﬁ1", "fi"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("vv", "w"), ("rn", "m"), ("cl", "d"), ("ii", "u")]
_LOOK_CHARS = str.maketrans({"0": "o", "1": "l", "i": "l", "j": "l", "!": "l", "|": "l", "5": "s", "$": "s", "@": "a", "9": "g", "q": "g", "e": "c", "é": "c", "b": "h", "6": "h", "8": "h", "t": "f", "n": "u"})

_BREAK = re.compile(r"([^\W\d_][\w@!|ﬁﬂ]*)([-‐‑¬\xad])[ \t]*$")
_TOKEN = re.compile(r"[^\W_](?:[\w@!|$]*[\w@])?(?:['’][^\W\d_]+)?")
_EDGE = re.compile(r"^\W+|\W+$")
_MARKS = ".,;:!?()[]{}\"'“”„‘’«»‹›<>*_=+~^%&#-‐‑–—…¿¡¬\xad\xa0"
_DASHES = re.compile(r"[-‐‑–—]")
_ROMAN = re.compile(r"[ivxlcdm1]{1,9}", re.I)
_PAGE = re.compile(r"(?:page|p\.|seite|pág\.|[-–—\[(|]*)\s*[\dOolISs]{1,4}\s*(?:(?:/|of|von|de)\s*[\dOolISs]{1,4})?\s*[-–—\])|]*", re.I)
_GAP = re.compile(r"\S( {3,}|\t)\S")
_LETTERS = re.compile(r"[^\W\d_]+")


_VOLUME = re.compile(r"\(\d{4}\)$|[Vv]ol\.? ?\d+")
_EQUATION = re.compile(r"\(\d+(?:\.\d+)?\)")
_HEAD = re.compile(r"\s*([^\W_][\w@!|ﬁﬂ]*)")
_HALF = re.compile(r"\s*[^\W\d_]+(?=\W|$)")


def _broken(line: str) -> re.Match | None:
    """The broken word at a line's end."""
    s = line.rstrip(" \t")
    if not s or s[-1] not in "-‐‑¬\xad":
        return None
    return _BREAK.search(line, max(s.rfind(" "), s.rfind("\t")) + 1)


@lru_cache(65_536)
def skeleton(word: str) -> str:
    """The word with look-alikes made equal."""
    w = word.lower()
    for a, b in _LOOK:
        w = w.replace(a, b)
    return w.translate(_LOOK_CHARS)


def edit_distance(a: str, b: str, most: int = 3) -> int:
    """Levenshtein distance, ``most`` + 1 if it is larger; a column of the table is held in the bits of two numbers."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return max(len(a), len(b))
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    mask, top, score = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = mask, 0
    for c in b:
        eq = at.get(c, 0)
        vertical = eq | down
        horizontal = ((eq & up) + up ^ up) | eq
        rise, fall = down | ~(horizontal | up) & mask, up & horizontal
        score += 1 if rise & top else -1 if fall & top else 0
        rise = rise << 1 | 1
        up, down = (fall << 1 | ~(vertical | rise)) & mask, rise & vertical & mask
    return min(score, most + 1)


# ---------------------------------------------------------------- lines and their words


def _continuation(lines: list[str], i: int, furniture: np.ndarray | None = None) -> int:
    """The line that may continue line i: the next one that is neither blank nor furniture; -1 if none."""
    for j in range(i + 1, len(lines)):
        if lines[j].strip() and (furniture is None or not furniture[j]):
            return j
    return -1


def words_of(text: str, familiar: frozenset[str] = frozenset()) -> list[tuple[int, str, str]]:
    """(line, role, word) of a unit, without familiar and broken words; role h: a line's first word, which may be the half of a broken one; w: the others."""
    out = []
    for i, line in enumerate(text.split("\n")):
        broken = _broken(line)
        body = line[: broken.start(1)] if broken else line
        head = bool(_HALF.match(body))
        for n, chunk in enumerate(body.split()):
            if "/" in chunk or "@" in chunk and "." in chunk or chunk.startswith("www."):
                continue
            bare = chunk.strip(_MARKS)
            for k, part in enumerate(_DASHES.split(bare) if _DASHES.search(bare) else (bare,)):
                if part.lower() in familiar:
                    continue
                m = _TOKEN.fullmatch(part)
                if m and len(part) >= 3 and (part.isalpha() or sum(map(str.isalpha, part)) >= 2):
                    out.append((i, "h" if head and n == k == 0 else "w", part))
    return out


def breaks_of(lines: list[str], furniture: np.ndarray) -> list[tuple[int, str, str]]:
    """(line, role, word) of broken words outside furniture: L and R the halves, J and C the joined and the hyphenated form."""
    out = []
    for i, line in enumerate(lines):
        broken = None if furniture[i] else _broken(line)
        if broken:
            left = broken.group(1)
            out.append((i, "L", left))
            right = _HEAD.match(lines[j]) if (j := _continuation(lines, i, furniture)) >= 0 else None
            if right:
                out += [(i, "R", right.group(1)), (i, "J", left + right.group(1)), (i, "C", f"{left}-{right.group(1)}")]
    return out


# ---------------------------------------------------------------- training text


def _misread(word: str, r: random.Random) -> str:
    options = [(a, b, m.start()) for a, b in CONFUSIONS for m in re.finditer(re.escape(b), word)]
    if not options:
        return word
    a, b, at = r.choice(options)
    return word[:at] + a + word[at + len(b) :]


def _roman(n: int) -> str:
    out = ""
    for v, s in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out, n = out + s * (n // v), n % v
    return out


def _header(short: str, names: list[str], page: int, r: random.Random) -> str:
    """A running header or footer: one to three of the things such lines are made of, set side by side."""
    series, place, author, other, maker = names
    parts = [
        lambda: short, lambda: short.upper(), lambda: f"{series} of {place}", lambda: series.upper(), lambda: f"{author.split()[0]} {r.choice(['et al.', 'and others', '& ' + other.split()[0]])}",
        lambda: f"{r.choice(['Vol.', 'vol.', 'Volume', 'No.', 'Part', 'Issue', 'Bd.', 'Tome'])} {r.randint(1, 99)}", lambda: f"Vol. {r.randint(1, 99)}, No. {r.randint(1, 12)}", lambda: f"{r.randint(1, 99)} ({r.randint(1900, 2020)})", lambda: f"({r.randint(1900, 2020)})",
        lambda: f"© {r.randint(1900, 2020)} {maker}", lambda: f"© {maker}", lambda: f"{r.choice(['Printed', 'Scanned', 'Issued', 'Copied', 'Held'])} {r.choice(['by', 'at', 'in', 'for'])} {r.choice(['', 'the '])}{maker}", lambda: f"{maker} {r.choice(['copy', 'print', 'edition', 'shelf'])} {r.randint(1, 99)}", lambda: f"{r.randint(1, 28)} {r.choice(['March', 'June', 'October'])} {r.randint(1900, 2020)}",
        lambda: f"{author.upper()} {r.choice(['ET AL.', 'AND ' + other.split()[0].upper()])}",
    ]
    chosen = [p() for p in r.sample(parts, r.choice([1, 1, 2, 2, 3]))]
    if r.random() < 0.2:
        chosen.insert(r.choice([0, len(chosen)]), str(page))
    return r.choice(["    ", ", ", " ", "   "]).join(chosen)


def add_noise(text: str, title: str, page: int, r: random.Random) -> tuple[str, dict]:
    """A clean text as a scanner might give it, and what was done: hyphen lines, compound lines, furniture lines, and true words."""
    width, marks = r.randint(48, 72), r.choice([["-"], ["-"], ["‐"], ["¬"], ["\xad"], ["- "]])
    lines: list[str] = []
    hyphen, compound, furniture, truth, read = set(), set(), set(), {}, set()
    said = [w for w in re.findall(r"[^\W\d_]{4,}", text)] or ["Untitled"]
    short = " ".join((title or "Untitled work").split()[: r.randint(3, 5)])
    until, total = r.randint(8, 26), page + r.randint(5, 30)
    # What a paper's headers name stays the same from page to page.
    names = [" ".join(r.choice(said).capitalize() for _ in range(r.randint(1, 3))) for _ in range(5)]

    def turn() -> None:
        nonlocal page, until
        if r.random() < 0.5:
            lines.append("")
        number = r.choice([f"[{page}]", f"- {page} -", f"{page} / {total}", f"Page {page}", _roman(page), str(page), f"{page}    {short}", f"{short}    {page}"])
        header, other = _header(short, names, page, r), _header(short, names, page, r)
        for line in r.choice([[number], [number, header], [header], [header, number], [number, header], [number, other, header]]):
            furniture.add(len(lines))
            lines.append(_misread(line, r) if r.random() < 0.15 else line)
        if r.random() < 0.5:
            lines.append("")
        page, until = page + 1, len(lines) + r.randint(8, 26)

    for paragraph in text.split("\n\n"):
        words = paragraph.split()
        for k in range(len(words) - 1):
            if r.random() < 0.015 and words[k].isalpha() and words[k + 1].isalpha():
                words[k], words[k + 1] = f"{words[k]}-{words[k + 1]}", ""
        line, flagged, k = "", False, 0
        words = [w for w in words if w]
        while k < len(words):
            w = words[k]
            bad = False
            if r.random() < 0.02 and len(w) > 3 and _EDGE.sub("", w).isalpha():
                noisy = _misread(w, r)
                core, true = _EDGE.sub("", noisy), _EDGE.sub("", w)
                if core != true:
                    truth[core], w, bad = true, noisy, True
            if len(line) + 1 + len(w) <= width or not line:
                line, flagged, k = f"{line} {w}".strip(), flagged or bad, k + 1
                continue
            room = width - len(line) - 2
            m = re.fullmatch(r"([^\W\d_]+)-([^\W\d_]+\W*)", w)
            if m and len(m.group(1)) <= room + 4:
                line, words[k] = f"{line} {m.group(1)}{marks[0]}", m.group(2)
                compound.add(len(lines))
            elif not bad and room >= 3 and len(w) >= 6 and _EDGE.sub("", w).isalpha() and w[0].isalpha() and r.random() < 0.4:
                cut = max(2, min(room, len(_EDGE.sub("", w)) - 2, r.randint(2, 9)))
                line, words[k] = f"{line} {w[:cut]}{marks[0]}", w[cut:]
                hyphen.add(len(lines))
            if flagged:
                read.add(len(lines))
            lines.append(line)
            line, flagged = "", False
            if len(lines) >= until:
                turn()
        if line:
            if flagged:
                read.add(len(lines))
            lines.append(line)
        if r.random() < 0.12:
            lines += r.choice([["", f"({r.randint(1, 9)}.{r.randint(1, 9)})"], [f"y = a{r.randint(1, 9)} x + b   ({r.randint(1, 20)})"], ["", f"Table {r.randint(1, 9)}"], ["  ".join(str(r.randint(10, 99)) for _ in range(5)) for _ in range(2)]])
        lines.append("")
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines), {"hyphen": hyphen, "compound": compound, "furniture": furniture, "truth": truth, "misread": read}


# ---------------------------------------------------------------- candidates and their ranking


def _draw_paragraphs(params: RepairParams):
    """Paragraphs from anywhere in a paper, in their order, until train_chars are reached."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for i, text in zip(b.column("paper_id").to_pylist(), b.column("text").to_pylist()):
                paragraphs = [q[at : at + params.train_chars] for q in text.split("\n\n") for at in range(0, max(1, len(q)), params.train_chars)]
                order = list(range(len(paragraphs)))
                random.Random(i).shuffle(order)
                kept, n = [], 0
                for j in order:
                    kept.append(j)
                    n += len(paragraphs[j])
                    if n >= params.train_chars:
                        break
                texts.append("\n\n".join(paragraphs[j] for j in sorted(kept)))
            yield pa.RecordBatch.from_arrays([b.column("paper_id"), b.column("title"), pa.array(texts, pa.string())], names=["paper_id", "title", "text"])

    return run


def _frequencies(papers: DataFrame) -> DataFrame:
    """(word, df): in how many papers that weren't scanned each word stands; hyphenated words count whole and in parts."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}[\p{L}\p{M}]*(?:-\p{L}[\p{L}\p{M}]*)?"), 0))
    return materialise(papers.where(~F.col("scanned") & F.col("text").isNotNull()).select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("df")), "word-frequencies")


def _fewer(word: str, k: int) -> set[str]:
    """The word with at most k of its letters left out: two words within edit distance k have one of these in common."""
    out = last = {word}
    for _ in range(k):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


def _most(word: str) -> int:
    """How far a candidate may be from a word."""
    return 1 if len(word) <= 4 else 2 if len(word) < 9 else 3


def _posted_keys(best: str) -> set[str]:
    """The keys under which a candidate is found: its look, and for each distance that askers of about its length allow what _asking_keys names."""
    n, keys = len(best), {"=" + skeleton(best)}
    if n <= 5:
        keys |= {"1" + w for w in _fewer(best, 1)}
    if 3 <= n <= 10:
        keys |= {"2" + w for w in _fewer(best, 2)}
    if n >= 6:
        keys |= {"<" + w for w in _fewer(best[: n // 2], 1)} | {">" + w for w in _fewer(best[n // 2 :], 1)}
    return keys


def _asking_keys(low: str, longest: int) -> set[str]:
    """The keys by which a word asks; longest: letters of the longest candidate.

    Up to distance 2 both sides leave letters out. At distance 3 one of the candidate's halves is at
    most 1 away from a beginning or an end of the word, of at most 1 letter more or less.
    """
    n, k, keys = len(low), _most(low), {"=" + skeleton(low)}
    if n > longest + k:
        return keys
    if k < 3:
        return keys | {f"{k}{w}" for w in _fewer(low, k)}
    for m in range((n - 3) // 2 - 1, (n + 3) // 2 + 2):
        keys |= {"<" + w for w in _fewer(low[:m], 1)}
    for m in range((n - 2) // 2 - 1, (n + 4) // 2 + 2):
        keys |= {">" + w for w in _fewer(low[max(0, n - m) :], 1)}
    return keys


def _distance(word: str, best: str | None) -> int | None:
    """How far a candidate is from a word; None if too far. Words that look alike are never too far."""
    if best is None:
        return None
    low = word.lower()
    if skeleton(low) == skeleton(best):
        return edit_distance(low, best)
    most = _most(low)
    if len(set(low) ^ set(best)) > 2 * most:
        return None
    d = edit_distance(low, best)
    return d if d <= most else None


def _pair_features(word: str, best: str | None, df: int, distance: int | None) -> list[float]:
    inner = word[1:-1]
    odd = sum(not c.isalpha() or c in "ﬁﬂﬀ" for c in inner) + (not word[-1].isalpha())
    base = [float(len(word)), float(odd), float(word[0].isupper()), float(word.isupper()), float(sum(c.isdigit() for c in word)), float(not word[0].isalpha()), float(sum(c.isupper() for c in word[1:]))]
    if best is None or distance is None:
        return base + [9.0, 0.0, 0.0, 0.0, 0.0]
    low = word.lower()
    same = skeleton(low) == skeleton(best)
    return base + [float(distance), float(same), float(np.log1p(df)), float(len(best) - len(low)), float(low[0] == best[0])]


def _keyed(words: DataFrame, keys) -> DataFrame:
    """(word, key) for each of a word's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                pairs = [(w, k) for w in whole.slice(lo, 1024).column(0).to_pylist() for k in keys(w)]
                yield pa.RecordBatch.from_arrays([pa.array([p[n] for p in pairs], pa.string()) for n in (0, 1)], names=["word", "key"])

    return words.mapInArrow(run, "word string, key string")


def _ask(tokens: DataFrame, known: DataFrame, params: RepairParams) -> DataFrame:
    """(word, train, best, df) of unknown words: all candidates that _distance accepts, or one row with a null."""
    vocabulary = known.where((F.col("df") >= params.common) & ~F.contains("word", F.lit("-")) & (F.length("word") >= 3)).withColumnRenamed("word", "best")
    longest = vocabulary.agg(F.max(F.length("best"))).first()[0] or 0
    postings = _keyed(vocabulary.select("best"), _posted_keys).withColumnRenamed("word", "best")
    asked = _keyed(tokens.select(F.lower("word")).distinct(), lambda low: _asking_keys(low, longest)).withColumnRenamed("word", "low")
    most = F.when(F.length("low") <= 4, 1).when(F.length("low") < 9, 2).otherwise(3)
    # The vocabulary grows with the papers: its joins are merged at every size.
    near = asked.join(postings.hint("merge"), "key").where(F.startswith("key", F.lit("=")) | ((F.abs(F.length("best") - F.length("low")) <= most) & F.levenshtein("low", "best", 3).between(0, most)))
    near = near.select("low", "best").distinct().join(vocabulary.hint("merge"), "best")
    return tokens.withColumn("low", F.lower("word")).join(near.hint("merge"), "low", "left").select("word", "train", "best", "df")


def _corrections(tokens: DataFrame, known: DataFrame, truth: dict[str, str], params: RepairParams) -> tuple[DataFrame, float]:
    """(word, train, best, score) for unknown words, and the score from which a word counts as misread."""
    pairs = materialise(_ask(tokens, known, params), "correction-candidates")

    spark = pairs.sparkSession
    # The trees see each training word's true candidate and a bounded number of others, drawn by hash.
    true = F.broadcast(spark.createDataFrame([(w, t.lower(), True) for w, t in sorted(truth.items())], "word string, best string, true boolean"))
    drawn = F.row_number().over(Window.partitionBy("word").orderBy(F.xxhash64("best", F.lit(params.seed)), "best"))
    sample = pairs.where("train").withColumn("rank", drawn).join(true, ["word", "best"], "left").where((F.col("rank") <= params.train_candidates) | F.col("true"))
    asked = [(r["word"], r["best"], r["df"] or 0, _distance(r["word"], r["best"])) for r in sample.select("word", "best", "df").collect()]
    rows = [r for r in asked if r[3] is not None]
    seen = {r[0] for r in rows}
    rows += [(w, None, 0, None) for w in sorted({r[0] for r in asked} - seen)]
    x = np.array([_pair_features(*r) for r in rows])
    y = np.array([float(r[0] in truth and (r[1] is None or r[1] == truth[r[0]].lower())) for r in rows])
    model = Boosted(trees=40, depth=4).fit(x, y) if len(rows) else Boosted(trees=0)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, alone = [], set()
            for w, t, c, d in zip(*(b.column(n).to_pylist() for n in ("word", "train", "best", "df"))):
                far = _distance(w, c)
                if far is not None:
                    rows.append((w, t, c, d or 0, far))
                elif (w, t) not in alone:  # one row without a candidate is enough
                    alone.add((w, t))
                    rows.append((w, t, None, 0, None))
            if rows:
                p = shared.value.predict(np.array([_pair_features(w, c, d, far) for w, _, c, d, far in rows]))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.string()), pa.array(p)], names=["word", "train", "best", "score"])

    scored = pairs.mapInArrow(score, "word string, train boolean, best string, score double")
    fixes = materialise(scored.groupBy("word", "train").agg(F.max_by("best", F.struct("score", "best")).alias("best"), F.max("score").alias("score")), "corrections")
    # The threshold rests on the best of all candidates of each training word.
    best = sorted((r["word"], r["score"]) for r in fixes.where("train").select("word", "score").collect())
    return fixes, calibrate(np.array([p for _, p in best]), np.array([float(w in truth) for w, _ in best]), 0.85) if best else 2.0


# ---------------------------------------------------------------- line features


def _shape(line: str) -> str:
    """A line's form for counting repetitions: the part before a wide gap, digits masked; long ones by their hash."""
    s = line.strip()
    m = _GAP.search(s)
    if m:
        head, tail = s[: m.start(1)], s[m.end(1) :]
        s = head if len(_LETTERS.findall(head)) >= 2 else tail
    form = skeleton(re.sub(r"[\dOl]*\d[\dOl]*", "#", s))
    return form if len(form) <= 20 else hashlib.blake2b(form.encode("utf-8", "surrogatepass"), digest_size=10).hexdigest()


def _line_features(lines: list[str], title: str, shapes: list[int], known: list[tuple[int, int]]) -> np.ndarray:
    """One row per line; shapes: papers that have the line's form; known: known and unknown words."""
    lengths = [len(x.strip()) for x in lines if x.strip()]
    middle = float(np.median(lengths)) if lengths else 1.0
    looks = {skeleton(w) for w in _LETTERS.findall(title or "") if len(w) > 3}

    def pagelike(s: str) -> bool:
        return bool(s) and (bool(_PAGE.fullmatch(s)) and any(c.isdigit() for c in s) or bool(_ROMAN.fullmatch(s)))

    stripped = [x.strip() for x in lines]
    own = []
    for i, s in enumerate(stripped):
        words = _LETTERS.findall(s)
        gap = _GAP.search(s)
        ends = [s[: gap.start(1)].strip(), s[gap.end(1) :].strip()] if gap else ["", ""]
        own.append([
            len(s), len(s) / middle, len(words), sum(map(str.isdigit, s)) / max(1, len(s)), float(pagelike(s)), float(bool(gap)), float(any(pagelike(e) for e in ends)),
            sum(map(str.isupper, s)) / max(1, sum(map(str.isalpha, s))), sum(skeleton(w) in looks for w in words) / max(1, len(words)), float(bool(_ROMAN.fullmatch(s))),
            float(s[-1:] in ".!?:;,”\"»)।。" and s != ""), float(s[:1].islower()), float("=" in s or "+" in s), float(bool(_EQUATION.fullmatch(s))), float("©" in s), float(np.log1p(shapes[i])),
            known[i][0] / max(1, sum(known[i])), float(bool(_VOLUME.search(s))), sum(w[:1].isupper() for w in words) / max(1, len(words)), float(s[-1:].isdigit()),
        ])
    out = []
    blank = [0.0] * (len(own[0]) if own else 20)
    for i in range(len(lines)):
        around = []
        for step in (-1, 1):
            j = i + step
            while 0 <= j < len(lines) and not stripped[j]:
                j += step
            inside = 0 <= j < len(lines)
            o = own[j] if inside else blank
            around += [float(abs(j - i) > 1), float(inside), o[1], o[4], o[8], o[10], o[11], o[15], float(bool(_broken(lines[j]))) if inside else 0.0]
        out.append(own[i] + around)
    return np.array(out) if out else np.zeros((0, 38))


def _break_features(line: str, facts: dict) -> list[float]:
    """A broken word and the line that may continue it: how well known halves, joined and hyphenated forms are."""
    mark = _broken(line).group(2)
    f = lambda role: facts.get(role, ("", 0, 0.0))
    left, right, joined, compound = f("L"), f("R"), f("J"), f("C")
    log = lambda t: float(np.log1p(max(0, t[1])))
    return [float("-‐‑¬\xad".find(mark)), log(left), log(right), log(joined), log(compound), joined[2], left[2], right[2], float(len(left[0])), float(len(right[0])), float(right[0][:1].islower()), float(line.endswith(" "))]


def _known(entries: list[dict], lines: list[str]) -> list[tuple[int, int]]:
    """Known and unknown words per line; known words have no entry, and what may be the half of a broken word doesn't count as unknown."""
    known = [[len(x.split()), 0] for x in lines]
    halves = {_continuation(lines, i) for i, x in enumerate(lines) if _broken(x)}
    for e in entries:
        i = e["line"]
        if e["role"] == "w" or i not in halves:
            known[i][0] -= 1
            known[i][1] += 1
    return [(max(0, a), b) for a, b in known]


@dataclass
class Models:
    breaks: Boosted
    break_cut: float
    misread_cut: float


@dataclass
class Unit:
    """A unit's lines, which of them are furniture, the facts of its broken words, and the scored words and first words of its lines."""

    lines: list[str]
    furniture: np.ndarray
    broken: dict[int, dict]
    scored: dict[int, list]
    heads: dict[int, tuple]


def _unit(text: str, furniture: list[int], entries: list[dict]) -> Unit:
    lines = text.split("\n")
    u = Unit(lines, np.isin(np.arange(len(lines)), furniture), {}, {}, {})
    for e in entries:
        i, role = e["line"], e["role"]
        if role in "wh":
            if e["score"] is not None:
                scored = (e["word"], e["best"], e["score"])
                u.scored.setdefault(i, []).append(scored) if role == "w" else u.heads.update({i: scored})
        else:
            facts = u.broken.setdefault(i, {"best": {}})
            facts[role] = (e["word"], e["df"], e["score"] or 0.0)
            facts["best"][role] = e["best"]
    return u


def judge(units: list[Unit], models: Models) -> list[tuple[list[tuple[int, str]], str]]:
    """For each unit the (line from 1, kind) that need repair, and the repaired text. The model is asked once for all units."""
    asked, features = [], []
    for n, u in enumerate(units):
        for i, facts in u.broken.items():
            if "J" in facts and (facts["R"][0][0].islower() or facts["L"][0].isupper()):
                asked.append((n, i))
                features.append(_break_features(u.lines[i], facts))
    joined = models.breaks.predict(np.array(features)) >= models.break_cut if features else []
    joins: list[dict[int, int]] = [{} for _ in units]
    for (n, i), yes in zip(asked, joined):
        if yes:
            joins[n][i] = _continuation(units[n].lines, i, units[n].furniture)
    return [_repaired_unit(u, j, models.misread_cut) for u, j in zip(units, joins)]


def _repaired_unit(u: Unit, continued: dict[int, int], cut: float) -> tuple[list[tuple[int, str]], str]:
    lines, furniture, broken = u.lines, u.furniture, u.broken
    # The half of a broken word is judged with its other half.
    halves = {_continuation(lines, i, furniture) for i in broken}
    scored = {i: list(s) for i, s in u.scored.items()}
    for i, head in u.heads.items():
        if i not in halves:
            scored.setdefault(i, []).append(head)
    found: list[tuple[int, str]] = []
    joins: dict[int, tuple[int, str]] = {}
    for i in range(len(lines)):
        if furniture[i]:
            found.append((i + 1, "furniture"))
            continue
        if i in continued:
            found.append((i + 1, "hyphen"))
            joined = broken[i]["J"]
            best = broken[i]["best"].get("J") if joined[1] <= 0 and joined[2] >= cut else None
            joins[i] = (continued[i], best or joined[0])
            if best:
                at_left = not best.startswith(broken[i]["L"][0].lower())
                found.append((i + 1 if at_left else joins[i][0] + 1, "misread"))
        if any(s >= cut for _, _, s in scored.get(i, [])):
            found.append((i + 1, "misread"))
    # Repair: drop furniture, put words right, join broken words, and set lines of a paragraph together.
    paragraphs: list[list[str]] = [[]]
    taken: dict[int, int] = {}
    for i, line in enumerate(lines):
        if furniture[i]:
            continue
        if not line.strip():
            # A blank line beside furniture is the page's, not the text's.
            beside = any(0 <= j < len(lines) and furniture[j] for j in (i - 1, i + 1))
            if paragraphs[-1] and not beside:
                paragraphs.append([])
            continue
        s = line[taken.get(i, 0) :].strip()
        for word, best, score in scored.get(i, []):
            if score >= cut and best:
                fixed = best.upper() if word.isupper() and len(word) > 2 else best.capitalize() if word[0].isupper() else best
                s = re.sub(rf"(?<!\w){re.escape(word)}(?!\w)", fixed, s)
        m = _broken(s)
        if i in joins and m:
            j, word = joins[i]
            s = s[: m.start(1)] + word
            head = re.match(r"\s*[^\W_][\w@!|ﬁﬂ]*", lines[j])
            taken[j] = head.end()
            tail = re.match(r"\S*", lines[j][head.end() :]).group()
            s += tail
            taken[j] += len(tail)
        elif m:
            s = s[: m.end(1)] + "-\0"
        paragraphs[-1].append(s)
    repaired = "\n\n".join(" ".join(x for x in p if x).replace("-\0 ", "-").replace("-\0", "-") for p in paragraphs if p)
    return sorted(set(found)), repaired


# ---------------------------------------------------------------- the whole


def repair(units: DataFrame, papers: DataFrame, params: RepairParams = RepairParams()) -> DataFrame:
    """(paper_id, section_idx, found array of (line, kind), text) of each unit of scanned papers.

    units: (paper_id, section_idx, title, text) to repair; papers: (paper_id, title, text, scanned),
    all of them, for the frequencies. Null and blank texts give no rows; a null title is ''. Without
    clean papers nothing is known about words, and the result is empty, as it is without units.
    """
    spark = units.sparkSession
    schema = "paper_id long, section_idx int, found array<struct<line:int,kind:string>>, text string"
    known = _frequencies(papers)
    clean = papers.where(~F.col("scanned") & (F.length("text") > 200)).orderBy(F.xxhash64("paper_id", F.lit(params.seed)), "paper_id").limit(params.train_papers).select("paper_id", "title", "text")
    clean = clean.mapInArrow(_draw_paragraphs(params), "paper_id long, title string, text string").orderBy("paper_id").collect()
    if not clean:
        return spark.createDataFrame([], schema)
    r = random.Random(params.seed)
    labels, rows, truth = {}, [], {}
    for n, c in enumerate(clean):
        text, done = add_noise(c["text"], c["title"] or "", r.randint(1, 200), r)
        labels[-1 - n] = done
        truth |= done["truth"]
        rows.append((-1 - n, 0, c["title"] or "", text, True))
    trained = spark.createDataFrame(rows, "paper_id long, section_idx int, title string, text string, train boolean")
    real = units.where(F.col("text").isNotNull() & (F.trim("text") != "")).select(F.col("paper_id").cast("long").alias("paper_id"), F.col("section_idx").cast("int").alias("section_idx"), F.coalesce("title", F.lit("")).alias("title"), "text", F.lit(False).alias("train"))
    every = materialise(real.unionByName(trained), "scanned-units")

    # Known words make no entries; the commonest are left out before anything is shuffled.
    heads = known.where((F.col("df") >= 2) & ~F.contains("word", F.lit("-"))).orderBy(F.desc("df"), "word").limit(params.familiar)
    familiar = spark.sparkContext.broadcast(frozenset(x["word"] for x in heads.select("word").collect()))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for p, s, t, train in zip(*(b.column(n).to_pylist() for n in ("paper_id", "section_idx", "text", "train"))):
                got = words_of(t, familiar.value) + [(i, "s", _shape(x)) for i, x in enumerate(t.split("\n")) if x.strip()]
                for line, role, word in got:
                    for c, v in zip(cols, (p, s, train, line, role, word)):
                        c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, (pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.string(), pa.string()))], names=["paper_id", "section_idx", "train", "line", "role", "word"])

    spelled = materialise(every.select("paper_id", "section_idx", "text", "train").mapInArrow(spell, "paper_id long, section_idx int, train boolean, line int, role string, word string"), "scanned-words")

    # A training text's own paper doesn't count among those that know its words.
    def standing(words: DataFrame) -> DataFrame:
        status = words.groupBy("word", "train").agg(F.count("*").alias("n")).withColumn("low", F.lower("word")).join(known.withColumnRenamed("word", "low").hint("merge"), "low", "left")
        return status.select("word", "train", (F.coalesce("df", F.lit(0)) - F.col("train").cast("int")).cast("int").alias("df"), "n")

    shapes = spelled.where(F.col("role") == "s").groupBy("word", "train").agg(F.count_distinct("paper_id").cast("int").alias("df"), F.count("*").alias("n")).withColumn("shape", F.lit(True))
    looked = standing(spelled.where(F.col("role") != "s")).where(F.col("df") <= 0).withColumn("shape", F.lit(False)).unionByName(shapes)
    looked, keys = materialise(looked, "looked-up"), ["word", "train", "shape"]
    # A bare page number is one form for all papers.
    marked = spread_join(spelled.withColumn("shape", F.col("role") == "s"), looked.drop("n"), keys, sizes=looked)
    entries = marked.groupBy("paper_id", "section_idx").agg(F.collect_list(F.struct("line", "role", "word", "df")).alias("entries"))
    described = materialise(every.join(entries, ["paper_id", "section_idx"], "left"), "described-units")

    # Furniture first: it decides which line continues a broken word. Training units have their own labels.
    lined = spark.sparkContext.broadcast((*_train_furniture(described.where("train").collect(), labels), {n: sorted(done["furniture"]) for n, done in labels.items()}))
    word = pa.list_(pa.struct([("line", pa.int32()), ("role", pa.string()), ("word", pa.string())]))
    fields = pa.schema([("paper_id", pa.int64()), ("section_idx", pa.int32()), ("text", pa.string()), ("train", pa.bool_()), ("furniture", pa.list_(pa.int32())), ("words", word)])

    def line_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, least, labelled = lined.value
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                rows = b.slice(lo, 128).to_pylist()
                split = [_split_entries(r["entries"], r["text"]) for r in rows]
                lines = [r["text"].split("\n") for r in rows]
                x = [_line_features(ls, r["title"], shapes, _known(words, ls)) for r, ls, (words, shapes) in zip(rows, lines, split)]
                p = np.split(model.predict(np.concatenate(x)), np.cumsum([len(q) for q in x])[:-1])
                out = []
                for r, ls, (words, _), q in zip(rows, lines, split, p):
                    at = labelled[r["paper_id"]] if r["train"] else [i for i in np.flatnonzero(q >= least).tolist() if ls[i].strip()]
                    breaks = breaks_of(ls, np.isin(np.arange(len(ls)), at))
                    words = [{k: e[k] for k in ("line", "role", "word")} for e in words] + [{"line": i, "role": role, "word": w} for i, role, w in breaks]
                    out.append({k: r[k] for k in ("paper_id", "section_idx", "text", "train")} | {"furniture": at, "words": words})
                yield pa.RecordBatch.from_pylist(out, schema=fields)

    parted = materialise(described.mapInArrow(line_up, "paper_id long, section_idx int, text string, train boolean, furniture array<int>, words array<struct<line:int,role:string,word:string>>"), "lined-units")
    pieces = parted.select("paper_id", "section_idx", "train", F.inline("words"))
    status = materialise(standing(pieces), "word-status")  # with n, the rows of each word
    unknown = status.where((F.col("df") <= 0) & ~F.contains("word", F.lit("-")) & (F.length("word") >= 3)).select("word", "train")
    fixes, cut = _corrections(unknown, known, truth, params)
    scored = spread_join(pieces, status.drop("n").join(fixes.hint("merge"), ["word", "train"], "left"), ["word", "train"], sizes=status)
    entries = scored.groupBy("paper_id", "section_idx").agg(F.collect_list(F.struct("line", "role", "word", "df", "best", "score")).alias("entries"))
    judged = materialise(parted.drop("words").join(entries, ["paper_id", "section_idx"], "left"), "scored-units")

    models = Models(*_train_breaks(judged.where("train").collect(), labels), cut)
    shared = spark.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lo in range(0, b.num_rows, 128):
                part = b.slice(lo, 128)
                ids, idx, texts, furniture, entries = (part.column(n).to_pylist() for n in ("paper_id", "section_idx", "text", "furniture", "entries"))
                units = [_unit(t, f, e or []) for t, f, e in zip(texts, furniture, entries)]
                for p, s, (found, text) in zip(ids, idx, judge(units, shared.value)):
                    out.append({"paper_id": p, "section_idx": s, "found": [{"line": i, "kind": k} for i, k in found], "text": text})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("paper_id", pa.int64()), ("section_idx", pa.int32()), ("found", pa.list_(pa.struct([("line", pa.int32()), ("kind", pa.string())]))), ("text", pa.string())]))

    return judged.where(~F.col("train")).select("paper_id", "section_idx", "text", "furniture", "entries").mapInArrow(run, schema)


def _split_entries(entries: list | None, text: str) -> tuple[list, list[int]]:
    """The word entries, and the papers that share each line's form."""
    shapes = [0] * (text.count("\n") + 1)
    words = []
    for e in entries or []:
        if e["role"] == "s":
            shapes[e["line"]] = e["df"]
        else:
            words.append(e)
    return words, shapes


def _fit(x: list, y: list, held: list) -> tuple[Boosted, float]:
    """A model of lines and its threshold, from the part held out."""
    x, y, held = np.array(x), np.array(y), np.array(held, bool)
    if len(y) < 20 or len(set(y)) < 2:
        return Boosted(trees=0), 2.0
    model = Boosted(trees=50, depth=4).fit(x[~held], y[~held])
    return model, min(0.7, calibrate(model.predict(x[held]), y[held], 0.85)) if held.any() and y[held].any() else 0.5


def _train_furniture(units: list, labels: dict) -> tuple[Boosted, float]:
    """The model of furniture, from the training units; every third unit is held out for the threshold."""
    x, y, held = [], [], []
    for u in units:
        done, lines = labels[u["paper_id"]], u["text"].split("\n")
        words, shapes = _split_entries([e.asDict() for e in u["entries"] or []], u["text"])
        for i, row in enumerate(_line_features(lines, u["title"], shapes, _known(words, lines))):
            if lines[i].strip():
                x.append(row)
                y.append(float(i in done["furniture"]))
                held.append(u["paper_id"] % 3 == 0)
    return _fit(x, y, held)


def _train_breaks(units: list, labels: dict) -> tuple[Boosted, float]:
    """The model of broken words, in the same way."""
    x, y, held = [], [], []
    for u in units:
        unit = _unit(u["text"], u["furniture"], [e.asDict() for e in u["entries"] or []])
        for i, facts in unit.broken.items():
            if "J" in facts:
                x.append(_break_features(unit.lines[i], facts))
                y.append(float(i in labels[u["paper_id"]]["hyphen"]))
                held.append(u["paper_id"] % 3 == 0)
    return _fit(x, y, held)
