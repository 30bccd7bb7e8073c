"""Texts that lost their end.

Plan. All values are reduced to their letters and digits and sorted (range partitions, so no prefix
group meets in one task). In sorted order a value that is a strict prefix of any other is a prefix of
its successor: this self-join by prefix finds the records that have a longer copy elsewhere. Records
without one are judged by boosted trees over the form of their end and over corpus counts: how often
the last word ends lines, and how often the last line ends other texts or stands as a line in them.
The trees are fitted on a bounded sample of the records and on copies of them that are cut
artificially and go through the same joins; whole texts needn't be known: records that the first trees
take for cut are left out when the next are fitted. A longer copy alone is no proof (an abstract opens its section), so it lowers the
score that is needed.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import median

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirewright.llm.boosting import Boosted, calibrate
from quirewright.llm.joins import spread_join
from quirewright.plans.storage import materialise


@dataclass(frozen=True)
class EndParams:
    """train_rows: records, drawn by hash, on which the trees are fitted; every second of them is cut as well. least_clear: for each of the first rounds, the score from which an uncut record isn't learnt from; least_longer: the score a record with a longer copy needs."""

    train_rows: int = 6_000
    least_clear: tuple[float, ...] = (0.6, 0.5)
    least_longer: float = 0.1
    seed: int = 29


#: Marks that are put after a cut.
MARKS = regex.compile(r"(?:\s*(?:\[\s*(?:\.{2,}|…|truncated|cut|more|continued|cont\.?|snip)\s*\]|\(\s*(?:\.{2,}|…|truncated|cut|more|continued|cont\.?|snip)\s*\)|<\s*(?:truncated|cut|more|snip)\s*>|…|\.{3,}|�|-{2,}|—|–|>>|»{2}|\[…?))+\s*$", regex.I)
#: Abbreviations that do not end a sentence, as they are spelled.
ABBREVIATIONS = frozenset(
    "Dr Mr Mrs Ms Mme Mlle Prof St Sr Jr vs No Nos no nr Nr Fig Figs fig Eq Eqs eq Ref Refs ref Sec Secs Tab Tabs Vol Vols vol Ch ch Chap pp approx ca cf viz e.g i.e resp Abb Kap Hr Fr bzw z.B d.h vgl Vgl Mio Mrd sog MM env c.-à-d Sra Srta pág págs núm p.ej ej EE Fa Dept ed eds U.S U.K Ltd".split()
)
_CLOSED = frozenset(".!?。！？।؟…۔।॥．")
_CLOSERS = regex.compile(r"[\"'”’»)\]）」』】》›*_\s]+$")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_ITEM = regex.compile(r"^\s*(?:[-*•–]|\(?\d{1,3}[.)]|\(?[a-z][.)])\s+")
_PAIRS = {")": "(", "]": "[", "”": "“", "）": "（", "」": "「", "』": "『", "》": "《", "»": "«", "】": "【"}
_OPEN = frozenset(_PAIRS.values())
_TEXT_END = regex.compile(r"[.!?。！？।؟…۔॥．][\"'”’»)\]）」』】》›*_\s]*(?:\s|$)")
_RATING = regex.compile(r"\[?\d+(?:\.\d+)?/\d+\]?$")
_INITIALS = regex.compile(r"\p{L}|(?:\p{L}\.)+\p{L}")
_SHORT = regex.compile(r"(?:^|\s)[(«„“\"']*(\p{L}[\p{L}.-]{0,8})\.(?=\s+\S)")
#: What may be put after an artificial cut.
_ARTIFICIAL = ["…", "...", " ...", " […]", " [...]", " [truncated]", " [cut]", " (more)", " [continued]", "--", "�", " (…)", " <truncated>"]
FEATURES = 26
_UNMARKED = 14  # the feature that tells such a script


def _unbalanced(text: str) -> bool:
    """Whether a bracket or a directed quotation mark of the last paragraph stays open."""
    stack = []
    german = "„" in text
    for c in text:
        if c in _OPEN and not (german and c == "“"):
            stack.append(c)
        elif c in _PAIRS and stack and stack[-1] == _PAIRS[c]:
            stack.pop()
    return bool(stack)


def _words_since_stop(last: str) -> int:
    """Words after the last full stop inside a line."""
    stops = [m.end() for m in _TEXT_END.finditer(last) if m.end() < len(last)]
    return len(_WORD.findall(last[stops[-1] :] if stops else last))


def end_of(text: str) -> tuple[bool, str, str, list[float]]:
    """(marked, last word, last line, features of the form) of a non-blank text."""
    stripped = text.strip()
    core = MARKS.sub("", stripped)
    if core != stripped and stripped.endswith(("—", "–", "--")) and core[core.rfind("\n") + 1 :].lstrip().startswith(("—", "–", "--")):
        core = stripped  # a line framed by dashes
    marked = core != stripped
    if not core:
        return marked, "", "", [float(marked), 1.0] + [0.0] * (FEATURES - 2)
    paragraph = core[core.rfind("\n\n") + 1 :].strip()
    lines = paragraph.split("\n")
    last = lines[-1].strip()
    words = _WORD.findall(last)
    word = words[-1].lower() if words and last.endswith(words[-1]) else ""
    bare = _CLOSERS.sub("", last)
    closed = bool(bare) and bare[-1] in _CLOSED
    item = bool(_ITEM.match(last))
    others = [x for x in lines[:-1] if _ITEM.match(x)] if item else []
    rows = [x.strip() for x in lines[:-1] if x.strip().startswith("|")]
    spoken = bare[:-1].split() if closed and bare[-1] == "." else []
    token = spoken[-1].lstrip("(«„“\"'") if spoken else ""
    unit = len(spoken) > 1 and spoken[-2][-1].isdigit()
    ends = [_CLOSERS.sub("", x.strip())[-1:] for x in core.split("\n") if x.strip()][:-1]
    tail = core[-1]
    return marked, word, last, [
        float(marked), 0.0, float(last.startswith("|")), float(last.endswith("|") and len(last) > 1), float(bool(rows) and last.count("|") == rows[0].count("|")),
        float(closed), float(bare != last), float(token in ABBREVIATIONS), float(bool(token) and not unit and bool(_INITIALS.fullmatch(token))), float(token.lower() in ("a.m", "p.m", "al")),
        float(item), sum(_CLOSERS.sub("", x.strip())[-1:] in _CLOSED for x in others) / len(others) if others else -1.0, len(words) / max(1, median(len(_WORD.findall(x)) for x in others)) if others else -1.0,
        float(_unbalanced(paragraph)), float("฀" <= tail <= "๿"), float(bool(_RATING.search(last))), float(min(20, len(words))), float(word != ""), float(last[:1] in "—–-#*"), float(tail in ",;:、，；：(-/&"),
        float(tail.isdigit()), float(len(word)), float(sum(x in _CLOSED for x in ends) * 2 > len(ends)) if len(ends) > 1 else -1.0,
        float(min(20, _words_since_stop(last))), float(tail.isalpha() and tail.lower() == tail.upper()), float(tail.isupper()),
    ]


def cut_text(text: str, r: random.Random) -> str | None:
    """A text cut in the middle of a word or sentence, with a mark or without; None if chance finds no such place."""
    core = text.strip()
    mark = r.choice(_ARTIFICIAL) if r.random() < 0.45 else ""
    if r.random() < 0.15:  # after the stop of an abbreviation
        stops = [m.end() for m in _SHORT.finditer(core) if m[1] in ABBREVIATIONS or _INITIALS.fullmatch(m[1])]
        if stops:
            return core[: r.choice(stops)] + mark
    for _ in range(8):
        at = r.randint(int(0.6 * len(core)), len(core) - 1) if len(core) > 8 else 0
        kept, rest = core[:at].rstrip(), core[at:]
        if kept and rest.strip() and not rest.startswith("\n") and _CLOSERS.sub("", kept)[-1:] not in _CLOSED and core[at - 1 : at] != "\n":
            return (core[:at] if r.random() < 0.2 else kept) + mark
    return None


_FIELDS = "kind string, id long, trained int, canon string, marked boolean, word string, line string, form array<double>"


def _describe(params: EndParams, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1_024):
                b = whole.slice(lo, 1_024)
                rows = []
                for kind, i, text, draw in zip(*(b.column(c).to_pylist() for c in ("kind", "id", "text", "draw"))):
                    drawn = draw % step == 0
                    r = random.Random(draw ^ params.seed)
                    cut = cut_text(text, r) if drawn and draw // step % 2 == 0 else None
                    # trained: 0 no, 1 as it is, 2 cut; a cut copy is no record.
                    for t, trained in [(text, int(drawn))] + [(cut, 2)] * bool(cut):
                        marked, word, line, form = end_of(t)
                        core = MARKS.sub("", t.strip()) if marked else t
                        canon = "".join(_WORD.findall(core)).lower() if trained < 2 else ""
                        rows.append((kind, i, trained, canon, marked, word, "".join(_WORD.findall(line)).lower(), form))
                if rows:
                    names = ("kind", "id", "trained", "canon", "marked", "word", "line", "form")
                    types = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def strict_prefixes(values: DataFrame, column: str) -> DataFrame:
    """The distinct non-empty values of ``column`` that are strict prefixes of another value.

    Sorted by range; a partition's last value meets the first of the next partition in a join, so no
    value reaches the driver.
    """
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = values.select(F.col(column).alias("v")).where(F.length("v") > 0).distinct()
    ordered = materialise(distinct.repartitionByRange(parts, "v").sortWithinPartitions("v").withColumn("part", F.spark_partition_id()), "sorted-values")
    follow = F.lead("v").over(Window.partitionBy("part").orderBy("v"))
    inner = ordered.withColumn("next", follow).where(F.col("next").isNotNull() & F.expr("startswith(next, v)")).select("v")
    order = ordered.select("part").distinct().withColumn("after", F.lead("part").over(Window.orderBy("part")))  # a row per partition
    edges = ordered.groupBy("part").agg(F.min("v").alias("first"), F.max("v").alias("last")).join(order, "part")
    met = edges.select("last", F.col("after").alias("part")).join(edges.select("part", "first"), "part")
    return inner.unionByName(met.where(F.expr("startswith(first, last)") & (F.col("first") != F.col("last"))).select(F.col("last").alias("v")))


def _mean(models: list[Boosted], x: np.ndarray) -> np.ndarray:
    return np.mean([m.predict(x) for m in models], axis=0)


def _crossfit(x: np.ndarray, y: np.ndarray, trees: int, depth: int, folds: int = 3) -> tuple[list[Boosted], np.ndarray]:
    """One model per fold, fitted on the others, and for each row the score by the model that hasn't seen it."""
    fold = np.arange(len(y)) % folds
    models = [Boosted(trees=trees, depth=depth).fit(x[fold != f], y[fold != f]) for f in range(folds)]
    p = np.zeros(len(y))
    for f, m in enumerate(models):
        p[fold == f] = m.predict(x[fold == f])
    return models, p


def ends(records: DataFrame, copies: DataFrame, lines: DataFrame | None = None, params: EndParams = EndParams()) -> DataFrame:
    """(kind, id, truncated, longer_copy, marked, score) of records (kind, id, text).

    copies (text): other places where whole copies may stand; lines (line): texts of one line that are
    known to be whole. longer_copy says that the prefix join found the record, score what the trees
    think of its end. Tables too small to fit trees on (fewer than about 40 records) have only the
    prefix join. Null and blank texts give no row; empty tables give no rows; repeated rows give
    one row each.
    """
    spark = records.sparkSession
    rows = records.where(F.col("text").isNotNull() & F.col("id").isNotNull() & F.expr("text rlike '[^ \\t\\n\\r\\u00A0\\u3000]'")).select("kind", F.col("id").cast("long").alias("id"), "text")
    step = max(1, rows.count() // params.train_rows)
    drawn = rows.withColumn("draw", F.pmod(F.xxhash64("kind", "id", F.lit(params.seed)), F.lit(1 << 40)))
    described = materialise(drawn.mapInArrow(_describe(params, step), _FIELDS).withColumn("h", F.xxhash64("canon")), "text-ends")
    real = described.where(F.col("trained") < 2)

    squash = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{M}\p{N}]+", ""))
    longest = real.agg(F.max(F.length("canon"))).head()[0] or 0
    other = copies.where(F.col("text").isNotNull()).select(F.substring(squash(F.col("text")), 1, longest + 1).alias("canon"))
    prefixes = strict_prefixes(real.select("canon").unionByName(other), "canon").select(F.xxhash64("v").alias("h"), F.lit(True).alias("longer")).distinct()

    # Over all lines but each record's last: how often a word ends one, and how often it stands at all.
    cut = F.filter(F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\n"), "\n"), lambda x: F.trim(x) != "")
    inner = materialise(rows.select(F.explode(F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(0)))).alias("line")), "inner-lines")
    said = inner.select(F.regexp_extract_all(F.lower("line"), F.lit(r"[\p{L}\p{M}\p{N}]+"), 0).alias("w")).where(F.size("w") > 0)
    counts = said.select(F.posexplode("w").alias("i", "word"), F.size("w").alias("n")).groupBy("word").agg(F.count("*").alias("total"), F.count_if(F.col("i") == F.col("n") - 1).alias("ended"))
    odds = counts.join(described.where(F.col("word") != "").select("word").distinct(), "word", "left_semi")

    # The same for whole lines: how many different texts end with one, and how often it stands inside them or elsewhere.
    asked = described.where(F.col("line") != "").select("line").distinct()
    closing = real.where(F.col("line") != "").select("h", "line").distinct().groupBy("line").agg(F.count("*").alias("said"))
    known = inner.select(squash(F.col("line")).alias("line"))
    if lines is not None:
        known = known.unionByName(lines.select(squash(F.col("line")).alias("line")))
    standing = known.groupBy("line").agg(F.count("*").alias("stands"))
    # A line that is the beginning of another one that several texts end with may itself be cut.
    common = closing.where(F.col("said") > 1)
    broken = strict_prefixes(common, "line").select(F.col("v").alias("line"), F.lit(1.0).alias("broken"))
    facts = asked.join(closing, "line", "left").join(standing, "line", "left").join(broken, "line", "left")

    # One word or line may end a third of all texts.
    found = spread_join(spread_join(described.drop("canon"), odds, ["word"], "left"), facts, ["line"], "left").join(prefixes, "h", "left")
    log = lambda c: F.log1p(F.coalesce(F.col(c), F.lit(0)).cast("double"))
    others = F.log1p(F.greatest(F.coalesce("said", F.lit(0)) - (F.col("trained") < 2).cast("int"), F.lit(0)).cast("double"))  # without the record itself
    corpus = F.array(F.coalesce(F.col("ended") / F.col("total"), F.lit(-1.0)), log("total"), others, log("stands"), F.coalesce("broken", F.lit(0.0)))
    featured = materialise(found.select("kind", "id", "trained", "marked", F.coalesce("longer", F.lit(False)).alias("longer_copy"), F.concat("form", corpus).alias("x")), "end-features")

    got = featured.where(F.col("trained") > 0).select("kind", "id", "trained", "x").collect()  # about train_rows and a half
    got.sort(key=lambda r: (r["trained"], r["kind"], r["id"]))
    x, y = np.array([r["x"] for r in got]), np.array([float(r["trained"] == 2) for r in got])
    if y.sum() < 20:  # nothing to fit trees on: the prefix join decides alone
        model, least = [Boosted(trees=0)], 2.0
    else:
        # Trees tell which of the uncut records look cut; the next ones are fitted without these.
        clear = np.ones(len(y), bool)
        for most in params.least_clear:
            _, likely = _crossfit(x[clear], y[clear], 40, 3)
            seen = np.zeros(len(y))
            seen[clear] = likely
            seen[~clear] = 1.0  # what was left out stays out
            clear = (y > 0) | (seen < most) | (x[:, _UNMARKED] > 0)  # in a script without full stops whole texts look cut
        model, p = _crossfit(x[clear], y[clear], 50, 4)
        least = calibrate(p, y[clear], 0.0)
    shared = spark.sparkContext.broadcast((model, least))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, cutoff = shared.value
        for b in batches:
            if b.num_rows:
                p = _mean(trees, b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
                longer = b.column("longer_copy").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("id"), pa.array((p >= cutoff) | longer & (p >= params.least_longer)), b.column("longer_copy"), b.column("marked"), pa.array(p)], names=["kind", "id", "truncated", "longer_copy", "marked", "score"])

    return featured.where(F.col("trained") < 2).drop("trained").mapInArrow(judge, "kind string, id long, truncated boolean, longer_copy boolean, marked boolean, score double")
