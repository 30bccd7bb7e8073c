"""Sentence boundaries across languages and scripts, by a finite transducer.

Plan. A lexer reduces a text to the few events that matter: terminators with their closing marks,
opening and closing quotation marks and brackets, paragraph breaks, and spaces between Thai letters.
What can be told on the spot (abbreviations, initials, decimals, what follows) is in the event's
symbol. The transducer has 16 states: at a sentence's start or not, no quotation or one opened at the
start, after a colon, or elsewhere, bracket open or not. A batch's events are cut into blocks; each
block becomes a function from states to states, the functions are composed by a parallel prefix scan,
and then all blocks run at once from their true first state. Documents of more than CHUNK characters
are cut between letters, their chunks are lexed in tasks of their own with a little context on either
side, and each chunk's function is composed with those of the document's other chunks. The result
doesn't depend on where the cuts fall.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewright.plans.storage import materialise

#: Abbreviations after which a sentence doesn't end, as they are spelled.
ABBREVIATIONS = frozenset(
    "Dr Mr Mrs Ms Mme Mlle Prof St Ste Sr Jr Asst Assoc Hon Rev Gen Col Capt Lt Sgt vs No Nos no nos Nr nr Fig Figs fig figs Eq Eqs eq Ref Refs ref refs Sec Secs sec Sect Sects sect Tab Tabs tab Vol Vols vol vols Ch Chap chap pp approx Approx ca Ca cf Cf viz e.g i.e E.g I.e resp Abb Kap Hr Fr Fa bzw z.B d.h u.a vgl Vgl Mio Mrd sog inkl evtl ggf Art Abs MM env c.-à-d Sra Sras Srta Dra pág págs Pág núm Núm ej p.ej EE Dept Univ ed eds transl Op op Ing Lic Bd Hrsg डॉ प्रो श्री".split()
)
#: Months after an ordinal, and words that announce one.
MONTHS = frozenset("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split())
_ORDINAL = frozenset("Am am Der der Die die Das das Dem dem Den den Im im Vom vom Zum zum Zur zur Beim beim Des des Seit seit Bis bis Ab ab".split())

_W = " \t\r\n 　"
_QUOTES = "\"'”’»」』》›"
_BRACKETS = ")]）】"
_CJK_STOPS = "。！？｡"
_FREE_STOPS = _CJK_STOPS + "।॥؟۔"
_EVENT = re.compile(
    rf"""(?P<stop>[.!?．…{_FREE_STOPS}]+(?P<close>(?:[{re.escape(_QUOTES + _BRACKETS)}]|[  ]»)*))(?=(?P<gap>[{_W}]*)(?P<next>.{{0,3}}))
    |(?P<para>\n[ \t\r 　]*\n[{_W}]*)
    |(?P<open>[“«„「『《‹‘])|(?P<oparen>[(\[（【])
    |(?P<shut>[”»」』》›])|(?P<cparen>[)\]）】])
    |(?P<straight>"|(?<![\w.!?,;])'(?=\w)|(?<=\w)'(?![\w]))
    |(?P<thai>(?<=[ก-๛])[{_W}]+(?=[ก-๛]))""",
    re.X | re.S,
)

_CUT = re.compile(r"[^\W\d_](?=[^\W\d_])|[^\W\d_] (?=[^\W\d_])")

# Symbols: kind * 2 + (text since the event before).
_PARA, _OPEN, _OPEN_COLON, _SHUT, _OPAREN, _CPAREN, _RESET = range(7)
_STOP = 7  # + decision * 4 + closes a quotation * 2 + closes a bracket
_NEVER, _SURE, _QUOTED = range(3)
_KINDS = _STOP + 12
STATES = 16

#: Characters of a chunk of a long document, and of the context that its lexer sees on either side.
CHUNK, _CONTEXT = 1 << 16, 64


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """next state and whether a sentence ends, by state and symbol; state = start * 8 + quotation * 2 + bracket."""
    step, emit = np.zeros((STATES, _KINDS * 2), np.uint8), np.zeros((STATES, _KINDS * 2), bool)
    for state in range(STATES):
        for symbol in range(_KINDS * 2):
            start, quote, bracket = state >> 3, state >> 1 & 3, state & 1
            kind, text = symbol >> 1, symbol & 1
            start = start and not text
            end = False
            if kind == _RESET:
                start, quote, bracket = 1, 0, 0
            elif kind == _PARA:
                end = not start
                start, quote, bracket = 1, 0, 0
            elif kind in (_OPEN, _OPEN_COLON):
                if not quote:
                    quote = 2 if kind == _OPEN_COLON else 1 if start else 3
                start = 0
            elif kind == _SHUT:
                quote, start = 0, 0
            elif kind == _OPAREN:
                bracket, start = 1, 0
            elif kind == _CPAREN:
                bracket, start = 0, 0
            else:
                decision, shuts, closes = (kind - _STOP) >> 2, (kind - _STOP) >> 1 & 1, (kind - _STOP) & 1
                was = quote
                quote, bracket = 0 if shuts else quote, 0 if closes else bracket
                if decision == _SURE:
                    end = not quote and not bracket
                elif decision == _QUOTED:
                    end = was in (0, 2) and not quote and not bracket
                start = int(end)
            step[state, symbol] = int(start) * 8 + quote * 2 + bracket
            emit[state, symbol] = end
    return step, emit


STEP, EMIT = _compile()


def _caseless(c: str) -> bool:
    return c.isalpha() and c.lower() == c.upper()


def _cjk(c: str) -> bool:
    return "　" <= c <= "鿿" or "豈" <= c <= "﫿" or "＀" <= c <= "￯"


def _decide(text: str, at: int, stop: str, close: str, gap: str, after: str) -> int:
    """Whether a terminator may end a sentence: never, surely, or only if its quotation was announced."""
    marks = stop[: len(stop) - len(close)]
    first = after[:1]
    quoted = bool(close) and any(c in _QUOTES for c in close)
    if not first:
        return _SURE
    if gap.count("\n") > 1:
        return _SURE
    free = any(c in _FREE_STOPS for c in marks)
    if not free and not gap:
        # Sentences set without a space: a word or number, its mark, and a capital of another word.
        if marks[-1] in ".!?" and len(marks) <= 2 and (first.isupper() and after[1:2] and not after[1:2].isdigit() and after[1] != "." or first in "“«„¿¡"):
            lo = max(text.rfind(w, max(0, at - 40), at) for w in _W) + 1
            token = text[lo:at].strip("(«„“\"'‘[¿¡)»”’]")
            if re.fullmatch(r"[ap]\.m|[^\W\d_]*[^\W\d_]{2}|\d+(?:[.,]\d+)?|%", token) and token not in ABBREVIATIONS and (token[-1].islower() or token[-1].isdigit() or token == "%"):
                return _SURE
        return _NEVER
    if "…" in marks or marks.startswith(".."):
        # An ellipsis ends a sentence only where a capital follows.
        return _SURE if gap and (first.isupper() or first in "“\"«¿¡") else _NEVER
    if first in ",;:，、；：،؛%°-–—/=" or first in _QUOTES and first not in "\"'" or first in _BRACKETS:
        return _NEVER
    if first.islower():
        # iPSC, p53: names that begin small may open a sentence.
        if not (len(after) > 1 and (after[1].isupper() or after[1].isdigit())):
            return _NEVER
    if marks == "．" and at and text[at - 1].isdigit() and first.isdigit():
        return _NEVER
    if marks == "." and not close:
        lo = at
        while lo and at - lo < 24 and text[lo - 1] not in _W:
            lo -= 1
        token = text[lo:at].lstrip("(«„“\"'‘[¿¡")
        if token in ABBREVIATIONS:
            return _NEVER
        if token == "al" and first == "(":
            return _NEVER
        if token.isdigit() and len(token) <= 2:
            word = re.match(r"\w+", text[at + 1 + len(gap) : at + 13 + len(gap)])
            if word and word.group() in MONTHS:
                return _NEVER
            before = text[max(0, lo - 8) : lo].split()
            if before and before[-1] in _ORDINAL and first.isupper():
                return _NEVER
        elif len(token) == 1 and token.isalpha() or re.fullmatch(r"(?:[^\W\d]\.)+-?[^\W\d]", token):
            before = text[max(0, lo - 14) : lo].rstrip()
            if token in ("a.m", "p.m", "A.M", "P.M"):
                pass
            elif not (len(token) == 1 and before and before[-1].isdigit() and not _caseless(token)):
                return _NEVER
    if quoted and (not gap or _caseless(first)):
        return _QUOTED
    return _SURE


def _events(text: str, symbols: list, places: list, core: tuple[int, int] | None = None, base: int = 0, first: bool = True, last: bool = True, german: bool | None = None) -> None:
    """Append the text's events: a reset, then each event with the place just after it.

    core: the part of the text that is to be read, if it is a chunk with its context; base: the place
    of the text's beginning in the document; first, last: whether it is the document's first or last
    chunk. As chunks are cut between letters, no event lies across a cut.
    """
    lo, hi = core or (0, len(text))
    if first:
        symbols.append(_RESET * 2)
        places.append(0)
    german = "„" in text if german is None else german
    end, at = lo, lo
    for m in _EVENT.finditer(text):
        kind, at = m.lastgroup, m.start()
        if at < lo:
            continue
        if at >= hi:
            break
        if m.group("stop"):
            stop, close = m.group("stop"), m.group("close")
            d = _decide(text, at, stop, close, m.group("gap"), m.group("next"))
            shuts, closes = any(c in _QUOTES for c in close), any(c in _BRACKETS for c in close)
            kind, place = _STOP + d * 4 + shuts * 2 + closes, m.end("stop")
        elif m.group("para"):
            kind, place = _PARA, at
        elif (q := m.group("open") or m.group("straight")) is not None:
            before = text[max(0, at - 3) : at].rstrip(_W)
            opens = q != "“" or not german
            if m.group("straight"):
                opens = q == "'" and (at == 0 or not text[at - 1].isalnum()) or q == '"' and (at == 0 or text[at - 1] in _W + "(（[—–“„«¿¡")
            kind, place = (_OPEN_COLON if before.endswith((":", "：")) else _OPEN) if opens else _SHUT, m.end()
        elif m.group("oparen"):
            kind, place = _OPAREN, m.end()
        elif m.group("shut"):
            kind, place = _SHUT, m.end()
        elif m.group("cparen"):
            kind, place = _CPAREN, m.end()
        else:
            kind, place = _STOP + _SURE * 4, at
        between = text[end:at]
        spoken = bool(between) and not between.isspace() or not first and end == lo
        symbols.append(kind * 2 + spoken)
        places.append(base + place)
        end = m.end()
    if last:
        rest = text[end:]
        symbols.append(_PARA * 2 + (bool(rest.strip(_W)) or not first and end == lo))
        places.append(base + len(text.rstrip(_W)))


def cuts(text: str, size: int = CHUNK) -> list[int]:
    """Places between letters, about ``size`` characters apart, at which a text may be cut; from 0 to its length."""
    out = [0]
    while (m := _CUT.search(text, out[-1] + size)) is not None:
        out.append(m.end())
    return [*out, len(text)]


def chunk_events(text: str, lo: int, hi: int) -> tuple[list[int], list[int]]:
    """Events of one chunk of a text, read with its context alone."""
    symbols: list[int] = []
    places: list[int] = []
    begin = max(0, lo - _CONTEXT)
    part = text[begin : hi + _CONTEXT]
    _events(part, symbols, places, (lo - begin, hi - begin), begin, lo == 0, hi == len(text), "„" in text)
    return symbols, places


def chunk_function(symbols: np.ndarray) -> np.ndarray:
    """The state after a chunk, for each state before it."""
    state = np.arange(STATES, dtype=np.uint8)
    for x in symbols:
        state = STEP[state, x]
    return state


def ends_from(state: int, symbols: np.ndarray, places: np.ndarray) -> list[int]:
    """Where sentences end in a chunk that is entered in a state."""
    out = []
    for x, p in zip(symbols, places):
        if EMIT[state, x] and p:
            out.append(int(p))
        state = STEP[state, x]
    return out


def run_transducer(symbols: np.ndarray, block: int = 64) -> np.ndarray:
    """Which events end a sentence, from state 'start'; the same for every block length."""
    n = len(symbols)
    blocks = -(-n // block)
    padded = np.full(blocks * block, _RESET * 2, np.uint8)
    padded[:n] = symbols
    grid = padded.reshape(blocks, block)
    # Each block as a function of its first state.
    function = np.tile(np.arange(STATES, dtype=np.uint8), (blocks, 1))
    for j in range(block):
        function = STEP[function, grid[:, j : j + 1]]
    # Inclusive prefix scan: function[i] becomes that of blocks 0..i.
    shift = 1
    while shift < blocks:
        function[shift:] = np.take_along_axis(function[shift:], function[:-shift].astype(np.int64), axis=1)
        shift *= 2
    state = np.full(blocks, 8, np.uint8)
    state[1:] = function[:-1, 8]
    out = np.empty((blocks, block), bool)
    for j in range(block):
        out[:, j] = EMIT[state, grid[:, j]]
        state = STEP[state, grid[:, j]]
    return out.ravel()[:n]


def boundaries(texts: list[str]) -> list[list[int]]:
    """For each text the places just after its sentences."""
    symbols: list[int] = []
    places: list[int] = []
    first = []
    for t in texts:
        first.append(len(symbols))
        _events(t, symbols, places)
    first.append(len(symbols))
    if not symbols:
        return []
    ends = run_transducer(np.array(symbols, np.uint8))
    where = np.array(places)
    out = []
    for a, b in zip(first, first[1:]):
        out.append(sorted({int(p) for p in where[a:b][ends[a:b]] if p}))
    return out


_CHUNK_ROWS = "doc long, chunk int, text string, lo int, hi int, base int, first boolean, last boolean, german boolean"


def _cut_up(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for doc, text in zip(b.column("doc").to_pylist(), b.column("text").to_pylist()):
            at = cuts(text, size)
            rows = []
            for n, (lo, hi) in enumerate(zip(at, at[1:])):
                begin = max(0, lo - _CONTEXT)
                rows.append((doc, n, text[begin : hi + _CONTEXT], lo - begin, hi - begin, begin, lo == 0, hi == len(text), "„" in text))
            types = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[c.split()[0] for c in _CHUNK_ROWS.split(", ")])


def _lex(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for r in b.to_pylist():
            symbols: list[int] = []
            places: list[int] = []
            _events(r["text"], symbols, places, (r["lo"], r["hi"]), r["base"], r["first"], r["last"], r["german"])
            rows.append((r["doc"], r["chunk"], bytes(symbols), places, chunk_function(np.array(symbols, np.uint8)).tobytes()))
        if rows:
            types = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc", "chunk", "symbols", "places", "function"])


def _enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each chunk is entered, from all functions of its document."""
    for b in batches:
        rows = []
        for doc, chunks in zip(b.column("doc").to_pylist(), b.column("chunks").to_pylist()):
            function = np.stack([np.frombuffer(c["function"], np.uint8) for c in chunks])
            shift = 1
            while shift < len(function):
                function[shift:] = np.take_along_axis(function[shift:], function[:-shift].astype(np.int64), axis=1)
                shift *= 2
            rows += [(doc, c["chunk"], int(function[n - 1, 8]) if n else 8) for n, c in enumerate(chunks)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32()))], names=["doc", "chunk", "state"])


def _leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            ends = [ends_from(r["state"], np.frombuffer(r["symbols"], np.uint8), r["places"]) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(ends, pa.list_(pa.int32()))], names=["doc", "ends"])


def _long_ends(long: DataFrame, size: int) -> DataFrame:
    """(doc, ends) of long documents (doc, text), whose chunks are lexed in tasks of their own."""
    chunks = long.select("doc", "text").mapInArrow(lambda batches: _cut_up(batches, size), _CHUNK_ROWS)
    lexed = materialise(chunks.dropDuplicates(["doc", "chunk"]).mapInArrow(_lex, "doc long, chunk int, symbols binary, places array<int>, function binary"), "chunk-events")
    functions = lexed.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("chunk", "function"))).alias("chunks"))  # 16 bytes per chunk
    entered = functions.mapInArrow(_enter, "doc long, chunk int, state int")
    ends = lexed.join(entered, ["doc", "chunk"]).select("doc", "state", "symbols", "places").mapInArrow(_leave, "doc long, ends array<int>")
    return ends.groupBy("doc").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ends")))).alias("ends"))


def sentences(units: DataFrame, with_text: bool = False, chunk: int = CHUNK) -> DataFrame:
    """One row per sentence of the units (paper_id, section_idx, text): its number, start, end and, if asked for, text.

    Null, empty and blank texts give no rows; repeated rows give their sentences again; other columns
    are not read. Offsets are code points. White space between sentences belongs to none. Texts of more
    than ``chunk`` characters are spread over several tasks, with the same result.
    """
    schema = "paper_id long, section_idx int, sentence int, start_pos int, end_pos int" + ", text string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                ids, idx, texts = (b.column(c).to_pylist() for c in ("paper_id", "section_idx", "text"))
                known = b.column("ends").to_pylist() if "ends" in b.schema.names else boundaries(texts)
                cols: list[list] = [[], [], [], [], [], []]
                for i, s, t, ends in zip(ids, idx, texts, known):
                    start = 0
                    for n, e in enumerate(ends):
                        while start < e and t[start] in _W:
                            start += 1
                        for c, v in zip(cols, (i, s, n, start, e, t[start:e] if with_text else None)):
                            c.append(v)
                        start = e
                if cols[0]:
                    types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                    names = ["paper_id", "section_idx", "sentence", "start_pos", "end_pos", "text"]
                    k = 5 + with_text
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:k], types)], names=names[:k])

    rows = units.where(F.col("text").isNotNull()).select(F.col("paper_id").cast("long").alias("paper_id"), F.col("section_idx").cast("int").alias("section_idx"), "text")
    if (rows.agg(F.max(F.length("text"))).head()[0] or 0) <= chunk:
        return rows.mapInArrow(run, schema)
    long = rows.where(F.length("text") > chunk).withColumn("doc", F.xxhash64("text", F.lit(1)))
    joined = long.join(_long_ends(long, chunk), "doc").select("paper_id", "section_idx", "text", "ends")
    return rows.where(F.length("text") <= chunk).mapInArrow(run, schema).unionByName(joined.mapInArrow(run, schema))
