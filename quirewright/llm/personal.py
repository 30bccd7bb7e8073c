"""Personal data in free text: found as spans and replaced by placeholders of their kind.

Plan. Generators with high recall propose overlapping spans; boosted trees score each from its format
and context; spans that pass their kind's calibrated threshold compete, and the best of overlapping
ones wins. The trees are trained on the driver on invented examples, ``train_rows`` at most, set into
neutral text; thresholds come from held-out examples. Any two capitalised words may be a name: a list of
given names and the words' frequencies in all documents are features of the trees. Words are counted in
one pass, in which each task adds up its own; those that stand in one of 20,000 documents or more are
broadcast, ``frequent`` of them at most, and the others count as rare. Documents are scored where they lie.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewright.llm.boosting import Boosted, calibrate
from quirewright.plans.storage import materialise

KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "PERSON")

#: Common given names of several countries.
GIVEN = """Adam Alice Alicia Amelie Ana Andrea Andreas Andrew Angela Anna Anne Antoine Antonio Beatrice Beatriz Benjamin
Bernard Camille Carla Carlos Carmen Caroline Catherine Charles Charlotte Christian Christine Claire Clara Claudia Daniel
David Diana Diego Dieter Dirk Edward Elena Elisa Elizabeth Emily Emma Eric Eva Felix Fernando Francesca Francois Frank
Franz Gabriel George Georg Gerhard Greta Guillaume Hannah Hans Heike Heinrich Helen Helena Helga Henri Henry Hugo Ingrid Irene
Isabel Jack Jacques James Jane Javier Jean Jens Joan Johanna John Jonas Jorge Jose Joseph Juan Julia Julie Jürgen Karin Karl
Katrin Klaus Lars Laura Leon Linda Louis Louise Lucas Lucia Lucie Luis Lukas Manuel Marc Marco Margaret Maria Marie Mark
Marta Martin Mary Mathieu Matthias Maximilian Michael Miguel Monika Nadia Nicolas Nicole Nina Nora Olga Oliver Olivier Oscar
Pablo Patricia Paul Paula Pedro Peter Petra Philip Pierre Rachel Ralf Raul Rebecca Richard Robert Rosa Ruth Samuel Sandra Sara
Sarah Silvia Simon Sofia Sophie Stefan Stephanie Susan Susanne Sven Teresa Theo Thomas Uwe Victor Victoria Walter Wolfgang""".split()
#: Words that make a name one of a place, a data set or a method.
NOT_FAMILY = frozenset(
    """basin forest kernel river lake valley ridge bay island mountain mount creek canyon desert glacier corpus dataset database archive collection
    library institute university college press test tests index score scale model method algorithm survey project street road lane avenue court terrace
    square bridge tower station hospital museum foundation award prize medal lecture effect law theorem lemma process filter transform distribution
    field fields network machine sampler estimator weights criterion inventory treebank benchmark plateau peninsula reservoir harbour harbor county city
    park gorge trench shelf fault formation group set cohort study trial protocol""".split()
)
_PARTICLE = r"(?:(?:van|von|de|del|della|di|da|du|dos|la|le|der|den|ten|ter|zu|zum|zur|bin|al|VAN|VON|DE|DEL|DI|DA|DU|LA|LE|DER|DEN)\s+){0,2}"
_FAMILY = r"[A-ZÀ-ÖØ-Þ][^\W\d_]+(?:['’][A-ZÀ-Þ][^\W\d_]+)?(?:-[A-ZÀ-ÖØ-Þ][^\W\d_]+)?"
_NAMES = "|".join(sorted({*GIVEN, *(g.upper() for g in GIVEN)}, key=lambda g: (-len(g), g)))
_CAPITAL = re.compile(r"\b[A-Z][^\W\d_]+")
_GIVEN = frozenset({*GIVEN, *(g.upper() for g in GIVEN)})
_AFTER = re.compile(rf"(?:-(?:{_NAMES}))?(?:[ \t ]+(?:{_NAMES}))?(?:[ \t ]+[A-ZÀ-Þ]\.)*[ \t ]+{_PARTICLE}({_FAMILY})")
_BEFORE = re.compile(rf"(?<![\w.@/-])((?:(?:van|von|der|den|ten|ter|zu|VAN|VON)\s+){{0,2}}{_FAMILY}),\s+$")
_MIDDLE = re.compile(r"(?:\s+[A-ZÀ-Þ]\.)*")

#: Capitalised words that begin sentences, titles and roles, marks of companies, and words before places.
_STARTERS = frozenset(
    """a all although an and any as at because before both but by contact dear each every for from had has he her his how if in is it its many most neither no nor not of on once one only or our
    return samples see send she signed so some that the their then there these they this those to under until we were what when where whether which while who why with you à aucune au aux après ce
    cette chaque de des du elle en et il la le les leur mais ni pour quand que quel quelle sans selon si son sur un une am an auf aus bei das dem den der des die ein eine einen einer es für gilt im
    ist jede jeder kein keine laut manche mit nach nur ob seither sie und vgl von vor wenn wir zu al alguna cada como con del el ella ese esta este los las ningún ninguna para pero por según sin su tras y""".split()
)
_TITLES = frozenset("mr mrs ms miss dr prof professor sir dame lady lord mme mlle m mm madame monsieur maître herr hr frau fr fräulein sr sra srta señor señora don doña professorin doktor doctor president director dean participant".split())
_COMPANY = frozenset("ltd inc gmbh ag corp co llc plc sa sarl bv group press university institute laboratories".split())
_PLACES = frozenset("in at near from to of à de près bei nach von aus en cerca lane street road avenue court terrace square drive".split())
_FIRST = r"[^\W\d_a-zß-öø-ÿ]"  # capitals of all scripts are among these
_NAME = rf"{_FIRST}(?:['’]{_FIRST})?[^\W\d_]+(?:['’]{_FIRST}[^\W\d_]+)?(?:-{_FIRST}[^\W\d_]+)*"
_PAIR = re.compile(rf"{_FIRST}(?<![\w@/.'’-].)(?=(?<=(.))((?:['’]{_FIRST})?[^\W\d_]+(?:['’]{_FIRST}[^\W\d_]+)?(?:-{_FIRST}[^\W\d_]+)*)(?:(?:[ \t\u00a0]+{_FIRST}\.)*[ \t\u00a0]+{_PARTICLE}({_NAME})|,[ \t\u00a0]+({_NAME})(?:[ \t\u00a0]+{_FIRST}\.)*)(?![\w@]))")

_LOCAL = r"[A-Za-z0-9_](?:[A-Za-z0-9_.+%-]*[A-Za-z0-9_+])?"
_DOT = r"(?:\s*[\[({<]\s*(?:dot|punkt|point|punto)\s*[\])}>]\s*|\s+(?:dot|DOT|punkt|punto)\s+|\.)"
_EMAIL = re.compile(rf"{_LOCAL}(?:[@＠]|\s*[\[({{<]\s*(?:at|AT|@|arroba)\s*[\])}}>]\s*|\s+(?:at|AT)\s+(?=[\w-]+\s+(?:dot|DOT)\b))[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}")
_EMAIL_HINT = re.compile(r"[@＠]|[\[({<]\s*(?:at|AT|arroba)\s*[\])}>]|\b(?:dot|DOT)\b")
_DIGITS = re.compile(r"(?<![\w.,/@-])(?:\+|\(\+?)?\d[\d\s().\-–/]{4,24}\d(?![\w@])|(?<![\w@/-])\+\d[\d\s().\-–]{6,24}\d(?!\w)")
_ID = re.compile(
    r"(?<![\w/@.-])(?:[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]|[A-Z]\d{2}[A-Z]\d{5}|[CFGHJKLMNPRTVWXYZ][CFGHJKLMNPRTVWXYZ0-9]{7,9}|\d{8}\s?-?\s?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|\d{3}[-\s]\d{2}[-\s]\d{4}|\d{2}\s\d{3}\s\d{3}\s\d{3}|[12378]\s?\d{2}\s?\d{2}\s?\d[\dAB]\s?\d{3}\s?\d{3}\s?\d{2}|[A-Z]{1,2}\d{6,8}|\d{9})(?![\w-])"
)
_TOWN = r"(?:(?:New|San|Santa|Saint|St\.?|Los|Las|Bad|Le|La|El|North|South|East|West|Port|Fort|Mount)\s+)?[A-ZÀ-Þ][^\W\d_]+(?:-[^\W\d_]+)*"
_POST = r"(?:[A-Z]{1,2}\d{1,2}[A-Z]?\s+\d[A-Z]{2}|[A-Z]{2}\s+\d{5}(?:-\d{4})?|\d{5})"
_ROAD = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Court|Ct|Terrace|Drive|Dr|Close|Way|Crescent|Place|Pl|Square|Sq|Boulevard|Blvd|Gardens|Grove|Row|Walk|Hill|Park|Mews)"
_ADDRESS = re.compile(
    rf"""(?<![\w,.-])(?:
    (?:(?:Flat|Apt|Apartment|Unit|Suite)\.?\s+\d+[A-Za-z]?,\s*)?\d{{1,5}}[A-Za-z]?\s+(?:[A-Z][^\W\d_'’]+\s+){{1,3}}{_ROAD}\b\.?(?:,?\s*(?:Apt|Flat|Unit|Suite|Apartment)\.?\s+\d+[A-Za-z]?)?,\s*(?:{_TOWN})(?:,?\s+{_POST})?
    |[A-ZÄÖÜ][^\W\d_]*(?:straße|strasse|str\.|gasse|weg|platz|allee|ring|ufer|damm)\s+\d{{1,4}}\s?[a-z]?,\s*\d{{5}}\s+{_TOWN}
    |\d{{1,4}}(?:\s+(?:bis|ter|quater))?,?\s+(?:rue|avenue|boulevard|bd|place|impasse|chemin|allée|quai|route|cours)\s+(?:[^\W\d_]+['’\s]\s?){{0,3}}[A-ZÀ-Þ][^\W\d_]+,\s*\d{{5}}\s+{_TOWN}
    |(?:Calle|C/|Avda\.?|Avenida|Plaza|Paseo|Camino|Ronda|Travesía)\s+(?:[^\W\d_]+\s+){{0,3}}[A-ZÀ-Þ][^\W\d_]+,\s*(?:n\.?º\s*)?\d{{1,4}}(?:,\s*\d+\.?º\s*\w*)?,\s*\d{{5}}\s+{_TOWN}
    )""",
    re.X,
)
_UPPER_ADDRESS = re.compile(_ADDRESS.pattern, re.X | re.I)
_ADDRESS_HINT = re.compile(r"\d[A-Za-z]?,?\s+(?:[A-Z][^\W\d_]+\s+){1,3}(?:Str|St|R[od]|L[an]|Av|C[tolr]|Te|Dr|Wa|Pl|Sq|Bou|Blv|Ga|Gro|Hi|Pa|Me)|\s\d{5}\s+[A-ZÀ-Þ]")

#: Words near phone numbers, near identity numbers, and near numbers of other kinds.
_PHONE_WORDS = frozenset("tel tél phone telephone téléphone telefon teléfono móvil mobile mobil call ring reached reach fax voice contact text sms appeler joindre llamar anrufen erreichbar linked whatsapp handy or oder ou".split())
_ID_WORDS = frozenset("passport id ids file no nr identity national social security insurance ssn nino nhs dni nie nif insee sécurité sociale numéro número number ausweis personalausweis reisepass pass passeport pasaporte steuer record form consent carries lleva porte participant".split())
_OTHER_WORDS = frozenset("isbn issn lot kit issue build version release accession arxiv doi grant vol pp page pages reads pairs rows order batch sku ticket commit bug patent eq fig tab ref covers years".split())
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^\W\d_]{4,}[.!?。]\s*|\n\n")


@dataclass(frozen=True)
class Found:
    start: int
    end: int
    kind: int
    form: int


def candidates(text: str) -> list[Found]:
    """Overlapping spans that may be personal data; form tells which generator proposed them."""
    out = []
    seen = 0
    for hint in _EMAIL_HINT.finditer(text):
        if hint.start() >= seen:
            for m in _EMAIL.finditer(text, max(seen, hint.start() - 80), hint.end() + 160):
                out.append(Found(*m.span(), 0, 0 if "@" in m.group() else 1))
                seen = m.end()
    for m in _DIGITS.finditer(text):
        a, b = m.span()
        s = m.group()
        if s.count("(") < s.count(")"):
            continue
        cut = s.find("\n\n")
        if cut > 0:
            b, s = a + len(s[:cut].rstrip()), s[:cut].rstrip()
        if s.startswith("(") and ")" not in s:
            a, s = a + 1, s[1:]
        if s.count("(") != s.count(")"):
            continue
        if 7 <= sum(c.isdigit() for c in s) <= 15:
            out.append(Found(a, b, 1, 2))
    out += [Found(*m.span(), 2, 3) for m in _ID.finditer(text)]
    if text.isupper():
        out += [Found(*m.span(), 3, 4) for m in _UPPER_ADDRESS.finditer(text)]
    elif _ADDRESS_HINT.search(text):
        out += [Found(*m.span(), 3, 4) for m in _ADDRESS.finditer(text)]
    for m in _CAPITAL.finditer(text):
        if m.group() not in _GIVEN:
            continue
        a, b = m.span()
        if after := _AFTER.match(text, b):
            end = after.end()
            out.append(Found(a, end, 4, 5))
        back = _BEFORE.search(text, max(0, a - 48), a)
        if back:
            # A middle initial belongs to the name; the next word's full stop doesn't.
            tail = _MIDDLE.match(text, b)
            out.append(Found(back.start(1), tail.end() if tail else b, 4, 6))
    known = {(f.start, f.end) for f in out if f.kind == 4}
    for m in _PAIR.finditer(text):
        last = 3 if m[3] else 4
        if _capital(m[1]) and _capital(m[last][0]) and (m.start(), m.end(last)) not in known:
            out.append(Found(m.start(), m.end(last), 4, 4 + last))
    return out


def _capital(c: str) -> bool:
    return c.isupper() or c.istitle()


def frequencies(docs: DataFrame, frequent: int = 100_000) -> dict[str, tuple[float, float]]:
    """The lower-case share and the logarithmic frequency of words in all documents (text); words of fewer than 4 documents, or of fewer than one in 20,000, are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small, great = Counter(), Counter()
        n = 0

        def given() -> pa.RecordBatch:
            words = [None, *(small.keys() | great.keys())]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([n if w is None else small[w] for w in words], pa.int64()), pa.array([0 if w is None else great[w] for w in words], pa.int64())], names=["word", "small", "great"])
            small.clear()
            great.clear()
            return out

        for b in batches:
            for t in b.column(0).to_pylist():
                words = set(_WORD.findall(t))
                low = {w for w in words if w.islower()}
                small.update(low)
                great.update([w.lower() for w in words - low])
                n += 1
            if len(small) + len(great) > 400_000:
                yield given()
                n = 0
        yield given()

    counted = docs.where(F.length("text") > 0).select("text").mapInArrow(count, "word string, small long, great long").groupBy("word").agg(F.sum("small").alias("small"), F.sum("great").alias("great"))
    counted = materialise(counted, "document-words")
    total = (counted.where(F.col("word").isNull()).head() or {"small": 0})["small"] or 0
    n = F.col("small") + F.col("great")
    rows = counted.where(F.col("word").isNotNull() & (n >= max(4, -(-total // 20_000)))).orderBy(n.desc(), "word").limit(frequent).collect()
    return {r["word"]: (r["small"] / k, float(np.log1p(1e4 * (k - 3) / (total + 1000)))) for r in rows if (k := r["small"] + r["great"])}


_SHAPES = [
    re.compile(p)
    for p in (
        r"\+\d{1,3}\D?.{6,}", r"\(\d{3}\) \d{3}-\d{4}", r"\d{3}[.-]\d{3}[.-]\d{4}", r"0\d(?:[ .]\d\d){4}", r"0\d{2,4} \d{3,5} \d{3,4}", r"0\d{2,4}[ /-]\d{4,8}", r"\d{3}[- ]\d{2}[- ]\d{4}",
        r"[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]", r"[A-Z]\d\d[A-Z]\d{5}", r"\d\d \d{3} \d{3} \d{3}", r"[12] ?\d\d ?\d\d ?\d[\dAB] ?\d{3} ?\d{3} ?\d\d", r"\d{8}-?[A-Z]", r"[XYZ]-?\d{7}-?[A-Z]", r"\d{4}[-–]\d{4}", r"97[89][- ][\d -]{10,}",
        r"\d{1,3}(?: \d{3})+", r"[A-Z]{1,2}\d{6,8}", r"\d+(?:\.\d+){2,}", r"\d{3}[- ]\d{4}", r"\d{4}\.\d{4,5}", r"\d{9}",
    )
]


_PAIR_FEATURES = 18


def features(text: str, f: Found, common: dict[str, tuple[float, float]] | None = None) -> list[float]:
    """Format and context of a candidate; the last _PAIR_FEATURES only of open pairs. common: the frequencies of words."""
    s = text[f.start : f.end]
    left, right = text[max(0, f.start - 48) : f.start], text[f.end : f.end + 32]
    # Only the same sentence speaks of the candidate; the next word counts only where it follows at once.
    before = [w.lower() for w in _WORD.findall(_SENTENCE.split(left)[-1])][-4:]
    after = [w.lower() for w in _WORD.findall(right)][:1] if re.match(r"\s+[^\W\d_]", right) else []
    flat = re.sub(r"\s+", " ", s)
    words = _WORD.findall(s)
    family = (words[0] if f.form in (6, 8) else words[-1]).lower() if words else ""
    near = lambda known: float(f.kind in (1, 2) and sum(w in known for w in before))
    digits = sum(c.isdigit() for c in s)
    out = [float(f.kind == k) for k in range(len(KINDS))] + [float(f.form), 0 if f.kind == 4 else len(s), digits, digits / len(s), 0 if f.kind == 4 else len(words), s.count("\n"), s.count("@"), s.count(",")]
    out += [0.0] * len(_SHAPES) if f.kind == 4 else [float(bool(p.fullmatch(flat))) for p in _SHAPES]
    out += [near(_PHONE_WORDS), near(_ID_WORDS), float(f.kind in (1, 2) and any(w in _OTHER_WORDS for w in before[-2:])), float(f.kind in (1, 2) and bool(after) and after[0] in _OTHER_WORDS)]
    out += [float(family in NOT_FAMILY), float(bool(after) and after[0] in NOT_FAMILY), float(right[:1].isalnum()), float(right[:1] == "-"), float(left[-1:] in "-/@#._" and left != ""), float(left.endswith(":")), float(right[:1] == "@")]
    out += [float(right.startswith("-") and right[1:2].isupper()), float(bool(re.search(r"\b(?:the|The|THE)\s+$", left)))]
    if f.form < 7:
        return out + [0.0] * _PAIR_FEATURES
    given = words[-1] if f.form == 8 else words[0]
    g, first = given.lower(), words[0].lower()
    (g_low, g_often), (f_low, f_often) = ((common or {}).get(w, (0.0, 0.0)) for w in (g, family))
    last = before[-1] if before and re.search(r"[^\W\d_]\W*$", left) else ""
    start = not left.strip() or left.rstrip()[-1] in ".!?:;“”\"»"
    return out + [
        float(given in _GIVEN), float(words[-1] in _GIVEN if f.form != 8 else words[0] in _GIVEN), g_low, g_often, f_low, f_often, float(g in _STARTERS or first in _STARTERS), float(family in _STARTERS),
        float(first in _TITLES or family in _TITLES), float(family in _COMPANY or bool(after) and after[0] in _COMPANY), float(last in _PLACES), float(start), float(len(given) < 3 or len(family) < 3), float(bool(re.search(rf"\b{_FIRST}\.\s*$", left))), float(g in NOT_FAMILY), float(s.isupper()), float(right[:1] == ":"), float(any(w.islower() for w in words[1:-1])),
    ]


def _examples(n: int, seed: int) -> tuple[list[tuple[str, Found]], list[int]]:
    """Invented candidates in context, with their labels; n at most."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    pick = r.choice
    syll = "ar bel cor den el far gil hol ist jor kal lan mer nor os pel quin ros sel tam ul ven wex yar zel".split()
    name = lambda: (pick(syll) + pick(syll) + pick(["", "son", "er", "man", "berg", "ley"])).capitalize()
    town = lambda: (pick(syll) + pick(["ton", "ham", "ville", "dorf", "by", "ford", "stadt"])).capitalize()
    letter = lambda: pick("ABCDEFGHJKLMNPRSTWXYZ")
    given = lambda: pick(GIVEN)
    family = lambda: pick([name(), name(), name() + "-" + name(), "van " + name(), "de " + name()])
    phone = [lambda: f"+44 7{d(3)} {d(6)}", lambda: f"+447{d(9)}", lambda: f"+1 {d(3)}-{d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"0{d(2)} {d(4)} {d(4)}", lambda: f"0{d(2)} {d(5)} {d(3)}", lambda: "0" + pick("123456789") + "".join(pick(" ") + d(2) for _ in range(4)), lambda: "0" + pick("123456789") + "".join("." + d(2) for _ in range(4)), lambda: f"+33 {pick('123456')} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"+49 (0){d(2)} {d(5)}-{d(3)}", lambda: f"+49 {d(3)} {d(7)}", lambda: f"+34 {d(3)} {d(2)} {d(2)} {d(2)}"]
    ids = [lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{d(3)} {d(2)} {d(4)}", lambda: f"{d(2)} {d(3)} {d(3)} {d(3)}", lambda: f"{letter()}{letter()} {d(2)} {d(2)} {d(2)} {pick('ABCD')}", lambda: f"{letter()}{letter()}{d(6)}{pick('ABCD')}", lambda: pick("12") + d(14), lambda: f"{pick('12')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", lambda: f"{pick('CFGHJKLX')}{d(2)}{letter()}{d(5)}", lambda: f"{d(8)}{letter()}", lambda: f"{d(8)}-{letter()}", lambda: f"{pick('XYZ')}{d(7)}{letter()}"]
    numbers = [lambda: f"978-{d(1)}-{d(3)}-{d(5)}-{d(1)}", lambda: f"979-{d(1)}-{d(3)}-{d(5)}-{d(1)}", lambda: f"{d(3)}-{d(2)}-{d(5)}", lambda: f"1{d(3)}-2{d(3)}", lambda: f"{d(2)} {d(3)} {d(3)}", lambda: f"{d(1)} {d(3)} {d(3)}", lambda: f"{d(3)}-{d(4)}", lambda: f"{d(2)}.{d(2)}.{d(1)}.{d(2)}", lambda: f"{d(4)}.{d(5)}", lambda: d(7), lambda: d(8), lambda: f"{letter()}{d(6)}", lambda: f"{letter()}{letter()} {d(2)} {d(2)} {d(3)}", lambda: f"{d(2)}-{d(3)}", lambda: f"{d(2)} {d(2)} {d(3)}", lambda: d(9), lambda: f"{d(4)}-{d(2)}-{d(2)}"]
    plain = "the sample was measured again and results were stable over time we found that model values remain open under field conditions while other groups did not respond".split()
    words = lambda k: " ".join(pick(plain) for _ in range(k))
    rows, labels = [], []

    def add(left: str, s: str, right: str, kind: int, form: int, label: int) -> None:
        rows.append((left + s + right, Found(len(left), len(left) + len(s), kind, form)))
        labels.append(label)

    while len(rows) < n:
        left = words(3) + pick([" ", f" {pick(sorted(_OTHER_WORDS | _ID_WORDS | _PHONE_WORDS))} "]) + words(2) + " "
        right = pick([" ", ". ", ", ", ") ", "; "]) + words(4)
        use = lambda bag: pick([pick(sorted(bag)) + pick([" ", ": ", ". "]), "", "", words(1) + " "])  # noqa: E731,B023
        add(left + use(_PHONE_WORDS), pick(phone)(), right, 1, 2, 1)
        add(left + use(_ID_WORDS), s := pick(ids)(), right, 2, 3, 1)
        if re.fullmatch(r"[\d\s-]+", s):
            add(left + use(_ID_WORDS), s, right, 1, 2, 0)
        other = pick(numbers)()
        tail = pick([right, " " + pick(["reads", "pairs", "rows", "years"]) + " " + words(3)])
        lead = left + use(_OTHER_WORDS)
        add(lead, other, tail, 1, 2, 0)
        add(lead, other, tail, 2, 3, 0)
        add(left + pick(["isbn ", "lot ", "grant GR-", "issue ", "arXiv:", "kit ", "build "]), pick(ids + phone)(), right, *pick([(1, 2), (2, 3)]), 0)
        g, f = given(), family()
        person = pick([f"{g} {f}", f"{g} {letter()}. {f}", f"{g.upper()} {f.upper()}"])
        add(left + pick(["", "by ", "Contact: ", "Dr. ", "for ", "thank "]), person, right, 4, 5, 1)
        add(left, f"{f}, {g}", right, 4, 6, 1)
        add(left + pick(["the ", "The ", ""]), f"{g} {pick(sorted(NOT_FAMILY)).capitalize()}", right, 4, 5, 0)
        add(left + pick(["the ", "The ", "and "]), f"{g} {name()}", " " + pick(sorted(NOT_FAMILY)) + right, 4, 5, 0)
        add(left, f"{name()}, {g}", pick(["-" + name(), " " + pick(sorted(NOT_FAMILY))]) + right, 4, 6, 0)
        host = f"{name().lower()}.{pick(['com', 'org', 'edu', 'net', 'de', 'fr'])}"
        add(left, f"{name().lower()}@{host}", right, 0, 0, 1)
        add(left, f"{name().lower()} {pick(['(at)', '[at]'])} {host}", right, 0, 1, 1)
        road = pick([f"{d(2)} {name()} {pick(['Street', 'Road', 'Lane', 'Ave.'])}, {town()}", f"{name()}straße {d(2)}, {d(5)} {town()}", f"{d(2)}, rue de la {name()}, {d(5)} {town()}", f"Calle de la {name()}, {d(2)}, {d(5)} {town()}"])
        add(left + pick(["address: ", "at ", ""]), road, right, 3, 4, 1)
    return rows[:n], labels[:n]


def _pair_examples(n: int, seed: int) -> tuple[list[tuple[str, Found, dict]], list[int]]:
    """Invented pairs of capitalised words in context, with the frequencies of their words and their labels; n at most."""
    r = random.Random(seed)
    pick = r.choice
    syll = "ar bel cor den el far gil hol ist jor kal lan mer nor os pel quin ros sel tam ul ven wex yar zel".split()
    name = lambda: (pick(syll) + pick(syll) + pick(["", "a", "son", "er", "man", "berg", "ley"])).capitalize()
    noun = lambda: (name() + pick(["ung", "e", "en", ""])).capitalize()
    town = lambda: (pick(syll) + pick(["ton", "ham", "ville", "dorf", "by", "ford", "stadt"])).capitalize()
    letter = lambda: pick("ABCDEFGHJKLMNPRSTWXYZ")
    closing = lambda: pick(sorted(NOT_FAMILY | _COMPANY))
    plain = "the sample was measured again and results were stable over time we found that model values remain open under field conditions while other groups did not respond".split()
    words = lambda k: " ".join(pick(plain) for _ in range(k))
    rows, labels = [], []

    def add(left: str, s: str, right: str, form: int, label: int, kinds: str) -> None:
        """kinds: for the first and the last word, c a common one, n a noun that is always capitalised, r a rare name, f a name of any frequency."""
        often = {}
        small = lambda: pick([0.0, 0.0, r.uniform(0, 0.15)])  # noqa: E731 - names stand in small letters in addresses
        for w, k in zip((s.split()[0].strip(",").lower(), s.split()[-1].lower()), kinds):
            often[w] = {"c": (r.uniform(0.2, 1), r.uniform(0, 9)), "n": (pick([0.0, 0.0, 0.1]), r.uniform(5, 9)), "r": (small(), pick([0.0, r.uniform(0, 3.2)])), "f": (small(), r.uniform(0, 5.3))}[k]
        rows.append((left + s + right, Found(len(left), len(left) + len(s), 4, form), often))
        labels.append(label)

    while len(rows) < n:
        left, right = words(5) + " ", pick([" ", ". ", ", ", ") ", "; "]) + words(4)
        # The same contexts for names and others, so that the words decide.
        place = lambda: pick([left, left, left.rstrip() + ". ", left.rstrip() + ".\n\n", "", *(left + c for c in ("by ", "Contact: ", "Dr. ", "for ", "with ", "of ", "Contact ", "and "))])  # noqa: E731,B023
        for _ in range(3):
            stranger = f"{name()} {pick(['', '', letter() + '. '])}{name()}"
            add(place(), pick([stranger, stranger, stranger.upper(), f"{pick(GIVEN)} {name()}"]), right, 7, 1, pick(["rr", "fr", "ff", "rf"]))
            add(place(), f"{pick([name(), name().upper()])}, {pick([name(), name(), pick(GIVEN)])}", right, 8, 1, pick(["rr", "rf", "ff", "fr"]))
        starter, title = pick(sorted(_STARTERS)).capitalize(), pick(sorted(_TITLES)).capitalize()
        add(place(), f"{starter} {name()}", right, 7, 0, pick(["cr", "cc", "cn", "rr"]))
        add(place(), f"{name()} {starter}", right, 7, 0, pick(["rc", "rr"]))
        add(place(), f"{noun()} {noun()}", right, 7, 0, pick(["cc", "cr", "rc", "nn", "cn", "nr", "rn"]))
        add(place(), f"{noun()} {pick(['der', 'de', 'del', 'la'])} {noun()}", right, 7, 0, pick(["nn", "nr", "cr", "cn"]))
        for _ in range(2):  # a thing of a place; in few documents its noun isn't known to be common
            add(place(), f"{noun()} {pick(['von', 'von', 'de', 'di', 'du'])} {town()}", right, 7, 0, pick(["nr", "cr", "rr", "fr", "ff"]))
        add(place(), f"{pick([name(), pick(GIVEN)])} {pick(['van', 'von', 'de', 'di', 'der', 'del'])} {name()}", right, 7, 1, pick(["rr", "fr", "ff", "rf"]))
        add(place(), f"{noun()} {noun()}".upper(), right, 7, 0, pick(["cc", "cr", "rc", "nn"]))
        add(place(), f"{noun()} {noun()}".upper(), ":" + right, 7, 0, pick(["rr", "ff", "rf"]))
        add(place(), f"{title} {name()}", right, 7, 0, pick(["rr", "nr", "cr"]))
        add(place(), f"{name()} {closing().capitalize()}", right, 7, 0, pick(["rr", "rc", "rn"]))
        add(place(), f"{name()} {name()}", f" {closing()}{right}", 7, 0, "rr")
        add(place(), f"{name()} {pick(GIVEN)}", right, 7, 0, pick(["cr", "rr", "nr"]))
        add(left + pick(["the ", "The "]), f"{name()} {name()}", right, 7, 0, "rr")
        add(place(), f"{noun()}, {noun()}", right, 8, 0, pick(["nn", "cc", "nr", "rn", "cr", "rc"]))
        add(place(), f"{town()}, {pick(['ZZ', letter() + letter(), 'Ph'])}", right, 8, 0, "rr")
        add(place(), f"{starter}, {name()}", right, 8, 0, "cr")
        add(place(), f"{closing().capitalize()}, {town()}", right, 8, 0, "rr")
        add(left + pick(sorted(_PLACES)) + " ", f"{town()}, {town()}", right, 8, 0, "rr")
        add(left + f"{letter()}. ", f"{name()}, {name()}", right, 8, 0, "rr")
    return rows[:n], labels[:n]


@dataclass(frozen=True)
class Models:
    """Trees for all but open pairs, and for those; the latter also see lists and frequencies of words."""

    listed: Boosted
    pairs: Boosted

    def predict(self, found: list[Found], x: np.ndarray) -> np.ndarray:
        open_pair = np.array([f.form >= 7 for f in found], bool)
        p = np.zeros(len(found))
        p[~open_pair] = self.listed.predict(x[~open_pair, :-_PAIR_FEATURES])
        p[open_pair] = self.pairs.predict(x[open_pair])
        return p


@lru_cache
def train(train_rows: int = 9_000, seed: int = 5) -> tuple[Models, tuple[float, ...]]:
    """The trees and each kind's threshold, the last for open pairs; both from at most train_rows invented examples, a third of them held out."""
    rows, labels = _examples(train_rows, seed)
    x, y = np.array([features(t, f)[:-_PAIR_FEATURES] for t, f in rows]), np.array(labels)
    kind = np.array([f.kind for _, f in rows])
    fit = np.arange(len(y)) % 3 != 0
    model = Boosted(trees=40, depth=4).fit(x[fit], y[fit])
    p = model.predict(x[~fit])
    cuts = []
    for k in range(len(KINDS)):
        own = kind[~fit] == k
        cuts.append(calibrate(p[own], y[~fit][own]) if len(set(y[~fit][own])) > 1 else 0.5)  # 0.5 where there are no counter-examples
    rows, labels = _pair_examples(train_rows, seed)
    x, y = np.array([features(*row) for row in rows]), np.array(labels)
    fit = np.arange(len(y)) % 3 != 0
    pairs = Boosted(trees=80, depth=4).fit(x[fit], y[fit])
    return Models(model, pairs), (*cuts, calibrate(pairs.predict(x[~fit]), y[~fit]))


def choose(text: str, found: list[Found], p: np.ndarray, cuts: tuple[float, ...]) -> list[Found]:
    """The spans that pass, without overlaps: addresses and e-mails first, pairs without a listed name last, and the likelier and longer before others."""
    good = [(f.kind not in (0, 3), f.form >= 7, -round(float(q), 2), f.start - f.end, f) for f, q in zip(found, p) if q >= (cuts[-1] if f.form >= 7 else cuts[f.kind])]
    starts: list[int] = []
    out: list[Found] = []
    for *_, f in sorted(good, key=lambda g: g[:4] + (g[4].start,)):
        i = bisect_left(starts, f.start)
        if (i == 0 or out[i - 1].end <= f.start) and (i == len(out) or out[i].start >= f.end):
            starts.insert(i, f.start)
            out.insert(i, f)
    return out


def _score(docs: DataFrame, schema: str, emit, train_rows: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((*train(train_rows), frequencies(docs)))
    names = [c.split()[0] for c in schema.split(", ")]
    types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cuts, common = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
                found = [candidates(t) for t in texts]
                x = [features(t, f, common) for t, fs in zip(texts, found) for f in fs]
                p = model.predict([f for fs in found for f in fs], np.array(x)) if x else np.array([])
                rows, at = [], 0
                for i, t, fs in zip(ids, texts, found):
                    rows += emit(i, t, choose(t, fs, p[at : at + len(fs)], cuts))
                    at += len(fs)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*rows), types)], names=names)

    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, schema)


def personal_spans(docs: DataFrame, train_rows: int = 9_000) -> DataFrame:
    """(doc_id, kind, start_pos, end_pos) of personal data in documents (doc_id, text).

    Null and empty texts give no rows, nor does an empty table; repeated rows give their spans again;
    other columns are not read. Offsets are code points, ends exclusive.
    """
    emit = lambda i, t, fs: [(i, KINDS[f.kind], f.start, f.end) for f in fs]
    return _score(docs, "doc_id long, kind string, start_pos int, end_pos int", emit, train_rows)


def redact(docs: DataFrame, train_rows: int = 9_000) -> DataFrame:
    """(doc_id, text, spans): each span replaced by [KIND], the rest as it was; null texts give no row."""

    def emit(i, t, fs):
        out, at = [], 0
        for f in fs:
            out += [t[at : f.start], f"[{KINDS[f.kind]}]"]
            at = f.end
        return [(i, "".join(out) + t[at:], len(fs))]

    return _score(docs, "doc_id long, text string, spans int", emit, train_rows)
