"""Truncation, splitting, sentences, mixing, personal data and scan repair: examples, invariants, edge cases."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirewright.llm import mixing, personal, scan_repair, sentences, splitting, truncation
from quirewright.llm.boosting import Boosted

# ---------------------------------------------------------------- truncation


def test_marks():
    for mark in ("...", "…", " [...]", "(more)", " [truncated]", "�", " –"):
        assert truncation.end_of("The heron flew over the" + mark)[0]


def test_truncation(spark):
    full = "The heron stood near the pond for hours. Then it flew over the mill and away."
    records = [("a", 1, full), ("a", 2, full[:60]), ("a", 3, None), ("a", 4, "  "), ("b", 6, "ที่ชุ่มน้ำลดลง"), ("b", 7, "ที่ชุ่มน้ำลดลงตามเส้นโค้ง"), ("b", 8, "x" * 100_000 + "."), ("b", 8, "x" * 100_000 + ".")]
    df = spark.createDataFrame([(*r, "clash") for r in records], "kind string, id long, text string, canon string")
    got = truncation.ends(df, spark.createDataFrame([(full,)], "text string")).collect()
    by = {r["id"]: r for r in got}
    assert by[2]["truncated"] and by[2]["longer_copy"] and not by[1]["truncated"]
    assert 3 not in by and 4 not in by and not by[8]["truncated"] and len(got) == 6
    assert by[6]["truncated"] and not by[7]["truncated"]
    assert truncation.ends(df.limit(0), spark.createDataFrame([], "text string")).count() == 0


def test_artificial_cuts_are_told_from_whole_texts(spark, folder):
    docs = [r[0] for r in spark.read.parquet(f"{folder}/../sf0.01/documents.parquet").where("lang in ('en', 'fr', 'es')").select("text").dropDuplicates().collect() if len(r[0]) > 200]
    r = random.Random(8)
    records, truth = [], set()
    for i, text in enumerate(docs):
        whole = text[: max(m.end() for m in re.finditer(r"\w{4,}[.!?](?=\s|$)", text))] if re.search(r"\w{4,}[.!?](?=\s|$)", text) else None
        if whole is None:
            continue
        if i % 6 == 0 and (cut := truncation.cut_text(whole, r)):
            truth.add(i)
            whole = cut
        records.append(("d", i, whole))
    got = truncation.ends(spark.createDataFrame(records, "kind string, id long, text string"), spark.createDataFrame([], "text string")).where("truncated").collect()
    found = {x["id"] for x in got}
    assert len(found & truth) >= 0.9 * len(truth) and len(found - truth) <= 0.05 * len(truth)


def test_strict_prefixes_against_brute_force(spark):
    r = random.Random(3)
    values = ["".join(r.choice("ab") for _ in range(r.randint(0, 7))) for _ in range(200)] + [None]
    got = {x["v"] for x in truncation.strict_prefixes(spark.createDataFrame([(v,) for v in values], "x string"), "x").collect()}
    own = {v for v in values if v}
    assert got == {v for v in own if any(o != v and o.startswith(v) for o in own)}


# ---------------------------------------------------------------- splitting


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab1 .,\n中。", max_size=300), st.integers(1, 30), st.integers(0, 40))
def test_pieces(text, limit, overlap):
    tokens = splitting._TOKEN.findall(text)
    parts = splitting.split_text(text, limit, overlap)
    if not tokens:
        assert parts == []
        return
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    at, out = 0, ""
    for n, (start, end, size, shared, _) in enumerate(parts):
        assert size <= limit and len(splitting._TOKEN.findall(text[start:end])) == size and start <= at
        assert n == 0 or shared == min(overlap, limit - 1)
        out, at = out + text[at:end], end
    assert out == text


def test_few_pieces_quickly():
    # A very long item takes time in proportion, and hardly more pieces than the least.
    text = "one two three four five six seven eight. " * 20_000
    parts = splitting.split_text(text, 200, 50)
    least = -(-(180_000 - 50) // 150)
    assert least <= len(parts) <= 1.06 * least and all(x[4] >= 4 for x in parts)
    solid = splitting.split_text("w " * 30_000, 200, 50)
    assert len(solid) == -(-(30_000 - 50) // 150)


def test_split_table(spark):
    items = [("chunk", 1, -1, " ABSTRACT ", "one two three. four five six."), ("chunk", 2, -1, None, "a b c"), ("chunk", 3, -1, "x", None), ("other", 4, 0, "x", "a b c d"), ("chunk", 5, -1, "x", "w" * 100_000), ("chunk", 6, -1, "x", " 　"), ("chunk", 2, -1, None, "a b c")]
    df = spark.createDataFrame([(*i, 1) for i in items], "item_type string, item_id long, section_idx int, name string, text string, piece int")
    limits = spark.createDataFrame([("chunk", "*", 2, 0), ("chunk", "abstract", 5, None), ("other", "*", None, 1)], "item_kind string, section_name string, max_tokens int, overlap_tokens int")
    got = [tuple(r) for r in splitting.split_oversized(df, limits).select("item_id", "piece", "pieces", "text").collect()]
    assert sorted(x for x in got if x[0] == 1) == [(1, 0, 2, "one two three. "), (1, 1, 2, "four five six.")]
    assert len([x for x in got if x[0] == 2]) == 4 and {x[0] for x in got} == {1, 2}
    assert splitting.split_oversized(df.limit(0), limits).count() == 0
    once = df.dropDuplicates(["item_type", "item_id"])
    assert {tuple(r)[3:] for r in splitting.checked(splitting.split_oversized(once, limits)).collect()} == {(True, True, True)}
    broken = splitting.split_oversized(once, limits).where("not (item_id = 1 and piece = 0)")
    assert not splitting.checked(broken).where("item_id = 1").head()["covers"]


# ---------------------------------------------------------------- sentences


@pytest.mark.parametrize(
    "text,parts",
    [
        ("Dr. Roe came. He left!", ["Dr. Roe came.", "He left!"]),
        ('"Does it hold?" asked Dr. Roe. Yes.', ['"Does it hold?" asked Dr. Roe.', "Yes."]),
        ('The note read: "It fell." We left.', ['The note read: "It fell."', "We left."]),
        ("It grew (cf. Fig. 3.2) by 1.5 mm. p53 rose.", ["It grew (cf. Fig. 3.2) by 1.5 mm.", "p53 rose."]),
        ("(It was vol. 3, no. 4.) Then A. B. Roe came at 5 p.m. No one saw.", ["(It was vol. 3, no. 4.)", "Then A. B. Roe came at 5 p.m.", "No one saw."]),
        ("Version 2 ... fell. So.", ["Version 2 ... fell.", "So."]),
        ("Am 9. März fiel z. B. die Flut. Hr. Roe kam.", ["Am 9. März fiel z. B. die Flut.", "Hr. Roe kam."]),
        ("« Est-elle ouverte ? » demande Mme Roe. Oui !", ["« Est-elle ouverte ? » demande Mme Roe.", "Oui !"]),
        ("审稿人问：“是否？”样本改变了。“有效吗？”这一问题改变了。", ["审稿人问：“是否？”", "样本改变了。", "“有效吗？”这一问题改变了。"]),
        ("「閾値か？」「標本だ！」という応答。図3．8を見た。", ["「閾値か？」「標本だ！」という応答。", "図3．8を見た。"]),
        ("तलछट बदलता है। डॉ. समूह ने मापा।", ["तलछट बदलता है।", "डॉ. समूह ने मापा।"]),
        ("เส้นโค้งลดลง เส้นใยรุ่น ABC ลดลง", ["เส้นโค้งลดลง", "เส้นใยรุ่น ABC ลดลง"]),
        ("A title\n\nText here.\nMore of it.", ["A title", "Text here.", "More of it."]),
        ("It ended.Then more came.", ["It ended.", "Then more came."]),
        ("", []),
        (" \n　", []),
    ],
)
def test_boundaries(text, parts):
    out, at = [], 0
    for e in sentences.boundaries([text])[0]:
        out.append(text[at:e].strip(sentences._W))
        at = e
    assert out == parts


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, sentences._KINDS * 2 - 1), min_size=1, max_size=400), st.integers(1, 50))
def test_blocks_do_not_matter(symbols, block):
    s = np.array(symbols, np.uint8)
    state, want = 8, []
    for x in s:
        want.append(bool(sentences.EMIT[state, x]))
        state = int(sentences.STEP[state, x])
    assert sentences.run_transducer(s, block).tolist() == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. A\"'“”„()?!…\n中。ก1Dr", max_size=200), st.integers(1, 30))
def test_cuts_of_long_documents_do_not_matter(text, size):
    at = sentences.cuts(text, size)
    state, out = 8, []
    for lo, hi in zip(at, at[1:]):
        symbols, places = (np.array(x) for x in sentences.chunk_events(text, lo, hi))
        out += sentences.ends_from(state, symbols, places)
        state = int(sentences.chunk_function(symbols)[state])
    assert sorted(set(out)) == sentences.boundaries([text])[0]


def test_long_documents_are_spread(spark, folder):
    papers = spark.read.parquet(f"{folder}/extracted_papers.parquet").select("paper_id", F.lit(-1).alias("section_idx"), "text")
    short, spread = (sentences.sentences(papers.union(papers.limit(3)), with_text=True, chunk=n) for n in (10**9, 700))
    assert sorted(map(tuple, short.collect())) == sorted(map(tuple, spread.collect()))


def test_sentence_rows(spark):
    df = spark.createDataFrame([(1, 0, "One. Two.", "x"), (1, 1, None, "x"), (1, 2, "", "x"), (2, -1, "Long one. " * 20_000, "x")], "paper_id long, section_idx int, text string, sentence string")
    got = sentences.sentences(df, with_text=True)
    assert got.where("paper_id = 1").select("section_idx", "text").collect() == [(0, "One."), (0, "Two.")]
    assert got.where("paper_id = 2").count() == 20_000
    assert sentences.sentences(df.limit(0)).count() == 0


# ---------------------------------------------------------------- mixing


def test_budgets():
    assert mixing.share_out(10, [1, 1], [2, 100]) == [2, 8]
    assert mixing.share_out(1000, [1, 1], [2, 3]) == [2, 3]
    leaves = {("d1", "a"): (0.25, 1.0), ("d1", "b"): (0.25, 100.0), ("d2", "c"): (0.5, 100.0)}
    got = mixing.allot(leaves, 40)
    # What a lacks goes to its sibling b before it goes to the other domain.
    assert got == {("d1", "a"): 1.0, ("d1", "b"): 19.0, ("d2", "c"): 20.0}


def test_mix(spark):
    docs = [(i, "word " * (5 + i % 7), "big" if i % 3 else "hot", "EN" if i % 2 else None, None) for i in range(300)]
    docs += [(1000, "tiny text here", "small", "en", "k"), (1001, None, "small", "en", "k"), (1002, "", "big", "en", "k"), (1003, "x y", None, "en", "k"), (None, "x", "big", "en", "k")]
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, source string, lang string, domain string, tokens string")
    t = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "hot", 0.5, None), ("n", "small", 0.5, 4), ("n", "big", 0.5, 1), ("n", "gone", None, 1), ("z", "gone", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    rows = mixing.mix(d, t, mixing.MixParams(budget=None, rows_per_range=10)).collect()
    by = {}
    for r in rows:
        by.setdefault((r["mix_name"], r["source"]), []).append(r)
    tokens = {k: sum(r["tokens"] for r in v) for k, v in by.items()}
    assert abs(tokens["m", "big"] / (tokens["m", "big"] + tokens["m", "hot"]) - 0.5) < 0.05
    assert len(by["n", "small"]) == 4 and {r["epoch"] for r in by["n", "small"]} == {0, 1, 2, 3}
    assert len({(r["mix_name"], r["doc_id"], r["epoch"]) for r in rows}) == len(rows)
    again = mixing.mix(d, t, mixing.MixParams(budget=None, rows_per_range=10)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    s = {(r["mix_name"], r["source"]): r["share"] for r in mixing.shares(mixing.mix(d, t, mixing.MixParams(budget=1.0))).collect()}
    assert abs(s["m", "big"] + s["m", "hot"] - 1) < 1e-4
    # Where supply allows, each source has its share but for half a document, however many leaves it has.
    many = [(i, "word " * (5 + i % 40), f"s{i % 3}", f"l{i % 7}", f"k{i % 5}") for i in range(2_000)]
    w = spark.createDataFrame([("m", f"s{i}", share, 1) for i, share in enumerate((0.5, 0.3, 0.2))], "mix_name string, source string, target_share double, max_repeats int")
    m = spark.createDataFrame(many, "doc_id long, text string, source string, lang string, domain string")
    shares = mixing.shares(mixing.mix(m, w, mixing.MixParams(budget=0.5, rows_per_range=50))).collect()
    total = sum(r["tokens"] for r in shares)
    assert all(abs(r["tokens"] - r["target_share"] * total) <= 45 for r in shares)
    assert mixing.mix(d.limit(0), t).count() == 0 and mixing.mix(d, t.limit(0)).count() == 0


# ---------------------------------------------------------------- boosting and personal data


def test_boosting():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = Boosted(trees=30, depth=3).fit(x[:1500], y[:1500])
    assert ((m.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95


TEXT = """Contact Anna Berg or Lomquist, Mark (mail: a.b+c@uni-x.example, x.y [at] lab (dot) org). Tel. +44 7700 900471 or 01.99.00.16.82.
The Anna Basin survey and the Peter-Kern test cite arXiv:2313.51541, ISBN 979-0-282-64005-1 and 34 831 724 reads. Passport no. QQ 34 14 42 A.
Send it to Flat 3, 12 Mill Lane, Oldham QX1 2ZZ or Mühlstraße 7a, 01234 Elley. Dr. Osmarrow and A. Linling stayed in Osdale."""


def test_personal_spans(spark):
    df = spark.createDataFrame([(1, TEXT, "k"), (2, None, "k"), (3, "", "k"), (4, "no one here " * 20_000 + "Anna Berg", "k")], "doc_id long, text string, kind string")
    got = {(r["kind"], TEXT[r["start_pos"] : r["end_pos"]]) for r in personal.personal_spans(df).where("doc_id = 1").collect()}
    assert got == {
        ("PERSON", "Anna Berg"), ("PERSON", "Lomquist, Mark"), ("EMAIL", "a.b+c@uni-x.example"), ("EMAIL", "x.y [at] lab (dot) org"), ("PHONE", "+44 7700 900471"), ("PHONE", "01.99.00.16.82"),
        ("ID_NUMBER", "QQ 34 14 42 A"), ("ADDRESS", "Flat 3, 12 Mill Lane, Oldham QX1 2ZZ"), ("ADDRESS", "Mühlstraße 7a, 01234 Elley"),
    }
    redacted = {r["doc_id"]: r for r in personal.redact(df).collect()}
    assert redacted[1]["text"].startswith("Contact [PERSON] or [PERSON] (mail: [EMAIL], [EMAIL]).") and redacted[4]["spans"] == 1 and 2 not in redacted
    assert personal.personal_spans(df.limit(0)).count() == 0


# ---------------------------------------------------------------- scans


def test_noise_is_labelled():
    text, done = scan_repair.add_noise("Some words stand here and wait for the end of it all. " * 40, "A title of some kind", 7, random.Random(1))
    lines = text.split("\n")
    assert done["furniture"] and all(lines[i].rstrip()[-1] in "-‐¬\xad" for i in done["hyphen"])


def test_repair(spark):
    r = random.Random(5)
    vocabulary = "measured gradient catalyst sediment reviewers declined under several coastal membranes while thermal plumes recovered slowly before another harbour improved beyond adaptive lattice protocols near hidden orchards".split()
    clean = lambda: ". ".join(" ".join(r.choice(vocabulary) for _ in range(9)).capitalize() for _ in range(14)) + "."
    papers = [(i, f"On {r.choice(vocabulary)} {r.choice(vocabulary)}", clean(), False) for i in range(60)]
    noisy, labels = [], {}
    for i in range(40):
        text, labels[1000 + i] = scan_repair.add_noise(clean(), "On hidden orchards", 30 + i, r)
        noisy.append((1000 + i, "On hidden orchards", text, True))
    every = spark.createDataFrame([*papers, *noisy, (3000, None, None, True), (3001, None, None, False)], "paper_id long, title string, text string, scanned boolean")
    units = every.where("scanned").select("paper_id", F.lit(-1).alias("section_idx"), "title", "text", F.lit("clash").alias("entries"))
    units = units.unionByName(spark.createDataFrame([(3002, 0, None, " ", "x"), (3003, 0, None, "word " * 30_000, "x")], units.schema))
    rows = {x["paper_id"]: x for x in scan_repair.repair(units, every, scan_repair.RepairParams(train_papers=50)).collect()}
    assert 3000 not in rows and 3002 not in rows and 3003 in rows
    hit, said, true = 0, 0, 0
    for i, done in labels.items():
        got = {(f["line"] - 1, f["kind"]) for f in rows[i]["found"]}
        want = {(n, k) for k in ("hyphen", "furniture", "misread") for n in done[k]}
        hit, said, true = hit + len(got & want), said + len(got), true + len(want)
    assert hit >= 0.85 * said and hit >= 0.8 * true
    assert scan_repair.repair(units.limit(0), every).count() == 0
    assert scan_repair.repair(units, every.where("scanned")).count() == 0


@pytest.mark.parametrize("between", [0, 3, 8])
def test_broken_word_around_much_furniture(between):
    lines = ["The design was a blin-", "", *["Page 164", "Vol. 29, No. 3"] * between, "", "ded trial of membranes."]
    furniture = [i for i, x in enumerate(lines) if x[:1] in "PV" and x]
    words = scan_repair.breaks_of(lines, np.isin(np.arange(len(lines)), furniture))
    assert words == [(0, "L", "blin"), (0, "R", "ded"), (0, "J", "blinded"), (0, "C", "blin-ded")]
    entries = [{"line": i, "role": k, "word": w, "df": int(k == "J"), "best": None, "score": None} for i, k, w in words]
    models = scan_repair.Models(Boosted(trees=0, base=5.0), 0.5, 0.5)
    found, text = scan_repair.judge([scan_repair._unit("\n".join(lines), furniture, entries)], models)[0]
    assert (1, "hyphen") in found and len(found) == 1 + 2 * between and text.replace("\n\n", " ") == "The design was a blinded trial of membranes."


def test_all_candidates_are_met(spark):
    r = random.Random(7)
    words = {"sediment", "secondary", "summary", "willow", "modern", "window", "illumination", "minimum", "ammonium"}
    words |= {"".join(r.choice("abcdelmnr") for _ in range(n)) for n in range(3, 15) for _ in range(60)}
    words |= {"sedim" + "".join(r.choice("eclmn") for _ in range(3)) for _ in range(60)}  # the vocabulary knows the misread trigrams
    known = [(w, 3) for w in sorted(words)] + [("secliments", 2), ("well-known", 9)]
    ask = ["secliment", "seconclary", "surnrnary", "vvillovv", "rnodern", "1llurn1nat1on", "rninirnurn", "arnrnoniurn", "x" * 5_000]
    for w in r.sample(sorted(words), 150):
        for _ in range(r.randint(1, 3)):
            at = r.randrange(len(w))
            w = w[:at] + r.choice(["", "c", "rn", "m"]) + w[at + r.randint(0, 1) :]
        ask.append(w)
    tokens = spark.createDataFrame([(w, False) for w in sorted({*ask, "Secliment"} - words - {""})], "word string, train boolean")
    got = {(x["word"], x["best"]) for x in scan_repair._ask(tokens, spark.createDataFrame(known, "word string, df int"), scan_repair.RepairParams()).collect()}

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a):
            last, row = row, [i + 1]
            for j, d in enumerate(b):
                row.append(min(last[j] + (c != d), last[j + 1] + 1, row[j] + 1))
        return row[-1]

    want = set()
    for (w, _) in map(tuple, tokens.collect()):
        low, most = w.lower(), 1 if len(w) <= 4 else 2 if len(w) < 9 else 3
        near = {(w, b) for b in words if scan_repair.skeleton(low) == scan_repair.skeleton(b) or abs(len(low) - len(b)) <= most and plain(low, b) <= most}
        assert all(scan_repair._distance(*p) is not None for p in near)
        want |= near or {(w, None)}
    assert got == want and {("secliment", "sediment"), ("Secliment", "sediment"), ("seconclary", "secondary"), ("surnrnary", "summary"), ("vvillovv", "willow")} <= got


@pytest.mark.parametrize("name", ["Priya Sharma", "José García", "Élodie Dupont", "Łukasz Nowak", "Иван Петров", "Sharma, Priya", "PRIYA SHARMA"])
def test_names_outside_the_list(spark, name):
    text = f"The survey was led by {name}, who left. In Dunwick the Osvary Basin and the Random Forest were measured; Mme Osrup stayed."
    others = [(i, "in some random forest the basin was measured and mme Osrup stayed") for i in range(2, 40)]
    df = spark.createDataFrame([(1, text), *others], "doc_id long, text string")
    assert [(r["kind"], text[r["start_pos"] : r["end_pos"]]) for r in personal.personal_spans(df).where("doc_id = 1").collect()] == [("PERSON", name)]
