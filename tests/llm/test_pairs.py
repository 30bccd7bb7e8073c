"""Neighbours, near-duplicates and leaks against brute force, with nulls, ties, copies, long texts and clashing columns."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirewright.llm import leakage, near_duplicates, neighbours
from quirewright.llm.joins import bitmap_of, marked
from quirewright.llm.near_duplicates import JoinParams
from quirewright.llm.neighbours import TreeParams


# ---------------------------------------------------------------- neighbours


def vectors(n=400, width=24, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, width))
    x = centres[rng.integers(0, 8, n)] + 0.35 * rng.normal(size=(n, width))
    x[50:60] = x[40]  # copies
    x[60] = 3 * x[40]  # the same direction
    return x.astype("f4")


def brute(ids, x, k, low):
    unit = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 9)
    out = set()
    for i in range(len(ids)):
        order = sorted((-s[i, j], ids[j]) for j in range(len(ids)) if j != i and s[i, j] >= low)[:k]
        out |= {(min(ids[i], j), max(ids[i], j)) for _, j in order}
    return out


def test_neighbours_against_brute_force(spark):
    x = vectors()
    rows = [(i, v.tolist(), "extra") for i, v in enumerate(x)] + [(9001, None, "n"), (9002, [0.0] * 24, "z"), (9003, [1.0, 2.0], "w"), (9004, [float("nan")] * 24, "f"), (9005, [None] * 24, "u"), (None, x[0].tolist(), "i")]
    df = spark.createDataFrame(rows, "row long, vec array<float>, id string")
    got = {tuple(r) for r in neighbours.neighbour_pairs(df, "row", "vec", 5, 0.8, TreeParams(rows_per_leaf=40, probes=60, tile_rows=50, slice_rows=200)).collect()}
    want = brute(list(range(400)), x, 5, 0.8)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    near = neighbours.nearest_rows(df, "row", "vec", 5, params=TreeParams(rows_per_leaf=40, probes=60)).collect()
    full = brute(list(range(400)), x, 5, -1)
    found = {(min(r["id"], r["neighbour"]), max(r["id"], r["neighbour"])) for r in near}
    assert len(found & full) >= 0.9 * len(full)


def test_cells_of_bounded_size(spark):
    # Two leaves, many tiles and slices: every row must still meet every query of its leaf.
    x = vectors(1500, seed=4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row long, vec array<float>")
    params = TreeParams(rows_per_leaf=40, max_leaves=2, tile_rows=100, slice_rows=150, probes=60)
    got = {tuple(r) for r in neighbours.neighbour_pairs(df, "row", "vec", 5, 0.8, params).collect()}
    want = brute(list(range(1500)), x, 5, 0.8)
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)
    one = TreeParams(rows_per_leaf=10_000, tile_rows=100, slice_rows=150)
    assert {tuple(r) for r in neighbours.neighbour_pairs(df, "row", "vec", 5, 0.8, one).collect()} == want


def test_copies_are_sent_to_cells_of_bounded_size():
    rng = np.random.default_rng(0)
    # A small leaf that all rows visit, and one without rows.
    tiles, slices = neighbours._cells(np.array([[1000, 37, 0], [1037, 1037, 0]]), TreeParams(tile_rows=64, slice_rows=128))
    walk = np.stack([np.repeat([0, 1], [1000, 37]), np.repeat([1, 0], [1000, 37])], axis=1)
    keys = rng.integers(-(2**62), 2**62, (1037, 2))
    row, leaf, tile, slice_, role = neighbours._send(walk, keys, tiles, slices)
    for cell in {(a, b, c) for a, b, c in zip(leaf, tile, slice_)}:
        here = (leaf == cell[0]) & (tile == cell[1]) & (slice_ == cell[2])
        assert (role[here] != 2).sum() <= 2 * 64 and (role[here] != 0).sum() <= 2 * 128
    # Each query meets each tile of its leaves once, each row each slice of its tile.
    for at in (0, 1000):
        asked = [(a, b) for r, a, b, k in zip(row, leaf, tile, role) if r == at and k > 0]
        assert sorted(asked) == sorted((a, t) for a in walk[at] for t in range(tiles[a]))


def test_infinite_and_extreme_vectors(spark):
    x = vectors(200)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900, [float("inf")] + [1.0] * 23), (901, [float("-inf")] * 24), (902, (x[3] * np.float32(1e30)).tolist()), (903, (x[5] * np.float32(1e-30)).tolist())]
    df = spark.createDataFrame(rows, "row long, vec array<float>")
    got = {tuple(r) for r in neighbours.neighbour_pairs(df, "row", "vec", 5, 0.8, TreeParams(rows_per_leaf=40, probes=60)).collect()}
    assert not any(900 in p or 901 in p for p in got) and (3, 902) in got and (5, 903) in got


def test_measured_recall(spark):
    x = vectors(600, seed=9)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row long, vec array<float>")
    found = neighbours.nearest_rows(df, "row", "vec", 5, params=TreeParams(rows_per_leaf=40, probes=60))
    wanted, hits = neighbours.measured_recall(df, found, "row", "vec", 5, every=10, block=16)
    assert wanted == 300 and hits >= 0.97 * wanted


def test_a_hot_vector(spark):
    x = vectors(300)
    x[100:250] = x[7]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row long, vec array<float>")
    near = neighbours.nearest_rows(df, "row", "vec", 3, 0.9, params=TreeParams(rows_per_leaf=50, probes=40)).collect()
    of = {i: sorted(r["neighbour"] for r in near if r["id"] == i) for i in (7, 100, 249)}
    assert of == {7: [100, 101, 102], 100: [7, 101, 102], 249: [7, 100, 101]}


def test_neighbours_of_nothing(spark):
    df = spark.createDataFrame([], "row long, vec array<float>")
    assert neighbours.neighbour_pairs(df, "row", "vec").count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0])], "row long, vec array<float>")
    assert neighbours.neighbour_pairs(one, "row", "vec").count() == 0


# ---------------------------------------------------------------- near-duplicates


def shingles(text, n):
    w = [x for x in re.split("[ \t\n\r 　]+", text.lower()) if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def texts(seed=2):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out = []
    for i in range(120):
        base = [r.choice(words) for _ in range(r.randint(20, 120))]
        out.append(" ".join(base))
        if i % 3 == 0:
            for _ in range(r.randint(1, 3)):
                edited = list(base)
                for _ in range(r.randint(1, 5)):
                    edited[r.randrange(len(edited))] = r.choice(words)
                out.append("  ".join(edited).upper())
    out += ["boiler plate text that many share today", "boiler plate text that many share today"] + [""] * 2 + ["two words", None]
    out.append("long " * 20_000 + "end of it")
    return out


@pytest.mark.parametrize("threshold,words", [(0.6, 3), (0.8, 5)])
def test_near_duplicates_against_brute_force(spark, threshold, words):
    rows = [("a" if i % 7 else "b", i, t, "clash") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "kind string, id long, text string, rep string")
    found = near_duplicates.near_duplicates(df, JoinParams(threshold=threshold, words=words, small_node=4))
    got = {tuple(r) for r in near_duplicates.expand(found).collect()}
    sets = [(k, i, shingles(t, words)) for k, i, t, _ in rows if t and len(shingles(t, words))]
    want = {(k, i, j) for (k, i, a), (m, j, b) in itertools.combinations(sets, 2) if k == m and len(a & b) / len(a | b) >= threshold}
    assert got <= want and len(got) >= 0.98 * len(want) and want
    members = found.members.collect()
    assert len(members) == len(sets)


def test_a_hot_text(spark):
    rows = [("a", i, "the same words stand in all of these texts", None) for i in range(60)] + [("a", 100 + i, f"some other text number {i} with its own words {i * i}", None) for i in range(60)]
    df = spark.createDataFrame(rows, "kind string, id long, text string, x string")
    found = near_duplicates.near_duplicates(df)
    assert found.members.where("rep = 0").count() == 60
    assert near_duplicates.expand(found).count() == 60 * 59 // 2
    assert near_duplicates.expand(near_duplicates.near_duplicates(df.limit(0))).count() == 0


def test_tiles_for_large_nodes(spark):
    # Distinct texts that are all alike: nodes stay large, and the last level compares them in tiles.
    base = [f"w{i}" for i in range(60)]
    rows = [("a", i, " ".join(base + [f"x{i}"])) for i in range(40)]
    df = spark.createDataFrame(rows, "kind string, id long, text string")
    found = near_duplicates.near_duplicates(df, JoinParams(threshold=0.8, words=5, small_node=2, levels=2, tile=8))
    assert near_duplicates.expand(found).count() == 40 * 39 // 2


def test_kinds_that_begin_alike_and_ids_with_several_texts(spark):
    one = " ".join(f"a{i}" for i in range(40))
    two = " ".join(f"b{i}" for i in range(40))
    rows = [("document_a", 1, one), ("document_b", 2, one + " more"), ("document_b", 1, two), ("document_b", 1, one), ("document_b", 5, two + " more")]
    for order in (rows, rows[::-1]):
        found = near_duplicates.near_duplicates(spark.createDataFrame(order, "kind string, id long, text string").repartition(3))
        assert {tuple(r) for r in near_duplicates.expand(found).collect()} == {("document_b", 1, 2), ("document_b", 1, 5)}


def test_a_bitmap_loses_nothing(spark):
    named = spark.range(5_000).selectExpr("'k' AS kind", "id * 7 AS id")
    for bits in (15, 16, 20):
        bitmap = bitmap_of(named.select(near_duplicates._id_hash(bits).alias("h")), bits)
        h = np.array([r[0] for r in named.select(near_duplicates._id_hash(bits)).collect()])
        assert marked(bitmap, h).all()
        assert marked(bitmap, np.arange(1 << bits)).sum() == len(set(h.tolist()))


def test_hot_classes_are_split(spark):
    rows = [("a", i, "the same words stand in all of these texts") for i in range(50)] + [("a", 100 + i, "the same words stand in all of these texts today") for i in range(9)]
    found = near_duplicates.near_duplicates(spark.createDataFrame(rows, "kind string, id long, text string"), JoinParams(threshold=0.6, words=3))
    got = near_duplicates.expand(found, part=7)
    assert got.count() == 59 * 58 // 2 == got.distinct().count()


# ---------------------------------------------------------------- leaks

ITEM = "In the third trial Ann Smith measured 14 mm of rain near the old mill before the gauge was moved to the upper field for good"


def test_leaks(spark):
    docs = [
        (1, "Before. " + ITEM.upper() + ". After."),
        (2, "x " + " ; ".join(ITEM.split()[2:16]) + " y"),
        (3, " ".join(ITEM.split()[:12])),
        (4, "We saw that in the third trial Bob Jones measured 99 cm of rain near the old mill before"),
        (5, None),
        (6, ""),
        (7, "word " * 50_000 + ITEM),
    ]
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "id long, text string, doc_id string")
    items = spark.createDataFrame([(10, ITEM), (11, "too short"), (12, None)], "id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in leakage.leaks(d, items).collect()}
    assert {k for k, r in got.items() if r["exact_words"]} == {(1, 10), (2, 10), (7, 10)}
    assert got[1, 10]["exact_words"] == len(ITEM.split()) and got[2, 10]["exact_words"] == 14
    assert got[4, 10]["exact_words"] == 0 and got[4, 10]["template_words"] >= 13
    assert leakage.leaks(d.limit(0), items).count() == 0 and leakage.leaks(d, items.limit(0)).count() == 0


def test_repeated_items_and_documents(spark):
    # Twenty items of one text, a document id with two texts whose windows must not be set together.
    words = ITEM.split()
    d = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, " ".join(words[:14])), (2, "x " + " ".join(words[1:15]))], "id long, text string")
    items = spark.createDataFrame([(i, ITEM) for i in range(20)], "id long, text string")
    got = leakage.leaks(d, items).collect()
    assert len(got) == 40 and {(r["doc_id"], r["exact_words"], r["item_words"]) for r in got} == {(1, len(words), len(words)), (2, 14, len(words))}


def test_a_passage_in_most_documents(spark):
    d = spark.createDataFrame([(i, f"number{i} " + ITEM) for i in range(3_000)], "id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "id long, text string")
    assert leakage.leaks(d, items).where(F.col("exact_words") == len(ITEM.split())).count() == 3_000


def test_letters_of_the_higher_planes(spark):
    text = " ".join(chr(0x20000 + i) + "字" for i in range(14)) + " 1"
    d = spark.createDataFrame([(1, text), (2, text.replace(chr(0x20003), "x"))], "id long, text string")
    assert [(r["doc_id"], r["exact_words"]) for r in leakage.leaks(d, spark.createDataFrame([(7, text)], "id long, text string")).where("exact_words > 0").collect()] == [(1, 15)]


def test_templates_against_brute_force(spark):
    r = random.Random(6)
    names, plain = ["Ann", "Bob", "Cleo", "Dan"], [f"w{c}" for c in "abcdefghijklmnop"]
    draw = lambda n: [r.choice([r.choice(names), str(r.randint(1, 30)), r.choice(["mm", "kg"])]) if r.random() < 0.3 else r.choice(plain) for _ in range(n)]
    items = {i: draw(24) for i in range(12)}
    docs = {}
    for i in range(60):
        source = list(items[i % 12][r.randint(0, 6) :])
        rename = {}
        for w in set(source):
            if w in names and r.random() < 0.5 or w.isdigit() and r.random() < 0.5:
                rename[w] = r.choice(["Eve", "Finn", "Gus"]) if w in names else str(r.randint(40, 99))
        source = [rename.get(w, w) if r.random() < 0.97 else w for w in source]
        docs[i] = ["so", *source, "end"]
    typed = lambda w, named: "#" if w.isdigit() else "u" if w in ("mm", "kg") else "N" if named and w[0].isupper() else w.lower()

    def like(a, b):
        if [x.lower() for x in a] == [x.lower() for x in b]:
            return True
        if not any([typed(x, n) for x in a] == [typed(x, n) for x in b] for n in (False, True)):
            return False
        a, b = [x.lower() for x in a], [x.lower() for x in b]
        return sum(x == y for x, y in zip(a, b)) >= 7 and all((a[i] == a[j]) == (b[i] == b[j]) for i in range(13) for j in range(13))

    want = {(d, i) for d, x in docs.items() for i, y in items.items() if any(like(x[a : a + 13], y[b : b + 13]) for a in range(len(x) - 12) for b in range(len(y) - 12))}
    text = lambda words: "so " + " ".join(words)  # noqa: E731 - the first word opens a sentence and is no name
    d = spark.createDataFrame([(i, text(x)) for i, x in docs.items()], "id long, text string")
    t = spark.createDataFrame([(i, text(x)) for i, x in items.items()], "id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in leakage.leaks(d, t).collect()} >= want and want


def test_leaks_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    items = spark.read.parquet(f"{folder}/eval_items.parquet").select(F.col("item_id").alias("id"), "text")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(docs, items).where("exact_words > 0").collect()}
    word = re.compile(r"[^\W_]+")
    runs = lambda t: {tuple(w[i : i + 13]) for w in [word.findall(t.lower())] for i in range(len(w) - 12)}
    held = [(r["id"], runs(r["text"])) for r in items.collect()]
    assert got == {(r["id"], i) for r in docs.collect() for i, s in held if runs(r["text"] or "") & s}
