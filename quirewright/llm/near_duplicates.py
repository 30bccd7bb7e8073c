"""Near-duplicate texts by a chosen-path similarity join.

Plan. Each text becomes the set of its word windows. Texts with the same set form a class, so that
copies cost one row. A run of the join starts with all classes in one node and sends each class to a
child for every sampled coordinate of its MinHash sketch; a node samples each coordinate with
probability 1/(threshold * width), so a pair at the threshold is expected to share one child. Nodes
of few classes are compared by brute force, larger ones are split again, and what is still large at
the last level is compared in tiles of bounded size. Runs are repeated until the share of pairs
found reaches the target. It is estimated by capture and recapture from two halves of the runs, which
use different halves of the sketch, so that what one misses isn't missed by the other for the same
reason; the loss of the short-sketch filter, which both share, follows from its threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirewright.llm.joins import bitmap_of, marked
from quirewright.llm.shingles import Sketcher, mix, shingle_sets
from quirewright.plans.storage import materialise


@dataclass(frozen=True)
class JoinParams:
    """threshold: least Jaccard similarity; words: window length; width: values of each half of the sketch; runs: runs per round, rounds: the most of them (62 runs at most)."""

    threshold: float = 0.8
    words: int = 5
    width: int = 32
    short: int = 24
    runs: int = 7
    small_node: int = 256
    levels: int = 5
    recall: float = 0.99
    rounds: int = 8
    tile: int = 256
    seed: int = 11


@dataclass
class Duplicates:
    """members: (kind, id, rep), one row per text, rep being the smallest id of its class; pairs: (kind, rep_a, rep_b, jaccard) between classes, rep_a < rep_b unless a repeated id heads both; recall: the estimate."""

    members: DataFrame
    pairs: DataFrame
    recall: float


def _rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("text").isNotNull() & F.col("id").isNotNull() & F.col("kind").isNotNull()).select("kind", F.col("id").cast("long").alias("id"), "text")


_FILTER_LOSS = 0.001


def _least_matches(params: JoinParams) -> int:
    """Equal values of two short sketches that all but _FILTER_LOSS of the pairs at the threshold reach."""
    p, n, below = params.threshold, params.short, 0.0
    for m in range(n + 1):
        below += comb(n, m) * p**m * (1 - p) ** (n - m)
        if below > _FILTER_LOSS:
            return m
    return n


def _class_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    return int(np.bitwise_xor.reduce(mix(s + np.uint64(5)))) - 2**63, int(mix(s * np.uint64(3)).sum(dtype=np.uint64)) - 2**63


def _sets(df: DataFrame, params: JoinParams) -> DataFrame:
    sketcher = Sketcher(2 * params.width, params.seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                sets = shingle_sets([str(t) for t in b.column("text").to_pylist()], params.words)
                keep = [i for i, s in enumerate(sets) if len(s)]
                if not keep:
                    continue
                got = [sets[i] for i in keep]
                sketch = sketcher(got)
                key = [_class_key(s) for s in got]
                yield pa.RecordBatch.from_pydict({
                    "kind": b.column("kind").take(pa.array(keep)), "id": b.column("id").take(pa.array(keep)),
                    "k1": pa.array([k[0] for k in key], pa.int64()), "k2": pa.array([k[1] for k in key], pa.int64()),
                    "sketch": pa.array([r.astype("<u4").tobytes() for r in sketch], pa.binary()),
                })

    return materialise(_rows(df).mapInArrow(run, "kind string, id long, k1 long, k2 long, sketch binary"), "shingle-sets")


def _chosen(node: np.ndarray, params: JoinParams) -> np.ndarray:
    """Which coordinates each node samples."""
    draw = mix(node[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(params.width, dtype=np.uint64)[None, :])
    return (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53 < 1 / (params.threshold * params.width)


def _root(run: int, params: JoinParams) -> np.ndarray:
    """The root node of a run; one that samples no coordinate would find nothing and is drawn again."""
    root = mix(np.array([run + 1], np.uint64) * np.uint64(params.seed * 2 + 1))
    while not _chosen(root, params).any():
        root = mix(root + np.uint64(1))
    return root


def _children(rows: DataFrame, params: JoinParams, roots: list[int] | None) -> DataFrame:
    """(node, run, rep) of the next level; roots: the runs that start here, else ``rows`` has nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rep = b.column("rep").to_numpy(zero_copy_only=False)
            sketch = np.frombuffer(b"".join(b.column("sketch").to_pylist()), "<u4").reshape(len(rep), -1).astype(np.uint64)
            if roots is None:
                parts = [(b.column("node").to_numpy(zero_copy_only=False).view(np.uint64), b.column("run").to_numpy(zero_copy_only=False))]
            else:
                kind = b.column("kind_hash").to_numpy(zero_copy_only=False).view(np.uint64)
                parts = [(None, r) for r in roots]
            for node, r in parts:
                if node is None:
                    root = _root(r, params)
                    pick = np.repeat(_chosen(root, params), len(rep), axis=0)
                    node, r = mix(kind + root), np.full(len(rep), r, np.int32)
                else:
                    pick = _chosen(node, params)
                i, c = np.nonzero(pick)
                child = mix(mix(node[i] + c.astype(np.uint64)) ^ sketch[i, c + params.width * (r[i] % 2)])  # odd runs use the other half
                if len(i):
                    yield pa.RecordBatch.from_pydict({"node": pa.array(child.view(np.int64)), "run": pa.array(r[i], pa.int32()), "rep": pa.array(rep[i])})

    need = ["kind_hash", "rep", "sketch"] if roots is not None else ["node", "run", "rep", "sketch"]
    return rows.select(*need).mapInArrow(run, "node long, run int, rep long")


def _bucket_pairs(rows: DataFrame, keys: list[str], params: JoinParams) -> DataFrame:
    """Pairs within buckets of bounded size whose short sketches agree often enough."""
    least = _least_matches(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[], [], []]
            low = b.column("low")
            flat = low.flatten()
            reps = flat.field("rep").to_numpy(zero_copy_only=False)
            shorts = np.frombuffer(b"".join(flat.field("short").to_pylist()), "<u2").reshape(len(reps), -1)
            ends = np.cumsum(low.value_lengths().to_numpy(zero_copy_only=False))
            for r, end, begin in zip(b.column("run").to_pylist(), ends, np.concatenate([[0], ends[:-1]])):
                rep, short = reps[begin:end], shorts[begin:end]
                i, j = np.nonzero(np.triu((short[:, None, :] == short[None, :, :]).sum(axis=2) >= least, 1))
                if len(i):
                    for c, v in zip(out, (np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j]), np.full(len(i), r))):
                        c.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32()))], names=["a", "b", "run"])

    low = rows.groupBy(*keys, "run").agg(F.collect_set(F.struct("rep", "short")).alias("low")).where(F.size("low") > 1)
    return low.select("run", "low").mapInArrow(run, "a long, b long, run int")


def _candidates(classes: DataFrame, roots: list[int], params: JoinParams) -> DataFrame:
    """(a, b, mask): pairs of classes that met in a small node, and the runs in which they did."""
    rows, found = _children(classes, params, roots), []
    for level in range(params.levels):
        rows = materialise(rows, f"nodes-{level}")
        size = rows.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > 1)
        # Most nodes hold one class; only the others get their short sketches.
        sized = materialise(rows.join(size, "node").join(classes.select("rep", "short"), "rep"), f"sized-{level}")
        found.append(_bucket_pairs(sized.where(F.col("n") <= params.small_node), ["node"], params))
        large = sized.where(F.col("n") > params.small_node)
        if large.isEmpty():
            break
        if level == params.levels - 1:
            # Tiles: each class goes to every pair of tiles that holds its own.
            tiles = F.ceil(F.col("n") / params.tile).cast("int")
            own = large.withColumn("tiles", tiles).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
            cells = own.select("node", "run", "rep", "short", "mine", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
            cells = cells.select("run", "node", "rep", "short", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
            found.append(_bucket_pairs(cells, ["node", "x", "y"], params))
            break
        rows = _children(large.join(classes.select("rep", "sketch"), "rep"), params, None)
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.groupBy("a", "b").agg(F.bit_or(F.expr("shiftleft(1L, run)")).alias("mask"))


def _short(sketch: str, values: int) -> Column:
    """The lower halves of the first values of a sketch."""
    return F.expr(f"concat({', '.join(f'substring({sketch}, {4 * i + 1}, 2)' for i in range(values))})")


def _id_hash(bits: int) -> Column:
    return F.pmod(F.xxhash64("kind", "id"), F.lit(1 << bits))


def _verified(pairs: DataFrame, classes: DataFrame, df: DataFrame, params: JoinParams) -> DataFrame:
    """(kind, rep_a, rep_b, mask, jaccard): the pairs with their exact similarity, by the classes' own sets.

    Only the texts of their classes are read into sets again, past a bitmap of eight bits per class
    and of 64 MB at most; beyond that it lets more texts pass, and the join after it decides.
    """
    spark = pairs.sparkSession
    pairs = materialise(pairs, "likely-pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    named = materialise(classes.select("rep", "kind", "k1", "k2", F.col("rep_id").alias("id")).join(ids, "rep", "left_semi"), "named-classes")
    bits = min(29, max(15, (8 * named.count()).bit_length()))
    shared = spark.sparkContext.broadcast(bitmap_of(named.select(_id_hash(bits).alias("h")), bits))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(marked(shared.value, b.column("h").to_numpy())))
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                sets = shingle_sets(part.column("text").to_pylist(), params.words)
                keep = [i for i, s in enumerate(sets) if len(s)]
                if keep:
                    key = [_class_key(sets[i]) for i in keep]
                    yield pa.RecordBatch.from_arrays([part.column("kind").take(pa.array(keep)), pa.array([k[0] for k in key], pa.int64()), pa.array([k[1] for k in key], pa.int64()), pa.array([sets[i].astype("<u8").tobytes() for i in keep], pa.binary())], names=["kind", "k1", "k2", "hashes"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = []
                for x, y in zip(b.column("ha").to_pylist(), b.column("hb").to_pylist()):
                    x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    out.append(both / (len(x) + len(y) - both))
                r = pa.RecordBatch.from_arrays([*(b.column(c) for c in ("kind", "x", "y", "mask")), pa.array(out, pa.float64())], names=["kind", "x", "y", "mask", "jaccard"])
                yield r.filter(pa.array(np.array(out) >= params.threshold - 1e-12))

    # Copies of a class have the same set, so any of them will do.
    texts = _rows(df).withColumn("h", _id_hash(bits)).mapInArrow(again, "kind string, k1 long, k2 long, hashes binary")
    h = materialise(named.join(texts, ["kind", "k1", "k2"]).groupBy("rep", "kind", "k1", "k2", "id").agg(F.first("hashes").alias("hashes")), "pair-sets")
    left, right = (h.select(F.col("rep").alias(r), F.col("kind").alias(f"kind_{r}"), F.col("id").alias(x), F.col("hashes").alias(f"h{r}")) for r, x in (("a", "x"), ("b", "y")))
    both = pairs.join(left, "a").join(right, "b").where(F.col("kind_a") == F.col("kind_b"))
    checked = both.select(F.col("kind_a").alias("kind"), "x", "y", "mask", "ha", "hb").mapInArrow(exact, "kind string, x long, y long, mask long, jaccard double")
    return materialise(checked.select("kind", F.least("x", "y").alias("rep_a"), F.greatest("x", "y").alias("rep_b"), "mask", "jaccard"), "verified-pairs")


def _estimate(pairs: DataFrame, runs: int, params: JoinParams) -> float | None:
    """The share of pairs that these runs find, by capture and recapture; None where neither half found any."""
    even = sum(1 << i for i in range(0, runs, 2))
    a, b = F.col("mask").bitwiseAND(even) != 0, F.col("mask").bitwiseAND(even << 1) != 0
    # Pairs near the threshold are the hardest; recall is judged on them where there are enough.
    edge = F.col("jaccard") < params.threshold + 0.15
    near, all_ = ([F.count_if(x & c) for x in (a, b, a & b)] for c in (edge, F.lit(True)))
    n_edge, *counts = pairs.agg(F.count_if(edge), *near, *all_).head()
    n_a, n_b, n_ab = counts[:3] if n_edge >= 200 else counts[3:]
    if not n_a + n_b:
        return None
    return (1 - (1 - n_ab / max(n_a, 1)) * (1 - n_ab / max(n_b, 1))) * (1 - _FILTER_LOSS)


def _by_chance(runs: int, params: JoinParams) -> float:
    """The share of pairs at the threshold that runs are expected to find: such a pair shares one child of a node on average, so it stays together with 1 - exp(-that of the next level)."""
    alive = 1.0
    for _ in range(params.levels):
        alive = 1 - exp(-alive)
    return (1 - (1 - alive) ** runs) * (1 - _FILTER_LOSS)


def near_duplicates(df: DataFrame, params: JoinParams = JoinParams()) -> Duplicates:
    """Similar texts of ``df`` (kind, id, text); only texts of one kind are compared.

    Null texts and texts of fewer words than a window take no part; an empty table gives empty
    results. An id that stands in several rows counts once for each of its texts; other columns are
    not read. Where no pair is found, recall is the expected share of pairs at the threshold; where
    the target isn't reached in all rounds, an error tells the estimate.
    """
    sets = _sets(df, params)
    # Classes get a number of their own: ids of different kinds may clash.
    classes = materialise(
        sets.groupBy("kind", "k1", "k2").agg(F.min("id").alias("rep_id"), F.first("sketch").alias("sketch"))
        .withColumns({"rep": F.xxhash64("kind", "k1", "k2"), "kind_hash": F.xxhash64("kind"), "short": _short("sketch", params.short)}),
        "set-classes",
    )
    pairs, recall = None, None
    for at in range(params.rounds):
        new = _verified(_candidates(classes, list(range(at * params.runs, (at + 1) * params.runs)), params), classes, df, params)
        pairs = new if pairs is None else materialise(pairs.unionByName(new).groupBy("kind", "rep_a", "rep_b", "jaccard").agg(F.bit_or("mask").alias("mask")), "verified-pairs")
        recall = _estimate(pairs, (at + 1) * params.runs, params)
        recall = _by_chance((at + 1) * params.runs, params) if recall is None else recall
        if recall >= params.recall:
            break
    else:
        raise RuntimeError(f"the runs find {recall:.4f} of the pairs, less than {params.recall}; allow more rounds")
    members = sets.select("kind", "id", "k1", "k2").distinct().join(classes.select("kind", "k1", "k2", "rep_id"), ["kind", "k1", "k2"]).select("kind", "id", F.col("rep_id").alias("rep"))
    return Duplicates(members, pairs.select("kind", "rep_a", "rep_b", "jaccard"), recall)


def expand(found: Duplicates, part: int = 1_024) -> DataFrame:
    """Every pair of texts (kind, id_a, id_b), id_a < id_b: copies of one class, and members of similar classes.

    As many rows as there are pairs; the members of a class that other members meet are split into
    parts of about ``part``, so that no task pairs off a hot class alone.
    """
    m = found.members
    sizes = m.groupBy("kind", "rep").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / part).cast("int"))
    a = m.join(sizes, ["kind", "rep"]).select("kind", F.col("rep").alias("rep_a"), F.col("id").alias("id_a"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    b = m.select("kind", F.col("rep").alias("rep_b"), F.col("id").alias("id_b"))
    own = sizes.where(F.col("n") > 1).select("kind", F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b"))
    links = found.pairs.select("kind", "rep_a", "rep_b").where(F.col("rep_a") != F.col("rep_b")).unionByName(own)
    split = links.join(sizes.select("kind", F.col("rep").alias("rep_a"), "parts"), ["kind", "rep_a"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    met = split.join(a, ["kind", "rep_a", "part"]).join(b, ["kind", "rep_b"]).where((F.col("rep_a") != F.col("rep_b")) | (F.col("id_a") < F.col("id_b")))
    return met.select("kind", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).where(F.col("id_a") < F.col("id_b")).distinct()
