"""Most similar vectors for every vector, by a hierarchical k-means tree.

Plan. The vectors are written once, losslessly compressed, with a hash of their values; all further
passes read that table. A tree of two levels is fitted on bounded samples, the branches on the driver, each
branch's leaves in a task of its own. Each row goes to its home leaf and, as a query, to the leaves
that a best-bin-first walk pops next; how many, and how much less like the row than its home they
may be, is calibrated against exact neighbours of probe rows over the whole table. Rows and queries of a leaf meet in cells: a tile of bounded rows is held, and
the queries stream past it in slices, so no task holds a group whole. Cosines are exact. Copies of one
vector form a class: they are searched once and share their neighbours, so a vector that fills a third
of the table costs one search.

Best-bin-first. The walk pops the best node of a priority queue and pushes its children. A leaf is
popped as soon as the queue's top falls to the smallest similarity on its path, so the order of pops
is the order of these path minima. A whole batch walks at once: branches are opened in the order of
their similarity until none can give a better leaf than those already popped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirewright.llm.shingles import mix
from quirewright.plans.storage import materialise


@dataclass(frozen=True)
class TreeParams:
    """Bounds of the index and of its tasks.

    A leaf is fitted on about ``sample_per_leaf`` rows, a branch's leaves on at most ``branch_rows``;
    leaves follow the table up to ``max_leaves``, the size of the broadcast tree. A cell holds about
    ``tile_rows`` rows and sees about ``slice_rows`` queries, whatever the leaf's size.
    """

    rows_per_leaf: int = 1_000
    sample_per_leaf: int = 32
    branch_rows: int = 16_384
    max_leaves: int = 32_768
    probes: int = 512
    recall: float = 0.995
    tile_rows: int = 8_192
    slice_rows: int = 32_768
    task_bytes: int = 4 << 20
    seed: int = 7


@dataclass
class Tree:
    """Centroids of unit length, the leaves in the order of their branches; leaves of branch b are first[b] to first[b + 1]."""

    branches: np.ndarray
    leaves: np.ndarray
    first: np.ndarray
    visits: int = 1
    gap: float = 2.0

    def walk(self, unit: np.ndarray, visits: int) -> tuple[np.ndarray, np.ndarray]:
        """The leaves that a best-bin-first walk pops first, in order, for each row, and the row's similarity to them."""
        visits = min(visits, len(self.leaves))
        top = unit @ self.branches.T
        order = np.argsort(-top, axis=1)
        best, alike = np.full((2, len(unit), visits), -9.0, np.float32)
        leaf = np.full((len(unit), visits), -1, np.int64)
        active = np.arange(len(unit))
        for r in range(len(self.branches)):
            branch = order[active, r]
            open_ = top[active, branch] + 2e-6 > best[active].min(axis=1)
            active, branch = active[open_], branch[open_]
            if not len(active):
                break
            for b in np.unique(branch):
                at = active[branch == b]
                lo, hi = self.first[b], self.first[b + 1]
                own = unit[at] @ self.leaves[lo:hi].T
                # Of leaves with one path minimum, those most like the row are popped first.
                key = np.minimum(own, top[at, b][:, None]) + np.float32(1e-6) * own
                keys = np.concatenate([best[at], key], axis=1)
                keep = np.argpartition(-keys, visits - 1, axis=1)[:, :visits]
                best[at] = np.take_along_axis(keys, keep, axis=1)
                leaf[at] = np.take_along_axis(np.concatenate([leaf[at], np.broadcast_to(np.arange(lo, hi), key.shape)], axis=1), keep, axis=1)
                alike[at] = np.take_along_axis(np.concatenate([alike[at], own], axis=1), keep, axis=1)
        order = np.argsort(-best, axis=1, kind="stable")
        return np.take_along_axis(leaf, order, axis=1), np.take_along_axis(alike, order, axis=1)

    def home(self, unit: np.ndarray) -> np.ndarray:
        return self.walk(unit, 1)[0][:, 0]

    def visited(self, unit: np.ndarray) -> np.ndarray:
        """The leaves that each row visits, its home first; -1 for those that are too little like the row."""
        leaf, alike = self.walk(unit, self.visits)
        return np.where(alike >= alike[:, :1] - self.gap, leaf, -1)


# ---------------------------------------------------------------- vectors as bytes


def _pack(x: np.ndarray) -> list[bytes]:
    """Each row losslessly: the bytes of its values by significance, compressed."""
    planes = np.ascontiguousarray(x.astype("<f4", copy=False).view(np.uint8).reshape(len(x), -1, 4).transpose(0, 2, 1))
    compress = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
    return [compress(row) for row in planes]


def _unpack(packed: list[bytes], width: int) -> np.ndarray:
    expand = zstandard.ZstdDecompressor().decompress
    planes = np.frombuffer(b"".join(expand(p) for p in packed), np.uint8).reshape(len(packed), 4, width)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<f4").reshape(len(packed), width)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of unit length; scaled first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _hashes(x: np.ndarray, seed: int) -> np.ndarray:
    """Two 64-bit hashes of each row's values."""
    rng = np.random.default_rng(seed)
    value = x.view("<u4").astype(np.uint64) + np.uint64(1)
    weights = rng.integers(0, 2**63, (2, x.shape[1]), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return np.stack([mix((value * w).sum(axis=1, dtype=np.uint64) ^ np.uint64(x.shape[1])) for w in weights], axis=1).view(np.int64)


_CODED = "id long, h1 long, h2 long, width int, packed binary"


def _coded(df: DataFrame, id_col: str, vector_col: str, params: TreeParams) -> DataFrame:
    """Rows that can take part: an id, and a vector without null, NaN or infinity, not all zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2_048):
                b = whole.slice(at, 2_048)
                vectors, ids = b.column("vector"), b.column("id").to_numpy(zero_copy_only=False)
                sizes = np.asarray(vectors.value_lengths().fill_null(0))
                flat = vectors.flatten()
                values = flat.to_numpy(zero_copy_only=False).astype("f4", copy=False)  # null values become NaN
                starts = np.cumsum(sizes) - sizes
                for width in np.unique(sizes[sizes > 0]):
                    own = np.nonzero(sizes == width)[0]
                    x = values[starts[own][:, None] + np.arange(width)] + np.float32(0)  # no negative zero
                    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                    own, x = own[good], np.ascontiguousarray(x[good])
                    if len(own):
                        h = _hashes(x, params.seed)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(np.full(len(own), width, np.int32)), pa.array(_pack(x), pa.binary())], names=["id", "h1", "h2", "width", "packed"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector")).where(F.col("id").isNotNull() & (F.size("vector") > 0))
    return materialise(rows.mapInArrow(run, _CODED), "vectors")


def _read(b: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, class keys (two columns) and vectors of a batch."""
    keys = np.stack([b.column("h1").to_numpy(zero_copy_only=False), b.column("h2").to_numpy(zero_copy_only=False)], axis=1)
    return b.column("id").to_numpy(zero_copy_only=False), keys, _unpack(b.column("packed").to_pylist(), width)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 2_048) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, as each becomes several matrices."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


# ---------------------------------------------------------------- the tree


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; empty centres are dropped."""
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        norm = np.linalg.norm(sums, axis=1)
        centres = sums[norm > 0] / norm[norm > 0][:, None]
    return centres.astype("f4")


def _distinct(rows: DataFrame) -> DataFrame:
    """One row per class."""
    return rows.groupBy("h1", "h2").agg(F.first("packed").alias("packed"))


def _fit(rows: DataFrame, n_classes: int, width: int, params: TreeParams) -> Tree:
    """Branches from about 64 classes each, fitted on the driver; leaves from a sample of each branch, fitted in tasks."""
    leaves = int(min(params.max_leaves, max(1, n_classes // params.rows_per_leaf)))
    n_branches = max(1, math.isqrt(leaves))
    rng = np.random.default_rng(params.seed)
    step = max(1, n_classes // (64 * n_branches))
    got = _distinct(rows.where(F.pmod("h2", F.lit(step)) == 0)).orderBy("h2").limit(64 * n_branches).select("packed").collect() or rows.select("packed").limit(1).collect()
    branches = _kmeans(_unit(_unpack([bytes(r["packed"]) for r in got], width)), n_branches, rng)
    shared = rows.sparkSession.sparkContext.broadcast(branches)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            if b.num_rows:
                branch = (_unit(_unpack(b.column("packed").to_pylist(), width)) @ shared.value.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(branch, pa.int32()), b.column("h2"), b.column("packed")], names=["branch", "h2", "packed"])

    def grow(table: pa.Table) -> pa.Table:
        x = _unit(_unpack(table.column("packed").to_pylist(), width))
        centres = _kmeans(x, max(1, round(len(x) / params.sample_per_leaf)), np.random.default_rng(params.seed))
        return pa.table({"branch": pa.array(np.full(len(centres), table.column("branch")[0].as_py()), pa.int32()), "centre": pa.array([c.astype("<f2").tobytes() for c in centres], pa.binary())})

    step = max(1, n_classes // (params.sample_per_leaf * leaves))
    placed = _distinct(rows.where(F.pmod("h1", F.lit(step)) == 0)).mapInArrow(place, "branch int, h2 long, packed binary")
    rank = F.row_number().over(Window.partitionBy("branch").orderBy("h2"))
    bounded = placed.withColumn("rank", rank).where(F.col("rank") <= params.branch_rows).drop("rank")
    parts: dict[int, list] = {}
    for r in bounded.groupBy("branch").applyInArrow(grow, "branch int, centre binary").collect():  # at most about max_leaves
        parts.setdefault(r["branch"], []).append(np.frombuffer(r["centre"], "<f2").astype("f4"))
    groups = [np.array(sorted(parts[b], key=bytes)) if b in parts else branches[b : b + 1] for b in range(len(branches))]
    return Tree(branches, np.concatenate(groups), np.concatenate([[0], np.cumsum([len(g) for g in groups])]))


def _calibrate(rows: DataFrame, tree: Tree, k: int, min_cosine: float, n_classes: int, width: int, params: TreeParams) -> tuple[int, float]:
    """The leaf visits, and the gap in similarity, by which the wanted share of the probes' exact neighbours is reached.

    Probes are distinct classes. They are compared with every row, and k rows per probe and task leave
    the scan. Where the probes' neighbours are too few to calibrate on, more probes are drawn, and
    where none has any, all leaves are visited.
    """
    n_leaves, pairs = len(tree.leaves), []
    if n_leaves == 1:
        return 1, 2.0
    for probes in (params.probes, 8 * params.probes):
        step = max(1, n_classes // probes)
        picked = _distinct(rows.where(F.pmod("h1", F.lit(step)) == 0)).orderBy("h1", "h2").limit(probes).collect()
        if not picked:
            continue
        probe = _unit(_unpack([bytes(r["packed"]) for r in picked], width))
        own = np.array([(r["h1"], r["h2"]) for r in picked], np.int64)
        shared = rows.sparkSession.sparkContext.broadcast((tree, probe, own))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            t, p, mine = shared.value
            held = [np.zeros((len(p), 0), d) for d in ("f4", "i8", "i8")]
            for b in _slices(batches):
                _, keys, x = _read(b, width)
                if not len(keys):
                    continue
                unit = _unit(x)
                sims = p @ unit.T
                sims[(mine[:, :1] == keys[None, :, 0]) & (mine[:, 1:] == keys[None, :, 1])] = -2
                # Copies count once: only the first row of a batch that has its key.
                again = np.ones(len(keys), bool)
                again[np.unique(keys[:, 0], return_index=True)[1]] = False
                sims[:, again] = -2
                m = min(k, sims.shape[1])
                near = np.argpartition(-sims, m - 1, axis=1)[:, :m]
                used, place = np.unique(near, return_inverse=True)
                fresh = [np.take_along_axis(sims, near, 1), keys[near, 0], t.home(unit[used])[place.reshape(near.shape)]]
                held = _best([np.concatenate(pair, axis=1) for pair in zip(held, fresh)], k)
            q, i = np.nonzero(held[0] >= max(min_cosine, -1.5))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(held[2][q, i], pa.int32()), pa.array(held[1][q, i]), pa.array(held[0][q, i].astype("f8"))], names=["q", "leaf", "h", "s"])

        near = F.slice(F.array_sort(F.collect_set(F.struct((-F.col("s")).alias("d"), "h", "leaf"))), 1, k)
        got = rows.mapInArrow(scan, "q int, leaf int, h long, s double").groupBy("q").agg(near.alias("near")).collect()
        shared.unpersist()
        pairs = [(r["q"], n["leaf"]) for r in got for n in r["near"]]
        if len(pairs) >= 40 or probes > n_classes:
            break
    return _policy(tree, probe, np.array(pairs), params.recall) if pairs else (n_leaves, 2.0)


def _policy(tree: Tree, probe: np.ndarray, pairs: np.ndarray, recall: float) -> tuple[int, float]:
    """Of all numbers of visits and gaps that reach the recall on (probe, leaf) pairs, those that cost the fewest visits."""
    leaf, alike = tree.walk(probe, len(tree.leaves))
    gaps = alike[:, :1] - alike
    rank = np.argsort(leaf, axis=1)[pairs[:, 0], pairs[:, 1]]
    gap = gaps[pairs[:, 0], rank]
    need = math.ceil(recall * len(rank))
    best = None
    for visits in np.unique(rank) + 1:
        inside = np.sort(gap[rank < visits])
        if len(inside) >= need:
            most = float(inside[need - 1]) + 1e-6
            cost = (gaps[:, :visits] <= most).sum()
            if best is None or cost < best[0]:
                best = (cost, int(visits), most)
    return best[1], best[2]


def _best(held: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The k most similar of each row of (similarities, keys, leaves)."""
    keep = np.argsort(-held[0], axis=1, kind="stable")[:, :k]
    return [np.take_along_axis(h, keep, axis=1) for h in held]


# ---------------------------------------------------------------- the search


def _kept(ids: np.ndarray, keys: np.ndarray, hot: dict) -> np.ndarray:
    """Copies of hot classes aren't searched, but for the first."""
    ok = np.ones(len(ids), bool)
    if hot:
        names = np.array([a for a, _ in hot])
        for i in np.nonzero(np.isin(keys[:, 0], names))[0]:
            first = hot.get((int(keys[i, 0]), int(keys[i, 1])))
            ok[i] = first is None or first == ids[i]
    return ok


def _nearest(query: tuple, rows: tuple, k: int, min_cosine: float, out: list[list]) -> None:
    """Append the k nearest classes of each query, by exact cosine and then by the smaller id.

    query, rows: (keys, ids, vectors, unit vectors); the rows' classes are distinct. Single precision
    only picks what is within its error of the k-th place.
    """
    (qk, _, qx, qu), (keys, ids, x, unit) = query, rows
    m = min(k, len(keys))
    for lo in range(0, len(qk), 512):
        mine = qk[lo : lo + 512]
        sims = qu[lo : lo + 512] @ unit.T
        sims[(mine[:, None, 0] == keys[None, :, 0]) & (mine[:, None, 1] == keys[None, :, 1])] = -2
        edge = np.maximum(np.partition(sims, -m, axis=1)[:, -m], min_cosine) - 1e-5
        q, i = np.nonzero((sims >= edge[:, None]) & (sims > -1.5))
        cosine = np.empty(len(q))
        for at in range(0, len(q), 8_192):
            a, b = _unit(qx[lo + q[at : at + 8_192]].astype("f8")), _unit(x[i[at : at + 8_192]].astype("f8"))
            cosine[at : at + 8_192] = np.einsum("ij,ij->i", a, b)
        cosine = np.round(cosine, 9)
        order = np.lexsort((ids[i], -cosine, q))
        order = order[cosine[order] >= min_cosine]
        q, i, cosine = q[order], i[order], cosine[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        q, i, cosine = q[rank < k], i[rank < k], cosine[rank < k]
        for c, v in zip(out, (mine[q, 0], mine[q, 1], keys[i, 0], keys[i, 1], ids[i], cosine)):
            c.append(v)


_ROW, _BOTH, _QUERY = range(3)


def _census(rows: DataFrame, tree: Tree, hot: dict, width: int) -> np.ndarray:
    """How many rows are at home in each leaf, and how many visit it (two lines)."""
    shared = rows.sparkSession.sparkContext.broadcast((tree, hot))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, dropped = shared.value
        total = np.zeros((2, len(t.leaves)), np.int64)
        for b in _slices(batches):
            ids, keys, x = _read(b, width)
            ok = _kept(ids, keys, dropped)
            if ok.any():
                walk = t.visited(_unit(x[ok]))
                total += np.stack([np.bincount(walk[:, 0], minlength=total.shape[1]), np.bincount(walk[walk >= 0], minlength=total.shape[1])])
        at = np.nonzero(total[1])[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[0, at]), pa.array(total[1, at])], names=["leaf", "homes", "queries"])

    out = np.zeros((2, len(tree.leaves)), np.int64)
    for r in rows.mapInArrow(count, "leaf int, homes long, queries long").groupBy("leaf").agg(F.sum("homes").alias("homes"), F.sum("queries").alias("queries")).collect():  # one row per leaf
        out[:, r["leaf"]] = r["homes"], r["queries"]
    shared.unpersist()
    return out


def _cells(census: np.ndarray, params: TreeParams) -> tuple[np.ndarray, np.ndarray]:
    """Tiles of the rows and slices of the queries of each leaf."""
    return -(-census[0] // params.tile_rows), np.maximum(1, -(-census[1] // params.slice_rows))


def _send(walk: np.ndarray, keys: np.ndarray, tiles: np.ndarray, slices: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, leaf, tile, slice, role) of all copies of the rows: to all slices of their own tile as rows, to one slice of each tile of the leaves they visit as queries."""
    n = len(walk)
    own = keys.view(np.uint64)
    home = walk[:, 0]
    tile = (own[:, 1] % tiles[home].astype(np.uint64)).astype(np.int64)
    slice_of = lambda rows, leaf: (own[rows, 0] % slices[leaf].astype(np.uint64)).astype(np.int64)
    out = []
    # As rows.
    row = np.repeat(np.arange(n), slices[home])
    at = np.arange(len(row)) - np.repeat(np.cumsum(slices[home]) - slices[home], slices[home])
    out.append((row, home[row], tile[row], at, np.where(at == slice_of(row, home[row]), _BOTH, _ROW)))
    # As queries.
    visit, leaf = np.repeat(np.arange(n), walk.shape[1])[walk.ravel() >= 0], walk[walk >= 0]
    many = tiles[leaf]
    row, leaf = np.repeat(visit, many), np.repeat(leaf, many)
    at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    other = (leaf != home[row]) | (at != tile[row])
    row, leaf, at = row[other], leaf[other], at[other]
    out.append((row, leaf, at, slice_of(row, leaf), np.full(len(row), _QUERY)))
    return tuple(np.concatenate(c) for c in zip(*out))


def _search(rows: DataFrame, tree: Tree, census: np.ndarray, hot: dict, k: int, min_cosine: float, width: int, row_bytes: float, params: TreeParams) -> DataFrame:
    """Class against class within each cell: (q1, q2, h1, h2, first_id, cosine)."""
    tiles, slices = _cells(census, params)
    shared = rows.sparkSession.sparkContext.broadcast((tree, hot, tiles, slices))
    names = ("leaf", "tile", "slice", "role")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, dropped, n_tiles, n_slices = shared.value
        for b in _slices(batches):
            ids, keys, x = _read(b, width)
            ok = np.nonzero(_kept(ids, keys, dropped))[0]
            if len(ok):
                row, *cell = _send(t.visited(_unit(x[ok])), keys[ok], n_tiles, n_slices)
                for lo in range(0, len(row), 8_192):
                    part = b.take(pa.array(ok[row[lo : lo + 8_192]]))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c[lo : lo + 8_192], pa.int32()) for c in cell), *(part.column(c) for c in ("id", "h1", "h2", "packed"))], names=[*names, "id", "h1", "h2", "packed"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, rows_ = None, [], None

        def ready() -> tuple | None:
            if not held:
                return None
            ids, keys, x = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((ids, keys[:, 1], keys[:, 0]))
            first = np.ones(len(ids), bool)
            first[1:] = (keys[order][1:] != keys[order][:-1]).any(axis=1)
            order = order[first]
            order = order[np.argsort(ids[order], kind="stable")]
            return keys[order], ids[order], x[order], _unit(x[order])

        def ask(query: tuple, out: list) -> None:
            if rows_ is not None:
                _nearest(query, rows_, k, min_cosine, out)

        def given(out: list) -> Iterator[pa.RecordBatch]:
            if out[0]:
                cols = [np.concatenate(c) for c in out]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.float64())], names=["q1", "q2", "h1", "h2", "first_id", "cosine"])

        def settle(out: list) -> None:
            """The cell's rows are complete: those that are queries as well ask first."""
            nonlocal rows_, held
            if held:
                rows_ = ready()
                mine = np.concatenate([m for _, m in asking]) if asking else np.zeros(0, bool)
                if mine.any():
                    ids, keys, x = (np.concatenate(c)[mine] for c in zip(*held))
                    at = np.unique(keys, axis=0, return_index=True)[1]
                    ask((keys[at], ids[at], x[at], _unit(x[at])), out)
                held = []
                asking.clear()

        asking: list[tuple] = []
        for b in _slices(batches):
            out = [[] for _ in range(6)]
            marks = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1)
            ids, keys, x = _read(b, width)
            kind = np.concatenate([marks[:, :3], (marks[:, 3:] == _QUERY)], axis=1)
            edges = [0, *(np.nonzero((kind[1:] != kind[:-1]).any(axis=1))[0] + 1), len(kind)]
            for lo, hi in zip(edges, edges[1:]):
                if hi == lo:
                    continue
                if cell != (here := tuple(kind[lo, :3].tolist())):
                    settle(out)
                    cell, rows_ = here, None
                if kind[lo, 3]:
                    settle(out)
                    ask((keys[lo:hi], ids[lo:hi], x[lo:hi], _unit(x[lo:hi])), out)
                else:
                    held.append((ids[lo:hi], keys[lo:hi], x[lo:hi].copy()))
                    asking.append((None, marks[lo:hi, 3] == _BOTH))
            yield from given(out)
        out = [[] for _ in range(6)]
        settle(out)
        yield from given(out)

    copies = float((census[0] * slices).sum() + (census[1] * tiles).sum())
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(copies * row_bytes / params.task_bytes))
    sent = rows.mapInArrow(visit, "leaf int, tile int, slice int, role int, id long, h1 long, h2 long, packed binary")
    return sent.repartition(parts, "leaf", "tile", "slice").sortWithinPartitions(*names).mapInArrow(meet, "q1 long, q2 long, h1 long, h2 long, first_id long, cosine double")


def nearest_rows(
    df: DataFrame, id_col: str, vector_col: str, k: int = 5, min_cosine: float = -1.0, width: int | None = None, params: TreeParams = TreeParams()
) -> DataFrame:
    """The k most similar other rows of every row: (id, neighbour, cosine), ties by the smaller id.

    Null vectors, vectors with a null, NaN or infinite value, all-zero vectors and vectors of another
    width than ``width`` (default: the commonest) take no part; repeated ids count once per vector. An
    empty table gives an empty result. Neighbours under ``min_cosine`` are left out, and recall is
    calibrated on the others. Cosines are rounded to 9 decimals. Columns other than the two named
    are not read.
    """
    empty = df.sparkSession.createDataFrame([], "id long, neighbour long, cosine double")
    coded = _coded(df, id_col, vector_col, params)
    sizes = coded.groupBy("width").agg(F.count("*").alias("n"), F.avg(F.length("packed")).alias("bytes"))
    if width is not None:
        sizes = sizes.where(F.col("width") == width)
    common = sizes.orderBy(F.desc("n"), "width").head()
    if common is None:
        return empty
    width, total = common["width"], common["n"]
    rows = coded.where(F.col("width") == width).select("id", "h1", "h2", "packed")
    ids = rows.select("id", "h1", "h2")

    # One row per class: its k + 1 smallest ids are all that any neighbour list can use.
    rank = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))  # limited before the shuffle
    firsts = ids.distinct().withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("h1", "h2").agg(F.array_sort(F.collect_set("id")).alias("first"))
    classes = materialise(ids.groupBy("h1", "h2").agg(F.count("*").alias("n")).join(firsts, ["h1", "h2"]), "vector-classes")
    n_classes = classes.count()
    # At most 1000 classes can have a thousandth of all rows.
    common_ones = classes.where(F.col("n") >= max(64, math.ceil(total / 1000))).select("h1", "h2", "first").collect()
    hot = {(r["h1"], r["h2"]): r["first"][0] for r in common_ones}

    tree = _fit(rows, n_classes, width, params)
    tree.visits, tree.gap = _calibrate(rows, tree, k, min_cosine, n_classes, width, params)
    census = _census(rows, tree, hot, width)
    found = _search(rows, tree, census, hot, k, min_cosine, width, common["bytes"] + 40, params)

    # Keep the best k classes of each class; then hand them to all rows of the class.
    best = found.groupBy("q1", "q2").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("cosine")).alias("d"), "first_id", "h1", "h2"))), 1, k).alias("near"))
    flat = best.select("q1", "q2", F.explode("near").alias("n")).select("q1", "q2", "n.d", F.col("n.h1").alias("h1"), F.col("n.h2").alias("h2"))
    other = flat.join(classes.select("h1", "h2", "first"), ["h1", "h2"]).select("q1", "q2", "d", "first")
    own = classes.where(F.col("n") > 1).select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.lit(-1.0).alias("d"), "first")
    lists = other.unionByName(own).groupBy("q1", "q2").agg(F.flatten(F.collect_list(F.transform("first", lambda i: F.struct("d", i.alias("i"))))).alias("near"))
    lists = lists.select(F.col("q1").alias("h1"), F.col("q2").alias("h2"), F.slice(F.array_sort("near"), 1, k + 1).alias("near"))
    if hot:
        # Rows of hot classes get their lists from a broadcast of at most 1000 of them.
        keys = F.broadcast(df.sparkSession.createDataFrame(list(hot), "h1 long, h2 long"))
        lists = materialise(lists, "neighbour-lists")
        given = ids.join(keys, ["h1", "h2"], "left_anti").join(lists, ["h1", "h2"]).unionByName(ids.join(F.broadcast(lists.join(keys, ["h1", "h2"], "left_semi")), ["h1", "h2"]))
    else:
        given = ids.join(lists, ["h1", "h2"])
    pairs = given.select("id", F.slice(F.filter("near", lambda x: x["i"] != F.col("id")), 1, k).alias("near"))
    return pairs.select("id", F.explode("near").alias("n")).select("id", F.col("n.i").alias("neighbour"), (-F.col("n.d")).alias("cosine")).where(F.col("cosine") >= min_cosine)


def neighbour_pairs(df: DataFrame, id_col: str, vector_col: str, k: int = 5, min_cosine: float = 0.8, params: TreeParams = TreeParams()) -> DataFrame:
    """Pairs (id_a < id_b) of which one is among the other's k most similar rows."""
    near = nearest_rows(df, id_col, vector_col, k, min_cosine, params=params)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def measured_recall(df: DataFrame, found: DataFrame, id_col: str, vector_col: str, k: int = 5, min_cosine: float = -1.0, every: int = 50, block: int = 512, params: TreeParams = TreeParams()) -> tuple[int, int]:
    """(exact neighbours, those of them in ``found``) of the rows whose id is divisible by ``every``, by brute force against all rows, in blocks of ``block`` queries.

    found: (id, neighbour) of nearest_rows. This is a measurement, not part of the search.
    """
    coded = _coded(df, id_col, vector_col, params)
    common = coded.groupBy("width").count().orderBy(F.desc("count"), "width").head()
    if common is None:
        return 0, 0
    width = common["width"]
    rows = coded.where(F.col("width") == width)
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).dropDuplicates(["id"])
    blocks = max(1, -(-asked.count() // block))
    wanted = hits = 0
    answers = found.where(F.pmod("id", F.lit(every)) == 0).select("id", "neighbour")
    for n in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n).select("id", "packed").collect()
        if not part:
            continue
        shared = df.sparkSession.sparkContext.broadcast((np.array([r["id"] for r in part]), _unpack([bytes(r["packed"]) for r in part], width)))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qid, qx = shared.value
            query = (np.stack([qid, qid], axis=1), qid, qx, _unit(qx))
            for b in _slices(batches):
                ids, _, x = _read(b, width)
                at = np.unique(ids, return_index=True)[1]
                out: list[list] = [[] for _ in range(6)]
                # Here a row's id stands for its class, so that copies count as rows of their own.
                _nearest(query, (np.stack([ids[at], ids[at]], axis=1), ids[at], x[at], _unit(x[at])), k, min_cosine, out)
                cols = [np.concatenate(c) for c in out]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[4]), pa.array(cols[5])], names=["id", "neighbour", "cosine"])

        near = rows.select("id", "h1", "h2", "packed").mapInArrow(scan, "id long, neighbour long, cosine double").distinct()
        best = near.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))).where(F.col("rank") <= k)
        got = best.join(answers.withColumn("hit", F.lit(1)), ["id", "neighbour"], "left").agg(F.count("*"), F.count("hit")).head()
        wanted, hits = wanted + got[0], hits + got[1]
        shared.unpersist()
    return wanted, hits
