"""Exact nearest-neighbour search over a table of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS = ("l2sq", "l2", "cosine", "dot")


def distance(vector: Column, query: list[float] | Column, metric: str = "l2sq") -> Column:
    """The distance of a vector column to a query, in doubles; null for null vectors, other widths and null items.

    l2sq is the sum of squared differences, l2 its root, cosine 1 - cosine (null for a zero vector),
    dot 1 - dot product.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; there are {', '.join(METRICS)}")
    q = query if isinstance(query, Column) else F.array(*(F.lit(float(x)) for x in query))
    total = lambda pairs: F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)
    product = lambda a, b: F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    if metric in ("l2sq", "l2"):
        d = total(F.zip_with(vector, q, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))
        d = F.sqrt(d) if metric == "l2" else d
    elif metric == "dot":
        d = 1 - total(product(vector, q))
    else:
        d = 1 - total(product(vector, q)) / F.nullif(F.sqrt(total(product(vector, vector))) * F.sqrt(total(product(q, q))), F.lit(0.0))
    return F.when(F.size(vector) == F.size(q), d)


def similarity(d: Column) -> Column:
    """1 / (1 + distance); null at distance -1, which only the dot metric reaches."""
    return F.try_divide(F.lit(1.0), 1 + d)


def search(table: DataFrame, query: list[float], n: int = 5, where: dict[str, str] | None = None, vector: str = "vector", id_col: str = "id", metric: str = "l2sq") -> DataFrame:
    """The n nearest rows with distance and score, ties by id; ``where`` gives exact values that are filtered first.

    One pass: the filter reaches the scan, distances are taken batch by batch, and each task keeps n rows.

    Rows with null or unfit vectors are never hits; an empty table or n = 0 gives no rows. Added
    columns are named distance and score, and replace columns of these names.
    """
    for name, value in (where or {}).items():
        table = table.where(F.col(name) == F.lit(value))
    found = table.withColumn("distance", _distance_to(query, metric)(F.col(vector))).where(F.col("distance").isNotNull())
    return found.withColumn("score", similarity(F.col("distance"))).orderBy("distance", id_col).limit(n)


def _lists(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which lists are of that width without nulls, and their values in doubles."""
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    flat = column.flatten().to_numpy(zero_copy_only=False)  # null items become NaN
    at = np.nonzero(sizes == width)[0]
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    x = flat[starts[at][:, None] + np.arange(width)].astype("f8") if len(at) else np.zeros((0, width))
    good = ~np.isnan(x).any(axis=1)
    return at[good], x[good]


def _pairwise(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """The distance of each row of x to the same row of q, by differences, so that equal vectors are at 0."""
    if metric in ("l2sq", "l2"):
        d = ((x - q) ** 2).sum(axis=1)
        return np.sqrt(d) if metric == "l2" else d
    dots = np.einsum("ij,ij->i", x, q)
    if metric == "dot":
        return 1 - dots
    norms = np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1)
    return np.where(norms > 0, 1 - dots / np.where(norms > 0, norms, 1), np.nan)


def _distance_to(query: list[float], metric: str):
    """The distance to one query as a vectorised function of a vector column; null where ``distance`` is null."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; there are {', '.join(METRICS)}")
    q = np.array(query, "f8")

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out = np.full(len(column), np.nan)
            for lo in range(0, len(column), 1_024):
                at, x = _lists(column.slice(lo, 1_024), len(q))
                out[lo + at] = _pairwise(x, np.broadcast_to(q, x.shape), metric)
            yield pa.array(out, mask=np.isnan(out))

    return run


def _nearest(ids: np.ndarray, x: np.ndarray, q: np.ndarray, keep: int, metric: str, barred: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the ``keep`` nearest rows of each query, ties by id.

    A matrix product finds all rows within its error of the last place; these are measured exactly.
    """
    dots = q @ x.T
    if metric in ("l2sq", "l2"):
        xx, qq = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", q, q)
        rough = qq[:, None] + xx[None, :] - 2 * dots
        slack = 1e-12 * (qq[:, None] + xx.max(initial=0))
    elif metric == "dot":
        rough, slack = -dots, 1e-12 * (1 + np.abs(dots).max(axis=1, initial=0))[:, None]
    else:
        norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        rough, slack = np.where(norms > 0, -dots / np.where(norms > 0, norms, 1), np.inf), np.full((len(q), 1), 1e-12)
    if barred is not None:
        rough[barred] = np.inf
    m = min(keep, rough.shape[1])
    edge = np.partition(rough, m - 1, axis=1)[:, m - 1 : m]
    i, j = np.nonzero((rough <= edge + slack) & np.isfinite(rough))
    d = np.concatenate([np.zeros(0), *(_pairwise(x[j[lo : lo + 8_192]], q[i[lo : lo + 8_192]], metric) for lo in range(0, len(i), 8_192))])
    order = np.lexsort((ids[j], d, i))
    order = order[np.arange(len(order)) - np.searchsorted(i[order], i[order]) < keep]
    return i[order], j[order], d[order]


def search_many(
    table: DataFrame, queries: DataFrame, n: int = 5, vector: str = "vector", id_col: str = "id", metric: str = "l2sq", exclude: str | None = None, strict: bool = True, block: int = 8_192
) -> DataFrame:
    """(query_id, id, distance, score, rank): the n nearest rows of ``table`` for each row of ``queries``.

    queries: (query_id long, query_vector, and exclude_value where ``exclude`` names a column). The
    search is exact, so its work is the product of both sides. Queries are taken in blocks of bounded
    size; each block is sent to the tasks, which keep n rows per query and batch, so neither side is
    shuffled whole. With ``exclude`` rows whose column equals the query's exclude_value are left out
    before the ranking (strict), or the 3n nearest are ranked first and then filtered (not strict),
    which may leave fewer than n. Ids must be whole numbers; null ids and null or unfit vectors take no
    part on either side.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; there are {', '.join(METRICS)}")
    spark = table.sparkSession
    schema = "query_id long, id long, group string, distance double"
    own = F.col(exclude).cast("string") if exclude else F.lit(None).cast("string")
    rows = table.select(F.col(id_col).cast("long").alias("id"), own.alias("group"), F.col(vector).alias("vector")).where(F.col("id").isNotNull() & F.col("vector").isNotNull())
    cols = [F.col("query_id").cast("long").alias("query_id"), F.col("query_vector").cast("array<double>").alias("v"), (F.col("exclude_value") if exclude else F.lit(None)).cast("string").alias("group")]
    asked = queries.select(*cols).where(F.col("query_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))
    keep = n if strict else 3 * n
    blocks = max(1, -(-asked.count() // block))
    found = spark.createDataFrame([], schema)
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()  # about ``block`` rows
        by_width: dict[int, list] = {}
        for r in part:
            by_width.setdefault(len(r["v"]), []).append(r)
        shared = spark.sparkContext.broadcast({w: (np.array([r["query_id"] for r in v]), np.array([r["v"] for r in v]), np.array([r["group"] for r in v], object)) for w, v in by_width.items()})

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo in range(0, whole.num_rows, 2_048):
                    batch = whole.slice(lo, 2_048)
                    ids, groups = batch.column("id").to_numpy(zero_copy_only=False), np.array(batch.column("group").to_pylist(), object)
                    for width, (qid, q, qgroup) in shared.value.items():
                        at, x = _lists(batch.column("vector"), width)
                        for first in range(0, len(qid) if len(at) and keep > 0 else 0, 512):
                            mine = slice(first, first + 512)
                            barred = (groups[at][None, :] == qgroup[mine][:, None]) & np.array([g is not None for g in qgroup[mine]])[:, None] if exclude and strict else None
                            i, j, d = _nearest(ids[at], x, q[mine], keep, metric, barred)
                            cols = (pa.array(qid[mine][i], pa.int64()), pa.array(ids[at][j], pa.int64()), pa.array(groups[at][j], pa.string()), pa.array(d, pa.float64()))
                            yield pa.RecordBatch.from_arrays(list(cols), names=["query_id", "id", "group", "distance"])

        found = found.unionByName(rows.mapInArrow(scan, schema))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))  # limited before the shuffle
    best = found.distinct().withColumn("rank", rank).where(F.col("rank") <= keep)
    if exclude and not strict:
        source = asked.select("query_id", F.col("group").alias("own"))
        best = best.join(source, "query_id").where(F.col("own").isNull() | F.col("group").isNull() | (F.col("group") != F.col("own")))
        best = best.withColumn("rank", rank).where(F.col("rank") <= n)
    return best.select("query_id", "id", "distance", similarity(F.col("distance")).alias("score"), "rank")


def check_width(vector: Column, width: int) -> Column:
    """Whether a vector may be stored: not null, of that width, without nulls."""
    return vector.isNotNull() & (F.size(vector) == width) & ~F.exists(vector, lambda x: x.isNull())


VECTOR = T.ArrayType(T.FloatType())
