"""Centroid clustering of integer vectors by a progressive search over Walsh-Hadamard coefficients.

The transform of 64 integers is exact and keeps distances up to the factor 64, so the squared differences of the first
coefficients, coarse ones (few sign changes) first, never exceed the whole: a centroid whose part is already greater than
the whole distance of another one is strictly worse and is left out; those that stay are summed over all 64.  A round is one
pass over the table: tasks return the sums and the count of each centroid, so equal or crowded vectors cost no more than
others, and the driver holds the centroids only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.values import as_col
from assayer.llm.common import small_batches, stored

SIZE = 64
SCALE = 256
#: Integers up to this bound are transformed, squared and summed within 64 bits; beyond, Python's own integers are used.
SMALL = 1 << 21
LARGEST = 10 ** 27
LEVELS = (0, 4, 8, 16, 32, 64)
LONG = 1 << 63
ROWS = 2048


def scaled(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of doubles, as 64-bit integers where all are small; held at +-LARGEST."""
    big = np.abs(values) * scale >= SMALL
    if not big.any():
        return np.floor(values * scale).astype(np.int64)
    rows = [[int(x) * scale if abs(x) > 2.0 ** 53 else int(np.floor(x * scale)) for x in row] for row in values.tolist()]
    out = np.empty(values.shape, dtype=object)
    out[:] = [[max(-LARGEST, min(LARGEST, x)) for x in row] for row in rows]
    return out


def _sequency() -> np.ndarray:
    """Places of the transform's coefficients by their number of sign changes."""
    matrix = np.array([[1]])
    while len(matrix) < SIZE:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    return np.argsort((np.diff(matrix, axis=1) != 0).sum(axis=1), kind="stable")


_ORDER = _sequency()


def walsh(vectors: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, coarse coefficients first; exact integers."""
    n, step = len(vectors), 1
    while step < SIZE:
        pairs = vectors.reshape(n, SIZE // (2 * step), 2, step)
        vectors = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, SIZE)
        step *= 2
    return vectors[:, _ORDER]


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid; of equal ones the smallest number."""
    if vectors.dtype == object or centroids.dtype == object:
        vectors, centroids = vectors.astype(object), centroids.astype(object)
    own, others = walsh(vectors), walsh(centroids)
    coarse = LEVELS[1]
    part = _squares(own[:, None, :coarse], others[None, :, :coarse])
    leader = part.argmin(axis=1)
    bound = _squares(own, others[leader])
    row, number = np.nonzero(part <= bound[:, None])
    part = part[row, number]
    for a, b in zip(LEVELS[1:], LEVELS[2:]):
        part = part + _squares(own[row, a:b], others[number, a:b])
        keep = part <= bound[row]
        row, number, part = row[keep], number[keep], part[keep]
    # Every row keeps one centroid at least, and its centroids in ascending order.
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    least = np.minimum.reduceat(part, first)
    at = np.flatnonzero(part == least[row])
    at = at[np.r_[True, row[at][1:] != row[at][:-1]]]
    return number[at], part[at] // SIZE


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)


def _array(rows: list[list[int]]) -> np.ndarray:
    """The rows as 64-bit integers where all are small, else as Python's."""
    if all(-SMALL < x < SMALL for r in rows for x in r):
        return np.array(rows, dtype=np.int64)
    return np.array(rows, dtype=object)


def kept_vectors(table: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the rows with exactly 64 components, none of them null, NaN or infinite."""
    fits = (F.size("vec") == SIZE) & F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return table.select(as_col(id_col).cast("long").alias("vec_id"), as_col(column).cast("array<double>").alias("vec")).where(fits)


def start(kept: DataFrame, k: int, seed: int, scale: int = SCALE) -> list[list[int]]:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:vec_id`` (ties: of the smallest components)."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(name.alias("h"), "vec").orderBy("h", "vec").limit(k).collect()
    return [[int(x) for x in row] for row in scaled(np.array([r["vec"] for r in rows]).reshape(-1, SIZE), scale)]


def _moved(kept: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """The centroids after a round: floors of exact means; one without vectors stays."""
    fixed = _array(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(fixed.shape, dtype=object), [0] * len(fixed)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                vectors = scaled(_matrix(b.column(0).slice(at, ROWS)), scale)
                number, _ = nearest(vectors, fixed)
                order = np.argsort(number, kind="stable")
                groups = np.flatnonzero(np.r_[True, np.diff(number[order]) != 0])
                names = number[order][groups]
                sums[names] += np.add.reduceat(vectors[order], groups, axis=0)
                for c, n in zip(names.tolist(), np.diff(np.r_[groups, len(order)]).tolist()):
                    counts[c] += n
        own = [c for c in range(len(fixed)) if counts[c]]
        if own:
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int32()), pa.array([counts[c] for c in own], pa.int64()),
                 pa.array([[Decimal(int(x)) for x in sums[c]] for c in own], pa.list_(pa.decimal128(38, 0)))], names=["cluster", "n", "sums"])

    parts = kept.select("vec").mapInArrow(run, "cluster int, n long, sums array<decimal(38,0)>")
    totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(SIZE)]).alias("sums"))
    new = list(centroids)
    for r in totals.collect():
        new[r["cluster"]] = [int(x) // r["n"] for x in r["sums"]]
    return new


def cluster(table: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, id_col: str = "vec_id", column: str = "embedding",
            scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector with 64 finite components.

    Vectors with nulls, NaN, infinities or another length give no row; repeated rows count and give a row each; a null
    vec_id counts with an empty name; fewer than ``k`` vectors make as many centroids; an empty table gives no rows.  Scaled
    components are held at +-10^27, and a distance or inertia beyond a long is null.  Other columns are not read.
    """
    spark = table.sparkSession
    small_batches(spark)
    kept = kept_vectors(table, id_col, column)
    centroids = start(kept, k, seed, scale)
    schema = "vec_id long, cluster int, distance long"
    if not centroids:
        return spark.createDataFrame([], schema + ", cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = _moved(kept, centroids, scale)
    fixed = _array(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                number, distance = nearest(scaled(_matrix(part.column(1)), scale), fixed)
                far = pa.array([None if d >= LONG else d for d in distance.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(number, pa.int32()), far], names=["vec_id", "cluster", "distance"])

    assigned = stored(kept.mapInArrow(run, schema), "assigned")
    total = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    own = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(total.alias("s")).collect()}
    long_of = lambda x: None if x is None or x >= LONG else int(x)
    inertia = long_of(None if None in own.values() else sum(own.values()))
    named = [(c, long_of(s), inertia, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in own.items()]
    sums = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # at most k rows
    return assigned.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
