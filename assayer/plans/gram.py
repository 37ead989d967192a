"""Least squares from one cross-product pass: tasks send packed tiles of the products, the driver solves p equations.

A task sends one binary value for each tile of TILE x TILE columns, whatever the number of rows or cells.  Tiles are added by a
tree: FAN tasks' tiles in one place first, each added up as it streams in, then the rest.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.values import number
from assayer.plans.columns import dtype

TILE = 256
FAN = 64
FEW = 8  # columns whose products Spark sums itself, without rows going to Python
SMALL = 64  # columns whose products take a few pages only
MAX_FEATURES = 2000  # the driver solves as many equations; 32 MB of products per task


def complete(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Double columns, rows complete in all of them."""
    return df.select(*keep, *[number(c, dtype(df, c)).alias(c) for c in cols if c not in keep]).dropna(subset=list(cols))


_CELLS = "i int, j int, at int, v binary"


def _tiles(p: int, tile: int = TILE) -> list[tuple[int, int]]:
    """First rows and columns of the tiles of an upper triangle."""
    return [(i, j) for i in range(0, p, tile) for j in range(i, p, tile)]


def _packed(at: int, cells: Sequence[tuple[int, int, np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame([(i, j, at, np.ascontiguousarray(v).tobytes()) for i, j, v in cells], columns=["i", "j", "at", "v"]).astype(
        {"i": "int32", "j": "int32", "at": "int32"})


def _added(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sums of the tiles of equal (i, j, at); rows come sorted, so one sum is held."""
    key, total = None, None
    for pdf in parts:
        for i, j, at, v in pdf.itertuples(index=False):
            if (i, j, at) != key:
                if key is not None:
                    yield _packed(key[2], [(key[0], key[1], total)])
                key, total = (i, j, at), np.zeros(len(v) // 8)
            total += np.frombuffer(v)
    if key is not None:
        yield _packed(key[2], [(key[0], key[1], total)])


def _summed(tiles: DataFrame, p: int, fan: int = FAN) -> DataFrame:
    """(i, j, at, v) with one row for each tile; products of a few columns are added in one step."""
    first = [] if p <= SMALL and fan == FAN else [F.floor(F.col("at") / fan).cast("int")]
    for at in (*first, F.lit(0)):
        keyed = tiles.withColumn("at", at).repartition("i", "j", "at").sortWithinPartitions("i", "j", "at")
        tiles = keyed.mapInPandas(_added, _CELLS)
    return tiles


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def cross_products(df: DataFrame, cols: Sequence[str], shift: Sequence[float] | None = None, tile: int = TILE,
                   fan: int = FAN) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sums, X'X) of the columns after subtracting ``shift``."""
    p = len(cols)
    base = np.zeros(p) if shift is None else np.asarray(shift, dtype=float)
    if p <= FEW and (tile, fan) == (TILE, FAN):
        return _few_products(df, cols, base)

    def block(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, g = 0, np.zeros(p), np.zeros((p, p))
        for pdf in parts:
            x = pdf.to_numpy(dtype=float) - base
            n, s, g = n + len(x), s + x.sum(axis=0), g + x.T @ x
        if n:
            yield _packed(_task(), [(-1, -1, np.append(s, n)), *[(i, j, g[i:i + tile, j:j + tile]) for i, j in _tiles(p, tile)]])

    n, s, g = 0, np.zeros(p), np.zeros((p, p))
    for r in _summed(df.select(*cols).mapInPandas(block, _CELLS), p, fan).collect():
        v, i, j = np.frombuffer(bytes(r["v"])), r["i"], r["j"]
        if i < 0:
            n, s = int(v[-1]), v[:-1].copy()
        else:
            part = v.reshape(min(tile, p - i), -1)
            g[i:i + tile, j:j + tile] = part
            g[j:j + tile, i:i + tile] = part.T
    return n, s, g


def _few_products(df: DataFrame, cols: Sequence[str], base: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    p = len(cols)
    x = [F.coalesce(F.col(c), F.lit(float("nan"))) - F.lit(float(b)) for c, b in zip(cols, base)]  # a missing value shows in the products
    at = [(i, j) for i in range(p) for j in range(i, p)]
    n, *sums = df.agg(F.count(F.lit(1)), *[F.sum(v) for v in x], *[F.sum(x[i] * x[j]) for i, j in at]).first()
    sums = np.array([v or 0.0 for v in sums])
    g = np.zeros((p, p))
    for (i, j), v in zip(at, sums[p:]):
        g[i, j] = g[j, i] = v
    return n, sums[:p], g


def correlations(df: DataFrame, cols: Sequence[str], against: str | None = None, tile: int = TILE, fan: int = FAN) -> DataFrame:
    """(feature1, feature2, n, r): Pearson r of every pair, or of every column with ``against``, over the rows that have both.

    One pass of matrix products: a task sends a value per tile of pairs, whatever the number of rows.  Values are taken about an
    approximate median, which is a value of the column near its mean; a side without spread has no r.
    """
    from assayer.plans.quantiles import sketch

    cols = list(cols)
    p = len(cols)
    d = df.select(*[number(c, dtype(df, c)).alias(f"q{i}") for i, c in enumerate(cols)])
    mids = sketch(d, {i: (F.col(f"q{i}"), [.5]) for i in range(p)}, 200)
    mid = np.array([m["g"][0] if m["g"] and np.isfinite(m["g"][0]) else 0.0 for m in mids.values()])
    t = None if against is None else cols.index(against)
    names = ["n", "si", "sj", "qi", "qj", "g"]

    def block(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((4, p, p)) if t is None else np.zeros((6, p))
        for pdf in parts:
            x = pdf.to_numpy(dtype=float) - mid
            has = (~np.isnan(x)).astype(float)
            x = np.where(has > 0, x, 0.0)
            with np.errstate(invalid="ignore", over="ignore"):
                if t is None:
                    out += np.stack([has.T @ has, x.T @ has, (x * x).T @ has, x.T @ x])
                else:
                    u, own = x[:, t], has[:, t]
                    out += np.stack([has.T @ own, x.T @ own, has.T @ u, (x * x).T @ own, has.T @ (u * u), x.T @ u])
        if t is not None:
            yield _packed(_task(), [(-1, -1, out)])
            return
        n, s, q, g = out
        yield _packed(_task(), [(i, j, np.stack([n[i:i + tile, j:j + tile], s[i:i + tile, j:j + tile], s[j:j + tile, i:i + tile].T,
                                                  q[i:i + tile, j:j + tile], q[j:j + tile, i:i + tile].T, g[i:i + tile, j:j + tile]])) for i, j in _tiles(p, tile)])

    def pairs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for i, j, _, v in pdf.itertuples(index=False):
                v = np.frombuffer(v).reshape(6, -1)
                if t is not None:
                    a, b, keep = np.minimum(np.arange(p), t), np.maximum(np.arange(p), t), np.arange(p) != t
                else:
                    a, b = np.indices((min(tile, p - i), min(tile, p - j))).reshape(2, -1)
                    a, b = a + i, b + j
                    keep = a < b
                yield pd.DataFrame({"i": a[keep].astype("int32"), "j": b[keep].astype("int32"), **{c: x[keep] for c, x in zip(names, v)}})

    s = _summed(d.mapInPandas(block, _CELLS), p, fan).mapInPandas(pairs, "i int, j int, " + ", ".join(f"{c} double" for c in names))
    n = F.nullif(F.col("n"), F.lit(0.0))
    spread = lambda q, t: F.when(F.col(q) - F.col(t) * F.col(t) / n > 1e-13 * F.col(q), F.col(q) - F.col(t) * F.col(t) / n)
    r = F.try_divide(F.col("g") - F.col("si") * F.col("sj") / n, F.sqrt(spread("qi", "si")) * F.sqrt(spread("qj", "sj")))
    label = F.array(*map(F.lit, cols))
    return s.select(
        F.get(label, "i").alias("feature1"), F.get(label, "j").alias("feature2"), F.col("n").cast("bigint").alias("n"),
        F.when(r.isNotNull() & ~F.isnan(r), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))


@dataclass
class Fit:
    features: list[str]
    intercept: float
    coef: np.ndarray
    n: int
    r2: float

    def predict(self) -> Column:
        terms = [F.lit(float(self.intercept)), *[F.col(c) * F.lit(float(b)) for c, b in zip(self.features, self.coef)]]
        while len(terms) > 1:  # by halves, so that many features make no deep expression
            terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) // 2 * 2:]
        return terms[0]


def least_squares(df: DataFrame, features: Sequence[str], target: str, ridge: float = 0.0, max_features: int = MAX_FEATURES) -> Fit:
    """Ordinary (or ridge) least squares with intercept; columns are centred before the products are formed."""
    features = list(features)
    if len(features) > max_features:
        raise ValueError(f"more than {max_features} features")
    cols = [*features, target]
    means = np.array(df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).first(), dtype=float)
    n, s, g = cross_products(df, cols, means)
    g = g - np.outer(s, s) / n
    xx, xy, yy = g[:-1, :-1], g[:-1, -1], g[-1, -1]
    scale = np.sqrt(np.where(np.diag(xx) > 0, np.diag(xx), 1.0))
    a = xx / np.outer(scale, scale) + ridge * np.eye(len(features))
    beta = np.linalg.lstsq(a, xy / scale, rcond=1e-12)[0] / scale
    r2 = float(beta @ xy / yy) if yy > 0 else 0.0
    return Fit(features, float(means[-1] - beta @ means[:-1]), beta, n, r2)
