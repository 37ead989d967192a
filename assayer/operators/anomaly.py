"""Multivariate outlier models: isolation forest and robust (minimum covariance determinant) distance."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.values import number, unit_hash
from assayer.plans.columns import dtype
from assayer.plans.gram import cross_products
from assayer.plans.quantiles import exact_quantiles
from assayer.session import cut


def _path_norm(n: float) -> float:
    return 2 * (math.log(n - 1) + .5772156649) - 2 * (n - 1) / n if n > 2 else 1.0 if n == 2 else 0.0


def isolation_trees(df: DataFrame, key: Sequence[str], cols: Sequence[str], trees: int = 100, rows: int = 256, seed: int = 42) -> list[dict]:
    """Random isolation trees, each grown by one task on ``rows`` hashed rows; trees * rows * 2 nodes in all."""
    n = df.count()
    x = df.select(*key, *[number(c, dtype(df, c)).alias(f"x{i}") for i, c in enumerate(cols)])
    # about three times the wanted rows are drawn (small tables lend a row to several trees), then ``rows`` kept per tree
    rate = min(1.0, 3.0 * trees * rows / max(n, 1))
    copies = min(trees, max(1, math.ceil(3 * trees * rows / max(n, 1))))
    thin = x.where(unit_hash(key, f"{seed}-thin") < rate)
    drawn = thin.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    drawn = drawn.withColumn("tree", F.floor(unit_hash([*key, "copy"], f"{seed}-tree") * trees).cast("int")) \
        .withColumn("h", unit_hash([*key, "copy"], seed))
    w = Window.partitionBy("tree").orderBy("h", *key)
    sample = drawn.withColumn("r", F.row_number().over(w)).where(F.col("r") <= rows).drop("r")
    names = [f"x{i}" for i in range(len(cols))]

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed + int(pdf["tree"].iloc[0]))
        data = pdf.sort_values("h")[names].to_numpy(float)
        data = np.where(np.isnan(data), 0.0, data)
        depth = math.ceil(math.log2(max(len(data), 2)))
        feat, cutp, left, right, size = [], [], [], [], []

        def node(rows_: np.ndarray, level: int) -> int:
            at = len(feat)
            feat.append(-1), cutp.append(0.0), left.append(-1), right.append(-1), size.append(float(len(rows_)))
            spread_ = np.flatnonzero(rows_.max(axis=0) > rows_.min(axis=0)) if len(rows_) > 1 else []
            if level < depth and len(spread_):
                f = int(rng.choice(spread_))
                c = float(rng.uniform(rows_[:, f].min(), rows_[:, f].max()))
                low = rows_[:, f] <= c
                feat[at], cutp[at] = f, c
                left[at] = node(rows_[low], level + 1)
                right[at] = node(rows_[~low], level + 1)
            return at

        node(data, 0)
        return pd.DataFrame({"tree": [pdf["tree"].iloc[0]], "n": [len(data)], "feat": [feat], "cut": [cutp], "lhs": [left], "rhs": [right], "size": [size]})

    got = sample.groupBy("tree").applyInPandas(grow, "tree int, n int, feat array<int>, cut array<double>, lhs array<int>, rhs array<int>, size array<double>").collect()
    return [{"n": r["n"], **{k: np.array(r[k]) for k in ("feat", "cut", "lhs", "rhs", "size")}} for r in sorted(got, key=lambda r: r["tree"])]


def isolation_scores(df: DataFrame, key: Sequence[str], cols: Sequence[str], trees: int = 100, rows: int = 256, seed: int = 42) -> DataFrame:
    """``df`` with ``score`` in (0, 1), higher = more isolated (a null counts as 0)."""
    forest = isolation_trees(df, key, cols, trees, rows, seed)
    norm = _path_norm(max(t["n"] for t in forest))
    for t in forest:
        t["pad"] = np.array([_path_norm(s) for s in t["size"]])

    @F.pandas_udf("double")
    def score(*x: pd.Series) -> pd.Series:
        data = np.nan_to_num(np.column_stack([s.to_numpy(float) for s in x]))
        total = np.zeros(len(data))
        for t in forest:
            at, level = np.zeros(len(data), dtype=int), np.zeros(len(data))
            live = t["feat"][at] >= 0
            while live.any():
                i = np.flatnonzero(live)
                f = t["feat"][at[i]]
                low = data[i, f] <= t["cut"][at[i]]
                at[i] = np.where(low, t["lhs"][at[i]], t["rhs"][at[i]])
                level[i] += 1
                live = t["feat"][at] >= 0
            total += level + t["pad"][at]
        return pd.Series(2 ** (-total / len(forest) / norm))

    return df.withColumn("score", score(*[number(c, dtype(df, c)) for c in cols]))


def remove_isolated(df: DataFrame, key: Sequence[str], cols: Sequence[str], contamination: float = .05, **kw) -> DataFrame:
    """Drop the ``contamination`` share of rows with the highest isolation score."""
    scored = cut(isolation_scores(df, key, cols, **kw))
    limit = exact_quantiles(scored, ["score"], [1 - contamination])["score"][0]
    return scored.where(F.col("score") <= limit).drop("score")


def robust_distance(df: DataFrame, cols: Sequence[str], support: float | None = None, rounds: int = 10) -> DataFrame:
    """``df`` with the squared Mahalanobis ``distance`` under a robust mean and covariance.

    Concentration steps: covariance of the current core by one cross-product pass, then the core becomes the rows
    below the exact support quantile of the distance; repeated until it no longer changes.
    """
    p = len(cols)
    n = df.count()
    share = support or min(1.0, (n + p + 1) / (2 * n))
    x = {c: number(c, dtype(df, c)) for c in cols}
    d = df.select("*", *[x[c].alias(f"__x{i}") for i, c in enumerate(cols)])
    names = [f"__x{i}" for i in range(p)]
    mid = exact_quantiles(d, names, [.25, .5, .75])
    mean = np.array([mid[c][1] for c in names])
    inv = np.diag([1 / max(((mid[c][2] - mid[c][0]) / 1.349) ** 2, 1e-12) for c in names])  # robust start: medians and quartile spreads
    last = None

    def distance(m: np.ndarray, a: np.ndarray):
        diff = [F.col(c) - F.lit(float(v)) for c, v in zip(names, m)]
        out = F.lit(0.0)
        for i in range(p):
            for j in range(i, p):
                out = out + diff[i] * diff[j] * F.lit(float(a[i, j] if i == j else 2 * a[i, j]))
        return out

    for _ in range(rounds):
        limit = exact_quantiles(d.select(distance(mean, inv).alias("q")), ["q"], [share])["q"][0]
        core = d.where(distance(mean, inv) <= limit).select(*names)
        k, s, g = cross_products(core, names, mean)
        shift = s / k
        cov = g / k - np.outer(shift, shift)
        mean, inv, det = mean + shift, np.linalg.pinv(cov), float(np.linalg.det(cov))
        if last is not None and abs(last - det) <= 1e-10 * abs(last):
            break
        last = det
    return d.withColumn("distance", distance(mean, inv)).drop(*names)


def remove_elliptic(df: DataFrame, cols: Sequence[str], contamination: float = .05) -> DataFrame:
    """Drop the ``contamination`` share of rows farthest from the robust centre."""
    scored = robust_distance(df, cols)
    limit = exact_quantiles(scored, ["distance"], [1 - contamination])["distance"][0]
    return scored.where(F.col("distance") <= limit).drop("distance")
