"""Row filters and per-column treatment: deduplication, outliers, imputation, transforms, scaling, binning.

Every fitted operator is split in ``fit`` (an aggregate of a few numbers per column) and ``apply`` (expressions),
so a test table is treated with the numbers of its training table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.values import all_of, any_of, as_col, clip, nan_is_missing, number, total
from assayer.operators.profile import iqr_fences, mean_std
from assayer.plans.columns import dtype, long_agg, numeric_columns, value_counts
from assayer.plans.ordered import neighbours
from assayer.plans.quantiles import even_quantiles, exact_quantiles, order_statistics


@nan_is_missing
def dedup(df: DataFrame, subset: Sequence[str] | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """Drop duplicate rows; with ``subset`` the first row in ``order_by`` order is kept.

    The first row of a key is a minimum over a struct, so copies meet map-side and no key is collected.
    """
    if subset is None:
        return df.dropDuplicates()
    if not order_by:
        raise ValueError("keeping the first row needs order_by")
    rest = [c for c in df.columns if c not in subset]
    first = F.min_by(F.struct(*[as_col(c) for c in rest]), F.struct(*[as_col(c) for c in order_by])).alias("__row")
    return df.groupBy(*subset).agg(first).select(*subset, "__row.*").select(*df.columns)


# ---- table-wide outliers --------------------------------------------------------------------

def _inside(df: DataFrame, cols: Sequence[str], bounds: Mapping[str, tuple[float, float]]) -> Column:
    return all_of([number(c, dtype(df, c)).between(*bounds[c]) for c in cols if c in bounds])


@nan_is_missing
def z_bounds(df: DataFrame, cols: Sequence[str], limit: float, sample: bool = True) -> dict[str, tuple[float, float]]:
    """mean -+ limit * deviation; constant columns are left out."""
    return {c: (m - limit * s, m + limit * s) for c, (m, s) in mean_std(df, cols, sample).items() if s}


@nan_is_missing
def remove_outliers_iqr(df: DataFrame, cols: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    """Keep rows inside the fences of every numeric column; a null in any of them drops the row."""
    cols = numeric_columns(df, cols)
    return df.filter(_inside(df, cols, iqr_fences(df, cols, k)))


@nan_is_missing
def remove_outliers_z(df: DataFrame, cols: Sequence[str] | None = None, limit: float = 3.0) -> DataFrame:
    """Keep rows within ``limit`` deviations in every numeric column; constant columns are ignored."""
    cols = numeric_columns(df, cols)
    return df.filter(_inside(df, cols, z_bounds(df, cols, limit)))


@nan_is_missing
def flag_outliers(df: DataFrame, methods: Sequence[str] = ("iqr", "zscore"), cols: Sequence[str] | None = None,
                  vote: str = "majority", k: float = 1.5, limit: float = 3.0,
                  extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Add ``outlier_<method>`` and their combination ``outlier`` (union, intersection or majority); nulls are inliers."""
    cols = numeric_columns(df, cols)
    flags: dict[str, Column] = {}
    for m in methods:
        b = iqr_fences(df, cols, k) if m == "iqr" else z_bounds(df, cols, limit)
        x = {c: number(c, dtype(df, c)) for c in b}
        flags[m] = F.coalesce(any_of([F.coalesce((x[c] < b[c][0]) | (x[c] > b[c][1]), F.lit(False)) for c in b]), F.lit(False))
    flags |= {m: F.coalesce(e, F.lit(False)) for m, e in (extra or {}).items()}
    out = df.select("*", *[e.alias(f"outlier_{m}") for m, e in flags.items()])
    votes = total([F.col(f"outlier_{m}").cast("int") for m in flags])
    rule = {"union": votes >= 1, "intersection": votes == len(flags), "majority": votes > len(flags) / 2}[vote]
    return out.withColumn("outlier", rule)


# ---- per-column outlier treatment -----------------------------------------------------------

@nan_is_missing
def outlier_bounds(df: DataFrame, cols: Sequence[str], method: str, threshold: float = 1.5) -> dict[str, tuple[float, float]]:
    """Limits per column for a treatment: percentile, fence, deviation or rank based."""
    if method == "cap":
        return {c: (q[0], q[1]) for c, q in exact_quantiles(df, cols, [.01, .99]).items() if q[0] is not None}
    if method == "zscore_cap":
        return z_bounds(df, cols, threshold)
    if method == "winsorize":
        out = {}
        for c in cols:
            vals, n = order_statistics(df, c, lambda n: [int(.01 * n), n - 1 - int(.01 * n)])
            if n:
                out[c] = (vals[0], vals[1])
        return out
    return iqr_fences(df, cols, threshold)


@nan_is_missing
def treat_outliers(df: DataFrame, method: str, cols: Sequence[str] | None = None, threshold: float = 1.5,
                   bounds: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """remove (nulls kept), cap, winsorize, iqr_cap, zscore_cap or null."""
    cols = numeric_columns(df, cols)
    b = bounds or outlier_bounds(df, cols, method, threshold)
    x = {c: number(c, dtype(df, c)) for c in b}
    if method == "remove":
        out = any_of([F.coalesce((x[c] < b[c][0]) | (x[c] > b[c][1]), F.lit(False)) for c in b])
        return df.filter(~out)
    if method == "null":
        return df.withColumns({c: F.when((x[c] >= b[c][0]) & (x[c] <= b[c][1]), as_col(c)) for c in b})
    return df.withColumns({c: clip(x[c], F.lit(b[c][0]), F.lit(b[c][1])) for c in b})


# ---- imputation -----------------------------------------------------------------------------

@nan_is_missing
def fill_values(df: DataFrame, method: str, cols: Sequence[str]) -> dict[str, object]:
    """The one fill value per column: mean, median or most_frequent (smallest on ties)."""
    if method == "median":
        return {c: q[0] for c, q in exact_quantiles(df, cols, [.5]).items()}
    if method == "mean":
        return {c: m for c, (m, _) in mean_std(df, cols).items()}
    native = {c: df.where(as_col(c).isNotNull()).groupBy(as_col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n"), F.asc("v")).first() for c in cols}
    return {c: row["v"] if row else None for c, row in native.items()}


@nan_is_missing
def impute(df: DataFrame, method: str, cols: Sequence[str], value: object = 0, values: Mapping[str, object] | None = None) -> DataFrame:
    """mean, median, most_frequent or constant; pass ``values`` to reuse the fit of another table."""
    fills = values or ({c: value for c in cols} if method == "constant" else fill_values(df, method, cols))
    return df.withColumns({c: F.coalesce(as_col(c), F.lit(fills[c])) for c in cols if fills[c] is not None})


@nan_is_missing
def impute_ordered(df: DataFrame, method: str, col: str, order_by: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    """forward_fill, backward_fill, or interpolate by row position (leading nulls stay, trailing take the last value)."""
    n = neighbours(df, col, order_by, key)
    if method == "forward_fill":
        filled = F.col("prev.v")
    elif method == "backward_fill":
        filled = F.col("next.v")
    else:
        gap = (F.col("next.p") - F.col("prev.p")).cast("double")
        slope = (F.col("next.v") - F.col("prev.v")) * (F.col("pos") - F.col("prev.p")) / gap
        filled = (F.when(as_col(col).isNotNull(), as_col(col)).when(F.col("prev").isNull(), F.lit(None))
                  .when(F.col("next").isNull(), F.col("prev.v")).otherwise(F.col("prev.v") + slope))
    return n.withColumn(col, filled).select(*df.columns)


# ---- transforms -----------------------------------------------------------------------------

@nan_is_missing
def transform(df: DataFrame, method: str, cols: Sequence[str], degree: int = 2, lows: Mapping[str, float] | None = None) -> DataFrame:
    """log, log1p, sqrt, square, reciprocal, polynomial; log and sqrt shift by the (fitted) minimum where needed."""
    x = {c: number(c, dtype(df, c)) for c in cols}
    if method in ("log", "sqrt"):
        lows = lows or {r["column_name"]: r["lo"] for r in long_agg(df, cols, {"lo": lambda c: F.min(x[c])}).collect()}
    out: dict[str, Column] = {}
    for c in cols:
        v = x[c]
        if method == "log":
            out[c] = F.ln(v - lows[c] + 1 if lows[c] is not None and lows[c] <= 0 else v)
        elif method == "sqrt":
            out[c] = F.sqrt(v - lows[c] if lows[c] is not None and lows[c] < 0 else v)
        elif method == "log1p":
            out[c] = F.log1p(v)
        elif method == "square":
            out[c] = v * v
        elif method == "polynomial":
            out[c] = F.pow(v, F.lit(float(degree)))
        elif method == "reciprocal":
            out[c] = F.try_divide(F.lit(1.0), v)
        else:
            raise ValueError(method)
    return df.withColumns(out)


def _power(x: Column, lam: float, family: str) -> Column:
    if family == "boxcox":
        return F.ln(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1) / lam
    pos = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    neg = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, pos).otherwise(neg)


@nan_is_missing
def power_lambdas(df: DataFrame, family: str, cols: Sequence[str], grid: int = 17, rounds: int = 4) -> dict[str, float | None]:
    """Maximum-likelihood exponent per column.

    One aggregation evaluates the log-likelihood of a grid of exponents for a column; each further round narrows
    the grid around the best one.  Box-Cox is refused (None) for columns with non-positive values.
    """
    out: dict[str, float | None] = {}
    for c in cols:
        d = df.select(number(c, dtype(df, c)).alias("x")).where("x is not null")
        jac = F.ln("x") if family == "boxcox" else F.signum("x") * F.log1p(F.abs("x"))
        head = d.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
        if head["lo"] is None or head["lo"] == head["hi"] or (family == "boxcox" and head["lo"] <= 0):
            out[c] = None
            continue
        lo, hi = -3.0, 5.0
        for _ in range(rounds):
            lams = [lo + (hi - lo) * i / (grid - 1) for i in range(grid)]
            row = d.agg(F.count(F.lit(1)).alias("n"), F.sum(jac).alias("j"),
                        *[F.var_pop(_power(F.col("x"), lam, family)).alias(f"v{i}") for i, lam in enumerate(lams)]).first()
            score = [-row["n"] / 2 * math.log(row[f"v{i}"]) + (lam - 1) * row["j"]
                     if row[f"v{i}"] and math.isfinite(row[f"v{i}"]) else -math.inf for i, lam in enumerate(lams)]
            best, step = lams[max(range(grid), key=score.__getitem__)], (hi - lo) / (grid - 1)
            lo, hi = best - step, best + step
        out[c] = best
    return out


@nan_is_missing
def power_transform(df: DataFrame, family: str, cols: Sequence[str]) -> DataFrame:
    """Box-Cox, or Yeo-Johnson followed by standardisation."""
    lams = power_lambdas(df, family, cols)
    out = df.withColumns({c: _power(number(c, dtype(df, c)), lam, family) for c, lam in lams.items() if lam is not None})
    return out if family == "boxcox" else scale(out, "standard", [c for c in cols if lams[c] is not None])


# ---- scaling --------------------------------------------------------------------------------

@nan_is_missing
def fit_scale(df: DataFrame, method: str, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(centre, width) per column; a zero width counts as one, so constants become zero."""
    if method == "standard":
        pairs = mean_std(df, cols, sample=False)
    elif method == "robust":
        pairs = {c: (q[1], q[2] - q[0]) for c, q in exact_quantiles(df, cols, [.25, .5, .75]).items() if q[0] is not None}
    else:
        rows = long_agg(df, cols, {"lo": lambda c: F.min(number(c, dtype(df, c))), "hi": lambda c: F.max(number(c, dtype(df, c)))}).collect()
        pairs = {r["column_name"]: ((r["lo"], r["hi"] - r["lo"]) if method == "minmax" else (0.0, max(abs(r["lo"]), abs(r["hi"]))))
                 for r in rows if r["lo"] is not None}
    return {c: (m, w if w else 1.0) for c, (m, w) in pairs.items() if m is not None}


@nan_is_missing
def scale(df: DataFrame, method: str, cols: Sequence[str], fitted: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """standard (population deviation), minmax, robust, maxabs, quantile_uniform or quantile_normal."""
    if method.startswith("quantile"):
        return quantile_scale(df, cols, normal=method.endswith("normal"))
    f = fitted or fit_scale(df, method, cols)
    return df.withColumns({c: (number(c, dtype(df, c)) - m) / w for c, (m, w) in f.items()})


@nan_is_missing
def quantile_scale(df: DataFrame, cols: Sequence[str], normal: bool = False, steps: int = 1000) -> DataFrame:
    """Position among up to ``steps`` exact quantiles, mean of the left and right reading on ties; optional normal scores."""
    from assayer.functions.distributions import normal_quantile

    out = {}
    for c in cols:
        refs = even_quantiles(df, c, steps)
        if not refs:
            continue
        out[c] = _rank_among(refs)(number(c, dtype(df, c)))
    res = df.withColumns(out)
    if normal:
        res = res.withColumns({c: normal_quantile(clip(as_col(c), F.lit(1e-7), F.lit(1 - 1e-7))) for c in out})
    return res


def _rank_among(refs: Sequence[float]):
    """Vectorised reading of a value on at most a thousand fitted knots (ties: mean of both readings)."""
    knots, at = np.asarray(refs, dtype=float), np.linspace(0, 1, len(refs))

    @F.pandas_udf("double")
    def rank(x: pd.Series) -> pd.Series:
        v = x.to_numpy(dtype=float, na_value=np.nan)
        left, right = np.interp(v, knots, at), -np.interp(-v, -knots[::-1], -at[::-1])
        return pd.Series(np.where(np.isnan(v), np.nan, (left + right) / 2)).where(~np.isnan(v))

    return rank


# ---- binning --------------------------------------------------------------------------------

@nan_is_missing
def bin_equal_width(df: DataFrame, col: str, bins: int = 5, name: str | None = None) -> DataFrame:
    """Right-closed bins of equal width, the minimum in the first one."""
    x = number(col, dtype(df, col))
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None or lo == hi:
        return df.withColumn(name or f"{col}_binned", F.when(x.isNotNull(), 0))
    at = F.ceil((x - lo) / ((hi - lo) / bins)) - 1
    return df.withColumn(name or f"{col}_binned", F.when(at < 0, 0).when(at >= bins, bins - 1).otherwise(at).cast("int"))


@nan_is_missing
def bin_quantile(df: DataFrame, col: str, bins: int = 5, drop_duplicates: bool = True, name: str | None = None) -> DataFrame:
    """Right-closed bins between quantile edges; repeated edges are merged, or leave the table unchanged."""
    edges = exact_quantiles(df, [col], [i / bins for i in range(bins + 1)])[col]
    uniq = sorted(set(e for e in edges if e is not None))
    if not drop_duplicates and len(uniq) < len(edges):
        return df
    x = number(col, dtype(df, col))
    inner = uniq[1:-1]
    at = total([(x > F.lit(e)).cast("int") for e in inner]) if inner else F.when(x.isNotNull(), 0)
    return df.withColumn(name or f"{col}_binned", at)


@nan_is_missing
def bin_kmeans(df: DataFrame, col: str, bins: int = 5, seed: int = 42, name: str | None = None) -> DataFrame:
    """One-dimensional k-means; bins numbered by centre, edges half way between centres."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    d = df.select(number(col, dtype(df, col)).alias("x")).where("x is not null")
    vec = VectorAssembler(inputCols=["x"], outputCol="features").transform(d)
    centres = sorted(float(c[0]) for c in KMeans(k=bins, seed=seed).fit(vec).clusterCenters())
    x = number(col, dtype(df, col))
    edges = [(a + b) / 2 for a, b in zip(centres, centres[1:])]
    at = total([(x > F.lit(e)).cast("int") for e in edges]) if edges else F.when(x.isNotNull(), 0)
    return df.withColumn(name or f"{col}_binned", at)


# ---- options declared by the reference's configuration ---------------------------------------

@nan_is_missing
def drop_low_variance(df: DataFrame, threshold: float = .01, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop numeric columns whose sample variance is below the threshold."""
    cols = numeric_columns(df, cols)
    return df.drop(*[c for c, (_, s) in mean_std(df, cols).items() if s is not None and s * s < threshold])


@nan_is_missing
def drop_missing(df: DataFrame, column_share: float = .3, row_share: float = .5) -> DataFrame:
    """Drop columns with more than ``column_share`` nulls, then rows with more than ``row_share`` nulls."""
    rows = long_agg(df, df.columns, {"m": lambda c: F.avg(as_col(c).isNull().cast("double"))}).collect()
    kept = df.drop(*[r["column_name"] for r in rows if r["m"] is not None and r["m"] > column_share])
    empty = total([as_col(c).isNull().cast("int") for c in kept.columns])
    return kept.filter(empty <= row_share * len(kept.columns))


@nan_is_missing
def correct_skew(df: DataFrame, cols: Sequence[str] | None = None, limit: float = 1.0) -> DataFrame:
    """log1p of the shifted value for columns with an absolute skewness over ``limit``."""
    cols = numeric_columns(df, cols)
    facts = long_agg(df, cols, {"g": lambda c: F.skewness(number(c, dtype(df, c))), "lo": lambda c: F.min(number(c, dtype(df, c)))}).collect()
    return df.withColumns({f["column_name"]: F.log1p(number(f["column_name"], dtype(df, f["column_name"])) - min(f["lo"], 0.0))
                           for f in facts if f["g"] is not None and abs(f["g"]) > limit})


@nan_is_missing
def downcast(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Integers to the narrowest type that holds the whole column."""
    from assayer.plans.columns import INTEGRAL, of_kind

    cols = of_kind(df, INTEGRAL, cols)
    facts = long_agg(df, cols, {"lo": lambda c: F.min(as_col(c).cast("bigint")), "hi": lambda c: F.max(as_col(c).cast("bigint"))}).collect()
    kinds = (("tinyint", 7), ("smallint", 15), ("int", 31))
    out = {}
    for f in facts:
        fits = [k for k, bits in kinds if f["lo"] is not None and -(2 ** bits) <= f["lo"] and f["hi"] < 2 ** bits]
        if fits:
            out[f["column_name"]] = as_col(f["column_name"]).cast(fits[0])
    return df.withColumns(out)


@nan_is_missing
def bucket_rare(df: DataFrame, col: str, max_categories: int, other: str = "other") -> DataFrame:
    """Keep the most frequent values, the rest becomes one value; null stays null."""
    top = value_counts(df, [col]).orderBy(F.desc("n"), F.asc("value")).limit(max_categories)
    keep = [r["value"] for r in top.collect()]
    return df.withColumn(col, F.when(as_col(col).isNull() | as_col(col).isin(*keep), as_col(col)).otherwise(other))


Step = Callable[[DataFrame], DataFrame]
