"""Sampling, splitting and resampling; randomness is a hash of the row key, so every retry draws the same rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.distributions import normal_quantile
from assayer.functions.values import as_col, number, once, share, unit_hash
from assayer.operators.profile import mean_std
from assayer.plans.columns import dtype, numeric_columns, text_columns
from assayer.plans.lookup import lookup_join
from assayer.plans.ordered import row_numbers
from assayer.session import cut

# ---- fixed values -------------------------------------------------------------------------
DRIFT = {"low": (.1, .05, .02), "medium": (.3, .1, .05), "high": (.5, .2, .1)}  # shift, noise, missing
# -------------------------------------------------------------------------------------------


def sample_rows(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all when fewer): the smallest key hashes; tasks forward at most ``n`` rows each."""
    return df.withColumn("__h", unit_hash(key, seed)).orderBy("__h", *key).limit(n).drop("__h")


def shuffled(df: DataFrame, key: Sequence[str], by: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Add ``rn``: exact position in hash order within the classes ``by``, computed over ranges."""
    return row_numbers(df.withColumn("__h", unit_hash(key, seed)), ["__h", *key], by, "rn").drop("__h")


def split(df: DataFrame, key: Sequence[str], label: str | None = None, test: float = .2, val: float = .1, seed: int = 42) -> DataFrame:
    """Add ``split``; the test share and then the validation share of the rest, exact within every class."""
    by = [label] if label else []
    numbered = shuffled(df, key, by, seed)
    if label:
        sized = lookup_join(numbered, df.groupBy(label).agg(F.count(F.lit(1)).alias("__n")), [label])
    else:
        sized = numbered.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("__n"))))
    n_test = F.floor(F.col("__n") * test)
    n_val = F.floor((F.col("__n") - n_test) * val)
    part = F.when(F.col("rn") <= n_test, "test").when(F.col("rn") <= n_test + n_val, "val").otherwise("train")
    return sized.select(*df.columns, part.alias("split"))


def folds(df: DataFrame, key: Sequence[str], k: int = 5, label: str | None = None, seed: int = 42) -> DataFrame:
    """Add ``fold`` 0..k-1, sizes equal to within one row (within every class when ``label`` is given)."""
    return shuffled(df, key, [label] if label else [], seed).select(*df.columns, ((F.col("rn") - 1) % k).cast("int").alias("fold"))


def time_folds(df: DataFrame, order_by: Sequence[str], k: int = 5) -> DataFrame:
    """Add ``fold`` as consecutive blocks in time order."""
    numbered = row_numbers(df, order_by, (), "rn").crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("__n"))))
    return numbered.select(*df.columns, F.floor((F.col("rn") - 1) * k / F.col("__n")).cast("int").alias("fold"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight) with weight n / (k * n_class)."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    tot = per.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"))
    return per.crossJoin(F.broadcast(tot)).select(label, "n", (F.col("t") / (F.col("k") * F.col("n"))).alias("weight"))


def needs_resampling(df: DataFrame, label: str, limit: float = .7) -> DataFrame:
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    top = share(F.max("n"), F.sum("n"))
    return per.agg(top.alias("majority_share"), (top >= limit).alias("resample"))


def under_random(df: DataFrame, label: str, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Every class reduced to the size of the smallest, by hash order."""
    least = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("__least"))
    return shuffled(df, key, [label], seed).crossJoin(F.broadcast(least)).where(F.col("rn") <= F.col("__least")).select(*df.columns)


def bootstrap(df: DataFrame, key: Sequence[str], rounds: int = 50, seed: int = 42) -> DataFrame:
    """Rows repeated per round with a Poisson(1) ``weight`` (rows not drawn are left out)."""
    cdf, term, acc = [], math.exp(-1), 0.0
    for k in range(1, 13):
        acc += term
        cdf.append(acc)
        term /= k
    each = df.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    u = unit_hash(key, F.concat(F.lit(f"{seed}-"), F.col("round").cast("string")))
    drawn = once(each, {"__u": u}).where(F.col("__u") >= cdf[0])
    weight = sum((F.when(F.col("__u") >= c, 1).otherwise(0) for c in cdf), F.lit(0))
    return drawn.withColumn("weight", weight).drop("__u")


def with_gaussians(df: DataFrame, key: Sequence[str], seeds: Mapping[str, str]) -> DataFrame:
    """Add standard normal columns ``{name: seed}`` of a row key.

    The hash is a column of its own first: the quantile refers to it many times and must not repeat it.
    """
    low = lambda u: F.when(u < 1e-9, 1e-9).otherwise(u)
    drawn = once(df, {f"__u_{n}": low(unit_hash(key, s)) for n, s in seeds.items()})
    return drawn.withColumns({n: normal_quantile(F.col(f"__u_{n}")) for n in seeds}).drop(*[f"__u_{n}" for n in seeds])


def add_noise(df: DataFrame, level: float, key: Sequence[str], cols: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """Gaussian noise of ``level`` standard deviations on numeric columns (keys untouched)."""
    cols = [c for c in numeric_columns(df, cols) if c not in key]
    sd = {c: s or 0.0 for c, (_, s) in mean_std(df, cols).items()}
    drawn = with_gaussians(df, key, {f"__z_{c}": f"{seed}-{c}" for c in cols})
    return drawn.withColumns({c: number(c, dtype(df, c)) + F.col(f"__z_{c}") * (level * sd[c]) for c in cols}).select(*df.columns)


def synthesize_drift(df: DataFrame, severity: str, key: Sequence[str], target: str | None = None, seed: int = 42) -> DataFrame:
    """Shift and noise on numbers, swapped categories, planted nulls; key and target untouched."""
    shift, noise, missing = DRIFT[severity]
    skip = {*key, target}
    nums = [c for c in numeric_columns(df) if c not in skip]
    out = add_noise(df, math.hypot(shift, noise), key, nums, seed) if nums else df
    for c in [c for c in text_columns(df) if c not in skip]:
        values = df.select(as_col(c).alias("__v")).where("__v is not null").distinct()
        codes = cut(row_numbers(values, ["__v"], name="__code").withColumn("__code", F.col("__code") - 1))
        n = codes.count()
        if n < 2:
            continue
        hop = 1 + F.floor(unit_hash(key, f"{seed}-to-{c}") * (n - 1)).cast("int")
        coded = lookup_join(out.withColumn("__v", as_col(c)), codes, ["__v"]).drop("__v")
        moved = coded.withColumn("__to", F.when(unit_hash(key, f"{seed}-swap-{c}") < shift, F.pmod(F.col("__code") + hop, F.lit(n))))
        other = codes.select(F.col("__v").alias("__new"), F.col("__code").alias("__to"))
        out = lookup_join(moved, other, ["__to"]).withColumn(c, F.coalesce("__new", as_col(c))).drop("__new", "__to", "__code").select(*df.columns)
    gone = [c for c in nums + text_columns(df) if c not in skip]
    return out.withColumns({c: F.when(unit_hash(key, f"{seed}-null-{c}") >= missing, as_col(c)) for c in gone})
