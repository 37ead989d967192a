"""Category encoders and feature construction; codes are small fitted tables joined back by value."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.columns_text import cyclic
from assayer.functions.values import as_col, nan_is_missing, number
from assayer.plans.columns import TEMPORAL, dtype, numeric_columns
from assayer.plans.gram import correlations
from assayer.plans.lookup import lookup_join
from assayer.plans.ordered import lags, row_numbers


@nan_is_missing
def one_hot(df: DataFrame, col: str, values: Sequence[str] | None = None, max_categories: int = 1000) -> DataFrame:
    """One boolean column per sorted value; null is false everywhere. More values than allowed is an error, not a cut."""
    if values is None:
        rows = df.select(as_col(col).alias("v")).where("v is not null").distinct().limit(max_categories + 1).collect()
        if len(rows) > max_categories:
            raise ValueError(f"{col} has more than {max_categories} values; use another encoder")
        values = sorted(r["v"] for r in rows)
    flags = [as_col(col).eqNullSafe(F.lit(v)).alias(f"{col}_{v}") for v in values]
    return df.select(*[as_col(c) for c in df.columns if c != col], *flags)


@nan_is_missing
def label_codes(df: DataFrame, col: str) -> DataFrame:
    """(value, code): 0-based rank of every distinct value in sort order, ranked over ranges."""
    vals = df.select(as_col(col).alias(col)).where(as_col(col).isNotNull()).distinct()
    return row_numbers(vals, [col], name="__code").select(col, (F.col("__code") - 1).alias("__code"))


@nan_is_missing
def label(df: DataFrame, col: str, codes: DataFrame | None = None) -> DataFrame:
    """Replace values by their codes; null and unseen values stay null."""
    coded = lookup_join(df, codes if codes is not None else label_codes(df, col), [col])
    return coded.withColumn(col, F.col("__code")).select(*df.columns)


@nan_is_missing
def ordinal(df: DataFrame, col: str, order: Sequence[str] | None = None) -> DataFrame:
    """Position in the given (or sort) order; unknown values get -1."""
    if order is not None:
        place = F.array_position(F.array(*[F.lit(v) for v in order]), as_col(col)) - 1
        return df.withColumn(col, F.coalesce(place, F.lit(-1)))
    coded = lookup_join(df, label_codes(df, col), [col])
    return coded.withColumn(col, F.coalesce(F.col("__code"), F.lit(-1))).select(*df.columns)


@nan_is_missing
def binary(df: DataFrame, col: str) -> DataFrame:
    """Bits of the label code, lowest first; a single value needs no bit."""
    codes = label_codes(df, col)
    n = codes.count()
    bits = math.ceil(math.log2(n)) if n > 1 else 0
    coded = lookup_join(df, codes, [col])
    return coded.select(*[as_col(c) for c in df.columns if c != col],
                        *[F.shiftright(F.col("__code"), i).bitwiseAND(F.lit(1).cast("bigint")).alias(f"{col}_binary_{i}") for i in range(bits)])


@nan_is_missing
def frequency(df: DataFrame, col: str) -> DataFrame:
    """Replace a value by its number of rows."""
    dim = df.where(as_col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("__n"))
    return lookup_join(df, dim, [col]).withColumn(col, F.col("__n")).select(*df.columns)


@nan_is_missing
def target_means(df: DataFrame, col: str, target: str, smoothing: float = 0.0) -> DataFrame:
    """(value, mean of target), drawn towards the global mean by ``smoothing`` pseudo rows."""
    y = number(target, dtype(df, target))
    per = df.where(as_col(col).isNotNull()).groupBy(col).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    if not smoothing:
        return per.select(col, F.try_divide(F.col("s"), F.col("n")).alias("__mean"))
    whole = df.agg(F.avg(y).alias("m"))
    return per.crossJoin(F.broadcast(whole)).select(
        col, ((F.col("s") + smoothing * F.col("m")) / (F.col("n") + smoothing)).alias("__mean"))


@nan_is_missing
def target(df: DataFrame, col: str, target_col: str, smoothing: float = 0.0, means: DataFrame | None = None) -> DataFrame:
    """Replace a value by its target mean; pass ``means`` fitted on training rows to avoid leakage."""
    dim = means if means is not None else target_means(df, col, target_col, smoothing)
    return lookup_join(df, dim, [col]).withColumn(col, F.col("__mean")).select(*df.columns)


@nan_is_missing
def target_out_of_fold(df: DataFrame, col: str, target_col: str, fold: str) -> DataFrame:
    """Target mean of a value over the rows of all OTHER folds."""
    y = number(target_col, dtype(df, target_col))
    per = df.where(as_col(col).isNotNull()).groupBy(col, fold).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    whole = per.groupBy(col).agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    dim = lookup_join(per, whole, [col]).select(
        col, fold, F.try_divide(F.col("ts") - F.col("s"), F.col("tn") - F.col("n")).alias("__mean"))
    return lookup_join(df, dim, [col, fold]).withColumn(col, F.col("__mean")).select(*df.columns)


@nan_is_missing
def hashed(df: DataFrame, col: str, width: int = 8) -> DataFrame:
    """``width`` indicator columns by value hash."""
    slot = F.pmod(F.xxhash64(as_col(col)), F.lit(width))
    return df.select(*[as_col(c) for c in df.columns if c != col],
                     *[F.when(as_col(col).isNotNull(), (slot == i).cast("int")).otherwise(0).alias(f"{col}_hash_{i}") for i in range(width)])


@nan_is_missing
def interaction(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return df.withColumns({f"{a}_x_{b}": as_col(a) * as_col(b) for a, b in pairs})


@nan_is_missing
def cyclic_dates(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Sine/cosine features of every temporal column; hours only where a column has more than one hour."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, TEMPORAL) and (cols is None or f.name in cols)]
    spread = df.agg(*[(F.min(F.hour(as_col(c))) < F.max(F.hour(as_col(c)))).alias(c) for c in cols]).first()
    out: dict[str, Column] = {}
    for c in cols:
        out |= cyclic(as_col(c), c, bool(spread[c]))
    return df.withColumns(out)


@nan_is_missing
def lag_features(df: DataFrame, order_by: Sequence[str], key: Sequence[str] = (), cols: Sequence[str] | None = None,
                 offsets: Sequence[int] = (1, 7, 30), most: int | None = None) -> DataFrame:
    """Lags of all numeric columns, or of the first ``most``, in row order."""
    cols = [c for c in numeric_columns(df, cols) if c not in order_by and c not in key][:most]
    return lags(df, cols, offsets, order_by, key)


# ---- feature selection ------------------------------------------------------------------------

@nan_is_missing
def chi2_scores(df: DataFrame, cols: Sequence[str], label_col: str) -> DataFrame:
    """Chi-square of non-negative features against a class: class sums against their expected share."""
    sums = df.groupBy(as_col(label_col).alias("y")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(number(c, dtype(df, c))).alias(f"s{i}") for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"s{i}").alias("o")) for i, c in enumerate(cols)]
    long = sums.select("y", "n", F.inline(F.array(*rows)))
    tot = long.groupBy("feature").agg(F.sum("o").alias("t"), F.sum("n").alias("rows"))
    e = F.col("t") * F.col("n") / F.col("rows")
    return long.join(F.broadcast(tot), "feature").groupBy("feature").agg(
        F.sum((F.col("o") - e) * (F.col("o") - e) / e).alias("score"))


@nan_is_missing
def f_class_scores(df: DataFrame, cols: Sequence[str], label_col: str) -> DataFrame:
    """One-way analysis-of-variance F of every feature by class, from class counts, sums and squares."""
    x = {c: number(c, dtype(df, c)) for c in cols}
    per = df.where(as_col(label_col).isNotNull()).groupBy(as_col(label_col).alias("y")).agg(*[
        e for i, c in enumerate(cols) for e in (F.count(x[c]).cast("double").alias(f"n{i}"), F.avg(x[c]).alias(f"m{i}"), F.var_pop(x[c]).alias(f"v{i}"))])
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("m"), F.col(f"v{i}").alias("v")) for i, c in enumerate(cols)]
    long = per.select(F.inline(F.array(*rows))).where("n > 0")  # a class counts for the features that it has values of
    n, k = F.sum("n"), F.count(F.lit(1))
    within = F.sum(F.col("n") * F.col("v"))
    mean = F.sum(F.col("n") * F.col("m")) / n
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - n * mean * mean
    return long.groupBy("feature").agg((between / (k - 1) / (within / (n - k))).alias("score"))


@nan_is_missing
def f_regression_scores(df: DataFrame, cols: Sequence[str], target_col: str) -> DataFrame:
    """F of a simple regression on the target, from Pearson r over the rows that have both."""
    pairs = correlations(df, [*cols, target_col], against=target_col)
    r2 = F.col("r") * F.col("r")
    other = F.when(F.col("feature1") == target_col, F.col("feature2")).otherwise(F.col("feature1"))
    return pairs.select(other.alias("feature"), (r2 / (1 - r2) * (F.col("n") - 2)).alias("score"))


@nan_is_missing
def mutual_information(df: DataFrame, cols: Sequence[str], label_col: str, bins: int = 10, target_bins: int | None = None) -> DataFrame:
    """Mutual information (nats) of equal-width binned features and a class, from joint counts.

    ``target_bins`` makes classes of a continuous target in the same way.
    """
    measured = [*cols, label_col] if target_bins else list(cols)
    ends = df.agg(*[e for i, c in enumerate(measured) for e in (F.min(as_col(c)).cast("double").alias(f"lo{i}"), F.max(as_col(c)).cast("double").alias(f"hi{i}"))]).first()

    def binned(i: int, c: str, k: int):
        if ends[f"lo{i}"] is None:  # no value at all
            return F.lit(None).cast("bigint")
        lo, width = ends[f"lo{i}"], (ends[f"hi{i}"] - ends[f"lo{i}"]) or 1.0
        at = F.floor((number(c, dtype(df, c)) - lo) / (width / k))
        return F.when(at >= k, k - 1).otherwise(at)

    rows = [F.struct(F.lit(c).alias("feature"), binned(i, c, bins).alias("b")) for i, c in enumerate(cols)]
    label = binned(len(cols), label_col, target_bins) if target_bins else as_col(label_col)
    joint = (df.select(label.alias("y"), F.inline(F.array(*rows))).where("b is not null and y is not null")
             .groupBy("feature", "b", "y").agg(F.count(F.lit(1)).cast("double").alias("o")))
    bx = joint.groupBy("feature", "b").agg(F.sum("o").alias("nb"))
    by = joint.groupBy("feature", "y").agg(F.sum("o").alias("ny"))
    tot = joint.groupBy("feature").agg(F.sum("o").alias("n"))
    j = joint.join(bx, ["feature", "b"]).join(by, ["feature", "y"]).join(F.broadcast(tot), "feature")
    term = F.col("o") / F.col("n") * F.ln(F.col("o") * F.col("n") / (F.col("nb") * F.col("ny")))
    return j.groupBy("feature").agg(F.sum(term).alias("score"))


def top_features(scores: DataFrame, k: int = 10) -> DataFrame:
    return scores.orderBy(F.desc_nulls_last("score"), F.asc("feature")).limit(k)


def select_by_rules(scores: DataFrame, rules: DataFrame, threshold: float, most: int) -> DataFrame:
    """Apply must_include, must_exclude and preference rules (feature, rule_type, priority) to a score table.

    The rule with the highest priority decides; preferred features rank before the others; mandatory ones always stay.
    """
    best = rules.groupBy("feature").agg(F.max_by("rule_type", "priority").alias("rule_type"))
    joined = scores.join(best, "feature", "full_outer")
    must, never = F.col("rule_type") == "must_include", F.col("rule_type") == "must_exclude"
    cand = joined.where(~F.coalesce(never, F.lit(False)) & (F.coalesce(must, F.lit(False)) | (F.col("score") >= threshold)))
    rank = F.when(must, 0).when(F.col("rule_type") == "preference", 1).otherwise(2)
    ranked = cand.select("feature", "score", F.coalesce("rule_type", F.lit("score")).alias("reason"), rank.alias("tier"))
    mandatory = ranked.where("tier = 0")  # never cut; the others fill what is left of ``most``
    others = ranked.where("tier > 0").withColumn("__at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("tier", F.desc_nulls_last("score"), "feature")))
    held = mandatory.agg(F.count(F.lit(1)).alias("__held"))
    chosen = others.crossJoin(F.broadcast(held)).where(F.col("__at") <= F.lit(most) - F.col("__held")).drop("__at", "__held")
    return mandatory.unionByName(chosen).orderBy("tier", F.desc_nulls_last("score"), "feature")


def combine_selections(chosen: DataFrame, strategy: str = "intersection") -> DataFrame:
    """Features picked by several selectors (selector, feature): intersection, union or majority vote."""
    selectors = chosen.agg(F.count_distinct("selector").alias("k"))
    votes = chosen.groupBy("feature").agg(F.count_distinct("selector").alias("votes")).crossJoin(F.broadcast(selectors))
    rule = {"intersection": F.col("votes") == F.col("k"), "union": F.col("votes") >= 1, "vote": F.col("votes") * 2 > F.col("k")}[strategy]
    return votes.where(rule).select("feature", "votes")
