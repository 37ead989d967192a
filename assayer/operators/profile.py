"""Inspection and profiling: one row per column, every metric of every column from fused aggregations."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.values import any_of, as_col, labels, nan_is_missing, number, share, total
from assayer.plans.columns import (
    VALUE_KEY, dtype, flat_columns, kind_name, long_agg, numeric_columns, text_columns, value_counts, value_key, value_present)
from assayer.plans.gram import correlations
from assayer.plans.quantiles import exact_quantiles, quantile_frame

# ---- fixed values -------------------------------------------------------------------------
SUSPECT_DATE_PATTERNS = (r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{2}-\d{2}-\d{4}")
IDENTIFIER_NAMES = ("id", "customer_id", "customerid", "user_id", "userid", "index", "row_id")
EDGE_BLANK = r"^\s|\s$"
# -------------------------------------------------------------------------------------------


def _rows(_: str) -> Column:
    return F.count(F.lit(1))


def _missing(c: str) -> Column:
    return F.count_if(as_col(c).isNull())


@nan_is_missing
def inspect(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Shape, storage kind, nulls and distinct values per column."""
    return long_agg(df, flat_columns(df, cols), {
        "n_rows": _rows,
        "n_columns": lambda c: F.lit(len(df.columns)),
        "kind": lambda c: F.lit(kind_name(dtype(df, c))),
        "null_count": _missing,
    }, distinct="distinct_count").withColumn("null_pct", 100 * share(F.col("null_count"), F.col("n_rows")))


@nan_is_missing
def counts(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Row, missing and distinct counts with their percentages; ``exact=False`` uses a sketch for distinct."""
    sketch = {} if exact else {"unique_count": lambda c: F.approx_count_distinct(as_col(c))}
    base = long_agg(df, flat_columns(df, cols), {"count": _rows, "missing_count": _missing, **sketch},
                    distinct="unique_count" if exact else None)
    return (base.withColumn("missing_pct", 100 * share(F.col("missing_count"), F.col("count")))
            .withColumn("unique_pct", 100 * share(F.col("unique_count"), F.col("count"))))


@nan_is_missing
def numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Mean, sample deviation, range and quartiles."""
    cols = numeric_columns(df, cols)
    num = lambda c: number(c, dtype(df, c))
    stats = long_agg(df, cols, {
        "mean": lambda c: F.avg(num(c)), "std": lambda c: F.stddev_samp(num(c)),
        "min": lambda c: F.min(num(c)), "max": lambda c: F.max(num(c))})
    quart = quantile_frame(df, cols, {"q25": .25, "q50": .5, "q75": .75})
    return stats.join(F.broadcast(quart), "column_name")


@nan_is_missing
def moments(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Population skewness and excess kurtosis."""
    num = lambda c: number(c, dtype(df, c))
    return long_agg(df, numeric_columns(df, cols), {
        "skewness": lambda c: F.nanvl(F.skewness(num(c)), F.lit(None)),
        "kurtosis": lambda c: F.nanvl(F.kurtosis(num(c)), F.lit(None))})


@nan_is_missing
def iqr_fences(df: DataFrame, cols: Sequence[str], k: float) -> dict[str, tuple[float, float]]:
    """Lower and upper fence per column with values (columns without values are left out)."""
    q = exact_quantiles(df, cols, [.25, .75])
    return {c: (a - k * (b - a), b + k * (b - a)) for c, (a, b) in q.items() if a is not None}


@nan_is_missing
def outliers_iqr(df: DataFrame, cols: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    """Values outside Q1 - k*IQR .. Q3 + k*IQR per column."""
    cols = numeric_columns(df, cols)
    f = iqr_fences(df, cols, k)
    num = lambda c: number(c, dtype(df, c))
    return long_agg(df, list(f), {
        "lower": lambda c: F.lit(f[c][0]), "upper": lambda c: F.lit(f[c][1]),
        "outliers": lambda c: F.count_if((num(c) < f[c][0]) | (num(c) > f[c][1]))})


@nan_is_missing
def mean_std(df: DataFrame, cols: Sequence[str], sample: bool = True) -> dict[str, tuple[float, float]]:
    """Mean and deviation per column on the driver: two numbers a column."""
    dev = F.stddev_samp if sample else F.stddev_pop
    rows = long_agg(df, cols, {"m": lambda c: F.avg(number(c, dtype(df, c))),
                               "s": lambda c: dev(number(c, dtype(df, c)))}).collect()
    return {r["column_name"]: (r["m"], r["s"]) for r in rows}


@nan_is_missing
def outliers_z(df: DataFrame, cols: Sequence[str] | None = None, limit: float = 3.0) -> DataFrame:
    """Values more than ``limit`` sample deviations from the mean; constant columns have none."""
    cols = numeric_columns(df, cols)
    ms = mean_std(df, cols)

    def n_out(c: str) -> Column:
        m, s = ms[c]
        return F.count_if(F.abs(number(c, dtype(df, c)) - m) / s > limit) if s else F.lit(0).cast("bigint")

    return long_agg(df, cols, {"outliers": n_out})


@nan_is_missing
def top_values(df: DataFrame, cols: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values per column; ties go to the smaller value.

    The rank filter is pushed below the shuffle, each task forwards at most ``k`` rows per column.
    """
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("value"))
    return (value_counts(df, text_columns(df, cols)).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))


@nan_is_missing
def categorical(df: DataFrame, cols: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """Cardinality, mode and top-k values per text column."""
    cols = text_columns(df, cols)
    vc = value_counts(df, cols)
    card = vc.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("cardinality"), F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("m"))
    top = top_values(df, cols, k).groupBy("column_name").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "value", "n"))),
        lambda s: F.concat(s["value"], F.lit("="), s["n"].cast("string"))), ";").alias("top_values"))
    return card.join(top, "column_name").select(
        "column_name", "cardinality", F.col("m.value").alias("mode_value"), (-F.col("m.n")).alias("mode_count"), "top_values")


@nan_is_missing
def text_length(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Length statistics and edge-blank flag per text column."""
    return long_agg(df, text_columns(df, cols), {
        "avg_length": lambda c: F.avg(F.length(as_col(c))), "min_length": lambda c: F.min(F.length(as_col(c))),
        "max_length": lambda c: F.max(F.length(as_col(c))),
        "has_edge_blank": lambda c: F.coalesce(F.bool_or(as_col(c).rlike(EDGE_BLANK)), F.lit(False))})


@nan_is_missing
def has_duplicates(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Whether any value (null counts as one) repeats."""
    base = long_agg(df, flat_columns(df, cols), {"n": _rows, "nulls": _missing}, distinct="u")
    return base.select("column_name", (F.col("n") > F.col("u") + F.least(F.col("nulls"), F.lit(1))).alias("has_duplicates"))


@nan_is_missing
def date_suspect(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Text columns where some value contains a date form (whole column, not its first rows)."""
    return long_agg(df, text_columns(df, cols), {"suspected_date": lambda c: F.coalesce(F.bool_or(
        any_of(as_col(c).rlike(p) for p in SUSPECT_DATE_PATTERNS)), F.lit(False))})


@nan_is_missing
def duplicate_rows(df: DataFrame) -> DataFrame:
    """(n_rows, duplicate_rows): all copies but the first. Copies are counted map-side before the shuffle."""
    groups = df.groupBy(*[as_col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows"),
                      F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"))


@nan_is_missing
def dataset(df: DataFrame) -> DataFrame:
    """Shape, missing cells and duplicate rows of the table."""
    cells = df.agg(total([F.count_if(as_col(c).isNull()) for c in df.columns]).alias("missing_cells"))
    return duplicate_rows(df).crossJoin(cells).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"), "missing_cells", "duplicate_rows")


@nan_is_missing
def pearson_pairs(df: DataFrame, cols: Sequence[str] | None = None, complete: bool = False) -> DataFrame:
    """Pearson r of every numeric pair from one pass of matrix products.

    ``complete=True`` first drops rows with a null in any of the columns (otherwise pairwise).
    """
    cols = numeric_columns(df, cols)
    d = df.select(*[number(c, dtype(df, c)).alias(c) for c in cols])
    return correlations(d.dropna() if complete else d, cols).drop("n")


@nan_is_missing
def cramers_v_pairs(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Cramer's V of every text pair from joint counts; only distinct value pairs are shuffled."""
    cols = text_columns(df, cols)
    pairs = [F.struct(F.lit(a).alias("feature1"), F.lit(b).alias("feature2"), as_col(a).alias("x"), as_col(b).alias("y"))
             for i, a in enumerate(cols) for b in cols[i + 1:]]
    joint = (df.select(F.inline(F.array(*pairs))).where("x is not null and y is not null")
             .groupBy("feature1", "feature2", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("o")))
    on = ["feature1", "feature2"]
    rows = joint.groupBy(*on, "x").agg(F.sum("o").alias("rx"))
    cols_ = joint.groupBy(*on, "y").agg(F.sum("o").alias("cy"))
    # chi2/n = sum(o^2 / (r*c)) - 1, so cells with a zero count never have to be built
    part = (joint.join(rows, [*on, "x"]).join(cols_, [*on, "y"])
            .groupBy(*on).agg(F.sum(F.col("o") * F.col("o") / (F.col("rx") * F.col("cy"))).alias("s")))
    dims = (rows.groupBy(*on).agg(F.count(F.lit(1)).alias("nx"))
            .join(cols_.groupBy(*on).agg(F.count(F.lit(1)).alias("ny")), on))
    return part.join(dims, on).select(*on, F.sqrt(F.greatest(F.try_divide(
        F.col("s") - 1, F.least(F.col("nx"), F.col("ny")) - 1), F.lit(0.0))).alias("v"))


@nan_is_missing
def profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """The full per-column record: counts, moments, outliers, text facts (null where not applicable).

    The table is read four times, whatever its width: three times for the exact quartiles of all columns (further
    rounds where more than ``SETTLE`` rows lie between two cuts), once for the
    counts of every column's values, which give all the rest.  Power sums are taken about the median, which is at most one
    deviation from the mean, so nothing cancels.
    """
    cols = flat_columns(df, cols)
    nums, texts = numeric_columns(df, cols), text_columns(df, cols)
    quart = exact_quantiles(df, nums, [.25, .5, .75]) if nums else {}
    marks = [(c, kind_name(dtype(df, c)), *(quart.get(c) or [None] * 3)) for c in cols]
    per_col = df.sparkSession.createDataFrame(marks, "column_name string, kind string, q25 double, q50 double, q75 double")
    null = lambda t: F.lit(None).cast(t)

    def facts(c: str) -> Column:
        is_text, is_num = c in texts, c in nums
        mid = (quart.get(c) or [None] * 3)[1]
        return F.struct(
            F.lit(c).alias("column_name"), *value_key(c, dtype(df, c)),
            (number(c, dtype(df, c)) if is_num else null("double")).alias("x"),
            F.lit(mid if mid is not None and math.isfinite(mid) else 0.0).alias("mid"),
            (F.length(as_col(c)) if is_text else null("int")).alias("len"),
            (as_col(c).rlike(EDGE_BLANK) if is_text else null("boolean")).alias("edge"),
            (any_of(as_col(c).rlike(p) for p in SUSPECT_DATE_PATTERNS) if is_text else null("boolean")).alias("dated"))

    values = (df.select(F.inline(F.array(*[facts(c) for c in cols])))
              .groupBy("column_name", *VALUE_KEY, "x", "mid", "len", "edge", "dated").agg(F.count(F.lit(1)).alias("m")))
    x, m, off = F.col("x"), F.col("m"), F.col("x") - F.col("mid")
    lower, upper = (F.col("q25") - 1.5 * (F.col("q75") - F.col("q25")), F.col("q75") + 1.5 * (F.col("q75") - F.col("q25")))
    sums = values.join(F.broadcast(per_col), "column_name").groupBy("column_name").agg(
        F.sum("m").alias("count"), F.coalesce(F.sum(F.when(~value_present(), m)), F.lit(0)).alias("missing_count"),
        F.count_if(value_present()).alias("unique_count"), F.sum(F.when(x.isNotNull(), m)).alias("n"),
        F.min("x").alias("min"), F.max("x").alias("max"), F.max("mid").alias("mid"),
        *[F.sum(m * F.pow(off, F.lit(float(k)))).alias(f"s{k}") for k in (1, 2, 3, 4)],
        F.sum(F.when((x < lower) | (x > upper), m).otherwise(F.when(lower.isNotNull(), 0))).alias("outliers_iqr"),
        F.try_divide(F.sum(m * F.col("len")), F.sum(F.when(F.col("len").isNotNull(), m))).alias("avg_length"),
        F.coalesce(F.bool_or("edge"), F.lit(False)).alias("has_edge_blank"),
        F.coalesce(F.bool_or("dated"), F.lit(False)).alias("suspected_date"))
    out = per_col.join(F.broadcast(sums), "column_name", "left").fillna(0, ["count", "missing_count", "unique_count"]).fillna(
        False, ["has_edge_blank", "suspected_date"])
    n = F.col("n")
    d, e2, e3, e4 = (F.col(f"s{k}") / n for k in (1, 2, 3, 4))
    var = F.when(F.col("min") == F.col("max"), F.lit(0.0)).otherwise(e2 - d * d)  # one value has no spread, not even by rounding
    third = e3 - 3 * d * e2 + 2 * d * d * d
    fourth = e4 - 4 * d * e3 + 6 * d * d * e2 - 3 * d * d * d * d
    known = lambda c: F.nanvl(c, F.lit(None))
    return out.select(
        "column_name", "kind", "count", "missing_count", (F.col("mid") + d).alias("mean"),
        F.when(n > 1, F.sqrt(var * n / (n - 1))).alias("std"), "min", "max", "q25", "q50", "q75",
        known(F.try_divide(third, F.pow(var, F.lit(1.5)))).alias("skewness"),
        known(F.try_divide(fourth, var * var) - 3).alias("kurtosis"),
        "outliers_iqr", "avg_length", "has_edge_blank", "suspected_date", "unique_count",
        (100 * share(F.col("missing_count"), F.col("count"))).alias("missing_pct"),
        F.when(F.col("kind") == "text", F.col("unique_count")).alias("cardinality"))


def column_advice(prof: DataFrame) -> DataFrame:
    """Cleaning advice per column of a profile."""
    return prof.select("column_name", labels(
        (F.col("missing_pct") > 50, "consider_dropping_column"),
        ((F.col("missing_pct") > 10) & (F.col("missing_pct") <= 50), "impute_missing_values"),
        (F.col("cardinality") > 50, "reduce_cardinality"),
        (F.col("outliers_iqr") > 0, "handle_outliers"),
        (F.col("has_edge_blank"), "clean_whitespace"),
        (F.col("suspected_date"), "convert_to_datetime")).alias("actions"))


def transform_advice(prof: DataFrame) -> DataFrame:
    """Transformation, encoding and scaling advice per column of a profile."""
    skew, cv = F.abs("skewness"), F.try_divide(F.col("std"), F.abs("mean"))
    usable = (F.col("std") != 0) & (F.col("mean") != 0)
    return prof.select("column_name", labels(
        (skew > 1, "apply_log_transform"), ((skew > .5) & (skew <= 1), "apply_sqrt_transform"),
        (F.col("cardinality").between(1, 10), "one_hot_encoding"),
        (F.col("cardinality").between(11, 50), "label_encoding"), (F.col("cardinality") > 50, "target_encoding"),
        (usable & (cv > 1), "standard_scaling"), (usable & (cv <= 1), "minmax_scaling")).alias("suggestions"))


def recipe(prof: DataFrame) -> DataFrame:
    """Derived cleaning recipe, one row per column."""
    unique = (F.col("unique_count") == F.col("count")) & (F.col("unique_count") > 1)
    named = F.lower("column_name").isin(*IDENTIFIER_NAMES)
    wide = F.col("cardinality") > .95 * F.col("count")
    is_num, is_text = F.col("kind").isin("integer", "float"), F.col("kind") == "text"
    skewed = F.abs("skewness") > 1
    return prof.select(
        "column_name",
        F.coalesce(unique | named | wide, F.lit(False)).alias("drop_column"),
        F.when(unique | named, "unique_identifier").when(wide, "high_cardinality").alias("drop_reason"),
        F.when(F.col("missing_pct") > 0, F.when(is_num, "median").otherwise("most_frequent")).alias("imputation"),
        F.when(is_num & (F.col("outliers_iqr") > 0), "remove").alias("outlier_treatment"),
        F.when(is_text & ~F.col("suspected_date"),
               F.when(F.col("cardinality").between(1, 10), "onehot").when(F.col("cardinality").between(11, 50), "label")
               .otherwise("target")).alias("encoding"),
        (is_text & F.col("suspected_date")).alias("date_conversion"),
        F.when(is_num & skewed, "log").alias("transformation"),
        F.when(is_num, F.when(skewed, "robust").otherwise("standard")).alias("scaling"))


@nan_is_missing
def recipe_basic(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Simpler recipe: identifiers, imputation by missing share, and the type text columns parse as."""
    from assayer.functions.values import timestamp

    cols = flat_columns(df, cols)
    texts = text_columns(df, cols)
    bad = lambda f: (lambda c: F.count_if(as_col(c).isNotNull() & f(c, dtype(df, c)).isNull()) if c in texts
                     else F.lit(None).cast("bigint"))
    base = long_agg(df, cols, {
        "kind": lambda c: F.lit(kind_name(dtype(df, c))), "count": _rows, "missing_count": _missing,
        "not_number": bad(number), "not_date": bad(timestamp)}, distinct="unique_count")
    pct, is_text = 100 * share(F.col("missing_count"), F.col("count")), F.col("kind") == "text"
    return base.select(
        "column_name", "missing_count", pct.alias("missing_pct"), "unique_count",
        (is_text & (share(F.col("unique_count"), F.col("count")) > .95)).alias("drop_column"),
        F.when(pct > 50, "drop_column").when(pct > 10, F.when(F.col("kind").isin("integer", "float"), "median")
                                             .otherwise("most_frequent")).otherwise("none").alias("imputation"),
        F.when(is_text & (F.col("missing_count") < F.col("count")),
               F.when(F.col("not_number") == 0, "float").when(F.col("not_date") == 0, "datetime")
               .otherwise("string")).alias("convert_to"))


@nan_is_missing
def basic(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Short profile: counts for every column and mean, deviation and range for numbers."""
    cols = flat_columns(df, cols)
    nums = numeric_columns(df, cols)
    on_num = lambda f: (lambda c: f(number(c, dtype(df, c))) if c in nums else F.lit(None).cast("double"))
    base = long_agg(df, cols, {
        "kind": lambda c: F.lit(kind_name(dtype(df, c))), "n": _rows, "missing_count": _missing,
        "mean": on_num(F.avg), "std": on_num(F.stddev_samp), "min": on_num(F.min), "max": on_num(F.max)},
        distinct="unique_count")
    return (base.withColumn("missing_pct", 100 * share(F.col("missing_count"), F.col("n")))
            .withColumn("unique_pct", 100 * share(F.col("unique_count"), F.col("n"))).drop("n"))


@nan_is_missing
def traits(df: DataFrame, target: str, few: int = 20) -> DataFrame:
    """Size and width class, problem kind and class balance relative to a target column."""
    feats = [c for c in df.columns if c != target]
    per_class = df.where(as_col(target).isNotNull()).groupBy(as_col(target).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    # the class table is only summarised; it never leaves the executors
    classes = per_class.agg(F.count(F.lit(1)).alias("n_classes"), F.min("n").alias("minority"), F.max("n").alias("majority"))
    facts = df.agg(F.count(F.lit(1)).alias("n_samples"),
                   total([F.count_if(as_col(c).isNull()) for c in feats]).alias("missing_values"))
    is_class = F.lit(isinstance(dtype(df, target), (T.StringType, T.BooleanType))) | (F.col("n_classes") < few)
    ratio = share(F.col("minority"), F.col("majority"))
    n, p = F.col("n_samples"), len(feats)
    return facts.crossJoin(classes).select(
        n, F.lit(p).alias("n_features"),
        F.when(n < 1000, "small").when(n < 10000, "medium").otherwise("large").alias("size_class"),
        F.lit("low" if p < 10 else "medium" if p < 50 else "high").alias("width_class"),
        F.when(is_class, "classification").otherwise("regression").alias("problem_kind"),
        "missing_values", F.lit(len(text_columns(df, feats))).alias("categorical_features"),
        F.lit(len(numeric_columns(df, feats))).alias("numeric_features"),
        F.when(is_class, F.col("n_classes")).alias("n_classes"),
        F.when(is_class, ratio).alias("class_ratio"), F.when(is_class, ratio > .7).alias("balanced"))
