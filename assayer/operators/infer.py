"""Semantic type inference: every column judged from one whole-table aggregation, no sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.normality import chi2_two_tail, corrected_kurtosis, corrected_skew, k_squared
from assayer.functions.values import as_col, labels, nan_is_missing, number, once, share, timestamp, total
from assayer.operators.profile import top_values
from assayer.plans.columns import (
    TEMPORAL, dtype, flat_columns, kind_name, long_agg, numeric_columns, sampled, text_columns, union_all, unpivot_number, unpivot_text)
from assayer.plans.quantiles import exact_quantiles
from assayer.session import cut

# ---- fixed values -------------------------------------------------------------------------
DATE_PATTERNS = (r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{2}-\d{2}-\d{4}", r"\d{4}/\d{2}/\d{2}")
NUMBER_PATTERNS = (r"^[-+]?\d*\.?\d+([eE][-+]?\d+)?$", r"^[-+]?\d+$", r"^[-+]?\d*\.\d+$")
HIGH, MEDIUM, LOW = .8, .6, .4
IDENTIFIER_RATIO, CATEGORY_RATIO, MAX_CATEGORIES = .95, .5, 50
# -------------------------------------------------------------------------------------------


@nan_is_missing
def evidence(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column: counts, parse and pattern ratios, moments of the numeric reading.

    Text columns are unpivoted and judged in one grouped aggregation, so the plan does not grow with their number.
    """
    cols = flat_columns(df, cols)
    texts, nums = text_columns(df, cols), numeric_columns(df, cols)
    temporal = [c for c in cols if isinstance(dtype(df, c), TEMPORAL)]
    base = long_agg(df, cols, {
        "original_type": lambda c: F.lit(kind_name(dtype(df, c))),
        "n_rows": lambda c: F.count(F.lit(1)), "non_null": lambda c: F.count(as_col(c)),
        "fixed_date": lambda c: F.lit(1.0 if c in temporal else 0.0), "fixed_number": lambda c: F.lit(1.0 if c in nums else 0.0),
    }, distinct="unique_count")
    x = F.col("__x")
    moments = (F.count(x).cast("double").alias("n_number"), F.nanvl(F.skewness(x), F.lit(None)).alias("skew"),
               F.nanvl(F.kurtosis(x), F.lit(None)).alias("kurt"))
    v, one = F.col("value"), lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    parts = []
    if texts:
        long = unpivot_text(df, texts).withColumns({"__x": number("value", T.StringType()), "__t": timestamp("value", T.StringType())})
        parts.append(long.groupBy("column_name").agg(
            total([one(v.rlike(p)) for p in DATE_PATTERNS]).alias("date_patterns"), one(F.col("__t").isNotNull()).alias("date_parse"),
            total([one(F.trim(v).rlike(p)) for p in NUMBER_PATTERNS]).alias("number_patterns"), one(x.isNotNull()).alias("number_parse"), *moments))
    if nums:
        zero = F.lit(0.0)
        long = unpivot_number(df, nums).withColumnRenamed("value", "__x")
        parts.append(long.groupBy("column_name").agg(F.max(zero).alias("date_patterns"), F.max(zero).alias("date_parse"),
                                                     F.max(F.lit(1.0)).alias("number_patterns"), F.max(F.lit(1.0)).alias("number_parse"), *moments))
    keep = ("column_name", "original_type", "n_rows", "non_null", "unique_count")
    null_d = F.lit(None).cast("double")
    if not parts:
        return base.select(*keep, F.col("fixed_date").alias("date_patterns"), F.col("fixed_date").alias("date_parse"), F.lit(0.0).alias("number_patterns"),
                           F.lit(0.0).alias("number_parse"), null_d.alias("n_number"), null_d.alias("skew"), null_d.alias("kurt"))
    return base.join(F.broadcast(union_all(parts)), "column_name", "left").select(
        *keep, F.coalesce("date_patterns", "fixed_date").alias("date_patterns"), F.coalesce("date_parse", "fixed_date").alias("date_parse"),
        F.coalesce("number_patterns", "fixed_number").alias("number_patterns"), F.coalesce("number_parse", "fixed_number").alias("number_parse"),
        "n_number", "skew", "kurt")


def scored(ev: DataFrame) -> DataFrame:
    """Add the confidence of each of the four kinds of evidence (null = no vote)."""
    staged = once(ev, {
        "u": share(F.col("unique_count"), F.col("non_null")),
        "k2": k_squared(F.col("n_number"), F.col("skew"), F.col("kurt")),
        "has": F.col("non_null") > 0})
    staged = once(staged, {"normal_p": chi2_two_tail(F.col("k2"))})
    u, has = F.col("u"), F.col("has")
    date = F.when(F.col("date_parse") > .7, F.least(F.lit(.9), F.col("date_parse") + .1)).otherwise(
        F.least(F.lit(.8), F.col("date_patterns") / len(DATE_PATTERNS)))
    numb = F.when(F.col("number_parse") > .8, F.least(F.lit(.9), F.col("number_parse"))).otherwise(
        F.least(F.lit(.8), F.col("number_patterns")))
    few = (u <= CATEGORY_RATIO) & (F.col("unique_count") <= MAX_CATEGORIES)
    tested = has & (F.col("n_number") >= 10) & F.col("normal_p").isNotNull()
    staged = once(staged, {"__date": date, "__numb": numb})
    return once(staged, {
        "datetime_conf": F.when(has & (F.col("__date") > 0), F.col("__date")),
        "numeric_conf": F.when(has & (F.col("__numb") > 0), F.col("__numb")),
        "cardinality_type": F.when(has, F.when(u >= IDENTIFIER_RATIO, "identifier").when(few, "categorical").when(u > .8, "continuous")),
        "cardinality_conf": F.when(has, F.when(u >= IDENTIFIER_RATIO, .9).when(few, .8).when(u > .8, .7)),
        "distribution_type": F.when(tested, F.when(F.col("normal_p") > .05, "continuous_normal").otherwise("continuous_skewed")),
        "distribution_conf": F.when(tested, F.when(F.col("normal_p") > .05, .7).otherwise(.6)),
    }).drop("__date", "__numb", "u", "has")


def decided(sc: DataFrame) -> DataFrame:
    """Final type: strongest evidence, earlier kind on ties, then the acceptance rules."""
    d, n, k, s = (F.coalesce(F.col(c), F.lit(0.0)) for c in (
        "datetime_conf", "numeric_conf", "cardinality_conf", "distribution_conf"))
    best, winner, accepted, stored = F.col("__best"), F.col("__winner"), F.col("__accepted"), F.col("original_type")
    # each stage is used several times by the next one, and a later filter must not unfold them all
    staged = once(sc, {"__best": F.greatest(d, n, k, s)})
    staged = once(staged, {"__winner": F.when(best == 0, F.lit(None)).when(d == best, "datetime").when(n == best, "numeric")
        .when(k == best, F.col("cardinality_type")).otherwise(F.col("distribution_type"))})
    staged = once(staged, {"__accepted": F.when((winner == "identifier") & (best > .8), "identifier")
        .when((winner == "datetime") & (best > .7), "datetime")
        .when(winner.isin("numeric", "continuous_normal", "continuous_skewed") & (best > .6), "numeric")
        .when((winner == "categorical") & (best > .6), "categorical")})
    empty = F.col("non_null") == 0
    none_t = F.when(stored.isin("integer", "float"), "numeric").when(stored == "text", "text").otherwise("unknown")
    none_c = F.when(stored.isin("integer", "float", "text"), .5).otherwise(.3)
    return staged.withColumns({
        "inferred_type": F.when(empty, "empty").when(winner.isNull(), none_t).otherwise(F.coalesce(accepted, F.lit("text"))),
        "confidence": F.when(empty, 1.0).when(winner.isNull(), none_c).when(accepted.isNotNull(), best)
        .otherwise(F.greatest(F.lit(.3), best * .5))}).drop("__best", "__winner", "__accepted")


def advised(dec: DataFrame) -> DataFrame:
    """Advice codes by type, confidence and missing share."""
    t, missing = F.col("inferred_type"), 1 - share(F.col("non_null"), F.col("n_rows"))
    return dec.withColumn("advice", labels(
        (F.col("confidence") < LOW, "review_low_confidence"),
        (t == "identifier", "drop_identifier_for_modeling"),
        (t == "datetime", "extract_temporal_features"),
        ((t == "numeric") & (F.col("original_type") == "text"), "convert_to_number"),
        ((t == "categorical") & (F.col("unique_count") > 20), "encode_high_cardinality"),
        ((t == "categorical") & (F.col("unique_count") <= 20), "encode_categorical"),
        (t == "text", "preprocess_text"), (missing > .1, "handle_missing_values")))


@nan_is_missing
def infer(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Inferred type, confidence and advice for all columns, from one pass over the table."""
    return advised(decided(scored(evidence(df, cols)))).select(
        "column_name", "original_type", "inferred_type", "confidence", "n_rows", "non_null", "unique_count", "advice", detected().alias("patterns_detected"))


def detected() -> Column:
    """Codes of all evidence that was found in a column, in the order in which it is gathered."""
    some = F.col("non_null") > 0
    kind, shape = F.col("cardinality_type"), F.col("distribution_type")
    return labels(
        (~some, "all_null"), (some & (F.col("date_patterns") > 0), "datetime_pattern"), (some & (F.col("date_parse") > .7), "datetime_convertible"),
        (some & (F.col("number_patterns") > 0), "numeric_pattern"), (some & (F.col("number_parse") > .8), "numeric_convertible"),
        (kind == "identifier", "unique_identifier"), (kind == "categorical", "categorical"), (kind == "continuous", "continuous_high_cardinality"),
        (shape == "continuous_normal", "normal_distribution"), (shape == "continuous_skewed", "non_normal_distribution"))


@nan_is_missing
def with_samples(df: DataFrame, inferred: DataFrame, cols: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """Add ``sample_values``, up to ``k`` different values of each column as text, to the (small) table of ``infer``."""
    examples = sampled(unpivot_text(df, flat_columns(df, cols)), ["column_name"], k).withColumnRenamed("examples", "sample_values")
    return inferred.join(F.broadcast(examples), "column_name", "left")


@nan_is_missing
def statistics(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Counts and ratios of all columns; mean, spread and corrected moments of the numeric reading."""
    cols = flat_columns(df, cols)
    readable = set(text_columns(df, cols)) | set(numeric_columns(df, cols))
    num = lambda c: number(c, dtype(df, c))
    on_num = lambda f: (lambda c: f(num(c)) if c in readable else F.lit(None).cast("double"))
    med = exact_quantiles(df, sorted(readable), [.5]) if readable else {}
    base = long_agg(df, cols, {
        "total_count": lambda c: F.count(F.lit(1)), "non_null_count": lambda c: F.count(as_col(c)),
        "n": on_num(lambda x: F.count(x).cast("double")),
        "mean": on_num(F.avg), "std": on_num(F.stddev_samp), "min": on_num(F.min), "max": on_num(F.max),
        "median": lambda c: F.lit(med[c][0] if c in med else None).cast("double"),
        "g1": on_num(lambda x: F.nanvl(F.skewness(x), F.lit(None))), "g2": on_num(lambda x: F.nanvl(F.kurtosis(x), F.lit(None)))}, distinct="unique_count")
    rows = F.col("total_count")
    return base.select(
        "column_name", rows, "non_null_count", (rows - F.col("non_null_count")).alias("null_count"),
        (1 - share(F.col("non_null_count"), rows)).alias("missing_ratio"), "unique_count",
        share(F.col("unique_count"), rows).alias("unique_ratio"), "mean", "std", "min", "max", "median",
        corrected_skew(F.col("n"), F.col("g1")).alias("skewness"),
        corrected_kurtosis(F.col("n"), F.col("g2")).alias("kurtosis"))


@nan_is_missing
def top_categories(df: DataFrame, cols: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """Top values of the columns inferred categorical."""
    inferred = cut(infer(df, cols).where(F.col("inferred_type") == "categorical").select("column_name"))
    return top_values(df, cols, k).join(F.broadcast(inferred), "column_name")


def report(inferred: DataFrame) -> DataFrame:
    """Confidence histogram, type histogram and advice by priority, as (section, item, n)."""
    c = F.col("confidence")
    band = F.when(c >= HIGH, "high").when(c >= MEDIUM, "medium").otherwise("low")
    priority = F.when(c < LOW, "high_priority").when(c < MEDIUM, "medium_priority").otherwise("low_priority")
    n_advice = F.size(F.filter(F.split("advice", ","), lambda x: x != ""))
    entry = lambda section, item, k: F.struct(F.lit(section).alias("section"), item.alias("item"), k.cast("bigint").alias("k"))
    rows = inferred.select(F.inline(F.array(
        entry("confidence", band, F.lit(1)), entry("type", F.col("inferred_type"), F.lit(1)), entry("advice", priority, n_advice))))
    return rows.groupBy("section", "item").agg(F.sum("k").alias("n"))
