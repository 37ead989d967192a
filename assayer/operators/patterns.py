"""Value patterns: formats, identifiers, distributions, anomalies and cross-column redundancy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.normality import chi2_two_tail, k_squared
from assayer.functions.values import as_col, nan_is_missing, number, share
from assayer.operators.profile import iqr_fences, pearson_pairs
from assayer.plans.columns import (
    dtype, flat_columns, long_agg, numeric_columns, text_columns, union_all, unpivot_text, sampled)
from assayer.plans.ordered import successive
from assayer.session import settled

# ---- fixed values: (group, name, regex, threshold) ------------------------------------------
FORMATS = (
    ("business", "email", r"(?i)^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$", .8),
    ("business", "phone", r"(?i)^[\+]?[1-9]?[0-9]{7,15}$", .7),
    ("business", "ssn", r"(?i)^\d{3}-\d{2}-\d{4}$", .9),
    ("business", "credit_card", r"(?i)^\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}$", .8),
    ("formatting", "currency", r"^\$?\d{1,3}(,\d{3})*(\.\d{2})?$", .7),
    ("formatting", "percentage", r"^\d{1,3}(\.\d+)?%$", .8),
    ("formatting", "zip_code", r"^\d{5}(-\d{4})?$", .8),
    ("formatting", "iso_date", r"^\d{4}-\d{2}-\d{2}$", .9),
    ("id", "uuid", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", .95),
)
# -------------------------------------------------------------------------------------------


@nan_is_missing
def formats(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Columns whose trimmed text matches a format at its threshold, with the smallest and largest match.

    One scan counts every format in every column; only the (few) matching pairs are looked at again.
    """
    cols = text_columns(df, cols)
    hits = [F.count_if(F.trim("value").rlike(rx)).alias(f"m{i}") for i, (_, _, rx, _) in enumerate(FORMATS)]
    counted = unpivot_text(df, cols).groupBy("column_name").agg(F.count(F.lit(1)).alias("total_count"), *hits)
    rows = [F.struct(F.lit(name).alias("pattern_name"), F.lit(limit).alias("limit"), F.col(f"m{i}").alias("matches_count"))
            for i, (_, name, _, limit) in enumerate(FORMATS)]
    ratio = share(F.col("matches_count"), F.col("total_count"))
    matched = (counted.select("column_name", "total_count", F.inline(F.array(*rows))).withColumn("match_ratio", ratio)
               .where(F.col("match_ratio") >= F.col("limit"))
               .select("column_name", "pattern_name", F.lit("regex").alias("pattern_type"),
                       F.least(F.lit(.95), F.col("match_ratio")).alias("confidence"), "matches_count", "total_count", "match_ratio"))
    return matched


@nan_is_missing
def format_examples(df: DataFrame, matched: DataFrame, k: int = 5) -> DataFrame:
    """Add up to ``k`` matching values and a description to a (small) table of matched formats; one more scan of their columns."""
    rx = {name: rx for _, name, rx, _ in FORMATS}
    told = F.concat(F.lit("values read as "), F.replace("pattern_name", F.lit("_"), F.lit(" "))).alias("description")
    found = [(r["column_name"], r["pattern_name"]) for r in matched.select("column_name", "pattern_name").collect()]
    if not found:
        return matched.select("*", F.lit(None).cast("array<string>").alias("examples"), told)
    hits = [F.struct(F.lit(c).alias("column_name"), F.lit(name).alias("pattern_name"), F.when(F.trim(as_col(c)).rlike(rx[name]), as_col(c)).alias("value"))
            for c, name in found]
    examples = sampled(df.select(F.inline(F.array(*hits))), ["column_name", "pattern_name"], k)
    return matched.join(F.broadcast(examples), ["column_name", "pattern_name"], "left").select("*", told)


@nan_is_missing
def steps(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column_name, total_count, n_number, n_steps, top_step, top_count): the most common sorted difference.

    Values are counted first, so a hot value is one row; distinct values are range-sorted and neighbouring
    ranges stitched.  Repeats contribute zero differences.
    """
    cols = flat_columns(df, cols)
    readable = [c for c in cols if c in numeric_columns(df) or c in text_columns(df)]
    pairs = [F.struct(F.lit(c).alias("column_name"), number(c, dtype(df, c)).alias("v")) for c in readable]
    vals = (df.select(F.inline(F.array(*pairs))).where("v is not null")
            .groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("m")))
    diffs = successive(vals, "v", ["v"], ["column_name"])
    steps_ = diffs.select("column_name", F.inline(F.array_compact(F.array(
        F.when(F.col("before").isNotNull(), F.struct((F.col("v") - F.col("before")).alias("step"), F.lit(1).cast("bigint").alias("k"))),
        F.when(F.col("m") > 1, F.struct(F.lit(0.0).alias("step"), (F.col("m") - 1).alias("k")))))))
    per_step = steps_.groupBy("column_name", "step").agg(F.sum("k").alias("k"))
    best = per_step.groupBy("column_name").agg(
        F.sum("k").alias("n_steps"), F.min(F.struct((-F.col("k")).alias("k"), F.col("step").alias("s"))).alias("top"))
    totals = long_agg(df, readable, {"total_count": lambda c: F.count(as_col(c)),
                                     "n_number": lambda c: F.count(number(c, dtype(df, c)))})
    return totals.join(F.broadcast(best), "column_name", "left").select(
        "column_name", "total_count", "n_number", F.coalesce("n_steps", F.lit(0)).alias("n_steps"),
        F.col("top.s").alias("top_step"), (-F.col("top.k")).alias("top_count"))


@nan_is_missing
def sequential(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Whether a column is at least 80 % numeric with over 70 % equal sorted differences."""
    ok = (F.col("n_number") >= .8 * F.col("total_count")) & (share(F.col("top_count"), F.col("n_steps")) > .7)
    return steps(df, cols).withColumn("is_sequential", F.coalesce(ok, F.lit(False)))


def _named(rows: DataFrame, name: str, kind: str, cond: Column, conf: Column, matches: Column, total: Column, ratio: Column) -> DataFrame:
    return rows.where(cond).select("column_name", F.lit(name).alias("pattern_name"), F.lit(kind).alias("pattern_type"),
                                   conf.cast("double").alias("confidence"), matches.cast("bigint").alias("matches_count"),
                                   total.cast("bigint").alias("total_count"), ratio.cast("double").alias("match_ratio"))


@nan_is_missing
def identifiers(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Constant columns and columns over 95 % unique."""
    base = long_agg(df, flat_columns(df, cols), {"n": lambda c: F.count(as_col(c))}, distinct="u")
    n, u = F.col("n"), F.col("u")
    one = F.lit(1.0)
    return (_named(base, "constant_value", "special", u == 1, one, n, n, one)
            .unionByName(_named(base, "unique_identifier", "special", share(u, n) > .95, share(u, n), u, n, share(u, n))))


def _readable(df: DataFrame, cols: Sequence[str] | None) -> list[str]:
    return [c for c in flat_columns(df, cols) if c in numeric_columns(df) or c in text_columns(df)]


def _readings(df: DataFrame, cols: Sequence[str], **added: Mapping[str, float | None]) -> DataFrame:
    """(column_name, present, v): the numeric reading of every value, read once however often it is used; ``added`` numbers by column."""
    if not cols:
        raise ValueError("no column of the required kind")
    pairs = [F.struct(F.lit(c).alias("column_name"), as_col(c).isNotNull().alias("present"), number(c, dtype(df, c)).alias("v"),
                      *[F.lit(of[c]).cast("double").alias(n) for n, of in added.items()]) for c in cols]
    return df.select(F.inline(F.array(*pairs)))


@nan_is_missing
def normal(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """D'Agostino-Pearson verdict on the numeric reading of every column with at least ten numbers."""
    v = F.col("v")
    base = _readings(df, _readable(df, cols)).groupBy("column_name").agg(
        F.count_if("present").alias("total_count"), F.count(v).alias("n_number"),
        F.nanvl(F.skewness(v), F.lit(None)).alias("g1"), F.nanvl(F.kurtosis(v), F.lit(None)).alias("g2"))
    p = chi2_two_tail(k_squared(F.col("n_number"), F.col("g1"), F.col("g2")))
    return base.where("n_number >= 10").select(
        "column_name", "total_count", "n_number", p.alias("p_value"), (p > .05).alias("is_normal"))


@nan_is_missing
def uniform(df: DataFrame, cols: Sequence[str] | None = None, bins: int = 10) -> DataFrame:
    """Spread of the counts in equal-width bins over their mean; below 0.3 a column counts as uniform."""
    num = lambda c: number(c, dtype(df, c))
    cols = _readable(df, cols)
    ends = {r["column_name"]: (r["lo"], r["hi"], r["n"]) for r in _readings(df, cols).groupBy("column_name").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n")).collect()}
    usable = [c for c in cols if c in ends and ends[c][2] >= 10]

    def bin_of(c: str) -> Column:
        lo, hi, _ = ends[c]
        if lo == hi:  # a flat column is spread around its value, as a histogram routine does
            lo, hi = lo - .5, hi + .5
        at = F.floor((num(c) - lo) / ((hi - lo) / bins))
        return F.when(at >= bins, bins - 1).otherwise(at)  # null stays null, unlike with least()

    pairs = [F.struct(F.lit(c).alias("column_name"), bin_of(c).alias("bin")) for c in usable]
    counts = (df.select(F.inline(F.array(*pairs))).where("bin is not null")
              .groupBy("column_name", "bin").agg(F.count(F.lit(1)).cast("double").alias("m")))
    n, sq = F.sum("m"), F.sum(F.col("m") * F.col("m"))
    cv = F.sqrt(sq / bins - (n / bins) * (n / bins)) / (n / bins)
    return counts.groupBy("column_name").agg(n.cast("bigint").alias("n_number"), cv.alias("bin_cv"), (cv < .3).alias("is_uniform"))


@nan_is_missing
def far_outliers(df: DataFrame, cols: Sequence[str] | None = None, k: float = 3.0) -> DataFrame:
    """Numeric readings outside Q1/Q3 -+ k*IQR of columns with at least ten numbers."""
    f = iqr_fences(df, _readable(df, cols), k)
    read = _readings(df, list(f), lo={c: x[0] for c, x in f.items()}, hi={c: x[1] for c, x in f.items()})
    base = read.groupBy("column_name").agg(F.count("v").alias("n"), F.count_if((F.col("v") < F.col("lo")) | (F.col("v") > F.col("hi"))).alias("out"))
    ratio = share(F.col("out"), F.col("n"))
    return _named(base, "numeric_outliers", "anomaly", (F.col("n") >= 10) & (F.col("out") > 0),
                  F.least(F.lit(.9), 2 * ratio), F.col("out"), F.col("n"), ratio)


@nan_is_missing
def mixed_case(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Text columns where over a tenth of the values hold capitals and over a tenth small letters."""
    base = long_agg(df, text_columns(df, cols), {
        "n": lambda c: F.count(as_col(c)), "up": lambda c: F.count_if(as_col(c).rlike("[A-Z]")),
        "low": lambda c: F.count_if(as_col(c).rlike("[a-z]"))})
    less = F.least("up", "low")
    ratio = share(less, F.col("n"))
    return _named(base, "case_inconsistency", "anomaly", ratio > .1, ratio, less, F.col("n"), ratio)


@nan_is_missing
def high_correlation(df: DataFrame, cols: Sequence[str] | None = None, limit: float = .8) -> DataFrame:
    """Numeric pairs with an absolute Pearson r of at least ``limit``."""
    return pearson_pairs(df, cols).where(F.abs("r") >= limit)


@nan_is_missing
def detect(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Every pattern found in every column, plus the cross-column row."""
    cols = flat_columns(df, cols)
    df, one = settled(df), F.lit(1.0)
    nrm, uni = normal(df, cols), uniform(df, cols)
    parts = [identifiers(df, cols), far_outliers(df, cols)]
    if text_columns(df, cols):
        parts += [formats(df, cols), mixed_case(df, cols)]
    seq = sequential(df, cols)
    parts.append(_named(seq, "sequential_id", "special", F.col("is_sequential"), F.lit(.9),
                        F.col("total_count"), F.col("total_count"), one))
    ratio = share(F.col("n_number"), F.col("total_count"))
    parts.append(_named(nrm, "normal_distribution", "statistical", F.col("is_normal"),
                        F.least(F.lit(.9), 1 - F.col("p_value")), F.col("n_number"), F.col("total_count"), ratio))
    flat = uni.join(F.broadcast(nrm.select("column_name", "total_count")), "column_name")
    parts.append(_named(flat, "uniform_distribution", "statistical", F.col("is_uniform"), F.lit(.7),
                        F.col("n_number"), F.col("total_count"), ratio))
    nums = numeric_columns(df, cols)
    if len(nums) > 1:
        pairs = high_correlation(df, nums).agg(F.count(F.lit(1)).alias("k")).withColumn("column_name", F.lit("__cross_column__"))
        parts.append(_named(pairs, "high_correlation", "cross_column", F.col("k") > 0, F.lit(.8), F.col("k"),
                            F.lit(len(nums)), F.col("k") / len(nums)))
    return union_all(parts)


def report(found: DataFrame) -> DataFrame:
    """Patterns by type, high-confidence patterns and advice, as (section, item, n)."""
    own = F.col("column_name") != "__cross_column__"
    kind, name = F.col("pattern_type"), F.col("pattern_name")
    advice = (F.when((kind == "special") & name.isin("unique_identifier", "sequential_id"), "drop_identifiers")
              .when(name == "numeric_outliers", "review_outliers")
              .when((kind == "regex") & name.isin("email", "phone", "ssn"), "protect_private_data")
              .when(kind == "cross_column", "reduce_multicollinearity"))
    entry = lambda section, item: F.struct(F.lit(section).alias("section"), item.alias("item"))
    rows = found.select(F.inline(F.array(
        entry("type", F.when(own, kind)), entry("confidence", F.when(own & (F.col("confidence") >= .8), "high")),
        entry("advice", advice))))
    return rows.where("item is not null").groupBy("section", "item").agg(F.count(F.lit(1)).alias("n"))
