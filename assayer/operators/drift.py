"""Drift of a current table against a reference table: both reduced to per-column summaries, then joined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.values import as_col, nan_is_missing, number, share
from assayer.plans.columns import dtype, long_agg, numeric_columns, text_columns, union_all, unpivot_number, value_counts
from assayer.plans.ordered import running_sums
from assayer.plans.quantiles import exact_quantiles

# ---- fixed values -------------------------------------------------------------------------
NUMERIC_LIMIT, CATEGORY_LIMIT, MISSING_LIMIT, DISTANCE_LIMIT, EPS = .5, .3, .1, .2, 1e-8
# -------------------------------------------------------------------------------------------


@nan_is_missing
def shared(ref: DataFrame, cur: DataFrame, skip: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Numeric and text columns present in both tables, without target and prediction columns."""
    names = [c for c in ref.columns if c in cur.columns and c not in skip]
    return numeric_columns(ref, names), text_columns(ref, names)


@nan_is_missing
def numeric(ref: DataFrame, cur: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Shift of mean and deviation in reference deviations."""
    def facts(df: DataFrame, tag: str) -> DataFrame:
        x = lambda c: number(c, dtype(df, c))
        return long_agg(df, cols, {f"{tag}_mean": lambda c: F.avg(x(c)), f"{tag}_std": lambda c: F.stddev_samp(x(c))})

    j = facts(ref, "ref").join(F.broadcast(facts(cur, "cur")), "column_name")
    by = F.col("ref_std") + EPS
    mean, std = F.abs(F.col("ref_mean") - F.col("cur_mean")) / by, F.abs(F.col("ref_std") - F.col("cur_std")) / by
    return j.select("column_name", mean.alias("mean_drift"), std.alias("std_drift"), ((mean > NUMERIC_LIMIT) | (std > NUMERIC_LIMIT)).alias("drifted"))


def _shares(ref: DataFrame, cur: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, value, p, q, n_ref, n_cur): value shares in both tables, full outer."""
    a, b = value_counts(ref, cols).withColumnRenamed("n", "na"), value_counts(cur, cols).withColumnRenamed("n", "nb")
    ta = a.groupBy("column_name").agg(F.sum("na").alias("ta"))
    tb = b.groupBy("column_name").agg(F.sum("nb").alias("tb"))
    j = a.join(b, ["column_name", "value"], "full_outer").join(F.broadcast(ta), "column_name", "left").join(F.broadcast(tb), "column_name", "left")
    zero = F.lit(0)
    na, nb = F.coalesce("na", zero), F.coalesce("nb", zero)
    return j.select("column_name", "value", F.coalesce(share(na, F.col("ta")), F.lit(0.0)).alias("p"), F.coalesce(share(nb, F.col("tb")), F.lit(0.0)).alias("q"),
                    na.alias("n_ref"), nb.alias("n_cur"))


@nan_is_missing
def categorical(ref: DataFrame, cur: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One minus the overlap of the value distributions; nulls are left out."""
    score = 1 - F.sum(F.least("p", "q"))
    return _shares(ref, cur, cols).groupBy("column_name").agg(score.alias("distribution_drift"), (score > CATEGORY_LIMIT).alias("drifted"))


@nan_is_missing
def table(ref: DataFrame, cur: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """One row per shared column plus ``__any__``."""
    nums, texts = shared(ref, cur, skip)
    parts = []
    if nums:
        parts.append(numeric(ref, cur, nums).select("column_name", F.lit("numeric").alias("kind"), F.greatest("mean_drift", "std_drift").alias("score"), "drifted"))
    if texts:
        parts.append(categorical(ref, cur, texts).select("column_name", F.lit("categorical").alias("kind"), F.col("distribution_drift").alias("score"), "drifted"))
    rows = union_all(parts)
    return rows.unionByName(rows.agg(F.lit("__any__").alias("column_name"), F.lit("dataset").alias("kind"),
                                     F.avg(F.col("drifted").cast("double")).alias("score"), F.bool_or("drifted").alias("drifted")))


@nan_is_missing
def kolmogorov_smirnov(ref: DataFrame, cur: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Largest gap of the two empirical distribution functions per column.

    Both tables are counted per value, range-sorted together and given running counts; no column sits in one task.
    """
    rows = (unpivot_number(ref, cols).select("column_name", "value", F.lit(1).alias("a"), F.lit(0).alias("b"))
            .unionByName(unpivot_number(cur, cols).select("column_name", "value", F.lit(0).alias("a"), F.lit(1).alias("b"))))
    vals = rows.groupBy("column_name", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    run = running_sums(vals, {"ca": F.col("a"), "cb": F.col("b")}, ["value"], ["column_name"])
    tot = vals.groupBy("column_name").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    gap = F.abs(F.coalesce(share(F.col("ca"), F.col("ta")), F.lit(0.0)) - F.coalesce(share(F.col("cb"), F.col("tb")), F.lit(0.0)))
    n = F.max("ta") * F.max("tb") / (F.max("ta") + F.max("tb"))
    return run.join(F.broadcast(tot), "column_name").groupBy("column_name").agg(F.max(gap).alias("ks"), F.sqrt(n).alias("root_n"))


@nan_is_missing
def population_stability(ref: DataFrame, cur: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """Population stability index over the deciles of the reference."""
    edges = {c: sorted(set(q[1:-1])) for c, q in _edges_of(ref, cols, bins).items()}

    def binned(df: DataFrame, tag: str) -> DataFrame:
        pairs = []
        for c, es in edges.items():
            x = number(c, dtype(df, c))
            at = F.when(x.isNotNull(), F.lit(0))
            for e in es:
                at = at + (x > F.lit(e)).cast("int")
            pairs.append(F.struct(F.lit(c).alias("column_name"), at.alias("bin")))
        n = (df.select(F.inline(F.array(*pairs))).where("bin is not null").groupBy("column_name", "bin").agg(F.count(F.lit(1)).alias(tag)))
        return n

    a, b = binned(ref, "na"), binned(cur, "nb")
    ta, tb = a.groupBy("column_name").agg(F.sum("na").alias("ta")), b.groupBy("column_name").agg(F.sum("nb").alias("tb"))
    j = a.join(b, ["column_name", "bin"], "full_outer").join(F.broadcast(ta), "column_name", "left").join(F.broadcast(tb), "column_name", "left")
    floor = F.lit(1e-6)  # empty bins count as a millionth
    p = F.greatest(F.coalesce(share(F.col("na"), F.col("ta")), F.lit(0.0)), floor)
    q = F.greatest(F.coalesce(share(F.col("nb"), F.col("tb")), F.lit(0.0)), floor)
    found = j.groupBy("column_name").agg(F.sum((q - p) * F.ln(q / p)).alias("psi"))
    every = ref.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")  # a column empty on both sides has not moved
    return F.broadcast(every).join(found, "column_name", "left").select("column_name", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def _edges_of(ref: DataFrame, cols: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Deciles per column; a column without values in the reference has one bin."""
    found = exact_quantiles(ref, cols, [i / bins for i in range(bins + 1)])
    return {c: q if q[0] is not None else [] for c, q in found.items()}


@nan_is_missing
def categorical_distances(ref: DataFrame, cur: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Chi-square statistic and Jensen-Shannon distance of the value distributions."""
    sh = _shares(ref, cur, cols)
    tot = sh.groupBy("column_name").agg(F.sum("n_ref").alias("ta"), F.sum("n_cur").alias("tb"))
    j = sh.join(F.broadcast(tot), "column_name")
    row = F.col("n_ref") + F.col("n_cur")
    ea, eb = row * F.col("ta") / (F.col("ta") + F.col("tb")), row * F.col("tb") / (F.col("ta") + F.col("tb"))
    m = (F.col("p") + F.col("q")) / 2
    kl = lambda x: F.when(x > 0, x * F.ln(x / m)).otherwise(0.0)
    return j.groupBy("column_name").agg(
        F.sum(F.pow(F.col("n_ref") - ea, F.lit(2.0)) / ea + F.pow(F.col("n_cur") - eb, F.lit(2.0)) / eb).alias("chi2"),
        F.sqrt(F.greatest(F.sum(kl(F.col("p")) + kl(F.col("q"))) / 2, F.lit(0.0))).alias("js_distance"))


@nan_is_missing
def distribution(ref: DataFrame, cur: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Distribution distances of every shared column and whether they pass the limit."""
    nums, texts = shared(ref, cur, skip)
    parts = []
    if nums:
        both = kolmogorov_smirnov(ref, cur, nums).join(F.broadcast(population_stability(ref, cur, nums)), "column_name")
        parts.append(both.select("column_name", F.inline(F.array(
            F.struct(F.lit("ks").alias("measure"), F.col("ks").alias("distance")), F.struct(F.lit("psi").alias("measure"), F.col("psi").alias("distance"))))))
    if texts:
        parts.append(categorical_distances(ref, cur, texts).select("column_name", F.lit("js").alias("measure"), F.col("js_distance").alias("distance")))
    return union_all(parts).withColumn("drifted", F.col("distance") > DISTANCE_LIMIT)


@nan_is_missing
def missing(ref: DataFrame, cur: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Increase of the missing share per column."""
    def facts(df: DataFrame, tag: str) -> DataFrame:
        return long_agg(df, cols, {tag: lambda c: F.avg(as_col(c).isNull().cast("double"))})

    up = F.col("cur_missing") - F.col("ref_missing")
    return facts(ref, "ref_missing").join(F.broadcast(facts(cur, "cur_missing")), "column_name").select(
        "column_name", "ref_missing", "cur_missing", up.alias("increase"), (up > MISSING_LIMIT).alias("drifted"))


def level(score: Column, limit: float) -> Column:
    """INFO below the limit, WARNING from it, CRITICAL from twice the limit."""
    return F.when(score >= 2 * limit, "CRITICAL").when(score >= limit, "WARNING").otherwise("INFO")


@nan_is_missing
def alerts(ref: DataFrame, cur: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Alert level per shared column for drift, and for missing values."""
    nums, texts = shared(ref, cur, skip)
    d = table(ref, cur, skip).where("kind <> 'dataset'")
    drift = d.select("column_name", F.lit("drift").alias("alert"), F.when(F.col("kind") == "numeric", level(F.col("score"), NUMERIC_LIMIT))
                     .otherwise(level(F.col("score"), CATEGORY_LIMIT)).alias("level"))
    gaps = missing(ref, cur, nums + texts).select("column_name", F.lit("missing").alias("alert"), level(F.col("increase"), MISSING_LIMIT).alias("level"))
    return drift.unionByName(gaps)


@nan_is_missing
def summary(ref: DataFrame, cur: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Rows, shared columns and alert counts of a monitoring run."""
    nums, texts = shared(ref, cur, skip)
    a = alerts(ref, cur, skip).agg(*[F.count_if(F.col("level") == x).alias(x.lower()) for x in ("INFO", "WARNING", "CRITICAL")])
    return (ref.agg(F.count(F.lit(1)).alias("n_ref")).crossJoin(cur.agg(F.count(F.lit(1)).alias("n_cur"))).crossJoin(a)
            .withColumn("shared_columns", F.lit(len(nums) + len(texts))))
