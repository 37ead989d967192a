"""Metrics of a prediction table (y, yhat, p): every metric from one or two aggregations, AUC exact with ties."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.distributions import t_two_sided
from assayer.functions.values import as_col, pearson
from assayer.plans.columns import union_all
from assayer.plans.ordered import running_sums, sorted_ranges
from assayer.plans.quantiles import exact_quantiles

# ---- fixed values -------------------------------------------------------------------------
TINY = 1e-15
TOTAL_WEIGHTS = {
    "production": {"performance": .40, "stability": .35, "interpretability": .15, "efficiency": .10},
    "research": {"performance": .50, "stability": .20, "interpretability": .25, "efficiency": .05},
    "realtime": {"performance": .35, "stability": .30, "interpretability": .10, "efficiency": .25},
    "regulatory": {"performance": .30, "stability": .25, "interpretability": .40, "efficiency": .05},
}
# -------------------------------------------------------------------------------------------


def _ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def regression(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """r2, rmse, mae, mse, mape, explained variance, max and median absolute error, residual mean and deviation."""
    a, e = as_col(y).cast("double"), as_col(y).cast("double") - as_col(yhat).cast("double")
    med = exact_quantiles(df.select(F.abs(e).alias("ae")), ["ae"], [.5])["ae"][0]
    row = df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(a).alias("vy"), F.var_pop(e).alias("ve"),
                 (100 * F.avg(F.when(a != 0, F.abs(e / a)))).alias("mape"), F.max(F.abs(e)).alias("max_error"),
                 F.avg(e).alias("residual_mean"), F.stddev_pop(e).alias("residual_std"),
                 F.avg(F.when((a > -1) & (as_col(yhat) > -1), F.pow(F.log1p(a) - F.log1p(as_col(yhat)), F.lit(2.0)))).alias("msle"))
    return row.select((1 - F.try_divide(F.col("mse"), F.col("vy"))).alias("r2"), F.sqrt("mse").alias("rmse"), "mae", "mse", "mape",
                      (1 - F.try_divide(F.col("ve"), F.col("vy"))).alias("explained_variance"), "max_error",
                      F.lit(med).cast("double").alias("median_abs_error"), "residual_mean", "residual_std", "msle")


def confusion(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """(y, yhat, n): the confusion matrix, counted map-side."""
    return df.groupBy(as_col(y).alias("y"), as_col(yhat).alias("yhat")).agg(F.count(F.lit(1)).alias("n"))


def binary_counts(df: DataFrame, by: Sequence[str] = (), positive: object = 1, weight: str | None = None) -> DataFrame:
    """The four counts of a two-class prediction table, a row of ``weight`` n as n rows."""
    yes, said = F.col("y") == positive, F.col("yhat") == positive
    many = lambda cond: F.coalesce(F.sum(F.when(cond, F.col(weight).cast("bigint"))), F.lit(0).cast("bigint")) if weight else F.count_if(cond)
    return df.groupBy(*by).agg(many(yes & said).alias("tp"), many(~yes & ~said).alias("tn"), many(~yes & said).alias("fp"), many(yes & ~said).alias("fn"))


def binary(df: DataFrame, positive: object = 1, weight: str | None = None) -> DataFrame:
    """Accuracy, balanced accuracy, precision, recall, f1, specificity, NPV and error rate."""
    c = binary_counts(df, positive=positive, weight=weight)
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    rec, spec, prec = _ratio(tp, tp + fn), _ratio(tn, tn + fp), _ratio(tp, tp + fp)
    n = tp + tn + fp + fn
    return c.select("tp", "tn", "fp", "fn", _ratio(tp + tn, n).alias("accuracy"), ((rec + spec) / 2).alias("balanced_accuracy"),
                    _ratio(fp + fn, n).alias("error_rate"), prec.alias("precision"), rec.alias("recall"),
                    _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), spec.alias("specificity"), _ratio(tn, tn + fn).alias("npv"))


def per_class(df: DataFrame) -> DataFrame:
    """(class, support, predicted, hits, precision, recall, f1) from the confusion matrix."""
    cm = confusion(df)
    rows = cm.select(F.inline(F.array(
        F.struct(F.col("y").alias("cls"), F.col("n").alias("sup"), F.lit(0).cast("bigint").alias("pre"), F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("yhat").alias("cls"), F.lit(0).cast("bigint").alias("sup"), F.col("n").alias("pre"), F.lit(0).cast("bigint").alias("hit")))))
    per = rows.groupBy("cls").agg(F.sum("sup").alias("support"), F.sum("pre").alias("predicted"), F.sum("hit").alias("hits"))
    s, p, h = F.col("support"), F.col("predicted"), F.col("hits")
    return per.select("cls", s, p, h, _ratio(h, p).alias("precision"), _ratio(h, s).alias("recall"), _ratio(2 * h, s + p).alias("f1"))


def multiclass(df: DataFrame) -> DataFrame:
    """Accuracy, and macro and support-weighted precision, recall, f1."""
    s = F.col("support").cast("double")
    return per_class(df).agg(
        (F.sum("hits") / F.sum(s)).alias("accuracy"),
        *[F.avg(m).alias(f"{m}_macro") for m in ("precision", "recall", "f1")],
        *[(F.sum(F.col(m) * s) / F.sum(s)).alias(f"{m}_weighted") for m in ("precision", "recall", "f1")])


def agreement(df: DataFrame) -> DataFrame:
    """Matthews correlation and Cohen's kappa, multiclass forms, from class marginals."""
    s, p = F.col("support").cast("double"), F.col("predicted").cast("double")
    m = per_class(df).agg(F.sum(s).alias("n"), F.sum("hits").cast("double").alias("c"), F.sum(s * p).alias("sp"),
                          F.sum(s * s).alias("ss"), F.sum(p * p).alias("pp"))
    n, c, sp, ss, pp = (F.col(x) for x in ("n", "c", "sp", "ss", "pp"))
    mcc = _ratio(c * n - sp, F.sqrt((n * n - pp) * (n * n - ss)))
    pe = sp / (n * n)
    return m.select(mcc.alias("mcc"), _ratio(c / n - pe, 1 - pe).alias("kappa"))


def _by_score(df: DataFrame, key: Sequence[str], score: str, label: Column) -> DataFrame:
    """Positives and negatives per distinct score: equal scores meet before any ordering, so ties are exact."""
    return df.where(as_col(score).isNotNull()).groupBy(*key, as_col(score).alias("s")).agg(
        F.count_if(label).cast("double").alias("pos"), F.count_if(~label).cast("double").alias("neg"))


def roc_auc(df: DataFrame, score: str = "p", positive: object = 1, key: Sequence[str] = (), label: Column | None = None) -> DataFrame:
    """Area under the ROC curve, ties counted half."""
    lab = label if label is not None else F.col("y") == positive
    run = running_sums(_by_score(df, key, score, lab), {"cn": F.col("neg")}, ["s"], key)
    below = F.col("cn") - F.col("neg")
    return run.groupBy(*key).agg(F.try_divide(
        F.sum(F.col("pos") * (below + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def roc_auc_ovr(df: DataFrame, scores: Mapping[str, str]) -> DataFrame:
    """One-versus-rest AUC per class (class value to its score column), for macro or weighted averaging."""
    rows = df.select("y", F.inline(F.array(*[F.struct(F.lit(c).alias("cls"), as_col(s).cast("double").alias("p")) for c, s in scores.items()])))
    return roc_auc(rows, key=["cls"], label=F.col("y") == F.col("cls"))


def average_precision(df: DataFrame, score: str = "p", positive: object = 1) -> DataFrame:
    """Step-wise area under the precision-recall curve."""
    by = _by_score(df, (), score, F.col("y") == positive).withColumn("d", -F.col("s"))
    run = running_sums(by, {"cp": F.col("pos"), "cn": F.col("neg")}, ["d"])
    prec = F.col("cp") / (F.col("cp") + F.col("cn"))
    return run.agg(F.try_divide(F.sum(F.col("pos") * prec), F.sum("pos")).alias("average_precision"))


def log_loss(df: DataFrame, score: str = "p", positive: object = 1) -> DataFrame:
    p = as_col(score)
    q = F.when(p < TINY, TINY).when(p > 1 - TINY, 1 - TINY).otherwise(p)
    return df.agg((-F.avg(F.when(F.col("y") == positive, F.ln(q)).otherwise(F.ln(1 - q)))).alias("log_loss"))


def margin_to_probability(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


def train_scores(df: DataFrame, by: str, kind: str) -> DataFrame:
    """The short metric set per split (train, validation, test)."""
    if kind == "regression":
        e = F.col("y") - F.col("yhat")
        return df.groupBy(by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
                                  (1 - F.avg(e * e) / F.var_pop("y")).alias("r2"))
    both = F.col("y") == F.col("yhat")
    acc = df.groupBy(by).agg(F.avg(both.cast("double")).alias("accuracy"))
    rows = df.groupBy(by, "y", "yhat").agg(F.count(F.lit(1)).alias("n"))
    parts = rows.select(by, F.inline(F.array(
        F.struct(F.col("y").alias("cls"), F.col("n").alias("sup"), F.lit(0).cast("bigint").alias("pre"), F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("yhat").alias("cls"), F.lit(0).cast("bigint").alias("sup"), F.col("n").alias("pre"), F.lit(0).cast("bigint").alias("hit")))))
    per = parts.groupBy(by, "cls").agg(F.sum("sup").alias("s"), F.sum("pre").alias("p"), F.sum("hit").alias("h"))
    f1 = per.groupBy(by).agg((F.sum(_ratio(2 * F.col("h"), F.col("s") + F.col("p")) * F.col("s")) / F.sum("s")).alias("f1_weighted"))
    return acc.join(f1, by)


# ---- residuals --------------------------------------------------------------------------------

def residual_stats(df: DataFrame) -> DataFrame:
    e = F.col("y") - F.col("yhat")
    return df.agg(F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"), F.skewness(e).alias("skewness"), F.kurtosis(e).alias("kurtosis"))


def residual_heteroscedasticity(df: DataFrame) -> DataFrame:
    """Pearson r of absolute residual and prediction, with its two-sided p."""
    e = F.abs(F.col("y") - F.col("yhat"))
    row = df.agg(pearson(e, F.col("yhat")).alias("r"), F.count(F.lit(1)).alias("n")).first()
    r, n = row["r"], row["n"]
    p = None if r is None or n < 3 else 0.0 if abs(r) >= 1 else t_two_sided(r * ((n - 2) / (1 - r * r)) ** .5, n - 2)
    return df.sparkSession.createDataFrame([(r, p, n)], "r double, p_value double, n bigint")


def durbin_watson(df: DataFrame, residual: Column, order_by: Sequence[str]) -> DataFrame:
    """Sum of squared successive differences over the sum of squares, in ``order_by`` order.

    Rows are brought into order once; see ``durbin_watson_of``.
    """
    return durbin_watson_of(sorted_ranges(df.select(*[as_col(c) for c in order_by], residual.alias("e")), order_by, ["e"]), F.col("e"))


def durbin_watson_of(rows: DataFrame, residual: Column) -> DataFrame:
    """The statistic of ``sorted_ranges``.

    Each ordered range reports its own sums and its first and last residual; only those few rows are stitched.
    """
    from pyspark.sql import Window

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, d, s, first, last = None, 0, 0.0, None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            has, e = b.column(1).is_valid().to_numpy(zero_copy_only=False), b.column(1).fill_null(0.0).to_numpy()
            if at is None:
                at, first = b.column(0)[0].as_py(), float(e[0]) if has[0] else None
            elif last is not None and has[0]:
                d += (e[0] - last) ** 2
            steps = np.diff(e)[has[1:] & has[:-1]]
            d, n, last = d + float(steps @ steps), n + len(e), float(e[-1]) if has[-1] else None
            if has.any():
                s = (s or 0.0) + float(e @ e)
        if at is not None:
            yield pa.RecordBatch.from_pylist([{"__range": at, "n": n, "d": d, "s": s, "first": first, "last": last}], schema=pa.schema(
                [("__range", pa.int32()), ("n", pa.int64()), *[(c, pa.float64()) for c in ("d", "s", "first", "last")]]))

    per = rows.select("__range", residual.cast("double").alias("e")).mapInArrow(sums, "__range int, n bigint, d double, s double, first double, last double")
    seam = F.col("first") - F.lag("last").over(Window.partitionBy(F.lit(1)).orderBy("__range"))
    return per.withColumn("seam", seam * seam).agg(
        (F.sum(F.coalesce("d", F.lit(0.0)) + F.coalesce("seam", F.lit(0.0))) / F.sum("s")).alias("durbin_watson"), F.sum("n").alias("n"))


def residual_outliers(df: DataFrame, z: float = 3.0, k: float = 1.5) -> DataFrame:
    """Residual outliers by deviation and by fences, and the share of rows hit by either."""
    d = df.select((F.col("y") - F.col("yhat")).cast("double").alias("e"))
    q1, q3 = exact_quantiles(d, ["e"], [.25, .75])["e"]
    m, s = d.agg(F.avg("e"), F.stddev_pop("e")).first()
    by_z = F.abs(F.col("e") - m) / s > z if s else F.lit(False)
    by_iqr = (F.col("e") < q1 - k * (q3 - q1)) | (F.col("e") > q3 + k * (q3 - q1))
    return d.agg(F.count_if(by_z).alias("z_outliers"), F.count_if(by_iqr).alias("iqr_outliers"),
                 F.avg((by_z | by_iqr).cast("double")).alias("outlier_share"))


def error_quantiles(df: DataFrame, probs: Sequence[float] = (.5, .75, .9, .95, .99)) -> DataFrame:
    d = df.select(F.abs(F.col("y") - F.col("yhat")).cast("double").alias("e"))
    q = exact_quantiles(d, ["e"], list(probs))["e"]
    return df.sparkSession.createDataFrame(list(zip([float(p) for p in probs], q)), "prob double, abs_error double")


# ---- tables of scores --------------------------------------------------------------------------

def rank_models(scores: DataFrame, by: str, k: int | None = None) -> DataFrame:
    """Models with their rank by a score column (bounded by the number of models)."""
    from pyspark.sql import Window

    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last(by), "model")))
    return out.where(F.col("rank") <= k) if k else out


def vote(preds: DataFrame, kind: str, key: Sequence[str]) -> DataFrame:
    """Ensemble of (key, model, yhat[, p]) rows: mean, soft (mean probability) or majority (smallest on ties)."""
    if kind == "mean":
        return preds.groupBy(*key).agg(F.avg("yhat").alias("yhat"))
    if kind == "soft":
        return preds.groupBy(*key).agg(F.avg("p").alias("p")).withColumn("yhat", (F.col("p") >= .5).cast("int"))
    counted = preds.groupBy(*key, "yhat").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*key).agg(F.min(F.struct((-F.col("n")).alias("n"), "yhat")).alias("m")).select(*key, "m.yhat")


def compare_runs(runs: DataFrame, baseline: str, best_by: str) -> DataFrame:
    """Runs as rows, metrics as columns (from run, metric, value), with the percent gain over a baseline run."""
    metrics = sorted(r["metric"] for r in runs.select("metric").distinct().collect())
    wide = runs.groupBy("run").pivot("metric", metrics).agg(F.first("value"))
    base = wide.where(F.col("run") == baseline).select(F.col(best_by).alias("__base"))
    return wide.crossJoin(F.broadcast(base)).select(
        "run", *metrics, (100 * F.try_divide(F.col(best_by) - F.col("__base"), F.abs("__base"))).alias("gain_pct"))


def rank_agreement(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """Top-k overlap and Spearman correlation of two (feature, score) tables (bounded by the number of features)."""
    from pyspark.sql import Window

    def ranked(t: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(F.lit(1)).orderBy(F.desc("score"))
        return t.select("feature", F.rank().over(w).cast("double").alias("lo"), F.col("score")).withColumn(
            name, F.col("lo") + (F.count(F.lit(1)).over(Window.partitionBy("score")) - 1) / 2).select("feature", name)

    j = ranked(a, "ra").join(ranked(b, "rb"), "feature")
    return j.agg((F.count_if((F.col("ra") <= k) & (F.col("rb") <= k)) / F.least(F.lit(k), F.count(F.lit(1)))).alias("top_overlap"),
                 pearson(F.col("ra"), F.col("rb")).alias("spearman"))


def interpretability(importances: DataFrame, attributed: bool = False) -> DataFrame:
    """Score of an importance table (feature, importance): spread importances and few important features score high."""
    pos = F.greatest(F.col("importance"), F.lit(0.0))
    facts = importances.agg(F.sum(pos).alias("t"), F.count_if(F.col("importance") > .01).alias("n"), F.max(pos).alias("top"))
    conc = _ratio(F.col("top"), F.col("t"))
    score = (1 - F.least(conc, F.lit(1.0))) * .4 + F.least(10 / F.greatest(F.col("n"), F.lit(1)), F.lit(1.0)) * .2 + (.4 if attributed else 0)
    return facts.select(conc.alias("concentration"), F.col("n").alias("important"), F.least(score, F.lit(1.0)).alias("score"))


def stability(noise: Column, dropout: Column, bootstrap: Column, repeat: Column) -> Column:
    return noise * .3 + dropout * .3 + bootstrap * .25 + repeat * .15


def compare_models(long: DataFrame) -> DataFrame:
    """model x (performance, stability, interpretability) from (model, aspect, value) rows."""
    return long.groupBy("model").pivot("aspect", ["performance", "stability", "interpretability"]).agg(F.avg("value"))


def total_score(long: DataFrame, profile: str = "production") -> DataFrame:
    """Weighted total per model from (model, aspect, value) rows."""
    w = TOTAL_WEIGHTS[profile]
    weight = F.coalesce(*[F.when(F.col("aspect") == a, v) for a, v in w.items()])
    return long.groupBy("model").agg(F.sum(F.col("value") * weight).alias("total"))


def roc_auc_ovo_pairs(df: DataFrame, scores: Mapping[str, str]) -> DataFrame:
    """AUC of every ordered class pair, on the rows of the two classes only."""
    parts = [roc_auc(df.where(F.col("y").isin(a, b)), score=scores[a], positive=a).select(F.lit(a).alias("cls"), F.lit(b).alias("versus"), "roc_auc")
             for a in scores for b in scores if a != b]
    return union_all(parts)


def ranking_quality(df: DataFrame, query: str, key: Sequence[str], k: int = 10) -> DataFrame:
    """Mean NDCG@k and MAP@k over queries of (query, gain, score) rows; a gain above zero counts as relevant.

    Both orders are cut at rank k by a rank filter that Spark applies before the shuffle, so a large query sends
    at most k rows per task.
    """
    from pyspark.sql import Window

    def top(order: str) -> DataFrame:
        w = Window.partitionBy(query).orderBy(F.desc(order), *key)
        return df.select(query, "gain", "score", *key).withColumn("at", F.row_number().over(w)).where(F.col("at") <= k)

    rel = (F.col("gain") > 0).cast("int")
    hits = F.sum(rel).over(Window.partitionBy(query).orderBy("at"))
    got = top("score").withColumn("hits", hits).groupBy(query).agg(
        F.sum(F.col("gain") / F.log2(F.col("at") + 1)).alias("dcg"), F.sum(F.when(rel == 1, F.col("hits") / F.col("at"))).alias("precisions"))
    best = top("gain").groupBy(query).agg(F.sum(F.col("gain") / F.log2(F.col("at") + 1)).alias("ideal"))
    total = df.groupBy(query).agg(F.sum(rel).alias("relevant"))
    ap = F.coalesce(F.try_divide(F.col("precisions"), F.least(F.col("relevant"), F.lit(k))), F.lit(0.0))
    return got.join(best, query).join(total, query).agg(
        F.avg(F.try_divide(F.col("dcg"), F.col("ideal"))).alias("ndcg"), F.avg(ap).alias("map"), F.count(F.lit(1)).alias("queries"))
