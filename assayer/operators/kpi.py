"""Business measures over confusion counts, return on investment, fairness, range rules and gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.values import as_col, clip, number, pearson, share
from assayer.operators.evaluate import _ratio, binary_counts
from assayer.operators.profile import duplicate_rows, iqr_fences
from assayer.plans.columns import dtype, long_agg, numeric_columns

# ---- fixed values -------------------------------------------------------------------------
VALUES = {"customer_lifetime_value": 1200, "acquisition_cost": 150, "retention_cost": 50, "average_monthly_revenue": 75, "churn_rate_baseline": .15}
# name: (formula, weight, target, warning, critical, higher is better)
KPIS = {
    "model_accuracy": ("accuracy", .15, .85, .80, .75, True),
    "model_precision": ("precision", .15, .80, .75, .70, True),
    "model_recall": ("recall", .15, .75, .70, .65, True),
    "churn_prevention_value": ("true_positives * customer_lifetime_value", .25, 120000, None, None, True),
    "false_positive_cost": ("false_positives * retention_cost", .10, None, None, None, False),
    "missed_churn_cost": ("false_negatives * acquisition_cost", .15, None, None, None, False),
}
INVESTMENT = {"model_development": 50000, "data_infrastructure": 25000, "training_and_deployment": 15000}
MONTHLY_COST, YEARLY_COST, MONTHS, YEARLY_RATE, SAVED_PER_DECISION = 3000, 12000, 12, .10, 2
PROFIT_VALUES = {"tp": 100, "fp": 20, "fn": 500}
RANGES = {"age": (0, 120, "cap"), "income": (0, 10_000_000, "review"), "credit_score": (300, 850, "cap"), "balance": (-1_000_000, 10_000_000, "review")}
TRIGGERS = {"missing": .25, "outliers": .05, "duplicates": .1}
# -------------------------------------------------------------------------------------------


def kpi_inputs(preds: DataFrame) -> DataFrame:
    """One row with the names KPI formulas may use."""
    c = binary_counts(preds)
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    return c.select(tp.alias("true_positives"), tn.alias("true_negatives"), fp.alias("false_positives"), fn.alias("false_negatives"),
                    _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"),
                    *[F.lit(v).cast("double").alias(k) for k, v in VALUES.items()])


def values(preds: DataFrame, kpis: Mapping[str, tuple] = KPIS) -> DataFrame:
    """(kpi, value, weight): each formula evaluated over the one-row inputs."""
    rows = [F.struct(F.lit(n).alias("kpi"), F.expr(k[0]).cast("double").alias("value"), F.lit(k[1]).cast("double").alias("weight")) for n, k in kpis.items()]
    return kpi_inputs(preds).select(F.inline(F.array(*rows)))


def status(preds: DataFrame, kpis: Mapping[str, tuple] = KPIS) -> DataFrame:
    """Each KPI against its target, warning and critical bounds in its own direction."""
    out = F.lit("no_target")
    for name, (_, _, target, warn, crit, higher) in kpis.items():
        v = F.col("value") if higher else -F.col("value")
        s = lambda x: x if higher else -x
        band = F.lit("no_target")
        if target is not None:
            band = F.when(v >= s(target), "on_target")
            band = band.when(v >= s(warn), "near_target") if warn is not None else band
            band = band.when(v >= s(crit), "warning").otherwise("critical") if crit is not None else band.otherwise("below_target")
        out = F.when(F.col("kpi") == name, band).otherwise(out)
    return values(preds, kpis).withColumn("status", out)


def roi(preds: DataFrame) -> DataFrame:
    """Monthly cash flow, discounted and cumulated; benefits of the confusion counts spread over the months."""
    up_front = float(sum(INVESTMENT.values()))
    monthly_cost = MONTHLY_COST + YEARLY_COST / MONTHS
    benefit = (F.col("true_positives") * (F.col("customer_lifetime_value") + F.col("acquisition_cost"))
               + (F.col("true_positives") + F.col("true_negatives") + F.col("false_positives") + F.col("false_negatives")) * SAVED_PER_DECISION) / MONTHS
    rate = (1 + YEARLY_RATE) ** (1 / 12) - 1
    flow = kpi_inputs(preds).select(benefit.alias("benefit"), F.explode(F.sequence(F.lit(1), F.lit(MONTHS))).alias("month"))
    from pyspark.sql import Window

    net = F.col("benefit") - monthly_cost
    disc = net / F.pow(F.lit(1 + rate), F.col("month"))
    cum = F.sum(disc).over(Window.partitionBy(F.lit(1)).orderBy("month")) - up_front  # twelve rows
    return flow.select("month", "benefit", net.alias("net"), disc.alias("discounted"), cum.alias("npv"))


def profit(preds: DataFrame, v: Mapping[str, float] = PROFIT_VALUES) -> DataFrame:
    """Profit, efficiency and cost-benefit ratio of the confusion counts."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    gain = (tp * v["tp"] - fp * v["fp"] - fn * v["fn"]).cast("double")
    return binary_counts(preds).select(gain.alias("profit"), _ratio(tp, tp + fp + fn).alias("efficiency"),
                                       (gain / (fp * v["fp"] + fn * v["fn"] + 1)).alias("cost_benefit"))


def correlation(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Correlation over models (``by``) of accuracy and business profit."""
    c = binary_counts(preds, by)
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    return c.agg(pearson(_ratio(tp + tn, tp + tn + fp + fn), (tp * PROFIT_VALUES["tp"] - fp * PROFIT_VALUES["fp"] - fn * PROFIT_VALUES["fn"]).cast("double")).alias("r"),
                 F.count(F.lit(1)).alias("n_models"))


def fairness(preds: DataFrame, group: str, score: str = "p") -> DataFrame:
    """Positive rate, true and false positive rate and calibration gap per group, and their spreads as group ``__spread__``."""
    c = preds.groupBy(as_col(group).cast("string").alias("grp")).agg(
        F.avg((F.col("yhat") == 1).cast("double")).alias("positive_rate"),
        F.avg(F.when(F.col("y") == 1, (F.col("yhat") == 1).cast("double"))).alias("tpr"),
        F.avg(F.when(F.col("y") != 1, (F.col("yhat") == 1).cast("double"))).alias("fpr"),
        F.abs(F.avg(as_col(score)) - F.avg((F.col("y") == 1).cast("double"))).alias("calibration_gap"))
    names = ("positive_rate", "tpr", "fpr", "calibration_gap")
    return c.unionByName(c.agg(F.lit("__spread__").alias("grp"), *[(F.max(n) - F.min(n)).alias(n) for n in names]))


def range_report(df: DataFrame, ranges: Mapping[str, tuple[float, float, str]]) -> DataFrame:
    """Values outside the allowed range per column and the configured action."""
    cols = [c for c in ranges if c in numeric_columns(df)]
    x = lambda c: number(c, dtype(df, c))
    return long_agg(df, cols, {"below": lambda c: F.count_if(x(c) < ranges[c][0]), "above": lambda c: F.count_if(x(c) > ranges[c][1]),
                               "action": lambda c: F.lit(ranges[c][2])})


def enforce_ranges(df: DataFrame, ranges: Mapping[str, tuple[float, float, str]]) -> DataFrame:
    """cap clamps, remove drops the row, review flags it in ``needs_review``."""
    review: Column = F.lit(False)
    for c, (lo, hi, action) in ranges.items():
        if c not in df.columns:
            continue
        off = F.coalesce((as_col(c) < lo) | (as_col(c) > hi), F.lit(False))
        if action == "cap":
            df = df.withColumn(c, clip(as_col(c), F.lit(lo), F.lit(hi)))
        elif action == "remove":
            df = df.filter(~off)
        else:
            review = review | off
    return df.withColumn("needs_review", review)


def triggers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(trigger, subject, value, review): missing share, outlier share, zero variance per column, duplicates per table."""
    x = lambda c: number(c, dtype(df, c))
    f = iqr_fences(df, cols, 1.5)
    per = long_agg(df, list(f), {"missing": lambda c: F.avg(as_col(c).isNull().cast("double")),
                                 "outliers": lambda c: share(F.count_if((x(c) < f[c][0]) | (x(c) > f[c][1])), F.count(x(c))),
                                 "variance": lambda c: F.var_samp(x(c))})
    rows = per.select(F.col("column_name").alias("subject"), F.inline(F.array(
        F.struct(F.lit("missing").alias("trigger"), F.col("missing").alias("value"), (F.col("missing") > TRIGGERS["missing"]).alias("review")),
        F.struct(F.lit("outliers").alias("trigger"), F.col("outliers").alias("value"), (F.col("outliers") > TRIGGERS["outliers"]).alias("review")),
        F.struct(F.lit("zero_variance").alias("trigger"), F.col("variance").alias("value"), (F.col("variance") == 0).alias("review")))))
    ratio = share(F.col("duplicate_rows"), F.col("n_rows"))
    dups = duplicate_rows(df).select(F.lit("__dataset__").alias("subject"), F.lit("duplicates").alias("trigger"), ratio.alias("value"),
                                     (ratio > TRIGGERS["duplicates"]).alias("review"))
    return rows.unionByName(dups)


def quality_gate(before: DataFrame, after: DataFrame, target: str, min_rows: float = .5, max_missing: float = .1) -> DataFrame:
    """Row retention, missing share after cleaning and presence of the target, each passed or not."""
    nb, na = before.agg(F.count(F.lit(1)).alias("nb")), after.agg(F.count(F.lit(1)).alias("na"))
    miss = long_agg(after, after.columns, {"m": lambda c: F.avg(as_col(c).isNull().cast("double"))}).agg(F.avg("m").alias("m"))
    kept = share(F.col("na"), F.col("nb"))
    return nb.crossJoin(na).crossJoin(miss).select(F.inline(F.array(
        F.struct(F.lit("row_retention").alias("gate"), kept.alias("value"), (kept >= min_rows).alias("passed")),
        F.struct(F.lit("missing_after").alias("gate"), F.col("m").alias("value"), (F.col("m") <= max_missing).alias("passed")),
        F.struct(F.lit("target_present").alias("gate"), F.lit(float(target in after.columns)).alias("value"), F.lit(target in after.columns).alias("passed")))))
