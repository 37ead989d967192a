"""Statistical assumption checks; every check is one or two aggregations and a small closed form."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.distributions import chi2_sf, normal_cdf, t_two_sided
from assayer.functions.normality import chi2_two_tail, corrected_kurtosis, corrected_skew, jarque_bera, k_squared
from assayer.functions.values import as_col, band, number, pearson, share
from assayer.operators.evaluate import durbin_watson_of
from assayer.operators.profile import mean_std, pearson_pairs
from assayer.plans.columns import dtype, long_agg, numeric_columns, text_columns, union_all, unpivot_number
from assayer.plans.gram import MAX_FEATURES, complete, cross_products, least_squares
from assayer.plans.ordered import RANGE, running_sums, sorted_ranges
from assayer.session import cut

ALPHA = .05
CHECK = "check string, column_name string, statistic double, p_value double, n bigint, passed boolean"


def normality(df: DataFrame, cols: Sequence[str] | None = None, method: str = "k_squared") -> DataFrame:
    """jarque_bera, k_squared or anderson per numeric column with at least three different values."""
    cols = numeric_columns(df, cols)
    if method == "anderson":
        return anderson_darling(df, cols)
    num = lambda c: number(c, dtype(df, c))
    base = long_agg(df, cols, {"n": lambda c: F.count(num(c)), "lo": lambda c: F.min(num(c)), "hi": lambda c: F.max(num(c)),
                               "g1": lambda c: F.nanvl(F.skewness(num(c)), F.lit(None)), "g2": lambda c: F.nanvl(F.kurtosis(num(c)), F.lit(None))})
    n, g1, g2 = F.col("n"), F.col("g1"), F.col("g2")
    stat = k_squared(n, g1, g2) if method == "k_squared" else jarque_bera(n, g1, g2)
    return base.where("n >= 3 AND lo < hi").withColumn("statistic", stat).select(
        "column_name", "n", "statistic", chi2_two_tail(F.col("statistic")).alias("p_value"),
        (chi2_two_tail(F.col("statistic")) > ALPHA).alias("passed"),
        corrected_skew(n, g1).alias("skewness"), corrected_kurtosis(n, g2).alias("kurtosis"))


def anderson_darling(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Anderson-Darling against the fitted normal, from running counts of distinct values."""
    vals = unpivot_number(df, cols).groupBy("column_name", "value").agg(F.count(F.lit(1)).cast("double").alias("m"))
    ms = {c: v for c, v in mean_std(df, cols).items() if v[1]}
    tot = vals.groupBy("column_name").agg(F.sum("m").alias("n"))
    run = running_sums(vals.where(F.col("column_name").isin(*ms)), {"c": F.col("m")}, ["value"], ["column_name"]).join(F.broadcast(tot), "column_name")
    z = F.coalesce(*[F.when(F.col("column_name") == c, (F.col("value") - m) / s) for c, (m, s) in ms.items()])
    p = normal_cdf(z)
    p = F.when(p < 1e-15, 1e-15).when(p > 1 - 1e-15, 1 - 1e-15).otherwise(p)
    c, m, n = F.col("c"), F.col("m"), F.col("n")
    low, high = c * c - (c - m) * (c - m), (n - c + m) * (n - c + m) - (n - c) * (n - c)
    a2 = -F.first(n) - F.sum(low / n * F.ln(p) + high / n * F.ln(1 - p))
    out = run.groupBy("column_name").agg(F.first(n).cast("bigint").alias("n"), a2.alias("statistic"))
    a = F.col("statistic") * (1 + .75 / F.col("n") + 2.25 / (F.col("n") * F.col("n")))
    pv = (F.when(a >= .6, F.exp(1.2937 - 5.709 * a + .0186 * a * a)).when(a >= .34, F.exp(.9177 - 4.279 * a - 1.38 * a * a))
          .when(a >= .2, 1 - F.exp(-8.318 + 42.796 * a - 59.938 * a * a)).otherwise(1 - F.exp(-13.436 + 101.14 * a - 223.73 * a * a)))
    pv = F.when(a > 50, 0.0).otherwise(pv)
    return out.select("column_name", "n", "statistic", pv.alias("p_value"), (pv > ALPHA).alias("passed"))


def heteroscedasticity(df: DataFrame, target: str, features: Sequence[str], white: bool = False) -> DataFrame:
    """Breusch-Pagan (studentised) or White: n*R2 of the squared residuals on the (expanded) features."""
    d = complete(df, [*features, target])
    fit = least_squares(d, features, target)
    res = F.col(target) - fit.predict()
    aux = d.select(*features, (res * res).alias("__e2"))
    names = list(features)
    if white:
        z = {c: (m, s or 1.0) for c, (m, s) in mean_std(d, features).items()}
        std = {c: (F.col(c) - z[c][0]) / z[c][1] for c in features}
        terms = {f"__t{i}_{j}": std[a] * std[b] for i, a in enumerate(features) for j, b in enumerate(features) if i <= j}
        aux = aux.select(*features, "__e2", *[e.alias(n) for n, e in terms.items()])
        names += list(terms)
    second = least_squares(aux, names, "__e2")
    stat = second.n * second.r2
    p = chi2_sf(stat, len(names))
    return df.sparkSession.createDataFrame([("white" if white else "breusch_pagan", target, float(stat), float(p), fit.n, bool(p > ALPHA))], CHECK)


def correlation_risk(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Absolute Pearson r of every pair on complete rows, with its band."""
    r = F.abs("r")
    return pearson_pairs(df, features, complete=True).select("feature1", "feature2", r.alias("r"),
                                                             band(r, [(.95, "extreme"), (.9, "high"), (.7, "moderate")], "none").alias("band"))


def feature_risk(pairs: DataFrame) -> DataFrame:
    """Risk score per feature: three per extreme, two per high, one per moderate pair."""
    both = pairs.select("band", F.explode(F.array("feature1", "feature2")).alias("feature"))
    n = lambda b: F.count_if(F.col("band") == b)
    score = 3 * n("extreme") + 2 * n("high") + n("moderate")
    return both.groupBy("feature").agg(score.alias("risk_score")).withColumn(
        "risk_level", band(F.col("risk_score"), [(3, "extreme"), (2, "high"), (1, "moderate")], "low"))


def vif(df: DataFrame, features: Sequence[str], center: bool = False, max_features: int = MAX_FEATURES) -> DataFrame:
    """Variance inflation per feature; uncentred by default (no intercept), ``center=True`` for the usual form."""
    if len(features) > max_features:
        raise ValueError(f"more than {max_features} features")
    d = complete(df, features)
    n, s, g = cross_products(d, features)
    if center:
        g = g - np.outer(s, s) / n
    scale = np.sqrt(np.diag(g))
    inv = np.linalg.pinv(g / np.outer(scale, scale))
    rows = [(c, float(inv[i, i])) for i, c in enumerate(features)]
    v = F.col("vif")
    return df.sparkSession.createDataFrame(rows, "feature string, vif double").select(
        "feature", v, band(v, [(20, "extreme"), (10, "high"), (5, "moderate")], "low").alias("risk_level"),
        F.when(v > 1, 1 - 1 / v).otherwise(0.0).alias("r2_with_others"))


def interpret_correlation(r: Column) -> Column:
    return band(r, [(.95, "nearly_perfect"), (.9, "very_strong"), (.7, "strong"), (.5, "moderate")], "weak")


def interpret_vif(v: Column) -> Column:
    return F.when(v.isNull(), "perfect").otherwise(band(v, [(20, "extreme"), (10, "high"), (5, "moderate")], "low"))


def multicollinearity_advice(pairs: DataFrame, vifs: DataFrame) -> DataFrame:
    """Keep, review or remove per feature, and its related features from strongest to weakest."""
    risk = feature_risk(pairs).select("feature", F.col("risk_level").alias("corr_level"))
    linked = pairs.where("band <> 'none'").select(F.inline(F.array(
        F.struct(F.col("feature1").alias("feature"), F.col("feature2").alias("other"), "r"),
        F.struct(F.col("feature2").alias("feature"), F.col("feature1").alias("other"), "r"))))
    related = linked.groupBy("feature").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("r")).alias("k"), "other"))),
                                                                     lambda s: s["other"]), ",").alias("related"))
    j = vifs.select("feature", F.col("risk_level").alias("vif_level")).join(risk, "feature", "full_outer").join(related, "feature", "left")
    lv = lambda *x: F.coalesce(F.col("vif_level").isin(*x), F.lit(False)) | F.coalesce(F.col("corr_level").isin(*x), F.lit(False))
    return j.select("feature", "vif_level", "corr_level", F.coalesce("related", F.lit("")).alias("related"),
                    F.when(lv("extreme"), "remove").when(lv("high"), "consider_removal").when(lv("moderate"), "review").otherwise("keep").alias("advice"))


def ordered_rows(df: DataFrame, target: str, features: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Features ``x0``, ``x1`` ... and target ``y`` as numbers, rows complete in these, sorted in ranges; ``placed``: no null in the order."""
    order = [f"__o{i}" for i in range(len(order_by))]
    names = [*[f"x{i}" for i in range(len(features))], "y"]
    d = df.select(*[as_col(c).alias(o) for c, o in zip(order_by, order)], *[number(c, dtype(df, c)).alias(n) for c, n in zip([*features, target], names)])
    nan = {o for o, c in zip(order, order_by) if isinstance(dtype(df, c), (T.FloatType, T.DoubleType))}
    placed = F.lit(True)
    for o in order:
        placed = placed & F.col(o).isNotNull() & (~F.isnan(o) if o in nan else F.lit(True))
    return sorted_ranges(d.dropna(subset=names).withColumn("placed", placed), order, [*names, "placed"])


def linearity(df: DataFrame, target: str, features: Sequence[str], order_by: Sequence[str], rows: DataFrame | None = None) -> DataFrame:
    """Harvey-Collier: t-test of the mean recursive residual in ``order_by`` order; ``rows``: their ``ordered_rows`` if there are any.

    Ranges report their cross products, the driver adds up the (range count x p x p) prefix, and every range then
    runs its own recursion from its starting state, batch by batch; no range is held in memory.
    """
    names = list(features)
    p = len(names) + 1
    ms = mean_std(complete(df, names), names)
    xs = [f"x{i}" for i in range(len(names))]
    rows = ordered_rows(df, target, names, order_by) if rows is None else rows
    base = rows.where("placed").select(RANGE, *[((F.col(x) - ms[c][0]) / (ms[c][1] or 1.0)).alias(x) for x, c in zip(xs, names)], "y")

    def blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, rid = np.zeros((p + 1, p + 1)), None
        for pdf in parts:
            if len(pdf):
                rid = int(pdf[RANGE].iloc[0])
                z = np.column_stack([np.ones(len(pdf)), pdf[xs].to_numpy(float), pdf["y"].to_numpy(float)])
                g += z.T @ z
        if rid is not None:
            yield pd.DataFrame({"r": [rid], "g": [g.ravel().tolist()]})

    sums = {r["r"]: np.array(r["g"]).reshape(p + 1, p + 1) for r in base.mapInPandas(blocks, "r int, g array<double>").collect()}
    start, acc = {}, np.zeros((p + 1, p + 1))
    for r in sorted(sums):
        start[r] = acc.copy()
        acc = acc + sums[r]

    step = max(1, 1_000_000 // (p + 1) ** 2)  # rows whose sums are held at once

    def recurse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = s1 = s2 = 0.0
        state, started = None, False
        for pdf in parts:
            if not len(pdf):
                continue
            if state is None:
                state = start[int(pdf[RANGE].iloc[0])].copy()
            for at in range(0, len(pdf), step):
                some = pdf.iloc[at:at + step]
                z = np.column_stack([np.ones(len(some)), some[xs].to_numpy(float), some["y"].to_numpy(float)])
                grams = np.cumsum(z[:, :, None] * z[:, None, :], axis=0)
                before = np.concatenate([state[None], state + grams[:-1]])  # what each row's predecessors sum to
                state = state + grams[-1]
                if not started:
                    enough = np.flatnonzero(before[:, 0, 0] > 2 * p)
                    solvable = enough[np.linalg.cond(before[enough, :p, :p]) < 1e12] if len(enough) else enough
                    if not len(solvable):
                        continue
                    started, before, z = True, before[solvable[0]:], z[solvable[0]:]
                x = z[:, :p]
                u = np.linalg.solve(before[:, :p, :p], x[:, :, None])[:, :, 0]
                w = (z[:, p] - (before[:, :p, p] * u).sum(axis=1)) / np.sqrt(1 + (x * u).sum(axis=1))
                n, s1, s2 = n + len(w), s1 + w.sum(), s2 + (w * w).sum()
        yield pd.DataFrame({"n": [n], "s1": [s1], "s2": [s2]})

    row = (base.mapInPandas(recurse, "n double, s1 double, s2 double")
           .agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2")).first())
    n, mean = row["n"], row["s1"] / row["n"]
    var = (row["s2"] - n * mean * mean) / (n - 1)
    t = mean / math.sqrt(var / n) if var > 0 else 0.0
    pv = t_two_sided(t, n - 1)
    return df.sparkSession.createDataFrame([("harvey_collier", target, float(t), float(pv), int(n), bool(pv > ALPHA))], CHECK)


def independence(df: DataFrame, target: str, features: Sequence[str], order_by: Sequence[str], rows: DataFrame | None = None) -> DataFrame:
    """Durbin-Watson of the least-squares residuals in order; passes between 1.5 and 2.5.  ``rows``: as for ``linearity``."""
    rows = ordered_rows(df, target, features, order_by) if rows is None else rows
    fit = least_squares(rows, [f"x{i}" for i in range(len(features))], "y")
    dw = durbin_watson_of(rows, F.col("y") - fit.predict())
    s = F.col("durbin_watson")
    return dw.select(F.lit("durbin_watson").alias("check"), F.lit(target).alias("column_name"), s.alias("statistic"),
                     F.lit(None).cast("double").alias("p_value"), F.col("n"), s.between(1.5, 2.5).alias("passed"))


def class_balance(df: DataFrame, target: str, limit: float = .9) -> DataFrame:
    """Class shares, imbalance ratio and flag (ties: smallest class name)."""
    per = df.where(as_col(target).isNotNull()).groupBy(as_col(target).cast("string").alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    a = per.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes"), F.min(F.struct((-F.col("n")).alias("k"), "cls")).alias("top"),
                F.min(F.struct("n", "cls")).alias("low"))
    major, minor = share(-F.col("top.k"), F.col("n")), share(F.col("low.n"), F.col("n"))
    return a.select("n", "classes", F.col("top.cls").alias("major_class"), major.alias("major_share"), F.col("low.cls").alias("minor_class"),
                    minor.alias("minor_share"), (major / minor).alias("imbalance_ratio"), (major > limit).alias("imbalanced"))


def target_kind(df: DataFrame, target: str, few: int = 20) -> DataFrame:
    """Classification for text, boolean and integers with few values, else regression."""
    t = dtype(df, target)
    kinds = df.agg(F.count_distinct(as_col(target)).alias("distinct_values"))
    if isinstance(t, (T.StringType, T.BooleanType)):
        rule = F.lit("classification")
    elif isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        rule = F.lit("regression")
    else:
        rule = F.when(F.col("distinct_values") <= few, "classification").otherwise("regression")
    return kinds.select(F.lit(target).alias("column_name"), "distinct_values", rule.alias("target_kind"))


def all_checks(df: DataFrame, target: str, order_by: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """The checks that apply to a target, one row each (class imbalance counts as not passed)."""
    nums = numeric_columns(df, cols)
    nm = normality(df, nums).select(F.lit("normality").alias("check"), "column_name", "statistic", "p_value", "n", "passed")
    parts = [nm]
    feats = [c for c in nums if c != target]
    if target in nums and feats:
        rows = ordered_rows(df, target, feats, order_by)  # put into order once for both
        parts += [heteroscedasticity(df, target, feats), linearity(df, target, feats, order_by, rows), independence(df, target, feats, order_by, rows)]
        if len(feats) > 1:
            parts.append(vif(df, feats).select(F.lit("multicollinearity").alias("check"), F.col("feature").alias("column_name"), F.col("vif").alias("statistic"),
                                               F.lit(None).cast("double").alias("p_value"), F.lit(None).cast("bigint").alias("n"), (F.col("vif") < 10).alias("passed")))
    few = df.agg(F.count_distinct(as_col(target))).first()[0] <= 20
    if few:
        parts.append(class_balance(df, target).select(F.lit("class_balance").alias("check"), F.lit(target).alias("column_name"), F.col("major_share").alias("statistic"),
                                                      F.lit(None).cast("double").alias("p_value"), "n", (~F.col("imbalanced")).alias("passed")))
    return union_all(parts)


def advice(checks: DataFrame) -> DataFrame:
    """Advice code per failed kind of check."""
    code = (F.when(F.col("check") == "normality", "transform_features").when(F.col("check") == "multicollinearity", "reduce_features")
            .when(F.col("check").isin("breusch_pagan", "white"), "robust_errors").when(F.col("check") == "harvey_collier", "nonlinear_model")
            .when(F.col("check") == "durbin_watson", "lag_features").when(F.col("check") == "class_balance", "resample"))
    return checks.where(~F.col("passed")).groupBy("check").agg(F.count(F.lit(1)).alias("failed")).withColumn("advice", code)


def summary(checks: DataFrame) -> DataFrame:
    """Pass rate over kinds of check (a kind passes when all its rows do)."""
    per = checks.groupBy("check").agg(F.bool_and("passed").alias("ok"))
    return per.agg(F.count(F.lit(1)).alias("checks"), F.count_if("ok").alias("passed"), F.avg(F.col("ok").cast("double")).alias("pass_rate"),
                   F.array_join(F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("check")))), ",").alias("failed"))


def recommend(checks: DataFrame, kind: str) -> DataFrame:
    """Model families for a target kind from the failed checks and the class imbalance."""
    bad = lambda *names: F.coalesce(F.bool_or(F.col("check").isin(*names) & ~F.col("passed")), F.lit(False))
    f = checks.agg(bad("multicollinearity").alias("mc"), bad("harvey_collier", "normality").alias("shape"), bad("breusch_pagan", "white", "durbin_watson").alias("errors"),
                   bad("class_balance").alias("imb"))
    any_bad = F.col("mc") | F.col("shape") | F.col("errors")
    if kind == "regression":
        pick = (F.when(~any_bad, "linear,ridge,lasso").when(F.col("mc"), "ridge,lasso").when(F.col("shape"), "random_forest,gbt")
                .otherwise("gbt,decision_tree"))
    else:
        pick = (F.when(~any_bad & ~F.col("imb"), "logistic,linear_svc").when(F.col("imb"), "weighted_random_forest,gbt")
                .otherwise("random_forest,gbt,decision_tree"))
    return f.select(F.lit(kind).alias("target_kind"), pick.alias("models"))


def recommend_by_traits(traits: DataFrame) -> DataFrame:
    """Model families, trial count and minutes for the size and width class of a table."""
    big, low, wide = F.col("size_class").isin("medium", "large"), F.col("width_class") == "low", F.col("width_class") == "high"
    large, small = F.col("size_class") == "large", F.col("size_class") == "small"
    simple = F.when(F.col("problem_kind") == "classification", "logistic").otherwise("linear")
    models = F.array_join(F.array_compact(F.array(F.lit("random_forest"), F.when(big, "gbt"), F.when(low | small, simple),
                                                  F.when(large & wide, "mlp"), F.when(small, "linear_svc"))), ",")
    return traits.select("size_class", "width_class", "problem_kind", models.alias("models"),
                         F.when(large & wide, 100).when(small | low, 30).otherwise(50).alias("trials"),
                         F.when(large, 60).when(small, 15).otherwise(30).alias("minutes"))


def advisory(df: DataFrame, target: str) -> DataFrame:
    """Balance status, features with over 20 % missing and text features with over 50 values."""
    feats = [c for c in df.columns if c != target]
    texts = text_columns(df, feats)
    facts = long_agg(df, feats, {"miss": lambda c: F.avg(as_col(c).isNull().cast("double"))})
    wide = long_agg(df, texts, {"n": lambda c: F.count(as_col(c))}, distinct="u").agg(F.count_if(F.col("u") > 50).alias("high_cardinality")) if texts \
        else df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("high_cardinality"))
    miss = facts.agg(F.count_if(F.col("miss") > .2).alias("high_missing"))
    bal = class_balance(df, target).select("classes", "major_share")
    status = F.when(F.col("major_share") > .8, "highly_imbalanced").when(F.col("major_share") > .6, "moderately_imbalanced").otherwise("balanced")
    return bal.crossJoin(miss).crossJoin(wide).select("classes", "major_share", status.alias("balance_status"), "high_missing", "high_cardinality")


# ---- further statistics and filters ------------------------------------------------------------

def average_ranks(df: DataFrame, col: str) -> DataFrame:
    """(value, rank, m): mid-rank and multiplicity of every distinct value, ranked over ranges."""
    vals = df.where(as_col(col).isNotNull()).groupBy(as_col(col).alias("value")).agg(F.count(F.lit(1)).cast("double").alias("m"))
    run = running_sums(vals, {"c": F.col("m")}, ["value"])
    return run.select("value", (F.col("c") - (F.col("m") - 1) / 2).alias("rank"), "m")


def spearman(df: DataFrame, a: str, b: str, key: Sequence[str]) -> DataFrame:
    """Rank correlation of two columns with mid-ranks for ties."""
    from assayer.plans.lookup import lookup_join

    d = df.select(*key, a, b).dropna(subset=[a, b])
    ra = average_ranks(d, a).select(F.col("value").alias(a), F.col("rank").alias("__ra"))
    rb = average_ranks(d, b).select(F.col("value").alias(b), F.col("rank").alias("__rb"))
    both = lookup_join(lookup_join(d, ra, [a]), rb, [b])
    return both.agg(pearson(F.col("__ra"), F.col("__rb")).alias("spearman"), F.count(F.lit(1)).alias("n"))


def kruskal_wallis(df: DataFrame, col: str, group: str) -> DataFrame:
    """H statistic (tie corrected) of a column over groups, with its chi-square p."""
    from assayer.plans.lookup import lookup_join

    ranks = cut(average_ranks(df, col))
    counts = df.dropna(subset=[col, group]).groupBy(as_col(group).alias("g"), as_col(col).alias("value")).agg(F.count(F.lit(1)).cast("double").alias("k"))
    per = lookup_join(counts, ranks, ["value"]).groupBy("g").agg(F.sum(F.col("rank") * F.col("k")).alias("rs"), F.sum("k").alias("k"))
    ties = ranks.agg(F.sum(F.col("m") * F.col("m") * F.col("m") - F.col("m")).alias("ties"))
    row = per.agg(F.sum(F.col("rs") * F.col("rs") / F.col("k")).alias("s"), F.sum("k").alias("n"), F.count(F.lit(1)).alias("g")).crossJoin(ties).first()
    n, g = row["n"], row["g"]
    h = (12 / (n * (n + 1)) * row["s"] - 3 * (n + 1)) / (1 - row["ties"] / (n ** 3 - n))
    return df.sparkSession.createDataFrame([(float(h), float(chi2_sf(h, g - 1)), int(g), int(n))], "h double, p_value double, groups bigint, n bigint")


def theils_u(df: DataFrame, x: str, y: str) -> DataFrame:
    """Uncertainty coefficient of ``x`` given ``y`` from joint counts."""
    j = df.dropna(subset=[x, y]).groupBy(as_col(x).alias("x"), as_col(y).alias("y")).agg(F.count(F.lit(1)).cast("double").alias("o"))
    px, py = j.groupBy("x").agg(F.sum("o").alias("c")), j.groupBy("y").agg(F.sum("o").alias("t"))
    n = j.agg(F.sum("o").alias("n"))
    hx = px.crossJoin(F.broadcast(n)).agg((-F.sum(F.col("c") / F.col("n") * F.ln(F.col("c") / F.col("n")))).alias("hx"))
    hxy = j.join(py, "y").crossJoin(F.broadcast(n)).agg((-F.sum(F.col("o") / F.col("n") * F.ln(F.col("o") / F.col("t")))).alias("hxy"))
    return hx.crossJoin(hxy).select(F.coalesce(F.try_divide(F.col("hx") - F.col("hxy"), F.col("hx")), F.lit(1.0)).alias("theils_u"))


def correlation_filter(df: DataFrame, features: Sequence[str], limit: float = .95) -> DataFrame:
    """Drop the later column of every pair correlated above the limit (pairs are a few rows)."""
    pairs = correlation_risk(df, features).where(F.col("r") > limit).collect()
    gone: set[str] = set()
    for p in sorted(pairs, key=lambda p: (features.index(p["feature1"]), features.index(p["feature2"]))):
        if p["feature1"] not in gone:
            gone.add(p["feature2"])
    return df.drop(*gone)


def vif_filter(df: DataFrame, features: Sequence[str], limit: float = 10.0) -> DataFrame:
    """Drop the column with the largest (centred) inflation until none exceeds the limit."""
    left = list(features)
    while len(left) > 1:
        worst = vif(df, left, center=True).orderBy(F.desc("vif"), "feature").first()
        if worst["vif"] <= limit:
            break
        left.remove(worst["feature"])
    return df.drop(*[c for c in features if c not in left])


def missing_flags(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Add ``<col>_missing`` for every column that has nulls."""
    names = cols or df.columns
    has = df.agg(*[F.max(as_col(c).isNull().cast("int")).alias(c) for c in names]).first()
    return df.withColumns({f"{c}_missing": as_col(c).isNull().cast("int") for c in names if has[c]})
