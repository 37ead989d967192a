"""Registered queries: evaluation of prediction tables, drift, business measures and windowed monitoring."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from assayer.catalog.fixtures import load, per_column, r, rounded, view, with_views
from assayer.operators import drift as D
from assayer.operators import evaluate as EV
from assayer.operators import kpi as K
from assayer.operators.profile import pearson_pairs
from assayer.session import shared_folder
from assayer.streaming import monitor as M

LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
PB = lambda q: with_views("pred_binary", q)
PM = lambda q: with_views("pred_multi", q)
PR = lambda q: with_views("pred_reg", q)
EVS = lambda q: with_views("events_ref events_cur", q)


def _b(s, d):
    return view(s, d, "pred_binary")


def _m(s, d):
    return view(s, d, "pred_multi")


def _reg(s, d):
    return view(s, d, "pred_reg")


def _rc(s, d):
    return view(s, d, "events_ref"), view(s, d, "events_cur")


def _splits(df):
    return df.withColumn("split", F.when(F.col("l_linenumber") <= 4, "train").when(F.col("l_linenumber") <= 5, "val").otherwise("test"))


def _proba(df):
    """Class scores derived from the key, so that a multiclass AUC has something to rank."""
    return df.select("y", *[((F.col("o_orderkey") * k % 101) / 101.0 + F.when(F.col("yhat") == c, .4).otherwise(0.0)).alias(f"p_{c}") for c, k in (("F", 7), ("O", 11), ("P", 13))])


PROBA_SQL = "SELECT y, " + ", ".join(f"(o_orderkey * {k} % 101) / 101.0::DOUBLE + CASE WHEN yhat = '{c}' THEN 0.4 ELSE 0.0 END AS p_{c}" for c, k in (("F", 7), ("O", 11), ("P", 13))) + " FROM pred_multi"


def _models(s, d):
    """Three derived models (thresholds) over the whole prediction table, long form."""
    return _b(s, d).select(*LI_KEY, "y", "p", F.explode(F.array(*[F.struct(F.lit(f"m{int(t * 100)}").alias("model"), F.lit(t).alias("t")) for t in (.3, .5, .7)])).alias("x")) \
        .select(*LI_KEY, "y", "p", "x.model", (F.col("p") >= F.col("x.t")).cast("int").alias("yhat"))


MODELS = f"SELECT {', '.join(LI_KEY)}, y, p, m.model, CASE WHEN p >= m.t THEN 1 ELSE 0 END AS yhat FROM pred_binary, (VALUES ('m30', 0.3), ('m50', 0.5), ('m70', 0.7)) m(model, t)"


def _scores(s, d):
    return _models(s, d).groupBy("model").agg(F.avg((F.col("y") == F.col("yhat")).cast("double")).alias("test_accuracy"), F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"))


SCORES = f"SELECT model, avg(CASE WHEN y = yhat THEN 1.0 ELSE 0.0 END) AS test_accuracy, avg(abs(y - p)) AS mae FROM ({MODELS}) GROUP BY 1"


def _aspects(s, d):
    return _scores(s, d).select("model", F.inline(F.array(
        F.struct(F.lit("performance").alias("aspect"), F.col("test_accuracy").alias("value")), F.struct(F.lit("stability").alias("aspect"), (1 - F.col("mae")).alias("value")),
        F.struct(F.lit("interpretability").alias("aspect"), F.lit(.5).alias("value")), F.struct(F.lit("efficiency").alias("aspect"), F.lit(.9).alias("value")))))


FEATS = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


def _ranks(s, d):
    li = load(s, d, "lineitem").withColumn("t1", F.col("l_partkey").cast("double")).withColumn("t2", F.col("l_suppkey").cast("double"))
    mk = lambda t: pearson_pairs(li, [*FEATS, t]).where(F.col("feature2") == t).select(F.col("feature1").alias("feature"), F.abs("r").alias("score"))
    return EV.rank_agreement(mk("t1"), mk("t2"), 2)


def _profile(s, d):
    return M.reference_profile(view(s, d, "events_ref"), "value", "event_type")


def _stream(s, d, build):
    """Run the streaming form over the events files and read back the closed windows."""
    schema = load(s, d, "events").schema
    src = s.readStream.schema(schema).parquet(os.path.join(d, "event[s].parquet")).withColumn("ts", F.col("ts").cast("timestamp"))
    return M.run_and_close(src, build, "ts", shared_folder(s, "stream"))


def _ovr(s, d):
    per = EV.roc_auc_ovr(_proba(_m(s, d)), {c: f"p_{c}" for c in "FOP"})
    return per.unionByName(per.agg(F.lit("macro").alias("cls"), F.avg("roc_auc").alias("roc_auc")))


NAMED = "SELECT l_quantity * 3 AS age, l_extendedprice * 130 AS income, l_quantity * 20 AS credit_score, l_extendedprice - 40000 AS balance, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem"


def _ranges(s, d):
    return load(s, d, "lineitem").selectExpr("l_quantity * 3 AS age", "l_extendedprice * 130 AS income", "l_quantity * 20 AS credit_score", "l_extendedprice - 40000 AS balance", *LI_KEY)


QUERIES = {
    "ev_regression": lambda s, d: rounded(EV.regression(_reg(s, d)).drop("msle"), 4),
    "ev_msle": lambda s, d: rounded(EV.regression(_reg(s, d)).select("msle")),
    "ev_confusion": lambda s, d: EV.confusion(_b(s, d)),
    "ev_binary": lambda s, d: rounded(EV.binary(_b(s, d))),
    "ev_multiclass": lambda s, d: rounded(EV.multiclass(_m(s, d))),
    "ev_mcc": lambda s, d: rounded(EV.agreement(_m(s, d)).select("mcc")), "ev_kappa": lambda s, d: rounded(EV.agreement(_m(s, d)).select("kappa")),
    "ev_roc_auc": lambda s, d: rounded(EV.roc_auc(_b(s, d))), "ev_roc_auc_ovr": lambda s, d: rounded(_ovr(s, d)),
    "ev_roc_auc_ovo": lambda s, d: rounded(EV.roc_auc_ovo_pairs(_proba(_m(s, d)), {c: f"p_{c}" for c in "FOP"})),
    "ev_pr_auc": lambda s, d: rounded(EV.average_precision(_b(s, d))),
    "ev_log_loss": lambda s, d: rounded(EV.log_loss(_b(s, d))),
    "ev_margin_to_prob": lambda s, d: rounded(_b(s, d).select(*LI_KEY, EV.margin_to_probability(F.col("p") * 4 - 2).alias("prob"))),
    "ev_train_scores": lambda s, d: rounded(EV.train_scores(_splits(_b(s, d)), "split", "classification")),
    "ev_train_scores_reg": lambda s, d: rounded(EV.train_scores(_splits(_reg(s, d)), "split", "regression"), 4),
    "res_stats": lambda s, d: rounded(EV.residual_stats(_reg(s, d)), 4),
    "res_hetero": lambda s, d: rounded(EV.residual_heteroscedasticity(_reg(s, d)).select("r", "n")),
    "res_autocorr": lambda s, d: rounded(EV.durbin_watson(_reg(s, d), F.col("y") - F.col("yhat"), [*LI_KEY, "y", "yhat"])),
    "res_outliers": lambda s, d: rounded(EV.residual_outliers(_reg(s, d), 2.0)),
    "res_quantiles": lambda s, d: rounded(EV.error_quantiles(_reg(s, d)), 4),
    "feat_corr_pairs": lambda s, d: rounded(pearson_pairs(load(s, d, "lineitem"), FEATS).agg(F.count_if(F.abs("r") > .7).alias("n_high"), F.max(F.abs("r")).alias("max_r"), F.avg(F.abs("r")).alias("mean_r"))),
    "rank_agreement": lambda s, d: rounded(_ranks(s, d)),
    "interp_score": lambda s, d: rounded(EV.interpretability(pearson_pairs(load(s, d, "lineitem"), FEATS).where("feature1 = 'l_quantity'").select(F.col("feature2").alias("feature"), F.abs("r").alias("importance")))),
    "stab_overall": lambda s, d: rounded(_scores(s, d).select("model", EV.stability(F.col("test_accuracy"), 1 - F.col("mae"), F.col("test_accuracy"), F.lit(1.0)).alias("stability"))),
    "eval_compare": lambda s, d: rounded(EV.compare_models(_aspects(s, d))),
    "model_total_score": lambda s, d: rounded(EV.total_score(_aspects(s, d))),
    "ml_rank": lambda s, d: rounded(EV.rank_models(_scores(s, d), "test_accuracy", 2)),
    "ml_vote": lambda s, d: EV.vote(_models(s, d), "majority", LI_KEY),
    "ml_vote_soft": lambda s, d: rounded(EV.vote(_models(s, d), "soft", LI_KEY)),
    "ml_compare_runs": lambda s, d: rounded(EV.compare_runs(_aspects(s, d).select(F.col("model").alias("run"), F.col("aspect").alias("metric"), "value"), "m50", "performance")),
    "drift_numeric": lambda s, d: rounded(D.numeric(*_rc(s, d), ["value", "user_id"])),
    "drift_categorical": lambda s, d: rounded(D.categorical(*_rc(s, d), ["event_type"])),
    "drift_table": lambda s, d: rounded(D.table(*_rc(s, d), ["event_id"])),
    "drift_ks": lambda s, d: rounded(D.kolmogorov_smirnov(*_rc(s, d), ["value", "user_id"])),
    "drift_psi": lambda s, d: rounded(D.population_stability(*_rc(s, d), ["value", "user_id"])),
    "drift_categorical_distance": lambda s, d: rounded(D.categorical_distances(*_rc(s, d), ["event_type"])),
    "drift_distribution": lambda s, d: rounded(D.distribution(*_rc(s, d), ["event_id"])),
    "drift_missing": lambda s, d: rounded(D.missing(*_rc(s, d), ["value", "event_type"])),
    "drift_alert": lambda s, d: D.alerts(*_rc(s, d), ["event_id"]),
    "drift_summary": lambda s, d: D.summary(*_rc(s, d), ["event_id"]),
    "kpi_value": lambda s, d: rounded(K.values(_b(s, d))), "kpi_status": lambda s, d: rounded(K.status(_b(s, d))),
    "kpi_roi": lambda s, d: rounded(K.roi(_b(s, d)), 2), "kpi_profit": lambda s, d: rounded(K.profit(_b(s, d))),
    "kpi_correlation": lambda s, d: rounded(K.correlation(_models(s, d), ["model"])),
    "fairness": lambda s, d: rounded(K.fairness(_b(s, d), "grp")),
    "rule_ranges": lambda s, d: K.range_report(_ranges(s, d), K.RANGES),
    "rule_ranges_enforced": lambda s, d: rounded(K.enforce_ranges(_ranges(s, d), K.RANGES), 3),
    "rule_triggers": lambda s, d: rounded(K.triggers(view(s, d, "orders_dirty").withColumns({"o_totalprice": F.col("o_totalprice") / 1e6, "o_custkey": F.col("o_custkey") / 1e3}), ["o_totalprice", "o_custkey"])),
    "quality_gate": lambda s, d: rounded(K.quality_gate(view(s, d, "orders_dirty"), view(s, d, "orders_dirty").dropna(), "o_orderstatus")),
    "stream_drift": lambda s, d: rounded(M.window_drift(view(s, d, "events_cur"), _profile(s, d), "ts", "value", "event_type")),
    "stream_shares": lambda s, d: rounded(M.window_shares(view(s, d, "events_cur"), _profile(s, d), "ts", "event_type")),
    "stream_quality": lambda s, d: rounded(M.window_quality(view(s, d, "events_gaps"), "ts", "value", 1.0, 50.0, "event_type", ["click", "view", "purchase"])),
    "stream_drift_run": lambda s, d: rounded(_stream(s, d, lambda src: M.window_drift(src, _profile(s, d), "ts", "value", "event_type", late="1 hour"))),
    "stream_quality_run": lambda s, d: rounded(_stream(s, d, lambda src: M.window_quality(src, "ts", "value", 1.0, 50.0, "event_type", ["click", "view", "purchase"], late="1 hour"))),
}

E_ = "y - yhat"
MC = """per AS (SELECT c.cls, (SELECT count(*) FROM pred_multi WHERE y = c.cls) AS s, (SELECT count(*) FROM pred_multi WHERE yhat = c.cls) AS p, (SELECT count(*) FROM pred_multi WHERE y = c.cls AND yhat = c.cls) AS h
    FROM (SELECT DISTINCT y AS cls FROM pred_multi UNION SELECT DISTINCT yhat FROM pred_multi) c)"""
AUC = "SELECT sum(CASE WHEN {y} THEN rk ELSE 0 END) AS rs, CAST(count(*) FILTER ({y}) AS DOUBLE) AS np, CAST(count(*) FILTER (NOT {y}) AS DOUBLE) AS nn FROM (SELECT *, (rank() OVER (ORDER BY {p}) + rank() OVER (ORDER BY {p}) + count(*) OVER (PARTITION BY {p}) - 1) / 2 AS rk FROM {t})"


def _auc(y, p, t):
    return f"(SELECT (rs - np * (np + 1) / 2) / (np * nn) FROM ({AUC.format(y=y, p=p, t=t)}))"


NUMD = per_column("value user_id", """SELECT '{c}' AS column_name, abs(a.m - b.m) / (a.s + 1e-8) AS mean_drift, abs(a.s - b.s) / (a.s + 1e-8) AS std_drift
    FROM (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM events_ref) a, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM events_cur) b""")
SH = """sh AS (SELECT v, coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb, coalesce(a.n, 0) * 1.0 / (SELECT count(event_type) FROM events_ref) AS p, coalesce(b.n, 0) * 1.0 / (SELECT count(event_type) FROM events_cur) AS q
    FROM (SELECT event_type AS v, count(*) AS n FROM events_ref GROUP BY 1) a FULL JOIN (SELECT event_type AS v, count(*) AS n FROM events_cur GROUP BY 1) b USING (v))"""
CATD = "SELECT 1 - sum(least(p, q)) AS score FROM sh"
TABLE_ = f"""SELECT column_name, 'numeric' AS kind, greatest(mean_drift, std_drift) AS score, mean_drift > 0.5 OR std_drift > 0.5 AS drifted FROM ({NUMD})
    UNION ALL SELECT 'event_type', 'categorical', score, score > 0.3 FROM ({CATD})"""
KS = per_column("value user_id", """SELECT '{c}' AS column_name, max(abs(fa - fb)) AS ks, sqrt(any_value(ta) * any_value(tb) / (any_value(ta) + any_value(tb))) AS root_n FROM (
    SELECT sum(a) OVER (ORDER BY v) / ta AS fa, sum(b) OVER (ORDER BY v) / tb AS fb, ta, tb FROM (SELECT v, sum(a) AS a, sum(b) AS b FROM (SELECT {c} AS v, 1 AS a, 0 AS b FROM events_ref UNION ALL SELECT {c}, 0, 1 FROM events_cur) WHERE v IS NOT NULL GROUP BY 1),
    (SELECT CAST(count({c}) AS DOUBLE) AS ta FROM events_ref), (SELECT CAST(count({c}) AS DOUBLE) AS tb FROM events_cur))""")
PSI = per_column("value user_id", """SELECT '{c}' AS column_name, sum((q - p) * ln(q / p)) AS psi FROM (
    SELECT greatest(coalesce(a.n, 0) * 1.0 / (SELECT count({c}) FROM events_ref), 1e-6) AS p, greatest(coalesce(b.n, 0) * 1.0 / (SELECT count({c}) FROM events_cur), 1e-6) AS q FROM
    (SELECT len(list_filter(e, lambda v: v < x)) AS bin, count(*) AS n FROM (SELECT CAST({c} AS DOUBLE) AS x FROM events_ref WHERE {c} IS NOT NULL), (SELECT list_distinct(quantile_cont(CAST({c} AS DOUBLE), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM events_ref) GROUP BY 1) a
    FULL JOIN (SELECT len(list_filter(e, lambda v: v < x)) AS bin, count(*) AS n FROM (SELECT CAST({c} AS DOUBLE) AS x FROM events_cur WHERE {c} IS NOT NULL), (SELECT list_distinct(quantile_cont(CAST({c} AS DOUBLE), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM events_ref) GROUP BY 1) b USING (bin))""")
JS = "SELECT 'event_type' AS column_name, sum(power(na - (na + nb) * ta / (ta + tb), 2) / ((na + nb) * ta / (ta + tb)) + power(nb - (na + nb) * tb / (ta + tb), 2) / ((na + nb) * tb / (ta + tb))) AS chi2, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS js_distance FROM sh, (SELECT CAST(sum(na) AS DOUBLE) AS ta, CAST(sum(nb) AS DOUBLE) AS tb FROM sh)"
MISS = per_column("value event_type", "SELECT '{c}' AS column_name, (SELECT avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END) FROM events_ref) AS ref_missing, (SELECT avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END) FROM events_cur) AS cur_missing")
LEVEL = lambda s, lim: f"CASE WHEN {s} >= {2 * lim} THEN 'CRITICAL' WHEN {s} >= {lim} THEN 'WARNING' ELSE 'INFO' END"
ALERTS = f"""SELECT column_name, 'drift' AS alert, CASE kind WHEN 'numeric' THEN {LEVEL('score', .5)} ELSE {LEVEL('score', .3)} END AS level FROM ({TABLE_})
    UNION ALL SELECT column_name, 'missing', {LEVEL('cur_missing - ref_missing', .1)} FROM ({MISS} UNION ALL SELECT 'user_id', 0.0, 0.0)"""
CONF = "SELECT CAST(count(*) FILTER (y = 1 AND yhat = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (y = 0 AND yhat = 0) AS DOUBLE) AS tn, CAST(count(*) FILTER (y = 0 AND yhat = 1) AS DOUBLE) AS fp, CAST(count(*) FILTER (y = 1 AND yhat = 0) AS DOUBLE) AS fn FROM pred_binary"
KPI = f"""SELECT unnest([{{'kpi': 'model_accuracy', 'value': (tp + tn) / (tp + tn + fp + fn), 'weight': 0.15::DOUBLE}}, {{'kpi': 'model_precision', 'value': tp / (tp + fp), 'weight': 0.15::DOUBLE}}, {{'kpi': 'model_recall', 'value': tp / (tp + fn), 'weight': 0.15::DOUBLE}},
    {{'kpi': 'churn_prevention_value', 'value': tp * 1200, 'weight': 0.25::DOUBLE}}, {{'kpi': 'false_positive_cost', 'value': fp * 50, 'weight': 0.1::DOUBLE}}, {{'kpi': 'missed_churn_cost', 'value': fn * 150, 'weight': 0.15::DOUBLE}}], recursive := true) FROM ({CONF})"""
FAIR = "SELECT grp, avg(CASE WHEN yhat = 1 THEN 1.0 ELSE 0 END) AS positive_rate, avg(CASE WHEN yhat = 1 THEN 1.0 ELSE 0 END) FILTER (y = 1) AS tpr, avg(CASE WHEN yhat = 1 THEN 1.0 ELSE 0 END) FILTER (y = 0) AS fpr, abs(avg(p) - avg(y)) AS calibration_gap FROM pred_binary GROUP BY 1"
ASPECTS = f"SELECT model, unnest([{{'aspect': 'performance', 'value': test_accuracy::DOUBLE}}, {{'aspect': 'stability', 'value': (1 - mae)::DOUBLE}}, {{'aspect': 'interpretability', 'value': 0.5::DOUBLE}}, {{'aspect': 'efficiency', 'value': 0.9::DOUBLE}}], recursive := true) FROM ({SCORES})"
ABSR = lambda t: " UNION ALL ".join(f"SELECT '{f}' AS feature, abs(corr({f}, CAST({t} AS DOUBLE))) AS score FROM lineitem" for f in FEATS)
PROF = "prof AS (SELECT event_type AS category, avg(value) AS rm, stddev_samp(value) AS rs, count(*) * 1.0 / (SELECT count(*) FROM events_ref) AS sh FROM events_ref GROUP BY 1)"

SQL = {
    "ev_regression": PR(r(f"""SELECT 1 - avg(power({E_}, 2)) / var_pop(y) AS r2, sqrt(avg(power({E_}, 2))) AS rmse, avg(abs({E_})) AS mae, avg(power({E_}, 2)) AS mse, 100 * avg(abs(({E_}) / y)) FILTER (y <> 0) AS mape,
        1 - var_pop({E_}) / var_pop(y) AS explained_variance, max(abs({E_})) AS max_error, quantile_cont(abs({E_}), 0.5) AS median_abs_error, avg({E_}) AS residual_mean, stddev_pop({E_}) AS residual_std FROM pred_reg""",
        "r2 rmse mae mse mape explained_variance max_error median_abs_error residual_mean residual_std", 4)),
    "ev_msle": PR(r("SELECT avg(power(ln(1 + y) - ln(1 + yhat), 2)) AS msle FROM pred_reg", "msle")),
    "ev_confusion": PB("SELECT y, yhat, count(*) AS n FROM pred_binary GROUP BY 1, 2"),
    "ev_binary": PB(r(f"""SELECT CAST(tp AS BIGINT) AS tp, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, (tp + tn) / (tp + tn + fp + fn) AS accuracy, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy, (fp + fn) / (tp + tn + fp + fn) AS error_rate,
        tp / (tp + fp) AS "precision", tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, tn / (tn + fp) AS specificity, tn / (tn + fn) AS npv FROM ({CONF})""", 'accuracy balanced_accuracy error_rate "precision" recall f1 specificity npv')),
    "ev_multiclass": PM(r(f"WITH {MC} SELECT sum(h) * 1.0 / sum(s) AS accuracy, " + ", ".join(f"avg({e}) AS {m}_macro, sum({e} * s) / sum(s) AS {m}_weighted" for m, e in {
        "precision": "h * 1.0 / nullif(p, 0)", "recall": "h * 1.0 / nullif(s, 0)", "f1": "2.0 * h / (s + p)"}.items()) + " FROM per", "accuracy precision_macro precision_weighted recall_macro recall_weighted f1_macro f1_weighted")),
    "ev_mcc": PM(r(f"WITH {MC} SELECT (c * n - sp) / sqrt((n * n - pp) * (n * n - ss)) AS mcc FROM (SELECT CAST(sum(s) AS DOUBLE) AS n, CAST(sum(h) AS DOUBLE) AS c, CAST(sum(s * p) AS DOUBLE) AS sp, CAST(sum(s * s) AS DOUBLE) AS ss, CAST(sum(p * p) AS DOUBLE) AS pp FROM per)", "mcc")),
    "ev_kappa": PM(r(f"WITH {MC} SELECT (c / n - sp / (n * n)) / (1 - sp / (n * n)) AS kappa FROM (SELECT CAST(sum(s) AS DOUBLE) AS n, CAST(sum(h) AS DOUBLE) AS c, CAST(sum(s * p) AS DOUBLE) AS sp FROM per)", "kappa")),
    "ev_roc_auc": PB(r(f"SELECT {_auc('y = 1', 'p', 'pred_binary')} AS roc_auc", "roc_auc")),
    "ev_roc_auc_ovr": PM(r(f"WITH pr AS ({PROBA_SQL}), o AS (" + " UNION ALL ".join(f"SELECT '{c}' AS cls, {_auc(chr(121) + ' = ' + chr(39) + c + chr(39), 'p_' + c, 'pr')} AS roc_auc" for c in "FOP") + ") SELECT * FROM o UNION ALL SELECT 'macro', avg(roc_auc) FROM o", "roc_auc")),
    "ev_roc_auc_ovo": PM(r(f"WITH pr AS ({PROBA_SQL}) " + " UNION ALL ".join(f"SELECT '{a}' AS cls, '{b}' AS versus, {_auc(f'y = {chr(39)}{a}{chr(39)}', 'p_' + a, f'(SELECT * FROM pr WHERE y IN ({chr(39)}{a}{chr(39)}, {chr(39)}{b}{chr(39)}))')} AS roc_auc" for a in "FOP" for b in "FOP" if a != b), "roc_auc")),
    "ev_pr_auc": PB(r("SELECT sum(pos * cp / (cp + cn)) / sum(pos) AS average_precision FROM (SELECT pos, sum(pos) OVER (ORDER BY p DESC) AS cp, sum(neg) OVER (ORDER BY p DESC) AS cn FROM (SELECT p, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS pos, CAST(count(*) FILTER (y = 0) AS DOUBLE) AS neg FROM pred_binary GROUP BY 1))", "average_precision")),
    "ev_log_loss": PB(r("SELECT -avg(CASE WHEN y = 1 THEN ln(q) ELSE ln(1 - q) END) AS log_loss FROM (SELECT y, least(greatest(p, 1e-15), 1 - 1e-15) AS q FROM pred_binary)", "log_loss")),
    "ev_margin_to_prob": PB(r(f"SELECT {', '.join(LI_KEY)}, 1 / (1 + exp(-(p * 4 - 2))) AS prob FROM pred_binary", "prob")),
    "ev_train_scores": PB(r("""WITH sp AS (SELECT *, CASE WHEN l_linenumber <= 4 THEN 'train' WHEN l_linenumber <= 5 THEN 'val' ELSE 'test' END AS split FROM pred_binary)
        SELECT split, any_value(acc) AS accuracy, sum(2.0 * h / (s + p) * s) / sum(s) AS f1_weighted FROM (SELECT split, c, count(*) FILTER (y = c) AS s, count(*) FILTER (yhat = c) AS p, count(*) FILTER (y = c AND yhat = c) AS h, avg(CASE WHEN y = yhat THEN 1.0 ELSE 0 END) AS acc FROM sp, (VALUES (0), (1)) v(c) GROUP BY 1, 2) GROUP BY 1""", "accuracy f1_weighted")),
    "ev_train_scores_reg": PR(r("""SELECT CASE WHEN l_linenumber <= 4 THEN 'train' WHEN l_linenumber <= 5 THEN 'val' ELSE 'test' END AS split, sqrt(avg(power(y - yhat, 2))) AS rmse, avg(abs(y - yhat)) AS mae, 1 - avg(power(y - yhat, 2)) / var_pop(y) AS r2 FROM pred_reg GROUP BY 1""", "rmse mae r2", 4)),
    "res_stats": PR(r("SELECT avg(e) AS mean, stddev_pop(e) AS std, avg(power(e - m, 3)) / power(avg(power(e - m, 2)), 1.5) AS skewness, avg(power(e - m, 4)) / power(avg(power(e - m, 2)), 2) - 3 AS kurtosis FROM (SELECT y - yhat AS e, avg(y - yhat) OVER () AS m FROM pred_reg)", "mean std skewness kurtosis", 4)),
    "res_hetero": PR(r("SELECT corr(abs(y - yhat), yhat) AS r, count(*) AS n FROM pred_reg", "r")),
    "res_autocorr": PR(r(f"SELECT sum(power(e - b, 2)) / sum(e * e) AS durbin_watson, count(*) AS n FROM (SELECT y - yhat AS e, lag(y - yhat) OVER (ORDER BY {', '.join(LI_KEY)}, y, yhat) AS b FROM pred_reg)", "durbin_watson")),
    "res_outliers": PR(r("SELECT count(*) FILTER (z) AS z_outliers, count(*) FILTER (i) AS iqr_outliers, avg(CASE WHEN z OR i THEN 1.0 ELSE 0 END) AS outlier_share FROM (SELECT abs(y - yhat - m) / s > 2 AS z, y - yhat < a - 1.5 * (b - a) OR y - yhat > b + 1.5 * (b - a) AS i FROM pred_reg, (SELECT avg(y - yhat) AS m, stddev_pop(y - yhat) AS s, quantile_cont(y - yhat, 0.25) AS a, quantile_cont(y - yhat, 0.75) AS b FROM pred_reg))", "outlier_share")),
    "res_quantiles": PR(r("SELECT CAST(p AS DOUBLE) AS prob, CAST(v AS DOUBLE) AS abs_error FROM (SELECT unnest([0.5, 0.75, 0.9, 0.95, 0.99]) AS p, unnest(quantile_cont(abs(y - yhat), [0.5, 0.75, 0.9, 0.95, 0.99])) AS v FROM pred_reg)", "abs_error", 4)),
    "feat_corr_pairs": r("SELECT count(*) FILTER (r > 0.7) AS n_high, max(r) AS max_r, avg(r) AS mean_r FROM (" + " UNION ALL ".join(f"SELECT abs(corr({a}, {b})) AS r FROM lineitem" for i, a in enumerate(FEATS) for b in FEATS[i + 1:]) + ")", "max_r mean_r"),
    "rank_agreement": r(f"SELECT count(*) FILTER (ra <= 2 AND rb <= 2) / 2.0 AS top_overlap, corr(ra, rb) AS spearman FROM (SELECT a.feature, rank() OVER (ORDER BY a.score DESC) AS ra, rank() OVER (ORDER BY b.score DESC) AS rb FROM ({ABSR('l_partkey')}) a JOIN ({ABSR('l_suppkey')}) b USING (feature))", "top_overlap spearman"),
    "interp_score": r("SELECT max(i) / sum(i) AS concentration, count(*) FILTER (i > 0.01) AS important, least((1 - least(max(i) / sum(i), 1)) * 0.4 + least(10.0 / greatest(count(*) FILTER (i > 0.01), 1), 1) * 0.2, 1.0) AS score FROM (" + " UNION ALL ".join(f"SELECT abs(corr(l_quantity, {f})) AS i FROM lineitem" for f in FEATS[1:]) + ")", "concentration score"),
    "stab_overall": PB(r(f"SELECT model, test_accuracy * 0.3 + (1 - mae) * 0.3 + test_accuracy * 0.25 + 0.15 AS stability FROM ({SCORES})", "stability")),
    "eval_compare": PB(r(f"SELECT model, test_accuracy AS performance, 1 - mae AS stability, 0.5 AS interpretability FROM ({SCORES})", "performance stability")),
    "model_total_score": PB(r(f"SELECT model, 0.4 * test_accuracy + 0.35 * (1 - mae) + 0.15 * 0.5 + 0.1 * 0.9 AS total FROM ({SCORES})", "total")),
    "ml_rank": PB(r(f"SELECT * FROM (SELECT *, row_number() OVER (ORDER BY test_accuracy DESC, model) AS rank FROM ({SCORES})) WHERE rank <= 2", "test_accuracy mae")),
    "ml_vote": PB(f"SELECT {', '.join(LI_KEY)}, CASE WHEN sum(yhat) * 2 > count(*) THEN 1 ELSE 0 END AS yhat FROM ({MODELS}) GROUP BY {', '.join(LI_KEY)}"),
    "ml_vote_soft": PB(r(f"SELECT {', '.join(LI_KEY)}, avg(p) AS p, CASE WHEN avg(p) >= 0.5 THEN 1 ELSE 0 END AS yhat FROM ({MODELS}) GROUP BY {', '.join(LI_KEY)}", "p")),
    "ml_compare_runs": PB(r(f"SELECT model AS run, 0.9 AS efficiency, 0.5 AS interpretability, test_accuracy AS performance, 1 - mae AS stability, 100 * (test_accuracy - b) / abs(b) AS gain_pct FROM ({SCORES}), (SELECT test_accuracy AS b FROM ({SCORES}) WHERE model = 'm50')", "performance stability gain_pct")),
    "drift_numeric": EVS(r(f"SELECT *, mean_drift > 0.5 OR std_drift > 0.5 AS drifted FROM ({NUMD})", "mean_drift std_drift")),
    "drift_categorical": EVS(r(f"WITH {SH} SELECT 'event_type' AS column_name, score AS distribution_drift, score > 0.3 AS drifted FROM ({CATD})", "distribution_drift")),
    "drift_table": EVS(r(f"WITH {SH}, t AS ({TABLE_}) SELECT * FROM t UNION ALL SELECT '__any__', 'dataset', avg(CASE WHEN drifted THEN 1.0 ELSE 0 END), bool_or(drifted) FROM t", "score")),
    "drift_ks": EVS(r(KS, "ks root_n")), "drift_psi": EVS(r(PSI, "psi")),
    "drift_categorical_distance": EVS(r(f"WITH {SH} {JS}", "chi2 js_distance")),
    "drift_distribution": EVS(r(f"WITH {SH} SELECT *, distance > 0.2 AS drifted FROM (SELECT column_name, 'ks' AS measure, ks AS distance FROM ({KS}) UNION ALL SELECT column_name, 'psi', psi FROM ({PSI}) UNION ALL SELECT column_name, 'js', js_distance FROM ({JS}))", "distance")),
    "drift_missing": EVS(r(f"SELECT *, cur_missing - ref_missing AS increase, cur_missing - ref_missing > 0.1 AS drifted FROM ({MISS})", "ref_missing cur_missing increase")),
    "drift_alert": EVS(f"WITH {SH} {ALERTS}"),
    "drift_summary": EVS(f"WITH {SH} SELECT (SELECT count(*) FROM events_ref) AS n_ref, (SELECT count(*) FROM events_cur) AS n_cur, count(*) FILTER (level = 'INFO') AS info, count(*) FILTER (level = 'WARNING') AS warning, count(*) FILTER (level = 'CRITICAL') AS critical, 3 AS shared_columns FROM ({ALERTS})"),
    "kpi_value": PB(r(KPI, "value")),
    "kpi_status": PB(r(f"""SELECT *, CASE kpi WHEN 'model_accuracy' THEN CASE WHEN value >= 0.85 THEN 'on_target' WHEN value >= 0.8 THEN 'near_target' WHEN value >= 0.75 THEN 'warning' ELSE 'critical' END
        WHEN 'model_precision' THEN CASE WHEN value >= 0.8 THEN 'on_target' WHEN value >= 0.75 THEN 'near_target' WHEN value >= 0.7 THEN 'warning' ELSE 'critical' END
        WHEN 'model_recall' THEN CASE WHEN value >= 0.75 THEN 'on_target' WHEN value >= 0.7 THEN 'near_target' WHEN value >= 0.65 THEN 'warning' ELSE 'critical' END
        WHEN 'churn_prevention_value' THEN CASE WHEN value >= 120000 THEN 'on_target' ELSE 'below_target' END ELSE 'no_target' END AS status FROM ({KPI})""", "value")),
    "kpi_roi": PB(r(f"""SELECT month, benefit, net, discounted, sum(discounted) OVER (ORDER BY month) - 90000 AS npv FROM (SELECT month, benefit, benefit - 4000 AS net, (benefit - 4000) / power(power(1.1, 1.0 / 12), month) AS discounted
        FROM (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS month, (tp * 1350 + (tp + tn + fp + fn) * 2) / 12 AS benefit FROM ({CONF})))""", "benefit net discounted npv", 2)),
    "kpi_profit": PB(r(f"SELECT tp * 100 - fp * 20 - fn * 500 AS profit, tp / (tp + fp + fn) AS efficiency, (tp * 100 - fp * 20 - fn * 500) / (fp * 20 + fn * 500 + 1) AS cost_benefit FROM ({CONF})", "profit efficiency cost_benefit")),
    "kpi_correlation": PB(r(f"SELECT corr(a, g) AS r, count(*) AS n_models FROM (SELECT model, avg(CASE WHEN y = yhat THEN 1.0 ELSE 0 END) AS a, CAST(sum(CASE WHEN y = 1 AND yhat = 1 THEN 100 WHEN y = 0 AND yhat = 1 THEN -20 WHEN y = 1 AND yhat = 0 THEN -500 ELSE 0 END) AS DOUBLE) AS g FROM ({MODELS}) GROUP BY 1)", "r")),
    "fairness": PB(r(f"WITH f AS ({FAIR}) SELECT * FROM f UNION ALL SELECT '__spread__', max(positive_rate) - min(positive_rate), max(tpr) - min(tpr), max(fpr) - min(fpr), max(calibration_gap) - min(calibration_gap) FROM f", "positive_rate tpr fpr calibration_gap")),
    "rule_ranges": f"WITH t AS ({NAMED}) " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} < {lo}) AS below, count(*) FILTER ({c} > {hi}) AS above, '{a}' AS action FROM t" for c, (lo, hi, a) in K.RANGES.items()),
    "rule_ranges_enforced": r(f"SELECT CASE WHEN age < 0 THEN 0 WHEN age > 120 THEN 120 ELSE age END AS age, income, CASE WHEN credit_score < 300 THEN 300 WHEN credit_score > 850 THEN 850 ELSE credit_score END AS credit_score, balance, {', '.join(LI_KEY)}, income < 0 OR income > 10000000 OR balance < -1000000 OR balance > 10000000 AS needs_review FROM ({NAMED})", "age income credit_score balance", 3),
    "rule_triggers": with_views("orders_dirty", "WITH od AS (SELECT * REPLACE (o_totalprice / 1e6 AS o_totalprice, o_custkey / 1e3 AS o_custkey) FROM orders_dirty) " + r(" UNION ALL ".join(f"""SELECT '{c}' AS subject, unnest([{{'trigger': 'missing', 'value': m, 'review': m > 0.25}}, {{'trigger': 'outliers', 'value': o, 'review': o > 0.05}}, {{'trigger': 'zero_variance', 'value': v, 'review': v = 0}}], recursive := true) FROM (
        SELECT CAST(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END) AS DOUBLE) AS m, count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) * 1.0::DOUBLE / count({c}) AS o, var_samp({c}) AS v FROM od, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS a, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS b FROM od))""" for c in ("o_totalprice", "o_custkey"))
        + " UNION ALL SELECT '__dataset__', 'duplicates', 0.0, false", "value")),
    "quality_gate": with_views("orders_dirty", r("""SELECT 'row_retention' AS gate, count(o_totalprice) * 1.0 / count(*) AS value, count(o_totalprice) * 1.0 / count(*) >= 0.5 AS passed FROM orders_dirty UNION ALL SELECT 'missing_after', 0.0, true UNION ALL SELECT 'target_present', 1.0, true""", "value")),
    "stream_drift": EVS(r(f"WITH {PROF} SELECT window_start, c.category, n, mean, std, abs(mean - rm) / (rs + 1e-8) AS mean_drift, {LEVEL('abs(mean - rm) / (rs + 1e-8)', .5)} AS level FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type AS category, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std FROM events_cur GROUP BY 1, 2) c LEFT JOIN prof ON prof.category = c.category", "mean std mean_drift")),
    "stream_shares": EVS(r(f"WITH {PROF} SELECT window_start, n, 1 - o AS distribution_drift, {LEVEL('1 - o', .3)} AS level FROM (SELECT window_start, any_value(t) AS n, sum(least(k * 1.0 / t, sh)) AS o FROM (SELECT w.window_start, w.t, p.sh, (SELECT count(*) FROM events_cur e WHERE time_bucket(INTERVAL 1 DAY, e.ts) = w.window_start AND e.event_type = p.category) AS k FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS t FROM events_cur GROUP BY 1) w, prof p) GROUP BY 1)", "distribution_drift")),
    "stream_quality": with_views("events_gaps", r("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n, count(*) - count(value) AS nulls, count(*) FILTER (value < 1 OR value > 50) AS out_of_range, count(*) FILTER (event_type NOT IN ('click', 'view', 'purchase')) AS bad_category, count(value) * 1.0 / count(*) AS completeness FROM events_gaps GROUP BY 1", "completeness")),
    "stream_drift_run": EVS(r(f"WITH {PROF} SELECT window_start, c.category, n, mean, std, abs(mean - rm) / (rs + 1e-8) AS mean_drift, {LEVEL('abs(mean - rm) / (rs + 1e-8)', .5)} AS level FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type AS category, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std FROM events GROUP BY 1, 2) c LEFT JOIN prof ON prof.category = c.category", "mean std mean_drift")),
    "stream_quality_run": r("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n, count(*) - count(value) AS nulls, count(*) FILTER (value < 1 OR value > 50) AS out_of_range, count(*) FILTER (event_type NOT IN ('click', 'view', 'purchase')) AS bad_category, count(value) * 1.0 / count(*) AS completeness FROM events GROUP BY 1", "completeness"),
}
