"""Registered queries: the six quality dimensions, issues and scores, on the malformed customer view."""

from __future__ import annotations

from assayer.catalog.fixtures import load, per_column, r, rounded, settled_view, view, with_views
from assayer.catalog.inference import FOUND, INFER
from assayer.catalog.profiling import CT_ALL, CT_TXT
from assayer.operators import quality as Q
from assayer.session import cut

AS_OF = "2025-06-01"
BANDS = {"completeness": (.95, .85, .70, .50), "consistency": (.98, .90, .75, .60), "accuracy": (.95, .85, .70, .55),
         "validity": (.98, .90, .80, .65), "uniqueness": (.99, .95, .85, .70), "timeliness": (.95, .85, .70, .50)}
WEIGHTS = {"completeness": .25, "consistency": .20, "accuracy": .20, "validity": .15, "uniqueness": .10, "timeliness": .10}

COMPLETE = per_column(CT_ALL, """SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS missing, count({c}) * 1.0 / count(*) AS completeness,
    CASE WHEN (count(*) - count({c})) * 1.0 / count(*) > 0.5 THEN 'high' WHEN (count(*) - count({c})) * 1.0 / count(*) > 0.2 THEN 'medium' END AS severity FROM customer_text""")
TEXTS = "SELECT column_name, cs AS case_score, bs AS blank_score, (cs + bs) / 2 AS score FROM (SELECT column_name, CASE WHEN least(up, low) > 0.1 * n THEN 1 - least(up, low) * 1.0 / n ELSE 1.0 END AS cs, CASE WHEN lead + trail > 0.05 * n THEN 1 - (lead + trail) * 1.0 / n ELSE 1.0 END AS bs FROM (" + per_column(
    CT_TXT, """SELECT '{c}' AS column_name, count({c}) AS n, count(*) FILTER (regexp_matches({c}, '[A-Z]')) AS up, count(*) FILTER (regexp_matches({c}, '[a-z]')) AS low,
    count(*) FILTER (starts_with({c}, ' ')) AS lead, count(*) FILTER (ends_with({c}, ' ')) AS trail FROM customer_text""") + "))"
NUMS = per_column("balance balance_number zip", """SELECT '{c}' AS column_name, count({c}) AS n, count(*) FILTER (regexp_matches({c}, '[^0-9.\\-+eE]')) AS odd,
    1 - count(*) FILTER (regexp_matches({c}, '[^0-9.\\-+eE]')) * 1.0 / count({c}) AS score FROM customer_text""")
CONS = f"SELECT column_name, score FROM ({TEXTS}) UNION ALL SELECT 'c_custkey', 1.0"


def _acc(c: str) -> str:
    if "email" in c:
        return "email", f"regexp_matches({c}, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}$')"
    if "phone" in c:
        return "phone", f"regexp_matches(trim({c}), '^[\\+]?[1-9]?[0-9\\s\\-\\(\\)]{{7,15}}$')"
    if "date" in c or "time" in c:
        return "date", f"try_strptime(trim({c}), ['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%m/%d/%Y', '%m-%d-%Y', '%Y/%m/%d']) IS NOT NULL"
    return "generic", f"{c} NOT IN ('', 'nan', 'null', 'None')" if c != "c_custkey" else f"{c} IS NOT NULL"


ACC = "SELECT *, CASE WHEN rule = 'generic' AND score < 0.95 THEN 'low' WHEN rule <> 'generic' AND score < 0.9 THEN 'medium' END AS severity FROM (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, '{_acc(c)[0]}' AS rule, count({c}) AS n, count(*) FILTER ({_acc(c)[1]}) AS valid, count(*) FILTER ({_acc(c)[1]}) * 1.0 / count({c}) AS score FROM customer_text"
    for c in CT_ALL.split()) + ")"
# li_named renames measures so that the name rules (count, percent) apply
NAMED = "SELECT l_discount - 0.02 AS discount, l_tax * 2000 AS tax_percent, l_quantity - 3 AS amount, l_returnflag AS flag FROM lineitem"
VALID = """SELECT column_name, n, negative, off_percent, greatest(0.0, 1 - (negative + off_percent) * 1.0 / n) AS score, CASE WHEN off_percent > 0 THEN 'high' WHEN negative > 0 THEN 'medium' END AS severity FROM (
    SELECT 'discount' AS column_name, count(*) AS n, count(*) FILTER (discount < 0) AS negative, CAST(0 AS BIGINT) AS off_percent FROM li_named
    UNION ALL SELECT 'tax_percent', count(*), 0, count(*) FILTER (tax_percent < 0 OR tax_percent > 100) FROM li_named
    UNION ALL SELECT 'amount', count(*), count(*) FILTER (amount < 0), 0 FROM li_named UNION ALL SELECT 'flag', count(*), 0, 0 FROM li_named)"""
UNIQ = per_column(CT_ALL, "SELECT '{c}' AS column_name, count({c}) AS n, count(DISTINCT {c}) AS unique_count, count(DISTINCT {c}) * 1.0 / count({c}) AS unique_ratio, CASE WHEN count(DISTINCT {c}) * 1.0 / count({c}) > 0.95 THEN 'info' END AS severity FROM customer_text")
STRP = "try_strptime(trim(signup_date), ['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%m/%d/%Y', '%m-%d-%Y', '%Y/%m/%d'])"


def _age(col: str, name: str, src: str) -> str:
    return f"""SELECT column_name, newest, days_old, CASE WHEN days_old <= 1 THEN 1.0 WHEN days_old <= 7 THEN 0.9 WHEN days_old <= 30 THEN 0.8 WHEN days_old <= 90 THEN 0.6 ELSE 0.4 END AS score,
        CASE WHEN days_old >= 90 THEN 'high' WHEN days_old > 30 THEN 'medium' END AS severity FROM (
        SELECT '{name}' AS column_name, max({col}) AS newest, CAST(datediff('day', CAST(max({col}) AS DATE), DATE '{AS_OF}') AS INTEGER) AS days_old, count({col}) AS k, count(*) AS n FROM {src}) WHERE k > 0.8 * n"""


TIME = _age(STRP, "signup_date", "customer_text")


def _band(expr: str, dim: str) -> str:
    a, b, c, d = BANDS[dim]
    return f"CASE WHEN {expr} >= {a} THEN 100.0 WHEN {expr} >= {b} THEN 80.0 WHEN {expr} >= {c} THEN 60.0 WHEN {expr} >= {d} THEN 40.0 ELSE 20.0 END"


GRADE = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END"
RATIOS = {
    "completeness": f"SELECT 1 - sum(missing) * 1.0 / sum(n_rows) FROM ({COMPLETE})",
    "consistency": f"SELECT avg(score) FROM ({CONS})", "accuracy": f"SELECT avg(score) FROM ({ACC})",
    "validity": "SELECT 1.0", "uniqueness": "SELECT (SELECT count(*) FROM (SELECT DISTINCT * FROM customer_text)) * 1.0 / count(*) FROM customer_text",
    "timeliness": f"SELECT avg(score) FROM ({TIME})"}
DIMS = "SELECT *, " + GRADE + " AS grade FROM (" + "\nUNION ALL\n".join(
    f"SELECT '{d}' AS dimension, CAST(({q}) AS DOUBLE) AS ratio, {_band(f'({q})', d)} AS score, {WEIGHTS[d]} AS weight" for d, q in RATIOS.items()) + ")"
OVERALL = f"SELECT sum(score * weight) / sum(weight) AS score FROM ({DIMS})"
T_ISSUES = f"""SELECT CASE WHEN confidence < 0.4 THEN 'medium' ELSE 'low' END AS severity, column_name, 'low_confidence_type_inference' AS issue_type FROM ({INFER}) WHERE confidence < 0.6
    UNION ALL SELECT CASE WHEN confidence > 0.8 THEN 'low' ELSE 'info' END, column_name, 'type_mismatch' FROM ({INFER})
        WHERE confidence > 0.7 AND inferred_type <> CASE WHEN original_type IN ('integer', 'float') THEN 'numeric' ELSE original_type END"""
P_ISSUES = f"""SELECT CASE WHEN confidence > 0.8 THEN 'high' ELSE 'medium' END AS severity, column_name, 'anomaly_' || pattern_name AS issue_type FROM ({FOUND}) WHERE pattern_type = 'anomaly'
    UNION ALL SELECT 'info', column_name, 'potential_identifier' FROM ({FOUND}) WHERE pattern_name = 'unique_identifier'"""
M_ISSUES = f"""SELECT CASE WHEN score < 40 THEN 'high' ELSE 'medium' END AS severity, '__dataset__' AS column_name, 'poor_' || dimension || '_quality' AS issue_type FROM ({DIMS}) WHERE score < 60
    UNION ALL SELECT severity, column_name, CASE severity WHEN 'high' THEN 'high_missing_data' ELSE 'moderate_missing_data' END FROM ({COMPLETE}) WHERE severity IS NOT NULL
    UNION ALL SELECT severity, column_name, CASE rule WHEN 'generic' THEN 'suspicious_values' ELSE 'invalid_' || rule || '_format' END FROM ({ACC}) WHERE severity IS NOT NULL
    UNION ALL SELECT severity, column_name, 'potential_identifier' FROM ({UNIQ}) WHERE severity IS NOT NULL
    UNION ALL SELECT severity, column_name, 'stale_data' FROM ({TIME}) WHERE severity IS NOT NULL
    UNION ALL SELECT 'low', column_name, 'case_inconsistency' FROM ({TEXTS}) WHERE case_score < 1
    UNION ALL SELECT 'low', column_name, 'whitespace_inconsistency' FROM ({TEXTS}) WHERE blank_score < 1"""
X_ISSUES = f"SELECT 'medium' AS severity, i.column_name, 'type_pattern_conflict' AS issue_type FROM ({INFER}) i WHERE i.inferred_type = 'numeric' AND i.column_name IN (SELECT column_name FROM ({FOUND}) WHERE pattern_name IN ('email', 'phone'))"
ISSUES = "\nUNION ALL\n".join(f"SELECT * FROM ({q})" for q in (T_ISSUES, P_ISSUES, M_ISSUES, X_ISSUES))
COST = "CASE severity WHEN 'high' THEN 10.0 WHEN 'medium' THEN 5.0 WHEN 'low' THEN 2.0 ELSE 0.0 END"
SCORES = f"""SELECT '__overall__' AS column_name, greatest(0.0, (SELECT score FROM ({OVERALL})) - coalesce(sum(CASE WHEN issue_type = 'type_mismatch' THEN CASE severity WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.5 ELSE 0.0 END ELSE {COST} END), 0)) AS score FROM ({ISSUES})
    UNION ALL SELECT n.c, greatest(0.0, 100 - coalesce((SELECT sum({COST}) FROM ({ISSUES}) i WHERE i.column_name = n.c), 0)) FROM (SELECT unnest([{', '.join(f"'{c}'" for c in CT_ALL.split())}]) AS c) n"""


def _ct(s, d):
    return view(s, d, "customer_text")


def _named(s, d):
    return load(s, d, "lineitem").selectExpr("l_discount - 0.02D AS discount", "l_tax * 2000 AS tax_percent", "l_quantity - 3 AS amount", "l_returnflag AS flag")


_memo: dict[tuple, dict] = {}


def _assessed(s, d):
    """The four result tables of one assessment; several registered queries show parts of it."""
    key = (s.sparkContext.applicationId, d)
    if key not in _memo:
        _memo[key] = Q.assess(settled_view(s, d, "customer_text"), AS_OF)
    return _memo[key]


def _advice(s, d):
    from pyspark.sql import functions as F

    a = _assessed(s, d)
    counts = a["issues"].agg(F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("severity") == "medium").alias("medium"))
    return a["scores"].where("column_name = '__overall__'").crossJoin(F.broadcast(counts)).select(
        "high", "medium", Q.advice(F.col("score"), F.col("high"), F.col("medium")).alias("advice"))


def _report(s, d):
    from pyspark.sql import functions as F

    dims = cut(Q.dimensions(_ct(s, d), AS_OF))
    issues = Q.issues_from_metrics(_ct(s, d), dims, AS_OF)
    return (dims.select(F.lit("dimension").alias("section"), F.col("dimension").alias("item"), F.col("score").alias("value"))
            .unionByName(issues.groupBy("severity").agg(F.count(F.lit(1)).cast("double").alias("value"))
                         .select(F.lit("issues").alias("section"), F.col("severity").alias("item"), "value")))


QUERIES = {
    "dq_completeness": lambda s, d: rounded(Q.completeness(_ct(s, d))),
    "dq_consistency_text": lambda s, d: rounded(Q.consistency_text(_ct(s, d))),
    "dq_consistency_num": lambda s, d: rounded(Q.consistency_numeric(_ct(s, d), ["balance", "balance_number", "zip"])),
    "dq_consistency": lambda s, d: rounded(Q.consistency(_ct(s, d))),
    "dq_accuracy": lambda s, d: rounded(Q.accuracy(_ct(s, d))),
    "dq_accuracy_email": lambda s, d: rounded(Q.accuracy(_ct(s, d), ["email"])),
    "dq_accuracy_phone": lambda s, d: rounded(Q.accuracy(_ct(s, d), ["phone"])),
    "dq_accuracy_date": lambda s, d: rounded(Q.accuracy(_ct(s, d), ["signup_date"])),
    "dq_accuracy_generic": lambda s, d: rounded(Q.accuracy(_ct(s, d)).where("rule = 'generic'")),
    "dq_validity": lambda s, d: rounded(Q.validity(_named(s, d))),
    "dq_target_validity": lambda s, d: rounded(Q.target_validity(load(s, d, "labels"), "toxic")),
    "dq_validity_total": lambda s, d: rounded(Q.validity(_named(s, d)).selectExpr("avg(score) AS ratio").select("ratio", Q.banded(Q.F.col("ratio"), "validity").alias("score"))),
    "dq_uniqueness": lambda s, d: rounded(Q.uniqueness(_ct(s, d))),
    "dq_timeliness": lambda s, d: rounded(Q.timeliness(load(s, d, "orders"), AS_OF).unionByName(Q.timeliness(_ct(s, d), AS_OF))),
    "dq_banding": lambda s, d: rounded(Q.dimensions(_ct(s, d), AS_OF).select("dimension", "ratio", "score")),
    "dq_overall": lambda s, d: rounded(Q.overall(Q.dimensions(_ct(s, d), AS_OF))),
    "dq_confidence": lambda s, d: rounded(Q.confidence(load(s, d, "supplier"))),
    "dq_grade": lambda s, d: Q.dimensions(_ct(s, d), AS_OF).select("dimension", "grade"),
    "dq_report": lambda s, d: rounded(_report(s, d)),
    "dq_assess": lambda s, d: _assessed(s, d)["issues"],
    "dq_issues_type": lambda s, d: Q.issues_from_types(_assessed(s, d)["inference"]),
    "dq_issues_pattern": lambda s, d: Q.issues_from_patterns(_assessed(s, d)["patterns"]),
    "dq_issues_metric": lambda s, d: Q.issues_from_metrics(settled_view(s, d, "customer_text"), _assessed(s, d)["dimensions"], AS_OF),
    "dq_cross_check": lambda s, d: Q.cross_check(_assessed(s, d)["inference"], _assessed(s, d)["patterns"]),
    "dq_score_penalty": lambda s, d: rounded(_assessed(s, d)["scores"]),
    "dq_final_reco": _advice,
    "dq_basic": lambda s, d: rounded(Q.basic_assessment(_ct(s, d))),
    "validate_frame": lambda s, d: Q.validate(view(s, d, "const_cols")),
}

_sql = lambda q: with_views("customer_text", q)
SQL = {
    "dq_completeness": _sql(r(COMPLETE, "completeness")),
    "dq_consistency_text": _sql(r(TEXTS, "case_score blank_score score")),
    "dq_consistency_num": _sql(r(NUMS, "score")),
    "dq_consistency": _sql(r(CONS, "score")),
    "dq_accuracy": _sql(r(ACC, "score")),
    "dq_accuracy_email": _sql(r(f"SELECT * FROM ({ACC}) WHERE rule = 'email'", "score")),
    "dq_accuracy_phone": _sql(r(f"SELECT * FROM ({ACC}) WHERE rule = 'phone'", "score")),
    "dq_accuracy_date": _sql(r(f"SELECT * FROM ({ACC}) WHERE rule = 'date'", "score")),
    "dq_accuracy_generic": _sql(r(f"SELECT * FROM ({ACC}) WHERE rule = 'generic'", "score")),
    "dq_validity": f"WITH li_named AS ({NAMED}) " + r(VALID, "score"),
    "dq_target_validity": r("SELECT 'toxic' AS column_name, count(*) AS classes, min(n) * 1.0 / sum(n) AS minority_ratio, CASE WHEN count(*) = 2 AND min(n) * 1.0 / sum(n) < 0.01 THEN 0.7 ELSE 1.0 END AS score FROM (SELECT toxic, count(*) AS n FROM labels GROUP BY 1)", "minority_ratio score"),
    "dq_validity_total": f"WITH li_named AS ({NAMED}) " + r(f"SELECT ratio, {_band('ratio', 'validity')} AS score FROM (SELECT avg(score) AS ratio FROM ({VALID}))", "ratio"),
    "dq_uniqueness": _sql(r(UNIQ, "unique_ratio")),
    "dq_timeliness": _sql(f"{_age('o_orderdate', 'o_orderdate', 'orders')} UNION ALL SELECT * FROM ({TIME})"),
    "dq_banding": _sql(r(f"SELECT dimension, ratio, score FROM ({DIMS})", "ratio")),
    "dq_overall": _sql(r(f"SELECT score AS overall_score, {GRADE} AS grade FROM ({OVERALL})", "overall_score")),
    "dq_confidence": "SELECT count(*) AS n_rows, 1.0 AS complete, (CASE WHEN count(*) < 100 THEN 0.6 WHEN count(*) < 1000 THEN 0.8 ELSE 1.0 END + 1.0) / 2 AS confidence FROM supplier",
    "dq_grade": _sql(f"SELECT dimension, grade FROM ({DIMS})"),
    "dq_report": _sql(f"SELECT 'dimension' AS section, dimension AS item, score AS value FROM ({DIMS}) UNION ALL SELECT 'issues', severity, count(*) FROM ({M_ISSUES}) GROUP BY 2"),
    "dq_assess": _sql(ISSUES),
    "dq_issues_type": _sql(T_ISSUES), "dq_issues_pattern": _sql(P_ISSUES), "dq_issues_metric": _sql(M_ISSUES), "dq_cross_check": _sql(X_ISSUES),
    "dq_score_penalty": _sql(SCORES),
    "dq_final_reco": _sql(f"""WITH iss AS MATERIALIZED ({ISSUES}), base AS MATERIALIZED ({OVERALL}) SELECT high, medium,
        concat_ws(',', CASE WHEN score < 40 THEN 'critical_remediation' WHEN score < 70 THEN 'fix_before_production' WHEN score < 85 THEN 'minor_issues' ELSE 'acceptable' END,
        CASE WHEN high > 0 THEN 'address_high_issues' END, CASE WHEN medium > 5 THEN 'consider_medium_issues' END) AS advice
        FROM (SELECT greatest(0.0, (SELECT score FROM base) - coalesce(sum(CASE WHEN issue_type = 'type_mismatch' THEN CASE severity WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.5 ELSE 0.0 END ELSE {COST} END), 0)) AS score,
            count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium FROM iss)"""),
    "dq_basic": _sql(r(f"""WITH i AS (SELECT CASE WHEN missing > 0.5 * n_rows THEN 'high' ELSE 'medium' END AS severity, column_name, 'missing_data' AS issue_type FROM ({COMPLETE}) WHERE missing > 0.1 * n_rows
        UNION ALL SELECT 'info', column_name, 'potential_identifier' FROM ({UNIQ}) WHERE unique_count > 0.95 * (SELECT count(*) FROM customer_text) AND column_name <> 'c_custkey')
        SELECT *, CAST(NULL AS DOUBLE) AS value FROM i UNION ALL SELECT NULL, '__dataset__', 'overall_score', greatest(0.0, 100 - coalesce((SELECT sum({COST}) FROM i), 0))
        UNION ALL SELECT NULL, '__dataset__', 'completeness', 100 * (1 - sum(missing) * 1.0 / sum(n_rows)) FROM ({COMPLETE})""", "value")),
    "validate_frame": with_views("const_cols", "SELECT * FROM (" + per_column("p_partkey p_brand p_size p_retailprice constant_text constant_number empty_text part_id",
        "SELECT CASE WHEN count({c}) = 0 THEN 'error' WHEN count(*) > 100 AND count(DISTINCT {c}) = count(*) THEN 'warning' END AS severity, '{c}' AS column_name, CASE WHEN count({c}) = 0 THEN 'all_null' ELSE 'identifier_like' END AS issue_type FROM const_cols") + ") WHERE severity IS NOT NULL"),
}
