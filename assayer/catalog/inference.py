"""Registered queries: semantic types and value patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.catalog.fixtures import load, per_column, r, rounded, settled_view, view, with_views
from assayer.catalog.profiling import CT_ALL, CT_TXT, LI_NUM
from assayer.operators import infer as I
from assayer.operators import patterns as PT
from assayer.session import cut

DATE_FORMS = ("\\d{4}-\\d{2}-\\d{2}", "\\d{2}/\\d{2}/\\d{4}", "\\d{2}-\\d{2}-\\d{4}", "\\d{4}/\\d{2}/\\d{2}")
NUMBER_FORMS = ("^[-+]?\\d*\\.?\\d+([eE][-+]?\\d+)?$", "^[-+]?\\d+$", "^[-+]?\\d*\\.\\d+$")
STRP = "['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%m/%d/%Y', '%m-%d-%Y', '%Y/%m/%d']"


def k2_sql(n: str, g1: str, g2: str) -> str:
    """D'Agostino-Pearson K2 as nested selects over columns n, g1 (skewness), g2 (excess kurtosis)."""
    return f"""(SELECT zs * zs + zk * zk FROM (SELECT
        CASE WHEN sd > 0 THEN asinh(y / sqrt(2 / (w2 - 1))) / sqrt(ln(w2) / 2) END AS zs,
        (1 - 2 / (9 * a) - sign(dn) * power((1 - 2 / a) / abs(dn), 1.0 / 3)) / sqrt(2 / (9 * a)) AS zk
        FROM (SELECT y, w2, sd, a, 1 + x * sqrt(2 / (a - 4)) AS dn FROM (
            SELECT y, w2, sd, x, 6 + 8 / q * (2 / q + sqrt(1 + 4 / (q * q))) AS a FROM (
                SELECT {g1} * sqrt((N + 1) * (N + 3) / (6 * (N - 2))) AS y, 1 AS sd,
                    sqrt(2 * (3 * (N * N + 27 * N - 70) * (N + 1) * (N + 3) / ((N - 2) * (N + 5) * (N + 7) * (N + 9)) - 1)) - 1 AS w2,
                    ({g2} + 3 - 3 * (N - 1) / (N + 1)) / sqrt(24 * N * (N - 2) * (N - 3) / ((N + 1) * (N + 1) * (N + 3) * (N + 5))) AS x,
                    6 * (N * N - 5 * N + 2) / ((N + 7) * (N + 9)) * sqrt(6 * (N + 3) * (N + 5) / (N * (N - 2) * (N - 3))) AS q
                FROM (SELECT CAST({n} AS DOUBLE) AS N))))))"""


def num_text(c: str, kind: str) -> str:
    if kind == "text":
        return f"CASE WHEN regexp_matches(trim({c}), '^[-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][-+]?[0-9]+)?$') THEN TRY_CAST(trim({c}) AS DOUBLE) END"
    return f"CAST({c} AS DOUBLE)"


def evidence_sql(cols: dict[str, str], table: str) -> str:
    parts = []
    for c, kind in cols.items():
        x = num_text(c, kind) if kind in ("text", "integer", "float") else "CAST(NULL AS DOUBLE)"
        if kind == "text":
            dp = " + ".join(f"count(*) FILTER (regexp_matches({c}, '{p}')) * 1.0 / count({c})" for p in DATE_FORMS)
            dc = f"count(*) FILTER (try_strptime(trim({c}), {STRP}) IS NOT NULL) * 1.0 / count({c})"
            np_ = " + ".join(f"count(*) FILTER (regexp_matches(trim({c}), '{p}')) * 1.0 / count({c})" for p in NUMBER_FORMS)
            nc = "count(x) * 1.0 / count({0})".format(c)
        elif kind == "datetime":
            dp, dc, np_, nc = "1.0", "1.0", "0.0", "0.0"
        else:
            dp, dc, np_, nc = "0.0", "0.0", "1.0", "1.0"
        parts.append(f"""SELECT '{c}' AS column_name, '{kind}' AS original_type, count(*) AS n_rows, count({c}) AS non_null, count(DISTINCT {c}) AS u,
            CAST({dp} AS DOUBLE) AS dp, CAST({dc} AS DOUBLE) AS dc, CAST({np_} AS DOUBLE) AS np, CAST({nc} AS DOUBLE) AS nc, count(x) AS nn,
            avg(power(x - m, 3)) / nullif(power(avg(power(x - m, 2)), 1.5), 0) AS g1, avg(power(x - m, 4)) / nullif(power(avg(power(x - m, 2)), 2), 0) - 3 AS g2
            FROM (SELECT *, avg(x) OVER () AS m FROM (SELECT *, {x} AS x FROM {table}))""")
    return "\nUNION ALL\n".join(parts)


CT_KIND = {c: "integer" if c == "c_custkey" else "text" for c in CT_ALL.split()}
EV = evidence_sql(CT_KIND, "customer_text")
SCORED = f"""SELECT *, {k2_sql('nn', 'g1', 'g2')} AS k2,
    CASE WHEN dc > 0.7 THEN least(0.9, dc + 0.1) WHEN dp > 0 THEN least(0.8, dp / 4) END AS dconf,
    CASE WHEN nc > 0.8 THEN least(0.9, nc) WHEN np > 0 THEN least(0.8, np) END AS nconf,
    CASE WHEN u >= 0.95 * non_null THEN 'identifier' WHEN u <= 0.5 * non_null AND u <= 50 THEN 'categorical' WHEN u > 0.8 * non_null THEN 'continuous' END AS ctype,
    CASE WHEN u >= 0.95 * non_null THEN 0.9 WHEN u <= 0.5 * non_null AND u <= 50 THEN 0.8 WHEN u > 0.8 * non_null THEN 0.7 END AS cconf FROM ({EV})"""
DECIDED = f"""SELECT *, CASE WHEN accepted IS NOT NULL THEN accepted ELSE 'text' END AS inferred_type,
        CASE WHEN accepted IS NOT NULL THEN best WHEN best = 0 THEN 0.5 ELSE greatest(0.3, best * 0.5) END AS confidence
    FROM (SELECT *, CASE WHEN w = 'identifier' AND best > 0.8 THEN 'identifier' WHEN w = 'datetime' AND best > 0.7 THEN 'datetime'
            WHEN w IN ('numeric', 'continuous_normal', 'continuous_skewed') AND best > 0.6 THEN 'numeric' WHEN w = 'categorical' AND best > 0.6 THEN 'categorical' END AS accepted
        FROM (SELECT *, CASE WHEN best = coalesce(dconf, 0) THEN 'datetime' WHEN best = coalesce(nconf, 0) THEN 'numeric' WHEN best = coalesce(cconf, 0) THEN ctype ELSE stype END AS w
            FROM (SELECT *, greatest(coalesce(dconf, 0), coalesce(nconf, 0), coalesce(cconf, 0), coalesce(sconf, 0)) AS best
                FROM (SELECT *, CASE WHEN nn >= 10 AND k2 IS NOT NULL THEN CASE WHEN exp(-k2 / 2) > 0.05 THEN 'continuous_normal' ELSE 'continuous_skewed' END END AS stype,
                             CASE WHEN nn >= 10 AND k2 IS NOT NULL THEN CASE WHEN exp(-k2 / 2) > 0.05 THEN 0.7 ELSE 0.6 END END AS sconf FROM ({SCORED})))))"""
ADVICE = """concat_ws(',', CASE WHEN confidence < 0.4 THEN 'review_low_confidence' END, CASE inferred_type WHEN 'identifier' THEN 'drop_identifier_for_modeling'
    WHEN 'datetime' THEN 'extract_temporal_features' WHEN 'numeric' THEN CASE WHEN original_type = 'text' THEN 'convert_to_number' END
    WHEN 'categorical' THEN CASE WHEN u > 20 THEN 'encode_high_cardinality' ELSE 'encode_categorical' END WHEN 'text' THEN 'preprocess_text' END,
    CASE WHEN 1 - non_null * 1.0 / n_rows > 0.1 THEN 'handle_missing_values' END)"""
DETECTED = """concat_ws(',', CASE WHEN non_null = 0 THEN 'all_null' END, CASE WHEN dp > 0 THEN 'datetime_pattern' END, CASE WHEN dc > 0.7 THEN 'datetime_convertible' END,
    CASE WHEN np > 0 THEN 'numeric_pattern' END, CASE WHEN nc > 0.8 THEN 'numeric_convertible' END,
    CASE ctype WHEN 'identifier' THEN 'unique_identifier' WHEN 'categorical' THEN 'categorical' WHEN 'continuous' THEN 'continuous_high_cardinality' END,
    CASE stype WHEN 'continuous_normal' THEN 'normal_distribution' WHEN 'continuous_skewed' THEN 'non_normal_distribution' END)"""
SAMPLES = ("SELECT column_name, array_to_string(list_transform(list_sort(list(struct_pack(h := h, v := v)))[1:10], lambda x: x.v), ' | ') AS sample_values FROM ("
           "SELECT column_name, min(h) AS h, arg_min(v, h) AS v FROM (SELECT *, md5(v) AS h FROM ("
           + "\nUNION ALL\n".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS v FROM customer_text WHERE {c} IS NOT NULL" for c in CT_KIND)
           + ")) GROUP BY column_name, substr(h, 1, 2)) GROUP BY 1")
INFER = f"SELECT column_name, original_type, inferred_type, CAST(confidence AS DOUBLE) AS confidence, n_rows, non_null, u AS unique_count, {ADVICE} AS advice, {DETECTED} AS patterns_detected FROM ({DECIDED})"


def _infer(s, d):
    return I.infer(settled_view(s, d, "customer_text"))


# ---- patterns -----------------------------------------------------------------------------
SQL_FORMATS = [(name, rx.replace("(?i)", ""), "'i'" if rx.startswith("(?i)") else "'c'", limit) for _, name, rx, limit in PT.FORMATS]
FORMATS_SQL = "SELECT column_name, pattern_name, 'regex' AS pattern_type, least(0.95, ratio) AS confidence, matches_count, total_count, ratio AS match_ratio FROM (\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, '{name}' AS pattern_name, count(*) FILTER (regexp_matches(trim({c}), '{rx}', {flag})) AS matches_count, count({c}) AS total_count, {limit} AS lim, count(*) FILTER (regexp_matches(trim({c}), '{rx}', {flag})) * 1.0 / count({c}) AS ratio FROM customer_text"
    for c in CT_TXT.split() for name, rx, flag, limit in SQL_FORMATS) + "\n) WHERE ratio >= lim"


def steps_sql(cols: dict[str, str], table: str) -> str:
    return "\nUNION ALL\n".join(f"""SELECT '{c}' AS column_name, (SELECT count({c}) FROM {table}) AS total_count, (SELECT count({num_text(c, k)}) FROM {table}) AS n_number,
        CAST(coalesce(sum(k), 0) AS BIGINT) AS n_steps, arg_min(step, (-k, step)) AS top_step, CAST(max(k) AS BIGINT) AS top_count
        FROM (SELECT step, count(*) AS k FROM (SELECT v - lag(v) OVER (ORDER BY v) AS step FROM (SELECT {num_text(c, k)} AS v FROM {table}) WHERE v IS NOT NULL) WHERE step IS NOT NULL GROUP BY 1)"""
                               for c, k in cols.items())


def named_sql(table: str, cols: dict[str, str]) -> dict[str, str]:
    """SQL of every pattern family over ``table``."""
    num = [c for c, k in cols.items() if k != "datetime"]
    out = {}
    out["ident"] = "\nUNION ALL\n".join(f"""SELECT '{c}' AS column_name, 'constant_value' AS pattern_name, 'special' AS pattern_type, 1.0 AS confidence, count({c}) AS matches_count, count({c}) AS total_count, 1.0 AS match_ratio
            FROM {table} HAVING count(DISTINCT {c}) = 1
        UNION ALL SELECT '{c}', 'unique_identifier', 'special', count(DISTINCT {c}) * 1.0 / count({c}), count(DISTINCT {c}), count({c}), count(DISTINCT {c}) * 1.0 / count({c}) FROM {table} HAVING count(DISTINCT {c}) > 0.95 * count({c})""" for c in cols)
    out["normal"] = f"SELECT column_name, total_count, nn AS n_number, p AS p_value, p > 0.05 AS is_normal FROM (SELECT *, exp(-{k2_sql('nn', 'g1', 'g2')} / 2) AS p FROM (" + "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS total_count, count(x) AS nn, avg(power(x - m, 3)) / nullif(power(avg(power(x - m, 2)), 1.5), 0) AS g1, avg(power(x - m, 4)) / nullif(power(avg(power(x - m, 2)), 2), 0) - 3 AS g2
            FROM (SELECT {c}, x, avg(x) OVER () AS m FROM (SELECT {c}, {num_text(c, cols[c])} AS x FROM {table}))""" for c in num) + ")) WHERE nn >= 10"
    out["uniform"] = "\nUNION ALL\n".join(f"""SELECT '{c}' AS column_name, CAST(sum(m) AS BIGINT) AS n_number, stddev_pop(m) / avg(m) AS bin_cv, stddev_pop(m) / avg(m) < 0.3 AS is_uniform
        FROM (SELECT b.b, count(t.bin) AS m FROM (SELECT unnest(range(10)) AS b) b LEFT JOIN (
            SELECT least(floor((x - CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END) / (CASE WHEN lo = hi THEN 1.0 ELSE hi - lo END / 10)), 9) AS bin
            FROM (SELECT x, min(x) OVER () AS lo, max(x) OVER () AS hi FROM (SELECT {num_text(c, cols[c])} AS x FROM {table}) WHERE x IS NOT NULL)) t ON t.bin = b.b GROUP BY 1) HAVING sum(m) >= 10""" for c in num)
    out["outliers"] = "SELECT column_name, 'numeric_outliers' AS pattern_name, 'anomaly' AS pattern_type, least(0.9, 2.0 * o / n) AS confidence, o AS matches_count, n AS total_count, o * 1.0 / n AS match_ratio FROM (" + "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS column_name, count(x) AS n, count(*) FILTER (x < a - 3 * (b - a) OR x > b + 3 * (b - a)) AS o
        FROM (SELECT {num_text(c, cols[c])} AS x FROM {table}), (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM (SELECT {num_text(c, cols[c])} AS x FROM {table}))""" for c in num) + ") WHERE n >= 10 AND o > 0"
    out["case"] = "SELECT column_name, 'case_inconsistency' AS pattern_name, 'anomaly' AS pattern_type, k * 1.0 / n AS confidence, k AS matches_count, n AS total_count, k * 1.0 / n AS match_ratio FROM (" + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, count({c}) AS n, least(count(*) FILTER (regexp_matches({c}, '[A-Z]')), count(*) FILTER (regexp_matches({c}, '[a-z]'))) AS k FROM {table}" for c, k in cols.items() if k == "text") + ") WHERE k > 0.1 * n"
    out["seq"] = f"SELECT *, coalesce(n_number >= 0.8 * total_count AND top_count * 1.0 / nullif(n_steps, 0) > 0.7, false) AS is_sequential FROM ({steps_sql({c: cols[c] for c in num}, table)})"
    return out


def detect_sql(table: str, cols: dict[str, str], cross: str | None = None) -> str:
    n = named_sql(table, cols)
    parts = [n["ident"], n["outliers"]]
    if "text" in cols.values():
        parts += [FORMATS_SQL if table == "customer_text" else "", n["case"]]
    parts += [f"SELECT column_name, 'sequential_id', 'special', 0.9, total_count, total_count, 1.0 FROM ({n['seq']}) WHERE is_sequential",
              f"SELECT column_name, 'normal_distribution', 'statistical', least(0.9, 1 - p_value), n_number, total_count, n_number * 1.0 / total_count FROM ({n['normal']}) WHERE is_normal",
              f"SELECT u.column_name, 'uniform_distribution', 'statistical', 0.7, u.n_number, t.total_count, u.n_number * 1.0 / t.total_count FROM ({n['uniform']}) u JOIN ({n['normal']}) t ON t.column_name = u.column_name WHERE is_uniform"]
    if cross:
        parts.append(cross)
    return "\nUNION ALL\n".join(f"SELECT * FROM ({p})" for p in parts if p)


FOUND = detect_sql("customer_text", CT_KIND)
SHAPE_D = "confidence match_ratio"
CT_NUM = {c: CT_KIND[c] for c in ("c_custkey", "balance_number", "zip", "phone")}
N = named_sql("customer_text", CT_KIND)
LI4 = {c: "float" for c in LI_NUM.split()}


def _detect(s, d):
    return cut(PT.detect(view(s, d, "customer_text")))


QUERIES = {
    "infer_datetime": lambda s, d: rounded(I.scored(I.evidence(view(s, d, "customer_text"))).select("column_name", "date_patterns", "date_parse", "datetime_conf")),
    "infer_numeric": lambda s, d: rounded(I.scored(I.evidence(view(s, d, "customer_text"))).select("column_name", "number_patterns", "number_parse", "numeric_conf")),
    "infer_cardinality": lambda s, d: I.scored(I.evidence(view(s, d, "customer_text"))).select("column_name", "unique_count", "cardinality_type", "cardinality_conf"),
    "infer_distribution": lambda s, d: rounded(I.scored(I.evidence(load(s, d, "lineitem"), LI_NUM.split())).select("column_name", "k2", "normal_p", "distribution_type"), 3),
    "infer_final": lambda s, d: rounded(I.decided(I.scored(I.evidence(view(s, d, "customer_text")))).select("column_name", "inferred_type", "confidence")),
    "infer_all_null": lambda s, d: I.infer(view(s, d, "const_cols"), ["empty_text", "constant_text", "p_partkey"]).select("column_name", "inferred_type", "confidence"),
    "infer_stats": lambda s, d: rounded(I.statistics(view(s, d, "customer_text"))),
    "infer_top_categories": lambda s, d: I.top_categories(view(s, d, "customer_text")).select("column_name", "value", "n", "rank"),
    "infer_table": lambda s, d: rounded(I.with_samples(settled_view(s, d, "customer_text"), _infer(s, d)).withColumn("sample_values", F.array_join("sample_values", " | "))),
    "infer_reco": lambda s, d: _infer(s, d).select("column_name", "advice"),
    "infer_report": lambda s, d: I.report(_infer(s, d)),
    "pat_regex": lambda s, d: rounded(PT.format_examples(settled_view(s, d, "customer_text"), cut(PT.formats(settled_view(s, d, "customer_text")))).withColumn("examples", F.array_join("examples", " | "))),
    "pat_sequential": lambda s, d: rounded(PT.sequential(load(s, d, "orders"))),
    "pat_constant": lambda s, d: PT.identifiers(view(s, d, "const_cols")).where("pattern_name = 'constant_value'"),
    "pat_unique_id": lambda s, d: rounded(PT.identifiers(view(s, d, "const_cols")).where("pattern_name = 'unique_identifier'")),
    "pat_normal": lambda s, d: rounded(PT.normal(load(s, d, "lineitem"), LI_NUM.split())),
    "pat_uniform": lambda s, d: rounded(PT.uniform(load(s, d, "lineitem"), LI_NUM.split())),
    "pat_outliers": lambda s, d: rounded(PT.far_outliers(view(s, d, "orders_dirty"), ["o_orderkey", "o_custkey", "o_totalprice"])),
    "pat_case": lambda s, d: rounded(PT.mixed_case(load(s, d, "documents"))),
    "pat_high_corr": lambda s, d: rounded(PT.high_correlation(load(s, d, "lineitem"))),
    "pat_detect": lambda s, d: rounded(_detect(s, d)),
    "pat_report": lambda s, d: PT.report(_detect(s, d)),
}

_ct = lambda sql: with_views("customer_text", sql)
SQL = {
    "infer_datetime": _ct(r(f"SELECT column_name, dp AS date_patterns, dc AS date_parse, CAST(dconf AS DOUBLE) AS datetime_conf FROM ({SCORED})", "date_patterns date_parse datetime_conf")),
    "infer_numeric": _ct(r(f"SELECT column_name, np AS number_patterns, nc AS number_parse, CAST(nconf AS DOUBLE) AS numeric_conf FROM ({SCORED})", "number_patterns number_parse numeric_conf")),
    "infer_cardinality": _ct(f"SELECT column_name, u AS unique_count, ctype AS cardinality_type, CAST(cconf AS DOUBLE) AS cardinality_conf FROM ({SCORED})"),
    "infer_distribution": r(f"SELECT column_name, k2, exp(-k2 / 2) AS normal_p, CASE WHEN exp(-k2 / 2) > 0.05 THEN 'continuous_normal' ELSE 'continuous_skewed' END AS distribution_type FROM (SELECT *, {k2_sql('nn', 'g1', 'g2')} AS k2 FROM ("
        + per_column(LI_NUM, "SELECT '{c}' AS column_name, count(x) AS nn, avg(power(x - m, 3)) / power(avg(power(x - m, 2)), 1.5) AS g1, avg(power(x - m, 4)) / power(avg(power(x - m, 2)), 2) - 3 AS g2 FROM (SELECT CAST({c} AS DOUBLE) AS x, avg(CAST({c} AS DOUBLE)) OVER () AS m FROM lineitem)") + "))", "k2 normal_p", 3),
    "infer_final": _ct(r(f"SELECT column_name, inferred_type, CAST(confidence AS DOUBLE) AS confidence FROM ({DECIDED})", "confidence")),
    "infer_all_null": with_views("const_cols", """SELECT 'empty_text' AS column_name, CASE WHEN count(empty_text) = 0 THEN 'empty' END AS inferred_type, 1.0 AS confidence FROM const_cols
        UNION ALL SELECT 'constant_text', CASE WHEN count(DISTINCT constant_text) <= 50 THEN 'categorical' END, 0.8 FROM const_cols
        UNION ALL SELECT 'p_partkey', CASE WHEN count(p_partkey) > 0 THEN 'numeric' END, 0.9 FROM const_cols"""),
    "infer_stats": _ct(r("\nUNION ALL\n".join(f"""SELECT '{c}' AS column_name, count(*) AS total_count, count({c}) AS non_null_count, count(*) - count({c}) AS null_count,
        1 - count({c}) * 1.0 / count(*) AS missing_ratio, count(DISTINCT {c}) AS unique_count, count(DISTINCT {c}) * 1.0 / count(*) AS unique_ratio, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, max(x) AS max,
        quantile_cont(x, 0.5) AS median, skewness(x) AS skewness, kurtosis(x) AS kurtosis FROM (SELECT *, {num_text(c, k)} AS x FROM customer_text)""" for c, k in CT_KIND.items()), "missing_ratio unique_ratio mean std min max median skewness kurtosis")),
    "infer_top_categories": _ct(f"""WITH chosen AS MATERIALIZED (SELECT column_name FROM ({DECIDED}) WHERE inferred_type = 'categorical') SELECT column_name, value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank FROM (""" + per_column(
        CT_TXT, "SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM customer_text WHERE {c} IS NOT NULL GROUP BY 2") + f")) WHERE rank <= 10 AND column_name IN (SELECT column_name FROM chosen)"),
    "infer_table": _ct(r(f"SELECT i.*, e.sample_values FROM ({INFER}) i LEFT JOIN ({SAMPLES}) e ON e.column_name = i.column_name", "confidence")),
    "infer_reco": _ct(f"SELECT column_name, advice FROM ({INFER})"),
    "infer_report": _ct(f"""SELECT 'confidence' AS section, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS item, count(*) AS n FROM ({INFER}) GROUP BY 2
        UNION ALL SELECT 'type', inferred_type, count(*) FROM ({INFER}) GROUP BY 2
        UNION ALL SELECT 'advice', CASE WHEN confidence < 0.4 THEN 'high_priority' WHEN confidence < 0.6 THEN 'medium_priority' ELSE 'low_priority' END,
            CAST(sum(CASE WHEN advice = '' THEN 0 ELSE length(advice) - length(replace(advice, ',', '')) + 1 END) AS BIGINT) FROM ({INFER}) GROUP BY 2"""),
    "pat_regex": _ct(r(f"SELECT f.*, array_to_string(e.examples, ' | ') AS examples, concat('values read as ', replace(f.pattern_name, '_', ' ')) AS description FROM ({FORMATS_SQL}) f JOIN (SELECT column_name, pattern_name, list_transform(list_sort(list(struct_pack(h := h, v := v)))[1:5], lambda x: x.v) AS examples FROM (SELECT column_name, pattern_name, min(h) AS h, arg_min(v, h) AS v FROM (SELECT *, md5(v) AS h FROM (" + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, '{name}' AS pattern_name, {c} AS v FROM customer_text WHERE regexp_matches(trim({c}), '{rx}', {flag})"
        for c in CT_TXT.split() for name, rx, flag, _ in SQL_FORMATS) + ")) GROUP BY column_name, pattern_name, substr(h, 1, 2)) GROUP BY 1, 2) e ON e.column_name = f.column_name AND e.pattern_name = f.pattern_name", SHAPE_D)),
    "pat_sequential": r(named_sql("orders", {"o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "text", "o_totalprice": "float", "o_orderpriority": "text"})["seq"], "top_step"),
    "pat_constant": with_views("const_cols", "SELECT * FROM (" + named_sql("const_cols", dict.fromkeys("p_partkey p_brand p_size p_retailprice constant_text constant_number empty_text part_id".split(), "text"))["ident"] + ") WHERE pattern_name = 'constant_value'"),
    "pat_unique_id": with_views("const_cols", r("SELECT * FROM (" + named_sql("const_cols", dict.fromkeys("p_partkey p_brand p_size p_retailprice constant_text constant_number empty_text part_id".split(), "text"))["ident"] + ") WHERE pattern_name = 'unique_identifier'", SHAPE_D)),
    "pat_normal": r(named_sql("lineitem", LI4)["normal"], "p_value"),
    "pat_uniform": r(named_sql("lineitem", LI4)["uniform"], "bin_cv"),
    "pat_outliers": with_views("orders_dirty", r(named_sql("orders_dirty", dict.fromkeys(("o_orderkey", "o_custkey", "o_totalprice"), "float"))["outliers"], SHAPE_D)),
    "pat_case": r(named_sql("documents", dict.fromkeys(("text", "lang", "source"), "text"))["case"], SHAPE_D),
    "pat_high_corr": r("SELECT * FROM (" + "\nUNION ALL\n".join(
        f"SELECT '{a}' AS feature1, '{b}' AS feature2, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM lineitem" for i, a in enumerate(LI_NUM.split()) for b in LI_NUM.split()[i + 1:]) + ") WHERE abs(r) >= 0.8", "r"),
    "pat_detect": _ct(r(FOUND, SHAPE_D)),
    "pat_report": _ct(f"""SELECT 'type' AS section, pattern_type AS item, count(*) AS n FROM ({FOUND}) GROUP BY 2
        UNION ALL SELECT * FROM (SELECT 'confidence', 'high', count(*) AS n FROM ({FOUND}) WHERE confidence >= 0.8) WHERE n > 0
        UNION ALL SELECT * FROM (SELECT 'advice', CASE WHEN pattern_name IN ('unique_identifier', 'sequential_id') THEN 'drop_identifiers' WHEN pattern_name = 'numeric_outliers' THEN 'review_outliers'
            WHEN pattern_name IN ('email', 'phone', 'ssn') THEN 'protect_private_data' END AS item, count(*) FROM ({FOUND}) GROUP BY 2) WHERE item IS NOT NULL"""),
}
