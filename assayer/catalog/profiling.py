"""Registered queries: sources, inspection and profiling."""

from __future__ import annotations


from pyspark.sql import functions as F

from assayer.catalog.fixtures import load, per_column, r, rounded, view, with_views
from assayer.operators import profile as P
from assayer.sources import files as IO
from assayer.session import shared_folder

LI_NUM = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax"
LI_TXT = "l_returnflag l_linestatus"
LI_ALL = f"{LI_NUM} {LI_TXT} l_shipdate"
LI_KIND = dict.fromkeys("l_orderkey l_partkey l_suppkey l_linenumber".split(), "integer") \
    | dict.fromkeys("l_quantity l_extendedprice l_discount l_tax".split(), "float") \
    | dict.fromkeys(LI_TXT.split(), "text") | {"l_shipdate": "datetime"}
OD_ALL = "o_orderkey o_custkey o_orderstatus o_totalprice o_orderpriority o_orderdate"
OD_KIND = {"o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "text", "o_totalprice": "float",
           "o_orderpriority": "text", "o_orderdate": "text"}
CT_ALL = "c_custkey c_name c_mktsegment balance balance_number email phone ssn zip uuid percent_text signup_date note status"
CT_TXT = CT_ALL.replace("c_custkey ", "")


def _counts(cols: str, table: str) -> str:
    return per_column(cols, f"""SELECT '{{c}}' AS column_name, count(*) AS count, count(*) - count({{c}}) AS missing_count,
        100.0 * (count(*) - count({{c}})) / count(*) AS missing_pct, count(DISTINCT {{c}}) AS unique_count,
        100.0 * count(DISTINCT {{c}}) / count(*) AS unique_pct FROM {table}""")


def _moments(c: str) -> str:
    """Population skewness and excess kurtosis of ``c`` over a derived table ``t`` with its mean ``m``."""
    return (f"avg(power({c} - m, 3)) / nullif(power(avg(power({c} - m, 2)), 1.5), 0)",
            f"avg(power({c} - m, 4)) / nullif(power(avg(power({c} - m, 2)), 2), 0) - 3")


def profile_sql(cols: str, kinds: dict[str, str], table: str) -> str:
    """The whole per-column record, computed column by column."""
    parts = []
    for c in cols.split():
        k = kinds[c]
        if k in ("integer", "float"):
            x = f"CAST({c} AS DOUBLE)"
            skew, kurt = _moments(x)
            num = f"""avg({x}) AS mean, stddev_samp({x}) AS std, min({x}) AS min, max({x}) AS max,
                quantile_cont({x}, 0.25) AS q25, quantile_cont({x}, 0.5) AS q50, quantile_cont({x}, 0.75) AS q75,
                {skew} AS skewness, {kurt} AS kurtosis,
                CAST(count(*) FILTER ({x} < lo OR {x} > hi) AS BIGINT) AS outliers_iqr"""
            src = f"""(SELECT {c}, (SELECT avg({x}) FROM {table}) AS m,
                (SELECT quantile_cont({x}, 0.25) - 1.5 * (quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)) FROM {table}) AS lo,
                (SELECT quantile_cont({x}, 0.75) + 1.5 * (quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)) FROM {table}) AS hi FROM {table})"""
        else:
            num = """CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max,
                CAST(NULL AS DOUBLE) AS q25, CAST(NULL AS DOUBLE) AS q50, CAST(NULL AS DOUBLE) AS q75,
                CAST(NULL AS DOUBLE) AS skewness, CAST(NULL AS DOUBLE) AS kurtosis, CAST(NULL AS BIGINT) AS outliers_iqr"""
            src = table
        if k == "text":
            txt = f"""avg(length({c})) AS avg_length, coalesce(bool_or(regexp_matches({c}, '^\\s|\\s$')), false) AS has_edge_blank,
                coalesce(bool_or(regexp_matches({c}, '\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{2}}/\\d{{2}}/\\d{{4}}|\\d{{2}}-\\d{{2}}-\\d{{4}}')), false) AS suspected_date,
                count(DISTINCT {c}) AS cardinality"""
        else:
            txt = "CAST(NULL AS DOUBLE) AS avg_length, false AS has_edge_blank, false AS suspected_date, CAST(NULL AS BIGINT) AS cardinality"
        parts.append(f"""SELECT '{c}' AS column_name, '{k}' AS kind, count(*) AS count, count(*) - count({c}) AS missing_count,
            100.0 * (count(*) - count({c})) / count(*) AS missing_pct, count(DISTINCT {c}) AS unique_count, {num}, {txt} FROM {src}""")
    return "\nUNION ALL\n".join(parts)


PROFILE_DOUBLES = "missing_pct mean std min max q25 q50 q75 skewness kurtosis avg_length"
DIRTY_PROFILE = profile_sql(OD_ALL, OD_KIND, "orders_dirty")


def _join_labels(*pairs: tuple[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {cond} THEN '{label}' END" for cond, label in pairs) + ")"


def _pairs(cols: str) -> list[tuple[str, str]]:
    c = cols.split()
    return [(a, b) for i, a in enumerate(c) for b in c[i + 1:]]


def _csv_round_trip(how):
    """Write the customer table as CSV in some form, read it back and return it typed."""
    def run(s, d):
        src = load(s, d, "customer")
        path = shared_folder(s, "csv")
        typed = lambda df: df.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), F.col("c_name").cast("string").alias("c_name"),
                                     F.col("c_nationkey").cast("int").alias("c_nationkey"), F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment")
        if how == "plain":
            IO.write_csv(src, path, sep=";")
            return typed(IO.read_csv(s, path))
        if how == "auto":
            IO.write_csv(src, path, "pipe_separated")
            return typed(IO.read_csv_auto(s, path))
        if how in ("semicolon_or_comma", "first_that_splits"):
            IO.write_csv(src, path, "clean_semicolon")
            return typed(IO.read_csv_auto(s, path, rule=how))
        if how == "fallback":
            accented = src.withColumn("c_name", F.concat("c_name", F.lit(" \u00e9")))
            IO.write_csv(accented, path, sep=";", encoding="ISO-8859-1")
            return typed(IO.read_csv_fallback(s, path))
        if how == "report":
            IO.write_report({"customer": src}, path)
            return typed(s.read.json(f"{path}/customer"))
        if how == "all":
            IO.write_csv(src, path, sep=",", quoting="all", line_sep="\n")
            return typed(IO.read_csv(s, path, ","))
        out = None
        for name, opts in IO.PRESETS.items():
            IO.write_csv(src, f"{path}/{name}", name)
            back = typed(IO.read_csv(s, f"{path}/{name}", str(opts["sep"]))).withColumn("preset", F.lit(name))
            out = back if out is None else out.unionByName(back)
        return out
    return run


QUERIES = {
    "src_csv_pair_rule": _csv_round_trip("semicolon_or_comma"), "src_csv_split_rule": _csv_round_trip("first_that_splits"),
    "src_csv": _csv_round_trip("plain"), "src_csv_auto": _csv_round_trip("auto"), "src_encoding_fallback": _csv_round_trip("fallback"),
    "sink_csv": _csv_round_trip("all"), "sink_csv_presets": _csv_round_trip("presets"), "sink_report": _csv_round_trip("report"),
    "src_parquet": lambda s, d: load(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"),
    "inspect_basic": lambda s, d: rounded(P.inspect(load(s, d, "orders"))),
    "profile_counts": lambda s, d: rounded(P.counts(view(s, d, "orders_dirty"))),
    "profile_numeric": lambda s, d: rounded(P.numeric(load(s, d, "lineitem"))),
    "profile_moments": lambda s, d: rounded(P.moments(load(s, d, "lineitem"))),
    "profile_outliers_iqr": lambda s, d: rounded(P.outliers_iqr(view(s, d, "orders_dirty"))),
    "profile_outliers_z": lambda s, d: P.outliers_z(view(s, d, "orders_dirty")),
    "profile_categorical": lambda s, d: P.categorical(load(s, d, "part")),
    "profile_text_length": lambda s, d: rounded(P.text_length(load(s, d, "documents"))),
    "profile_has_duplicates": lambda s, d: P.has_duplicates(view(s, d, "const_cols")),
    "profile_date_suspect": lambda s, d: P.date_suspect(view(s, d, "customer_text")),
    "profile_dataset": lambda s, d: P.dataset(view(s, d, "orders_dup")),
    "profile_correlations": lambda s, d: rounded(
        P.pearson_pairs(load(s, d, "lineitem")).withColumnRenamed("r", "association").unionByName(
            P.cramers_v_pairs(load(s, d, "lineitem")).withColumnRenamed("v", "association"))),
    "profile_table": lambda s, d: rounded(P.profile(load(s, d, "lineitem")), 4),
    "profile_column_reco": lambda s, d: P.column_advice(P.profile(view(s, d, "orders_dirty"))),
    "profile_transform_reco": lambda s, d: P.transform_advice(P.profile(view(s, d, "orders_dirty"))),
    "profile_recipe": lambda s, d: P.recipe(P.profile(view(s, d, "orders_dirty"))),
    "profile_recipe_basic": lambda s, d: rounded(P.recipe_basic(view(s, d, "customer_text"))),
    "profile_basic_fallback": lambda s, d: rounded(P.basic(load(s, d, "orders"), "o_orderkey o_custkey o_orderstatus o_totalprice o_orderpriority".split())),
    "dataset_traits": lambda s, d: rounded(P.traits(load(s, d, "events"), "event_type")),
}

SQL = {
    "src_csv_pair_rule": "SELECT * FROM customer", "src_csv_split_rule": "SELECT * FROM customer",
    "src_csv": "SELECT * FROM customer", "src_csv_auto": "SELECT * FROM customer", "sink_csv": "SELECT * FROM customer", "sink_report": "SELECT * FROM customer",
    "src_encoding_fallback": "SELECT * REPLACE (concat(c_name, ' \u00e9') AS c_name) FROM customer",
    "sink_csv_presets": "SELECT customer.*, p AS preset FROM customer, (SELECT unnest(['quoted_semicolon', 'clean_semicolon', 'standard_csv', 'tab_separated', 'pipe_separated', 'no_quotes']) AS p)",
    "src_parquet": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "inspect_basic": r("\nUNION ALL\n".join(
        f"""SELECT '{c}' AS column_name, count(*) AS n_rows, 6 AS n_columns, '{k}' AS kind, count(*) - count({c}) AS null_count,
            100.0 * (count(*) - count({c})) / count(*) AS null_pct, count(DISTINCT {c}) AS distinct_count FROM orders"""
        for c, k in (OD_KIND | {"o_orderdate": "datetime"}).items()), "null_pct"),
    "profile_counts": with_views("orders_dirty", r(_counts(OD_ALL, "orders_dirty"), "missing_pct unique_pct")),
    "profile_numeric": r(per_column(LI_NUM, """SELECT '{c}' AS column_name, avg(CAST({c} AS DOUBLE)) AS mean, stddev_samp(CAST({c} AS DOUBLE)) AS std,
        min(CAST({c} AS DOUBLE)) AS min, max(CAST({c} AS DOUBLE)) AS max, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25,
        quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q50, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75 FROM lineitem"""),
        "mean std min max q25 q50 q75"),
    "profile_moments": r(per_column(LI_NUM, f"""SELECT '{{c}}' AS column_name, {_moments('x')[0]} AS skewness, {_moments('x')[1]} AS kurtosis
        FROM (SELECT CAST({{c}} AS DOUBLE) AS x, (SELECT avg({{c}}) FROM lineitem) AS m FROM lineitem)"""), "skewness kurtosis"),
    "profile_outliers_iqr": with_views("orders_dirty", r(per_column("o_orderkey o_custkey o_totalprice", """
        SELECT '{c}' AS column_name, any_value(lo) AS lower, any_value(hi) AS upper, count(*) FILTER ({c} < lo OR {c} > hi) AS outliers
        FROM orders_dirty, (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM (SELECT
            quantile_cont(CAST({c} AS DOUBLE), 0.25) AS a, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS b FROM orders_dirty))"""), "lower upper")),
    "profile_outliers_z": with_views("orders_dirty", per_column("o_orderkey o_custkey o_totalprice", """
        SELECT '{c}' AS column_name, count(*) FILTER (abs({c} - m) / s > 3) AS outliers
        FROM orders_dirty, (SELECT avg(CAST({c} AS DOUBLE)) AS m, stddev_samp(CAST({c} AS DOUBLE)) AS s FROM orders_dirty)""")),
    "profile_categorical": per_column("p_name p_brand p_type", """
        SELECT '{c}' AS column_name, count(*) AS cardinality, arg_min(v, rk) AS mode_value, max(n) AS mode_count,
               string_agg(concat(v, '=', n), ';' ORDER BY rk) FILTER (rk <= 10) AS top_values
        FROM (SELECT v, n, row_number() OVER (ORDER BY n DESC, v) AS rk FROM (SELECT {c} AS v, count(*) AS n FROM part WHERE {c} IS NOT NULL GROUP BY 1))"""),
    "profile_text_length": r(per_column("text lang source", """
        SELECT '{c}' AS column_name, avg(length({c})) AS avg_length, CAST(min(length({c})) AS INTEGER) AS min_length, CAST(max(length({c})) AS INTEGER) AS max_length,
               coalesce(bool_or(regexp_matches({c}, '^\\s|\\s$')), false) AS has_edge_blank FROM documents"""), "avg_length"),
    "profile_has_duplicates": with_views("const_cols", per_column(
        "p_partkey p_brand p_size p_retailprice constant_text constant_number empty_text part_id",
        "SELECT '{c}' AS column_name, coalesce(max(n), 0) > 1 AS has_duplicates FROM (SELECT {c}, count(*) AS n FROM const_cols GROUP BY 1)")),
    "profile_date_suspect": with_views("customer_text", per_column(CT_TXT, """SELECT '{c}' AS column_name,
        count(*) FILTER (regexp_matches({c}, '\\d{4}-\\d{2}-\\d{2}') OR regexp_matches({c}, '\\d{2}/\\d{2}/\\d{4}')
            OR regexp_matches({c}, '\\d{2}-\\d{2}-\\d{4}')) > 0 AS suspected_date FROM customer_text""")),
    "profile_dataset": with_views("orders_dup", """SELECT (SELECT count(*) FROM orders_dup) AS n_rows, 6 AS n_columns, CAST(0 AS BIGINT) AS missing_cells,
        (SELECT count(*) FROM orders_dup) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_dup)) AS duplicate_rows"""),
    "profile_correlations": r("\nUNION ALL\n".join(
        [f"SELECT '{a}' AS feature1, '{b}' AS feature2, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS association FROM lineitem" for a, b in _pairs(LI_NUM)]
        + ["""SELECT 'l_returnflag' AS feature1, 'l_linestatus' AS feature2, sqrt(greatest(sum(power(o - e, 2) / e) / any_value(n) / (least(any_value(a), any_value(b)) - 1), 0)) AS association
            FROM (SELECT coalesce(j.o, 0) AS o, CAST(x.c AS DOUBLE) * y.c / t.n AS e, t.n, (SELECT count(DISTINCT l_returnflag) FROM lineitem) AS a, (SELECT count(DISTINCT l_linestatus) FROM lineitem) AS b
                  FROM (SELECT l_returnflag AS v, count(*) AS c FROM lineitem GROUP BY 1) x
                  CROSS JOIN (SELECT l_linestatus AS w, count(*) AS c FROM lineitem GROUP BY 1) y
                  CROSS JOIN (SELECT count(*) AS n FROM lineitem) t
                  LEFT JOIN (SELECT l_returnflag AS v, l_linestatus AS w, count(*) AS o FROM lineitem GROUP BY 1, 2) j ON j.v = x.v AND j.w = y.w)"""]), "association"),
    "profile_table": r(profile_sql(LI_ALL, LI_KIND, "lineitem"), PROFILE_DOUBLES, 4),
    "profile_column_reco": with_views("orders_dirty", "SELECT column_name, " + _join_labels(
        ("missing_pct > 50", "consider_dropping_column"), ("missing_pct > 10 AND missing_pct <= 50", "impute_missing_values"),
        ("cardinality > 50", "reduce_cardinality"), ("outliers_iqr > 0", "handle_outliers"),
        ("has_edge_blank", "clean_whitespace"), ("suspected_date", "convert_to_datetime")) + f" AS actions FROM ({DIRTY_PROFILE})"),
    "profile_transform_reco": with_views("orders_dirty", "SELECT column_name, " + _join_labels(
        ("abs(skewness) > 1", "apply_log_transform"), ("abs(skewness) > 0.5 AND abs(skewness) <= 1", "apply_sqrt_transform"),
        ("cardinality BETWEEN 1 AND 10", "one_hot_encoding"), ("cardinality BETWEEN 11 AND 50", "label_encoding"),
        ("cardinality > 50", "target_encoding"), ("std <> 0 AND mean <> 0 AND std / abs(mean) > 1", "standard_scaling"),
        ("std <> 0 AND mean <> 0 AND std / abs(mean) <= 1", "minmax_scaling")) + f" AS suggestions FROM ({DIRTY_PROFILE})"),
    "profile_recipe": with_views("orders_dirty", f"""SELECT column_name,
        (unique_count = count AND unique_count > 1) OR column_name IN ('id','customer_id','customerid','user_id','userid','index','row_id') OR coalesce(cardinality > 0.95 * count, false) AS drop_column,
        CASE WHEN unique_count = count AND unique_count > 1 THEN 'unique_identifier' WHEN cardinality > 0.95 * count THEN 'high_cardinality' END AS drop_reason,
        CASE WHEN missing_pct > 0 THEN CASE WHEN kind IN ('integer','float') THEN 'median' ELSE 'most_frequent' END END AS imputation,
        CASE WHEN kind IN ('integer','float') AND outliers_iqr > 0 THEN 'remove' END AS outlier_treatment,
        CASE WHEN kind = 'text' AND NOT suspected_date THEN CASE WHEN cardinality BETWEEN 1 AND 10 THEN 'onehot' WHEN cardinality BETWEEN 11 AND 50 THEN 'label' ELSE 'target' END END AS encoding,
        kind = 'text' AND suspected_date AS date_conversion,
        CASE WHEN kind IN ('integer','float') AND abs(skewness) > 1 THEN 'log' END AS transformation,
        CASE WHEN kind IN ('integer','float') THEN CASE WHEN abs(skewness) > 1 THEN 'robust' ELSE 'standard' END END AS scaling
        FROM ({DIRTY_PROFILE})"""),
    "profile_recipe_basic": with_views("customer_text", r("\nUNION ALL\n".join(
        f"""SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count, 100.0 * (count(*) - count({c})) / count(*) AS missing_pct,
            count(DISTINCT {c}) AS unique_count, {'false' if c == 'c_custkey' else f'count(DISTINCT {c}) > 0.95 * count(*)'} AS drop_column,
            CASE WHEN count({c}) < 0.5 * count(*) THEN 'drop_column' WHEN count({c}) < 0.9 * count(*) THEN '{"median" if c == "c_custkey" else "most_frequent"}' ELSE 'none' END AS imputation,
            {'CAST(NULL AS VARCHAR)' if c == 'c_custkey' else f"""CASE
                WHEN count(*) FILTER ({c} IS NOT NULL AND TRY_CAST(trim({c}) AS DOUBLE) IS NULL) = 0 THEN 'float'
                WHEN count(*) FILTER ({c} IS NOT NULL AND try_strptime(trim({c}), ['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%m/%d/%Y', '%m-%d-%Y', '%Y/%m/%d']) IS NULL) = 0 THEN 'datetime'
                ELSE 'string' END"""} AS convert_to FROM customer_text""" for c in CT_ALL.split()), "missing_pct")),
    "profile_basic_fallback": r("\nUNION ALL\n".join(
        f"""SELECT '{c}' AS column_name, '{OD_KIND[c]}' AS kind, count(*) - count({c}) AS missing_count, 100.0 * (count(*) - count({c})) / count(*) AS missing_pct,
            count(DISTINCT {c}) AS unique_count, 100.0 * count(DISTINCT {c}) / count(*) AS unique_pct, """ + (
            f"avg(CAST({c} AS DOUBLE)) AS mean, stddev_samp(CAST({c} AS DOUBLE)) AS std, min(CAST({c} AS DOUBLE)) AS min, max(CAST({c} AS DOUBLE)) AS max"
            if OD_KIND[c] != "text" else ", ".join(f"CAST(NULL AS DOUBLE) AS {m}" for m in ("mean", "std", "min", "max"))) + " FROM orders"
        for c in OD_ALL.split() if c != "o_orderdate"), "missing_pct unique_pct mean std min max"),
    "dataset_traits": r("""SELECT t.n AS n_samples, 5 AS n_features, CASE WHEN t.n < 1000 THEN 'small' WHEN t.n < 10000 THEN 'medium' ELSE 'large' END AS size_class,
        'low' AS width_class, 'classification' AS problem_kind, CAST(0 AS BIGINT) AS missing_values, 1 AS categorical_features, 3 AS numeric_features,
        c.k AS n_classes, CAST(c.lo AS DOUBLE) / c.hi AS class_ratio, CAST(c.lo AS DOUBLE) / c.hi > 0.7 AS balanced
        FROM (SELECT count(*) AS n FROM events) t, (SELECT count(*) AS k, min(n) AS lo, max(n) AS hi FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)) c""", "class_ratio"),
}
