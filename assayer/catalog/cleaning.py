"""Registered queries: row filters, scalar cleaning, imputation, treatment, encoding, selection, recipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.catalog.fixtures import load, r, rounded, view, with_views
from assayer.functions import columns_text as CT
from assayer.functions.values import as_col, clip
from assayer.operators import clean as C
from assayer.operators import encode as E
from assayer.operators.dates import parse_dates
from assayer.plans.defaults import complete
from assayer.plans.ordered import successive
from assayer.plans.recipe import ColumnRecipe, Pipeline, apply_recipe
from assayer.sources.files import sanitise_unquoted

LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_SEL = [*LI_KEY, *MEASURES]
OD = lambda q: with_views("orders_dirty", q)
CTX = lambda q: with_views("customer_text", q)


def _od(s, d):
    return view(s, d, "orders_dirty")


def _ct(s, d):
    return view(s, d, "customer_text")


def _li(s, d):
    return load(s, d, "lineitem").select(*LI_SEL)


def _text_query(op):
    return lambda s, d: load(s, d, "customer").select("c_custkey", CT.TEXT[op](F.concat(F.lit(" "), "c_name", F.lit("  o'neil-é 12 "), F.lower("c_mktsegment"), F.lit("\t"))).alias("out"))


TEXT_IN = "concat(' ', c_name, '  o''neil-é 12 ', lower(c_mktsegment), chr(9))"


def _text_sql(expr):
    return f"SELECT c_custkey, {expr.replace('{x}', TEXT_IN)} AS out FROM customer"


def _cast(col, kind, table="customer_text", key="c_custkey", **kw):
    def run(s, d):
        df = view(s, d, table)
        from assayer.plans.columns import dtype
        return df.select(key, CT.CASTS[kind](as_col(col), dtype(df, col), **kw).alias("out"))
    return run


def _treated(method, threshold=1.5):
    def run(s, d):
        df = C.treat_outliers(_od(s, d).select("o_orderkey", "o_totalprice"), method, ["o_totalprice"], threshold)
        return rounded(df, 4)
    return run


def _scaled(method):
    return lambda s, d: rounded(C.scale(_od(s, d).select("o_orderkey", "o_totalprice"), method, ["o_totalprice"]))


def _filled(method):
    return lambda s, d: rounded(C.impute_ordered(view(s, d, "events_gaps"), method, "value", ["ts", "event_id"], ["user_id"]).select("event_id", "value"))


Q25 = "quantile_cont(CAST(o_totalprice AS DOUBLE), 0.25)"
Q75 = "quantile_cont(CAST(o_totalprice AS DOUBLE), 0.75)"


def _bounded(lo, hi, out, keep=""):
    """orders_dirty with its limits (lo, hi as aggregates) and the treated price."""
    return OD(r(f"SELECT o_orderkey, {out} AS o_totalprice FROM orders_dirty, (SELECT {lo} AS lo, {hi} AS hi FROM orders_dirty) {keep}", "o_totalprice", 4))


CLIP = "CASE WHEN o_totalprice < lo THEN lo WHEN o_totalprice > hi THEN hi ELSE o_totalprice END"
FENCE = (f"{Q25} - 1.5 * ({Q75} - {Q25})", f"{Q75} + 1.5 * ({Q75} - {Q25})")


def _scale_sql(expr):
    return OD(r(f"""SELECT o_orderkey, {expr} AS o_totalprice FROM orders_dirty, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi,
        max(abs(o_totalprice)) AS ma, {Q25} AS a, quantile_cont(CAST(o_totalprice AS DOUBLE), 0.5) AS med, {Q75} AS b FROM orders_dirty)""", "o_totalprice"))


def _ensemble(s, d):
    df = C.flag_outliers(_od(s, d).select("o_orderkey", "o_custkey", "o_totalprice"), ("iqr", "zscore"), vote="union")
    both = C.flag_outliers(_od(s, d).select("o_orderkey", "o_custkey", "o_totalprice"), ("iqr", "zscore"), vote="intersection")
    return df.groupBy("outlier_iqr", "outlier_zscore", "outlier").agg(F.count(F.lit(1)).alias("n")).unionByName(
        both.groupBy("outlier_iqr", "outlier_zscore", "outlier").agg(F.count(F.lit(1)).alias("n"))).withColumn("n", F.col("n"))


RECIPE = {
    "o_orderpriority": ColumnRecipe(text=("strip", "upper"), allowed=("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"), impute="most_frequent", encode="label"),
    "o_orderdate": ColumnRecipe(date_conversion=True, date_parts=("year", "dayofweek"), drop=True),
    "o_totalprice": ColumnRecipe(impute="median", outliers="iqr_cap", scale="robust"),
    "o_orderstatus": ColumnRecipe(encode="onehot"),
    "o_custkey": ColumnRecipe(interact_with=("o_orderkey",)),
}
RECIPE_SQL = f"""clean AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CASE WHEN upper(trim(o_orderpriority)) IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') THEN upper(trim(o_orderpriority)) END AS pr,
        try_strptime(o_orderdate, '%Y-%m-%d') AS dt FROM src),
    filled AS (SELECT o_orderkey, o_custkey, o_orderstatus, dt, coalesce(pr, (SELECT pr FROM clean WHERE pr IS NOT NULL GROUP BY pr ORDER BY count(*) DESC, pr LIMIT 1)) AS pr,
        coalesce(o_totalprice, (SELECT quantile_cont(CAST(o_totalprice AS DOUBLE), 0.5) FROM clean)) AS price FROM clean),
    lim AS (SELECT quantile_cont(price, 0.25) - 1.5 * (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) AS lo, quantile_cont(price, 0.75) + 1.5 * (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) AS hi FROM filled),
    capped AS (SELECT o_orderkey, o_custkey, o_orderstatus, dt, pr, CASE WHEN price < lo THEN lo WHEN price > hi THEN hi ELSE price END AS price FROM filled, lim),
    sc AS (SELECT quantile_cont(price, 0.5) AS med, quantile_cont(price, 0.75) - quantile_cont(price, 0.25) AS w FROM capped)
    SELECT o_orderkey, o_custkey, o_orderstatus = 'F' AS "o_orderstatus_F", o_orderstatus = 'O' AS "o_orderstatus_O", o_orderstatus = 'P' AS "o_orderstatus_P",
        round((price - med) / w, 6) + 0.0 AS o_totalprice, dense_rank() OVER (ORDER BY pr) - 1 AS o_orderpriority, CAST(year(dt) AS INTEGER) AS o_orderdate_year,
        CAST(isodow(dt) - 1 AS INTEGER) AS o_orderdate_dayofweek, o_custkey * o_orderkey AS o_custkey_x_o_orderkey FROM capped, sc"""


def _noted(s, d):
    """Dates as text: mixed formats, a format that days beyond twelve settle, and a text that is none."""
    day = lambda f: F.date_format("o_orderdate", f)
    k = F.col("o_orderkey")
    return load(s, d, "orders").select("o_orderkey", F.when(k % 3 == 0, day("yyyy-MM-dd")).when(k % 3 == 1, day("dd/MM/yyyy")).otherwise(day("d MMM yyyy")).alias("mixed"),
                                       day("dd-MM-yyyy").alias("settled"), F.when(k % 20 != 0, day("MM/dd/yyyy")).otherwise("unknown").alias("mostly"), "o_orderpriority")


def _gappy(s, d):
    k = F.col("o_orderkey")
    return load(s, d, "orders").select(
        "o_orderkey", F.when(k % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"), F.when(k % 5 != 0, F.exp(F.col("o_totalprice") / 50000)).alias("skewed"),
        F.when(k % 3 != 0, F.col("o_orderstatus")).alias("o_orderstatus"), F.when(k % 4 == 0, F.col("o_orderpriority")).alias("o_orderpriority"))


GAPPY = """g AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 5 <> 0 THEN exp(o_totalprice / 50000) END AS skewed,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS o_orderpriority FROM orders)"""


def _dirty_dup(s, d):
    od = _od(s, d)
    return od.unionByName(od.where("o_orderstatus = 'P'"))


SEL = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _rules(s, d):
    from assayer.catalog.fixtures import load as _load
    # the rules table is derived from the column names of the table at hand
    scores = E.f_class_scores(_load(s, d, "lineitem"), SEL, "l_returnflag")
    rules = scores.select("feature", F.when(F.col("feature") == "l_tax", "must_include").when(F.col("feature") == "l_quantity", "must_exclude")
                          .otherwise("preference").alias("rule_type"), F.lit(5).alias("priority")).where("feature <> 'l_discount'")
    return E.select_by_rules(scores, rules, 0.0, 3).select("feature", "reason", "tier")


def _votes(s, d):
    li = load(s, d, "lineitem")
    a = E.top_features(E.chi2_scores(li, SEL, "l_returnflag"), 2).select(F.lit("chi2").alias("selector"), "feature")
    b = E.top_features(E.f_class_scores(li, SEL, "l_returnflag"), 2).select(F.lit("f").alias("selector"), "feature")
    c = E.top_features(E.f_regression_scores(li, SEL[:1] + SEL[2:], "l_extendedprice"), 2).select(F.lit("fr").alias("selector"), "feature")
    return E.combine_selections(a.unionByName(b).unionByName(c), "vote")


CHI2 = "\nUNION ALL\n".join(f"SELECT '{c}' AS feature, sum(power(o - e, 2) / e) AS score FROM (SELECT sum({c}) AS o, (SELECT sum({c}) FROM lineitem) * count(*) / (SELECT count(*) FROM lineitem) AS e FROM lineitem GROUP BY l_returnflag)" for c in SEL)
FCLASS = "\nUNION ALL\n".join(f"""SELECT '{c}' AS feature, (sum(n * power(m - gm, 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS score
    FROM (SELECT count(*) AS n, avg({c}) AS m, var_pop({c}) AS v, (SELECT avg({c}) FROM lineitem) AS gm FROM lineitem GROUP BY l_returnflag)""" for c in SEL)
FREG = "\nUNION ALL\n".join(f"SELECT '{c}' AS feature, rr / (1 - rr) * (n - 2) AS score FROM (SELECT power(corr({c}, l_extendedprice), 2) AS rr, count(*) AS n FROM lineitem)" for c in SEL if c != "l_extendedprice")

QUERIES = {
    "sink_noquote_sanitise": lambda s, d: sanitise_unquoted(load(s, d, "documents"), ",").select("doc_id", "text", "lang", "source"),
    "dedup": lambda s, d: C.dedup(view(s, d, "orders_dup")),
    "dedup_subset": lambda s, d: C.dedup(load(s, d, "orders"), ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"]),
    "outlier_iqr": lambda s, d: C.remove_outliers_iqr(_li(s, d).withColumn("l_extendedprice", F.expr("IF(l_partkey % 11 = 0, NULL, l_extendedprice)")), MEASURES),
    "outlier_z": lambda s, d: C.remove_outliers_z(_li(s, d), MEASURES, 1.6),
    "outlier_ensemble": _ensemble,
    "project_drop": lambda s, d: load(s, d, "orders").drop("o_orderstatus", "o_orderdate"),
    "cast_int": _cast("balance_number", "int"), "cast_float": _cast("balance", "float"), "cast_str": _cast("c_custkey", "str"),
    "cast_bool": _cast("note", "bool"), "cast_datetime": _cast("signup_date", "datetime", fmt="%Y-%m-%d"),
    "text_strip": _text_query("strip"), "text_lower": _text_query("lower"), "text_upper": _text_query("upper"), "text_title": _text_query("title"),
    "text_remove_digits": _text_query("remove_digits"), "text_remove_punct": _text_query("remove_punctuation"), "text_collapse_ws": _text_query("remove_extra_spaces"),
    "text_regex_replace": lambda s, d: load(s, d, "customer").select("c_custkey", CT.regex_replace(F.col("c_name"), {r"^(\w+)#0*(\d)": r"\2:\1", "C": "K"}).alias("out")),
    "text_currency": lambda s, d: _ct(s, d).select("c_custkey", CT.TEXT["currency_to_numeric"](F.col("balance")).alias("out")),
    "text_clean_log": lambda s, d: _od(s, d).agg(F.count_distinct("o_orderpriority").alias("before"), F.count_distinct(CT.clean_text(F.col("o_orderpriority"), ("strip", "upper"))).alias("after")),
    "constraint_min": lambda s, d: load(s, d, "customer").select("c_custkey", clip(F.col("c_acctbal"), F.lit(0.0), None).alias("out")),
    "constraint_max": lambda s, d: _od(s, d).select("o_orderkey", clip(F.col("o_totalprice"), None, F.lit(250000.0)).alias("out")),
    "constraint_allowed": lambda s, d: _od(s, d).select("o_orderkey", CT.allowed(F.col("o_orderpriority"), ["1-URGENT", "5-LOW"]).alias("out")),
    "constraint_pattern": lambda s, d: _ct(s, d).select("c_custkey", CT.matching(F.col("email"), r"@example\.com$").alias("out")),
    **{f"date_part_{p}": (lambda p: lambda s, d: load(s, d, "events").select("event_id", CT.DATE_PARTS[p](F.col("ts")).cast("int").alias("out")))(p)
       for p in ("year", "month", "day", "dayofweek", "quarter", "hour", "minute")},
    "date_is_weekend": lambda s, d: load(s, d, "events").select("event_id", CT.DATE_PARTS["is_weekend"](F.col("ts")).alias("out")),
    "date_cyclic": lambda s, d: rounded(load(s, d, "events").select("event_id", *[e.alias(n) for n, e in CT.cyclic(F.col("ts"), "ts", True).items()])),
    "impute_mean": lambda s, d: rounded(C.impute(_od(s, d).select("o_orderkey", "o_totalprice"), "mean", ["o_totalprice"]), 4),
    "impute_median": lambda s, d: rounded(C.impute(_od(s, d).select("o_orderkey", "o_totalprice"), "median", ["o_totalprice"]), 4),
    "impute_mode": lambda s, d: C.impute(_ct(s, d).select("c_custkey", "note", "signup_date"), "most_frequent", ["note", "signup_date"]),
    "impute_const": lambda s, d: C.impute(_od(s, d).select("o_orderkey", "o_totalprice"), "constant", ["o_totalprice"], 0.0),
    "impute_interpolate": _filled("interpolate"), "impute_ffill": _filled("forward_fill"), "impute_bfill": _filled("backward_fill"),
    "col_out_remove": _treated("remove"), "col_out_cap": _treated("cap"), "col_out_winsorize": _treated("winsorize"), "col_out_iqr_cap": _treated("iqr_cap"),
    "col_out_z_cap": _treated("zscore_cap", 0.5), "col_out_null": _treated("null"),
    "tr_log": lambda s, d: rounded(C.transform(load(s, d, "customer").select("c_custkey", "c_acctbal"), "log", ["c_acctbal"])),
    "tr_log1p": lambda s, d: rounded(C.transform(load(s, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > -1, F.col("c_acctbal")).alias("c_acctbal")), "log1p", ["c_acctbal"])),
    "tr_sqrt": lambda s, d: rounded(C.transform(load(s, d, "customer").select("c_custkey", "c_acctbal"), "sqrt", ["c_acctbal"])),
    "tr_square": lambda s, d: rounded(C.transform(load(s, d, "customer").select("c_custkey", "c_acctbal"), "square", ["c_acctbal"]), 3), "tr_polynomial": lambda s, d: rounded(C.transform(_li(s, d).select(*LI_KEY, "l_quantity"), "polynomial", ["l_quantity"], 3), 4),
    "tr_reciprocal": lambda s, d: rounded(C.transform(_li(s, d).select(*LI_KEY, "l_discount"), "reciprocal", ["l_discount"])),
    "tr_boxcox": lambda s, d: rounded(C.power_transform(load(s, d, "orders").select("o_orderkey", "o_totalprice"), "boxcox", ["o_totalprice"])),
    "tr_yeojohnson": lambda s, d: rounded(C.power_transform(load(s, d, "customer").select("c_custkey", "c_acctbal"), "yeojohnson", ["c_acctbal"])),
    "sc_standard": _scaled("standard"), "sc_minmax": _scaled("minmax"), "sc_robust": _scaled("robust"), "sc_maxabs": _scaled("maxabs"),
    "sc_quantile_uniform": lambda s, d: rounded(C.scale(_od(s, d).select("o_orderkey", "o_totalprice"), "quantile_uniform", ["o_totalprice"]), 5), "sc_quantile_normal": _scaled("quantile_normal"),
    "bin_equal_width": lambda s, d: C.bin_equal_width(_od(s, d).select("o_orderkey", "o_totalprice"), "o_totalprice", 7).drop("o_totalprice"),
    "bin_equal_freq": lambda s, d: C.bin_quantile(_li(s, d).select(*LI_KEY, "l_discount"), "l_discount", 20),
    "bin_quantile": lambda s, d: C.bin_quantile(_od(s, d).select("o_orderkey", "o_totalprice"), "o_totalprice", 5, False).drop("o_totalprice"),
    "bin_kmeans": lambda s, d: C.bin_kmeans(load(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 4),
    "enc_onehot": lambda s, d: E.one_hot(load(s, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus"),
    "enc_label": lambda s, d: E.label(load(s, d, "part").select("p_partkey", "p_brand"), "p_brand"),
    "enc_ordinal": lambda s, d: E.ordinal(_od(s, d).select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]),
    "enc_binary": lambda s, d: E.binary(load(s, d, "part").select("p_partkey", "p_brand"), "p_brand"),
    "enc_frequency": lambda s, d: E.frequency(load(s, d, "part").select("p_partkey", "p_name"), "p_name"),
    "enc_target": lambda s, d: rounded(E.target(_od(s, d).select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderpriority", "o_totalprice"), 4),
    "enc_mean": lambda s, d: rounded(E.target(load(s, d, "part").select("p_partkey", "p_name", "p_retailprice"), "p_name", "p_retailprice"), 4),
    "enc_target_smooth": lambda s, d: rounded(E.target(load(s, d, "part").select("p_partkey", "p_name", "p_retailprice"), "p_name", "p_retailprice", 10.0), 4),
    "enc_target_oof": lambda s, d: rounded(E.target_out_of_fold(load(s, d, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice"), "p_brand", "p_retailprice", "p_type"), 7),
    "enc_binary_adv": lambda s, d: E.binary(load(s, d, "documents").select("doc_id", "source"), "source"),
    "enc_hash": lambda s, d: E.hashed(load(s, d, "part").select("p_partkey", "p_name"), "p_name"),
    "feat_interaction": lambda s, d: rounded(E.interaction(_li(s, d).select(*LI_KEY, "l_quantity", "l_discount"), [("l_quantity", "l_discount")])),
    "feat_lag": lambda s, d: E.lag_features(load(s, d, "events").select("event_id", "ts", "user_id", "value"), ["ts", "event_id"], ["user_id"], ["value"]),
    "feat_lag_global": lambda s, d: E.lag_features(load(s, d, "events").select("event_id", "ts", "value"), ["ts", "event_id"], (), ["value"]),
    "feat_cyclic": lambda s, d: rounded(E.cyclic_dates(load(s, d, "orders").select("o_orderkey", "o_orderdate")).drop("o_orderdate")),
    "sel_chi2": lambda s, d: rounded(E.chi2_scores(load(s, d, "lineitem"), SEL, "l_returnflag"), 4),
    "sel_f": lambda s, d: rounded(E.f_class_scores(load(s, d, "lineitem"), SEL, "l_returnflag").withColumn("kind", F.lit("class")).unionByName(
        E.f_regression_scores(load(s, d, "lineitem"), SEL[:1] + SEL[2:], "l_extendedprice").withColumn("kind", F.lit("regression"))), 2),
    "sel_mi": lambda s, d: rounded(E.mutual_information(load(s, d, "lineitem"), SEL, "l_returnflag")),
    "sel_mi_regression": lambda s, d: rounded(E.mutual_information(load(s, d, "lineitem"), [c for c in SEL if c != "l_extendedprice"], "l_extendedprice", target_bins=10)),
    "sel_rules": _rules, "sel_vote": _votes,
    "recipe_apply": lambda s, d: rounded(apply_recipe(_od(s, d), RECIPE)),
    "pipeline_clean": lambda s, d: rounded(Pipeline.standard(RECIPE).run(_dirty_dup(s, d))),
    "custom_step": lambda s, d: Pipeline().add("keep_open", lambda df: df.where("o_orderstatus = 'O'")).add("flag", lambda df: df.withColumn("big", F.col("o_totalprice") > 200000)).remove("flag").run(load(s, d, "orders")),
    "clean_log": lambda s, d: Pipeline.standard(RECIPE).run_logged(_dirty_dup(s, d))[1],
    "opt_low_variance": lambda s, d: C.drop_low_variance(view(s, d, "const_cols").select("p_partkey", "p_size", "constant_number"), .01),
    "opt_drop_missing": lambda s, d: C.drop_missing(view(s, d, "const_cols").select("p_partkey", "p_brand", "empty_text")),
    "opt_skew": lambda s, d: rounded(C.correct_skew(_od(s, d).select("o_orderkey", "o_totalprice"), ["o_totalprice"], 1.0)),
    "opt_downcast": lambda s, d: s.createDataFrame(C.downcast(load(s, d, "lineitem")).dtypes, "column_name string, type string"),
    "opt_bucket_rare": lambda s, d: C.bucket_rare(load(s, d, "part").select("p_partkey", "p_name"), "p_name", 10),
    "opt_date_parse": lambda s, d: parse_dates(_noted(s, d)),
    "opt_global_impute": lambda s, d: rounded(apply_recipe(_gappy(s, d), complete(_gappy(s, d), {}, ["o_orderkey"], scaling=None, encoding=None))),
    "opt_global_scale": lambda s, d: rounded(apply_recipe(_gappy(s, d), complete(_gappy(s, d), {"o_totalprice": ColumnRecipe(scale="minmax")}, ["o_orderkey"], None, None, encoding=None))),
    "opt_global_encode": lambda s, d: rounded(apply_recipe(_gappy(s, d), complete(_gappy(s, d), {}, ["o_orderkey"], None, None, scaling=None, max_cardinality=4))),
    # relational surface
    "rel_scan_filter": lambda s, d: load(s, d, "lineitem").where("l_quantity > 30 AND l_discount < 0.05 AND l_returnflag = 'R'").select(*LI_KEY, "l_quantity"),
    "rel_group_agg": lambda s, d: rounded(load(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("avg_quantity"), F.sum("l_extendedprice").alias("sum_price")), 2),
    "rel_lookup_join": lambda s, d: load(s, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders")).join(load(s, d, "customer").select("c_custkey", "c_mktsegment"), F.expr("o_custkey = c_custkey"), "left").select("o_custkey", "n_orders", "c_mktsegment"),
    "rel_overlap_join": lambda s, d: view(s, d, "events_ref").groupBy(F.col("event_type").alias("v")).agg(F.count(F.lit(1)).alias("n_ref")).join(
        view(s, d, "events_cur").groupBy(F.col("event_type").alias("v")).agg(F.count(F.lit(1)).alias("n_cur")), "v", "full_outer").select("v", "n_ref", "n_cur"),
    "rel_append_columns": lambda s, d: rounded(load(s, d, "part").select("*", (F.col("p_retailprice") * 1.1).alias("gross"), F.length("p_name").alias("name_length"))),
    "rel_union": lambda s, d: view(s, d, "events_ref").unionByName(view(s, d, "events_cur")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")),
    "rel_distinct": lambda s, d: view(s, d, "orders_dup").dropDuplicates().groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")),
    "rel_sort": lambda s, d: load(s, d, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey"),
    "rel_topk": lambda s, d: load(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10),
    "rel_limit": lambda s, d: load(s, d, "orders").orderBy("o_orderkey").limit(100).select("o_orderkey", "o_custkey"),
    "rel_window_offset": lambda s, d: rounded(successive(load(s, d, "events").select("event_id", "ts", "user_id", "value"), "value", ["ts", "event_id"], ["user_id"]).select("event_id", (F.col("value") - F.col("before")).alias("diff"))),
    "rel_to_json": lambda s, d: load(s, d, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.min("n_name").alias("first_name")).select("n_regionkey", F.to_json(F.struct("n", "first_name")).alias("doc")),
}

_EV = "events_gaps"
SQL = {
    "opt_date_parse": "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS mixed, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS settled, CASE WHEN o_orderkey % 20 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS mostly, o_orderpriority FROM orders",
    "opt_global_impute": r(f"WITH {GAPPY} SELECT o_orderkey, coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM g)) AS o_totalprice, coalesce(skewed, (SELECT quantile_cont(skewed, 0.5) FROM g)) AS skewed, coalesce(o_orderstatus, (SELECT o_orderstatus FROM g WHERE o_orderstatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderstatus, coalesce(o_orderpriority, 'missing') AS o_orderpriority FROM g", "o_totalprice skewed"),
    "opt_global_scale": r(f"WITH {GAPPY} SELECT o_orderkey, (o_totalprice - (SELECT min(o_totalprice) FROM g)) / (SELECT max(o_totalprice) - min(o_totalprice) FROM g) AS o_totalprice, (skewed - (SELECT avg(skewed) FROM g)) / (SELECT stddev_pop(skewed) FROM g) AS skewed, o_orderstatus, o_orderpriority FROM g", "o_totalprice skewed"),
    "opt_global_encode": r(f"WITH {GAPPY} SELECT o_orderkey, o_totalprice, skewed, coalesce(o_orderstatus = 'F', false) AS \"o_orderstatus_F\", coalesce(o_orderstatus = 'O', false) AS \"o_orderstatus_O\", coalesce(o_orderstatus = 'P', false) AS \"o_orderstatus_P\", o_orderpriority FROM g", "skewed"),
    "sink_noquote_sanitise": "SELECT doc_id, " + ", ".join(f"replace(replace(replace({c}, ',', '_'), '''', ''), '\"', '') AS {c}" for c in ("text", "lang", "source")) + " FROM documents",
    "dedup": with_views("orders_dup", "SELECT DISTINCT * FROM orders_dup"),
    "dedup_subset": "SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS rk FROM orders) WHERE rk = 1",
    "outlier_iqr": f"WITH t AS (SELECT {', '.join(c if c != 'l_extendedprice' else 'CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice' for c in LI_SEL)} FROM lineitem), q AS (SELECT "
        + ", ".join(f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}" for c in MEASURES) + " FROM t) SELECT t.* FROM t, q WHERE "
        + " AND ".join(f"{c} >= a_{c} - 1.5 * (b_{c} - a_{c}) AND {c} <= b_{c} + 1.5 * (b_{c} - a_{c})" for c in MEASURES),
    "outlier_z": f"SELECT {', '.join('t.' + c for c in LI_SEL)} FROM lineitem t, (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in MEASURES) + " FROM lineitem) WHERE "
        + " AND ".join(f"abs({c} - m_{c}) / s_{c} <= 1.6" for c in MEASURES),
    "outlier_ensemble": OD(f"""SELECT i AS outlier_iqr, z AS outlier_zscore, v AS outlier, count(*) AS n FROM (SELECT *, unnest([{{'v': i OR z, 'k': 1}}, {{'v': i AND z, 'k': 2}}], recursive := true) FROM (SELECT
        coalesce(o_totalprice < qa - 1.5 * (qb - qa) OR o_totalprice > qb + 1.5 * (qb - qa), false) OR o_custkey < ca - 1.5 * (cb - ca) OR o_custkey > cb + 1.5 * (cb - ca) OR o_orderkey < ka - 1.5 * (kb - ka) OR o_orderkey > kb + 1.5 * (kb - ka) AS i,
        coalesce(abs(o_totalprice - m) / s > 3, false) OR abs(o_custkey - cm) / cs > 3 OR abs(o_orderkey - km) / ks > 3 AS z
        FROM orders_dirty, (SELECT {Q25} AS qa, {Q75} AS qb, quantile_cont(CAST(o_custkey AS DOUBLE), 0.25) AS ca, quantile_cont(CAST(o_custkey AS DOUBLE), 0.75) AS cb, quantile_cont(CAST(o_orderkey AS DOUBLE), 0.25) AS ka, quantile_cont(CAST(o_orderkey AS DOUBLE), 0.75) AS kb,
            avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s, avg(o_custkey) AS cm, stddev_samp(o_custkey) AS cs, avg(o_orderkey) AS km, stddev_samp(o_orderkey) AS ks FROM orders_dirty))) GROUP BY i, z, v, k"""),
    "project_drop": "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders",
    "cast_int": CTX("SELECT c_custkey, TRY_CAST(balance_number AS BIGINT) AS out FROM customer_text"),
    "cast_float": CTX("SELECT c_custkey, TRY_CAST(balance AS DOUBLE) AS out FROM customer_text"),
    "cast_str": CTX("SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS out FROM customer_text"),
    "cast_bool": CTX("SELECT c_custkey, length(note) > 0 AS out FROM customer_text"),
    "cast_datetime": CTX("SELECT c_custkey, try_strptime(signup_date, '%Y-%m-%d') AS out FROM customer_text"),
    "text_strip": _text_sql("regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"), "text_lower": _text_sql("lower({x})"), "text_upper": _text_sql("upper({x})"),
    "text_title": _text_sql("list_reduce(list_transform(regexp_extract_all({x}, '([A-Za-z]+|[^A-Za-z]+)', 1), lambda w: upper(w[1]) || lower(w[2:])), lambda a, b: a || b)"),
    "text_remove_digits": _text_sql("regexp_replace({x}, '[0-9]+', '', 'g')"), "text_remove_punct": _text_sql("regexp_replace({x}, '[^\\p{L}\\p{N}_\\s]', '', 'g')"),
    "text_collapse_ws": _text_sql("regexp_replace({x}, '\\s+', ' ', 'g')"),
    "text_regex_replace": "SELECT c_custkey, replace(regexp_replace(c_name, '^(\\w+)#0*(\\d)', '\\2:\\1', 'g'), 'C', 'K') AS out FROM customer",
    "text_currency": CTX("SELECT c_custkey, TRY_CAST(regexp_replace(balance, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS out FROM customer_text"),
    "text_clean_log": OD("SELECT count(DISTINCT o_orderpriority) AS before, count(DISTINCT upper(trim(o_orderpriority))) AS after FROM orders_dirty"),
    "constraint_min": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS out FROM customer",
    "constraint_max": OD("SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 250000.0 ELSE o_totalprice END AS out FROM orders_dirty"),
    "constraint_allowed": OD("SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN o_orderpriority END AS out FROM orders_dirty"),
    "constraint_pattern": CTX("SELECT c_custkey, CASE WHEN email LIKE '%@example.com' THEN email END AS out FROM customer_text"),
    **{f"date_part_{p}": f"SELECT event_id, CAST({e} AS INTEGER) AS out FROM events" for p, e in {"year": "year(ts)", "month": "month(ts)", "day": "day(ts)", "dayofweek": "isodow(ts) - 1", "quarter": "quarter(ts)", "hour": "hour(ts)", "minute": "minute(ts)"}.items()},
    "date_is_weekend": "SELECT event_id, CAST(isodow(ts) >= 6 AS INTEGER) AS out FROM events",
    "date_cyclic": r("SELECT event_id, " + ", ".join(f"{f}(2 * pi() * {e}) AS ts_{n}_{f}" for n, e in {"month": "month(ts) / 12", "dow": "(isodow(ts) - 1) / 7", "hour": "hour(ts) / 24"}.items() for f in ("sin", "cos")) + " FROM events",
        "ts_month_sin ts_month_cos ts_dow_sin ts_dow_cos ts_hour_sin ts_hour_cos"),
    "impute_mean": OD(r("SELECT o_orderkey, coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM orders_dirty)) AS o_totalprice FROM orders_dirty", "o_totalprice", 4)),
    "impute_median": OD(r("SELECT o_orderkey, coalesce(o_totalprice, (SELECT quantile_cont(CAST(o_totalprice AS DOUBLE), 0.5) FROM orders_dirty)) AS o_totalprice FROM orders_dirty", "o_totalprice", 4)),
    "impute_mode": CTX("SELECT c_custkey, " + ", ".join(f"coalesce({c}, (SELECT {c} FROM customer_text WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS {c}" for c in ("note", "signup_date")) + " FROM customer_text"),
    "impute_const": OD("SELECT o_orderkey, coalesce(o_totalprice, 0.0) AS o_totalprice FROM orders_dirty"),
    "impute_ffill": with_views(_EV, r("SELECT event_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM events_gaps", "value")),
    "impute_bfill": with_views(_EV, r("SELECT event_id, first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM events_gaps", "value")),
    "impute_interpolate": with_views(_EV, r("""SELECT event_id, CASE WHEN value IS NOT NULL THEN value WHEN pv IS NULL THEN NULL WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * (i - pi) / (ni - pi) END AS value FROM (
        SELECT *, last_value(value IGNORE NULLS) OVER b AS pv, first_value(value IGNORE NULLS) OVER f AS nv, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER f AS ni
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events_gaps)
        WINDOW b AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""", "value")),
    "col_out_remove": _bounded(*FENCE, "o_totalprice", "WHERE NOT coalesce(o_totalprice < lo OR o_totalprice > hi, false)"),
    "col_out_cap": _bounded("quantile_cont(CAST(o_totalprice AS DOUBLE), 0.01)", "quantile_cont(CAST(o_totalprice AS DOUBLE), 0.99)", CLIP),
    "col_out_winsorize": OD(r(f"SELECT o_orderkey, {CLIP} AS o_totalprice FROM orders_dirty, (SELECT min(v) FILTER (rk = CAST(floor(0.01 * n) AS BIGINT) + 1) AS lo, min(v) FILTER (rk = n - CAST(floor(0.01 * n) AS BIGINT)) AS hi FROM (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS rk, count(*) OVER () AS n FROM orders_dirty WHERE o_totalprice IS NOT NULL))", "o_totalprice", 4)),
    "col_out_iqr_cap": _bounded(*FENCE, CLIP),
    "col_out_z_cap": _bounded("avg(o_totalprice) - 0.5 * stddev_samp(o_totalprice)", "avg(o_totalprice) + 0.5 * stddev_samp(o_totalprice)", CLIP),
    "col_out_null": _bounded(*FENCE, "CASE WHEN o_totalprice >= lo AND o_totalprice <= hi THEN o_totalprice END"),
    "tr_log": r("SELECT c_custkey, ln(c_acctbal - lo + 1) AS c_acctbal FROM customer, (SELECT min(c_acctbal) AS lo FROM customer)", "c_acctbal"),
    "tr_log1p": r("SELECT c_custkey, CASE WHEN c_acctbal > -1 THEN ln(1 + c_acctbal) END AS c_acctbal FROM customer", "c_acctbal"),
    "tr_sqrt": r("SELECT c_custkey, sqrt(c_acctbal - lo) AS c_acctbal FROM customer, (SELECT min(c_acctbal) AS lo FROM customer)", "c_acctbal"),
    "tr_square": r("SELECT c_custkey, c_acctbal * c_acctbal AS c_acctbal FROM customer", "c_acctbal", 3),
    "tr_polynomial": r(f"SELECT {', '.join(LI_KEY)}, power(l_quantity, 3) AS l_quantity FROM lineitem", "l_quantity", 4),
    "tr_reciprocal": r(f"SELECT {', '.join(LI_KEY)}, 1 / nullif(l_discount, 0) AS l_discount FROM lineitem", "l_discount"),
    "sc_standard": _scale_sql("(o_totalprice - m) / s"), "sc_minmax": _scale_sql("(o_totalprice - lo) / (hi - lo)"), "sc_robust": _scale_sql("(o_totalprice - med) / (b - a)"), "sc_maxabs": _scale_sql("o_totalprice / ma"),
    "sc_quantile_uniform": OD(r("""SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN NULL WHEN o_totalprice <= q[1] THEN 0.0 WHEN o_totalprice >= q[1000] THEN 1.0
        ELSE (lo - 1 + (o_totalprice - q[lo]) / (q[lo + 1] - q[lo])) / 999 END AS o_totalprice
        FROM (SELECT o_orderkey, o_totalprice, q, len(list_filter(q, lambda v: v <= o_totalprice)) AS lo FROM orders_dirty, (SELECT quantile_cont(CAST(o_totalprice AS DOUBLE), [""" + ", ".join(f"CAST({i} AS DOUBLE) / 999" for i in range(1000)) + """]) AS q FROM orders_dirty))""", "o_totalprice", 5)),
    "bin_equal_width": OD("SELECT o_orderkey, CAST(CASE WHEN o_totalprice IS NULL THEN NULL ELSE greatest(ceil((o_totalprice - lo) / ((hi - lo) / 7)) - 1, 0) END AS INTEGER) AS o_totalprice_binned FROM orders_dirty, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders_dirty)"),
    "bin_equal_freq": f"SELECT {', '.join(LI_KEY)}, l_discount, CAST(len(list_filter(e[2:-2], lambda v: v < l_discount)) AS INTEGER) AS l_discount_binned FROM lineitem, (SELECT list_sort(list_distinct(quantile_cont(l_discount, [{', '.join(str(i / 20) for i in range(21))}]))) AS e FROM lineitem)",
    "bin_quantile": OD(f"SELECT o_orderkey, CASE WHEN o_totalprice IS NOT NULL THEN CAST(len(list_filter(e, lambda v: v < o_totalprice)) AS INTEGER) END AS o_totalprice_binned FROM orders_dirty, (SELECT quantile_cont(CAST(o_totalprice AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS e FROM orders_dirty)"),
    "enc_onehot": "SELECT o_orderkey, coalesce(o_orderstatus = 'F', false) AS \"o_orderstatus_F\", coalesce(o_orderstatus = 'O', false) AS \"o_orderstatus_O\", o_orderstatus = 'P' AS \"o_orderstatus_P\" FROM orders",
    "enc_label": "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brand FROM part",
    "enc_ordinal": OD("SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECIFIED' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 WHEN '1-URGENT' THEN 4 ELSE -1 END AS BIGINT) AS o_orderpriority FROM orders_dirty"),
    "enc_binary": "SELECT p_partkey, " + ", ".join(f"(c >> {i}) & 1 AS p_brand_binary_{i}" for i in range(5)) + " FROM (SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS c FROM part)",
    "enc_frequency": "SELECT p_partkey, count(*) OVER (PARTITION BY p_name) AS p_name FROM part",
    "enc_target": OD(r("SELECT o_orderkey, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS o_orderpriority, o_totalprice FROM orders_dirty", "o_orderpriority o_totalprice", 4)),
    "enc_mean": r("SELECT p_partkey, avg(p_retailprice) OVER (PARTITION BY p_name) AS p_name, p_retailprice FROM part", "p_name p_retailprice", 4),
    "enc_target_smooth": r("SELECT p_partkey, (sum(p_retailprice) OVER (PARTITION BY p_name) + 10 * (SELECT avg(p_retailprice) FROM part)) / (count(*) OVER (PARTITION BY p_name) + 10) AS p_name, p_retailprice FROM part", "p_name p_retailprice", 4),
    "enc_target_oof": r("SELECT p_partkey, (sum(p_retailprice) OVER (PARTITION BY p_brand) - sum(p_retailprice) OVER (PARTITION BY p_brand, p_type)) / nullif(count(*) OVER (PARTITION BY p_brand) - count(*) OVER (PARTITION BY p_brand, p_type), 0) AS p_brand, p_type, p_retailprice FROM part", "p_brand p_retailprice", 7),
    "enc_binary_adv": "SELECT doc_id, " + ", ".join(f"(c >> {i}) & 1 AS source_binary_{i}" for i in range(5)) + " FROM (SELECT doc_id, dense_rank() OVER (ORDER BY source) - 1 AS c FROM documents)",
    "feat_interaction": r(f"SELECT {', '.join(LI_KEY)}, l_quantity, l_discount, l_quantity * l_discount AS l_quantity_x_l_discount FROM lineitem", "l_quantity l_discount l_quantity_x_l_discount"),
    "feat_lag": "SELECT event_id, ts, user_id, value, " + ", ".join(f"lag(value, {k}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value_lag_{k}" for k in (1, 7, 30)) + " FROM events",
    "feat_lag_global": "SELECT event_id, ts, value, " + ", ".join(f"lag(value, {k}) OVER (ORDER BY ts, event_id) AS value_lag_{k}" for k in (1, 7, 30)) + " FROM events",
    "feat_cyclic": r("SELECT o_orderkey, " + ", ".join(f"{f}(2 * pi() * {e}) AS o_orderdate_{n}_{f}" for n, e in {"month": "month(o_orderdate) / 12", "dow": "(isodow(o_orderdate) - 1) / 7"}.items() for f in ("sin", "cos")) + " FROM orders",
        "o_orderdate_month_sin o_orderdate_month_cos o_orderdate_dow_sin o_orderdate_dow_cos"),
    "sel_chi2": r(CHI2, "score", 4),
    "sel_f": r(f"SELECT *, 'class' AS kind FROM ({FCLASS}) UNION ALL SELECT *, 'regression' FROM ({FREG})", "score", 2),
    "sel_mi": r("\nUNION ALL\n".join(f"""SELECT '{c}' AS feature, sum(o / n * ln(o * n / (nb * ny))) AS score FROM (SELECT DISTINCT b, y, CAST(count(*) OVER (PARTITION BY b, y) AS DOUBLE) AS o, CAST(count(*) OVER (PARTITION BY b) AS DOUBLE) AS nb, count(*) OVER (PARTITION BY y) AS ny, count(*) OVER () AS n
        FROM (SELECT l_returnflag AS y, least(floor(({c} - lo) / ((hi - lo) / 10)), 9) AS b FROM lineitem, (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem)))""" for c in SEL), "score"),
    "sel_mi_regression": r("\nUNION ALL\n".join(f"""SELECT '{c}' AS feature, sum(o / n * ln(o * n / (nb * ny))) AS score FROM (SELECT DISTINCT b, y, CAST(count(*) OVER (PARTITION BY b, y) AS DOUBLE) AS o, CAST(count(*) OVER (PARTITION BY b) AS DOUBLE) AS nb, count(*) OVER (PARTITION BY y) AS ny, count(*) OVER () AS n
        FROM (SELECT least(floor((l_extendedprice - ly) / ((hy - ly) / 10)), 9) AS y, least(floor(({c} - lo) / ((hi - lo) / 10)), 9) AS b FROM lineitem, (SELECT min({c}) AS lo, max({c}) AS hi, min(l_extendedprice) AS ly, max(l_extendedprice) AS hy FROM lineitem)))""" for c in SEL if c != "l_extendedprice"), "score"),
    "sel_rules": f"""SELECT feature, CASE feature WHEN 'l_tax' THEN 'must_include' WHEN 'l_discount' THEN 'score' ELSE 'preference' END AS reason, CASE feature WHEN 'l_tax' THEN 0 WHEN 'l_discount' THEN 2 ELSE 1 END AS tier
        FROM ({FCLASS}) WHERE feature <> 'l_quantity' ORDER BY tier, score DESC LIMIT 3""",
    "sel_vote": f"""SELECT feature, count(*) AS votes FROM (SELECT * FROM (SELECT feature FROM ({CHI2}) ORDER BY score DESC LIMIT 2) UNION ALL SELECT * FROM (SELECT feature FROM ({FCLASS}) ORDER BY score DESC LIMIT 2)
        UNION ALL SELECT * FROM (SELECT feature FROM ({FREG}) ORDER BY score DESC LIMIT 2)) GROUP BY 1 HAVING count(*) * 2 > 3""",
    "recipe_apply": OD(f"WITH src AS (SELECT * FROM orders_dirty), {RECIPE_SQL}"),
    "pipeline_clean": OD("""WITH src AS (SELECT DISTINCT t.* FROM (SELECT * FROM orders_dirty UNION ALL SELECT * FROM orders_dirty WHERE o_orderstatus = 'P') t,
        (SELECT quantile_cont(CAST(o_totalprice AS DOUBLE), 0.25) AS a, quantile_cont(CAST(o_totalprice AS DOUBLE), 0.75) AS b, quantile_cont(CAST(o_custkey AS DOUBLE), 0.25) AS ca, quantile_cont(CAST(o_custkey AS DOUBLE), 0.75) AS cb,
            quantile_cont(CAST(o_orderkey AS DOUBLE), 0.25) AS ka, quantile_cont(CAST(o_orderkey AS DOUBLE), 0.75) AS kb FROM orders_dirty)
        WHERE o_totalprice BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) AND o_custkey BETWEEN ca - 1.5 * (cb - ca) AND cb + 1.5 * (cb - ca) AND o_orderkey BETWEEN ka - 1.5 * (kb - ka) AND kb + 1.5 * (kb - ka)), """ + RECIPE_SQL),
    "custom_step": "SELECT * FROM orders WHERE o_orderstatus = 'O'",
    "clean_log": OD("""SELECT 0 AS at, 'input' AS step, (SELECT count(*) FROM orders_dirty) + (SELECT count(*) FROM orders_dirty WHERE o_orderstatus = 'P') AS rows, 6 AS columns UNION ALL SELECT 1, 'dedup', (SELECT count(*) FROM orders_dirty), 6
        UNION ALL SELECT 2 + k, CASE k WHEN 0 THEN 'outliers' ELSE 'recipe' END, n, CASE k WHEN 0 THEN 6 ELSE 10 END FROM (SELECT unnest([0, 1]) AS k), (SELECT count(*) AS n FROM orders_dirty,
            (SELECT quantile_cont(CAST(o_totalprice AS DOUBLE), 0.25) AS a, quantile_cont(CAST(o_totalprice AS DOUBLE), 0.75) AS b FROM orders_dirty) WHERE o_totalprice BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a))"""),
    "opt_low_variance": "SELECT p_partkey, p_size FROM part", "opt_drop_missing": "SELECT p_partkey, p_brand FROM part",
    "opt_skew": OD(r("SELECT o_orderkey, ln(1 + o_totalprice - least((SELECT min(o_totalprice) FROM orders_dirty), 0)) AS o_totalprice FROM orders_dirty", "o_totalprice")),
    "opt_downcast": "\nUNION ALL\n".join([f"""SELECT '{c}' AS column_name, CASE WHEN min({c}) >= -128 AND max({c}) < 128 THEN 'tinyint' WHEN min({c}) >= -32768 AND max({c}) < 32768 THEN 'smallint'
        WHEN min({c}) >= -2147483648 AND max({c}) < 2147483648 THEN 'int' ELSE 'bigint' END AS type FROM lineitem""" for c in LI_KEY] + ["""SELECT column_name, CASE data_type WHEN 'VARCHAR' THEN 'string'
        WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END FROM duckdb_columns() WHERE table_name = 'lineitem' AND data_type NOT IN ('BIGINT', 'INTEGER')"""]),
    "opt_bucket_rare": "SELECT p_partkey, CASE WHEN p_name IN (SELECT p_name FROM part GROUP BY 1 ORDER BY count(*) DESC, p_name LIMIT 10) THEN p_name ELSE 'other' END AS p_name FROM part",
    "rel_scan_filter": f"SELECT {', '.join(LI_KEY)}, l_quantity FROM lineitem WHERE l_quantity > 30 AND l_discount < 0.05 AND l_returnflag = 'R'",
    "rel_group_agg": r("SELECT l_returnflag, l_linestatus, count(*) AS n, avg(l_quantity) AS avg_quantity, sum(l_extendedprice) AS sum_price FROM lineitem GROUP BY 1, 2", "avg_quantity sum_price", 2),
    "rel_lookup_join": "SELECT o_custkey, n_orders, c_mktsegment FROM (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) LEFT JOIN customer ON o_custkey = c_custkey",
    "rel_overlap_join": with_views("events_ref events_cur", "SELECT coalesce(a.v, b.v) AS v, n_ref, n_cur FROM (SELECT event_type AS v, count(*) AS n_ref FROM events_ref GROUP BY 1) a FULL JOIN (SELECT event_type AS v, count(*) AS n_cur FROM events_cur GROUP BY 1) b ON a.v = b.v"),
    "rel_append_columns": r("SELECT *, p_retailprice * 1.1 AS gross, CAST(length(p_name) AS INTEGER) AS name_length FROM part", "p_retailprice gross"),
    "rel_union": with_views("events_ref events_cur", "SELECT event_type, count(*) AS n FROM (SELECT * FROM events_ref UNION ALL SELECT * FROM events_cur) GROUP BY 1"),
    "rel_distinct": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1",
    "rel_sort": "SELECT * FROM supplier ORDER BY s_acctbal DESC, s_suppkey", "rel_topk": "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "rel_limit": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100",
    "rel_window_offset": r("SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS diff FROM events", "diff"),
    "rel_to_json": "SELECT n_regionkey, concat('{\"n\":', count(*), ',\"first_name\":\"', min(n_name), '\"}') AS doc FROM nation GROUP BY 1",
}
