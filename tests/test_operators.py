"""Edge cases and invariants of the operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayer.functions import columns_text as CT
from assayer.functions import distributions as DI
from assayer.operators import anomaly as AN
from assayer.operators import assume as A
from assayer.operators import clean as C
from assayer.operators import encode as E
from assayer.operators import evaluate as EV
from assayer.operators import infer as I
from assayer.operators import knn as N
from assayer.operators import models as M
from assayer.operators import profile as P
from assayer.operators import quality as Q
from assayer.operators import sample as S
from assayer.plans.recipe import ColumnRecipe, Pipeline, apply_recipe


@pytest.fixture(scope="module")
def demo(spark):
    n = 1000
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": np.arange(n), "date_str": ["2024-01-02", "2024-02-03", "2024-03-04", "2024-01-02"] * 250, "numeric_str": [str(i % 77) for i in range(n)],
                        "category": ["A", "B", "C", "A"] * 250, "salary": rng.normal(100, 15, n), "constant": ["x"] * n})
    pdf.loc[:9, "salary"] = np.nan
    return spark.createDataFrame(pdf).withColumn("salary", F.when(~F.isnan("salary"), F.col("salary"))).withColumn("empty", F.lit(None).cast("string"))


def test_inferred_types(demo):
    got = {r["column_name"]: r["inferred_type"] for r in I.infer(demo).collect()}
    assert got == {"id": "numeric", "date_str": "datetime", "numeric_str": "numeric", "category": "categorical", "salary": "numeric",
                   "constant": "categorical", "empty": "empty"}


def test_profile_and_recipe(demo):
    rec = {r["column_name"]: r for r in P.recipe(P.profile(demo)).collect()}
    assert rec["id"]["drop_column"] and rec["salary"]["imputation"] == "median" and rec["category"]["encoding"] == "onehot" and rec["date_str"]["date_conversion"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, b string")
    assert {r["column_name"]: r["count"] for r in P.counts(df).collect()} == {"a": 0, "b": 0}
    assert [r["severity"] for r in Q.validate(df).collect()] == ["critical"]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "a double")
    assert P.numeric(df).first()["mean"] == 2.0


def test_constant_columns(spark):
    df = spark.createDataFrame([(5.0, float(i)) for i in range(10)], "c double, x double")
    assert P.outliers_z(df).where("column_name = 'c'").first()["outliers"] == 0
    assert C.remove_outliers_z(df).count() == 10
    for how in ("standard", "minmax", "robust"):
        assert C.scale(df, how, ["c"]).agg(F.max("c")).first()[0] == 0.0


def test_text_and_casts(spark):
    df = spark.createDataFrame([("  O'neil foo-bar 12 ", "3.5", "x"), (None, "4", "")], "t string, n string, b string")
    row = df.select(CT.clean_text(F.col("t"), ["strip", "title"]).alias("t"), CT.cast_int(F.col("n"), df.schema["n"].dataType).alias("n"),
                    CT.cast_bool(F.col("b"), df.schema["b"].dataType).alias("b")).collect()
    assert row[0]["t"] == "O'Neil Foo-Bar 12" and row[0]["n"] is None and row[0]["b"] is True
    assert row[1]["t"] is None and row[1]["n"] == 4 and row[1]["b"] is False


def test_binary_encoding_bits(spark):
    two = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    assert E.binary(two, "c").columns == ["c_binary_0"]
    assert E.binary(two.where("c = 'a'"), "c").columns == []


def test_quantile_bins_with_repeated_edges(spark):
    df = spark.createDataFrame([(1.0,)] * 50 + [(float(i),) for i in range(50)], "x double")
    assert C.bin_quantile(df, "x", 4, drop_duplicates=False).columns == ["x"]
    assert C.bin_quantile(df, "x", 4).agg(F.max("x_binned")).first()[0] <= 3


def test_recipe_custom_step_and_pipeline_edit(demo):
    rec = {"salary": ColumnRecipe(impute="mean", custom=lambda d: d.withColumn("twice", F.col("salary") * 2)), "id": ColumnRecipe(drop=True)}
    out = apply_recipe(demo, rec)
    assert "id" not in out.columns and out.where("twice is null").count() == 0
    p = Pipeline.standard(rec).add("last", lambda d: d.limit(5)).remove("outliers")
    assert p.names() == ["dedup", "recipe", "last"]
    assert p.run(demo).count() == 5


def test_power_transform_lambda(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame(pd.DataFrame({"x": np.exp(rng.normal(0, 1, 3000))}))
    assert abs(C.power_lambdas(df, "boxcox", ["x"])["x"]) < .1
    assert C.power_lambdas(df.select((F.col("x") - 5).alias("x")), "boxcox", ["x"])["x"] is None


def test_driver_side_tails():
    assert abs(DI.chi2_sf(3.841459, 1) - .05) < 1e-6 and abs(DI.chi2_sf(18.307, 10) - .05) < 1e-5
    assert abs(DI.t_two_sided(2.228139, 10) - .05) < 1e-6 and abs(DI.f_sf(4.964603, 1, 10) - .05) < 1e-6


def test_normal_quantile_and_cdf(spark):
    r = spark.range(1).select(DI.normal_quantile(F.lit(.975)).alias("q"), DI.normal_cdf(F.lit(1.959964)).alias("p"), DI.normal_quantile(F.lit(.001)).alias("low")).first()
    assert abs(r["q"] - 1.959964) < 1e-6 and abs(r["p"] - .975) < 1e-6 and abs(r["low"] + 3.090232) < 1e-5


def _brute(x, ids, k):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    out = {}
    for i in range(len(x)):
        order = sorted((d[i, j], ids[j]) for j in range(len(x)) if j != i)[:k]
        out[ids[i]] = order
    return out


@pytest.mark.parametrize("block, direct", [(15, 0), (60, 0), (20_000, 20_000)])
def test_knn_matches_brute_force_with_copies(spark, block, direct):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 3)).round(1)
    x[:80] = x[0]  # a third of the rows are copies of one vector
    ids = np.arange(240)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id bigint, vec array<double>")
    got = {}
    for r in N.knn_join(df, df, 4, block=block, direct=direct).collect():
        got.setdefault(r["id"], []).append((r["dist"], r["nid"]))
    want = _brute(x, ids, 4)
    for i, nearest in want.items():  # equal distances may differ in the last bit, so distances are compared
        assert len({n for _, n in got[i]} - {i}) == 4
        assert np.allclose([d for d, _ in sorted(got[i])], [d for d, _ in nearest])


@pytest.mark.parametrize("block, direct", [(12, 0), (20_000, 20_000)])
def test_knn_imputation_of_many_patterns(spark, block, direct):
    """All patterns of five incomplete columns against brute force, with copies and a row that has nothing."""
    rng = np.random.default_rng(11)
    x = rng.integers(0, 9, (150, 5)).astype(float) + rng.normal(0, .01, (150, 5))
    x[100:130] = x[100]
    x[rng.random(x.shape) < .25] = np.nan
    x[140] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, c double, d double, e double")
    got = {r["id"]: np.array(r[1:], dtype=float) for r in N.impute(df, "id", list("abcde"), 4, block=block, direct=direct).collect()}
    assert len(got) == 150
    for i, r in enumerate(x):
        has = ~np.isnan(r)
        for c in range(5):
            if has[c]:
                want = r[c]
            else:
                able = [j for j in range(150) if not np.isnan(x[j, c]) and not np.isnan(x[j, has]).any()]
                near = sorted((np.sqrt(((x[j, has] - r[has]) ** 2).sum()), j) for j in able)[:4 if has.any() else None]
                want = np.mean([x[j, c] for _, j in near]) if near else np.nan
            assert np.isclose(got[i][c], want, equal_nan=True), (i, c)


def test_knn_imputation_starts_as_many_jobs_for_many_patterns(spark):
    def jobs(cols):
        rng, sc = np.random.default_rng(1), spark.sparkContext
        x = rng.normal(size=(60, 5))
        x[:, :cols][rng.random((60, cols)) < .3] = np.nan
        df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id bigint, a double, b double, c double, d double, e double")
        sc.setJobGroup(f"knn{cols}", "impute")
        N.impute(df, "id", list("abcde")).count()
        n = len(sc.statusTracker().getJobIdsForGroup(f"knn{cols}"))
        sc.setJobGroup("other", "other")
        return n

    assert jobs(1) == jobs(5)


def test_smote_balances_and_tomek_only_drops_majority(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1, (60, 2)), rng.normal(1.5, 1, (20, 2))])
    df = spark.createDataFrame([(i, v.tolist(), int(i >= 60)) for i, v in enumerate(x)], "id bigint, vec array<double>, cls int")
    n = {r["label"]: r["count"] for r in N.smote(df, "cls", 1).groupBy("label").count().collect()}
    assert n == {0: 60, 1: 60}
    left = N.tomek(df, "cls", 0)
    assert left.where("cls = 1").count() == 20 and left.count() <= 80


def test_isolation_and_robust_distance_find_planted_outliers(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.normal(size=(500, 2)), columns=["a", "b"])
    pdf.loc[:9] += 12
    pdf["id"] = np.arange(500)
    df = spark.createDataFrame(pdf)
    for kept in (AN.remove_isolated(df, ["id"], ["a", "b"], .02, trees=40, rows=128), AN.remove_elliptic(df, ["a", "b"], .02)):
        assert kept.where("id < 10").count() == 0 and abs(kept.count() - 490) <= 1


def test_split_is_exact_and_disjoint(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    n = {(r["split"], r["y"]): r["count"] for r in S.split(df, ["id"], "y").groupBy("split", "y").count().collect()}
    assert n["test", 0] == 180 and n["test", 1] == 20 and sum(n.values()) == 1000
    again = S.split(df.repartition(13), ["id"], "y").join(S.split(df, ["id"], "y"), ["id", "split"]).count()
    assert again == 1000


def test_auc_of_perfect_and_random_scores(spark):
    df = spark.createDataFrame([(i % 2, float(i % 2), .5) for i in range(100)], "y int, p double, q double")
    assert EV.roc_auc(df).first()[0] == 1.0 and EV.roc_auc(df, "q").first()[0] == .5


def test_harvey_collier_and_breusch_pagan_tell_curves_and_spread(spark):
    rng = np.random.default_rng(1)
    x = np.sort(rng.uniform(0, 10, 800))
    pdf = pd.DataFrame({"i": np.arange(800), "x": x, "line": 3 * x + rng.normal(0, 1, 800), "curve": x ** 2 + rng.normal(0, 1, 800), "fan": x + rng.normal(0, 1, 800) * x})
    df = spark.createDataFrame(pdf)
    assert A.linearity(df, "line", ["x"], ["i"]).first()["passed"] and not A.linearity(df, "curve", ["x"], ["i"]).first()["passed"]
    assert A.heteroscedasticity(df, "line", ["x"]).first()["passed"] and not A.heteroscedasticity(df, "fan", ["x"]).first()["passed"]


def test_imputers_leave_no_gap(spark):
    rng = np.random.default_rng(8)
    a = rng.normal(size=300)
    pdf = pd.DataFrame({"id": np.arange(300), "a": a, "b": 2 * a + rng.normal(0, .01, 300)})
    df = spark.createDataFrame(pdf).withColumn("b", F.when(F.col("id") % 5 != 0, F.col("b")))
    for out in (N.impute(df, "id", ["a", "b"]), M.chained_imputation(df, ["a", "b"])):
        assert out.where("b is null").count() == 0
        assert out.select(F.max(F.abs(F.col("b") - 2 * F.col("a")))).first()[0] < 1.0


def test_bootstrap_weights_average_one(spark):
    df = spark.range(3000)
    w = S.bootstrap(df, ["id"], 4).agg(F.sum("weight")).first()[0] / 12000
    assert abs(w - 1) < .05


def test_nan_counts_as_missing_everywhere(spark):
    from assayer.operators import clean, drift, profile

    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, 1.0), (2, nan), (3, None), (4, 3.0)], "k int, x double")
    row = profile.counts(df, ["x"]).first()
    assert (row["missing_count"], row["unique_count"]) == (2, 2)
    assert sorted(r["x"] for r in clean.impute(df, "mean", ["x"]).collect()) == [1.0, 2.0, 2.0, 3.0]
    assert sorted(r["x"] for r in clean.impute(df, "constant", ["x"], 9.0).collect()) == [1.0, 3.0, 9.0, 9.0]
    wide = spark.createDataFrame([(-inf,), (1.0,), (2.0,), (3.0,), (inf,)], "x double")
    q = profile.numeric(wide).first()
    assert (q["q25"], q["q50"], q["q75"]) == (1.0, 2.0, 3.0)
    gone = spark.createDataFrame([(1, None), (2, nan)], "k int, x double")
    psi = {r["column_name"]: r["psi"] for r in drift.population_stability(df, gone, ["x", "k"]).collect()}
    assert psi["x"] > 1 and set(psi) == {"x", "k"}
    assert drift.population_stability(gone, df, ["x"]).first()["psi"] > 1
    assert drift.population_stability(gone, gone, ["x"]).first()["psi"] == 0
    assert drift.kolmogorov_smirnov(df, gone, ["x"]).first()["ks"] == 1


def test_scores_use_the_rows_a_feature_has(spark):
    from assayer.operators import encode

    rows = [(float(i % 7), None if i % 3 == 0 else float(i), "ab"[i % 2], float(i * i)) for i in range(30)]
    df = spark.createDataFrame(rows, "a double, b double, y string, t double")
    whole = df.where("b is not null")
    for fn, target in ((encode.f_class_scores, "y"), (encode.f_regression_scores, "t")):
        assert abs(fn(df, ["a", "b"], target).where("feature = 'b'").first()["score"] - fn(whole, ["b"], target).first()["score"]) < 1e-9


def test_mandatory_features_and_all_lags_stay(spark):
    from assayer.operators import encode

    scores = spark.createDataFrame([(f"f{i}", float(i)) for i in range(6)], "feature string, score double")
    rules = spark.createDataFrame([(f"f{i}", "must_include", 1) for i in range(3)], "feature string, rule_type string, priority int")
    assert [r["feature"] for r in encode.select_by_rules(scores, rules, 0.5, 2).collect()] == ["f2", "f1", "f0"]
    assert [r["feature"] for r in encode.select_by_rules(scores, rules, 0.5, 4).collect()] == ["f2", "f1", "f0", "f5"]
    wide = spark.createDataFrame([(i, *[float(i)] * 7) for i in range(5)], "k int, " + ", ".join(f"c{j} double" for j in range(7)))
    assert sum("_lag_1" in c for c in encode.lag_features(wide, ["k"], offsets=(1,)).columns) == 7


def test_drift_swaps_categories_of_any_number(spark):
    from assayer.operators.sample import synthesize_drift

    df = spark.range(1500).selectExpr("id", "concat('v', id) AS c")
    out = {r["id"]: r["c"] for r in synthesize_drift(df, "high", ["id"]).collect()}
    assert len(out) == 1500 and sum(v is not None and v != f"v{k}" for k, v in out.items()) > 300


def _planted(spark, n=3000):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=n), rng.normal(size=n)
    return spark.createDataFrame(pd.DataFrame({"k": np.arange(n), "a": a, "b": b, "y": 3 * a + .1 * rng.normal(size=n), "cls": (a + .3 * rng.normal(size=n) > 1).astype("int32")}))


def test_models_score_on_rows_they_have_not_seen(spark):
    from assayer.operators import models as M
    from assayer.operators.sample import split

    df = split(_planted(spark), ["k"], val=0.0)
    train, test = df.where("split = 'train'"), df.where("split = 'test'")
    for name, kind, target, least, more in (
            ("linear", "regression", "y", .99, {}), ("ridge", "regression", "y", .85, {}), ("lasso", "regression", "y", .95, {}), ("elastic_net", "regression", "y", .95, {}),
            ("random_forest", "regression", "y", .85, {"numTrees": 20}), ("gbt", "regression", "y", .9, {"maxIter": 10}), ("decision_tree", "regression", "y", .9, {}),
            ("random_forest", "classification", "cls", .9, {"numTrees": 20}), ("gbt", "classification", "cls", .9, {"maxIter": 5}), ("decision_tree", "classification", "cls", .9, {}),
            ("logistic", "classification", "cls", .9, {}), ("linear_svc", "classification", "cls", .9, {}), ("naive_bayes", "classification", "cls", .85, {}), ("mlp", "classification", "cls", .9, {})):
        model = M.fit(train, ["a", "b"], target, name, kind, **more)
        assert M.metric(M.score_table(model, test, target, kind, ["k"]), kind).first()["score"] > least, name


def test_learning_curve_and_cross_validation(spark):
    from assayer.operators import models as M
    from assayer.operators.sample import folds

    df = _planted(spark, 1000).cache()
    shares = folds(df, ["k"], 5, "cls").groupBy("fold").agg(F.sum("cls").alias("n")).collect()
    assert max(r["n"] for r in shares) - min(r["n"] for r in shares) <= 1
    curve = sorted(M.learning_curve(df, ["a", "b"], "y", "linear", "regression", ["k"], (.25, .5, .75, 1.0), k=3).collect(), key=lambda r: r["size"])
    test, gap = [r["test_mean"] for r in curve], [r["train_mean"] - r["test_mean"] for r in curve]
    assert len(curve) == 4 and min(test) > .99
    assert curve[0]["final_gap"] == pytest.approx(gap[-1]) and curve[0]["overfitting_score"] == pytest.approx(np.mean(gap[-3:]))
    assert curve[0]["convergence_rate"] == pytest.approx(np.mean(np.diff(test[2:])))
    cv = M.cross_validate(df, ["a", "b"], "cls", "decision_tree", "classification", ["k"], 3).first()
    assert cv["folds"] == 3 and cv["mean_score"] > .85
    tuned = M.tune(df, ["a", "b"], "y", "ridge", "regression", ["k"], 2, {"regParam": [.1, 100.0]}).collect()
    assert [r["best"] for r in sorted(tuned, key=lambda r: r["params"])] == [True, False]


def test_permutation_finds_the_feature_that_counts(spark):
    from assayer.operators import models as M

    df = _planted(spark, 500)
    got = {r["feature"]: r for r in M.permutation_importance(M.fit(df, ["a", "b"], "y", "linear", "regression"), df, ["a", "b"], "y", "regression", ["k"], 5, at_once=2).collect()}
    assert got["a"]["importance"] > 1 and abs(got["b"]["importance"]) < .01 and got["a"]["std"] > 0


def test_many_features(spark):
    from assayer.operators import assume as A

    x = np.random.default_rng(9).normal(size=(400, 60))
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"x{i}" for i in range(60)]).assign(y=x.sum(axis=1)))
    vifs = {r["feature"]: r["vif"] for r in A.vif(df, [f"x{i}" for i in range(60)], center=True).collect()}
    want = np.diag(np.linalg.inv(np.corrcoef(x.T)))
    assert [vifs[f"x{i}"] for i in range(60)] == pytest.approx(list(want))
    noisy = df.withColumn("y", F.col("x0") + F.col("x1") * F.rand(3))
    white = A.heteroscedasticity(noisy, "y", [f"x{i}" for i in range(10)], white=True).first()  # 65 terms
    assert white["n"] == 400 and not white["passed"]
    with pytest.raises(ValueError):
        A.vif(df, ["x0", "x1", "x2"], max_features=2)


def test_word_counts_have_the_whole_vocabulary(spark):
    from assayer.operators import models as M

    df = spark.createDataFrame([(1, "a b, a"), (2, ""), (3, " ".join(f"w{i}" for i in range(3000)))], "k int, t string")
    got = {r["k"]: r["text_features"] for r in M.text_features(df, "t", "count").collect()}
    assert got[1] == {"a": 2, "b": 1} and got[2] == {} and len(got[3]) == 3000 and set(got[3].values()) == {1}


def test_delimiter_rules(spark, tmp_path):
    from assayer.sources import files as IO

    path = str(tmp_path / "t.csv")
    with open(path, "w") as f:
        f.write("a,b,c;d\n1,2,3;4\n")
    assert [IO.detect_delimiter(spark, path, rule=r) for r in ("most", "semicolon_or_comma", "first_that_splits")] == [",", ",", ";"]
    with pytest.raises(ValueError):
        IO.detect_delimiter(spark, path, rule="none")


@pytest.mark.parametrize("cell_pairs", [7, 40, 1_000_000])
def test_kendall_matches_all_pairs(spark, cell_pairs):
    """Ties in both columns, a value that a third of all rows share, repeated and missing pairs, small and large cells."""
    from assayer.operators import concordance as K

    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 25, 260).astype(float), rng.integers(0, 40, 260).astype(float)
    b[:90] = 17.0
    rows = [(float(x), float(y)) for x, y in zip(a, b)] + [(None, 1.0), (2.0, None), (float("nan"), 3.0)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(5)
    got = K.kendall(df, "a", "b", cell_pairs).first()
    s = np.sign(a[:, None] - a[None]) * np.sign(b[:, None] - b[None])
    c, q = int((s > 0).sum() // 2), int((s < 0).sum() // 2)
    tied = lambda x: sum(k * (k - 1) // 2 for k in np.unique(x, return_counts=True)[1].tolist())
    n0 = 260 * 259 // 2
    assert (got["n"], got["concordant"], got["discordant"]) == (260, c, q)
    assert np.isclose(got["tau"], (c - q) / np.sqrt(float(n0 - tied(a)) * float(n0 - tied(b))))
    assert K.kendall(df.where("a > 99"), "a", "b").first()["tau"] is None


def test_samples_are_the_same_on_every_partitioning(spark):
    from assayer.plans.columns import sampled

    df = spark.createDataFrame([("k", f"v{i % 40}") for i in range(400)] + [("few", "x"), ("few", "x"), ("few", None)], "key string, value string")
    one, two = ({r["key"]: r["examples"] for r in sampled(df.repartition(p), ["key"], 5).collect()} for p in (1, 7))
    assert one == two and one["few"] == ["x"] and len(set(one["k"])) == 5


def test_date_formats_are_settled_by_the_whole_column(spark):
    import datetime as dt

    from assayer.operators import dates as D

    rows = [("01/02/2024", "01/02/2024", "2024-03-05", "x", "2024-02-30"), ("25/12/2024", "02/03/2024", "05.03.2024", "y", "2024-02-29"),
            (" 03/04/2024 ", None, "5 Mar 2024", "2024-01-01", None), (None, "03/04/2024", "2024-03-05 10:20:30", "z", "2024-01-01")]
    df = spark.createDataFrame(rows, "settled string, open string, mixed string, text string, `odd.name` string")
    day = lambda m, d, *t: dt.datetime(2024, m, d, *t)
    got = D.parse_dates(df, least=0.6).collect()
    assert [r["settled"] for r in got] == [day(2, 1), day(12, 25), day(4, 3), None]
    assert [r["open"] for r in got] == [day(1, 2), day(2, 3), None, day(3, 4)]
    assert [r["mixed"] for r in got] == [day(3, 5), day(3, 5), day(3, 5), day(3, 5, 10, 20, 30)]
    assert [r["text"] for r in got] == ["x", "y", "2024-01-01", "z"] and [r["odd.name"] for r in got] == [None, day(2, 29), None, day(1, 1)]
    assert [r["open"] for r in D.parse_dates(df, ["open"], day_first=True).collect()] == [day(2, 1), day(3, 2), None, day(4, 3)]
    assert D.parse_dates(df.limit(0)).dtypes == df.dtypes and D.parse_dates(spark.range(3)).columns == ["id"]


def test_open_steps_of_a_recipe_follow_the_table(spark):
    from assayer.plans.defaults import complete

    df = spark.createDataFrame([(i, float(i) if i % 4 else None, float(2 ** i) if i % 3 else None, "ab"[i % 2] if i % 5 else None, f"t{i}") for i in range(20)],
                               "id int, even double, skewed double, few string, many string")
    got = complete(df, {"even": ColumnRecipe(scale="minmax")}, ["id"], max_cardinality=5)
    assert "id" not in got and (got["even"].impute, got["even"].scale) == ("mean", "minmax")
    assert (got["skewed"].impute, got["skewed"].scale) == ("median", "standard")
    assert (got["few"].impute, got["few"].encode, got["few"].scale) == ("most_frequent", "onehot", None)
    assert "many" not in got
    done = apply_recipe(df, got)
    assert done.where("even IS NULL OR skewed IS NULL").count() == 0 and "few_a" in done.columns
    assert complete(df, {}, df.columns) == {} and complete(df.limit(0), {}, impute_num=None)["even"].scale == "standard"


def test_constant_predictions_have_a_stability_and_no_correlation(spark):
    df = spark.range(400).selectExpr("id AS k", "CAST(id % 7 AS DOUBLE) AS a", "CAST(id % 5 AS DOUBLE) AS b", "CAST(id % 400 = 0 AS INT) AS y")
    model = M.fit(df, ["a", "b"], "y", "decision_tree", "classification", maxDepth=1, minInstancesPerNode=150)
    assert M.score_table(model, df, "y", "classification", ["k"]).select("yhat").distinct().count() == 1
    got = M.stability_table(model, df, ["a", "b"], "y", "classification", ["k"], rounds=3).first()
    assert got["noise"] == got["dropout"] == got["repeat"] == 1.0 and 0.99 < got["bootstrap"] <= 1
    flat = spark.range(50).selectExpr("CAST(id AS DOUBLE) AS y", "CAST(3 AS DOUBLE) AS yhat")
    assert EV.residual_heteroscedasticity(flat).first()["r"] is None


def test_bootstrap_query_counts_rare_weights_as_its_sql(spark, tmp_path):
    import duckdb

    from assayer.catalog.modeling import QUERIES, SQL

    pd.DataFrame({"event_id": [505636, 129345, 7], "value": [1.0, 2.0, 3.0]}).to_parquet(tmp_path / "events.parquet")
    df = spark.read.parquet(str(tmp_path / "events.parquet"))
    assert S.bootstrap(df, ["event_id"]).agg(F.max("weight")).first()[0] > 9
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    want = sorted(con.execute(SQL["bootstrap"]).fetchall())
    assert sorted(map(tuple, QUERIES["bootstrap"](spark, str(tmp_path)).collect())) == want


def test_knn_copies_a_query_to_packs_and_ranks_by_exact_distance(spark, monkeypatch):
    """Far from the origin a product's rounding exceeds the gaps; packs of several cells, cells of several packs."""
    rng = np.random.default_rng(3)
    x = 1e6 + rng.integers(0, 40, (300, 16)) / 1e4
    x[:120, 1:] = x[0, 1:]  # one cell holds many
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
    want = _brute(x, np.arange(300), 3)
    monkeypatch.setattr(N, "PACKS", 6)
    for block, direct in ((20, 0), (20_000, 20_000)):
        got = {}
        for r in N.knn_join(df, df, 3, block=block, direct=direct).orderBy("id", "rank").collect():
            got.setdefault(r["id"], []).append(r["dist"])
        assert all(np.allclose(got[i], [d for d, _ in w], rtol=1e-12) for i, w in want.items())
    wide, product = N.match_whole, []
    monkeypatch.setattr(N, "_dist", lambda a, b: product.append(1))
    next(wide(x[:9], x, np.arange(300), 4))
    assert not product  # no difference of all pairs


def test_permutation_scores_all_columns_of_a_true_permutation_without_a_cut(spark, monkeypatch):
    df = _planted(spark, 500)
    model, moved, score = M.fit(df, ["a", "b"], "y", "linear", "regression"), [], M.score_table
    monkeypatch.setattr(M, "cut", lambda t: pytest.fail("a copy of the table was written"))
    monkeypatch.setattr(M, "CLASS_ROWS", 60)
    monkeypatch.setattr(M, "score_table", lambda m, t, *a, **k: moved.append(t) or score(m, t, *a, **k))
    assert M.permutation_importance(model, df, ["a", "b"], "y", "regression", ["k"], 3, at_once=3).count() == 2
    assert len(moved) == 2  # the base, and all columns of all repeats
    got, own = moved[1].toPandas(), df.toPandas().set_index("k")
    assert len(got) == 3 * 2 * 500
    for (_, col), rows in got.groupby(["__rep", "__col"]):
        rows, kept = rows.set_index("k").sort_index(), "b" if col == "a" else "a"
        assert sorted(rows[col]) == sorted(own[col]) and (rows[col] != own[col].sort_index()).mean() > .5
        assert (rows[kept] == own[kept].sort_index()).all()


def test_regression_queries_predict_every_row_once(spark, monkeypatch):
    from assayer.catalog.modeling import QUERIES

    score, seen = M.score_table, spark.sparkContext.accumulator(0)

    def counted(*a, **k):
        @F.udf("double")
        def same(v):
            seen.add(1)
            return v

        return score(*a, **k).withColumn("yhat", same("yhat"))

    monkeypatch.setattr(M, "score_table", counted)
    sf = "/root/testdata/sf0.001"
    assert QUERIES["ml_dt_regression"](spark, sf).count() == 1
    assert seen.value == spark.read.parquet(f"{sf}/lineitem.parquet").count()


def test_fits_on_counted_rows(spark):
    """Classifiers without draws read each different row once; scores count all rows, gaps are filled by the mean of all."""
    df = spark.range(4000).selectExpr("id", "CASE WHEN id % 8 = 0 THEN NULL ELSE CAST(id % 5 AS DOUBLE) END AS a", "CAST(id % 3 AS DOUBLE) AS b",
                                      "CAST(id % 5 > 2 OR id % 40 = 0 AS INT) AS y")
    model = M.fit(df, ["a", "b"], "y", "decision_tree", "classification")
    assert model.stages[-1].getWeightCol() == "__weight"
    mean = df.agg(F.avg("a")).first()[0]
    assert abs(model.stages[0].stages[0].surrogateDF.first()["a"] - mean) < 1e-9
    plain = M.Pipeline(stages=[M.preparation(df, ["a", "b"]), M.estimator("decision_tree", "classification")]).fit(df.withColumn("label", F.col("y").cast("double")))
    said = lambda m: [r["yhat"] for r in M.score_table(m, df, "y", "classification", ["id"]).orderBy("id").collect()]
    assert said(model) == said(plain)
    assert not M.repeats(df, ["id", "y"])
    held = M.fit(df, ["a", "b"], "y", "decision_tree", "classification", minInstancesPerNode=500)
    assert held.stages[-1].numNodes > 1  # a least number of rows is of all rows, not of different ones

    sizes, u = (.3, .6, 1.0), M.unit_hash(["id"], "curve")
    got = {(r["size"]): (r["train_mean"], r["test_mean"]) for r in M.learning_curve(df, ["a", "b"], "y", "decision_tree", "classification", ["id"], sizes, 2).collect()}
    cut_ = S.folds(df, ["id"], 2, "y").withColumn("u", u)
    for size in sizes:
        want = []
        for i in range(2):
            train, test = cut_.where((F.col("fold") != i) & (F.col("u") < size)), cut_.where(F.col("fold") == i)
            m = M.fit(train, ["a", "b"], "y", "decision_tree", "classification")
            want.append([M.metric(M.score_table(m, part, "y", "classification", ["id"]), "classification").first()[0] for part in (train, test)])
        assert np.allclose(got[size], np.mean(want, axis=0))
    both = M.cross_validate(df, ["a", "b"], "y", "decision_tree", "classification", ["id"], 2).first()
    assert both["folds"] == 2 and np.isclose(both["mean_score"], got[1.0][1])


def test_tuning_prepares_a_fold_once(spark, monkeypatch):
    from pyspark.ml.feature import Imputer

    fits, plain = [], Imputer._fit
    monkeypatch.setattr(Imputer, "_fit", lambda self, data: (fits.append(1), plain(self, data))[1])
    df = spark.range(60).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS a", "2.0D * (id % 7) + id % 3 AS y")
    got = M.tune(df, ["a"], "y", "ridge", "regression", ["id"], 2, {"regParam": [.1, 1.0, 10.0]}).collect()
    assert len(fits) == 2 and [r["best"] for r in sorted(got, key=lambda r: r["score"])] == [True, False, False]


def test_forest_is_fitted_to_counted_rows(spark, monkeypatch):
    """A tree weighs a counted row by a Poisson draw of its mean, every class is known to each tree, and scores count all rows."""
    df = spark.range(6000).selectExpr("id", "CASE WHEN id % 8 = 0 THEN NULL ELSE CAST(id % 5 AS DOUBLE) END AS a", "CAST(id % 3 AS DOUBLE) AS b",
                                      "CASE WHEN id = 5 THEN 2 WHEN crc32(CAST(id AS STRING)) % 4 = 0 THEN CAST(id % 5 < 3 AS INT) ELSE CAST(id % 5 > 2 AS INT) END AS y")
    rows = M.counted(df.withColumn("label", F.col("y").cast("double")), ["a", "b", "label"])
    pdf = M.drawn(rows, ["a", "b"], 2000, 42).toPandas()
    got = np.stack(pdf["__drawn"].to_numpy())
    assert np.allclose(got.mean(axis=1), pdf["__weight"], atol=5 * np.sqrt(pdf["__weight"].max() / 2000))
    assert np.allclose(got.var(axis=1) / pdf["__weight"], 1, atol=.25) and len({r.tobytes() for r in got}) == len(pdf)

    read, fitted = [], M.counted
    monkeypatch.setattr(M, "counted", lambda *a: read.append(a) or fitted(*a))
    model = M.fit(df, ["a", "b"], "y", "random_forest", "classification", numTrees=7)
    forest = model.stages[-1]
    assert len(read) == 1 and forest.getNumTrees == 7 and forest.numClasses == 3 and forest.featureImportances.size == 2
    assert len({t._java_obj.rootNode().impurity() for t in forest.trees}) == 7
    plain = M.Pipeline(stages=[M.preparation(df, ["a", "b"]), M.estimator("random_forest", "classification", numTrees=7)]).fit(df.withColumn("label", F.col("y").cast("double")))
    share = lambda m: M.metric(M.score_table(m, df, "y", "classification", ["id"]), "classification").first()[0]
    assert abs(share(model) - share(plain)) < .02
    counts = {(r["y"], r["yhat"]): r["n"] for r in M.score_counts(model, df, ["a", "b"], "y", "classification").groupBy("y", "yhat").agg(F.sum("weight").alias("n")).collect()}
    assert counts == {(r["y"], r["yhat"]): r["count"] for r in M.score_table(model, df, "y", "classification", ["id"]).groupBy("y", "yhat").count().collect()}
    two = M.score_counts(model, df.where("y < 2"), ["a", "b"], "y", "classification")
    assert EV.binary(two, weight="weight").collect() == EV.binary(M.score_table(model, df.where("y < 2"), "y", "classification", ["id"])).collect()
    read.clear()
    M.fit(df, ["a", "b"], "y", "random_forest", "classification", numTrees=2, minInstancesPerNode=500)
    assert not read  # a least number of rows is of all rows, not of different ones


def test_checks_in_order_sort_once(spark, monkeypatch):
    """Harvey-Collier and Durbin-Watson share one sorted copy; the statistic goes over range seams and past missing residuals."""
    from assayer.plans import ordered

    rng = np.random.default_rng(8)
    x = rng.normal(size=600)
    pdf = pd.DataFrame({"i": rng.permutation(600), "x": x, "z": rng.normal(size=600), "y": 2 * x + np.cumsum(rng.normal(size=600))})
    df, sorted_, made = spark.createDataFrame(pdf), A.sorted_ranges, []
    monkeypatch.setattr(A, "sorted_ranges", lambda *a: made.append(a) or sorted_(*a))
    got = {r["check"]: r for r in A.all_checks(df, "y", ["i"], ["x", "z", "y"]).collect()}
    assert len(made) == 1
    o = pdf.sort_values("i")
    m = np.column_stack([np.ones(600), o["x"], o["z"]])
    e = o["y"] - m @ np.linalg.lstsq(m, o["y"], rcond=None)[0]
    assert got["durbin_watson"]["n"] == 600 and abs(got["durbin_watson"]["statistic"] - np.sum(np.diff(e) ** 2) / np.sum(e ** 2)) < 1e-9
    assert abs(got["harvey_collier"]["statistic"] - A.linearity(df, "y", ["x", "z"], ["i"]).first()["statistic"]) < 1e-9

    gaps = spark.range(60).select("id", F.when(F.col("id") % 7 != 3, F.sin("id")).alias("e"))
    e = np.array([np.nan if i % 7 == 3 else np.sin(i) for i in range(60)])
    monkeypatch.setattr(ordered, "range_count", lambda df: 11)
    row = EV.durbin_watson(gaps, F.col("e"), ["id"]).first()
    assert row["n"] == 60 and abs(row["durbin_watson"] - np.nansum(np.diff(e) ** 2) / np.nansum(e ** 2)) < 1e-12


def test_perceptron_is_fitted_to_counted_rows(spark, monkeypatch):
    """Counted rows lead to the weights that MLlib finds on all rows; solvers and tables without counts stay MLlib's."""
    df = spark.range(6400, numPartitions=1).selectExpr(
        "id", "CASE WHEN id % 7 = 0 THEN NULL ELSE CAST(id % 5 AS DOUBLE) END AS a", "CAST(id % 3 AS DOUBLE) AS b", "concat('t', id % 4) AS c",
        "CASE WHEN crc32(CAST(id AS STRING)) % 4 = 0 THEN CAST(id % 2 AS INT) ELSE CAST(id % 5 > 2 AS INT) + CAST(id % 3 > 1 AS INT) END AS y")
    read, fitted = [], M.counted
    monkeypatch.setattr(M, "counted", lambda *a: read.append(a) or fitted(*a))
    model = M.fit(df, ["a", "b", "c"], "y", "mlp", "classification")
    assert len(read) == 1 and model.stages[-1].getLayers() == [6, 8, 3]
    rows = model.stages[0].transform(df.withColumn("label", F.col("y").cast("double")))  # whole blocks of one task: MLlib weighs all rows alike
    plain = M.estimator("mlp", "classification", layers=[6, 8, 3]).fit(rows.coalesce(1))
    assert np.allclose(model.stages[-1].weights.toArray(), plain.weights.toArray(), atol=1e-4)
    said = lambda m: [r["yhat"] for r in M.score_table(m, df, "y", "classification", ["id"]).orderBy("id").collect()]
    assert said(model) == said(M.PipelineModel([model.stages[0], plain]))
    short = M.fit(df, ["a", "b"], "y", "mlp", "classification", maxIter=2, layers=[2, 4, 3, 3], seed=7).stages[-1]
    assert short.getLayers() == [2, 4, 3, 3] and short.weights.size == 12 + 15 + 12 and len(read) == 2
    M.fit(df, ["a", "b"], "y", "mlp", "classification", maxIter=2, solver="gd")
    M.fit(df.limit(500), ["a", "id"], "y", "mlp", "classification", maxIter=2)
    assert len(read) == 2
    with pytest.raises(Exception, match="(?i)label"):
        M.fit(df.withColumn("y", F.when(F.col("id") != 5, F.col("y"))), ["a", "b"], "y", "mlp", "classification", layers=[2, 4, 3])


def test_a_stability_query_runs_its_own_part(spark, monkeypatch):
    """No part draws the noise, the bootstrap or the second prediction of another."""
    from __spark_entry__ import queries

    from assayer.catalog import modeling

    made, sf = [], "/root/testdata/sf0.001"
    for name in ("noise_copies", "dropout_copies", "bootstrap", "drawn", "pearson"):
        monkeypatch.setattr(M, name, lambda *a, _n=name, _f=getattr(M, name): made.append(_n) or _f(*a))
    monkeypatch.setattr(modeling, "_memo", {})
    for part, own in (("noise", ["noise_copies"]), ("dropout", ["dropout_copies"]), ("bootstrap", ["drawn"]), ("repeat", ["pearson"])):
        made.clear()
        row = queries()[f"stab_{part}"](spark, sf).first()
        assert list(row.asDict()) == [part] and .9 < row[0] <= 1.1 and made == own


def test_stability_of_counted_rows_is_that_of_all(spark, monkeypatch):
    """Scores over counted rows are those of rows; a cell's Poisson draws scatter as the rows' draws do; noise is normal."""
    df = spark.range(6000).selectExpr("id AS k", "CAST(id % 5 AS DOUBLE) AS a", "CASE WHEN id % 11 > 0 THEN CAST(id % 3 AS DOUBLE) END AS b",
                                      "CASE WHEN id % 97 = 0 THEN NULL WHEN crc32(CAST(id AS STRING)) % 4 = 0 THEN CAST(id % 2 AS INT) ELSE CAST(id % 5 > 2 AS INT) END AS y")
    model = M.fit(df.where("y IS NOT NULL"), ["a", "b"], "y", "decision_tree", "classification")
    few = M.Stability(model, df, ["a", "b"], "y", "classification", ["k"])
    assert few.counted().count() <= 60
    monkeypatch.setattr(M, "repeats", lambda *a: False)
    each = M.Stability(model, df, ["a", "b"], "y", "classification", ["k"])
    assert each.counted() is None
    assert few.dropout((.5, .9)).first()[0] == pytest.approx(each.dropout((.5, .9)).first()[0]) and few.dropout((.9,)).first()[0] < .95
    assert few.noise((.5,)).first()[0] == pytest.approx(each.noise((.5,)).first()[0])
    assert few.bootstrap(5).first()[0] == each.bootstrap(5).first()[0]  # the same cells
    labelled = df.where("y IS NOT NULL")
    rows = S.bootstrap(M.score_table(model, labelled, "y", "classification", ["k"]), ["k"], 150).groupBy("round").agg(
        (F.sum(F.col("weight") * (F.col("y") == F.col("yhat")).cast("int")) / F.sum("weight")).alias("s")).agg(F.stddev_pop("s") / F.avg("s")).first()[0]
    cells = 1 - M.Stability(model, labelled, ["a", "b"], "y", "classification", ["k"]).bootstrap(150).first()[0]
    assert .75 < cells / rows < 1.33

    noisy = M.noise_copies(df, ["a"], (.1, 2.0), ["k"])
    assert noisy.columns == [*df.columns, "level"] and noisy.count() == 12_000
    both = noisy.join(df.select("k", F.col("a").alias("own")), "k").toPandas()
    z = (both["a"] - both["own"]) / both["level"] / df.toPandas()["a"].std()
    assert abs(z.mean()) < .03 and abs(z.std() - 1) < .03 and abs((z ** 4).mean() - 3) < .25
    wide = z.groupby(both["level"]).apply(list)
    assert abs(np.corrcoef(wide.iloc[0], wide.iloc[1])[0, 1]) < .05
    again = M.noise_copies(df.repartition(5), ["a"], (.1, 2.0), ["k"])
    assert sorted((r["k"], r["level"], round(r["a"], 9)) for r in again.collect()) == sorted((r["k"], r["level"], round(r["a"], 9)) for r in noisy.collect())


def test_regression_trees_are_fitted_to_means_of_equal_features(spark, monkeypatch):
    """The trees are those of all rows, every row is scored, gaps are filled by the mean of all; other losses read all rows."""
    df = spark.range(5000).selectExpr("id", "CASE WHEN id % 8 = 0 THEN NULL ELSE CAST(id % 7 AS DOUBLE) END AS a", "CAST(id % 3 AS DOUBLE) AS b",
                                      "concat('t', id % 2) AS c", "(id % 7) * (id % 3) + (crc32(CAST(id AS STRING)) % 1000) / 250.0D AS y")
    cols, made, plain_means = ["a", "b", "c"], [], M.means
    monkeypatch.setattr(M, "means", lambda *a: made.append(a) or plain_means(*a))
    for name, params in (("gbt", {"maxIter": 5, "maxDepth": 3}), ("decision_tree", {})):
        made.clear()
        model = M.fit(df, cols, "y", name, "regression", **params)
        assert len(made) == 1 and model.stages[-1].getWeightCol() == "__weight"
        plain = M.Pipeline(stages=[M.preparation(df, cols), M.estimator(name, "regression", **params)]).fit(df.withColumn("label", F.col("y").cast("double")))
        said = lambda m: np.array([r["yhat"] for r in M.score_table(m, df, "y", "regression", ["id"]).orderBy("id").collect()])
        assert np.allclose(said(model), said(plain)) and np.allclose(model.stages[-1].featureImportances.toArray(), plain.stages[-1].featureImportances.toArray())
        rows = M.score_rows(model, df, cols, "y", "regression")
        want = M.score_table(plain, df, "y", "regression", [])
        assert rows.columns == ["y", "yhat"] and rows.count() == 5000
        assert np.allclose(EV.regression(rows).toPandas().to_numpy(dtype=float), EV.regression(want).toPandas().to_numpy(dtype=float))
    made.clear()
    M.fit(df, cols, "y", "gbt", "regression", maxIter=1, lossType="absolute")
    M.fit(df, cols, "y", "decision_tree", "regression", minInstancesPerNode=500)
    M.fit(df, [*cols, "id"], "y", "decision_tree", "regression")
    assert not made
    with pytest.raises(Exception, match="(?i)label"):
        M.fit(df.withColumn("y", F.when(F.col("id") != 5, F.col("y"))), cols, "y", "gbt", "regression", maxIter=1)


def test_permuted_predictions_are_looked_up(spark, monkeypatch):
    """Few different features are predicted once; the scores are those of predicting every permuted row, whatever the partitions."""
    df = spark.range(4000).selectExpr("id AS k", "CASE WHEN id % 9 = 0 THEN NULL ELSE CAST(id % 5 AS DOUBLE) END AS a", "concat('t', id % 3) AS b", "id % 2 AS c",
                                      "CASE WHEN id % 41 = 0 THEN NULL ELSE 3.0D * (id % 5) + (id % 3) + (crc32(CAST(id AS STRING)) % 1000) / 500.0D END AS y")
    reg = M.fit(df.where("y IS NOT NULL"), ["a", "b", "c"], "y", "linear", "regression")
    two = df.withColumn("y", (F.col("y") > 7).cast("int"))
    cls = M.fit(two.where("y IS NOT NULL"), ["a", "b", "c"], "y", "decision_tree", "classification")
    monkeypatch.setattr(M, "CLASS_ROWS", 700)
    moved, score, looked = [], M.score_table, M.predicted_swaps
    monkeypatch.setattr(M, "score_table", lambda m, t, *a, **k: moved.append(t) or score(m, t, *a, **k))
    said = lambda m, t, kind, cols: {r["feature"]: (r["importance"], r["std"]) for r in M.permutation_importance(m, t, cols, "y", kind, ["k"], 4, at_once=2).collect()}
    for model, table, kind in ((reg, df, "regression"), (cls, two, "classification")):
        moved.clear()
        got = said(model, table, kind, ["a", "b"])
        assert len(moved) == 1 and moved[0] is table  # the base only: no repeat of the rows is predicted
        assert got["a"][0] > .1 and got["a"][1] > 0
        assert got["a"] == pytest.approx(said(model, table.repartition(7), kind, ["a", "b"])["a"])
        monkeypatch.setattr(M, "predicted_swaps", lambda *a: None)
        each = said(model, table, kind, ["a", "b"])
        assert len(moved) > 3 and all(got[c] == pytest.approx(each[c]) for c in ("a", "b"))
        monkeypatch.setattr(M, "predicted_swaps", looked)
    monkeypatch.setattr(M, "SWAPS", 10)
    assert M.predicted_swaps(reg, df, ["a", "b"], "y", "regression", ["k"]) is None
