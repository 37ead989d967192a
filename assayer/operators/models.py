"""Model fitting on Spark MLlib: preparation, model families, tuning, cross-validation, importance, stability."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml import classification as MC
from pyspark.ml import regression as MR
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import (
    HashingTF, IDF, Imputer, OneHotEncoder, RegexTokenizer, StandardScaler, StringIndexer, VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.values import as_col, number, once, pearson, unit_hash, unit_hash64
from assayer.operators.evaluate import stability
from assayer.operators.sample import bootstrap, folds
from assayer.plans.columns import dtype, numeric_columns, text_columns
from assayer.plans.gram import complete, least_squares
from assayer.plans.perceptron import solve
from assayer.plans.permuted import by_class, in_classes, paired, permutation
from assayer.session import cut, ensure_checkpoint_dir

# ---- fixed values: parameter values per family ------------------------------------------------
# Named as MLlib names them: an unbounded depth is MLlib's largest, 30; C is 1 / regParam; l1 and l2 are elasticNetParam 1 and 0
# (linear_svc has l2 only); a smallest leaf is minInstancesPerNode, and a smallest split has no counterpart.
GRIDS = {
    "ridge": {"regParam": [.1, 1.0, 10.0, 100.0]},
    "lasso": {"regParam": [.01, .1, 1.0, 10.0]},
    "elastic_net": {"regParam": [.1, 1.0, 10.0], "elasticNetParam": [.1, .5, .9]},
    "random_forest": {"numTrees": [100, 200, 500], "maxDepth": [10, 20, 30], "minInstancesPerNode": [1, 2]},
    "gbt": {"maxIter": [100, 200], "stepSize": [.01, .1, .2], "maxDepth": [3, 6]},
    "decision_tree": {"maxDepth": [10, 20, 30]},
    "logistic": {"regParam": [10.0, 1.0, .1], "elasticNetParam": [1.0, 0.0]},
    "linear_svc": {"regParam": [10.0, 1.0, .1]},
}
CLASS_ROWS = 50_000  # rows of one class of a permutation
WEIGHTED = ("decision_tree", "gbt")  # classifiers that draw no rows: a row of weight n is n equal rows
BY_MEANS = ("decision_tree", "gbt")  # regressions by squared error that draw no rows: rows of equal features are one row of their mean
FEW = 4  # equal rows are counted where that leaves at most one row of so many
LOOKUP_ROWS = 100_000  # different rows that are predicted once and sent to all tasks, at most
SWAPS = 1_000_000  # predictions that tasks look up, of all columns
TREE_ROWS = 250_000  # a forest is fitted tree by tree where its different rows are at most so many
ROWS_A_TASK = 50_000  # of a single tree
# -------------------------------------------------------------------------------------------


def estimator(name: str, kind: str, seed: int = 42, **params):
    """An MLlib estimator of a family; ``kind`` is regression or classification."""
    made = {
        ("linear", "regression"): lambda: MR.LinearRegression(),
        ("ridge", "regression"): lambda: MR.LinearRegression(regParam=1.0, elasticNetParam=0.0),
        ("lasso", "regression"): lambda: MR.LinearRegression(regParam=.1, elasticNetParam=1.0),
        ("elastic_net", "regression"): lambda: MR.LinearRegression(regParam=.1, elasticNetParam=.5),
        ("random_forest", "regression"): lambda: MR.RandomForestRegressor(seed=seed),
        ("gbt", "regression"): lambda: MR.GBTRegressor(seed=seed),
        ("decision_tree", "regression"): lambda: MR.DecisionTreeRegressor(seed=seed),
        ("random_forest", "classification"): lambda: MC.RandomForestClassifier(seed=seed),
        ("gbt", "classification"): lambda: MC.GBTClassifier(seed=seed),
        ("decision_tree", "classification"): lambda: MC.DecisionTreeClassifier(seed=seed),
        ("logistic", "classification"): lambda: MC.LogisticRegression(),
        ("linear_svc", "classification"): lambda: MC.LinearSVC(),
        ("naive_bayes", "classification"): lambda: MC.NaiveBayes(modelType="gaussian"),
        ("mlp", "classification"): lambda: MC.MultilayerPerceptronClassifier(seed=seed, maxIter=50),
    }[name, kind]()
    return made.setParams(**params) if params else made


def preparation(df: DataFrame, features: Sequence[str], scale: bool = False) -> Pipeline:
    """Impute, index and one-hot, assemble and optionally standardise the features."""
    nums, texts = numeric_columns(df, features), text_columns(df, features)
    stages: list = []
    if nums:
        stages.append(Imputer(inputCols=nums, outputCols=[f"{c}__n" for c in nums]))
    if texts:
        stages.append(StringIndexer(inputCols=texts, outputCols=[f"{c}__i" for c in texts], handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[f"{c}__i" for c in texts], outputCols=[f"{c}__v" for c in texts]))
    raw = "features_raw" if scale else "features"
    stages.append(VectorAssembler(inputCols=[f"{c}__n" for c in nums] + [f"{c}__v" for c in texts], outputCol=raw))
    if scale:
        stages.append(StandardScaler(inputCol=raw, outputCol="features", withMean=True, withStd=True))
    return Pipeline(stages=stages)


def with_label(df: DataFrame, target: str, kind: str) -> tuple[DataFrame, list]:
    """``label`` as a double; classes are numbered in sort order (a class table has few rows by definition)."""
    if kind == "regression" or target in numeric_columns(df):
        return df.withColumn("label", number(target, dtype(df, target))), []
    model = StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc").fit(df)
    return model.transform(df), list(model.labels)


def fit(df: DataFrame, features: Sequence[str], target: str, name: str, kind: str, scale: bool = False, **params) -> PipelineModel:
    data, labels = with_label(df, target, kind)
    if name == "mlp" and kind == "classification":
        few = params.get("solver", "l-bfgs") == "l-bfgs" and repeats(data, [*features, "label"])
        rows, prep = counted(data, [*features, "label"]) if few else data, preparation(df, features, scale).fit(df)
        if "layers" not in params:
            width = len(prep.transform(df.limit(1)).select("features").first()["features"])
            params["layers"] = [width, 8, max(2, len(labels) or rows.select("label").distinct().count())]
        return fit_perceptron(rows, prep, **params) if few else PipelineModel([prep, estimator(name, kind, **params).fit(prep.transform(data))])
    ensure_checkpoint_dir(df.sparkSession)  # boosting cuts its lineage there
    by_rows = {"minInstancesPerNode", "subsamplingRate", "bootstrap"} & set(params)  # these count or draw rows, whatever their weight
    if kind == "classification" and name in (*WEIGHTED, "random_forest") and not by_rows:
        most = TREE_ROWS if name == "random_forest" else None
        if repeats(data, [*features, "label"], most):
            rows, prep = counted(data, [*features, "label"]), preparation(df, features, scale).fit(data)
            return fit_trees(rows, features, prep, **params) if most else fit_counted(rows, prep, name, kind, **params)
    squared = str(params.get("lossType", "squared")).lower() == "squared" and not {"validationIndicatorCol", "weightCol"} & set(params)
    if kind == "regression" and name in BY_MEANS and squared and not by_rows and repeats(data, features):
        return fit_counted(means(data, features), preparation(df, features, scale).fit(data), name, kind, **params)
    return Pipeline(stages=[preparation(df, features, scale), estimator(name, kind, **params)]).fit(data)


def repeats(df: DataFrame, cols: Sequence[str], most: int | None = None) -> bool:
    """Whether the rows of ``cols`` are few different ones (and at most ``most``), by a sketch of some percent."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64(*[as_col(c) for c in cols])).alias("k")).first()
    return row["k"] * FEW <= row["n"] and (most is None or row["k"] <= most)


def counted(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(*cols, __weight): equal rows counted map-side and cut, so that a fit's passes read each different row once."""
    return cut(df.groupBy(*[as_col(c) for c in cols]).agg(F.count(F.lit(1)).cast("double").alias("__weight")))


def means(data: DataFrame, features: Sequence[str]) -> DataFrame:
    """(*features, label, __weight): the mean label and the number of the rows of equal features, cut.

    Squared error over rows is that over these means plus a part that no split changes, so trees gain by the same splits.  A
    label that is missing or not finite makes its mean so, and MLlib turns it down as it does with rows.
    """
    label = F.when(F.count("label") == F.count(F.lit(1)), F.avg("label")).alias("label")
    return cut(data.groupBy(*[as_col(c) for c in features]).agg(label, F.count(F.lit(1)).cast("double").alias("__weight")))


def fit_counted(rows: DataFrame, prep: PipelineModel, name: str, kind: str, **params) -> PipelineModel:
    """A WEIGHTED family fitted to counted rows; ``prep`` is fitted by the caller, as its means and orders go by all rows."""
    return PipelineModel([prep, estimator(name, kind, weightCol="__weight", **params).fit(prep.transform(rows))])


def fit_perceptron(rows: DataFrame, prep: PipelineModel, **params) -> PipelineModel:
    """A perceptron fitted to counted rows (``plans.perceptron``); ``prep`` is fitted by the caller.

    MLlib checks the rows, draws the first weights and makes the model; a model's ``summary`` is of one row, not of the fit.
    """
    est = estimator("mlp", "classification", **params)
    data = prep.transform(rows).select("features", "label", "__weight").coalesce(-(-rows.count() // ROWS_A_TASK)).cache()
    try:
        start = est.fit(data, {est.maxIter: 0}).weights
        flat = data.select(vector_to_array("features"), "label", "__weight")
        weights = solve(flat, est.getLayers(), start.toArray(), est.getMaxIter(), est.getTol())
        model = est.fit(data.limit(1), {est.maxIter: 0, est.initialWeights: Vectors.dense(weights)})
    finally:
        data.unpersist()
    return PipelineModel([prep, model])


def drawn(rows: DataFrame, features: Sequence[str], times: int, seed: int) -> DataFrame:
    """Counted rows with ``__drawn``: how often each of ``times`` bootstrap samples holds a row of ``__weight`` equal rows.

    A bootstrap takes every single row a Poisson number of times of mean 1, so n equal rows together a Poisson number of mean n.
    """
    @F.pandas_udf("array<bigint>")
    def poisson(n: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng([seed, k & (1 << 64) - 1]).poisson(w, times) for w, k in zip(n, h)])

    return rows.withColumn("__drawn", poisson("__weight", F.xxhash64(*[as_col(c) for c in features], "label")))


def fit_trees(rows: DataFrame, features: Sequence[str], prep: PipelineModel, numTrees: int = 20, featureSubsetStrategy: str = "auto",
              seed: int = 42, parallelism: int = 8, **params) -> PipelineModel:
    """A random forest for classes fitted tree by tree to counted rows; ``prep`` is fitted by the caller.

    A tree weighs a row of n by a draw of its own (``drawn``), so the time of the trees goes by the different rows only.
    """
    if featureSubsetStrategy == "auto":
        featureSubsetStrategy = "all" if numTrees == 1 else "sqrt"
    n, top = rows.agg(F.count(F.lit(1)), F.max("label")).first()
    classes = {"ml_attr": {"type": "nominal", "name": "label", "num_vals": int(top) + 1}}  # also of a tree that draws no row of the last
    data = prep.transform(drawn(rows, features, numTrees, seed)).select(F.col("label").alias("label", metadata=classes), "features", "__drawn")
    data = data.coalesce(-(-n // ROWS_A_TASK)).cache()

    def tree(t: int):
        own = data.select("label", "features", F.col("__drawn")[t].cast("double").alias("__weight")).where("__weight > 0")
        return estimator("random_forest", "classification", seed=seed + t, numTrees=1, bootstrap=False, weightCol="__weight",
                         featureSubsetStrategy=featureSubsetStrategy, **params).fit(own)

    try:
        data.count()
        with ThreadPool(parallelism) as pool:
            trees = pool.map(tree, range(numTrees), chunksize=1)
    finally:
        data.unpersist()
    return PipelineModel([prep, joined(trees)])


def joined(forests: Sequence[MC.RandomForestClassificationModel]) -> MC.RandomForestClassificationModel:
    """One forest of the trees of several, with the parameters of the first; MLlib has no Python call for it."""
    from pyspark import SparkContext

    sc, first = SparkContext._active_spark_context, forests[0]
    made = sc._jvm.org.apache.spark.ml.classification
    own = [t for f in forests for t in f._java_obj.trees()]
    trees = sc._gateway.new_array(made.DecisionTreeClassificationModel, len(own))
    for i, t in enumerate(own):
        trees[i] = t
    forest = made.RandomForestClassificationModel(first.uid, trees, first.numFeatures, first.numClasses).copy(first._java_obj.extractParamMap())
    return MC.RandomForestClassificationModel(forest.set(forest.getParam("numTrees"), len(own)))


def score_counts(model: Transformer, df: DataFrame, features: Sequence[str], target: str, kind: str) -> DataFrame:
    """(y, yhat, weight): a prediction for each different row of features and target where these are few, else for each row."""
    cols = [*features, target]
    if not repeats(df, cols):
        return score_table(model, df, target, kind, []).withColumn("weight", F.lit(1.0))
    return score_table(model, counted(df, cols), target, kind, ["__weight"]).withColumnRenamed("__weight", "weight")


def score_rows(model: Transformer, df: DataFrame, features: Sequence[str], target: str, kind: str) -> DataFrame:
    """(y, yhat) of every row for metrics that take several passes.

    Where the rows of ``features``, all that the model reads, are few different ones, each of these is predicted once and meets
    its rows by broadcast; else the predictions of all rows are cut.
    """
    if not repeats(df, features, LOOKUP_ROWS):
        return cut(score_table(model, df, target, kind, []))
    own = df.groupBy(*[as_col(c).alias(f"__{i}") for i, c in enumerate(features)]).count()
    said = cut(model.transform(own.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(features)])).select(
        *[as_col(c).alias(f"__{i}") for i, c in enumerate(features)], F.col("prediction").alias("yhat")))
    same = [as_col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(features)]
    return with_label(df, target, kind)[0].join(F.broadcast(said), same).select(F.col("label").alias("y"), "yhat")


def score_table(model: Transformer, df: DataFrame, target: str, kind: str, key: Sequence[str], positive: bool = False) -> DataFrame:
    """(key, y, yhat[, p]): the prediction table all metrics work on."""
    out = model.transform(with_label(df, target, kind)[0])
    cols = [*key, F.col("label").alias("y"), F.col("prediction").alias("yhat")]
    if positive and "probability" in out.columns:
        from pyspark.ml.functions import vector_to_array

        cols.append(F.element_at(vector_to_array("probability"), 2).alias("p"))
    return out.select(*cols)


def metric(preds: DataFrame, kind: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """r2 or accuracy, optionally per group; an accuracy also by row weight."""
    if weight:
        hit = (F.col("y") == F.col("yhat")).cast("double")  # null without a label
        return preds.groupBy(*by).agg((F.sum(hit * F.col(weight)) / F.sum(F.when(hit.isNotNull(), F.col(weight)))).alias("score"))
    if kind == "regression":
        e = F.col("y") - F.col("yhat")
        return preds.groupBy(*by).agg((1 - F.avg(e * e) / F.var_pop("y")).alias("score"))
    return preds.groupBy(*by).agg(F.avg((F.col("y") == F.col("yhat")).cast("double")).alias("score"))


def evaluator(kind: str):
    return RegressionEvaluator(metricName="rmse") if kind == "regression" else MulticlassClassificationEvaluator(metricName="accuracy")


def _prepared_fold(data: DataFrame, features: Sequence[str], i: int) -> tuple[DataFrame, DataFrame]:
    """(training, test) rows of fold ``i`` with label and features, prepared by the training rows."""
    train, test = data.where(F.col("fold") != i), data.where(F.col("fold") == i)
    prep = preparation(train, features).fit(train)
    return tuple(prep.transform(part).select("label", "features") for part in (train, test))


def tune(df: DataFrame, features: Sequence[str], target: str, name: str, kind: str, key: Sequence[str], k: int = 3,
         grid: Mapping[str, Sequence] | None = None, draws: int | None = None, parallelism: int = 4, seed: int = 42) -> DataFrame:
    """(params, score, best): grid search, or ``draws`` hashed points of it, over exact hashed folds.

    Folds have the class shares of the table, and the preparation is fitted on the training folds only.
    """
    data, _ = with_label(df, target, kind)
    data = folds(data, key, k, "label" if kind == "classification" else None, seed).cache()
    est = estimator(name, kind)
    build = ParamGridBuilder()
    for p, values in (grid or GRIDS[name]).items():
        build = build.addGrid(getattr(est, p), list(values))
    points = build.build()
    if draws is not None and draws < len(points):
        import hashlib

        points = sorted(points, key=lambda m: hashlib.md5(f"{seed}{sorted((p.name, v) for p, v in m.items())}".encode()).hexdigest())[:draws]
    judge = evaluator(kind)
    data.count()
    try:
        with ThreadPool(parallelism) as pool:
            # a fold's preparation does not depend on the point, so it is fitted once and not once for each point
            parts = pool.map(lambda i: _prepared_fold(data, features, i), range(k))
            jobs = [(i, m) for m in range(len(points)) for i in range(k)]
            each = pool.map(lambda at: judge.evaluate(est.fit(parts[at[0]][0], points[at[1]]).transform(parts[at[0]][1])), jobs)
    finally:
        data.unpersist()
    scores = [sum(each[m * k:(m + 1) * k]) / k for m in range(len(points))]
    best = min(scores) if kind == "regression" else max(scores)
    rows = [(", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda x: x[0].name)), float(s), bool(s == best)) for m, s in zip(points, scores)]
    return df.sparkSession.createDataFrame(rows, "params string, score double, best boolean")


class Passes:
    """Fits on parts of a table and their scores, over counted rows where a WEIGHTED family has few different ones.

    ``parts`` are the columns that the conditions name.  Counted rows need the whole table again only for the means of
    missing numbers and the order of texts; without either a preparation is the same on them.
    """

    def __init__(self, data: DataFrame, df: DataFrame, features: Sequence[str], target: str, name: str, kind: str, parts: Sequence[str]):
        self.features, self.target, self.name, self.kind = list(features), target, name, kind
        self.rows, self.whole = None, data
        if kind == "classification" and name in WEIGHTED and repeats(df, [*features, target]):
            self.rows = counted(data, [*features, target, *parts])
            gaps = self.rows.where(F.greatest(*[number(c, dtype(df, c)).isNull() for c in features], F.lit(False))).limit(1).count()
            self.exact = bool(gaps or text_columns(df, features))
        if self.rows is None or self.exact:
            self.whole = data.cache()

    def scores(self, train, test) -> dict[bool, float | None]:
        """The score on the rows of ``train`` (False) and ``test`` (True) of the model of ``train``."""
        if self.rows is None:
            rows, weight = self.whole, None
            model = fit(rows.where(train), self.features, self.target, self.name, self.kind)
        else:
            rows, weight = with_label(self.rows, self.target, self.kind)[0], "__weight"
            fitted = rows.where(train).groupBy(*[as_col(c) for c in self.features], "label").agg(F.sum("__weight").alias("__weight"))
            prep = preparation(rows, self.features).fit(self.whole.where(train) if self.exact else rows.where(train))
            model = fit_counted(fitted, prep, self.name, self.kind)
        both = rows.where(train | test).withColumn("__part", test)
        keep = ["__part", weight] if weight else ["__part"]
        return {r["__part"]: r["score"] for r in metric(score_table(model, both.drop("label"), self.target, self.kind, keep), self.kind, ["__part"], weight).collect()}

    def close(self) -> None:
        self.whole.unpersist()


def cross_validate(df: DataFrame, features: Sequence[str], target: str, name: str, kind: str, key: Sequence[str], k: int = 5) -> DataFrame:
    """Mean and deviation of the fold scores; folds have the class shares of the table."""
    data = folds(df, key, k, target if kind == "classification" else None)
    at = Passes(data, df, features, target, name, kind, ["fold"])
    try:
        scores = [(i, at.scores(F.col("fold") != i, F.col("fold") == i).get(True)) for i in range(k)]
    finally:
        at.close()
    return df.sparkSession.createDataFrame(scores, "fold int, score double").agg(
        F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"), F.count(F.lit(1)).alias("folds"))


def importance(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(feature, importance): tree importances or absolute coefficients by slot of the feature vector."""
    last = model.stages[-1]
    vals = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    names: list[str] = [""] * len(vals)
    for block in df.schema["features"].metadata["ml_attr"]["attrs"].values():
        for a in block:
            names[a["idx"]] = a["name"].replace("__n", "").replace("__v_", "=")
    return df.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(names, vals)], "feature string, importance double")


def recursive_elimination(df: DataFrame, features: Sequence[str], target: str, kind: str, keep: int) -> DataFrame:
    """(feature, dropped_at): the least important feature of a small forest goes in every round."""
    left, rows = list(features), []
    while len(left) > keep:
        model = fit(df, left, target, "random_forest", kind, numTrees=10)
        imp = {r["feature"]: r["importance"] for r in importance(model, model.transform(with_label(df, target, kind)[0])).collect()}
        worst = min(left, key=lambda c: (sum(v for f, v in imp.items() if f == c or f.startswith(f"{c}=")), c))
        left.remove(worst)
        rows.append((worst, len(rows) + 1))
    return df.sparkSession.createDataFrame([*rows, *[(c, None) for c in left]], "feature string, dropped_at int")


def learning_curve(df: DataFrame, features: Sequence[str], target: str, name: str, kind: str, key: Sequence[str],
                   sizes: Sequence[float] = tuple(i / 10 for i in range(1, 11)), k: int = 5, parallelism: int = 4) -> DataFrame:
    """Per size: mean and deviation over ``k`` folds of the score on the training rows and on the fold left out.

    The training rows are hashed prefixes of the other folds.  Every row also carries the whole curve's ``convergence_rate``
    (mean step of the test means over the later half), ``overfitting_score`` (mean gap of the last three sizes) and
    ``final_gap``.  Two numbers per fit reach the driver.
    """
    step = F.lit(0)  # how many sizes a row is beyond; it trains from the next size on
    for x in sizes:
        step = step + (F.col("__u") >= x).cast("int")
    data = once(folds(df, key, k, target if kind == "classification" else None), {"__u": unit_hash(key, "curve")}).withColumn("__step", step).drop("__u")
    at = Passes(data, df, features, target, name, kind, ["fold", "__step"])
    rank = {x: sum(y <= x for y in sizes) for x in sizes}

    def point(of: tuple[float, int]) -> tuple[float, int, float | None, float | None]:
        size, i = of
        got = at.scores((F.col("fold") != i) & (F.col("__step") < rank[size]), F.col("fold") == i)
        return float(size), i, got.get(False), got.get(True)

    try:
        with ThreadPool(parallelism) as pool:
            points = pool.map(point, [(s, i) for s in sizes for i in range(k)])
    finally:
        at.close()
    curve = df.sparkSession.createDataFrame(points, "size double, fold int, train double, test double").groupBy("size").agg(
        *[f(c).alias(f"{c}_{n}") for c in ("train", "test") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    rows = F.array_sort(F.collect_list(F.struct("size", "test_mean", (F.col("train_mean") - F.col("test_mean")).alias("gap"))))
    m, half = len(sizes), len(sizes) // 2
    at = lambda i, c: F.col("rows")[i][c]
    last = range(max(0, m - 3), m)
    facts = curve.agg(rows.alias("rows")).select(
        ((at(m - 1, "test_mean") - at(half, "test_mean")) / (m - 1 - half) if m >= 3 else F.lit(0.0)).alias("convergence_rate"),
        (sum((at(i, "gap") for i in last), F.lit(0.0)) / len(last)).alias("overfitting_score"), at(m - 1, "gap").alias("final_gap"))
    return curve.crossJoin(F.broadcast(facts))


def perturbed(model: Transformer, copies: DataFrame, target: str, kind: str, weight: str | None = None) -> DataFrame:
    """Score per ``level`` of perturbed copies of a table, all levels in one pass."""
    return metric(score_table(model, copies, target, kind, ["level", weight] if weight else ["level"]), kind, ["level"], weight)


def noise_copies(df: DataFrame, cols: Sequence[str], levels: Sequence[float], key: Sequence[str]) -> DataFrame:
    """Per level the rows with normal noise of so many standard deviations, drawn for each row, level and column.

    The normal is of two uniform numbers (Box and Muller): code that the JVM compiles however many columns there are.
    """
    from assayer.operators.profile import mean_std

    sd = {c: s or 0.0 for c, (_, s) in mean_std(df, cols).items()}
    each = df.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    at = [*key, "level"]
    drawn = lambda c: F.sqrt(-2 * F.ln(unit_hash64(at, f"noise-{c}"))) * F.cos(2 * math.pi * unit_hash64(at, f"turn-{c}"))
    noisy = once(each, {f"__n_{c}": number(c, dtype(df, c)) + drawn(c) * F.col("level") * sd[c] for c in cols})  # models refer to them many times
    return noisy.select(*[F.col(f"`__n_{c}`").alias(c) if c in cols else as_col(c) for c in each.columns])


def dropout_copies(df: DataFrame, cols: Sequence[str], rates: Sequence[float]) -> DataFrame:
    """Per rate the hashed first int(rate * features) features are zeroed."""
    import hashlib

    order = sorted(cols, key=lambda c: hashlib.md5(c.encode()).hexdigest())
    each = df.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in rates])))
    return each.withColumns({c: F.when(F.floor(F.col("level") * len(cols)) > i, F.lit(0.0)).otherwise(number(c, dtype(df, c))) for i, c in enumerate(order)})


class Stability:
    """The parts of a model's stability on a table, each a table of one row and one column, none of which runs another.

    Where a class is predicted and the rows without ``key`` are few different ones, dropout, bootstrap and the base score go
    over counted rows.  Noise is drawn for every row, and every row is predicted twice for ``repeat``.
    """

    def __init__(self, model: Transformer, df: DataFrame, cols: Sequence[str], target: str, kind: str, key: Sequence[str]):
        self.model, self.df, self.cols, self.target, self.kind, self.key = model, df, list(cols), target, kind, list(key)
        self._counted: list[DataFrame | None] = []
        self._base: list[DataFrame] = []

    def counted(self) -> DataFrame | None:
        """Equal rows counted once, None where they are not few."""
        if not self._counted:
            own = [c for c in self.df.columns if c not in self.key or c in (*self.cols, self.target)]
            self._counted.append(counted(self.df, own) if self.kind == "classification" and repeats(self.df, own) else None)
        return self._counted[0]

    def scored(self) -> tuple[DataFrame, str | None]:
        """The prediction table and its column of weights, if any."""
        if (rows := self.counted()) is None:
            return score_table(self.model, self.df, self.target, self.kind, self.key), None
        return score_table(self.model, rows, self.target, self.kind, ["__weight"]), "__weight"

    def retained(self, scores: DataFrame, name: str) -> DataFrame:
        """Mean over the levels of a score against that of the table as it is."""
        if not self._base:
            preds, weight = self.scored()
            self._base.append(cut(metric(preds, self.kind, (), weight).select(F.col("score").alias("base"))))
        return scores.crossJoin(F.broadcast(self._base[0])).agg(F.avg(F.try_divide(F.col("score"), F.col("base"))).alias(name))

    def noise(self, levels: Sequence[float] = (.01, .05, .1, .2)) -> DataFrame:
        return self.retained(perturbed(self.model, noise_copies(self.df, self.cols, levels, self.key), self.target, self.kind), "noise")

    def dropout(self, rates: Sequence[float] = (.1, .2, .3, .5)) -> DataFrame:
        rows = self.counted()
        copies = dropout_copies(self.df if rows is None else rows, self.cols, rates)
        return self.retained(perturbed(self.model, copies, self.target, self.kind, None if rows is None else "__weight"), "dropout")

    def bootstrap(self, rounds: int = 50, seed: int = 42) -> DataFrame:
        """A row is drawn a Poisson number of times of mean 1 a round; n rows of one label and prediction together one of mean n."""
        preds, weight = self.scored()
        if self.kind == "regression":
            e = F.col("y") - F.col("yhat")
            w = F.col("weight")
            my = F.sum(w * F.col("y")) / F.sum(w)
            score = 1 - F.sum(w * e * e) / (F.sum(w * F.col("y") * F.col("y")) - F.sum(w) * my * my)
            boots = bootstrap(cut(preds), self.key, rounds, seed)
        else:
            score = F.sum(F.col("weight") * (F.col("y") == F.col("yhat")).cast("double")) / F.sum("weight")
            many = F.sum(weight) if weight else F.count(F.lit(1)).cast("double")
            cells = preds.groupBy(F.col("y").alias("label"), "yhat").agg(many.alias("__weight"))
            boots = drawn(cells, ["yhat"], rounds, seed).select(F.col("label").alias("y"), "yhat", F.posexplode("__drawn").alias("round", "weight"))
        return boots.groupBy("round").agg(score.alias("score")).agg((1 - F.stddev_pop("score") / (F.avg("score") + 1e-8)).alias("bootstrap"))

    def repeat(self) -> DataFrame:
        first = self.model.transform(self.df).select(*self.df.columns, F.col("prediction").alias("__first"))  # both predictions on the row itself
        same = F.bool_and(F.col("__first") == F.col("prediction"))
        r = F.coalesce(pearson(F.col("__first"), F.col("prediction")), F.lit(0.0))
        return self.model.transform(first).agg(F.when(~same, r).otherwise(1.0).alias("repeat"))


def stability_table(model: Transformer, df: DataFrame, cols: Sequence[str], target: str, kind: str, key: Sequence[str],
                    noise: Sequence[float] = (.01, .05, .1, .2), dropout: Sequence[float] = (.1, .2, .3, .5), rounds: int = 50) -> DataFrame:
    """Score retention under noise and dropout, bootstrap stability, repeatability and the weighted total."""
    of = Stability(model, df, cols, target, kind, key)
    out = of.noise(noise).crossJoin(of.dropout(dropout)).crossJoin(of.bootstrap(rounds)).crossJoin(of.repeat())
    return out.withColumn("overall", stability(F.col("noise"), F.col("dropout"), F.col("bootstrap"), F.col("repeat")))


def permutation_importance(model: Transformer, df: DataFrame, cols: Sequence[str], target: str, kind: str, key: Sequence[str], repeats: int = 30,
                           at_once: int = 10) -> DataFrame:
    """Mean and deviation of the score drop when a column is shuffled among the rows.

    The rows are dealt to classes of some CLASS_ROWS by a hash of their key, and in each repeat a class permutes its values at
    random, the same way for all columns.  The rows are shuffled once a job and never their repeats.  Where the features (all
    columns but key and target) are few different ones, every value that a column can take in each of them is predicted once,
    and tasks look the predictions up; else ``at_once`` repeats of all columns are predicted in a job.
    """
    base, n = metric(score_table(model, df, target, kind, key), kind).first()["score"], df.count()
    classes = max(1, n // CLASS_ROWS)
    if base is None:
        scores = []
    elif looked_up := predicted_swaps(model, df, cols, target, kind, key):
        scores = _swap_scores(*looked_up, cols, kind, key, classes, repeats)
    else:
        scores = []
        for start in range(0, repeats, at_once):
            both = paired(df, cols, key, classes, range(start, min(start + at_once, repeats)))
            moved = both.withColumn("__col", F.explode(F.array(*[F.lit(c) for c in cols]))).withColumns(
                {c: F.when(F.col("__col") == c, F.col("__other").getField(c)).otherwise(as_col(c)) for c in cols}).drop("__other")
            found = metric(score_table(model, moved, target, kind, ["__rep", "__col"]), kind, ["__rep", "__col"]).collect()
            scores += [(r["__col"], r["score"]) for r in found]
    drops = [(c, base - score) for c, score in scores if score is not None]
    return df.sparkSession.createDataFrame(drops, "feature string, drop double").groupBy("feature").agg(
        F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("std"))


def predicted_swaps(model: Transformer, df: DataFrame, cols: Sequence[str], target: str, kind: str,
                    key: Sequence[str]) -> tuple[DataFrame, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] | None:
    """Every row as key, ``__y`` and ``__id`` of its different features, and for each column what the model predicts with any of its values.

    For a column: the number of the other features by id, that of its own value by id, and the predictions of both numbers.
    None where the different rows are more than LOOKUP_ROWS, the predictions more than SWAPS, or the model leaves rows out.
    """
    features = [c for c in df.columns if c not in key and c != target]
    if not cols or not set(cols) <= set(features) or not repeats(df, features, LOOKUP_ROWS):
        return None
    own = df.groupBy(*[as_col(c) for c in features]).agg(F.count(F.lit(1)).alias("__n")).drop("__n").coalesce(1)
    number_of = lambda by: F.dense_rank().over(Window.orderBy(*[as_col(c) for c in by])) - 1 if by else F.lit(0)
    codes = {f"__r{i}": number_of([f for f in features if f != c]) for i, c in enumerate(cols)} | {f"__v{i}": number_of([c]) for i, c in enumerate(cols)}
    coded = cut(own.withColumns(codes).coalesce(1).withColumn("__id", F.monotonically_increasing_id().cast("int")))  # one task, so without a gap
    at = coded.orderBy("__id").select(*codes).toPandas().to_numpy(dtype=np.int64).reshape(-1, 2, len(cols))
    sizes = at.max(axis=0) + 1
    if int((sizes[0] * sizes[1]).sum()) > SWAPS:
        return None
    tables = []
    for i, c in enumerate(cols):
        rest = coded.dropDuplicates([f"__r{i}"]).select(*[as_col(f) for f in features if f != c], f"__r{i}")
        grid = rest.crossJoin(coded.dropDuplicates([f"__v{i}"]).select(as_col(c), f"__v{i}"))
        found = model.transform(grid).select(f"__r{i}", f"__v{i}", F.col("prediction").cast("double")).toPandas().to_numpy(dtype=float)
        said = np.full(sizes[:, i], np.nan)
        said[found[:, 0].astype(int), found[:, 1].astype(int)] = found[:, 2]
        if np.isnan(said).any():
            return None
        tables.append((at[:, 0, i] * sizes[1, i], at[:, 1, i], said.ravel()))
    names = {c: f"__f{i}" for i, c in enumerate(features)}
    known = F.broadcast(coded.select(*[as_col(c).alias(f) for c, f in names.items()], "__id"))
    rows = with_label(df, target, kind)[0].join(known, [as_col(c).eqNullSafe(F.col(f)) for c, f in names.items()])
    return rows.select(*[as_col(c) for c in key], F.col("label").alias("__y"), "__id"), tables


def _swap_scores(rows: DataFrame, tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]], cols: Sequence[str], kind: str, key: Sequence[str],
                 classes: int, reps: int) -> list[tuple[str, float | None]]:
    """(column, score) of each repeat: tasks add up squared errors or hits of permuted rows, looked up in ``tables``."""
    shared = rows.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, b in by_class(batches):
            y, ids = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("__y", "__id"))
            labelled = ~np.isnan(y)
            placed = [(rest[ids], value[ids], said) for rest, value, said in shared.value]
            out = []
            for rep in range(reps):
                at = permutation(len(ids), rep, own)
                for i, (rest, value, said) in enumerate(placed):
                    e = (y - said[rest + value[at]])[labelled]
                    out.append((rep, i, float(e @ e) if kind == "regression" else float((e == 0).sum()), len(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=schema)

    schema = pa.schema([("rep", pa.int64()), ("col", pa.int64()), ("total", pa.float64()), ("n", pa.int64())])
    dealt = in_classes(rows, key, classes, ["__id", "__y"]).select("__class", "__id", "__y")
    means_ = dealt.mapInArrow(run, "rep long, col long, total double, n long").groupBy("rep", "col").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("m")).collect()
    spread = rows.agg(F.var_pop("__y")).first()[0] if kind == "regression" else None
    return [(cols[r["col"]], r["m"] if kind != "regression" or r["m"] is None else 1 - r["m"] / spread) for r in means_]


def chained_imputation(df: DataFrame, cols: Sequence[str], rounds: int = 5, ridge: float = 1e-3) -> DataFrame:
    """Chained equations: every incomplete column is regressed on the others, in turn, for some rounds.

    A column's regression is one cross-product pass over the rows where it was observed; the table is cut to the
    checkpoint folder after each round so that plans do not grow.
    """
    flags = {c: f"__miss_{c}" for c in cols}
    data = df.withColumns({flags[c]: number(c, dtype(df, c)).isNull() for c in cols})
    gaps = data.agg(*[F.count_if(flags[c]).alias(c) for c in cols]).first()
    holes = [c for c in cols if gaps[c] > 0]
    means = data.agg(*[F.avg(number(c, dtype(df, c))).alias(c) for c in cols]).first()
    data = data.withColumns({c: F.coalesce(number(c, dtype(df, c)), F.lit(means[c])) for c in cols})
    for _ in range(rounds if holes else 0):
        for c in holes:
            rest = [o for o in cols if o != c]
            model = least_squares(complete(data.where(~F.col(flags[c])), [*rest, c]), rest, c, ridge)
            data = data.withColumn(c, F.when(F.col(flags[c]), model.predict()).otherwise(F.col(c)))
        data = cut(data)
    return data.drop(*flags.values())


def text_features(df: DataFrame, col: str, method: str = "tfidf", size: int = 1 << 12) -> DataFrame:
    """Word features of whole texts: adds ``text_features``, a vector of ``size`` hashed slots for tfidf and hash.

    For count it is a map of every word to its count: the whole vocabulary, and no list of it anywhere.
    """
    words = RegexTokenizer(inputCol=col, outputCol="__words", pattern=r"\W+", gaps=True).transform(df)
    if method == "count":
        w = F.col("__words")
        rows = words.withColumn("__words", F.array_sort(w)).withColumn("__at", F.when(F.size(w) > 0, F.filter(
            F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))).otherwise(F.array().cast("array<int>")))
        ends = F.concat(F.slice("__at", F.lit(2), F.size("__at")), F.array(F.size(w)))  # where the next word begins
        counts = F.zip_with("__at", ends, lambda a, b: F.struct(F.get(w, a), (b - a).cast("bigint")))
        return rows.withColumn("text_features", F.map_from_entries(F.filter(counts, lambda e: e["col1"].isNotNull()))).drop("__words", "__at")
    tf = HashingTF(inputCol="__words", outputCol="__tf" if method == "tfidf" else "text_features", numFeatures=size).transform(words)
    if method == "hash":
        return tf.drop("__words")
    return IDF(inputCol="__tf", outputCol="text_features").fit(tf).transform(tf).drop("__words", "__tf")
