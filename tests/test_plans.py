"""The shared building blocks against pandas/numpy on small tables with hot values, ties and nulls."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from assayer.operators.patterns import sequential
from assayer.plans import ordered as O
from assayer.plans.columns import distinct_counts, long_agg
from assayer.plans.lookup import lookup_join
from assayer.plans.quantiles import even_quantiles, exact_quantiles, order_statistics


def hot_frame(spark, n=4000, seed=1):
    """A third of all rows share one key and one value."""
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"id": np.arange(n), "k": np.where(rng.random(n) < .34, 7, rng.integers(0, 40, n)),
                        "v": np.where(rng.random(n) < .34, 5.0, rng.normal(0, 10, n).round(2))})
    pdf.loc[rng.random(n) < .1, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return pdf, df


def test_exact_quantiles_match_numpy_even_when_every_scan_is_forced(spark):
    pdf, df = hot_frame(spark)
    probs = [0, .01, .25, .5, .66, .75, .99, 1]
    want = np.nanquantile(pdf["v"], probs)
    for accuracy, settle in ((1000, 200_000), (20, 50), (8, 10)):
        got = exact_quantiles(df, ["v"], probs, accuracy=accuracy, settle=settle)["v"]
        assert np.allclose(got, want), (accuracy, settle)


def test_even_quantiles_and_order_statistics(spark):
    pdf, df = hot_frame(spark, 700)
    vals = np.sort(pdf["v"].dropna())
    assert np.allclose(even_quantiles(df, "v", 101), np.quantile(vals, np.linspace(0, 1, 101)))
    got, n = order_statistics(df, "v", lambda n: [0, 3, n - 4, n - 1])
    assert n == len(vals) and np.allclose(got, vals[[0, 3, -4, -1]])


def test_quantiles_of_empty_and_single(spark):
    empty = spark.createDataFrame([], "x double")
    assert exact_quantiles(empty, ["x"], [.5])["x"] == [None]
    one = spark.createDataFrame([(3.0,)], "x double")
    assert exact_quantiles(one, ["x"], [.25, .5])["x"] == [3.0, 3.0]


def test_running_sums_row_numbers_and_neighbours_across_ranges(spark):
    pdf, df = hot_frame(spark)
    pdf = pdf.sort_values(["k", "id"])
    got = O.running_sums(df.fillna(0.0, ["v"]), {"s": F.col("v")}, ["id"], ["k"]).toPandas().sort_values(["k", "id"])
    assert np.allclose(got["s"], pdf.fillna({"v": 0}).groupby("k")["v"].cumsum())
    rn = O.row_numbers(df, ["id"], ["k"]).toPandas().sort_values(["k", "id"])
    assert (rn["rn"].to_numpy() == pdf.groupby("k").cumcount().to_numpy() + 1).all()
    nb = O.neighbours(df, "v", ["id"], ["k"]).select("id", "k", F.col("prev.v").alias("f"), F.col("next.v").alias("b")).toPandas().sort_values(["k", "id"])
    assert np.allclose(nb["f"], pdf.groupby("k")["v"].ffill(), equal_nan=True)
    assert np.allclose(nb["b"], pdf.groupby("k")["v"].bfill(), equal_nan=True)


def test_lags_with_tiles_smaller_than_a_key(spark):
    pdf, df = hot_frame(spark)
    got = O.lags(df, ["v"], [1, 7], ["id"], ["k"], tile=10).toPandas().sort_values(["k", "id"])
    pdf = pdf.sort_values(["k", "id"])
    for k in (1, 7):
        assert np.allclose(got[f"v_lag_{k}"], pdf.groupby("k")["v"].shift(k), equal_nan=True)
    whole = O.successive(df, "v", ["id"]).toPandas().sort_values("id")
    assert np.allclose(whole["before"], pdf.sort_values("id")["v"].shift(1), equal_nan=True)


def test_lookup_join_by_hot_keys_equals_broadcast(spark):
    _, df = hot_frame(spark)
    df = df.withColumn("k", F.when(F.col("id") % 10 != 0, F.col("k")))
    dim = spark.range(0, 30).select(F.col("id").alias("k"), (F.col("id") * 2).alias("n"))
    for how in ("left", "inner"):
        want = sorted(map(tuple, lookup_join(df, dim, ["k"], how).select("id", "k", "n").collect()))
        got = sorted(map(tuple, lookup_join(df, dim, ["k"], how, broadcast_rows=1, hot_keys=3).select("id", "k", "n").collect()),
                     key=lambda r: r[0])
        assert got == sorted(want, key=lambda r: r[0]), how


def test_lookup_join_of_equal_narrow_rows_is_balanced(spark):
    """One value in nine tenths of identical one-column rows: they are not shuffled, and no output partition holds them all."""
    df = spark.range(0, 20_000, 1, 8).select(F.when(F.col("id") % 10 != 0, F.lit(7)).otherwise(F.col("id") % 997).cast("long").alias("k"))
    dim = spark.range(0, 1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("n"))
    out = lookup_join(df, dim, ["k"], broadcast_rows=1, hot_keys=5)
    sizes = [r["m"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("m")).collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 4_000
    assert out.where("n <> 2 * k or n is null").count() == 0


def test_scans_do_not_grow_with_the_columns(spark, tmp_path):
    """The record of a wide table comes from one scan, after three for the quartiles of all columns."""
    from assayer.operators.profile import profile

    wide = spark.range(0, 500).select(*[(F.col("id") % (i + 3)).cast("double").alias(f"c{i}") for i in range(30)],
                                      *[F.concat(F.lit("t"), F.col("id") % (i + 2)).alias(f"s{i}") for i in range(10)])
    wide.write.parquet(str(tmp_path / "wide"))
    df = spark.read.parquet(str(tmp_path / "wide"))
    counts = distinct_counts(df, df.columns)
    out = profile(df)
    for frame in (counts, out):
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    got = {r["column_name"]: r for r in out.collect()}
    pdf = df.toPandas()
    for c in ("c0", "c17", "c29"):
        assert np.isclose(got[c]["mean"], pdf[c].mean()) and np.isclose(got[c]["std"], pdf[c].std())
        assert np.isclose(got[c]["q25"], pdf[c].quantile(.25)) and got[c]["unique_count"] == pdf[c].nunique()
    assert {r["column_name"]: r["unique_count"] for r in counts.collect()} == {c: pdf[c].nunique() for c in pdf}


def test_long_texts_and_empty_tables_are_counted(spark):
    from assayer.operators.profile import profile

    df = spark.createDataFrame([("x" * 40,), ("x" * 41,), ("x" * 40,), (None,), ("",)], "t string")
    assert distinct_counts(df, ["t"]).first()["unique_count"] == 3
    empty = spark.createDataFrame([], "t string, v double")
    got = {r["column_name"]: (r["count"], r["missing_count"], r["unique_count"], r["mean"]) for r in profile(empty).collect()}
    assert got == {"t": (0, 0, 0, None), "v": (0, 0, 0, None)}


def test_profile_keeps_digits_far_from_zero(spark):
    """A narrow column at a large offset: sums about zero would lose the deviation."""
    from assayer.operators.profile import profile

    v = [1e9 + x for x in (0.0, 0.25, 0.5, 1.0, 4.0)]
    got = profile(spark.createDataFrame([(x,) for x in v], "v double")).first()
    s = pd.Series(v)
    m = (s - 1e9) - (s - 1e9).mean()
    assert np.isclose(got["std"], s.std(), rtol=1e-9) and np.isclose(got["mean"], s.mean(), rtol=1e-15)
    assert np.isclose(got["skewness"], (m ** 3).mean() / (m ** 2).mean() ** 1.5)
    assert np.isclose(got["kurtosis"], (m ** 4).mean() / (m ** 2).mean() ** 2 - 3)


def test_long_agg_splits_scans_and_counts_distinct(spark):
    pdf, df = hot_frame(spark)
    wide = df.select(*[F.col("v").alias(f"c{i}") for i in range(30)])
    rows = {r["column_name"]: r for r in long_agg(wide, wide.columns, {"m": lambda c: F.avg(c), "n": lambda c: F.count(c)}, distinct="u").collect()}
    assert len(rows) == 30 and all(r["u"] == pdf["v"].nunique() and np.isclose(r["m"], pdf["v"].mean()) for r in rows.values())
    assert {r["column_name"]: r["unique_count"] for r in distinct_counts(df, df.columns).collect()} == {"id": 4000, "k": pdf["k"].nunique(), "v": pdf["v"].nunique()}


def test_sequential_allows_some_gaps_and_counts_repeats(spark):
    df = spark.createDataFrame([(i if i % 10 else i + 1, i * i, str(i * 2), i % 3) for i in range(100)], "a long, b long, c string, d long")
    got = {r["column_name"]: (r["is_sequential"], r["top_step"], r["n_steps"]) for r in sequential(df).collect()}
    assert got["a"] == (True, 1.0, 99) and got["c"] == (True, 2.0, 99) and not got["b"][0]
    assert got["d"] == (True, 0.0, 99)  # repeats are zero differences


def test_correlations_over_the_rows_that_have_both(spark):
    from assayer.plans.gram import correlations

    rng = np.random.default_rng(3)
    n = 600
    pdf = pd.DataFrame({"a": rng.normal(1e6, 1, n), "b": rng.normal(0, 1, n), "c": np.full(n, 0.1), "d": np.full(n, np.nan)})
    pdf["b"] += pdf["a"] - 1e6
    pdf.loc[rng.random(n) < .3, "a"] = np.nan
    pdf.loc[rng.random(n) < .2, "b"] = np.nan
    df = spark.createDataFrame(pdf)
    got = {(r["feature1"], r["feature2"]): (r["n"], r["r"]) for r in correlations(df, list("abcd")).collect()}
    both = pdf[["a", "b"]].dropna()
    assert len(got) == 6 and got["a", "b"][0] == len(both)
    assert np.isclose(got["a", "b"][1], both["a"].corr(both["b"]), rtol=1e-9)
    assert all(got[p][1] is None for p in got if p != ("a", "b")) and got["a", "d"][0] == 0
    one = {(r["feature1"], r["feature2"]): (r["n"], r["r"]) for r in correlations(df, list("abcd"), against="b").collect()}
    assert set(one) == {("a", "b"), ("b", "c"), ("b", "d")} and np.isclose(one["a", "b"][1], got["a", "b"][1], rtol=1e-12)


def test_products_in_tiles_match_numpy(spark):
    """Tiles smaller than the table's width, some not square, missing values, more tasks than meet at once."""
    from assayer.plans import gram

    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 7)) @ rng.normal(size=(7, 7))
    cols = [f"c{i}" for i in range(7)]
    df = spark.createDataFrame(x.tolist(), ", ".join(f"{c} double" for c in cols)).repartition(9)
    n, s, g = gram.cross_products(df, cols, [1.0] * 7, tile=3, fan=2)
    assert n == 200 and np.allclose(s, (x - 1).sum(axis=0)) and np.allclose(g, (x - 1).T @ (x - 1))
    holes = x.copy()
    holes[rng.random(x.shape) < .1] = np.nan
    want = pd.DataFrame(holes, columns=cols).corr()
    df = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in r] for r in holes], ", ".join(f"{c} double" for c in cols)).repartition(9)
    got = {(r["feature1"], r["feature2"]): r["r"] for r in gram.correlations(df, cols, None, 3, 2).collect()}
    assert len(got) == 21 and all(np.isclose(v, want.loc[a, b]) for (a, b), v in got.items())
    one = {(r["feature1"], r["feature2"]): r["r"] for r in gram.correlations(df, cols, "c4").collect()}
    assert len(one) == 6 and all(np.isclose(v, got[k]) for k, v in one.items())


def test_wide_products_send_a_row_per_tile(spark):
    from assayer.plans import gram

    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 600))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(4)
    df = df.select(*[F.get("v", F.lit(i)).alias(f"c{i}") for i in range(600)])
    assert len(gram._tiles(600)) == 6 and len(gram._tiles(2000)) == 36
    n, s, g = gram.cross_products(df, df.columns)
    assert n == 40 and np.allclose(g, x.T @ x)


def test_ranges_follow_the_bytes_read(spark, monkeypatch, tmp_path):
    from assayer.plans import ordered
    from assayer.session import cut, input_bytes

    df = spark.range(20_000).select(F.col("id"), F.md5(F.col("id").cast("string")).alias("t"))
    df.write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    assert ordered.range_count(read) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = cut(read)
    assert input_bytes(read) > 300_000 and 100_000 < input_bytes(held.join(held.withColumnRenamed("t", "u"), "id")) < 20_000_000
    monkeypatch.setattr(ordered, "RANGE_BYTES", input_bytes(read) // 20)
    few = ordered.range_count(read)
    twice = ordered.range_count(read.unionByName(read))
    assert few in (20, 21) and 40 <= twice <= 42
    assert ordered.ranged(read, ["id"]).select(ordered.RANGE).distinct().count() == few
    numbered = ordered.row_numbers(read, ["id"])
    assert numbered.where("rn <> id + 1").isEmpty() and numbered.count() == 20_000


def test_scope_deletes_what_was_cut_inside(spark, tmp_path):
    import os

    from assayer import session
    from assayer.plans import ordered

    df = spark.range(1000)
    before = session.cut(df)
    root = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    old = set(os.listdir(root))
    with session.scope(spark):
        numbered = ordered.row_numbers(df, ["id"])
        with session.scope(spark):
            session.cut(df.where("id > 5"))
            inner = set(os.listdir(root))
        assert len(inner - old) == 2 and len(set(os.listdir(root)) - old) == 1
        numbered.write.parquet(str(tmp_path / "out"))
    assert set(os.listdir(root)) == old and before.count() == 1000
    try:
        with session.scope(spark):
            session.cut(df)
            raise ValueError("the copy goes after a failure, too")
    except ValueError:
        pass
    assert set(os.listdir(root)) == old
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1000


def test_a_small_file_of_many_rows_is_dealt_to_all_cores(spark, tmp_path):
    from assayer.catalog import quality as CQ
    from assayer.catalog.fixtures import settled_view
    from assayer.session import settled

    spark.range(0, 200_000, 1, 1).selectExpr("id AS c_custkey", "'n' AS c_name", "1 AS c_nationkey", "id % 90 + 0.5D AS c_acctbal", "'m' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    held = settled_view(spark, str(tmp_path), "customer_text")
    sizes = [r["count"] for r in held.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < 2 * min(sizes) and sum(sizes) == 200_000
    assert settled(held) is held and held.agg(F.count_distinct("c_custkey")).first()[0] == 200_000
    issues = CQ.QUERIES["dq_issues_metric"](spark, str(tmp_path))  # its scans read the dealt rows, not the one file
    assert "customer.parquet" not in issues._jdf.queryExecution().executedPlan().toString()


def test_samples_sort_no_values(spark):
    import hashlib

    from assayer.plans.columns import sampled

    values = [f"v{i}" for i in range(3000)] + ["hot"] * 5000
    df = spark.createDataFrame([("k", v) for v in values], "key string, value string").repartition(5)
    got = sampled(df, ["key"], 10)
    least = {}
    for h, v in sorted({(hashlib.md5(v.encode()).hexdigest(), v) for v in values}, reverse=True):
        least[h[:2]] = v
    assert got.first()["examples"] == [least[c] for c in sorted(least)][:10]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "min(bits" in plan  # a least of texts would be a sort of all values in each task


def test_numbers_are_read_once_per_pass(spark):
    from assayer.operators import patterns as PT

    df = spark.createDataFrame([(str(i % 50), f"x{i}") for i in range(500)], "a string, b string")
    assert {r["column_name"]: (r["total_count"], r["n_number"]) for r in PT.normal(df).collect()} == {"a": (500, 500)}
    text = PT.normal(df)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("RLIKE") <= 2


def test_few_columns_are_multiplied_by_spark(spark):
    """The products of a few columns are Spark's own sums and equal those of tiles; an empty table has none."""
    from assayer.plans import gram

    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(500, 4)) + 1e3, columns=list("abcd"))
    df = spark.createDataFrame(pdf)
    n, s, g = gram.cross_products(df, list("abcd"), [1e3] * 4)
    x = pdf.to_numpy() - 1e3
    assert n == 500 and np.allclose(s, x.sum(axis=0)) and np.allclose(g, x.T @ x)
    tiled = gram.cross_products(df, list("abcd"), [1e3] * 4, tile=3)
    assert tiled[0] == n and np.allclose(tiled[1], s) and np.allclose(tiled[2], g)
    assert gram.cross_products(df.where("a < 0"), list("abcd"))[0] == 0


def test_perceptron_loss_and_its_descent():
    """The gradient is that of the loss, a weight counts a row so often, blocks add up; the descent gets down a bent valley."""
    from assayer.plans import perceptron as PP

    rng, layers = np.random.default_rng(4), [3, 4, 5, 2]
    w = rng.normal(size=16 + 25 + 12)
    rows = [(list(rng.normal(size=3)), float(rng.integers(2)), float(rng.integers(1, 9))) for _ in range(50)]
    got = PP.loss(next(PP.blocks(rows, 50)), w, layers)
    near = lambda d: PP.loss(next(PP.blocks(rows, 50)), w + d, layers)[0]
    assert np.allclose(got[1:], [(near(d) - near(-d)) / 2e-6 for d in 1e-6 * np.eye(len(w))], rtol=1e-4, atol=1e-4)
    single = [(x, y, 1.0) for x, y, n in rows for _ in range(int(n))]
    parts = list(PP.blocks(single, 7))
    assert sum(len(b[1]) for b in parts) == len(single) and np.allclose(sum(PP.loss(b, w, layers) for b in parts), got)

    bent = lambda x: (100 * (x[1] - x[0] ** 2) ** 2 + (1 - x[0]) ** 2, np.array([-400 * x[0] * (x[1] - x[0] ** 2) - 2 * (1 - x[0]), 200 * (x[1] - x[0] ** 2)]))
    assert np.allclose(PP.descend(bent, np.array([-1.2, 1.0]), 100, 1e-12), 1, atol=1e-4)
    assert np.allclose(PP.descend(bent, np.array([1.0, 1.0]), 100, 1e-6), 1) and bent(PP.descend(bent, np.array([-1.2, 1.0]), 3, 0.0))[0] < 24.2
