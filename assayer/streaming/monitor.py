"""Windowed drift and quality monitoring: one set of expressions for batch tables and for streams.

A stream keeps one small state row per open window (and category); the stored reference profile is a static side.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from assayer.functions.values import as_col, share
from assayer.operators.drift import CATEGORY_LIMIT, NUMERIC_LIMIT, level

EPS = 1e-8
END = "2999-12-31 00:00:00"  # later than any event


def reference_profile(ref: DataFrame, value: str, category: str) -> DataFrame:
    """(category, ref_mean, ref_std, ref_share) of the reference table."""
    per = ref.groupBy(as_col(category).alias("category")).agg(
        F.avg(value).alias("ref_mean"), F.stddev_samp(value).alias("ref_std"), F.count(F.lit(1)).alias("n"))
    total = ref.agg(F.count(F.lit(1)).alias("t"))
    return per.crossJoin(F.broadcast(total)).select("category", "ref_mean", "ref_std", share(F.col("n"), F.col("t")).alias("ref_share"))


def _windows(df: DataFrame, ts: str, width: str, late: str | None, *keys):
    src = df.withWatermark(ts, late) if late else df
    return src.groupBy(F.window(ts, width).alias("w"), *keys)


def window_drift(df: DataFrame, profile: DataFrame, ts: str, value: str, category: str, width: str = "1 day", late: str | None = None) -> DataFrame:
    """Moments of every window and category against the profile, with an alert level."""
    per = _windows(df, ts, width, late, as_col(category).alias("category")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    j = per.join(profile, "category", "left")  # a stored profile: the optimizer broadcasts it by its known size
    shift = F.abs(F.col("mean") - F.col("ref_mean")) / (F.col("ref_std") + EPS)
    return j.select(F.col("w.start").alias("window_start"), "category", "n", "mean", "std", shift.alias("mean_drift"), level(shift, NUMERIC_LIMIT).alias("level"))


def window_shares(df: DataFrame, profile: DataFrame, ts: str, category: str, width: str = "1 day") -> DataFrame:
    """One minus the overlap of each window's category shares with the stored shares, for tables.

    A stream writes the counts of ``window_drift``; its closed windows are such a table.  The categories are joined, never
    collected, so their number does not matter.
    """
    per = _windows(df, ts, width, None, as_col(category).alias("category")).agg(F.count(F.lit(1)).alias("k"))
    total = per.groupBy("w").agg(F.sum("k").alias("n"))
    known = per.join(profile.select("category", "ref_share"), "category")  # an unknown category overlaps with nothing
    hit = known.join(total, "w").groupBy("w").agg(F.sum(F.least(share(F.col("k"), F.col("n")), F.col("ref_share"))).alias("hit"))
    drift = 1 - F.coalesce("hit", F.lit(0.0))
    return total.join(hit, "w", "left").select(F.col("w.start").alias("window_start"), "n", drift.alias("distribution_drift"),
                                               level(drift, CATEGORY_LIMIT).alias("level"))


def window_quality(df: DataFrame, ts: str, value: str, lo: float, hi: float, category: str, allowed: Sequence[str],
                   width: str = "1 day", late: str | None = None) -> DataFrame:
    """Null, range and domain violations per window."""
    return _windows(df, ts, width, late).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(as_col(value).isNull()).alias("nulls"),
        F.count_if((as_col(value) < lo) | (as_col(value) > hi)).alias("out_of_range"),
        F.count_if(~as_col(category).isin(*allowed)).alias("bad_category")).select(
        F.col("w.start").alias("window_start"), "n", "nulls", "out_of_range", "bad_category",
        (1 - share(F.col("nulls"), F.col("n"))).alias("completeness"))


def append_files(result: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Exactly-once Parquet output of closed windows; restartable from ``checkpoint``."""
    return (result.writeStream.outputMode("append").format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True))


def run_and_close(src: DataFrame, build: Callable[[DataFrame], DataFrame], ts: str, folder: str) -> DataFrame:
    """Run ``build`` over all that a file stream holds now, close its last windows, and return what was written.

    A window is written when the watermark passes its end, which nothing does for the last ones.  So the query reads a
    second folder beside the events: empty in the first run; then a single row far ahead goes there and the query, restarted
    from its own state, closes every window.  The row's own window stays open and is never written.  This ends the stream:
    events that come later are late.
    """
    spark, schema = src.sparkSession, src.schema
    marks, out, state = f"{folder}/marks", f"{folder}/out", f"{folder}/state"
    spark.createDataFrame([], schema).write.parquet(marks)
    whole = build(src.unionByName(spark.readStream.schema(schema).parquet(marks)))
    append_files(whole, out, state).start().awaitTermination()
    row = [F.lit(END if f.name == ts else None).cast(f.dataType).alias(f.name) for f in schema.fields]
    spark.range(1).select(*row).write.mode("append").parquet(marks)
    append_files(whole, out, state).start().awaitTermination()
    return spark.read.schema(whole.schema).parquet(out)
