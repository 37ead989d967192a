"""Helpers of the training-data operators: inputs, shared scratch tables, null-safe texts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.session import ensure_checkpoint_dir

BATCH_ROWS = 1000
_written: dict[str, list[str]] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def small_batches(spark: SparkSession) -> None:
    """At most BATCH_ROWS rows in an Arrow batch, so that very long texts don't add up in a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a lost executor replays nothing before it."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the session's scratch tables; call it when every result built on them has been written."""
    sc = spark.sparkContext
    for path in _written.pop(sc.applicationId, []):
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def range_tops(df: DataFrame, column: str, parts: int) -> list[int]:
    """The largest value of each of about ``parts`` ranges of a long column, sorted: one number a range comes to the driver."""
    rows = (df.select(F.col(column).cast("long").alias("v")).where("v IS NOT NULL").repartitionByRange(parts, "v")
            .groupBy(F.spark_partition_id().alias("part")).agg(F.max("v").alias("top")).collect())
    return sorted(r["top"] for r in rows)


def range_of(value: Column, tops: list[int]) -> Column:
    """How many of the sorted ``tops`` are below ``value``, by a search in two steps; null is in the first range."""
    if not tops:
        return F.lit(0)
    step = max(1, int(len(tops) ** 0.5))
    groups = [tops[k:k + step] for k in range(0, len(tops), step)]
    lasts = F.lit([g[-1] for g in groups]).cast("array<bigint>")
    full = F.size(F.filter(lasts, lambda t: t < value))
    own = F.get(F.array(*[F.lit(g).cast("array<bigint>") for g in groups]), full)
    found = full * step + F.coalesce(F.size(F.filter(own, lambda t: t < value)), F.lit(0))
    return F.when(value.isNull(), 0).otherwise(F.least(F.greatest(found, F.lit(0)), F.lit(len(tops) - 1))).cast("int")
