"""Value-to-attribute joins that stay correct and balanced whatever the size of the lookup side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.values import any_of, as_col

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20
HOT_KEYS = 1_000


def lookup_join(df: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "left", broadcast_rows: int = BROADCAST_ROWS,
                broadcast_bytes: int = BROADCAST_BYTES, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Join ``dim`` (unique on ``on``), ``how`` left or inner: broadcast when its counted size allows, else by hot keys and the rest.

    The ``hot_keys`` most frequent keys of ``df``, so every key of more than a ``hot_keys``-th of its rows, meet their few
    ``dim`` rows by broadcast and are not shuffled at all, and neither are null keys.  The rest has no hot key left and
    is shuffled plainly.
    """
    on = list(on)
    few = dim.limit(broadcast_rows + 1)
    size = few.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*map(as_col, dim.columns))))),
                                                            F.lit(0)).alias("bytes")).first()
    if size["n"] <= broadcast_rows and size["bytes"] <= broadcast_bytes:
        return df.join(F.broadcast(dim), on, how)
    keys = df.select(*map(as_col, on)).dropna()
    top = keys.groupBy(*on).agg(F.count(F.lit(1)).alias("__m")).orderBy(F.desc("__m"), *on).limit(hot_keys).drop("__m")
    top = df.sparkSession.createDataFrame(top.collect(), top.schema)  # at most hot_keys keys
    marked = df.join(F.broadcast(top.withColumn("__hot", F.lit(True))), on, "left")
    stays = F.col("__hot").isNotNull() | any_of(as_col(c).isNull() for c in on)
    hot = marked.where(stays).join(F.broadcast(dim.join(F.broadcast(top), on)), on, how)
    rest = marked.where(~stays).join(dim, on, how)
    return hot.unionByName(rest).drop("__hot")
