"""Order-dependent operators (row numbers, fills, lags, running sums) without a single-task sort.

Rows are range-partitioned on ``key + order_by`` and cut to the checkpoint folder with their partition
number.  Each range is solved on its own, each range's end state is carried to the next over a table of
at most two rows per range, and joined back.  One key holding a third of all rows simply spans a third of
the ranges.  ``order_by`` must be total within a key (add a unique tie-breaker).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.session import cut, input_bytes

RANGE = "__range"
#: Bytes of input files for one range, and the most ranges.
RANGE_BYTES, MOST_RANGES = 128 << 20, 200_000


def range_count(df: DataFrame) -> int:
    """One range for each RANGE_BYTES that ``df`` reads, at least the shuffle partitions of the session."""
    by_size = min(MOST_RANGES, -(-input_bytes(df) // RANGE_BYTES))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by_size)


def ranged(df: DataFrame, order_by: Sequence[str], key: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """``df`` cut into ordered ranges, range number in ``__range``; ``parts`` ranges, or as many as its input's size asks for."""
    parts = parts or range_count(df)
    spread = df.repartitionByRange(parts, *key, *order_by)
    return cut(spread.withColumn(RANGE, F.spark_partition_id()))


def sorted_ranges(df: DataFrame, order_by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``cols`` of ``df`` cut into ordered ranges, each a partition in which the rows stand in order, range number in ``__range``.

    Passes over it neither shuffle nor sort; the order columns are kept only where ``cols`` names them.
    """
    spread = df.repartitionByRange(range_count(df), *order_by).sortWithinPartitions(*order_by)
    return cut(spread.select(*cols, F.spark_partition_id().alias(RANGE)))


def _local(key: Sequence[str], order_by: Sequence[str]):
    return Window.partitionBy(RANGE, *key).orderBy(*order_by)


def _with_carry(rows: DataFrame, ends: DataFrame, key: Sequence[str], carries: Mapping[str, Column]) -> DataFrame:
    """Join the carried state of earlier/later ranges; only ranges that share a key with another need it.

    A range boundary is shared by at most one key, so the joined table has at most two rows per range.
    """
    per_key = Window.partitionBy(*key) if key else Window.partitionBy(F.lit(1))
    carried = (ends.withColumn("__spans", F.count(F.lit(1)).over(per_key))
               .select(F.col(RANGE).alias("__k_range"), *[F.col(k).alias(f"__k_{k}") for k in key], "__spans",
                       *[c.alias(n) for n, c in carries.items()])
               .where("__spans > 1").drop("__spans"))
    cond = [F.col(RANGE) == F.col("__k_range")] + [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in key]
    return (rows.join(F.broadcast(carried), cond, "left")
            .drop("__k_range", *[f"__k_{k}" for k in key]))


def _across(key: Sequence[str]):
    w = (Window.partitionBy(*key) if key else Window.partitionBy(F.lit(1))).orderBy(RANGE)
    return w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)


def running_sums(df: DataFrame, sums: Mapping[str, str | Column], order_by: Sequence[str],
                 key: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Add inclusive running sums ``{new_name: value}`` per key in order."""
    values = {f"__v_{n}": (F.col(v) if isinstance(v, str) else v) for n, v in sums.items()}
    base = ranged(df.select("*", *[v.alias(n) for n, v in values.items()]), order_by, key, parts)
    before, _ = _across(key)
    ends = base.groupBy(RANGE, *key).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    w = _local(key, order_by).rowsBetween(Window.unboundedPreceding, 0)
    rows = base.select("*", *[F.sum(f"__v_{n}").over(w).alias(f"__r_{n}") for n in sums])
    joined = _with_carry(rows, ends, key, {f"__c_{n}": F.sum(f"__t_{n}").over(before) for n in sums})
    zero = F.lit(0)
    return joined.select(*df.columns, *[
        (F.coalesce(F.col(f"__r_{n}"), zero) + F.coalesce(F.col(f"__c_{n}"), zero)).alias(n) for n in sums])


def row_numbers(df: DataFrame, order_by: Sequence[str], key: Sequence[str] = (), name: str = "rn",
                parts: int | None = None) -> DataFrame:
    """1-based exact row number per key."""
    return running_sums(df, {name: F.lit(1).cast("bigint")}, order_by, key, parts)


def neighbours(df: DataFrame, value: str, order_by: Sequence[str], key: Sequence[str] = (),
               parts: int | None = None) -> DataFrame:
    """Add ``pos`` and the nearest non-null (pos, v) at or before / at or after each row as ``prev``, ``next``."""
    base = ranged(df, order_by, key, parts)
    w = _local(key, order_by)
    rows = base.withColumn("__lp", F.row_number().over(w).cast("bigint"))
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col("__lp").alias("p"), F.col(value).alias("v")))
    before, after = _across(key)
    ends = rows.groupBy(RANGE, *key).agg(F.count(F.lit(1)).alias("__n"), F.max(seen).alias("__last"),
                                         F.min(seen).alias("__first"))
    ends = ends.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0)))

    def moved(c: str) -> Column:
        return F.when(F.col(c).isNotNull(),
                      F.struct((F.col(f"{c}.p") + F.col("__off")).alias("p"), F.col(f"{c}.v").alias("v")))

    ends = ends.withColumn("__last", moved("__last")).withColumn("__first", moved("__first"))
    joined = _with_carry(rows, ends, key, {
        "__o": F.col("__off"), "__prev": F.last("__last", True).over(before), "__next": F.first("__first", True).over(after)})
    pos = F.col("__lp") + F.coalesce(F.col("__o"), F.lit(0))
    here = F.when(F.col(value).isNotNull(), F.struct(F.col("pos").alias("p"), F.col(value).alias("v")))
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    down = w.rowsBetween(0, Window.unboundedFollowing)
    return joined.withColumn("pos", pos).select(
        *df.columns, "pos",
        F.coalesce(F.last(here, True).over(up), F.col("__prev")).alias("prev"),
        F.coalesce(F.first(here, True).over(down), F.col("__next")).alias("next"))


def lags(df: DataFrame, cols: Sequence[str], offsets: Sequence[int], order_by: Sequence[str],
         key: Sequence[str] = (), tile: int = 100_000, parts: int | None = None) -> DataFrame:
    """Add ``<col>_lag_<k>``; tiles of row numbers with a halo of the longest lag keep every window bounded."""
    halo = max(offsets)
    tile = max(tile, halo)
    numbered = row_numbers(df, order_by, key, "__rn", parts)
    home = ((F.col("__rn") - 1) / tile).cast("bigint")
    reach = ((F.col("__rn") - 1) % tile) >= tile - halo
    tiled = numbered.select("*", F.explode(F.array_compact(F.array(
        F.struct(home.alias("t"), F.lit(True).alias("own")),
        F.when(reach, F.struct((home + 1).alias("t"), F.lit(False).alias("own")))))).alias("__p"))
    w = Window.partitionBy(*key, "__p.t").orderBy("__rn")
    added = {f"{c}_lag_{k}": F.lag(c, k).over(w) for c in cols for k in offsets}
    return (tiled.select(*df.columns, F.col("__p.own").alias("__own"), *[e.alias(n) for n, e in added.items()])
            .where("__own").drop("__own"))


def successive(df: DataFrame, value: str, order_by: Sequence[str], key: Sequence[str] = (),
               parts: int | None = None) -> DataFrame:
    """Add ``before``: the value of the previous row of the key (null on the first row)."""
    base = ranged(df, order_by, key, parts)
    w = _local(key, order_by)
    rows = base.select("*", F.lag(value).over(w).alias("__lag"), F.row_number().over(w).alias("__lp"))
    before, _ = _across(key)
    boxed = F.struct(F.col(value).alias("v"))
    ends = rows.groupBy(RANGE, *key).agg(F.max_by(boxed, F.col("__lp")).alias("__end"))
    joined = _with_carry(rows, ends, key, {"__in": F.last("__end").over(before)})
    return joined.select(*df.columns, F.when(F.col("__lp") == 1, F.col("__in.v")).otherwise(F.col("__lag")).alias("before"))
