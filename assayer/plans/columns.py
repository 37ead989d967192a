"""Column kinds and the fused aggregation that most operators are built on."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED = (T.ArrayType, T.MapType, T.StructType)


def dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def of_kind(df: DataFrame, kinds: tuple, cols: Sequence[str] | None = None) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, kinds) and (cols is None or f.name in cols)]


def numeric_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    return of_kind(df, NUMERIC, cols)


def text_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    return of_kind(df, (T.StringType,), cols)


def flat_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    return [f.name for f in df.schema.fields
            if not isinstance(f.dataType, NESTED) and (cols is None or f.name in cols)]


def kind_name(t: T.DataType) -> str:
    """Storage kind on a small, engine-neutral scale."""
    if isinstance(t, INTEGRAL):
        return "integer"
    if isinstance(t, NUMERIC):
        return "float"
    if isinstance(t, T.StringType):
        return "text"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, TEMPORAL):
        return "datetime"
    return "nested"


AGGREGATES_PER_SCAN = 24  # beyond this the generated aggregation method is too large for the JIT


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def long_agg(df: DataFrame, cols: Sequence[str], metrics: Mapping[str, Callable[[str], Column]],
             distinct: str | None = None, key: str = "column_name") -> DataFrame:
    """All metrics of all columns, one row per column; ``distinct`` names an added exact distinct count.

    Columns share one aggregation until it holds ``AGGREGATES_PER_SCAN`` functions; further columns get their
    own, which reads only those columns.  Each task sends one partial row, whatever the table's size.
    """
    if not cols:
        raise ValueError("no column of the required kind")
    step = max(1, AGGREGATES_PER_SCAN // len(metrics))
    parts = []
    for i in range(0, len(cols), step):
        rows = [F.struct(F.lit(c).alias(key), *[m(c).alias(n) for n, m in metrics.items()]) for c in cols[i:i + step]]
        parts.append(df.agg(F.array(*rows).alias("rows")).select(F.inline("rows")))
    out = union_all(parts)
    if distinct:
        out = out.join(F.broadcast(distinct_counts(df, cols, distinct, key)), key, "left")
        out = out.withColumn(distinct, F.coalesce(distinct, F.lit(0)))  # an empty table has no group at all
    return out


VALUE_KEY = ("__whole", "__real", "__text")


def value_key(c: str, t: T.DataType) -> list[Column]:
    """(whole, real, text): a value of any flat type, told apart from every other value of its column.

    Numbers and times stay narrow; texts above 32 bytes are a 128-bit digest, so that a corpus never crosses the network.
    """
    c = F.col(f"`{c}`")
    i, d, s = F.lit(None).cast("bigint"), F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(t, (*INTEGRAL, T.BooleanType)):
        i = c.cast("bigint")
    elif isinstance(t, (T.FloatType, T.DoubleType)) or isinstance(t, T.DecimalType) and t.precision <= 15:
        d = c.cast("double")
    elif isinstance(t, T.DateType):
        i = F.unix_date(c).cast("bigint")
    elif isinstance(t, TEMPORAL):
        i = F.unix_micros(c.cast("timestamp"))
    elif isinstance(t, T.BinaryType):
        s = F.md5(c)
    else:
        s = c.cast("string")
        s = F.when(F.octet_length(s) > 32, F.md5(s.cast("binary"))).otherwise(s)
    return [i.alias("__whole"), d.alias("__real"), s.alias("__text")]


def distinct_counts(df: DataFrame, cols: Sequence[str], name: str = "unique_count", key: str = "column_name") -> DataFrame:
    """Exact non-null distinct count per column, from one scan whatever the number of columns.

    Columns are unpivoted to narrow value keys; equal values meet map-side first, and the last step only counts per column.
    """
    pairs = [F.struct(F.lit(c).alias(key), *value_key(c, dtype(df, c))) for c in cols]
    seen = df.select(F.inline(F.array(*pairs))).groupBy(key, *VALUE_KEY).agg(F.lit(1).alias("__one"))
    return seen.groupBy(key).agg(F.count_if(value_present()).alias(name))


def value_present() -> Column:
    """Whether an unpivoted value key belongs to a value and not to a null."""
    return reduce(lambda a, b: a | b, [F.col(v).isNotNull() for v in VALUE_KEY])


def unpivot_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Non-null (column_name, value) pairs, values as text."""
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols]
    return (df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
            .where(F.col("value").isNotNull()))


def unpivot_number(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Non-null (column_name, value) pairs, values as double, ``keep`` columns carried along."""
    from assayer.functions.values import number

    pairs = [F.struct(F.lit(c).alias("column_name"), number(c, dtype(df, c)).alias("value")) for c in cols]
    return (df.select(*keep, F.explode(F.array(*pairs)).alias("p")).select(*keep, "p.*")
            .where(F.col("value").isNotNull()))


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, value, n): partial counts are built before the shuffle, so a hot value is one row per task."""
    return unpivot_text(df, cols).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


SAMPLE_CLASSES = 256  # by the first two digits of an MD5


def sampled(values: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """(*keys, examples): up to ``k`` different texts ``value`` of each key, the same on every partitioning.

    Values fall in classes by their hash and each class gives that of its least hash.  A first scan finds the least leading 60 bits
    of each class as numbers, which are combined in place; a second takes the values that have them, equal ones once.  So a task
    holds some SAMPLE_CLASSES values of a key and sorts none.  The first ``k`` classes give the examples, in the order of the hash.
    """
    hashed = values.where("value IS NOT NULL").withColumn("h", F.md5("value")).withColumn("bits", F.conv(F.substring("h", 1, 15), 16, 10).cast("bigint"))
    first = hashed.groupBy(*keys, F.shiftright("bits", 52).alias("class")).agg(F.min("bits").alias("__bits"))
    first = first.select(*[F.col(c).alias(f"__{c}") for c in keys], "__bits")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys], F.col("bits") == F.col("__bits"))
    few = hashed.join(F.broadcast(first), same, "left_semi").groupBy(*keys, "h", "value").agg(F.lit(1).alias("__one"))
    least = few.groupBy(*keys, F.substring("h", 1, 2).alias("class")).agg(F.min(F.struct("h", "value")).alias("least"))
    return least.groupBy(*keys).agg(F.transform(F.slice(F.array_sort(F.collect_list("least")), 1, k), lambda x: x["value"]).alias("examples"))
