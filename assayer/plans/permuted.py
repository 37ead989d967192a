"""Rows permuted within classes of their key's hash: one shuffle of the rows, none of their repeats."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.values import as_col


def in_classes(df: DataFrame, key: Sequence[str], classes: int, then: Sequence[str]) -> DataFrame:
    """``df`` with ``__h`` and ``__class``, a partition for some twenty classes, sorted by both and ``then``."""
    h = F.shiftrightunsigned(F.xxhash64(*[as_col(c) for c in key], F.lit("class")), 1)
    at = F.least(F.floor(F.col("__h") / F.lit(2.0 ** 63) * classes), F.lit(classes - 1)).cast("int")
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-classes // 20))
    dealt = df.withColumn("__h", h).withColumn("__class", at)
    return dealt.repartition(parts, "__class").sortWithinPartitions("__class", "__h", *[as_col(c) for c in then])


def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(class, its rows in one batch) of sorted batches."""
    held, own = [], None
    whole = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for b in batches:
        at = b.column(b.schema.get_field_index("__class")).to_numpy()
        ends = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        for first, end in zip(ends, ends[1:]):
            if first == end:
                continue
            if held and at[first] != own:
                yield own, whole()
                held = []
            own = int(at[first])
            held.append(b.slice(first, end - first))
    if held:
        yield own, whole()


def permutation(n: int, rep: int, own: int) -> np.ndarray:
    return np.random.default_rng([1000, rep, own]).permutation(n)


def paired(df: DataFrame, cols: Sequence[str], key: Sequence[str], classes: int, reps: Sequence[int]) -> DataFrame:
    """``df`` once for each of ``reps`` as ``__rep``, with ``__other``: the values of ``cols`` of the row that takes part in its place."""
    other = [df.columns.index(c) for c in cols]
    fields = [T.StructField(f.name, f.dataType) for f in df.schema]
    width = len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, b in by_class(batches):
            columns = b.columns[:width]
            for rep in reps:
                at = pa.array(permutation(b.num_rows, rep, own))
                moved = pa.StructArray.from_arrays([columns[i].take(at) for i in other], names=list(cols))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(b.num_rows, rep, dtype=np.int32)), moved],
                                                 names=[*[f.name for f in fields], "__rep", "__other"])

    schema = T.StructType([*fields, T.StructField("__rep", T.IntegerType()), T.StructField("__other", T.StructType([fields[i] for i in other]))])
    return in_classes(df, key, classes, key).mapInArrow(run, schema)
