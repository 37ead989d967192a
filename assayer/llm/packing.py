"""Best-fit packing of documents into sequences by large-item matching.

Two pieces above a third of the capacity at most share a sequence, so the large ones are matched greedily, each with the
largest that still fits; the smaller ones then go, longest first, to the tightest gap that takes them.  Pieces of one
length are alike, so the plan is made on the histogram of lengths: its size depends on the capacity alone, never on the
number of documents.  Every piece then finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import small_batches, stored, text_of
from assayer.llm.tokens import encoder
from assayer.plans.ordered import RANGE, ranged

CAPACITY = 4096
END_ID = 1


class Run(NamedTuple):
    """Pieces ``first`` .. ``first + count - 1`` of a length: ``each`` of them side by side per sequence from ``sequence`` on."""

    length: int
    first: int
    count: int
    sequence: int
    each: int
    offset: int


def plan(histogram: Mapping[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Runs for every piece of a length histogram (lengths 1 to ``capacity``).

    Sequences of one gap are kept as ranges, so the work grows with the number of different lengths and gaps.
    """
    left = {n: c for n, c in histogram.items() if c}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError(f"lengths must be 1 to {capacity}")
    used: dict[int, int] = dict.fromkeys(left, 0)
    runs: list[Run] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges (first sequence, sequences)
    open_gaps: list[int] = []  # sorted
    sequences = 0

    def put(length: int, count: int, sequence: int, each: int, offset: int) -> None:
        runs.append(Run(length, used[length], count, sequence, each, offset))
        used[length] += count
        left[length] -= count

    def free(gap: int, sequence: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                insort(open_gaps, gap)
            gaps[gap].append((sequence, count))

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left[n]:
            at = bisect_left(large, min(n, capacity - n) + 1) - 1
            while at >= 0 and not left[large[at]] - (large[at] == n and left[n] == 1):
                at -= 1
            if at < 0:
                count = left[n]
                put(n, count, sequences, 1, 0)
                free(capacity - n, sequences, count)
            elif (m := large[at]) == n:
                count = left[n] // 2
                put(n, 2 * count, sequences, 2, 0)
                free(capacity - 2 * n, sequences, count)
            else:
                count = min(left[n], left[m])
                put(n, count, sequences, 1, 0)
                put(m, count, sequences, 1, n)
                free(capacity - n - m, sequences, count)
            sequences += count
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(open_gaps, n)
            if at == len(open_gaps):
                count = -(-left[n] // (capacity // n))
                free(capacity, sequences, count)
                sequences += count
                continue
            gap = open_gaps[at]
            first, count = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                open_gaps.pop(at)
            each = gap // n  # the gap left by one piece is tighter, so the next one goes there too
            full = min(count, left[n] // each)
            if full:
                put(n, full * each, first, each, capacity - gap)
                free(gap - each * n, first, full)
            rest = min(left[n], each) if full < count else 0
            if rest:
                put(n, rest, first + full, rest, capacity - gap)
                free(gap - rest * n, first + full, 1)
            free(gap, first + full + (rest > 0), count - full - (rest > 0))
    return runs


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, spaces: bool = False,
           with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): each document's ids and the end id, cut every ``capacity`` ids."""
    small_batches(docs.sparkSession)
    end = end_id.to_bytes(4, "little")
    width = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, spaces)
        for b in batches:
            out = [[] for _ in range(6)]
            for doc, ids in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), width)):
                    own = ids[at:at + width]
                    for column, v in zip(out, (doc, k, at // 4, len(own) // 4, zlib.crc32(own), own)):
                        column.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            keep = 5 + with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:keep], types)], names=names[:keep])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, schema)


def pack(items: DataFrame, capacity: int = CAPACITY, order_by: tuple[str, ...] = ("doc_id", "piece", "start")) -> DataFrame:
    """Add (or replace) sequence_id and offset in rows with a ``length`` of 1 to ``capacity``; all other columns pass through.

    The histogram (at most ``capacity`` rows) is all that the driver sees.  Rows are cut into ranges by length and
    ``order_by``; a length that a third of all rows have spans a third of the ranges.
    """
    items = items.drop("sequence_id", "offset")
    base = ranged(items, ["length", *order_by])
    counts = base.groupBy(RANGE, "length").count().groupBy("length").agg(F.sum("count").alias("n")).collect()
    histogram = {r["length"]: r["n"] for r in counts}
    runs = plan(histogram, capacity)
    sizes = {r[RANGE]: r["count"] for r in base.groupBy(RANGE).count().collect()}  # one row a range
    before, total = {}, 0
    for part in sorted(sizes):
        before[part] = total
        total += sizes[part]
    start_of, total = {}, 0
    for n in sorted(histogram):
        start_of[n] = total
        total += histogram[n]
    runs = sorted(runs, key=lambda r: (r.length, r.first))
    at = np.array([start_of[r.length] + r.first for r in runs] or [0], dtype=np.int64)
    spec = np.array([(r.sequence, r.each, r.offset, r.length) for r in runs] or [(0, 1, 0, 0)], dtype=np.int64)
    shared = items.sparkSession.sparkContext.broadcast((before, at, spec))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, at, spec = shared.value
        seen: dict[int, int] = {}
        for b in batches:
            part = b.column(b.schema.get_field_index(RANGE)).to_numpy()
            index = np.empty(len(part), dtype=np.int64)
            for p in np.unique(part).tolist():  # a range's rows come in order, one range after the other
                own = part == p
                index[own] = before[p] + seen.get(p, 0) + np.arange(own.sum())
                seen[p] = seen.get(p, 0) + int(own.sum())
            run = np.searchsorted(at, index, side="right") - 1
            sequence, each, offset, length = spec[run].T
            nth = index - at[run]
            keep = [i for i, name in enumerate(b.schema.names) if name != RANGE]
            arrays = [b.column(i) for i in keep] + [pa.array(sequence + nth // each), pa.array(offset + nth % each * length)]
            yield pa.RecordBatch.from_arrays(arrays, names=[b.schema.names[i] for i in keep] + ["sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return (base.sortWithinPartitions("length", *order_by)
            .mapInArrow(place, f"{fields}, sequence_id long, offset long"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, spaces: bool = False,
                   with_ids: bool = False) -> DataFrame:
    """Documents to packed pieces: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    A null text is empty and gives one piece, the end id; repeated rows are packed each for itself; an empty table gives
    no rows; other columns are not read.  Only documents longer than ``capacity`` are cut.
    """
    if not with_ids:
        return pack(stored(pieces(docs, tokenizer, capacity, end_id, spaces), "pieces"), capacity)
    held = pieces(docs, tokenizer, capacity, end_id, spaces, True).withColumn("row", F.monotonically_increasing_id())
    held = stored(held, "pieces")  # the ids are shuffled once, to the places found without them
    own = held.select("row", "ids")
    return pack(held.drop("ids"), capacity).join(own, "row").select(*[c for c in held.columns if c != "row"], "sequence_id", "offset")
