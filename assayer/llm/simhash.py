"""Near duplicates by 64-bit SimHash, linked through deletion-variant signatures.

Of three segments of two fingerprints that differ in at most four bits, one differs in at most one bit.  So each segment is
indexed once per bit with that bit left out; fingerprints that share such a variant are compared in full.  Equal
fingerprints are one node from the start.  Within a bucket only a spanning forest of the links is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import small_batches, stored, text_of
from assayer.llm.components import components
from assayer.plans.lookup import lookup_join

SEED = 42
BITS = 4
BUCKET_ROWS = 4096
BLOCK_ROWS = 65_536


def fingerprint(text: str, words: int) -> int:
    """SimHash over XXH64 of word shingles, A-Z in lower case: a bit is set if over half the hashes have it set."""
    from xxhash import xxh64_intdigest

    own = text.encode("utf-8", "surrogatepass").lower().split()  # bytes know A-Z and the six white space characters only
    if not own:
        return 0
    joined = b" ".join(own)
    if len(own) < words:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:len(own) - words + 1].tolist(), ends[words - 1:].tolist())]
    count = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), BLOCK_ROWS):
        block = np.array(hashes[k:k + BLOCK_ROWS], dtype="<u8")
        count += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every whole text; null texts are empty, empty ones have fingerprint 0."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([fingerprint(t, words) for t in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, fp long")


def segments(bits: int = BITS) -> list[tuple[int, int]]:
    """(lowest bit, width) of the bits // 2 + 1 segments."""
    n = bits // 2 + 1
    cuts = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def variants(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """key, fp: one row per bit; the key is the bit's number over the bit's segment without that bit."""
    keys = [F.lit((lo + i) << 32 | 0).bitwiseOR(F.shiftrightunsigned(F.col("fp"), lo).bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << i))))
            for lo, width in segments(bits) for i in range(width)]
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


class _Forest:
    """Union-find of one task, so that it sends each link once and no cycles; emptied when large, which only repeats links."""

    def __init__(self, most: int = 500_000):
        self.of: dict[int, int] = {}
        self.most = most

    def root(self, x: int) -> int:
        of = self.of
        while (up := of.setdefault(x, x)) != x:
            of[x] = x = of[up]
        return x

    def joins(self, a: int, b: int) -> bool:
        if len(self.of) > self.most:
            self.of.clear()
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.of[max(a, b)] = min(a, b)
        return True


def _reach(own: np.ndarray, bits: int) -> Iterator[tuple[int, int]]:
    """Links that join what can be reached within a bucket: each new member is compared with those not reached yet."""
    while len(own) > 1:
        root, own = own[0], own[1:]
        front = [root]
        while front and len(own):
            near = np.bitwise_count(own ^ front.pop()) <= bits
            found = own[near]
            own = own[~near]
            front.extend(found)
            for x in found.tolist():
                yield int(root), x


def _pairs(key: np.ndarray, fp: np.ndarray, bits: int) -> Iterator[tuple[int, int]]:
    """All links within the (small) buckets of a sorted block."""
    at, step = np.arange(len(key) - 1), 1
    while len(at):
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= bits]
        yield from set(zip(fp[near].tolist(), fp[near + step].tolist()))
        step += 1


def _linker(bits: int, most: int, small: int = 32):
    """mapInArrow function over rows sorted by key: kind 0 links (a, b); kind 1 (key, fingerprint) of buckets above ``most``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()

        def solved(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            fp = fp.view(np.uint64)  # numpy counts the bits of a signed number without its sign
            cut = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
            size = ends - starts
            links = []
            own = np.repeat((size > 1) & (size <= small), size)
            if own.any():
                links += [p for p in _pairs(key[own], fp[own], bits) if forest.joins(*p)]
            for a, b in zip(starts[size > small].tolist(), ends[size > small].tolist()):
                links += [p for p in _reach(fp[a:b], bits) if forest.joins(*p)]
            if links:
                pairs = np.array(links, dtype=np.uint64).view(np.int64)
                yield _rows(0, pairs[:, 0], pairs[:, 1])

        keys, fps, held, over = [], [], 0, None
        for b in batches:
            key, fp = b.column(0).to_numpy(), b.column(1).to_numpy()
            if over is not None:  # the rest of a bucket that is too large goes on
                n = int(np.searchsorted(key, over, side="right"))
                if n:
                    yield _rows(1, key[:n], fp[:n])
                key, fp = key[n:], fp[n:]
                if not len(key):
                    continue
                over = None
            keys.append(key)
            fps.append(fp)
            held += len(key)
            if held < BLOCK_ROWS:
                continue
            key, fp = np.concatenate(keys), np.concatenate(fps)
            last = int(np.searchsorted(key, key[-1]))
            if len(key) - last > most:
                yield _rows(1, key[last:], fp[last:])
                over = key[-1]
                keys, fps, held = [], [], 0
            else:
                keys, fps, held = [key[last:]], [fp[last:]], len(key) - last
            yield from _large_out(key[:last], fp[:last], most, solved)
        if held:
            yield from _large_out(np.concatenate(keys), np.concatenate(fps), most, solved)

    return run


def _large_out(key: np.ndarray, fp: np.ndarray, most: int, solved) -> Iterator[pa.RecordBatch]:
    if not len(key):
        return
    cut = np.flatnonzero(np.diff(key)) + 1
    size = np.diff(np.concatenate([[0], cut, [len(key)]]))
    large = np.repeat(size > most, size)
    if large.any():
        yield _rows(1, key[large], fp[large])
        key, fp = key[~large], fp[~large]
    if len(key):
        yield from solved(key, fp)


def _rows(kind: int, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, dtype=np.int32)), pa.array(np.asarray(a, dtype=np.int64)),
                                       pa.array(np.asarray(b, dtype=np.int64))], names=["kind", "a", "b"])


def links(fps: DataFrame, bits: int = BITS, most: int = BUCKET_ROWS) -> DataFrame:
    """a, b: links between different fingerprints (``fps``: distinct, column fp) that connect all that lie within ``bits`` bits.

    A bucket of over ``most`` fingerprints is cut into blocks, and every two blocks of it meet in a group of their own.
    """
    dealt = variants(fps, bits).repartition("key").sortWithinPartitions("key", "fp")
    first = stored(dealt.mapInArrow(_linker(bits, most), "kind int, a long, b long"), "links")
    found, large = first.where("kind = 0").select("a", "b"), first.where("kind = 1")
    if large.isEmpty():
        return found
    sizes = large.groupBy("a").agg(F.ceil(F.count("*") / F.lit(most / 2)).cast("int").alias("n"))
    block = large.join(sizes, "a").select("a", "b", "n", F.pmod(F.xxhash64("b"), "n").cast("int").alias("own"))
    met = block.select("b", "a", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    group = F.xxhash64("a", F.least("own", "other"), F.greatest("own", "other"))
    again = met.select(group.alias("key"), F.col("b").alias("fp")).repartition("key").sortWithinPartitions("key", "fp")
    return found.unionByName(again.mapInArrow(_linker(bits, 1 << 40), "kind int, a long, b long").select("a", "b"))


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = BITS) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links of at most ``bits`` bits, the own one included).

    Null texts are empty, and all empty texts are linked, as equal fingerprints are; repeated rows give a row each; rows with
    a null doc_id link others but never name a component; an empty table gives no rows; other columns are not read.
    """
    fps = stored(fingerprints(docs, words), "fingerprints")
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    root = stored(components(links(nodes.select("fp"), bits)).select(F.col("node").alias("fp"), "root"), "roots")
    linked = nodes.join(root, "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    named = root.join(least, "root").select("fp", "component")
    alone = nodes.where("n > 1").join(root, "fp", "left_anti").select("fp", F.col("least").alias("component"))
    groups = stored(named.unionByName(alone), "groups")
    return lookup_join(fps, groups, ["fp"]).select("doc_id", "fp", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, bits: int = BITS) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, that of the smallest doc_id; columns as they are.

    Rows that share a doc_id are one document, of which the row of the least content stays; a row with a null doc_id can't be
    named and stays.
    """
    found = stored(near_duplicates(docs, words, bits), "components")
    state = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("first"), F.count("*").alias("n"))
    odd = stored(state.where("first = 0 OR n > 1"), "odd")
    kept = docs.join(odd.select(F.col("doc_id").alias("__id")), F.col("doc_id").cast("long") == F.col("__id"), "left_anti")
    again = odd.where("first = 1").select(F.col("doc_id").alias("__id"))
    one = (docs.join(again, F.col("doc_id").cast("long") == F.col("__id"), "inner").groupBy("__id")
           .agg(F.min(F.struct(*docs.columns)).alias("__row")).select("__row.*"))
    return kept.unionByName(one)
