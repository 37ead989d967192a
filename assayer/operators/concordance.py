"""Kendall's rank correlation from inversion counts, without a table of pairs.

Pairs of values are counted first and put in order by ranges of (a, b).  The values of b are cut into cells: between two cut
points, or equal to one.  A discordant pair lies in two cells or in one: across cells it is counted within a range as it is
read, and between ranges from the counts of each range and cell; within a cell its members meet in a task of their own.  A
cell of one value has no discordant pairs, so a value that many rows share needs no task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.values import nan_is_missing, number
from assayer.plans.columns import dtype
from assayer.plans.ordered import RANGE, ranged
from assayer.session import cut

CELL_PAIRS = 1_000_000  # pairs of values of about one cell
MAX_CUTS = 1_024        # cells and ranges are counted on the driver


def inversions(rank: np.ndarray, weight: np.ndarray) -> int:
    """The sum of w_i * w_j over i < j with rank_i > rank_j, by merging runs that double in size."""
    total, index, width = 0, np.arange(len(rank)), 1
    rank = np.unique(rank, return_inverse=True)[1]
    while width < len(rank):
        run, right = index // (2 * width), (index // width) % 2
        order = np.lexsort((right, rank, run))
        run, right, w = run[order], right[order].astype(bool), weight[order]
        left = np.where(right, 0, w)
        upto = np.cumsum(left)
        ends = np.flatnonzero(np.r_[run[1:] != run[:-1], True])
        above = upto[ends][np.searchsorted(ends, np.arange(len(run)))] - upto
        total += int(np.sum(np.where(right, w, 0).astype(np.longdouble) * above))
        width *= 2
    return total


def _cells(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Twice the cuts below a value, and one more if it equals a cut."""
    at = np.searchsorted(cuts, values)
    return 2 * at + (cuts[np.minimum(at, len(cuts) - 1)] == values) if len(cuts) else np.zeros(len(values), dtype=int)


@nan_is_missing
def kendall(df: DataFrame, a: str, b: str, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """(tau, n, concordant, discordant): tau-b over the rows that have both values; null without two different values of each."""
    joint = df.select(number(a, dtype(df, a)).alias("a"), number(b, dtype(df, b)).alias("b")).dropna()
    joint = cut(joint.groupBy("a", "b").agg(F.count(F.lit(1)).alias("m")))
    pair = lambda c: F.sum(F.col(c).cast("decimal(38,0)") * (F.col(c) - 1) / 2).cast("decimal(38,0)")
    whole = joint.agg(F.count(F.lit(1)).alias("pairs"), F.sum("m").alias("n"), pair("m").alias("both")).first()
    n = int(whole["n"] or 0)
    spark = df.sparkSession
    schema = "tau double, n bigint, concordant double, discordant double"
    tied = [joint.groupBy(c).agg(F.sum("m").alias("m")).agg(pair("m")).first()[0] if n else 0 for c in ("a", "b")]
    n0, n1, n2, n3 = n * (n - 1) // 2, *[int(x or 0) for x in tied], int(whole["both"] or 0)
    if n0 in (n1, n2):
        return spark.createDataFrame([(None, n, 0.0, 0.0)], schema)
    k = min(MAX_CUTS, -(-whole["pairs"] // cell_pairs))
    grid = [i / k for i in range(1, k)]
    cuts = np.unique(np.array(joint.agg(F.percentile_approx("b", grid)).first()[0])) if grid else np.zeros(0)
    rows = ranged(joint, ["a", "b"])

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Counts of each cell of a range, and as cell -1 its discordant pairs across cells."""
        held, found = {}, {}
        for pdf in parts:
            for r, own in pdf.groupby(RANGE, sort=False):
                cell, w = _cells(own["b"].to_numpy(), cuts), own["m"].to_numpy()
                before = held.setdefault(r, np.zeros(2 * len(cuts) + 1, dtype=np.int64))
                above = before.sum() - np.cumsum(before)
                found[r] = found.get(r, 0) + int(np.sum(w.astype(np.longdouble) * above[cell])) + inversions(cell, w)
                np.add.at(before, cell, w)
        for r, counts in held.items():
            yield pd.DataFrame({"range": r, "cell": np.r_[-1, np.flatnonzero(counts)], "m": [float(found[r]), *counts[counts > 0].astype(float)]})

    # A range is one partition of the cut table, so a task reads its rows in order.
    seen = rows.sortWithinPartitions(RANGE, "a", "b").select(RANGE, "b", "m").mapInPandas(read, "range int, cell int, m double").toPandas()
    across = seen[seen["cell"] >= 0]
    ranges = {r: i for i, r in enumerate(sorted(across["range"].unique()))}
    counts = np.zeros((len(ranges), 2 * len(cuts) + 1), dtype=np.longdouble)
    counts[across["range"].map(ranges).to_numpy(), across["cell"].to_numpy()] = across["m"].to_numpy()
    earlier = np.cumsum(counts, axis=0) - counts
    later_cells = earlier.sum(axis=1, keepdims=True) - np.cumsum(earlier, axis=1)
    discordant = int(seen.loc[seen["cell"] < 0, "m"].sum()) + int((counts * later_cells).sum())

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            cell = _cells(pdf["b"].to_numpy(), cuts)
            yield pdf.assign(cell=cell)[cell % 2 == 0]

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a", "b"])
        return pd.DataFrame({"q": [float(inversions(pdf["b"].to_numpy(), pdf["m"].to_numpy()))]})

    inner = (joint.select("a", "b", "m").mapInPandas(place, "a double, b double, m bigint, cell int").groupBy("cell")
             .applyInPandas(within, "q double").agg(F.sum("q")).first()[0])
    discordant += int(inner or 0)
    concordant = n0 - n1 - n2 + n3 - discordant
    tau = (concordant - discordant) / (float(n0 - n1) ** .5 * float(n0 - n2) ** .5)
    return spark.createDataFrame([(float(tau), n, float(concordant), float(discordant))], schema)
