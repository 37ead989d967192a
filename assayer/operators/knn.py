"""Exact k-nearest-neighbour join and the operators built on it.

Equal vectors are first reduced to one (with at most k+1 ids), so copies are compared once.  Points of a counted, small size
are sent to all tasks, and each query is answered where it lies.  Beyond that size vectors are spread over cells around
hashed pivots and the search takes two rounds: a query first meets its own cell, which gives its true k-th distance so far,
and then, by the triangle inequality, only the cells that can hold anything nearer.  Small cells travel together in packs, so
that a query is copied to a few packs and not to each cell; large cells are cut into packs of their own and the queries of a
pack into chunks.  Every task compares two bounded blocks with numpy and returns k rows per query, never all pairs; the k
best of all tasks are kept by a rank filter, which Spark applies before the shuffle too.  A matrix product chooses the pairs
whose exact distance is computed.

A component may be missing (NaN).  Then only the components that a query has count, and only points that have all of them
may answer; distances on fewer components are never larger, so the same pivots, cells and bounds hold for every pattern.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.values import as_col, number, unit_hash
from assayer.plans.columns import dtype, numeric_columns
from assayer.plans.lookup import lookup_join
from assayer.plans.ordered import row_numbers
from assayer.session import cut

BLOCK = 20_000       # most points, and about as many queries, in one comparison task
DIRECT = 20_000      # most points, and
DIRECT_CELLS = 4_000_000  # most components of all points, that are sent to all tasks
MAX_PIVOTS = 1_024   # pivots on the driver: at most this many vectors
ROWS = 500           # queries placed or answered at once
PACKS = 16           # packs of cells that a table makes at most, while a pack's components stay within DIRECT_CELLS
PRODUCT = 4_000_000  # distances in one matrix product

#: Rows of the first matrix, slots, places in the second, distances of the k nearest; a slot is what is looked for.
Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
Match = Callable[..., Iterator[Found]]


def vectors(df: DataFrame, id_col: str, cols: Sequence[str] | str, keep: Sequence[str] = ()) -> DataFrame:
    """(id, vec, *keep) from numeric columns or one array column; rows with a null are left out."""
    vec = as_col(cols).cast("array<double>") if isinstance(cols, str) else F.array(*[number(c, dtype(df, c)) for c in cols])
    return df.select(as_col(id_col).cast("bigint").alias("id"), vec.alias("vec"), *keep).where(
        F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull()))


def _distinct(points: DataFrame, k: int) -> DataFrame:
    """(vid, vec, ids): one row per distinct vector with its ``k + 1`` smallest ids."""
    w = Window.partitionBy("vec").orderBy("id")
    few = points.select("id", "vec").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    return few.groupBy("vec").agg(F.min("id").alias("vid"), F.sort_array(F.collect_list("id")).alias("ids"))


def _dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact differences in slabs: no cancellation, equal vectors are at distance zero."""
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        d = a[i:i + step, None, :] - b[None, :, :]
        out[i:i + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def _known_dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances on the components that a row of ``a`` has; ``b`` is whole."""
    if not np.isnan(a).any():
        return _dist(a, b)
    out = np.empty((len(a), len(b)))
    for mask, rows in _patterns(a):
        out[rows] = _dist(a[rows][:, mask], b[:, mask])
    return out


def _patterns(a: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each set of components that rows have (as a mask), and those rows."""
    masks, which = np.unique(~np.isnan(a), axis=0, return_inverse=True)
    for k, mask in enumerate(masks):
        yield mask, np.flatnonzero(which.ravel() == k)


def _within(a: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int, bound: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, position) that hold the k nearest of every row, and little more.

    Squared distances from one matrix product choose them; they are kept up to twice the product's rounding error beyond a limit
    that k points meet: the k-th of the least distances of groups of points.
    """
    an, bn = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    if not np.isfinite(an.max(initial=0) + bn.max(initial=0)):  # nothing is left out
        return np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a))
    error = 8 * (a.shape[1] + 8) * np.finfo(float).eps * (an + bn.max(initial=0)) + np.finfo(float).tiny
    near = a @ b.T
    near *= -2
    near += bn
    near += an[:, None]
    limit = np.full(len(a), np.inf)
    if len(b) > k:
        groups = max(k, len(b) // 32)
        deep = len(b) // groups
        least = near[:, :deep * groups].reshape(len(a), deep, groups).min(axis=1)
        limit = np.partition(least, k - 1, axis=1)[:, k - 1]
    if bound is not None:
        limit = np.minimum(limit, bound * bound * (1 + 1e-9))
    return np.nonzero(near <= (limit + 2 * error)[:, None])


def _gathered(a: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int, bound: np.ndarray | None, rows: np.ndarray, places: np.ndarray, slot: int) -> Found:
    """The k nearest of ``b`` to every row of ``a`` by (exact distance, id); ``rows`` and ``places`` are their numbers."""
    out: list[Found] = []
    step = max(1, PRODUCT // max(1, len(b)))
    for at in range(0, len(a), step):
        part = a[at:at + step]
        row, pos = _within(part, b, ids, k, None if bound is None else bound[at:at + step])
        dist = np.empty(len(row))
        some = max(1, PRODUCT // max(1, a.shape[1]))
        for i in range(0, len(row), some):
            d = part[row[i:i + some]] - b[pos[i:i + some]]
            dist[i:i + some] = np.sqrt(np.einsum("ij,ij->i", d, d))
        order = np.lexsort((ids[pos], dist, row))
        row, pos, dist = row[order], pos[order], dist[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        row = row[first]
        out.append((rows[at + row], np.full(len(row), slot), places[pos[first]], dist[first]))
    return tuple(map(np.concatenate, zip(*out))) if out else (rows[:0], rows[:0], places[:0], np.zeros(0))


def match_whole(a: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int, bound: np.ndarray | None = None) -> Iterator[Found]:
    """The k nearest rows of ``b`` to every row of ``a``; those beyond a row's bound may be missing."""
    yield _gathered(a, b, ids, k, bound, np.arange(len(a)), np.arange(len(b)), 0)


def match_missing(a: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int, bound: np.ndarray | None = None) -> Iterator[Found]:
    """For every missing component (slot) of a row of ``a`` the k nearest rows of ``b`` that have it and all that the row has."""
    have = ~np.isnan(b)
    for mask, rows in _patterns(a):
        if not mask.any():
            continue
        able = have[:, mask].all(axis=1)
        for slot in np.flatnonzero(~mask):
            places = np.flatnonzero(able & have[:, slot])
            if len(places):
                yield _gathered(a[rows][:, mask], b[places][:, mask], ids[places], k, None if bound is None else bound[rows], rows, places, int(slot))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _search(qs: DataFrame, pts: DataFrame, n: int, kk: int, match: Match, block: int, seed: int) -> DataFrame:
    """(qid, slot, vid, dist): the kk nearest of the ``n`` points (vid, vec, ids) for each slot of a query (qid, vec), in two rounds."""
    m = max(1, min(MAX_PIVOTS, n // max(1, block // 20)))
    whole = F.transform("vec", lambda x: F.nanvl(x, F.lit(0.0)))
    picked = pts.withColumn("h", unit_hash(["vid"], seed)).orderBy("h", "vid").limit(m).select(whole.alias("vec")).collect()
    pivots = np.array([r["vec"] for r in picked], dtype=float)

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                d = _known_dist(_matrix(pdf["vec"]), pivots)
                c = d.argmin(axis=1)
                yield pdf.assign(cell=c.astype("int32"), away=d[np.arange(len(c)), c])

    placed = cut(pts.select("vid", "vec").mapInPandas(place, "vid bigint, vec array<double>, cell int, away double"))
    asking = cut(qs.select("qid", "vec").mapInPandas(place, "qid bigint, vec array<double>, cell int, away double").drop("away"))
    sizes = {r["cell"]: (r["n"], r["rad"]) for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("rad")).collect()}
    cells = np.array(sorted(sizes), dtype=int)
    radius = np.array([sizes[c][1] for c in cells])

    # A pack is several small cells or a part of a large one; a cell has the packs from its first on.
    dim = max(1, pivots.shape[1])
    pack = max(1, min(max(block, -(-n // PACKS)), max(1000, DIRECT_CELLS // dim)))
    first, parted, packs, room = {}, {}, 0, 0
    for c in cells.tolist():
        size = sizes[c][0]
        if size > pack:
            first[c], parted[c], room = packs, -(-size // pack), 0
            packs += parted[c]
        else:
            if size > room:
                packs, room = packs + 1, pack
            first[c], parted[c], room = packs - 1, 1, room - size
    member = np.zeros((len(cells), packs), dtype=np.float32)
    for i, c in enumerate(cells.tolist()):
        member[i, first[c]:first[c] + parted[c]] = 1
    inside = [np.flatnonzero(member[:, p]) for p in range(packs)]

    def asks(vec: np.ndarray, bound: np.ndarray, own: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Whether a query must meet the cells ``some``, other than its own."""
        least = _known_dist(vec, pivots[cells[some]]) - radius[some]
        return (least <= bound[:, None] * (1 + 1e-9) + 1e-12) & (cells[some][None, :] != own[:, None])

    def compare_in(home: bool):
        def compare(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"qid": pd.Series(dtype="int64"), "slot": pd.Series(dtype="int32"), "vid": pd.Series(dtype="int64"), "dist": pd.Series(dtype="float64")})]
            if len(a) and len(b):
                names, bound, own, am = a["qid"].to_numpy(), a["bound"].to_numpy(), a["cell"].to_numpy(), _matrix(a["vec"])
                ids, at, bm = b["vid"].to_numpy(), b["cell"].to_numpy(), _matrix(b["vec"])
                some = inside[key[0]]
                ask = own[:, None] == cells[some][None, :] if home else asks(am, bound, own, some)
                held = np.array([(at == c).sum() for c in cells[some]])
                wide = ask @ held * 4 > len(b)  # such queries meet the pack at once
                meet = [(np.flatnonzero(wide), np.arange(len(b)))] if not home and wide.any() else []
                meet += [(np.flatnonzero(ask[:, i] & (home | ~wide)), np.flatnonzero(at == c)) for i, c in enumerate(cells[some])]
                for rows, places in meet:
                    if not len(rows) or not len(places):
                        continue
                    for row, slot, pos, dist in match(am[rows], bm[places], ids[places], kk, bound[rows]):
                        row, pos = rows[row], places[pos]
                        near = (dist <= bound[row]) & (home | (at[pos] != own[row]))  # the own cell has answered
                        out.append(pd.DataFrame({"qid": names[row[near]], "slot": slot[near].astype("int32"), "vid": ids[pos[near]], "dist": dist[near]}))
            return pd.concat(out, ignore_index=True)
        return compare

    spots = qs.sparkSession.createDataFrame([(int(c), first[c], parted[c]) for c in first], "cell int, first int, parted int")
    dealt = placed.join(F.broadcast(spots), "cell").select("cell", "vid", "vec", (F.col("first") + F.pmod(F.xxhash64("vid"), F.col("parted"))).cast("int").alias("pack"))

    def met(asked: DataFrame, home: bool) -> DataFrame:
        """The kk nearest of the points in the packs that queries (qid, vec, bound, cell, pack) name."""
        n_asked = {r["pack"]: r["n"] for r in asked.groupBy("pack").agg(F.count(F.lit(1)).alias("n")).collect()}
        shape = qs.sparkSession.createDataFrame([(p, -(-m // pack)) for p, m in n_asked.items()], "pack int, nc int")
        left = (asked.join(F.broadcast(shape), "pack").withColumn("chunk", F.pmod(F.xxhash64("qid"), F.col("nc")).cast("int"))
                .select("pack", "chunk", "qid", "vec", "bound", "cell"))
        right = (dealt.join(F.broadcast(shape), "pack").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("nc") - 1)))
                 .select("pack", "chunk", "vid", "vec", "cell"))
        keys = ["pack", "chunk"]
        return best(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare_in(home), "qid bigint, slot int, vid bigint, dist double"))

    def best(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("qid", "slot").orderBy("dist", "vid")
        return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= kk).drop("r")

    home = asking.join(F.broadcast(spots), "cell").select("qid", "vec", "cell", F.lit(float("inf")).alias("bound"), F.explode(
        F.sequence(F.col("first"), F.col("first") + F.col("parted") - 1)).alias("pack"))
    own = cut(met(home, True))
    # A query's bound is the greatest k-th distance of its slots, infinite if its cell could not fill each of them.
    slots = F.greatest(F.lit(1), F.size(F.filter("vec", F.isnan))) if match is match_missing else F.lit(1)
    kth = own.groupBy("qid").agg(F.max("dist").alias("far"), F.count(F.lit(1)).alias("found"))
    bound = F.when(F.col("found") >= kk * slots, F.col("far")).otherwise(F.lit(float("inf")))
    bounded = asking.join(kth, "qid", "left").select("qid", "vec", "cell", bound.alias("bound"))

    everywhere = np.arange(len(cells))

    def route(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for at in range(0, len(pdf), ROWS):
                some = pdf.iloc[at:at + ROWS]
                ask = asks(_matrix(some["vec"]), some["bound"].to_numpy(), some["cell"].to_numpy(), everywhere)
                yield some.assign(packs=[np.flatnonzero(r).astype("int32") for r in ask.astype(np.float32) @ member > 0])

    # One row a query; a vector is copied to its packs in the shuffle only.
    routed = cut(bounded.mapInPandas(route, "qid bigint, vec array<double>, cell int, bound double, packs array<int>"))
    # cut, since the joins that follow count it first
    return cut(best(own.unionByName(met(routed.select("qid", "vec", "bound", "cell", F.explode("packs").alias("pack")), False))))


def _sent(pts: DataFrame, n: int, direct: int) -> tuple | None:
    """(vids, matrix, ids) of points of a small size on the driver, to be sent to all tasks; else None."""
    if n > direct or n and n * (pts.select(F.size("vec")).first()[0]) > DIRECT_CELLS:
        return None
    rows = sorted((r["vid"], r["vec"], r["ids"]) for r in pts.collect())
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float), [r[2] for r in rows]


def knn_join(queries: DataFrame, points: DataFrame, k: int, exclude_self: bool = True, block: int = BLOCK, seed: int = 42,
             direct: int = DIRECT) -> DataFrame:
    """(id, nid, dist, rank) of the ``k`` nearest points of every query (both tables: id, vec); ties by smaller id."""
    kk = k + 1 if exclude_self else k
    pts = cut(_distinct(points, k))
    n = pts.count()
    if n == 0:
        return queries.sparkSession.createDataFrame([], "id bigint, nid bigint, dist double, rank int")
    sent = _sent(pts, n, direct)
    if sent is not None:
        held = queries.sparkSession.sparkContext.broadcast(sent)

        def answer(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            vids, matrix, ids = held.value
            for pdf in parts:
                for at in range(0, len(pdf), ROWS):
                    some, out = pdf.iloc[at:at + ROWS], []
                    names = some["id"].to_numpy()
                    for row, _, pos, dist in match_whole(_matrix(some["vec"]), matrix, vids, kk):
                        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                        for a, b in zip(starts, np.r_[starts[1:], len(row)]):
                            own = sorted((d, i) for p, d in zip(pos[a:b].tolist(), dist[a:b].tolist()) for i in ids[p]
                                         if not exclude_self or i != names[row[a]])[:k]
                            out += [(names[row[a]], i, d, r) for r, (d, i) in enumerate(own, 1)]
                    yield pd.DataFrame(out, columns=["id", "nid", "dist", "rank"])

        spread = max(1, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        return queries.select("id", "vec").repartition(spread, "id").mapInPandas(answer, "id bigint, nid bigint, dist double, rank int")
    # vectors of a query that is also a point are looked up once per distinct vector
    qmap = queries.select("id", "vec")
    qs = cut(qmap.groupBy("vec").agg(F.min("id").alias("qid")))
    top = _search(qs, pts, n, kk, match_whole, block, seed)
    named = top.join(pts.select("vid", "ids"), "vid").groupBy("qid").agg(F.array_sort(F.flatten(F.collect_list(F.transform(
        "ids", lambda i: F.struct(F.col("dist").alias("dist"), i.alias("nid")))))).alias("cand"))
    # back to every original row: the lookup side is unique per vector, hot vectors are split when it is large
    rows = lookup_join(qmap, cut(lookup_join(qs, cut(named), ["qid"]).select("vec", "cand")), ["vec"])
    others = F.filter("cand", lambda s: s["nid"] != F.col("id")) if exclude_self else F.col("cand")
    return rows.select("id", F.posexplode(F.slice(others, 1, k)).alias("pos", "s")).select(
        "id", F.col("s.nid").alias("nid"), F.col("s.dist").alias("dist"), (F.col("pos") + 1).alias("rank"))


def local_outlier_factor(points: DataFrame, k: int = 20) -> DataFrame:
    """(id, lof) by k-distance, reachability and local density over one neighbour table."""
    nb = cut(knn_join(points, points, k))
    kd = nb.groupBy(F.col("id").alias("nid")).agg(F.max("dist").alias("kdist"))
    lrd = lookup_join(nb, kd, ["nid"], "inner").groupBy("id").agg((1 / (F.avg(F.greatest("dist", "kdist")) + 1e-10)).alias("lrd"))
    far = lrd.select(F.col("id").alias("nid"), F.col("lrd").alias("nlrd"))
    return lookup_join(nb, far, ["nid"], "inner").groupBy("id").agg(F.avg("nlrd").alias("m")).join(lrd, "id").select("id", (F.col("m") / F.col("lrd")).alias("lof"))


def predict(queries: DataFrame, points: DataFrame, value: str, k: int = 5, kind: str = "classification", weights: str = "uniform",
            exclude_self: bool = False) -> DataFrame:
    """Majority vote (smaller class on ties) or mean of the ``k`` nearest points, optionally by inverse distance."""
    # copies of a vector all name the same neighbours, so these ids can be hot
    nb = lookup_join(cut(knn_join(queries, points, k, exclude_self)), points.select(F.col("id").alias("nid"), F.col(value).alias("v")), ["nid"], "inner")
    w = 1 / (F.col("dist") + 1e-10) if weights == "distance" else F.lit(1.0)
    if kind == "regression":
        return nb.groupBy("id").agg((F.sum(w * F.col("v")) / F.sum(w)).alias("yhat"))
    votes = nb.groupBy("id", "v").agg(F.round(F.sum(w), 12).alias("w"))
    return votes.groupBy("id").agg(F.min(F.struct((-F.col("w")).alias("w"), "v")).alias("m")).select("id", F.col("m.v").alias("yhat"))


def impute(df: DataFrame, id_col: str, cols: Sequence[str] | None = None, k: int = 5, block: int = BLOCK, seed: int = 42,
           direct: int = DIRECT) -> DataFrame:
    """Fill every numeric column with the mean of the ``k`` nearest rows that have a value.

    Distance is over the columns that the row has, donors have all of them and the column; a row without any gets the mean
    of all values.  One index serves all patterns of missing columns, so the number of jobs does not depend on them.
    """
    cols = [c for c in numeric_columns(df, cols) if c != id_col]
    if not cols:
        return df
    df = cut(df)
    vec = F.array(*[F.coalesce(number(c, dtype(df, c)), F.lit(float("nan"))) for c in cols])
    rows = df.select(as_col(id_col).cast("bigint").alias("id"), vec.alias("vec"))
    gaps = F.size(F.filter("vec", F.isnan))
    asking = rows.where((gaps > 0) & (gaps < len(cols)))
    pts = cut(_distinct(rows.where(gaps < len(cols)), k))
    n = pts.count()
    means = df.agg(*[F.avg(number(c, dtype(df, c))).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    fills = None
    if n:
        sent = _sent(pts, n, direct)
        if sent is not None:
            held = df.sparkSession.sparkContext.broadcast(sent)

            def answer(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                vids, matrix, ids = held.value
                for pdf in parts:
                    for at in range(0, len(pdf), ROWS):
                        some = pdf.iloc[at:at + ROWS]
                        whole = _matrix(some["vec"])
                        for row, slot, pos, dist in match_missing(_matrix(some["vec"]), matrix, vids, k):
                            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                            for a, b in zip(starts, np.r_[starts[1:], len(row)]):
                                own = sorted((d, i, p) for p, d in zip(pos[a:b].tolist(), dist[a:b].tolist()) for i in ids[p])[:k]
                                whole[row[a], slot[a]] = np.mean([matrix[p, slot[a]] for *_, p in own])
                        yield pd.DataFrame({"id": some["id"], "fill": list(whole)})

            spread = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
            fills = asking.repartition(spread, "id").mapInPandas(answer, "id bigint, fill array<double>")
        else:
            qs = cut(asking.groupBy("vec").agg(F.min("id").alias("qid")))
            top = _search(qs, pts, n, k, match_missing, block, seed)
            near = top.join(pts.select("vid", "ids", F.col("vec").alias("other")), "vid").groupBy("qid", "slot").agg(
                F.slice(F.array_sort(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(
                    F.col("dist").alias("dist"), i.alias("nid"), F.get("other", F.col("slot")).alias("v")))))), 1, k).alias("near"))
            mean = F.aggregate("near", F.lit(0.0), lambda a, x: a + x["v"]) / F.size("near")
            filled = near.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("slot", mean.alias("v")))).alias("found"))
            each = lookup_join(qs, filled, ["qid"]).select("vec", F.transform(F.col("vec"), lambda x, i: F.when(
                F.isnan(x), F.element_at(F.col("found"), i)).otherwise(x)).alias("fill"))
            fills = lookup_join(asking, each, ["vec"]).select("id", "fill")
    out = df if fills is None else df.join(fills.select(F.col("id").alias("__id"), F.col("fill").alias("__fill")), as_col(id_col) == F.col("__id"), "left")
    at = {c: i for i, c in enumerate(cols)}
    alone = ~F.coalesce(*[number(c, dtype(df, c)) for c in cols]).isNotNull()

    def value(c: str) -> Column:
        own = number(c, dtype(df, c))
        near = F.lit(None).cast("double") if fills is None else F.get("__fill", F.lit(at[c]))
        return F.coalesce(own, F.when(~F.isnan(near), near), F.when(alone, F.lit(means[f"m{at[c]}"]))).alias(c)

    return out.select(*[value(c) if c in at else as_col(c) for c in df.columns])


def smote(points: DataFrame, label: str, minority, k: int = 5, variant: str = "smote", seed: int = 42) -> DataFrame:
    """(id, vec, label, synthetic): minority rows interpolated towards neighbours until classes balance.

    ``borderline`` only starts from minority rows with mostly majority neighbours; ``adasyn`` draws more copies
    where majority neighbours are dense.
    """
    pts = cut(points.select("id", "vec", as_col(label).alias("label")))
    mine = pts.where(F.col("label") == minority)
    sizes = pts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("hi"), F.max(F.when(F.col("label") == minority, F.col("n"))).alias("lo")).first()
    need = sizes["hi"] - sizes["lo"]
    seeds = mine.select("id", "vec")
    if variant != "smote":
        around = lookup_join(knn_join(mine.select("id", "vec"), pts.select("id", "vec"), 2 * k), pts.select(F.col("id").alias("nid"), "label"), ["nid"], "inner")
        risk = around.groupBy("id").agg(F.avg((F.col("label") != minority).cast("double")).alias("risk"))
        kept = risk.where((F.col("risk") >= .5) & (F.col("risk") < 1)) if variant == "borderline" else risk.where("risk > 0")
        seeds = seeds.join(kept, "id")
    seeds = cut(seeds)
    n_seeds = seeds.count()
    if need <= 0 or n_seeds == 0:
        return pts.withColumn("synthetic", F.lit(False))
    if variant == "adasyn":
        total_risk = seeds.agg(F.sum("risk")).first()[0]
        seeds = seeds.withColumn("copies", F.round(F.col("risk") / total_risk * need).cast("int"))
    else:
        each, rest = divmod(need, n_seeds)
        ranked = row_numbers(seeds.withColumn("h", unit_hash(["id"], seed)), ["h", "id"], (), "rn")
        seeds = ranked.withColumn("copies", (F.lit(each) + F.when(F.col("rn") <= rest, 1).otherwise(0)).cast("int"))
    nb = knn_join(mine.select("id", "vec"), mine.select("id", "vec"), k).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "nid"))).alias("near"))
    plan = seeds.where("copies > 0").select("id", "vec", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).join(nb, "id")
    pick = (F.floor(unit_hash(["id", "copy"], f"{seed}-n") * F.size("near")) + 1).cast("int")
    plan = lookup_join(plan.withColumn("nid", F.element_at("near", pick)["nid"]), mine.select(F.col("id").alias("nid"), F.col("vec").alias("other")), ["nid"], "inner")
    u = unit_hash(["id", "copy"], f"{seed}-u")
    made = plan.withColumn("u", u).select("id", F.zip_with("vec", "other", lambda a, b: a + F.col("u") * (b - a)).alias("vec"),
                                          F.lit(minority).alias("label"), F.lit(True).alias("synthetic"))
    return pts.withColumn("synthetic", F.lit(False)).unionByName(made)


def tomek(points: DataFrame, label: str, majority) -> DataFrame:
    """Points without the majority members of mutual nearest pairs of opposite class."""
    nb = cut(knn_join(points, points, 1).select("id", "nid"))
    back = nb.select(F.col("id").alias("nid"), F.col("nid").alias("id"))
    pairs = nb.join(back, ["id", "nid"])
    lab = points.select("id", as_col(label).alias("a"))
    drop = (lookup_join(pairs.join(lab, "id"), lab.select(F.col("id").alias("nid"), F.col("a").alias("b")), ["nid"], "inner")
            .where((F.col("a") != F.col("b")) & (F.col("a") == majority)).select("id"))
    return points.join(drop, "id", "left_anti")


def lof_threshold_flag(scores: DataFrame, contamination: float) -> Column:
    from assayer.plans.quantiles import exact_quantiles

    limit = exact_quantiles(scores, ["lof"], [1 - contamination])["lof"][0]
    return F.col("lof") > limit
