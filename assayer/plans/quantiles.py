"""Exact quantiles of many columns without collecting a column anywhere.

``percentile`` keeps every distinct value of a column in one task.  Here a bounded sketch
(``percentile_approx``) only proposes cut points; counting aggregates then prove on which side of a
cut each wanted rank lies, and the few values left between two proven cuts are ranked exactly.
Three light scans settle up to about 10^9 rows, each further scan a factor of some thousands.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.values import number
from assayer.plans.columns import dtype, union_all

ACCURACY = 1_000  # sketch size: rank error of at most n / ACCURACY per scan
SETTLE = 200_000  # most rows that are ranked exactly in one window
GROUPS_PER_SCAN = 100  # sketches held by one task; above 128 groups Spark sorts instead of hashing
TERMS = 48  # cuts per column up to which a cell is a plain sum of comparisons


def exact_quantiles(df: DataFrame, cols: Sequence[str] | Mapping[str, Sequence[float]],
                    probs: Sequence[float] = (), accuracy: int = ACCURACY,
                    settle: int = SETTLE) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles (nulls ignored), one list per column in ``probs`` order."""
    wanted = {c: list(p) for c, p in cols.items()} if isinstance(cols, Mapping) else {c: list(probs) for c in cols}
    names = list(wanted)
    stats, n = _ranks(df, wanted, accuracy, settle)
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(names):
        vals: list[float | None] = []
        for p in wanted[c]:
            if n[i] == 0:
                vals.append(None)
                continue
            pos = p * (n[i] - 1)
            lo, hi = math.floor(pos), math.ceil(pos)
            a, b = stats[i, lo], stats[i, hi]
            vals.append(a + (b - a) * (pos - lo))
        out[c] = vals
    return out


def order_statistics(df: DataFrame, col: str, ranks_of_n) -> tuple[list[float], int]:
    """Values at 0-based ranks; ``ranks_of_n`` maps the non-null count to the wanted ranks."""
    d = df.select(number(col, dtype(df, col)).alias("v")).where("v is not null")
    n = d.count()
    if n == 0:
        return [], 0
    ranks = [min(max(r, 0), n - 1) for r in ranks_of_n(n)]
    wanted = {"v": [r / (n - 1) if n > 1 else 0.0 for r in ranks]}
    stats, _ = _ranks(d, wanted, ACCURACY, SETTLE, exact_ranks={0: ranks})
    return [stats[0, r] for r in ranks], n


def even_quantiles(df: DataFrame, col: str, steps: int) -> list[float]:
    """Exact quantiles at ``steps`` (at most the number of values) evenly spaced probabilities.

    Values are counted, range-sorted and given running counts; only rows in which a wanted rank falls are returned.
    """
    from assayer.plans.ordered import running_sums

    counted = (df.select(number(col, dtype(df, col)).alias("v")).where("v is not null")
               .groupBy("v").agg(F.count(F.lit(1)).alias("m")))
    n = counted.agg(F.sum("m").alias("n")).first()["n"] or 0
    if n < 2:
        return [r["v"] for r in counted.collect()] * 2 if n else []
    k = max(2, min(steps, n))
    width = (n - 1) / (k - 1)
    run = running_sums(counted, {"c": F.col("m")}, ["v"])
    # ranks of this value are [c - m, c); rank i*width may need its floor and its ceiling
    near = run.select("v", "c", "m", F.explode(F.sequence(
        F.greatest(F.lit(0), F.floor((F.col("c") - F.col("m") - 1) / width)), F.least(F.lit(k - 1), F.ceil((F.col("c") + 1) / width)))).alias("i"))
    pos = F.col("i") * F.lit(width)
    inside = lambda rank: (rank >= F.col("c") - F.col("m")) & (rank < F.col("c"))
    ends = near.groupBy("i").agg(F.max(F.when(inside(F.floor(pos + 1e-9)), F.col("v"))).alias("a"),
                                 F.max(F.when(inside(F.ceil(pos - 1e-9)), F.col("v"))).alias("b")).collect()
    out = {}
    for e in ends:
        p = e["i"] * width
        frac = p - math.floor(p + 1e-9)
        out[e["i"]] = e["a"] + (e["b"] - e["a"]) * max(frac, 0.0)
    return [out[i] for i in range(k)]


def _ranks(df, wanted, accuracy, settle, exact_ranks=None):
    names = list(wanted)
    d = df.select(*[number(c, dtype(df, c)).alias(f"q{i}") for i, c in enumerate(names)])
    step = 2.0 / accuracy
    grids = [sorted({min(max(p + s, 0.0), 1.0) for p in wanted[c] for s in (-step, step)}) for c in names]
    first = sketch(d, {i: (F.col(f"q{i}"), g) for i, g in enumerate(grids)}, accuracy)
    n = {i: first[i]["n"] for i in range(len(names))}
    found: dict[tuple[int, int], float] = {}
    open_: dict[tuple[int, int], None] = {}
    cuts: dict[int, set[float]] = {}
    for i, c in enumerate(names):
        if n[i] == 0:
            continue
        ranks = exact_ranks[i] if exact_ranks else [
            r for p in wanted[c] for r in (math.floor(p * (n[i] - 1)), math.ceil(p * (n[i] - 1)))]
        for r in ranks:
            if r == 0:
                found[i, r] = first[i]["lo"]
            elif r == n[i] - 1:
                found[i, r] = first[i]["hi"]
            else:
                open_[i, r] = None
        cuts[i] = {first[i]["lo"], first[i]["hi"], *first[i]["g"]}

    counted: dict[int, dict[float, tuple[int, int]]] = {i: {} for i in cuts}
    while open_:
        todo = {i: sorted(v for v in cuts[i] if v not in counted[i]) for i in sorted({i for i, _ in open_})}
        todo = {i: vs for i, vs in todo.items() if vs}
        if todo:
            cells: dict[int, dict[int, int]] = {i: {} for i in todo}
            for row in _cell_counts(d, todo).collect():
                cells[row["i"]][row["cell"]] = row["m"]
            for i, vs in todo.items():
                below = 0
                for k, v in enumerate(vs):
                    below += cells[i].get(2 * k, 0)
                    equal = cells[i].get(2 * k + 1, 0)
                    counted[i][v] = (below, below + equal)
                    below += equal
        small: dict[tuple[int, float, float, int], list[int]] = {}
        large: dict[tuple[int, float, float, int, int], list[int]] = {}
        for i, r in list(open_):
            hit = next((v for v, (lt, le) in counted[i].items() if lt <= r < le), None)
            if hit is not None:
                found[i, r] = hit
                del open_[i, r]
                continue
            a = max(v for v, (_, le) in counted[i].items() if le <= r)
            b = min(v for v, (lt, _) in counted[i].items() if lt > r)
            base, inside = counted[i][a][1], counted[i][b][0] - counted[i][a][1]
            if inside <= settle:
                small.setdefault((i, a, b, base), []).append(r)
            else:
                large.setdefault((i, a, b, base, inside), []).append(r)
        if small:
            keys = list(small)
            within = [f"(q{i} > {_num(a)} AND q{i} < {_num(b)})" for i, a, b, _ in keys]
            pairs = ", ".join(f"CASE WHEN {cond} THEN named_struct('k', {k}, 'v', q{key[0]}) END"
                              for k, (cond, key) in enumerate(zip(within, keys)))
            picked = " OR ".join(f"(k = {k} AND c - m <= {r - key[3]} AND c > {r - key[3]})"
                                 for k, key in enumerate(keys) for r in small[key])
            w = Window.partitionBy("k").orderBy("v")
            # a generator computes the values once, however often the conditions name them
            held = d.select(F.inline(F.array(F.struct(*[f"q{i}" for i in sorted({k[0] for k in keys})]))))
            hits = (held.where(" OR ".join(within)).selectExpr(f"inline(array_compact(array({pairs})))")
                    .groupBy("k", "v").agg(F.count(F.lit(1)).alias("m"))
                    .withColumn("c", F.sum("m").over(w)).where(picked).collect())
            for h in hits:
                key = keys[h["k"]]
                for r in small[key]:
                    if h["c"] - h["m"] <= r - key[3] < h["c"]:
                        found[key[0], r] = h["v"]
                        open_.pop((key[0], r), None)
        if large:
            keys = list(large)
            again = sketch(d, {k: (F.when((F.col(f"q{i}") > F.lit(a)) & (F.col(f"q{i}") < F.lit(b)), F.col(f"q{i}")),
                                    [min(max((r - base) / inside + s, 0.0), 1.0) for r in large[i, a, b, base, inside] for s in (-step, step)])
                                for k, (i, a, b, base, inside) in enumerate(keys)}, accuracy)
            for k, key in enumerate(keys):
                cuts[key[0]].update(again[k]["g"])
    return found, n


def _num(v: float) -> str:
    """A double in SQL; infinity has no literal."""
    return f"CAST('{float(v)!r}' AS DOUBLE)" if math.isinf(v) else f"{float(v)!r}D"


def sketch(d: DataFrame, wanted: Mapping[int, tuple], accuracy: int) -> dict[int, dict]:
    """Count, range and approximate quantiles per entry from one scan; sketches are merged map-side.

    Values are unpivoted, so the plan does not grow with the columns.  All entries are asked for the same grid, which costs
    only at the merge, and keep their own part of it.
    """
    keys = list(wanted)
    grid = sorted({float(p) for _, g in wanted.values() for p in g})
    parts = []
    for at in range(0, len(keys), GROUPS_PER_SCAN):
        some = keys[at:at + GROUPS_PER_SCAN]
        pairs = [F.struct(F.lit(k).alias("k"), wanted[k][0].alias("x")) for k in some]
        parts.append(d.select(F.inline(F.array(*pairs))).groupBy("k").agg(
            F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.percentile_approx("x", grid, accuracy).alias("g")))
    out = {k: {"k": k, "n": 0, "lo": None, "hi": None, "g": None} for k in keys}  # an empty table has no group
    for row in union_all(parts).collect():
        own = {float(p) for p in wanted[row["k"]][1]}
        out[row["k"]] = {**row.asDict(), "g": row["g"] and [v for p, v in zip(grid, row["g"]) if p in own]}
    return out


def _cell_counts(d: DataFrame, cuts: Mapping[int, Sequence[float]]) -> DataFrame:
    """Rows per cell (i, cell) from one scan: even cells lie between two cuts, odd cells equal one.

    A value's cell is twice the cuts below it plus one if it equals a cut.  The cuts are a constant table with a row of the
    same width for each column, so the generated code does not grow with the columns.
    """
    width = max(len(vs) for vs in cuts.values())
    at = {i: k * width for k, i in enumerate(cuts)}
    table = ", ".join(_num(v) if v is not None else "CAST(NULL AS DOUBLE)"
                      for vs in cuts.values() for v in [*vs, *[None] * (width - len(vs))])
    pairs = ", ".join(f"named_struct('i', {i}, 'at', {at[i]}, 'x', q{i})" for i in cuts)
    if width <= TERMS:
        cut = [f"get(array({table}), at + {j})" for j in range(width)]
        cell = " + ".join(f"CASE WHEN x > {c} THEN 2 WHEN x = {c} THEN 1 ELSE 0 END" for c in cut)
    else:
        cell = (f"aggregate(slice(array({table}), at + 1, {width}), 0, "
                f"(s, c) -> s + CASE WHEN x > c THEN 2 WHEN x = c THEN 1 ELSE 0 END)")
    return (d.selectExpr(f"inline(array({pairs}))").where("x is not null").selectExpr("i", f"{cell} AS cell")
            .groupBy("i", "cell").agg(F.count(F.lit(1)).alias("m")))


def quantile_frame(df: DataFrame, cols: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """One small row per column: column_name and one double per named probability."""
    q = exact_quantiles(df, cols, list(probs.values()))
    schema = "column_name string, " + ", ".join(f"{n} double" for n in probs)
    return df.sparkSession.createDataFrame([(c, *q[c]) for c in cols], schema)
