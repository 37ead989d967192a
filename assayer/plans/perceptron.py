"""Weights of a perceptron by rows that count several times: tasks sum loss and gradient of blocks, the driver steps by L-BFGS.

MLlib's perceptron takes no row weights.  Layers, the order of the weights, loss, line search and stop rule are MLlib's, so that
both follow the same path where MLlib reads each row as often as it counts here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import islice
from operator import add

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame

CELLS = 1 << 18  # of the widest layer of one block
MEMORY = 10  # steps that L-BFGS keeps
TRIES = 10  # of a line search, before and within its bracket
VALUES = 20  # the stop rule looks back so many values

Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def blocks(rows: Iterable, size: int) -> Iterator[Block]:
    """Rows (features, class, weight) as matrices of ``size`` rows."""
    rows = iter(rows)
    while part := list(islice(rows, size)):
        x, y, n = zip(*part)
        yield np.array(x, dtype=float), np.array(y, dtype=int), np.array(n, dtype=float)


def loss(block: Block, weights: np.ndarray, layers: Sequence[int]) -> np.ndarray:
    """Cross entropy of a block's rows, each counted by its weight, and its gradient, in one array; sigmoid layers, softmax on top."""
    x, y, n = block
    steps, outs, at = [], [x], 0
    for i, o in zip(layers, layers[1:]):
        steps.append((weights[at:at + i * o].reshape(i, o), weights[at + i * o:at + (i + 1) * o]))
        at += (i + 1) * o
    for w, b in steps[:-1]:
        with np.errstate(over="ignore"):
            outs.append(1 / (1 + np.exp(-(outs[-1] @ w + b))))
    z = outs[-1] @ steps[-1][0] + steps[-1][1]
    z -= z.max(axis=1, keepdims=True)
    e = np.exp(z)
    total, own = e.sum(axis=1, keepdims=True), (np.arange(len(y)), y)
    value = n @ (np.log(total[:, 0]) - z[own])
    delta = e / total
    delta[own] -= 1
    delta *= n[:, None]
    grads: list[np.ndarray] = []
    for (w, _), out in zip(reversed(steps), reversed(outs)):
        grads[:0] = [(out.T @ delta).ravel(), delta.sum(axis=0)]
        delta = (delta @ w.T) * out * (1 - out)
    return np.concatenate([[value], *grads])


def solve(rows: DataFrame, layers: Sequence[int], start: np.ndarray, most: int, tol: float) -> np.ndarray:
    """The weights after at most ``most`` steps from ``start``; ``rows`` are (features array, class, weight), read once and kept in blocks."""
    size = max(1, CELLS // max(layers))
    kept = rows.rdd.mapPartitions(lambda part: blocks(part, size)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        total = kept.map(lambda b: float(b[2].sum())).sum()

        def mean(weights: np.ndarray) -> tuple[float, np.ndarray]:
            got = kept.map(lambda b: loss(b, weights, layers)).treeReduce(add) / total
            return float(got[0]), got[1:]

        return descend(mean, start, most, tol)
    finally:
        kept.unpersist()


def descend(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, most: int, tol: float) -> np.ndarray:
    """L-BFGS on ``f`` (value and gradient), as Nocedal and Wright give it."""
    value, grad = f(x)
    first, values, pairs, done, failed = value, [np.inf], [], 0, False
    while done < most and np.linalg.norm(grad) > max(tol * value, 1e-8):
        way = _direction(grad, pairs)
        found = _search(f, x, way, value, grad, 1.0 if done else 1 / np.linalg.norm(way)) if way is not None else None
        if found is None:
            if failed:
                break
            failed, pairs = True, []  # once more, straight down
            continue
        step, value, grad, before = *found, grad
        pairs, failed, done = [(step, grad - before), *pairs][:MEMORY], False, done + 1
        x = x + step
        values = [*values, value][-VALUES:]
        if abs(value - max(values)) <= tol * first:
            break
    return x


def _direction(grad: np.ndarray, pairs: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray | None:
    """Downhill by the inverse Hessian of the last steps (newest first); None where they bend the wrong way."""
    way, scales = grad.copy(), []
    for s, y in pairs:
        if not s @ y > 0:
            return None
        scales.append(s @ way / (s @ y))
        way -= scales[-1] * y
    if pairs:
        way *= pairs[0][0] @ pairs[0][1] / (pairs[0][1] @ pairs[0][1])
    for (s, y), a in zip(reversed(pairs), reversed(scales)):
        way += (a - y @ way / (s @ y)) * s
    return -way


def _search(f, x, way, value, grad, t):
    """(step, value, gradient) by the strong Wolfe conditions, None where there is no such step."""
    slope = grad @ way
    if not slope <= 0:
        return None

    def at(t):
        v, g = f(x + t * way)
        return t, v, g @ way, g

    def found(c):
        return (c[0] * way, c[1], c[3]) if c[0] * np.linalg.norm(grad) >= 1e-10 else None

    steep = lambda c: c[1] > value + 1e-4 * c[0] * slope
    flat = lambda c: abs(c[2]) <= .9 * abs(slope)
    low, high = (0.0, value, slope, grad), None
    for i in range(TRIES):
        c = at(t)
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if steep(c) or (c[1] >= low[1] and i > 0):
            high = c
            break
        if flat(c):
            return found(c)
        if c[2] >= 0:
            low, high = c, low
            break
        low, t = c, t * 1.5
    if high is None:
        return None
    for _ in range(TRIES):
        c = at(_between(*sorted((low, high), key=lambda e: e[0])))
        if steep(c) or c[1] >= low[1]:
            high = c
            continue
        if flat(c):
            return found(c)
        if c[2] * (high[0] - low[0]) >= 0:
            high = low
        low = c
    return None


def _between(a, b) -> float:
    """Where the cubic through both ends is least, kept off the ends."""
    d1 = a[2] + b[2] - 3 * (a[1] - b[1]) / (a[0] - b[0])
    d2 = np.sqrt(max(d1 * d1 - a[2] * b[2], 0.0))
    rise = b[2] - a[2] + 2 * d2
    t = b[0] - (b[0] - a[0]) * (b[2] + d2 - d1) / rise if rise else (a[0] + b[0]) / 2
    return min(max(t, a[0] + .1 * (b[0] - a[0])), a[0] + .9 * (b[0] - a[0]))
