"""Row-wise calibration of Gaussian neighbourhoods by bisection on beta.

``p_k`` is proportional to ``exp(-beta d_k)``; beta is found so that the entropy
matches a perplexity, or so that the kernel weights reach a sum. Two forms with
the same steps: a Column expression that stays in the JVM, and a numpy kernel
that advances all rows of an Arrow batch together.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS, TOLERANCE = 200, 1e-5


def _kernel(d: Column, beta: Column) -> Column:
    return F.transform(d, lambda x: F.exp(-beta * x))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def shifted(d: Column) -> Column:
    return F.transform(F.array(F.array_min(d)), lambda m: F.transform(d, lambda x: x - m))[0]


def beta(d: Column, target: float, *, by_weight: bool = False, steps: int = STEPS, tolerance: float = TOLERANCE) -> Column:
    """struct(beta, found) of the distances ``d``.

    Entropy does not change if all distances are shifted, so it is taken from
    the smallest on, where the kernel cannot vanish.
    """
    if not by_weight:
        d = shifted(d)

    def excess(b: Column) -> Column:
        z = _sum(_kernel(d, b))
        if by_weight:
            return z - target
        s = _sum(F.transform(d, lambda x: b * x * F.exp(-b * x)))
        return F.transform(F.array(z), lambda v: s / v + F.log(v) - math.log(target))[0]

    def state(b: Column, lo: Column, hi: Column, found: Column) -> Column:
        return F.struct(b.alias("b"), lo.alias("lo"), hi.alias("hi"), found.alias("found"))

    null = F.lit(None).cast("double")

    def step(s: Column, _: Column) -> Column:
        def move(e: Column) -> Column:
            up = F.when(s["hi"].isNull(), s["b"] * 2).otherwise((s["b"] + s["hi"]) / 2)
            down = F.when(s["lo"].isNull(), s["b"] / 2).otherwise((s["b"] + s["lo"]) / 2)
            return F.when(F.abs(e) < tolerance, state(s["b"], s["lo"], s["hi"], F.lit(True))).when(e > 0, state(up, s["b"], s["hi"], F.lit(False))).otherwise(state(down, s["lo"], s["b"], F.lit(False)))

        return F.when(s["found"], s).otherwise(F.transform(F.array(excess(s["b"])), move)[0])

    start = state(F.lit(1.0), null, null, F.lit(False))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: F.struct(s["b"].alias("beta"), s["found"].alias("found")))


def probabilities(d: Column, fit: Column) -> Column:
    """Normalised kernel at the fitted beta; uniform where none was found."""
    uniform = F.transform(d, lambda x: 1.0 / F.size(d))
    normal = F.transform(F.array(_kernel(shifted(d), fit["beta"])), lambda v: F.transform(v, lambda x: x / _sum(v)))[0]
    return F.when(fit["found"], normal).otherwise(uniform)


def sigma(fit: Column) -> Column:
    return F.sqrt(1.0 / (2.0 * fit["beta"]))


def fitted(d: np.ndarray, target: float, *, valid: np.ndarray, by_weight: bool = False, steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """(beta, found) of rows x neighbours; cells that aren't valid do not count."""
    rows = len(d)
    b, lo, hi = np.ones(rows), np.full(rows, np.nan), np.full(rows, np.nan)
    open_ = np.arange(rows)
    found = np.zeros(rows, bool)
    for _ in range(steps):
        if not len(open_):
            break
        x, beta_ = d[open_], b[open_]
        v = np.where(valid[open_], np.exp(-beta_[:, None] * x), 0.0)
        z = np.maximum(v.sum(axis=1), np.finfo(float).tiny)
        e = z - target if by_weight else (beta_[:, None] * x * v).sum(axis=1) / z + np.log(z) - math.log(target)
        done = np.abs(e) < tolerance
        found[open_[done]] = True
        up, down = open_[~done & (e > 0)], open_[~done & (e <= 0)]
        lo[up] = b[up]
        b[up] = np.where(np.isnan(hi[up]), b[up] * 2, (b[up] + hi[up]) / 2)
        hi[down] = b[down]
        b[down] = np.where(np.isnan(lo[down]), b[down] / 2, (b[down] + lo[down]) / 2)
        open_ = open_[~done]
    return b, found


def kernel(d: np.ndarray, target: float, *, valid: np.ndarray | None = None, by_weight: bool = False, steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """(p, sigma) of rows x neighbours; cells that aren't valid get 0."""
    valid = np.ones_like(d, bool) if valid is None else valid
    away = d - np.where(valid, d, np.inf).min(axis=1, keepdims=True)
    b, found = fitted(d if by_weight else away, target, valid=valid, by_weight=by_weight, steps=steps, tolerance=tolerance)
    v = np.where(valid, np.exp(-b[:, None] * np.where(valid, away, 0)), 0.0)
    even = valid / np.maximum(1, valid.sum(axis=1, keepdims=True))
    p = np.where(found[:, None], v / np.maximum(v.sum(axis=1, keepdims=True), np.finfo(float).tiny), even)
    return p, np.where(found, np.sqrt(1 / (2 * b)), 1.0)
