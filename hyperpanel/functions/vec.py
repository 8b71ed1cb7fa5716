"""Scalar and vector functions as Column expressions; arrays hold doubles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 0.0


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(ZERO), lambda s, x: s + x)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


METRICS = {"l1": manhattan, "l2": distance, "l2sq": squared_distance}


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(a: Column, by: Column | float) -> Column:
    return F.transform(a, lambda x: x * by)


def _normalised(a: Column, norm: Column) -> Column:
    return let(norm, lambda n: F.when(n == 0, F.transform(a, lambda x: 1.0 / F.size(a))).otherwise(F.transform(a, lambda x: x / n)))


def l2_normalise(a: Column) -> Column:
    """Unit length; a zero vector becomes 1/n everywhere."""
    return _normalised(a, F.sqrt(dot(a, a)))


def l1_normalise(a: Column) -> Column:
    """Signed sum 1; a sum of zero gives 1/n everywhere."""
    return _normalised(a, total(a))


def softmax(a: Column) -> Column:
    return let(F.transform(a, F.exp), lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def gaussian_function(d: Column, sigma: float, alpha: float = 1.0) -> Column:
    """alpha * exp(-d^2 / (2 sigma^2)) of every distance."""
    return F.transform(d, lambda x: alpha * F.exp(-(x * x) / (2.0 * sigma * sigma)))


def gaussian(d: Column, sigma: float) -> Column:
    """The same, summing to one."""
    return let(gaussian_function(d, sigma), lambda g: let(total(g), lambda s: F.transform(g, lambda x: x / s)))


def perplexity(p: Column) -> Column:
    """2 to the entropy in bits; zeros are skipped."""
    return F.pow(F.lit(2.0), -total(F.transform(p, lambda x: F.when(x > 0, x * F.log(x) / math.log(2)).otherwise(ZERO))))


def student_t(d2: Column) -> Column:
    return 1.0 / (1.0 + d2)


def colour_name(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb."""
    return F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex(c), 2, "0")) for c in (r, g, b)))


def csv_record(*columns: Column) -> Column:
    return F.concat_ws(",", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))


def staleness(now: Column, seen: Column, span: float = 500.0) -> Column:
    """Confidence of a value seen at an earlier iteration: 1 falls to 0 over ``span``."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - (now - seen) / span))


def sign(x: Column) -> Column:
    return F.signum(x)
