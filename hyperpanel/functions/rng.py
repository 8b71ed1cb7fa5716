"""Portable randomness: a counter-based generator in whole-number arithmetic.

Equal in every SQL engine, so sampling operators are reproducible and can be
checked elsewhere; a number depends on (seed, key, step) only, not on order.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 2_147_483_647
A, B, C = 48_271, 69_621, 16_807


def number(seed: int, key: Column, step: Column | int = 0) -> Column:
    """Whole number in [0, MODULUS)."""
    step = F.lit(step) if isinstance(step, int) else step
    h = F.pmod(key.cast("long") * A + (seed * C) % MODULUS + step.cast("long") * B + 1, F.lit(MODULUS).cast("long"))
    h = F.pmod(h * A + 11, F.lit(MODULUS).cast("long"))
    h = F.pmod((h + F.call_function("div", h, F.lit(127_773))) * B, F.lit(MODULUS).cast("long"))
    return F.pmod(h * C, F.lit(MODULUS).cast("long"))


def uniform(seed: int, key: Column, step: Column | int = 0) -> Column:
    """Double in [0, 1)."""
    return number(seed, key, step) / F.lit(float(MODULUS))


def uniform_of(seed: int, keys: np.ndarray, step: int = 0) -> np.ndarray:
    """The same of whole numbers in numpy."""
    h = (keys.astype(np.int64) * A + ((seed * C) % MODULUS + step * B + 1)) % MODULUS
    h = (h * A + 11) % MODULUS
    h = (h + h // 127_773) * B % MODULUS
    return h * C % MODULUS / float(MODULUS)


def number_sql(seed: int, key: str, step: str = "0") -> str:
    """The same in SQL."""
    h = f"(CAST({key} AS BIGINT) * {A} + {(seed * C) % MODULUS} + CAST({step} AS BIGINT) * {B} + 1) % {MODULUS}"
    h = f"((({h}) * {A} + 11) % {MODULUS})"
    return f"(((({h} + {h} // 127773) * {B}) % {MODULUS}) * {C} % {MODULUS})"


def uniform_sql(seed: int, key: str, step: str = "0") -> str:
    return f"({number_sql(seed, key, step)} / {float(MODULUS)})"


def normal_pair(seed: int, key: Column) -> tuple[Column, Column]:
    """Two normal numbers by Box-Muller."""
    u, v = F.greatest(uniform(seed, key, 1), F.lit(1e-12)), uniform(seed, key, 2)
    r = F.sqrt(-2.0 * F.log(u))
    return r * F.cos(2 * math.pi * v), r * F.sin(2 * math.pi * v)
