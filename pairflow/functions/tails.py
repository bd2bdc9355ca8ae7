"""Tail probabilities that SQL lacks, as column expressions: the density from a value on by Gauss-Legendre quadrature."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nodes of the quadrature; relative errors stay below 1e-12.
NODES = 48
#: The interval ends where a density has fallen to exp(-41) of its height at the start, below the last bit of a double.
FALL = 41.0


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _integral(f: Callable[[Column], Column], length: Column) -> Column:
    """The integral of ``f`` from 0 to ``length``."""
    at, weights = np.polynomial.legendre.leggauss(NODES)
    nodes = F.array(*[F.struct(F.lit(float((1 + x) / 2)).alias("x"), F.lit(float(w / 2)).alias("w")) for x, w in zip(at, weights, strict=True)])
    return length * F.aggregate(nodes, F.lit(0.0), lambda total, n: total + n["w"] * f(n["x"] * length))


def _at_most_1(p: Column) -> Column:
    return F.when(p > 1, 1.0).when(p <= 1, p)


def normal_p(z: Column | str) -> Column:
    """Two-sided p of a standard normal value; null stays null."""
    a = F.abs(_column(z).cast("double"))
    length = 2 * FALL / (F.sqrt(a * a + 2 * FALL) + a)
    rest = _integral(lambda t: F.exp(-a * t - t * t / 2), length)
    return _at_most_1(math.sqrt(2 / math.pi) * F.exp(-a * a / 2) * rest)


def correlation_p(r: Column | str, n: Column | str) -> Column:
    """Two-sided p of a correlation of n pairs by Student's t with n - 2 degrees; null below 3 pairs, 0 for |r| = 1.

    With sin(angle) = r the density is a power n - 3 of the cosine, so p is that power's integral from the angle to a right angle, as a
    share of the integral from 0.
    """
    a, n = F.abs(_column(r).cast("double")), _column(n)
    k = (n - 3).cast("double")

    def rest(slope: Column, most: Column) -> Column:
        fall = F.try_divide(F.lit(2 * FALL), k)
        length = F.least(most, F.coalesce(fall / (F.sqrt(slope * slope + fall) + slope), most))
        return _integral(lambda t: F.pow(F.greatest(F.cos(t) - slope * F.sin(t), F.lit(0.0)), k), length)

    cosine = F.sqrt((1 - a) * (1 + a))
    p = F.pow(cosine, k) * rest(a / cosine, F.acos(a)) / rest(F.lit(0.0), F.lit(math.pi / 2))
    known = (n >= 3) & ~F.isnan(a)
    return F.when(known & (a >= 1), 0.0).when(known, _at_most_1(p))
