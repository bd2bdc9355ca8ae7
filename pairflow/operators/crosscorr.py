"""Cross-correlation over row lags, per pair, by Fourier transforms of its two series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import by_series


#: Rows of a series that are transformed at once.
CHUNK = 1 << 15


def lag_sums(x: np.ndarray, y: np.ndarray, first: int, last: int, chunk: int = CHUNK) -> np.ndarray:
    """The sum of x at i times y at i - lag for each lag from ``first`` to ``last``, by Fourier transforms of ``chunk`` rows of x and the
    rows of y that they meet."""
    out = np.zeros(last - first + 1)
    for a in range(0, len(x), chunk):
        own = x[a : a + chunk]
        met = np.zeros(len(own) + last - first)
        low, high = max(0, a - last), min(len(y), a + len(own) - first)
        if low >= high:
            continue
        met[low - (a - last) : high - (a - last)] = y[low:high]
        size = 1 << (len(met) - 1).bit_length()
        out += np.fft.irfft(np.conj(np.fft.rfft(own, size)) * np.fft.rfft(met, size), size)[: last - first + 1][::-1]
    return out


def _both(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull())


def cross_correlation(df: DataFrame, keys=("grp", "entity"), date: str = "date", x: str = "delta_wte", y: str = "delta_q", limit: int = 3650, least: int = 36) -> DataFrame:
    """``(keys, n, lag, c)`` for lags -limit..limit: c is the mean over n of x at i times y at i - lag (population z-values), so at positive lags y leads.

    Lags count rows; a lag without a common row has none. Pairs under ``least`` rows are left out. A pair's two arrays are convolved by
    Fourier transforms in chunks, so its cost hardly grows with ``limit``.
    """

    def curve(x: np.ndarray, y: np.ndarray):
        n = len(x)
        if n < least:
            return None
        most = min(limit, n - 1)
        zx, zy = ((v - v.mean()) / (v.std() + 1e-10) for v in (x, y))
        return np.full(2 * most + 1, n), np.arange(-most, most + 1), lag_sums(zx, zy, -most, most) / n

    return by_series(_both(df, x, y), keys, (date,), (x, y), curve, "n long, lag int, c double")


def lagged_correlation(df: DataFrame, keys=("grp", "entity"), date: str = "date", x: str = "delta_wte", y: str = "delta_q", limit: int = 60, least: int = 36, overlap: int = 5) -> DataFrame:
    """``(keys, lag, n, r)`` for lags 0..limit: Pearson of x at i and y at i + lag, so at positive lags x leads; ``n`` is the overlap.

    Lags under ``overlap`` common rows, and those over which a column is constant, are left out. Products come from Fourier transforms, sums and squares
    from running sums.
    """

    def curve(x: np.ndarray, y: np.ndarray):
        n = len(x)
        if n < least:
            return None
        most = min(limit, n - overlap)
        if most < 0:
            return None
        lags = np.arange(most + 1)
        m = n - lags
        x, y = ((v - v.mean()) / (v.std() or 1.0) for v in (x, y))
        # of x the first m rows, of y the last m
        sx, sxx = np.cumsum(x)[m - 1], np.cumsum(x * x)[m - 1]
        sy, syy = np.cumsum(y[::-1])[m - 1], np.cumsum(y[::-1] ** 2)[m - 1]
        sxy = lag_sums(x, y, -most, 0)[::-1]
        same_x = np.flatnonzero(x != x[0])[0] if (x != x[0]).any() else n
        same_y = np.flatnonzero(y[::-1] != y[-1])[0] if (y != y[-1]).any() else n
        varies = (m > same_x) & (m > same_y)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = (sxy - sx * sy / m) / np.sqrt((sxx - sx * sx / m) * (syy - sy * sy / m))
        return lags[varies], m[varies], r[varies]

    return by_series(_both(df, x, y), keys, (date,), (x, y), curve, "lag int, n long, r double")


def peaks(curves: DataFrame, keys=("grp", "entity"), value: str = "c", n: str = "n") -> DataFrame:
    """The strongest lag of each pair (the smallest of equal ones), its value, and the bound 1.96 / sqrt(n) at lag 0."""
    best = F.min(F.struct((-F.abs(value)).alias("m"), "lag", F.col(value).alias("v")))
    out = curves.groupBy(*keys).agg(best.alias("b"), F.max(n).alias("n_obs"), F.max(F.when(F.col("lag") == 0, F.col(value))).alias("at_0"))
    ci = 1.96 / F.sqrt("n_obs")
    return out.select(*keys, "n_obs", F.col("b.lag").alias("best_lag"), F.col("b.v").alias("best"), "at_0", (F.abs("at_0") > ci).alias("significant_at_0"))


def peak_overview(best: DataFrame, group: str = "grp") -> DataFrame:
    """Lags and strengths per group and over all (null group), in one pass."""
    aggs = [F.count("*").alias("n"), F.median("best_lag").alias("median_lag"), F.avg("best_lag").alias("mean_lag"), F.stddev_pop("best_lag").alias("std_lag"),
            F.median("best").alias("median_best"), F.avg("best").alias("mean_best")]
    return best.groupingSets([[F.col(group)], []], F.col(group)).agg(*aggs)


def mean_curve(curves: DataFrame, group: str = "grp", value: str = "c", step: int = 1) -> DataFrame:
    """Mean and population deviation of the curves at every ``step``-th lag, per group."""
    return curves.where(F.col("lag") % step == 0).groupBy(group, "lag").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def held_mean_curve(
    curves: DataFrame, grid: Sequence[float], keys: Sequence[str] = ("grp", "entity"), group: str = "grp", value: str = "c"
) -> DataFrame:
    """Mean, population deviation and standard error of the curves at the lags of ``grid``, per group and over all (null group).

    Each curve is interpolated linearly between its own lags; beyond its first and last lag it keeps the value there. Null
    values are no part of a curve, so curves without any value stay out.
    """
    own = curves.where(F.col(value).isNotNull()).groupBy(*keys)
    points = own.agg(F.sort_array(F.collect_list(F.struct(F.col("lag").cast("double").alias("lag"), F.col(value).alias("v")))).alias("p"))

    def between(g):
        below = F.try_element_at(F.filter("p", lambda e: e["lag"] <= g), F.lit(-1))
        above = F.try_element_at(F.filter("p", lambda e: e["lag"] >= g), F.lit(1))
        share = F.coalesce(F.try_divide(g - below["lag"], above["lag"] - below["lag"]), F.lit(0.0))
        return F.coalesce(below["v"] + (above["v"] - below["v"]) * share, below["v"], above["v"])

    # each curve becomes the array of its values at the grid within its own row; only those are dealt out
    values = F.transform(F.array(*[F.lit(float(g)) for g in grid]), lambda g: F.struct(g.alias("lag"), between(g).alias("v")))
    at, g = points.select(group, F.inline(values)), F.col("lag")
    out = at.groupingSets([[F.col(group), g], [g]], F.col(group), g)
    return out.agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), (F.stddev_pop("v") / F.sqrt(F.count("*"))).alias("error"))
