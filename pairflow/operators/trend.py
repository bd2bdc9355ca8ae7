"""Mann-Kendall trend tests with Sen slopes, and the rank-sum test."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairflow.functions.columns import DAYS_A_YEAR
from pairflow.functions.tails import normal_p

from .ranks import value_ranks
from .regression import regression
from .series import by_series


#: Series up to this length have their few slopes sorted; longer ones never list them.
FEW = 256


def falls(y: np.ndarray, ties: bool) -> int:
    """How many pairs of places i < j have y[j] < y[i] (``ties``: or equal).

    Inversions by merging from the top bit of ranks down: at each bit the rows of a group split into zeros and ones, a zero counts the ones
    before it, and both halves go on in their order. Linear in the rows for each bit.
    """
    n = len(y)
    order = np.argsort(y, kind="stable")
    rank = np.empty(n, np.int64)
    if ties:  # of equal values the later has the smaller rank
        order = n - 1 - np.argsort(y[::-1], kind="stable")
    rank[order] = np.arange(n)
    total = 0
    for bit in range(max(n - 1, 0).bit_length() - 1, -1, -1):
        one = rank >> bit & 1
        group = rank >> (bit + 1) << (bit + 1)  # ranks fill 0 to n - 1, so a group begins at its smallest rank
        ones = np.cumsum(one) - one
        ones -= ones[group]
        total += int(ones[one == 0].sum())
        zeros = np.arange(n) - group - ones
        place = np.where(one == 0, group + zeros, np.minimum(group + (1 << bit), n) + ones)
        moved = np.empty_like(rank)
        moved[place] = rank
        rank = moved
    return total


def _slope(x: np.ndarray, k: int) -> float:
    """The k-th smallest slope (from 1) of all pairs of places, by bisection of slopes and counting of those up to each."""
    i = np.arange(len(x), dtype=float)
    high = float(x.max() - x.min())
    low = -high
    for _ in range(64):
        middle = (low + high) / 2
        if not low < middle < high:
            break
        if falls(x - middle * i, True) >= k:
            high = middle
        else:
            low = middle
    # a pair whose slope it is now stands next to each other in the order of what the line leaves
    order = np.argsort(x - high * i, kind="stable")
    near = np.diff(x[order]) / np.diff(i[order])
    return float(near[np.argmin(np.abs(near - high))])


def median_slope(x: np.ndarray) -> float:
    """The median of the slopes of all pairs of places; the mean of the middle two of an even number."""
    n = len(x)
    pairs = n * (n - 1) // 2
    if n <= FEW:
        i, j = np.triu_indices(n, 1)
        return float(np.median((x[j] - x[i]) / (j - i)))
    low = _slope(x, (pairs + 1) // 2)
    return low if pairs % 2 else (low + _slope(x, pairs // 2 + 1)) / 2


def _kendall(x: np.ndarray):
    """n, S, the sum of t(t-1)(2t+5) over ties, Sen's slope and the median of one series."""
    n = len(x)
    if n < 2:
        return [n], [None], [0.0], [None], [float(x[0])]
    pairs = n * (n - 1) // 2
    t = np.unique(x, return_counts=True)[1].astype(float)
    return [n], [float(pairs - falls(x, True) - falls(x, False))], [float((t * (t - 1) * (2 * t + 5)).sum())], [median_slope(x)], [float(np.median(x))]


def mann_kendall(series: DataFrame, key: str, date: str = "date", value: str = "x", least: int = 4, p: bool = True) -> DataFrame:
    """``n, s, var_s, z, tau, slope, intercept`` (``p, trend, significant``) per key, over non-null rows by date.

    No pairs are listed: S counts inversions by merging, Sen's slope is selected by bisecting slopes and counting the pairs up to each, so
    a series of any length takes memory in proportion to it. Keys under ``least`` points get the trend ``insufficient data`` and no figures.
    """
    rows = series.where(F.col(value).isNotNull()).select(key, date, F.col(value).cast("double").alias("x"))
    out = by_series(rows, (key,), (date,), ("x",), _kendall, "n long, s double, t double, slope double, mx double")
    m = F.col("n")
    out = out.withColumn("var_s", (m * (m - 1) * (2 * m + 5) - F.col("t")) / 18.0)
    out = out.withColumns(
        {
            "z": F.when(F.col("s") == 0, 0.0).otherwise(F.try_divide(F.col("s") - F.signum("s"), F.sqrt("var_s"))),
            "tau": F.try_divide(2.0 * F.col("s"), m * (m - 1)),
            "intercept": F.col("mx") - (m - 1) / 2.0 * F.col("slope"),
        }
    )
    figures = ["s", "var_s", "z", "tau", "slope", "intercept"]
    out = out.select(key, "n", *[F.when(m >= least, F.col(c)).alias(c) for c in figures])
    if p:
        out = out.withColumn("p", normal_p("z"))
        told = F.when(m < least, "insufficient data").when(F.col("p") >= 0.05, "no trend").when(F.col("z") > 0, "increasing").otherwise("decreasing")
        out = out.withColumns({"trend": told, "significant": F.coalesce(F.col("p") < 0.05, F.lit(False))})
    return out


def level_trends(levels: DataFrame, entity: str = "entity", date: str = "date", value: str = "wte", least: int = 10, p: bool = True) -> DataFrame:
    """Trend of each entity with ``least`` values, Sen slope also per year by the median gap between dates."""
    rows = levels.where(F.col(value).isNotNull())
    gap = F.datediff(date, F.lag(date).over(W.partitionBy(entity).orderBy(date)))
    facts = rows.withColumn("g", gap).groupBy(entity).agg(
        F.median("g").alias("gap"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count("*").alias("_n")
    ).where(F.col("_n") >= least)
    good = rows.join(facts.select(entity), entity, "left_semi")
    out = mann_kendall(good, entity, date, value, p=p).join(facts.drop("_n"), entity)
    years = F.bround(F.datediff("last_date", "first_date") / DAYS_A_YEAR, 2)
    return out.withColumns({"sen_slope_yr": F.when(F.col("gap") > 0, F.col("slope") * DAYS_A_YEAR / F.col("gap")), "year_span": years}).drop("gap")


def group_trends(monthly: DataFrame, group: str = "grp", date: str = "date", value: str = "q", least: int = 10, entity: str | None = None, p: bool = True) -> DataFrame:
    """Trend of each group's monthly series (of entities' mean, if ``entity`` is given), slope times 12."""
    rows = monthly.where(F.col(value).isNotNull())
    facts = rows.groupBy(group).agg(F.count_distinct(date).alias("_n"), *([F.count_distinct(entity).alias("n_entities")] if entity else [])).where(F.col("_n") >= least)
    series = rows.groupBy(group, date).agg(F.avg(value).alias("x")).join(facts.select(group), group, "left_semi")
    return mann_kendall(series, group, date, "x", p=p).withColumn("sen_slope_yr", 12 * F.col("slope")).join(facts.drop("_n"), group)


def annual_trends(flow: DataFrame, group: str = "grp", date: str = "date", value: str = "q", p: bool = True) -> DataFrame:
    """Sen slope of annual means, also in percent of the mean flow; needs 12 months and 5 years."""
    rows = flow.where(F.col(value).isNotNull())
    year = rows.groupBy(group, F.year(date).alias("year")).agg(F.avg(value).alias("x"), F.count_distinct(F.month(date)).alias("months"))
    facts = year.groupBy(group).agg(F.count("*").alias("years"), F.sum("months").alias("months"), F.avg("x").alias("mean_flow")).where("years >= 5 and months >= 12")
    out = mann_kendall(year.join(facts.select(group), group, "left_semi"), group, "year", "x", p=p).join(facts, group)
    return out.withColumn("pct_of_mean", F.when(F.col("mean_flow") > 0, 100 * F.col("slope") / F.col("mean_flow")))


def trend_overview(trends: DataFrame, of: DataFrame, entity: str = "entity", group: str = "grp", years: float = 3) -> DataFrame:
    """Per group: entities, quartiles of the yearly slope, share declining (and significant, where the table says)."""
    rows = trends.where(F.col("year_span") >= years).join(of.select(entity, group).distinct(), entity)
    q = F.percentile("sen_slope_yr", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    aggs = [F.count("*").alias("n"), q.alias("q"), (100 * F.avg(F.coalesce((F.col("sen_slope_yr") < 0).cast("double"), F.lit(0.0)))).alias("declining_pct")]
    if "significant" in trends.columns:
        aggs.append((100 * F.avg(F.col("significant").cast("double"))).alias("significant_pct"))
    out = rows.groupBy(group).agg(*aggs)
    return out.withColumns({n: F.col("q")[i] for i, n in enumerate(("q25", "median", "q75"))}).drop("q")


def linear_trends(levels: DataFrame, entity: str = "entity", date: str = "date", value: str = "wte", least: int = 24) -> DataFrame:
    """Straight line over days since the first: slope a year of 365 days, r2."""
    day = F.datediff(date, F.min(date).over(W.partitionBy(entity)))
    out = regression(levels.withColumn("_day", day), (entity,), "_day", value, least)
    return out.select(entity, "n", (F.col("slope") * 365).alias("slope_yr"), "r2")


def rank_sum(df: DataFrame, first, value: str, p: bool = True) -> DataFrame:
    """Mann-Whitney U of rows where ``first`` holds against the others; normal p with tie and continuity correction."""
    rows = df.where(F.col(value).isNotNull() & first.isNotNull()).withColumn("_f", first)
    ranked = value_ranks(rows, value, a=F.count_if("_f")).withColumn("r", F.col("before") + (F.col("c") + 1) / 2)
    one = ranked.agg(F.sum("a").alias("n1"), (F.sum("c") - F.sum("a")).alias("n2"), F.sum(F.col("r") * F.col("a")).alias("r1"), F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("t"))
    n1, n2 = F.col("n1"), F.col("n2")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12.0 * ((n1 + n2 + 1) - F.try_divide(F.col("t"), (n1 + n2) * (n1 + n2 - 1)))
    centre = u - n1 * n2 / 2
    z = F.try_divide(F.signum(centre) * F.greatest(F.abs(centre) - 0.5, F.lit(0.0)), F.sqrt(var))
    out = one.select("n1", "n2", u.alias("u"), z.alias("z"))
    return out.withColumn("p", normal_p("z")) if p else out


