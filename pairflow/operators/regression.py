"""Grouped regression and correlation from sums alone, so hot groups are summed map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairflow.functions.columns import month_name, season
from pairflow.functions.tails import correlation_p


def regression(df: DataFrame, keys: tuple[str, ...] = (), x: str = "delta_wte", y: str = "delta_q", least: int = 2, entity: str | None = None, p: bool = False) -> DataFrame:
    """Ordinary least squares of y on x per key: ``n, slope, intercept, r, r2, std_err`` (``n_entities``, ``p``).

    Rows with a null in either column don't count; groups under ``least`` rows or with a constant
    column drop out (decided by minimum and maximum, not by a rounded variance).
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    aggs = [F.regr_count(y, x).alias("n"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"),
            F.avg(x).alias("mx"), F.avg(y).alias("my"), (F.min(x) < F.max(x)).alias("vx"), (F.min(y) < F.max(y)).alias("vy")]
    if entity:
        aggs.append(F.count_distinct(entity).alias("n_entities"))
    return _told(rows.groupBy(*keys).agg(*aggs), keys, least, entity is not None, p)


def _told(sums: DataFrame, keys, least: int, entities: bool, p: bool) -> DataFrame:
    out = sums.where((F.col("n") >= least) & F.col("vx") & F.col("vy"))
    slope = F.try_divide("sxy", "sxx")
    out = out.withColumns({"slope": slope, "r": F.try_divide("sxy", F.sqrt("sxx") * F.sqrt("syy"))})
    out = out.withColumns({"intercept": F.col("my") - F.col("slope") * F.col("mx"), "r2": F.col("r") * F.col("r")})
    error = F.sqrt(F.greatest(F.lit(0.0), F.try_divide((1 - F.col("r2")) * F.col("syy"), F.col("sxx") * (F.col("n") - 2))))
    out = out.withColumn("std_err", F.when(F.col("n") > 2, error).otherwise(F.lit(0.0)))
    names = [*keys, "n", "slope", "intercept", "r", "r2", "std_err", *(["n_entities"] if entities else [])]
    if p:
        out = out.withColumn("p", F.when(F.col("n") == 2, F.lit(0.0)).otherwise(correlation_p("r", "n")))
        names.append("p")
    return out.select(*names)


def average_rank(c: str, keys: tuple[str, ...]) -> Column:
    """Rank within the key; ties share their mean rank."""
    same = F.count("*").over(W.partitionBy(*keys, c))
    return F.rank().over(W.partitionBy(*keys).orderBy(c)) + (same - 1) / 2


def spearman(df: DataFrame, keys: tuple[str, ...], x: str = "delta_wte", y: str = "delta_q", least: int = 2) -> DataFrame:
    """``n, spearman`` per key: the correlation of average ranks."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = rows.withColumns({"_rx": average_rank(x, keys), "_ry": average_rank(y, keys)})
    return regression(ranked, keys, "_rx", "_ry", least).select(*keys, "n", F.col("r").alias("spearman"))


def regression_by_pair(df: DataFrame, keys=("entity", "grp"), x: str = "delta_wte", y: str = "delta_q", least: int = 10, p: bool = False) -> DataFrame:
    """Least squares, Pearson and Spearman of each pair."""
    ranks = spearman(df, keys, x, y, least).drop("n")
    out = regression(df, keys, x, y, least, p=p).join(ranks, list(keys))
    return out.withColumn("spearman_p", correlation_p("spearman", "n")) if p else out


def seasonal_and_monthly(df: DataFrame, group: str = "grp", date: str = "date", x: str = "delta_wte", y: str = "delta_q", least: int = 5) -> DataFrame:
    """Regressions by (group, season) and (group, month) in one pass: ``period_type, period``."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    m = F.month(date)
    periods = F.array(
        F.struct(F.lit("Seasonal").alias("period_type"), season(m).alias("period")), F.struct(F.lit("Monthly").alias("period_type"), month_name(m).alias("period"))
    )
    rows = rows.select(group, x, y, F.inline(periods))
    return regression(rows, (group, "period_type", "period"), x, y, least)


def combined_summary(overall: DataFrame, periods: DataFrame, group: str = "grp") -> DataFrame:
    """Overall, seasonal and monthly regressions as rows of one table, in reading order."""
    names = [group, "period_type", "period", "n", "slope", "r2"]
    whole = overall.withColumns({"period_type": F.lit("Overall"), "period": F.lit("All")}).select(*names)
    out = whole.unionByName(periods.select(*names))
    types, order = F.array(*map(F.lit, ("Overall", "Seasonal", "Monthly"))), "All Winter Spring Summer Fall Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
    return out.orderBy(group, F.array_position(types, F.col("period_type")), F.array_position(F.array(*map(F.lit, order)), F.col("period")))


def regression_overview(stats: DataFrame, prefix: str = "") -> DataFrame:
    """One row over a table of regressions (with ``p``, if it has one); counts are 0 and the rest null over an empty table."""
    share = lambda c: (F.avg(F.coalesce(c, F.lit(False)).cast("double")) * 100)
    aggs = [F.count("*").alias(f"{prefix}n"), F.avg("r2").alias(f"{prefix}mean_r2"), F.median("r2").alias(f"{prefix}median_r2"), F.stddev_samp("r2").alias(f"{prefix}std_r2"),
            F.avg("slope").alias(f"{prefix}mean_slope"), F.median("slope").alias(f"{prefix}median_slope"),
            F.count_if(F.col("slope") > 0).alias(f"{prefix}positive"), share(F.col("slope") > 0).alias(f"{prefix}positive_pct")]
    if "p" in stats.columns:
        aggs += [F.count_if(F.col("p") < 0.05).alias(f"{prefix}significant"), share(F.col("p") < 0.05).alias(f"{prefix}significant_pct")]
    return stats.agg(*aggs)
