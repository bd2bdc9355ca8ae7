"""Outlier flags, quality gates and data-quality reports of observation series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairflow.functions.columns import DAYS_A_YEAR, unplaced

from .ranks import exact_quantiles


def iqr_outliers(levels: DataFrame, entity: str = "entity", value: str = "wte", least: int = 5, k: float = 3.0) -> DataFrame:
    """Adds ``is_outlier``: outside the entity's quartiles by more than k interquartile ranges, if it has ``least`` rows and a positive range."""
    bounds = levels.groupBy(entity).agg(F.count(F.lit(1)).alias("_n"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    bounds = bounds.select(unplaced(F.col(entity)).alias("_e"), "_n", F.col("_q")[0].alias("_lo"), F.col("_q")[1].alias("_hi"))
    out = levels.join(bounds, F.col(entity) == F.col("_e"), "left")
    span = F.col("_hi") - F.col("_lo")
    odd = (F.col("_n") >= least) & (span > 0) & ((F.col(value) < F.col("_lo") - k * span) | (F.col(value) > F.col("_hi") + k * span))
    return out.withColumn("is_outlier", F.coalesce(odd, F.lit(False))).drop("_e", "_n", "_lo", "_hi")


def without_outliers(levels: DataFrame, **how) -> DataFrame:
    return iqr_outliers(levels, **how).where("not is_outlier").drop("is_outlier")


def global_outliers(df: DataFrame, column: str, z: float = 3.0, k: float = 1.5) -> DataFrame:
    """Adds ``z_outlier, iqr_outlier, any_outlier, both_outlier`` by population z-score and quartiles over all rows."""
    one = df.agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    q = exact_quantiles(df, column, [0.25, 0.75]).select(F.col("q").alias("_q"))
    out = df.join(F.broadcast(one)).join(F.broadcast(q))  # single rows
    span = F.col("_q")[1] - F.col("_q")[0]
    far = F.coalesce(F.try_divide(F.abs(F.col(column) - F.col("_m")), F.col("_s")) > z, F.lit(False))
    wide = F.coalesce((F.col(column) < F.col("_q")[0] - k * span) | (F.col(column) > F.col("_q")[1] + k * span), F.lit(False))
    return out.withColumns({"z_outlier": far, "iqr_outlier": wide, "any_outlier": far | wide, "both_outlier": far & wide}).drop("_m", "_s", "_q")


def enough_data(levels: DataFrame, entity: str = "entity", date: str = "date", least: int = 2, days: float = 365) -> DataFrame:
    """Rows of entities with at least ``least`` dated rows over at least ``days`` days."""
    good = levels.groupBy(entity).agg(F.count(date).alias("n"), F.datediff(F.max(date), F.min(date)).alias("d")).where((F.col("n") >= least) & (F.col("d") >= days))
    return levels.join(good.select(entity), entity, "left_semi")


def enough_years(levels: DataFrame, entity: str = "entity", date: str = "date", least: int = 20, years: float = 3) -> DataFrame:
    """The gate after outliers: rows, and years of 365.25 days."""
    good = levels.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), (F.datediff(F.max(date), F.min(date)) / DAYS_A_YEAR).alias("y")).where((F.col("n") >= least) & (F.col("y") >= years))
    return levels.join(good.select(entity), entity, "left_semi")


def series_quality(levels: DataFrame, entity: str = "entity", date: str = "date") -> DataFrame:
    """``n_obs, record_years, median_gap_days`` of each entity; null dates don't count but the entity stays."""
    gap = F.datediff(date, F.lag(date).over(W.partitionBy(entity).orderBy(F.col(date).asc_nulls_last())))
    rows = levels.withColumn("_gap", gap)
    return rows.groupBy(entity).agg(
        F.count(date).alias("n_obs"), F.coalesce(F.datediff(F.max(date), F.min(date)) / DAYS_A_YEAR, F.lit(0.0)).alias("record_years"), F.median("_gap").alias("median_gap_days")
    )


def quality_overview(metrics: DataFrame) -> DataFrame:
    """``(statistic, value)`` over the table of :func:`series_quality`."""
    share = lambda c: F.bround(F.avg(F.coalesce(c.cast("double"), F.lit(0.0))) * 100, 2)
    gap = F.col("median_gap_days")
    one = metrics.agg(
        F.count("*").cast("double").alias("entities"), F.median("n_obs").alias("median_n"), F.percentile("n_obs", 0.75).alias("p75_n"), F.max("n_obs").cast("double").alias("max_n"),
        F.median("record_years").alias("median_years"), share(F.col("n_obs") <= 2).alias("pct_n_le_2"), share(gap <= 30).alias("pct_gap_le_30"), share(gap <= 90).alias("pct_gap_le_90"),
    )
    return one.unpivot([], one.columns, "statistic", "value")


def quality_report(levels: DataFrame, entity: str = "entity", date: str = "date") -> DataFrame:
    """One row: entities, those with one and two points, mean and median count, mean span, mean of mean counts a year."""
    years = levels.groupBy(entity, F.year(date).alias("year")).agg(F.count("*").alias("n"), F.min(date).alias("a"), F.max(date).alias("b"))
    each = years.groupBy(entity).agg(F.sum("n").alias("n"), F.datediff(F.max("b"), F.min("a")).alias("span"), F.avg("n").alias("per_year"))
    return each.agg(
        F.count("*").alias("entities"), F.count_if(F.col("n") == 1).alias("single_point"), F.count_if(F.col("n") == 2).alias("two_point"), F.avg("n").alias("mean_n"),
        F.median("n").alias("median_n"), F.avg("span").alias("mean_span_days"), F.avg("per_year").alias("mean_per_year"),
    )


def months_of_year(levels: DataFrame, date: str = "date") -> DataFrame:
    return levels.groupBy(F.month(date).alias("month")).agg(F.count("*").alias("n"))
