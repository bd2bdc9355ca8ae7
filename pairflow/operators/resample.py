"""Shape-preserving cubic resampling of irregular series, as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _end_slope(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    d = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    return F.when(F.signum(d) != F.signum(d0), 0.0).when((F.signum(d0) != F.signum(d1)) & (F.abs(d) > 3 * F.abs(d0)), 3 * d0).otherwise(d)


def pchip(levels: DataFrame, entity: str = "entity", date: str = "date", value: str = "wte", grid: str = "monthly") -> DataFrame:
    """Monotone cubic interpolation on the 15th of each month (or every day) between an entity's first and last day.

    Entities with fewer than two rows, a day twice, or a null are left out whole; so are those without a grid day in range. Knots are
    matched to grid days by generating, from each knot, the days up to the next: no range join.
    """
    whole = levels.groupBy(entity).agg(F.count("*").alias("_n"), F.count_distinct(date).alias("_d"), F.count(F.when(F.col(value).isNotNull() & F.col(date).isNotNull(), 1)).alias("_v"))
    whole = whole.where("_n >= 2 and _n = _d and _n = _v").select(entity)
    w = W.partitionBy(entity).orderBy(date)
    k = levels.select(entity, date, F.col(value).cast("double").alias("y")).join(whole, entity, "left_semi").withColumn("x", F.unix_date(date))
    k = k.withColumns({"x1": F.lead("x").over(w), "y1": F.lead("y").over(w), "next": F.lead(date).over(w)})
    k = k.withColumn("h", (F.col("x1") - F.col("x")).cast("double")).withColumn("s", (F.col("y1") - F.col("y")) / F.col("h"))
    k = k.withColumns({"hp": F.lag("h").over(w), "sp": F.lag("s").over(w), "hn": F.lead("h").over(w), "sn": F.lead("s").over(w), "hpp": F.lag("h", 2).over(w), "spp": F.lag("s", 2).over(w)})
    h, s, hp, sp = (F.col(c) for c in ("h", "s", "hp", "sp"))
    w1, w2 = 2 * h + hp, h + 2 * hp
    inner = F.when(sp * s <= 0, 0.0).otherwise((w1 + w2) / (w1 / sp + w2 / s))
    first = F.when(F.col("hn").isNull(), s).otherwise(_end_slope(h, F.col("hn"), s, F.col("sn")))
    last = F.when(F.col("hpp").isNull(), sp).otherwise(_end_slope(hp, F.col("hpp"), sp, F.col("spp")))
    k = k.withColumn("m", F.when(sp.isNull(), first).when(s.isNull(), last).otherwise(inner))
    k = k.withColumn("m1", F.lead("m").over(w))
    end = F.coalesce(F.date_sub("next", 1), F.col(date))
    if grid == "monthly":
        days = F.transform(F.sequence(F.trunc(date, "month"), F.trunc(end, "month"), F.expr("interval 1 month")), lambda d: F.date_add(d, 14))
    else:
        days = F.sequence(F.col(date), end, F.expr("interval 1 day"))
    days = F.filter(days, lambda d: (d >= F.col(date)) & (d <= end))
    out = k.withColumn("_g", F.explode(days))
    t = (F.unix_date("_g") - F.col("x")) / h
    y = (
        F.col("y") * (1 + 2 * t) * (1 - t) * (1 - t) + h * F.col("m") * t * (1 - t) * (1 - t)
        + F.col("y1") * t * t * (3 - 2 * t) + h * F.col("m1") * t * t * (t - 1)
    )
    return out.select(entity, F.col("_g").alias(date), F.coalesce(y, F.col("y")).alias(value))


def with_attributes(series: DataFrame, entities: DataFrame, columns: tuple[str, ...], entity: str = "entity") -> DataFrame:
    """Left join of entity attributes."""
    return series.join(entities.select(entity, *columns), entity, "left")


def compare_series(before: DataFrame, after: DataFrame, entity: str = "entity", value: str = "wte") -> DataFrame:
    """One row: entities and records before and after, their ratio, and the mean absolute change of entity means."""
    a = before.groupBy(entity).agg(F.count("*").alias("n"), F.avg(value).alias("m"))
    b = after.groupBy(entity).agg(F.count("*").alias("n_after"), F.avg(value).alias("m_after"))
    return a.join(b, entity, "left").agg(
        F.count("*").alias("entities_before"), F.count("n_after").alias("entities_after"), F.sum("n").alias("records_before"), F.sum("n_after").alias("records_after"),
        F.try_divide(F.sum("n_after"), F.sum("n")).alias("ratio"), F.avg(F.abs(F.col("m") - F.col("m_after"))).alias("mean_abs_change"),
    )
