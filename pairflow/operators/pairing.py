"""Observation and response series: monthly means, pairing, baselines, differences, lags, pair summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairflow.functions.columns import before, mid_month
from pairflow.plans.tables import kept


def monthly_response(flow: DataFrame, group: str = "grp", date: str = "date", q: str = "q", flag: str = "bfd") -> DataFrame:
    """Mean of each group and month over rows with flag 1, on the 15th, flag 1."""
    out = flow.where(F.col(flag) == 1).groupBy(group, mid_month(F.col(date)).alias(date)).agg(F.avg(q).alias(q))
    return out.withColumn(flag, F.lit(1))


def monthly_levels(levels: DataFrame, entity: str = "entity", date: str = "date", value: str = "wte") -> DataFrame:
    """Mean of each entity and month, on the 15th."""
    return levels.groupBy(entity, mid_month(F.col(date)).alias(date)).agg(F.avg(value).alias(value))


def with_group(levels: DataFrame, of: DataFrame, entity: str = "entity", group: str = "grp") -> DataFrame:
    """Adds the group of each entity; k groups give k rows, none gives null; tables that have one pass through."""
    if group in levels.columns:
        return levels
    return levels.join(of.select(entity, group).distinct(), entity, "left")


def pair(levels: DataFrame, flow: DataFrame, flags: DataFrame | None = None, group: str = "grp", date: str = "date", flag: str = "bfd") -> DataFrame:
    """Rows of levels and flow of one group and date. The flag comes from the flow, else from ``flags``, else it is 0."""
    out = levels.join(flow, [group, date])
    if flag not in flow.columns:
        out = out.withColumn(flag, F.lit(0)) if flags is None else out.join(flags.select(group, date, flag), [group, date], "left")
    return out.withColumn(flag, F.coalesce(F.col(flag).cast("int"), F.lit(0)))


def with_baseline(paired: DataFrame, by: tuple[str, ...] = ("entity",), date: str = "date", x: str = "wte", y: str = "q", flag: str = "bfd", tie: str = "grp") -> DataFrame:
    """Adds ``{x}0`` and ``{y}0``: each column's first value by date among flagged rows of the key, null without any.

    First values are aggregates, so map-side sums come before the exchange and no task holds an entity's rows in order. The rows are written once:
    sums of doubles that are made twice may differ in their last bits, and a first value would not be that of its own row.
    """
    paired = kept(paired)
    rank = lambda c: F.when((F.col(flag) == 1) & F.col(c).isNotNull(), F.struct(date, tie))
    first = paired.groupBy(*[F.col(k).alias(f"_{k}") for k in by]).agg(*[F.min_by(c, rank(c)).alias(f"{c}0") for c in (x, y)])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by]
    return paired.join(first, on, "left").drop(*[f"_{k}" for k in by])


def with_deltas(df: DataFrame, x: str = "wte", y: str = "q") -> DataFrame:
    return df.withColumns({f"delta_{x}": F.col(x) - F.col(f"{x}0"), f"delta_{y}": F.col(y) - F.col(f"{y}0")})


def lagged(df: DataFrame, k: int, unit: str = "years", by: tuple[str, ...] = ("entity",), date: str = "date", value: str = "delta_wte", name: str | None = None) -> DataFrame:
    """Adds the value of the same key at the date ``k`` units earlier; rows without such a date drop out, several fan out."""
    name = name or f"{value}_lag"
    then = df.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(date).alias("_date"), F.col(value).alias(name))
    on = [F.col(c) == F.col(f"_{c}") for c in by] + [before(F.col(date), k, unit) == F.col("_date")]
    return df.join(then, on).drop("_date", *[f"_{c}" for c in by])


def pair_summary(paired: DataFrame, keys: tuple[str, ...] = ("entity", "grp"), date: str = "date", x: str = "wte", y: str = "q", flag: str = "bfd") -> DataFrame:
    stats = [f(c).alias(f"{c}_{n}") for c in (x, y) for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    return paired.groupBy(*keys).agg(
        F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count(date).alias("n"), *stats,
        F.sum(flag).alias("n_flagged"), F.datediff(F.max(date), F.min(date)).alias("span_days"),
    )
