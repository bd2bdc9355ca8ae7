"""Many lags of one table at once: its rows, fits and information by lag, wide and long."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairflow.functions.columns import before, month_name, ordinal, season

from .information import mutual_information
from .regression import regression

#: Label, length and unit of each lag; None is the table itself (fixed values).
LAGS: dict[str, tuple[int, str] | None] = {"none": None, "3mo": (3, "months"), "6mo": (6, "months"), "1yr": (1, "years"), "5yr": (5, "years")}


def with_lags(
    df: DataFrame, lags: Mapping[str, tuple[int, str] | None] = LAGS, by: Sequence[str] = ("entity",), date: str = "date", value: str = "delta_wte", name: str = "x"
) -> DataFrame:
    """The rows of ``df`` once for each lag with ``lag`` and ``name``: the value of the same key at the date that much earlier.

    One join serves all lags: each row asks for the dates of its lags. Rows without such a date drop out under that lag, several fan out.
    """
    asked = [F.struct(F.lit(label).alias("lag"), before(F.col(date), *how).alias("_then")) for label, how in lags.items() if how]
    then = df.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(date).alias("_date"), F.col(value).alias(name))
    on = [F.col(c) == F.col(f"_{c}") for c in by] + [F.col("_then") == F.col("_date")]
    own = [df.select("*", F.lit(label).alias("lag"), F.col(value).alias(name)) for label, how in lags.items() if not how]
    out = df.select("*", F.inline(F.array(*asked))).join(then, on).drop("_then", "_date", *[f"_{c}" for c in by]) if asked else None
    for part in own:
        out = part if out is None else out.unionByName(part)
    return out


def lag_table(rows: DataFrame, keys: Sequence[str] = ("grp",), x: str = "x", y: str = "delta_q", bins: int = 20, entity: str = "entity") -> DataFrame:
    """``(lag, keys, n, n_entities, slope, r2, p, mi)`` of :func:`with_lags`; a fit that a constant column rules out is null."""
    by = ("lag", *keys)
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = both.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(entity).alias("n_entities"))
    fits = regression(both, by, x, y, p=True).select(*by, "slope", "r2", "p")
    shared = mutual_information(both, by, x, y, bins, least=1).select(*by, "mi")
    return out.join(fits, list(by), "left").join(shared, list(by), "left")


def by_lag(table: DataFrame, lags: Sequence[str], values: Sequence[str] = ("r2", "mi", "n", "n_entities"), keys: Sequence[str] = ("grp",)) -> DataFrame:
    """One row for each key: every value of every lag as ``value_lag``."""
    aggs = [F.max(F.when(F.col("lag") == lag, F.col(v))).alias(f"{v}_{lag}") for v in values for lag in lags]
    return table.groupBy(*keys).agg(*aggs)


def period_trends(df: DataFrame, columns: Sequence[str] = ("delta_q", "delta_wte_lag"), group: str = "grp", date: str = "date", entity: str = "entity") -> DataFrame:
    """``(grp, period_type, period, n, n_entities)`` and per column ``slope_, r2_, p_``: its straight line over days, by month and by season, in one pass.

    Rows need all columns; periods of a single date drop out, and a constant column has no line.
    """
    m = F.month(date)
    periods = F.array(*[F.struct(F.lit(t).alias("period_type"), c.alias("period")) for t, c in (("Seasonal", season(m)), ("Monthly", month_name(m)))])
    rows = df.where(F.col(date).isNotNull()).dropna(subset=list(columns))
    rows = rows.select(group, entity, date, *columns, ordinal(F.col(date)).cast("double").alias("_day"), F.inline(periods))
    by = (group, "period_type", "period")
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(entity).alias("n_entities"), (F.min(date) < F.max(date)).alias("_many")).where("_many").drop("_many")
    for c in columns:
        line = regression(rows, by, "_day", c, p=True)
        out = out.join(line.select(*by, *[F.col(v).alias(f"{v}_{c}") for v in ("slope", "r2", "p")]), list(by), "left")
    return out
