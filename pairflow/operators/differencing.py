"""Ways of differencing paired monthly series besides the baseline: years, quarters, seasons, rolling years, anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairflow.functions.columns import month_index, quarter_index

PAIR = ("entity", "grp")


def _steps(df: DataFrame, keys, index: str, x: str, y: str, rows: int = 1, move: int = 1) -> DataFrame:
    """Differences to the row before (``rows`` before), kept only if the index moved by ``move``."""
    w = W.partitionBy(*keys).orderBy(index)
    out = df.withColumns({"delta_wte": F.col(x) - F.lag(x, rows).over(w), "delta_q": F.col(y) - F.lag(y, rows).over(w), "_m": F.col(index) - F.lag(index, rows).over(w)})
    return out.where(F.col("_m") == move).drop("_m")


def annual(paired: DataFrame, keys=PAIR, date: str = "date", x: str = "wte", y: str = "q", months: int = 6) -> DataFrame:
    """Changes between means of consecutive years with at least ``months`` rows each."""
    year = paired.groupBy(*keys, F.year(date).alias("year")).agg(F.avg(x).alias(x), F.avg(y).alias(y), F.count("*").alias("n")).where(F.col("n") >= months)
    return _steps(year, keys, "year", x, y)


def quarters(paired: DataFrame, keys=PAIR, date: str = "date", x: str = "wte", y: str = "q") -> DataFrame:
    """Means of quarters with all three months."""
    out = paired.groupBy(*keys, F.year(date).alias("year"), F.quarter(date).alias("quarter"), quarter_index(F.col(date)).alias("qi"))
    return out.agg(F.avg(x).alias(x), F.avg(y).alias(y), F.count("*").alias("n")).where("n >= 3")


def same_quarter(paired: DataFrame, keys=PAIR, **cols) -> DataFrame:
    """Changes from a quarter to the same of the next year."""
    return _steps(quarters(paired, keys, **cols), (*keys, "quarter"), "year", cols.get("x", "wte"), cols.get("y", "q"))


def deseasoned_quarters(paired: DataFrame, keys=PAIR, x: str = "wte", y: str = "q", **cols) -> DataFrame:
    """Changes between consecutive quarters after each quarter's long-term mean is taken off."""
    w = W.partitionBy(*keys, "quarter")
    q = quarters(paired, keys, x=x, y=y, **cols)
    q = q.withColumns({x: F.col(x) - F.avg(x).over(w), y: F.col(y) - F.avg(y).over(w)})
    return _steps(q, keys, "qi", x, y)


def rolling_year(paired: DataFrame, keys=PAIR, date: str = "date", x: str = "wte", y: str = "q", rows: int = 12, least: int = 10) -> DataFrame:
    """Changes over 12 rows of 12-row means (of at least ``least`` values), kept where 12 months passed."""
    w = W.partitionBy(*keys).orderBy(date).rowsBetween(1 - rows, 0)
    mean = lambda c: F.when(F.count(c).over(w) >= least, F.avg(c).over(w))
    out = paired.withColumns({"_x": mean(x), "_y": mean(y), "mi": month_index(F.col(date))})
    out = _steps(out.select(*keys, date, "mi", "_x", "_y"), keys, "mi", "_x", "_y", rows, rows)
    return out.where("delta_wte is not null and delta_q is not null")


def anomalies(paired: DataFrame, keys=PAIR, date: str = "date", x: str = "wte", y: str = "q", least: int = 12, detrend: bool = True) -> DataFrame:
    """Detrended values as z-scores of their calendar month (sample deviation; 0 gives null), in ``delta_wte, delta_q``."""
    w = W.partitionBy(*keys)
    t = month_index(F.col(date)).cast("double")
    out = paired.withColumn("_t", t)

    def line(c):
        at = F.when(F.col(c).isNotNull(), F.col("_t"))
        slope = F.try_divide(F.covar_pop(c, at).over(w), F.var_pop(at).over(w))
        off = F.avg(c).over(w) + slope * (F.col("_t") - F.avg(at).over(w))
        return F.when(F.count(c).over(w) >= least, F.col(c) - F.coalesce(off, F.avg(c).over(w))).otherwise(F.col(c))

    out = out.withColumns({"_x": line(x), "_y": line(y)}) if detrend else out.withColumns({"_x": F.col(x), "_y": F.col(y)})
    m = W.partitionBy(*keys, F.month(date))
    z = lambda c: F.try_divide(F.col(c) - F.avg(c).over(m), F.stddev_samp(c).over(m))
    return out.withColumns({"delta_wte": z("_x"), "delta_q": z("_y")}).drop("_x", "_y", "_t")


METHODS = {"annual": annual, "same_quarter": same_quarter, "deseasoned_quarter": deseasoned_quarters, "rolling_year": rolling_year, "anomaly": anomalies}


def all_methods(paired: DataFrame, keys=PAIR) -> DataFrame:
    """The differences of every method with its name; one table for comparisons."""
    out = None
    for name, method in METHODS.items():
        rows = method(paired, keys).select(F.lit(name).alias("method"), *keys, "delta_wte", "delta_q")
        out = rows if out is None else out.unionByName(rows)
    return out
