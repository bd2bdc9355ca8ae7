"""Mutual information by equal-width bins, and the comparison of lagged with unlagged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairflow.functions.columns import equal_width_bin

from .regression import regression, spearman


def mutual_information(df: DataFrame, keys=("entity", "grp"), x: str = "delta_wte", y: str = "delta_q", bins: int = 10, least: int = 10) -> DataFrame:
    """``n, mi`` per key, in nats; mi is null under ``least`` rows. Only bin counts (at most bins squared a key) are dealt out twice."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))
    ends = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[f(c).alias(f"{n}{c}") for c in ("_x", "_y") for n, f in (("lo", F.min), ("hi", F.max))])
    placed = rows.join(ends, list(keys))
    cells = placed.groupBy(*keys, "n", equal_width_bin(F.col("_x"), F.col("lo_x"), F.col("hi_x"), bins).alias("bx"), equal_width_bin(F.col("_y"), F.col("lo_y"), F.col("hi_y"), bins).alias("by"))
    cells = cells.agg(F.count("*").alias("c"))
    cells = cells.withColumns({"cx": F.sum("c").over(W.partitionBy(*keys, "bx")), "cy": F.sum("c").over(W.partitionBy(*keys, "by"))})
    term = F.col("c") / F.col("n") * F.ln(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy")))
    out = cells.groupBy(*keys, "n").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mi"))
    return out.withColumn("mi", F.when(F.col("n") >= least, F.col("mi")))


def pair_information(df: DataFrame, keys=("entity", "grp"), x: str = "delta_wte", y: str = "delta_q", bins: int = 10) -> DataFrame:
    """Mutual information, Pearson and Spearman of each pair with its number of rows."""
    out = mutual_information(df, keys, x, y, bins)
    out = out.join(regression(df, keys, x, y).select(*keys, F.col("r").alias("pearson")), list(keys), "left")
    return out.join(spearman(df, keys, x, y).drop("n"), list(keys), "left")


def compare_lag(plain: DataFrame, lag: DataFrame, keys=("entity", "grp")) -> DataFrame:
    """Pairs in both tables: change and ratio of mi, and what mi shows beyond the absolute correlation."""
    side = lambda d, t: d.select(*keys, F.col("mi").alias(f"mi_{t}"), F.col("pearson").alias(f"pearson_{t}"))
    out = side(plain, "plain").join(side(lag, "lag"), list(keys))
    out = out.withColumns(
        {
            "delta_mi": F.col("mi_lag") - F.col("mi_plain"),
            "ratio_mi": F.col("mi_lag") / (F.col("mi_plain") + 1e-9),
            "gain_plain": F.col("mi_plain") - F.abs("pearson_plain"),
            "gain_lag": F.col("mi_lag") - F.abs("pearson_lag"),
        }
    )
    return out.withColumn("delta_gain", F.col("gain_lag") - F.col("gain_plain"))


def lag_overview(compared: DataFrame, group: str | None = "grp") -> DataFrame:
    """Counts, means and the share of pairs whose mi grew, per group (by falling mean change) or over all."""
    better = F.avg(F.coalesce((F.col("delta_mi") > 0).cast("double"), F.lit(0.0))) * 100
    aggs = (F.count("*").alias("n"), F.avg("mi_plain").alias("mean_mi_plain"), F.avg("mi_lag").alias("mean_mi_lag"), F.avg("delta_mi").alias("mean_delta_mi"), better.alias("positive_pct"))
    return compared.groupBy(group).agg(*aggs).orderBy(F.desc("mean_delta_mi"), group) if group else compared.agg(*aggs)
