"""Row and group filters, selections of the best, set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairflow.functions.columns import ELEVATION_EDGES, FEET_TO_METRES, bin_labels, bin_order, clean_id, right_closed_bins
from pairflow.plans.tables import kept

from .ranks import exact_quantiles


def date_range(df: DataFrame, start: str | None = None, end: str | None = None, date: str = "date") -> DataFrame:
    """Rows from ``start`` to ``end``, both included, each optional."""
    if start is not None:
        df = df.where(F.col(date) >= F.lit(start).cast("date"))
    return df if end is None else df.where(F.col(date) <= F.lit(end).cast("date"))


def flagged(df: DataFrame, flag: str = "bfd") -> DataFrame:
    return df.where(F.col(flag) == 1)


def known_groups(df: DataFrame, keep: DataFrame | None, group: str = "grp") -> DataFrame:
    """Ids cleaned; rows of the groups in ``keep`` (None: all)."""
    df = df.withColumn(group, clean_id(F.col(group)))
    return df if keep is None else df.join(keep.select(clean_id(F.col(group)).alias(group)).distinct(), group, "left_semi")


def without_groups(df: DataFrame, gone: Sequence[str], group: str = "grp") -> DataFrame:
    return df.where(~F.coalesce(F.col(group).isin(*gone), F.lit(False))) if gone else df


def without_known_errors(df: DataFrame, rules: DataFrame, group: str = "grp", value: str = "delta_wte") -> DataFrame:
    """Drops rows beyond the absolute ``limit`` of their group in ``rules(group, limit)``; nulls stay."""
    limits = rules.groupBy(group).agg(F.min("limit").alias("_limit"))
    return df.join(limits, group, "left").where(~F.coalesce(F.abs(value) > F.col("_limit"), F.lit(False))).drop("_limit")


def top_share_of_entities(df: DataFrame, stats: DataFrame, percent: float = 10, metric: str = "r2", entity: str = "entity") -> DataFrame:
    """Rows of entities with a pair whose metric reaches the (100 - percent) percentile of all pairs."""
    stats = kept(stats)  # so that the cut and the metrics are of the same bits
    cut = exact_quantiles(stats, metric, [1 - percent / 100]).select(F.col("q")[0].alias("_cut"))
    best = stats.join(F.broadcast(cut), F.col(metric) >= F.col("_cut")).select(entity).distinct()  # a single row
    return df.join(best, entity, "left_semi")


def matching_keys(df: DataFrame, stats: DataFrame, where: Column, keys: Sequence[str] = ("entity", "grp")) -> DataFrame:
    """Rows whose key has a row in ``stats`` for which ``where`` holds."""
    return df.join(stats.where(where).select(*keys).distinct(), list(keys), "left_semi")


def elevation_filter(levels: DataFrame, reaches: DataFrame, buffer: float = 30.0, edges: Sequence[float] = ELEVATION_EDGES, entity: str = "entity", wte: str = "wte") -> tuple[DataFrame, DataFrame]:
    """Rows whose reach lies at most ``buffer`` metres above the level (feet to metres), and the classes of those differences.

    ``reaches(entity, reach_elevation)``; rows without an elevation drop out.
    """
    rows = levels.join(reaches.select(entity, "reach_elevation"), entity)
    rows = rows.withColumn("delta_elev", F.col("reach_elevation") - F.col(wte) * FEET_TO_METRES).where(F.col("delta_elev") <= buffer)
    d = F.col("delta_elev")
    bins = rows.groupBy(right_closed_bins(d, edges, bin_labels(edges)).alias("bin"), bin_order(d, edges).alias("bin_order")).agg(F.count("*").alias("n"))
    share = F.try_divide(100.0 * F.col("n"), F.sum("n").over(W.partitionBy()))
    return rows, bins.withColumn("pct", F.bround(share, 2))


def trimmed(df: DataFrame, columns: Sequence[str], low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Rows inside each column's quantiles, one column after the other, each over what is left."""
    df = kept(df)  # so that the quantiles and the rows are of the same bits
    for c in columns:
        q = exact_quantiles(df, c, [low, high]).select(F.col("q").alias("_q"))
        df = df.join(F.broadcast(q), F.col(c).between(F.col("_q")[0], F.col("_q")[1])).drop("_q")  # a single row
    return df


def clipped(df: DataFrame, column: str, low: float, high: float, keys: Sequence[str] = ()) -> DataFrame:
    """Values saturate at their group's percentiles; no row goes."""
    q = exact_quantiles(df, column, [low, high], keys).withColumnRenamed("q", "_q")
    out = df.join(q, list(keys), "left") if keys else df.join(F.broadcast(q))  # a single row
    return out.withColumn(column, F.greatest(F.least(F.col(column), F.col("_q")[1]), F.col("_q")[0])).drop("_q")


def disagreements(a: DataFrame, b: DataFrame, entity: str = "entity", left: str = "downstream", right: str = "grp") -> DataFrame:
    """Entities whose two group columns differ; a missing one differs from a present one."""
    return a.select(entity, left).join(b.select(entity, right), entity).where(~F.col(left).eqNullSafe(F.col(right)))


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row of each key, the first in the order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def top_n(df: DataFrame, n: int, metric: str, group: str = "grp", tie: str = "entity", rank: str = "rank") -> DataFrame:
    """The n rows of each group with the greatest metric, numbered; null metrics don't count, ties go by ``tie``."""
    w = W.partitionBy(group).orderBy(F.desc(metric), tie)
    return df.where(F.col(metric).isNotNull()).withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def top_fraction(df: DataFrame, share: float, metric: str, group: str = "grp", tie: str = "entity") -> DataFrame:
    """The best ``share`` of each group by absolute metric, one at least."""
    rows = df.where(F.col(metric).isNotNull())
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.abs(metric).desc(), tie))
    size = F.greatest(F.lit(1), F.floor(F.count("*").over(W.partitionBy(group)) * share))
    return rows.withColumns({"_r": rank, "_n": size}).where("_r <= _n").drop("_r", "_n")


def above_group_quantile(df: DataFrame, q: float, metric: str, group: str = "grp") -> DataFrame:
    """Rows whose metric reaches their group's quantile. The rows are written once, so that a metric that is the quantile itself equals it to the last bit."""
    df = kept(df)
    cut = df.groupBy(group).agg(F.percentile(metric, q).alias("_cut"))
    return df.join(cut, group).where(F.col(metric) >= F.col("_cut")).drop("_cut")


def first_entities(df: DataFrame, n: int, group: str = "grp", entity: str = "entity", date: str = "date") -> DataFrame:
    """Rows of the first n entities of each group by first date."""
    order = df.groupBy(group, entity).agg(F.min(date).alias("_d"))
    order = order.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy("_d", entity))).where(F.col("_r") <= n)
    return df.join(order.select(group, entity), [group, entity], "left_semi")


def union_new(a: DataFrame, b: DataFrame, keys: Sequence[str], labels: tuple[str, str] = ("top10", "top25")) -> DataFrame:
    """a, then those rows of b whose key a lacks, with a label each."""
    rest = b.join(a.select(*keys).distinct(), list(keys), "left_anti")
    return a.withColumn("subset", F.lit(labels[0])).unionByName(rest.withColumn("subset", F.lit(labels[1])))
