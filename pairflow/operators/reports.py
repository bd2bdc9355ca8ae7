"""Summaries, sensitivity sweeps and comparison tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairflow.functions.columns import minus_log10, missing, threshold_class

from .ranks import exact_quantiles
from .regression import regression


def buffer_sweep(rows: DataFrame, buffers: Sequence[float] = (10, 20, 30, 50, 100), delta: str = "delta_elev", entity: str = "entity", group: str = "grp") -> DataFrame:
    """Rows, entities, groups and retention for each buffer, in one scan: a row counts under every buffer that keeps it."""
    kept = rows.select(entity, group, F.explode(F.filter(F.array(*[F.lit(float(b)) for b in buffers]), lambda b: F.col(delta) <= b)).alias("buffer"))
    total = rows.agg(F.count("*").alias("_n"))
    out = kept.groupBy("buffer").agg(F.count("*").alias("n_rows"), F.count_distinct(entity).alias("n_entities"), F.count_distinct(group).alias("n_groups"))
    return out.join(F.broadcast(total)).withColumn("retention_pct", 100.0 * F.col("n_rows") / F.col("_n")).drop("_n")  # a single row


def gate_sweep(quality: DataFrame, years: Sequence[float] = (1, 2, 3, 5, 10, 15), counts: Sequence[int] = (5, 10, 20, 30, 50)) -> DataFrame:
    """Entities that pass each pair of gates, over the table of series quality."""
    grid = F.array(*[F.struct(F.lit(float(y)).alias("min_years"), F.lit(n).alias("min_obs")) for y in years for n in counts])
    rows = quality.select("record_years", "n_obs", F.inline(grid))
    ok = (F.col("record_years") >= F.col("min_years")) & (F.col("n_obs") >= F.col("min_obs"))
    out = rows.groupBy("min_years", "min_obs").agg(F.count_if(ok).alias("n_entities"), F.count("*").alias("_all"))
    return out.withColumn("pct", F.bround(100.0 * F.col("n_entities") / F.col("_all"), 1)).drop("_all")


def cumulative_bins(bins: DataFrame) -> DataFrame:
    """Bins in order with the running sum of their percentages; a few rows."""
    return bins.withColumn("cumulative_pct", F.sum("pct").over(W.orderBy("bin_order").rowsBetween(W.unboundedPreceding, 0)))


def compare_datasets(tables: Mapping[str, DataFrame], original: str, entity: str = "entity", group: str = "grp", date: str = "date") -> DataFrame:
    """Size, span, entities a group and rows an entity of each table, and its retention against the original."""
    rows = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("dataset"), entity, group, date)
        rows = part if rows is None else rows.unionByName(part)
    each = rows.groupBy("dataset", group, entity).agg(F.count("*").alias("n"), F.min(date).alias("a"), F.max(date).alias("b"))
    per_entity = each.groupBy("dataset", entity).agg(F.sum("n").alias("n")).groupBy("dataset").agg(
        F.count("*").alias("n_entities"), F.avg("n").alias("mean_obs"), F.median("n").alias("median_obs"), F.min("n").alias("min_obs"), F.max("n").alias("max_obs")
    )
    per_group = each.groupBy("dataset", group).agg(F.count("*").alias("e")).groupBy("dataset").agg(
        F.count("*").alias("n_groups"), F.avg("e").alias("mean_entities"), F.median("e").alias("median_entities")
    )
    whole = each.groupBy("dataset").agg(F.sum("n").alias("n"), F.min("a").alias("first_date"), F.max("b").alias("last_date"))
    whole = whole.withColumn("span_days", F.datediff("last_date", "first_date"))
    base = whole.where(F.col("dataset") == original).select(F.col("n").alias("_base"))
    out = whole.join(per_entity, "dataset").join(per_group, "dataset").join(F.broadcast(base))  # a row for each table
    return out.withColumn("retention_pct", 100.0 * F.col("n") / F.col("_base")).drop("_base")


def tagged(tables: Mapping[str, DataFrame], columns: Sequence[str], tag: str = "lag") -> DataFrame:
    out = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias(tag), *columns)
        out = part if out is None else out.unionByName(part)
    return out


def slope_signs(slopes: DataFrame, group: str = "grp", tag: str = "lag") -> DataFrame:
    """Per group and tag: slopes, share below zero, median."""
    share = F.avg((F.col("slope") < 0).cast("double")) * 100
    return slopes.groupBy(group, tag).agg(F.count("*").alias("n"), F.count_if(F.col("slope") < 0).alias("n_negative"), share.alias("negative_pct"), F.median("slope").alias("median_slope"))


def sign_flips(slopes: DataFrame, first: str, second: str, keys: Sequence[str] = ("entity",), tag: str = "lag") -> DataFrame:
    """One row: keys with both tags, and those whose sign changes from one to the other."""
    wide = slopes.groupBy(*keys).pivot(tag, [first, second]).agg(F.first("slope"))
    both = wide.where(F.col(f"`{first}`").isNotNull() & F.col(f"`{second}`").isNotNull())
    a, b = F.col(f"`{first}`") < 0, F.col(f"`{second}`") < 0
    return both.agg(F.count("*").alias("n"), F.count_if(a & ~b).alias("to_positive"), F.count_if(~a & b).alias("to_negative"))


def method_table(stats: DataFrame, method: str = "method") -> DataFrame:
    """Mean figures of each method's regressions."""
    return stats.groupBy(method).agg(
        F.count("*").alias("n"), F.avg("slope").alias("mean_slope"), (100 * F.avg((F.col("slope") > 0).cast("double"))).alias("positive_pct"), F.avg("r2").alias("mean_r2"), F.sum("n").alias("points")
    )


def wide(df: DataFrame, keys: Sequence[str], tag: str, values: Sequence[str], column: str) -> DataFrame:
    """A column for each of the given tags."""
    return df.groupBy(*keys).pivot(tag, list(values)).agg(F.first(column))


def long(df: DataFrame, keys: Sequence[str], columns: Sequence[str], tag: str = "lag", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), list(columns), tag, value)


def strongest(df: DataFrame, keys: Sequence[str], tag: str = "lag", value: str = "value") -> DataFrame:
    """Per key the tag of the greatest absolute value (ties: the smallest tag)."""
    best = F.min(F.struct((-F.abs(value)).alias("m"), tag, F.col(value).alias("v"))).alias("b")
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(best).select(*keys, F.col(f"b.{tag}").alias(tag), F.col("b.v").alias(value))


def class_regressions(df: DataFrame, stats: DataFrame, classes: Sequence[tuple[str, float, float | None]], x: str = "delta_wte", y: str = "delta_q") -> DataFrame:
    """Regressions by group and class of the pairs' r2."""
    tagged_pairs = stats.select("entity", "grp", threshold_class(F.col("r2"), classes).alias("r2_class")).where("r2_class is not null")
    return regression(df.join(tagged_pairs, ["entity", "grp"]), ("grp", "r2_class"), x, y)


def panel(df: DataFrame, column: str, group: str = "grp") -> DataFrame:
    """Count, extremes, mean and 90th percentile of a column per group, share above zero; infinities are missing."""
    v = missing(F.col(column))
    return df.groupBy(group).agg(
        F.count(v).alias("n"), F.min(v).alias("min"), F.avg(v).alias("mean"), F.percentile(v, 0.9).alias("p90"), F.max(v).alias("max"),
        (100 * F.avg((v > 0).cast("double"))).alias("positive_pct"),
    )


def group_summary(stats: DataFrame, group: str = "grp") -> DataFrame:
    """r2 and row counts of a group's pairs, to four decimals."""
    r = lambda c: F.bround(c, 4)
    return stats.groupBy(group).agg(
        F.count("r2").alias("n_pairs"), r(F.avg("r2")).alias("r2_mean"), r(F.stddev_samp("r2")).alias("r2_std"), r(F.max("r2")).alias("r2_max"), r(F.min("r2")).alias("r2_min"),
        r(F.avg("n")).alias("n_mean"), F.sum("n").alias("n_sum"),
    )


def histogram(df: DataFrame, value: str, width: float, low: float = 0.0) -> DataFrame:
    v = F.floor((F.col(value) - low) / width).cast("long")
    return df.where(F.col(value).isNotNull()).groupBy(v.alias("bin")).agg(F.count("*").alias("n")).withColumn("from", low + F.col("bin") * width)


def shares(df: DataFrame, tests: Mapping[str, Column]) -> DataFrame:
    """One row with the percentage of rows for which each test holds."""
    return df.agg(*[(100 * F.avg(F.coalesce(t.cast("double"), F.lit(0.0)))).alias(n) for n, t in tests.items()])


def cross_counts(df: DataFrame, key: str, tag: str, values: Sequence[str]) -> DataFrame:
    """Zero-filled counts of each tag value by key."""
    return df.groupBy(key).pivot(tag, list(values)).count().na.fill(0)


def class_shares(df: DataFrame, column: str) -> DataFrame:
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return n.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy()))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles of columns, a row each."""
    rows = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])))
    out = rows.groupBy("column").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    out = out.join(exact_quantiles(rows, "v", [0.25, 0.5, 0.75], ["column"]), "column", "left")
    return out.withColumns({c: F.col("q")[i] for i, c in enumerate(("q25", "q50", "q75"))}).drop("q")


def value_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """5th and 95th percentile over the pooled columns; infinities are missing."""
    pooled = df.select(F.explode(F.array(*[missing(F.col(c)) for c in columns])).alias("v"))
    return exact_quantiles(pooled, "v", [0.05, 0.95]).select(F.col("q")[0].alias("q05"), F.col("q")[1].alias("q95"))


def group_range(df: DataFrame, column: str, group: str = "grp", q: float = 0.95, least: float = 1e-6) -> DataFrame:
    """``(grp, most)``: the quantile of each group's absolute values, infinities missing; ``least`` where that is null or 0."""
    rows = df.select(group, F.abs(missing(F.col(column))).alias("v"))
    found = exact_quantiles(rows, "v", [q], [group]).select(F.col(group).alias("_g"), F.col("q")[0].alias("_q"))
    out = rows.select(group).distinct().join(found, F.col(group).eqNullSafe(F.col("_g")), "left")
    return out.select(group, F.when(F.col("_q") > 0, F.col("_q")).otherwise(F.lit(least)).alias("most"))


def method_significance(fits: DataFrame, by: str = "method") -> DataFrame:
    """``(method, n, mean_minus_log10_p)`` over fits with ``p``."""
    return fits.groupBy(by).agg(F.count("*").alias("n"), F.avg(minus_log10(F.col("p"))).alias("mean_minus_log10_p"))


def season_report(stats: DataFrame, slopes: Sequence[str], r2s: Sequence[str]) -> DataFrame:
    """Per season and over all (null): rows, share of positive slopes and mean r2 of each pair of columns."""
    aggs = [F.count("*").alias("n")]
    for s, r in zip(slopes, r2s, strict=True):
        aggs += [(100 * F.avg((F.col(s) > 0).cast("double"))).alias(f"{s}_positive_pct"), F.avg(r).alias(f"{r}_mean")]
    return stats.groupingSets([[F.col("period")], []], F.col("period")).agg(*aggs)
