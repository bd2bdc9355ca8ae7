"""Classes and display names of entities and groups, and statistics that are split by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .regression import regression

#: Labels of the two known classes; any other value is the last label.
CLASS_LABELS = {"Ref": "Regulated", "Non-ref": "Unregulated"}
NO_CLASS = "Unclassified"


def relabelled(value: Column, labels: dict[str, str] | None = None, other: str = NO_CLASS) -> Column:
    """The label of a class; null and unknown classes have ``other``."""
    out = F.lit(other)
    for name, label in (CLASS_LABELS if labels is None else labels).items():
        out = F.when(value == name, F.lit(label)).otherwise(out)
    return out


def with_class(df: DataFrame, classes: DataFrame, key: str = "grp", column: str = "class", other: str = NO_CLASS) -> DataFrame:
    """All rows of ``df`` with the relabelled class of ``key``; keys meet as text, keys without a class have ``other``.

    Of several classes of a key the least counts, so that no row is doubled; a column of that name is replaced.
    """
    own = classes.groupBy(F.col(key).cast("string").alias("_key")).agg(F.min(column).alias("_class"))
    joined = df.drop(column).join(own, F.col(key).cast("string") == F.col("_key"), "left")
    return joined.withColumn(column, relabelled(F.col("_class"), other=other)).drop("_key", "_class")


def with_name(df: DataFrame, names: DataFrame, key: str, name: str = "name") -> DataFrame:
    """``df`` with the display name of ``key`` right after it; keys without a name have null, of several names the least counts."""
    own = names.groupBy(F.col(key).cast("string").alias("_key")).agg(F.min(name).alias(name))
    joined = df.drop(name).join(own, F.col(key).cast("string") == F.col("_key"), "left")
    order = [c for c in df.columns if c != name]
    at = order.index(key) + 1
    return joined.select(*order[:at], name, *order[at:])


def at_least(df: DataFrame, column: str, least: float = 4) -> DataFrame:
    """Rows whose attribute (a stream order, say) reaches ``least``; nulls go."""
    return df.where(F.col(column) >= least)


def without_outer_noise(df: DataFrame, columns: tuple[str, ...], most: float = 4.0) -> DataFrame:
    """Rows whose scaled columns all lie within ``most`` of 0, the bound included; nulls go."""
    for c in columns:
        df = df.where(F.abs(F.col(c)) <= most)
    return df


def class_fits(df: DataFrame, classes: DataFrame, keys: tuple[str, ...] = ("grp",), x: str = "delta_wte", y: str = "delta_q", least: int = 2, p: bool = False) -> DataFrame:
    """A regression for each of ``keys`` (group, or group and month or season) with the number of its entities and its group's class."""
    fits = regression(df, keys, x=x, y=y, least=least, entity="entity", p=p)
    return with_class(fits, classes, keys[0])


def pearson(df: DataFrame, keys: tuple[str, ...], x: str, y: str, least: int = 10) -> DataFrame:
    """``(keys, n, r, abs_r)`` of groups with ``least`` complete rows and a range in both columns."""
    whole = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = whole.groupBy(*keys).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"), (F.min(x) < F.max(x)).alias("_x"), (F.min(y) < F.max(y)).alias("_y"))
    return out.where((F.col("n") >= least) & F.col("_x") & F.col("_y")).select(*keys, "n", "r", F.abs("r").alias("abs_r"))


def slope_split(slopes: DataFrame, members: DataFrame | None = None, key: str = "grp", slope: str = "slope", on: tuple[str, ...] = ("entity",)) -> DataFrame:
    """``(key, n, n_negative, n_not_negative, mean_slope, median_slope)``, of the rows that ``members`` has if it is given."""
    if members is not None:
        slopes = slopes.join(members.select(*on).distinct(), list(on), "left_semi")
    negative = F.count(F.when(F.col(slope) < 0, 1))
    return slopes.groupBy(key).agg(
        F.count(slope).alias("n"), negative.alias("n_negative"), (F.count(slope) - negative).alias("n_not_negative"),
        F.avg(slope).alias("mean_slope"), F.median(slope).alias("median_slope"),
    )


def distribution(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """``(keys, n, mean, median, std)`` of a column."""
    c = F.col(column)
    return df.groupBy(*keys).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.median(c).alias("median"), F.stddev_samp(c).alias("std"))


def by_number(distances: DataFrame, places: DataFrame, metric: DataFrame, entity: str = "entity", grp: str = "grp") -> DataFrame:
    """Inner join of pairs' distances with entities' places and pairs' metric on ids as whole numbers; ids that aren't numbers match nothing."""
    number = lambda df, *ids: df.withColumns({i: F.expr(f"try_cast(`{i}` AS bigint)") for i in ids}).distinct()
    pairs = number(distances, entity, grp).join(number(places, entity), entity)
    return pairs.join(number(metric, entity, grp), [entity, grp])
