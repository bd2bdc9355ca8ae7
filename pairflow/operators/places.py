"""Which places belong together: entities in catchments, basins of gages, series with coordinates and reaches, metrics of entities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairflow.plans.tables import kept

from .filters import above_group_quantile, top_n
from .regression import regression
from .graph import first_gage_below
from .spatial import nearest_line, points_in_polygons, to_utm


def entities_in_catchments(points: DataFrame, catchments: DataFrame, upstream: DataFrame, cell: float, catchment: str = "polygon_id", gage: str = "grp") -> DataFrame:
    """Points ``(x, y)`` with the catchment they lie within and each gage that it drains to; names in lower case.

    ``upstream`` has ``(gage, catchment)`` rows. A point may have several gages; points without a catchment or a gage drop out.
    """
    held = points_in_polygons(points, catchments, cell)
    links = upstream.select(F.col(gage), F.col(catchment)).dropna().distinct()
    out = held.join(links, catchment)
    return out.toDF(*[c.lower() for c in out.columns])


def reaches_of(
    points: DataFrame, lines: DataFrame, elevations: DataFrame, net: DataFrame, gages: DataFrame, cell: float = 1000.0, zone: int = 12, entity: str = "entity"
) -> DataFrame:
    """``(entity, reach, reach_elevation, distance, downstream_gage)``: the nearest reach of each point, its elevation, and the first gage at or below it.

    ``points(entity, lon, lat)`` and ``lines(line_id, line)`` with vertices ``x, y`` are in degrees; distances are metres in the UTM zone, as is ``cell``, the least
    width of the search's cells. ``elevations(line_id, reach_elevation)``: of several rows of a reach the smallest counts, none gives null. ``net(src, dst)`` and
    ``gages(id, link)`` are over the lines' ids; a gage is looked for within 100 links, and null if there is none.
    """
    x, y = to_utm(F.col("lon"), F.col("lat"), zone)
    spots = points.select(entity, x.alias("x"), y.alias("y"))

    def moved(v: Column) -> Column:
        east, north = to_utm(v["x"], v["y"], zone)
        return F.struct(east.alias("x"), north.alias("y"))

    near = nearest_line(spots, lines.select("line_id", F.transform("line", moved).alias("line")), cell, entity)
    heights = elevations.groupBy(F.col("line_id").alias("_line")).agg(F.min("reach_elevation").alias("reach_elevation"))
    below = first_gage_below(gages, net).select(F.col("link").alias("_link"), F.col("gage").alias("downstream_gage"))
    out = near.join(heights, F.col("line_id") == F.col("_line"), "left").join(below, F.col("line_id") == F.col("_link"), "left")
    return out.select(entity, F.col("line_id").alias("reach"), "reach_elevation", "distance", "downstream_gage")


def basins_of(gages: DataFrame, upstream: DataFrame, gage: str = "grp", terminal: str = "terminal", basin: str = "polygon_id") -> DataFrame:
    """``(gage, basin, role)``: the gage's own basin as ``terminal`` and all others above it as ``upstream``, each once.

    A gage without a basin of its own (null) still has those above it.
    """
    own = gages.select(gage, F.col(terminal).alias(basin)).where(F.col(basin).isNotNull()).distinct()
    above = upstream.select(gage, basin).dropna().distinct().join(gages.select(gage).distinct(), gage, "left_semi").join(own, [gage, basin], "left_anti")
    return own.withColumn("role", F.lit("terminal")).unionByName(above.withColumn("role", F.lit("upstream")))


def enriched(series: DataFrame, members: DataFrame, places: DataFrame, elevations: DataFrame, entity: str = "entity", group: str = "grp") -> DataFrame:
    """Series of entities that have a group, with the coordinates of both and the elevation of the entity's reach (null where unknown).

    ``members``: ``(entity, grp, lat, lon)``, ``places``: ``(grp, lat, lon)``, ``elevations``: ``(entity, reach_elevation)``. An entity of several groups
    has its series in each.
    """
    own = members.select(entity, group, F.col("lat").alias("entity_lat"), F.col("lon").alias("entity_lon"))
    there = places.select(group, F.col("lat").alias("grp_lat"), F.col("lon").alias("grp_lon"))
    return series.join(own, entity).join(there, group, "left").join(elevations.select(entity, "reach_elevation"), entity, "left")


def with_metric(entities: DataFrame, metrics: DataFrame, metric: str, on: Sequence[str] = ("entity", "grp")) -> DataFrame:
    """All entities with a metric of theirs, null where there is none, and ``has_metric``; filter on it to split them."""
    found = metrics.select(*on, F.col(metric))
    return entities.join(found, list(on), "left").withColumn("has_metric", F.col(metric).isNotNull())


def match_rate(df: DataFrame, by: Sequence[str] = ("grp",)) -> DataFrame:
    """Of :func:`with_metric`: entities, those with a metric, and their share in percent, per group."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("has_metric").alias("n_matched"), (100 * F.avg(F.col("has_metric").cast("int"))).alias("match_pct"))


def with_fits(top: DataFrame, fits: DataFrame, columns: Sequence[str] = ("slope", "r2"), on: Sequence[str] = ("entity", "grp")) -> DataFrame:
    """Selected entities with columns of their fits, null where they have none."""
    return top.join(fits.select(*on, *columns), list(on), "left")


def described_trends(trends: DataFrame, places: DataFrame, top: DataFrame, entity: str = "entity") -> DataFrame:
    """Trends with the columns of places and of selected entities, null where those lack the entity."""
    return trends.join(places, entity, "left").join(top, entity, "left")


def step_metrics(df: DataFrame, entity: str = "entity", group: str = "grp", date: str = "date") -> DataFrame:
    """One row about a step's result: rows, distinct entities and groups, first and last date."""
    count: Column = F.count("*").alias("n_rows")
    return df.agg(
        count, F.countDistinct(entity).alias("n_entities"), F.countDistinct(group).alias("n_groups"), F.min(date).alias("first_date"), F.max(date).alias("last_date")
    )


def six_selections(tables: Mapping[str, DataFrame], shares: Sequence[float] = (0.1, 0.25), n: int = 10, group: str = "grp", entity: str = "entity") -> DataFrame:
    """``(selection, grp, entity)``: of each metric the pairs at or above each group's quantile for every share, and each group's best ``n``.

    ``tables`` holds per label a table ``(entity, grp, value)``. Null values are never chosen; equal values all pass a quantile, and of
    equal values at the end of the best ``n`` the smaller entity stays.
    """
    out = None
    for label, values in tables.items():
        values = kept(values.select(entity, group, "value").where(F.col("value").isNotNull()))
        parts = [(f"{100 * s:g}%_{label}", above_group_quantile(values, 1 - s, "value", group)) for s in shares]
        for name, part in [*parts, (f"top{n}_{label}", top_n(values, n, "value", group, entity))]:
            part = part.select(F.lit(name).alias("selection"), group, entity)
            out = part if out is None else out.unionByName(part)
    return out


def selection_fits(df: DataFrame, chosen: DataFrame, least: int = 5, group: str = "grp", entity: str = "entity", all_of: str = "ALL") -> DataFrame:
    """Least squares of each chosen entity and, as entity ``ALL``, of each group's chosen entities together, per selection.

    Fits of fewer than ``least`` rows or with a constant column drop out.
    """
    rows = df.join(chosen, [group, entity])
    own = regression(rows, ("selection", group, entity), least=least).withColumn("level", F.lit("well"))
    pooled = regression(rows, ("selection", group), least=least).withColumns({entity: F.lit(all_of), "level": F.lit("pooled")})
    return own.unionByName(pooled)


def selection_summary(fits: DataFrame, group: str = "grp") -> DataFrame:
    """Of the single fits of :func:`selection_fits`, per selection and group: their number, medians and means, and the share of positive slopes."""
    return fits.where("level = 'well'").groupBy("selection", group).agg(
        F.count("*").alias("n_wells"), F.median("n").alias("median_n"), F.avg("slope").alias("mean_slope"), F.median("slope").alias("median_slope"),
        F.avg("r2").alias("mean_r2"), F.median("r2").alias("median_r2"), (100 * F.avg((F.col("slope") > 0).cast("double"))).alias("positive_pct"),
    )


def selections_wide(summary: DataFrame, selections: Sequence[str], value: str, group: str = "grp") -> DataFrame:
    """One row for each group with a value of every selection, null where it has none."""
    return summary.groupBy(group).agg(*[F.max(F.when(F.col("selection") == s, F.col(value))).alias(s) for s in selections])


def counts_of(members: DataFrame, by: Sequence[str] = ("polygon_id", "grp"), entity: str = "entity") -> DataFrame:
    """Entities of each catchment and gage (or of other keys), the largest first."""
    return members.groupBy(*by).agg(F.count_distinct(entity).alias("n")).orderBy(F.desc("n"), *by)
