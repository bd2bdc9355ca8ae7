"""Readers with fixed schemas: column aliases are resolved once, ids are text, NaN is null."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairflow.functions.columns import clean_id

# Column names that inputs use, by role.
ALIASES = {
    "entity": ("well_id", "wellid", "site_no"),
    "wte": ("wte", "water_table_elevation", "lev_va"),
    "date": ("date", "datetime"),
    "grp": ("gage_id", "site_no", "station_id", "id"),
    "q": ("q", "discharge", "flow", "streamflow"),
    "bfd": ("ml_bfd", "bfd"),
    "lat": ("lat_dec", "latitude", "lat"),
    "lon": ("long_dec", "longitude", "lon", "long"),
}


def renamed(df: DataFrame, roles: Sequence[str], aliases: Mapping[str, Sequence[str]] = ALIASES, optional: Sequence[str] = ()) -> DataFrame:
    """Columns under their roles' names, found without regard to case; a required role without a column is an error."""
    by_lower = {}
    for c in df.columns:
        by_lower.setdefault(c.lower(), c)
    moves, used = {}, set()
    for role in roles:
        own = next((by_lower[a] for a in (role, *aliases.get(role, ())) if a in by_lower and by_lower[a] not in used), None)
        if own is None and role not in optional:
            raise ValueError(f"no column for {role}: {', '.join(df.columns)}")
        if own is not None:
            moves[own] = role
            used.add(own)
    return df.withColumnsRenamed(moves)


def no_nan(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(t)) for c, t in df.dtypes if t in ("double", "float")})


def table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or CSV with a header, by the path's name."""
    if path.rstrip("/").lower().endswith((".csv", ".csv.gz", ".txt")):
        return spark.read.option("header", True).csv(path)
    return spark.read.parquet(path)


def locations(df: DataFrame, role: str = "entity") -> DataFrame:
    """Ids and coordinates as numbers with a point; rows without coordinates drop out."""
    out = renamed(df, (role, "lat", "lon"))
    out = out.withColumns({role: clean_id(F.col(role)), "lat": F.col("lat").try_cast("double"), "lon": F.col("lon").try_cast("double")})
    out = no_nan(out).dropna(subset=["lat", "lon"])
    return out.withColumn("point", F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")))


def levels(df: DataFrame) -> DataFrame:
    """``(entity, date, wte)``; values and dates that can't be read are null."""
    out = renamed(df, ("entity", "date", "wte"))
    day = F.to_date(F.col("date").try_cast("timestamp"))
    return no_nan(out.select(clean_id(F.col("entity")).alias("entity"), day.alias("date"), F.col("wte").try_cast("double").alias("wte")))


def flows(df: DataFrame, only_flagged: bool = False) -> DataFrame:
    """``(grp, date, q[, bfd])``."""
    out = renamed(df, ("grp", "date", "q", "bfd"), optional=("bfd",))
    cols = [clean_id(F.col("grp")).alias("grp"), F.to_date(F.col("date").try_cast("timestamp")).alias("date"), F.col("q").try_cast("double").alias("q")]
    if "bfd" in out.columns:
        cols.append(F.col("bfd").try_cast("int").alias("bfd"))
    out = no_nan(out.select(*cols))
    return out.where("bfd = 1") if only_flagged and "bfd" in out.columns else out


def flow_folder(spark: SparkSession, folder: str, only_flagged: bool = True) -> DataFrame:
    """A folder of one CSV file for each group, read in one scan; the id is the file's name."""
    df = spark.read.option("header", True).csv(f"{folder}/*.csv")
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)
    return flows(df.withColumn("grp", name), only_flagged)


def flags(df: DataFrame) -> DataFrame:
    """``(grp, date, bfd)``."""
    out = renamed(df, ("grp", "date", "bfd"))
    return out.select(clean_id(F.col("grp")).alias("grp"), F.to_date(F.col("date").try_cast("timestamp")).alias("date"), F.col("bfd").try_cast("int").alias("bfd"))


def upstream_map(df: DataFrame) -> DataFrame:
    """``(gage, upstream_link)`` as integers, null where they aren't."""
    out = renamed(df, ("gage", "upstream_link"), {"gage": ("gage_id",), "upstream_link": ("upstream_catchment_id",)})
    return out.withColumns({c: F.col(c).try_cast("bigint") for c in ("gage", "upstream_link")})


def with_crosswalk(gages: DataFrame, crosswalk: DataFrame, key: str = "grp", code: str = "code", columns: Sequence[str] = ("comid",)) -> DataFrame:
    """Left join of a crosswalk on ids as text."""
    other = crosswalk.select(clean_id(F.col(code)).alias("_code"), *columns).dropDuplicates(["_code"])
    return gages.join(other, clean_id(F.col(key)) == F.col("_code"), "left").drop("_code")


def locations_with_series(places: DataFrame, series: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Locations with points, the levels' series, and the locations' attributes without the geometry."""
    points = locations(places)
    return points, levels(series), points.drop("point")


def reach_elevations(df: DataFrame) -> DataFrame:
    """``(reach, reach_elevation)``: mean ground elevation of each reach, null where it is no number."""
    out = renamed(df, ("reach", "reach_elevation"), {"reach": ("reach_id",), "reach_elevation": ("avg_gse",)})
    return no_nan(out.select(clean_id(F.col("reach")).alias("reach"), F.col("reach_elevation").try_cast("double").alias("reach_elevation")))


def vertex_arrays(df: DataFrame, vertices: str = "line", least: int = 2) -> DataFrame:
    """Lines or rings held as ``array<struct<x, y>>``; rows with fewer than ``least`` whole vertices drop out."""
    points = F.transform(vertices, lambda v: F.struct(v["x"].cast("double").alias("x"), v["y"].cast("double").alias("y")))
    whole = F.filter(points, lambda v: v["x"].isNotNull() & v["y"].isNotNull())
    return df.withColumn(vertices, whole).where(F.size(vertices) >= least)
