"""Queries of catchments, basins, enriched series, attached metrics, location readers and held mean curves."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pairflow.operators import crosscorr, information, places, regression
from pairflow.plans import study
from pairflow.plans.tables import Store, kept, shared_folder
from pairflow.sources import readers

from .base import CTES, Tables, add, r, sql
from .pairs import RANKED, mi, reg, stat
from .selections import GRID, LINES, PTS, _lines, _points, _polygons
from .series import IX, MONTHLY, PCHIP, _curves

#: Each cell of the grid drains to one group or to two.
DRAINS = "dr AS (SELECT CAST(n_nationkey AS VARCHAR) AS grp, n_nationkey % 16 AS polygon_id FROM nation WHERE n_nationkey % 5 > 0)"


def _drains(t: Tables):
    key = F.col("n_nationkey")
    return t.read("nation").where(key % 5 > 0).select(key.cast("string").alias("grp"), (key % 16).cast("long").alias("polygon_id"))


WITHIN = "x > x1 AND x < x1 + 0.2 AND y > y1 AND y < y1 + 0.2"
add("x2_entities_in_catchments", f"WITH {PTS}, {GRID}, {DRAINS} SELECT point_id, polygon_id, grp FROM pt JOIN gr ON {WITHIN} JOIN dr USING (polygon_id)")(
    lambda t: places.entities_in_catchments(_points(t), _polygons(t), _drains(t), 0.1).select("point_id", "polygon_id", "grp")
)
ABOVE = "up AS (SELECT CAST(s_nationkey AS VARCHAR) AS grp, s_suppkey % 40 AS polygon_id FROM supplier), own AS (SELECT CAST(n_nationkey AS VARCHAR) AS grp, n_nationkey % 7 AS polygon_id FROM nation WHERE n_nationkey % 6 > 0)"
add(
    "x7_basins_of_gages",
    f"""WITH {ABOVE} SELECT grp, polygon_id, 'terminal' AS role FROM own UNION
    SELECT grp, polygon_id, 'upstream' FROM up WHERE (grp, polygon_id) NOT IN (SELECT (grp, polygon_id) FROM own)""",
)(lambda t: _basins(t))


def _basins(t: Tables):
    key = F.col("n_nationkey")
    gages = t.read("nation").select(key.cast("string").alias("grp"), F.when(key % 6 > 0, (key % 7).cast("long")).alias("terminal"))
    above = t.read("supplier").select(F.col("s_nationkey").cast("string").alias("grp"), (F.col("s_suppkey") % 40).cast("long").alias("polygon_id"))
    return places.basins_of(gages, above)


add(
    "j3_enriched_series",
    sql(
        f"""SELECT m.entity, e.grp, m.date, {r('m.wte', 'wte')}, {r('s_acctbal', 'entity_lat')}, CAST(s_suppkey AS DOUBLE) AS entity_lon,
        CASE WHEN s_nationkey % 4 > 0 THEN CAST(s_nationkey AS DOUBLE) END AS grp_lat, CASE WHEN s_nationkey % 4 > 0 THEN s_nationkey / 2 END AS grp_lon,
        CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey / 4 END AS reach_elevation FROM mlev m JOIN ents e USING (entity) JOIN supplier ON m.entity = CAST(s_suppkey AS VARCHAR)""",
        "mlev",
    ),
)(lambda t: _enriched(t))


def _enriched(t: Tables):
    s, key, nation = t.read("supplier"), F.col("s_suppkey"), F.col("n_nationkey")
    entity = key.cast("string").alias("entity")
    members = s.select(entity, F.col("s_nationkey").cast("string").alias("grp"), F.col("s_acctbal").cast("double").alias("lat"), key.cast("double").alias("lon"))
    there = t.read("nation").where(nation % 4 > 0).select(nation.cast("string").alias("grp"), nation.cast("double").alias("lat"), (nation / 2).alias("lon"))
    return places.enriched(t.mlev(), members, there, s.where(key % 3 > 0).select(entity, (key / 4).alias("reach_elevation")))


def _fits(t: Tables):
    return regression.regression(t.deltas(), ("entity", "grp"), least=10)


FITS = f"s AS ({stat()})"
add("j14_match_rate", sql(f"SELECT grp, count(*) AS n, count(r2) AS n_matched, {r('100.0 * count(r2) / count(*)', 'match_pct')} FROM ents LEFT JOIN s USING (entity, grp) GROUP BY grp", more=FITS))(
    lambda t: places.match_rate(places.with_metric(t.ents(), _fits(t), "r2"))
)
add("j12_with_fits", sql(f"SELECT entity, grp, {r('slope')}, {r('r2')} FROM ents LEFT JOIN s USING (entity, grp)", more=FITS))(lambda t: places.with_fits(t.ents(), _fits(t)))
add("a52_step_metrics", sql("SELECT count(*) AS n_rows, count(DISTINCT entity) AS n_entities, count(DISTINCT grp) AS n_groups, min(date) AS first_date, max(date) AS last_date FROM deltas"))(
    lambda t: places.step_metrics(t.deltas())
)
HELD = """gd AS (SELECT CAST(i * 2.5 AS DOUBLE) AS g FROM (SELECT unnest(range(-6, 7)) AS i)), hl AS (SELECT a.grp, g, a.c + (b.c - a.c) * (h - floor(h)) AS v FROM (SELECT g, greatest(-12, least(12, g)) AS h FROM gd)
    JOIN cc a ON a.lag = floor(h) JOIN cc b ON b.grp = a.grp AND b.entity = a.entity AND b.lag = ceil(h))"""
add(
    "t10_held_mean_curve",
    sql(f"SELECT grp, g AS lag, count(*) AS n, {r('avg(v)', 'mean')}, {r('stddev_pop(v)', 'std')}, {r('stddev_pop(v) / sqrt(count(*))', 'error')} FROM hl GROUP BY GROUPING SETS ((grp, g), (g))", "deltas", f"{IX}, {HELD}"),
)(lambda t: crosscorr.held_mean_curve(_curves(t), [2.5 * i for i in range(-6, 7)]))
add("s3_attributes_of_series", "SELECT CAST(s_suppkey AS VARCHAR) AS entity, CAST(s_acctbal AS DOUBLE) AS lat, CAST(s_nationkey AS DOUBLE) AS lon, n FROM supplier JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey")(
    lambda t: _attributes(t)
)


def _attributes(t: Tables):
    own = t.read("supplier").select(F.col("s_suppkey").alias("Well_ID"), F.col("s_acctbal").alias("lat_dec"), F.col("s_nationkey").alias("long_dec"))
    series = t.read("lineitem").select(F.col("l_suppkey").alias("Well_ID"), F.col("l_shipdate").alias("Date"), F.col("l_extendedprice").alias("WTE"))
    _, levels, attributes = readers.locations_with_series(own, series)
    return attributes.join(levels.groupBy("entity").agg(F.count("*").alias("n")), "entity")


add("s8_reach_elevations", f"SELECT CAST(p_partkey AS VARCHAR) AS reach, {r('CAST(p_retailprice AS DOUBLE)', 'reach_elevation')} FROM part")(
    lambda t: readers.reach_elevations(t.read("part").select(F.col("p_partkey").alias("Reach_ID"), F.col("p_retailprice").alias("Avg_GSE")))
)
add("s9_vertex_arrays", f"WITH {PTS}, {LINES} SELECT line_id, 2 AS n, {r('x1')}, {r('y2')} FROM li")(
    lambda t: readers.vertex_arrays(_lines(t)).select("line_id", F.size("line").alias("n"), F.col("line")[0]["x"].alias("x1"), F.col("line")[1]["y"].alias("y2"))
)


def _resumed(t: Tables):
    """Levels and members as an earlier run left them; a run of step 7, then another that starts again at step 8."""
    store = Store(t.spark, f"{shared_folder(t.spark)}/study-{uuid.uuid4().hex}")
    store.save("near_stream", t.mlev())
    store.save("members", t.ents())
    study.run(store, {"flows": t.flows()}, "7")
    return study.run(store, {}, "8-9").drop("spearman")


add("s11_resumed_study", sql(reg("entity, grp", least=10)))(_resumed)


def _study_inputs(t: Tables) -> dict:
    """Four rivers of four links each under the cells of the grid; suppliers are entities at points, nations gages of the lower eight links.

    Tables are written once: two runs compare them by hashes, and sums of doubles that are made twice may differ in their last bits."""
    key = F.col("n_nationkey")
    at = _points(t).select(F.col("point_id").cast("string").alias("entity"), "x", "y")
    inputs = {
        "network": t.read("nation").where(key < 16).select((key + 1).alias("link"), F.greatest(key - 3, F.lit(0)).alias("below")),
        "gages": t.read("nation").where(key < 8).select(key.cast("string").alias("id"), (key + 1).alias("link")),
        "points": at.join(t.ents().select("entity"), "entity", "left_semi"),
        "catchments": _polygons(t).withColumn("polygon_id", F.col("polygon_id") + 1),
        "lines": _lines(t),
        "elevations": _lines(t).where("line_id % 9 > 0").select("line_id", (20.0 + 2 * (F.col("line_id") % 13)).alias("reach_elevation")),
        "levels": t.levels(),
        "flows": t.flows(),
    }
    return {name: kept(table) for name, table in inputs.items()}


def _nine_steps(t: Tables):
    """Steps 1 to 4, then a run that reads them again for 5 to 9."""
    store = Store(t.spark, f"{shared_folder(t.spark)}/study-{uuid.uuid4().hex}")
    inputs = _study_inputs(t)
    study.run(store, inputs, "1-4", cell=0.05)
    return study.run(store, inputs, "5-9", cell=0.05)


ON_LINE = "greatest(0, least(1, coalesce(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / nullif(pow(x2 - x1, 2) + pow(y2 - y1, 2), 0), 0)))"
STUDY = f"""{PTS}, {GRID}, {LINES},
net AS (SELECT n_nationkey + 1 AS src, n_nationkey - 3 AS dst FROM nation WHERE n_nationkey < 16),
dn(link, here) AS (SELECT src, src FROM net UNION ALL SELECT link, dst FROM dn JOIN net ON here = src WHERE dst > 0),
mb AS MATERIALIZED (SELECT DISTINCT CAST(point_id AS VARCHAR) AS entity, CAST(here - 1 AS VARCHAR) AS grp, x, y FROM pt JOIN gr ON {WITHIN}
  JOIN dn ON link = polygon_id + 1 AND here <= 4 WHERE point_id IN (SELECT s_suppkey FROM supplier)),
rc AS MATERIALIZED (SELECT entity, 20.0 + 2 * (line_id % 13) AS z FROM (SELECT entity, line_id, row_number() OVER (PARTITION BY entity ORDER BY d, line_id) AS k FROM (
  SELECT entity, line_id, sqrt(pow(x - (x1 + u * (x2 - x1)), 2) + pow(y - (y1 + u * (y2 - y1)), 2)) AS d FROM (SELECT *, {ON_LINE} AS u FROM mb, li))) WHERE k = 1 AND line_id % 9 > 0),
q4 AS (SELECT entity, count(*) AS n, quantile_cont(wte, 0.25) AS lo, quantile_cont(wte, 0.75) AS hi FROM levels WHERE entity IN (SELECT entity FROM mb) GROUP BY 1),
kp AS (SELECT l.* FROM levels l JOIN q4 USING (entity) WHERE NOT coalesce(n >= 5 AND hi > lo AND (wte < lo - 3 * (hi - lo) OR wte > hi + 3 * (hi - lo)), false)),
ck AS MATERIALIZED (SELECT * FROM kp WHERE entity IN (SELECT entity FROM kp GROUP BY 1 HAVING count(*) >= 20 AND datediff('day', min(date), max(date)) / 365.25 >= 3)),
{PCHIP.format(src="ck", grid=MONTHLY)},
ns AS (SELECT entity, date, wte FROM pv JOIN rc USING (entity) WHERE z - wte * 0.3048 <= 30),
paired AS MATERIALIZED (SELECT b.grp, n.date, n.entity, n.wte, f.q, f.bfd FROM ns n JOIN (SELECT DISTINCT entity, grp FROM mb) b USING (entity) JOIN mflow f ON f.grp = b.grp AND f.date = n.date),
based AS MATERIALIZED ({CTES["based"]}), deltas AS MATERIALIZED ({CTES["deltas"]}), sr AS ({RANKED})"""
add("s11_nine_steps", sql(f"SELECT * FROM ({reg('entity, grp', least=10)}) JOIN (SELECT entity, grp, {r('spearman')} FROM sr) USING (entity, grp)", "mflow", STUDY).replace("WITH ", "WITH RECURSIVE ", 1))(
    _nine_steps
)


def _chosen(t: Tables):
    r2 = _fits(t).select("entity", "grp", F.col("r2").alias("value"))
    shared = information.mutual_information(t.deltas()).select("entity", "grp", F.col("mi").alias("value"))
    return places.six_selections({"R2": r2, "MI": shared}, n=2)


CHOSEN = f"""{FITS}, m AS ({mi("deltas", "delta_wte")}), me AS (SELECT entity, grp, 'R2' AS k, r2 AS v FROM s UNION ALL SELECT entity, grp, 'MI', mi FROM m WHERE mi IS NOT NULL),
    cut AS (SELECT grp, k, quantile_cont(v, 0.9) AS q90, quantile_cont(v, 0.75) AS q75 FROM me GROUP BY grp, k),
    sel AS (SELECT '10%_' || k AS selection, grp, entity FROM me JOIN cut USING (grp, k) WHERE v >= q90 UNION ALL SELECT '25%_' || k, grp, entity FROM me JOIN cut USING (grp, k) WHERE v >= q75
    UNION ALL SELECT 'top2_' || k, grp, entity FROM (SELECT *, row_number() OVER (PARTITION BY grp, k ORDER BY v DESC, entity) AS i FROM me) WHERE i <= 2), sd AS (SELECT * FROM deltas JOIN sel USING (grp, entity))"""
add("u5_selections", sql("SELECT selection, grp, entity FROM sel", more=CHOSEN))(_chosen)
add(
    "u5_selection_fits",
    sql(
        f"""SELECT *, 'well' AS level FROM ({reg("selection, grp, entity", src="sd", least=5)}) UNION ALL BY NAME
        SELECT *, 'ALL' AS entity, 'pooled' AS level FROM ({reg("selection, grp", src="sd", least=5)})""",
        more=CHOSEN,
    ),
)(lambda t: places.selection_fits(t.deltas(), _chosen(t)))
add("s6_gage_locations", "SELECT CAST(s_suppkey AS VARCHAR) AS grp, CAST(s_acctbal AS DOUBLE) AS lat, CAST(s_nationkey AS DOUBLE) AS lon FROM supplier")(
    lambda t: readers.locations(
        t.read("supplier").select(F.col("s_suppkey").alias("ID"), F.col("s_acctbal").alias("Latitude"), F.col("s_nationkey").alias("Longitude")), role="grp"
    ).drop("point")
)
add("s7_flags", "SELECT CAST(o_custkey AS VARCHAR) AS grp, CAST(o_orderdate AS DATE) AS date, CAST(o_orderstatus = 'F' AS INT) AS bfd FROM orders")(
    lambda t: readers.flags(
        t.read("orders").select(F.col("o_custkey").alias("gage_id"), F.col("o_orderdate").alias("Date"), (F.col("o_orderstatus") == "F").cast("int").alias("ML_BFD"))
    )
)
add("s13_upstream_map", "SELECT CAST(s_nationkey AS BIGINT) AS gage, CASE WHEN s_suppkey % 5 > 0 THEN CAST(s_suppkey AS BIGINT) END AS upstream_link FROM supplier")(
    lambda t: readers.upstream_map(
        t.read("supplier").select(
            F.col("s_nationkey").cast("string").alias("Gage_ID"),
            F.when(F.col("s_suppkey") % 5 > 0, F.col("s_suppkey").cast("string")).otherwise("none").alias("Upstream_Catchment_ID"),
        )
    )
)
