"""Queries of lag tables, trends by period, summaries of selections, and what else a study tabulates from fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairflow.functions.columns import FEET_TO_METRES
from pairflow.operators import differencing, filters, information, lags, places, regression, reports, spatial, trend

from .base import Tables, add, correlation_p, r, sql
from .pairs import ALL, CMP, _compared, mi, reg, stat
from .places import CHOSEN, DRAINS, WITHIN, _chosen, _drains
from .selections import ELEV, GRID, PTS, _points, _polygons, _reaches
from .series import LIN

SPANS = {"3mo": "3 MONTH", "6mo": "6 MONTH", "1yr": "1 YEAR", "5yr": "5 YEAR"}
FIVE = "lg AS MATERIALIZED (SELECT 'none' AS lag, entity, grp, delta_wte AS x, delta_q FROM deltas" + "".join(
    f" UNION ALL SELECT '{k}', a.entity, a.grp, b.delta_wte, a.delta_q FROM deltas a JOIN deltas b ON a.entity = b.entity AND CAST(a.date - INTERVAL {v} AS DATE) = b.date" for k, v in SPANS.items()
) + ")"


def lag_sql(keys: str) -> str:
    """Counts, fits and information by lag and keys as SQL."""
    return f"""SELECT lag, {keys}, n, n_entities, slope, r2, p, {r("mi")} FROM (SELECT lag, {keys}, count(*) AS n, count(DISTINCT entity) AS n_entities FROM lg WHERE x IS NOT NULL AND delta_q IS NOT NULL GROUP BY ALL)
    LEFT JOIN (SELECT lag, {keys}, slope, r2, p FROM ({reg(f"lag, {keys}", x="x", src="lg", p=True)})) USING (lag, {keys})
    LEFT JOIN (SELECT lag, {keys}, mi FROM ({mi("lg", "x", 20, f"lag, {keys}", 1)})) USING (lag, {keys})"""


add("a27_five_lags", sql(lag_sql("grp"), more=FIVE))(lambda t: lags.lag_table(lags.with_lags(t.deltas())))
add("a27_five_lags_by_pair", sql(lag_sql("grp, entity"), more=FIVE))(lambda t: lags.lag_table(lags.with_lags(t.deltas()), ("grp", "entity")))
WIDE = ", ".join(f"max({v}) FILTER (lag = '{k}') AS {v}_{k}" for v in ("r2", "mi", "n", "n_entities") for k in lags.LAGS)
add("a27_five_lags_wide", sql(f"SELECT grp, {WIDE} FROM ({lag_sql('grp')}) GROUP BY grp", more=FIVE))(
    lambda t: lags.by_lag(lags.lag_table(lags.with_lags(t.deltas())), list(lags.LAGS))
)

PERIODIC = """pt2 AS MATERIALIZED (SELECT *, CAST(datediff('day', DATE '1970-01-01', date) + 719163 AS DOUBLE) AS day FROM lag1 WHERE delta_q IS NOT NULL AND delta_wte_lag IS NOT NULL),
pp AS MATERIALIZED (SELECT *, 'Monthly' AS period_type, strftime(date, '%b') AS period FROM pt2 UNION ALL
  SELECT *, 'Seasonal', CASE WHEN month(date) IN (12, 1, 2) THEN 'Winter' WHEN month(date) <= 5 THEN 'Spring' WHEN month(date) <= 8 THEN 'Summer' ELSE 'Fall' END FROM pt2)"""
BY = "grp, period_type, period"
LINES_OF = "".join(
    f" LEFT JOIN (SELECT {BY}, slope AS slope_{c}, r2 AS r2_{c}, p AS p_{c} FROM ({reg(BY, x='day', y=c, src='pp', p=True)})) USING ({BY})" for c in ("delta_q", "delta_wte_lag")
)
add(
    "a35_period_trends",
    sql(f"SELECT * FROM (SELECT {BY}, count(*) AS n, count(DISTINCT entity) AS n_entities FROM pp GROUP BY ALL HAVING min(date) < max(date)){LINES_OF}", "lag1", PERIODIC),
)(lambda t: lags.period_trends(t.lag()))

SUMMARY = f"""su AS (SELECT selection, grp, count(*) AS n_wells, median(n) AS median_n, avg(slope) AS mean_slope, median(slope) AS median_slope, avg(r2) AS mean_r2, median(r2) AS median_r2,
  100 * avg(CASE WHEN slope > 0 THEN 1.0 ELSE 0 END) AS positive_pct FROM (
    SELECT selection, grp, entity, count(*) AS n, regr_sxy(delta_q, delta_wte) / regr_sxx(delta_q, delta_wte) AS slope,
      pow(regr_sxy(delta_q, delta_wte), 2) / regr_sxx(delta_q, delta_wte) / regr_syy(delta_q, delta_wte) AS r2 FROM sd WHERE delta_wte IS NOT NULL AND delta_q IS NOT NULL
    GROUP BY ALL HAVING count(*) >= 5 AND min(delta_wte) < max(delta_wte) AND min(delta_q) < max(delta_q)) GROUP BY ALL)"""
TOLD = ("median_n", "mean_slope", "median_slope", "mean_r2", "median_r2", "positive_pct")
add("u5_summary", sql(f"SELECT selection, grp, n_wells, {', '.join(map(r, TOLD))} FROM su", more=f"{CHOSEN}, {SUMMARY}"))(lambda t: _summary(t))
SIX = ("10%_R2", "25%_R2", "top2_R2", "10%_MI", "25%_MI", "top2_MI")
for _value in ("median_r2", "median_slope"):
    add(
        f"u5_{_value}_wide",
        sql("SELECT grp, " + ", ".join(f"round(max({_value}) FILTER (selection = '{k}'), 6) + 0.0 AS \"{k}\"" for k in SIX) + " FROM su GROUP BY grp", more=f"{CHOSEN}, {SUMMARY}"),
    )(lambda t, value=_value: places.selections_wide(_summary(t), SIX, value))


def _summary(t: Tables):
    return places.selection_summary(places.selection_fits(t.deltas(), _chosen(t)))


S, M = f"s AS ({stat()})", f"m AS ({mi('deltas', 'delta_wte')})"
add(
    "j12_top_information",
    sql(f"SELECT entity, grp, n, {r('mi')}, CAST(rank AS INT) AS rank, {r('slope')}, {r('r2')} FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY mi DESC, entity) AS rank FROM m WHERE mi IS NOT NULL) LEFT JOIN (SELECT entity, grp, slope, r2 FROM s) USING (entity, grp) WHERE rank <= 2", more=f"{S}, {M}"),
)(lambda t: places.with_fits(filters.top_n(information.mutual_information(t.deltas()), 2, "mi"), regression.regression(t.deltas(), ("entity", "grp"), least=20)))
add(
    "j12_described_trends",
    sql(
        f"""SELECT entity, f.n, {r("f.slope_yr", "slope_yr")}, {r("f.r2", "r2")}, z AS reach_elevation, rank FROM lf f
        LEFT JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS entity, 10 + abs(s_acctbal) / 200 AS z FROM supplier WHERE s_suppkey % 4 > 0) USING (entity)
        LEFT JOIN (SELECT entity, rank FROM (SELECT CAST(s_suppkey AS VARCHAR) AS entity, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, CAST(s_suppkey AS VARCHAR)) AS INT) AS rank FROM supplier) WHERE rank <= 2) USING (entity)""",
        "mlev",
        LIN,
    ),
)(lambda t: _described(t))


def _described(t: Tables):
    s = t.read("supplier").select(F.col("s_suppkey").cast("string").alias("entity"), "s_nationkey", "s_acctbal", "s_suppkey")
    where = _reaches(t).join(s.where("s_suppkey % 4 > 0").select("entity"), "entity", "left_semi")
    top = filters.top_n(s, 2, "s_acctbal", "s_nationkey").select("entity", "rank")
    return places.described_trends(trend.linear_trends(t.mlev()), where, top)


add(
    "j15_entities_by_catchment",
    f"WITH {PTS}, {GRID}, {DRAINS} SELECT polygon_id, grp, count(DISTINCT point_id) AS n FROM pt JOIN gr ON {WITHIN} JOIN dr USING (polygon_id) GROUP BY ALL",
)(lambda t: places.counts_of(places.entities_in_catchments(_points(t), _polygons(t), _drains(t), 0.1), entity="point_id"))
add(
    "x10_direction_counts",
    sql(f"SELECT direction, n, {r('100.0 * n / sum(n) OVER ()', 'pct')} FROM (SELECT CASE WHEN wte > z THEN 'gaining' WHEN wte < z THEN 'losing' ELSE 'neutral' END AS direction, count(*) AS n FROM mlev JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS entity, 10 + abs(s_acctbal) / 200 AS z FROM supplier) USING (entity) GROUP BY 1)", "mlev"),
)(lambda t: spatial.direction_counts(spatial.gradient(t.mlev().join(_reaches(t), "entity").withColumn("distance", F.lit(1)))))
EDGES = (-5.0, 0.0, 2.5, 20.0)
add(
    "p8_own_classes",
    sql(
        f"""SELECT ['< -5', '-5 to 0', '0 to 2.5', '2.5 to 20', '>= 20'][o + 1] AS bin, o AS bin_order, count(*) AS n, round_even(100.0 * count(*) / sum(count(*)) OVER (), 2) + 0.0 AS pct
        FROM (SELECT CASE WHEN delta_elev <= -5 THEN 0 WHEN delta_elev <= 0 THEN 1 WHEN delta_elev <= 2.5 THEN 2 WHEN delta_elev <= 20 THEN 3 ELSE 4 END AS o FROM el WHERE delta_elev <= 25) GROUP BY o""",
        "mlev",
        ELEV,
    ),
)(lambda t: filters.elevation_filter(t.mlev(), _reaches(t), 25.0, EDGES)[1])
add(
    "a53_group_range",
    sql(f"SELECT grp, {r('CASE WHEN q > 0 THEN q ELSE 1e-6 END', 'most', 7)} FROM (SELECT grp, quantile_cont(abs(CASE WHEN grp <> '3' THEN mi_lag - mi_plain END), 0.95) AS q FROM c GROUP BY grp)", "lag1", CMP),
    digits=7,
)(lambda t: reports.group_range(_compared(t).withColumn("delta_mi", F.when(F.col("grp") != "3", F.col("delta_mi"))), "delta_mi"))
RAW_P = reg("method, grp", src="al", least=5, p=True).replace(r(correlation_p("rr", "n"), "p"), f"{correlation_p('rr', 'n')} AS p")
add(
    "a29_method_significance",
    sql(f"SELECT method, count(*) AS n, {r('avg(-log10(greatest(p, 1e-300)))', 'mean_minus_log10_p', 4)} FROM ({RAW_P}) GROUP BY method", "paired", ALL),
    digits=4,
)(lambda t: reports.method_significance(regression.regression(differencing.all_methods(t.paired()), ("method", "grp"), least=5, p=True)))
GOOD = f"{S}, gd AS (SELECT * FROM deltas WHERE (entity, grp) IN (SELECT (entity, grp) FROM s WHERE r2 > 0.01))"


def _good(t: Tables):
    return filters.matching_keys(t.deltas(), regression.regression(t.deltas(), ("entity", "grp"), least=10), F.col("r2") > 0.01)


add("a41_filtered_by_group", sql(reg("grp", src="gd", entity="entity", p=True), more=GOOD))(lambda t: regression.regression(_good(t), ("grp",), entity="entity", p=True))
add("a41_filtered_pairs", sql(reg("entity, grp", src="gd", p=True), more=GOOD))(lambda t: regression.regression(_good(t), ("entity", "grp"), p=True))
