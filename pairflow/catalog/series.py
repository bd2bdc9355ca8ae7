"""Cleaning, resampling, trend and cross-correlation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairflow.operators import cleaning, crosscorr, resample, trend

from .base import Tables, add, normal_p, r, sql

OUT = """oq AS (SELECT entity, count(*) AS n, quantile_cont(wte, 0.25) AS lo, quantile_cont(wte, 0.75) AS hi FROM levels GROUP BY entity),
oo AS (SELECT l.*, coalesce(n >= 5 AND hi > lo AND (wte < lo - {k} * (hi - lo) OR wte > hi + {k} * (hi - lo)), false) AS is_outlier FROM levels l JOIN oq USING (entity))"""
add("t3_iqr_outliers", sql(f"SELECT entity, date, {r('wte')}, is_outlier FROM oo", "levels", OUT.format(k="1.0")))(lambda t: cleaning.iqr_outliers(t.levels(), k=1.0))
add("t3_without_outliers", sql(f"SELECT entity, date, {r('wte')} FROM oo WHERE NOT is_outlier", "levels", OUT.format(k="3.0")))(lambda t: cleaning.without_outliers(t.levels()))
add(
    "t4_global_outliers",
    sql(
        f"""SELECT entity, date, {r("wte")}, z AS z_outlier, w AS iqr_outlier, z OR w AS any_outlier, z AND w AS both_outlier FROM (
        SELECT l.*, coalesce(abs(wte - m) / s > 2, false) AS z, coalesce(wte < lo - 0.5 * (hi - lo) OR wte > hi + 0.5 * (hi - lo), false) AS w FROM levels l,
        (SELECT avg(wte) AS m, stddev_pop(wte) AS s, quantile_cont(wte, 0.25) AS lo, quantile_cont(wte, 0.75) AS hi FROM levels))""",
        "levels",
    ),
)(lambda t: cleaning.global_outliers(t.levels(), "wte", z=2.0, k=0.5))
add("p5_enough_data", sql(f"SELECT entity, date, {r('wte')} FROM levels WHERE entity IN (SELECT entity FROM levels GROUP BY entity HAVING count(date) >= 500 AND datediff('day', min(date), max(date)) >= 2400)", "levels"))(
    lambda t: cleaning.enough_data(t.levels(), least=500, days=2400)
)
add("p6_enough_years", sql(f"SELECT entity, date, {r('wte')} FROM levels WHERE entity IN (SELECT entity FROM levels GROUP BY entity HAVING count(*) >= 510 AND datediff('day', min(date), max(date)) / 365.25 >= 6.7)", "levels"))(
    lambda t: cleaning.enough_years(t.levels(), least=510, years=6.7)
)
QUAL = """sq AS (SELECT entity, count(date) AS n_obs, datediff('day', min(date), max(date)) / 365.25 AS record_years, median(gap) AS median_gap_days
FROM (SELECT *, datediff('day', lag(date) OVER (PARTITION BY entity ORDER BY date), date) AS gap FROM levels) GROUP BY entity)"""
add("a18_series_quality", sql(f"SELECT entity, n_obs, {r('record_years')}, {r('median_gap_days')} FROM sq", "levels", QUAL))(lambda t: cleaning.series_quality(t.levels()))
add(
    "a19_quality_overview",
    sql(
        f"""SELECT statistic, {r("value")} FROM (SELECT CAST(count(*) AS DOUBLE) AS entities, median(n_obs) AS median_n, quantile_cont(n_obs, 0.75) AS p75_n, CAST(max(n_obs) AS DOUBLE) AS max_n, median(record_years) AS median_years,
        round_even(avg(CASE WHEN n_obs <= 2 THEN 1.0 ELSE 0 END) * 100, 2) AS pct_n_le_2, round_even(avg(CASE WHEN median_gap_days <= 30 THEN 1.0 ELSE 0 END) * 100, 2) AS pct_gap_le_30,
        round_even(avg(CASE WHEN median_gap_days <= 90 THEN 1.0 ELSE 0 END) * 100, 2) AS pct_gap_le_90 FROM sq)
        UNPIVOT (value FOR statistic IN (entities, median_n, p75_n, max_n, median_years, pct_n_le_2, pct_gap_le_30, pct_gap_le_90))""",
        "levels",
        QUAL,
    ),
)(lambda t: cleaning.quality_overview(cleaning.series_quality(t.levels())))
add(
    "a20_quality_report",
    sql(
        f"""SELECT count(*) AS entities, count(*) FILTER (n = 1) AS single_point, count(*) FILTER (n = 2) AS two_point, {r("avg(n)", "mean_n")}, {r("median(n)", "median_n")}, {r("avg(span)", "mean_span_days")}, {r("avg(per_year)", "mean_per_year")} FROM (
        SELECT entity, CAST(sum(n) AS BIGINT) AS n, datediff('day', min(a), max(b)) AS span, avg(n) AS per_year FROM (SELECT entity, year(date) AS y, count(*) AS n, min(date) AS a, max(date) AS b FROM levels GROUP BY 1, 2) GROUP BY entity)""",
        "levels",
    ),
)(lambda t: cleaning.quality_report(t.levels()))
add("a21_months_of_year", sql("SELECT month(date) AS month, count(*) AS n FROM levels GROUP BY 1", "levels"))(lambda t: cleaning.months_of_year(t.levels()))

PCHIP = """k0 AS (SELECT entity, date, wte AS y, CAST(datediff('day', DATE '1970-01-01', date) AS DOUBLE) AS x FROM {src}),
k1 AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(date) OVER w AS nx, lead(x) OVER w - x AS h, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS s FROM k0 WINDOW w AS (PARTITION BY entity ORDER BY date)),
k2 AS (SELECT *, lag(h) OVER w AS hp, lag(s) OVER w AS sp, lead(h) OVER w AS hn, lead(s) OVER w AS sn, lag(h, 2) OVER w AS hpp, lag(s, 2) OVER w AS spp FROM k1 WINDOW w AS (PARTITION BY entity ORDER BY date)),
k3 AS (SELECT *, ((2 * h + hn) * s - h * sn) / (h + hn) AS e0, ((2 * hp + hpp) * sp - hp * spp) / (hp + hpp) AS e1 FROM k2),
k4 AS (SELECT *, CASE WHEN sp IS NULL THEN CASE WHEN hn IS NULL THEN s WHEN sign(e0) <> sign(s) THEN 0 WHEN sign(s) <> sign(sn) AND abs(e0) > 3 * abs(s) THEN 3 * s ELSE e0 END
  WHEN s IS NULL THEN CASE WHEN hpp IS NULL THEN sp WHEN sign(e1) <> sign(sp) THEN 0 WHEN sign(sp) <> sign(spp) AND abs(e1) > 3 * abs(sp) THEN 3 * sp ELSE e1 END
  WHEN sp * s <= 0 THEN 0 ELSE ((2 * h + hp) + (h + 2 * hp)) / ((2 * h + hp) / sp + (h + 2 * hp) / s) END AS m FROM k3),
k5 AS (SELECT *, lead(m) OVER (PARTITION BY entity ORDER BY date) AS m1, coalesce(CAST(nx - 1 AS DATE), date) AS e FROM k4),
k6 AS (SELECT *, unnest({grid}) AS g FROM k5),
pc AS (SELECT entity, CAST(g AS DATE) AS date, (CAST(datediff('day', DATE '1970-01-01', CAST(g AS DATE)) AS DOUBLE) - x) / h AS t, y, y1, h, m, m1 FROM k6 WHERE g >= date AND g <= e),
pv AS (SELECT entity, date, coalesce(y * (1 + 2 * t) * (1 - t) * (1 - t) + h * m * t * (1 - t) * (1 - t) + y1 * t * t * (3 - 2 * t) + h * m1 * t * t * (t - 1), y) AS wte FROM pc)"""
MONTHLY = "list_transform(generate_series(date_trunc('month', date), date_trunc('month', e), INTERVAL 1 MONTH), lambda d: d + INTERVAL 14 DAY)"
add("t1_pchip_monthly", sql(f"SELECT entity, date, {r('wte')} FROM pv", "levels", PCHIP.format(src="levels", grid=MONTHLY)))(lambda t: resample.pchip(t.levels()))
add("t2_pchip_daily", sql(f"SELECT entity, date, {r('wte')} FROM pv", "levels", PCHIP.format(src="levels", grid="generate_series(CAST(date AS TIMESTAMP), CAST(e AS TIMESTAMP), INTERVAL 1 DAY)")))(
    lambda t: resample.pchip(t.levels(), grid="daily")
)
add(
    "j4_resampled_with_attributes",
    sql(f"SELECT p.entity, p.date, {r('p.wte', 'wte')}, {r('s.s_acctbal', 'gse')} FROM pv p LEFT JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS entity, s_acctbal FROM supplier) s USING (entity)", "levels", PCHIP.format(src="levels", grid=MONTHLY)),
)(lambda t: resample.with_attributes(resample.pchip(t.levels()), t.read("supplier").select(F.col("s_suppkey").cast("string").alias("entity"), F.col("s_acctbal").alias("gse")), ("gse",)).select("entity", "date", "wte", "gse"))
add(
    "a22_compare_series",
    sql(
        f"""SELECT count(*) AS entities_before, count(b.n) AS entities_after, CAST(sum(a.n) AS BIGINT) AS records_before, CAST(sum(b.n) AS BIGINT) AS records_after, {r("sum(b.n) / sum(a.n)", "ratio")}, {r("avg(abs(a.m - b.m))", "mean_abs_change")}
        FROM (SELECT entity, count(*) AS n, avg(wte) AS m FROM levels GROUP BY 1) a LEFT JOIN (SELECT entity, count(*) AS n, avg(wte) AS m FROM pv GROUP BY 1) b USING (entity)""",
        "levels",
        PCHIP.format(src="levels", grid=MONTHLY),
    ),
)(lambda t: resample.compare_series(t.levels(), resample.pchip(t.levels())))

MK = """i{n} AS (SELECT {k}, x, row_number() OVER (PARTITION BY {k} ORDER BY d) - 1 AS i FROM ({src})),
s{n} AS (SELECT a.{k}, sum(sign(b.x - a.x)) AS s, median((b.x - a.x) / (b.i - a.i)) AS slope FROM i{n} a JOIN i{n} b ON a.{k} = b.{k} AND a.i < b.i GROUP BY 1),
m{n} AS (SELECT *, (n * (n - 1) * (2 * n + 5) - t) / 18.0 AS var_s FROM (SELECT {k}, count(*) AS n, median(x) AS mx FROM i{n} GROUP BY 1) LEFT JOIN s{n} USING ({k})
  LEFT JOIN (SELECT {k}, sum(c * (c - 1) * (2 * c + 5)) AS t FROM (SELECT {k}, x, count(*) AS c FROM i{n} GROUP BY 1, 2) GROUP BY 1) USING ({k})),
k{n} AS (SELECT *, CASE WHEN s = 0 THEN 0 ELSE (s - sign(s)) / sqrt(var_s) END AS z, 2.0 * s / (n * (n - 1)) AS tau, mx - (n - 1) / 2.0 * slope AS intercept FROM m{n})"""
FIG = f"n, {r('CAST(s AS DOUBLE)', 's')}, {r('var_s')}, {r('z')}, {r('tau')}, {r('slope')}, {r('intercept')}"
FIG += f", {r(normal_p('z'), 'p')}, CASE WHEN n < 4 THEN 'insufficient data' WHEN {normal_p('z')} >= 0.05 THEN 'no trend' WHEN z > 0 THEN 'increasing' ELSE 'decreasing' END AS trend"
FIG += f", n >= 4 AND {normal_p('z')} < 0.05 AS significant"
MLEV_MK = MK.format(n=1, k="entity", src="SELECT entity, date AS d, wte AS x FROM mlev")
add("a12_mann_kendall", sql(f"SELECT entity, {FIG} FROM k1", "mlev", MLEV_MK))(lambda t: trend.mann_kendall(t.mlev(), "entity", value="wte"))
add("u2_trend_labels", sql(f"SELECT entity, {FIG} FROM k1", "mlev", MLEV_MK))(lambda t: trend.mann_kendall(t.mlev(), "entity", value="wte"))
LT = MLEV_MK + """, gp AS (SELECT entity, median(g) AS gap, min(date) AS first_date, max(date) AS last_date FROM (SELECT *, datediff('day', lag(date) OVER (PARTITION BY entity ORDER BY date), date) AS g FROM mlev) GROUP BY 1 HAVING count(*) >= 10),
lt AS (SELECT *, slope * 365.25 / gap AS sen_slope_yr, round_even(datediff('day', first_date, last_date) / 365.25, 2) AS year_span FROM k1 JOIN gp USING (entity))"""
add("a13_level_trends", sql(f"SELECT entity, {FIG}, first_date, last_date, {r('sen_slope_yr')}, {r('year_span')} FROM lt", "mlev", LT))(lambda t: trend.level_trends(t.mlev()))
add("a14_flow_trends", sql(f"SELECT grp, {FIG}, {r('12 * slope', 'sen_slope_yr')} FROM k1", "mflow", MK.format(n=1, k="grp", src="SELECT grp, date AS d, avg(q) AS x FROM mflow GROUP BY 1, 2")))(lambda t: trend.group_trends(t.mflow()))
add(
    "a15_group_level_trends",
    sql(f"SELECT grp, {FIG}, {r('12 * slope', 'sen_slope_yr')}, n_entities FROM k1 JOIN (SELECT grp, count(DISTINCT entity) AS n_entities FROM paired GROUP BY 1) USING (grp)", "paired", MK.format(n=1, k="grp", src="SELECT grp, date AS d, avg(wte) AS x FROM paired GROUP BY 1, 2")),
)(lambda t: trend.group_trends(t.paired(), value="wte", entity="entity"))
ANN = MK.format(n=1, k="grp", src="SELECT grp, year AS d, x FROM ya WHERE grp IN (SELECT grp FROM yf)")
ANN = f"ya AS (SELECT grp, year(date) AS year, avg(q) AS x, count(DISTINCT month(date)) AS months FROM flows GROUP BY 1, 2), yf AS (SELECT grp, count(*) AS years, CAST(sum(months) AS BIGINT) AS months, avg(x) AS mean_flow FROM ya GROUP BY 1 HAVING count(*) >= 5 AND sum(months) >= 12), {ANN}"
add("a16_annual_trends", sql(f"SELECT grp, {FIG}, years, months, {r('mean_flow')}, {r('CASE WHEN mean_flow > 0 THEN 100 * slope / mean_flow END', 'pct_of_mean')} FROM k1 JOIN yf USING (grp)", "flows", ANN))(lambda t: trend.annual_trends(t.flows()))
add(
    "a17_trend_overview",
    sql(
        f"""SELECT grp, count(*) AS n, {r("100 * avg(CASE WHEN sen_slope_yr < 0 THEN 1.0 ELSE 0 END)", "declining_pct")}, {r("quantile_cont(sen_slope_yr, 0.25)", "q25")}, {r("median(sen_slope_yr)", "median")}, {r("quantile_cont(sen_slope_yr, 0.75)", "q75")}
        FROM lt JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS entity, CAST(s_nationkey AS VARCHAR) AS grp FROM supplier) USING (entity) WHERE year_span >= 3 GROUP BY grp""",
        "mlev",
        LT,
    ),
)(lambda t: trend.trend_overview(trend.level_trends(t.mlev(), p=False), t.ents()))
LIN = "ln AS (SELECT *, CAST(datediff('day', min(date) OVER (PARTITION BY entity), date) AS DOUBLE) AS day FROM mlev), lf AS (SELECT entity, count(*) AS n, regr_sxy(wte, day) / regr_sxx(wte, day) * 365 AS slope_yr, pow(regr_sxy(wte, day), 2) / regr_sxx(wte, day) / regr_syy(wte, day) AS r2 FROM ln GROUP BY 1 HAVING count(*) >= 24)"
add("a47_linear_trends", sql(f"SELECT entity, n, {r('slope_yr')}, {r('r2')} FROM lf", "mlev", LIN))(lambda t: trend.linear_trends(t.mlev()))
add(
    "a46_rank_sum",
    sql(
        f"""SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, {r("u")}, {r("sign(u - n1 * n2 / 2) * greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - t / ((n1 + n2) * (n1 + n2 - 1))))", "z")}, {r(normal_p("zz"), "p")} FROM (SELECT *, sign(u - n1 * n2 / 2) * greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - t / ((n1 + n2) * (n1 + n2 - 1)))) AS zz FROM (
        SELECT sum(f) AS n1, sum(1 - f) AS n2, sum(rk * f) - sum(f) * (sum(f) + 1) / 2 AS u, 0.0 + (SELECT sum(c * c * c - c) FROM (SELECT count(*) AS c FROM lf GROUP BY r2)) AS t
        FROM (SELECT CAST(CASE WHEN slope_yr < 0 THEN 1 ELSE 0 END AS DOUBLE) AS f, rank() OVER (ORDER BY r2) + (count(*) OVER (PARTITION BY r2) - 1) / 2.0 AS rk FROM lf)))""",
        "mlev",
        LIN,
    ),
)(lambda t: trend.rank_sum(trend.linear_trends(t.mlev()), F.col("slope_yr") < 0, "r2"))

IX = f"""ix AS (SELECT *, (delta_wte - avg(delta_wte) OVER p) / (stddev_pop(delta_wte) OVER p + 1e-10) AS zx, (delta_q - avg(delta_q) OVER p) / (stddev_pop(delta_q) OVER p + 1e-10) AS zy FROM (
  SELECT grp, entity, date, delta_wte, delta_q, row_number() OVER (PARTITION BY grp, entity ORDER BY date) AS i, count(*) OVER (PARTITION BY grp, entity) AS n FROM deltas) WINDOW p AS (PARTITION BY grp, entity)),
cc AS (SELECT a.grp, a.entity, a.n, CAST(l.lag AS INT) AS lag, sum(a.zx * b.zy) / a.n AS c FROM ix a, (SELECT unnest(range(-12, 13)) AS lag) l, ix b WHERE a.n >= 36 AND a.grp = b.grp AND a.entity = b.entity AND a.i - l.lag = b.i GROUP BY 1, 2, 3, 4),
lc AS (SELECT a.grp, a.entity, CAST(l.lag AS INT) AS lag, count(*) AS n, regr_sxy(b.zy, a.zx) / sqrt(regr_sxx(b.zy, a.zx)) / sqrt(regr_syy(b.zy, a.zx)) AS r FROM ix a, (SELECT unnest(range(0, 13)) AS lag) l, ix b
  WHERE a.n >= 36 AND a.grp = b.grp AND a.entity = b.entity AND a.i + l.lag = b.i GROUP BY 1, 2, 3 HAVING count(*) >= 5),
pk AS (SELECT grp, entity, max(n) AS n_obs, arg_min(lag, struct_pack(a := -abs(c), b := lag)) AS best_lag, arg_min(c, struct_pack(a := -abs(c), b := lag)) AS best, max(CASE WHEN lag = 0 THEN c END) AS at_0 FROM cc GROUP BY 1, 2)"""


def _curves(t: Tables):
    return crosscorr.cross_correlation(t.deltas(), limit=12)


add("t7_cross_correlation", sql(f"SELECT grp, entity, n, lag, {r('c')} FROM cc", "deltas", IX))(_curves)
add("t8_lagged_correlation", sql(f"SELECT grp, entity, lag, n, {r('r')} FROM lc", "deltas", IX))(lambda t: crosscorr.lagged_correlation(t.deltas(), limit=12))
add("t9_peaks", sql(f"SELECT grp, entity, n_obs, best_lag, {r('best')}, {r('at_0')}, abs(at_0) > 1.96 / sqrt(n_obs) AS significant_at_0 FROM pk", "deltas", IX))(lambda t: crosscorr.peaks(_curves(t)))
add("t9_peak_overview", sql(f"SELECT grp, count(*) AS n, {r('median(best_lag)', 'median_lag')}, {r('avg(best_lag)', 'mean_lag')}, {r('stddev_pop(best_lag)', 'std_lag')}, {r('median(best)', 'median_best')}, {r('avg(best)', 'mean_best')} FROM pk GROUP BY GROUPING SETS ((grp), ())", "deltas", IX))(
    lambda t: crosscorr.peak_overview(crosscorr.peaks(_curves(t)))
)
add("t10_mean_curve", sql(f"SELECT grp, lag, count(*) AS n, {r('avg(c)', 'mean')}, {r('stddev_pop(c)', 'std')} FROM cc WHERE lag % 3 = 0 GROUP BY 1, 2", "deltas", IX))(lambda t: crosscorr.mean_curve(_curves(t), step=3))
add("a55_peaks_in_years", sql(f"SELECT grp, entity, metric, {r('value')} FROM (SELECT grp, entity, best_lag / 365.25 AS lag_years, best FROM pk) UNPIVOT (value FOR metric IN (lag_years, best))", "deltas", IX))(
    lambda t: crosscorr.peaks(_curves(t)).select("grp", "entity", (F.col("best_lag") / 365.25).alias("lag_years"), "best").unpivot(["grp", "entity"], ["lag_years", "best"], "metric", "value")
)
