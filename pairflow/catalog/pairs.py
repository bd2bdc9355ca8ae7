"""Pairing, regression, information and comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairflow.operators import differencing, filters, information, pairing, regression, reports

from .base import Tables, add, correlation_p, r, sql

CLASSES = (("low", 0.0, 0.01), ("middle", 0.01, 0.05), ("high", 0.05, None))


def reg(keys: str, x: str = "delta_wte", y: str = "delta_q", src: str = "deltas", least: int = 2, entity: str = "", where: str = "true", p: bool = False) -> str:
    """Least squares by key as SQL; rounded figures."""
    k = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    e = f", count(DISTINCT {entity}) AS n_entities" if entity else ""
    n = (", n_entities" if entity else "") + (f", {r(correlation_p('rr', 'n'), 'p')}" if p else "")
    return f"""SELECT {k}n, {r("slope")}, {r("my - slope * mx", "intercept")}, {r("rr", "r")}, {r("rr * rr", "r2")},
      {r("CASE WHEN n > 2 THEN sqrt(greatest(0, (1 - rr * rr) * syy / sxx / (n - 2))) ELSE 0 END", "std_err")}{n} FROM (
      SELECT *, sxy / sxx AS slope, sxy / sqrt(sxx) / sqrt(syy) AS rr FROM (
        SELECT {k}count(*) AS n, regr_sxx({y}, {x}) AS sxx, regr_syy({y}, {x}) AS syy, regr_sxy({y}, {x}) AS sxy, avg({x}) AS mx, avg({y}) AS my{e}
        FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL AND {where} {group} HAVING count(*) >= {least} AND min({x}) < max({x}) AND min({y}) < max({y})))"""


def stat(src: str = "deltas", x: str = "delta_wte", least: int = 10) -> str:
    """Unrounded pair statistics as a CTE body."""
    return f"""SELECT entity, grp, count(*) AS n, regr_sxy(delta_q, {x}) / regr_sxx(delta_q, {x}) AS slope,
      pow(regr_sxy(delta_q, {x}), 2) / regr_sxx(delta_q, {x}) / regr_syy(delta_q, {x}) AS r2 FROM {src}
      WHERE {x} IS NOT NULL AND delta_q IS NOT NULL GROUP BY entity, grp HAVING count(*) >= {least} AND min({x}) < max({x}) AND min(delta_q) < max(delta_q)"""


def mi(src: str, x: str, bins: int = 10, keys: str = "entity, grp", least: int = 10) -> str:
    """Mutual information by key as a CTE body."""
    at = lambda c: f"coalesce(least(CAST(floor(({c} - min({c}) OVER p) * {bins} / nullif(max({c}) OVER p - min({c}) OVER p, 0)) AS INT), {bins - 1}), 0)"
    return f"""SELECT {keys}, n, CASE WHEN n >= {least} THEN greatest(sum(c / n * ln(c * n / (cx * cy))), 0) END AS mi FROM (
      SELECT *, sum(c) OVER (PARTITION BY {keys}, bx) AS cx, sum(c) OVER (PARTITION BY {keys}, by_) AS cy FROM (
        SELECT {keys}, n, bx, by_, CAST(count(*) AS DOUBLE) AS c FROM (
          SELECT {keys}, count(*) OVER p AS n, {at(x)} AS bx, {at("delta_q")} AS by_ FROM {src}
          WHERE {x} IS NOT NULL AND delta_q IS NOT NULL WINDOW p AS (PARTITION BY {keys}))
        GROUP BY ALL)) GROUP BY {keys}, n"""


add("a1_monthly_response", sql(f"SELECT grp, date, {r('q')}, bfd FROM mflow", "mflow"))(lambda t: t.mflow())
add("j1_paired", sql(f"SELECT entity, grp, date, {r('wte')}, {r('q')}, bfd FROM paired", "paired"))(lambda t: t.paired())
add(
    "j1_paired_daily_flags",
    sql(f"SELECT e.entity, e.grp, l.date, {r('l.wte', 'wte')}, {r('f.q', 'q')}, coalesce(f.bfd, 0) AS bfd FROM levels l JOIN ents e ON l.entity = e.entity JOIN flows f ON f.grp = e.grp AND f.date = l.date", "ents"),
)(lambda t: pairing.pair(pairing.with_group(t.levels(), t.ents()), t.flows().drop("bfd"), t.flows().select("grp", "date", "bfd")).select("entity", "grp", "date", "wte", "q", "bfd"))
add("j2_levels_with_group", sql(f"SELECT m.entity, e.grp, m.date, {r('m.wte', 'wte')} FROM mlev m LEFT JOIN ents e ON m.entity = e.entity", "mlev"))(lambda t: pairing.with_group(t.mlev(), t.ents()).select("entity", "grp", "date", "wte"))
add("w1_baseline", sql(f"SELECT DISTINCT entity, grp, {r('wte0')}, {r('q0')} FROM based", "based"))(lambda t: t.based().select("entity", "grp", "wte0", "q0").distinct())
add(
    "w1_baseline_daily",
    sql(
        f"""SELECT DISTINCT entity, {r("first_value(CASE WHEN bfd = 1 THEN wte END IGNORE NULLS) OVER w", "wte0")}, {r("first_value(CASE WHEN bfd = 1 THEN q END IGNORE NULLS) OVER w", "q0")}
        FROM (SELECT e.entity, e.grp, l.date, l.wte, f.q, f.bfd FROM levels l JOIN ents e ON l.entity = e.entity JOIN flows f ON f.grp = e.grp AND f.date = l.date)
        WINDOW w AS (PARTITION BY entity ORDER BY date, grp ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
        "ents",
    ),
)(lambda t: pairing.with_baseline(pairing.pair(pairing.with_group(t.levels(), t.ents()), t.flows())).select("entity", "wte0", "q0").distinct())
add("t5_deltas", sql(f"SELECT entity, grp, date, {r('delta_wte')}, {r('delta_q')} FROM deltas"))(lambda t: t.deltas().select("entity", "grp", "date", "delta_wte", "delta_q"))
add("j5_lag_one_year", sql(f"SELECT entity, grp, date, {r('delta_q')}, {r('delta_wte_lag')} FROM lag1", "lag1"))(lambda t: t.lag().select("entity", "grp", "date", "delta_q", "delta_wte_lag"))
add("j5_lag_three_months", sql(f"SELECT entity, grp, date, {r('delta_q')}, {r('delta_wte_lag')} FROM lag3m", "lag3m"))(lambda t: t.lag(3, "months").select("entity", "grp", "date", "delta_q", "delta_wte_lag"))
add(
    "j5_lag_days",
    sql(f"SELECT a.entity, a.date, {r('a.wte', 'wte')}, {r('b.wte', 'wte_lag')} FROM levels a JOIN levels b ON a.entity = b.entity AND a.date - 30 = b.date", "levels"),
)(lambda t: pairing.lagged(t.levels(), 30, "days", value="wte").select("entity", "date", "wte", "wte_lag"))
add(
    "a2_pair_summary",
    sql(
        f"""SELECT entity, grp, min(date) AS first_date, max(date) AS last_date, count(date) AS n, {r("avg(wte)", "wte_mean")}, {r("stddev_samp(wte)", "wte_std")}, {r("min(wte)", "wte_min")}, {r("max(wte)", "wte_max")},
        {r("avg(q)", "q_mean")}, {r("stddev_samp(q)", "q_std")}, {r("min(q)", "q_min")}, {r("max(q)", "q_max")}, CAST(sum(bfd) AS BIGINT) AS n_flagged, datediff('day', min(date), max(date)) AS span_days FROM paired GROUP BY entity, grp""",
        "paired",
    ),
)(lambda t: pairing.pair_summary(t.paired()))
add("a3_regression_by_group", sql(reg("grp", least=10, entity="entity", p=True)))(
    lambda t: regression.regression(t.deltas(), ("grp",), least=10, entity="entity", p=True)
)
add("a4_regression_by_pair", sql(reg("entity, grp", least=10, p=True)))(lambda t: regression.regression(t.deltas(), ("entity", "grp"), least=10, p=True))
RANKED = """SELECT entity, grp, count(*) AS n, regr_sxy(b, a) / sqrt(regr_sxx(b, a)) / sqrt(regr_syy(b, a)) AS spearman FROM (SELECT entity, grp,
  rank() OVER (PARTITION BY entity, grp ORDER BY delta_wte) + (count(*) OVER (PARTITION BY entity, grp, delta_wte) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY entity, grp ORDER BY delta_q) + (count(*) OVER (PARTITION BY entity, grp, delta_q) - 1) / 2.0 AS b FROM deltas)
  GROUP BY entity, grp HAVING count(*) >= 10"""
add("a5_spearman_by_pair", sql(f"SELECT entity, grp, n, {r('spearman')} FROM ({RANKED})"))(lambda t: regression.spearman(t.deltas(), ("entity", "grp"), least=10))
add(
    "u1_p_values",
    sql(
        f"SELECT * FROM ({reg('entity, grp', least=10, p=True)}) JOIN (SELECT entity, grp, {r('spearman')}, {r(correlation_p('spearman', 'n'), 'spearman_p')} FROM sr) USING (entity, grp)",
        more=f"sr AS ({RANKED})",
    ),
)(lambda t: regression.regression_by_pair(t.deltas(), p=True))
add(
    "a6_regression_overview",
    sql(
        f"""SELECT count(*) AS n, {r("avg(r2)", "mean_r2")}, {r("median(r2)", "median_r2")}, {r("stddev_samp(r2)", "std_r2")}, {r("avg(slope)", "mean_slope")}, {r("median(slope)", "median_slope")},
        count(*) FILTER (slope > 0) AS positive, {r("100 * avg(CASE WHEN slope > 0 THEN 1.0 ELSE 0 END)", "positive_pct")} FROM s""",
        more=f"s AS ({stat()})",
    ),
)(lambda t: regression.regression_overview(regression.regression(t.deltas(), ("entity", "grp"), least=10)))
SEASON = "CASE WHEN month(date) IN (12, 1, 2) THEN 'Winter' WHEN month(date) <= 5 THEN 'Spring' WHEN month(date) <= 8 THEN 'Summer' ELSE 'Fall' END"
PERIODS = f"per AS (SELECT *, 'Seasonal' AS period_type, {SEASON} AS period FROM deltas UNION ALL SELECT *, 'Monthly', strftime(date, '%b') FROM deltas)"
add("a10_seasonal_and_monthly", sql(reg("grp, period_type, period", src="per", least=5), more=PERIODS))(lambda t: regression.seasonal_and_monthly(t.deltas()))
add(
    "u_combined_summary",
    sql(
        f"SELECT grp, 'Overall' AS period_type, 'All' AS period, n, slope, r2 FROM ({reg('grp', least=10)}) UNION ALL SELECT grp, period_type, period, n, slope, r2 FROM ({reg('grp, period_type, period', src='per', least=5)})",
        more=PERIODS,
    ),
)(lambda t: regression.combined_summary(regression.regression(t.deltas(), ("grp",), least=10), regression.seasonal_and_monthly(t.deltas())))
add(
    "a36_season_report",
    sql(
        f"""SELECT period, count(*) AS n, {r("100 * avg(CASE WHEN slope > 0 THEN 1.0 ELSE 0 END)", "slope_positive_pct")}, {r("avg(r2)", "r2_mean")} FROM s GROUP BY GROUPING SETS ((period), ())""",
        more=f"""{PERIODS}, s AS (SELECT grp, period, regr_sxy(delta_q, delta_wte) / regr_sxx(delta_q, delta_wte) AS slope, pow(regr_sxy(delta_q, delta_wte), 2) / regr_sxx(delta_q, delta_wte) / regr_syy(delta_q, delta_wte) AS r2
        FROM per WHERE period_type = 'Seasonal' GROUP BY 1, 2 HAVING count(*) >= 5 AND min(delta_wte) < max(delta_wte) AND min(delta_q) < max(delta_q))""",
    ),
)(lambda t: reports.season_report(regression.seasonal_and_monthly(t.deltas()).where("period_type = 'Seasonal'"), ["slope"], ["r2"]))
add(
    "a37_season_means",
    sql(
        f"""SELECT period, {r("avg(r2)", "mean_r2")}, {r("avg(slope)", "mean_slope")} FROM s GROUP BY period""",
        more=f"""{PERIODS}, s AS (SELECT grp, period, regr_sxy(delta_q, delta_wte) / regr_sxx(delta_q, delta_wte) AS slope, pow(regr_sxy(delta_q, delta_wte), 2) / regr_sxx(delta_q, delta_wte) / regr_syy(delta_q, delta_wte) AS r2
        FROM per GROUP BY 1, 2 HAVING count(*) >= 5 AND min(delta_wte) < max(delta_wte) AND min(delta_q) < max(delta_q))""",
    ),
)(lambda t: regression.seasonal_and_monthly(t.deltas()).groupBy("period").agg(F.avg("r2").alias("mean_r2"), F.avg("slope").alias("mean_slope")))
add("a30_pooled", sql(reg("", least=5, entity="entity")))(lambda t: regression.regression(t.deltas(), (), least=5, entity="entity"))
add("a31_sum_of_slopes", sql(f"SELECT {r('sum(s)', 'slope')}, count(*) AS n_groups FROM (SELECT grp, regr_sxy(delta_q, delta_wte) / regr_sxx(delta_q, delta_wte) AS s FROM deltas GROUP BY grp HAVING count(*) >= 30)"))(
    lambda t: regression.regression(t.deltas(), ("grp",), least=30).agg(F.sum("slope").alias("slope"), F.count("*").alias("n_groups"))
)
NORMAL = "norm AS (SELECT *, delta_q / q0 AS rel_q FROM deltas WHERE q0 > 0)"
add("a32_normalised_pool", sql(reg("", y="rel_q", src="norm"), more=NORMAL))(lambda t: regression.regression(t.deltas().where("q0 > 0").withColumn("rel_q", F.col("delta_q") / F.col("q0")), (), y="rel_q"))
add("a32_declining_only", sql(reg("grp", y="rel_q", src="norm", where="delta_wte < 0"), more=NORMAL))(
    lambda t: regression.regression(t.deltas().where("q0 > 0 and delta_wte < 0").withColumn("rel_q", F.col("delta_q") / F.col("q0")), ("grp",), y="rel_q")
)
ORD = "ord AS (SELECT *, CAST(datediff('day', DATE '1970-01-01', date) + 719163 AS DOUBLE) AS day, month(date) AS month FROM deltas)"
add("a35_trend_by_month", sql(reg("grp, month", x="day", src="ord"), more=ORD), digits=6)(
    lambda t: regression.regression(t.deltas().withColumns({"day": (F.unix_date("date") + 719163).cast("double"), "month": F.month("date")}), ("grp", "month"), x="day")
)
add(
    "a39_group_summary",
    sql(
        f"""SELECT grp, count(r2) AS n_pairs, {r("avg(r2)", "r2_mean", 4)}, {r("stddev_samp(r2)", "r2_std", 4)}, {r("max(r2)", "r2_max", 4)}, {r("min(r2)", "r2_min", 4)}, {r("avg(n)", "n_mean", 4)}, CAST(sum(n) AS BIGINT) AS n_sum FROM s GROUP BY grp""",
        more=f"s AS ({stat()})",
    ),
)(lambda t: reports.group_summary(regression.regression(t.deltas(), ("entity", "grp"), least=10)))
CASES = "CASE WHEN r2 >= 0 AND r2 < 0.01 THEN 'low' WHEN r2 >= 0.01 AND r2 < 0.05 THEN 'middle' WHEN r2 >= 0.05 THEN 'high' END"
add("a40_class_regressions", sql(reg("grp, r2_class", src="cl"), more=f"s AS ({stat()}), cl AS (SELECT d.*, {CASES} AS r2_class FROM deltas d JOIN s USING (entity, grp))"))(
    lambda t: reports.class_regressions(t.deltas(), regression.regression(t.deltas(), ("entity", "grp"), least=10), CLASSES)
)
add(
    "a38_pair_correlations",
    sql(f"SELECT s.entity, s.grp, s.n, {r('r2')}, {r('lat')} FROM s JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS entity, s_acctbal AS lat FROM supplier) USING (entity)", more=f"s AS ({stat()})"),
)(lambda t: regression.regression(t.deltas(), ("entity", "grp"), least=10).join(t.read("supplier").select(F.col("s_suppkey").cast("string").alias("entity"), F.col("s_acctbal").alias("lat")), "entity").select("entity", "grp", "n", "r2", "lat"))
add("a7_mutual_information", sql(f"SELECT entity, grp, n, {r('mi')} FROM m", more=f"m AS ({mi('deltas', 'delta_wte')})"))(lambda t: information.mutual_information(t.deltas()))
add("a9_mutual_information_20", sql(f"SELECT entity, grp, n, {r('mi')} FROM m", more=f"m AS ({mi('deltas', 'delta_wte', 20)})"))(lambda t: information.mutual_information(t.deltas(), bins=20))
PEARSON = "SELECT entity, grp, regr_sxy(delta_q, {x}) / sqrt(regr_sxx(delta_q, {x})) / sqrt(regr_syy(delta_q, {x})) AS pearson FROM {src} GROUP BY 1, 2 HAVING count(*) >= 2 AND min({x}) < max({x}) AND min(delta_q) < max(delta_q)"
add(
    "a8_pair_information",
    sql(
        f"SELECT m.entity, m.grp, m.n, {r('mi')}, {r('pearson')}, {r('spearman')} FROM m LEFT JOIN p USING (entity, grp) LEFT JOIN s USING (entity, grp)",
        more=f"""m AS ({mi("deltas", "delta_wte")}), p AS ({PEARSON.format(x="delta_wte", src="deltas")}),
        s AS (SELECT entity, grp, regr_sxy(b, a) / sqrt(regr_sxx(b, a)) / sqrt(regr_syy(b, a)) AS spearman FROM (SELECT entity, grp,
        rank() OVER (PARTITION BY entity, grp ORDER BY delta_wte) + (count(*) OVER (PARTITION BY entity, grp, delta_wte) - 1) / 2.0 AS a,
        rank() OVER (PARTITION BY entity, grp ORDER BY delta_q) + (count(*) OVER (PARTITION BY entity, grp, delta_q) - 1) / 2.0 AS b FROM deltas) GROUP BY 1, 2 HAVING count(*) >= 2 AND min(a) < max(a) AND min(b) < max(b))""",
    ),
)(lambda t: information.pair_information(t.deltas()))
CMP = f"""ma AS ({mi("deltas", "delta_wte")}), mb AS ({mi("lag1", "delta_wte_lag")}), pa AS ({PEARSON.format(x="delta_wte", src="deltas")}), pb AS ({PEARSON.format(x="delta_wte_lag", src="lag1")}),
c AS (SELECT ma.entity, ma.grp, ma.mi AS mi_plain, pa.pearson AS pearson_plain, mb.mi AS mi_lag, pb.pearson AS pearson_lag, mb.mi - ma.mi AS delta_mi, mb.mi / (ma.mi + 1e-9) AS ratio_mi, ma.mi - abs(pa.pearson) AS gain_plain, mb.mi - abs(pb.pearson) AS gain_lag
FROM ma JOIN mb USING (entity, grp) LEFT JOIN pa USING (entity, grp) LEFT JOIN pb USING (entity, grp))"""


def _compared(t: Tables):
    return information.compare_lag(information.pair_information(t.deltas()), information.pair_information(t.lag(), x="delta_wte_lag"))


add("j6_lag_comparison", sql(f"SELECT entity, grp, {', '.join(r(c) for c in ('mi_plain', 'pearson_plain', 'mi_lag', 'pearson_lag', 'delta_mi', 'ratio_mi', 'gain_plain', 'gain_lag'))}, {r('gain_lag - gain_plain', 'delta_gain')} FROM c", "lag1", CMP), digits=6)(_compared)
OVER = f"""count(*) AS n, {r("avg(mi_plain)", "mean_mi_plain")}, {r("avg(mi_lag)", "mean_mi_lag")}, {r("avg(delta_mi)", "mean_delta_mi")}, {r("100 * avg(CASE WHEN delta_mi > 0 THEN 1.0 ELSE 0 END)", "positive_pct")} FROM c"""
add("a11_lag_overview_by_group", sql(f"SELECT grp, {OVER} GROUP BY grp", "lag1", CMP))(lambda t: information.lag_overview(_compared(t)))
add("a11_lag_overview", sql(f"SELECT {OVER}", "lag1", CMP))(lambda t: information.lag_overview(_compared(t), None))
add(
    "a42_panel",
    sql(f"""SELECT grp, count(delta_mi) AS n, {r("min(delta_mi)", "min")}, {r("avg(delta_mi)", "mean")}, {r("quantile_cont(delta_mi, 0.9)", "p90")}, {r("max(delta_mi)", "max")}, {r("100 * avg(CASE WHEN delta_mi > 0 THEN 1.0 ELSE 0 END)", "positive_pct")} FROM c GROUP BY grp""", "lag1", CMP),
)(lambda t: reports.panel(_compared(t), "delta_mi"))
add("a53_value_range", sql(f"SELECT {r('quantile_cont(v, 0.05)', 'q05')}, {r('quantile_cont(v, 0.95)', 'q95')} FROM (SELECT mi_plain AS v FROM c UNION ALL SELECT mi_lag FROM c)", "lag1", CMP))(lambda t: reports.value_range(_compared(t), ["mi_plain", "mi_lag"]))
add(
    "k6_largest_changes",
    sql(f"SELECT grp, entity, {r('delta_mi')}, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY abs(delta_mi) DESC, entity) AS rank FROM c) WHERE rank <= 3", "lag1", CMP),
)(lambda t: filters.top_n(_compared(t).withColumn("size", F.abs("delta_mi")), 3, "size").select("grp", "entity", "delta_mi", "rank"))

# differencing methods
YEAR = "yr AS (SELECT entity, grp, year(date) AS year, avg(wte) AS wte, avg(q) AS q, count(*) AS n FROM paired GROUP BY 1, 2, 3 HAVING count(*) >= 6)"
QTR = "qt AS (SELECT entity, grp, year(date) AS year, quarter(date) AS quarter, year(date) * 4 + quarter(date) AS qi, avg(wte) AS wte, avg(q) AS q FROM paired GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 3)"
STEP = "SELECT entity, grp, {cols}, {x} - lag({x}) OVER w AS delta_wte, {y} - lag({y}) OVER w AS delta_q, {i} - lag({i}) OVER w AS m FROM {src} WINDOW w AS (PARTITION BY {keys} ORDER BY {i})"
ANNUAL = f"dy AS (SELECT * FROM ({STEP.format(cols='year', x='wte', y='q', i='year', src='yr', keys='entity, grp')}) WHERE m = 1)"
SAMEQ = f"dq AS (SELECT * FROM ({STEP.format(cols='year, quarter', x='wte', y='q', i='year', src='qt', keys='entity, grp, quarter')}) WHERE m = 1)"
DES = f"qa AS (SELECT entity, grp, year, quarter, qi, wte - avg(wte) OVER p AS wte, q - avg(q) OVER p AS q FROM qt WINDOW p AS (PARTITION BY entity, grp, quarter)), ds AS (SELECT * FROM ({STEP.format(cols='qi', x='wte', y='q', i='qi', src='qa', keys='entity, grp')}) WHERE m = 1)"
ROLL = """ro AS (SELECT entity, grp, date, year(date) * 12 + month(date) AS mi, CASE WHEN count(wte) OVER w >= 10 THEN avg(wte) OVER w END AS x, CASE WHEN count(q) OVER w >= 10 THEN avg(q) OVER w END AS y FROM paired
WINDOW w AS (PARTITION BY entity, grp ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
dr AS (SELECT * FROM (SELECT entity, grp, date, x - lag(x, 12) OVER w AS delta_wte, y - lag(y, 12) OVER w AS delta_q, mi - lag(mi, 12) OVER w AS m FROM ro WINDOW w AS (PARTITION BY entity, grp ORDER BY mi)) WHERE m = 12 AND delta_wte IS NOT NULL AND delta_q IS NOT NULL)"""
ANOM = """tt AS (SELECT *, CAST(year(date) * 12 + month(date) AS DOUBLE) AS t FROM paired),
dt AS (SELECT entity, grp, date, CASE WHEN count(wte) OVER p >= 12 THEN wte - (avg(wte) OVER p + coalesce(covar_pop(wte, t) OVER p / var_pop(t) OVER p, 0) * (t - avg(t) OVER p)) ELSE wte END AS x,
CASE WHEN count(q) OVER p >= 12 THEN q - (avg(q) OVER p + coalesce(covar_pop(q, t) OVER p / var_pop(t) OVER p, 0) * (t - avg(t) OVER p)) ELSE q END AS y FROM tt WINDOW p AS (PARTITION BY entity, grp)),
an AS (SELECT entity, grp, date, (x - avg(x) OVER p) / nullif(stddev_samp(x) OVER p, 0) AS delta_wte, (y - avg(y) OVER p) / nullif(stddev_samp(y) OVER p, 0) AS delta_q FROM dt WINDOW p AS (PARTITION BY entity, grp, month(date)))"""
D = f"{r('delta_wte')}, {r('delta_q')}"
add("t6_annual", sql(f"SELECT entity, grp, year, {D} FROM dy", "paired", f"{YEAR}, {ANNUAL}"))(lambda t: differencing.annual(t.paired()).select("entity", "grp", "year", "delta_wte", "delta_q"))
add("t6_same_quarter", sql(f"SELECT entity, grp, year, quarter, {D} FROM dq", "paired", f"{QTR}, {SAMEQ}"))(lambda t: differencing.same_quarter(t.paired()).select("entity", "grp", "year", "quarter", "delta_wte", "delta_q"))
add("t6_deseasoned_quarter", sql(f"SELECT entity, grp, qi, {D} FROM ds", "paired", f"{QTR}, {DES}"))(lambda t: differencing.deseasoned_quarters(t.paired()).select("entity", "grp", "qi", "delta_wte", "delta_q"))
add("t6_rolling_year", sql(f"SELECT entity, grp, date, {D} FROM dr", "paired", ROLL))(lambda t: differencing.rolling_year(t.paired()).select("entity", "grp", "date", "delta_wte", "delta_q"))
add("t6_anomaly", sql(f"SELECT entity, grp, date, {D} FROM an", "paired", ANOM))(lambda t: differencing.anomalies(t.paired()).select("entity", "grp", "date", "delta_wte", "delta_q"))
ALL = f"""{YEAR}, {ANNUAL}, {QTR}, {SAMEQ}, {DES}, {ROLL}, {ANOM}, al AS (SELECT 'annual' AS method, entity, grp, delta_wte, delta_q FROM dy UNION ALL SELECT 'same_quarter', entity, grp, delta_wte, delta_q FROM dq
UNION ALL SELECT 'deseasoned_quarter', entity, grp, delta_wte, delta_q FROM ds UNION ALL SELECT 'rolling_year', entity, grp, delta_wte, delta_q FROM dr UNION ALL SELECT 'anomaly', entity, grp, delta_wte, delta_q FROM an)"""
add("a29_method_regressions", sql(reg("method, grp", src="al", least=5), "paired", ALL))(lambda t: regression.regression(differencing.all_methods(t.paired()), ("method", "grp"), least=5))
add(
    "a29_method_table",
    sql(
        f"""SELECT method, count(*) AS n, {r("avg(slope)", "mean_slope")}, {r("100 * avg(CASE WHEN slope > 0 THEN 1.0 ELSE 0 END)", "positive_pct")}, {r("avg(r2)", "mean_r2")}, CAST(sum(n) AS BIGINT) AS points FROM (
        SELECT method, grp, count(*) AS n, regr_sxy(delta_q, delta_wte) / regr_sxx(delta_q, delta_wte) AS slope, pow(regr_sxy(delta_q, delta_wte), 2) / regr_sxx(delta_q, delta_wte) / regr_syy(delta_q, delta_wte) AS r2
        FROM al WHERE delta_wte IS NOT NULL AND delta_q IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5) GROUP BY method""",
        "paired",
        ALL,
    ),
)(lambda t: reports.method_table(regression.regression(differencing.all_methods(t.paired()), ("method", "grp"), least=5)))
