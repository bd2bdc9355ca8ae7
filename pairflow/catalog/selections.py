"""Source, filter, selection, graph, spatial and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairflow.functions.columns import FEET_TO_METRES, minus_log10, p_text, season
from pairflow.operators import cleaning, filters, graph, places, regression, reports, spatial
from pairflow.sources import readers

from .base import Tables, add, r, sql
from .pairs import reg, stat

S = f"s AS ({stat()})"


def _stats(t: Tables):
    return regression.regression(t.deltas(), ("entity", "grp"), least=10)


# sources
add("s1_locations", "SELECT CAST(vec_id AS VARCHAR) AS entity, round(CAST(embedding[2] AS DOUBLE), 6) + 0.0 AS lat, round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS lon FROM embeddings")(
    lambda t: readers.locations(t.read("embeddings").select(F.col("vec_id").alias("Well_ID"), F.col("embedding")[1].cast("double").alias("Lat_Dec"), F.col("embedding")[0].cast("double").alias("long_dec"))).select("entity", "lat", "lon")
)
add("s4_levels", f"SELECT CAST(l_suppkey AS VARCHAR) AS entity, CAST(l_shipdate AS DATE) AS date, {r('l_extendedprice', 'wte')} FROM lineitem")(
    lambda t: readers.levels(t.read("lineitem").select(F.col("l_suppkey").alias("WellID"), F.col("l_shipdate").alias("Date"), F.col("l_extendedprice").alias("WTE")))
)
add("s5_flows_flagged", f"SELECT CAST(o_custkey AS VARCHAR) AS grp, CAST(o_orderdate AS DATE) AS date, {r('o_totalprice', 'q')}, 1 AS bfd FROM orders WHERE o_orderstatus = 'F'")(
    lambda t: readers.flows(t.read("orders").select(F.col("o_custkey").alias("Gage_ID"), F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("Discharge"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("ML_BFD")), True)
)
add("s12_crosswalk", "SELECT CAST(c_custkey AS VARCHAR) AS grp, n_name AS comid FROM customer LEFT JOIN nation ON c_custkey = n_nationkey")(
    lambda t: readers.with_crosswalk(t.read("customer").select(F.col("c_custkey").cast("string").alias("grp")), t.read("nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("comid"))).select("grp", "comid")
)
# filters
add("p1_date_range", sql(f"SELECT entity, date, {r('wte')} FROM levels WHERE date BETWEEN DATE '1996-03-01' AND DATE '1997-02-28'", "levels"))(lambda t: filters.date_range(t.levels(), "1996-03-01", "1997-02-28"))
add("p2_flagged", sql(f"SELECT grp, date, {r('q')}, bfd FROM flows WHERE bfd = 1", "flows"))(lambda t: filters.flagged(t.flows()))
add("p3_known_groups", sql(f"SELECT grp, date, {r('q')} FROM mflow WHERE grp IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey = 1)", "mflow"))(
    lambda t: filters.known_groups(t.mflow().withColumn("grp", F.concat("grp", F.lit(".0"))), t.read("nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("grp"))).select("grp", "date", "q")
)
add("p4_without_groups", sql(f"SELECT grp, date, {r('q')} FROM mflow WHERE grp NOT IN ('3', '7')", "mflow"))(lambda t: filters.without_groups(t.mflow(), ["3", "7"]).select("grp", "date", "q"))
ELEV = f"""el AS (SELECT m.entity, m.date, m.wte, s.z - m.wte * {FEET_TO_METRES} AS delta_elev, e.grp FROM mlev m JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS entity, 10 + abs(s_acctbal) / 200 AS z FROM supplier) s USING (entity) JOIN ents e USING (entity)),
eb AS (SELECT *, CASE WHEN delta_elev <= -20 THEN 0 WHEN delta_elev <= -10 THEN 1 WHEN delta_elev <= -5 THEN 2 WHEN delta_elev <= 0 THEN 3 WHEN delta_elev <= 5 THEN 4 WHEN delta_elev <= 10 THEN 5 WHEN delta_elev <= 20 THEN 6
  WHEN delta_elev <= 30 THEN 7 WHEN delta_elev <= 50 THEN 8 WHEN delta_elev <= 75 THEN 9 WHEN delta_elev <= 100 THEN 10 ELSE 11 END AS bin_order FROM el WHERE delta_elev <= 30),
bn AS (SELECT ['< -20', '-20 to -10', '-10 to -5', '-5 to 0', '0 to 5', '5 to 10', '10 to 20', '20 to 30', '30 to 50', '50 to 75', '75 to 100', '>= 100'][bin_order + 1] AS bin, bin_order, count(*) AS n, round_even(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM eb GROUP BY bin_order)"""


def _reaches(t: Tables):
    return t.read("supplier").select(F.col("s_suppkey").cast("string").alias("entity"), (10 + F.abs("s_acctbal") / 200).alias("reach_elevation"))


add("p7_elevation_filter", sql(f"SELECT entity, date, {r('wte')}, {r('delta_elev')} FROM eb", "mlev", ELEV))(lambda t: filters.elevation_filter(t.mlev(), _reaches(t))[0].select("entity", "date", "wte", "delta_elev"))
add("p7_elevation_classes", sql("SELECT bin, bin_order, n, pct + 0.0 AS pct FROM bn", "mlev", ELEV))(lambda t: filters.elevation_filter(t.mlev(), _reaches(t))[1])
add("w12_cumulative_classes", sql(f"SELECT bin, bin_order, n, pct + 0.0 AS pct, {r('sum(pct) OVER (ORDER BY bin_order)', 'cumulative_pct')} FROM bn", "mlev", ELEV))(lambda t: reports.cumulative_bins(filters.elevation_filter(t.mlev(), _reaches(t))[1]))
add(
    "a23_buffer_sweep",
    sql(f"SELECT buffer, count(*) AS n_rows, count(DISTINCT entity) AS n_entities, count(DISTINCT grp) AS n_groups, {r('100.0 * count(*) / (SELECT count(*) FROM el)', 'retention_pct')} FROM el JOIN (SELECT unnest([1.0::DOUBLE, 5, 10, 20, 30]) AS buffer) ON delta_elev <= buffer GROUP BY buffer", "mlev", ELEV.replace("mlev m", "mlev m")),
)(lambda t: reports.buffer_sweep(t.mlev().join(_reaches(t), "entity").join(t.ents(), "entity").withColumn("delta_elev", F.col("reach_elevation") - F.col("wte") * FEET_TO_METRES), (1, 5, 10, 20, 30)))
add(
    "x10_gradient",
    sql(f"SELECT entity, date, {r('wte - z', 'head')}, {r('CASE WHEN d > 0 THEN (wte - z) / d END', 'gradient')}, CASE WHEN wte > z THEN 'gaining' WHEN wte < z THEN 'losing' ELSE 'neutral' END AS direction FROM mlev JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS entity, 10 + abs(s_acctbal) / 200 AS z, s_suppkey % 5 AS d FROM supplier) USING (entity)", "mlev"),
)(lambda t: spatial.gradient(t.mlev().join(_reaches(t), "entity").withColumn("distance", F.col("entity").cast("int") % 5)).select("entity", "date", "head", "gradient", "direction"))
add("p9_known_errors", sql(f"SELECT entity, grp, date, {r('delta_wte')} FROM deltas WHERE NOT coalesce(grp = '7' AND abs(delta_wte) > 10, false)"))(
    lambda t: filters.without_known_errors(t.deltas(), t.spark.createDataFrame([("7", 10.0)], "grp string, limit double")).select("entity", "grp", "date", "delta_wte")
)
add("p10_top_share", sql(f"SELECT entity, grp, date, {r('delta_wte')} FROM deltas WHERE entity IN (SELECT entity FROM s WHERE r2 >= (SELECT quantile_cont(r2, 0.9) FROM s))", more=S))(lambda t: filters.top_share_of_entities(t.deltas(), _stats(t)).select("entity", "grp", "date", "delta_wte"))
add("p11_pairs_by_r2", sql(f"SELECT entity, grp, date, {r('delta_wte')} FROM deltas WHERE (entity, grp) IN (SELECT (entity, grp) FROM s WHERE r2 > 0.02)", more=S))(lambda t: filters.matching_keys(t.deltas(), _stats(t), F.col("r2") > 0.02).select("entity", "grp", "date", "delta_wte"))
add("p12_groups_by_r2", sql(f"SELECT grp, date, {r('q')} FROM mflow WHERE grp IN (SELECT grp FROM s WHERE r2 > 0.05)", more=S))(lambda t: filters.matching_keys(t.mflow(), _stats(t), F.col("r2") > 0.05, ["grp"]).select("grp", "date", "q"))
add(
    "p14_trimmed",
    sql(
        f"SELECT entity, date, {r('delta_wte')}, {r('delta_q')} FROM t2, (SELECT quantile_cont(delta_q, 0.005) AS a, quantile_cont(delta_q, 0.995) AS b FROM t2) WHERE delta_q BETWEEN a AND b",
        more="t2 AS (SELECT * FROM deltas, (SELECT quantile_cont(delta_wte, 0.005) AS lo, quantile_cont(delta_wte, 0.995) AS hi FROM deltas) WHERE delta_wte BETWEEN lo AND hi)",
    ),
)(lambda t: filters.trimmed(t.deltas(), ["delta_wte", "delta_q"]).select("entity", "date", "delta_wte", "delta_q"))
add("p15_clipped", sql(f"SELECT entity, grp, date, {r('greatest(least(delta_wte, hi), lo)', 'delta_wte')} FROM deltas JOIN (SELECT grp, quantile_cont(delta_wte, 0.02) AS lo, quantile_cont(delta_wte, 0.98) AS hi FROM deltas GROUP BY grp) USING (grp)"))(
    lambda t: filters.clipped(t.deltas(), "delta_wte", 0.02, 0.98, ["grp"]).select("entity", "grp", "date", "delta_wte")
)
add("p18_disagreements", "SELECT CAST(s_suppkey AS VARCHAR) AS entity, CAST(s_suppkey % 25 AS VARCHAR) AS downstream, CAST(s_nationkey AS VARCHAR) AS grp FROM supplier WHERE s_suppkey % 25 <> s_nationkey")(
    lambda t: filters.disagreements(t.read("supplier").select(F.col("s_suppkey").cast("string").alias("entity"), (F.col("s_suppkey") % 25).cast("string").alias("downstream")), t.ents())
)
add("p20_first_of", sql(f"SELECT entity, date, {r('wte')} FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date) AS k FROM levels) WHERE k = 1", "levels"))(lambda t: filters.first_of(t.levels(), ["entity"], ["date"]))
add("k1_top_pairs", sql(f"SELECT entity, grp, n, {r('r2')}, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY r2 DESC, entity) AS rank FROM s) WHERE rank <= 2", more=S))(lambda t: filters.top_n(_stats(t), 2, "r2").select("entity", "grp", "n", "r2", "rank"))
add("k2_top_fraction", sql(f"SELECT entity, grp, {r('r2')} FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY abs(r2) DESC, entity) AS k, greatest(1, floor(count(*) OVER (PARTITION BY grp) * 0.5)) AS m FROM s) WHERE k <= m", more=S))(lambda t: filters.top_fraction(_stats(t), 0.5, "r2").select("entity", "grp", "r2"))
add("w10_above_quantile", sql(f"SELECT entity, grp, {r('r2')} FROM s JOIN (SELECT grp, quantile_cont(r2, 0.75) AS c FROM s GROUP BY grp) USING (grp) WHERE r2 >= c", more=S))(lambda t: filters.above_group_quantile(_stats(t), 0.75, "r2").select("entity", "grp", "r2"))
add("k4_first_entities", sql(f"SELECT entity, grp, date, {r('wte')} FROM paired WHERE (grp, entity) IN (SELECT (grp, entity) FROM (SELECT grp, entity, row_number() OVER (PARTITION BY grp ORDER BY min(date), entity) AS k FROM paired GROUP BY 1, 2) WHERE k <= 2)", "paired"))(
    lambda t: filters.first_entities(t.paired(), 2).select("entity", "grp", "date", "wte")
)
add(
    "u3_union_new",
    sql(
        "SELECT entity, grp, subset FROM (SELECT entity, grp, CASE WHEN k <= 1 THEN 'top10' ELSE 'top25' END AS subset, k FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY r2 DESC, entity) AS k FROM s)) WHERE k <= 3", more=S
    ),
)(lambda t: filters.union_new(filters.top_n(_stats(t), 1, "r2").select("entity", "grp"), filters.top_n(_stats(t), 3, "r2").select("entity", "grp"), ["entity", "grp"]))
add("u4_shared_groups", sql("SELECT DISTINCT grp FROM ents INTERSECT SELECT DISTINCT grp FROM mflow", "mflow"))(lambda t: t.ents().select("grp").intersect(t.mflow().select("grp")))
add("j15_entities_by_group", sql("SELECT grp, count(DISTINCT entity) AS n FROM ents GROUP BY grp", "ents"))(lambda t: t.ents().groupBy("grp").agg(F.count_distinct("entity").alias("n")).orderBy(F.desc("n"), "grp"))
add("f_season_and_text", sql("SELECT entity, date, CASE WHEN month(date) IN (12, 1, 2) THEN 'Winter' WHEN month(date) <= 5 THEN 'Spring' WHEN month(date) <= 8 THEN 'Summer' ELSE 'Fall' END AS season, CASE WHEN wte / 1e6 < 0.0001 THEN '< 0.0001' ELSE printf('%.4f', wte / 1e4) END AS p_text, round(-log10(wte), 6) + 0.0 AS mlog FROM mlev", "mlev"))(
    lambda t: t.mlev().select("entity", "date", season(F.month("date")).alias("season"), F.when(F.col("wte") / 1e6 < 0.0001, p_text(F.col("wte") / 1e6)).otherwise(p_text(F.col("wte") / 1e4)).alias("p_text"), minus_log10(F.col("wte")).alias("mlog"))
)
# reports
QUAL = "sq AS (SELECT entity, count(date) AS n_obs, datediff('day', min(date), max(date)) / 365.25 AS record_years FROM levels GROUP BY entity)"
add(
    "a24_gate_sweep",
    sql(f"SELECT y AS min_years, CAST(o AS INT) AS min_obs, count(*) FILTER (record_years >= y AND n_obs >= o) AS n_entities, round_even(100.0 * count(*) FILTER (record_years >= y AND n_obs >= o) / count(*), 1) + 0.0 AS pct FROM sq, (SELECT unnest([1.0::DOUBLE, 3, 6.7, 7]) AS y), (SELECT unnest([20, 500, 530]) AS o) GROUP BY 1, 2", "levels", QUAL),
)(lambda t: reports.gate_sweep(cleaning.series_quality(t.levels()), (1, 3, 6.7, 7), (20, 500, 530)))
DATA = "ad AS (SELECT 'Original' AS dataset, entity, grp, date FROM deltas UNION ALL SELECT 'lag 1 year', entity, grp, date FROM lag1 UNION ALL SELECT 'lag 3 months', entity, grp, date FROM lag3m)"
add(
    "a26_compare_datasets",
    sql(
        f"""SELECT dataset, n, first_date, last_date, datediff('day', first_date, last_date) AS span_days, n_entities, {r("mean_obs")}, {r("median_obs")}, min_obs, max_obs, n_groups, {r("mean_entities")}, {r("median_entities")}, {r("100.0 * n / (SELECT count(*) FROM ad WHERE dataset = 'Original')", "retention_pct")}
        FROM (SELECT dataset, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM ad GROUP BY 1)
        JOIN (SELECT dataset, count(*) AS n_entities, avg(c) AS mean_obs, median(c) AS median_obs, min(c) AS min_obs, max(c) AS max_obs FROM (SELECT dataset, entity, count(*) AS c FROM ad GROUP BY 1, 2) GROUP BY 1) USING (dataset)
        JOIN (SELECT dataset, count(*) AS n_groups, avg(c) AS mean_entities, median(c) AS median_entities FROM (SELECT dataset, grp, count(DISTINCT entity) AS c FROM ad GROUP BY 1, 2) GROUP BY 1) USING (dataset)""",
        "lag3m",
        DATA,
    ),
)(lambda t: reports.compare_datasets({"Original": t.deltas(), "lag 1 year": t.lag(), "lag 3 months": t.lag(3, "months")}, "Original"))
LAGS = "al AS (SELECT 'none' AS lag, entity, grp, delta_wte AS x, delta_q FROM deltas UNION ALL SELECT '1yr', entity, grp, delta_wte_lag, delta_q FROM lag1 UNION ALL SELECT '3mo', entity, grp, delta_wte_lag, delta_q FROM lag3m)"
LSLOPE = f"{LAGS}, sl AS (SELECT lag, entity, grp, regr_sxy(delta_q, x) / regr_sxx(delta_q, x) AS slope FROM al GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND min(x) < max(x) AND min(delta_q) < max(delta_q))"


def _lags(t: Tables):
    named = lambda d, c: d.withColumn("x", F.col(c))
    return reports.tagged({"none": named(t.deltas(), "delta_wte"), "1yr": named(t.lag(), "delta_wte_lag"), "3mo": named(t.lag(3, "months"), "delta_wte_lag")}, ["entity", "grp", "x", "delta_q"])


def _slopes(t: Tables):
    return regression.regression(_lags(t), ("lag", "entity", "grp"), x="x")


add("a27_lag_regressions", sql(reg("lag, grp", x="x", src="al", least=5, entity="entity"), "lag3m", LAGS))(lambda t: regression.regression(_lags(t), ("lag", "grp"), x="x", least=5, entity="entity"))
add("a27_lag_wide", sql(f"SELECT entity, grp, {r('max(slope) FILTER (lag = $$none$$)', 'none')}, {r('max(slope) FILTER (lag = $$3mo$$)', '_3mo')}, {r('max(slope) FILTER (lag = $$1yr$$)', '_1yr')} FROM sl GROUP BY 1, 2", "lag3m", LSLOPE))(
    lambda t: reports.wide(_slopes(t), ["entity", "grp"], "lag", ["none", "3mo", "1yr"], "slope").withColumnsRenamed({"3mo": "_3mo", "1yr": "_1yr"})
)
add("a28_slope_signs", sql(f"SELECT grp, lag, count(*) AS n, count(*) FILTER (slope < 0) AS n_negative, {r('100 * avg(CASE WHEN slope < 0 THEN 1.0 ELSE 0 END)', 'negative_pct')}, {r('median(slope)', 'median_slope')} FROM sl GROUP BY 1, 2", "lag3m", LSLOPE))(lambda t: reports.slope_signs(_slopes(t)))
add("a28_sign_flips", sql("SELECT count(*) AS n, count(*) FILTER (a.slope < 0 AND NOT b.slope < 0) AS to_positive, count(*) FILTER (NOT a.slope < 0 AND b.slope < 0) AS to_negative FROM sl a JOIN sl b ON a.entity = b.entity AND a.grp = b.grp AND a.lag = 'none' AND b.lag = '1yr'", "lag3m", LSLOPE))(
    lambda t: reports.sign_flips(_slopes(t), "none", "1yr", ("entity", "grp"))
)
add("u7_strongest_lag", sql(f"SELECT entity, grp, lag, {r('slope', 'value')} FROM (SELECT *, row_number() OVER (PARTITION BY entity, grp ORDER BY abs(slope) DESC, lag) AS k FROM sl) WHERE k = 1", "lag3m", LSLOPE))(
    lambda t: reports.strongest(reports.long(reports.wide(_slopes(t), ["entity", "grp"], "lag", ["none", "3mo", "1yr"], "slope"), ["entity", "grp"], ["none", "3mo", "1yr"]), ["entity", "grp"])
)
add("j13_better_with_lag", sql(f"SELECT b.lag, {r('100 * avg(CASE WHEN b.slope > a.slope THEN 1.0 ELSE 0 END)', 'better_pct')} FROM sl a JOIN sl b ON a.entity = b.entity AND a.grp = b.grp AND a.lag = 'none' AND b.lag <> 'none' GROUP BY 1", "lag3m", LSLOPE))(
    lambda t: _slopes(t).where("lag <> 'none'").select("entity", "grp", "lag", F.col("slope").alias("s")).join(_slopes(t).where("lag = 'none'").select("entity", "grp", "slope"), ["entity", "grp"])
    .groupBy("lag").agg((100 * F.avg(F.coalesce((F.col("s") > F.col("slope")).cast("double"), F.lit(0.0)))).alias("better_pct"))
)
add("a44_histogram", sql(f"SELECT CAST(floor(wte / 5) AS BIGINT) AS bin, count(*) AS n, {r('5.0 * floor(wte / 5)', chr(34) + 'from' + chr(34))} FROM levels GROUP BY floor(wte / 5)", "levels"))(lambda t: reports.histogram(t.levels(), "wte", 5.0))
add("a45_shares", sql(f"SELECT {r('100 * avg(CASE WHEN n_obs <= 500 THEN 1.0 ELSE 0 END)', 'few')}, {r('100 * avg(CASE WHEN record_years > 6.7 THEN 1.0 ELSE 0 END)', 'long')} FROM sq", "levels", QUAL))(
    lambda t: reports.shares(cleaning.series_quality(t.levels()), {"few": F.col("n_obs") <= 500, "long": F.col("record_years") > 6.7})
)
add("a48_cross_counts", sql("SELECT grp, count(*) FILTER (slope < 0) AS negative, count(*) FILTER (slope >= 0) AS positive FROM s GROUP BY grp", more=S))(
    lambda t: reports.cross_counts(_stats(t).withColumn("sign", F.when(F.col("slope") < 0, "negative").otherwise("positive")), "grp", "sign", ["negative", "positive"])
)
add("a49_class_shares", f"SELECT c_mktsegment, count(*) AS n, {r('100.0 * count(*) / sum(count(*)) OVER ()', 'pct')} FROM customer GROUP BY 1")(lambda t: reports.class_shares(t.read("customer").select("c_mktsegment"), "c_mktsegment"))
add("a54_profile", sql(f"SELECT \"column\", count(v) AS n, {r('avg(v)', 'mean')}, {r('stddev_samp(v)', 'std')}, {r('min(v)', 'min')}, {r('max(v)', 'max')}, {r('quantile_cont(v, 0.25)', 'q25')}, {r('quantile_cont(v, 0.5)', 'q50')}, {r('quantile_cont(v, 0.75)', 'q75')} FROM (SELECT 'wte' AS \"column\", wte AS v FROM paired UNION ALL SELECT 'q', q FROM paired) GROUP BY 1", "paired"))(
    lambda t: reports.profile(t.paired(), ["wte", "q"])
)
# link network
NET = "net AS (SELECT p_partkey + 1 AS src, (p_partkey + 1) // 2 AS dst FROM part WHERE (p_partkey + 1) // 2 > 0), gg AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_suppkey * 7 % (SELECT count(*) FROM part) + 1 AS link FROM supplier)"
DOWN = f"WITH RECURSIVE {NET}, dn(node, here, d) AS (SELECT n, n, 0 FROM (SELECT src AS n FROM net UNION SELECT dst FROM net UNION SELECT link FROM gg) UNION ALL SELECT dn.node, net.dst, d + 1 FROM dn JOIN net ON dn.here = net.src WHERE d < 200)"
TERM = ", tm AS (SELECT id, link FROM gg g WHERE NOT EXISTS (SELECT 1 FROM dn JOIN gg o ON o.link = dn.here WHERE dn.node = g.link AND o.id <> g.id))"


def _net(t: Tables):
    link = F.col("p_partkey") + 1
    return graph.edges(t.read("part").select(link.alias("link"), F.floor(link / 2).alias("below")))


def _gages(t: Tables):
    n = t.read("part").agg(F.count("*").alias("n"))
    return t.read("supplier").join(F.broadcast(n)).select(F.col("s_suppkey").cast("string").alias("id"), (F.col("s_suppkey") * 7 % F.col("n") + 1).alias("link"))  # one row


add("g1_edges", f"WITH {NET} SELECT DISTINCT src, dst FROM net")(_net)
add("g3_terminal_groups", f"{DOWN}{TERM} SELECT id, link FROM tm")(lambda t: graph.terminal_groups(_gages(t), _net(t)))
add("g3_terminal_groups_edited", f"{DOWN}{TERM} SELECT id, link FROM tm WHERE id NOT IN ('1', '2', '3') UNION SELECT id, link FROM gg WHERE id IN ('4', '5')")(
    lambda t: graph.terminal_groups(_gages(t), _net(t), t.spark.createDataFrame([("1",), ("2",), ("3",)], "id string"), t.spark.createDataFrame([("4",), ("5",), ("none",)], "id string"))
)
add("g5_upstream_links", f"{DOWN}{TERM} SELECT id AS gage, 'Gage ' || id AS gage_name, link AS terminal_link, dn.node AS upstream_link FROM tm JOIN dn ON dn.here = tm.link")(lambda t: graph.upstream_links(graph.terminal_groups(_gages(t), _net(t)), _net(t)))
add("g5_upstream_links_nested", f"{DOWN} SELECT id AS gage, 'Gage ' || id AS gage_name, link AS terminal_link, dn.node AS upstream_link FROM gg JOIN dn ON dn.here = gg.link")(lambda t: graph.upstream_links(_gages(t), _net(t)))
add("g7_upstream_counts", f"{DOWN}{TERM} SELECT id AS gage, count(*) AS n_links FROM tm JOIN dn ON dn.here = tm.link GROUP BY 1")(lambda t: graph.upstream_counts(graph.upstream_links(graph.terminal_groups(_gages(t), _net(t)), _net(t))))
add("g6_first_gage_below", f"{DOWN} SELECT node AS link, gage, CAST(d AS INT) AS depth FROM (SELECT node, d, min(id) AS gage, row_number() OVER (PARTITION BY node ORDER BY d) AS k FROM dn JOIN gg ON gg.link = dn.here WHERE d < 100 GROUP BY 1, 2) WHERE k = 1")(
    lambda t: graph.first_gage_below(_gages(t), _net(t))
)
LONG = f"""WITH RECURSIVE {NET}, ln AS (SELECT p_partkey + 1 AS link, CAST(p_retailprice AS DOUBLE) AS len FROM part),
dl(node, here, d, s) AS (SELECT n, n, 0, 0.0::DOUBLE FROM (SELECT src AS n FROM net UNION SELECT dst FROM net UNION SELECT link FROM gg)
  UNION ALL SELECT dl.node, net.dst, d + 1, s + coalesce(len, 0) FROM dl JOIN net ON dl.here = net.src LEFT JOIN ln ON ln.link = net.src WHERE d < 200)"""


def _lengths(t: Tables):
    return t.read("part").select((F.col("p_partkey") + 1).alias("link"), F.col("p_retailprice").cast("double").alias("length"))


add("g4_upstream_of", f"{DOWN}, wanted AS (SELECT DISTINCT s_suppkey * 3 % (SELECT count(*) FROM part) + 1 AS link FROM supplier) SELECT link, dn.node, CAST(d AS BIGINT) AS steps FROM wanted JOIN dn ON dn.here = wanted.link")(
    lambda t: _upstream_of(t)
)


def _upstream_of(t: Tables):
    n = t.read("part").agg(F.count("*").alias("n"))
    wanted = t.read("supplier").join(F.broadcast(n)).select((F.col("s_suppkey") * 3 % F.col("n") + 1).alias("link"))  # one row
    return graph.upstream_pairs(wanted, _net(t)).select("link", "node", "steps")


add(
    "g7_upstream_summary",
    f"""{LONG} SELECT gage, n_links, coalesce(n_gages, 0) AS n_gages, {r("mean_steps")}, {r("mean_distance")} FROM
    (SELECT id AS gage, count(*) AS n_links FROM gg JOIN dl ON dl.here = gg.link GROUP BY 1) LEFT JOIN
    (SELECT g.id AS gage, count(*) AS n_gages, avg(d) AS mean_steps, avg(s) AS mean_distance FROM gg g JOIN dl ON dl.here = g.link JOIN gg o ON o.link = dl.node AND o.id <> g.id GROUP BY 1) USING (gage)""",
)(lambda t: graph.upstream_summary(_gages(t), _gages(t), _net(t), _lengths(t)))
# geometry
PTS = "pt AS (SELECT vec_id AS point_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"
GRID = "gr AS (SELECT i * 4 + j AS polygon_id, -0.4 + 0.2 * i AS x1, -0.4 + 0.2 * j AS y1 FROM (SELECT unnest(range(0, 4)) AS i), (SELECT unnest(range(0, 4)) AS j))"
LINES = "li AS (SELECT a.point_id // 2 AS line_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM pt a JOIN pt b ON b.point_id = a.point_id + 1 WHERE a.point_id % 2 = 0)"


def _points(t: Tables):
    return t.read("embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


def _polygons(t: Tables):
    ij = t.spark.range(16).select(F.col("id").alias("polygon_id"), (F.lit(-0.4) + 0.2 * F.floor(F.col("id") / 4)).alias("a"), (F.lit(-0.4) + 0.2 * (F.col("id") % 4)).alias("b"))
    corner = lambda dx, dy: F.struct((F.col("a") + dx).alias("x"), (F.col("b") + dy).alias("y"))
    return ij.select("polygon_id", F.array(corner(0.0, 0.0), corner(0.2, 0.0), corner(0.2, 0.2), corner(0.0, 0.2)).alias("ring"))


def _lines(t: Tables):
    p = _points(t)
    a = p.where("point_id % 2 = 0")
    b = p.select((F.col("point_id") - 1).alias("point_id"), F.struct("x", "y").alias("b"))
    return a.join(b, "point_id").select(F.floor(F.col("point_id") / 2).alias("line_id"), F.array(F.struct("x", "y"), F.col("b")).alias("line"))


add("x1_points_in_polygons", f"WITH {PTS}, {GRID} SELECT point_id, polygon_id FROM pt JOIN gr ON x > x1 AND x < x1 + 0.2 AND y > y1 AND y < y1 + 0.2")(lambda t: spatial.points_in_polygons(_points(t), _polygons(t), 0.1).select("point_id", "polygon_id"))
add("x8_within_any", f"WITH {PTS}, {GRID} SELECT DISTINCT point_id FROM pt JOIN gr ON x > x1 AND x < x1 + 0.2 AND y > y1 AND y < y1 + 0.2")(lambda t: spatial.within_any(_points(t), _polygons(t), 0.1).select("point_id"))
BOX = "sqrt(pow(greatest(x1 - x, 0, x - x1 - 0.2), 2) + pow(greatest(y1 - y, 0, y - y1 - 0.2), 2))"
add(
    "x6_containing_or_nearest",
    f"WITH {PTS}, {GRID} SELECT point_id, polygon_id, {r('distance')} FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY distance, polygon_id) AS k FROM (SELECT point_id, polygon_id, {BOX} AS distance FROM pt, gr)) WHERE k = 1",
)(lambda t: spatial.containing_or_nearest(_points(t), _polygons(t), 0.1))
DIST = "sqrt(pow(x - (x1 + u * (x2 - x1)), 2) + pow(y - (y1 + u * (y2 - y1)), 2))"
add(
    "x3_nearest_line",
    f"WITH {PTS}, {LINES} SELECT point_id, line_id, {r('distance')} FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY distance, line_id) AS k FROM (SELECT point_id, line_id, {DIST} AS distance FROM (SELECT *, greatest(0, least(1, coalesce(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / nullif(pow(x2 - x1, 2) + pow(y2 - y1, 2), 0), 0))) AS u FROM pt, li WHERE point_id % 2 = 1 OR point_id // 2 <> line_id))) WHERE k = 1".replace(" WHERE point_id % 2 = 1 OR point_id // 2 <> line_id", ""),
)(lambda t: spatial.nearest_line(_points(t).withColumns({"x": F.col("x"), "y": F.col("y")}), _lines(t), 0.05))
add("x4_centroids", f"WITH {PTS}, {LINES} SELECT line_id, {r('(x1 + x2) / 2', 'x')}, {r('(y1 + y2) / 2', 'y')} FROM li")(lambda t: spatial.centroids(_lines(t)))
add("x5_web_mercator", f"WITH {PTS} SELECT point_id, {r('radians(x * 100) * 6378137.0', 'mx', 4)}, {r('ln(tan(pi() / 4 + radians(y * 100) / 2)) * 6378137.0', 'my', 4)} FROM pt", digits=4)(
    lambda t: _points(t).select("point_id", *[c.alias(n) for c, n in zip(spatial.to_web_mercator(F.col("x") * 100, F.col("y") * 100), ("mx", "my"), strict=True)])
)
def utm(lon: str, lat: str, zone: int = 12) -> tuple[str, str]:
    """Easting and northing as SQL, by the same series."""
    n = spatial.FLATTENING / (2 - spatial.FLATTENING)
    scale = 0.9996 * spatial.AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    t = f"sinh(atanh(sin(radians({lat}))) - {e!r} * atanh({e!r} * sin(radians({lat}))))"
    lam = f"radians({lon} - ({zone * 6 - 183}))"
    xi, eta = f"atan2({t}, cos({lam}))", f"atanh(sin({lam}) / sqrt(1 + pow({t}, 2)))"
    east = " + ".join([eta, *[f"{a!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(alpha, 1)]])
    north = " + ".join([xi, *[f"{a!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(alpha, 1)]])
    return f"(500000 + {scale!r} * ({east}))", f"({scale!r} * ({north}))"


EAST, NORTH = utm("(x * 5 - 111)", "(y * 5 + 40)")
add("x5_utm", f"WITH {PTS} SELECT point_id, {r(EAST, 'east', 3)}, {r(NORTH, 'north', 3)} FROM pt", digits=3)(
    lambda t: _points(t).select("point_id", *[c.alias(n) for c, n in zip(spatial.to_utm(F.col("x") * 5 - 111, F.col("y") * 5 + 40), ("east", "north"), strict=True)])
)
# points and lines in degrees about a corner of the zone; lines are links of the network, every third one without an elevation
ON_REACHES = f"""{DOWN}, {PTS}, {LINES}, mp AS (SELECT point_id, {EAST} AS x, {NORTH} AS y FROM pt),
ml AS (SELECT line_id + 1 AS line_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM li JOIN mp a ON a.point_id = 2 * line_id JOIN mp b ON b.point_id = 2 * line_id + 1),
nr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY distance, line_id) AS k FROM (SELECT point_id, line_id, {DIST} AS distance FROM (
  SELECT *, greatest(0, least(1, coalesce(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / nullif(pow(x2 - x1, 2) + pow(y2 - y1, 2), 0), 0))) AS u FROM mp, ml))) WHERE k = 1),
bl AS (SELECT node, gage FROM (SELECT node, d, min(id) AS gage, row_number() OVER (PARTITION BY node ORDER BY d) AS k FROM dn JOIN gg ON gg.link = dn.here WHERE d < 100 GROUP BY 1, 2) WHERE k = 1)"""
add(
    "x3_reaches_of_points",
    f"""{ON_REACHES} SELECT point_id, line_id AS reach, CASE WHEN line_id % 3 > 0 THEN CAST(p_retailprice AS DOUBLE) END AS reach_elevation, {r("distance", None, 3)}, gage AS downstream_gage
    FROM nr LEFT JOIN part ON p_partkey = line_id LEFT JOIN bl ON bl.node = line_id""",
    digits=3,
)(lambda t: _reaches_of(t))


def _reaches_of(t: Tables):
    points = _points(t).select("point_id", (F.col("x") * 5 - 111).alias("lon"), (F.col("y") * 5 + 40).alias("lat"))
    turned = lambda v: F.struct((v["x"] * 5 - 111).alias("x"), (v["y"] * 5 + 40).alias("y"))
    lines = _lines(t).select((F.col("line_id") + 1).alias("line_id"), F.transform("line", turned).alias("line"))
    heights = t.read("part").where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("line_id"), F.col("p_retailprice").cast("double").alias("reach_elevation"))
    return places.reaches_of(points, lines, heights, _net(t), _gages(t), entity="point_id")


CLIPPED = "greatest(0, least((g.x1 - li.x1) / (li.x2 - li.x1), (g.x1 + 0.2 - li.x1) / (li.x2 - li.x1)), least((g.y1 - li.y1) / (li.y2 - li.y1), (g.y1 + 0.2 - li.y1) / (li.y2 - li.y1)))"
add(
    "x9_lines_meeting_polygons",
    f"WITH {PTS}, {GRID}, {LINES} SELECT DISTINCT line_id, polygon_id FROM li, gr g WHERE {CLIPPED} <= {CLIPPED.replace('greatest', 'GREATER').replace('least', 'greatest').replace('GREATER', 'least').replace('least(0', 'least(1')}",
)(lambda t: spatial.lines_meeting_polygons(_lines(t), _polygons(t), 0.1))
