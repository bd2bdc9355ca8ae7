"""Queries of classes, display names and split statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairflow.functions.columns import season
from pairflow.operators import classes, information, regression

from .base import Tables, add, r, sql
from .pairs import PERIODS, mi, reg, stat

LABEL = "CASE WHEN class = 'Ref' THEN 'Regulated' WHEN class = 'Non-ref' THEN 'Unregulated' ELSE 'Unclassified' END"
KINDS = "kinds AS (SELECT CAST(n_nationkey AS VARCHAR) AS grp, CASE n_nationkey % 3 WHEN 0 THEN 'Ref' ELSE 'Non-ref' END AS class FROM nation WHERE n_nationkey % 3 < 2)"
MONTHS = "mo AS (SELECT *, month(date) AS month FROM deltas)"


def _kinds(t: Tables):
    """Two thirds of the groups have a class."""
    key = F.col("n_nationkey")
    return t.read("nation").where(key % 3 < 2).select(key.cast("string").alias("grp"), F.when(key % 3 == 0, "Ref").otherwise("Non-ref").alias("class"))


def _labelled(fits: str) -> str:
    return f"SELECT f.*, {LABEL} AS class FROM ({fits}) f LEFT JOIN kinds USING (grp)"


add("p13_attribute_filter", "SELECT p_partkey, p_size FROM part WHERE p_size >= 4")(lambda t: classes.at_least(t.read("part").select("p_partkey", "p_size"), "p_size"))
add(
    "p17_without_outer_noise",
    sql(
        f"SELECT entity, grp, date, {r('zx')}, {r('zy')} FROM z WHERE abs(zx) <= 4 AND abs(zy) <= 4",
        more="""z AS (SELECT entity, grp, date, (delta_wte - mx) / sx AS zx, (delta_q - my) / sy AS zy FROM deltas JOIN (
            SELECT grp, avg(delta_wte) AS mx, stddev_samp(delta_wte) AS sx, avg(delta_q) AS my, stddev_samp(delta_q) AS sy FROM deltas GROUP BY grp HAVING sx > 0 AND sy > 0) USING (grp))""",
    ),
)(lambda t: classes.without_outer_noise(_scaled(t), ("zx", "zy")))


def _scaled(t: Tables):
    d = t.deltas()
    scale = d.groupBy("grp").agg(F.avg("delta_wte").alias("mx"), F.stddev_samp("delta_wte").alias("sx"), F.avg("delta_q").alias("my"), F.stddev_samp("delta_q").alias("sy"))
    both = d.join(scale.where("sx > 0 and sy > 0"), "grp")
    return both.select("entity", "grp", "date", ((F.col("delta_wte") - F.col("mx")) / F.col("sx")).alias("zx"), ((F.col("delta_q") - F.col("my")) / F.col("sy")).alias("zy"))


add("p19_display_name", sql("SELECT entity, grp, n_name AS name FROM ents LEFT JOIN nation ON n_nationkey % 2 = 0 AND grp = CAST(n_nationkey AS VARCHAR)", "ents"))(
    lambda t: classes.with_name(t.ents(), t.read("nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("grp"), F.col("n_name").alias("name")), "grp")
)
add("p21_class_labels", f"WITH {KINDS} SELECT grp, {LABEL} AS class FROM kinds")(lambda t: _kinds(t).select("grp", classes.relabelled(F.col("class")).alias("class")))
add("j10_class_join", sql(f"SELECT entity, grp, {LABEL} AS class FROM ents LEFT JOIN kinds USING (grp)", "ents", KINDS))(lambda t: classes.with_class(t.ents(), _kinds(t)))
add("a33_class_fits", sql(_labelled(reg("grp", entity="entity")), more=KINDS))(lambda t: classes.class_fits(t.deltas(), _kinds(t)))
add("a34_class_fits_by_month", sql(_labelled(reg("grp, month", src="mo", entity="entity")), more=f"{KINDS}, {MONTHS}"))(
    lambda t: classes.class_fits(t.deltas().withColumn("month", F.month("date")), _kinds(t), ("grp", "month"))
)
add("a34_class_fits_by_season", sql(_labelled(reg("grp, period", src="per", entity="entity", where="period_type = 'Seasonal'")), more=f"{KINDS}, {PERIODS}"))(
    lambda t: classes.class_fits(t.deltas().withColumn("period", season(F.month("date"))), _kinds(t), ("grp", "period"))
)
ORDINAL = "od AS (SELECT *, CAST(datediff('day', DATE '1970-01-01', date) AS DOUBLE) AS day FROM deltas), pe AS (SELECT od.*, period FROM od JOIN (SELECT DISTINCT date, period FROM per WHERE period_type = 'Seasonal') USING (date))"
add("a35_level_trend_by_season", sql(reg("grp, period", x="day", y="delta_wte", src="pe"), more=f"{PERIODS}, {ORDINAL}"))(
    lambda t: regression.regression(
        t.deltas().withColumns({"day": F.unix_date("date").cast("double"), "period": season(F.month("date"))}), ("grp", "period"), x="day", y="delta_wte"
    )
)
CORR = "regr_sxy(delta_q, delta_wte) / sqrt(regr_sxx(delta_q, delta_wte)) / sqrt(regr_syy(delta_q, delta_wte))"
add(
    "a50_pearson",
    sql(f"SELECT entity, grp, n, {r('r')}, {r('abs(r)', 'abs_r')} FROM (SELECT entity, grp, count(*) AS n, {CORR} AS r FROM deltas GROUP BY 1, 2 HAVING count(*) >= 10 AND min(delta_wte) < max(delta_wte) AND min(delta_q) < max(delta_q))"),
)(lambda t: classes.pearson(t.deltas(), ("entity", "grp"), "delta_wte", "delta_q"))
SPLIT = f"count(*) AS n, count(*) FILTER (slope < 0) AS n_negative, count(*) FILTER (slope >= 0) AS n_not_negative, {r('avg(slope)', 'mean_slope')}, {r('median(slope)', 'median_slope')}"
add("a51_slope_split", sql(f"SELECT grp, {SPLIT} FROM s WHERE n >= 20 GROUP BY grp", more=f"s AS ({stat()})"))(
    lambda t: classes.slope_split(_fits(t), _fits(t).where("n >= 20"), on=("entity", "grp"))
)


def _fits(t: Tables):
    return regression.regression(t.deltas(), ("entity", "grp"), least=10)


M = f"m AS ({mi('deltas', 'delta_wte')}), m20 AS ({mi('deltas', 'delta_wte', 20)})"
add("a43_information_by_group", sql(f"SELECT grp, count(mi) AS n, {r('avg(mi)', 'mean')}, {r('median(mi)', 'median')}, {r('stddev_samp(mi)', 'std')} FROM m GROUP BY grp", more=M))(
    lambda t: classes.distribution(information.mutual_information(t.deltas()), "mi", "grp")
)
add("a43_information_fit", sql(reg("", x="a", y="b", src="mm", least=3), more=f"{M}, mm AS (SELECT m.mi AS a, m20.mi AS b FROM m JOIN m20 USING (entity, grp))"))(
    lambda t: regression.regression(
        information.mutual_information(t.deltas()).select("entity", "grp", F.col("mi").alias("a"))
        .join(information.mutual_information(t.deltas(), bins=20).select("entity", "grp", F.col("mi").alias("b")), ["entity", "grp"]),
        (), x="a", y="b", least=3,
    )
)
add(
    "j9_by_number",
    sql(
        f"SELECT CAST(s_suppkey AS BIGINT) AS entity, CAST(s_nationkey AS BIGINT) AS grp, s_acctbal AS distance, length(s_name) AS place, {r('r2')} FROM supplier JOIN s ON s.entity = CAST(s_suppkey AS VARCHAR) AND s.grp = CAST(s_nationkey AS VARCHAR) WHERE s_suppkey % 5 > 0",
        more=f"s AS ({stat()})",
    ),
)(lambda t: classes.by_number(*_numbered(t)).select("entity", "grp", "distance", "place", "r2"))


def _numbered(t: Tables):
    """Ids as text, every fifth of them no number."""
    own = t.read("supplier")
    entity, grp = F.col("s_suppkey").cast("string").alias("entity"), F.col("s_nationkey").cast("string").alias("grp")
    odd = F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("x"), F.col("s_suppkey"))).otherwise(F.col("s_suppkey").cast("string")).alias("entity")
    return own.select(odd, grp, F.col("s_acctbal").alias("distance")), own.select(entity, F.length("s_name").alias("place")), _fits(t).select("entity", "grp", "r2")
