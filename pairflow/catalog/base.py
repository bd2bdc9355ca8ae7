"""The driver tables in their roles (levels, flows, entities), as frames and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairflow.operators import pairing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CTES = {
    "levels": "SELECT CAST(l_suppkey AS VARCHAR) AS entity, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice) / 997 AS wte FROM lineitem GROUP BY 1, 2",
    "flows": "SELECT CAST(c_nationkey AS VARCHAR) AS grp, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) / 997 AS q, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS bfd FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
    "ents": "SELECT CAST(s_suppkey AS VARCHAR) AS entity, CAST(s_nationkey AS VARCHAR) AS grp FROM supplier",
    "mlev": "SELECT entity, CAST(date_trunc('month', date) + INTERVAL 14 DAY AS DATE) AS date, avg(wte) AS wte FROM levels GROUP BY 1, 2",
    "mflow": "SELECT grp, CAST(date_trunc('month', date) + INTERVAL 14 DAY AS DATE) AS date, avg(q) AS q, 1 AS bfd FROM flows WHERE bfd = 1 GROUP BY 1, 2",
    "paired": "SELECT e.grp, m.date, m.entity, m.wte, f.q, f.bfd FROM mlev m JOIN ents e ON m.entity = e.entity JOIN mflow f ON f.grp = e.grp AND f.date = m.date",
    "based": """SELECT *, first_value(CASE WHEN bfd = 1 THEN wte END IGNORE NULLS) OVER w AS wte0, first_value(CASE WHEN bfd = 1 THEN q END IGNORE NULLS) OVER w AS q0 FROM paired
        WINDOW w AS (PARTITION BY entity ORDER BY date, grp ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "deltas": "SELECT *, wte - wte0 AS delta_wte, q - q0 AS delta_q FROM based",
    "lag1": "SELECT a.*, b.delta_wte AS delta_wte_lag FROM deltas a JOIN deltas b ON a.entity = b.entity AND CAST(a.date - INTERVAL 1 YEAR AS DATE) = b.date",
    "lag3m": "SELECT a.*, b.delta_wte AS delta_wte_lag FROM deltas a JOIN deltas b ON a.entity = b.entity AND CAST(a.date - INTERVAL 3 MONTH AS DATE) = b.date",
}


def sql(body: str, upto: str = "deltas", more: str = "") -> str:
    """``body`` over the roles' tables up to one of them."""
    names = list(CTES)
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in names[: names.index(upto) + 1]]
    return "WITH " + ",\n".join(parts + ([more] if more else [])) + "\n" + body


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name or expr}"


def _simpson(f: Callable[[str], str], length: str, steps: int = 1000) -> str:
    """The integral of ``f`` from 0 to ``length`` as SQL."""
    weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"({length}) / {3 * steps} * list_sum(list_transform(range({steps + 1}), lambda i: ({weight}) * {f(f'(i * ({length}) / {steps}.0)')}))"


def normal_p(z: str) -> str:
    """Two-sided p of a normal value as SQL."""
    rest = _simpson(lambda t: f"exp(-abs({z}) * {t} - {t} * {t} / 2)", f"sqrt({z} * {z} + 82) - abs({z})")
    return f"least(1.0, sqrt(2 / pi()) * exp(-{z} * {z} / 2) * {rest})"


def correlation_p(rr: str, n: str) -> str:
    """Two-sided p of a correlation as SQL: cosines to the power n - 3 beyond its angle, as a share of all of them."""

    def rest(x: str) -> str:
        slope = f"{x} / sqrt(1 - {x} * {x})"
        length = f"CASE WHEN {n} > 3 THEN least(acos({x}), sqrt(pow({slope}, 2) + 82.0 / ({n} - 3)) - {slope}) ELSE acos({x}) END"
        return _simpson(lambda t: f"pow(greatest(cos(asin({x}) + {t}), 0), {n} - 3)", length)

    return f"CASE WHEN {n} = 2 OR abs({rr}) >= 1 THEN 0.0 WHEN {n} > 2 THEN least(1.0, ({rest(f'abs({rr})')}) / ({rest('0.0')})) END"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` decimals, without a negative zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def add(name: str, oracle: str | None = None, digits: int = 6):
    """Registers a query under ``name`` with its doubles rounded, and its SQL."""

    def keep(f):
        QUERIES[name] = lambda spark, d: rounded(f(Tables(spark, d)), digits)
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return keep


class Tables:
    """The roles' frames over one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def raw_levels(self) -> DataFrame:
        t = self.read("lineitem")
        return t.select(F.col("l_suppkey").cast("string").alias("entity"), F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / 997).alias("wte"))

    def levels(self) -> DataFrame:
        t = self.read("lineitem").groupBy(F.col("l_suppkey").cast("string").alias("entity"), F.to_date("l_shipdate").alias("date"))
        return t.agg((F.avg("l_extendedprice") / 997).alias("wte"))

    def flows(self) -> DataFrame:
        t = self.read("orders").join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
        t = t.groupBy(F.col("c_nationkey").cast("string").alias("grp"), F.to_date("o_orderdate").alias("date"))
        return t.agg((F.sum("o_totalprice") / 997).alias("q"), F.max(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("bfd"))

    def ents(self) -> DataFrame:
        return self.read("supplier").select(F.col("s_suppkey").cast("string").alias("entity"), F.col("s_nationkey").cast("string").alias("grp"))

    def mlev(self) -> DataFrame:
        return pairing.monthly_levels(self.levels())

    def mflow(self) -> DataFrame:
        return pairing.monthly_response(self.flows())

    def paired(self) -> DataFrame:
        return pairing.pair(pairing.with_group(self.mlev(), self.ents()), self.mflow()).select("grp", "date", "entity", "wte", "q", "bfd")

    def based(self) -> DataFrame:
        return pairing.with_baseline(self.paired())

    def deltas(self) -> DataFrame:
        return pairing.with_deltas(self.based())

    def lag(self, k: int = 1, unit: str = "years") -> DataFrame:
        return pairing.lagged(self.deltas(), k, unit)
