"""Helpers that several corpus operators share: the word rule, shared folders, written tables, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairflow.plans.tables import shared_folder

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends, executors may go."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Tables written meanwhile go to Python in Arrow batches of at most ``rows`` rows: buffers of whole texts lie outside the heap,
    for each running task, and double while they grow."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(own)) if int(own) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, own)


def words(text: Column) -> Column:
    """The words of a text, as an array; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_blocks(docs: DataFrame, text: str = "text", block_mb: float = 16.0) -> int:
    """How many blocks of about ``block_mb`` MB of text the documents fill (at least 4), by the size of the files they are read from
    (text takes about twice its compressed size); frames that aren't read from files are summed."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = 2 * sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size > 1e17:  # Spark's way of saying that it doesn't know
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(4, int(size / (block_mb * 1e6)) + 1)


def unplaced(c: Column, kind: str) -> Column:
    """The same value in a form that Spark doesn't take as already partitioned, so that a join
    deals out both sides and can split hot keys at run time."""
    return F.concat(c, F.lit("")) if kind == "string" else F.bitwise_not(F.bitwise_not(c))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    Returns ``(id, component)`` for every node of an edge other than a loop; ``component`` is the smallest node
    of the component. Each round is two grouped minima and two joins on edge tables, written to the
    shared folder; nothing is collected but one row (count and hash sum) that tells when rounds stop
    changing the edges. Null ends are ignored; no edges give an empty table.
    """
    spark = edges.sparkSession
    kind = dict(edges.dtypes)[a]
    u, v = F.col("u"), F.col("v")
    now = (
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    now, seen = written(now, "edges"), None
    for _ in range(max_rounds):
        both = now.select("u", "v").union(now.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select(unplaced(u, kind).alias("k"), F.least(u, "m").alias("m"))
        large = both.where(v > u).join(low, u == F.col("k")).select(v.alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(unplaced(u, kind).alias("k"), "m")
        small = large.join(low, u == F.col("k"))
        small = small.select(F.when(v == F.col("m"), u).otherwise(v).alias("u"), F.col("m").alias("v"))
        # a row with v == m stands for (u, m); any other row for (v, m), and its u has a row with v == m as well
        now = written(small.distinct(), "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(v.alias("id"), v.alias("component")).distinct()
    return now.select(u.alias("id"), v.alias("component")).union(roots)
