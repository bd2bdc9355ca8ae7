"""Exact ranks and quantiles of whole columns without a task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairflow.plans.tables import kept


def value_ranks(df: DataFrame, value: str, keys: Sequence[str] = (), **sums: Column) -> DataFrame:
    """``(keys, value, c, sums, before, n)``: each distinct value of a key with its rows, how many rows have a smaller one, and the key's rows.

    Rows are counted per distinct value and dealt out by ranges of (keys, value); ranges are added up in order, and each takes the
    total of the key's earlier ranges as its start. The only window over all of a key orders its ranges, of which there are no
    more than partitions. Null values don't count; ``sums`` are further aggregates of each value.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("value"))
    counts = counts.agg(F.count("*").alias("c"), *[e.alias(name) for name, e in sums.items()])
    ranged = kept(counts.repartitionByRange(*keys, "value").withColumn("_part", F.spark_partition_id()))
    within = F.sum("c").over(W.partitionBy("_part", *keys).orderBy("value")) - F.col("c")
    parts = ranged.groupBy("_part", *keys).agg(F.sum("c").alias("_c"))
    ahead = F.sum("_c").over(W.partitionBy(*keys).orderBy("_part")) - F.col("_c")
    parts = parts.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_{k}") for k in keys], ahead.alias("_ahead"), F.sum("_c").over(W.partitionBy(*keys)).alias("n"))
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = ranged.withColumn("_within", within).join(parts, same)
    return out.select(*keys, "value", "c", *sums, (F.col("_ahead") + F.col("_within")).alias("before"), "n")


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, q)``: the quantiles of each key as an array, interpolated linearly between the two nearest rows.

    Without keys one row, of nulls over an empty table.
    """
    ranked = value_ranks(df, value, keys)
    begin, end = F.col("before"), F.col("before") + F.col("c")
    found = []
    for i, p in enumerate(probs):
        at = (F.col("n") - 1) * F.lit(float(p))
        for side, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            found.append(F.max(F.when((begin <= place) & (place < end), F.col("value"))).alias(f"_{side}{i}"))
    out = ranked.groupBy(*keys).agg(F.max("n").alias("_n"), *found)
    told = []
    for i, p in enumerate(probs):
        at = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        told.append(F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi))
    return out.select(*keys, F.array(*told).alias("q"))
