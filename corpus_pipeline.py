"""From documents to packed training sequences: five stages over the ``documents`` table, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairflow.llm.common import SPACE, unplaced, written
from pairflow.llm.decontamination import without_benchmark
from pairflow.llm.jaccard_join import jaccard_components
from pairflow.llm.line_dedup import dedup_lines
from pairflow.llm.packing import pack_documents
from pairflow.llm.quality_rules import judge_quality

#: Columns of ``documents``; all stages but the last return these.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject (null and very short texts among them)."""
    return judge_quality(docs).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops fuzzy duplicate lines; documents that lose all their words go, and ``n_chars`` follows the text."""
    out = dedup_lines(docs, reread=True)
    out = out.where((F.col("n_dropped") == 0) | (F.regexp_replace("text", SPACE, "") != ""))
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of near duplicates (five words, 0.8) the document with the smallest id, once.

    Documents without words or without an id are no duplicates of anything and stay.
    """
    found = jaccard_components(docs, k=5, percent=80, reread=True)
    others = found.where(F.col("doc_id") != F.col("component_id")).select(unplaced(F.col("doc_id"), "bigint").alias("_id")).distinct()
    kept = docs.join(others, F.col("doc_id") == F.col("_id"), "left_anti")
    return kept.dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark."""
    return without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def pattern_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens: a row for each piece."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("pattern packing", pattern_packing),
]

#: SQL can't express the determinant estimates, the signatures or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each over everything that the one before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
