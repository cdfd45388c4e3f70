"""The corpus pipeline: reject, de-duplicate, cut repeats, decontaminate, mix. Each stage is written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.decontaminate import without_contaminated
from strata.llm.jaccard import jaccard_rows
from strata.llm.mixing import mix_sources
from strata.llm.quality import without_rejects
from strata.llm.stage import stage
from strata.llm.suffix import without_repeats


ROW = "row_of_near_duplicates"


def _table(docs: DataFrame, sf_dir: str, name: str) -> DataFrame:
    return docs.sparkSession.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return without_rejects(docs, _table(docs, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones: the smallest id, null last, and of rows with one id the first by text, then any one.

    Rows without words link with nothing and stay; so do rows without id, unless they link to another.
    """
    numbered = stage(docs.withColumn(ROW, F.monotonically_increasing_id()))
    groups = jaccard_rows(numbered.select(F.col(ROW).alias("row"), "doc_id", "text"))
    heads = stage(groups.filter(F.col("order_") == F.col("least")).select("row", "component"))
    each = heads.groupBy("component").agg(F.count("*").alias("heads"), F.min("row").alias("row"))
    tied = heads.join(each.filter("heads > 1").select("component"), "component")
    texts = numbered.select(F.col(ROW).alias("row"), "text").join(tied, "row")
    first = texts.groupBy("component").agg(F.min(F.struct("text", "row")).alias("m")).select("m.row")
    kept = each.filter("heads = 1").select("row").union(first)
    return numbered.join(kept.select(F.col("row").alias(ROW)), ROW, "left_semi").select(*docs.columns)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without strings that start earlier; n_chars is counted anew where the text has changed."""
    cut = without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return without_contaminated(docs, _table(docs, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, with what the mix takes of each."""
    return mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix),
]

#: The classifier is trained, which SQL cannot say; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of `sf_dir`; what one stage writes is what the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
