"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

Stages take ``(spark, docs, sf_dir)``; ``docs`` has the columns of ``documents``. All but the last return them, the
last one adds the mix: ``size``, ``source_size``, ``target`` and ``taken``. SQL cannot express the trees of the first
stage and the alignment of the fourth, so there is no SQL twin; the tests compare every stage with a brute-force version.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outvote.llm import decontamination, line_dedup, mixing, near_duplicates, quality_rules
from outvote.llm.common import ship
from outvote.plans.staging import stage

ORACLE_SQL = None


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: base rules and boosted trees; documents that are rejected go."""
    ship(spark)
    return quality_rules.passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup over what is left; ``n_chars`` follows the new text."""
    ship(spark)
    out = line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def keep_one_of_each_group(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup at a similarity of 0.8: the smallest doc_id of each group stays, with all of its rows.

    A row without doc_id stays if it has no copy with one.
    """
    ship(spark)
    found = near_duplicates.near_duplicates(docs, percent=80)
    kept = found.filter("kept").select("doc_id").distinct()
    kept = kept.withColumnRenamed("doc_id", "kept_id")
    out = docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id")), "left_semi")
    return out.select(*docs.columns)


def drop_benchmark_passages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a passage that aligns with a benchmark item go."""
    ship(spark)
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: documents of which the mix takes no word go, ``taken`` says how many of the others."""
    ship(spark)
    return mixing.mix(docs, keep=True).filter("taken > 0")


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_repeated_lines),
    ("near-duplicates", keep_one_of_each_group),
    ("decontamination", drop_benchmark_passages),
    ("mixing", mix_sources),
]


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
