"""A corpus pipeline from the operators of ``tallyloom.llm``.

Documents of low quality go, one document of each group of near duplicates stays,
documents that hold benchmark items go, personal values become pseudonyms, and what
is left is packed into token sequences. Every stage is written as Parquet and read
again by the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import jaccard_join, packing, pseudonyms, quality_fm, tiling
from tallyloom.llm.common import free_name, small_side
from tallyloom.session import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the factorisation machine accepts."""
    labels = quality_fm.learnable(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    machine = quality_fm.fit(docs, labels, "quality", ("n_chars",))
    names = free_name(docs, "score"), free_name(docs, "predicted")
    return quality_fm.score(docs, machine, ("n_chars",), names=names).filter(F.col(names[1]) == 1).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component: five-word shingles, similarity 0.8."""
    found = materialise(jaccard_join.join(docs, n=5, num=80, den=100), "near_duplicates").filter("doc_id is not null")
    surplus = found.filter("doc_id != component_id").select("doc_id").distinct()
    kept = docs.join(small_side(surplus, 16), "doc_id", "left_anti").select(*docs.columns)
    repeated = found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    if repeated.limit(1).count():  # rows with one id are one document
        repeated = small_side(repeated, 16)
        once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(once).select(*docs.columns)
    return kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold at least half of a benchmark item's words in common runs."""
    return tiling.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal values by pseudonyms."""
    return pseudonyms.pseudonymise(docs, key="tallyloom")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 1,024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("packing", pack),
]

# Fitted weights and tokens cannot be written in SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
