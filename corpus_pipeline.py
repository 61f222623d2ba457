"""From raw documents to packed training windows, in five stages.

Each stage is written as Parquet to the shared folder and read again, so a lost executor or a
restart never reaches further back than one stage.

Defined results, for every stage. Null text: as an empty one. An empty table gives an empty one.
Repeated rows are judged each by itself, but for near duplicates, where one of them stays. Columns
other than those of ``documents`` are dropped, whatever their names. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import decontam, jaccard, packing, pii, quality
from millrace.session import settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def as_documents(df: DataFrame) -> DataFrame:
    """The columns of ``documents``, with the length of the text as it is now."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines that the rules reject. Wrapped lines share their marks.

    Null, empty and short texts are rejected.
    """
    kept = quality.judge_quality(docs, prose=True).filter("kept")
    return as_documents(kept.withColumn("text", F.col("clean_text")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the smallest id.

    Texts without a word are linked with nothing but equal texts.
    """
    return as_documents(jaccard.one_per_class(docs))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go. Without items, or without words, none does."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return as_documents(decontam.contamination(docs, items).filter("not contaminated"))


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind; texts without any stay as they are, null ones too."""
    return as_documents(pii.redact(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its place in a sequence of at most 1024 tokens.

    A document without text is its end mark.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("decontaminate", decontaminate_stage), ("privacy", privacy_stage), ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents`` of a folder; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
