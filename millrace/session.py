"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes that a Python worker gets at a time; what it holds is several times that, for each task of an executor.
PYTHON_BATCH = 8 << 20
#: Written texts: packs them closer than Spark's own choice, and finds what is said again in the next rows of a page.
TEXT_CODEC = "zstd"


def prepare(spark: SparkSession) -> SparkSession:
    """Set what the JSON rules need, a repeated key keeps its last value, and what bounds Python workers' memory."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(PYTHON_BATCH))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor can reach, as the cluster names it.

    Only a local session may fall back to a folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/millrace/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, *by: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once, in folders of the columns ``by``, and read it back.

    Cuts the lineage, and pins rows that a second evaluation could change. ``codec`` is for rows with long texts (``TEXT_CODEC``).
    """
    path = scratch_path(df.sparkSession, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
