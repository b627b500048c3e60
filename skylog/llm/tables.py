"""What the operators share about input tables: reading, row keys and checkpoints."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NO_ID = -(1 << 63)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def key_columns(text: str = "text") -> list[Column]:
    """``key`` and ``salt`` tell rows apart: the doc_id (the least long if null) and 64 bits of the text's hash.

    Rows that repeat both doc_id and text are equal to each other and get equal results.
    """
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("key"), F.xxhash64(F.col(text)).alias("salt")]


def keyed(documents: DataFrame, text: str = "text") -> DataFrame:
    """key, salt and text of every row."""
    return documents.select(*key_columns(text), F.col(text).cast("string").alias("text"))


def doc_id():
    return F.when(F.col("key") != _NO_ID, F.col("key")).alias("doc_id")


def shared_folder(spark: SparkSession) -> str:
    """The folder for written tables that the cluster names in spark.checkpoint.dir.

    Where it names none, a local session makes one of its own; elsewhere that is an error, for no other
    machine would see it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder and read again, without lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a written table in whatever store the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
