"""The corpus pipeline: each stage works on all documents that the one before it kept.

Stages keep all columns of their input, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylog.llm import decontaminate, ngram_join, packing, substring_dedup, toxicity
from skylog.llm.tables import drop_folder, key_columns, read, shared_folder


def _whole(docs: DataFrame) -> DataFrame:
    """Each row as one struct, beside the key and salt that tell it apart."""
    return docs.select(F.struct("*").alias("row"), *key_columns())


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity score of 0.5 or more; the model learns from labels of training documents."""
    learnt = read(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    return toxicity.score_rows(docs, toxicity.fit(docs, learnt)).where("score < 0.5").select("row.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each link class: the least doc_id (a null one first), of equal ones that with the least text hash.

    Rows that repeat doc_id and text are one document. Documents without words are linked with nothing:
    every row of them is kept. Rows whose ids are null or clash are told apart by their texts alone.
    """
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    texts = docs.where(worded)
    best = ngram_join.link_classes(texts).groupBy("class").agg(F.min(F.struct("key", "salt")).alias("best")).select("best.*")
    kept = _whole(texts).join(best, ["key", "salt"], "left_semi").dropDuplicates(["key", "salt"])
    return kept.select("row.*").unionByName(docs.where(~worded))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 35 words or more that occur more than once; the documents stay, and n_chars is counted anew."""
    cut = substring_dedup.remove_repeats(docs).where("n_removed > 0").select(
        "key", "salt", F.col("text").alias("rest")
    ).dropDuplicates(["key", "salt"])
    rows = _whole(docs).join(cut, ["key", "salt"], "left")
    changed, kind = F.col("rest").isNotNull(), dict(docs.dtypes)
    new = {"text": F.col("rest"), "n_chars": F.length("rest")}
    return rows.select(
        *(
            F.when(changed, new[c].cast(kind[c])).otherwise(F.col(f"row.`{c}`")).alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns
        )
    )


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or all of a shorter one."""
    hit = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark")).where("n_hit > 0").select("key", "salt").distinct()
    return _whole(docs).join(hit, ["key", "salt"], "left_anti").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places all documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_join", without_near_copies),
    ("substring_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Scores, link classes and packings are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each one's rows are written to the shared folder and read again.

    A stage's rows are deleted once the next one's are written; those of the last stay, for the caller reads them.
    """
    docs, folder = read(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    done = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if done:
            drop_folder(spark, f"{folder}/{done}")
        done = name
    return docs
