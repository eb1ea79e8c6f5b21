"""The corpus pipeline: stages over documents, each written and read again before the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.llm import bpe, decontaminate, quality_trees, secret_ledger, simhash
from pagelode.llm.components import shared_folder

#: Quality below which a document goes.
LEAST_QUALITY = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from `labels` on the pipeline's own documents."""
    trees = quality_trees.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    into = "score"
    while into in map(str.lower, docs.columns):
        into = f"_{into}"
    return quality_trees.score(docs, trees, into=into).where(F.col(into) >= LEAST_QUALITY).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: that with the least doc_id, or, among rows that share it, the
    least hash over all columns; rows without a doc_id come last. Rows equal in all columns are one."""
    mark = lambda seed: F.xxhash64(F.lit(seed), *docs.columns).alias(f"h{seed}")
    rows = docs.select(F.struct(*docs.columns).alias("row"), mark(1), mark(2))
    own = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("id"), "h1", "h2")
    found = simhash.near_duplicates(rows.select(own.alias("key"), F.col("row.text").alias("text")), "key")
    kept = found.where("key = component_id").select("key.h1", "key.h2").distinct()
    first = rows.join(kept, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    return first.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars of what is left."""
    masked = secret_ledger.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every document."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), decoded=True).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: Trees, fingerprint components, edit distances and BPE have no SQL; the tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and read again.

    Null, empty and very long texts, null ids, repeated rows and further columns of any name pass each
    stage as its operator defines; an empty table gives an empty one."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
