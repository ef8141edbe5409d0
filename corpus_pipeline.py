"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows the stage before kept and
returns documents with the same columns; the last returns the mix, with how often
each document is taken.  ``run`` writes each stage as Parquet to the shared folder
and reads it again for the next.

A task holds an Arrow batch several times over, in the JVM and in its Python worker.
Spark lets a batch grow to 64 MB; where a session leaves it at that, the stages set
``BATCH_BYTES`` for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dailybars.llm import chosen_path, personal_data, qgram_decontam, source_mix, subword_bag
from dailybars.plans.cut import written

BATCH_BYTES = 2 << 20
_KEY, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def _small_batches(spark: SparkSession) -> None:
    if spark.conf.get(_KEY) == _DEFAULT:
        spark.conf.set(_KEY, str(BATCH_BYTES))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below one half; the model learns from ``labels`` of the documents given."""
    _small_batches(spark)
    model = subword_bag.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "toxicity"
    while name in docs.columns:  # a column that documents do not have yet
        name += "_"
    return subword_bag.scored(docs, model, name).filter(F.col(name) < 0.5).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    _small_batches(spark)
    return chosen_path.distinct(docs).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    _small_batches(spark)
    return qgram_decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced by its kind; n_chars follows the text."""
    _small_batches(spark)
    return personal_data.redacted(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with all their columns, their size, the words taken and the number of times."""
    _small_batches(spark)
    return source_mix.mix_sources(docs, fill=True, carry=[c for c in docs.columns if c != "doc_id"]).filter("times > 0")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("privacy", privacy), ("mixing", mixing)]

#: The first two stages rest on a learned model and on hashing, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
