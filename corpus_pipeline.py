"""The training-data pipeline: five stages over ``documents``, each one of the operators of ``scoreloom.llm``.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and returns the columns of ``documents``; the last adds
the tokens. Each result is written as Parquet and read again as the next stage's input.

Defined cases: null and empty texts are scored like any other text by the quality stage and pass the later stages, which find
nothing in them; repeated rows (same doc_id) are one document for the near-duplicate stage, which keeps one of them; an empty
table passes through; further columns of ``documents`` are carried along (tokens, n_tokens, round_trip and decoded are refused).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm import bpe, decontam, minhash, pii, quality
from scoreloom.session import reliable_checkpoints


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, similarity of 0.8 or more)."""
    return minhash.keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up a twentieth or more go."""
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by surrogates, and n_chars follows the text."""
    done = pii.replace_personal_data(docs)
    return done.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else done


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether decoding gives the text back."""
    if clash := sorted({"tokens", "n_tokens", "round_trip", "decoded"} & set(docs.columns)):
        raise ValueError(f"columns of documents with names of the result: {clash}")
    done = bpe.round_trip(docs, bpe.default_path())
    return done.select(*docs.columns, "tokens", F.size("tokens").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal data", personal_data_stage),
    ("tokens", token_stage),
]

#: The classifier, the surrogates and the tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them goes to the shared folder that checkpoints use."""
    reliable_checkpoints(spark)
    folder = f"{spark._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
