"""From raw documents to tokens, in five stages. Each takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.llm import bpe, decontaminate, jaccard_join, suffix_dedup, toxicity
from cataloom.llm.queries import tokenizer_path
from cataloom.llm.storage import stored

#: Columns of documents, in order.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of the documents at hand, doesn't reject."""
    model = toxicity.train(toxicity.labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.keep_accepted(docs.select(*COLUMNS), model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the least doc_id."""
    return jaccard_join.keep_one(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes and more that start earlier in the corpus; n_chars follows the text.
    A document that loses all its text stays, with an empty text."""
    cut = suffix_dedup.remove_repeats(docs, carry=["lang", "source"])
    return cut.select(F.col("id").alias("doc_id"), F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the word-level BPE for every document, with hashes of the ids and of the decoded text."""
    return bpe.encode_texts(docs, tokenizer_path(), with_ids=True).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("repeats", cut_repeats), ("benchmark", drop_benchmark), ("tokens", tokenize)]

#: SQL can't express a trained classifier, suffix sorting or a tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
