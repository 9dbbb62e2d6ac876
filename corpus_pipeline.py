"""A corpus pipeline: documents to packed training sequences; each stage works on what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm import cotraining, exact_dedup, jaccard, packing, surrogates
from pairwright.llm.common import materialize

#: Of the corpus owner; whoever has it can draw the same surrogates again.
SURROGATE_KEY = "a key of the corpus owner"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject.

    Each row is judged by itself, repeated ids and rows without one too; a null text is judged as an
    empty one. Without documents or labels of both classes nothing is fitted.
    """
    return cotraining.drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest id; null and empty texts are one group.

    Of rows with the same id and text one stays, and so of copies without any id.
    """
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 of five-word shingles, that with the smallest id.

    Null and empty texts, texts without words and rows without id are linked with nothing and stay.
    Rows are dropped by id, which ``documents`` holds once.
    """
    return jaccard.drop_near_copies(docs, jaccard.JaccardSpec(words=5, share=80, over=100))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in place of personal data; ``n_chars`` follows the text.

    Null texts stay null; every row stays, repeated ones too.
    """
    replaced = surrogates.replace_personal_data(docs, SURROGATE_KEY).select(docs.columns)
    if "n_chars" not in docs.columns:
        return replaced
    kind = docs.schema["n_chars"].dataType
    changed = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind))
    return replaced.withColumn("n_chars", changed).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1,024 tokens, with their ids; a null text is the end id alone.

    An empty table has no pieces; further columns are not read.
    """
    return packing.pack_documents(
        docs,
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Classifier, surrogates and tokens cannot be told in SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
