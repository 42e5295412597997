"""From raw documents to token ids, in five stages.

Every stage is a function of (spark, docs, sf_dir). Its result is written as
Parquet and read again as the next stage's documents, so a lost executor costs
no more than the stage at work. All stages but the last return the columns of
``documents`` (and any further ones they were given).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismatch.llm.decontaminate import remove_contaminated
from prismatch.llm.language_mix import with_language
from prismatch.llm.ngram_join import one_of_each_group
from prismatch.llm.pieces import encode
from prismatch.llm.queries import piece_model
from prismatch.llm.substring_dedup import cut_documents
from prismatch.session import stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents get the language that their text is found to be in; those in which none is found go."""
    return with_language(docs)


def join_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id stays."""
    return one_of_each_group(docs)


def cut_repeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur earlier are cut out of the texts."""
    return cut_documents(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids of every text and their number."""
    return encode(docs, piece_model(), out="ids").withColumn("n_tokens", F.size("ids"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", join_similar),
    ("substring dedup", cut_repeated),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode_pieces),
]

#: The stages learn models and encode by a vocabulary, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, work) in enumerate(STAGES):
        docs = work(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{k}")
    return docs
