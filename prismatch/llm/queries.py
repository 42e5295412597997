"""The subpackage's queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prismatch.llm.code_index import neighbour_query
from prismatch.llm.context_mixing import score_documents
from prismatch.llm.decontaminate import contamination_digest
from prismatch.llm.fill_middle import MIDDLE_SQL, middle_digest
from prismatch.llm.language_mix import language_report
from prismatch.llm.license_scan import license_digest
from prismatch.llm.ngram_join import ngram_components
from prismatch.llm.periodic_runs import run_digest
from prismatch.llm.pieces import PIECE_MODEL, token_digest
from prismatch.llm.preferences import PREFERENCE_SQL, preference_query
from prismatch.llm.substring_dedup import substring_digest
from prismatch.llm.suffix_levels import string_digest
from prismatch.llm.url_filter import url_verdicts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op5_url_models")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages"))


@query("op8_decontaminate")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query("op10_substring_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digest(_table(spark, sf_dir, "documents"))


@query("op7_ngram_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents"))


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


@query("op6_sentencepiece")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(_table(spark, sf_dir, "documents"), piece_model())


@query("op3_language_mix")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(_table(spark, sf_dir, "documents"))


@query("op2_preferences", PREFERENCE_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_query(_table(spark, sf_dir, "conversations"))


@query("op9_license_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(_table(spark, sf_dir, "documents"))


@query("op1_code_index")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_query(_table(spark, sf_dir, "embeddings"))


@query("op4_context_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


@query("op11_fill_middle", MIDDLE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle_digest(_table(spark, sf_dir, "documents"))


@query("op12_suffix_levels")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_digest(_table(spark, sf_dir, "documents"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(_table(spark, sf_dir, "documents"))
