"""The queries and oracle SQL of this subpackage, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.llm import decontaminate, languagemodel, linechunks, mixing, neardup, perspectives, repetition, tokenfiles, toxicity, warc
from ledgerlake.llm.scratch import documents

#: Word shingles of the near-duplicate contract.
CONTRACT_SHINGLE = 4
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.scan(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(warc.archive(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.measure(documents(spark, sf_dir))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languagemodel.score(documents(spark, sf_dir))


def op5_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linechunks.report(linechunks.dedupe(documents(spark, sf_dir)))


def op5_line_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linechunks.report(linechunks.dedupe_passages(documents(spark, sf_dir)))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.encode(documents(spark, sf_dir), tokenizer_path())


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(documents(spark, sf_dir), size=CONTRACT_SHINGLE)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.report(perspectives.rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OPERATORS = (op1_decontaminate, op2_warc, op3_repetition, op4_language_model, op5_line_chunks, op5_line_passages, op6_token_files, op7_near_duplicates, op8_toxicity, op9_perspectives, op10_mix, pipeline)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": warc.ORACLE_SQL, "op5_line_chunks": linechunks.ORACLE_SQL, "op9_perspectives": perspectives.ORACLE_SQL, "op10_mix": mixing.ORACLE_SQL}
