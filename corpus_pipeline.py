"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, source mixing, token files.

Every stage works on all that the one before has kept; all but the last return the columns of documents.

Inputs and defined results
- null or empty texts: pass the first three stages (they share no shingle or window with anything); the mix takes none of
  them, for they have no words. Very long texts are whole.
- null doc_id: never a near-duplicate; the mix takes it like any other, and the token files hold it first.
- repeated rows: one of equal rows stays after the near-duplicate stage; a doc_id with unlike texts is one document.
- empty tables: no rows at any stage. Extra columns of documents go along up to the mix; those of the other tables are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.llm import decontaminate, mixing, neardup, scratch, tokenfiles, toxicity
from ledgerlake.llm.entries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go; clean ones stay."""
    return toxicity.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (five-word shingles, similarity 0.8 or more)."""
    return neardup.dedupe(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards; a row per document as read back from them."""
    return tokenfiles.encode(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

#: The stages train a classifier and use hashes that SQL does not have; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.materialize(docs, f"stage-{name}")
    return docs
