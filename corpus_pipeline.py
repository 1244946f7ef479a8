"""The corpus pipeline: documents through five operators, each stage written and reread.

1. language ID: documents without a recognised language go (``und``, or a score below 0.5).
2. line dedup: later repeated runs of 50 words or more go from the texts, and documents left without a line.
3. SimHash near-dedup: the document of the least doc_id of each class stays.
4. benchmark decontamination: documents holding a passage of the benchmark go.
5. packing: what is left, as pieces of sequences of at most 1024 tokens.

Stages 1 to 4 return the columns of ``documents``; ``n_chars`` follows the text that stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempovar.llm import decontaminate, langid, linededup, packing, simhash
from tempovar.llm.common import scratch, table
from tempovar.llm.queries import TOKENIZER


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = linededup.clean(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_near_dedup", simhash_near_dedup),
          ("benchmark_decontamination", benchmark_decontamination), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is stored in the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: A SimHash, a tokenizer and a learned filter are beyond SQL: tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None
