"""Token counts through a digest cache (operator 5).

The cache is a Parquet table (digest of the normalised content, digest of the tokenizer
version, count). A run reduces the documents to content digests, anti-joins the distinct
ones to the cache, encodes one text per missing digest, appends those counts, and joins
counts back by digest. Texts are shuffled once, by document, never by digest: of the copies of one
text, that of the least doc_id alone is encoded. Rows that repeat it are encoded once.

Normalised content: null becomes the empty text, and nothing else changes, since any other
change can change the count. Defined results: null counts as empty (0 bytes, 0 tokens
under a byte-level tokenizer); repeated rows each get their row; rows without an id too; very long texts are encoded whole;
an empty table gives no rows and appends nothing; extra columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import scratch, stored
from .tokens import batches, encoder

CACHE = "digest binary, tokenizer string, n_tokens long"
SEEN = 500_000  # digests that a task remembers


def version(tokenizer: str) -> str:
    """Digest of the tokenizer file and of the library that reads it."""
    import tokenizers
    with open(tokenizer, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def cached(spark, path: str, tokenizer: str) -> DataFrame:
    """Counts of this tokenizer version; one row per digest also if two runs stored it."""
    try:
        rows = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], CACHE)
    return rows.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encoded(texts: DataFrame, path: str, tokenizer: str) -> DataFrame:
    """Counts of the texts (``digest``, ``text``), one row a digest.

    Rows that repeat a document come to one task, which encodes a digest once (it remembers the last ``SEEN``).
    """

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, seen = encoder(path), set()
        for f in frames:
            if len(seen) > SEEN:
                seen.clear()
            digests = f.column(0).to_pylist()
            first = {d: i for i, d in reversed([*enumerate(digests)]) if d not in seen}
            seen.update(first)
            at = pa.array(sorted(first.values()), pa.int64())
            n = [len(b) // 4 for run in batches(f.column(1).take(at).to_pylist()) for b in code.ids(run)]
            yield pa.RecordBatch.from_arrays([f.column(0).take(at), pa.array([tokenizer] * len(n), pa.string()), pa.array(n, pa.int64())],
                                             names=["digest", "tokenizer", "n_tokens"])

    return texts.mapInArrow(count, CACHE).dropDuplicates(["digest"])


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 1024) -> DataFrame:
    """Per document: ``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit``.

    ``cache`` is the folder of the cache, read first and appended to; None takes a new one
    in the shared folder.
    """
    spark, kind = docs.sparkSession, version(tokenizer)
    cache = cache or scratch(spark, "token-cache")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    full = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    keys = stored(full.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "digests")
    missing = (keys.groupBy("digest").agg(F.min("doc_id").alias("first"))
               .join(cached(spark, cache, kind), "digest", "left_anti")
               .select(F.col("digest").alias("_digest"), "first"))
    texts = (full.join(missing, F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("digest") == F.col("_digest")), "left_semi")
             .select("digest", "text"))
    encoded(texts, tokenizer, kind).write.mode("append").parquet(cache)
    return (keys.join(cached(spark, cache, kind), "digest")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
