"""Line dedup by winnowing over line hashes (operator 6), in column expressions only.

Unit: lines that hold a word (others count for nothing). A window is the shortest run of
such lines from a line on, or up to a line, that holds ``min_words`` words; a long line is
a window by itself. Each window selects its least line hash, the rightmost of equal ones:
any run of ``min_words`` words shared by two places shares a selected fingerprint. Only
windows whose fingerprint occurs at two positions go on: there the match is extended both
ways to the whole window (two 64-bit hashes of the line sequence), and every occurrence but
the first in (doc_id, line) order is deleted. Every line of a repeated run lies in such a
window, so overlapping windows delete whole maximal runs.

Result: a line goes if it lies in a run of at least ``min_words`` words whose same lines
begin earlier in the corpus; lines without words inside a deleted window go with it. A run
that repeats itself with overlap collapses to its first period. Defined cases: null and
wordless texts stay as they are; rows equal in doc_id and text are one document and all
their rows get its result; one doc_id with two texts is two documents, ordered by text
hash; a null doc_id comes first; an empty table stays empty; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"


def _document(docs: DataFrame) -> tuple[Column, Column]:
    """doc_id and a hash of the text: the identity of a document."""
    return docs["doc_id"].cast("long"), F.xxhash64(docs["text"].cast("string"))


def windows(docs: DataFrame, min_words: int) -> DataFrame:
    """Windows of each document: lines ``a`` to ``b``, content ``c1``/``c2``, fingerprint ``h`` at line ``at``."""
    doc_id, d = _document(docs)
    text = docs["text"].cast("string")
    lines = (docs.select(doc_id.alias("doc_id"), d.alias("d"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
             .select("doc_id", "d", "pos", F.regexp_count("line", F.lit(WORD)).alias("words"),
                     F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"))
             .where("words > 0")
             .repartition("doc_id", "d").dropDuplicates(["doc_id", "d", "pos"]))
    of = Window.partitionBy("doc_id", "d")
    upto = lines.withColumn("upto", F.sum("words").over(of.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    upto = upto.withColumn("before", F.col("upto") - F.col("words"))

    def frame(w) -> Column:
        return F.struct(
            F.sum("words").over(w).alias("words"), F.min("pos").over(w).alias("a"), F.max("pos").over(w).alias("b"),
            F.xxhash64(F.collect_list("h1").over(w)).alias("c1"), F.xxhash64(F.lit(1), F.collect_list("h2").over(w)).alias("c2"),
            F.min(F.struct(F.col("h1").alias("h"), (-F.col("pos")).alias("p"))).over(w).alias("least"))

    onward = frame(of.orderBy("before").rangeBetween(0, min_words - 1))
    back = frame(of.orderBy("upto").rangeBetween(1 - min_words, 0))
    both = upto.select("doc_id", "d", "words", onward.alias("onward"), back.alias("back"))
    # a window up to a line that would do without that line is no onward window yet
    return (both.select("doc_id", "d", F.explode(F.array(
                F.when(F.col("onward.words") >= min_words, F.col("onward")),
                F.when(F.col("back.words") - F.col("words") >= min_words, F.col("back")))).alias("w"))
            .where("w is not null")
            .select("doc_id", "d", "w.a", "w.b", "w.c1", "w.c2", F.col("w.least.h").alias("h"), (-F.col("w.least.p")).alias("at")))


def removed(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Lines to delete of each document that has any: ``doc_id``, ``d`` (text hash), ``lines`` (sorted)."""
    w = stored(windows(docs, min_words), "line-windows")
    twice = (w.select("h", "doc_id", "d", "at").distinct().groupBy("h").count().where("count > 1").select("h"))
    seeds = w.join(twice, "h", "left_semi").select("doc_id", "d", "a", "b", "c1", "c2").distinct()
    place = F.struct("doc_id", "d", "a")
    first = (seeds.groupBy("c1", "c2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
             .where("n > 1").drop("n"))
    later = seeds.join(first, ["c1", "c2"]).where(~place.eqNullSafe(F.col("first")))
    return (later.select("doc_id", "d", F.explode(F.sequence("a", "b")).alias("line"))
            .groupBy("doc_id", "d").agg(F.sort_array(F.collect_set("line")).alias("lines")))


def dedup(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``row`` (all columns, ``text`` without the deleted lines), ``n_lines`` and ``n_removed``."""
    doc_id, d = _document(docs)
    gone = removed(docs, min_words).select(F.col("doc_id").alias("g_id"), F.col("d").alias("g_d"), F.col("lines").alias("gone"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), doc_id.alias("r_id"), d.alias("r_d"))
    joined = rows.join(gone, F.col("r_id").eqNullSafe(F.col("g_id")) & (F.col("r_d") == F.col("g_d")), "left")
    text = F.col("row")["text"].cast("string")
    lines = F.split(text, "\n", -1)
    kept = F.element_at(F.transform(F.array(lines), lambda x: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone")), lambda i: F.get(x, i)), "\n")), 1)
    return joined.select(
        F.struct(*[F.when(F.col("gone").isNull(), text).otherwise(kept).alias(c) if c == "text" else F.col("row")[c].alias(c)
                   for c in docs.columns]).alias("row"),
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def clean(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """The documents without their later repeated runs; one that loses all its lines goes."""
    out = dedup(docs, min_words)
    return out.where("n_removed = 0 or n_removed < n_lines").select("row.*")


def report(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Per document: lines, deleted lines, digest of the text that stays (null of null)."""
    return dedup(docs.select("doc_id", "text"), min_words).select(
        F.col("row.doc_id").cast("long").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.col("row.text"), 256).alias("text_sha256"))
