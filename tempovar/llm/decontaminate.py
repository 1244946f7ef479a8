"""Benchmark decontamination by a broadcast hash set of test n-grams (operator 2).

Words are runs of 0-9, a-z (after lower-casing A-Z) and anything beyond ASCII. A window is
``n`` consecutive words of an item; an item of fewer words is one window. Documents are
scanned in Arrow batches: 64-bit window hashes are looked up in the set, and each hit is
verified by comparing the words themselves. A document word inside any occurrence of a
window is hit.

The set is broadcast only up to ``max_windows`` windows, counted first. A larger benchmark
is split by a hash of the item into blocks under that bound, and the same pass over the
documents carries each row through block after block.

Defined results: a null or wordless text has no words, items and hits; a null or wordless
item has no window; a null item_id counts as an item named "null"; rows of the benchmark
with one item_id are one item; repeated document rows each get their row; an empty
benchmark hits nothing; extra columns are not carried by ``hits`` and are by ``clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import LOWER, Index, bounds, slices, window_hashes, word_hashes

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[:0x30] = IS_WORD[0x3A:0x61] = IS_WORD[0x7B:0x80] = False
_WORDS = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCANNED = "doc_id long, text string, n_words long, spans array<struct<s:long,e:long>>, items array<string>"


def item_windows(item_id: str | None, text: str | None, n: int) -> list[tuple[str, bytes, int]]:
    """(item, words joined by spaces, number of words) of each window."""
    words = _WORDS.findall((text or "").encode().lower())
    width = min(n, len(words))
    name = "null" if item_id is None else str(item_id)
    return [(name, b" ".join(words[i:i + width]), width) for i in range(len(words) - width + 1)] if words else []


class HashSet:
    """The windows of one block of the benchmark, by width."""

    def __init__(self, windows: list[tuple[str, bytes, int]]):
        items: dict[int, dict[bytes, set[str]]] = {}
        for item, joined, width in windows:
            items.setdefault(width, {}).setdefault(joined, set()).add(item)
        self.items, self.index = items, {}
        for width, of in items.items():
            flat = np.frombuffer(b" ".join(of), dtype=np.uint8)
            s, e, _ = bounds(flat, np.array([0, len(flat)]), IS_WORD)
            self.index[width] = Index(np.unique(window_hashes(word_hashes(flat, s, e), width)[::width]))

    def scan(self, buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
        """Per text: number of words, hit word spans in order, items found."""
        low = LOWER[buf]
        s, e, first = bounds(low, offs, IS_WORD)
        words = word_hashes(low, s, e)
        found: dict[int, list[tuple[int, int, frozenset[str]]]] = {}
        for width, index in self.index.items():
            at = np.flatnonzero(index.find(window_hashes(words, width)) >= 0)
            doc = np.searchsorted(first, at, "right") - 1
            for i, d in zip(at.tolist(), doc.tolist(), strict=True):
                if i + width <= first[d + 1]:
                    joined = b" ".join(low[a:b].tobytes() for a, b in zip(s[i:i + width], e[i:i + width], strict=True))
                    if items := self.items[width].get(joined):
                        found.setdefault(d, []).append((i - int(first[d]), i - int(first[d]) + width, items))
        for d in range(len(offs) - 1):
            hits = sorted(found.get(d, []), key=lambda h: h[:2])
            yield int(first[d + 1] - first[d]), [h[:2] for h in hits], set().union(*(h[2] for h in hits))


def _scan(docs: DataFrame, block: HashSet) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(block)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        for f in frames:
            spans, items = f.column("spans").to_pylist(), f.column("items").to_pylist()
            for a, b, buf, offs in slices(f.column("text")):
                got = list(block.scan(buf, offs))
                yield pa.RecordBatch.from_arrays([
                    f.column("doc_id").slice(a, b - a), f.column("text").slice(a, b - a),
                    pa.array([g[0] for g in got], pa.int64()),
                    pa.array([(spans[a + i] or []) + [{"s": s, "e": e} for s, e in g[1]] for i, g in enumerate(got)],
                             pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
                    pa.array([(items[a + i] or []) + sorted(g[2]) for i, g in enumerate(got)], pa.list_(pa.string())),
                ], names=["doc_id", "text", "n_words", "spans", "items"])

    return docs.mapInArrow(run, SCANNED)


def blocks(benchmark: DataFrame, n: int, max_windows: int) -> Iterator[HashSet]:
    """Hash sets of at most about ``max_windows`` windows each, collected one at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = F.octet_length("text") / 2  # words take two bytes at least, but for the last
    k = int((items.agg(F.sum(size)).first()[0] or 0) // max_windows) + 1
    for i in range(k):
        part = items if k == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(k)) == i)
        yield HashSet([w for r in part.toLocalIterator() for w in item_windows(r.item_id, r.text, n)])


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_windows: int = 1_000_000) -> DataFrame:
    """Documents with ``n_words``, hit word ``spans`` and ``items`` found (sorted, distinct)."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                      F.lit(0).cast("long").alias("n_words"),
                      F.lit(None).cast("array<struct<s:long,e:long>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    for block in blocks(benchmark, n, max_windows):
        out = _scan(out, block)
    return out


def n_hit(spans: F.Column) -> F.Column:
    """Words covered by the spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    return F.aggregate(F.array_sort(spans), start, lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["to"]))).alias("n"),
        F.greatest(acc["to"], x["e"]).alias("to")), lambda acc: acc["n"])


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_windows: int = 1_000_000) -> DataFrame:
    """Per document: words, hit words, items with windows in it, their digest, verdict."""
    items = F.array_sort(F.array_distinct("items"))
    return scan(docs, benchmark, n, max_windows).select(
        "doc_id", "n_words", n_hit(F.col("spans")).alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_windows: int = 1_000_000) -> DataFrame:
    """The documents without a hit, all columns kept. Rows are matched by id and text, so one
    id under two texts is judged text by text."""
    found = (scan(docs, benchmark, n, max_windows).where(F.size("spans") > 0)
             .select(F.col("doc_id").alias("f_id"), F.xxhash64("text").alias("f_d")).distinct())
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("r_id"),
                       F.xxhash64(docs["text"].cast("string")).alias("r_d"))
    return rows.join(found, F.col("r_id").eqNullSafe(F.col("f_id")) & (F.col("r_d") == F.col("f_d")), "left_anti").select("row.*")
