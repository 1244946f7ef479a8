"""Language identification by language-bitmask n-gram filters (operator 10).

Training counts the letter trigrams (words lower-cased and space-bounded) of each language.
A trigram enters a language's filter if it occurs there at least ``min_count`` times and at
least ``min_share`` as often, by rate, as in the language that has it most. The filters are
bit-sliced: one table of ``slots`` words whose bit l belongs to language l, so the AND of
the words at a trigram's hash positions is the bitmask of all languages that contain it. A
text's count per language is the popcount of that bit over its trigrams; from it the number
expected from false positives (fill of the language's bits to the power of hashes) is taken.
The largest corrected count decides; its share of the trigrams is the score.

The filter is fitted on at most about ``max_train`` labelled rows. Each language has an equal
share of them: one with fewer rows is learned whole, a larger one is thinned to its share by a
hash of doc_id and text, so a rare language learns from all it has. The filter's size is ``slots`` words, whatever the corpus. Prediction reads every text whole
and uses the text alone.

Defined cases: a text that is null or has no letter, and any text if no language was
learned, is ``und`` with score 0; ties go to the first language by name; rows with a null
lang are not learned from; a null doc_id counts as the empty text in the split by crc32;
repeated rows count each time; very long texts are read whole; more than ``MAX_LANGUAGES``
languages are an error; an empty table gives no rows; extra columns are kept by ``accepted`` only.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import mix
from .tokens import batches

HASHES = 4
MAX_LANGUAGES = 63 * 16
#: Characters of texts that a worker takes apart at once: some 60 bytes each while it does.
CHARS = 1 << 19


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed letter trigrams of texts and the text each is of."""
    joined = "".join(f" {t.replace(chr(0), ' ').lower()} \0" for t in texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    end, letter = cp == 0, letters()[cp]
    cp = np.where(letter | end, cp, np.uint64(32))
    keep = np.ones(len(cp), dtype=bool)
    keep[1:] = (cp[1:] != 32) | (cp[:-1] != 32)
    cp, letter, end = cp[keep], letter[keep], end[keep]
    packed = cp[:-2] << np.uint64(42) | cp[1:-1] << np.uint64(21) | cp[2:]
    of = np.cumsum(end)[1:-1]
    inner = letter[1:-1]
    return packed[inner], of[inner]


def _held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def gram_counts(docs: DataFrame) -> DataFrame:
    """(``lang``, ``gram``, ``n``) over labelled rows, pre-counted per batch."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            langs, texts = np.array(f.column(0).to_pylist(), dtype=object), np.array(f.column(1).to_pylist(), dtype=object)
            for lang in dict.fromkeys(langs.tolist()):
                total: dict[int, int] = {}
                for part in batches(texts[langs == lang].tolist(), CHARS):
                    for g, n in zip(*(v.tolist() for v in np.unique(grams(part)[0], return_counts=True)), strict=True):
                        total[g] = total.get(g, 0) + n
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(total), pa.string()), pa.array(list(total), pa.int64()),
                                                  pa.array(list(total.values()), pa.int64())], names=["lang", "gram", "n"])

    return (docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


class Filters:
    """The bit-sliced filters: ``table[word][slot]`` holds one bit per language."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table
        fill = [np.count_nonzero(table[i // 63] >> np.uint64(i % 63) & np.uint64(1)) / table.shape[1] for i in range(len(languages))]
        self.false = np.array(fill) ** HASHES

    @staticmethod
    def positions(gram: np.ndarray, slots: int) -> list[np.ndarray]:
        h, step = mix(gram), mix(gram ^ np.uint64(0x5DEECE66D)) | np.uint64(1)
        with np.errstate(over="ignore"):
            return [(h + np.uint64(k) * step) % np.uint64(slots) for k in range(HASHES)]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        return [g for part in batches(texts, CHARS) for g in self._predict(part)]

    def _predict(self, texts: list[str]) -> list[tuple[str, float]]:
        gram, of = grams(texts)
        n = np.bincount(of, minlength=len(texts))
        at = self.positions(gram, self.table.shape[1])
        count = np.zeros((len(self.languages), len(texts)))
        for w in range(len(self.table)):
            mask = self.table[w][at[0]]
            for p in at[1:]:
                mask &= self.table[w][p]
            for i in range(63 * w, min(63 * w + 63, len(self.languages))):
                count[i] = np.bincount(of, (mask >> np.uint64(i % 63) & np.uint64(1)).astype(float), minlength=len(texts))
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        true = np.clip((count - n * self.false[:, None]) / np.maximum(1 - self.false[:, None], 1e-9), 0, None)
        best = true.argmax(axis=0)
        share = np.minimum(1.0, true[best, np.arange(len(texts))] / np.maximum(n, 1))
        return [(self.languages[b], float(s)) if m else ("und", 0.0) for b, s, m in zip(best, share, n, strict=True)]


def train(docs: DataFrame, max_train: int = 50_000, slots: int = 1 << 20, min_count: int = 2, min_share: float = 0.1) -> Filters:
    """Filters from the labelled rows outside the held-out fold."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~_held_out(F.col("doc_id"), 4, 2))
    per_lang = rows.groupBy(F.col("lang").cast("string").alias("lang")).count().limit(MAX_LANGUAGES + 1).collect()
    if len(per_lang) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(r["lang"] for r in per_lang)
    share = max_train / max(1, len(languages))
    thinned = {r["lang"]: int(1_000_000 * share / r["count"]) for r in per_lang if r["count"] > share}
    if thinned:
        most = F.create_map(*[F.lit(x) for pair in thinned.items() for x in pair])
        place = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text").cast("string")), F.lit(1_000_000))
        rows = rows.where(place < F.coalesce(F.try_element_at(most, F.col("lang").cast("string")), F.lit(1_000_000)))
    counts = gram_counts(rows)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("all"))
    rates = counts.join(totals, "lang").withColumn("rate", F.col("n") / F.col("all"))
    most = rates.groupBy("gram").agg(F.max("rate").alias("most"))
    chosen = rates.join(most, "gram").where((F.col("n") >= min_count) & (F.col("rate") >= min_share * F.col("most"))).select("lang", "gram")

    def places(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {lang: i for i, lang in enumerate(languages)}
        for f in frames:
            bit = np.array([index[x] for x in f.column(0).to_pylist()], dtype=np.int64)
            for at in Filters.positions(f.column(1).to_numpy().astype(np.uint64), slots):
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(bit // 63), pa.array(np.int64(1) << (bit % 63))],
                                                 names=["slot", "word", "mask"])

    # at most slots x words rows come back
    sliced = chosen.mapInArrow(places, "slot long, word long, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros((max(1, -(-len(languages) // 63)), slots), dtype=np.uint64)
    table[sliced["word"].to_numpy(), sliced["slot"].to_numpy()] = sliced["mask"].to_numpy().astype(np.uint64)
    return Filters(languages, table)


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """Per document: ``doc_id``, text hash ``d``, ``lang_pred``, ``score``."""
    held = docs.sparkSession.sparkContext.broadcast(filters)  # slots x words x 8 bytes

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            got = held.value.predict(f.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([f.column(0), f.column(2), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                                             names=["doc_id", "d", "lang_pred", "score"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")))
            .mapInArrow(run, "doc_id long, d long, lang_pred string, score double"))


def predictions(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``held_out``, ``lang_pred``, ``score``."""
    return identify(docs, train(docs)).select("doc_id", _held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The documents, all columns kept, whose language is known with at least ``min_score``."""
    bad = (identify(docs, train(docs)).where((F.col("lang_pred") == "und") | (F.col("score") < min_score))
           .select(F.col("doc_id").alias("b_id"), F.col("d").alias("b_d")).distinct())
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("r_id"),
                       F.xxhash64(docs["text"].cast("string")).alias("r_d"))
    return rows.join(bad, F.col("r_id").eqNullSafe(F.col("b_id")) & (F.col("r_d") == F.col("b_d")), "left_anti").select("row.*")
