"""Spelling variants grouped by PartEnum signatures (operator 12).

A word is seen as a binary vector over (letter, how many of it came before): its letter multiset.
One inserted or deleted letter changes one place of the vector, one replaced letter at most two, so
two near words have a Hamming distance of at most two. The places are dealt into ``parts`` parts;
two vectors that differ in at most two places agree on all but two of the parts, so one signature
per choice of ``parts - 2`` parts (their content, hashed) is exact: near words share one at least.
A pair of equal length takes that form; a pair of which one is a letter longer differs in one place
and shares a signature that leaves one part out. Every word enters both: as of its length, as the
shorter and as the longer one. Words that share a signature meet by an equi-join (one shuffle by
signature) and are verified where they meet: halves compared by hash for whole arrays, then the
words themselves. Only verified pairs leave the task.

``parts`` follows the number of words: more parts mean longer signatures and smaller groups.
Words are counted per task before they are shuffled. Inside, a word is its Latin-1 bytes (every
letter that counts has one), whose order is that of the code points.

The given rule of thinning is part of the input's definition: a run whose crc32 with its document's
id is a multiple of ``mutate`` loses one code point before it is counted.

Bounds: the vocabulary is a stored table and never leaves the executors. A signature's group is the
words of one (partial) letter multiset; a group over ``most`` is dealt into chunks by hash, and each
pair of chunks is a task of its own. Forms at least double ``n``, so paths are no longer than log2
of the largest count, and halving them takes a few rounds.

Defined cases: null and empty texts have no runs; a null doc_id counts as the empty text in the
hash; repeated rows count again; very long texts and runs are whole (a run is one word, however
long); ties of the largest near word go to the first in code-point order; an empty table gives no
rows; extra columns are not carried.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .scan import mix

FLUSH = 500_000
ROWS = 400_000
#: A-Z become a-z; a-z and the letters from U+00C0 on stay; the rest becomes a blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str) -> list[bytes]:
    return text.encode("latin-1", "replace").translate(TABLE).split()


def seen(run: bytes, start: int, mutate: int) -> bytes:
    """The run as it counts; ``start`` is the crc32 of ``<doc_id>:``."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % mutate:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def counts(docs: DataFrame, mutate: int) -> DataFrame:
    """(``w``, ``n``) of all runs, summed in the task first."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for f in frames:
            for i, text in zip(f.column(0).to_pylist(), f.column(1), strict=True):
                if not (text := text.as_py()):
                    continue
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                for r, n in Counter(runs(text)).items():
                    total[seen(r, start, mutate)] += n
            if len(total) > FLUSH:
                yield batch(total)
                total.clear()
        yield batch(total)

    def batch(total: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["w", "n"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")))


def vocabulary(docs: DataFrame, letters: int = 5, times: int = 3, mutate: int = 97) -> DataFrame:
    """(``w``, ``n``): the distinct words of ``letters`` code points and ``times`` occurrences or more."""
    return counts(docs, mutate).where((F.length("w") >= letters) & (F.col("n") >= times))


def parts_for(n_words: int) -> int:
    return 5 if n_words < 3_000_000 else 6 if n_words < 30_000_000 else 8


SAME, SHORT, LONG = 0, 1, 2  # a word among those of its length, as the shorter of a pair, as the longer


def _places(words: list[bytes], n_parts: int) -> np.ndarray:
    """Per word and part, the sum of the hashes of the places that are set in it."""
    size = np.array([len(w) for w in words])
    of = np.repeat(np.arange(len(words)), size)
    letter = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
    order = np.lexsort((letter, of))
    key = of[order] * 256 + letter[order]
    place = np.empty(len(key), dtype=np.uint64)
    place[order] = (np.arange(len(key)) - np.searchsorted(key, key, "left")).astype(np.uint64)  # how many of the letter came before
    h = mix(place * np.uint64(256) + letter.astype(np.uint64) + np.uint64(0x5EED))
    out = np.zeros((len(words), n_parts), dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(out, (of, ((h >> np.uint64(33)) % np.uint64(n_parts)).astype(np.int64)), mix(h))
    return out


def signatures(words: list[bytes], n_parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of words, as (signature, kind, word's index)."""
    part = _places(words, n_parts)
    size = np.array([len(w) for w in words], dtype=np.uint64)
    every = np.arange(len(words))
    sig, kind, of = [], [], []
    with np.errstate(over="ignore"):
        def put(left_out: tuple[int, ...], length: np.ndarray, salt: int, as_kind: int) -> None:
            h = mix(length * np.uint64(64) + np.uint64(salt))
            for p in range(n_parts):
                if p not in left_out:
                    h = mix(h * np.uint64(31) + part[:, p])
            sig.append(h)
            kind.append(np.full(len(words), as_kind, dtype=np.int8))
            of.append(every)

        for k, pair in enumerate(itertools.combinations(range(n_parts), 2)):
            put(pair, size, 32 + k, SAME)
        for p in range(n_parts):
            put((p,), size, p, SHORT)
            put((p,), size - np.uint64(1), p, LONG)
    return np.concatenate(sig), np.concatenate(kind), np.concatenate(of)


def halves(words: list[bytes], kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first and last letters: one edit leaves one of the two halves (of the shorter word) as it is."""
    size = [len(w) - (k == LONG) for w, k in zip(words, kind.tolist(), strict=True)]
    first = np.array([hash(w[:n // 2]) for w, n in zip(words, size, strict=True)], dtype=np.int64)
    last = np.array([hash(w[len(w) - (n - n // 2):]) for w, n in zip(words, size, strict=True)], dtype=np.int64)
    return first, last


def near(a: bytes, b: bytes) -> bool:
    """One replaced letter, or one more in ``b``."""
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (a[at + 1:] == b[at + 1:] if len(a) == len(b) else a[at:] == b[at + 1:])


def group_pairs(key: np.ndarray, kind: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within runs of ``key`` that share a half; the shorter word comes first."""
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.array([0])
    size = np.diff(cut)
    small = np.repeat(size <= 64, size)

    def passing(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (first[i] == first[j]) | (last[i] == last[j])
        i, j = i[ok], j[ok]
        ok = (kind[i] == SAME) | (kind[i] != kind[j])
        i, j = i[ok], j[ok]
        swap = kind[i] > kind[j]
        return np.where(swap, j, i), np.where(swap, i, j)

    for d in range(1, int(size[size <= 64].max(initial=0))):
        yield passing(i := np.flatnonzero((key[d:] == key[:-d]) & small[d:]), i + d)
    for a, n in zip(cut[:-1][size > 64].tolist(), size[size > 64].tolist(), strict=True):
        for d in range(1, n):
            yield passing(i := np.arange(a, a + n - d), i + d)


def near_pairs(words: DataFrame, n_parts: int, most: int = 50_000) -> DataFrame:
    """(``a``, ``b``): near words, each pair once in each direction."""

    def signed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            w = f.column(0).to_pylist()
            if w:
                sig, kind, of = signatures(w, n_parts)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(kind), f.column(0).take(pa.array(of))], names=["sig", "kind", "w"])

    rows = words.select("w").mapInArrow(signed, "sig long, kind byte, w binary")

    def verified(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
            key, kind = t["sig"].to_numpy(), t["kind"].to_numpy()
            alone = np.ones(len(key), dtype=bool)
            alone[1:] &= key[1:] != key[:-1]
            alone[:-1] &= key[1:] != key[:-1]
            at = np.flatnonzero(~alone)
            key, kind, w = key[at], kind[at], t["w"].take(pa.array(at)).to_pylist()
            one, other = [], []
            for i, j in group_pairs(key, kind, *halves(w, kind)):
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    if near(w[x], w[y]):
                        swap = kind[x] == SAME and w[x] > w[y]  # one form of each pair
                        one.append(w[y if swap else x])
                        other.append(w[x if swap else y])
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.binary()), pa.array(other, pa.binary())], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        n = 0
        for f in frames:
            if not f.num_rows:
                continue
            held.append(f)
            n += f.num_rows
            key = f.column(0).to_numpy()
            if n < ROWS or key[-1] == held[0].column(0)[0].as_py():
                continue
            last = int(np.searchsorted(key, key[-1], "left"))  # the last group may go on
            if last == 0:
                continue
            yield from found(pa.Table.from_batches([*held[:-1], f.slice(0, last)]))
            held, n = [f.slice(last)], f.num_rows - last
        if held:
            yield from found(pa.Table.from_batches(held))

    large = stored(rows.groupBy("sig").count().where(F.col("count") > most)
                   .select("sig", F.ceil(F.col("count") / most).cast("int").alias("chunks")), "variant-large")
    dealt = rows.join(large, "sig", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    mine = F.pmod(F.xxhash64("w"), F.col("chunks")).cast("int")
    dealt = (dealt.select("sig", "kind", "w", "chunks", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
             .select(F.when(F.col("chunks") == 1, F.col("sig"))
                     .otherwise(F.xxhash64("sig", F.least("mine", "other"), F.greatest("mine", "other"))).alias("sig"), "kind", "w"))
    pairs = dealt.repartition("sig").sortWithinPartitions("sig").mapInArrow(verified, "a binary, b binary").distinct()
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return pairs.select(both.alias("p")).select("p.a", "p.b")


def roots(forms: DataFrame) -> DataFrame:
    """(``w``, ``root``) of the words with a form (``w``, ``form``): paths are halved until each one ends."""
    now = stored(forms.select("w", F.col("form").alias("root")), "variant-roots")
    while True:
        ahead = now.select(F.col("w").alias("root"), F.col("root").alias("further"))
        now = stored(now.join(ahead, "root", "left").select("w", F.coalesce("further", "root").alias("root"), F.isnotnull("further").alias("moved")), "variant-roots")
        if not now.where("moved").limit(1).count():
            return now.select("w", "root")
        now = now.select("w", "root")


def variants(docs: DataFrame, letters: int = 5, times: int = 3, mutate: int = 97) -> DataFrame:
    """Per word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``."""
    words = stored(vocabulary(docs, letters, times, mutate), "variant-words")
    pairs = near_pairs(words, parts_for(words.count()))
    of = (pairs.join(words.select(F.col("w").alias("b"), F.col("n").alias("n_b")), "b")
          .groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b"))).alias("best")))
    every = stored(words.join(of.withColumnRenamed("a", "w"), "w", "left").select(
        "w", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.less") >= 2 * F.col("n"), F.col("best")).alias("best")), "variant-forms")
    every = every.select("w", "n", "n_near", F.col("best.b").alias("form"), (-F.col("best.less")).alias("form_n"))
    last = roots(every.where("form is not null"))
    out = every.join(last, "w", "left")

    def word(c: str) -> Column:
        return F.decode(F.col(c), "ISO-8859-1")

    return out.select(word("w").alias("word"), word("form").alias("form"), F.coalesce(word("root"), word("w")).alias("root"), "n", "n_near", "form_n")
