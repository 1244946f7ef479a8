"""LM scoring by a probabilistic suffix tree over words (operator 8).

Symbols are words (lower-cased A-Z, parted by white space) and one end per text. The root
is the word distribution with absolute discounting; the discounted mass is that of the one
unknown word. A context is a candidate if it occurs ``least_state`` times in the training
text. Its next-symbol distribution keeps the successors seen ``least_pair`` times with it
(discounted by ``DISCOUNT``); the rest of its mass goes to the other symbols in proportion
to the suffix's distribution, so every state sums to one. A candidate is retained if its
distribution diverges (Kullback-Leibler, nats) from its suffix's by ``divergence``. A token
is scored in the longest retained suffix state. Levels grow from the candidates among the
kept runs of the level before, up to ``depth`` words.

A run of words is a hash of the two runs that are one word shorter, so it is counted by
(context, suffix) and both are at hand. The log probability of a token is the sum over the
runs that end at it of fixed values: its root, ``extra`` of each kept successor (what it is
above its suffix's value and its context's ``rest``) and ``rest`` of each retained context.
States and successors are stored tables, as large as the evidence makes them. The most
frequent (at most ``head`` words, contexts and successors a level; or, if ``p_word`` is given,
those of that probability) are broadcast; the others are joined to the runs of each text,
summed by text first, that pass a filter of at most ``FILTER_BITS`` bits. A filter passes more than it should, never
less, and the joins drop what is not there, so both are exact at any size.

Defined cases: null, empty and wordless texts are one end token; a null doc_id counts as
the empty text in the split; repeated rows train and score each for themselves; with no
training row every probability is 1 (base and score 0); an empty table gives no rows;
extra columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .scan import LOWER, Index, bounds, mix, slices, word_hashes

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[32, 9, 10, 11, 12, 13]] = False
END = np.uint64(0xE0D0E0D0E0D0E0D1)
DISCOUNT = 0.75
FLUSH = 1_000_000
FILTER_BITS = 1 << 27
SALTS = 8
STATE = np.uint64(0x51A7E51A7E51A7E5)  # parts the key of a run as a context from its key as a successor


@dataclass(frozen=True)
class Thresholds:
    """Least counts of contexts and successors; the probabilities ``p_next``, ``p_state`` and ``p_pair`` only if asked for."""

    p_word: float | None = None  # of what is broadcast; None: the ``head`` most frequent of each table
    head: int = 1_000_000
    p_next: float = 0.0
    p_state: float = 0.0
    p_pair: float = 0.0
    divergence: float = 0.02
    least_state: int = 20
    least_pair: int = 4
    depth: int = 2


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of several texts (words, then the end) and the text of each."""
    low = LOWER[buf]
    s, e, first = bounds(low, offs, IS_WORD)
    n = np.diff(first)
    of = np.repeat(np.arange(len(n)), n + 1)
    out = np.full(len(of), END)
    out[np.arange(len(s)) + np.repeat(np.arange(len(n)), n)] = word_hashes(low, s, e)
    return out, of


def counted(texts: DataFrame, keys: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(``key``, ``n``) of the 64-bit keys that ``keys(tokens, text)`` gives; summed in the task first."""
    return _counted(texts, lambda tok, of: keys(tok, of)[:, None], ["key"])


def _counted(texts: DataFrame, keys: Callable[[np.ndarray, np.ndarray], np.ndarray], names: list[str]) -> DataFrame:
    """The same for rows of several 64-bit columns."""

    def summed(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(rows):
            return rows, n
        order = np.lexsort(rows.T) if rows.shape[1] > 1 else np.argsort(rows[:, 0], kind="stable")
        rows, n = rows[order], n[order]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        at = np.flatnonzero(new)
        return rows[at], np.add.reduceat(n, at)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], []

        def batch(rows: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(c).view(np.int64)) for c in rows.T], pa.array(n)], names=[*names, "n"])

        for f in frames:
            for _, _, buf, offs in slices(f.column(0)):
                rows = keys(*tokens(buf, offs))
                rows, n = summed(rows, np.ones(len(rows), dtype=np.int64))
                held.append(rows)
                count.append(n)
                if sum(map(len, held)) > 2 * FLUSH:
                    rows, n = summed(np.concatenate(held), np.concatenate(count))
                    held, count = [rows], [n]
                    if len(rows) > FLUSH:
                        yield batch(rows, n)
                        held, count = [], []
        if held:
            yield batch(*summed(np.concatenate(held), np.concatenate(count)))

    schema = ", ".join(f"{c} long" for c in [*names, "n"])
    return texts.select("text").mapInArrow(run, schema).groupBy(*names).agg(F.sum("n").alias("n"))


def collected(df: DataFrame, *columns: str) -> list[np.ndarray]:
    rows = df.select(*columns).toArrow()
    return [rows[c].to_numpy() for c in columns]


class Filter:
    """A Bloom filter of the keys of a table, of at most ``FILTER_BITS`` bits."""

    def __init__(self, keys: DataFrame, size: int):
        bits = min(FILTER_BITS, 1 << max(10, int(16 * size).bit_length()))

        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.zeros(bits // 64, dtype=np.uint64)
            for f in frames:
                for at in Filter.places(f.column(0).to_numpy().view(np.uint64), bits):
                    np.bitwise_or.at(table, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(table[at].view(np.int64))], names=["at", "mask"])

        self.bits, self.table = bits, np.zeros(bits // 64, dtype=np.uint64)
        if size:
            at, mask = collected(keys.mapInArrow(run, "at long, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")), "at", "mask")
            self.table[at] = mask.view(np.uint64)
        self.size = size

    @staticmethod
    def places(key: np.ndarray, bits: int) -> Iterator[np.ndarray]:
        step = mix(key ^ np.uint64(0x5DEECE66D)) | np.uint64(1)
        for k in range(4):
            with np.errstate(over="ignore"):
                yield ((key + np.uint64(k) * step) & np.uint64(bits - 1)).astype(np.int64)

    def passes(self, key: np.ndarray) -> np.ndarray:
        out = np.full(len(key), self.size > 0)
        for at in self.places(key, self.bits) if self.size else ():
            out &= (self.table[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)) > 0
        return out


@dataclass
class Level:
    """The broadcast contexts of one length with log10 of the share left to the suffix, and the broadcast successors."""

    states: Index
    rest: np.ndarray
    pairs: Index
    extra: np.ndarray


@dataclass
class Model:
    n: int
    v: int
    discount: float
    words: Index
    log_root: np.ndarray
    log_count: np.ndarray  # log10(c + 1)
    levels: list[Level]
    head: Column  # of the counts: the words that are broadcast
    others: DataFrame | None = None  # (key, value) of the states and successors that are not broadcast

    def unknown(self) -> float:
        return float(np.log10(self.discount * self.v / self.n)) if self.n else 0.0


def longer(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Key of the run whose first words are ``context`` and whose last words are ``suffix``."""
    with np.errstate(over="ignore"):
        return mix(mix(context + np.uint64(1)) + suffix)


def runs(tok: np.ndarray, of: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For lengths 1 to ``most``: where a run of that many words of one text ends, and its key."""
    at, key = np.arange(len(tok)), tok
    for length in range(1, most + 1):
        yield at, key
        full = np.zeros(len(tok), dtype=np.uint64)
        full[at] = key
        at = at[at >= length]
        at = at[of[at] == of[at - length]]
        key = longer(full[at - 1], full[at])


def walk(model: Model, ids: np.ndarray, of: np.ndarray) -> np.ndarray:
    """log10 probability of each token by what is broadcast; one without an id gets the factor before its root probability."""
    tok = np.full(len(ids), STATE)
    tok[ids >= 0] = model.words.keys[ids[ids >= 0]]
    p = np.where(ids >= 0, model.log_root[ids], 0.0) if len(model.log_root) else np.zeros(len(ids))
    return p + walked(model.levels, tok, of, None)[0]


def walked(levels: list[Level], tok: np.ndarray, of: np.ndarray, others: Filter | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the levels add to each token's log10 probability; the tokens and keys that the other states and successors may add to."""
    p, where, keys = np.zeros(len(tok)), [np.empty(0, np.int64)], [np.empty(0, np.uint64)]

    def add(index: Index, value: np.ndarray, at: np.ndarray, key: np.ndarray, tag: np.uint64) -> None:
        found = index.find(key)
        p[at[found >= 0]] += value[found[found >= 0]]
        if others is not None:
            left = found < 0
            at, key = at[left], key[left] ^ tag
            there = others.passes(key)
            where.append(at[there])
            keys.append(key[there])

    for length, (at, key) in enumerate(runs(tok, of, len(levels) + 1)):
        if length:
            add(levels[length - 1].pairs, levels[length - 1].extra, at, key, np.uint64(0))
        if length < len(levels):
            inner = at + 1 < len(tok)
            inner[inner] = of[at[inner] + 1] == of[at[inner]]
            add(levels[length].states, levels[length].rest, at[inner] + 1, key[inner], STATE)
    return p, np.concatenate(where), np.concatenate(keys)


def keyed(df: DataFrame) -> DataFrame:
    """Add the ``key`` of the run of ``ctx`` and ``suf``."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            key = longer(*(f.column(c).to_numpy().view(np.uint64) for c in ("ctx", "suf")))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *f.columns], names=["key", *f.schema.names])

    return df.select("ctx", "suf", "n").mapInArrow(run, "key long, ctx long, suf long, n long")


def frequent(df: DataFrame, column: str, t: Thresholds, n: int) -> Column:
    """Whether a row of ``df`` is broadcast, by its number of occurrences: at most ``t.head`` rows are, whatever the size.

    Rows are counted by steps of a quarter of a power of two; whole steps are taken from the top.
    """
    if t.p_word is not None:
        return F.col(column) >= t.p_word * n
    step = F.floor(4 * F.log2(column))
    least, held = None, 0
    for s, rows in sorted(map(tuple, df.groupBy(step.alias("step")).count().collect()), reverse=True):
        held += rows
        if held > t.head:
            break
        least = s
    return F.lit(False) if least is None else step >= least


def train(texts: DataFrame, t: Thresholds) -> tuple[Model, DataFrame]:
    """The model, and the exact counts of all training words (``key``, ``n``)."""
    spark = texts.sparkSession
    counts = stored(counted(texts, lambda tok, of: tok), "word-counts")
    n, v, n1, n2 = counts.agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    n, discount = n or 0, min(0.9, max(0.1, n1 / (n1 + 2 * n2) if n1 else 0.5))
    head = frequent(counts, "n", t, n)
    key, c = collected(counts.where(head).orderBy(F.desc("n"), "key"), "key", "n")
    model = Model(n, v, discount, Index(key.view(np.uint64)), np.log10((c - discount) / max(n, 1)), np.log10(c + 1.0), [], head)
    evidence = max(t.least_state, t.p_state * n)
    known = counts.where(F.col("n") >= max(t.least_pair, t.p_next * n)).select(
        "key", "n", F.log10((F.col("n") - discount) / n).alias("t"), (F.col("key") == F.lit(int(END.view(np.int64)))).alias("end")) if n else None
    others: list[DataFrame] = []
    while n and len(model.levels) < t.depth:
        length = len(model.levels) + 1
        open_ = (F.col("n") >= evidence) & ~F.col("end")
        some, size = known.agg(F.count_if(open_), F.count("*")).first()
        if not some:
            break
        candidates = known.where(open_)
        held = spark.sparkContext.broadcast((Filter(candidates.select("key"), some), Filter(known.select("key"), size)))

        def pairs(tok: np.ndarray, of: np.ndarray, length: int = length, held=held) -> np.ndarray:
            contexts, ends = held.value
            *_, (at, key) = runs(tok, of, length)
            full, there = np.zeros(len(tok), dtype=np.uint64), np.zeros(len(tok), dtype=bool)
            full[at], there[at] = key, True
            at = at[at > 0]
            at = at[there[at - 1] & (of[at - 1] == of[at])]
            at = at[contexts.passes(full[at - 1])]
            at = at[ends.passes(full[at])]
            return np.stack([full[at - 1], full[at]], axis=1)

        kept = _counted(texts, pairs, ["ctx", "suf"]).where(F.col("n") >= max(t.least_pair, t.p_pair * n))
        got = stored(keyed(kept).join(known.select(F.col("key").alias("suf"), "t", "end"), "suf"), f"runs-{length}")
        held.unpersist()
        m, ln10 = F.col("n") - DISCOUNT, math.log(10)
        sums = got.groupBy("ctx").agg(F.sum(m).alias("a"), F.sum(F.pow(F.lit(10.0), "t")).alias("s"), F.sum(m * (F.log(m) - F.col("t") * ln10)).alias("b"))
        left, other = 1 - F.col("a") / F.col("times"), F.greatest(1 - F.col("s"), F.lit(1e-12))
        diverges = (F.col("b") - F.col("a") * F.log("times")) / F.col("times") + left * F.log(left / other)
        states = stored(sums.join(candidates.select(F.col("key").alias("ctx"), F.col("n").alias("times")), "ctx")
                        .where(diverges >= t.divergence).select("ctx", "times", F.log10(left / other).alias("rest")), f"states-{length}")
        # a context of many successors is dealt by a salt
        salted = states.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = F.log10(m / F.col("times"))
        known = stored(got.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(salted, ["ctx", "salt"], "left").select(
            "key", "n", F.coalesce(own, "t").alias("t"), "end", (own - F.col("t") - F.col("rest")).alias("extra")), f"known-{length}")
        after = known.where(F.col("extra").isNotNull())
        often, near = frequent(states, "times", t, n), frequent(after, "n", t, n)
        key, rest = collected(states.where(often).orderBy("ctx"), "ctx", "rest")
        pair, extra = collected(after.where(near).orderBy("key"), "key", "extra")
        model.levels.append(Level(Index(key.view(np.uint64)), rest, Index(pair.view(np.uint64)), extra))
        others += [states.where(~often).select(F.col("ctx").bitwiseXOR(F.lit(int(STATE.view(np.int64)))).alias("key"), F.col("rest").alias("value")),
                   after.where(~near).select("key", F.col("extra").alias("value"))]
    if others and not (rest_of := reduce(DataFrame.unionByName, others)).isEmpty():
        model.others = rest_of
    return model, counts


SCORED = ("doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, "
          "rare array<long>, times array<long>, keys array<long>, key_times array<long>")


def _per_text(of: np.ndarray, key: np.ndarray, size: int) -> list[pa.Array]:
    """Per text its distinct keys, and how often each."""
    order = np.lexsort((key, of))
    of, key = of[order], key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    cuts = pa.array(np.searchsorted(of[at], np.arange(size + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (key[at].view(np.int64), np.diff([*at, len(key)]).astype(np.int64))]


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Per text: sums over what is broadcast, and its other words and other keys with their number."""
    others = Filter(model.others.select("key"), model.others.count()) if model.others is not None else None
    held = docs.sparkSession.sparkContext.broadcast((model.words, model.log_root, model.log_count, model.levels, others))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, log_root, log_count, levels, others = held.value
        for f in frames:
            for a, b, buf, offs in slices(f.column("text")):
                tok, of = tokens(buf, offs)
                ids = words.find(tok).astype(np.int64)
                known, size = ids >= 0, b - a
                p, at, key = walked(levels, tok, of, others)
                base = np.zeros(len(ids))
                if len(log_count):
                    base = np.where(known, log_count[ids], 0.0)
                    p += np.where(known, log_root[ids], 0.0)
                yield pa.RecordBatch.from_arrays([
                    f.column("doc_id").slice(a, size), f.column("held_out").slice(a, size),
                    pa.array(np.bincount(of, minlength=size)), pa.array(np.bincount(of, known, size).astype(np.int64)),
                    pa.array(np.bincount(of, base, size)), pa.array(np.bincount(of, p, size)),
                    *_per_text(of[~known], tok[~known], size), *_per_text(of[at], key, size),
                ], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "times", "keys", "key_times"])

    return docs.mapInArrow(run, SCORED)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def score(docs: DataFrame, t: Thresholds | None = None) -> DataFrame:
    """Per document: tokens, known tokens, the add-one base score and the suffix tree's score."""
    t = t or Thresholds()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    model, counts = train(rows.where(~F.col("held_out")), t)
    per_doc = stored(scored(rows, model).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = per_doc.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    c = F.coalesce("n", F.lit(0))
    root = F.when(c > 0, F.log10((c - model.discount) / max(model.n, 1))).otherwise(F.lit(model.unknown()))
    sums = (rare.join(counts.where(~model.head), "key", "left").groupBy("row")
            .agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("r_known"),
                 F.sum(F.col("times") * F.log10(c + 1.0)).alias("r_base"), F.sum(F.col("times") * root).alias("r_score")))
    scale = float(np.log10(model.n + model.v + 1))
    if model.others is not None:
        by_key = (per_doc.select("row", F.explode(F.arrays_zip("keys", "key_times")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.key_times").alias("times"))
                  .join(model.others, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("o_score")))
        sums = sums.join(by_key, "row", "full")
    else:
        sums = sums.withColumn("o_score", F.lit(0.0))
    return (per_doc.drop("rare", "times", "keys", "key_times").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("r_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("r_base", F.lit(0.0)) - F.col("n_tokens") * scale).alias("base_score"),
        (F.col("score") + F.coalesce("r_score", F.lit(0.0)) + F.coalesce("o_score", F.lit(0.0))).alias("score")))
