"""Jaccard join of shingle sets by multiple global orders (operator 13).

A document is the set of its ``shingle``-word runs. If two sets of sizes x and y have a Jaccard
similarity of ``percent`` or more, then under *any* global order of the shingles they share one
among the first ``x - ceil(percent x) + 1`` and the first ``y - ceil(percent y) + 1``: their
prefixes. There are three orders. All put the frequent shingles last (by bands of a count table)
and differ in the hash that orders the shingles within a band. Candidates are the pairs that share
a prefix shingle under the first order; those that do not share one under the second and the third
as well are dropped; only what is left is verified on the texts.

1. ``shapes`` reads the texts once: size and digest of each set, and the count table. The table has
   a fixed number of slots (hashed shingles, summed over all documents); it only directs the orders,
   which are exact whatever it holds. Equal sets are one from here on.
2. ``prefixes`` reads them again: the three prefixes of each distinct set, a parity sketch (two sets
   differ in at least as many shingles as their sketches in bits), and three keys of two least
   hashes each.
3. Stars: the sets of one key are each paired with the least of them (linear), filtered and verified.
   Near copies mostly become one class here, however many they are.
4. Search: the sets of one prefix shingle meet in a task. Shingles whose sets are all of one class are
   dropped; else pairs *of different classes* that pass the size, position and sketch bounds are
   candidates, filtered by the other orders and verified. Pairs within a class are connected already,
   so no link between classes is lost and none is sought twice. A group may be a class of thousands of near
   copies, so of a group of more than ``SMALL`` sets a task gives out a forest of its candidates: a pair whose
   sets its other candidates connect waits. If one of those turns out to be no link, the sets it stood for are
   searched again, with the failed pairs left out. Such failures are rare, since the sketches of large groups
   are wide enough to be nearly exact; the second search lets no pair wait, so it is the last.

Verified links, with those of the stars, give the classes by components.

Bounds: to the driver and broadcast: the bands of the count table (``SLOTS`` bytes, 2 MB) and bitmaps of at most
16 MB that let a scan drop what no candidate needs. A shingle with more than ``most`` sets is dealt into
chunks by hash, each pair of chunks a task of its own. Shingles are compared by 64-bit hashes.

Defined cases: null, empty and wordless texts have size 0, are linked with nothing and are their own
component; texts of fewer words than the shingle are one shingle; a null doc_id is never a component's
id unless no other is there; repeated rows each get their row; very long texts are whole; an empty
table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sifted, stored
from .components import components
from .simhash import Classes
from .lm import IS_WORD
from .scan import LOWER, bounds, mix, slices, window_hashes, word_hashes

SLOTS = 1 << 21
CHUNK = 1 << 13
ORDERS = 3
SALT = [np.uint64(x) for x in (0x1F3D5B79A2C4E687, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1, 0x510E527FADE682D1, 0x9B05688C2B3E6C1F, 0x1F83D9ABFB41BD6B)]


def sets(buf: np.ndarray, offs: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of several texts: the distinct shingle hashes of all (sorted by text, then hash), the text of each, the sizes."""
    low = LOWER[buf]
    s, e, first = bounds(low, offs, IS_WORD)
    words, n = word_hashes(low, s, e), np.diff(first)
    runs = np.maximum(n - shingle + 1, 0)
    of = np.repeat(np.arange(len(n)), runs)
    at = np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs) + first[:-1][of]
    grams = window_hashes(words, shingle)[at]
    short = np.flatnonzero((n > 0) & (n < shingle))
    whole = np.array([window_hashes(words[first[i]:first[i + 1]], int(n[i]))[0] for i in short], dtype=np.uint64)
    of, grams = np.concatenate([of, short]), np.concatenate([grams, mix(whole + np.uint64(1))])
    order = np.lexsort((grams, of))
    of, grams = of[order], grams[order]
    new = np.ones(len(of), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (grams[1:] != grams[:-1])
    of, grams = of[new], grams[new]
    return grams, of, np.bincount(of, minlength=len(n))


def _starts(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size) - size


def _digests(grams: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set that is not empty (0 of the others)."""
    out = np.zeros((2, len(size)), dtype=np.uint64)
    full = size > 0
    if full.any():
        at = _starts(size)[full]
        with np.errstate(over="ignore"):
            for k in range(2):
                out[k, full] = mix(np.add.reduceat(mix(grams ^ SALT[k]), at))
    return out[0].view(np.int64), out[1].view(np.int64)


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(20)).astype(np.int64) & (SLOTS - 1)


def shapes(texts: DataFrame, shingle: int) -> DataFrame:
    """Rows of documents (``doc_id``, ``t``, ``d1``, ``d2``, ``n``) and, with ``chunk``, of the task's count table."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SLOTS, dtype=np.int64)
        held: list[np.ndarray] = []
        for f in frames:
            for a, b, buf, offs in slices(f.column("text")):
                grams, _, size = sets(buf, offs, shingle)
                held.append(_slot(grams))
                if sum(map(len, held)) > SLOTS:
                    table += np.bincount(np.concatenate(held), minlength=SLOTS)
                    held = []
                d1, d2 = _digests(grams, size)
                yield rows(f.column("doc_id").slice(a, b - a), f.column("t").slice(a, b - a), pa.array(d1), pa.array(d2), pa.array(size.astype(np.int64)))
        if held:
            table += np.bincount(np.concatenate(held), minlength=SLOTS)
        table = table.reshape(-1, CHUNK)
        some = np.flatnonzero(table.any(axis=1))
        none = pa.nulls(len(some), pa.int64())
        kinds = ["<u1" if table[k].max() < 1 << 8 else "<u2" if table[k].max() < 1 << 16 else "<u8" for k in some]
        yield rows(none, none, none, none, none, pa.array(some.astype(np.int32)), pa.array([table[k].astype(d).tobytes() for k, d in zip(some, kinds, strict=True)], pa.binary()))

    def rows(*cols: pa.Array) -> pa.RecordBatch:
        n = len(cols[0])
        cols = cols if len(cols) > 5 else (*cols, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()))
        return pa.RecordBatch.from_arrays(list(cols), names=["doc_id", "t", "d1", "d2", "n", "chunk", "counts"])

    return texts.mapInArrow(run, "doc_id long, t long, d1 long, d2 long, n long, chunk int, counts binary")


def bands(shaped: DataFrame) -> np.ndarray:
    """The band of each slot: 0 up to twice the mean count, then one more for each doubling."""
    mean = (shaped.agg(F.sum("n")).first()[0] or 0) // SLOTS

    def added(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for f in frames:
            for k, c in zip(f.column(0).to_pylist(), f.column(1), strict=True):
                c = c.as_py()
                total[k] = total.get(k, 0) + np.frombuffer(c, dtype=f"<u{len(c) // CHUNK}").astype(np.int64)
        of = [np.ceil(np.log2(c // (2 * mean + 1) + 1)).astype(np.uint8).tobytes() for c in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(of, pa.binary())], names=["chunk", "band"])

    table = np.zeros((SLOTS // CHUNK, CHUNK), dtype=np.uint8)
    parts = shaped.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(added, "chunk int, band binary")
    for r in parts.collect():  # SLOTS bytes
        table[r.chunk] = np.frombuffer(r.band, dtype=np.uint8)
    return table.ravel()


def _sketch(grams: np.ndarray) -> tuple[bytes, bytes]:
    """Parities of the set over half a cell a shingle or more (256 to 4,096), and over four cells a shingle (256 to 65,536).

    Folding the halves of a sketch gives the narrower ones.
    """
    n = len(grams)
    bits = min(1 << 16, max(256, 1 << (4 * n - 1).bit_length()))
    wide = np.packbits(np.bincount((grams >> np.uint64(5)).astype(np.int64) & (bits - 1), minlength=bits) & 1 == 1, bitorder="little")
    few = min(4096, max(256, 1 << (n // 2).bit_length())) // 8
    return np.bitwise_xor.reduce(wide.reshape(-1, min(few, len(wide))), axis=0).tobytes(), wide.tobytes()


def prefix_sizes(size: np.ndarray, percent: int) -> np.ndarray:
    return size - -(-percent * size // 100) + 1


def prefixes(texts: DataFrame, band: np.ndarray, shingle: int, percent: int) -> DataFrame:
    """Per document with a set: its digests and size, its prefixes under the orders, its sketch, its keys."""
    sent = texts.sparkSession.sparkContext.broadcast(band)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = sent.value.astype(np.uint64) << np.uint64(58)
        for f in frames:
            for a, b, buf, offs in slices(f.column("text")):
                grams, of, size = sets(buf, offs, shingle)
                full = np.flatnonzero(size)
                if not len(full):
                    continue
                start, last = _starts(size)[full], np.cumsum(size)[full]
                p = prefix_sizes(size[full], percent)
                places = np.repeat(start - _starts(p), p) + np.arange(int(p.sum()))
                late = band[_slot(grams)]
                pre = []
                for k in range(ORDERS):
                    order = np.lexsort((late | mix(grams ^ SALT[k + 2]) >> np.uint64(6), of))
                    flat = grams[order][places]
                    flat = flat.astype("<u8") if k == 0 else (flat >> np.uint64(32)).astype("<u4")  # half a hash will do for a filter
                    flat, cut, wide = flat.tobytes(), (flat.itemsize * np.cumsum(p)).tolist(), flat.itemsize
                    pre.append(pa.array([flat[x - wide * y:x] for x, y in zip(cut, p.tolist(), strict=True)], pa.binary()))
                d1, d2 = _digests(grams, size)
                keys = np.zeros((ORDERS, len(full)), dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(2 * ORDERS):
                        keys[k // 2] = mix(keys[k // 2] + np.minimum.reduceat(mix(grams + SALT[k]), start) + np.uint64(k // 2))
                fold, wide = zip(*[_sketch(grams[x:y]) for x, y in zip(start.tolist(), last.tolist(), strict=True)], strict=True)
                yield pa.RecordBatch.from_arrays([
                    f.column("doc_id").slice(a, b - a).take(pa.array(full)), f.column("t").slice(a, b - a).take(pa.array(full)), pa.array(d1[full]), pa.array(d2[full]),
                    pa.array(size[full].astype(np.int64)), *pre, pa.array(fold, pa.binary()), pa.array(wide, pa.binary()),
                    *[pa.array(x.view(np.int64)) for x in keys]], names=["doc_id", "t", "d1", "d2", "n", "o1", "o2", "o3", "fold", "sketch", "k1", "k2", "k3"])

    return texts.mapInArrow(run, "doc_id long, t long, d1 long, d2 long, n long, o1 binary, o2 binary, o3 binary, fold binary, sketch binary, k1 long, k2 long, k3 long")


def near_sketches(x: bytes, y: bytes, most: int) -> bool:
    """False if the sketches alone show more than ``most`` differing shingles."""
    a, b = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    return int(np.bitwise_count(a ^ b).sum()) <= most


def most_apart(size: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Most shingles in which two sets of ``size`` shingles together may differ."""
    return (100 - percent) * size // (100 + percent)


def filtered(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (``x``, ``y``) that share a prefix shingle under every order and pass the bounds of size and sketch."""
    held = sifted(known.select("id", "n", "o1", "o2", "o3", "sketch"), "id", pairs.select(F.explode(F.array("x", "y")).alias("k")))
    named = ["n", "o1", "o2", "o3", "sketch"]
    joined = (pairs.join(held.select(F.col("id").alias("x"), *[F.col(c).alias(f"x_{c}") for c in named]), "x")
              .join(held.select(F.col("id").alias("y"), *[F.col(c).alias(f"y_{c}") for c in named]), "y"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            size = f.column("x_n").to_numpy() + f.column("y_n").to_numpy()
            keep = []
            for i, most in enumerate(most_apart(size, percent).tolist()):
                if (near_sketches(f.column("x_sketch")[i].as_py(), f.column("y_sketch")[i].as_py(), most)
                        and all(len(np.intersect1d(np.frombuffer(f.column(f"x_{o}")[i].as_py(), kind), np.frombuffer(f.column(f"y_{o}")[i].as_py(), kind)))
                                for o, kind in (("o1", "<u8"), ("o2", "<u4"), ("o3", "<u4")))):
                    keep.append(i)
            yield f.select(["x", "y"]).take(pa.array(keep, pa.int64()))

    return joined.mapInArrow(run, "x long, y long")


def verified(pairs: DataFrame, known: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (``a``, ``b``): the pairs whose texts have the similarity."""
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("k")).distinct()
    place = sifted(known.select("id", "doc_id", "t"), "id", wanted).join(wanted, F.col("id") == F.col("k")).select("id", F.col("doc_id").alias("w_id"), F.col("t").alias("w_t"))
    of = sifted(texts.withColumn("h", F.xxhash64("doc_id", "t")), "h", place.select(F.xxhash64("w_id", "w_t").alias("k")))
    held = (of.join(place, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("t") == F.col("w_t"))).dropDuplicates(["id"]).select("id", "text"))
    held = stored(held, "setjoin-texts")
    joined = (pairs.join(held.select(F.col("id").alias("x"), F.col("text").alias("x_text")), "x")
              .join(held.select(F.col("id").alias("y"), F.col("text").alias("y_text")), "y"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each(column: pa.Array) -> Iterator[np.ndarray]:
            for _, _, buf, offs in slices(column):
                grams, _, size = sets(buf, offs, shingle)
                yield from np.split(grams, np.cumsum(size)[:-1])

        for f in frames:
            keep = []
            for i, (x, y) in enumerate(zip(each(f.column("x_text")), each(f.column("y_text")), strict=True)):
                both = len(np.intersect1d(x, y, True))
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([f.column("x").take(at), f.column("y").take(at)], names=["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


def stars(known: DataFrame) -> DataFrame:
    """(``x``, ``y``): each set with the least one of each of its keys."""
    keyed = known.select("id", F.explode("keys").alias("key"))
    least = keyed.groupBy("key").agg(F.min("id").alias("y"), F.count("*").alias("m")).where("m > 1").select("key", "y")
    return keyed.join(least, "key").where("id <> y").select(F.col("id").alias("x"), "y").distinct()


def _groups(frames: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups of a sorted first column, of about ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for f in frames:
        if not f.num_rows:
            continue
        held.append(f)
        n += f.num_rows
        key = f.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1], "left"))
        if n >= rows and last > 0:  # the last group may go on
            yield pa.Table.from_batches([*held[:-1], f.slice(0, last)])
            held, n = [f.slice(last)], f.num_rows - last
    if held:
        yield pa.Table.from_batches(held)


POSTING = "tok long, id long, root long, n long, pos int"
SMALL = 64  # sets of a shingle up to which their short sketches will do


def within(n: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sizes, and the places of the shared shingle, leave the pairs a chance."""
    shared = np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j])
    return (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & ((100 + percent) * shared >= percent * (n[i] + n[j]))


def postings(known: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(``tok``, ``id``, ``root``, ``n``, ``pos``) of the first order's prefixes, where a shingle has a set of another class within
    the bounds (of large groups: a set of another class); ``m``, how many sets it has."""
    of = known.select("id", "n", "o1").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("id", F.coalesce("root", "id").alias("root"), "n", "o1")

    def spread(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            pre = [np.frombuffer(x.as_py(), dtype="<i8") for x in f.column("o1")]
            if not pre:
                continue
            size = np.array([len(x) for x in pre])
            at = pa.array(np.repeat(np.arange(len(pre)), size))
            pos = (np.arange(int(size.sum())) - np.repeat(_starts(size), size)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(pre)), f.column("id").take(at), f.column("root").take(at), f.column("n").take(at), pa.array(pos)],
                                             names=["tok", "id", "root", "n", "pos"])

    def several(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(frames, 200_000):
            tok, root, n, pos = (t[c].to_numpy() for c in ("tok", "root", "n", "pos"))
            cut = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
            mixed = np.minimum.reduceat(root, cut) < np.maximum.reduceat(root, cut)
            m = np.diff([*cut, len(tok)])
            keep, small = np.repeat(mixed & (m > SMALL), m), np.repeat(mixed & (m <= SMALL), m)
            for d in range(1, int(m[m <= SMALL].max(initial=0))):
                i = np.flatnonzero((tok[d:] == tok[:-d]) & small[d:] & (root[d:] != root[:-d]))
                i = i[within(n, pos, i, i + d, percent)]
                keep[i] = keep[i + d] = True
            keep = np.flatnonzero(keep)
            yield from t.append_column("m", pa.array(np.repeat(m, m))).take(pa.array(keep)).combine_chunks().to_batches()

    return of.mapInArrow(spread, POSTING).repartition("tok").sortWithinPartitions("tok").mapInArrow(several, f"{POSTING}, m long")


def candidates(found: DataFrame, known: DataFrame, tried: DataFrame | None, percent: int, most: int, forest: bool = True) -> DataFrame:
    """(``x``, ``y``, ``part``, ``waits``): per shingle, the pairs of sets of different classes within the bounds.

    Of a large group with ``forest`` only a forest of them: ``part`` numbers its trees, ``waits`` tells that some pair of
    the tree's sets has not been looked at. ``tried`` are pairs known to be no links (``x``, ``y``).
    """
    held = sifted(known.select("id", "fold", "sketch"), "id", found.select(F.col("id").alias("k")))
    if tried is not None:
        both = tried.select(F.explode(F.array(F.struct(F.col("x").alias("id"), F.col("y").alias("o")), F.struct(F.col("y").alias("id"), F.col("x").alias("o")))).alias("p"))
        held = held.join(both.select("p.*").groupBy("id").agg(F.collect_set("o").alias("tried")), "id", "left")
    else:
        held = held.withColumn("tried", F.lit(None).cast("array<long>"))
    chunks = F.ceil(F.col("m") / most).cast("int")
    dealt = found.join(held, "id").withColumn("mine", F.pmod(F.xxhash64("id"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    tasks = (dealt.select(F.xxhash64("tok", F.least("mine", "other"), F.greatest("mine", "other")).alias("task"), "id", "root", "n", "pos", "fold",
                          F.when(F.col("m") > SMALL, F.col("sketch")).alias("sketch"), "tried")
             .repartition("task").sortWithinPartitions("task", "id"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(frames, 50_000):
            task, id_, root, n, pos = (t[c].to_numpy() for c in ("task", "id", "root", "n", "pos"))
            narrow = t["fold"].to_pylist()
            fold = np.array([np.bitwise_xor.reduce(np.frombuffer(x, dtype="<u8").reshape(-1, 4), axis=0) for x in narrow])
            sketch = [w or x for w, x in zip(t["sketch"].to_pylist(), narrow, strict=True)]
            failed = {(i, j) for i, others in zip(id_.tolist(), t["tried"].to_pylist(), strict=True) for j in others or ()}
            trees, waits, out = Classes(len(task)), np.zeros(len(task), dtype=bool), []
            order = np.lexsort((np.arange(len(task)), root, task))  # sets of one class in one group are one tree from the start
            new = np.ones(len(task), dtype=bool)
            new[1:] = (task[order[1:]] != task[order[:-1]]) | (root[order[1:]] != root[order[:-1]])
            trees.of[order] = np.repeat(order[new], np.diff([*np.flatnonzero(new), len(task)]))

            def look(i: np.ndarray, j: np.ndarray, forest: bool) -> None:
                apart = trees.of[i] != trees.of[j] if forest else root[i] != root[j]
                waits[i[~apart & (root[i] != root[j])]] = True
                i, j = i[apart], j[apart]
                size = n[i] + n[j]
                ok = within(n, pos, i, j, percent)
                ok[ok] = np.bitwise_count(fold[i[ok]] ^ fold[j[ok]]).sum(axis=1) <= most_apart(size[ok], percent)
                i, j, size = i[ok], j[ok], size[ok]
                ok = [near_sketches(sketch[a], sketch[b], m) and not (failed and (x, y) in failed)
                      for a, b, m, x, y in zip(i.tolist(), j.tolist(), most_apart(size, percent).tolist(), id_[i].tolist(), id_[j].tolist(), strict=True)]
                i, j = i[ok], j[ok]
                if forest:
                    a, b = np.minimum(trees.of[i], trees.of[j]), np.maximum(trees.of[i], trees.of[j])
                    _, first = np.unique(a * len(task) + b, return_index=True)  # one pair for each two trees
                    if len(first) < len(i):
                        waits[i] = True
                    i, j = i[first], j[first]
                    trees.link(i, j)
                out.append((i, j))

            cut = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1], [True]]))
            size = np.diff(cut)
            small = np.repeat(size <= SMALL, size)
            for d in range(1, int(size[size <= SMALL].max(initial=0))):
                look(i := np.flatnonzero((task[d:] == task[:-d]) & small[d:]), i + d, False)
            for a, m in zip(cut[:-1][size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
                for d in range(1, m):
                    look(i := np.arange(a, a + m - d), i + d, forest)
            if out:
                i, j = (np.concatenate(v) for v in zip(*out, strict=True))
                waiting = np.zeros(len(task), dtype=bool)
                waiting[trees.of[waits]] = True
                part = mix(task.view(np.uint64) ^ mix(id_[trees.of].view(np.uint64))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(id_[i], id_[j])), pa.array(np.maximum(id_[i], id_[j])), pa.array(part[i]), pa.array(waiting[trees.of[i]])],
                                                 names=["x", "y", "part", "waits"])

    return tasks.mapInArrow(run, "x long, y long, part long, waits boolean").distinct()


def classes(docs: DataFrame, shingle: int = 3, percent: int = 90, most: int = 20_000) -> DataFrame:
    """Per document: ``doc_id``, ``n_shingles``, ``component_id`` (least doc_id that links reach)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("t"))
    shaped = stored(shapes(texts, shingle), "setjoin-shapes")
    per_doc = shaped.where("chunk is null").select("doc_id", "d1", "d2", "n")
    distinct = prefixes(texts, bands(shaped), shingle, percent).dropDuplicates(["d1", "d2"])
    known = stored(distinct.select(F.monotonically_increasing_id().alias("id"), "d1", "d2", "n", "doc_id", "t", "o1", "o2", "o3", "fold", "sketch", F.array("k1", "k2", "k3").alias("keys")),
                   "setjoin-sets")

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        left = stored(filtered(stored(pairs, f"{name}-pairs"), known, percent), f"{name}-filtered")
        return stored(verified(left, known, texts, shingle, percent), f"{name}-verified")

    links = [linked(stars(known), "setjoin-stars")]
    searched, tried = known, None
    for forest in (True, False):
        roots = components(reduce(DataFrame.unionAll, links), "setjoin")
        found = stored(postings(searched, roots, percent), "setjoin-postings")
        pairs = stored(candidates(found, searched, tried, percent, most, forest), "setjoin-candidates")
        good = linked(pairs.select("x", "y").distinct(), "setjoin-search")
        links.append(good)
        failed = stored(pairs.join(good.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"], "left_anti"), "setjoin-failed")
        if not failed.where("waits").limit(1).count():
            break
        again = pairs.join(failed.where("waits").select("part").distinct(), "part", "left_semi").select(F.explode(F.array("x", "y")).alias("id")).distinct()
        of = known.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        searched = stored(of.join(of.select("id", "root").join(again, "id").select("root").distinct(), "root", "left_semi").select(*known.columns), "setjoin-again")
        tried = failed.select("x", "y").distinct() if tried is None else tried.unionAll(failed.select("x", "y")).distinct()
    roots = components(reduce(DataFrame.unionAll, links), "setjoin")
    of = known.select("id", "d1", "d2").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select(F.coalesce("root", "id").alias("root"), "d1", "d2")
    least = per_doc.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("doc")).join(of, ["d1", "d2"])
    named = least.select("d1", "d2", "root").join(least.groupBy("root").agg(F.min("doc").alias("component_id")), "root").select("d1", "d2", "component_id")
    linked_docs = per_doc.where("n > 0").join(named, ["d1", "d2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked_docs.unionAll(per_doc.where("n = 0").select("doc_id", F.col("n"), F.col("doc_id")))
