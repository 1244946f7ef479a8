"""Substring dedup by paragraph MinHash banding (operator 3).

A paragraph is a line of at least ``min_words`` words (lower-cased A-Z, parted by white
space); its set is that of its ``shingle``-word runs, as 64-bit hashes. Equal paragraphs are
one before anything is compared. ``tune_bands`` takes the fewest rows per band that keep
chance collisions rare, then as many bands as the recall at the threshold asks for.

Paragraphs that collide in a band are verified by exact Jaccard. A bucket is searched by
breadth: a paragraph's intersections with all not yet reached ones come from one pass over
the posting lists of its shingles, and what it reaches is never compared again, so a
bucket of variants of one text costs one such pass. The task returns the least member each
one is connected to, never pairs. A bucket of more than ``most`` is dealt into chunks by
hash and each pair of chunks is a task. Components over these links are the clusters; all
but the first paragraph in (doc_id, line) order of each is marked for removal.

A passage inside longer lines, or across line breaks that differ, is no line. ``passages``
finds it: of every ``found`` words in a row, the run of ``least`` words with the least hash
(a MinHash of one row and band over the runs) is a paragraph too. So two documents that share
``found`` words in a row share such a run; equal runs (128 bits of hash) are clusters, and
runs that follow one another in both a document and the cluster's first one are one passage.
A passage of fewer than ``least`` words is never reported. ``repeats`` gives lines and
passages; a passage of which every line is reported already is left out.

Defined cases: null texts and short lines have no paragraphs; rows equal in doc_id and text
are one document (a cluster of them alone removes nothing); one doc_id with two texts is
two documents, ordered by text hash; a null doc_id comes first; an empty table gives no
rows; extra columns are not carried. A passage counts once in a document, at its first place
there, and is one row even where the document's row is repeated; one that stands in a single
document is none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .components import components
from .lm import IS_WORD
from .scan import LOWER, bounds, mix, slices, window_hashes, word_hashes


def tune_bands(threshold: float, recall: float = 0.999, background: float = 0.05, chance: float = 0.002) -> tuple[int, int]:
    """(bands, rows): a pair at the threshold collides with at least ``recall``, one at ``background`` with at most ``chance``."""
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))
        if 1 - (1 - background ** rows) ** bands <= chance:
            return bands, rows
    raise ValueError("no banding reaches these bounds")


def paragraphs(buf: np.ndarray, offs: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """Of several texts: word hashes, and for each paragraph its text, line, first word and number of words."""
    low = LOWER[buf]
    feeds = np.flatnonzero(low == 10) + 1
    lines = np.union1d(offs, feeds) if len(buf) else offs
    s, e, first = bounds(low, lines, IS_WORD)
    n = np.diff(first)
    of = np.searchsorted(offs, lines[:-1], "right") - 1
    line = np.arange(len(of)) - np.searchsorted(lines, offs)[of]
    wide = np.flatnonzero(n >= min_words)
    return word_hashes(low, s, e), of[wide], line[wide], first[:-1][wide], n[wide]


def _runs(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all members of runs, and where each run starts among them."""
    at = np.cumsum(n) - n
    return np.arange(int(n.sum())) + np.repeat(first - at, n), at


PARAGRAPH = "doc_id long, d long, line int, n_words long, p1 long, p2 long, bands array<long>"


def signed(docs: DataFrame, min_words: int, shingle: int, bands: int, rows: int) -> DataFrame:
    """Every paragraph with a 128-bit hash of its words and its band keys."""
    rng = np.random.default_rng(20240229)
    factor = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
    plus = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for a, b, buf, offs in slices(f.column("text")):
                words, of, line, first, n = paragraphs(buf, offs, min_words)
                if not len(of):
                    continue
                with np.errstate(over="ignore"):
                    every, at = _runs(first, n)
                    place = mix((np.arange(len(every)) - np.repeat(at, n)).astype(np.uint64) + np.uint64(11))
                    p1 = mix(np.add.reduceat(mix(words[every] ^ place), at))
                    p2 = mix(np.add.reduceat(mix(words[every] + place * np.uint64(5)), at) + np.uint64(7))
                    every, at = _runs(first, n - shingle + 1)
                    grams = window_hashes(words, shingle)[every]
                    keys = np.zeros((len(of), bands), dtype=np.uint64)
                    for k in range(bands * rows):
                        least = np.minimum.reduceat(mix_light(grams * factor[k] + plus[k]), at)
                        keys[:, k // rows] = mix(keys[:, k // rows] + least)
                yield pa.RecordBatch.from_arrays([
                    f.column("doc_id").slice(a, b - a).take(pa.array(of)), f.column("d").slice(a, b - a).take(pa.array(of)),
                    pa.array(line.astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(p1.view(np.int64)), pa.array(p2.view(np.int64)),
                    pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel().view(np.int64)), bands).cast(pa.list_(pa.int64())),
                ], names=["doc_id", "d", "line", "n_words", "p1", "p2", "bands"])

    return docs.mapInArrow(run, PARAGRAPH)


RUN = "doc_id long, d long, start long, line int, last int, first_worded int, last_worded int, p1 long, p2 long"


def _sliding(h: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` (minimum or maximum) of each run of ``width`` values, by doubling."""
    out, have = h, 1
    while have < width:
        step = min(have, width - have)
        out, have = best(out[:-step], out[step:]), have + step
    return out


def chosen_runs(words: np.ndarray, text: np.ndarray, found: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of ``least`` words that have the least hash of some ``found`` words of their text, and their hashes."""
    width = found - least + 1
    if len(words) < found:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = window_hashes(words, least)
    inside = text[:len(words) - found + 1] == text[found - 1:]
    low = np.where(inside, _sliding(h, width, np.minimum), np.uint64(0))
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero((h == _sliding(np.concatenate([edge, low, edge]), width, np.maximum)) & (h > 0))
    # of equal runs of a text, the first
    at = at[np.lexsort((at, h[at], text[at]))]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (h[at[1:]] != h[at[:-1]]) | (text[at[1:]] != text[at[:-1]])
    at = np.sort(at[new])
    return at, h[at]


def run_rows(docs: DataFrame, found: int, least: int) -> DataFrame:
    """The chosen runs of every text: first word, lines, and the places of these among the lines that have words."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for a, b, buf, offs in slices(f.column("text")):
                low = LOWER[buf]
                lines = np.union1d(offs, np.flatnonzero(low == 10) + 1) if len(buf) else offs
                s, e, first = bounds(low, lines, IS_WORD)
                if len(s) < found:
                    continue
                words = word_hashes(low, s, e)
                of = np.searchsorted(offs, lines[:-1], "right") - 1
                line = np.arange(len(of)) - np.searchsorted(lines, offs)[of]
                worded = np.cumsum(np.diff(first) > 0)
                seg = np.repeat(np.arange(len(of)), np.diff(first))
                at, p1 = chosen_runs(words, of[seg], found, least)
                if not len(at):
                    continue
                p2 = np.zeros(len(at), dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(least):
                        p2 = mix_light(p2 * np.uint64(0x9FB21C651E98DF25) + words[at + k] + np.uint64(k))
                t, here, there = of[seg[at]], seg[at], seg[at + least - 1]
                yield pa.RecordBatch.from_arrays([
                    f.column("doc_id").slice(a, b - a).take(pa.array(t)), f.column("d").slice(a, b - a).take(pa.array(t)),
                    pa.array(at - first[np.searchsorted(lines, offs)[t]]), pa.array(line[here].astype(np.int32)), pa.array(line[there].astype(np.int32)),
                    pa.array(worded[here].astype(np.int32)), pa.array(worded[there].astype(np.int32)), pa.array(p1.view(np.int64)), pa.array(p2.view(np.int64)),
                ], names=["doc_id", "d", "start", "line", "last", "first_worded", "last_worded", "p1", "p2"])

    return docs.mapInArrow(run, RUN)


def mix_light(h: np.ndarray) -> np.ndarray:
    return h ^ (h >> np.uint64(29))


def shingle_sets(docs: DataFrame, wanted: DataFrame, min_words: int, shingle: int) -> DataFrame:
    """(``p1``, ``grams``): the shingle set of each wanted paragraph (``doc_id``, ``d``, ``line``, ``p1``).

    Only the texts that hold one leave the join; they are read once more.
    """
    of_doc = wanted.groupBy("doc_id", "d").agg(F.collect_list(F.struct("line", "p1")).alias("wanted"))
    held = docs.join(of_doc.select(F.col("doc_id").alias("w_id"), F.col("d").alias("w_d"), "wanted"),
                     F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("d") == F.col("w_d"))).dropDuplicates(["doc_id", "d"])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            wants = f.column("wanted").to_pylist()
            for a, _, buf, offs in slices(f.column("text")):
                words, of, line, first, n = paragraphs(buf, offs, min_words)
                grams = window_hashes(words, shingle)
                at = {(int(o), int(x)): (int(i), int(i + m - shingle + 1)) for o, x, i, m in zip(of, line, first, n, strict=True)}
                out = [(w["p1"], np.unique(grams[slice(*at[o, w["line"]])]).view(np.int64)) for o in range(len(offs) - 1) for w in wants[a + o]]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([g for _, g in out], pa.list_(pa.int64()))],
                                                 names=["p1", "grams"])

    return held.select("text", "wanted").mapInArrow(run, "p1 long, grams array<long>")


def jaccard_classes(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Least index of the class of each set under links of at least ``threshold``."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    of = np.repeat(np.arange(m), size)
    _, gram = np.unique(np.concatenate(sets), return_inverse=True)
    by_gram = of[np.argsort(gram, kind="stable")]
    start = np.concatenate([[0], np.cumsum(np.bincount(gram))])
    own = np.concatenate([[0], np.cumsum(size)])
    out, open_ = np.arange(m), np.ones(m, dtype=bool)
    for i in range(m):
        if not open_[i]:
            continue
        open_[i], queue = False, [i]
        while queue and open_.any():
            x = queue.pop()
            g = gram[own[x]:own[x + 1]]
            every, _ = _runs(start[g], start[g + 1] - start[g])
            both = np.bincount(by_gram[every], minlength=m)
            near = np.flatnonzero(open_ & (both >= threshold * (size + size[x] - both) - 1e-9))
            open_[near] = False
            out[near] = i
            queue += near.tolist()
    return out


def links(members: DataFrame, sets: DataFrame, threshold: float, most: int) -> DataFrame:
    """(``a``, ``b``): verified links of the paragraphs of each bucket (``bucket``, ``p1``)."""
    large = members.groupBy("bucket").count().where(F.col("count") > most).select("bucket", F.ceil(F.col("count") / most).cast("int").alias("chunks"))
    dealt = members.join(large, "bucket", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    mine = F.pmod(F.xxhash64("p1"), F.col("chunks")).cast("int")
    tasks = (dealt.select("p1", "bucket", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
             .select("p1", F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("node"))
             .join(sets, "p1").repartition("node").sortWithinPartitions("node"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, sets = None, [], []

        def found() -> list[tuple[int, int]]:
            if len(ids) < 2:
                return []
            return [(ids[i], ids[c]) for i, c in enumerate(jaccard_classes(sets, threshold).tolist()) if i != c]

        def batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for f in frames:
            pairs: list[tuple[int, int]] = []
            grams = f.column("grams")
            flat, cuts = grams.values.to_numpy(), grams.offsets.to_numpy()
            for i, (x, p) in enumerate(zip(f.column("node").to_pylist(), f.column("p1").to_pylist(), strict=True)):
                if x != node:
                    pairs += found()
                    node, ids, sets = x, [], []
                ids.append(p)
                sets.append(flat[cuts[i]:cuts[i + 1]])
            yield batch(pairs)
        yield batch(found())

    return tasks.select("node", "p1", "grams").mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("d"), F.col("text").cast("string").alias("text"))


def _clusters(docs: DataFrame, threshold: float, shingle: int, min_words: int, most: int) -> DataFrame:
    """The rows of ``clusters`` with ``d``, the hash of the text."""
    bands, rows = tune_bands(threshold)
    min_words = max(min_words, shingle)
    every = stored(signed(docs, min_words, shingle, bands, rows), "paragraphs")
    distinct = every.groupBy("p1", "p2").agg(F.min(F.struct("doc_id", "d", "line")).alias("at"), F.first("bands").alias("bands"))
    banded = distinct.select("p1", F.posexplode("bands").alias("band", "key")).select("p1", F.xxhash64("band", "key").alias("bucket"))
    several = banded.groupBy("bucket").count().where(F.col("count") > 1).select("bucket")
    members = stored(banded.join(several, "bucket", "left_semi"), "buckets")
    wanted = distinct.join(members.select("p1").distinct(), "p1", "left_semi").select("at.doc_id", "at.d", "at.line", "p1")
    sets = shingle_sets(docs, wanted, min_words, shingle)  # read once, by the join of the links
    roots = components(links(members, sets, threshold, most), "paragraphs").select(F.col("node").alias("p1"), "root")
    rooted = every.drop("bands", "p2").join(roots, "p1", "left").withColumn("root", F.coalesce("root", "p1"))
    place = F.struct("doc_id", "d", "line")
    first = rooted.groupBy("root").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    return rooted.join(first, "root").select(
        "d", "doc_id", F.col("line").alias("paragraph"), "n_words", F.col("first.doc_id").alias("first_doc_id"),
        F.col("first.line").alias("first_paragraph"), F.col("n").alias("cluster_size"), (~place.eqNullSafe(F.col("first"))).alias("removed"))


def clusters(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, min_words: int = 20, most: int = 4000) -> DataFrame:
    """Every paragraph that has a copy or near copy: its cluster's first paragraph, and whether it goes."""
    return _clusters(_texts(docs), threshold, shingle, min_words, most).drop("d")


def _passages(docs: DataFrame, found: int, least: int) -> DataFrame:
    """The rows of ``passages`` with ``d`` and the lines that a passage lies in."""
    runs = stored(run_rows(docs, found, least), "runs")
    shared = (runs.groupBy("p1", "p2").agg(F.min(F.struct("doc_id", "d", "start")).alias("first"), F.max(F.struct("doc_id", "d")).alias("other"), F.count("*").alias("n"))
              .where(~F.struct("first.doc_id", "first.d").eqNullSafe(F.col("other"))).drop("other"))
    held = runs.join(shared, ["p1", "p2"]).withColumn("shift", F.col("start") - F.col("first.start"))
    pair = ["doc_id", "d", F.col("first.doc_id"), F.col("first.d"), "shift"]
    row = Window.partitionBy(*pair).orderBy("start")
    apart = F.coalesce(F.col("start") - F.lag("start").over(row) > least, F.lit(True))
    parted = held.withColumn("apart", apart.cast("int")).withColumn("k", F.sum("apart").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    return (parted.groupBy("doc_id", "d", F.col("first.doc_id").alias("first_doc_id"), F.col("first.d").alias("first_d"), "shift", "k")
            .agg(F.min("start").alias("start"), (F.max("start") + least).alias("end"), F.max("n").alias("n"), F.min("line").alias("line"), F.max("last").alias("last"),
                 (F.max("last_worded") - F.min("first_worded") + 1).alias("worded"))
            .select("d", "doc_id", (-1 - F.col("start")).cast("int").alias("paragraph"), (F.col("end") - F.col("start")).alias("n_words"), "first_doc_id",
                    (-1 - F.col("start") + F.col("shift")).cast("int").alias("first_paragraph"), F.col("n").alias("cluster_size"),
                    (~F.struct("doc_id", "d").eqNullSafe(F.struct("first_doc_id", "first_d"))).alias("removed"), "line", "last", "worded"))


def passages(docs: DataFrame, found: int = 50, least: int = 25) -> DataFrame:
    """Every passage that another document has too, wherever its lines break: every one of ``found`` words, none of fewer than ``least``.

    ``paragraph`` is -1 - the passage's first word in the text (from 0), ``first_paragraph`` likewise.
    """
    return _passages(_texts(docs), found, least).drop("d", "line", "last", "worded")


def repeats(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, min_words: int = 5, most: int = 4000, found: int = 50, least: int = 25) -> DataFrame:
    """The rows of ``clusters`` (lines) and, with a negative ``paragraph``, those passages that do not lie in such lines altogether."""
    docs = _texts(docs)
    lines = stored(_clusters(docs, threshold, shingle, min_words, most), "line-clusters")
    runs = stored(_passages(docs, found, least), "passages")
    told = lines.select(F.col("doc_id").alias("t_id"), F.col("d").alias("t_d"), F.col("paragraph").alias("t_line")).distinct()
    key = ["doc_id", "d", "paragraph", "first_doc_id", "first_paragraph"]
    covered = (runs.select(*key, "worded", F.explode(F.sequence("line", "last")).alias("at"))
               .join(told, F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("d") == F.col("t_d")) & (F.col("at") == F.col("t_line")))
               .groupBy(*key, "worded").agg(F.count("*").alias("of")).where("of >= worded").select(*[F.col(c).alias(f"c_{c}") for c in key]))
    same = [F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in key]
    kept = runs.drop("line", "last", "worded").join(covered, reduce(lambda a, b: a & b, same), "left_anti")
    return lines.unionByName(kept).drop("d")
