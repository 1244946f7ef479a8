"""Ranked lexical search of many queries at once, by common-subexpression evaluation (operator 11).

The items are queries: multisets of terms. A score is a sum over an item's terms, so what several
items share is summed once. ``mine`` finds the shared term sets of a block of items: terms that
stand in the same items are one *atom*; then, again and again, the pair of nodes that most items
share becomes a node of its own (greedy pair mining, best first). The outcome is a sharing graph:
atoms over terms, merged nodes over two nodes each, items over the nodes that are left to them.

The documents are read once per block of items: a document becomes its length and the counts of
the block's terms (stored). Statistics are summed over that table. Then each task evaluates the
graph bottom up for some documents at a time: one accumulator per node and document, computed once
and added by every item above it. A task keeps the ``top`` best of an item; the bests of all tasks
are ranked in two steps (by item and salt, then by item), so no task meets more than a share.

Bounds: a block of items holds about ``BLOCK`` bytes of text (its size is summed before anything is
collected); a larger set of items goes block by block, each one stored before the next is made.
Accumulators take at most ``CELLS`` integers at once, whatever the graph. A text is held one at a time.

Defined cases: null, empty and termless texts match nothing and count in no statistic; an item without
terms has no rows; rows equal in item_id and text are one item; repeated documents are ranked each
for itself; a null doc_id comes last among equal scores; very long texts are counted whole, all in
64-bit integers; an empty table on either side gives no rows; extra columns are not carried.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BLOCK = 1 << 19
CELLS = 1 << 22
SALTS = 64
#: A-Z become a-z; what is neither a digit, a letter nor beyond ASCII becomes a blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


@dataclass(frozen=True)
class Graph:
    """Which terms an atom adds, which two nodes a merged node adds, which nodes an item adds.

    ``atoms`` and ``items`` are runs (members, start of each run); merged nodes are numbered on
    from the atoms, in ``levels`` of (first node, left, right), each level over the ones before.
    """

    atoms: tuple[np.ndarray, np.ndarray]
    levels: list[tuple[int, np.ndarray, np.ndarray]]
    items: tuple[np.ndarray, np.ndarray]
    n_nodes: int

    def scores(self, base: np.ndarray) -> np.ndarray:
        """Items x documents from terms x documents."""
        nodes = np.empty((self.n_nodes, base.shape[1]), dtype=np.int64)
        nodes[:len(self.atoms[1])] = np.add.reduceat(base[self.atoms[0]], self.atoms[1], axis=0)
        for first, left, right in self.levels:
            nodes[first:first + len(left)] = nodes[left] + nodes[right]
        return np.add.reduceat(nodes[self.items[0]], self.items[1], axis=0)


def _runs(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    return np.array([y for x in lists for y in x], dtype=np.int64), np.cumsum(sizes) - sizes


def mine(queries: list[list[int]], reach: int = 64) -> Graph:
    """Sharing graph of items given as term lists, repeats included; each list has a term at least.

    The k-th repeat of a term is an element of its own, so that a multiset is a set. ``reach`` is how far
    apart in an item (most shared first) two atoms may stand to be counted as a pair at the start.
    """
    where: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, q in enumerate(queries):
        for t, n in Counter(q).items():
            for k in range(n):
                where[t, k].append(i)
    alike: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for (t, _), items in where.items():
        alike[tuple(items)].append(t)
    atoms, held = list(alike.values()), [set() for _ in queries]
    support = [len(items) for items in alike]
    for a, items in enumerate(alike):
        for i in items:
            held[i].add(a)

    shared: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i, nodes in enumerate(held):
        order = sorted((a for a in nodes if support[a] > 1), key=lambda a: (-support[a], a))
        for j, a in enumerate(order):
            for b in order[j + 1:j + 1 + reach]:
                shared[min(a, b), max(a, b)].add(i)
    heap = [(-len(s), a, b) for (a, b), s in shared.items() if len(s) > 1]
    heapq.heapify(heap)
    n, depth, merged = len(atoms), [0] * len(atoms), []
    while heap:
        size, a, b = heapq.heappop(heap)
        now = {i for i in shared[a, b] if a in held[i] and b in held[i]}
        if len(now) < -size:
            shared[a, b] = now
            if len(now) > 1:
                heapq.heappush(heap, (-len(now), a, b))
            continue
        beside: dict[int, set[int]] = defaultdict(set)
        for i in now:
            held[i] -= {a, b}
            for x in held[i]:
                beside[x].add(i)
            held[i].add(n)
        for x, items in beside.items():
            if len(items) > 1:
                shared[x, n] = items
                heapq.heappush(heap, (-len(items), x, n))
        merged.append((a, b))
        depth.append(1 + max(depth[a], depth[b]))
        n += 1

    # number the merged nodes level by level
    order = sorted(range(len(merged)), key=lambda k: (depth[len(atoms) + k], k))
    number = {**{a: a for a in range(len(atoms))}, **{len(atoms) + k: len(atoms) + at for at, k in enumerate(order)}}
    by_level: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for k in order:
        by_level[depth[len(atoms) + k]].append((number[merged[k][0]], number[merged[k][1]]))
    levels, first = [], len(atoms)
    for d in sorted(by_level):
        pairs = np.array(by_level[d], dtype=np.int64)
        levels.append((first, pairs[:, 0], pairs[:, 1]))
        first += len(pairs)
    return Graph(_runs(atoms), levels, _runs([sorted(number[x] for x in nodes) for nodes in held]), n)


def counted(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Per document with a term: ``doc_id``, its length ``n``, the numbers of the vocabulary's terms in it and their counts."""
    number = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = number.value.get
        for f in frames:
            keep, lengths, which, counts = [], [], [], []
            for i, text in enumerate(f.column(1)):
                words = terms(text.as_py())
                if not words:
                    continue
                hits = sorted((k, c) for w, c in Counter(words).items() if (k := find(w)) is not None)
                keep.append(i)
                lengths.append(len(words))
                which.append(np.array([k for k, _ in hits], dtype="<u4").tobytes())
                counts.append(np.array([c for _, c in hits], dtype="<u4").tobytes())
            yield pa.RecordBatch.from_arrays([f.column(0).take(pa.array(keep, pa.int64())), pa.array(lengths, pa.int64()), pa.array(which, pa.binary()),
                                              pa.array(counts, pa.binary())], names=["doc_id", "n", "terms", "counts"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
            .mapInArrow(run, "doc_id long, n long, terms binary, counts binary"))


def holders(held: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each term of the vocabulary stands."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, dtype=np.int64)
        for f in frames:
            for t in f.column(0):
                df[np.frombuffer(t.as_py(), dtype="<u4")] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "df"])

    out = np.zeros(n_terms, dtype=np.int64)
    for r in held.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # at most the vocabulary
        out[r.term] = r.df
    return out


def best_of(item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray, top: int) -> np.ndarray:
    """Indices of the ``top`` best rows of each item, sorted by item."""
    order = np.lexsort((doc, null, -score, item))
    start = np.searchsorted(item[order], item[order], "left")
    return order[np.arange(len(order)) - start < top]


def scored(held: DataFrame, graph: Graph, weights: np.ndarray, total: int, length: int, n_items: int, top: int) -> DataFrame:
    """(``item``, ``doc_id``, ``score``): of each task, the best of each item."""
    sent = held.sparkSession.sparkContext.broadcast((graph, weights))
    step = max(1, CELLS // max(1, graph.n_nodes + len(weights) + len(graph.items[0]) + len(graph.atoms[0])))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, weights = sent.value
        floor = np.ones(n_items, dtype=np.int64)
        kept = [np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=bool)]
        for f in frames:
            ids = f.column(0)
            null, doc = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
            lengths = f.column(1).to_pylist()
            for a in range(0, f.num_rows, step):
                b = min(f.num_rows, a + step)
                which = [np.frombuffer(x.as_py(), dtype="<u4").astype(np.int64) for x in f.column(2)[a:b]]
                tf = np.concatenate([np.frombuffer(x.as_py(), dtype="<u4").astype(np.int64) for x in f.column(3)[a:b]])
                of = np.repeat(np.arange(b - a), [len(x) for x in which])
                m = np.array([75 + 25 * n * total // length for n in lengths[a:b]], dtype=np.int64)[of]
                which = np.concatenate(which)
                base = np.zeros((len(weights), b - a), dtype=np.int64)
                base[which, of] = weights[which] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
                scores = graph.scores(base)
                item, at = np.nonzero(scores >= floor[:, None])
                if not len(item):
                    continue
                kept = [np.concatenate(x) for x in zip(kept, (item, scores[item, at], doc[a + at], null[a + at]), strict=True)]
                best = best_of(*kept, top)
                kept = [x[best] for x in kept]
                many, n = np.unique(kept[0], return_counts=True)
                last = np.cumsum(n) - 1
                floor[many[n == top]] = kept[1][last[n == top]]
        item, score, doc, null = kept
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, pa.int64(), mask=null), pa.array(score)], names=["item", "doc_id", "score"])

    return held.mapInArrow(run, "item long, doc_id long, score long")


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The ``top`` best rows of each item with their ``rank``: within salts first, so that no task gets an item's rows of all tasks."""
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    share = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    share = share.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*best))).where(F.col("rank") <= top)
    return share.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).where(F.col("rank") <= top).drop("salt")


def block_ranks(docs: DataFrame, block: DataFrame, top: int) -> DataFrame | None:
    """Ranks of one block of items (``item_id``, ``text``); None if none of them has a term."""
    rows = [(r.item_id, words) for r in block.select("item_id", F.col("text").cast("binary").alias("text")).collect() if (words := terms(r.text))]
    if not rows:
        return None
    vocabulary = sorted({t for _, words in rows for t in words})
    number = {t: i for i, t in enumerate(vocabulary)}
    graph = mine([[number[t] for t in words] for _, words in rows])
    held = stored(counted(docs, vocabulary), "search-counts")
    sums = held.agg(F.count("*").alias("total"), F.sum("n").alias("length")).first()
    total, length = sums.total, sums.length or 1
    weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(df) + 1))) for df in holders(held, len(vocabulary))], dtype=np.int64)
    names = docs.sparkSession.createDataFrame([(i, item) for i, (item, _) in enumerate(rows)], f"item long, item_id {block.schema['item_id'].dataType.simpleString()}")
    best = ranked(scored(held, graph, weights, total, length, len(rows), top), top)
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # names: at most a block


def rank(docs: DataFrame, items: DataFrame, top: int = 20, block: int = BLOCK) -> DataFrame:
    """Each item's ``top`` best documents: ``item_id``, ``rank`` (from 1), ``doc_id``, ``score`` above 0."""
    queries = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block))
    parts = []
    for k in range(blocks):
        part = block_ranks(docs, queries.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k), top)
        if part is not None:
            parts.append(stored(part, "search-ranks") if blocks > 1 else part)
    if not parts:
        return docs.sparkSession.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionAll, parts)
