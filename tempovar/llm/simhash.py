"""SimHash near-duplicates by a Gray-order hierarchical index (operator 7).

Fingerprints that differ in at most ``k`` bits agree on one of ``k + 1`` bit blocks. Each
block's value is an upper node of the index: it factors a masked bit pattern that all
fingerprints below it share, and every fingerprint goes under its ``k + 1`` upper nodes.
Under a node the fingerprints are sorted by Gray rank and grouped; a group keeps the bits
its members share, and groups of groups likewise. A search over pairs of groups adds up the
differences on the shared bits from the top down and drops both whole groups once the sum
exceeds ``k``; only what is left is compared fingerprint by fingerprint.

A task returns, for its fingerprints, the least one they are connected to (linear, never
pairs); components over these links give the classes. Distinct fingerprints only are
indexed, so copies cost nothing. A node of more than ``most`` fingerprints is dealt into
chunks by hash and each pair of chunks is a task of its own: exact at any size.

Defined cases: null, empty and wordless texts have fingerprint zero, linked like any other;
a null doc_id is never a component's id unless no other is there; repeated rows each get
their row; an empty table gives no rows; extra columns are kept by ``keep_first`` only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

LEAF, FAN = 32, 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLANE = (np.arange(8) * 256)[None, :]
ONE = np.uint64(1)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles."""
    joined = b" ".join((text or "").encode().lower().split())
    if not joined:
        return 0
    spaces = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    starts, ends = [0, *(spaces + 1).tolist()], [*spaces.tolist(), len(joined)]
    digest, width = xxhash.xxh64_intdigest, min(shingle, len(starts))
    n = len(starts) - width + 1
    counts = np.zeros((8, 256), dtype=np.int64)
    for a in range(0, n, 1 << 16):
        b = min(n, a + (1 << 16))
        hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts[a:b], ends[a + width - 1:b + width - 1], strict=True)], dtype="<u8")
        counts += np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _PLANE).ravel(), minlength=2048).reshape(8, 256)
    return int((((counts @ _BITS).ravel() * 2 > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(``doc_id``, ``d``, ``fp``): a hash of the text, and the fingerprint as a signed long."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in f.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([f.column(0), f.column(2), pa.array(fps)], names=["doc_id", "d", "fp"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")))
            .mapInArrow(run, "doc_id long, d long, fp long"))


def blocks(k: int) -> list[int]:
    """Masks of ``k + 1`` contiguous bit blocks of the 64 bits."""
    cuts = [round(i * 64 / (k + 1)) for i in range(k + 2)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class Classes:
    """Least-index classes under links given as index arrays."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, p: np.ndarray, q: np.ndarray) -> None:
        while len(p):
            a, b = self.of[p], self.of[q]
            apart = a != b
            if not apart.any():
                return
            p, q, a, b = p[apart], q[apart], a[apart], b[apart]
            np.minimum.at(self.of, np.maximum(a, b), np.minimum(a, b))
            while (up := self.of[self.of]).tobytes() != self.of.tobytes():
                self.of = up


def _grid(p: np.ndarray, q: np.ndarray, fan: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of children (each once) of the node pairs (p, q), and which node pair each is of."""
    i, j = np.divmod(np.arange(fan * fan), fan)
    a, b = (p[:, None] * fan + i).ravel(), (q[:, None] * fan + j).ravel()
    of = np.repeat(np.arange(len(p)), fan * fan)
    keep = (a <= b) & (b < n)
    return a[keep], b[keep], of[keep]


def index_links(fps: np.ndarray, k: int) -> np.ndarray:
    """Least index of the class of each of the fingerprints of one node."""
    order = np.argsort(gray_rank(fps), kind="stable")
    x = fps[order]
    low = np.arange(0, len(x), LEAF)
    ands, ors = [np.bitwise_and.reduceat(x, low)], [np.bitwise_or.reduceat(x, low)]
    top = np.arange(0, len(low), FAN)
    ands.append(np.bitwise_and.reduceat(ands[0], top))
    ors.append(np.bitwise_or.reduceat(ors[0], top))
    (leaf_mask, mask), (leaf, node) = [~(a ^ o) for a, o in zip(ands, ors, strict=True)], ands
    classes = Classes(len(x))
    p, q = np.triu_indices(len(top))
    shared = mask[p] & mask[q]
    gone = np.bitwise_count((node[p] ^ node[q]) & shared)
    p, q, shared, gone = (v[gone <= k] for v in (p, q, shared, gone))
    for i in range(0, len(p), 1024):
        a, b, of = _grid(p[i:i + 1024], q[i:i + 1024], FAN, len(low))
        more = leaf_mask[a] & leaf_mask[b] & ~shared[i + of]
        near = gone[i + of] + np.bitwise_count((leaf[a] ^ leaf[b]) & more) <= k
        a, b = a[near], b[near]
        for j in range(0, len(a), 512):
            u, v, _ = _grid(a[j:j + 512], b[j:j + 512], LEAF, len(x))
            hit = (np.bitwise_count(x[u] ^ x[v]) <= k) & (u < v)
            classes.link(u[hit], v[hit])
    out = np.empty(len(x), dtype=np.int64)
    least = np.full(len(x), len(x), dtype=np.int64)
    np.minimum.at(least, classes.of, order)
    out[order] = least[classes.of]
    return out


def node_links(keys: np.ndarray, fps: np.ndarray, k: int) -> np.ndarray:
    """Class of each fingerprint (index of one of its members); ``keys`` numbers the nodes, in runs."""
    if not len(keys):
        return np.empty(0, dtype=np.int64)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
    size = np.diff([*cut, len(keys)])
    classes = Classes(len(keys))
    small = np.repeat(size <= 2 * LEAF, size)
    for d in range(1, int(size[size <= 2 * LEAF].max(initial=0))):
        hit = np.flatnonzero((keys[d:] == keys[:-d]) & small[d:] & (np.bitwise_count(fps[d:] ^ fps[:-d]) <= k))
        classes.link(hit, hit + d)
    for a, n in zip(cut[size > 2 * LEAF].tolist(), size[size > 2 * LEAF].tolist(), strict=True):
        of = a + index_links(fps[a:a + n], k)
        classes.link(np.arange(a, a + n), of)
    return classes.of


def links(distinct: DataFrame, k: int, most: int = 20_000) -> DataFrame:
    """(``a``, ``b``): fingerprints and the class member they hang on, from every node of the index."""
    masks = [m - (1 << 64) if m >> 63 else m for m in blocks(k)]
    under = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("block", "part"))
    large = under.groupBy("block", "part").count().where(F.col("count") > most).select("block", "part", F.ceil(F.col("count") / most).cast("int").alias("chunks"))
    dealt = under.join(large, ["block", "part"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    tasks = (dealt.select("fp", "block", "part", mine.alias("mine"), other.alias("other"))
             .select("fp", F.xxhash64("block", "part", F.least("mine", "other"), F.greatest("mine", "other")).alias("node"))
             .repartition("node").sortWithinPartitions("node"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            of = node_links(node, fp.view(np.uint64), k)
            moved = np.flatnonzero(of != np.arange(len(of)))
            return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[of[moved]])], names=["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for f in frames:
            node, fp = f.column("node").to_numpy(), f.column("fp").to_numpy()
            held.append((node, fp))
            rows += len(node)
            if rows < 50_000 or node[-1] == held[0][0][0]:
                continue
            node, fp = (np.concatenate(v) for v in zip(*held, strict=True))
            last = int(np.searchsorted(node, node[-1], "left"))  # the last node may go on
            yield found(node[:last], fp[:last])
            held, rows = [(node[last:], fp[last:])], len(node) - last
        if rows:
            yield found(*(np.concatenate(v) for v in zip(*held, strict=True)))

    return tasks.mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, shingle: int = 4, k: int = 4) -> DataFrame:
    """Per document: ``doc_id``, ``d``, ``fp`` and ``root``, the least fingerprint of its class."""
    per_doc = stored(fingerprints(docs, shingle), "fingerprints")
    distinct = per_doc.groupBy("fp").agg(F.min("doc_id").alias("doc"))
    roots = components(links(distinct.select("fp"), k), "simhash").select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(roots, "fp", "left").select("fp", "doc", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    return per_doc.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = 4, k: int = 4) -> DataFrame:
    """Per document: ``doc_id``, ``fingerprint`` (hex), ``component_id`` (least doc_id of its class)."""
    return classes(docs, shingle, k).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = 4, k: int = 4) -> DataFrame:
    """One document of each class stays, all columns kept: the least doc_id (a null one last),
    then the least text hash; of rows equal in both, the least row."""
    of = classes(docs, shingle, k)
    first = (of.groupBy("root", "doc_id", "d").agg(F.count("*").alias("n"))
             .groupBy("root").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "d", "n")).alias("w"))
             .select(F.col("w.doc_id").alias("w_id"), F.col("w.d").alias("w_d"), F.col("w.n").alias("w_n")))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("r_id"),
                       F.xxhash64(docs["text"].cast("string")).alias("r_d"))
    kept = rows.join(first, F.col("r_id").eqNullSafe(F.col("w_id")) & (F.col("r_d") == F.col("w_d")))
    several = kept.where("w_n > 1").groupBy("r_id", "r_d").agg(F.min("row").alias("row"))
    return kept.where("w_n = 1").select("row").unionAll(several.select("row")).select("row.*")
