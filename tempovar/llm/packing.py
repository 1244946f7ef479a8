"""Packing by non-negative least squares over a length histogram (operator 1).

Every document is its token ids and one end id. It is cut into full windows and one
remainder; the piece lengths form a histogram of at most ``window`` counts. All multisets
of up to three lengths that exactly fill the window are the candidate patterns. How often
each is repeated is a non-negative least-squares fit of the patterns to the histogram,
rounded and held to the counts there are; what is left is packed greedily, longest first.
The plan depends on the histogram alone. Pieces then take its slots by their rank among
the pieces of the same length, so no piece is ever gathered with all others.

Defined results: null and empty texts are one end id; repeated rows are packed each for
themselves; an empty table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank, stored
from .tokens import batches, encoder

#: Characters of texts that a worker tokenizes at once.
CHARS = 1 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece of each document (``doc_id``, ``text``): at most ``window`` ids."""

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end, step = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes(), 4 * window
        for frame in frames:
            ids, texts, at = frame.column(0).to_pylist(), frame.column(1), 0
            for run in batches(texts.to_pylist(), CHARS):
                out: list[tuple] = []
                for doc_id, body in zip(ids[at:at + len(run)], code.ids(run), strict=True):
                    body += end
                    n = len(body) // 4
                    out += [(doc_id, i // 4, (min(i + step, len(body)) - i) // 4, zlib.crc32(body[i:i + step]), n)
                            for i in range(0, len(body), step)]
                at += len(run)
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def patterns(window: int, present: np.ndarray) -> np.ndarray:
    """All (a <= b <= c) that sum to the window, of present lengths; a or b may be 0 (none)."""
    there = np.zeros(window + 1, dtype=bool)
    there[present] = True
    there[0] = True
    a, b = np.meshgrid(np.arange(window + 1), np.arange(window + 1), indexing="ij")
    a, b = a.ravel(), b.ravel()
    keep = (a <= b) & (window - a - b >= b)
    a, b = a[keep], b[keep]
    out = np.stack([a, b, window - a - b], axis=1)
    return out[there[out].all(axis=1)]


def nnls(shapes: np.ndarray, counts: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Non-negative x that least-squares fits the sum of x over shapes to ``counts`` (index: length; 0 is free).

    Multiplicative steps keep x non-negative and never raise the squared error.
    """
    h = counts.astype(float).copy()
    h[0] = 0
    real = (shapes > 0).astype(float)
    x = np.full(len(shapes), max(h.sum(), 1.0) / max(len(shapes), 1) / 3)

    def fitted(x: np.ndarray) -> np.ndarray:
        got = np.bincount(shapes.ravel(), (x[:, None] * real).ravel(), len(h))
        got[0] = 0
        return got

    want = (h[shapes] * real).sum(axis=1)
    for _ in range(rounds):
        x *= want / np.maximum((fitted(x)[shapes] * real).sum(axis=1), 1e-12)
    return x


def plan(counts: np.ndarray, window: int = 1024) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats): together they use each length exactly as often as it occurs."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []

    def take(shape: tuple[int, ...], most: int | None = None) -> None:
        lengths, times = np.unique(shape, return_counts=True)
        n = int((left[lengths] // times).min())
        n = n if most is None else min(n, most)
        if n > 0:
            left[lengths] -= n * times
            out.append((tuple(shape), n))

    shapes = patterns(window, np.flatnonzero(left))
    if len(shapes):
        x = np.rint(nnls(shapes, left)).astype(np.int64)
        for k in np.argsort(-x, kind="stable"):
            if x[k] == 0:
                break
            take(tuple(int(v) for v in shapes[k] if v), int(x[k]))
    while (there := np.flatnonzero(left)).size:
        shape, room, used = [], window, np.zeros_like(left)
        while room > 0:
            fit = there[(there <= room) & (left[there] > used[there])]
            if not fit.size:
                break
            # the longest that fits, or the two that fill the room exactly
            two = fit[np.isin(room - fit, fit) & ((room - fit != fit) | (left[fit] - used[fit] > 1))]
            for v in ([int(two[-1]), int(room - two[-1])] if shape and two.size and room not in fit else [int(fit[-1])]):
                shape.append(v)
                used[v] += 1
                room -= v
        take(tuple(shape))
    return out


def slots(shapes: list[tuple[tuple[int, ...], int]], window: int) -> dict[str, np.ndarray]:
    """The plan by (length, first rank): base of the sequence numbers, uses in a shape, its offsets."""
    rows, base, used = [], 0, np.zeros(window + 1, dtype=np.int64)
    for shape, n in shapes:
        at = np.concatenate([[0], np.cumsum(shape)[:-1]])
        for length in dict.fromkeys(shape):
            offs = [int(o) for o, v in zip(at, shape, strict=True) if v == length]
            rows.append((length, used[length], base, offs))
            used[length] += n * len(offs)
        base += n
    rows.sort(key=lambda r: (r[0], r[1]))
    many = [len(r[3]) for r in rows]
    return {"length": np.array([r[0] for r in rows], np.int64), "rank": np.array([r[1] for r in rows], np.int64),
            "base": np.array([r[2] for r in rows], np.int64), "uses": np.array(many, np.int64),
            "at": np.cumsum([0, *many[:-1]]).astype(np.int64) if rows else np.empty(0, np.int64),
            "offset": np.array([o for r in rows for o in r[3]], np.int64)}


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their sequence and place in it.

    To the driver go at most ``window`` histogram rows; back goes a plan whose size is
    bounded by the number of patterns (about window squared / 12 + window), not by the data.
    """
    cut = stored(pieces(docs, tokenizer, window, end_id), "pieces")
    counts = np.zeros(window + 1, dtype=np.int64)
    for length, n in cut.groupBy("length").count().collect():
        counts[length] = n
    table = docs.sparkSession.sparkContext.broadcast(slots(plan(counts, window), window))
    ranked = gapless_rank(cut, "length", ["doc_id", "start", "ids_crc32"], "rank")

    def place(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        span = int(t["rank"].max(initial=0)) + 1
        keys = t["length"] * span + t["rank"]
        for f in frames:
            length, rank = f.column("length").to_numpy(), f.column("rank").to_numpy()
            row = np.searchsorted(keys, length * span + np.minimum(rank, span - 1), "right") - 1
            nth = rank - t["rank"][row]
            uses = t["uses"][row]
            yield pa.RecordBatch.from_arrays(
                [f.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
                + [pa.array(t["base"][row] + nth // uses), pa.array(t["offset"][t["at"][row] + nth % uses])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
