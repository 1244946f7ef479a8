"""Forward as-of join by key with a tolerance (C13), for all cells of a grid at once, pair-free.

For each left row (a stay ending at ``left_ts``) and each cell the match is the right row (an event)
of the same key that is stable in the cell, with the smallest ``(right_ts, right_id)`` such that
``left_ts <= right_ts <= left_ts + tolerance``.

Stays and events are stacked in one frame and dealt by ``(key, bucket)``, a bucket being ``tolerance``
days wide. Each event is placed in its own bucket and in the previous one, so a stay's bucket holds
every event of its band, and a key with a long history is split over its time buckets (events are
copied once). A bucket is scanned once, backwards in time, with the *frontier* as its state: the next
event, then the next one that passes a cell the first does not pass, and so on. An event comes in front
and takes its cells from the ones behind it; an entry left without a cell goes. The entries' cells are
disjoint, so the state has at most as many entries as the grid has cells, however many events a key
has. Spark sorts and deals the rows; the scan itself needs a state that no built-in window function
keeps (48 running ``last`` functions come nearest), so it is a ``mapInArrow`` step over sorted rows.
All stays of a batch step through their frontiers at once; where a stay still seeks cells after ``STEPS`` events, its
bucket is scanned event by event, so that a hot key stays linear.
Without cells the nearest event of all is one running ``last``, and no Python runs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _bucket(ts: Column, days: int) -> Column:
    # Day number of the zone-less date, so bucket edges do not move with the session time zone.
    return F.floor(F.unix_date(ts.cast("date")) / F.lit(days))


#: Events that all stays of a batch look at together.
STEPS = 32


def _frontier(match_type, tolerance_us: int):
    """The scan: rows sorted by key, bucket, then backwards in time; a stay's row with its frontier comes out."""

    def nearest(front: list, events: Iterable) -> list:
        """The frontier ``(cells, event)``, nearest first, once further events ``(event, cells)`` came in front of it."""
        for event, mine in events:
            if mine:
                front = [(mine, event), *((left, e) for c, e in front if (left := c & ~mine))]
        return front

    def run(frames: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        group, carried = None, None  # the last bucket of the batch before, its frontier as events (ids, times, cells), farthest first
        for f in frames:
            if not len(f):
                continue
            key, bucket = f.column("_key"), f.column("_b")
            ends = [(key[i].as_py(), bucket[i].as_py()) for i in (0, len(f) - 1)]
            here = np.zeros(len(f), dtype=np.int64)
            for column in (key, bucket):
                code = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
                here[1:] |= code[1:] != code[:-1]
            here = np.cumsum(here)  # the number of a row's bucket
            is_event = f.column("_side").to_numpy() == 1
            ids, ts, cells = f.column("_rid").filter(pa.array(is_event)), f.column("_ts").cast(pa.int64()).to_numpy(), f.column("_cells").fill_null(0).to_numpy()[is_event]
            times, before = ts[is_event], 0
            if ends[0] == group:
                before = len(carried[1])
                ids, times, cells = pa.concat_arrays([carried[0], ids]), np.concatenate([carried[1], times]), np.concatenate([carried[2], cells])
            seen = np.cumsum(is_event) + before
            firsts = np.flatnonzero(np.diff(here, prepend=-1))
            low = (seen - is_event)[firsts]  # a bucket's first event
            low[0] = 0

            # each stay goes from its next event on, as long as it lacks cells that some event has
            stays = np.flatnonzero(~is_event)
            at, latest, wanted = seen[stays] - 1, ts[stays] + tolerance_us, np.full(len(stays), np.bitwise_or.reduce(cells, initial=0), dtype=np.int64)
            going, found = np.arange(len(stays)), []
            for _ in range(STEPS):
                going = going[(at[going] >= low[here[stays[going]]]) & (wanted[going] != 0)]
                going = going[times[at[going]] <= latest[going]]
                if not len(going):
                    break
                new = cells[at[going]] & wanted[going]
                found.append((going[new != 0], at[going][new != 0], new[new != 0]))
                wanted[going] &= ~new
                at[going] -= 1
            if len(going):
                long = np.zeros(len(stays), dtype=bool)
                long[going] = True
                found = [tuple(x[~long[entries[0]]] for x in entries) for entries in found]
                front, e, last = [], 0, -1
                for i in going.tolist():
                    if here[stays[i]] != last:
                        last = here[stays[i]]
                        front, e = [], int(low[last])
                    upto = int(seen[stays[i]])
                    front, e = nearest(front, zip(range(e, upto), cells[e:upto].tolist(), strict=True)), upto
                    mine = [(event, c) for c, event in front if times[event] <= latest[i]]
                    found.append((np.full(len(mine), i), np.array([x[0] for x in mine], dtype=np.int64), np.array([x[1] for x in mine], dtype=np.int64)))
            stay, event, taken = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, dtype=np.int64)] * 3
            order = np.argsort(stay, kind="stable")
            event, taken = event[order], taken[order]
            entries = pa.StructArray.from_arrays([pa.array(times[event]).cast(pa.timestamp("us")), ids.take(pa.array(event)), pa.array(taken)], names=["ts", "id", "cells"])
            offsets = np.concatenate([[0], np.cumsum(np.bincount(stay, minlength=len(stays)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([f.column("_row").take(pa.array(stays)), pa.ListArray.from_arrays(pa.array(offsets), entries)], names=["_row", match_type])

            e = int(low[-1])
            front = nearest([], zip(range(e, len(cells)), cells[e:].tolist(), strict=True))[::-1]
            place = np.array([event for _, event in front], dtype=np.int64)
            group, carried = ends[1], (ids.take(pa.array(place)), times[place], np.array([c for c, _ in front], dtype=np.int64))

    return run


def asof_nearest(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_id: str, right_ts: str,
                 tolerance_days: int, cells: str | None = None, out: str = "match") -> DataFrame:
    """Left rows with ``out``, an array of ``struct(ts, id, cells)``, nearest event first: the event is the
    match of the cells in its entry. An empty array: no match.

    ``cells`` is the events' column of stable cells (bits of a long). Without it there is one cell.
    """
    if tolerance_days <= 0:
        raise ValueError("tolerance_days must be positive")
    types = {f.name: f.dataType for f in right.schema.fields}
    row_type = left.select(F.struct(*left.columns).alias("r")).schema["r"].dataType
    stays = left.select(F.col(key).alias("_key"), F.struct(*left.columns).alias("_row"), F.col(left_ts).cast("timestamp_ntz").alias("_ts"),
                        _bucket(F.col(left_ts), tolerance_days).alias("_b"), F.lit(0).alias("_side"),
                        F.lit(None).cast(types[right_id]).alias("_rid"), F.lit(None).cast("long").alias("_cells"))
    rb = _bucket(F.col(right_ts), tolerance_days)
    events = right.select(F.col(key).alias("_key"), F.lit(None).cast(row_type).alias("_row"), F.col(right_ts).cast("timestamp_ntz").alias("_ts"),
                          F.explode(F.array(rb, rb - 1)).alias("_b"), F.lit(1).alias("_side"), F.col(right_id).alias("_rid"),
                          (F.col(cells) if cells else F.lit(1)).cast("long").alias("_cells"))
    rows = stays.unionByName(events)
    backwards = [F.col("_ts").desc(), F.col("_side").desc(), F.col("_rid").desc()]
    if cells is None:
        w = Window.partitionBy("_key", "_b").orderBy(*backwards).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        event = F.struct(F.col("_ts").alias("ts"), F.col("_rid").alias("id"), F.col("_cells").alias("cells"))
        seen = F.last(F.when(F.col("_side") == 1, event), ignorenulls=True).over(w)
        scanned = rows.select("_row", "_ts", "_side", seen.alias("_next")).where(F.col("_side") == 0)
        latest = F.col("_ts") + F.make_dt_interval(days=F.lit(tolerance_days))
        none = F.array().cast(T.ArrayType(scanned.schema["_next"].dataType))
        return scanned.select("_row.*", F.when(F.col("_next.ts") <= latest, F.array("_next")).otherwise(none).alias(out))
    entry = T.StructType([T.StructField("ts", T.TimestampNTZType()), T.StructField("id", types[right_id]), T.StructField("cells", T.LongType())])
    schema = T.StructType([T.StructField("_row", row_type), T.StructField(out, T.ArrayType(entry))])
    dealt = rows.repartition("_key", "_b").sortWithinPartitions("_key", "_b", *backwards)
    return dealt.mapInArrow(_frontier(out, tolerance_days * 86_400_000_000), schema).select("_row.*", out)


def asof_join(left: DataFrame, right: DataFrame, key: str, left_id: str, left_ts: str, right_id: str,
              right_ts: str, tolerance_days: int, how: str = "left") -> DataFrame:
    """Left rows with the columns ``right_id, right_ts`` of their forward nearest match (NULL if none)."""
    best = asof_nearest(left, right.select(right_id, key, right_ts), key, left_ts, right_id, right_ts, tolerance_days, out="_match")
    match = F.get("_match", 0)
    best = best.select(*left.columns, match["id"].alias(right_id), match["ts"].alias(right_ts))
    return best.where(F.col(right_id).isNotNull()) if how == "inner" else best
