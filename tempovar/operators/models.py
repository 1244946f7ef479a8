"""Completeness models fitted on a probe's predictor.

Step model: ``c_hat(t) = c_0 * 1(t >= t_0)``. Rectangle model:
``c_hat(t) = c_0 * 1(t_0 <= t <= t_1)``. Both minimise the mean squared error
over all months of the index. For a support ``A`` of ``n_A`` months the best
level is the mean of ``c`` on ``A``, and the error is
``(sum(c^2) - sum_A(c)^2 / n_A) / T``. The step takes suffix sums of every ``t_0``, the rectangle prefix sums of every
pair ``t_0 <= t_1``, over a batch of indexes at once (numpy on Arrow batches: array expressions are interpreted a month at a time).
The smallest error (to 12 places) wins, then the earliest ``t_0`` (then ``t_1``): the batch leaves the supports that
rounding may not tell from the best one, mostly one, and Spark rounds these.
A predictor is given by rows per month, which are grouped by index first, or as a series (``MONTHS``), which needs no
shuffle. Nothing ever holds more than the months of one batch of indexes (one care site and label set each).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The months of an index in order, as one array of structs with ``date`` and ``c`` (a predictor as a *series*).
MONTHS = "months"
META = {"date", "c", "c_hat", MONTHS}


def index_columns(predictor: DataFrame) -> list[str]:
    """The index of a predictor: every column but the month, counts and completeness."""
    return [c for c in predictor.columns if c not in META and not c.startswith("n_")]


def _gathered(predictor: DataFrame, index: Sequence[str]) -> DataFrame:
    """Per index its months in order as structs with ``date, c`` in ``MONTHS``."""
    if MONTHS in predictor.columns:
        return predictor.select(*index, MONTHS)
    return (predictor.select(*index, "date", F.col("c").cast("double").alias("c")).groupBy(*index)
            .agg(F.array_sort(F.collect_list(F.struct("date", "c"))).alias(MONTHS)))


#: Errors further apart than this differ after rounding to 12 places.
ROUNDING = 2e-12
#: Levels that a scan holds at once. (What a scan calls is nested in it: it is sent to the workers whole, they need not have this package.)
LEVELS = 1 << 18


def step_fits():
    """The scan of steps: row, start, level and error of those whose error may round to the least of its row. ``c`` has a row per index, a
    NaN counts as 0. Of equal least errors only the earliest start comes out."""
    def fits(c):
        import numpy as np

        t = c.shape[1]
        c = np.where(np.isnan(c), 0.0, c)
        total, months = np.cumsum(c[:, ::-1], axis=1)[:, ::-1], np.arange(t, 0, -1.0)
        error = (np.cumsum(c * c, axis=1)[:, -1:] - total * total / months) / t
        least = error.min(axis=1, keepdims=True)
        first = np.arange(t) == (error == least).argmax(axis=1)[:, None]
        row, start = np.nonzero(~(error > least + ROUNDING) & ((error != least) | first))
        return row, [start], total[row, start] / months[start], error[row, start]

    return fits


def rectangle_fits():
    """The scan of rectangles: row, start, end, level and error of those whose error may round to the least of its row, as ``step_fits``.
    The starts are compared by their best end first, so only few have all their ends looked at."""
    def fits(c):
        import numpy as np

        n, t = c.shape
        upto = np.concatenate([np.zeros((n, 1)), np.cumsum(c, axis=1)], axis=1)
        squares, months = np.cumsum(c * c, axis=1)[:, -1], np.arange(1.0, t + 1)
        error = np.empty((n, t))
        for a in range(t):
            total = upto[:, a + 1:] - upto[:, a:a + 1]
            error[:, a] = (squares - (total * total / months[:t - a]).max(axis=1)) / t
        least = error.min(axis=1, keepdims=True)
        first = np.arange(t) == (error == least).argmax(axis=1)[:, None]
        at, start = np.nonzero(~(error > least + ROUNDING) & ((error != least) | first))
        total = upto[at, 1:] - upto[at, start][:, None]
        length = np.arange(1, t + 1) - start[:, None]
        error = np.where(length > 0, (squares[at, None] - total * total / np.maximum(length, 1)) / t, np.inf)
        least = least[at]
        first = np.arange(t) == (error == least).argmax(axis=1)[:, None]
        pair, end = np.nonzero((length > 0) & ~(error > least + ROUNDING) & ((error != least) | first))
        return at[pair], [start[pair], end], total[pair, end] / length[pair, end], error[pair, end]

    return fits


def _scanned(fits, months: Sequence[str]):
    """Arrow batches with the lists ``_dates`` and ``_levels`` as batches with ``_fits``, an index's supports by ``fits``; indexes of
    as many months are scanned together."""

    def run(frames: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for f in frames:
            dates, levels = f.column("_dates"), f.column("_levels").values.to_numpy(zero_copy_only=False)
            offsets, dates = dates.offsets.to_numpy(), dates.values
            lengths = np.diff(offsets)
            found = []
            for t in np.unique(lengths[lengths > 0]):
                rows = np.flatnonzero(lengths == t)
                for some in np.array_split(rows, -(-len(rows) * t // LEVELS)):
                    places = offsets[some][:, None] + np.arange(t)
                    at, supports, level, error = fits(levels[places])
                    found.append((some[at], *[places[at, x] for x in supports], level, error))
            row, *supports, level, error = ([np.concatenate(x) for x in zip(*found, strict=True)] if found
                                            else [np.zeros(0, np.int64)] * (len(months) + 1) + [np.zeros(0)] * 2)
            order = np.argsort(row, kind="stable")
            entries = pa.StructArray.from_arrays([*[dates.take(pa.array(x[order])) for x in supports], pa.array(level[order]), pa.array(error[order])],
                                                 names=[*months, "c_0", "error"])
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(f)))]).astype(np.int32)
            kept = [name for name in f.schema.names if name not in ("_dates", "_levels")]
            yield pa.RecordBatch.from_arrays([*[f.column(name) for name in kept], pa.ListArray.from_arrays(pa.array(ends), entries)], names=[*kept, "_fits"])

    return run


def _fitted(predictor: DataFrame, index: Sequence[str] | None, fits, months: Sequence[str]) -> DataFrame:
    index = list(index or index_columns(predictor))
    series = _gathered(predictor, index)
    date = series.schema[MONTHS].dataType.elementType["date"].dataType
    fit = T.StructType([*[T.StructField(m, date) for m in months], T.StructField("c_0", T.DoubleType()), T.StructField("error", T.DoubleType())])
    schema = T.StructType([*[series.schema[c] for c in index], T.StructField("_fits", T.ArrayType(fit))])
    # the lists of dates and levels alone: a stored series' counts are not read
    lists = series.select(*index, F.col(MONTHS)["date"].alias("_dates"), F.col(MONTHS)["c"].cast("array<double>").alias("_levels"))
    found = lists.mapInArrow(_scanned(fits, months), schema)
    best = F.array_min(F.transform("_fits", lambda x: F.struct(F.round(x["error"], 12).alias("_rounded"), *[x[c].alias(c) for c in fit.names])))
    return found.select(*index, best.alias("_best")).select(*index, *[F.col("_best")[c].alias(c) for c in fit.names])


def fit_step(predictor: DataFrame, index: Sequence[str] | None = None) -> DataFrame:
    """``index..., t_0, c_0, error`` per index."""
    return _fitted(predictor, index, step_fits(), ["t_0"])


def fit_rectangle(predictor: DataFrame, index: Sequence[str] | None = None) -> DataFrame:
    """``index..., t_0, t_1, c_0, error`` per index."""
    return _fitted(predictor, index, rectangle_fits(), ["t_0", "t_1"])


def predict(predictor: DataFrame, estimates: DataFrame, index: Sequence[str] | None = None) -> DataFrame:
    """I8: add ``c_hat`` (``c_0`` inside the fitted support, else 0) by a null-safe join on the index. A series is
    joined as it is, and its months become rows after."""
    index = list(index or index_columns(predictor))
    est_cols = [c for c in ("t_0", "t_1", "c_0", "error") if c in estimates.columns]
    est = estimates.select(*[F.col(c).alias(f"_e_{c}") for c in index], *est_cols)
    on = [F.col(c).eqNullSafe(F.col(f"_e_{c}")) for c in index]
    out = predictor.join(est, on).drop(*[f"_e_{c}" for c in index])
    if MONTHS in out.columns:
        out = out.select(*[c for c in out.columns if c != MONTHS], F.inline(MONTHS))
    inside = F.col("date") >= F.col("t_0")
    if "t_1" in est_cols:
        inside = inside & (F.col("t_1").isNull() | (F.col("date") <= F.col("t_1")))
    return out.withColumn("c_hat", F.when(inside, F.col("c_0")).otherwise(F.lit(0.0)))
