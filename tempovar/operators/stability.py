"""Complete-source filtering (I9, I10, I13, B14, D4, D11, D12) with the parameter grid folded in.

A visit is stable in cell ``(start, max_error, min_c_0[, end])`` iff every
estimate row matched by every care site of the visit has ``t_0 <= start``,
``error <= max_error``, ``c_0 >= min_c_0`` (and ``t_1 >= end``); a site with
no estimate, or a NULL in any of these, makes the visit unstable. An AND of
threshold tests is a test on extremes, so one aggregate per visit,
``max(t_0), max(error), min(c_0), min(t_1)`` plus a ``bad`` flag, answers all
cells at once. The answers are one whole number, a bit per cell: what a visit
carries through joins and shuffles whatever the grid. Rows are counted by that
number, and only the counts are unfolded into cells (``unfolded``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..config import Outcome
from .quantiles import nearest_ranks

ERROR_LABELS = ["No filter", "Q3", "median", "Q1"]
C0_LABELS = ["No filter", "Q1", "median", "Q3"]
FILTER_FIELDS = ["note_type", "stay_type", "specialties_set", "diag_type", "source_system", "condition_type"]


def filter_estimates(estimates: DataFrame, care_site_level: str, **filters) -> DataFrame:
    """AND of the equality filters that are set (a filter on a column the model lacks is an error)."""
    out = estimates.where(F.col("care_site_level") == care_site_level)
    for name in FILTER_FIELDS:
        value = filters.get(name)
        if value:
            if name not in estimates.columns:
                raise ValueError(f"estimates have no column {name!r} to filter on")
            out = out.where(F.col(name) == value)
    return out


def outcome_filters(outcome: Outcome) -> dict:
    return {k: getattr(outcome, k) for k in FILTER_FIELDS}


def site_column(care_site_level: str) -> str:
    if care_site_level == C.LEVEL_HOSPITAL:
        return "care_site_id"
    if care_site_level in C.DETAIL_LEVELS:
        return "detail_care_site_id"
    raise ValueError(f"care_site_level must be one of {C.CARE_SITE_LEVELS}, not {care_site_level!r}")


def at_level(event_df: DataFrame, care_site_level: str) -> Column | None:
    """At department / unit level, whether a row's detail site is of that level; None: every row is."""
    if care_site_level in C.DETAIL_LEVELS and "detail_care_site_level" in event_df.columns:
        return F.col("detail_care_site_level") == care_site_level
    site_column(care_site_level)  # validates the level
    return None


def level_rows(event_df: DataFrame, care_site_level: str) -> DataFrame:
    """The rows of the level."""
    chosen = at_level(event_df, care_site_level)
    return event_df if chosen is None else event_df.where(chosen)


def visit_extremes(event_df: DataFrame, estimates: DataFrame, care_site_level: str,
                   visit_col: str = "visit_occurrence_id", with_t1: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """D4 folded: per visit ``max_t0, max_error, min_c0[, min_t1], bad`` over its sites' estimate rows.

    ``estimates`` must already be filtered (B14). They are reduced to one row of extremes per
    site first, so an event row meets at most one; AQE broadcasts them after measuring them. A site that a
    visit has again changes no extreme, so rows are dealt by visit only. ``by`` names further columns that tell events apart.
    """
    col = site_column(care_site_level)
    rows = level_rows(event_df, care_site_level).select(visit_col, *by, F.col(col).cast("long").alias("_site"))
    bad = F.col("t_0").isNull() | F.col("error").isNull() | F.col("c_0").isNull()
    if with_t1:
        bad = bad | F.col("t_1").isNull()
    extremes = [F.max("t_0").alias("max_t0"), F.max("error").alias("max_error"), F.min("c_0").alias("min_c0"),
                *([F.min("t_1").alias("min_t1")] if with_t1 else [])]
    site = estimates.groupBy(F.col("care_site_id").cast("long").alias("_site")).agg(*extremes, F.bool_or(bad).alias("bad"))
    again = [F.max("max_t0").alias("max_t0"), F.max("max_error").alias("max_error"), F.min("min_c0").alias("min_c0"),
             *([F.min("min_t1").alias("min_t1")] if with_t1 else [])]
    return rows.join(site, "_site", "left").groupBy(visit_col, *by).agg(*again, F.bool_or(F.coalesce("bad", F.lit(True))).alias("bad"))


@dataclass(frozen=True)
class Grid:
    """The parameter cells (I11): start dates x error limits x completeness floors, ``param_id`` counting the last fastest.

    Limits and floors come by rank ("No filter", then quantiles), so equal quantiles still give cells of their own
    (T9). A NULL quantile (no estimates) admits nothing. At most 63 cells, one bit each in a visit's answers.
    """

    starts: tuple[str, ...]
    max_errors: tuple[float | None, ...]
    min_c_0s: tuple[float | None, ...]
    end: str | None = None
    active_cs_count: int = 0

    def __post_init__(self):
        if self.size > 63:
            raise ValueError(f"a grid has at most 63 cells, not {self.size}: analyse the start dates in several grids")

    @classmethod
    def of(cls, thresholds: DataFrame, start_dates: Sequence[str], end_date: str | None = None) -> Grid:
        """From the one row of ``estimate_parameters``, read once; everything after it plans with literals."""
        row = thresholds.first()
        return cls(tuple(start_dates), tuple(row.max_errors), tuple(row.min_c_0s), end_date, row.active_cs_count)

    @property
    def shape(self) -> tuple[int, int, int]:
        return len(self.starts), len(self.max_errors), len(self.min_c_0s)

    @property
    def size(self) -> int:
        s, e, c = self.shape
        return s * e * c

    def answers(self, t_0: Column, error: Column, c_0: Column, usable: Column) -> Column:
        """The cells that a row with these values passes, as bits of a long: a product of one number per dimension,
        whose bits never meet."""
        _, n_errors, n_floors = self.shape

        def passed(tests: Sequence[Column], step: int) -> Column:
            parts = [F.when(test, F.lit(1 << (i * step))).otherwise(F.lit(0)).cast("long") for i, test in enumerate(tests)]
            total = parts[0]
            for part in parts[1:]:
                total = total + part
            return total

        starts = passed([t_0 <= F.lit(s).cast("date") for s in self.starts], n_errors * n_floors)
        errors = passed([error <= F.lit(x).cast("double") for x in self.max_errors], n_floors)
        floors = passed([c_0 >= F.lit(x).cast("double") for x in self.min_c_0s], 1)
        return F.when(F.coalesce(usable, F.lit(False)), starts * errors * floors).otherwise(F.lit(0).cast("long"))

    def labelled(self, df: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
        """Add the cell's parameters and rank labels by ``param_id``."""
        _, n_errors, n_floors = self.shape
        p = F.col("param_id")
        start, error, floor = F.floor(p / (n_errors * n_floors)).cast("int"), F.floor(p / n_floors).cast("int") % n_errors, p % n_floors

        def pick(values: Sequence, at: Column, kind: str) -> Column:
            return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), at)

        return df.select("*", pick(self.starts, start, "string").alias("start_observation_date"),
                         pick(self.max_errors, error, "double").alias("max_error"), pick(self.min_c_0s, floor, "double").alias("min_c_0"),
                         pick(ERROR_LABELS, error, "string").alias("max_error_label"), pick(C0_LABELS, floor, "string").alias("min_c_0_label"))

    def frame(self, spark: SparkSession) -> DataFrame:
        """The cells as a table (for reports and the count summary)."""
        rows = [(i, s, e, c, ERROR_LABELS[k % len(self.max_errors)], C0_LABELS[i % len(self.min_c_0s)])
                for i, (s, (k, e), c) in enumerate(product(self.starts, enumerate(self.max_errors), self.min_c_0s))]
        return spark.createDataFrame(rows, "param_id int, start_observation_date string, max_error double, min_c_0 double, "
                                           "max_error_label string, min_c_0_label string")


def unfolded(classes: DataFrame, keys: Sequence[str], counts: Sequence[str], size: int, totals: Sequence[str] = ()) -> DataFrame:
    """Counts per cell from counts per answer: ``keys, param_id, counts, totals``, ``size`` rows a key.

    ``classes`` has the answers in ``cells`` (NULL: none). Rows with equal keys and answers are added up first (in the
    task, then over the shuffle), so a key meets the distinct answers that its rows have, never its rows.
    ``totals`` are added up over all answers.
    """
    added = classes.groupBy(*keys, "cells").agg(*[F.sum(c).alias(c) for c in (*counts, *totals)])
    gathered = added.groupBy(*keys).agg(F.collect_list(F.struct("cells", *counts)).alias("_classes"), *[F.sum(c).alias(c) for c in totals])
    sums = [F.expr(f"transform(sequence(0, {size - 1}), k -> aggregate(_classes, 0L, (acc, x) -> "
                   f"acc + if((shiftright(x.cells, k) & 1) = 1, coalesce(x.{c}, 0L), 0L)))").alias(c) for c in counts]
    per_key = gathered.select(*keys, *totals, F.arrays_zip(*sums).alias("_cells"))
    return (per_key.select(*keys, *totals, F.posexplode("_cells").alias("param_id", "_cell"))
            .select(*keys, "param_id", *[F.col("_cell")[c].alias(c) for c in counts], *totals))


@dataclass(frozen=True)
class Stability:
    """Per visit that is stable anywhere, the cells it is stable in (``cells``, bits of a long); the grid.

    With a ``level`` the naive form is one cell more, the last one: there every event counts, in the others the rows of
    the level alone. Events, stays and matches are then dealt and scanned once for both.
    """

    visits: DataFrame
    grid: Grid
    level: str | None = None

    @property
    def size(self) -> int:
        return self.grid.size + (self.level is not None)

    def of(self, events: DataFrame, on: Sequence[str], at_level: Column | None = None) -> DataFrame:
        """The events that count in a cell, with ``cells``. ``at_level`` are those of the level, by default all."""
        if self.level is None:
            return events.join(self.visits, list(on))
        bit = self.grid.size
        naive = F.lit(1 << bit if bit < 63 else -(1 << 63)).cast("long")
        cells = F.col("cells") if at_level is None else F.when(at_level, F.col("cells"))
        return events.join(self.visits, list(on), "left").withColumn("cells", F.coalesce(cells, F.lit(0).cast("long")).bitwiseOR(naive))


def visit_cells(extremes: DataFrame, grid: Grid, by: Sequence[str] = (), level: str | None = None) -> Stability:
    """I9 for all cells (a NULL extreme or a bad site passes none)."""
    usable = ~F.col("bad")
    if grid.end:
        usable = usable & (F.col("min_t1") >= F.lit(grid.end).cast("date"))
    cells = grid.answers(F.col("max_t0"), F.col("max_error"), F.col("min_c0"), usable)
    return Stability(extremes.select(extremes.columns[0], *by, cells.alias("cells")).where(F.col("cells") != 0), grid, level)


def stable_in(params_prefix: str = "p_", with_t1: bool = False) -> Column:
    """I9 per visit extremes against one cell's thresholds."""
    cond = (~F.col("bad") & (F.col("max_t0") <= F.col(f"{params_prefix}start"))
            & (F.col("max_error") <= F.col(f"{params_prefix}max_error"))
            & (F.col("min_c0") >= F.col(f"{params_prefix}min_c_0")))
    if with_t1:
        cond = cond & (F.col("min_t1") >= F.col(f"{params_prefix}end"))
    return F.coalesce(cond, F.lit(False))


def site_stable(start: Column, max_error: Column, min_c0: Column, end: Column | None = None) -> Column:
    """I9 on one estimate row; NULL counts as unstable."""
    cond = (F.col("t_0") <= start) & (F.col("error") <= max_error) & (F.col("c_0") >= min_c0)
    if end is not None and end is not False:
        cond = cond & (F.col("t_1") >= end)
    return F.coalesce(cond, F.lit(False))


def stable_site_count(estimates: DataFrame, start_observation_date: str, care_site_level: str, max_error: float = 1.0,
                      min_c_0: float = 0.0, end_date: str | None = None, **filters) -> DataFrame:
    """The stable sites of one cell as a one-row frame; it reads the estimates alone."""
    est = filter_estimates(estimates, care_site_level, **filters)
    end = F.lit(end_date).cast("date") if end_date and "t_1" in est.columns else None
    return (est.where(site_stable(F.lit(start_observation_date).cast("date"), F.lit(float(max_error)), F.lit(float(min_c_0)), end))
            .agg(F.countDistinct("care_site_id").cast("long").alias("stable_cs_count")))


def filter_stable_visits(event_df: DataFrame, estimates: DataFrame, start_observation_date: str,
                         care_site_level: str, max_error: float = 1.0, min_c_0: float = 0.0,
                         end_date: str | None = None, visit_col: str = "visit_occurrence_id",
                         **filters) -> tuple[DataFrame, DataFrame]:
    """I10 for one cell: (stable-site count as a one-row frame, events of stable visits).

    The events returned are the level-filtered rows (T21) of visits stable in the cell.
    """
    est = filter_estimates(estimates, care_site_level, **filters)
    with_t1 = bool(end_date) and "t_1" in est.columns
    ext = visit_extremes(event_df, est, care_site_level, visit_col, with_t1)
    cell = ext.withColumn("p_start", F.lit(start_observation_date).cast("date")) \
              .withColumn("p_max_error", F.lit(float(max_error))) \
              .withColumn("p_min_c_0", F.lit(float(min_c_0)))
    if with_t1:
        cell = cell.withColumn("p_end", F.lit(end_date).cast("date"))
    stable_visits = cell.where(stable_in(with_t1=with_t1)).select(visit_col)
    events = level_rows(event_df, care_site_level).join(stable_visits, visit_col, "left_semi")
    return stable_site_count(estimates, start_observation_date, care_site_level, max_error, min_c_0, end_date, **filters), events


def estimate_parameters(estimates: DataFrame, care_site_level: str, **filters) -> DataFrame:
    """One row with the active-site count and the threshold lists.

    ``max_errors = [1.0, Q3, Q2, Q1]`` of ``error`` and ``min_c_0s = [0.0, Q1, Q2, Q3]``
    of ``c_0``, exact quantiles by the nearest-rank rule.
    """
    est = filter_estimates(estimates, care_site_level, **filters)
    ranks = nearest_ranks(est, ["error", "c_0"], [0.25, 0.5, 0.75])
    quantile = {c: F.max(F.when(F.col("name") == c, F.col("values"))) for c in ("error", "c_0")}
    errors, floors = (ranks.agg(quantile[c].alias("v")).scalar() for c in ("error", "c_0"))
    return est.agg(F.countDistinct("care_site_id").cast("long").alias("active_cs_count")).select(
        "active_cs_count",
        F.array(F.lit(1.0), *[F.get(errors, i) for i in (2, 1, 0)]).alias("max_errors"),
        F.array(F.lit(0.0), *[F.get(floors, i) for i in (0, 1, 2)]).alias("min_c_0s"))


def parameter_grid(thresholds: DataFrame, start_dates: Sequence[str], end_date: str | None = None) -> DataFrame:
    """The 48 cells as a table."""
    return Grid.of(thresholds, start_dates, end_date).frame(thresholds.sparkSession)


def stable_site_counts(estimates: DataFrame, grid: Grid, care_site_level: str, **filters) -> DataFrame:
    """D12 per cell: distinct sites with at least one stable estimate row (param_id, cso_cs_count)."""
    est = filter_estimates(estimates, care_site_level, **filters)
    usable = F.col("t_1") >= F.lit(grid.end).cast("date") if grid.end else F.lit(True)
    cells = grid.answers(F.col("t_0"), F.col("error"), F.col("c_0"), usable)
    sites = est.select("care_site_id", cells.alias("cells")).groupBy("care_site_id").agg(F.bit_or("cells").alias("cells"))
    return unfolded(sites.withColumn("cso_cs_count", F.lit(1).cast("long")).withColumn("_every", F.lit(True)), ["_every"], ["cso_cs_count"], grid.size).drop("_every")
