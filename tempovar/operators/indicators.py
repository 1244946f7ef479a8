"""Indicators (D5-D10, D14, E1, B16): readmission-style rates, event-during-stay rates, weekly incidence.

Each function computes the naive indicator, or, given the per-visit stability
answers, the complete-source-only indicator of every cell in the same job
(4.2), and the naive one as a cell more if these have a level. Rows are counted by site, month and answers (a bit per cell); the counts
are unfolded into cells last, so no stay, event or match is copied per cell or
per threshold. The "All" care site (D14) is a roll-up done by exploding each row into
its site and "All" right before a partial aggregate, so the hot "All" key is
combined map-side. Stays duplicated by several GHM codes (trap T6) are carried
as a multiplicity, so row-count semantics hold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import season_year, week_start
from .asof import asof_nearest
from .stability import Stability, at_level, unfolded

ALL = "All"
ALL_MCD = "00 ALL"


def add_care_site(df: DataFrame, index: Sequence[str] = ("care_site_id",)) -> DataFrame:
    """Every row also counts for the "All" site; the site becomes a string."""
    if "care_site_id" not in index:
        return df
    return df.withColumn("care_site_id", F.explode(F.array(F.col("care_site_id").cast("string"), F.lit(ALL))))


def add_mcd(cohort: DataFrame, mcd_start: str, max_code: str = "27") -> tuple[DataFrame, DataFrame]:
    """(per-group subset with ``MCD = code + ' ' + label``, all stays with ``MCD = '00 ALL'``).

    The subset keeps codes ``<= max_code`` as a string comparison (T20) from ``mcd_start`` on.
    """
    all_ = cohort.drop("CMD", "CMD_code").withColumn("MCD", F.lit(ALL_MCD))
    per_group = (cohort.where((F.col("CMD_code") <= max_code) & (F.col("sub_cohort") >= F.lit(mcd_start).cast("date")))
                 .withColumn("MCD", F.concat_ws(" ", "CMD_code", "CMD")).drop("CMD", "CMD_code"))
    return per_group, all_


def cohort_stays(cohort: DataFrame, index: Sequence[str] = ("care_site_id",)) -> DataFrame:
    """One row per stay with ``mult`` = its number of cohort rows."""
    keys = ["visit_cohort_id", "person_id", "cohort_stay_start", "cohort_stay_end", "sub_cohort", *index]
    return cohort.groupBy(*dict.fromkeys(keys)).agg(F.count("*").alias("mult"))


def duration_after_event(event_df: DataFrame, cohort: DataFrame, col_date: str,
                         thresholds: Sequence[int] = (30, 90), tolerance_days: int | None = None,
                         index: Sequence[str] = ("care_site_id",), stability: Stability | None = None) -> DataFrame:
    """D5 (C13, C14, H8, D6, D7): share of stays followed by an event within each threshold.

    The as-of match is the nearest event of the same person at or after the stay
    end, within ``tolerance_days`` (default: the largest threshold). A match that
    is the stay itself drops the stay (T4); groups with no match are absent (T5).
    ``n_total`` counts cohort rows, not distinct stays (T6).
    """
    tol = tolerance_days or max(thresholds)
    stays = cohort_stays(cohort, index)
    event = ["visit_occurrence_id", "person_id", "event_ts"]
    ev = event_df.where(F.col(col_date).isNotNull()).withColumn("event_ts", F.col(col_date).cast("timestamp_ntz"))
    if stability is None:
        ev = ev.select(*event).distinct()
    else:
        # events meet their visit's answers first: dealt by visit, an event's rows are made one where they are
        chosen = at_level(event_df, stability.level) if stability.level else None
        ev = ev.select(*event, *([] if chosen is None else [chosen.alias("_at_level")]))
        ev = stability.of(ev, ["visit_occurrence_id"], None if chosen is None else F.col("_at_level")).groupBy(*event).agg(F.bit_or("cells").alias("cells"))
    found = asof_nearest(stays, ev, "person_id", "cohort_stay_end", "visit_occurrence_id", "event_ts", tol,
                         "cells" if stability is not None else None)
    # a stay has one match, or one per step of its frontier: rows go straight into the partial aggregate
    after = F.col("_m.ts") - F.col("cohort_stay_end")
    matched = (found.withColumn("_m", F.explode("match")).where(F.col("_m.id") != F.col("visit_cohort_id"))
               .select(*index, "sub_cohort", F.col("_m.cells").alias("cells"), F.col("mult").alias("_any"),
                       *[F.when(after <= F.make_dt_interval(days=F.lit(int(t))), F.col("mult")).otherwise(F.lit(0)).cast("long").alias(f"_{t}") for t in thresholds]))
    counts = ["_any", *[f"_{t}" for t in thresholds]]
    keys = [*index, "sub_cohort"]
    classes = add_care_site(matched, index)
    if stability is None:
        events = classes.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])
        extra = []
    else:
        events = unfolded(classes, keys, counts, stability.size).where(F.col("_any") > 0)
        extra = ["param_id"]
    th = F.explode(F.array(*[F.struct(F.lit(f"before_{t}_days").alias("threshold"), F.col(f"_{t}").alias("n")) for t in thresholds]))
    n_events = events.select(*keys, *extra, th.alias("_t")).select(*keys, F.col("_t.threshold").alias("threshold"), *extra, F.col("_t.n").cast("int").alias("n_events"))
    n_total = (add_care_site(stays, index).groupBy(*keys)
               .agg(F.sum("mult").cast("long").alias("n_total")))
    out = n_events.join(n_total, keys)
    return out.withColumn("rate", F.col("n_events") / F.col("n_total"))


def _events_by_stay(event_df: DataFrame, stability: Stability | None) -> DataFrame:
    """The visits with an event, as ``visit_cohort_id``, with the cells they are stable in."""
    ev = event_df.select("visit_occurrence_id").distinct()
    if stability is not None:
        ev = stability.of(ev, ["visit_occurrence_id"])  # a visit that is stable in a cell has rows of the level
    return ev.withColumnRenamed("visit_occurrence_id", "visit_cohort_id")


def event_during_stay(event_df: DataFrame, cohort: DataFrame, index: Sequence[str] = ("care_site_id",),
                      stability: Stability | None = None, **_) -> DataFrame:
    """D8 (C17): share of stays with an event of the same visit.

    ``n_events`` sums a flag over cohort rows while ``n_total`` counts distinct
    stays, so a rate can pass 1 when stays are duplicated (T6), as in the study.
    Every cell has a row for every site and month with a stay.
    """
    ev = _events_by_stay(event_df, stability).withColumn("_hit", F.lit(True))
    keys = [*index, "sub_cohort"]
    rows = (cohort_stays(cohort, index).join(ev, "visit_cohort_id", "left")
            .select(*keys, *(["cells"] if stability is not None else []), F.when(F.col("_hit"), F.col("mult")).otherwise(F.lit(0)).cast("long").alias("_events"),
                    F.lit(1).cast("long").alias("_total")))
    classes = add_care_site(rows, index)
    if stability is None:
        out = classes.groupBy(*keys).agg(F.sum("_events").cast("int").alias("n_events"), F.sum("_total").alias("n_total"))
    else:
        out = (unfolded(classes, keys, ["_events"], stability.size, ["_total"])
               .select(*keys, "param_id", F.col("_events").cast("int").alias("n_events"), F.col("_total").alias("n_total")))
    return out.withColumn("rate", F.col("n_events") / F.col("n_total"))


def condition_incidence(event_df: DataFrame, cohort: DataFrame, index: Sequence[str] = ("care_site_id",),
                        stability: Stability | None = None, by: Sequence[str] = (), **_) -> DataFrame:
    """D9 (C18, D10, E1, H7): weekly distinct stays with the condition, and the seasonal peak.

    Weeks start on Monday (T11); a season runs September to August (T19);
    ``max_events`` is set on the peak week of each (season, site) only, the
    earliest week winning ties. A stay has one site, so distinct stays are counted
    per site, week and stability answers, and those counts add up. ``by`` names columns of the
    events that tell several conditions apart, counted in the same pass.
    """
    ev = event_df.select("visit_occurrence_id", *by).distinct()
    if stability is not None:
        ev = stability.of(ev, ["visit_occurrence_id", *by])
    ev = ev.withColumnRenamed("visit_occurrence_id", "visit_cohort_id")
    hits = (cohort.select("visit_cohort_id", week_start("cohort_stay_start").alias("sub_cohort"), *index).distinct()
            .join(ev, "visit_cohort_id").withColumn("_events", F.lit(1).cast("long")))
    keys = [*by, *index, "sub_cohort"]
    classes = add_care_site(hits, index)
    if stability is None:
        counted, extra = classes.groupBy(*keys).agg(F.sum("_events").alias("_events")), []
    else:
        counted, extra = unfolded(classes, keys, ["_events"], stability.size).where(F.col("_events") > 0), ["param_id"]
    weekly = (counted.select(*keys, *extra, F.col("_events").cast("int").alias("n_events"))
              .withColumn("school_years", season_year("sub_cohort").cast("int")))
    w = Window.partitionBy("school_years", *by, *index, *extra).orderBy(F.col("n_events").desc(), "sub_cohort")
    return weekly.withColumn("max_events", F.when(F.row_number().over(w) == 1, F.col("n_events")))


KEY_FUNCTIONS = {
    "duration_after": duration_after_event,
    "during_stay": event_during_stay,
    "incidence": condition_incidence,
}
