"""Statistical analysis over the parameter grid.

One job per outcome computes the naive indicator once and the complete-source
-only indicator of all cells at once (stability folded into per-visit answers, the naive
form a cell of its own), in one long table with an ``analysis`` column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import DEFAULT_STUDY, OUTCOMES, Outcome, Study
from ..operators.indicators import KEY_FUNCTIONS, add_mcd, condition_incidence
from ..operators.stability import (FILTER_FIELDS, Grid, estimate_parameters, filter_estimates, filter_stable_visits, outcome_filters, stable_site_count,
                                   stable_site_counts, visit_cells, visit_extremes)

COHORT_COLS = ["visit_cohort_id", "person_id", "care_site_id", "cohort_stay_start", "cohort_stay_end",
               "stay_type", "CMD_code", "CMD", "sub_cohort"]


@dataclass
class AnalysisCohort:
    cohort_all: DataFrame  # stays of stable hospitals, with MCD = "00 ALL"
    cohort_mcd: DataFrame  # per-group subset (T22: exposed, not used by the indicators)
    hospital_count: DataFrame  # one row: stable_cs_count


def analysis_cohort(cohort_visit: DataFrame, visit_estimates: DataFrame, study: Study = DEFAULT_STUDY) -> AnalysisCohort:
    """B13 (finished stays, 9 columns) -> I13 (stable hospitals at ``stability_date``) -> B16."""
    cohort = cohort_visit.select(*COHORT_COLS).where(F.col("cohort_stay_end").isNotNull())
    count, cohort = filter_stable_visits(cohort, visit_estimates, study.stability_date, C.LEVEL_HOSPITAL,
                                         visit_col="visit_cohort_id", stay_type="hospitalisés")
    mcd, all_ = add_mcd(cohort, study.mcd_start)
    return AnalysisCohort(all_, mcd, count)


def hospital_count(visit_estimates: DataFrame, study: Study = DEFAULT_STUDY) -> DataFrame:
    """The ``hospital_count`` of the analysis cohort, which needs no stay."""
    return stable_site_count(visit_estimates, study.stability_date, C.LEVEL_HOSPITAL, stay_type="hospitalisés")


def _kwargs(outcome: Outcome, study: Study) -> dict:
    if outcome.key_function == "duration_after":
        return dict(col_date=outcome.col_date, thresholds=study.thresholds, tolerance_days=study.tolerance_days)
    return {}


def outcome_thresholds(estimates: DataFrame, outcome: Outcome) -> DataFrame:
    """D11 for an outcome: one row, from which all its cells follow."""
    return estimate_parameters(estimates, outcome.care_site_level, **outcome_filters(outcome))


def outcome_grid(thresholds: DataFrame, outcome: Outcome, estimates: DataFrame, study: Study) -> Grid:
    """The outcome's cells, from its threshold row; a rectangle model must also reach the last month."""
    end = study.last_month if outcome.use_end_date and "t_1" in estimates.columns else None
    return Grid.of(thresholds, study.start_observation_dates, end)


def _analysed(rows: DataFrame, grid: Grid) -> DataFrame:
    """The naive cell's rows copied to each cell, every cell's rows from its start date on (B15), with ``analysis``."""
    naive = F.col("param_id") == grid.size
    cells = F.explode(F.when(naive, F.sequence(F.lit(0), F.lit(grid.size - 1))).otherwise(F.array("param_id")))
    own = [c for c in rows.columns if c != "param_id"]
    out = grid.labelled(rows.select(*own, F.when(naive, C.NAIVE).otherwise(C.CSO).alias("analysis"), cells.alias("param_id")))
    out = out.where(F.col("sub_cohort") >= F.col("start_observation_date").cast("date"))
    return out.select(*[c for c in out.columns if c != "analysis"], "analysis")


def statistical_analysis(cohort_all: DataFrame, event_df: DataFrame, estimates: DataFrame, outcome: Outcome,
                         study: Study = DEFAULT_STUDY, thresholds: DataFrame | None = None,
                         sensibility_variables: Sequence[str] = ("care_site_id",)) -> DataFrame:
    """Naive (copied to each cell, from its start date on) + CSO per cell, one table.

    ``sensibility_variables`` are the grouping columns beside the month (``care_site_id``, ``MCD``);
    ``thresholds`` is the stored row of ``outcome_thresholds``, worked out if not given.
    """
    level = outcome.care_site_level
    est = filter_estimates(estimates, level, **outcome_filters(outcome))
    grid = outcome_grid(outcome_thresholds(estimates, outcome) if thresholds is None else thresholds, outcome, estimates, study)
    fn = KEY_FUNCTIONS[outcome.key_function]
    kw = _kwargs(outcome, study) | {"index": list(sensibility_variables)}

    # complete sources: rows of the level first, then the stable visits (the naive form keeps every row)
    extremes = visit_extremes(event_df, est, level, "visit_occurrence_id", grid.end is not None)
    return _analysed(fn(event_df, cohort_all, stability=visit_cells(extremes, grid, level=level), **kw), grid)


def incidence_analysis(cohort_all: DataFrame, events: Mapping[str, DataFrame], estimates: DataFrame, study: Study = DEFAULT_STUDY,
                       thresholds: DataFrame | None = None, index: Sequence[str] = ("care_site_id",)) -> DataFrame:
    """I11 of several incidence outcomes in one pass: their rows with ``outcome_name``.

    ``events`` are the outcomes' tables by name. The outcomes must share model, level and filters, so one grid
    and one set of estimates serve all; a visit's stability is worked out per outcome, over its rows there.
    """
    first, *others = (OUTCOMES[name] for name in events)
    shared = ("key_function", "estimates", "care_site_level", *FILTER_FIELDS)
    if first.key_function != "incidence" or any(getattr(o, f) != getattr(first, f) for o in others for f in shared):
        raise ValueError("incidences that differ in model, level or filters are analysed one by one")
    by = "outcome_name"
    columns = sorted(set.intersection(*[set(df.columns) for df in events.values()]))
    rows = reduce(DataFrame.unionByName, [df.select(*columns).withColumn(by, F.lit(name)) for name, df in events.items()])
    est = filter_estimates(estimates, first.care_site_level, **outcome_filters(first))
    grid = outcome_grid(outcome_thresholds(estimates, first) if thresholds is None else thresholds, first, estimates, study)
    extremes = visit_extremes(rows, est, first.care_site_level, "visit_occurrence_id", grid.end is not None, by=[by])
    return _analysed(condition_incidence(rows, cohort_all, index, visit_cells(extremes, grid, [by], first.care_site_level), by=[by]), grid)


# The columns of the long table over all outcomes (A5, G2), with their types.
INDICATOR_COLUMNS = {"care_site_id": "string", "sub_cohort": "date", "threshold": "string", "n_events": "int", "n_total": "long",
                     "rate": "double", "school_years": "int", "max_events": "int", "param_id": "int",
                     "start_observation_date": "string", "max_error": "double", "min_c_0": "double",
                     "max_error_label": "string", "min_c_0_label": "string", "analysis": "string"}
#: Those that only some kinds of outcome have.
OWN_COLUMNS = {"duration_after": ["threshold", "n_total", "rate"], "during_stay": ["n_total", "rate"], "incidence": ["school_years", "max_events"]}


def union_schema(indicator: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """A5: every column of the long table, typed NULL where the outcome has none, and the columns to keep beside them."""
    return indicator.select(*[(F.col(c) if c in indicator.columns else F.lit(None)).cast(t).alias(c) for c, t in INDICATOR_COLUMNS.items()], *keep)


def own_schema(rows: DataFrame, outcome: Outcome) -> DataFrame:
    """The columns that an outcome of this kind has."""
    optional = {c for own in OWN_COLUMNS.values() for c in own} - set(OWN_COLUMNS[outcome.key_function])
    return rows.select(*[c for c in INDICATOR_COLUMNS if c not in optional])


def cs_count_summary(cs_count: DataFrame, estimates: DataFrame, outcome: Outcome, hospital_count: DataFrame,
                     study: Study = DEFAULT_STUDY, thresholds: DataFrame | None = None) -> DataFrame:
    """I17 (D11, D12, C22): per cell, sites at the level, active sites, stable sites.

    Cells join on the integer ``param_id`` (not on float thresholds), so equal
    quantiles do not multiply rows (T9).
    """
    level = outcome.care_site_level
    grid = outcome_grid(outcome_thresholds(estimates, outcome) if thresholds is None else thresholds, outcome, estimates, study)
    cso = stable_site_counts(estimates, grid, level, **outcome_filters(outcome))
    cells = (grid.frame(estimates.sparkSession).withColumn("care_site_level", F.lit(level))
             .withColumn("naive_cs_count", F.lit(grid.active_cs_count).cast("long")))
    total = cs_count.where(F.col("care_site_level") == level)
    out = (cells.join(total, "care_site_level")
           .join(cso, "param_id", "left")
           .fillna(0, subset=["cso_cs_count"])
           .withColumn("outcome_name", F.lit(outcome.name))
           .withColumn("cohort_hospital_count", hospital_count.select("stable_cs_count").scalar()))
    return out.select("param_id", "care_site_level", "total_care_site", "naive_cs_count", "cso_cs_count",
                      "start_observation_date", "max_error", "min_c_0", "max_error_label", "min_c_0_label",
                      "outcome_name", "cohort_hospital_count")
