"""Indicators on hand-made frames (E1, T11, T19, T4, T6) and study properties on the smallest test data."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tempovar.operators.indicators import condition_incidence, duration_after_event, event_during_stay


def cohort(spark, rows):
    return (spark.createDataFrame(rows, "visit_cohort_id long, person_id long, care_site_id long, "
                                        "cohort_stay_start timestamp_ntz, cohort_stay_end timestamp_ntz")
            .withColumn("sub_cohort", F.trunc("cohort_stay_start", "month")))


def test_incidence_weeks_seasons_and_peak(spark):
    d = datetime
    rows = [(1, 1, 7, d(2019, 8, 31), d(2019, 9, 2)),   # Saturday, season 2019
            (2, 2, 7, d(2019, 9, 1), d(2019, 9, 2)),    # Sunday, same ISO week, season 2020 by week start?
            (3, 3, 7, d(2019, 9, 2), d(2019, 9, 3)),    # Monday: next week
            (4, 4, 7, d(2019, 9, 3), d(2019, 9, 4)),
            (5, 5, 7, d(2019, 9, 9), d(2019, 9, 10)),
            (6, 6, 7, d(2019, 9, 10), d(2019, 9, 11))]
    c = cohort(spark, rows)
    ev = spark.createDataFrame([(i,) for i in range(1, 7)], "visit_occurrence_id long")
    out = {(r.care_site_id, str(r.sub_cohort)): r for r in condition_incidence(ev, c).collect()}
    assert out[("7", "2019-08-26")].n_events == 2 and out[("7", "2019-08-26")].school_years == 2019
    assert out[("7", "2019-09-02")].n_events == 2 and out[("7", "2019-09-02")].school_years == 2020
    # tie on the peak inside season 2020: the earliest week carries max_events
    assert out[("7", "2019-09-02")].max_events == 2 and out[("7", "2019-09-09")].max_events is None
    assert out[("All", "2019-09-02")].n_events == 2


def test_duration_after_excludes_self_match_and_counts_rows(spark):
    d = datetime
    rows = [(1, 1, 7, d(2020, 1, 1), d(2020, 1, 5)),
            (1, 1, 7, d(2020, 1, 1), d(2020, 1, 5)),   # same stay twice (two GHM codes, T6)
            (2, 2, 7, d(2020, 1, 1), d(2020, 1, 5)),
            (3, 3, 8, d(2020, 1, 2), d(2020, 1, 6))]
    c = cohort(spark, rows)
    ev = spark.createDataFrame([(100, 1, d(2020, 1, 20)),      # person 1, 15 days
                                (2, 2, d(2020, 1, 5)),         # the stay itself is nearest: stay dropped (T4)
                                (200, 2, d(2020, 1, 10)),
                                (300, 3, d(2020, 3, 1))],      # person 3, 55 days
                               "visit_occurrence_id long, person_id long, visit_start_datetime timestamp_ntz")
    out = {(r.care_site_id, r.threshold): (r.n_events, r.n_total) for r in
           duration_after_event(ev, c, "visit_start_datetime", (30, 90)).collect()}
    assert out[("7", "before_30_days")] == (2, 3)
    assert out[("8", "before_30_days")] == (0, 1)
    assert out[("8", "before_90_days")] == (1, 1)
    assert out[("All", "before_90_days")] == (3, 4)


def test_during_stay_rate_can_pass_one(spark):
    d = datetime
    rows = [(1, 1, 7, d(2020, 1, 1), d(2020, 1, 5)), (1, 1, 7, d(2020, 1, 1), d(2020, 1, 5))]
    ev = spark.createDataFrame([(1,)], "visit_occurrence_id long")
    r = [x for x in event_during_stay(ev, cohort(spark, rows)).collect() if x.care_site_id == "7"][0]
    assert (r.n_events, r.n_total, r.rate) == (2, 1, 2.0)


def test_index_finer_than_the_stay(spark):
    """One stay in two diagnosis groups, one later event: each group counts it once."""
    d = datetime
    c = cohort(spark, [(1, 1, 7, d(2020, 1, 1), d(2020, 1, 5))])
    c = c.withColumn("MCD", F.explode(F.array(F.lit("01 A"), F.lit("02 B"))))
    ev = spark.createDataFrame([(100, 1, d(2020, 1, 13))], "visit_occurrence_id long, person_id long, visit_start_datetime timestamp_ntz")
    out = duration_after_event(ev, c, "visit_start_datetime", (30, 90), index=("care_site_id", "MCD")).collect()
    assert len(out) == 8 and {(r.n_events, r.n_total, r.rate) for r in out} == {(1, 1, 1.0)}


def test_complete_source_match_takes_rows_of_the_level(spark):
    """A stable visit has a unit row at day 3 and a department row at day 78: only the latter counts at department level."""
    from dataclasses import replace

    from tempovar import config as C
    from tempovar.plans.grid import statistical_analysis
    d = datetime
    c = cohort(spark, [(1, 1, 7, d(2020, 1, 1), d(2020, 1, 5))])
    ev = spark.createDataFrame([(100, 1, 31, C.LEVEL_UNIT, d(2020, 1, 8)), (100, 1, 21, C.LEVEL_DEPARTMENT, d(2020, 3, 23))],
                               "visit_occurrence_id long, person_id long, detail_care_site_id long, detail_care_site_level string, visit_start_datetime timestamp_ntz")
    est = spark.createDataFrame([(C.LEVEL_DEPARTMENT, 21, d(2019, 1, 1).date(), 0.9, 0.01)],
                                "care_site_level string, care_site_id long, t_0 date, c_0 double, error double")
    outcome = C.Outcome(**{**C.OUTCOMES["hospit_visit"].__dict__, "care_site_level": C.LEVEL_DEPARTMENT, "stay_type": None, "specialties_set": None,
                           "col_date": "visit_start_datetime"})
    study = replace(C.DEFAULT_STUDY, start_observation_dates=["2020-01-01"])
    out = {(r.analysis, r.threshold): r.n_events for r in statistical_analysis(c, ev, est, outcome, study).where("care_site_id = '7'").collect()}
    assert out[C.CSO, "before_30_days"] == 0 and out[C.CSO, "before_90_days"] == 1
    assert out[C.NAIVE, "before_30_days"] == 1


def test_no_cells_below_an_aggregate(spark, pipeline):
    """Stays, events and matches are counted by their answers; cells come out of the counts, above the last sum."""
    for name in ("hospit_visit", "prescription_note", "flu_condition"):
        plan = pipeline.indicator(name)._jdf.queryExecution().optimizedPlan().toString()
        assert "count(distinct visit_cohort_id" not in plan
        for line in (lines := plan.splitlines()):
            if "Generate posexplode" in line and "_cell" in line:
                below = lines[lines.index(line) + 1:]
                assert not any("Generate posexplode" in x and "_cell" in x for x in below)


@pytest.fixture(scope="module")
def pipeline(spark):
    from tempovar.plans.study import Pipeline
    from tempovar.sources.surrogate import warehouse
    return Pipeline(*warehouse(spark, "/root/testdata/sf0.001"))


def test_study_properties(pipeline):
    res = pipeline.indicator("hospit_visit").toPandas()
    naive = res[res.analysis == "Naive analysis"]
    cso = res[res.analysis != "Naive analysis"]
    # n_events(30) <= n_events(90) <= n_total
    piv = naive.pivot_table(index=["param_id", "care_site_id", "sub_cohort"], columns="threshold",
                            values=["n_events", "n_total"])
    assert (piv[("n_events", "before_30_days")].fillna(0) <= piv[("n_events", "before_90_days")].fillna(0)).all()
    assert (naive.n_events <= naive.n_total).all()
    # sites sum to "All" for n_total
    one = naive[(naive.param_id == 0) & (naive.threshold == "before_90_days")]
    sites = one[one.care_site_id != "All"].groupby("sub_cohort").n_total.sum()
    alls = one[one.care_site_id == "All"].set_index("sub_cohort").n_total
    assert (sites.reindex(alls.index).fillna(0) <= alls).all()


def test_cso_events_subset_of_naive_during_stay(pipeline):
    # events during the stay: CSO keeps a subset of the naive events, cell by cell
    res = pipeline.indicator("prescription_note").toPandas()
    naive = res[res.analysis == "Naive analysis"]
    cso = res[res.analysis != "Naive analysis"]
    m = cso.merge(naive, on=["param_id", "care_site_id", "sub_cohort"], suffixes=("_c", "_n"))
    assert len(m) == len(cso)
    assert (m.n_events_c <= m.n_events_n).all() and (m.n_total_c == m.n_total_n).all()
