"""What the summary over all outcomes shares between them, and its numpy scans, against the same without."""

import os
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tempovar import config as C
from tempovar.config import DEFAULT_STUDY, OUTCOMES
from tempovar.functions.text import contains_regex
from tempovar.operators import models as M
from tempovar.operators import probes as P
from tempovar.operators.asof import STEPS, asof_nearest
from tempovar.operators.cohort import prepare
from tempovar.operators.indicators import duration_after_event
from tempovar.operators.stability import Grid, Stability, level_rows
from tempovar.plans import grid as G
from tempovar.plans.study import INCIDENCES, Pipeline, StoredPipeline
from tempovar.sources.surrogate import warehouse
from tempovar.sources.tables import Tables

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def studies(spark, tmp_path):
    lazy = Pipeline(*warehouse(spark, SF))
    yield lazy, StoredPipeline(lazy.core, lazy.reference, lazy.claims, root=str(tmp_path / "study"))
    lazy.release()


def test_visits_meet_their_sites_once(studies):
    """Four probes dealt and joined the details by visit, two of them counted the same visits."""
    lazy, done = studies
    for name in ("visit", "icu", "note_per_visit"):
        assert rows(done.series(name)) == rows(lazy.series(name)), name
    assert {"prepared/visit_sites", "prepared/visit_counts"} <= set(done.held)
    assert "Exchange" not in plan(P.visit_sites(done.prepared, done.study))


def test_conditions_are_worked_out_in_one_pass(studies):
    lazy, done = studies
    done.indicator("bronchiolitis_condition")
    assert sorted(os.listdir(f"{done.root}/cohort")) == ["cohort_visit", "conditions"]
    for name in INCIDENCES:
        assert rows(done.outcome(name)) == rows(lazy.outcome(name)), name
        assert done.outcome(name).columns == lazy.outcome(name).columns


def test_a_visit_counts_at_its_own_unit_for_units_alone(spark):
    """A stay whose own site is a unit with a detail there: once as its own, and once as a detail where only units are asked for."""
    H, D, U = C.CARE_SITE_LEVELS
    t = datetime(1995, 1, 5)
    care_site = spark.createDataFrame([(1, H, "h", None), (4, U, "u", "REA MED")],
                                      "care_site_id long, care_site_type_source_value string, care_site_short_name string, place_of_service_source_value string")
    visits = spark.createDataFrame([(10, "V10", 1, 4, t, t, "x", "MCO", "ORBIS", "Actif"), (11, "V11", 1, 1, t, t, "x", "MCO", "ORBIS", "Actif")],
                                   "visit_occurrence_id long, visit_occurrence_source_value string, person_id long, care_site_id long, visit_start_datetime timestamp_ntz, "
                                   "visit_end_datetime timestamp_ntz, visit_source_value string, stay_source_value string, cdm_source string, row_status_source_value string")
    details = spark.createDataFrame([(1, t, 10, "UH", 4, "Actif"), (2, t, 11, "UH", 4, "Actif")],
                                    "visit_detail_id long, visit_detail_start_datetime timestamp_ntz, visit_occurrence_id long, visit_detail_type_source_value string, "
                                    "care_site_id long, row_status_source_value string")
    p = prepare(Tables({"care_site": care_site, "visit_occurrence": visits, "visit_detail": details}), Tables({}), Tables({}))
    for levels in ([U], [H, D, U]):
        got = P.monthly(P.visit_probe(p, levels=levels)).where("care_site_id = 4 and specialties_set = 'ICU'").agg(F.sum("n_visit")).first()[0]
        assert got == 2, levels


def test_months_laid_out_equal_the_expressions(spark):
    first = "map(date'1994-12-01', struct(9L as a, 9L as b), date'1996-02-01', struct(2L as a, 3L as b), date'2001-07-01', struct(1L as a, 0L as b))"
    seen = spark.sql(f"select 1000L care_site_id, {first} _own, map(date'1996-02-01', struct(5L as a, 0L as b), date'2001-08-01', struct(7L as a, 7L as b)) _in_details "
                     "union all select 1001L, null, map(date'1995-01-01', struct(0L as a, 4L as b))")
    sites = spark.sql("select col1 care_site_id, col2 care_site_type_source_value, 'x' care_site_short_name, 'y' place_of_service_source_value "
                      f"from values (1000L, '{C.LEVEL_DEPARTMENT}'), (1001L, '{C.LEVEL_UNIT}')")
    p = prepare(Tables({"care_site": sites}), Tables({}), Tables({}))
    cells = [({"label": c}, c, {"n": c}) for c in ("a", "b")]
    got = {(r.care_site_id, r.label): [(x.date, x.n) for x in r.months] for r in P.laid_out(seen, p, ["a", "b"], cells, P.of_largest(), DEFAULT_STUDY, C.CARE_SITE_LEVELS).collect()}
    want = {(r.care_site_id, c): [(x.date, x[c]) for x in r._months] for r in P.series(seen, p, ["a", "b"], DEFAULT_STUDY, C.CARE_SITE_LEVELS).collect() for c in ("a", "b")}
    assert got == {k: v for k, v in want.items() if any(n for _, n in v)} and len(got) == 3


def test_fits_of_near_ties_choose_by_the_rounded_error(spark):
    """Errors that differ below 12 places tie: the earlier start wins, as if all had been rounded."""
    rng = random.Random(23)
    series = {sid: [rng.choice([0.0, 0.5, 1.0]) + rng.choice([0.0, 1e-13, -1e-13]) for _ in range(rng.randint(1, 14))] for sid in range(80)} | {99: [0.0] * 9}
    months = [date(2000, 1, 1) + timedelta(days=31 * i) for i in range(14)]
    df = spark.createDataFrame([(sid, months[i], float(x)) for sid, c in series.items() for i, x in enumerate(c)], "care_site_id long, date date, c double")

    def best(c, supports):
        q, t = sum(x * x for x in c), len(c)
        return min((round((q - sum(c[a:b + 1]) ** 2 / (b - a + 1)) / t, 12), a, b) for a, b in supports)[1:]

    assert "MapInArrow" in plan(M.fit_step(df, ["care_site_id"]))
    step = {r.care_site_id: r.t_0 for r in M.fit_step(df, ["care_site_id"]).collect()}
    rect = {r.care_site_id: (r.t_0, r.t_1) for r in M.fit_rectangle(df, ["care_site_id"]).collect()}
    for sid, c in series.items():
        t = len(c)
        assert step[sid] == months[best(c, [(a, t - 1) for a in range(t)])[0]], sid
        assert rect[sid] == tuple(months[i] for i in best(c, [(a, b) for a in range(t) for b in range(a, t)])), sid


def test_a_scan_goes_on_over_batches_and_long_bands(spark):
    """A bucket cut by batches keeps its frontier; a band of more events than are looked at together is scanned."""
    rng, t0 = random.Random(29), datetime(2020, 1, 1)
    stays = [(i, i % 3, t0 + timedelta(days=rng.randrange(40))) for i in range(60)]
    events = [(1000 + j, j % 3, t0 + timedelta(days=rng.randrange(60), hours=rng.randrange(3)), 1 << rng.randrange(2) if j % 3 else rng.randrange(1, 1 << 10)) for j in range(900)]
    events += [(5000, 1, t0 + timedelta(days=59), 1 << 9)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        left = spark.createDataFrame(stays, "visit_cohort_id long, person_id long, cohort_stay_end timestamp_ntz")
        right = spark.createDataFrame(events, "visit_occurrence_id long, person_id long, event_ts timestamp_ntz, cells long")
        found = asof_nearest(left, right, "person_id", "cohort_stay_end", "visit_occurrence_id", "event_ts", 90, "cells").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(stays) and len(events) / 3 > 4 * STEPS
    for r in found:
        band = sorted((ts, e, c) for e, p, ts, c in events if p == r.person_id and r.cohort_stay_end <= ts <= r.cohort_stay_end + timedelta(days=90))
        for k in range(10):
            want = next(((ts, e) for ts, e, c in band if c >> k & 1), None)
            assert next(((m.ts, m.id) for m in r.match if m.cells >> k & 1), None) == want


def test_the_naive_form_is_a_cell_of_the_same_scan(spark):
    """Rows of another level count for the naive form only, also where their time differs; events and stays were dealt and scanned twice."""
    D, U = C.DETAIL_LEVELS
    t = datetime(1999, 1, 10)
    cohort = spark.createDataFrame([(1, 1, 1000, t, t, t.date().replace(day=1)), (2, 2, 1000, t, t, t.date().replace(day=1)), (3, 3, 1001, t, t, t.date().replace(day=1))],
                                   "visit_cohort_id long, person_id long, care_site_id long, cohort_stay_start timestamp_ntz, cohort_stay_end timestamp_ntz, sub_cohort date")
    event = [(10, 1, 5, U, 20), (10, 1, 50, D, 20), (11, 2, 60, D, 20), (11, 2, 60, U, 20), (12, 2, 10, U, 21), (3, 3, 0, D, 20), (13, 3, 80, D, 21)]
    events = spark.createDataFrame([(v, p, t + timedelta(days=d), lv, s) for v, p, d, lv, s in event],
                                   "visit_occurrence_id long, person_id long, note_datetime timestamp_ntz, detail_care_site_level string, detail_care_site_id long")
    visits = spark.createDataFrame([(10, 0b101), (11, 0b1), (3, 0b111)], "visit_occurrence_id long, cells long")
    grid = Grid(("1995-01-01",), (1.0, 0.5, 0.1), (0.0,))
    kw = {"col_date": "note_datetime", "thresholds": (30, 90), "tolerance_days": 90}
    both = duration_after_event(events, cohort, stability=Stability(visits, grid, D), **kw)
    cso = duration_after_event(level_rows(events, D), cohort, stability=Stability(visits, grid), **kw)
    naive = duration_after_event(events, cohort, **kw)
    assert rows(both.where("param_id < 3")) == rows(cso) and cso.count() > 0
    assert rows(both.where("param_id = 3").drop("param_id")) == rows(naive) and naive.count() > 0
    o = OUTCOMES["consultation_note"]
    estimates = spark.sql(f"select 20L care_site_id, '{D}' care_site_level, 'All' stay_type, 'consultation' note_type, date'1995-01-01' t_0, 0.9D c_0, 0.01D error")
    text = plan(G.statistical_analysis(cohort, events, estimates, o))
    assert text.count("MapInArrow") == 1 and "Window" not in text


def test_plain_words_are_sought_without_a_matcher(spark):
    values = [None, "", "J09", "xj10y", "J1", "j11é", "K", "k", "K", "ſ", "S", "ordo", "ORDOÉ", "oRdO ſ", "DP", "dp", "hospitalisés", "HOSPITALISÉS", "a\nb", "İ", "ı", "J09\U0001F600"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for regex in ("J09|J10|J11", "ORDO", "DP|DR", "hospitalisés", ".*", "k", "s", "i", r"REA\s|USI\s", "a|", ""):
        for case in (False, True):
            want = F.coalesce(F.col("v").rlike(("" if case else "(?iu)") + regex), F.lit(False))
            assert df.where(~contains_regex("v", regex, case).eqNullSafe(want)).count() == 0, (regex, case)
    assert "RLIKE" not in plan(df.where(contains_regex("v", "DP|DR", case=True))) and "RLIKE" not in plan(df.where(contains_regex("v", ".*")))
