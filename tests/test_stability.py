"""Complete-source filter (I9, I10, D4, D11, D12) with the traps of the stability fixture."""

from datetime import date

from pyspark.sql import functions as F

from tempovar.config import LEVEL_HOSPITAL
from tempovar.operators.stability import Grid, estimate_parameters, filter_stable_visits, parameter_grid, unfolded, visit_cells, visit_extremes

D0 = date(2019, 1, 1)


def estimates(spark):
    rows = [(LEVEL_HOSPITAL, 1, "x", D0, 0.9, 0.01),   # A stable
            (LEVEL_HOSPITAL, 2, "x", date(2021, 1, 1), 0.9, 0.01),  # B unstable (late)
            (LEVEL_HOSPITAL, 4, "x", D0, None, 0.01),  # D NULL c_0
            (LEVEL_HOSPITAL, 5, "x", D0, 0.9, 0.01),   # E row 1 stable
            (LEVEL_HOSPITAL, 5, "x", D0, 0.9, 0.5),    # E row 2 above max_error
            (LEVEL_HOSPITAL, 1, "y", D0, 0.9, 0.9)]    # other label set, filtered out
    return spark.createDataFrame(rows, "care_site_level string, care_site_id long, stay_type string, t_0 date, "
                                       "c_0 double, error double")


def events(spark):
    rows = [(1, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 1)]
    return spark.createDataFrame(rows, "visit_occurrence_id long, care_site_id long")


def test_visit_stability_traps(spark):
    count, ev = filter_stable_visits(events(spark), estimates(spark), "2020-01-01", LEVEL_HOSPITAL,
                                     max_error=0.1, stay_type="x")
    assert sorted(r.visit_occurrence_id for r in ev.collect()) == [5]
    assert count.collect()[0].stable_cs_count == 2  # A, and E through its stable row


def test_fold_equals_direct_form_on_every_cell(spark):
    est = estimates(spark).where(F.col("stay_type") == "x")
    thr = estimate_parameters(estimates(spark), LEVEL_HOSPITAL, stay_type="x")
    stability = visit_cells(visit_extremes(events(spark), est, LEVEL_HOSPITAL), Grid.of(thr, ["2018-01-01", "2020-01-01"]))
    folded = {(k, r.visit_occurrence_id) for r in stability.visits.collect() for k in range(stability.grid.size) if r.cells >> k & 1}
    direct = set()
    for p in parameter_grid(thr, ["2018-01-01", "2020-01-01"]).collect():
        _, ev = filter_stable_visits(events(spark), estimates(spark), p.start_observation_date, LEVEL_HOSPITAL,
                                     p.max_error, p.min_c_0, stay_type="x")
        direct |= {(p.param_id, r.visit_occurrence_id) for r in ev.collect()}
    assert folded == direct


def test_counts_unfold_into_cells(spark):
    rows = [("a", 0b101, 2, 1), ("a", 0b101, 3, 1), ("a", 0b010, 5, 1), ("a", None, 7, 1), ("b", 0b111, 1, 4), (None, 0, 9, 1)]
    df = spark.createDataFrame(rows, "k string, cells long, n long, every long")
    got = {(r.k, r.param_id): (r.n, r.every) for r in unfolded(df, ["k"], ["n"], 3, ["every"]).collect()}
    assert got == {("a", 0): (5, 4), ("a", 1): (5, 4), ("a", 2): (5, 4), ("b", 0): (1, 4), ("b", 1): (1, 4), ("b", 2): (1, 4),
                   (None, 0): (0, 1), (None, 1): (0, 1), (None, 2): (0, 1)}


def test_a_grid_of_too_many_cells_is_refused():
    import pytest
    with pytest.raises(ValueError, match="63 cells"):
        Grid(tuple(f"200{i}-01-01" for i in range(4)), (1.0, 0.3, 0.2, 0.1), (0.0, 0.1, 0.2, 0.3))


def test_equal_quantiles_give_distinct_labelled_cells(spark):
    rows = [(LEVEL_HOSPITAL, i, D0, 0.5, 0.2) for i in range(5)]
    est = spark.createDataFrame(rows, "care_site_level string, care_site_id long, t_0 date, c_0 double, error double")
    grid = parameter_grid(estimate_parameters(est, LEVEL_HOSPITAL), ["2020-01-01", "2021-01-01", "2022-01-01"])
    cells = grid.collect()
    assert len(cells) == 48 and len({c.param_id for c in cells}) == 48
    assert {c.max_error for c in cells} == {1.0, 0.2}
    assert {c.max_error_label for c in cells} == {"No filter", "Q3", "median", "Q1"}


def test_nearest_rank_quantiles(spark):
    rows = [(LEVEL_HOSPITAL, i, D0, float(i), float(i) / 10) for i in range(1, 5)]  # 4 values
    est = spark.createDataFrame(rows, "care_site_level string, care_site_id long, t_0 date, c_0 double, error double")
    r = estimate_parameters(est, LEVEL_HOSPITAL).collect()[0]
    # positions round(3 * q): q=.75 -> 2, .5 -> 2 (1.5 rounds half away from zero), .25 -> 1
    assert r.max_errors == [1.0, 0.3, 0.3, 0.2]
    assert r.min_c_0s == [0.0, 2.0, 3.0, 3.0]
    assert r.active_cs_count == 4
