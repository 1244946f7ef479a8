"""Closed-form zero-filled trend against an explicit fill + numpy least squares."""

from datetime import date

import numpy as np
import pytest

from pyspark.sql import functions as F

from tempovar.functions.stats import t_quantile, t_two_sided_p
from tempovar.operators.trend import as_text, linear_trend, significance


def months(start, n):
    y, m = start.year, start.month
    out = []
    for _ in range(n):
        out.append(date(y, m, 1))
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)
    return out


def reference_fit(values_by_month, start, last):
    grid = months(start, (last.year - start.year) * 12 + last.month - start.month + 1)
    y = np.array([values_by_month.get(d, 0.0) for d in grid])
    x = np.arange(len(y), dtype=float)
    if len(y) < 2 or np.ptp(x) == 0:
        return len(y), None, None, y.mean()
    b, a = np.polyfit(x, y, 1)
    return len(y), a, b, y.mean()


def frame(spark, rows):
    return spark.createDataFrame(rows, "care_site_id string, start_observation_date string, sub_cohort date, rate double")


def test_closed_form_equals_filled_regression(spark):
    rng = np.random.default_rng(1)
    rows, data = [], {}
    last = date(2021, 6, 1)
    for site, start in [("a", date(2020, 1, 1)), ("b", date(2019, 7, 1)), ("c", date(2021, 1, 1))]:
        for d in months(start, 18):
            if d <= last and rng.random() < 0.7:  # missing months in the middle
                v = float(rng.random())
                rows.append((site, start.isoformat(), d, v))
                data.setdefault(site, (start, {}))[1][d] = v
    got = {r.care_site_id: r for r in linear_trend(frame(spark, rows), index=["care_site_id", "start_observation_date"]).collect()}
    for site, (start, vals) in data.items():
        n, a, b, mean = reference_fit(vals, start, last)
        r = got[site]
        assert r.n == n
        assert abs(r.alpha_0 - a) < 1e-9 and abs(r.alpha_1 - b) < 1e-9 and abs(r.mean_value - mean) < 1e-12


def test_degenerate_partitions(spark):
    rows = [("two", "2021-05-01", date(2021, 5, 1), 0.2), ("two", "2021-05-01", date(2021, 6, 1), 0.4),
            ("flat", "2021-01-01", date(2021, 1, 1), 0.5), ("flat", "2021-01-01", date(2021, 3, 1), 0.5),
            ("flat", "2021-01-01", date(2021, 6, 1), 0.5)]
    out = {r.care_site_id: r for r in significance(linear_trend(frame(spark, rows),
                                                                index=["care_site_id", "start_observation_date"])).collect()}
    two = out["two"]
    assert two.n == 2 and abs(two.alpha_1 - 0.2) < 1e-12
    assert two.se_alpha_1 is None and two.p_value is None  # T15: fewer than 3 points
    flat = out["flat"]  # zero-filled months make it non-constant; x spans the whole window
    assert flat.n == 6 and abs(flat.mean_value - 0.25) < 1e-12 and flat.p_value is not None


def test_student_t(spark):
    rows = [(0.0, 5, 1.0), (2.228138852, 10, 0.05), (12.7062047, 1, 0.05), (-4.302652730, 2, 0.05), (3.182446305, 3, 0.05)]
    df = spark.createDataFrame(rows, "t double, dof int, p double")
    for r in df.select("p", t_two_sided_p(F.col("t"), F.col("dof")).alias("got")).collect():
        assert r.got == pytest.approx(r.p, abs=1e-7)
    dof = spark.createDataFrame([(1, 12.7062047), (2, 4.302652730), (10, 2.228138852), (1000, 1.962339)], "dof int, q double")
    for r in dof.select("q", t_quantile(0.975, F.col("dof")).alias("got")).collect():
        assert r.got == pytest.approx(r.q, abs=1e-5)
    none = spark.range(1).select(t_two_sided_p(F.lit(1.0), F.lit(0)).alias("p"), t_quantile(0.975, F.lit(0)).alias("q")).first()
    assert none.p is None and none.q is None


def test_exact_and_empty_fits(spark):
    """An exact slope has p = 0, a series of zeros has no p; NULL stays NULL in the text."""
    rows = [("exact", "2020-01-01", d, 0.25 * i) for i, d in enumerate(months(date(2020, 1, 1), 8))]
    rows += [("zero", "2020-01-01", d, 0.0) for d in months(date(2020, 1, 1), 8)]
    out = {r.care_site_id: r for r in as_text(significance(linear_trend(frame(spark, rows), index=["care_site_id", "start_observation_date"]))).collect()}
    assert out["exact"].p_value == 0.0 and out["exact"].p_value_text == "< 10e-3" and out["exact"].alpha_1 == pytest.approx(0.25)
    assert out["zero"].p_value is None and out["zero"].p_value_text is None and out["zero"].alpha_1 == 0.0
