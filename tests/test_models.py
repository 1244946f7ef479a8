"""Step and rectangle fits (I5, I6) against brute-force least squares."""

import random
from datetime import date

from tempovar.operators.models import fit_rectangle, fit_step, predict


def months(n):
    return [date(2000 + (i // 12), i % 12 + 1, 1) for i in range(n)]


def brute_step(c):
    T = len(c)
    best = None
    for k in range(T):
        c0 = sum(c[k:]) / (T - k)
        err = (sum(x * x for x in c[:k]) + sum((x - c0) ** 2 for x in c[k:])) / T
        if best is None or round(err, 12) < round(best[0], 12):
            best = (err, k, c0)
    return best


def brute_rect(c):
    T = len(c)
    best = None
    for a in range(T):
        for b in range(a, T):
            c0 = sum(c[a:b + 1]) / (b - a + 1)
            err = sum((x - (c0 if a <= i <= b else 0.0)) ** 2 for i, x in enumerate(c)) / T
            if best is None or round(err, 12) < round(best[0], 12):
                best = (err, a, b, c0)
    return best


def frame(spark, series):
    rows = [(sid, d, float(x)) for sid, c in series.items() for d, x in zip(months(len(c)), c)]
    return spark.createDataFrame(rows, "care_site_id long, date date, c double")


def test_step_matches_brute_force(spark):
    rng = random.Random(3)
    series = {}
    for sid in range(25):
        k = rng.randrange(30)
        series[sid] = [0.0 if i < k else rng.uniform(0.5, 1.0) for i in range(30)]
    est = {r.care_site_id: r for r in fit_step(frame(spark, series), ["care_site_id"]).collect()}
    for sid, c in series.items():
        err, k, c0 = brute_step(c)
        assert est[sid].t_0 == months(30)[k]
        assert abs(est[sid].c_0 - c0) < 1e-9 and abs(est[sid].error - err) < 1e-9


def test_rectangle_matches_brute_force_and_beats_step(spark):
    rng = random.Random(5)
    series = {sid: [rng.random() for _ in range(30)] for sid in range(50)}
    df = frame(spark, series)
    rect = {r.care_site_id: r for r in fit_rectangle(df, ["care_site_id"]).collect()}
    step = {r.care_site_id: r for r in fit_step(df, ["care_site_id"]).collect()}
    for sid, c in series.items():
        err, a, b, c0 = brute_rect(c)
        r = rect[sid]
        assert (r.t_0, r.t_1) == (months(30)[a], months(30)[b])
        assert abs(r.error - err) < 1e-9
        assert r.error <= step[sid].error + 1e-12


def test_rectangle_ties_blocks_and_odd_levels(spark):
    rng = random.Random(9)
    series = {0: [0.0] * 12, 1: [1.0] * 12, 2: [0.0, 1.0, 0.0, 1.0, 0.0, 0.0], 3: [0.5, 0.0, 0.5, 0.0, 0.5], 4: [0.7], 5: [0.0] * 5 + [1.0] * 20 + [0.0] * 15,
              6: [-0.5, 0.2, -0.1, 0.9], 7: [0.0, 0.0, 0.3], 8: [0.3, 0.0, 0.0]}
    for sid in range(10, 60):  # levels on a coarse grid, so that many rectangles tie
        series[sid] = [rng.choice([0.0, 0.0, 0.5, 1.0]) for _ in range(rng.randint(1, 24))]
    rect = {r.care_site_id: r for r in fit_rectangle(frame(spark, series), ["care_site_id"]).collect()}
    for sid, c in series.items():
        err, a, b, c0 = brute_rect(c)
        r = rect[sid]
        assert (r.t_0, r.t_1) == (months(40)[a], months(40)[b]), sid
        assert abs(r.error - err) < 1e-9 and abs(r.c_0 - c0) < 1e-9


def test_predict(spark):
    df = frame(spark, {1: [0.0, 0.0, 1.0, 1.0]})
    est = fit_step(df, ["care_site_id"])
    got = [r.c_hat for r in predict(df, est, ["care_site_id"]).orderBy("date").collect()]
    assert got == [0.0, 0.0, 1.0, 1.0]
