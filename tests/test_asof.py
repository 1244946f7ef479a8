"""Forward as-of join (C13) and the D5 exclusion order (T4) against brute force."""

import random
from datetime import datetime, timedelta

from tempovar.operators.asof import asof_join, asof_nearest

T0 = datetime(2020, 1, 1)


def brute(stays, events, tol):
    out = {}
    for sid, pid, end in stays:
        c = [(ts, eid) for eid, p, ts in events if p == pid and end <= ts <= end + timedelta(days=tol)]
        out[sid] = min(c) if c else None
    return out


def run(spark, stays, events, tol=90):
    left = spark.createDataFrame(stays, "visit_cohort_id long, person_id long, cohort_stay_end timestamp_ntz")
    right = spark.createDataFrame(events, "visit_occurrence_id long, person_id long, event_ts timestamp_ntz")
    res = asof_join(left, right, "person_id", "visit_cohort_id", "cohort_stay_end", "visit_occurrence_id",
                    "event_ts", tol)
    return {r.visit_cohort_id: (None if r.visit_occurrence_id is None else (r.event_ts, r.visit_occurrence_id))
            for r in res.collect()}


def test_edges(spark):
    stays = [(1, 1, T0), (2, 2, T0), (3, 3, T0), (4, 4, T0), (5, 5, T0)]
    events = [
        (10, 1, T0),                                        # equal to the stay end: matches
        (20, 2, T0 + timedelta(days=90)),                   # exactly 90 days: matches
        (30, 3, T0 + timedelta(days=90, seconds=1)),        # 90 days + 1 s: no match
        (41, 4, T0 + timedelta(days=3)), (40, 4, T0 + timedelta(days=3)),  # tie: smaller id
        (50, 6, T0 + timedelta(days=1)),                    # another person
    ]
    got = run(spark, stays, events)
    assert got[1] == (T0, 10)
    assert got[2] == (T0 + timedelta(days=90), 20)
    assert got[3] is None
    assert got[4] == (T0 + timedelta(days=3), 40)
    assert got[5] is None


def test_random_against_brute_force(spark):
    rng = random.Random(7)
    stays, events = [], []
    for i in range(300):
        stays.append((i, rng.randrange(20), T0 + timedelta(days=rng.randrange(400), hours=rng.randrange(24))))
    for j in range(1500):
        events.append((10_000 + j, rng.randrange(20), T0 + timedelta(days=rng.randrange(500), hours=rng.randrange(3))))
    assert run(spark, stays, events, 45) == brute(stays, events, 45)


def test_hot_person_against_brute_force(spark):
    # one person holds a third of all stays and events, packed into a few months
    rng = random.Random(11)
    stays, events = [], []
    for i in range(600):
        hot = i % 3 == 0
        pid = 0 if hot else 1 + rng.randrange(50)
        span = 120 if hot else 700
        stays.append((i, pid, T0 + timedelta(days=rng.randrange(span), minutes=rng.randrange(1440))))
    for j in range(3000):
        hot = j % 3 == 0
        pid = 0 if hot else 1 + rng.randrange(50)
        span = 150 if hot else 800
        events.append((100_000 + j, pid, T0 + timedelta(days=rng.randrange(span), minutes=rng.randrange(1440))))
    assert run(spark, stays, events, 90) == brute(stays, events, 90)


def brute_cells(stays, events, tol, size):
    """Per stay and cell, the nearest event of the band that is stable in the cell."""
    out = {}
    for sid, pid, end in stays:
        band = sorted((ts, eid, cells) for eid, p, ts, cells in events if p == pid and end <= ts <= end + timedelta(days=tol))
        for k in range(size):
            hit = next(((ts, eid) for ts, eid, cells in band if cells >> k & 1), None)
            if hit:
                out[sid, k] = hit
    return out


def found_cells(spark, stays, events, tol, size):
    left = spark.createDataFrame(stays, "visit_cohort_id long, person_id long, cohort_stay_end timestamp_ntz")
    right = spark.createDataFrame(events, "visit_occurrence_id long, person_id long, event_ts timestamp_ntz, cells long")
    rows = asof_nearest(left, right, "person_id", "cohort_stay_end", "visit_occurrence_id", "event_ts", tol, "cells").collect()
    assert len(rows) == len(stays)
    out = {}
    for r in rows:
        assert [m.ts for m in r.match] == sorted(m.ts for m in r.match) and len(r.match) <= size
        for m in r.match:
            for k in range(size):
                if m.cells >> k & 1:
                    assert (r.visit_cohort_id, k) not in out  # the entries' cells are disjoint
                    out[r.visit_cohort_id, k] = (m.ts, m.id)
    return out


def rank_answers(rng, shape=(3, 4, 4)):
    """The cells that random ranks pass: an up-set in each dimension; at times none."""
    a, b, c = (rng.randrange(n + 1) for n in shape)
    return sum(1 << (s * 16 + e * 4 + f) for s in range(a, 3) for e in range(b) for f in range(c))


def test_frontier_against_brute_force(spark):
    rng = random.Random(13)
    stays = [(i, rng.randrange(15), T0 + timedelta(days=rng.randrange(300), hours=rng.randrange(24))) for i in range(200)]
    events = [(10_000 + j, rng.randrange(15), T0 + timedelta(days=rng.randrange(400), hours=rng.randrange(3)), cells)
              for j in range(1500) if (cells := rank_answers(rng))]
    assert found_cells(spark, stays, events, 45, 48) == brute_cells(stays, events, 45, 48)


def test_frontier_of_a_hot_person(spark):
    # one person holds a third of all rows, most of them within one band, many at the same instant
    rng = random.Random(17)
    stays = [(i, 0 if i % 3 == 0 else 1 + rng.randrange(40), T0 + timedelta(days=rng.randrange(60))) for i in range(300)]
    events = [(100_000 + j, 0 if j % 3 == 0 else 1 + rng.randrange(40), T0 + timedelta(days=rng.randrange(90)), cells)
              for j in range(4000) if (cells := rank_answers(rng))]
    assert found_cells(spark, stays, events, 90, 48) == brute_cells(stays, events, 90, 48)


def test_frontier_with_any_answers_and_without_events(spark):
    rng = random.Random(19)
    stays = [(i, rng.randrange(5), T0 + timedelta(days=rng.randrange(30))) for i in range(60)]
    events = [(1000 + j, rng.randrange(5), T0 + timedelta(days=rng.randrange(60)), rng.randrange(1, 1 << 12)) for j in range(300)]
    assert found_cells(spark, stays, events, 20, 12) == brute_cells(stays, events, 20, 12)
    assert found_cells(spark, stays, [(1, 99, T0, 1)], 20, 12) == {}
