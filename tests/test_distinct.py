"""Exact distinct counts by bitmaps (D1, D17) against sets."""

import random

from pyspark.sql import functions as F

from tempovar.operators.distinct import distinct_ids, id_rows


def test_counts_equal_sets(spark):
    rng = random.Random(2)
    ids = [0, 1, -1, 32767, 32768, 32769, -32768, -40000, 2**62, -(2**62)]
    rows = [(rng.choice("ab"), rng.choice([*ids, rng.randrange(100_000), None]), rng.choice([None, rng.randrange(-50, 50)])) for _ in range(3000)]
    rows += [("none", None, None)]
    df = spark.createDataFrame(rows, "k string, x long, y int")
    counted = distinct_ids(id_rows(df, {"n_x": F.col("x"), "n_y": F.col("y"), "n_even": F.when(F.col("x") % 2 == 0, F.col("x"))}, ["k"]), ["k"])
    got = {(r.k, r.name): r.n_distinct for r in counted.collect()}
    want = {}
    for k in "ab":
        x = {r[1] for r in rows if r[0] == k and r[1] is not None}
        want |= {(k, "n_x"): len(x), (k, "n_y"): len({r[2] for r in rows if r[0] == k and r[2] is not None}), (k, "n_even"): sum(1 for v in x if v % 2 == 0)}
    assert got == want
    assert distinct_ids(id_rows(df.where("false"), {"n": F.col("x")})).collect() == []


def test_no_expand_in_the_plan(spark):
    df = spark.range(1000).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"))
    plan = distinct_ids(id_rows(df, {"a": F.col("a"), "b": F.col("b")}))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_reports_count_empty_tables_and_absent_columns(spark):
    from tempovar.plans.reports import cohort_summary, warehouse_counts
    from tempovar.sources.tables import Tables
    visit = spark.createDataFrame([(1, 7, 100, 40), (1, 7, 100, 40), (2, 8, 101, 50)], "visit_cohort_id long, person_id long, care_site_id long, age_at_stay int")
    event = spark.createDataFrame([(1, 5, "Unité Fonctionnelle (UF)")], "visit_occurrence_id long, detail_care_site_id long, detail_care_site_level string")
    names = ["hospit_visit", "emergency_visit", "consultation_note", "prescription_note", "icu_visit", "bronchiolitis_condition", "flu_condition",
             "gastroenteritis_condition", "nasopharyngitis_condition"]
    out = {r.table: r for r in cohort_summary({"cohort_visit": visit, **{n: event.where("false") if n == "icu_visit" else event for n in names}}).collect()}
    assert len(out) == 10
    c, e, none = out["Cohort"], out["QI1_Hospitalization"], out["QI5_ICU"]
    assert (c.n_stays, c.n_patients, c.n_hospitals, c.n_departments, c.n_units) == (2, 2, 2, None, None) and abs(c.age_mean - 130 / 3) < 1e-9
    assert (e.n_stays, e.n_patients, e.n_hospitals, e.n_departments, e.n_units, e.age_mean) == (1, None, None, 1, 0, None)
    assert (none.n_stays, none.n_departments) == (0, 0)
    core = Tables({"person": visit.select("person_id"), "visit_occurrence": visit.select(F.col("visit_cohort_id").alias("visit_occurrence_id"), "person_id").where("false"),
                   "note": spark.createDataFrame([(1,), (1,), (None,)], "note_id long")})
    r = warehouse_counts(core).first()
    assert (r.n_person, r.n_visit, r.n_note, r.n_person_with_visit) == (2, 0, 1, 0)
