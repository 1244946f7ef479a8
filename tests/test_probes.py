"""Probes as series (one row per index, its months in one array), and a warehouse that is built only as far as it is read."""

import os
from datetime import datetime

from pyspark.sql import functions as F

from tempovar import config as C
from tempovar.config import DEFAULT_STUDY
from tempovar.operators import probes as P
from tempovar.operators.cohort import prepare
from tempovar.operators.models import fit_rectangle, fit_step, predict
from tempovar.plans.study import StoredPipeline
from tempovar.sources.surrogate import warehouse
from tempovar.sources.tables import Tables

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_cohort_builds_no_lines_and_lines_are_stored_once(spark, tmp_path):
    root = str(tmp_path / "study")
    done = StoredPipeline(*warehouse(spark, SF, persist=False, root=root), root=root)
    done.outcome("cohort_visit")
    done.outcome("emergency_visit")
    assert not os.path.exists(f"{root}/surrogate")
    done.outcome("icu_visit")
    assert os.listdir(f"{root}/surrogate") == ["lines"]
    for df in (done.core.visit_detail, done.core.condition_occurrence, done.claims.condition_occurrence, done.reference.note_ref):
        assert "Exchange" not in plan(df) and all("/surrogate/lines/" in f for f in df.inputFiles())


def test_lines_without_an_order_keep_their_reference_only(spark, tmp_path):
    from tempovar.sources import surrogate as S
    line = spark.createDataFrame([(1, 7, 3, 2, 1.0, 1.0, 0.0, 0.0, "A", "O", datetime(1996, 1, 1)), (1, 8, 3, 2, 1.0, 1.0, 0.0, 0.0, "A", "O", datetime(1996, 1, 1)),
                                  (9, 7, 3, 2, 1.0, 1.0, 0.0, 0.0, "A", "O", datetime(1996, 1, 1))],
                                 "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_quantity double, l_extendedprice double, l_discount double, "
                                 "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")
    orders = spark.createDataFrame([(1, 5, datetime(1996, 1, 1))], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz")
    ln = S.lines(line, orders)
    assert sorted(r.note_id for r in S.note_ref(ln).collect()) == [1200, 1201, 9200]
    assert sorted(r.visit_detail_id for r in S.visit_detail(ln).collect()) == [1200, 1201]


def test_a_series_is_fitted_and_predicted_as_its_rows(spark):
    p = prepare(*warehouse(spark, SF, persist=False))
    for probe, fit in ((P.visit_probe(p), fit_step), (P.note_per_visit_probe(p), fit_step), (P.visit_probe(p, levels=[C.LEVEL_UNIT]), fit_rectangle)):
        probe = spark.createDataFrame(probe.collect(), probe.schema)
        fitted, by_rows = fit(probe), fit(P.monthly(probe))
        assert "Exchange" not in plan(fitted)
        assert rows(fitted) == rows(by_rows)
        assert rows(predict(probe, fitted)) == rows(predict(P.monthly(probe), fitted))


def test_sites_of_visits_and_details(spark):
    """A visit counts once at a site that is its own and its detail's; a detail does not count at a hospital."""
    H, D, U = C.CARE_SITE_LEVELS
    t = datetime(1995, 1, 5)
    care_site = spark.createDataFrame([(1, H, "h1", None), (2, H, "h2", None), (3, D, "d", "MEDECINE"), (4, U, "u", "REA MED")],
                                      "care_site_id long, care_site_type_source_value string, care_site_short_name string, place_of_service_source_value string")
    visits = spark.createDataFrame([(10, "V10", 1, 1, t, t, "x", "MCO", "ORBIS", "Actif"), (11, "V11", 1, 3, t, t, "x", "MCO", "ORBIS", "Actif")],
                                   "visit_occurrence_id long, visit_occurrence_source_value string, person_id long, care_site_id long, visit_start_datetime timestamp_ntz, "
                                   "visit_end_datetime timestamp_ntz, visit_source_value string, stay_source_value string, cdm_source string, row_status_source_value string")
    details = spark.createDataFrame([(1, t, 10, "RUM", 2, "Actif"), (2, t, 10, "RUM", 3, "Actif"), (3, t, 10, "RUM", 3, "Actif"), (4, t, 11, "RUM", 3, "Actif"),
                                     (5, t, 11, "UH", 4, "Actif"), (6, t, 11, "UH", 4, "Inactif"), (7, t, 11, "UH", 99, "Actif")],
                                    "visit_detail_id long, visit_detail_start_datetime timestamp_ntz, visit_occurrence_id long, visit_detail_type_source_value string, "
                                    "care_site_id long, row_status_source_value string")
    p = prepare(Tables({"care_site": care_site, "visit_occurrence": visits, "visit_detail": details}), Tables({}), Tables({}))
    got = {(r.care_site_id, r.specialties_set): r.n for r in P.monthly(P.visit_probe(p)).groupBy("care_site_id", "specialties_set").agg(F.sum("n_visit").alias("n")).collect()}
    assert got == {(1, "All"): 1, (3, "All"): 2, (4, "All"): 1, (4, "ICU"): 1}
    units = P.monthly(P.visit_probe(p, levels=[U])).where("n_visit > 0").select("care_site_id", "c", "date").distinct().collect()
    assert [(r.care_site_id, r.c, str(r.date)) for r in units] == [(4, 1.0, "1995-01-01")]


def test_a_month_is_looked_up_once_a_map(spark):
    seen = spark.sql("select 1000L care_site_id, map(date'1996-02-01', struct(2L as a, 3L as b, 4L as c)) _own")
    p = prepare(Tables({"care_site": spark.sql("select 1000L care_site_id, 'Hospital' care_site_type_source_value, 'x' care_site_short_name, 'y' place_of_service_source_value")}),
                Tables({}), Tables({}))
    site = P.series(seen, p, ["a", "b", "c"], DEFAULT_STUDY)
    assert site._jdf.queryExecution().analyzed().toString().count("element_at(") == 1
    assert [(str(x.date), x.a, x.b, x.c) for x in site.first()._months if x.a or x.b or x.c] == [("1996-02-01", 2, 3, 4)]


def test_sites_of_a_visit_are_dealt_over_all_partitions_and_counted_once(spark):
    p = prepare(*warehouse(spark, SF, persist=False))
    details = p.valid_details.unionByName(p.valid_details.limit(50))
    p.valid_details = details
    visits = p.visit_occurrence.select("visit_occurrence_id", "care_site_id", "stay_type")
    n = spark.conf.get("spark.sql.shuffle.partitions")
    for df, key in ((P.site_rows(p, visits, C.CARE_SITE_LEVELS), "visit_occurrence_id"), (p.note_care_site, "note_id")):
        got = plan(df)
        assert "REPARTITION_BY_NUM" in got and any(f"hashpartitioning({key}" in line and f", {n})" in line for line in got.split("\n") if "REPARTITION_BY_NUM" in line)
        assert df.count() == df.distinct().count()
    want = details.join(visits, "visit_occurrence_id").where("detail_care_site_id <> care_site_id").select("visit_occurrence_id", "detail_care_site_id").distinct()
    assert P.site_rows(p, visits, C.CARE_SITE_LEVELS).where("_detail").count() == want.count()


def test_codes_of_notes_meet_their_sites_without_a_shuffle(spark, tmp_path):
    """The department codes are stored, so their size is known when the notes' codes are planned: these were dealt by code."""
    plans = {}

    def keep(name, build):
        df = build()
        plans[name] = plan(df)
        df.write.parquet(str(tmp_path / name))
        return spark.read.schema(df.schema).parquet(str(tmp_path / name))

    tables = warehouse(spark, SF, persist=False)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")
    try:
        got = prepare(*tables, keep=keep).note_care_site
        assert "hashpartitioning(care_site_source_value" not in plans["note_care_site"] and "hashpartitioning(note_id" in plans["note_care_site"]
        want = prepare(*tables).note_care_site
        assert "hashpartitioning(care_site_source_value" in plan(want)
        assert rows(got) == rows(want) and got.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_details_of_other_sites_go_before_they_are_dealt_by_visit(spark):
    from tempovar.operators.cohort import cohort_visit, icu_visit
    p = prepare(*warehouse(spark, SF, persist=False))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan(icu_visit(p, cohort_visit(p))).split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    joins = [i for i, x in enumerate(lines) if "SortMergeJoin [detail_care_site_id" in x and "REA" not in x]
    by_visit = next(i for i, x in enumerate(lines) if "SortMergeJoin [visit_occurrence_id" in x)
    assert joins and min(joins) > by_visit


def test_stages_are_written_in_zstd(tmp_path, spark):
    import pyarrow.parquet as pq
    from tempovar.sources.sinks import write_table
    path = write_table(spark.range(1000), str(tmp_path / "t"))
    file = next(f for f in os.listdir(path) if f.endswith(".parquet"))
    assert pq.ParquetFile(f"{path}/{file}").metadata.row_group(0).column(0).compression == "ZSTD"
