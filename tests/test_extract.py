"""Traps T1-T3, B8, H2/H3, H5/H6 on hand-made frames."""

from datetime import datetime

from pyspark.sql import functions as F

from tempovar.functions.dates import years_between_birthdays
from tempovar.functions.text import code_after_colon, contains_regex, prefix
from tempovar.operators import extract as X


def test_clean_date_keeps_null_drops_out_of_range(spark):
    rows = [(1, None), (2, "1600-01-01 00:00:00"), (3, "1700-01-01 00:00:00"), (4, "2262-04-11 00:00:00"),
            (5, "2300-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "id int, d string").withColumn("d", F.col("d").cast("timestamp_ntz"))
    kept = sorted(r.id for r in X.clean_date(df, "d").collect())
    assert kept == [1, 3, 4]


def test_regex_contains_unicode_case_and_lookahead(spark):
    vals = ["HOSPITALISÉS", "hospitalisés complets", None, "CR-CONS", "CR-CONS-ANESTH", "cr-cons x", "REA", "REA MED"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = lambda rx: [r.v for r in X.filter_event(df, "v", rx).collect()]
    assert got("hospitalisés") == ["HOSPITALISÉS", "hospitalisés complets"]
    assert got("CR-CONS(?!-)") == ["CR-CONS", "cr-cons x"]
    assert got(r"REA\s|USI\s|SC\s") == ["REA MED"]
    # case-sensitive variant
    diag = spark.createDataFrame([("DP",), ("dp",), ("DAS",), ("DR",)], "v string")
    assert [r.v for r in diag.where(contains_regex("v", "DP|DR", case=True)).collect()] == ["DP", "DR"]


def test_first_event_takes_whole_earliest_row_nulls_last(spark):
    rows = [(1, 10, "2020-01-02", "b"), (1, 11, "2020-01-01", None), (1, 9, None, "z"),
            (2, 20, None, "a"), (3, 31, "2020-05-01", "x"), (3, 30, "2020-05-01", "y")]
    df = (spark.createDataFrame(rows, "visit_occurrence_id int, note_id int, d string, t string")
          .withColumn("d", F.col("d").cast("timestamp_ntz")))
    out = {r.visit_occurrence_id: (r.note_id, r.t) for r in X.first_event(df, "d", tie_break=["note_id"]).collect()}
    assert out == {1: (11, None), 2: (20, "a"), 3: (30, "y")}  # whole row, not first non-null per column


def test_filter_valid_invalid_keeps_null(spark):
    df = spark.createDataFrame([("Actif",), ("supprimé",), (None,)], "row_status_source_value string")
    assert X.filter_valid(df, invalid="supprimé").count() == 2
    assert X.filter_valid(df, valid="Actif").count() == 1


def test_code_parse(spark):
    df = spark.createDataFrame([("GHM:05M02",), ("NOCOLON",), (None,)], "c string")
    out = [(r.g, r.p) for r in df.select(code_after_colon("c").alias("g"), prefix(code_after_colon("c"), 2).alias("p")).collect()]
    assert out == [("05M02", "05"), (None, None), (None, None)]


def test_ages(spark):
    rows = [(datetime(2000, 2, 29), datetime(2021, 2, 28)), (datetime(2000, 2, 29), datetime(2021, 3, 1)),
            (datetime(1990, 6, 15), datetime(2020, 6, 15)), (None, datetime(2020, 1, 1))]
    df = spark.createDataFrame(rows, "b timestamp_ntz, a timestamp_ntz")
    ages = [r.age for r in df.select(years_between_birthdays("a", "b").alias("age")).collect()]
    assert ages == [20, 21, 30, None]


def test_first_event_drops_rows_without_a_key(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 3), (7, 3, 9)], "visit_occurrence_id long, note_id long, d int")
    assert [(r.visit_occurrence_id, r.note_id) for r in X.first_event(df, "d", tie_break=["note_id"]).collect()] == [(7, 3)]


def test_filters_reach_the_scan(spark, tmp_path):
    from tempovar.sources.surrogate import warehouse
    from tempovar.sources.tables import Tables
    core, _, _ = warehouse(spark, "/root/testdata/sf0.001", persist=False)
    core["visit_occurrence"].write.parquet(str(tmp_path / "v"))
    stored = Tables({"visit_occurrence": spark.read.parquet(str(tmp_path / "v"))})
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = X.prepare_visit_occurrence(stored)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    for column in ("row_status_source_value", "visit_start_datetime", "visit_end_datetime", "cdm_source"):
        assert column in pushed.split("ReadSchema")[0], pushed


def test_unknown_condition_source_is_an_error(spark):
    import pytest
    with pytest.raises(ValueError):
        X.prepare_condition_occurrence(None, None, None, "elsewhere")


def test_counts_keep_a_null_level_and_leave_out_sites(spark):
    from tempovar.operators.probes import care_site_counts
    sites = spark.createDataFrame([(1, "Hopital"), (2, None), (3, "Hopital"), (None, "Hopital")], "care_site_id long, care_site_type_source_value string")
    assert {(r.care_site_level, r.total_care_site) for r in care_site_counts(sites, [3]).collect()} == {("Hopital", 1), (None, 1)}
