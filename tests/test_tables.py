"""A warehouse in monthly folders (A1): the study window prunes them, the study stays the same."""

import pytest
from pyspark.sql import functions as F

from tempovar.config import DEFAULT_STUDY
from tempovar.plans.study import Pipeline
from tempovar.sources.sinks import write_by_month, write_table
from tempovar.sources.surrogate import warehouse
from tempovar.sources.tables import MONTHLY, load_parquet, restrict_months

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("warehouse"))
    sets = warehouse(spark, SF, persist=False)
    for kind, tables in zip(("core", "reference", "claims"), sets, strict=True):
        for name, df in tables.items():
            path = f"{root}/{kind}/{name}.parquet"
            if kind == "core" and name in MONTHLY:
                early = df.limit(3).withColumn(MONTHLY[name], F.lit("1980-05-05").cast("timestamp_ntz"))
                undated = df.limit(2).withColumn(MONTHLY[name], F.lit(None).cast("timestamp_ntz"))
                write_by_month(df.unionByName(early).unionByName(undated), path, MONTHLY[name])
            else:
                write_table(df, path)
    return root, sets


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def filters(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:]]


def test_the_window_becomes_partition_filters(spark, folders):
    root, (core, _, _) = folders
    loaded = load_parquet(spark, f"{root}/core", core, window=DEFAULT_STUDY.window)
    for name, date in MONTHLY.items():
        t = loaded[name]
        assert t.columns == core[name].columns and "month" not in t.columns
        assert any("month" in f for f in filters(t)), name
        first, end = DEFAULT_STUDY.window
        assert t.where(F.col(date) < first).count() == 0
        assert t.where(F.col(date).isNull()).count() >= 2  # rows without a date stay
    assert load_parquet(spark, f"{root}/core", core).visit_occurrence.where("visit_start_datetime < '1981-01-01'").count() == 3  # without a window all is read
    narrow = load_parquet(spark, f"{root}/core", core, window=("1999-03-01", "1999-05-01")).visit_occurrence.where("visit_start_datetime is not null")
    months = {r[0] for r in narrow.select(F.date_format("visit_start_datetime", "yyyy-MM")).distinct().collect()}
    assert months == {"1999-03", "1999-04"}


def test_the_study_on_pruned_folders_is_the_study(spark, folders):
    root, (core, reference, claims) = folders
    pruned = Pipeline(load_parquet(spark, f"{root}/core", core, window=DEFAULT_STUDY.window), load_parquet(spark, f"{root}/reference", reference),
                      load_parquet(spark, f"{root}/claims", claims, claims=True))
    plain = Pipeline(core, reference, claims)
    assert rows(pruned.outcome("cohort_visit")) == rows(plain.outcome("cohort_visit"))
    assert rows(pruned.probe("visit")) == rows(plain.probe("visit"))
    assert any("month" in f for f in filters(pruned.probe("visit")))


def test_months_of_another_table_prune_at_run_time(spark, folders):
    root, _ = folders
    notes = spark.read.parquet(f"{root}/core/note.parquet")
    wanted = spark.createDataFrame([("1998-02-01", 1), ("1998-03-01", 1), ("1999-01-01", 0)], "month string, use int").where("use = 1")
    got = restrict_months(notes, "note_datetime", wanted)
    assert {str(r.month) for r in got.select("month").distinct().collect()} == {"1998-02-01", "1998-03-01"}
    assert any("dynamicpruning" in f for f in filters(got))
    plain = restrict_months(notes.drop("month"), "note_datetime", wanted)
    assert rows(plain) == rows(got.drop("month"))
