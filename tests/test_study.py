"""The study runner: every stage is written, and what is read back equals the lazy result."""

import os

from tempovar.plans.reports import write_reports
from tempovar.config import OUTCOMES
from tempovar.plans.study import MODELS, PROBES, Pipeline, StoredPipeline, all_indicators, run_study
from tempovar.sources.surrogate import warehouse
from tempovar.sources.tables import Tables, check_columns, load_catalog, load_parquet

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_stored_stages_equal_the_lazy_ones_and_feed_the_reports(spark, tmp_path):
    lazy = Pipeline(*warehouse(spark, SF))
    seconds, chosen = {}, ["hospit_visit", "flu_condition"]
    done = run_study(spark, lazy, str(tmp_path / "study"), on_stage=seconds.__setitem__, materialize_inputs=True, outcomes=chosen)
    assert set(seconds) == set(done.held)
    for name, df in lazy.outcomes.items():
        assert rows(done.outcomes[name]) == rows(df), name
    for name in PROBES:
        assert done.probe(name).columns == lazy.probe(name).columns
    for name in ("visit", "icu_rectangle", "condition"):
        assert rows(done.estimates(name)) == rows(lazy.estimates(name)), name
    assert {f"models/{name}" for name in MODELS} <= set(done.held)
    every = all_indicators(spark, str(tmp_path / "study"))
    for name in chosen:
        want = lazy.indicator(name)
        assert set(done.indicator(name).columns) == set(want.columns)
        assert rows(done.indicator(name)) == rows(want), name
        assert rows(every.where(every.outcome_name == name).select(*want.columns)) == rows(want), name
    assert {r.outcome_name for r in every.select("outcome_name").distinct().collect()} == set(chosen)
    assert rows(done.count_summary("flu_condition")) == rows(lazy.count_summary("flu_condition"))

    out = str(tmp_path / "reports")
    written = write_reports(done, out, outcomes=chosen)
    assert {"warehouse_counts", "model_summary", "figure_flu_condition", "sensitivity_hospit_visit"} <= set(written)
    csv = [f for f in os.listdir(os.path.join(out, "model_summary")) if f.endswith(".csv")]
    with open(os.path.join(out, "model_summary", csv[0])) as fh:
        assert fh.readline().strip().split(",")[:3] == ["functionality", "n_models", "error_mean"]
    assert any(f.endswith(".json") for f in os.listdir(os.path.join(out, "warehouse_counts")))
    lazy.release()


def subtree(plan: str, node: str) -> list[str]:
    """The lines of a plan below the first line that holds ``node``."""
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if node in x)
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-"))
    below = []
    for x in lines[at + 1:]:
        if len(x) - len(x.lstrip(" :+-")) <= depth:
            break
        below.append(x)
    return below


def test_a_reloaded_bucketed_study_joins_without_an_exchange(spark, tmp_path):
    """Cohort and events are stored by stay, so joining them again shuffles neither."""
    from tempovar.operators.indicators import condition_incidence, event_during_stay
    from tempovar.operators.stability import filter_estimates, visit_cells, visit_extremes
    from tempovar.plans import grid as G

    done = StoredPipeline(*warehouse(spark, SF, persist=False), root=str(tmp_path / "study"), buckets=4)

    def unbucketed(df, path):
        return spark.read.schema(df.schema).parquet(f"{done.root}/{path}")

    for name, fn in (("prescription_note", event_during_stay), ("flu_condition", condition_incidence)):
        o = OUTCOMES[name]
        est = filter_estimates(done.estimates(o.estimates), o.care_site_level, **G.outcome_filters(o))
        grid = G.outcome_grid(done.thresholds(name), o, est, done.study)
        events, cohort = done.events(name), done.analysis_cohort.cohort_all
        results = []
        for ev, co in ((events, cohort), (unbucketed(events, f"cohort/{name}"), unbucketed(cohort, "analysis/cohort_all"))):
            stability = visit_cells(visit_extremes(ev, est, o.care_site_level), grid)
            results.append(fn(ev, co, stability=stability))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 200_000)  # as at scale: events are not broadcast, estimates of sites are
        try:
            plans = [df._jdf.queryExecution().executedPlan().toString() for df in results]
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        below = [subtree(p, "Join [visit_cohort_id") for p in plans]
        assert not any("Exchange hashpartitioning(visit" in x for x in below[0]), plans[0]
        assert any("Bucketed: true" in x for x in below[0]) and any("Exchange hashpartitioning(visit" in x for x in below[1])
        assert rows(results[0]) == rows(results[1])


def test_loaders(spark, tmp_path):
    import pytest
    frame = spark.createDataFrame([(1, "x", "y", "z")], "care_site_id long, care_site_type_source_value string, care_site_short_name string, place_of_service_source_value string")
    frame.write.parquet(str(tmp_path / "care_site.parquet"))
    tables = load_parquet(spark, str(tmp_path), ["care_site"])
    assert isinstance(tables, Tables) and tables.care_site.count() == 1
    with pytest.raises(ValueError):
        check_columns("care_site", frame.drop("care_site_id"))
    frame.createOrReplaceTempView("care_site")
    spark.sql(f"create database if not exists omop_test location '{tmp_path}/omop_test'")
    frame.write.mode("overwrite").option("path", str(tmp_path / "table")).saveAsTable("omop_test.care_site")
    assert load_catalog(spark, "omop_test", ["care_site"]).care_site.count() == 1
    spark.sql("drop table omop_test.care_site")


def test_a_query_stores_only_the_parts_of_the_cohort_it_reads(spark, tmp_path):
    """Stays and their diagnosis groups were written for every count summary and indicator."""
    core, reference, claims = warehouse(spark, SF)
    done = StoredPipeline(core, reference, claims, root=str(tmp_path / "study"))
    assert rows(done.count_summary("bronchiolitis_condition")) == rows(Pipeline(core, reference, claims).count_summary("bronchiolitis_condition"))
    assert "analysis/hospital_count" in done.held and not {"cohort/cohort_visit", "analysis/cohort_all", "analysis/cohort_mcd"} & set(done.held)
    done.indicator("hospit_visit")
    assert "analysis/cohort_all" in done.held and "analysis/cohort_mcd" not in done.held
    assert done.analysis_cohort.cohort_mcd.count() >= 0 and "analysis/cohort_mcd" in done.held
