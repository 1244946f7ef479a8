"""

``entry(spark)`` runs the flagship query (30/90-day rehospitalisation rates,
naive and complete-source-only over the 48-cell parameter grid) on sf0.001.
``queries()`` registers one callable per implemented operator group of
SURVEY section 2; ``oracle_sql()`` gives the independent DuckDB statement of
each. Every query reads the whole test tables through the surrogate OMOP views.
Doubles are rounded to 9 places on both sides before comparison.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable
from functools import reduce

_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from tempovar import config as C  # noqa: E402
from tempovar.plans.study import StoredPipeline  # noqa: E402
from tempovar.session import ensure_checkpoint_dir  # noqa: E402
from tempovar.sources.surrogate import warehouse  # noqa: E402

try:  # the training-data operators are optional: where they cannot be imported, the other queries stand
    import corpus_pipeline
    from tempovar.llm import queries as llm_queries
except ImportError:
    corpus_pipeline = llm_queries = None

HAS_LLM = llm_queries is not None

SMOKE_DIR = "/root/testdata/sf0.001"

PROBES = {"visit_probe": "visit", "icu_probe": "icu", "note_probe": "note", "note_per_visit_probe": "note_per_visit",
          "condition_probe": "condition_per_visit", "condition_per_condition_probe": "condition"}
MODELS = {"visit_step_model": "visit", "icu_rectangle_model": "icu_rectangle", "note_step_model": "note",
          "note_per_visit_step_model": "note_per_visit", "condition_step_model": "condition"}


_PIPELINES: dict[tuple[str, str], StoredPipeline] = {}


def _pipeline(spark: SparkSession, sf_dir: str) -> StoredPipeline:
    """One pipeline per Spark application and data folder. Its stages are computed from the given tables, each
    written once to the shared folder where a query first needs it and scanned by the others; nothing is persisted.
    Of the surrogate warehouse only the tables that a query reads are built, and stored where they cost a shuffle."""
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    if key not in _PIPELINES:
        root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/study-{uuid.uuid4().hex}"
        _PIPELINES[key] = StoredPipeline(*warehouse(spark, sf_dir, persist=False, root=root), root=root)
    return _PIPELINES[key]


def _canon(df: DataFrame) -> DataFrame:
    """Round doubles to 9 places (the oracle does the same)."""
    cols = [F.round(F.col(f.name), 9).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


def _plain_zero(df: DataFrame) -> DataFrame:
    """A negative zero as zero, as the oracle of the same query has it (rounding leaves one where a tiny value was)."""
    return df.select(*[(F.col(f.name) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


def _outcome_query(name: str):
    return lambda spark, sf_dir: _canon(_pipeline(spark, sf_dir).outcome(name))


def _probe_query(name: str):
    return lambda spark, sf_dir: _canon(_pipeline(spark, sf_dir).probe(name))


def _model_query(name: str):
    return lambda spark, sf_dir: _canon(_pipeline(spark, sf_dir).estimates(name))


def _indicator_query(name: str):
    return lambda spark, sf_dir: _canon(_pipeline(spark, sf_dir).indicator(name))


def _summary_query(name: str):
    return lambda spark, sf_dir: _canon(_pipeline(spark, sf_dir).count_summary(name))


#: Steps of the trend that are not part of the registered results.
TREND_STEPS = ("se_alpha_0", "se_alpha_1", "t_alpha_1")
TRENDS = ["hospit_visit", "emergency_visit", "prescription_note", "icu_visit_rectangle"]


def _trend_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tempovar.operators.trend import linear_trend
        t = linear_trend(_pipeline(spark, sf_dir).indicator(name), y="rate")
        return _canon(t.drop(*TREND_STEPS))
    return run


def _significance_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tempovar.operators.trend import as_text, linear_trend, significance
        return _canon(as_text(significance(linear_trend(_pipeline(spark, sf_dir).indicator(name), y="rate"))).drop(*TREND_STEPS))
    return run


EXCLUDED_SITES = [1003, 2000001, 3000002]


def _excluded_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B12 with sites to leave out: the study's list is empty on the test data."""
    from tempovar.operators.probes import care_site_counts
    return care_site_counts(_pipeline(spark, sf_dir).core.care_site, EXCLUDED_SITES)


EXAMPLE_HOSPITALS = [1000, 1003]
EXAMPLE_DEPARTMENTS = [2000001, 2000002]
EXAMPLE_UNITS = [3000005, 3000006]
SENSITIVITY_OUTCOMES = [*C.QUALITY_OUTCOMES, *C.ICU_OUTCOMES]
EXAMPLE_FILTERS = {"care_site_level": C.LEVEL_HOSPITAL, "stay_type": "hospitalisés", "specialties_set": "All"}


#: Outcomes whose rows are read back from the one indicator dataset: one of each kind and the incidences written in one job.
LONG_TABLE_OUTCOMES = ["hospit_visit", "prescription_note", *C.CONDITION_REGEXES]


def _long_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 written and read back: the long table over several outcomes, by its partitions."""
    from tempovar.plans.study import all_indicators
    pl = _pipeline(spark, sf_dir)
    for name in LONG_TABLE_OUTCOMES:
        pl.indicator(name)
    return _canon(all_indicators(spark, pl.root).where(F.col("outcome_name").isin(LONG_TABLE_OUTCOMES)))


def _csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 written and read back: a figure dataset as CSV with a header."""
    from tempovar.plans.reports import figure_dataset
    from tempovar.sources.sinks import write_csv
    pl = _pipeline(spark, sf_dir)
    df = figure_dataset(pl.indicator("prescription_note"))
    return _canon(spark.read.schema(df.schema).option("header", True).csv(write_csv(df, f"{pl.root}/reports/figure_prescription_note")))


def _json_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 written and read back: the warehouse count record as JSON."""
    from tempovar.plans.reports import warehouse_counts
    from tempovar.sources.sinks import write_json
    pl = _pipeline(spark, sf_dir)
    df = warehouse_counts(pl.core)
    return spark.read.schema(df.schema).json(write_json(df, f"{pl.root}/reports/warehouse_counts"))


def _report_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tempovar.operators import extract as X
    from tempovar.operators.trend import as_text, linear_trend, long_form, significance
    from tempovar.plans import reports as R

    def est_all(pl: StoredPipeline) -> dict:
        return {n: pl.estimates(n) for n in ["visit", "note", "note_per_visit", "condition", "icu_rectangle"]}

    def preds(pl: StoredPipeline) -> dict:
        return {n: pl.series(n) for n in ["visit", "note", "note_per_visit", "condition_per_visit"]}

    def counts(pl: StoredPipeline, names: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [pl.count_summary(n) for n in names])

    def panels(pl: StoredPipeline, names: list[str], rates: bool = True) -> DataFrame:
        return R.figure_panels({n: pl.indicator(n) for n in names}, counts(pl, names), rates)

    def wrap(fn):
        return lambda spark, sf_dir: _canon(fn(_pipeline(spark, sf_dir)))

    return {
        "indicator_long_table": _long_table,
        "figure_csv_prescription_note": _csv_round_trip,
        "warehouse_record_json": _json_record,
        "warehouse_counts": wrap(lambda pl: R.warehouse_counts(pl.core)),
        "care_site_counts": wrap(lambda pl: pl.care_site_counts()),
        "model_summary": wrap(lambda pl: R.model_summary(est_all(pl))),
        "cohort_summary": wrap(lambda pl: R.cohort_summary(pl.outcomes)),
        "ehr_context": wrap(lambda pl: R.ehr_context(pl.probe("visit"), pl.probe("note"), pl.probe("condition"),
                                                     pl.study.probe_start)),
        "analysis_summary_hospit_visit": wrap(lambda pl: R.analysis_summary(
            pl.indicator("hospit_visit"), pl.count_summary("hospit_visit"), "hospit_visit")),
        "site_sensitivity_hospit_visit": wrap(lambda pl: R.site_sensitivity(pl.indicator("hospit_visit"))),
        "site_sensitivity_prescription_note": wrap(lambda pl: R.site_sensitivity(pl.indicator("prescription_note"))),
        "goodness_of_fit": wrap(lambda pl: R.goodness_of_fit(preds(pl), est_all(pl))),
        "fit_by_lag": wrap(lambda pl: R.fit_by_lag(R.goodness_of_fit(preds(pl), est_all(pl)))),
        "volume_per_site_hospit_visit": wrap(lambda pl: R.volume_per_site(pl.indicator("hospit_visit"))),
        "volume_per_site_flu_condition": wrap(lambda pl: R.volume_per_site(pl.indicator("flu_condition"), None)),
        "figure_dataset_consultation_note": wrap(lambda pl: R.figure_dataset(pl.indicator("consultation_note"))),
        "left_edge_aligned_flu_condition": wrap(lambda pl: R.left_edge_aligned(pl.indicator("flu_condition"))),
        "ghm": wrap(lambda pl: pl.prepared.ghm),
        "note_care_site": wrap(lambda pl: pl.prepared.note_care_site),
        "arem_condition": wrap(lambda pl: X.prepare_condition_occurrence(
            pl.core, pl.claims, pl.prepared.visit_occurrence, C.SOURCE_CLAIMS)),
        "fitted_examples_hospital": wrap(lambda pl: R.fitted_examples(
            pl.series("visit"), pl.estimates("visit"), EXAMPLE_HOSPITALS, EXAMPLE_FILTERS)),
        "fitted_trend_line_hospit_visit": wrap(lambda pl: R.fitted_trend_line(pl.indicator("hospit_visit"))),
        "seasonal_peak_trend_flu_condition": wrap(lambda pl: R.fitted_trend_line(
            pl.indicator("flu_condition"), None, "max_events")),
        "analysis_summary": wrap(lambda pl: R.analysis_summary_all(
            {n: pl.indicator(n) for n in C.SUMMARY_OUTCOMES}, counts(pl, C.SUMMARY_OUTCOMES))),
        "quality_figure": wrap(lambda pl: panels(pl, C.QUALITY_OUTCOMES)),
        "quality_figure_icu": wrap(lambda pl: panels(pl, C.ICU_OUTCOMES)),
        "epidemiology_figure": wrap(lambda pl: panels(pl, C.EPIDEMIOLOGY_OUTCOMES, False)),
        "site_sensitivity_rows": lambda spark, sf_dir: _plain_zero(wrap(lambda pl: R.site_sensitivity_rows({n: pl.indicator(n) for n in SENSITIVITY_OUTCOMES}))(spark, sf_dir)),
        "example_panels": wrap(lambda pl: R.example_panels(preds(pl), est_all(pl), EXAMPLE_HOSPITALS, EXAMPLE_DEPARTMENTS)),
        "rectangle_panels": wrap(lambda pl: R.rectangle_panels(pl.series("visit"), pl.series("icu"), est_all(pl), EXAMPLE_UNITS,
                                                               pl.study.end_date)),
        "trend_long_form_hospit_visit": wrap(lambda pl: long_form(as_text(significance(
            linear_trend(pl.indicator("hospit_visit")))))),
    }


def _report_oracles() -> dict[str, str]:
    from oracle import reports as OR
    from oracle import sql as OS
    return {
        "indicator_long_table": OR.long_table(LONG_TABLE_OUTCOMES),
        "figure_csv_prescription_note": OR.figure_dataset("prescription_note"),
        "warehouse_record_json": OR.warehouse_counts(),
        "warehouse_counts": OR.warehouse_counts(),
        "care_site_counts": OS.with_ctes(dict(OS.VIEWS), """select care_site_type_source_value care_site_level,
       count(distinct care_site_id) total_care_site from care_site group by 1"""),
        "model_summary": OR.model_summary(),
        "cohort_summary": OR.cohort_summary(),
        "ehr_context": OR.ehr_context(C.DEFAULT_STUDY.probe_start),
        "analysis_summary_hospit_visit": OR.analysis_summary("hospit_visit"),
        "site_sensitivity_hospit_visit": OR.site_sensitivity("hospit_visit"),
        "site_sensitivity_prescription_note": OR.site_sensitivity("prescription_note"),
        "goodness_of_fit": OR.goodness_of_fit(False),
        "fit_by_lag": OR.goodness_of_fit(True),
        "volume_per_site_hospit_visit": OR.volume_per_site("hospit_visit"),
        "volume_per_site_flu_condition": OR.volume_per_site("flu_condition"),
        "figure_dataset_consultation_note": OR.figure_dataset("consultation_note"),
        "left_edge_aligned_flu_condition": OR.left_edge_aligned("flu_condition"),
        "analysis_summary": OR.analysis_summary_all(),
        "quality_figure": OR.figure_panels(C.QUALITY_OUTCOMES),
        "quality_figure_icu": OR.figure_panels(C.ICU_OUTCOMES),
        "epidemiology_figure": OR.figure_panels(C.EPIDEMIOLOGY_OUTCOMES, rates=False),
        "site_sensitivity_rows": OR.site_sensitivity_rows(SENSITIVITY_OUTCOMES),
        "example_panels": OR.example_panels(EXAMPLE_HOSPITALS, EXAMPLE_DEPARTMENTS),
        "rectangle_panels": OR.rectangle_panels(EXAMPLE_UNITS, C.DEFAULT_STUDY.end_date),
        "ghm": OS.with_ctes(OS.base_ctes(), "select * from ghm"),
        "note_care_site": OS.with_ctes(OS.base_ctes(), "select * from ncs"),
        "arem_condition": OR.arem_condition(),
        "fitted_examples_hospital": OR.fitted_examples(EXAMPLE_HOSPITALS, EXAMPLE_FILTERS),
        "fitted_trend_line_hospit_visit": OR.fitted_trend_line("hospit_visit", "rate"),
        "seasonal_peak_trend_flu_condition": OR.fitted_trend_line("flu_condition", "max_events"),
    }


def _analysis_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canon(_pipeline(spark, sf_dir).analysis_cohort.cohort_all)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: rehospitalisation indicator over the grid, on sf0.001."""
    return _pipeline(spark, SMOKE_DIR).indicator("hospit_visit")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in C.OUTCOME_TABLES:
        q[name] = _outcome_query(name)
    for qname, probe in PROBES.items():
        q[qname] = _probe_query(probe)
    for qname, model in MODELS.items():
        q[qname] = _model_query(model)
    q["analysis_cohort"] = _analysis_cohort
    for name in C.OUTCOMES:
        q[f"indicator_{name}"] = _indicator_query(name)
        q[f"cs_count_summary_{name}"] = _summary_query(name)
    for name in TRENDS:
        q[f"trend_{name}"] = _trend_query(name)
    q["trend_significance_hospit_visit"] = _significance_query("hospit_visit")
    q["indicator_hospit_visit_by_group"] = lambda spark, sf_dir: _canon(_pipeline(spark, sf_dir).indicator_by_group("hospit_visit"))
    q["care_site_counts_without_excluded"] = _excluded_query
    q.update(_report_queries())
    if HAS_LLM:
        q.update(llm_queries.queries())
        q["pipeline"] = corpus_pipeline.run
    return q


def oracle_sql() -> dict[str, str]:
    from oracle import grid as OG
    from oracle import sql as OS

    def canon(sql: str, doubles: list[str]) -> str:
        if not doubles:
            return sql
        rep = ", ".join(f"round({c}, 9) as {c}" for c in doubles)
        return f"select * replace ({rep}) from ({sql})"

    out: dict[str, str] = {}
    base = OS.base_ctes()
    for name in C.OUTCOME_TABLES:
        out[name] = OS.with_ctes(base, f"select * from {'cohort' if name == 'cohort_visit' else name}")
    probe_sql = {"visit": OS.visit_probe(), "icu": OS.visit_probe(levels=[C.LEVEL_UNIT], sets=C.ICU_SPECIALTIES_SETS),
                 "note": OS.note_probe(), "note_per_visit": OS.note_per_visit_probe(),
                 "condition_per_visit": OS.condition_probe(), "condition": OS.condition_per_condition_probe()}
    for qname, probe in PROBES.items():
        out[qname] = OS.with_ctes(base, canon(probe_sql[probe], ["c"]))
    for qname, model in MODELS.items():
        out[qname] = OS.with_ctes(base, canon(OS.estimates(model), ["c_0", "error"]))
    ac = OG.analysis_cohort_ctes()
    out["analysis_cohort"] = OS.with_ctes(ac, "select * exclude (CMD, CMD_code), '00 ALL' MCD from cohort_all")
    for name in C.OUTCOMES:
        out[f"indicator_{name}"] = OG.indicator(name)
        out[f"cs_count_summary_{name}"] = OG.cs_count_summary(name)
    for name in TRENDS:
        out[f"trend_{name}"] = OG.trend(name)
    out["trend_significance_hospit_visit"] = OG.trend_significance("hospit_visit")
    out["trend_long_form_hospit_visit"] = OG.trend_significance("hospit_visit", long_form=True)
    out["indicator_hospit_visit_by_group"] = OG.indicator_by_group("hospit_visit")
    out["care_site_counts_without_excluded"] = OS.with_ctes(dict(OS.VIEWS), f"""select care_site_type_source_value care_site_level,
       count(distinct care_site_id) total_care_site from care_site
where care_site_id not in ({', '.join(map(str, EXCLUDED_SITES))}) group by 1""")
    out.update(_report_oracles())
    if HAS_LLM:
        out.update(llm_queries.oracle_sql())
        if corpus_pipeline.ORACLE_SQL:
            out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
