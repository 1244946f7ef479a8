"""Report and figure datasets (D1, D16-D25, I14-I16, I18). Charts themselves are not built.

Every dataset is an aggregate over the stage tables; only these small results
are meant to leave the cluster (as CSV, A7).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.dates import month_diff
from ..functions.text import relabel, starting_date_label
from ..operators.distinct import distinct_ids, id_rows
from ..operators.models import predict
from ..operators.stability import outcome_filters
from ..operators.trend import as_text, linear_trend, significance
from ..sources.tables import Tables

# The panels of example sites: data type, outcome, probe, kind of site.
EXAMPLE_PANELS = [
    ("Hospitalizations", "hospit_visit", "visit", "Hospital"),
    ("Emergency stays", "emergency_visit", "visit", "Hospital"),
    ("Consultation reports", "consultation_note", "note", "Department"),
    ("Prescription reports", "prescription_note", "note_per_visit", "Department"),
    ("Diagnostic codes", "bronchiolitis_condition", "condition_per_visit", "Department"),
]

# The functionalities of the model summary and their estimate filters.
FUNCTIONALITIES = {
    "Hospitalization": ("visit", {"care_site_level": C.LEVEL_HOSPITAL, "stay_type": "hospitalisés"}),
    "Emergency": ("visit", {"care_site_level": C.LEVEL_HOSPITAL, "stay_type": "urgence"}),
    "Consultation": ("note", {"care_site_level": C.LEVEL_DEPARTMENT, "stay_type": "All", "note_type": "consultation"}),
    "Prescription": ("note_per_visit", {"care_site_level": C.LEVEL_DEPARTMENT, "stay_type": "hospit",
                                        "note_type": "prescription"}),
    "Diagnosis": ("condition", {"care_site_level": C.LEVEL_DEPARTMENT, "source_system": "ORBIS",
                                "diag_type": "DP_DR", "condition_type": "All"}),
    "ICU": ("visit", {"care_site_level": C.LEVEL_UNIT, "specialties_set": "ICU"}),
    "ICU_rectangle": ("icu_rectangle", {"care_site_level": C.LEVEL_UNIT, "specialties_set": "ICU"}),
}


def _eq_all(df: DataFrame, filters: Mapping[str, str]) -> DataFrame:
    for k, v in filters.items():
        df = df.where(F.col(k) == v)
    return df


def warehouse_counts(core: Tables, approx: bool = False) -> DataFrame:
    """Persons, visits, notes, persons with a visit (exact, or HyperLogLog when ``approx``)."""
    ids = {"n_person": (core.person, "person_id"), "n_visit": (core.visit_occurrence, "visit_occurrence_id"),
           "n_note": (core.note, "note_id"), "n_person_with_visit": (core.visit_occurrence, "person_id")}
    if approx:
        parts = [df.agg(F.approx_count_distinct(c).alias("n")).select(F.lit(name).alias("name"), "n") for name, (df, c) in ids.items()]
        counts = reduce(DataFrame.unionByName, parts)
    else:
        visits = id_rows(core.visit_occurrence, {n: F.col(c) for n, (df, c) in ids.items() if df is core.visit_occurrence})
        others = [id_rows(df, {n: F.col(c)}) for n, (df, c) in ids.items() if df is not core.visit_occurrence]
        counts = distinct_ids(reduce(DataFrame.unionByName, others, visits)).withColumnRenamed("n_distinct", "n")
    return counts.agg(*[F.coalesce(F.max(F.when(F.col("name") == n, F.col("n"))), F.lit(0)).cast("long").alias(n) for n in ids])


def _epoch_days(c: str) -> Column:
    return F.unix_date(F.col(c).cast("date"))


def model_summary(estimates: Mapping[str, DataFrame]) -> DataFrame:
    """Mean and sample std of ``error, c_0, t_0, t_1`` per functionality and for all (Total).

    Dates are averaged as day numbers (mean date truncated to the day, std in whole days).
    """
    parts = []
    for label, (name, filters) in FUNCTIONALITIES.items():
        e = _eq_all(estimates[name], filters)
        t1 = F.col("t_1") if "t_1" in e.columns else F.lit(None).cast("date")
        parts.append(e.select(F.lit(label).alias("functionality"), "error", "c_0", "t_0", t1.alias("t_1")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    stats = [F.count("*").alias("n_models"),
             F.avg("error").alias("error_mean"), F.stddev_samp("error").alias("error_std"),
             F.avg("c_0").alias("c_0_mean"), F.stddev_samp("c_0").alias("c_0_std"),
             F.date_from_unix_date(F.floor(F.avg(_epoch_days("t_0"))).cast("int")).alias("t_0_mean"),
             F.floor(F.stddev_samp(_epoch_days("t_0"))).cast("long").alias("t_0_std_days"),
             F.date_from_unix_date(F.floor(F.avg(_epoch_days("t_1"))).cast("int")).alias("t_1_mean"),
             F.floor(F.stddev_samp(_epoch_days("t_1"))).cast("long").alias("t_1_std_days")]
    per = rows.groupBy("functionality").agg(*stats)
    total = rows.agg(*stats).withColumn("functionality", F.lit("Total"))
    return per.unionByName(total)


def cohort_summary(outcomes: Mapping[str, DataFrame]) -> DataFrame:
    """Distinct stays, patients, hospitals, departments, units and age per table; absent columns give NULL."""
    # The tables' names in the summary.
    labels = {"cohort_visit": "Cohort", "hospit_visit": "QI1_Hospitalization", "emergency_visit": "QI2_Emergency",
              "consultation_note": "QI3_Consultation", "prescription_note": "QI4_Prescription",
              "icu_visit": "QI5_ICU", "bronchiolitis_condition": "EI1_Bronchiolitis", "flu_condition": "EI2_Flu",
              "gastroenteritis_condition": "EI3_Gastroenteritis", "nasopharyngitis_condition": "EI4_Nasopharyngitis"}
    ids, ages, has = [], [], {}
    for name, label in labels.items():
        t = outcomes[name].withColumn("table", F.lit(label))
        cols = set(t.columns)
        counted = {"n_stays": F.col("visit_occurrence_id" if "visit_occurrence_id" in cols else "visit_cohort_id")}
        counted |= {n: F.col(c) for n, c in (("n_patients", "person_id"), ("n_hospitals", "care_site_id")) if c in cols}
        if "detail_care_site_id" in cols:
            counted |= {n: F.when(F.col("detail_care_site_level") == level, F.col("detail_care_site_id"))
                        for n, level in (("n_departments", C.LEVEL_DEPARTMENT), ("n_units", C.LEVEL_UNIT))}
        ids.append(id_rows(t, counted, ["table"]))
        if "age_at_stay" in cols:
            ages.append(t.select("table", F.col("age_at_stay").cast("double").alias("age")))
        has[label] = set(counted)
    every = ["n_stays", "n_patients", "n_hospitals", "n_departments", "n_units"]
    counts = distinct_ids(reduce(DataFrame.unionByName, ids), ["table"]).groupBy("table").agg(
        *[F.max(F.when(F.col("name") == n, F.col("n_distinct"))).alias(n) for n in every])
    age = reduce(DataFrame.unionByName, ages).groupBy("table").agg(F.avg("age").alias("age_mean"), F.stddev_samp("age").alias("age_std"))
    named = counts.sparkSession.createDataFrame([(label, [n for n in every if n in own]) for label, own in has.items()], "table string, own array<string>")
    # a table without rows counts 0, a table without the column NULL
    shown = [F.when(F.array_contains("own", n), F.coalesce(n, F.lit(0))).cast("long").alias(n) for n in every]
    return F.broadcast(named).join(counts, "table", "left").join(age, "table", "left").select("table", *shown, "age_mean", "age_std")


def ehr_context(visit_probe: DataFrame, note_probe: DataFrame, condition_probe: DataFrame, start_date: str) -> DataFrame:
    """D18 + E3: monthly volume of six functionalities, divided by each one's largest month."""
    since = F.col("date") >= F.lit(start_date).cast("date")
    H = C.LEVEL_HOSPITAL
    specs = [
        ("5. Diagnoses", condition_probe, "n_condition",
         {"source_system": "ORBIS", "care_site_level": H, "stay_type": "hospit", "condition_type": "All",
          "diag_type": "DP_DR"}),
        ("3. Consultation reports", note_probe, "n_note",
         {"note_type": "consultation", "care_site_level": H, "stay_type": "All"}),
        ("4. Prescription reports", note_probe, "n_note",
         {"note_type": "prescription", "care_site_level": H, "stay_type": "All"}),
        ("2. Emergency department records", visit_probe, "n_visit",
         {"stay_type": "urgence", "care_site_level": H, "specialties_set": "All"}),
        ("1. Hospitalization records", visit_probe, "n_visit",
         {"stay_type": "hospitalisés", "care_site_level": H, "specialties_set": "All"}),
        ("6. Intensive care unit records", visit_probe, "n_visit", {"specialties_set": "ICU"}),
    ]
    parts = []
    for label, probe, n, filters in specs:
        monthly = (_eq_all(probe, filters).where(since).groupBy("date")
                   .agg(F.sum(n).cast("long").alias("n_event")).withColumn("event_type", F.lit(label)))
        parts.append(monthly)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    m = F.max("n_event").over(Window.partitionBy("event_type"))
    return out.withColumn("max_event", m).withColumn("c", F.col("n_event") / F.col("max_event"))


def one_cell(indicator: DataFrame, max_error_label: str = "No filter", min_c_0_label: str = "No filter",
             threshold: str | None = "before_30_days") -> DataFrame:
    """Select one parameter cell (by rank label, robust to equal quantiles) and one threshold."""
    out = indicator.where((F.col("max_error_label") == max_error_label) & (F.col("min_c_0_label") == min_c_0_label))
    if threshold and "threshold" in indicator.columns:
        out = out.where(F.col("threshold") == threshold)
    return out


def cs_share(cs_count_summary: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``cso (x.x %)`` for the complete-source-only analysis, ``naive (100 %)`` for the naive one."""
    base = cs_count_summary.select("param_id", "start_observation_date", "max_error_label", "min_c_0_label",
                                   "outcome_name", "naive_cs_count", "cso_cs_count", *keep)
    cso = base.select("*", F.lit(C.CSO).alias("analysis"),
                      F.concat(F.col("cso_cs_count").cast("string"), F.lit(" ("),
                               F.format_number(F.col("cso_cs_count") / F.col("naive_cs_count") * 100, 1),
                               F.lit(" %)")).alias("cs_considered"))
    naive = base.select("*", F.lit(C.NAIVE).alias("analysis"),
                        F.concat(F.col("naive_cs_count").cast("string"), F.lit(" (100 %)")).alias("cs_considered"))
    return naive.unionByName(cso).drop("naive_cs_count", "cso_cs_count")


def analysis_summary(indicator: DataFrame, cs_count_summary: DataFrame, outcome_name: str,
                     threshold: str = "before_30_days") -> DataFrame:
    """Trend at "All" in the no-filter cell and one threshold, per (start date, analysis), with site shares."""
    cell = one_cell(indicator, threshold=threshold).where(F.col("care_site_id") == "All")
    tr = linear_trend(cell, y="rate").select("start_observation_date", "analysis", "param_id", "alpha_0", "alpha_1")
    share = cs_share(cs_count_summary.where(F.col("outcome_name") == outcome_name))
    return (tr.join(share, ["param_id", "start_observation_date", "analysis"])
            .select("outcome_name", "start_observation_date", "analysis", "cs_considered", "alpha_0", "alpha_1"))


def analysis_summary_all(indicators: Mapping[str, DataFrame], cs_count_summary: DataFrame,
                         threshold: str = "before_30_days") -> DataFrame:
    """D20 over the outcomes: estimates with their intervals as text at "All" in the no-filter cell, beside
    the site shares; an outcome without a rate has the shares only."""
    parts = []
    for name, indicator in indicators.items():
        if "rate" in indicator.columns:
            # only the reported cell is fitted, over the months up to the last one of the whole table
            cell = one_cell(indicator, threshold=threshold).where(F.col("care_site_id") == "All")
            rows = as_text(significance(linear_trend(cell, y="rate", last=indicator.agg(F.max("sub_cohort")).scalar())))
            texts = [F.col("alpha_0_text").alias("alpha_0"), F.col("alpha_1_text").alias("alpha_1")]
        else:
            rows = one_cell(indicator).select("start_observation_date", "analysis", "param_id").distinct()
            texts = [F.lit(None).cast("string").alias(c) for c in ("alpha_0", "alpha_1")]
        share = cs_share(cs_count_summary.where(F.col("outcome_name") == name))
        parts.append(rows.select("start_observation_date", "analysis", "param_id", *texts)
                     .join(share, ["param_id", "start_observation_date", "analysis"]))
    return reduce(DataFrame.unionByName, parts).select("outcome_name", "start_observation_date", "analysis", "cs_considered", "alpha_0", "alpha_1")


def figure_panels(indicators: Mapping[str, DataFrame], cs_count_summary: DataFrame, rates: bool = True) -> DataFrame:
    """I16 / C25 over the outcomes: the "All" rows with the stable sites of their cell, rank labels in place of
    thresholds; rates leave the event counts out."""
    share = cs_share(cs_count_summary.withColumn("care_site_level", F.concat(relabel("care_site_level", C.LEVEL_LABELS), F.lit("s"))),
                     keep=["care_site_level"]).where(F.col("analysis") == C.CSO).drop("analysis")
    parts = []
    for name, indicator in indicators.items():
        rows = figure_dataset(indicator).drop("max_error", "min_c_0", *(["n_events"] if rates else []))
        of = share.where(F.col("outcome_name") == name).select("param_id", "cs_considered", "care_site_level")
        parts.append(rows.join(of, "param_id").withColumn("outcome_name", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def site_sensitivity_rows(indicators: Mapping[str, DataFrame], threshold: str | None = "before_30_days") -> DataFrame:
    """Every site's fit beside that of "All" in the same cell, all outcomes, by their report name."""
    parts = []
    for name, indicator in indicators.items():
        chosen = indicator.where(F.col("threshold") == threshold) if threshold and "threshold" in indicator.columns else indicator
        fit = significance(linear_trend(chosen, y="rate"))
        keys = [c for c in ("threshold", "param_id", "start_observation_date", "max_error_label", "min_c_0_label", "analysis") if c in fit.columns]
        values = ["p_value", "alpha_0", "alpha_1", "mean_value"]
        # a cell's rows are its sites: "All" is read beside them, not joined back
        beside = [F.max(F.when(F.col("care_site_id") == "All", F.col(v))).over(Window.partitionBy(*keys)).alias(f"{v}_all") for v in values]
        sites = fit.select("care_site_id", *keys, *values, *beside).where(F.col("care_site_id") != "All")
        parts.append(sites.withColumn("outcome_name", F.lit(C.EVENT_NAMES[name])))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def site_sensitivity(indicator: DataFrame, threshold: str | None = "before_30_days") -> DataFrame:
    """I18 + C24 + D21: trend per site beside the "All" trend, and the spread of the sites' values.

    One row per (cell, analysis): min, quartiles (interpolated) and max over the
    sites of the slope and of the mean value, with the "All" values.
    """
    ind = indicator.where(F.col("threshold") == threshold) if threshold and "threshold" in indicator.columns else indicator
    tr = linear_trend(ind, y="rate")
    keys = [c for c in ["threshold", "param_id", "start_observation_date", "max_error_label", "min_c_0_label",
                        "analysis"] if c in tr.columns]
    at_all = F.col("care_site_id") == "All"
    aggs = []
    for v in ("alpha_1", "mean_value"):
        site = F.when(~at_all, F.col(v))
        aggs += [F.min(site).alias(f"{v}_min"), F.percentile(site, 0.25).alias(f"{v}_q1"),
                 F.percentile(site, 0.5).alias(f"{v}_median"), F.percentile(site, 0.75).alias(f"{v}_q3"),
                 F.max(site).alias(f"{v}_max"), F.max(F.when(at_all, F.col(v))).alias(f"{v}_all")]
    return tr.groupBy(*keys).agg(F.count_if(~at_all).alias("n_sites"), *aggs).where("n_sites > 0")


def goodness_of_fit(predictors: Mapping[str, DataFrame], estimates: Mapping[str, DataFrame]) -> DataFrame:
    """I15 + C23 + H11 + H12: completeness normalised by ``c_0`` against months since ``t_0``."""
    probe_of = {"visit": "visit", "note": "note", "note_per_visit": "note_per_visit", "condition": "condition_per_visit"}
    parts = []
    for label, (name, filters) in FUNCTIONALITIES.items():
        if name not in probe_of:
            continue
        pred = _eq_all(predictors[probe_of[name]], filters)
        fitted = predict(pred, _eq_all(estimates[name], filters))
        parts.append(fitted.select(F.lit(label).alias("EHR_functionality"), "care_site_level", "care_site_id",
                                   "care_site_short_name", "date", "c", "c_0", "t_0", "error"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    lag = month_diff("date", "t_0")
    out = out.withColumn("normalized_date", lag)
    out = out.withColumn("normalized_c", F.when((F.col("normalized_date") < 0) | (F.col("c_0") == 0), F.col("c"))
                         .otherwise(F.col("c") / F.col("c_0")))
    out = out.withColumn("care_site_level", relabel("care_site_level", C.PANEL_LABELS))
    return out.withColumn("model", F.when(F.col("normalized_date") >= 0, 1).otherwise(0))


def fit_by_lag(gof: DataFrame) -> DataFrame:
    """Mean and standard deviation of the normalised completeness per functionality and lag."""
    return (gof.groupBy("EHR_functionality", "normalized_date")
            .agg(F.count("*").alias("n"), F.avg("normalized_c").alias("normalized_c_mean"),
                 F.stddev_samp("normalized_c").alias("normalized_c_std"), F.max("model").alias("model")))


def fitted_trend_line(indicator: DataFrame, threshold: str | None = "before_30_days", y: str = "rate") -> DataFrame:
    """Regression of the "All" value (rate, or seasonal peak ``max_events``) on the date (day number)
    per cell and analysis, predicted at each row; rows without a value are left out, as a chart drops them."""
    cell = indicator.where((F.col("care_site_id") == "All") & F.col(y).isNotNull())
    if threshold and "threshold" in cell.columns:
        cell = cell.where(F.col("threshold") == threshold)
    keys = ["param_id", "analysis"]
    x = _epoch_days("sub_cohort").cast("double")
    coef = cell.groupBy(*keys).agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"))
    return (cell.join(coef, keys).withColumn(f"{y}_fitted", F.col("_a") + F.col("_b") * x).drop("_a", "_b"))


def volume_per_site(indicator: DataFrame, threshold: str | None = "before_30_days") -> DataFrame:
    """Total stays and events per site (naive, no-filter cell), largest first."""
    cell = one_cell(indicator, threshold=threshold).where(
        (F.col("analysis") == C.NAIVE) & (F.col("care_site_id") != "All"))
    first_start = cell.agg(F.min("start_observation_date")).scalar()
    cell = cell.where(F.col("start_observation_date") == first_start)
    total = "n_total" if "n_total" in cell.columns else "n_events"
    out = cell.groupBy("care_site_id").agg(F.sum(total).cast("long").alias("n_total"),
                                           F.sum("n_events").cast("long").alias("n_events"))
    return out.orderBy(F.col("n_total").desc(), "care_site_id")


def left_edge_aligned(incidence: DataFrame) -> DataFrame:
    """Per start date, weeks up to the latest of the per-partition first weeks move to 1 January."""
    keys = ["start_observation_date", "max_error_label", "min_c_0_label", "analysis"]
    firsts = incidence.groupBy(*keys).agg(F.min("sub_cohort").alias("_first"))
    edge = firsts.groupBy("start_observation_date").agg(F.max("_first").alias("_edge"))
    years = incidence.groupBy("start_observation_date").agg(F.min(F.year("sub_cohort")).alias("_y"))
    out = incidence.join(edge, "start_observation_date").join(years, "start_observation_date")
    return (out.withColumn("sub_cohort", F.when(F.col("sub_cohort") <= F.col("_edge"),
                                                F.make_date(F.col("_y"), F.lit(1), F.lit(1)))
                           .otherwise(F.col("sub_cohort")))
            .drop("_edge", "_y"))


def figure_dataset(indicator: DataFrame) -> DataFrame:
    """I16: the "All" site only, with the starting-date label."""
    out = indicator.where(F.col("care_site_id") == "All").drop("care_site_id")
    if "MCD" in out.columns:
        out = out.where(F.col("MCD") == "00 ALL").drop("MCD")
    return out.withColumn("start_label", starting_date_label(F.col("start_observation_date").cast("date")))


def fitted_examples(predictor: DataFrame, estimates: DataFrame, site_ids: Sequence[int],
                    filters: Mapping[str, str], kind: str = "Hospital") -> DataFrame:
    """I14 + B21 + I8: fitted model of example sites, relabelled "Hospital 1", "Hospital 2"... by id order."""
    ids = sorted(site_ids)
    pred = _eq_all(predictor, filters).where(F.col("care_site_id").isin(ids))
    fitted = predict(pred, _eq_all(estimates, filters).where(F.col("care_site_id").isin(ids)))
    names = relabel(F.col("care_site_id").cast("string"), {str(i): f"{kind} {n}" for n, i in enumerate(ids, 1)})
    return fitted.withColumn("care_site_short_name", names).select("date", "care_site_short_name", "c", "c_hat")


def example_panels(probes: Mapping[str, DataFrame], estimates: Mapping[str, DataFrame], hospitals: Sequence[int],
                   departments: Sequence[int]) -> DataFrame:
    """The five panels of example sites, by ``data_type``."""
    parts = []
    for data_type, outcome, probe, kind in EXAMPLE_PANELS:
        o = C.OUTCOMES[outcome]
        sites = hospitals if kind == "Hospital" else departments
        parts.append(fitted_examples(probes[probe], estimates[o.estimates], sites, _filters(o), kind).withColumn("data_type", F.lit(data_type)))
    return reduce(DataFrame.unionByName, parts)


def rectangle_panels(visit_probe: DataFrame, icu_probe: DataFrame, estimates: Mapping[str, DataFrame], units: Sequence[int],
                     end_date: str) -> DataFrame:
    """Step fit (0) beside rectangle fit (1, up to ``end_date``) of example units."""
    step, rectangle = C.OUTCOMES["icu_visit"], C.OUTCOMES["icu_visit_rectangle"]
    a = fitted_examples(visit_probe, estimates[step.estimates], units, _filters(step), "Unit").withColumn("data_type", F.lit(0))
    b = fitted_examples(icu_probe, estimates[rectangle.estimates], units, _filters(rectangle), "Unit").withColumn("data_type", F.lit(1))
    return a.unionByName(b.where(F.col("date") <= F.lit(end_date).cast("date")))


def _filters(outcome: C.Outcome) -> dict[str, str]:
    return {"care_site_level": outcome.care_site_level, **{k: v for k, v in outcome_filters(outcome).items() if v}}


def write_reports(pipeline, out_dir: str, mode: str = "overwrite", outcomes: Sequence[str] = tuple(C.OUTCOMES)) -> dict[str, str]:
    """Figure and summary datasets as CSV with a header, the warehouse record as JSON.

    Meant for the pipeline that ``run_study`` gives back: every dataset reads its stored stages.
    """
    from ..sources.sinks import write_csv, write_json

    est = {n: pipeline.estimates(n) for n in ["visit", "note", "note_per_visit", "condition", "icu_rectangle"]}
    preds = {n: pipeline.series(n) for n in ["visit", "note", "note_per_visit", "condition_per_visit"]}
    out = {"warehouse_counts": write_json(warehouse_counts(pipeline.core), f"{out_dir}/warehouse_counts", mode)}
    datasets = {
        "model_summary": model_summary(est),
        "cohort_summary": cohort_summary(pipeline.outcomes),
        "ehr_context": ehr_context(pipeline.probe("visit"), pipeline.probe("note"), pipeline.probe("condition"),
                                   pipeline.study.probe_start),
        "goodness_of_fit": fit_by_lag(goodness_of_fit(preds, est)),
    }
    summary = reduce(DataFrame.unionByName, [pipeline.count_summary(n) for n in outcomes])
    every = {name: pipeline.indicator(name) for name in outcomes}

    def chosen(names: Sequence[str]) -> dict[str, DataFrame]:
        return {n: every[n] for n in names if n in every}

    panels = {"quality": (C.QUALITY_OUTCOMES, True), "quality_icu": (C.ICU_OUTCOMES, True), "epidemiology": (C.EPIDEMIOLOGY_OUTCOMES, False)}
    datasets |= {k: figure_panels(chosen(names), summary, rates) for k, (names, rates) in panels.items() if chosen(names)}
    if chosen(C.SUMMARY_OUTCOMES):
        datasets["analysis_summary"] = analysis_summary_all(chosen(C.SUMMARY_OUTCOMES), summary)
    if rates := [n for n in every if "rate" in every[n].columns]:
        datasets["site_sensitivity"] = site_sensitivity_rows(chosen(rates))
    for name, ind in every.items():
        datasets[f"figure_{name}"] = figure_dataset(ind)
        if "rate" in ind.columns:
            datasets[f"sensitivity_{name}"] = site_sensitivity(ind)
            datasets[f"volume_{name}"] = volume_per_site(ind)
        else:
            datasets[f"aligned_{name}"] = left_edge_aligned(ind)
    for name, df in datasets.items():
        out[name] = write_csv(df, f"{out_dir}/{name}", mode)
    return out
