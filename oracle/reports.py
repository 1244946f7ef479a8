"""DuckDB SQL for the report datasets."""

from __future__ import annotations

from tempovar import config as C

from . import sql as OS
from .grid import TREND_IDX, count_parts, cs_count_summary, indicator_parts, outcome_ctes, significance_ctes, trend_ctes
from .sql import q, with_ctes

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


def where(filters: dict) -> str:
    return " and ".join(f"{k} = {q(v)}" for k, v in filters.items()) or "true"


def warehouse_counts() -> str:
    ctes = dict(OS.VIEWS)
    return with_ctes(ctes, """select (select count(distinct person_id) from person) n_person,
       (select count(distinct visit_occurrence_id) from visit_occurrence) n_visit,
       (select count(distinct note_id) from note) n_note,
       (select count(distinct person_id) from visit_occurrence) n_person_with_visit""")


def model_summary() -> str:
    ctes = OS.base_ctes()
    for name in ["visit", "note", "note_per_visit", "condition", "icu_rectangle"]:
        ctes[f"est_{name}"] = OS.estimates(name)
    parts = []
    for label, (name, filters) in FUNCTIONALITIES.items():
        t1 = "t_1" if name == "icu_rectangle" else "cast(null as date)"
        parts.append(f"select {q(label)} functionality, error, c_0, t_0, {t1} t_1 from est_{name} where {where(filters)}")
    ctes["rows"] = " union all ".join(parts)
    day = lambda c: f"date_diff('day', DATE '1970-01-01', {c})"
    final = f"""select coalesce(functionality, 'Total') functionality, count(*) n_models,
       round(avg(error), 9) error_mean, round(stddev_samp(error), 9) error_std,
       round(avg(c_0), 9) c_0_mean, round(stddev_samp(c_0), 9) c_0_std,
       cast(DATE '1970-01-01' + cast(floor(avg({day('t_0')})) as integer) as date) t_0_mean,
       cast(floor(stddev_samp({day('t_0')})) as bigint) t_0_std_days,
       cast(DATE '1970-01-01' + cast(floor(avg({day('t_1')})) as integer) as date) t_1_mean,
       cast(floor(stddev_samp({day('t_1')})) as bigint) t_1_std_days
from rows group by grouping sets ((functionality), ())"""
    return with_ctes(ctes, final)


def cohort_summary() -> str:
    ctes = OS.base_ctes()
    labels = {"cohort": "Cohort", "hospit_visit": "QI1_Hospitalization", "emergency_visit": "QI2_Emergency",
              "consultation_note": "QI3_Consultation", "prescription_note": "QI4_Prescription",
              "icu_visit": "QI5_ICU", "bronchiolitis_condition": "EI1_Bronchiolitis", "flu_condition": "EI2_Flu",
              "gastroenteritis_condition": "EI3_Gastroenteritis", "nasopharyngitis_condition": "EI4_Nasopharyngitis"}
    detail = {"consultation_note", "prescription_note", "icu_visit", "bronchiolitis_condition", "flu_condition",
              "gastroenteritis_condition", "nasopharyngitis_condition"}
    parts = []
    for t, label in labels.items():
        stay = "visit_cohort_id" if t == "cohort" else "visit_occurrence_id"
        lv = (lambda lvl: f"count(distinct case when detail_care_site_level = {q(lvl)} then detail_care_site_id end)") \
            if t in detail else (lambda lvl: "cast(null as bigint)")
        age = ("round(avg(age_at_stay), 9)", "round(stddev_samp(age_at_stay), 9)") if t == "cohort" \
            else ("cast(null as double)", "cast(null as double)")
        parts.append(f"""select {q(label)} "table", count(distinct {stay}) n_stays, count(distinct person_id) n_patients,
       count(distinct care_site_id) n_hospitals, {lv(C.LEVEL_DEPARTMENT)} n_departments, {lv(C.LEVEL_UNIT)} n_units,
       {age[0]} age_mean, {age[1]} age_std from {t}""")
    return with_ctes(ctes, " union all ".join(parts))


def ehr_context(start_date: str) -> str:
    ctes = OS.base_ctes()
    ctes["vp"] = OS.visit_probe()
    ctes["np"] = OS.note_probe()
    ctes["cp"] = OS.condition_per_condition_probe()
    H = C.LEVEL_HOSPITAL
    specs = [
        ("5. Diagnoses", "cp", "n_condition", {"source_system": "ORBIS", "care_site_level": H, "stay_type": "hospit",
                                               "condition_type": "All", "diag_type": "DP_DR"}),
        ("3. Consultation reports", "np", "n_note", {"note_type": "consultation", "care_site_level": H, "stay_type": "All"}),
        ("4. Prescription reports", "np", "n_note", {"note_type": "prescription", "care_site_level": H, "stay_type": "All"}),
        ("2. Emergency department records", "vp", "n_visit", {"stay_type": "urgence", "care_site_level": H,
                                                              "specialties_set": "All"}),
        ("1. Hospitalization records", "vp", "n_visit", {"stay_type": "hospitalisés", "care_site_level": H,
                                                         "specialties_set": "All"}),
        ("6. Intensive care unit records", "vp", "n_visit", {"specialties_set": "ICU"}),
    ]
    parts = [f"""select date, cast(sum({n}) as bigint) n_event, {q(label)} event_type from {src}
where {where(f)} and date >= DATE '{start_date}' group by date""" for label, src, n, f in specs]
    ctes["monthly"] = " union all ".join(parts)
    return with_ctes(ctes, """select *, max(n_event) over (partition by event_type) max_event,
       round(n_event / max(n_event) over (partition by event_type), 9) c from monthly""")


def analysis_summary(name: str) -> str:
    ctes, final = indicator_parts(name, rounded=False)
    ctes["ind"] = final
    ctes["cell"] = f"""select * from ind where care_site_id = 'All' and max_error_label = 'No filter'
  and min_c_0_label = 'No filter' {"and threshold = 'before_30_days'" if C.OUTCOMES[name].key_function == 'duration_after' else ''}"""
    idx = [c for c in TREND_IDX if c != "threshold" or C.OUTCOMES[name].key_function == "duration_after"]
    res = trend_ctes(ctes, "cell", idx)
    summ = cs_count_summary(name)
    ctes["summ"] = f"select * from ({summ})"
    ctes["share"] = f"""select param_id, start_observation_date, {q(C.NAIVE)} analysis,
       cast(naive_cs_count as varchar) || ' (100 %)' cs_considered, outcome_name from summ
union all select param_id, start_observation_date, {q(C.CSO)},
       cast(cso_cs_count as varchar) || ' (' || printf('%.1f', cso_cs_count / naive_cs_count * 100) || ' %)', outcome_name
from summ"""
    return with_ctes(ctes, f"""select s.outcome_name, t.start_observation_date, t.analysis, s.cs_considered,
       round(t.alpha_0, 9) alpha_0, round(t.alpha_1, 9) alpha_1
from {res} t join share s on s.param_id = t.param_id and s.start_observation_date = t.start_observation_date
  and s.analysis = t.analysis""")


def site_sensitivity(name: str) -> str:
    ctes, final = indicator_parts(name, rounded=False)
    is_d5 = C.OUTCOMES[name].key_function == "duration_after"
    ctes["ind"] = f"select * from ({final}) {'where threshold = ' + q('before_30_days') if is_d5 else ''}"
    idx = [c for c in TREND_IDX if c != "threshold" or is_d5]
    res = trend_ctes(ctes, "ind", idx)
    keys = [c for c in ["threshold", "param_id", "start_observation_date", "max_error_label", "min_c_0_label",
                        "analysis"] if c != "threshold" or is_d5]
    k = ", ".join(keys)
    aggs = []
    for v in ("alpha_1", "mean_value"):
        aggs += [f"round(min({v}), 9) {v}_min", f"round(quantile_cont({v}, 0.25), 9) {v}_q1",
                 f"round(quantile_cont({v}, 0.5), 9) {v}_median", f"round(quantile_cont({v}, 0.75), 9) {v}_q3",
                 f"round(max({v}), 9) {v}_max"]
    ctes["spread"] = f"select {k}, count(*) n_sites, {', '.join(aggs)} from {res} where care_site_id <> 'All' group by all"
    ctes["alls"] = f"""select {k}, round(alpha_1, 9) alpha_1_all, round(mean_value, 9) mean_value_all
from {res} where care_site_id = 'All'"""
    on = " and ".join(f"a.{c} = s.{c}" for c in keys)
    return with_ctes(ctes, f"select s.*, a.alpha_1_all, a.mean_value_all from spread s left join alls a on {on}")


def _panel(c: str) -> str:
    return f"case {c} " + " ".join(f"when {q(k)} then {q(v)}" for k, v in C.PANEL_LABELS.items()) + " end"


def goodness_of_fit(by_lag: bool) -> str:
    ctes = OS.base_ctes()
    probes = {"visit": OS.visit_probe(), "note": OS.note_probe(), "note_per_visit": OS.note_per_visit_probe(),
              "condition": OS.condition_probe()}
    idx = OS.PROBE_INDEX
    for name, sql in probes.items():
        # only the wanted levels and sets are fitted: an index is fitted by itself
        wanted = " or ".join("(" + " and ".join(f"{k} = {q(v)}" for k, v in f.items()) + ")" for n, f in FUNCTIONALITIES.values() if n == name)
        ctes[f"pred_{name}"] = f"select * from ({sql}) where {wanted}"
        ctes[f"est_{name}"] = OS.step_fit(f"select * from pred_{name}", idx[name])
    parts = []
    for label, (name, filters) in FUNCTIONALITIES.items():
        if name not in probes:
            continue
        on = " and ".join(f"p.{c} is not distinct from e.{c}" for c in idx[name])
        w = " and ".join(f"p.{k} = {q(v)}" for k, v in filters.items())
        parts.append(f"""select {q(label)} EHR_functionality, {_panel('p.care_site_level')} care_site_level, p.care_site_id, p.care_site_short_name,
       p.date, p.c, e.c_0, e.t_0, e.error from pred_{name} p join est_{name} e on {on} where {w}""")
    ctes["gof"] = " union all ".join(parts)
    ctes["gof2"] = """select *, cast((year(date) - year(t_0)) * 12 + month(date) - month(t_0) as integer) normalized_date from gof"""
    ctes["gof3"] = """select *, case when normalized_date < 0 or c_0 = 0 then c else c / c_0 end normalized_c,
       case when normalized_date >= 0 then 1 else 0 end model from gof2"""
    if by_lag:
        return with_ctes(ctes, """select EHR_functionality, normalized_date, count(*) n,
       round(avg(normalized_c), 9) normalized_c_mean, round(stddev_samp(normalized_c), 9) normalized_c_std,
       max(model) model from gof3 group by all""")
    return with_ctes(ctes, """select * replace (round(c, 9) as c, round(c_0, 9) as c_0, round(error, 9) as error,
       round(normalized_c, 9) as normalized_c) from gof3""")


def volume_per_site(name: str) -> str:
    ctes, final = indicator_parts(name)
    is_d5 = C.OUTCOMES[name].key_function == "duration_after"
    ctes["ind"] = final
    ctes["cell"] = f"""select * from ind where max_error_label = 'No filter' and min_c_0_label = 'No filter'
  and analysis = {q(C.NAIVE)} and care_site_id <> 'All' {"and threshold = 'before_30_days'" if is_d5 else ''}"""
    total = "n_total" if C.OUTCOMES[name].key_function != "incidence" else "n_events"
    return with_ctes(ctes, f"""select care_site_id, cast(sum({total}) as bigint) n_total, cast(sum(n_events) as bigint) n_events
from cell where start_observation_date = (select min(start_observation_date) from cell) group by care_site_id""")


def figure_dataset(name: str) -> str:
    ctes, final = indicator_parts(name)
    ctes["ind"] = final
    return with_ctes(ctes, """select * exclude (care_site_id),
       'Starting date: ' || strftime(cast(start_observation_date as date), '%b %Y') start_label
from ind where care_site_id = 'All'""")


def left_edge_aligned(name: str) -> str:
    ctes, final = indicator_parts(name)
    ctes["ind"] = final
    ctes["firsts"] = """select start_observation_date, max_error_label, min_c_0_label, analysis, min(sub_cohort) f
from ind group by all"""
    ctes["edge"] = "select start_observation_date, max(f) edge from firsts group by 1"
    ctes["yrs"] = "select start_observation_date, min(year(sub_cohort)) y from ind group by 1"
    return with_ctes(ctes, """select i.* replace (case when i.sub_cohort <= e.edge then make_date(cast(y.y as integer), 1, 1)
       else i.sub_cohort end as sub_cohort)
from ind i join edge e using (start_observation_date) join yrs y using (start_observation_date)""")


def arem_condition() -> str:
    ctes = OS.base_ctes()
    return with_ctes(ctes, f"""select v.visit_occurrence_id, cast(null as bigint) visit_detail_id,
       c.condition_status_source_value diag_type, c.condition_source_value, c.condition_start_datetime
from arem_visit_occurrence a join arem_condition_occurrence c on c.visit_occurrence_id = a.visit_occurrence_id
join vo v on v.visit_occurrence_source_value = a.visit_occurrence_source_value
where c.cdm_source = 'AREM' and {OS.rx('c.condition_status_source_value', C.DIAG_REGEX, True)}""")


def fitted_examples(site_ids: list[int], filters: dict) -> str:
    ctes = OS.base_ctes()
    ctes["pred"] = OS.visit_probe()
    ctes["est"] = OS.step_fit("select * from pred", OS.PROBE_INDEX["visit"])
    on = " and ".join(f"p.{c} is not distinct from e.{c}" for c in OS.PROBE_INDEX["visit"])
    w = " and ".join(f"p.{k} = {q(v)}" for k, v in filters.items())
    ids = ", ".join(str(i) for i in site_ids)
    return with_ctes(ctes, f"""select p.date, 'Hospital ' || cast(dense_rank() over (order by p.care_site_id) as varchar)
       care_site_short_name, round(p.c, 9) c,
       round(case when p.date >= e.t_0 then e.c_0 else 0.0 end, 9) c_hat
from pred p join est e on {on} where {w} and p.care_site_id in ({ids})""")


def fitted_trend_line(name: str, y: str) -> str:
    ctes, final = indicator_parts(name, rounded=False)
    is_d5 = C.OUTCOMES[name].key_function == "duration_after"
    ctes["cell"] = f"""select * from ({final}) where care_site_id = 'All' and {y} is not null
  {"and threshold = 'before_30_days'" if is_d5 else ''}"""
    ctes["xy"] = "select *, cast(date_diff('day', DATE '1970-01-01', sub_cohort) as double) x_ from cell"
    ctes["coef"] = f"select param_id, analysis, regr_slope({y}, x_) b_, regr_intercept({y}, x_) a_ from xy group by all"
    doubles = ["max_error", "min_c_0", f"{y}_fitted"] + (["rate"] if y == "rate" else [])
    rep = ", ".join(f"round({c}, 9) as {c}" for c in doubles)
    return with_ctes(ctes, f"""select * replace ({rep}) from (
  select x.* exclude (x_), c.a_ + c.b_ * x.x_ {y}_fitted from xy x join coef c using (param_id, analysis))""")


SHARE = f"""select param_id, outcome_name, start_observation_date, care_site_level, {q(C.NAIVE)} analysis,
       cast(naive_cs_count as varchar) || ' (100 %)' cs_considered from summ
union all select param_id, outcome_name, start_observation_date, care_site_level, {q(C.CSO)},
       cast(cso_cs_count as varchar) || ' (' || printf('%.1f', cso_cs_count / naive_cs_count * 100) || ' %)' from summ"""


def _with_share(ctes: dict[str, str], name: str) -> dict[str, str]:
    more, final = count_parts(name)
    return {**ctes, **{k: v for k, v in more.items() if k not in ctes}, "summ": final, "share": SHARE}


def analysis_summary_all() -> str:
    parts = []
    cell = "care_site_id = 'All' and max_error_label = 'No filter' and min_c_0_label = 'No filter'"
    for name in C.SUMMARY_OUTCOMES:
        if C.OUTCOMES[name].key_function == "incidence":
            ctes, final = indicator_parts(name)
            ctes["rows_"] = f"""select distinct param_id, start_observation_date, analysis, cast(null as varchar) alpha_0,
       cast(null as varchar) alpha_1 from ({final}) where max_error_label = 'No filter' and min_c_0_label = 'No filter'"""
        else:
            is_d5 = C.OUTCOMES[name].key_function == "duration_after"
            ctes, _ = significance_ctes(name, only=cell + (" and threshold = 'before_30_days'" if is_d5 else ""))
            ctes["rows_"] = "select param_id, start_observation_date, analysis, alpha_0_text alpha_0, alpha_1_text alpha_1 from txt"
        parts.append(with_ctes(_with_share(ctes, name), """select s.outcome_name, t.start_observation_date, t.analysis, s.cs_considered, t.alpha_0, t.alpha_1
from rows_ t join share s using (param_id, start_observation_date, analysis)""", recursive=True))
    return " union all ".join(f"select * from ({p})" for p in parts)


def figure_panels(names: list[str], rates: bool = True) -> str:
    label = "case s.care_site_level " + " ".join(f"when {q(k)} then {q(v + 's')}" for k, v in C.LEVEL_LABELS.items()) + " end"
    parts = []
    for name in names:
        ctes, final = indicator_parts(name)
        ctes["ind"] = final
        drop = "care_site_id, max_error, min_c_0" + (", n_events" if rates else "")
        parts.append(with_ctes(_with_share(ctes, name), f"""select i.* exclude ({drop}),
       'Starting date: ' || strftime(cast(i.start_observation_date as date), '%b %Y') start_label, s.cs_considered, {label} care_site_level, {q(name)} outcome_name
from ind i join share s on s.param_id = i.param_id and s.analysis = {q(C.CSO)} where i.care_site_id = 'All'"""))
    return " union all by name ".join(f"select * from ({p})" for p in parts)


def site_sensitivity_rows(names: list[str]) -> str:
    parts = []
    for name in names:
        is_d5 = C.OUTCOMES[name].key_function == "duration_after"
        keys = [c for c in ["threshold", "param_id", "start_observation_date", "max_error_label", "min_c_0_label", "analysis"] if c != "threshold" or is_d5]
        ctes, _ = significance_ctes(name, threshold="before_30_days" if is_d5 else None)
        values = ["p_value", "alpha_0", "alpha_1", "mean_value"]
        on = " and ".join(f"a.{k} = s.{k}" for k in keys)
        parts.append(with_ctes(ctes, f"""select s.care_site_id, {', '.join('s.' + k for k in keys)}, {', '.join(f'round(s.{v}, 9) + 0.0 {v}, round(a.{v}, 9) + 0.0 {v}_all' for v in values)},
       {q(C.EVENT_NAMES[name])} outcome_name
from txt s left join txt a on {on} and a.care_site_id = 'All' where s.care_site_id <> 'All'""", recursive=True))
    return " union all by name ".join(f"select * from ({p})" for p in parts)


def _panel_rows(probe: str, key: str, outcome: str, sites: list[int], kind: str, rectangle: bool = False) -> str:
    o = C.OUTCOMES[outcome]
    ctes = OS.base_ctes()
    w = " and ".join(f"{k} = {q(v)}" for k, v in {"care_site_level": o.care_site_level, **{k: getattr(o, k) for k in (
        "note_type", "stay_type", "specialties_set", "diag_type", "source_system", "condition_type") if getattr(o, k)}}.items())
    ctes["pred"] = f"select * from ({probe}) where {w}"
    ctes["est"] = OS.estimates(o.estimates) if rectangle else OS.step_fit("select * from pred", OS.PROBE_INDEX[key])
    on = " and ".join(f"p.{c} is not distinct from e.{c}" for c in OS.PROBE_INDEX[key])
    inside = "p.date >= e.t_0" + (" and p.date <= e.t_1" if rectangle else "")
    names = " ".join(f"when {i} then '{kind} {n}'" for n, i in enumerate(sorted(sites), 1))
    return with_ctes(ctes, f"""select p.date, case p.care_site_id {names} end care_site_short_name, round(p.c, 9) c,
       round(case when {inside} then e.c_0 else 0.0 end, 9) c_hat
from pred p join est e on {on} where p.care_site_id in ({', '.join(map(str, sites))})""")


def example_panels(hospitals: list[int], departments: list[int]) -> str:
    rows = [("Hospitalizations", OS.visit_probe(), "visit", "hospit_visit", hospitals, "Hospital"),
            ("Emergency stays", OS.visit_probe(), "visit", "emergency_visit", hospitals, "Hospital"),
            ("Consultation reports", OS.note_probe(), "note", "consultation_note", departments, "Department"),
            ("Prescription reports", OS.note_per_visit_probe(), "note_per_visit", "prescription_note", departments, "Department"),
            ("Diagnostic codes", OS.condition_probe(), "condition", "bronchiolitis_condition", departments, "Department")]
    return " union all ".join(f"select *, {q(t)} data_type from ({_panel_rows(p, k, o, s, kind)})" for t, p, k, o, s, kind in rows)


def rectangle_panels(units: list[int], end_date: str) -> str:
    icu = OS.visit_probe(levels=[C.LEVEL_UNIT], sets=C.ICU_SPECIALTIES_SETS)
    return f"""select *, 0 data_type from ({_panel_rows(OS.visit_probe(), 'visit', 'icu_visit', units, 'Unit')})
union all select *, 1 from ({_panel_rows(icu, 'visit', 'icu_visit_rectangle', units, 'Unit', rectangle=True)}) where date <= DATE '{end_date}'"""


def long_table(names: list[str]) -> str:
    """The indicator dataset of A5 over some outcomes: one schema, NULL where an outcome has no such column."""
    nulls = {"threshold": "varchar", "n_total": "bigint", "rate": "double", "school_years": "integer", "max_events": "integer"}
    own = {"duration_after": ["threshold", "n_total", "rate"], "during_stay": ["n_total", "rate"], "incidence": ["school_years", "max_events"]}
    parts = []
    for name in names:
        ctes, final = indicator_parts(name)
        ctes["ind"] = final
        lacking = [c for c in nulls if c not in own[C.OUTCOMES[name].key_function]]
        parts.append(with_ctes(ctes, f"select *, {', '.join(f'cast(null as {nulls[c]}) {c}' for c in lacking)}, {q(name)} outcome_name from ind"))
    return " union all by name ".join(f"select * from ({p})" for p in parts)
