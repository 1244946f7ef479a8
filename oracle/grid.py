"""DuckDB SQL for the analysis stage: cohort stability, parameter cells, indicators, count summary."""

from __future__ import annotations

from tempovar import config as C

from .sql import H, base_ctes, estimates, q, with_ctes

ALL_SITE = "case when grouping(care_site_id) = 1 then 'All' else cast(care_site_id as varchar) end"
ERROR_LABELS = ["No filter", "Q3", "median", "Q1"]
C0_LABELS = ["No filter", "Q1", "median", "Q3"]


def analysis_cohort_ctes(s: C.Study = C.DEFAULT_STUDY) -> dict[str, str]:
    ctes = base_ctes(s)
    ctes["vest"] = estimates("visit", s)
    ctes["vest_f"] = f"select * from vest where care_site_level = {q(H)} and stay_type = 'hospitalisés'"
    ctes["coh9"] = """select visit_cohort_id, person_id, care_site_id, cohort_stay_start, cohort_stay_end, stay_type,
       CMD_code, CMD, sub_cohort from cohort where cohort_stay_end is not null"""
    ctes["coh_ok"] = f"""select r.visit_cohort_id from coh9 r left join vest_f e on e.care_site_id = r.care_site_id
group by r.visit_cohort_id
having bool_and(coalesce(e.t_0 <= DATE '{s.stability_date}' and e.error <= 1.0 and e.c_0 >= 0.0, false))"""
    ctes["cohort_all"] = "select * from coh9 where visit_cohort_id in (select visit_cohort_id from coh_ok)"
    ctes["hospital_count"] = f"""select count(distinct care_site_id) n from vest_f
where t_0 <= DATE '{s.stability_date}' and error <= 1.0 and c_0 >= 0.0"""
    return ctes


def _nearest(lst: str, qq: float) -> str:
    return f"{lst}[cast(round((len({lst}) - 1) * {qq}) as integer) + 1]"


def outcome_ctes(name: str, s: C.Study = C.DEFAULT_STUDY) -> tuple[dict[str, str], C.Outcome, str | None]:
    o = C.OUTCOMES[name]
    ctes = analysis_cohort_ctes(s)
    ctes["est"] = estimates(o.estimates, s) if o.estimates != "visit" else "select * from vest"
    conds = [f"care_site_level = {q(o.care_site_level)}"]
    for f in ["note_type", "stay_type", "specialties_set", "diag_type", "source_system", "condition_type"]:
        v = getattr(o, f)
        if v:
            conds.append(f"{f} = {q(v)}")
    ctes["est_f"] = f"select * from est where {' and '.join(conds)}"
    ctes["thr"] = """select count(distinct care_site_id) active,
       list_sort(list(error) filter (where error is not null)) errs,
       list_sort(list(c_0) filter (where c_0 is not null)) c0s from est_f"""
    starts = " union all ".join(f"select {i} si, {q(d)} sd" for i, d in enumerate(s.start_observation_dates))
    errs = " union all ".join(
        [f"select 0 ei, 1.0 me, {q(ERROR_LABELS[0])} el from thr"] +
        [f"select {i} ei, {_nearest('errs', qq)} me, {q(ERROR_LABELS[i])} el from thr"
         for i, qq in [(1, 0.75), (2, 0.5), (3, 0.25)]])
    c0s = " union all ".join(
        [f"select 0 ci, 0.0 mc, {q(C0_LABELS[0])} cl from thr"] +
        [f"select {i} ci, {_nearest('c0s', qq)} mc, {q(C0_LABELS[i])} cl from thr"
         for i, qq in [(1, 0.25), (2, 0.5), (3, 0.75)]])
    ctes["cells"] = f"""select cast(s.si*16 + e.ei*4 + c.ci as integer) param_id, s.sd start_observation_date,
       cast(e.me as double) max_error, cast(c.mc as double) min_c_0, e.el max_error_label, c.cl min_c_0_label
from ({starts}) s cross join ({errs}) e cross join ({c0s}) c"""
    end = s.last_month if (o.use_end_date and "rectangle" in o.estimates) else None
    t1 = end is not None
    site = "care_site_id" if o.care_site_level == H else "detail_care_site_id"
    level_filter = "" if o.care_site_level == H else f"where detail_care_site_level = {q(o.care_site_level)}"
    events = name.replace("_rectangle", "")
    ctes["ev_rows"] = f"select visit_occurrence_id, {site} site from {events} {level_filter}"
    ctes["ext"] = f"""select r.visit_occurrence_id, max(e.t_0) max_t0, max(e.error) max_error, min(e.c_0) min_c0,
       {'min(e.t_1)' if t1 else 'null'} min_t1,
       bool_or(e.t_0 is null or e.error is null or e.c_0 is null {'or e.t_1 is null' if t1 else ''}) bad
from ev_rows r left join est_f e on e.care_site_id = r.site group by r.visit_occurrence_id"""
    ctes["stable"] = f"""select x.visit_occurrence_id, p.param_id from ext x join cells p
on not x.bad and x.max_t0 <= cast(p.start_observation_date as date) and x.max_error <= p.max_error
   and x.min_c0 >= p.min_c_0 {f"and x.min_t1 >= DATE '{end}'" if t1 else ''}"""
    return ctes, o, end


def _attach_cells(res_cols: str) -> str:
    return f"""select {res_cols}, p.param_id, p.start_observation_date, round(p.max_error, 9) max_error,
       round(p.min_c_0, 9) min_c_0, p.max_error_label, p.min_c_0_label, {q(C.NAIVE)} analysis
from res r cross join cells p where r.param_id = -1 and r.sub_cohort >= cast(p.start_observation_date as date)
union all
select {res_cols}, p.param_id, p.start_observation_date, round(p.max_error, 9), round(p.min_c_0, 9),
       p.max_error_label, p.min_c_0_label, {q(C.CSO)}
from res r join cells p on p.param_id = r.param_id where r.sub_cohort >= cast(p.start_observation_date as date)"""


def indicator(name: str, s: C.Study = C.DEFAULT_STUDY) -> str:
    ctes, final = indicator_parts(name, s)
    return with_ctes(ctes, final)


def indicator_by_group(name: str, s: C.Study = C.DEFAULT_STUDY) -> str:
    """D5 per (site, diagnosis group) on the per-group subset of the cohort."""
    ctes, _ = indicator_parts(name, s)
    ctes["stays"] = f"""select visit_cohort_id, person_id, cohort_stay_end, care_site_id, sub_cohort, CMD_code || ' ' || CMD MCD, count(*) mult
from cohort_all where CMD_code <= '27' and sub_cohort >= DATE '{s.mcd_start}' group by all"""
    ctes["cand"] = ctes["cand"].replace("from stays s", "from (select distinct visit_cohort_id, person_id, cohort_stay_end from stays) s")
    ctes["flags"] = ctes["flags"].replace("s.care_site_id,", "s.care_site_id, s.MCD,")
    for part in ("nev", "ntot"):
        ctes[part] = ctes[part].replace("care_site_id, sub_cohort", "care_site_id, MCD, sub_cohort").replace("param_id, sub_cohort", "param_id, MCD, sub_cohort").replace(", (sub_cohort)", ", (MCD, sub_cohort)")
    ctes["res"] = ctes["res"].replace("n.care_site_id, ", "n.care_site_id, n.MCD, ").replace("and t.sub_cohort", "and t.MCD = n.MCD and t.sub_cohort")
    return with_ctes(ctes, _attach_cells("r.care_site_id, r.MCD, r.sub_cohort, r.threshold, r.n_events, r.n_total, round(r.rate, 9) rate"))


def indicator_parts(name: str, s: C.Study = C.DEFAULT_STUDY, rounded: bool = True) -> tuple[dict[str, str], str]:
    """CTEs and final select of the indicator; ``rounded=False`` keeps exact doubles for further computation."""
    ctes, o, _ = outcome_ctes(name, s)
    events = name.replace("_rectangle", "")
    ctes["stays"] = """select visit_cohort_id, person_id, cohort_stay_end, care_site_id, sub_cohort, count(*) mult
from cohort_all group by all"""
    if o.key_function == "duration_after":
        ctes["ev"] = f"""select distinct visit_occurrence_id, person_id, {o.col_date} ts from {events}
where {o.col_date} is not null"""
        ctes["cand"] = f"""select s.visit_cohort_id, s.person_id s_person, e.visit_occurrence_id, e.ts from stays s join ev e
on e.person_id = s.person_id and e.ts >= s.cohort_stay_end and e.ts <= s.cohort_stay_end + to_days({s.tolerance_days})"""
        level = C.OUTCOMES[name].care_site_level
        at_level = "" if level == H else f"and detail_care_site_level = {q(level)}"
        ctes["cand_level"] = f"""select c.* from cand c where exists (select 1 from {events} e
  where e.visit_occurrence_id = c.visit_occurrence_id and e.person_id = s_person and e.{o.col_date} = c.ts {at_level})"""
        ctes["m"] = """select -1 param_id, visit_cohort_id, visit_occurrence_id, ts from (
  select c.*, row_number() over (partition by visit_cohort_id order by ts, visit_occurrence_id) rn_ from cand c) where rn_ = 1
union all
select param_id, visit_cohort_id, visit_occurrence_id, ts from (
  select c.*, st.param_id, row_number() over (partition by st.param_id, c.visit_cohort_id order by c.ts, c.visit_occurrence_id) rn_
  from cand_level c join stable st on st.visit_occurrence_id = c.visit_occurrence_id) where rn_ = 1"""
        th = " union all ".join(f"select 'before_{t}_days' threshold, {t} ndays" for t in s.thresholds)
        ctes["flags"] = f"""select m.param_id, s.care_site_id, s.sub_cohort, s.mult, t.threshold,
       m.ts <= s.cohort_stay_end + to_days(t.ndays) has
from m join stays s on s.visit_cohort_id = m.visit_cohort_id cross join ({th}) t
where m.visit_occurrence_id <> m.visit_cohort_id"""
        ctes["nev"] = f"""select param_id, {ALL_SITE} care_site_id, sub_cohort, threshold,
       cast(sum(case when has then mult else 0 end) as integer) n_events
from flags group by grouping sets ((param_id, care_site_id, sub_cohort, threshold), (param_id, sub_cohort, threshold))"""
        ctes["ntot"] = f"""select {ALL_SITE} care_site_id, sub_cohort, cast(sum(mult) as bigint) n_total
from stays group by grouping sets ((care_site_id, sub_cohort), (sub_cohort))"""
        ctes["res"] = """select n.param_id, n.care_site_id, n.sub_cohort, n.threshold, n.n_events, t.n_total,
       n.n_events / t.n_total rate
from nev n join ntot t on t.care_site_id = n.care_site_id and t.sub_cohort = n.sub_cohort"""
        cols = "r.care_site_id, r.sub_cohort, r.threshold, r.n_events, r.n_total, " + (
            "round(r.rate, 9) rate" if rounded else "r.rate")
    elif o.key_function == "during_stay":
        ctes["flag"] = f"""select -1 param_id, s.*, s.visit_cohort_id in (select visit_occurrence_id from {events}) hit from stays s
union all
select p.param_id, s.*, st.visit_occurrence_id is not null hit from stays s cross join cells p
left join stable st on st.visit_occurrence_id = s.visit_cohort_id and st.param_id = p.param_id"""
        ctes["res"] = f"""select param_id, {ALL_SITE} care_site_id, sub_cohort,
       cast(sum(case when hit then mult else 0 end) as integer) n_events, count(*) n_total,
       cast(sum(case when hit then mult else 0 end) as integer) / count(*) rate
from flag group by grouping sets ((param_id, care_site_id, sub_cohort), (param_id, sub_cohort))"""
        cols = "r.care_site_id, r.sub_cohort, r.n_events, r.n_total, " + (
            "round(r.rate, 9) rate" if rounded else "r.rate")
    else:
        ctes["hits"] = f"""select -1 param_id, c.visit_cohort_id, c.care_site_id, cast(date_trunc('week', c.cohort_stay_start) as date) wk
from cohort_all c where c.visit_cohort_id in (select visit_occurrence_id from {events})
union all
select st.param_id, c.visit_cohort_id, c.care_site_id, cast(date_trunc('week', c.cohort_stay_start) as date)
from cohort_all c join stable st on st.visit_occurrence_id = c.visit_cohort_id"""
        ctes["weekly"] = f"""select param_id, {ALL_SITE} care_site_id, wk sub_cohort,
       cast(count(distinct visit_cohort_id) as integer) n_events
from hits group by grouping sets ((param_id, care_site_id, wk), (param_id, wk))"""
        ctes["res"] = """select *, case when row_number() over (partition by param_id, school_years, care_site_id
       order by n_events desc, sub_cohort) = 1 then n_events end max_events from (
  select *, cast(year(sub_cohort) + case when month(sub_cohort) > 8 then 1 else 0 end as integer) school_years
  from weekly)"""
        cols = "r.care_site_id, r.sub_cohort, r.n_events, r.school_years, r.max_events"
    return ctes, _attach_cells(cols)


TREND_IDX = ["care_site_id", "threshold", "param_id", "start_observation_date", "max_error", "min_c_0",
             "max_error_label", "min_c_0_label", "analysis"]


def trend_ctes(ctes: dict[str, str], src: str, idx: list[str], y: str = "rate", prefix: str = "t", only: str = "true") -> str:
    """Add the D15 CTEs over ``src`` and return the name of the per-partition result CTE."""
    cols = ", ".join(idx)
    on = " and ".join(f"g.{c} is not distinct from i.{c}" for c in idx)
    ctes[f"{prefix}_part"] = f"select distinct {cols} from {src} where {only}"
    ctes[f"{prefix}_grid"] = f"""select p.*, cast(unnest(generate_series(cast(p.start_observation_date as timestamp),
       cast((select max(sub_cohort) from {src}) as timestamp), interval 1 month)) as date) sub_cohort from {prefix}_part p"""
    ctes[f"{prefix}_filled"] = f"""select {', '.join('g.' + c for c in idx)}, g.sub_cohort, coalesce(i.{y}, 0.0) y
from {prefix}_grid g left join {src} i on {on} and i.sub_cohort = g.sub_cohort"""
    ctes[f"{prefix}_xs"] = f"""select *, cast(row_number() over (partition by {cols} order by sub_cohort) - 1 as double) x
from {prefix}_filled"""
    ctes[f"{prefix}_res"] = f"""select {cols}, count(*) n,
       case when regr_sxx(y, x) > 0 then regr_intercept(y, x) end alpha_0,
       case when regr_sxx(y, x) > 0 then regr_slope(y, x) end alpha_1,
       avg(y) mean_value
from {prefix}_xs group by all"""
    return f"{prefix}_res"


def trend(name: str, s: C.Study = C.DEFAULT_STUDY) -> str:
    """D15 on ``rate``: zero-filled months from each start date to the last month, x = month index."""
    ctes, final = indicator_parts(name, s, rounded=False)
    ctes["ind"] = final
    idx = [c for c in TREND_IDX if c != "threshold" or C.OUTCOMES[name].key_function == "duration_after"]
    res = trend_ctes(ctes, "ind", idx)
    return with_ctes(ctes, f"""select * replace (round(alpha_0, 9) as alpha_0, round(alpha_1, 9) as alpha_1,
       round(mean_value, 9) as mean_value) from {res}""")


def _p_sum(nu: str, c2: str) -> str:
    """The finite cosine sum of Student's t for whole degrees of freedom, by gamma functions."""
    odd = f"list_sum(list_transform(range(0, ({nu} - 1) // 2), lambda k: exp(lgamma(k + 1) - lgamma(k + 1.5)) * sqrt(pi()) / 2 * pow({c2}, k)))"
    even = f"list_sum(list_transform(range(0, {nu} // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow({c2}, k)))"
    return f"case when {nu} % 2 = 1 then coalesce({odd}, 0) else coalesce({even}, 0) end"


def _p_two_sided(t: str, nu: str) -> str:
    a = f"atan(abs({t}) / sqrt({nu}))"
    total = _p_sum(nu, f"pow(cos({a}), 2)")
    return (f"greatest(0, 1 - case when {nu} % 2 = 1 then 2 / pi() * ({a} + sin({a}) * cos({a}) * ({total})) "
            f"else sin({a}) * ({total}) end)")


def trend_significance(name: str, long_form: bool = False) -> str:
    """P-value, 95 % intervals and their text, from the filled months."""
    ctes, idx = significance_ctes(name)
    if long_form:
        cols = ", ".join(idx)
        return with_ctes(ctes, " union all ".join(f"select {cols}, '{m}' model, {m} as value from txt"
                                                  for m in ("p_value_text", "alpha_0_text", "alpha_1_text")), recursive=True)
    doubles = ["alpha_0", "alpha_1", "mean_value", "p_value", *[f"alpha_{i}_ci_{x}" for i in (0, 1) for x in ("low", "high")]]
    return with_ctes(ctes, f"select * replace ({', '.join(f'round({c}, 9) as {c}' for c in doubles)}) from txt", recursive=True)


def significance_ctes(name: str, s: C.Study = C.DEFAULT_STUDY, threshold: str | None = None, only: str = "true") -> tuple[dict[str, str], list[str]]:
    """The CTEs up to ``txt``; ``threshold`` limits the rows first, ``only`` the partitions that are fitted."""
    ctes, final = indicator_parts(name, s, rounded=False)
    ctes["ind"] = f"select * from ({final}) where threshold = {q(threshold)}" if threshold else final
    idx = [c for c in TREND_IDX if c != "threshold" or C.OUTCOMES[name].key_function == "duration_after"]
    trend_ctes(ctes, "ind", idx, only=only)
    cols = ", ".join(idx)
    ctes["raw"] = f"""select {cols}, count(*) n, sum(y) sy, sum(x * y) sxy_raw, sum(y * y) syy_raw,
       count(*) * (count(*) * count(*) - 1) / 12.0 sxx from t_xs group by all"""
    ctes["mom"] = """select *, sxy_raw - (n - 1) / 2.0 * sy sxy_, syy_raw - sy * sy / n syy_ from raw"""
    ctes["fit0"] = """select *, case when abs(sxy_) <= 1e-12 * sqrt(syy_raw * sxx) then 0 else sxy_ end sxy,
       case when abs(syy_) <= 1e-12 * syy_raw then 0 else syy_ end syy from mom"""
    ctes["fit1"] = """select *, case when sxx > 0 then sxy / sxx end alpha_1, sy / n mean_value,
       syy - sxy_ * sxy_ / nullif(sxx, 0) res_ from fit0"""
    ctes["fit2"] = """select *, case when sxx > 0 then sy / n - alpha_1 * (n - 1) / 2.0 end alpha_0,
       case when n >= 3 then case when abs(res_) <= 1e-12 * syy_raw then 0 else greatest(res_, 0) end end res from fit1"""
    ctes["fit3"] = """select *, sqrt(res / (n - 2) / sxx) se_1, sqrt(res / (n - 2) * (1.0 / n + pow((n - 1) / 2.0, 2) / sxx)) se_0 from fit2"""
    ctes["fit4"] = f"""select *, case when se_1 = 0 and alpha_1 <> 0 then 0.0 when se_1 > 0 then {_p_two_sided('(alpha_1 / se_1)', '(n - 2)')} end p_value from fit3"""
    half = _p_two_sided("((lo + hi) / 2)", "(n - 2)")
    ctes["bis"] = f"""select n, 0.0::double lo, 12.8::double hi, 0 i from (select distinct n from raw where n >= 3)
union all select n, case when {half} > 0.05 then (lo + hi) / 2 else lo end, case when {half} > 0.05 then hi else (lo + hi) / 2 end, i + 1 from bis where i < 60"""
    ctes["qq"] = "select n, (lo + hi) / 2 q from bis where i = 60"
    ctes["sig"] = f"""select {cols}, n, alpha_0, alpha_1, mean_value, p_value, alpha_0 - q * se_0 alpha_0_ci_low, alpha_0 + q * se_0 alpha_0_ci_high,
       alpha_1 - q * se_1 alpha_1_ci_low, alpha_1 + q * se_1 alpha_1_ci_high from fit4 left join qq using (n)"""
    text = ", ".join(
        f"format('{{:.2e}}', {c}) || ' [' || format('{{:.2e}}', {c}_ci_low) || ', ' || format('{{:.2e}}', {c}_ci_high) || ']' {c}_text"
        for c in ("alpha_0", "alpha_1"))
    ctes["txt"] = f"""select *, case when p_value < 0.001 then '< 10e-3' else format('{{:.3f}}', p_value) end p_value_text, {text} from sig"""
    return ctes, idx


def cs_count_summary(name: str, s: C.Study = C.DEFAULT_STUDY) -> str:
    return with_ctes(*count_parts(name, s))


def count_parts(name: str, s: C.Study = C.DEFAULT_STUDY) -> tuple[dict[str, str], str]:
    ctes, o, end = outcome_ctes(name, s)
    t1 = f"and e.t_1 >= DATE '{end}'" if end else ""
    ctes["csc"] = """select care_site_type_source_value care_site_level, count(distinct care_site_id) total_care_site
from care_site group by 1"""
    ctes["cso_cnt"] = f"""select p.param_id, count(distinct case when e.t_0 <= cast(p.start_observation_date as date)
       and e.error <= p.max_error and e.c_0 >= p.min_c_0 {t1} then e.care_site_id end) cso_cs_count
from cells p cross join est_f e group by p.param_id"""
    final = f"""select p.param_id, {q(o.care_site_level)} care_site_level, c.total_care_site, t.active naive_cs_count,
       coalesce(k.cso_cs_count, 0) cso_cs_count, p.start_observation_date, round(p.max_error, 9) max_error,
       round(p.min_c_0, 9) min_c_0, p.max_error_label, p.min_c_0_label, {q(name)} outcome_name,
       (select n from hospital_count) cohort_hospital_count
from cells p cross join thr t join csc c on c.care_site_level = {q(o.care_site_level)}
left join cso_cnt k on k.param_id = p.param_id"""
    return ctes, final


def grid_parameters(name: str, s: C.Study = C.DEFAULT_STUDY) -> str:
    ctes, _, _ = outcome_ctes(name, s)
    final = """select param_id, start_observation_date, round(max_error, 9) max_error, round(min_c_0, 9) min_c_0,
       max_error_label, min_c_0_label from cells"""
    return with_ctes(ctes, final)
