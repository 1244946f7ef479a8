"""DuckDB SQL oracle: an independent, plain-SQL statement of every registered query.

Each query is one ``WITH`` statement over the raw test tables (registered as
views by the checker). The CTEs restate the surrogate warehouse, the
preparation, the outcomes, probes, model fits, stability and the grid in
ordinary SQL (window ``row_number`` for as-of and first-event, ``GROUPING SETS``
for the "All" site, a cross join for the parameter cells) so that the Spark
DataFrame implementation is checked against a different formulation.
"""

from __future__ import annotations

from tempovar import config as C

UF = C.LEVEL_DEPARTMENT
UH = C.LEVEL_UNIT
H = C.LEVEL_HOSPITAL
NS_RANGE = "TIMESTAMP '1677-09-21 00:12:43.145224' and TIMESTAMP '2262-04-11 23:47:16.854775'"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def in_range(c: str) -> str:
    return f"({c} is null or {c} between {NS_RANGE})"


def rx(c: str, regex: str, case: bool = False) -> str:
    if regex == C.CONSULTATION_NOTE_TYPE_REGEX:
        # DuckDB's regex engine has no lookahead (trap T2): "CR-CONS" not followed by "-".
        return f"coalesce(upper({c}) like '%CR-CONS%' and upper({c}) not like '%CR-CONS-%', false)"
    flags = "" if case else "(?i)"
    return f"coalesce(regexp_matches({c}, {q(flags + regex)}), false)"


def age(later: str, earlier: str) -> str:
    return (f"cast(year({later}) - year({earlier}) - "
            f"cast(strftime({later}, '%m-%d') < strftime({earlier}, '%m-%d') as integer) as integer)")


# ---------------------------------------------------------------- surrogate views
VIEWS = {
    "ln": """select l_orderkey k, l_linenumber n, l_suppkey sk, l_partkey pk, l_returnflag rf,
       (l_orderkey*10+l_linenumber)*100 - 1 + row_number() over (partition by l_orderkey, l_linenumber
         order by l_partkey nulls first, l_suppkey nulls first, l_quantity nulls first, l_extendedprice nulls first,
           l_discount nulls first, l_tax nulls first, l_returnflag nulls first, l_linestatus nulls first,
           l_shipdate nulls first) id
from lineitem""",
    "care_site": f"""select cast(1000+n_nationkey as bigint) care_site_id, {q(H)} care_site_type_source_value,
       n_name care_site_short_name, cast(null as varchar) place_of_service_source_value from nation
union all select 2000000+s_suppkey, {q(UF)}, s_name, 'DEPARTEMENT' from supplier
union all select 3000000+s_suppkey, {q(UH)}, s_name,
       case s_suppkey%5 when 0 then 'REA MED' when 1 then 'USI CARDIO' when 2 then 'SC POLY'
                        when 3 then 'MEDECINE' else 'CHIRURGIE' end from supplier""",
    "visit_occurrence": """select o_orderkey visit_occurrence_id, concat('V',o_orderkey) visit_occurrence_source_value,
       o_custkey person_id, cast(1000+o_orderkey%25 as bigint) care_site_id, o_orderdate visit_start_datetime,
       case when o_orderkey%53=0 then null else o_orderdate+to_days(cast(o_orderkey%7 as int)) end visit_end_datetime,
       case when o_orderpriority in ('1-URGENT','2-HIGH') then 'urgence' else 'hospitalisés' end visit_source_value,
       case when o_orderkey%10=0 then 'SSR' else 'MCO' end stay_source_value,
       case when o_orderkey%20<>1 and o_orderdate >= date '1995-01-01' + to_months(cast(3*(o_orderkey%25) as int))
         then 'ORBIS' else 'OTHER' end cdm_source,
       case when o_orderkey%31=0 then 'supprimé' else 'Actif' end row_status_source_value
from orders""",
    "visit_detail": """select id visit_detail_id, o_orderdate+to_days(n) visit_detail_start_datetime, k visit_occurrence_id,
       case when n%2=0 then 'RUM' else 'UH' end visit_detail_type_source_value,
       cast(case when n%2=0 then 2000000 else 3000000 end+sk as bigint) care_site_id,
       case when n=7 then 'Inactif' else 'Actif' end row_status_source_value
from ln join orders on k=o_orderkey""",
    "condition_occurrence": """select k visit_occurrence_id, case when n%2=0 then id end visit_detail_id, 'ORBIS' cdm_source,
       case rf when 'A' then 'DP' when 'N' then 'DR' else 'DAS' end condition_status_source_value,
       case pk%8 when 0 then 'J210' when 1 then 'J09' when 2 then 'J101' when 3 then 'J110' when 4 then 'A090'
                 when 5 then 'J00' when 6 then 'I10' else 'E11' end condition_source_value,
       o_orderdate condition_start_datetime
from ln join orders on k=o_orderkey""",
    "note": """select id note_id, o_custkey person_id, k visit_occurrence_id, o_orderdate+to_days(n) note_datetime,
       case p_type when 'PROMO' then 'CR-CONS' when 'ECONOMY' then 'CR-CONS-ANESTH' when 'SMALL' then 'ORDO'
                   else 'CR-HOSP' end note_class_source_value,
       'Actif' row_status_source_value, case when id%37=0 then null else p_name end note_text, 'ORBIS' cdm_source
from ln join orders on k=o_orderkey join part on pk=p_partkey""",
    "person": """select c_custkey person_id, timestamp '1930-01-01'+to_days(cast(c_custkey*7919%25000 as int)) birth_datetime,
       case when c_custkey%17=0 then timestamp '2002-01-01'+to_days(cast(c_custkey%300 as int)) end death_datetime,
       case when c_custkey%2=0 then 'f' else 'm' end gender_source_value,
       case when c_custkey%29=0 then 'Inactif' else 'Actif' end status_source_value, 'ORBIS' cdm_source
from customer""",
    "note_ref": "select id note_id, concat('UF',sk) ufr_source_value, concat('US',sk) us_source_value from ln",
    "care_site_ref": """select concat('UF',s_suppkey) care_site_source_value, cast(2000000+s_suppkey as bigint) care_site_id from supplier
union all select concat('US',s_suppkey), 3000000+s_suppkey from supplier""",
    "orbis_visite_calc": "select o_orderkey ids_eds, concat('E',o_orderkey) ids_eds_crypt from orders",
    "i2b2_observation_fact_ghm": """select concat('E',o_orderkey) encounter_num,
       concat('GHM:',lpad(cast(1+o_orderkey%28 as varchar),2,'0'),'M0',cast(o_orderkey%4 as varchar)) concept_cd,
       'AREM' sourcesystem_cd from orders where o_orderkey%9<>0
union all
select concat('E',o_orderkey), concat('GHM:',lpad(cast(1+(o_orderkey+7)%28 as varchar),2,'0'),'C09'), 'AREM'
from orders where o_orderkey%41=0""",
    "arem_visit_occurrence": "select -o_orderkey visit_occurrence_id, concat('V',o_orderkey) visit_occurrence_source_value from orders",
    "arem_condition_occurrence": """select -k visit_occurrence_id, 'AREM' cdm_source,
       case rf when 'A' then 'DP' when 'N' then 'DR' else 'DAS' end condition_status_source_value,
       case pk%8 when 0 then 'J210' when 1 then 'J09' when 2 then 'J101' when 3 then 'J110' when 4 then 'A090'
                 when 5 then 'J00' when 6 then 'I10' else 'E11' end condition_source_value,
       o_orderdate condition_start_datetime
from ln join orders on k=o_orderkey""",
}


def cmd_values() -> str:
    rows = ", ".join(f"({q(k)}, {q(v)})" for k, v in sorted(C.CMD_MAP.items()))
    return f"select * from (values {rows}) t(CMD_code, CMD)"


def prepared(study: C.Study = C.DEFAULT_STUDY) -> dict[str, str]:
    s = study
    return {
        "cs": """select care_site_id, care_site_type_source_value care_site_level, care_site_short_name,
       place_of_service_source_value service_type from care_site""",
        "vo": f"""select visit_occurrence_id, visit_occurrence_source_value, person_id, care_site_id,
       visit_start_datetime, visit_end_datetime, visit_source_value stay_type, stay_source_value stay_source
from visit_occurrence
where coalesce(row_status_source_value <> {q(C.STATUS_DELETED)}, true) and cdm_source = 'ORBIS'
  and {in_range('visit_start_datetime')} and {in_range('visit_end_datetime')}""",
        "vd": f"""select d.visit_detail_id, d.visit_detail_start_datetime, d.visit_occurrence_id,
       d.visit_detail_type_source_value transfer_type, d.care_site_id detail_care_site_id,
       c.care_site_level detail_care_site_level
from visit_detail d join cs c on c.care_site_id = d.care_site_id
where d.row_status_source_value = 'Actif' and {in_range('d.visit_detail_start_datetime')}""",
        "pe": f"""select person_id, birth_datetime, death_datetime, gender_source_value from person
where status_source_value = 'Actif' and cdm_source = 'ORBIS'
  and {in_range('birth_datetime')} and {in_range('death_datetime')}""",
        "nt": """select note_id, person_id, visit_occurrence_id, note_datetime, note_class_source_value note_type
from note where row_status_source_value = 'Actif' and note_text is not null and cdm_source = 'ORBIS'""",
        "ncs": f"""select distinct r.note_id, c.care_site_id detail_care_site_id, c.care_site_level detail_care_site_level
from (select note_id, ufr_source_value v from note_ref union all select note_id, us_source_value from note_ref) r
join care_site_ref f on f.care_site_source_value = r.v
join cs c on c.care_site_id = f.care_site_id
where c.care_site_level = {q(UF)}""",
        "cmd": cmd_values(),
        "ghm": """select distinct g.visit_occurrence_id, g.GHM_code, m.CMD_code, m.CMD from (
  select l.ids_eds visit_occurrence_id, nullif(split_part(f.concept_cd, ':', 2), '') GHM_code
  from i2b2_observation_fact_ghm f left join orbis_visite_calc l on l.ids_eds_crypt = f.encounter_num
  where f.sourcesystem_cd = 'AREM') g
join cmd m on m.CMD_code = substr(g.GHM_code, 1, 2)""",
        "cond": f"""select visit_occurrence_id, visit_detail_id, condition_status_source_value diag_type,
       condition_source_value, condition_start_datetime
from condition_occurrence where cdm_source = 'ORBIS' and {rx('condition_status_source_value', C.DIAG_REGEX, True)}""",
        "cohort": f"""select v.visit_occurrence_id visit_cohort_id, v.visit_occurrence_source_value, v.person_id, v.care_site_id,
       v.visit_start_datetime cohort_stay_start, v.visit_end_datetime cohort_stay_end, v.stay_type, v.stay_source,
       g.GHM_code, g.CMD_code, g.CMD, cast(date_trunc('month', v.visit_start_datetime) as date) sub_cohort,
       p.birth_datetime, p.death_datetime, p.gender_source_value,
       {age(f"coalesce(p.death_datetime, TIMESTAMP '{s.as_of}')", 'p.birth_datetime')} age_today,
       {age('v.visit_start_datetime', 'p.birth_datetime')} age_at_stay
from vo v left join ghm g on g.visit_occurrence_id = v.visit_occurrence_id
join pe p on p.person_id = v.person_id
where {rx('v.stay_type', C.HOSPIT_STAY_TYPE_REGEX)} and {rx('v.stay_source', C.HOSPIT_STAY_SOURCE_REGEX)}
  and v.visit_start_datetime >= TIMESTAMP '{s.cohort_start}' and v.visit_start_datetime < TIMESTAMP '{s.end_date}'""",
    }


def _first(inner: str, order: str) -> str:
    return (f"select * exclude (rn_) from (select x.*, row_number() over (partition by visit_occurrence_id "
            f"order by {order}) rn_ from ({inner}) x) where rn_ = 1")


def outcomes() -> dict[str, str]:
    persons = "(select person_id from cohort)"
    stays4 = "(select distinct person_id, visit_cohort_id visit_occurrence_id, care_site_id, cohort_stay_start from cohort)"
    out = {
        "hospit_visit": f"""select visit_occurrence_id, person_id, care_site_id, visit_start_datetime from vo
where {rx('stay_type', C.HOSPIT_STAY_TYPE_REGEX)} and {rx('stay_source', C.HOSPIT_STAY_SOURCE_REGEX)}
  and person_id in {persons}""",
        "emergency_visit": f"""select visit_occurrence_id, person_id, care_site_id, visit_start_datetime from vo
where {rx('stay_type', C.EMERGENCY_STAY_TYPE_REGEX)} and {rx('stay_source', C.EMERGENCY_STAY_SOURCE_REGEX)}
  and person_id in {persons}""",
        # CR-CONS not followed by '-': DuckDB's regex engine has no lookahead (trap T2).
        "cn1": _first("select * from nt where upper(note_type) like '%CR-CONS%' and upper(note_type) not like '%CR-CONS-%'",
                      "note_datetime nulls last, note_id"),
        "consultation_note": f"""select c.visit_occurrence_id, c.person_id, c.note_datetime, c.note_type,
       s.detail_care_site_id, s.detail_care_site_level, v.care_site_id, v.visit_start_datetime
from cn1 c join ncs s on s.note_id = c.note_id left join vo v on v.visit_occurrence_id = c.visit_occurrence_id
where {in_range('c.note_datetime')} and c.person_id in {persons}""",
        "pn1": _first(f"select * from nt where {rx('note_type', C.PRESCRIPTION_NOTE_TYPE_REGEX)}",
                      "note_datetime nulls last, note_id"),
        "prescription_note": f"""select s.visit_occurrence_id, s.care_site_id, s.cohort_stay_start, n.person_id, n.note_datetime,
       n.note_type, c.detail_care_site_id, c.detail_care_site_level
from (select distinct visit_cohort_id visit_occurrence_id, care_site_id, cohort_stay_start from cohort) s
join pn1 n on n.visit_occurrence_id = s.visit_occurrence_id
join ncs c on c.note_id = n.note_id
where {in_range('n.note_datetime')}""",
        "icu_visit": _first(f"""select v.visit_occurrence_id, v.person_id, d.detail_care_site_id, v.care_site_id,
       v.visit_start_datetime, v.stay_type, d.visit_detail_id, d.visit_detail_start_datetime, d.transfer_type,
       d.detail_care_site_level, c.service_type
from vo v join vd d on d.visit_occurrence_id = v.visit_occurrence_id
join cs c on c.care_site_id = d.detail_care_site_id
where {rx('c.service_type', C.ICU_REGEX)} and v.person_id in {persons}""",
                            "visit_detail_start_datetime nulls last, visit_detail_id"),
    }
    for name, regex in C.CONDITION_REGEXES.items():
        first = _first(f"select * from cond where {rx('condition_source_value', regex)}",
                       "condition_start_datetime nulls last, visit_detail_id nulls first, diag_type nulls first, "
                       "condition_source_value nulls first")
        out[name] = f"""select s.person_id, s.visit_occurrence_id, s.care_site_id, s.cohort_stay_start, c.visit_detail_id,
       c.diag_type, c.condition_source_value, c.condition_start_datetime, d.detail_care_site_id,
       d.visit_detail_start_datetime, d.transfer_type, d.detail_care_site_level
from {stays4} s join ({first}) c on c.visit_occurrence_id = s.visit_occurrence_id
left join (select * from vd where transfer_type = 'RUM') d on d.visit_detail_id = c.visit_detail_id"""
    return out


# ---------------------------------------------------------------- probes
def _window(col: str, s: C.Study) -> str:
    return f"{col} >= TIMESTAMP '{s.probe_start}' and {col} < TIMESTAMP '{s.end_date}'"


def _fan(src: str, label: str, column: str, sets: dict, case: bool = False) -> str:
    parts = [f"select r.*, {q(name)} {label} from ({src}) r where {rx(f'coalesce({column}, {chr(39)}{chr(39)})', regex, case)}"
             for name, regex in sets.items()]
    return " union all ".join(parts)


def _months(s: C.Study) -> str:
    return (f"select cast(d as date) date from generate_series(DATE '{s.probe_start}', "
            f"DATE '{s.last_month}', INTERVAL 1 MONTH) t(d)")


def _zero_fill(counts: str, index: list[str], ns: list[str], s: C.Study) -> str:
    idx = ", ".join(index)
    on = " and ".join(f"k.{c} is not distinct from g.{c}" for c in index)
    nsel = ", ".join(f"coalesce(k.{n}, 0) {n}" for n in ns)
    gsel = ", ".join(f"g.{c}" for c in index)
    return f"""select {gsel}, g.date, {nsel} from
  (select * from (select distinct {idx} from ({counts})) i cross join ({_months(s)}) m) g
  left join ({counts}) k on {on} and k.date = g.date"""


def _normalised(filled: str, index: list[str], n: str) -> str:
    idx = ", ".join(index)
    return f"""select *, case when max({n}) over (partition by {idx}) > 0
       then {n} / cast(max({n}) over (partition by {idx}) as double) else 0.0 end c from ({filled})"""


SITE = ["care_site_level", "care_site_id", "care_site_short_name"]


def _site_rows(visits: str, levels: list[str]) -> str:
    parts = []
    if H in levels:
        parts.append(f"select visit_occurrence_id, care_site_id from ({visits})")
    det = [lv for lv in levels if lv != H]
    if det:
        lv = ", ".join(q(x) for x in det)
        parts.append(f"""select d.visit_occurrence_id, d.detail_care_site_id care_site_id from vd d
where d.detail_care_site_level in ({lv}) and d.visit_occurrence_id in (select visit_occurrence_id from ({visits}))""")
    lvs = ", ".join(q(x) for x in levels)
    return f"""select s.visit_occurrence_id, c.care_site_level, c.care_site_id, c.care_site_short_name, c.service_type
from (select distinct * from ({' union all '.join(parts)})) s join cs c on c.care_site_id = s.care_site_id
where c.care_site_level in ({lvs})"""


def visit_probe(s: C.Study = C.DEFAULT_STUDY, levels=None, sets=None) -> str:
    levels = levels or C.CARE_SITE_LEVELS
    sets = sets or C.VISIT_SPECIALTIES_SETS
    vwin = f"select * from vo where {_window('visit_start_datetime', s)}"
    rows = f"""select r.*, v.stay_type, v.visit_start_datetime from ({_site_rows(vwin, levels)}) r
join ({vwin}) v on v.visit_occurrence_id = r.visit_occurrence_id"""
    fan = _fan(rows, "specialties_set", "service_type", sets)
    index = SITE + ["stay_type", "specialties_set"]
    counts = f"""select {', '.join(index)}, cast(date_trunc('month', visit_start_datetime) as date) date,
       count(distinct visit_occurrence_id) n_visit from ({fan}) group by all"""
    return _normalised(_zero_fill(counts, index, ["n_visit"], s), index, "n_visit")


def note_probe(s: C.Study = C.DEFAULT_STUDY) -> str:
    notes = f"""select n.note_id, n.visit_occurrence_id, n.note_datetime, n.note_type, v.stay_type,
       v.care_site_id visit_care_site_id from nt n left join vo v on v.visit_occurrence_id = n.visit_occurrence_id
where {_window('n.note_datetime', s)}"""
    rows = f"""select n.note_id, n.note_datetime, n.note_type, n.stay_type, n.visit_care_site_id care_site_id from ({notes}) n
union all select n.note_id, n.note_datetime, n.note_type, n.stay_type, c.detail_care_site_id from ({notes}) n
join ncs c on c.note_id = n.note_id"""
    rows = f"""select r.note_id, r.note_datetime, r.note_type raw_note_type, r.stay_type raw_stay_type, c.care_site_level,
       c.care_site_id, c.care_site_short_name from ({rows}) r join cs c on c.care_site_id = r.care_site_id"""
    fan = _fan(_fan(rows, "stay_type", "raw_stay_type", C.NOTE_STAY_TYPES), "note_type", "raw_note_type", C.NOTE_TYPES)
    index = SITE + ["stay_type", "note_type"]
    counts = f"""select {', '.join(index)}, cast(date_trunc('month', note_datetime) as date) date,
       count(distinct note_id) n_note from ({fan}) group by all"""
    return _normalised(_zero_fill(counts, index, ["n_note"], s), index, "n_note")


def _site_visits(s: C.Study, stay_types: dict) -> str:
    vwin = f"select * from vo where {_window('visit_start_datetime', s)}"
    rows = f"""select r.visit_occurrence_id, r.care_site_level, r.care_site_id, r.care_site_short_name,
       v.stay_type raw_stay_type, cast(date_trunc('month', v.visit_start_datetime) as date) date
from ({_site_rows(vwin, C.CARE_SITE_LEVELS)}) r join ({vwin}) v on v.visit_occurrence_id = r.visit_occurrence_id"""
    return _fan(rows, "stay_type", "raw_stay_type", stay_types)


def _per_visit(site_visits: str, flagged: str, labels: list[str], combos: str, n_name: str, s: C.Study) -> str:
    base = SITE + ["stay_type"]
    index = base + labels
    b = ", ".join(base)
    den = f"""select d.*, l.* from (select {b}, date, count(distinct visit_occurrence_id) n_visit
  from ({site_visits}) group by all) d cross join ({combos}) l"""
    hit = f"""select {', '.join('v.' + c for c in base)}, {', '.join('f.' + c for c in labels)}, v.date,
       count(distinct v.visit_occurrence_id) {n_name}
from ({site_visits}) v join ({flagged}) f on f.visit_occurrence_id = v.visit_occurrence_id group by all"""
    on = " and ".join(f"d.{c} is not distinct from h.{c}" for c in index)
    counts = f"""select {', '.join('d.' + c for c in index)}, d.date, d.n_visit, coalesce(h.{n_name}, 0) {n_name}
from ({den}) d left join ({hit}) h on {on} and d.date = h.date"""
    filled = _zero_fill(counts, index, ["n_visit", n_name], s)
    return f"select *, case when n_visit > 0 then {n_name} / cast(n_visit as double) else 0.0 end c from ({filled})"


def note_per_visit_probe(s: C.Study = C.DEFAULT_STUDY) -> str:
    flagged = "select distinct visit_occurrence_id, note_type from (" + \
              _fan("select visit_occurrence_id, note_type raw from nt", "note_type", "raw", C.NOTE_TYPES) + ")"
    combos = " union all ".join(f"select {q(k)} note_type" for k in C.NOTE_TYPES)
    return _per_visit(_site_visits(s, C.NOTE_STAY_TYPES), flagged, ["note_type"], combos, "n_visit_with_note", s)


def _conditions_by_source() -> str:
    core = """select visit_occurrence_id, visit_detail_id, condition_status_source_value, condition_source_value,
       condition_start_datetime, 'ORBIS' source_system from condition_occurrence where cdm_source = 'ORBIS'"""
    arem = """select v.visit_occurrence_id, cast(null as bigint) visit_detail_id, c.condition_status_source_value,
       c.condition_source_value, c.condition_start_datetime, 'AREM' source_system
from arem_visit_occurrence a join arem_condition_occurrence c on c.visit_occurrence_id = a.visit_occurrence_id
join vo v on v.visit_occurrence_source_value = a.visit_occurrence_source_value
where c.cdm_source = 'AREM'"""
    rows = f"{core} union all {arem}"
    rows = _fan(rows, "condition_type", "condition_source_value", C.CONDITION_TYPES)
    return _fan(rows, "diag_type", "condition_status_source_value", C.CONDITION_DIAG_TYPES, case=True)


def condition_probe(s: C.Study = C.DEFAULT_STUDY) -> str:
    labels = ["condition_type", "diag_type", "source_system"]
    flagged = f"select distinct visit_occurrence_id, {', '.join(labels)} from ({_conditions_by_source()})"
    combos = " union all ".join(
        f"select {q(ct)} condition_type, {q(dt)} diag_type, {q(ss)} source_system"
        for ct in C.CONDITION_TYPES for dt in C.CONDITION_DIAG_TYPES for ss in C.CONDITION_SOURCE_SYSTEMS)
    return _per_visit(_site_visits(s, C.CONDITION_STAY_TYPES), flagged, labels, combos, "n_visit_with_condition", s)


def condition_per_condition_probe(s: C.Study = C.DEFAULT_STUDY) -> str:
    conds = f"""select c.*, v.stay_type raw_stay_type, v.care_site_id visit_care_site_id
from ({_conditions_by_source()}) c join vo v on v.visit_occurrence_id = c.visit_occurrence_id
where {_window('c.condition_start_datetime', s)}"""
    rows = f"""select c.*, c.visit_care_site_id site from ({conds}) c
union all select c.*, d.detail_care_site_id from ({conds}) c join vd d on d.visit_detail_id = c.visit_detail_id"""
    lvs = ", ".join(q(x) for x in C.CARE_SITE_LEVELS)
    rows = f"""select r.*, s.care_site_level, s.care_site_id, s.care_site_short_name from ({rows}) r
join cs s on s.care_site_id = r.site where s.care_site_level in ({lvs})"""
    fan = _fan(rows, "stay_type", "raw_stay_type", C.CONDITION_STAY_TYPES)
    index = SITE + ["stay_type", "condition_type", "diag_type", "source_system"]
    counts = f"""select {', '.join(index)}, cast(date_trunc('month', condition_start_datetime) as date) date,
       count(*) n_condition from ({fan}) group by all"""
    return _normalised(_zero_fill(counts, index, ["n_condition"], s), index, "n_condition")


# ---------------------------------------------------------------- models
def step_fit(pred: str, index: list[str]) -> str:
    idx = ", ".join(index)
    cand = f"""select {idx}, date, s_ / n_ c_0, (q_ - s_ * s_ / n_) / t_ error from (
  select {idx}, date,
    sum(c * c) over (partition by {idx}) q_, count(*) over (partition by {idx}) t_,
    sum(c) over (partition by {idx} order by date desc rows between unbounded preceding and current row) s_,
    count(*) over (partition by {idx} order by date desc rows between unbounded preceding and current row) n_
  from ({pred}))"""
    return f"""select {idx}, date t_0, c_0, error from (
  select *, row_number() over (partition by {idx} order by round(error, 12), date) rn_ from ({cand})) where rn_ = 1"""


def rectangle_fit(pred: str, index: list[str]) -> str:
    idx = ", ".join(index)
    base = f"""select {idx}, date, c, sum(c) over (partition by {idx} order by date rows between unbounded preceding and current row) p_,
       row_number() over (partition by {idx} order by date) i_,
       sum(c * c) over (partition by {idx}) q_, count(*) over (partition by {idx}) t_ from ({pred})"""
    on = " and ".join(f"a.{c} is not distinct from b.{c}" for c in index)
    pairs = f"""select {', '.join('b.' + c for c in index)}, a.date t_0, b.date t_1,
       (b.p_ - a.p_ + a.c) / (b.i_ - a.i_ + 1) c_0,
       (b.q_ - (b.p_ - a.p_ + a.c) * (b.p_ - a.p_ + a.c) / (b.i_ - a.i_ + 1)) / b.t_ error
from ({base}) a join ({base}) b on {on} and a.i_ <= b.i_"""
    return f"""select {idx}, t_0, t_1, c_0, error from (
  select *, row_number() over (partition by {idx} order by round(error, 12), t_0, t_1) rn_ from ({pairs})) where rn_ = 1"""


PROBE_INDEX = {
    "visit": SITE + ["stay_type", "specialties_set"],
    "note": SITE + ["stay_type", "note_type"],
    "note_per_visit": SITE + ["stay_type", "note_type"],
    "condition": SITE + ["stay_type", "condition_type", "diag_type", "source_system"],
}


def estimates(name: str, s: C.Study = C.DEFAULT_STUDY) -> str:
    if name == "visit":
        return step_fit(visit_probe(s), PROBE_INDEX["visit"])
    if name == "icu_rectangle":
        return rectangle_fit(visit_probe(s, [UH], C.ICU_SPECIALTIES_SETS), PROBE_INDEX["visit"])
    if name == "note":
        return step_fit(note_probe(s), PROBE_INDEX["note"])
    if name == "note_per_visit":
        return step_fit(note_per_visit_probe(s), PROBE_INDEX["note_per_visit"])
    if name == "condition":
        return step_fit(condition_probe(s), PROBE_INDEX["condition"])
    if name == "condition_per_condition":
        return step_fit(condition_per_condition_probe(s), PROBE_INDEX["condition"])
    raise ValueError(name)


def with_ctes(ctes: dict[str, str], final: str, recursive: bool = False) -> str:
    body = ",\n".join(f"{k} AS (\n{v}\n)" for k, v in ctes.items())
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}\n{final}"


def base_ctes(study: C.Study = C.DEFAULT_STUDY) -> dict[str, str]:
    ctes = dict(VIEWS)
    ctes.update(prepared(study))
    ctes.update(outcomes())
    return ctes
