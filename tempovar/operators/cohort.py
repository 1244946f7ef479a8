"""Cohort and outcome tables (I12; C3-C9, C12, B16-B18, D13).

``cohort_selection`` returns lazy DataFrames; the caller decides what to write
or persist. Membership joins on persons or stays are semi joins, so a person
never multiplies event rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import DEFAULT_STUDY, Study
from ..functions.dates import years_between_birthdays
from ..functions.text import contains_regex
from ..sources.tables import Tables
from . import extract as X


def stay_filter(visits: DataFrame, stay_type_regex: str, stay_source_regex: str) -> DataFrame:
    """Stay type and stay source, both case-insensitive contains."""
    return X.filter_event(X.filter_event(visits, "stay_type", stay_type_regex), "stay_source", stay_source_regex)


def add_patient_info(visit: DataFrame, person: DataFrame, as_of: str) -> DataFrame:
    """C12 + H5 + H6: inner join to persons (drops filtered-out persons) and ages.

    ``age_today`` runs to the death date, else to the ``as_of`` parameter (trap T18).
    """
    today = F.lit(as_of).cast("timestamp_ntz")
    person = person.withColumn(
        "age_today", years_between_birthdays(F.coalesce(F.col("death_datetime"), today), F.col("birth_datetime")))
    out = visit.join(person, "person_id")
    return out.withColumn("age_at_stay", years_between_birthdays("cohort_stay_start", "birth_datetime"))


@dataclass
class Prepared:
    """The cleaned tables, each built where it is first asked for. ``keep(name, build)`` may store one that several steps read."""

    core: Tables
    reference: Tables
    claims: Tables
    condition_source_system: str = C.SOURCE_CORE
    keep: Callable[[str, Callable[[], DataFrame]], DataFrame] | None = None

    @cached_property
    def care_site(self) -> DataFrame:
        return X.prepare_care_site(self.core.care_site)

    @cached_property
    def visit_occurrence(self) -> DataFrame:
        return X.prepare_visit_occurrence(self.core)

    @cached_property
    def valid_details(self) -> DataFrame:
        return X.valid_details(self.core)

    @cached_property
    def visit_detail(self) -> DataFrame:
        return X.prepare_visit_detail(self.core, self.care_site)

    @cached_property
    def person(self) -> DataFrame:
        return X.prepare_person(self.core)

    @cached_property
    def note(self) -> DataFrame:
        return X.prepare_note(self.core)

    @cached_property
    def note_care_site(self) -> DataFrame:
        if not self.keep:
            return X.prepare_note_care_site(self.reference, self.care_site)
        codes = self.keep("department_codes", lambda: X.department_codes(self.reference, self.care_site))
        return self.keep("note_care_site", lambda: X.prepare_note_care_site(self.reference, self.care_site, codes))

    @cached_property
    def ghm(self) -> DataFrame:
        return X.prepare_ghm(self.claims)

    @cached_property
    def condition_occurrence(self) -> DataFrame:
        return X.prepare_condition_occurrence(self.core, self.claims, self.visit_occurrence, self.condition_source_system)

    @cached_property
    def conditions_by_source(self) -> DataFrame:
        """Conditions of both sources, before the role filter, with ``source_system``."""
        return _conditions_by_source(self.core, self.claims, self.visit_occurrence)

    def condition_labels(self, bits: Column) -> DataFrame:
        """Per visit and source, the union of its conditions' label bits (``_labels``, none are left out). Claims are
        united by their own visit before that is linked to the core visit."""
        def united(rows: DataFrame, source: str) -> DataFrame:
            return (rows.withColumn("source_system", F.lit(source)).select("visit_occurrence_id", bits.alias("_labels")).where("_labels <> 0")
                    .groupBy("visit_occurrence_id").agg(F.bit_or("_labels").alias("_labels")))
        rows = united(X.core_condition(self.core, C.SOURCE_CORE), C.SOURCE_CORE)
        if self.claims is not None and "condition_occurrence" in self.claims:
            arem = united(X.claims_rows(self.claims, C.SOURCE_CLAIMS), C.SOURCE_CLAIMS)
            rows = rows.unionByName(X.to_core_visits(arem, self.claims, self.visit_occurrence))
        return rows


def prepare(core: Tables, reference: Tables, claims: Tables, condition_source_system: str = C.SOURCE_CORE,
            keep: Callable[[str, Callable[[], DataFrame]], DataFrame] | None = None) -> Prepared:
    return Prepared(core, reference, claims, condition_source_system, keep)


def _conditions_by_source(core: Tables, claims: Tables | None, visit: DataFrame) -> DataFrame:
    cols = ["visit_occurrence_id", "visit_detail_id", "condition_status_source_value", "condition_source_value",
            "condition_start_datetime"]
    rows = X.core_condition(core, C.SOURCE_CORE).select(*cols).withColumn("source_system", F.lit(C.SOURCE_CORE))
    if claims is not None and "condition_occurrence" in claims:
        arem = X.claims_condition(claims, visit, C.SOURCE_CLAIMS).select(*cols)
        rows = rows.unionByName(arem.withColumn("source_system", F.lit(C.SOURCE_CLAIMS)))
    return rows


def cohort_visit(p: Prepared, study: Study = DEFAULT_STUDY) -> DataFrame:
    """Cohort stays: B18, C3 (a stay with several GHM codes becomes several rows, T6), B7, C12."""
    stays = stay_filter(p.visit_occurrence, C.HOSPIT_STAY_TYPE_REGEX, C.HOSPIT_STAY_SOURCE_REGEX)
    stays = (stays.join(p.ghm, "visit_occurrence_id", "left")
             .withColumnRenamed("visit_start_datetime", "cohort_stay_start")
             .withColumnRenamed("visit_end_datetime", "cohort_stay_end")
             .withColumnRenamed("visit_occurrence_id", "visit_cohort_id"))
    stays = X.filter_date(stays, study.cohort_start, study.end_date)
    return add_patient_info(stays, p.person, study.as_of)


NOTE_COLS = ["note_id", "person_id", "visit_occurrence_id", "note_datetime", "note_type"]


def _cohort_persons(cohort: DataFrame) -> DataFrame:
    """C4: each person once, so the side of the semi join is small before it is shuffled or broadcast."""
    return cohort.select("person_id").distinct()


def visit_outcome(p: Prepared, cohort: DataFrame, stay_type_regex: str, stay_source_regex: str) -> DataFrame:
    """hospit_visit / emergency_visit: B18, projection, C4 (semi join on cohort persons)."""
    v = stay_filter(p.visit_occurrence, stay_type_regex, stay_source_regex)
    v = v.select("visit_occurrence_id", "person_id", "care_site_id", "visit_start_datetime")
    return v.join(_cohort_persons(cohort), "person_id", "left_semi")


def consultation_note(p: Prepared, cohort: DataFrame) -> DataFrame:
    """B3, D3, B6, C4, C6 (inner to note sites), C7 (left to visits)."""
    # project before the first-event aggregate: the note text never enters the shuffle
    n = X.filter_note_type(p.note, C.CONSULTATION_NOTE_TYPE_REGEX).select(*NOTE_COLS)
    n = X.first_event(n, "note_datetime", tie_break=["note_id"])
    n = X.clean_date(n, "note_datetime")
    n = n.select("person_id", "visit_occurrence_id", "note_datetime", "note_id", "note_type")
    n = n.join(_cohort_persons(cohort), "person_id", "left_semi")
    n = n.join(p.note_care_site, "note_id").drop("note_id")
    visits = p.visit_occurrence.select("visit_occurrence_id", "care_site_id", "visit_start_datetime")
    return n.join(visits, "visit_occurrence_id", "left")


def _cohort_stays(cohort: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct stay-level columns of the cohort (D13), the stay id named ``visit_occurrence_id``."""
    return (cohort.select(*cols).withColumnRenamed("visit_cohort_id", "visit_occurrence_id").distinct())


def prescription_note(p: Prepared, cohort: DataFrame) -> DataFrame:
    """B3, D3, B6, C5 (inner to distinct cohort stays), C6."""
    n = X.filter_note_type(p.note, C.PRESCRIPTION_NOTE_TYPE_REGEX).select(*NOTE_COLS)
    n = X.first_event(n, "note_datetime", tie_break=["note_id"])
    n = X.clean_date(n, "note_datetime")
    n = n.select("person_id", "visit_occurrence_id", "note_datetime", "note_type", "note_id")
    stays = _cohort_stays(cohort, ["visit_cohort_id", "care_site_id", "cohort_stay_start"])
    out = stays.join(n, "visit_occurrence_id")
    return out.join(p.note_care_site, "note_id").drop("note_id")


def icu_visit(p: Prepared, cohort: DataFrame) -> DataFrame:
    """B17, C9 (visit x detail x ICU units), C4, D3 on the detail start."""
    icu_sites = X.icu_care_sites(p.care_site)
    v = p.visit_occurrence.select("visit_occurrence_id", "person_id", "care_site_id",
                                  "visit_start_datetime", "stay_type")
    # details of other sites go before a row is shuffled
    details = p.visit_detail.join(icu_sites, "detail_care_site_id").select(*p.visit_detail.columns, "service_type")
    out = v.join(details, "visit_occurrence_id").select("detail_care_site_id", *v.columns, *[c for c in details.columns if c not in ("detail_care_site_id", "visit_occurrence_id")])
    out = out.join(_cohort_persons(cohort), "person_id", "left_semi")
    return X.first_event(out, "visit_detail_start_datetime", tie_break=["visit_detail_id"])


def condition_outcomes(p: Prepared, cohort: DataFrame, regexes: Mapping[str, str],
                       condition_source_system: str = C.SOURCE_CORE) -> DataFrame:
    """B2 on the code, D3, C5, C8 (left to RUM details, core source only), for all conditions in one pass, told apart by
    ``outcome_name``: conditions and details are read and dealt once."""
    kinds = F.array(*[F.when(contains_regex("condition_source_value", regex), F.lit(name)) for name, regex in regexes.items()])
    c = p.condition_occurrence.withColumn("outcome_name", F.explode(kinds)).where(F.col("outcome_name").isNotNull())
    c = X.first_event(c, "condition_start_datetime",
                      tie_break=["visit_detail_id", "diag_type", "condition_source_value"], by=["outcome_name"])
    stays = _cohort_stays(cohort, ["person_id", "visit_cohort_id", "care_site_id", "cohort_stay_start"])
    out = stays.join(c, "visit_occurrence_id")
    if condition_source_system == C.SOURCE_CORE:
        out = out.join(X.condition_detail(p.visit_detail), "visit_detail_id", "left")
    return out


def condition_outcome(p: Prepared, cohort: DataFrame, name: str, condition_source_system: str = C.SOURCE_CORE) -> DataFrame:
    """One condition's table."""
    return condition_outcomes(p, cohort, {name: C.CONDITION_REGEXES[name]}, condition_source_system).drop("outcome_name")


def outcome_table(p: Prepared, cohort: DataFrame, name: str, condition_source_system: str = C.SOURCE_CORE) -> DataFrame:
    """One outcome table of a cohort (a stored one is read, not derived again)."""
    if name == "hospit_visit":
        return visit_outcome(p, cohort, C.HOSPIT_STAY_TYPE_REGEX, C.HOSPIT_STAY_SOURCE_REGEX)
    if name == "emergency_visit":
        return visit_outcome(p, cohort, C.EMERGENCY_STAY_TYPE_REGEX, C.EMERGENCY_STAY_SOURCE_REGEX)
    if name == "consultation_note":
        return consultation_note(p, cohort)
    if name == "prescription_note":
        return prescription_note(p, cohort)
    if name == "icu_visit":
        return icu_visit(p, cohort)
    if name in C.CONDITION_REGEXES:
        return condition_outcome(p, cohort, name, condition_source_system)
    raise ValueError(f"unknown outcome table {name!r}")


def cohort_selection(core: Tables, reference: Tables, claims: Tables, study: Study = DEFAULT_STUDY,
                     condition_source_system: str = C.SOURCE_CORE) -> dict[str, DataFrame]:
    """The cohort and its nine outcome tables, lazily."""
    p = prepare(core, reference, claims, condition_source_system)
    cohort = cohort_visit(p, study)
    return {name: cohort if name == "cohort_visit" else outcome_table(p, cohort, name, condition_source_system) for name in C.OUTCOME_TABLES}
