"""Cleaning and extraction of the warehouse tables.

Each function is DataFrame -> DataFrame; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.dates import in_ns_range
from ..functions.text import code_after_colon, contains_regex, prefix
from ..sources.tables import Tables, cmd_map


# ---- generic filters -------------------------------------------------------

def filter_event(df: DataFrame, column: str, regex: str) -> DataFrame:
    """Keep rows whose column contains the regex, case-insensitive; NULL is dropped (B2)."""
    return df.where(contains_regex(column, regex))


def filter_note_type(note: DataFrame, regex: str) -> DataFrame:
    """B2 on ``note_type``."""
    return filter_event(note, "note_type", regex)


def filter_diag(condition: DataFrame, regex: str = C.DIAG_REGEX) -> DataFrame:
    """Rename the status to ``diag_type`` and keep a case-sensitive contains match."""
    if "condition_status_source_value" in condition.columns:
        condition = condition.withColumnRenamed("condition_status_source_value", "diag_type")
    return condition.where(contains_regex("diag_type", regex, case=True))


def filter_source(df: DataFrame, source_system: str) -> DataFrame:
    """Keep one source system, drop the column."""
    return df.where(F.col("cdm_source") == source_system).drop("cdm_source")


def clean_date(df: DataFrame, column: str) -> DataFrame:
    """Drop dates outside the nanosecond range, keep NULL, as zone-less timestamps."""
    return df.where(in_ns_range(F.col(column))).withColumn(column, F.col(column).cast("timestamp_ntz"))


def filter_valid(df: DataFrame, valid: str | None = None, invalid: str | None = None,
                 column: str = "row_status_source_value") -> DataFrame:
    """``valid=`` keeps equality; ``invalid=`` keeps everything else, NULL included."""
    if invalid is not None:
        return df.where((F.col(column) != F.lit(invalid)) | F.col(column).isNull())
    if valid is not None:
        return df.where(F.col(column) == F.lit(valid))
    raise ValueError("give valid= or invalid=")


def filter_date(cohort: DataFrame, start_date: str, end_date: str, column: str = "cohort_stay_start") -> DataFrame:
    """Half-open study window; ``sub_cohort`` is the month of the stay start (a DATE)."""
    c = F.col(column)
    return (cohort.where((c >= F.lit(start_date).cast("timestamp_ntz")) & (c < F.lit(end_date).cast("timestamp_ntz")))
            .withColumn("sub_cohort", F.trunc(c, "month")))


def exclude_care_sites(df: DataFrame, ids: Sequence[int], column: str = "care_site_id") -> DataFrame:
    """NULL-safe ``not in``."""
    if not ids:
        return df
    return df.where(~F.coalesce(F.col(column).isin(list(ids)), F.lit(False)))


def first_event(df: DataFrame, date_col: str, key: str = "visit_occurrence_id",
                tie_break: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """The whole earliest row per key (trap T3), NULL dates last, then ``tie_break`` columns.

    Rows without a key belong to no group and are dropped. ``by`` names columns that tell several kinds of events apart.
    Written as ``min(struct)`` per key: an aggregate with a map-side partial step,
    so a key holding a large share of the rows is combined before the shuffle
    instead of sorted inside one window partition.
    """
    rest = [c for c in df.columns if c not in (key, date_col, *tie_break, *by)]
    order = [F.col(date_col).isNull().alias("_nulls_last"), F.col(date_col)]
    order += [F.col(c) for c in tie_break] + [F.col(c) for c in rest]
    first = df.where(F.col(key).isNotNull()).groupBy(key, *by).agg(F.min(F.struct(*order)).alias("_first"))
    return first.select(key, *by, *[F.col(f"_first.{c}").alias(c) for c in df.columns if c not in (key, *by)])


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by ``key`` over all shuffle partitions. The number is given, so adaptive execution does not merge them:
    what a distinct holds in a task is its share of the rows, not as many as 64 MB of shuffle blocks have."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


# ---- table extraction ------------------------------------------------------

def prepare_care_site(care_site: DataFrame) -> DataFrame:
    """B1."""
    return care_site.select(
        "care_site_id",
        F.col("care_site_type_source_value").alias("care_site_level"),
        "care_site_short_name",
        F.col("place_of_service_source_value").alias("service_type"))


def prepare_visit_occurrence(core: Tables, source_system: str = C.SOURCE_CORE) -> DataFrame:
    """B19 (visits): invalid rows out, one source, clean dates."""
    v = core.visit_occurrence.select(
        "visit_occurrence_id", "visit_occurrence_source_value", "person_id", "care_site_id",
        "visit_start_datetime", "visit_end_datetime",
        F.col("visit_source_value").alias("stay_type"),
        F.col("stay_source_value").alias("stay_source"),
        "cdm_source", "row_status_source_value")
    v = filter_valid(v, invalid=C.STATUS_DELETED)
    v = filter_source(v, source_system)
    v = clean_date(v, "visit_start_datetime")
    return clean_date(v, "visit_end_datetime").drop("row_status_source_value")


def valid_details(core: Tables) -> DataFrame:
    """B19 (details): valid rows, clean dates."""
    d = core.visit_detail.select(
        "visit_detail_id", "visit_detail_start_datetime", "visit_occurrence_id",
        F.col("visit_detail_type_source_value").alias("transfer_type"),
        F.col("care_site_id").alias("detail_care_site_id"),
        "row_status_source_value")
    d = filter_valid(d, valid=C.STATUS_VALID).drop("row_status_source_value")
    return clean_date(d, "visit_detail_start_datetime")


def prepare_visit_detail(core: Tables, care_site: DataFrame) -> DataFrame:
    """B19 (details) + C1: details of valid rows with the level of their care site (inner)."""
    levels = care_site.select(F.col("care_site_id").alias("detail_care_site_id"),
                              F.col("care_site_level").alias("detail_care_site_level"))
    return valid_details(core).join(levels, "detail_care_site_id")


def prepare_note(core: Tables, source_system: str = C.SOURCE_CORE) -> DataFrame:
    """B19 (notes) + B10."""
    n = core.note.select(
        "note_id", "person_id", "visit_occurrence_id", "note_datetime",
        F.col("note_class_source_value").alias("note_type"),
        "row_status_source_value", "note_text", "cdm_source")
    n = filter_valid(n, valid=C.STATUS_VALID).drop("row_status_source_value")
    n = n.where(F.col("note_text").isNotNull())
    return filter_source(n, source_system)


def prepare_person(core: Tables, source_system: str = C.SOURCE_CORE) -> DataFrame:
    """B19 (persons) + B9."""
    p = core.person.select("person_id", "birth_datetime", "death_datetime", "gender_source_value",
                           "status_source_value", "cdm_source")
    p = p.where(F.col("status_source_value") == C.STATUS_VALID).drop("status_source_value")
    p = filter_source(p, source_system)
    p = clean_date(p, "birth_datetime")
    return clean_date(p, "death_datetime")


def prepare_ghm(claims: Tables, source_system: str = C.SOURCE_CLAIMS, cmd: DataFrame | None = None) -> DataFrame:
    """Diagnosis groups per visit, one row per (visit, GHM code).

    Facts -> left join to the visit link -> one source -> code parse -> dedup on
    (visit, GHM) -> inner join to the code map (broadcast, 29 rows), so no label is shuffled. The CMD code is a
    part of the GHM code: it is cut out after the dedup, which then is a hash aggregate of keys alone.
    """
    link = claims.orbis_visite_calc.select(F.col("ids_eds").alias("visit_occurrence_id"),
                                           F.col("ids_eds_crypt").alias("encounter_num"))
    facts = claims.i2b2_observation_fact_ghm.select(
        "encounter_num", "concept_cd", F.col("sourcesystem_cd").alias("cdm_source"))
    ghm = facts.join(link, "encounter_num", "left").drop("encounter_num")
    ghm = filter_source(ghm, source_system)
    ghm = ghm.select("visit_occurrence_id", code_after_colon("concept_cd").alias("GHM_code")).distinct().withColumn("CMD_code", prefix("GHM_code", 2))
    if cmd is None:
        cmd = cmd_map(ghm.sparkSession)
    return ghm.join(F.broadcast(cmd), "CMD_code").select("visit_occurrence_id", "GHM_code", "CMD_code", "CMD")


def core_condition(core: Tables, source_system: str) -> DataFrame:
    c = core.condition_occurrence.select(
        "visit_occurrence_id", "visit_detail_id", "cdm_source", "condition_status_source_value",
        "condition_source_value", "condition_start_datetime")
    return filter_source(c, source_system)


def claims_condition(claims: Tables, visit_occurrence: DataFrame, source_system: str) -> DataFrame:
    """Claims visit -> visit number -> core visit, two inner joins. No detail id there."""
    return to_core_visits(claims_rows(claims, source_system), claims, visit_occurrence).withColumn("visit_detail_id", F.lit(None).cast("long"))


def claims_rows(claims: Tables, source_system: str) -> DataFrame:
    """The claims conditions of one source, by claims visit."""
    return filter_source(claims.condition_occurrence.select(
        "visit_occurrence_id", "cdm_source", "condition_status_source_value",
        "condition_source_value", "condition_start_datetime"), source_system)


def to_core_visits(rows: DataFrame, claims: Tables, visit_occurrence: DataFrame) -> DataFrame:
    """Rows by claims visit as rows by core visit. The visits of both are linked first, so that rows are joined only once."""
    numbers = claims.visit_occurrence.select("visit_occurrence_id", "visit_occurrence_source_value")
    core_visits = visit_occurrence.select("visit_occurrence_source_value", F.col("visit_occurrence_id").alias("_core"))
    link = numbers.join(core_visits, "visit_occurrence_source_value").drop("visit_occurrence_source_value")
    rest = [c for c in rows.columns if c != "visit_occurrence_id"]
    return rows.join(link, "visit_occurrence_id").select(*rest, F.col("_core").alias("visit_occurrence_id"))


def prepare_condition_occurrence(core: Tables, claims: Tables | None, visit_occurrence: DataFrame,
                                 source_system: str = C.SOURCE_CORE, diag_regex: str = C.DIAG_REGEX) -> DataFrame:
    """Core or claims conditions, then B4."""
    if source_system == C.SOURCE_CLAIMS:
        cond = claims_condition(claims, visit_occurrence, source_system)
    elif source_system == C.SOURCE_CORE:
        cond = core_condition(core, source_system)
    else:
        raise ValueError(f"condition source must be {C.SOURCE_CLAIMS!r} or {C.SOURCE_CORE!r}, not {source_system!r}")
    cond = filter_diag(cond, diag_regex)
    return cond.select("visit_occurrence_id", "visit_detail_id", "diag_type", "condition_source_value",
                       "condition_start_datetime")


def department_codes(reference: Tables, care_site: DataFrame) -> DataFrame:
    """The site codes that name a department: (care_site_source_value, detail_care_site_id)."""
    cs_ref = reference.care_site_ref.select("care_site_source_value",
                                            F.col("care_site_id").alias("detail_care_site_id"))
    departments = care_site.where(F.col("care_site_level") == C.LEVEL_DEPARTMENT).select(F.col("care_site_id").alias("detail_care_site_id"))
    return cs_ref.join(departments, "detail_care_site_id")


def prepare_note_care_site(reference: Tables, care_site: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """C11: unpivot the two site codes of a note, map to sites, keep department sites, distinct.

    ``codes`` are the stored ``department_codes``: their size is known before the notes' codes are dealt, so these are
    not shuffled where Spark can broadcast the sites.
    """
    ref = reference.note_ref.select("note_id", "ufr_source_value", "us_source_value")
    long = ref.unpivot("note_id", ["ufr_source_value", "us_source_value"], "variable", "care_site_source_value")
    # codes meet their sites first: a note's codes are joined once, and those of other sites go there
    sites = long.join(department_codes(reference, care_site) if codes is None else codes, "care_site_source_value").select("note_id", "detail_care_site_id")
    return dealt(sites, "note_id").distinct().select("note_id", "detail_care_site_id", F.lit(C.LEVEL_DEPARTMENT).alias("detail_care_site_level"))


def icu_care_sites(care_site: DataFrame, icu_regex: str = C.ICU_REGEX) -> DataFrame:
    """Units whose service type matches the ICU regex."""
    return (filter_event(care_site, "service_type", icu_regex)
            .select(F.col("care_site_id").alias("detail_care_site_id"), "service_type"))


def condition_detail(visit_detail: DataFrame, transfer_type: str = C.CONDITION_TRANSFER_TYPE) -> DataFrame:
    """Transfer-type equality (the config names it a regex; it is used as equality)."""
    return visit_detail.where(F.col("transfer_type") == transfer_type).drop("visit_occurrence_id")
