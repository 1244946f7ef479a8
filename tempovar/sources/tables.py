"""Table loading (A1) and literal reference tables (A2)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C

# Columns each input table must have (the columns the study selects).
REQUIRED_COLUMNS = {
    "care_site": ["care_site_id", "care_site_type_source_value", "care_site_short_name",
                  "place_of_service_source_value"],
    "visit_occurrence": ["visit_occurrence_id", "visit_occurrence_source_value", "person_id", "care_site_id",
                         "visit_start_datetime", "visit_end_datetime", "visit_source_value",
                         "stay_source_value", "cdm_source", "row_status_source_value"],
    "visit_detail": ["visit_detail_id", "visit_detail_start_datetime", "visit_occurrence_id",
                     "visit_detail_type_source_value", "care_site_id", "row_status_source_value"],
    "condition_occurrence": ["visit_occurrence_id", "cdm_source", "condition_status_source_value",
                             "condition_source_value", "condition_start_datetime"],
    "note": ["note_id", "person_id", "visit_occurrence_id", "note_datetime", "note_class_source_value",
             "row_status_source_value", "note_text", "cdm_source"],
    "person": ["person_id", "birth_datetime", "death_datetime", "gender_source_value",
               "status_source_value", "cdm_source"],
    "note_ref": ["note_id", "ufr_source_value", "us_source_value"],
    "care_site_ref": ["care_site_source_value", "care_site_id"],
    "orbis_visite_calc": ["ids_eds", "ids_eds_crypt"],
    "i2b2_observation_fact_ghm": ["encounter_num", "concept_cd", "sourcesystem_cd"],
}


# Columns that the core tables have beside these; the claims tables lack them.
CORE_COLUMNS = {"condition_occurrence": ["visit_detail_id"]}
# The columns of the claims tables that have fewer than the core ones (the link from claims visits to core visits).
CLAIMS_COLUMNS = {"visit_occurrence": ["visit_occurrence_id", "visit_occurrence_source_value"]}


class Tables(Mapping):
    """Name -> DataFrame mapping with attribute access (``tables.visit_occurrence``).

    A table may be given as a function: it is called where the table is first asked for.
    """

    def __init__(self, frames: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        self._frames = dict(frames)

    def __getitem__(self, name: str) -> DataFrame:
        try:
            frame = self._frames[name]
        except KeyError:
            raise KeyError(f"table {name!r} is not loaded; loaded: {sorted(self._frames)}") from None
        if not isinstance(frame, DataFrame):
            frame = self._frames[name] = frame()
        return frame

    def __contains__(self, name: object) -> bool:
        return name in self._frames

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self[name]
        except KeyError as e:
            raise AttributeError(str(e)) from None

    def __iter__(self):
        return iter(self._frames)

    def __len__(self):
        return len(self._frames)


def check_columns(name: str, df: DataFrame, required: Iterable[str] | None = None) -> DataFrame:
    """Fail early on a missing column, the way a schema-on-read warehouse would not."""
    need = list(required if required is not None else REQUIRED_COLUMNS.get(name, []))
    missing = [c for c in need if c not in df.columns]
    if missing:
        raise ValueError(f"table {name!r} lacks columns {missing}")
    return df


def _checked(name: str, df: DataFrame, claims: bool) -> DataFrame:
    need = REQUIRED_COLUMNS.get(name, [])
    return check_columns(name, df, CLAIMS_COLUMNS.get(name, need) if claims else [*need, *CORE_COLUMNS.get(name, [])])


def load_catalog(spark: SparkSession, database: str, tables: Iterable[str], claims: bool = False) -> Tables:
    """Load ``database.table`` for each name from the metastore (A1)."""
    return Tables({t: _checked(t, spark.read.table(f"{database}.{t}"), claims) for t in tables})


#: Tables that may lie in one folder per month, with the date that says which.
MONTHLY = {"visit_occurrence": "visit_start_datetime", "visit_detail": "visit_detail_start_datetime",
           "condition_occurrence": "condition_start_datetime", "note": "note_datetime"}


def load_parquet(spark: SparkSession, root: str, tables: Iterable[str], claims: bool = False,
                 window: tuple[str, str] | None = None) -> Tables:
    """Load ``root/table.parquet`` (or a folder of that name) for each name (A1).

    A table may be partitioned by ``month`` (``write_by_month``). With ``window``, dates ``[from, to)``, the months
    outside it are not read: a study passes ``Study.window``, which holds every row that its own date filters
    (B6, B7, the probe window, the as-of band) can keep. Rows without a date stay. ``month`` is not a column of the table.
    """
    return Tables({t: _checked(t, _pruned(spark.read.parquet(f"{root.rstrip('/')}/{t}.parquet"), t, window), claims) for t in tables})


def _pruned(df: DataFrame, name: str, window: tuple[str, str] | None) -> DataFrame:
    if "month" not in df.columns or name not in MONTHLY:
        return df
    if window:
        first, end = (F.lit(d).cast("date") for d in window)
        month = F.col("month").cast("date")
        df = df.where(month.isNull() | ((month >= F.trunc(first, "month")) & (month < end)))
    return df.drop("month")


def restrict_months(df: DataFrame, date: str, months: DataFrame) -> DataFrame:
    """Rows of the months that ``months`` (a frame with a ``month`` date) names; on a table partitioned by month the
    join prunes folders at run time, whatever ``months`` comes from."""
    wanted = months.select(F.col("month").cast("date").alias("_month")).distinct()
    own = F.col("month").cast("date") if "month" in df.columns else F.trunc(F.col(date).cast("date"), "month")
    return df.join(wanted, own == F.col("_month"), "left_semi")


def cmd_map(spark: SparkSession, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Code map (A2): two columns ``CMD_code, CMD``. 29 literal rows, so a broadcast is safe."""
    mapping = C.CMD_MAP if mapping is None else mapping
    schema = T.StructType([T.StructField("CMD_code", T.StringType(), False),
                           T.StructField("CMD", T.StringType(), False)])
    return F.broadcast(spark.createDataFrame(sorted(mapping.items()), schema))
