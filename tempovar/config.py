"""Study parameters and fixed vocabularies.

Everything here is plain data. Functions take these as arguments with these
values as defaults, so a study on another warehouse passes its own values.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values (must equal the warehouse vocabulary the study runs on) ---
# Care-site levels, in the warehouse's own spelling (typographic apostrophe).
LEVEL_HOSPITAL = "Hôpital"
LEVEL_DEPARTMENT = "Unité Fonctionnelle (UF)"
LEVEL_UNIT = "Unité d’hébergement (UH)"
CARE_SITE_LEVELS = [LEVEL_HOSPITAL, LEVEL_DEPARTMENT, LEVEL_UNIT]
DETAIL_LEVELS = [LEVEL_DEPARTMENT, LEVEL_UNIT]

# Row status values.
STATUS_VALID = "Actif"
STATUS_DELETED = "supprimé"

# Source systems.
SOURCE_CORE = "ORBIS"
SOURCE_CLAIMS = "AREM"

# Regular expressions used by the cohort selection (contains-match).
DIAG_REGEX = "DP|DR"
HOSPIT_STAY_TYPE_REGEX = "hospitalisés"
HOSPIT_STAY_SOURCE_REGEX = "MCO"
EMERGENCY_STAY_TYPE_REGEX = "urgence"
EMERGENCY_STAY_SOURCE_REGEX = "MCO"
CONSULTATION_NOTE_TYPE_REGEX = "CR-CONS(?!-)"
PRESCRIPTION_NOTE_TYPE_REGEX = "ORDO"
CONDITION_TRANSFER_TYPE = "RUM"
BRONCHIOLITIS_REGEX = "J21"
FLU_REGEX = "J09|J10|J11"
GASTROENTERITIS_REGEX = "A09"
NASOPHARYNGITIS_REGEX = "J00"
ICU_REGEX = r"REA\s|USI\s|SC\s"

CONDITION_REGEXES = {
    "bronchiolitis_condition": BRONCHIOLITIS_REGEX,
    "flu_condition": FLU_REGEX,
    "gastroenteritis_condition": GASTROENTERITIS_REGEX,
    "nasopharyngitis_condition": NASOPHARYNGITIS_REGEX,
}

# Major diagnostic categories (CMD code -> label), fixed values.
CMD_MAP = {
    "01": "Affections du système nerveux",
    "02": "Affections de l'œil",
    "03": "Affections des oreilles, du nez, de la gorge, de la bouche et des dents",
    "04": "Affections de l'appareil respiratoire",
    "05": "Affections de l'appareil circulatoire",
    "06": "Affections du tube digestif",
    "07": "Affections du système hépatobiliaire et du pancréas",
    "08": "Affections et traumatismes de l'appareil musculosquelettique et du tissu conjonctif",
    "09": "Affections de la peau, des tissus souscutanés et des seins",
    "10": "Affections endocriniennes, métaboliques et nutritionnelles",
    "11": "Affections du rein et des voies urinaires",
    "12": "Affections de l'appareil génital masculin",
    "13": "Affections de l'appareil génital féminin",
    "14": "Grossesses pathologiques, accouchements et affections du post-partum",
    "15": "Nouveau-nés, prématurés et affections de la période périnatale",
    "16": "Affections du sang et des organes hématopoïétiques",
    "17": "Affections myéloprolifératives et tumeurs de siège imprécis ou diffus",
    "18": "Maladies infectieuses et parasitaires",
    "19": "Maladies et troubles mentaux",
    "20": "Troubles mentaux organiques liés à l'absorption de drogues ou induits par celles-ci",
    "21": "Traumatismes, allergies et empoisonnements",
    "22": "Brûlures",
    "23": "Facteurs influant sur l'état de santé et autres motifs de recours aux services de santé",
    "24": "Séjours de moins de 2 jours",
    "25": "Maladies dues à une infection par le VIH",
    "26": "Traumatismes multiples graves",
    "27": "Transplantations d'organes",
    "28": "Séances",
    "90": "Erreurs et autres séjours inclassables",
}

# Probe regex sets (label -> regex). A row fans out to every matching label.
VISIT_SPECIALTIES_SETS = {"ICU": ICU_REGEX, "All": ".*"}
ICU_SPECIALTIES_SETS = {"ICU": ICU_REGEX}
NOTE_STAY_TYPES = {"All": ".*", "hospit": "hospitalisés", "consultation": "consultation"}
NOTE_TYPES = {"consultation": CONSULTATION_NOTE_TYPE_REGEX, "prescription": PRESCRIPTION_NOTE_TYPE_REGEX}
CONDITION_STAY_TYPES = {"hospit": "hospitalisés"}
CONDITION_TYPES = {"All": ".*", "Bronchiolitis": BRONCHIOLITIS_REGEX, "Flu": FLU_REGEX}
CONDITION_DIAG_TYPES = {"DP_DR": DIAG_REGEX}
CONDITION_SOURCE_SYSTEMS = [SOURCE_CLAIMS, SOURCE_CORE]

# Outcome thresholds in days, and their labels.
THRESHOLDS = [30, 90]

# Labels of the two analyses.
NAIVE = "Naive analysis"
CSO = "Complete-source-only analysis"
# --- end of fixed values ---


@dataclass(frozen=True)
class Outcome:
    """How one outcome table is turned into an indicator."""

    name: str
    key_function: str  # duration_after | during_stay | incidence
    estimates: str  # which model's estimates decide stability
    care_site_level: str
    col_date: str | None = None
    stay_type: str | None = None
    note_type: str | None = None
    specialties_set: str | None = None
    source_system: str | None = None
    diag_type: str | None = None
    condition_type: str | None = None
    use_end_date: bool = False


# The names of the outcomes in reports.
EVENT_NAMES = {
    "hospit_visit": "Hospitalisation",
    "emergency_visit": "Emergency stay",
    "consultation_note": "Consultation note",
    "prescription_note": "Prescription",
    "bronchiolitis_condition": "Bronchiolitis condition",
    "flu_condition": "Flu condition",
    "gastroenteritis_condition": "Gastroenteritis condition",
    "nasopharyngitis_condition": "Nasopharyngitis condition",
    "icu_visit": "ICU stay",
    "icu_visit_rectangle": "ICU stay corrected",
}

# The cohort and its nine outcome tables.
OUTCOME_TABLES = ["cohort_visit", "hospit_visit", "emergency_visit", "consultation_note", "prescription_note", "icu_visit", *CONDITION_REGEXES]

# Levels as reports name them, in the counts and on the fit panels.
LEVEL_LABELS = {LEVEL_HOSPITAL: "hospital", LEVEL_DEPARTMENT: "department", LEVEL_UNIT: "unit"}
PANEL_LABELS = {LEVEL_HOSPITAL: "1 - Hospitals", LEVEL_DEPARTMENT: "2 - Departments", LEVEL_UNIT: "3 - Units"}

# The outcomes of each report.
SUMMARY_OUTCOMES = ["hospit_visit", "emergency_visit", "consultation_note", "prescription_note", "icu_visit",
                    "icu_visit_rectangle", "bronchiolitis_condition", "flu_condition"]
QUALITY_OUTCOMES = ["hospit_visit", "emergency_visit", "consultation_note", "prescription_note"]
ICU_OUTCOMES = ["icu_visit", "icu_visit_rectangle"]
EPIDEMIOLOGY_OUTCOMES = ["bronchiolitis_condition", "flu_condition"]

OUTCOMES = {
    "hospit_visit": Outcome("hospit_visit", "duration_after", "visit", LEVEL_HOSPITAL,
                            col_date="visit_start_datetime", stay_type="hospitalisés"),
    "emergency_visit": Outcome("emergency_visit", "duration_after", "visit", LEVEL_HOSPITAL,
                               col_date="visit_start_datetime", stay_type="urgence"),
    "consultation_note": Outcome("consultation_note", "duration_after", "note", LEVEL_DEPARTMENT,
                                 col_date="note_datetime", note_type="consultation", stay_type="All"),
    "prescription_note": Outcome("prescription_note", "during_stay", "note_per_visit", LEVEL_DEPARTMENT,
                                 col_date="note_datetime", note_type="prescription", stay_type="hospit"),
    "bronchiolitis_condition": Outcome("bronchiolitis_condition", "incidence", "condition", LEVEL_DEPARTMENT,
                                       col_date="cohort_stay_start", source_system=SOURCE_CORE,
                                       diag_type="DP_DR", condition_type="All"),
    "flu_condition": Outcome("flu_condition", "incidence", "condition", LEVEL_DEPARTMENT,
                             col_date="cohort_stay_start", source_system=SOURCE_CORE,
                             diag_type="DP_DR", condition_type="All"),
    "gastroenteritis_condition": Outcome("gastroenteritis_condition", "incidence", "condition", LEVEL_DEPARTMENT,
                                         col_date="cohort_stay_start", source_system=SOURCE_CORE,
                                         diag_type="DP_DR", condition_type="All"),
    "nasopharyngitis_condition": Outcome("nasopharyngitis_condition", "incidence", "condition", LEVEL_DEPARTMENT,
                                         col_date="cohort_stay_start", source_system=SOURCE_CORE,
                                         diag_type="DP_DR", condition_type="All"),
    "icu_visit": Outcome("icu_visit", "duration_after", "visit", LEVEL_UNIT,
                         col_date="visit_start_datetime", specialties_set="ICU"),
    "icu_visit_rectangle": Outcome("icu_visit_rectangle", "duration_after", "icu_rectangle", LEVEL_UNIT,
                                   col_date="visit_start_datetime", specialties_set="ICU", use_end_date=True),
}


@dataclass(frozen=True)
class Study:
    """Dates of one study. Defaults fit the surrogate warehouse of the test data.

    The probe window starts with the data; the cohort-stability reference date
    sits two years in, the way the original study let its probes run ahead of
    the cohort so that sites already complete at the cohort start are found.
    """

    probe_start: str = "1995-01-01"
    end_date: str = "2001-08-01"
    cohort_start: str = "1995-01-01"
    stability_date: str = "1997-01-01"
    start_observation_dates: tuple = ("1995-01-01", "1997-01-01", "1999-01-01")
    mcd_start: str = "1997-01-01"  # the per-group subset starts at the second observation date
    as_of: str = "2001-08-01"  # reference date of age_today
    tolerance_days: int = 90
    thresholds: tuple = tuple(THRESHOLDS)
    hospitals_to_remove: tuple = field(default_factory=tuple)

    @property
    def window(self) -> tuple[str, str]:
        """Dates ``[from, to)`` of the warehouse rows that the study can use: stays from the probe or cohort start on,
        events up to the as-of tolerance after the last stay that counts. A stay may be open or end late, so the
        end leaves two tolerances."""
        from datetime import date, timedelta
        end = date.fromisoformat(self.end_date) + timedelta(days=2 * self.tolerance_days)
        return min(self.probe_start, self.cohort_start), end.isoformat()

    @property
    def last_month(self) -> str:
        """Last month the probes cover (the window is ``[probe_start, end_date)``).

        A rectangle model is "still complete at the end" when ``t_1`` reaches it.
        """
        from datetime import date
        d = date.fromisoformat(self.end_date)
        y, m = (d.year, d.month - 1) if d.month > 1 else (d.year - 1, 12)
        return date(y, m, 1).isoformat()


DEFAULT_STUDY = Study()
