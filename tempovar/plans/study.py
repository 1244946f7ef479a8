"""The study as lazily built stages, and the form that stores each stage once.

``Pipeline`` builds frames only. ``StoredPipeline`` writes a stage where it is first asked for and scans
it from then on: no plan holds another stage's plan, a lost executor costs only tasks of the stage at
work, and what a study holds lies in its folder, not in executors. Nothing is collected but the one row
of an outcome's thresholds, from which its parameter cells are literals.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..config import DEFAULT_STUDY, OUTCOMES, Study
from ..operators import models as M
from ..operators import probes as P
from ..operators.cohort import Prepared, cohort_selection, cohort_visit, condition_outcomes, outcome_table, prepare
from ..sources.sinks import read_bucketed, write_bucketed, write_partitions, write_table
from ..sources.tables import Tables
from . import grid as G

PROBES = ["visit", "icu", "note", "note_per_visit", "condition_per_visit", "condition"]
MODELS = ["visit", "icu_rectangle", "note", "note_per_visit", "condition", "condition_per_condition"]


@dataclass
class Pipeline:
    core: Tables
    reference: Tables
    claims: Tables
    study: Study = field(default_factory=lambda: DEFAULT_STUDY)

    @cached_property
    def prepared(self) -> Prepared:
        return prepare(self.core, self.reference, self.claims)

    @cached_property
    def outcomes(self) -> dict[str, DataFrame]:
        return cohort_selection(self.core, self.reference, self.claims, self.study)

    def outcome(self, name: str) -> DataFrame:
        return self.outcomes[name]

    # --- probes (I1-I4) ---
    def series(self, name: str) -> DataFrame:
        """A row per index, with its months in one array: what the models read."""
        p, s = self.prepared, self.study
        if name == "visit":
            return P.visit_probe(p, s)
        if name == "icu":
            return P.visit_probe(p, s, levels=[C.LEVEL_UNIT], specialties_sets=C.ICU_SPECIALTIES_SETS)
        if name == "note":
            return P.note_probe(p, s)
        if name == "note_per_visit":
            return P.note_per_visit_probe(p, s)
        if name == "condition_per_visit":
            return P.condition_probe(p, s, per_visit=True)
        if name == "condition":
            return P.condition_probe(p, s, per_visit=False)
        raise ValueError(f"unknown probe {name!r}")

    def probe(self, name: str) -> DataFrame:
        """A row per index and month."""
        return P.monthly(self.series(name))

    # --- models (I5, I6) keyed as the analysis names them ---
    def estimates(self, name: str) -> DataFrame:
        """Estimates are one row per site and label set: memoised and persisted, since the
        analysis reads them several times (stability, thresholds, cells, counts)."""
        cache = self.__dict__.setdefault("_estimates", {})
        if name not in cache:
            cache[name] = self._fit(name).persist()
        return cache[name]

    def _fit(self, name: str) -> DataFrame:
        if name == "visit":
            return M.fit_step(self.series("visit"))
        if name == "icu_rectangle":
            return M.fit_rectangle(self.series("icu"))
        if name == "note":
            return M.fit_step(self.series("note"))
        if name == "note_per_visit":
            return M.fit_step(self.series("note_per_visit"))
        if name == "condition":
            return M.fit_step(self.series("condition_per_visit"))
        if name == "condition_per_condition":
            return M.fit_step(self.series("condition"))
        raise ValueError(f"unknown estimates {name!r}")

    def care_site_counts(self) -> DataFrame:
        return P.care_site_counts(self.core.care_site, self.study.hospitals_to_remove)

    @cached_property
    def analysis_cohort(self) -> G.AnalysisCohort:
        ac = G.analysis_cohort(self.outcomes["cohort_visit"], self.estimates("visit"), self.study)
        # every indicator reads the analysis cohort: persist it once (MEMORY_AND_DISK), as the study caches its cohort
        return G.AnalysisCohort(ac.cohort_all.persist(), ac.cohort_mcd, ac.hospital_count)

    def indicator(self, outcome_name: str) -> DataFrame:
        """Persisted, since the reports read it several times: one row per site, month and cell."""
        cache = self.__dict__.setdefault("_indicators", {})
        if outcome_name not in cache:
            o = OUTCOMES[outcome_name]
            cache[outcome_name] = G.statistical_analysis(self.analysis_cohort.cohort_all, self.events(outcome_name), self.estimates(o.estimates), o,
                                                         self.study, self.thresholds(outcome_name)).persist()
        return cache[outcome_name]

    def events(self, outcome_name: str) -> DataFrame:
        """The outcome's event table; the rectangle form of an outcome has the same events."""
        return self.outcome(outcome_name.replace("_rectangle", ""))

    def indicator_by_group(self, outcome_name: str) -> DataFrame:
        """The indicator per site and diagnosis group, on the per-group subset of the cohort."""
        o = OUTCOMES[outcome_name]
        return G.statistical_analysis(self.analysis_cohort.cohort_mcd, self.events(outcome_name), self.estimates(o.estimates), o,
                                      self.study, self.thresholds(outcome_name), ("care_site_id", "MCD"))

    def thresholds(self, outcome_name: str) -> DataFrame:
        o = OUTCOMES[outcome_name]
        return G.outcome_thresholds(self.estimates(o.estimates), o)

    def release(self) -> None:
        """Give back what the lazy pipeline persisted."""
        held = [*self.__dict__.get("_estimates", {}).values(), *self.__dict__.get("_indicators", {}).values()]
        for df in [*held, *([self.analysis_cohort.cohort_all] if "analysis_cohort" in self.__dict__ else [])]:
            df.unpersist()

    def count_summary(self, outcome_name: str) -> DataFrame:
        o = OUTCOMES[outcome_name]
        return G.cs_count_summary(self.care_site_counts(), self.estimates(o.estimates), o,
                                  self.analysis_cohort.hospital_count, self.study, self.thresholds(outcome_name))


#: Incidences that share model, level and filters are analysed in one pass.
INCIDENCES = [name for name, o in OUTCOMES.items() if o.key_function == "incidence"]


@dataclass
class StoredPipeline(Pipeline):
    """A pipeline whose stages are written to ``root`` where they are first asked for and scanned from then on.

    With ``buckets`` the cohort and event tables are written bucketed by stay, so the joins of a reloaded
    study need no exchange (A6). ``on_stage(name, seconds)`` receives stage timings, plan building included.
    ``chosen`` are the outcomes that the study analyses.
    """

    root: str = ""
    mode: str = "overwrite"
    buckets: int | None = None
    on_stage: Callable[[str, float], None] | None = None
    chosen: Sequence[str] = tuple(OUTCOMES)
    held: dict[str, DataFrame] = field(default_factory=dict)
    _tables: str = field(default_factory=lambda: f"study_{uuid.uuid4().hex[:12]}")

    @property
    def spark(self) -> SparkSession:
        return next(iter(self.core.values())).sparkSession

    def stage(self, name: str, build: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
        if name not in self.held:
            t0 = time.perf_counter()
            self.held[name] = self._write(name, build(), by)
            if self.on_stage:
                self.on_stage(name, time.perf_counter() - t0)
        return self.held[name]

    def _write(self, name: str, df: DataFrame, by: str | None) -> DataFrame:
        path = f"{self.root}/{name}"
        if by and self.buckets:
            return read_bucketed(df.sparkSession, f"{self._tables}_{name.replace('/', '_')}", write_bucketed(df, path, by, self.buckets, self.mode), df.schema, by, self.buckets)
        return df.sparkSession.read.schema(df.schema).parquet(write_table(df, path, self.mode))

    def materialise(self) -> StoredPipeline:
        """Store each input table where it is first asked for (for inputs that are views, such as the surrogate warehouse)."""
        self.core, self.reference, self.claims = (
            Tables({t: lambda t=t, tables=tables, prefix=prefix: self.stage(f"warehouse/{prefix}/{t}", lambda: tables[t]) for t in tables})
            for prefix, tables in (("core", self.core), ("reference", self.reference), ("claims", self.claims)))
        return self

    @cached_property
    def prepared(self) -> Prepared:
        """The sites of notes are stored: three steps read them."""
        return prepare(self.core, self.reference, self.claims, keep=lambda name, build: self.stage(f"prepared/{name}", build))

    def outcome(self, name: str) -> DataFrame:
        if name == "cohort_visit":
            return self.stage("cohort/cohort_visit", lambda: cohort_visit(self.prepared, self.study), "visit_cohort_id")
        return self.stage(f"cohort/{name}", lambda: outcome_table(self.prepared, self.outcome("cohort_visit"), name), "visit_occurrence_id")

    def conditions(self, names: Sequence[str]) -> dict[str, DataFrame]:
        """The tables of these conditions. Those not stored yet are worked out in one pass and stored together, one by one if bucketed."""
        left = [n for n in names if f"cohort/{n}" not in self.held]
        if len(left) > 1 and not self.buckets:
            t0 = time.perf_counter()
            df = condition_outcomes(self.prepared, self.outcome("cohort_visit"), {n: C.CONDITION_REGEXES[n] for n in left})
            every = self.spark.read.schema(df.schema).parquet(write_partitions(df, f"{self.root}/cohort/conditions", "outcome_name"))
            for n in left:
                self.held[f"cohort/{n}"] = every.where(F.col("outcome_name") == n).drop("outcome_name")
                if self.on_stage:
                    self.on_stage(f"cohort/{n}", (time.perf_counter() - t0) / len(left))
        return {n: self.outcome(n) for n in names}

    @property
    def outcomes(self) -> dict[str, DataFrame]:  # type: ignore[override]
        return {name: self.outcome(name) for name in C.OUTCOME_TABLES}

    def series(self, name: str) -> DataFrame:
        return self.stage(f"probes/{name}", lambda: super(StoredPipeline, self).series(name))

    def estimates(self, name: str) -> DataFrame:
        return self.stage(f"models/{name}", lambda: self._fit(name))

    def thresholds(self, outcome_name: str) -> DataFrame:
        """Outcomes with the same model, level and filters have the same row: it is stored once."""
        o = OUTCOMES[outcome_name]
        same = next(n for n, x in OUTCOMES.items() if (x.estimates, x.care_site_level, G.outcome_filters(x)) == (o.estimates, o.care_site_level, G.outcome_filters(o)))
        return self.stage(f"thresholds/{same}", lambda: G.outcome_thresholds(self.estimates(o.estimates), o))

    def care_site_counts(self) -> DataFrame:
        return self.stage("cs_count", super().care_site_counts)

    @property
    def analysis_cohort(self) -> Tables:  # type: ignore[override]
        """The parts of ``G.AnalysisCohort``, each stored where it is first asked for; the number of hospitals needs no stay."""
        def stays(name: str) -> DataFrame:
            return getattr(G.analysis_cohort(self.outcome("cohort_visit"), self.estimates("visit"), self.study), name)

        return Tables({"hospital_count": lambda: self.stage("analysis/hospital_count", lambda: G.hospital_count(self.estimates("visit"), self.study)),
                       **{name: lambda name=name: self.stage(f"analysis/{name}", lambda: stays(name), "visit_cohort_id") for name in ("cohort_all", "cohort_mcd")}})

    def indicator(self, outcome_name: str) -> DataFrame:
        """Of the long table over all outcomes (A5), this outcome's partition; incidences are written in one job."""
        name = f"indicators/{outcome_name}"
        if name not in self.held:
            o = OUTCOMES[outcome_name]
            group = [n for n in INCIDENCES if n in self.chosen] if outcome_name in INCIDENCES else [outcome_name]
            if outcome_name not in group:
                group = [outcome_name]
            cohort, estimates, thresholds = self.analysis_cohort.cohort_all, self.estimates(o.estimates), self.thresholds(outcome_name)
            events = self.conditions(group) if outcome_name in INCIDENCES else {n: self.events(n) for n in group}
            t0 = time.perf_counter()
            rows = (G.incidence_analysis(cohort, events, estimates, self.study, thresholds) if o.key_function == "incidence"
                    else G.statistical_analysis(cohort, events[outcome_name], estimates, o, self.study, thresholds).withColumn("outcome_name", F.lit(outcome_name)))
            write_partitions(G.union_schema(rows, ["outcome_name"]), f"{self.root}/indicators", "outcome_name")
            every = all_indicators(self.spark, self.root)
            for n in group:
                self.held[f"indicators/{n}"] = G.own_schema(every.where(F.col("outcome_name") == n), OUTCOMES[n])
                if self.on_stage:
                    self.on_stage(f"indicators/{n}", (time.perf_counter() - t0) / len(group))
        return self.held[name]

    def count_summary(self, outcome_name: str) -> DataFrame:
        return self.stage(f"cs_count_summary/{outcome_name}", lambda: super(StoredPipeline, self).count_summary(outcome_name))


def all_indicators(spark: SparkSession, out_dir: str) -> DataFrame:
    """A5 read back: one long table over all outcomes, with ``outcome_name``."""
    schema = ", ".join(f"{c} {t}" for c, t in {**G.INDICATOR_COLUMNS, "outcome_name": "string"}.items())
    return spark.read.schema(schema).parquet(f"{out_dir}/indicators")


def run_study(spark: SparkSession, pipeline: Pipeline, out_dir: str, mode: str = "overwrite",
              on_stage: Callable[[str, float], None] | None = None, materialize_inputs: bool = False,
              outcomes: Sequence[str] = tuple(OUTCOMES), buckets: int | None = None) -> StoredPipeline:
    """Write every stage to ``out_dir``, in order; the pipeline that comes back scans what was written.

    The cohort before the outcome tables (A3), probes / estimates / site counts (A4), threshold rows, the
    analysis cohort, the indicators (one partition per outcome under one schema, A5) and the count
    summaries. ``outcomes`` are those to analyse, ``buckets`` as in ``StoredPipeline``.
    """
    done = StoredPipeline(pipeline.core, pipeline.reference, pipeline.claims, pipeline.study, root=out_dir, mode=mode, buckets=buckets,
                          on_stage=on_stage, chosen=tuple(outcomes))
    if materialize_inputs:
        done.materialise()
    for name in C.OUTCOME_TABLES:
        done.outcome(name)
    for name in PROBES:
        done.probe(name)
    for name in MODELS:
        done.estimates(name)
    done.care_site_counts()
    for name in outcomes:
        done.thresholds(name)
    for name in ("cohort_all", "cohort_mcd", "hospital_count"):
        done.analysis_cohort[name]  # stored by being asked for
    for name in outcomes:
        done.indicator(name)
    for name in outcomes:
        done.count_summary(name)
    return done
