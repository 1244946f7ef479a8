"""Surrogate OMOP warehouse over the TPC-H-like test tables.

The test data carry no clinical tables, so each OMOP table is a deterministic
view of the star schema (orders -> stays, lineitem lines -> details, notes and
conditions, customers -> persons, suppliers -> departments and units,
nations -> hospitals). Every view is a plain DataFrame over the parquet scans,
so filters and column pruning reach the files and the work grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from .sinks import write_table
from .tables import Tables

RAW = ["nation", "supplier", "customer", "part", "orders", "lineitem"]

NTZ = "timestamp_ntz"


def _days(col) -> F.Column:
    return F.make_dt_interval(days=col.cast("int"))


def read_raw(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in RAW}


#: Fixed order of the lines that share an order and a line number.
LINE_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
              "l_linestatus", "l_shipdate"]


def lines(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Every line, with its order's date and customer (``ordered``: it has an order). (order, line number) is not
    unique in lineitem, so the id adds the line's rank within the pair; a pair of more than 100 lines or a line number
    above 9 does not fit the id and is an error. Lines are dealt once, by order: the ranks and the join are both within it."""
    same = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*LINE_ORDER)
    n, rank = F.col("l_linenumber"), F.col("rank")
    line_id = F.when(rank.between(1, 100) & n.between(0, 9), (F.col("l_orderkey") * 10 + n) * 100 + rank - 1)
    ranked = (lineitem.repartition("l_orderkey").withColumn("rank", F.row_number().over(same))
              .select(F.col("l_orderkey").alias("k"), n.alias("n"), F.col("l_suppkey").alias("sk"),
                      F.col("l_partkey").alias("pk"), F.col("l_returnflag").alias("rf"),
                      F.coalesce(line_id, F.raise_error(F.lit("line id overflow")).cast("long")).alias("id")))
    return (ranked.join(orders.select("o_orderkey", "o_orderdate", "o_custkey"), F.col("k") == F.col("o_orderkey"), "left")
            .withColumn("ordered", F.col("o_orderkey").isNotNull()).drop("o_orderkey"))


def care_site(nation: DataFrame, supplier: DataFrame) -> DataFrame:
    hospitals = nation.select(
        (F.lit(1000) + F.col("n_nationkey")).cast("long").alias("care_site_id"),
        F.lit(C.LEVEL_HOSPITAL).alias("care_site_type_source_value"),
        F.col("n_name").alias("care_site_short_name"),
        F.lit(None).cast("string").alias("place_of_service_source_value"))
    departments = supplier.select(
        (F.lit(2000000) + F.col("s_suppkey")).cast("long").alias("care_site_id"),
        F.lit(C.LEVEL_DEPARTMENT).alias("care_site_type_source_value"),
        F.col("s_name").alias("care_site_short_name"),
        F.lit("DEPARTEMENT").alias("place_of_service_source_value"))
    service = (F.when(F.col("s_suppkey") % 5 == 0, "REA MED")
               .when(F.col("s_suppkey") % 5 == 1, "USI CARDIO")
               .when(F.col("s_suppkey") % 5 == 2, "SC POLY")
               .when(F.col("s_suppkey") % 5 == 3, "MEDECINE")
               .otherwise("CHIRURGIE"))
    units = supplier.select(
        (F.lit(3000000) + F.col("s_suppkey")).cast("long").alias("care_site_id"),
        F.lit(C.LEVEL_UNIT).alias("care_site_type_source_value"),
        F.col("s_name").alias("care_site_short_name"),
        service.alias("place_of_service_source_value"))
    return hospitals.unionByName(departments).unionByName(units)


def visit_occurrence(orders: DataFrame) -> DataFrame:
    """Every order is a stay. A hospital's stays come from the core source once it has gone live (3 months after the
    hospital before it), from another source until then: the source filter leaves the adoption steps."""
    k = F.col("o_orderkey")
    start = F.col("o_orderdate").cast(NTZ)
    live_from = F.add_months(F.lit("1995-01-01").cast("date"), (3 * (k % 25)).cast("int")).cast(NTZ)
    return orders.select(
        k.alias("visit_occurrence_id"),
        F.concat(F.lit("V"), k.cast("string")).alias("visit_occurrence_source_value"),
        F.col("o_custkey").alias("person_id"),
        (F.lit(1000) + k % 25).cast("long").alias("care_site_id"),
        start.alias("visit_start_datetime"),
        F.when(k % 53 == 0, F.lit(None).cast(NTZ)).otherwise(start + _days(k % 7)).alias("visit_end_datetime"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "urgence")
         .otherwise("hospitalisés").alias("visit_source_value"),
        F.when(k % 10 == 0, "SSR").otherwise("MCO").alias("stay_source_value"),
        F.when((start >= live_from) & (k % 20 != 1), C.SOURCE_CORE).otherwise("OTHER").alias("cdm_source"),
        F.when(k % 31 == 0, C.STATUS_DELETED).otherwise(C.STATUS_VALID).alias("row_status_source_value"))


def visit_detail(ln: DataFrame) -> DataFrame:
    n = F.col("n")
    return ln.where("ordered").select(
        F.col("id").alias("visit_detail_id"),
        (F.col("o_orderdate").cast(NTZ) + _days(n)).alias("visit_detail_start_datetime"),
        F.col("k").alias("visit_occurrence_id"),
        F.when(n % 2 == 0, "RUM").otherwise("UH").alias("visit_detail_type_source_value"),
        (F.when(n % 2 == 0, F.lit(2000000)).otherwise(F.lit(3000000)) + F.col("sk")).cast("long")
        .alias("care_site_id"),
        F.when(n == 7, "Inactif").otherwise(C.STATUS_VALID).alias("row_status_source_value"))


def condition_occurrence(ln: DataFrame, source: str = C.SOURCE_CORE) -> DataFrame:
    pk = F.col("pk") % 8
    code = (F.when(pk == 0, "J210").when(pk == 1, "J09").when(pk == 2, "J101").when(pk == 3, "J110")
            .when(pk == 4, "A090").when(pk == 5, "J00").when(pk == 6, "I10").otherwise("E11"))
    return ln.where("ordered").select(
        F.col("k").alias("visit_occurrence_id"),
        F.when(F.col("n") % 2 == 0, F.col("id")).alias("visit_detail_id"),
        F.lit(source).alias("cdm_source"),
        F.when(F.col("rf") == "A", "DP").when(F.col("rf") == "N", "DR").otherwise("DAS")
        .alias("condition_status_source_value"),
        code.alias("condition_source_value"),
        F.col("o_orderdate").cast(NTZ).alias("condition_start_datetime"))


def note(ln: DataFrame, part: DataFrame) -> DataFrame:
    ptype = F.col("p_type")
    note_class = (F.when(ptype == "PROMO", "CR-CONS").when(ptype == "ECONOMY", "CR-CONS-ANESTH")
                  .when(ptype == "SMALL", "ORDO").otherwise("CR-HOSP"))
    return (ln.where("ordered")
            .join(part.select("p_partkey", "p_type", "p_name"), F.col("pk") == F.col("p_partkey"))
            .select(
                F.col("id").alias("note_id"),
                F.col("o_custkey").alias("person_id"),
                F.col("k").alias("visit_occurrence_id"),
                (F.col("o_orderdate").cast(NTZ) + _days(F.col("n"))).alias("note_datetime"),
                note_class.alias("note_class_source_value"),
                F.lit(C.STATUS_VALID).alias("row_status_source_value"),
                F.when(F.col("id") % 37 == 0, F.lit(None).cast("string")).otherwise(F.col("p_name"))
                .alias("note_text"),
                F.lit(C.SOURCE_CORE).alias("cdm_source")))


def person(customer: DataFrame) -> DataFrame:
    ck = F.col("c_custkey")
    birth = F.lit("1930-01-01 00:00:00").cast(NTZ) + _days((ck * 7919) % 25000)
    death = F.lit("2002-01-01 00:00:00").cast(NTZ) + _days(ck % 300)
    return customer.select(
        ck.alias("person_id"),
        birth.alias("birth_datetime"),
        F.when(ck % 17 == 0, death).alias("death_datetime"),
        F.when(ck % 2 == 0, "f").otherwise("m").alias("gender_source_value"),
        F.when(ck % 29 == 0, "Inactif").otherwise(C.STATUS_VALID).alias("status_source_value"),
        F.lit(C.SOURCE_CORE).alias("cdm_source"))


def note_ref(ln: DataFrame) -> DataFrame:
    sk = F.col("sk").cast("string")
    return ln.select(F.col("id").alias("note_id"), F.concat(F.lit("UF"), sk).alias("ufr_source_value"),
                     F.concat(F.lit("US"), sk).alias("us_source_value"))


def care_site_ref(supplier: DataFrame) -> DataFrame:
    sk = F.col("s_suppkey")
    return (supplier.select(F.concat(F.lit("UF"), sk.cast("string")).alias("care_site_source_value"),
                            (F.lit(2000000) + sk).cast("long").alias("care_site_id"))
            .unionByName(supplier.select(F.concat(F.lit("US"), sk.cast("string")).alias("care_site_source_value"),
                                         (F.lit(3000000) + sk).cast("long").alias("care_site_id"))))


def orbis_visite_calc(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    return orders.select(k.alias("ids_eds"), F.concat(F.lit("E"), k.cast("string")).alias("ids_eds_crypt"))


def ghm_facts(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    enc = F.concat(F.lit("E"), k.cast("string"))
    cmd = F.lpad((1 + k % 28).cast("string"), 2, "0")
    first = orders.where(k % 9 != 0).select(
        enc.alias("encounter_num"),
        F.concat(F.lit("GHM:"), cmd, F.lit("M0"), (k % 4).cast("string")).alias("concept_cd"),
        F.lit(C.SOURCE_CLAIMS).alias("sourcesystem_cd"))
    other = F.lpad((1 + (k + 7) % 28).cast("string"), 2, "0")  # a second group, so some stays have two
    second = orders.where(k % 41 == 0).select(
        enc.alias("encounter_num"),
        F.concat(F.lit("GHM:"), other, F.lit("C09")).alias("concept_cd"),
        F.lit(C.SOURCE_CLAIMS).alias("sourcesystem_cd"))
    return first.unionByName(second)


def claims_visit_occurrence(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    return orders.select((-k).alias("visit_occurrence_id"),
                         F.concat(F.lit("V"), k.cast("string")).alias("visit_occurrence_source_value"))


def claims_condition_occurrence(ln: DataFrame) -> DataFrame:
    core = condition_occurrence(ln, source=C.SOURCE_CLAIMS)
    return core.select((-F.col("visit_occurrence_id")).alias("visit_occurrence_id"), "cdm_source",
                       "condition_status_source_value", "condition_source_value", "condition_start_datetime")


def warehouse(spark: SparkSession, sf_dir: str, persist: bool = True, root: str | None = None) -> tuple[Tables, Tables, Tables]:
    """Build (core, reference, claims) table sets over one test-data folder, each table where it is first asked for.

    A real warehouse stores these tables; here they are views. What costs a shuffle, the lines with their orders and
    the notes, is written once under ``root`` if one is given; the other tables are projections of these or of a raw table.
    Without a root, each table is by default persisted (MEMORY_AND_DISK) once, and every later reference reads the
    stored rows instead of re-deriving the view (a lost block is recomputed from its lineage).
    """
    raw = read_raw(spark, sf_dir)
    orders = raw["orders"]

    def stored(name: str, df: DataFrame) -> DataFrame:
        if root:
            return spark.read.schema(df.schema).parquet(write_table(df, f"{root}/surrogate/{name}"))
        return df.persist() if persist else df

    @cache
    def ln() -> DataFrame:
        return stored("lines", lines(raw["lineitem"], orders))

    def tables(**builders: Callable[[], DataFrame]) -> Tables:
        return Tables({t: (lambda build=build: build().persist()) if persist and not root else build for t, build in builders.items()})

    core = tables(
        care_site=lambda: care_site(raw["nation"], raw["supplier"]),
        visit_occurrence=lambda: visit_occurrence(orders),
        visit_detail=lambda: visit_detail(ln()),
        condition_occurrence=lambda: condition_occurrence(ln()),
        note=lambda: stored("note", note(ln(), raw["part"])),
        person=lambda: person(raw["customer"]))
    reference = tables(note_ref=lambda: note_ref(ln()), care_site_ref=lambda: care_site_ref(raw["supplier"]))
    claims = tables(
        orbis_visite_calc=lambda: orbis_visite_calc(orders),
        i2b2_observation_fact_ghm=lambda: ghm_facts(orders),
        visit_occurrence=lambda: claims_visit_occurrence(orders),
        condition_occurrence=lambda: claims_condition_occurrence(ln()))
    return core, reference, claims
