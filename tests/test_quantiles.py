"""Exact nearest-rank quantiles by distributed rank selection."""

import math
import random

from pyspark.sql import functions as F

from tempovar.operators.quantiles import nearest_ranks

QS = [0.0, 0.25, 0.5, 0.75, 1.0]


def brute(values):
    v = sorted(x for x in values if x is not None)
    return [v[math.floor((len(v) - 1) * q + 0.5)] for q in QS] if v else None


def check(spark, columns):
    names = list(columns)
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in names))
    got = {r.name: r["values"] for r in nearest_ranks(df, names, QS).collect()}
    assert got == {c: b for c, v in columns.items() if (b := brute(v))}


def test_ties_nulls_and_extremes(spark):
    rng = random.Random(4)
    n = 400
    check(spark, {
        "same": [0.5] * n, "none": [None] * n, "few": [None] * (n - 2) + [3.0, -1.0], "ties": [rng.choice([0.0, 0.1, 0.1, 0.9]) for _ in range(n)],
        "apart": [rng.choice([0.0, 1e-9, 1.0, 1e9]) for _ in range(n)], "random": [rng.gauss(0, 1) for _ in range(n)],
        "holes": [rng.random() if rng.random() < 0.5 else None for _ in range(n)]})


def test_small_sizes(spark):
    for n in range(1, 8):
        check(spark, {"v": [float(i * i) for i in range(n)]})


def test_a_million_rows_without_gathering_a_column(spark):
    n = 1_000_000
    df = spark.range(n).select(((F.col("id") * 7919) % n / n).alias("spread"), (F.col("id") % 3).cast("double").alias("ties"))
    ranks = nearest_ranks(df, ["spread", "ties"], QS)
    got = {r.name: r["values"] for r in ranks.collect()}
    assert got["spread"] == [math.floor((n - 1) * q + 0.5) / n for q in QS] and got["ties"] == [0.0, 0.0, 1.0, 2.0, 2.0]
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(ranks._jdf.queryExecution(), "simple")
    assert "collect_list(v" not in plan
    df = spark.createDataFrame([], "v double")
    assert nearest_ranks(df, ["v"], QS).collect() == []
