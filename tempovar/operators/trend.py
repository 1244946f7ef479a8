"""Linear trend per partition (D15, C21, E5, I7, H17) with built-in regression aggregates.

Each partition (site, threshold, parameter cell, analysis) counts the months
from its start date to the last month of the whole table, missing ones as 0
(T16, T17); ``x`` is the month index. The zero-filled least squares is done in
closed form from three sums over the observed rows. The p-value and the 95 %
intervals take the Student-t distribution as column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_diff
from ..functions.stats import t_quantile, t_two_sided_p

TREND_INDEX = ["MCD", "care_site_id", "threshold", "param_id", "start_observation_date", "max_error", "min_c_0",
               "max_error_label", "min_c_0_label", "analysis", "outcome_name"]


#: Months up to which ``significance`` looks the quantile up.
TABLE_MONTHS = 240
#: Differences of sums below this share of the sums are round-off.
ROUND_OFF = 1e-12


def trend_index(df: DataFrame) -> list[str]:
    return [c for c in TREND_INDEX if c in df.columns]


def _settled(value: Column, scale: Column) -> Column:
    """Zero in place of what is only round-off beside ``scale``."""
    return F.when(F.abs(value) <= ROUND_OFF * scale, F.lit(0.0)).otherwise(value)


def linear_trend(df: DataFrame, y: str = "rate", x: str = "sub_cohort", index: Sequence[str] | None = None,
                 start_col: str = "start_observation_date", last: Column | None = None) -> DataFrame:
    """Per partition ``n, alpha_0, alpha_1, se_alpha_0, se_alpha_1, t_alpha_1, mean_value``.

    Same result as filling every month from the partition's start to the last
    month of the table with 0 and regressing on the month index (C21, T16, T17),
    but in closed form: a missing month adds nothing to the sums of ``y``,
    ``x*y`` and ``y^2``, and ``x = 0..n-1`` has known sums, so one aggregate over
    the observed rows suffices (no month grid, no join). NULL when there is no
    spread or fewer than 3 points (T15). ``last`` is the last month, if ``df`` is only a part of the table.
    """
    index = list(index or trend_index(df))
    last = df.agg(F.max(x)).scalar() if last is None else last
    start = F.col(start_col).cast("date")
    xi = month_diff(F.col(x), start).cast("double")
    yv = F.coalesce(F.col(y).cast("double"), F.lit(0.0))
    agg = (df.groupBy(*index)
           .agg(F.sum(yv).alias("_sy"), F.sum(xi * yv).alias("_sxy_raw"), F.sum(yv * yv).alias("_syy_raw"))
           .withColumn("n", (month_diff(last, start) + 1).cast("long")))
    n = F.col("n").cast("double")
    sum_x = n * (n - 1) / 2.0
    sxx = n * (n * n - 1) / 12.0
    sxy = F.col("_sxy_raw") - sum_x * F.col("_sy") / n
    syy = _settled(F.col("_syy_raw") - F.col("_sy") * F.col("_sy") / n, F.col("_syy_raw"))
    spread = sxx > 0
    slope = F.when(spread, _settled(sxy, F.sqrt(F.col("_syy_raw") * sxx)) / sxx)
    out = (agg.withColumn("alpha_1", slope)
           .withColumn("alpha_0", F.when(spread, F.col("_sy") / n - slope * (n - 1) / 2.0))
           .withColumn("mean_value", F.col("_sy") / n))
    ok = (F.col("n") >= 3) & spread
    resid = F.greatest(_settled(syy - sxy * sxy / sxx, F.col("_syy_raw")), F.lit(0.0))
    out = (out.withColumn("se_alpha_1", F.when(ok, F.sqrt(resid / (n - 2) / sxx)))
              .withColumn("se_alpha_0", F.when(ok, F.sqrt(resid / (n - 2) * (1.0 / n + ((n - 1) / 2.0) ** 2 / sxx))))
              .withColumn("t_alpha_1", F.when(ok & (F.col("se_alpha_1") > 0), F.col("alpha_1") / F.col("se_alpha_1"))))
    return out.drop("_sy", "_sxy_raw", "_syy_raw")


def significance(trend: DataFrame) -> DataFrame:
    """Two-sided slope p-value and 95 % intervals of both coefficients.

    An exact fit with a slope has p = 0; without one (all values equal) p is NULL. The quantile of a
    number of months comes from a literal-sized table, beyond ``TABLE_MONTHS`` from the expression itself.
    """
    spark = trend.sparkSession
    table = spark.range(3, TABLE_MONTHS + 1).select(F.col("id").alias("_n"), t_quantile(0.975, F.col("id") - 2).alias("_q"))
    dof = F.col("n") - 2
    exact = (F.col("se_alpha_1") == 0) & (F.col("alpha_1") != 0)
    out = (trend.withColumn("p_value", F.when(exact, F.lit(0.0))
                            .when(F.col("t_alpha_1").isNotNull(), t_two_sided_p(F.col("t_alpha_1"), dof)))
           .join(F.broadcast(table), F.col("n") == F.col("_n"), "left"))  # TABLE_MONTHS rows, whatever the data
    quantile = F.when(F.col("n") > TABLE_MONTHS, t_quantile(0.975, dof)).otherwise(F.col("_q"))
    out = out.withColumn("_quantile", quantile)
    for c in ("alpha_0", "alpha_1"):
        out = (out.withColumn(f"{c}_ci_low", F.col(c) - F.col("_quantile") * F.col(f"se_{c}"))
                  .withColumn(f"{c}_ci_high", F.col(c) + F.col("_quantile") * F.col(f"se_{c}")))
    return out.drop("_n", "_q", "_quantile")


def _sci(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.2e", c))


def as_text(trend: DataFrame) -> DataFrame:
    """``estimate [low, high]`` in scientific notation; p below 0.001 as ``< 10e-3``; NULL stays NULL."""
    out = trend.withColumn("p_value_text", F.when(F.col("p_value") < 0.001, F.lit("< 10e-3"))
                           .when(F.col("p_value").isNotNull(), F.format_string("%.3f", F.col("p_value"))))
    for c in ("alpha_0", "alpha_1"):
        out = out.withColumn(f"{c}_text", F.concat(_sci(F.col(c)), F.lit(" ["), _sci(F.col(f"{c}_ci_low")),
                                                    F.lit(", "), _sci(F.col(f"{c}_ci_high")), F.lit("]")))
    return out


def long_form(trend_text: DataFrame, index: Sequence[str] | None = None) -> DataFrame:
    """The text trend unpivoted to (model, value)."""
    index = list(index or trend_index(trend_text))
    return trend_text.unpivot(index, ["p_value_text", "alpha_0_text", "alpha_1_text"], "model", "value")
