"""Student-t tail probabilities and quantiles (I7) as column expressions.

Degrees of freedom are whole numbers here (months minus two), for which the distribution
is a finite sum of powers of a cosine; no Python runs on executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BISECTIONS = 60


def t_two_sided_p(t: Column, dof: Column) -> Column:
    """``P(|T| >= |t|)`` for Student's t with a whole number ``dof >= 1`` of degrees of freedom; NULL otherwise."""
    nu = dof.cast("int")
    angle = F.atan(F.abs(t) / F.sqrt(nu))
    square = F.cos(angle) * F.cos(angle)
    odd = nu % 2 == 1
    terms = F.when(odd, F.floor((nu - 1) / 2)).otherwise(F.floor(nu / 2)).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"))

    def step(acc: Column, k: Column) -> Column:
        ratio = F.when(odd, (2 * k + 2) / (2 * k + 3)).otherwise((2 * k + 1) / (2 * k + 2))
        return F.struct((acc["term"] * square * ratio).alias("term"), (acc["total"] + acc["term"]).alias("total"))

    every = F.when(terms > 0, F.sequence(F.lit(0), terms - 1)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(every, start, step, lambda acc: acc["total"])
    inside = F.when(odd, (angle + F.sin(angle) * F.cos(angle) * total) * (2 / math.pi)).otherwise(F.sin(angle) * total)
    return F.when(nu >= 1, F.greatest(1 - inside, F.lit(0.0)))


def t_quantile(p: float, dof: Column) -> Column:
    """``t`` with ``P(T <= t) = p`` (0.5 <= p < 1), by bisection: no quantile exceeds that of one degree of freedom."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(math.tan(math.pi * (p - 0.5)) + 1e-9).alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        middle = (acc["lo"] + acc["hi"]) / 2
        above = t_two_sided_p(middle, dof) > 2 * (1 - p)
        return F.struct(F.when(above, middle).otherwise(acc["lo"]).alias("lo"),
                        F.when(above, acc["hi"]).otherwise(middle).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), start, step, lambda acc: (acc["lo"] + acc["hi"]) / 2)
    return F.when(dof >= 1, found)
