"""Date expressions (H4-H8, H11, H15, B6). All JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NTZ = "timestamp_ntz"

# The range a nanosecond timestamp can hold.
NS_MIN = "1677-09-21 00:12:43.145224"
NS_MAX = "2262-04-11 23:47:16.854775"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts(value: str) -> Column:
    """A zone-less timestamp literal."""
    return F.lit(value).cast(NTZ)


def in_ns_range(c) -> Column:
    """True unless the date is outside the nanosecond range; NULL counts as in range (trap T1)."""
    c = col(c)
    return c.isNull() | ((c >= ts(NS_MIN)) & (c <= ts(NS_MAX)))


def month_start(c) -> Column:
    """First day of the month, as a DATE (H4)."""
    return F.trunc(col(c), "month")


def week_start(c) -> Column:
    """Monday of the ISO week, as a DATE."""
    return F.date_trunc("week", col(c)).cast("date")


def years_between_birthdays(later, earlier) -> Column:
    """Whole years from ``earlier`` to ``later``: year difference minus one if the birthday is yet to come (H5)."""
    later, earlier = col(later), col(earlier)
    not_yet = (F.date_format(later, "MM-dd") < F.date_format(earlier, "MM-dd")).cast("int")
    return F.year(later) - F.year(earlier) - not_yet


def season_year(c) -> Column:
    """School / epidemic season: September onward belongs to the next year."""
    c = col(c)
    return F.year(c) + (F.month(c) > 8).cast("int")


def month_diff(a, b) -> Column:
    """Signed month difference a - b by calendar months."""
    a, b = col(a), col(b)
    return (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)


def month_grid(start, end) -> Column:
    """Array of month starts from the month of ``start`` (snapped up to a month start) to ``end`` inclusive."""
    s = col(start).cast("date")
    first = F.when(F.trunc(s, "month") == s, s).otherwise(F.add_months(F.trunc(s, "month"), 1))
    return F.sequence(first, month_start(end), F.expr("interval 1 month"))
