"""Text predicates and formatting."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import col


def contains_regex(c, regex: str, case: bool = False) -> Column:
    """Regex *contains* test; NULL input is no match.

    Case-insensitive matching folds Unicode case too (``É`` matches ``é``, trap T2). A regex of plain words (``J09|J10``) is
    sought as such, without a matcher for each row; if case does not count, only where words and text are ASCII, whose
    letters fold among themselves.
    """
    text = col(c)
    if regex == ".*":
        return text.isNotNull()
    matched = text.rlike(("" if case else "(?iu)") + regex)
    words = regex.split("|")
    if all(words) and not set(regex) & set("\\^$.?*+()[]{}"):
        if case:
            matched = reduce(lambda a, b: a | b, [text.contains(w) for w in words])
        elif regex.isascii():
            plain = F.upper(text)
            matched = F.when(F.octet_length(text) == F.char_length(text), reduce(lambda a, b: a | b, [plain.contains(w.upper()) for w in words])).otherwise(matched)
    return F.coalesce(matched, F.lit(False))


def code_after_colon(c) -> Column:
    """Second ``:``-separated part of a concept code; NULL when there is none (H2)."""
    return F.nullif(F.split_part(col(c), F.lit(":"), F.lit(2)), F.lit(""))


def prefix(c, n: int) -> Column:
    """First ``n`` characters (H3)."""
    return F.substring(col(c), 1, n)


def starting_date_label(c) -> Column:
    """``Starting date: Mon YYYY``."""
    return F.concat(F.lit("Starting date: "), F.date_format(col(c), "MMM yyyy"))


def relabel(c: str | Column, labels: Mapping[str, str]) -> Column:
    """A column's values by their labels; a value without one stays."""
    column = F.col(c) if isinstance(c, str) else c
    out = None
    for value, label in labels.items():
        out = F.when(column == value, F.lit(label)) if out is None else out.when(column == value, F.lit(label))
    return column if out is None else out.otherwise(column)
