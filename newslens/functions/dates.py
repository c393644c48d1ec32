"""Date-string handling of the article table (``datetime`` is text ``yyyyMMdd[HHmmss]``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newslens.functions import patterns as P


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def format_datetime(c) -> Column:
    """ISO text → compact digits: keep the part before the first ``+``, drop ``T - :`` and spaces.

    ``Z`` and negative offsets stay as characters, as in the original rule.
    """
    return F.translate(F.split_part(_c(c), F.lit("+"), F.lit(1)), "T-: ", "")


def month_prefix(c) -> Column:
    return F.substring(_c(c), 1, 6)


def month_floor_ok(c, floor: int | None) -> Column:
    """Load-time month filter: unknown dates are kept, known ones need ``yyyyMM >= floor``."""
    if floor is None:
        return F.lit(True)
    m = month_prefix(c)
    numeric = m.rlike(P.ALL_ASCII_DIGITS) & (m.try_cast("int") >= F.lit(floor))
    return _c(c).isNull() | (m == F.lit("nan")) | F.coalesce(numeric, F.lit(False))


def has_digit_date(c) -> Column:
    """At least eight leading digits (the month analyses skip other rows)."""
    return F.coalesce(_c(c).rlike(P.DIGIT_DATE), F.lit(False))


def month_of(c) -> Column:
    """First day of the ``yyyyMM`` month of the text; an impossible month gives NULL."""
    return F.to_date(F.try_to_timestamp(month_prefix(c), F.lit("yyyyMM")))


def month_label(c, fmt: str = "MM/yyyy") -> Column:
    """Display form of a month (the slider shows ``MM/YYYY``, chart axes ``MMM yyyy``)."""
    return F.date_format(_c(c), fmt)
