"""Dates: the first year-first date, else the first year-last one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyscan.fixed_values import DATE_YEAR_FIRST, DATE_YEAR_LAST
from tallyscan.functions.sqltext import YEAR_LAST_STEPS


def clean_date(col: Column) -> Column:
    """Null when neither form gives a real calendar day; year 0000 is none.

    In the year-last form a first part above 12 is a day, any other a month.
    """
    year_first = F.regexp_replace(F.regexp_extract(col, DATE_YEAR_FIRST, 0), "/", "-")
    year_last = F.regexp_extract(col, DATE_YEAR_LAST, 0)
    for pattern, by in YEAR_LAST_STEPS:
        year_last = F.regexp_replace(year_last, pattern, by)
    return F.coalesce(*[F.regexp_replace(d, "^0000", "").try_cast("date") for d in (year_first, year_last)])
