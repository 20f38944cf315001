"""Money: text to DECIMAL(28,2), half-even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyscan.functions.sqltext import AMOUNT_STEPS, MONEY, PLAIN_AMOUNT
from tallyscan.functions.text import let

__all__ = ["MONEY", "clean_amount"]


def clean_amount(col: Column) -> Column:
    """Drops currency symbols, commas and white space, then parses.

    Rounds half to even at two places. Null when the rest is no number or has
    more than 26 integer digits. The input is read once, so a costly ``col`` (a pattern
    over a whole text) is never evaluated twice; a number that is stored as it stands takes no steps.
    """

    def cleaned(raw: Column) -> Column:
        rest = raw
        for pattern, by in AMOUNT_STEPS:
            rest = F.regexp_replace(rest, pattern, by)
        rounded = F.bround(rest.try_cast("decimal(38,10)"), 2).try_cast(MONEY)
        return F.when(raw.rlike(PLAIN_AMOUNT), raw.try_cast(MONEY)).otherwise(rounded)

    return let(col, cleaned)
