"""Currency code out of a short value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyscan.fixed_values import CURRENCY_CODES, CURRENCY_SYMBOLS


def first_symbol(col: Column) -> Column:
    return F.coalesce(*[F.when(col.contains(s), code) for s, code in CURRENCY_SYMBOLS.items()])


def currency_code(col: Column) -> Column:
    """First code of the list contained anywhere, else first symbol of the list."""
    codes = [F.when(F.upper(col).contains(code), code) for code in CURRENCY_CODES]
    return F.coalesce(*codes, first_symbol(col))
