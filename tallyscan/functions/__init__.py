"""Column functions: built-in Spark expressions only, no Python per row."""

from tallyscan.functions.amounts import clean_amount
from tallyscan.functions.currency import currency_code
from tallyscan.functions.dates import clean_date
from tallyscan.functions.text import (
    ascii_digits, computed, is_blank, is_upper, let, ordered_text, plain_spaces, strip, title_case,
)

__all__ = [
    "ascii_digits", "clean_amount", "clean_date", "computed", "currency_code", "is_blank", "is_upper", "let",
    "ordered_text", "plain_spaces", "strip", "title_case",
]
