"""Expression text for the long chains of patterns.

A chain of forty patterns is one parsed expression here, not hundreds of calls
into the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from tallyscan.fixed_values import DATE_YEAR_FIRST, DATE_YEAR_LAST, WHITESPACE, WIDE_WHITESPACE

MONEY = "decimal(28,2)"
# Wide classes are slow per character; a plain class in front settles nearly all characters.
WIDE_SPACE = rf"[^\t-\r -~](?<=[{WIDE_WHITESPACE}])"
NOISE = rf"[^0-9A-Za-z.+-](?<=[$€£¥₹,_\s{WIDE_WHITESPACE}])"
# a captured amount that clean_amount() accepts: a digit somewhere, at most 26 before the point
ACCEPTED_AMOUNT = r"^(?=.*\d)[0,]*(?:[1-9],*(?:\d,*){0,25})?(?:\.\d*)?$"
# More than ten decimals: the tail only matters as "more than a half", so one digit stands for it.
LONG_TAIL = r"^([+-]?\d*\.\d{9})\d*[1-9]\d*$"
# Text that is no number becomes one that is out of range: both end as null, but
# parsing the latter raises and catches no exception, which would cost far more than the parse.
NO_NUMBER = r"(?s)^(?![+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$).*$"
OUT_OF_RANGE = "1e99"
# Most amounts: stored as they stand, without any step. \z: a line end behind the number is white space to drop.
PLAIN_AMOUNT = r"^-?[0-9]{1,20}(?:\.[0-9]{1,2})?\z"

# Word boundaries spelled out: \b is Unicode-aware on some JDKs and ASCII-only on others.
_NO_WORD_BEFORE = r"(?<![\p{L}\p{N}_])"
_NO_WORD_AFTER = r"(?![\p{L}\p{N}_])"


def lit(text: str) -> str:
    """A raw string literal: backslashes stay as they are."""
    if "'" in text:
        raise ValueError("raw literals cannot hold a quote")
    return f"r'{text}'"


def java_regex(pattern: str, flags: str = "") -> str:
    """(?d): a line ends at LF only, whatever the platform calls a line end."""
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + _NO_WORD_AFTER
    if pattern.startswith(r"\b"):
        pattern = _NO_WORD_BEFORE + pattern[2:]
    return f"(?d{flags})" + pattern


def group(text: str, pattern: str, flags: str = "", index: int = 1) -> str:
    return f"regexp_extract({text}, {lit(java_regex(pattern, flags))}, {index})"


def matches(text: str, pattern: str, flags: str = "") -> str:
    return f"rlike({text}, {lit(java_regex(pattern, flags))})"


def replace(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, {lit(pattern)}, {lit(by)})"


def strip(text: str) -> str:
    return f"btrim({text}, {lit(WHITESPACE)})"


def plain_spaces(text: str) -> str:
    return replace(text, WIDE_SPACE, " ")


def has(text: str, *words: str) -> str:
    return "(" + " or ".join(f"contains({text}, {lit(w)})" for w in words) + ")"


def coalesce(parts: Sequence[str]) -> str:
    return "coalesce(" + ", ".join(parts) + ")"


def when(condition: str, value: str) -> str:
    return f"case when {condition} then {value} end"


# What is replaced, in turn, before a cast: the columns of ``amounts`` and ``dates`` take the same steps.
AMOUNT_STEPS = [(NOISE, ""), (NO_NUMBER, OUT_OF_RANGE), (LONG_TAIL, "$11")]
YEAR_LAST_STEPS = [
    (r"^(1[3-9]|[2-9]\d)[-/.](\d{1,2})[-/.](\d{4})$", "$3-$2-$1"), (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$", "$3-$1-$2"),
]


def amount(value: str) -> str:
    """See ``amounts.clean_amount``. The value is read once."""
    rest = "_v"
    for pattern, by in AMOUNT_STEPS:
        rest = replace(rest, pattern, by)
    rounded = f"try_cast(bround(try_cast({rest} as decimal(38,10)), 2) as {MONEY})"
    plain = f"case when rlike(_v, {lit(PLAIN_AMOUNT)}) then try_cast(_v as {MONEY}) else {rounded} end"
    return f"get(transform(array({value}), _v -> {plain}), 0)"


def first_match(value: str, pattern: str) -> str:
    """The match of a pattern in a short value, null when there is none; reads the value once."""
    return f"get(regexp_extract_all({value}, {lit(pattern)}, 0), 0)"


def captures(text: str, patterns: Sequence[str], flags: str = "") -> list[str]:
    """Per pattern the captured amount of its first match, null when it is not acceptable.

    ``amount(coalesce(captures))`` stops at the first hit and parses once.
    """
    return [first_match(group(text, p, flags), ACCEPTED_AMOUNT) for p in patterns]


def day(value: str) -> str:
    """See ``dates.clean_date``."""
    year_first = replace(group(value, DATE_YEAR_FIRST, index=0), "/", "-")
    year_last = group(value, DATE_YEAR_LAST, index=0)
    for pattern, by in YEAR_LAST_STEPS:
        year_last = replace(year_last, pattern, by)
    return coalesce([f"try_cast({replace(d, '^0000', '')} as date)" for d in (year_first, year_last)])
