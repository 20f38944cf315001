"""Rule extraction over a table of texts.

Every extractor is one expression over the columns made by ``normalise_text``.
Cheap substring tests stand in front of the patterns: a document without the word
"total" never starts a pattern for it. ``coalesce`` stops at the first pattern
whose first match gives an acceptable value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscan import fixed_values as fv
from tallyscan.functions import is_upper, plain_spaces, strip, title_case
from tallyscan.functions import sqltext as sql
from tallyscan.functions.sqltext import MONEY, amount, captures, coalesce, first_match, has, lit, matches, when
from tallyscan.operators.reconcile import field_exclusivity, reconcile_amounts
from tallyscan.operators.text_assembly import normalise_text

# a digit and a letter in any order, three characters at least; or four digits at least
_ACCEPTED_NUMBER = r"^(?=.*\d)(?=.*[A-Z]).{3,}$|^\d{4,}$"
_DATES = [f"_date{i}" for i in range(len(fv.DATE_KEYWORDS))]


def invoice_number(lower: str = "text_lower") -> Column:
    """Upper-cased; a candidate without a digit (so every label word) is refused."""
    accepted = [first_match(f"upper({sql.group(lower, p, 'i')})", _ACCEPTED_NUMBER) for p in fv.NUMBER_PATTERNS]
    return F.expr(when(has(lower, "inv"), coalesce(accepted)))


def date_contexts(text: str = "text", lower: str = "text_lower") -> list[Column]:
    """Per keyword the 100 characters from its first position on, null when absent."""
    cut = "substring({0}, locate({1}, {2}), {3})"
    return [
        F.expr(when(has(lower, k), cut.format(text, lit(k), lower, fv.DATE_CONTEXT_CHARS))).alias(name)
        for name, k in zip(_DATES, fv.DATE_KEYWORDS)
    ]


def date_from_contexts() -> Column:
    return F.expr(coalesce([sql.day(c) for c in _DATES]))


def header(text: str = "text") -> str:
    return f"substring({text}, 1, {fv.HEADER_CHARS})"


def vendor_labelled_raw(text: str = "text") -> Column:
    """Name behind a label, white space collapsed, cut before a trailing field word."""
    name = sql.strip(sql.group(sql.plain_spaces(header(text)), fv.VENDOR_PATTERN, "im"))
    return F.expr(sql.replace(sql.replace(name, r"\s+", " "), sql.java_regex(fv.VENDOR_TAIL, "i"), ""))


def vendor_from_raw(raw: Column) -> Column:
    return F.when(F.length(raw).between(2, 100), title_case(raw))


def vendor_fallback(head: Column) -> Column:
    """First company-like line among header lines 2 to 10."""
    skip = sql.java_regex("|".join(fv.VENDOR_SKIP), "i")
    lines = F.transform(F.slice(F.split(head, "\n"), 2, fv.HEADER_LINES - 1), strip)

    def company_like(line: Column) -> Column:
        first = F.substring(line, 1, 1)
        return (
            F.length(line).between(4, 49)
            & (is_upper(first) | is_upper(line))
            & ~plain_spaces(line).rlike(skip)
            & ~line.rlike("[0-9]{4,}")
        )

    return F.get(F.filter(lines, company_like), F.lit(0))


def _table_then_line(lower: str, table: list[str], line: list[str]) -> str:
    in_table = when(has(lower, "|"), coalesce(captures(lower, table, "i")))
    return amount(coalesce([in_table, *captures(lower, line)]))


def subtotal(lower: str = "text_lower") -> Column:
    found = _table_then_line(lower, fv.SUBTOTAL_TABLE_PATTERNS, fv.SUBTOTAL_PATTERNS)
    return F.expr(when(has(lower, "total"), found))


def tax_amount(lower: str = "text_lower") -> Column:
    return F.expr(when(has(lower, "tax"), _table_then_line(lower, fv.TAX_TABLE_PATTERNS, fv.TAX_PATTERNS)))


def vat_amount(lower: str = "text_lower") -> Column:
    return F.expr(when(has(lower, "vat", "added"), amount(coalesce(captures(lower, fv.VAT_PATTERNS)))))


def discount(lower: str = "text_lower") -> Column:
    """Always stored as a negative amount."""
    found = _table_then_line(lower, fv.DISCOUNT_TABLE_PATTERNS, fv.DISCOUNT_PATTERNS)
    return F.expr(when(has(lower, "discount"), f"cast(-abs({found}) as {MONEY})"))


def total(lower: str = "text_lower") -> Column:
    return F.expr(when(has(lower, "total", "amount"), amount(coalesce(captures(lower, fv.TOTAL_PATTERNS, "m")))))


def currency_explicit(lower: str = "text_lower") -> Column:
    """A code as a whole word in list order, else a symbol in list order."""
    codes = [
        f"when {has(lower, c.lower())} and {matches(lower, rf'\b{c.lower()}\b')} then '{c}'" for c in fv.CURRENCY_CODES
    ]
    symbols = [f"when {has(lower, s)} then '{c}'" for s, c in fv.CURRENCY_SYMBOLS.items()]
    return F.expr(f"case {' '.join([*codes, *symbols])} end")


def currency_inferred(text: str = "text", lower: str = "text_lower") -> Column:
    """Dollar misread as 5 or S, or a code glued to the word "currency".

    Meant for texts in which ``currency_explicit`` found nothing. Atomic groups
    pin the first keyword or amount of a line, as what follows a later one follows the first, so a long line is read once.
    An amount whose 5 ends a line is a case of its own. Of several overlapping tests only those are kept that can decide:
    the widest misread-5 form holds the narrower ones, and a text with an indicator
    of its own always has an amount.
    """
    five_amount = sql.java_regex(fv.MISREAD_FIVE_AMOUNT).removeprefix("(?d)")
    before = rf"^(?>.*?(?:total|amount|price|cost|due|fee)).*?{five_amount}"
    amount_end = sql.java_regex(fv.MISREAD_FIVE_AMOUNT.removeprefix(r"\b5\s*")).removeprefix("(?d)")
    five = five_amount.removesuffix(r"\s*" + amount_end)
    after = rf"^(?>.*?{five}[^\S\n]*+{amount_end}).*?(?:total|amount|due)"
    after_break = rf"{five}[^\S\n]*+\n\s*+{amount_end}.*?(?:total|amount|due)"
    near_word = (
        f"({has(lower, 'total', 'amount', 'price', 'cost', 'due', 'fee')} and {matches(lower, before, 'm')}"
        f" or {has(lower, 'total', 'amount', 'due')} and ({matches(lower, after, 'm')} or {matches(lower, after_break)}))"
    )
    misread = f"{has(lower, '5')} and {matches(lower, fv.MISREAD_FIVE_AMOUNT)} and {near_word}"

    labels = [
        f"get(regexp_extract_all({lower}, {lit(sql.java_regex(p))}, 1), 0)" for p in fv.CURRENCY_LABEL_PATTERNS
    ]
    labelled = f"upper({when(has(lower, 'currency'), coalesce(labels))})"

    plain = sql.plain_spaces(text)
    apart, letter, five_long = [matches(plain, p) for p in fv.DOLLAR_INDICATORS]
    indicator = (
        f"({has(text, '$')} or {has(text, 'S')} and {letter} or {has(text, '5')} and ({apart} or {five_long}))"
    )
    priced = matches(lower, r"^(?>.*?(?:price|cost|fee)).*?[\d,]\.\d{2}", "m")
    in_invoice = f"({has(lower, *fv.INVOICE_KEYWORDS)} or {priced})"
    some_amount = matches(lower, r"[\d,]\.\d{2}")
    indicated = f"{some_amount} and {indicator} and {in_invoice}"
    return F.expr(coalesce([when(misread, "'USD'"), labelled, when(indicated, "'USD'")]))


def tax_normalised(tax: str = "_tax", vat: str = "_vat") -> list[Column]:
    """VAT wins over tax; amount and type."""
    kind = f"case when {vat} is not null then 'vat' when {tax} is not null then 'sales_tax' end"
    return [F.expr(f"coalesce({vat}, {tax})").alias("tax_amount"), F.expr(kind).alias("tax_type")]


def raw_rule_fields(docs: DataFrame) -> DataFrame:
    """The ten extractors in one narrow pass, no shuffle.

    Keeps every column of ``docs`` but the text. Two projections: the first cuts
    the small pieces the second reads more than once.
    """
    keep = [c for c in docs.columns if c != "text"]
    pieces = normalise_text(docs).select(
        *keep,
        F.expr(header()).alias("_header"),
        vendor_labelled_raw().alias("_vendor"),
        *date_contexts(),
        invoice_number().alias("invoice_number"),
        subtotal().alias("subtotal"),
        discount().alias("discount"),
        tax_amount().alias("_tax"),
        vat_amount().alias("_vat"),
        total().alias("total"),
        currency_explicit().alias("_explicit"),
        "text",
        "text_lower",
    )
    return pieces.select(
        *keep,
        "invoice_number",
        date_from_contexts().alias("invoice_date"),
        F.coalesce(vendor_from_raw(F.col("_vendor")), vendor_fallback(F.col("_header"))).alias("vendor_name"),
        "subtotal",
        "discount",
        *tax_normalised(),
        F.expr("cast(null as boolean)").alias("tax_inferred"),
        "total",
        F.coalesce(F.col("_explicit"), currency_inferred()).alias("currency"),
    )


def rule_fields(docs: DataFrame) -> DataFrame:
    """All rule fields of ``docs(doc_id, text, ...)``, reconciled and checked for exclusivity."""
    return field_exclusivity(reconcile_amounts(raw_rule_fields(docs)))


def extract_one(docs: DataFrame, field: str) -> DataFrame:
    """(doc_id, value) of a single extractor, for callers that want one field."""
    prepared = normalise_text(docs).select("doc_id", "text", "text_lower")
    if field == "invoice_date":
        return prepared.select("doc_id", *date_contexts()).select("doc_id", date_from_contexts().alias("value"))
    if field == "vendor_labelled":
        cut = prepared.select("doc_id", vendor_labelled_raw().alias("_vendor"))
        return cut.select("doc_id", vendor_from_raw(F.col("_vendor")).alias("value"))
    if field == "vendor_fallback":
        cut = prepared.select("doc_id", F.expr(header()).alias("_header"))
        return cut.select("doc_id", vendor_fallback(F.col("_header")).alias("value"))
    extractor = {
        "invoice_number": invoice_number,
        "subtotal": subtotal,
        "tax_amount": tax_amount,
        "vat_amount": vat_amount,
        "discount": discount,
        "total": total,
        "currency_explicit": currency_explicit,
        "currency_inferred": currency_inferred,
    }[field]
    return prepared.select("doc_id", extractor().alias("value"))
