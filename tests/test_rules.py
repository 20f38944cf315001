"""Golden rows of the rules, reconciliation and validation; one batch per test."""

import re
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyscan.functions import clean_amount, clean_date, currency_code, title_case
from tallyscan.operators import rules
from tallyscan.operators.reconcile import field_exclusivity, reconcile_amounts, validate_accounting
from tallyscan.operators.rules import extract_one, rule_fields

H = "Invoice No: INV-001\nInvoice Date: 2025-12-30\n"


@pytest.fixture(scope="module")
def run(spark):
    def run(*texts):
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        rows = validate_accounting(rule_fields(docs)).orderBy("doc_id").collect()
        assert len(rows) == len(texts)
        return rows

    return run


def test_whole_invoice(run):
    (r,) = run(
        "INVOICE\nFrom: Acme Trading Co\nInvoice No: INV-001\nInvoice Date: 2025-12-30\n"
        "Subtotal: $1,000.00\nTax (10%): $100.00\nTotal: $1,100.00"
    )
    assert (r.invoice_number, r.invoice_date, r.vendor_name) == ("INV-001", date(2025, 12, 30), "Acme Trading Co")
    assert (r.subtotal, r.tax_amount, r.tax_type, r.total) == (Decimal("1000.00"), Decimal("100.00"), "sales_tax", Decimal("1100.00"))
    assert r.currency == "USD" and r.is_valid and r.discount is None


def test_reconciliation_branches(run):
    rows = run(
        H + "Subtotal: $1,798.39\nDiscount: -$179.84\nTax: $80.93\nTotal: $1,699.48",
        H + "Subtotal: $100.00\nTotal: $110.00",
        H + "Subtotal: $100.00\nTax: $10.00\nTotal: $105.00",
        H + "Subtotal: $100.00\nTotal: $90.00",
        H + "Subtotal: $100.00\nTax: $10.00\nTotal: $120.00",
        H + "Subtotal: $100.00\nTax: $10.00\nTotal: $110.01",
        H + "Subtotal: $100.00\nTax: $10.00\nTotal: $110.02",
        H + "Subtotal: $100.00\nTax: $10.00\nTotal: $109.98",
        H + "Subtotal: 100.00\nTax 10%: $80.00\nTotal: 180.00",
    )
    assert rows[0].reconciliation_error == "Expected total: 2059.16, Found: 1699.48, Difference: 359.68" and rows[0].is_valid
    assert (rows[1].tax_amount, rows[1].tax_inferred, rows[1].is_valid) == (Decimal("10.00"), True, True)
    assert (rows[2].discount, rows[2].is_valid) == (Decimal("-5.00"), True)
    assert (rows[3].tax_amount, rows[3].discount, rows[3].is_valid) == (None, Decimal("-10.00"), True)
    assert rows[4].reconciliation_error == "Expected total: 110.00, Found: 120.00, Difference: 10.00"
    assert rows[4].validation_error == (
        "Math validation failed: total (120.00) ≠ subtotal (100.00) + tax (10.00) + discount (0). Expected: 110.00, Difference: 10.00"
    )
    assert rows[5].reconciliation_status is None and rows[5].is_valid
    assert rows[6].reconciliation_status == "inconsistent" and rows[6].is_valid
    assert rows[7].discount == Decimal("-0.02") and rows[7].is_valid
    assert rows[8].tax_amount == Decimal("10.00") and not rows[8].is_valid


def test_misread_signs(run):
    rows = run(
        "Subtotal: 5 1,798.39", "| Subtotal | | 5 1,798.39 |", "| Subtotal | | S1,798.39 |", "Subtotal: S1,798.39",
        "Total: 500.00", "Total: 400.00", "x\nPaid fee 5 100.00", "Currencyeur 12", "Sub Total: 100.00\nTotal: 110.00",
        "Sub Total: 100.00\nInvoice Total: 110.00",
        "subtotal , due later, subtotal 5 100.00",
    )
    assert [r.subtotal for r in rows[:4]] == [Decimal("5.00"), Decimal("1798.39"), Decimal("1798.39"), None]
    assert [r.currency for r in rows[4:8]] == ["USD", None, "USD", "EUR"]
    assert [r.total for r in rows[8:10]] == [Decimal("110.00"), Decimal("100.00")]
    assert rows[10].subtotal == Decimal("100.00")  # a comma alone is no amount: the next pattern decides


def test_number_date_vendor(run):
    rows = run(
        "Invoice Notes: see below\nInvoice No: 12345", "Invoice No: 123", "Invoice No: 1234", "Tax: 5.00\nVAT 20%: 50.00",
        "Invoice No: AMOUNT", " \n\t ", None, "Date: 13/05/2024", "Date: 05/06/2024", "Date: 31/31/2024", "Date: 2024.01.15",
        "Date: 0000-01-01", "x\nACME LTD\nInvoice", "Vendor: o malley-smith & co",
    )
    assert [r.invoice_number for r in rows[:3]] == [None, None, "1234"]
    assert (rows[3].tax_amount, rows[3].tax_type) == (Decimal("20.00"), "vat")
    assert rows[4].invoice_number is None
    for r in rows[5:7]:
        assert r.validation_error == "Invoice number is missing or empty" and r.vendor_name is None and r.currency is None
    assert [r.invoice_date for r in rows[7:12]] == [date(2024, 5, 13), date(2024, 5, 6), None, None, None]
    assert rows[12].vendor_name == "ACME LTD"
    assert rows[13].vendor_name == "O Malley-Smith & Co"


def test_single_extractors_agree_with_the_whole(spark, run):
    texts = [H + "From: Abc Def\nSubtotal: 10.00\nTax: 1.00\nDiscount: 2\nTotal: 9.00 EUR", "Total 5100.00"]
    whole = run(*texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for field in ("invoice_number", "invoice_date", "subtotal", "total"):
        assert [r.value for r in extract_one(docs, field).orderBy("doc_id").collect()] == [r[field] for r in whole]


def test_normalisers(spark):
    amounts = ["1.005", "1.015", ",", "5.", ".5", "NaN", "1e3", "$ 1,234.50", "1_000", "1.01499999999999", "9" * 27, "", None, "-3.005"]
    got = spark.createDataFrame([(a,) for a in amounts], "a string").select(clean_amount(F.col("a")).cast("string")).collect()
    assert [r[0] for r in got] == [
        "1.00", "1.02", None, "5.00", "0.50", None, "1000.00", "1234.50", "1000.00", "1.01", None, None, None, "-3.00",
    ]
    days = ["on 2024-2-3", "2024-02-30", "30/02/2024", "13.12.2023", "2024-13-01 then 01/02/2023", None]
    got = spark.createDataFrame([(d,) for d in days], "d string").select(clean_date(F.col("d")).cast("string")).collect()
    assert [r[0] for r in got] == ["2024-02-03", None, None, "2023-12-13", "2023-01-02", None]
    codes = ["12 euros", "£ and $", "inr usd", "kr"]
    got = spark.createDataFrame([(c,) for c in codes], "c string").select(currency_code(F.col("c"))).collect()
    assert [r[0] for r in got] == ["EUR", "USD", "USD", None]
    got = spark.sql("select 'o''reilly & CO-op' as n").select(title_case(F.col("n"))).first()[0]
    assert got == "O'Reilly & Co-Op"


def test_header_word_exclusivity_and_idempotence(spark):
    schema = (
        "doc_id long, invoice_number string, invoice_date date, subtotal decimal(28,2), discount decimal(28,2), "
        "tax_amount decimal(28,2), tax_type string, tax_inferred boolean, total decimal(28,2)"
    )
    d = Decimal
    rows = [
        (0, " Amount ", date(2024, 1, 1), d("1.00"), None, None, None, None, d("1.00")),
        (1, "A1", date(2024, 1, 1), d("1.00"), d("-2.00"), d("-1.00"), "vat", None, d("5.00")),
        (2, "A1", date(2024, 1, 1), None, None, None, None, None, d("5.00")),
    ]
    df = spark.createDataFrame(rows, schema)
    errors = [r.validation_error for r in validate_accounting(df).orderBy("doc_id").collect()]
    assert errors[0] == "Invoice number ' Amount ' is a table header, not a valid invoice number"
    assert errors[2].startswith("Math validation failed: total (5.00) ≠ subtotal (0) + tax (0) + discount (0). Expected: 0,")
    one = field_exclusivity(df).where("doc_id = 1").first()
    assert (one.discount, one.tax_amount, one.tax_type) == (None, None, None)
    once = reconcile_amounts(df.where("doc_id <> 2"))
    assert sorted(map(str, reconcile_amounts(once).collect())) == sorted(map(str, once.collect()))


def test_wide_spaces_and_other_digits(spark):
    from tallyscan.operators.rules import rule_fields

    texts = ["Invoice\n5\u00a0100.00", "Total: $１２.３４", "Total: $٤٥.٠٠ and 5 300.00"]
    df = spark.createDataFrame([(i, t, "pdf") for i, t in enumerate(texts)], "doc_id long, text string, kind string")
    got = {r.doc_id: r for r in rule_fields(df).collect()}
    assert got[0].currency == "USD"
    assert str(got[1].total) == "12.34" and str(got[2].total) == "45.00"


def test_currency_patterns_equal_the_plain_ones(spark):
    """The patterns that read a line once find what the plain ones find, over lines and odd white space."""
    import random

    from pyspark.sql import functions as F

    from tallyscan import fixed_values as fv

    rng = random.Random(2)
    bits = ["5", "5 ", "1.00", "12,3.45", "total", "due", "amount", "price", "fee", "x", " ", "\n", "\n\n", "\t", "S1.00", "invoice", "5 2.50", "51.00"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text_lower string").withColumn("text", F.col("text_lower"))
    near = r"(total|amount|price|cost|due|fee).*?" + fv.MISREAD_FIVE_AMOUNT + "|" + fv.MISREAD_FIVE_AMOUNT + r".*?(total|amount|due)"
    letter = "|".join(fv.DOLLAR_INDICATORS)
    known = "|".join(fv.INVOICE_KEYWORDS)

    def plain(text):
        if re.search(near, text):
            return "USD"
        some = re.search(r"[\d,]\.\d{2}", text) and ("$" in text or re.search(letter, text))
        return "USD" if some and (re.search(known, text) or re.search(r"(price|cost|fee).*?[\d,]\.\d{2}", text)) else None

    found = {r.doc_id: r.c for r in df.select("doc_id", rules.currency_inferred().alias("c")).collect()}
    assert found == {i: plain(t) for i, t in enumerate(texts)} and len(set(found.values())) == 2


def test_long_lines_take_time_in_proportion(spark):
    import time

    for piece in ("5 1.00 ", "price ", "fee 5 ", "5\n"):
        took = []
        for n in (8_000, 64_000):
            df = spark.createDataFrame([(piece * n,)], "text string").selectExpr("text", "text as text_lower")
            df.select(rules.currency_inferred()).collect()
            start = time.time()
            df.select(rules.currency_inferred()).collect()
            took.append(time.time() - start)
        assert took[1] < 3
