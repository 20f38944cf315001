"""Model answers, overlay, confidence, display."""

from pyspark.sql import functions as F

from tallyscan.operators import merge, responses, serving
from tallyscan.plans.extract import Options, extract_documents, plain_fields

BAD = "Invoice No: INV-1\nInvoice Date: 2025-12-30\nSubtotal: $100.00\nTax: $10.00\nTotal: $520.00"
GOOD = "Invoice No: INV-1\nInvoice Date: 2025-12-30\nSubtotal: 100.00\nTax: 10.00\nTotal: 110.00"
RAW = "doc_id long, provider_rank int, raw_response string"
LLM = Options(use_layout=False, use_model=True)


def parse(spark, *rows):
    done = responses.parse_responses(responses.repair_responses(spark.createDataFrame(rows, RAW)))
    return {(r.doc_id, r.provider_rank): r for r in done.collect()}


def test_repair_and_parse(spark):
    got = parse(
        spark,
        (1, 1, '```json\n{"total": "7", "tax": 80.93, "discount": 5, }\n```'),
        (2, 1, "not json"),
        (3, 1, '{"vendor_name": \'A "b\', "total": "1"'),
        (4, 1, '{"total": "1",\\n "date": "2025-01-02", "": 5}'),
        (5, 1, '{"total": "1",\n\n "vendor_name": "a"}'),
        (6, 1, '{"a": ""}'),
        (7, 1, '{"total": 1} x {"total": 2}'),
        (8, 1, '{"tax": 0, "discount": "-.50", "total": null}'),
        (9, 1, '{"foo": 1}'),
        (10, 1, '{"tax": {"amount": "3", "type": "vat"}, "vendor_name": "' + 20000 * '\\"' + 'z"}'),
        (11, 2, '```json{"invoice_date": "d", "tax": "3", "date": "x"}```'),
        (12, 2, '{"total": 1,}'),
        (13, 1, '{"total": 12345678.5, "discount": 0}'),
    )
    one = got[1, 1]
    assert (one.total, one.tax_amount, one.tax_type, one.discount) == ("7", "80.93", "sales_tax", "-5")
    assert (2, 1) not in got and (6, 1) not in got and (7, 1) not in got and (12, 2) not in got
    assert got[4, 1].invoice_date == "2025-01-02" and got[5, 1].vendor_name == "a"
    assert (got[8, 1].tax_amount, got[8, 1].tax_type, got[8, 1].discount) == ("0", None, "-0.50")
    assert not got[8, 1].is_empty and got[9, 1].is_empty
    assert got[10, 1].tax_type == "vat" and len(got[10, 1].vendor_name) == 20001
    assert (got[11, 2].invoice_date, got[11, 2].tax_amount, got[11, 2].tax_type) == ("d", "3", None)
    assert float(got[13, 1].total) == 12345678.5


def test_overlay_and_status(spark):
    docs = spark.createDataFrame([(1, BAD, "pdf"), (2, GOOD, "pdf"), (3, BAD, "pdf")], "doc_id long, text string, kind string")
    answers = spark.createDataFrame(
        [(1, 1, '{"total":"7","date":"2025-01-02"}'), (2, 1, '{"currency": "EUR"}'), (3, 1, "not json")], RAW
    )
    rows = {r.doc_id: r for r in extract_documents(docs, model_responses=answers, options=LLM).collect()}
    one = rows[1].fields
    assert (one.total.value, one.total.confidence) == ("7", 0.5) and "OCR error fixed" in one.total.notes
    assert one.invoice_date.value == "2025-01-02" and one.invoice_date.notes.endswith("Difference: 410.00")
    assert rows[1].confidence_status == "REVIEW" and one.subtotal.confidence == 0.9
    two = rows[2].fields.currency
    assert (two.value, two.confidence, two.notes) == ("EUR", 0.7, "Level 3 (Gemini) extraction")
    assert rows[2].confidence_status == "ERROR" and rows[3].confidence_status == "ERROR"
    assert rows[3].fields.total.value == "520.00"
    plain = {r.doc_id: r.confidence_status for r in extract_documents(docs).collect()}
    assert plain == {1: "ERROR", 2: "VERIFIED", 3: "ERROR"}


def test_provider_order(spark):
    raw = spark.createDataFrame(
        [(1, 1, "{}"), (1, 2, ""), (1, 3, '{"total": "3"}'), (2, 1, '{"total": null}'), (2, 2, '{"total": "2"}'),
         (3, 3, '{"total": "3"}'), (4, 1, "bad")], RAW)
    ent = spark.createDataFrame([(4, 0, "total_amount", "8"), (4, 1, "invoice_total", "9"), (4, 2, "other", "1"), (1, 0, "currency", "X")],
                                "doc_id long, entity_idx int, type string, content string")
    parsed = responses.parse_responses(responses.repair_responses(raw), unusable=True)
    got = {r.doc_id: (r.provider_rank, r.total) for r in responses.choose_provider(parsed, ent).collect()}
    assert got == {2: (1, None), 3: (3, "3"), 4: (4, "9")}  # 1: the second provider's empty answer is final


def test_wrap_unwrap_and_requests(spark):
    docs = spark.createDataFrame([(1, BAD, "pdf"), (2, GOOD + " EUR", "pdf")], "doc_id long, text string, kind string")
    plain = plain_fields(docs)
    back = merge.unwrap(merge.with_confidence(plain)).select(*plain.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, plain.collect()))
    asked = responses.build_requests(responses.escalation_queue(plain), docs).collect()
    assert [(r.doc_id, r.misread_hint, r.text) for r in asked] == [(1, True, BAD)]


def test_layout_tax_is_bare_and_shown(spark):
    docs = spark.createDataFrame([(1, GOOD.replace("Tax", "VAT"), "pdf")], "doc_id long, text string, kind string")
    rows = spark.createDataFrame([(1, 0, 0, 0, ["Tax", "12.00"]), (1, 0, 0, 1, ["VAT", "1"])],
                                 "doc_id long, page int, table_idx int, row_idx int, cells array<string>")
    done = extract_documents(docs, table_rows=rows)
    tax = done.first().fields.tax
    assert (tax.value.amount, tax.value.type, tax.confidence) == ("12.00", None, 0.9)
    shown = {r.field: (r.label, r.shown, r.percent, r.band) for r in serving.display_fields(done).collect()}
    assert shown["tax"] == ("Tax/VAT", "12.00", "(90%)", "high") and shown["vat"] == ("vat", "1.00", "(90%)", "high")
    assert shown["discount"] == ("Discount", "Not found", None, None)
    card = serving.scorecard(done).first()
    assert card.n_keys == 9 + 2 * (done.first().fields.reconciliation_status is not None)


def test_nothing_a_model_says_is_lost(spark):
    docs = spark.createDataFrame([(1, BAD, "pdf"), (2, BAD, "pdf"), (3, BAD, "pdf")], "doc_id long, text string, kind string")
    answers = spark.createDataFrame(
        [
            (1, 2, '{"total": "$1,879.32", "invoice_date": "30 of June", "due_date": "2025-07-30", "terms": {"days": 30}}'),
            (2, 2, '{"total": "n/a", "tax": {"type": "vat"}}'),
            (3, 2, '{"total": "8"}'), (3, 2, '{"total": "5"}'), (3, 2, '{"total": "7"}'),
        ], RAW,
    )
    done = extract_documents(docs, model_responses=answers, options=LLM)
    rows = {r.doc_id: r for r in done.collect()}
    extra = rows[1].fields.extra
    assert extra["due_date"].value.toPython() == "2025-07-30" and extra["terms"].value.toPython() == {"days": 30} and extra["terms"].confidence == 0.5
    assert rows[2].fields.tax.value.type == "vat"
    assert rows[3].fields.total.value == "5"  # the least of several answers of one provider
    plain = {r.doc_id: r for r in merge.unwrap(done).collect()}
    assert str(plain[1].total) == "1879.32" and plain[1].as_text == {"invoice_date": "30 of June"}
    assert plain[2].total is None and plain[2].as_text["total"] == "n/a"
    assert plain[1].extra["due_date"].toPython() == "2025-07-30" and plain[1].extra["terms"].toPython() == {"days": 30} and plain[2].extra is None
    again = {r.doc_id: r for r in merge.unwrap(merge.with_confidence(merge.unwrap(done))).collect()}
    assert again[1].extra["terms"].toPython() == {"days": 30} and again[1].total == plain[1].total
    assert dict(extract_documents(docs).dtypes)["fields"] == dict(done.dtypes)["fields"]
    report = {(r.section, r.key): r for r in serving.corpus_report(done).collect()}
    assert str(report["all", "all"].total_amount) == "1884.32" and report["all", "all"].n_unparsed_totals == 1


def test_request_text(spark):
    queue = responses.escalation_queue(plain_fields(spark.createDataFrame([(1, BAD, "pdf")], "doc_id long, text string, kind string")))
    docs = spark.createDataFrame([(1, "x" * 5000)], "doc_id long, text string")
    got = [responses.build_requests(queue, docs, n).first() for n in (4000, None)]
    assert [(len(r.text), r.text_cut) for r in got] == [(4000, True), (5000, False)]


def test_unknown_values_survive_storage_as_they_were_sent(spark):
    """Numbers, lists and nested values: answer -> fields -> JSON -> stored row -> fields -> plain columns."""
    import json

    from tallyscan.operators import lifecycle

    sent = {"n": 30, "x": 2.5, "yes": True, "list": [1, "a", {"b": None}], "deep": {"k": {"z": [1.25]}}, "text": "t", "gone": None}
    docs = spark.createDataFrame([(1, BAD, "pdf")], "doc_id long, text string, kind string")
    answers = spark.createDataFrame([(1, 2, json.dumps({"total": "5", **sent}))], RAW)
    done = extract_documents(docs, model_responses=answers, options=LLM)
    row = spark.createDataFrame([("1",)], "id string").selectExpr(
        "id", "'OCR_DONE' as status", "cast(null as string) as extracted_fields", "'ERROR' as confidence_status", "'' as last_error", "timestamp'1997-01-01' as updated_at")
    stored = lifecycle.apply_extraction(row, merge.fields_to_json(done.withColumn("doc_id", F.col("doc_id").cast("string"))), "1997-06-01")
    back = merge.fields_from_json(stored)
    assert back.select(F.to_json("fields")).first()[0] == done.select(F.to_json("fields")).first()[0]
    extra = merge.unwrap(back).select(F.to_json("extra").alias("e")).first().e
    assert json.loads(extra) == {k: v for k, v in sent.items() if v is not None}
