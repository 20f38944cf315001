"""One registered query per operator. Each covers all rows of its tables.

Results are flat: money and dates as text with the places they are stored with,
timestamps as text, counts as BIGINT.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscan.functions import clean_amount, clean_date, currency_code
from tallyscan.operators import layout, lifecycle, merge, reconcile, responses, rules, serving
from tallyscan.operators import text_assembly as ta
from tallyscan.plans.derived import NOW, Tables
from tallyscan.plans.extract import Options, extract_documents, plain_fields
from tallyscan.plans.intake import run_intake
from tallyscan.plans.report import ReportTable
from tallyscan.session import scratch_root
from tallyscan.sources import (
    assign_storage_key, check_sizes, classify_files, content_digest, dedupe_ingest, evolve_schema,
    initial_state, read_invoices, scan_files, write_invoices,
)
from tallyscan.streaming import stream
from tallyscan.streaming.documents import stream_documents
from tallyscan.streaming.state import StateTable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
FULL = Options(use_layout=True, use_model=True)


def query(make: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[make.__name__] = lambda spark, folder: make(Tables(spark, folder))
    return make


def as_text(*columns: str) -> list[Column]:
    return [F.col(c).cast("string").alias(c) for c in columns]


def as_long(*columns: str) -> list[Column]:
    return [F.col(c).cast("bigint").alias(c) for c in columns]


def ts_text(*columns: str) -> list[Column]:
    return [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in columns]


RULE_TEXT = ["invoice_number", "invoice_date", "vendor_name", "subtotal", "discount", "tax_amount", "tax_type"]


def flat_fields(fields: DataFrame, *more: str) -> DataFrame:
    columns = [*RULE_TEXT, "total", "currency"]
    if "vat" in fields.columns:
        columns.append("vat")
    return fields.select(
        "doc_id", *as_text(*columns), "tax_inferred", "reconciliation_status", "reconciliation_error", *more
    )


def flat_wrapped(extracted: DataFrame, *more: str) -> DataFrame:
    """value, confidence and note of every field as columns."""
    columns: list[Column] = []
    for f in merge.WRAPPED_FIELDS:
        w = F.col(f"fields.{f}")
        if f == "tax":
            columns += [w["value"]["amount"].alias("tax"), w["value"]["type"].alias("tax_type")]
            columns.append(w["value"]["inferred"].alias("tax_inferred"))
        else:
            columns.append(w["value"].alias(f))
        if f not in ("reconciliation_status", "reconciliation_error"):
            columns += [w["confidence"].alias(f"{f}_conf"), w["notes"].alias(f"{f}_note")]
    return extracted.select("doc_id", *columns, *more)


# --- A: sources, ingest, sinks ---------------------------------------------------------


@query
def a1_scan_files(t: Tables) -> DataFrame:
    """Files written from the attachments (one per part file), read back as bytes."""
    folder = f"{scratch_root(t.spark)}/scan-{uuid.uuid4().hex}"
    lines = t.attachments.select(F.concat_ws(",", "email_message_id", "filename").alias("value"))
    lines.write.option("maxRecordsPerFile", 1000000).text(folder, compression="none")
    files = scan_files(t.spark, folder, "*.txt")
    return files.select(F.sum("length").alias("bytes"), (F.sum("length") == F.sum(F.octet_length("content"))).alias("whole"))


@query
def a1_scan_each_file(t: Tables) -> DataFrame:
    """One row for each file of lines: its length and digest, as read back in bytes."""
    folder = f"{scratch_root(t.spark)}/each-{uuid.uuid4().hex}"
    ordered = t.file_lines.repartition("month").sortWithinPartitions("month", "no").select("month", F.col("line").alias("value"))
    ordered.write.partitionBy("month").text(folder, compression="none")
    files = scan_files(t.spark, folder, "*.txt")
    return files.select(F.regexp_extract("path", "month=([^/]+)", 1).alias("month"), "length", F.sha2("content", 256).alias("sha256"))


@query
def a2_classify_files(t: Tables) -> DataFrame:
    keyed = assign_storage_key(content_digest(t.attachments)).withColumn("path", F.col("storage_path"))
    return classify_files(keyed).select("email_message_id", "filename", *ts_text("received_at"), "kind", "supported")


@query
def a3_content_digest(t: Tables) -> DataFrame:
    return content_digest(t.attachments).select("email_message_id", *ts_text("received_at"), "sha256", "length")


def _existing(t: Tables) -> DataFrame:
    return content_digest(t.attachments).where("email_message_id like '%7'").select("email_message_id", "sha256")


@query
def a4_dedupe_ingest(t: Tables) -> DataFrame:
    new = dedupe_ingest(content_digest(t.attachments), _existing(t))
    return new.select("email_message_id", "sha256", "filename", *ts_text("received_at"), "sender")


@query
def a5_assign_storage_key(t: Tables) -> DataFrame:
    keyed = assign_storage_key(dedupe_ingest(content_digest(t.attachments)))
    return keyed.select("email_message_id", "filename", "id", "storage_path")


@query
def a6_check_sizes(t: Tables) -> DataFrame:
    return check_sizes(t.manifest, t.stored_files)


def _arrived(t: Tables) -> DataFrame:
    return initial_state(assign_storage_key(dedupe_ingest(content_digest(t.attachments))), NOW)


@query
def a7_initial_state(t: Tables) -> DataFrame:
    return _arrived(t).select(
        "id", "email_message_id", "sender", "subject", "filename", "content_type", "status",
        *as_long("attempt_count"), *ts_text("received_at", "next_attempt_at", "created_at"),
        "last_error", "ocr_text", "extracted_fields", "confidence_status",
    )


@query
def a8_evolve_schema(t: Tables) -> DataFrame:
    """Rows from before and after the status column, as one table."""
    old = evolve_schema(t.invoices.where("created_at < '1996-01-01'").drop("confidence_status"))
    new = evolve_schema(
        t.invoices.where("created_at >= '1996-01-01'").withColumn(
            "confidence_status", F.when(F.col("confidence_status") != "REVIEW", F.col("confidence_status"))
        )
    )
    return old.unionByName(new).select("id", "status", "confidence_status")


@query
def a9_write_invoices(t: Tables) -> DataFrame:
    path = f"{scratch_root(t.spark)}/invoices-{uuid.uuid4().hex}"
    write_invoices(_arrived(t), path, by="month")
    stored = read_invoices(t.spark, path)
    return stored.select("id", "email_message_id", "status", "confidence_status", *ts_text("received_at"))


# --- B: text assembly ------------------------------------------------------------------


@query
def b1_choose_page_text(t: Tables) -> DataFrame:
    return ta.choose_page_text(t.page_text).select("doc_id", *as_long("engine_rank", "page"), "text")


@query
def b2_choose_engine(t: Tables) -> DataFrame:
    chosen = ta.choose_pages(t.page_text)
    return chosen.select("doc_id", *as_long("engine_rank", "page"), "text")


@query
def b3_lines_from_glyphs(t: Tables) -> DataFrame:
    return ta.lines_from_glyphs(t.glyphs).select("doc_id", *as_long("page"), "text")


@query
def b4_table_to_text(t: Tables) -> DataFrame:
    return ta.table_to_text(t.table_rows).select("doc_id", *as_long("page"), "text")


@query
def b5_pages_to_document(t: Tables) -> DataFrame:
    pages = ta.choose_pages(t.page_text)
    return ta.pages_to_document(pages).select("doc_id", "text")


@query
def b6_segments_to_document(t: Tables) -> DataFrame:
    return ta.choose_engine(ta.segments_to_document(t.ocr_segments)).select("doc_id", *as_long("engine_rank"), "text")


@query
def b7_normalise_text(t: Tables) -> DataFrame:
    return ta.normalise_text(t.padded_documents).select("doc_id", "text", "text_lower")


# --- C: normalisers ---------------------------------------------------------------------


@query
def c1_clean_amounts(t: Tables) -> DataFrame:
    return t.amount_texts.select("doc_id", *as_long("line"), clean_amount(F.col("raw")).cast("string").alias("value"))


@query
def c2_clean_dates(t: Tables) -> DataFrame:
    return t.date_texts.select("doc_id", clean_date(F.col("raw")).cast("string").alias("value"))


@query
def c3_clean_currency(t: Tables) -> DataFrame:
    return t.currency_texts.select("doc_id", currency_code(F.col("raw")).alias("value"))


# --- D: rule extraction ------------------------------------------------------------------


def _single(name: str, field: str, table: str = "docs") -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return rules.extract_one(getattr(Tables(spark, folder), table), field).select("doc_id", *as_text("value"))

    QUERIES[name] = run


_single("d1_invoice_number", "invoice_number")
_single("d2_invoice_date", "invoice_date")
_single("d3a_vendor_labelled", "vendor_labelled")
_single("d3b_vendor_fallback", "vendor_fallback")
_single("d4_subtotal", "subtotal")
_single("d5_tax_amount", "tax_amount")
_single("d6_vat_amount", "vat_amount")


@query
def d7_tax_normalised(t: Tables) -> DataFrame:
    return rules.raw_rule_fields(t.docs).select("doc_id", *as_text("tax_amount"), "tax_type")


_single("d8_discount", "discount")
_single("d9_total", "total")
_single("d10a_currency_explicit", "currency_explicit")
_single("d10b_currency_inferred", "currency_inferred", "misread_docs")


@query
def d11_rule_fields(t: Tables) -> DataFrame:
    return flat_fields(rules.rule_fields(t.docs))


@query
def d11_rule_fields_corpus(t: Tables) -> DataFrame:
    """All given texts, none an invoice: every field a rule still finds, and its verdict."""
    checked = reconcile.validate_accounting(rules.rule_fields(t.corpus))
    return flat_fields(checked, "is_valid", "validation_error")


# --- E: reconciliation, validation ----------------------------------------------------------


@query
def e1_reconcile_amounts(t: Tables) -> DataFrame:
    return flat_fields(reconcile.reconcile_amounts(rules.raw_rule_fields(t.docs)))


@query
def e2_field_exclusivity(t: Tables) -> DataFrame:
    done = reconcile.field_exclusivity(t.amount_fields)
    return done.select("doc_id", *as_text("subtotal", "discount", "tax_amount"), "tax_type")


@query
def e3_validate_accounting(t: Tables) -> DataFrame:
    done = reconcile.validate_accounting(rules.rule_fields(t.docs))
    return done.select("doc_id", "is_valid", "validation_error")


# --- F: layout -------------------------------------------------------------------------------


@query
def f1_layout_scope(t: Tables) -> DataFrame:
    scoped = layout.layout_scope(t.table_rows, t.docs)
    return scoped.select("doc_id", *as_long("table_idx", "row_idx"), F.size("cells").cast("bigint").alias("n_cells"))


@query
def f2_fields_from_tables(t: Tables) -> DataFrame:
    found = layout.fields_from_tables(layout.layout_scope(t.table_rows, t.docs))
    return found.select("doc_id", *as_text("invoice_number", "invoice_date", "subtotal", "tax", "vat", "total", "currency"))


@query
def f3_lines_from_words(t: Tables) -> DataFrame:
    return layout.lines_from_words(t.words).select("doc_id", *as_long("page", "y"), "line")


@query
def f4_amounts_from_lines(t: Tables) -> DataFrame:
    lines = layout.lines_from_words(layout.layout_scope(t.words, t.docs))
    return layout.amounts_from_lines(lines).select("doc_id", *as_text("subtotal", "tax", "vat", "total"))


@query
def f5_vendor_from_lines(t: Tables) -> DataFrame:
    lines = layout.lines_from_words(layout.layout_scope(t.words, t.docs))
    return layout.vendor_from_lines(lines).select("doc_id", "vendor_name")


@query
def f6_merge_layout(t: Tables) -> DataFrame:
    return layout.layout_fields(t.docs, t.words, t.table_rows).select("doc_id", *as_text(*layout.LAYOUT_FIELDS))


# --- G: model answers ---------------------------------------------------------------------------


def _queue(t: Tables) -> DataFrame:
    return responses.escalation_queue(plain_fields(t.docs, t.words, t.table_rows))


@query
def g1_escalation_queue(t: Tables) -> DataFrame:
    return _queue(t).select("doc_id", "is_valid", "escalation_reason")


@query
def g2_build_requests(t: Tables) -> DataFrame:
    asked = responses.build_requests(_queue(t), t.docs)
    total = F.get_json_object("prior_fields", "$.total").alias("prior_total")
    return asked.select("doc_id", "text", "validation_error", "misread_hint", total)


@query
def g3_repair_responses(t: Tables) -> DataFrame:
    return responses.repair_responses(t.model_responses).select("doc_id", *as_long("provider_rank"), "repaired")


def _parsed(t: Tables, unusable: bool = False) -> DataFrame:
    return responses.parse_responses(responses.repair_responses(t.model_responses), unusable)


@query
def g4_parse_responses(t: Tables) -> DataFrame:
    return _parsed(t).select("doc_id", *as_long("provider_rank"), *responses.ANSWER_COLUMNS)


@query
def g5_entities_to_fields(t: Tables) -> DataFrame:
    return responses.entities_to_fields(t.entities).select("doc_id", *responses.ANSWER_COLUMNS)


@query
def g6_choose_provider(t: Tables) -> DataFrame:
    chosen = responses.choose_provider(_parsed(t, unusable=True), t.entities)
    return chosen.select("doc_id", *as_long("provider_rank"), *responses.ANSWER_COLUMNS)


@query
def g7_overlay_semantic(t: Tables) -> DataFrame:
    queue = responses.escalation_queue(plain_fields(t.docs))
    chosen = responses.choose_provider(_parsed(t, unusable=True), t.entities)
    return flat_wrapped(responses.overlay_semantic(queue, chosen), "corrected")


# --- H: merge, confidence, status -------------------------------------------------------------------


@query
def h1_merge_levels(t: Tables) -> DataFrame:
    found = layout.layout_fields(t.docs, t.words, t.table_rows)
    return flat_fields(merge.merge_levels(rules.rule_fields(t.docs), found))


@query
def h2_with_confidence(t: Tables) -> DataFrame:
    return flat_wrapped(merge.with_confidence(plain_fields(t.docs, t.words, t.table_rows)))


@query
def h3_unwrap(t: Tables) -> DataFrame:
    return flat_fields(merge.unwrap(merge.with_confidence(plain_fields(t.docs, t.words, t.table_rows))))


@query
def h4_confidence_status(t: Tables) -> DataFrame:
    """Status of every document with model answers off and on."""
    done = extract_documents(t.docs, t.words, t.table_rows, t.model_responses, t.entities, FULL)
    alone = merge.confidence_status(False, F.lit(False), F.lit(False))
    return done.select("doc_id", alone.alias("without_model"), F.col("confidence_status").alias("with_model"))


@query
def h5_extract_documents(t: Tables) -> DataFrame:
    done = extract_documents(t.docs, t.words, t.table_rows, t.model_responses, t.entities, FULL)
    return flat_wrapped(done, "is_valid", "validation_error", "confidence_status")


# --- I: lifecycle -------------------------------------------------------------------------------------


def flat_state(invoices: DataFrame) -> DataFrame:
    return invoices.select(
        "id", "status", *as_long("attempt_count"), *ts_text("next_attempt_at", "updated_at"),
        "last_error", "ocr_text", "extracted_fields", "confidence_status",
    )


@query
def i1_due_for_text(t: Tables) -> DataFrame:
    return lifecycle.due_for_text(t.invoices, NOW).select("id", "status", *ts_text("created_at", "next_attempt_at"))


@query
def i1_next_for_text(t: Tables) -> DataFrame:
    """The oldest 25 due rows, as a poller with 25 hands would take them."""
    return lifecycle.due_for_text(t.invoices, NOW, 25).select("id", "status", *ts_text("created_at"))


@query
def i2_due_for_extraction(t: Tables) -> DataFrame:
    return lifecycle.due_for_extraction(t.invoices).select("id", "status", *ts_text("created_at"))


@query
def i3_apply_failures(t: Tables) -> DataFrame:
    return flat_state(lifecycle.apply_failures(t.invoices, t.failures, NOW))


@query
def i4_apply_text(t: Tables) -> DataFrame:
    return flat_state(lifecycle.apply_text(t.invoices, t.text_results, NOW))


@query
def i5_apply_extraction(t: Tables) -> DataFrame:
    return flat_state(lifecycle.apply_extraction(t.invoices, t.extraction_results, NOW))


@query
def i6_set_status(t: Tables) -> DataFrame:
    return flat_state(lifecycle.set_status(t.invoices, t.status_updates, NOW))


def _state_after(t: Tables, change: Callable[[DataFrame], DataFrame], compact: bool = False) -> DataFrame:
    """The invoices as a bucketed state table, changed by a batch that meets their buckets alone."""
    table = StateTable(t.spark, f"{scratch_root(t.spark)}/state-{uuid.uuid4().hex}", t.invoices.schema)
    table.write(t.invoices, 0)
    table.write(change(table.current()), 1, aligned=True)
    if compact:
        table.compact(2)
    return flat_state(table.current())


@query
def i3_state_failures(t: Tables) -> DataFrame:
    return _state_after(t, lambda rows: lifecycle.apply_failures(rows, t.failures, NOW, changed_only=True))


@query
def i4_state_text(t: Tables) -> DataFrame:
    return _state_after(t, lambda rows: lifecycle.apply_text(rows, t.text_results, NOW, changed_only=True), compact=True)


@query
def i5_state_extraction(t: Tables) -> DataFrame:
    return _state_after(t, lambda rows: lifecycle.apply_extraction(rows, t.extraction_results, NOW, changed_only=True))


@query
def i6_state_status(t: Tables) -> DataFrame:
    return _state_after(t, lambda rows: lifecycle.set_status(rows, t.status_updates, NOW, changed_only=True), compact=True)


# --- J: serving ------------------------------------------------------------------------------------------


@query
def j1_invoice_lookup(t: Tables) -> DataFrame:
    return serving.invoice_lookup(t.invoices, t.lookup_ids).select("asked_id", "lookup", "email_message_id", "status")


@query
def j1_state_lookup(t: Tables) -> DataFrame:
    """The lookup on the state table: few ids read their row groups alone, many meet their buckets."""
    table = StateTable(t.spark, f"{scratch_root(t.spark)}/lookup-{uuid.uuid4().hex}", t.invoices.schema)
    table.write(t.invoices, 0)
    found = serving.state_lookup(table, t.lookup_ids)
    return found.select("asked_id", "lookup", "email_message_id", "status")


@query
def j2_invoice_out(t: Tables) -> DataFrame:
    out = serving.invoice_out(t.invoices)
    stamps = ("next_attempt_at", "created_at", "updated_at")
    plain = [c for c in serving.OUT_COLUMNS if c not in (*stamps, "attempt_count")]
    return out.select(*plain, *as_long("attempt_count"), *ts_text(*stamps))


@query
def j3_client_result(t: Tables) -> DataFrame:
    return serving.client_result(t.invoices)


def _extracted(t: Tables) -> DataFrame:
    return extract_documents(t.docs, t.words, t.table_rows)


@query
def j4_display_fields(t: Tables) -> DataFrame:
    done = extract_documents(t.docs, t.words, t.table_rows, t.model_responses, t.entities, FULL)
    return serving.display_fields(done)


@query
def j5_scorecard(t: Tables) -> DataFrame:
    return serving.scorecard(_extracted(t))


@query
def j6_corpus_report(t: Tables) -> DataFrame:
    """All levels, model answers included, rolled up by section."""
    done = extract_documents(t.docs, t.words, t.table_rows, t.model_responses, t.entities, FULL)
    return serving.corpus_report(done).withColumn("total_amount", F.col("total_amount").cast("string"))


@query
def j6_incremental_report(t: Tables) -> DataFrame:
    """Four batches of changes: all documents by rules and layout, then in three parts with model answers. Equals the report on all of it."""
    root = f"{scratch_root(t.spark)}/report-{uuid.uuid4().hex}"
    # rules and layout are the same for both jobs and run once
    plain_fields(t.docs, t.words, t.table_rows).write.parquet(f"{root}/validated")
    validated = t.spark.read.parquet(f"{root}/validated")
    plain = extract_documents(t.docs, t.words, t.table_rows, validated=validated)
    full = extract_documents(t.docs, t.words, t.table_rows, t.model_responses, t.entities, FULL, validated)
    # stored by part, so that a batch reads its own
    full.withColumn("part", F.col("doc_id") % 3).write.partitionBy("part").parquet(f"{root}/full")
    stored = t.spark.read.parquet(f"{root}/full")
    table = ReportTable(t.spark, f"{root}/report", plain)
    table.update(plain, 0)
    for part in range(3):
        table.update(stored.where(F.col("part") == part).select(*full.columns), part + 1)
    return table.report().withColumn("total_amount", F.col("total_amount").cast("string"))


# --- K: streams ----------------------------------------------------------------------------------------------


@query
def k1_stream_ingest(t: Tables) -> DataFrame:
    """Orders arrive as a file stream; the stored table must equal batch ingest."""
    source = stream.table_stream(t.spark, t.folder, "orders")
    stored = stream.stream_ingest(stream.attachments_from_orders(source), f"{scratch_root(t.spark)}/k1-{uuid.uuid4().hex}", NOW)
    return stored.select("id", "email_message_id", "sha256", "filename", "status", *ts_text("received_at"))


@query
def k1_stream_files(t: Tables) -> DataFrame:
    """Files of lines (a month each, some twice) arrive in several batches as bytes; each is classified, digested and stored once."""
    folder, root = (f"{scratch_root(t.spark)}/{name}-{uuid.uuid4().hex}" for name in ("files", "k1-files"))
    copies = t.file_lines.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    ordered = copies.repartition("month", "copy").sortWithinPartitions("month", "copy", "no")
    ordered.select("month", "copy", F.col("line").alias("value")).write.partitionBy("month", "copy").text(folder, compression="none")
    month = F.regexp_extract("path", "month=([^/]+)", 1)
    stored = stream.stream_files(t.spark, folder, root, NOW, month, "*.txt", files_per_batch=24, compact_every=2)
    return stored.select("id", "email_message_id", "sha256", "content_type", "status", *as_long("attempt_count"))


def _as_stream(t: Tables, rows: DataFrame, by: list[str], batches: int = 5, files: int = 8) -> DataFrame:
    """Rows stored in files, dealt by ``by``, of which each micro-batch reads a few: one alone is written and read by a task or two."""
    folder = f"{scratch_root(t.spark)}/arrive-{uuid.uuid4().hex}"
    rows = rows.withColumn("event_time", F.lit(NOW).cast("timestamp"))
    rows.repartition(batches * files, *by).write.parquet(folder)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


@query
def k2_stream_documents(t: Tables) -> DataFrame:
    """Texts, words, cells, answers and entities arrive in different batches; equals the batch job on every level."""
    keys = {
        "words": ["page", "word_idx", "text", "top"], "table_rows": ["page", "table_idx", "row_idx", "cells"],
        "model_responses": ["provider_rank", "raw_response"], "entities": ["entity_idx", "type", "content"],
    }
    given = {name: getattr(t, name).select("doc_id", *columns) for name, columns in keys.items()}
    counts = None
    for name in keys:
        one = given[name].distinct().select("doc_id")
        counts = one if counts is None else counts.union(one)
    parts = counts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"))
    docs = t.docs.join(parts, "doc_id", "left").withColumn("parts", F.coalesce("parts", F.lit(0)))
    root = f"{scratch_root(t.spark)}/k2-documents-{uuid.uuid4().hex}"
    done = stream_documents(
        _as_stream(t, docs, ["doc_id"]), root,
        *[_as_stream(t, given[name], ["doc_id", keys[name][0], keys[name][1]]) for name in ("words", "table_rows", "model_responses", "entities")],
        options=FULL,
    )
    return flat_wrapped(done, "is_valid", "validation_error", "confidence_status")


@query
def k2_stream_extract(t: Tables) -> DataFrame:
    """Rules over the stream of given documents; equals the batch job."""
    source = stream.table_stream(t.spark, t.folder, "documents")
    docs = source.select("doc_id", F.lit("pdf").alias("kind"), "text")
    root = f"{scratch_root(t.spark)}/k2-{uuid.uuid4().hex}"
    done = stream.stream_extract(docs, root)
    return flat_fields(done, "is_valid", "validation_error")


@query
def k3_latest_status(t: Tables) -> DataFrame:
    return lifecycle.latest_status(t.status_events).select("doc_id", "seq", *ts_text("event_ts"), "event", "error")


@query
def k3_stream_latest_status(t: Tables) -> DataFrame:
    source = stream.table_stream(t.spark, t.folder, "events")
    root = f"{scratch_root(t.spark)}/k3-{uuid.uuid4().hex}"
    latest = stream.stream_latest_status(stream.status_from_events(source), root)
    return latest.select("doc_id", "seq", *ts_text("event_ts"), "event", "error")


@query
def k4_stream_retry(t: Tables) -> DataFrame:
    """Text results arrive as a stream; only due rows change state."""
    source = stream.table_stream(t.spark, t.folder, "orders")
    results = stream.text_results_from_orders(source)
    root = f"{scratch_root(t.spark)}/k4-{uuid.uuid4().hex}"
    return flat_state(stream.stream_retry(t.invoices.drop("o_orderkey"), results, root, NOW))


# --- L: whole jobs -------------------------------------------------------------------------------------------


@query
def l1_text_stage(t: Tables) -> DataFrame:
    """Pages, table rows, characters and detections to one text per file."""
    given = t.page_text.where("engine_rank = 2 or method_rank < 4")
    tries = ta.page_tries(given, t.table_rows, t.glyphs)
    return ta.documents_from_parts(t.part_files, tries, t.ocr_segments).select("doc_id", "kind", "text")


@query
def l2_stored_fields(t: Tables) -> DataFrame:
    """Extraction of every level for the rows that wait for it, stored as JSON, as a client reads it."""
    waiting = lifecycle.due_for_extraction(t.invoices)
    done = extract_documents(t.docs, t.words, t.table_rows, t.model_responses, t.entities, FULL)
    named = done.join(waiting.select("id", F.col("o_orderkey").alias("doc_id")), "doc_id")
    stored = lifecycle.apply_extraction(waiting, merge.fields_to_json(named, "id"), NOW, changed_only=True)
    read = serving.client_result(stored)
    value = lambda path: F.get_json_object("extracted_fields", f"$.{path}")
    return read.select(
        "id", "result", "confidence_status", value("total.value").alias("total"), value("currency.value").alias("currency"),
        value("vendor_name.notes").alias("vendor_note"), value("tax.value.type").alias("tax_type"),
    )


@query
def l3_end_to_end(t: Tables) -> DataFrame:
    """Bytes of files to client answers: ingest, kinds, texts of pages and images, every level, stored state."""
    done = run_intake(
        t.attachments, t.arrived_pages, f"{scratch_root(t.spark)}/l3-{uuid.uuid4().hex}", NOW, t.arrived_segments,
        t.words, t.table_rows, t.model_responses, t.entities, FULL, F.substring("email_message_id", 5, 20).cast("bigint"),
    )
    value = lambda path: F.get_json_object("extracted_fields", f"$.{path}")
    return done.select(
        "id", "result", "error", "confidence_status", value("invoice_number.value").alias("invoice_number"), value("total.value").alias("total"),
        value("currency.value").alias("currency"), value("vendor_name.notes").alias("vendor_note"), value("tax.value.type").alias("tax_type"),
    )
