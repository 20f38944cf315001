"""One run from files to what a client reads: ingest, text, extraction, answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscan.operators import lifecycle
from tallyscan.operators.lifecycle import Moment
from tallyscan.operators.merge import fields_to_json
from tallyscan.operators.serving import client_result
from tallyscan.operators.text_assembly import documents_from_parts
from tallyscan.plans.extract import Options, extract_documents
from tallyscan.sources import assign_storage_key, classify_files, content_digest, dedupe_ingest, initial_state
from tallyscan.streaming.state import BUCKETS, StateTable


def run_intake(
    attachments: DataFrame, tries: DataFrame, root: str, now: Moment,
    ocr_segments: DataFrame | None = None, words: DataFrame | None = None, table_rows: DataFrame | None = None,
    model_responses: DataFrame | None = None, entities: DataFrame | None = None,
    options: Options = Options(), doc_id: Column | None = None, run: int = 0, buckets: int = BUCKETS,
) -> DataFrame:
    """(id, result, error, extracted_fields, confidence_status) of every file that is not stored below ``root`` yet.

    ``attachments`` hold the bytes; the other tables are what readers found in the files, by ``doc_id``, which is an
    expression of invoice columns (the id if not given). Files are digested, stored once for each message and
    content, and classified; texts are put together by kind; rows with a text are extracted and closed. Runs over one
    ``root`` are numbered. Each has three batches of the state table and reads what is older than the batch at hand, so a run
    that fails can be started again under its number.
    """
    first = 3 * run
    spark = attachments.sparkSession
    own = F.col("id") if doc_id is None else doc_id
    digested = content_digest(attachments)
    schema = initial_state(assign_storage_key(digested), now).schema
    table = StateTable(spark, f"{root}/invoices", schema, "id", buckets)

    known = table.current(first).select("id")
    keyed = assign_storage_key(dedupe_ingest(digested)).join(known, "id", "left_anti")
    kinds = classify_files(keyed.withColumn("path", F.col("storage_path"))).select("id", own.alias("doc_id"), "kind", "supported")
    kinds.write.mode("overwrite").parquet(f"{root}/kinds/run={run}")
    table.write(initial_state(keyed, now), first)

    kinds = spark.read.parquet(f"{root}/kinds/run={run}")
    texts = documents_from_parts(kinds, tries, ocr_segments)
    results = kinds.join(texts.select("doc_id", "text"), "doc_id", "left").select("id", F.lit(True).alias("file_found"), "supported", "text")
    mine = lambda before: table.of(kinds, before)
    # changes are dealt to the buckets; stored rows, and what becomes of them, stay where they are
    table.write(lifecycle.apply_text(mine(first + 1), table.dealt(results), now, changed_only=True), first + 1, aligned=True)

    waiting = lifecycle.due_for_extraction(mine(first + 2)).select("id", F.col("ocr_text").alias("text"))
    docs = waiting.join(kinds, "id").select("doc_id", "text", "kind")
    done = extract_documents(docs, words, table_rows, model_responses, entities, options)
    named = done.join(kinds.select("id", "doc_id"), "doc_id")
    stored = table.dealt(fields_to_json(named, "id"))
    table.write(lifecycle.apply_extraction(mine(first + 2), stored, now, changed_only=True), first + 2, aligned=True)
    return client_result(mine(first + 3))
