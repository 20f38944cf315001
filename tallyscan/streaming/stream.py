"""Streams to tables.

Tables that change are kept by ``state.StateTable``: a micro-batch looks up the rows its keys name and adds
the rows it changes, under its number, so a batch that runs again after a failure changes nothing. No
aggregate state is held by the streaming queries, so they can run for ever. Runs use ``availableNow``;
the same code with another trigger keeps running.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscan.operators import lifecycle
from tallyscan.operators.lifecycle import Moment
from tallyscan.operators.reconcile import validate_accounting
from tallyscan.operators.rules import rule_fields
from tallyscan.sources import assign_storage_key, content_digest, dedupe_ingest, initial_state
from tallyscan.sources.files import classify_files, file_stream, mime_type
from tallyscan.sources.invoices import KEY, uuid_text
from tallyscan.streaming.state import BUCKETS, StateTable

COMPACT_EVERY = 10


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table as a file stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_batches(source: DataFrame, root: str, each_batch: Callable[[DataFrame, int], None]) -> None:
    writer = source.writeStream.foreachBatch(each_batch).option("checkpointLocation", f"{root}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()


def _upkeep(table: StateTable, batch_id: int, every: int) -> None:
    if every and batch_id and batch_id % every == 0:
        table.compact(batch_id)


def stream_ingest(
    attachments: DataFrame, root: str, now: Moment, watermark: str | None = None,
    buckets: int = BUCKETS, compact_every: int = COMPACT_EVERY,
) -> DataFrame:
    """Stores each (message, digest) once, whatever the number of batches it comes in.

    The id of a row is a digest of that key, so a batch looks its ids up in the buckets they lie in: what is read follows
    the batch, not all that has ever come. With a ``watermark`` near copies are dropped by streaming state before
    they reach a batch.
    """
    spark = attachments.sparkSession
    digested = content_digest(attachments).drop("content")
    if watermark:
        digested = digested.withWatermark("received_at", watermark).dropDuplicatesWithinWatermark(KEY)
    schema = initial_state(assign_storage_key(spark.createDataFrame([], digested.schema)), now).schema
    table = StateTable(spark, f"{root}/table", schema, "id", buckets)

    def store(batch: DataFrame, batch_id: int) -> None:
        _upkeep(table, batch_id, compact_every)
        keyed = assign_storage_key(dedupe_ingest(batch))
        fresh = keyed.join(table.of(keyed, batch_id).select("id"), "id", "left_anti")
        table.write(initial_state(fresh, now), batch_id)

    run_batches(digested, root, store)
    return table.current()


def stream_files(
    spark: SparkSession, folder: str, root: str, now: Moment, message: Column, pattern: str = "*",
    files_per_batch: int = 1000, archive: str | None = None, buckets: int = BUCKETS, compact_every: int = COMPACT_EVERY,
) -> DataFrame:
    """Files that arrive below ``folder``, as stored invoice rows.

    ``message`` names the message a file came with, out of ``path``. A file whose message and bytes are known is not
    stored again, in whatever batch it comes. With ``archive`` files that are done move there.
    """
    files = mime_type(classify_files(file_stream(spark, folder, pattern, files_per_batch, archive)))
    none = F.lit(None).cast("string")
    attachments = files.select(
        message.alias("email_message_id"), none.alias("sender"), none.alias("subject"),
        F.element_at(F.split("path", "/"), -1).alias("filename"), "content_type", "content",
        F.col("modificationTime").alias("received_at"),
    )
    return stream_ingest(attachments, root, now, buckets=buckets, compact_every=compact_every)


def stream_extract(docs: DataFrame, root: str) -> DataFrame:
    """Rules and validation are narrow, so a stream of texts needs no state at all."""
    spark = docs.sparkSession
    fields = validate_accounting(rule_fields(docs))
    out = fields.writeStream.format("parquet").option("path", f"{root}/table")
    out.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(fields.schema).parquet(f"{root}/table")


def stream_latest_status(
    status_events: DataFrame, root: str, buckets: int = BUCKETS, compact_every: int = COMPACT_EVERY
) -> DataFrame:
    """Latest state per document.

    A batch is brought down to one event a document and put beside the stored state of these documents;
    only newer ones are written, so events that are late or repeated change nothing. The query itself
    holds no state.
    """
    schema = lifecycle.latest_status(status_events).schema
    table = StateTable(status_events.sparkSession, f"{root}/table", schema, "doc_id", buckets)

    def store(batch: DataFrame, batch_id: int) -> None:
        _upkeep(table, batch_id, compact_every)
        newest = lifecycle.latest_status(batch)
        known = table.of(newest, batch_id).select("doc_id", F.struct("event_ts", "seq").alias("_known"))
        newer = newest.join(known, "doc_id", "left").where(F.col("_known").isNull() | (F.struct("event_ts", "seq") > F.col("_known")))
        table.write(newer.drop("_known"), batch_id)

    run_batches(status_events, root, store)
    return table.current()


def stream_retry(
    invoices: DataFrame, text_results: DataFrame, root: str, now: Moment, buckets: int = BUCKETS, compact_every: int = COMPACT_EVERY
) -> DataFrame:
    """Applies text results as they arrive to the rows that are due.

    No timer is held: ``next_attempt_at`` is data. ``invoices`` are stored once; a batch reads the current state of
    the ids it names and writes only those that are due; a row that stays as it is gets no new version.
    """
    table = StateTable(invoices.sparkSession, f"{root}/table", invoices.schema, "id", buckets)
    if table.versions().isEmpty():
        table.write(invoices, -1)

    def store(batch: DataFrame, batch_id: int) -> None:
        _upkeep(table, batch_id, compact_every)
        # one result per id: copies of a result are one attempt
        results = batch.groupBy("id").agg(F.max(F.struct("file_found", "supported", "text")).alias("r")).select("id", "r.*")
        table.write(lifecycle.apply_text(table.of(results, batch_id), results, now, changed_only=True), batch_id)

    run_batches(text_results, root, store)
    return table.current()


# --- streams of the operators' inputs, made from the given tables ---------------------------


def attachments_from_orders(orders: DataFrame) -> DataFrame:
    """Attachments as in the batch table: some orders arrive two or three times."""
    key = F.col("o_orderkey")
    copies = F.array(F.lit(2), F.when(key % 5 == 0, 0), F.when(key % 10 == 0, 3))
    rows = orders.withColumn("copy", F.explode(F.filter(copies, lambda c: c.isNotNull())))
    name = F.element_at(F.array(*[F.lit(n) for n in ("a.b.PDF", "noext", ".png", "scan.JPEG")]), (key % 4 + 1).cast("int"))
    head = F.when(key % 2 == 0, "%PDF-").otherwise("raw-")
    return rows.select(
        F.concat(F.lit("msg-"), key.cast("string")).alias("email_message_id"),
        F.when(key % 3 != 0, F.concat(F.lit("user"), F.col("o_custkey").cast("string"), F.lit("@example.org"))).alias("sender"),
        F.lit("Invoice").alias("subject"),
        name.alias("filename"),
        F.when(key % 8 == 1, "image/png; q=1").when(key % 8 == 2, "application/pdf").alias("content_type"),
        F.concat(head, (F.col("o_custkey") % 50).cast("string")).cast("binary").alias("content"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=F.col("copy"))).alias("received_at"),
    )


def status_from_events(events: DataFrame) -> DataFrame:
    """Status changes as in the batch table, every fourth one twice."""
    names = {"view": "RECEIVED", "signup": "OCR_PENDING", "click": "OCR_DONE", "purchase": "EXTRACTED"}
    event = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in names.items()], F.lit("FAILED_RETRYABLE"))
    times = F.when(F.col("event_id") % 4 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return events.withColumn("_copy", F.explode(times)).select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("event_ts"), event.alias("event"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
    )


def text_results_from_orders(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    rows = orders.where(key % 11 != 10).withColumn("_seed", F.concat(F.lit("inv-"), key.cast("string")))
    text = F.concat(F.lit("text f"), key.cast("string"), F.lit(".pdf"))
    return rows.select(
        uuid_text("_seed").alias("id"),
        (key % 13 != 0).alias("file_found"), (key % 17 != 0).alias("supported"),
        F.when(key % 19 == 0, "").when(key % 19 != 1, text).alias("text"),
    )
