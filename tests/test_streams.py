"""Streams over several micro-batches, and started again, against the batch jobs."""

from pyspark.sql import functions as F

from tallyscan.operators import lifecycle
from tallyscan.sources import assign_storage_key, content_digest, dedupe_ingest
from tallyscan.streaming import stream

NOW = "1997-06-01 00:00:00"


def source(spark, rows, folder, files):
    rows.repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def attachments(spark):
    rows = [(f"m{i % 30}", None, "s", f"f{i % 4}.pdf", "application/pdf", bytearray(b"%PDF" + bytes([i % 5]))) for i in range(120)]
    df = spark.createDataFrame(rows, "email_message_id string, sender string, subject string, filename string, content_type string, content binary")
    return df.withColumn("received_at", F.timestamp_seconds(F.lit(100)))


def test_ingest_stores_each_key_once(spark, tmp_path):
    rows = attachments(spark)
    for _ in range(2):  # the second start brings the same files again as new ones
        given = source(spark, rows, str(tmp_path / "in"), 5)
        stored = stream.stream_ingest(given, str(tmp_path / "out"), NOW)
        batch = assign_storage_key(dedupe_ingest(content_digest(rows)))
        assert sorted(r.id for r in stored.collect()) == sorted(r.id for r in batch.collect())


def test_retry_counts_each_result_once(spark, tmp_path):
    columns = ("id string, status string, attempt_count int, next_attempt_at timestamp, storage_path string, content_type string, "
               "ocr_text string, last_error string, updated_at timestamp")
    invoices = spark.createDataFrame([(str(i), "RECEIVED" if i % 3 else "OCR_DONE", 0, None, "p", "application/pdf", None, "", None) for i in range(60)], columns)
    invoices = invoices.withColumn("next_attempt_at", F.lit("1997-01-01").cast("timestamp"))
    results = spark.createDataFrame([(str(i), True, i % 4 != 0, f"text {i}") for i in range(0, 60, 2)], "id string, file_found boolean, supported boolean, text string")
    done = stream.stream_retry(invoices, source(spark, results, str(tmp_path / "in"), 6), str(tmp_path / "out"), NOW)
    changed = lifecycle.apply_text(invoices.join(results.select("id"), "id", "left_semi"), results, NOW)
    wanted = lifecycle.current_state(invoices, changed)
    assert sorted(map(tuple, done.select(sorted(done.columns)).collect()), key=str) == sorted(map(tuple, wanted.select(sorted(done.columns)).collect()), key=str)


def test_latest_status_over_late_batches(spark, tmp_path):
    events = spark.createDataFrame([(i % 7, i, f"e{i % 3}", None) for i in range(200)], "doc_id long, seq long, event string, error string")
    events = events.withColumn("event_ts", F.timestamp_seconds((F.col("seq") * 37) % 101))
    done = stream.stream_latest_status(source(spark, events, str(tmp_path / "in"), 5), str(tmp_path / "out"))
    assert sorted(map(tuple, done.collect())) == sorted(map(tuple, lifecycle.latest_status(events).select(*done.columns).collect()))
