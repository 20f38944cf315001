"""Lifecycle, ingest and streams."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tallyscan import sources
from tallyscan.operators import lifecycle, serving
from tallyscan.streaming import stream

NOW = datetime(2024, 5, 1, 12)


def attachments(spark, rows):
    data = [(m, "s", "t", f, c, bytearray(b), NOW + timedelta(seconds=i)) for i, (m, f, c, b) in enumerate(rows)]
    return spark.createDataFrame(
        data, "email_message_id string, sender string, subject string, filename string, content_type string, content binary, received_at timestamp"
    )


def arrive(spark, rows):
    return sources.initial_state(sources.assign_storage_key(sources.dedupe_ingest(sources.content_digest(attachments(spark, rows)))), NOW)


def test_ingest_keys_and_kinds(spark):
    new = attachments(spark, [
        ("m1", "a.b.PDF", None, b"%PDF1"), ("m1", "later.pdf", None, b"%PDF1"), ("m2", "noext", "image/png; q=1", b"x"),
        ("m3", ".png", None, b"%PDF1"), ("m4", "z.txt", "text/plain", b"hello"),
    ])
    digested = sources.content_digest(new)
    unique = sources.dedupe_ingest(digested)
    assert unique.count() == 4 and sources.dedupe_ingest(digested, unique).count() == 0
    keyed = sources.assign_storage_key(unique).withColumn("path", F.col("storage_path"))
    got = {r.email_message_id: (r.filename, r.path[44:], r.kind) for r in sources.classify_files(keyed).collect()}
    assert got == {"m1": ("a.b.PDF", ".pdf", "pdf"), "m2": ("noext", "", "image"), "m3": (".png", ".png", "image"), "m4": ("z.txt", ".txt", None)}
    bare = sources.classify_files(spark.createDataFrame([(".png", None, bytearray(b"%PDF"))], "path string, content_type string, content binary"))
    assert bare.first().kind == "pdf"


def test_retries_until_final(spark):
    table = arrive(spark, [("m1", "a.pdf", None, b"1")])
    failure = table.select("id", F.lit("boom").alias("error"))
    waits = []
    for _ in range(5):
        table = lifecycle.apply_failures(table, failure, NOW)
        row = table.first()
        waits.append((row.status, (row.next_attempt_at - NOW).seconds // 60))
    assert waits == [("FAILED_RETRYABLE", 1), ("FAILED_RETRYABLE", 2), ("FAILED_RETRYABLE", 4), ("FAILED_RETRYABLE", 8), ("FAILED_FINAL", 0)]
    late = spark.range(1, 12).select(lifecycle.backoff_minutes(F.col("id")).alias("m")).collect()
    assert [r.m for r in late] == [1, 2, 4, 8, 16, 32, 60, 60, 60, 60, 60]


def test_claimed_rows_are_not_due_and_results_apply(spark):
    table = arrive(spark, [("m1", "a.pdf", None, b"1"), ("m2", "b.pdf", None, b"2"), ("m3", "c.pdf", None, b"3")])
    ids = {r.email_message_id: r.id for r in table.collect()}
    texts = spark.createDataFrame([(ids["m1"], True, True, "hello"), (ids["m2"], True, False, None)],
                                  "id string, file_found boolean, supported boolean, text string")
    done = lifecycle.apply_text(table, texts, NOW)
    got = {r.email_message_id: (r.status, r.ocr_text, r.last_error) for r in done.collect()}
    assert got["m1"] == ("OCR_DONE", "hello", "") and got["m3"] == ("OCR_PENDING", None, "")
    assert got["m2"][2] == "Unsupported file type: application/octet-stream. Supported: PDF, PNG, JPEG, TIFF"
    assert lifecycle.due_for_text(done, NOW).count() == 0
    assert [r.id for r in lifecycle.due_for_extraction(done, 5).collect()] == [ids["m1"]]
    results = spark.createDataFrame([(ids["m1"], '{"total": 1}', "VERIFIED", None), (ids["m3"], None, None, "bad")],
                                    "id string, fields string, confidence_status string, error string")
    final = {r.email_message_id: r for r in serving.client_result(lifecycle.apply_extraction(done, results, NOW)).join(table.select("id", "email_message_id"), "id").collect()}
    assert (final["m1"].result, final["m1"].confidence_status) == ("success", "VERIFIED")
    assert (final["m3"].result, final["m3"].error) == ("extraction_failed", "Extraction failed: bad")


def test_store_and_evolve(spark, tmp_path):
    table = arrive(spark, [("m1", "a.pdf", None, b"1"), ("m2", "b.pdf", None, b"2")])
    sources.write_invoices(table.where("email_message_id = 'm1'").drop("confidence_status"), str(tmp_path / "t"))
    sources.write_invoices(table.where("email_message_id = 'm2'").withColumn("confidence_status", F.lit("REVIEW")), str(tmp_path / "t"))
    got = {r.email_message_id: r.confidence_status for r in sources.read_invoices(spark, str(tmp_path / "t")).collect()}
    assert got == {"m1": "ERROR", "m2": "REVIEW"}
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "x.pdf").write_bytes(b"%PDF-1")
    files = sources.classify_files(sources.scan_files(spark, str(tmp_path / "in")).withColumn("content_type", F.lit(None).cast("string")))
    assert [(r.length, r.kind) for r in files.collect()] == [(6, "pdf")]


def test_stream_equals_batch_over_many_batches(spark, tmp_path):
    rows = [(f"m{i % 7}", f"f{i}.pdf", None, b"%PDF" + bytes([i % 3])) for i in range(40)]
    data = attachments(spark, rows)
    data.repartition(4).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stored = stream.stream_ingest(source, str(tmp_path / "out"), NOW)
    batch = arrive(spark, rows)
    assert sorted(r.id for r in stored.collect()) == sorted(r.id for r in batch.collect())
    again = stream.stream_ingest(source, str(tmp_path / "out"), NOW)
    assert again.count() == batch.count()
    marked = stream.stream_ingest(source, str(tmp_path / "marked"), NOW, watermark="1 hour")
    assert sorted(r.id for r in marked.collect()) == sorted(r.id for r in batch.collect())


def test_late_events_do_not_turn_status_back(spark, tmp_path):
    events = [(1, 3, NOW, "OCR_DONE", None), (1, 1, NOW - timedelta(hours=1), "RECEIVED", None), (1, 3, NOW, "OCR_DONE", None), (2, 2, NOW, "RECEIVED", None)]
    df = spark.createDataFrame(events, "doc_id long, seq long, event_ts timestamp, event string, error string")
    df.repartition(4).write.parquet(str(tmp_path / "e"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    got = stream.stream_latest_status(source, str(tmp_path / "o"))
    want = sorted(map(str, lifecycle.latest_status(df).collect()))
    assert sorted(map(str, got.collect())) == want and len(want) == 2


def test_several_changes_of_one_row(spark):
    from tallyscan.operators import lifecycle

    invoices = spark.createDataFrame([("a", "RECEIVED", ""), ("b", "RECEIVED", "")], "id string, status string, last_error string")
    invoices = invoices.selectExpr("*", "timestamp'1997-01-01' as updated_at")
    updates = spark.createDataFrame([("a", "X", None), ("a", "Y", "why"), ("a", "Y", "no")], "id string, status string, error string")
    whole = lifecycle.set_status(invoices, updates, "1997-06-01 00:00:00")
    changed = lifecycle.set_status(invoices, updates, "1997-06-01 00:00:00", changed_only=True)
    assert [(r.id, r.status, r.last_error) for r in changed.collect()] == [("a", "Y", "why")]
    assert sorted(map(tuple, lifecycle.current_state(invoices, changed).collect())) == sorted(map(tuple, whole.collect()))


def test_scanned_files_fit(spark, tmp_path):
    from tallyscan.sources import check_sizes, classify_files, content_digest, scan_files

    (tmp_path / "a.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "b.PNG").write_bytes(b"xx")
    files = content_digest(classify_files(scan_files(spark, str(tmp_path))))
    assert {r.path.rsplit("/", 1)[1]: (r.kind, r.length) for r in files.collect()} == {"a.pdf": ("pdf", 6), "b.PNG": ("image", 2)}
    manifest = spark.createDataFrame([("1", f"{tmp_path}/a.pdf", 6), ("2", f"{tmp_path}/b.PNG", 3), ("3", f"{tmp_path}/c", 1)], "id string, storage_path string, expected_length long")
    assert sorted((r.id, r.stored_length) for r in check_sizes(manifest, files).collect()) == [("2", 2), ("3", 0)]
