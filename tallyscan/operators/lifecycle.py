"""Lifecycle of documents in the ``invoices`` table.

Every transition is a table-to-table job: the rows concerned come in as a second
table, and the result is the whole table in its next state, or with ``changed_only``
just the rows that change. On a ``streaming.state.StateTable`` no stored row is shuffled for it. Of several changes of one
id the largest counts, by all its columns in turn.
``now`` is an argument, so a rerun gives the same rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscan import fixed_values as fv

Moment = datetime | str | Column


def at(now: Moment) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


def _set(invoices: DataFrame, hit: Column, **changes: Column | str) -> DataFrame:
    """The columns of ``invoices`` with ``changes`` where ``hit`` holds."""
    hit = F.coalesce(hit, F.lit(False))
    return invoices.withColumns({
        name: F.when(hit, value if isinstance(value, Column) else F.lit(value)).otherwise(F.col(name))
        for name, value in changes.items()
    })


def _joined(invoices: DataFrame, changes: DataFrame, changed_only: bool = False, **columns: str) -> DataFrame:
    """Join on id; each column of ``changes`` arrives under the given new name."""
    one = changes.groupBy("id").agg(F.max(F.struct(*[F.col(c).alias(new) for new, c in columns.items()])).alias("_change"))
    renamed = one.select("id", F.lit(True).alias("_hit"), "_change.*")
    return invoices.join(renamed, "id", "inner" if changed_only else "left")


def current_state(invoices: DataFrame, changed: DataFrame) -> DataFrame:
    """The table with ``changed`` rows in place of those with the same id."""
    return invoices.join(changed.select("id"), "id", "left_anti").unionByName(changed)


def _oldest(rows: DataFrame, limit: int | None) -> DataFrame:
    """All rows, or the ``limit`` oldest (a top-k, no full sort)."""
    return rows if limit is None else rows.orderBy("created_at", "id").limit(limit)


def is_due(now: Moment) -> Column:
    return F.col("status").isin(fv.RECEIVED, fv.FAILED_RETRYABLE) & (F.col("next_attempt_at") <= at(now))


def due_for_text(invoices: DataFrame, now: Moment, limit: int | None = None) -> DataFrame:
    return _oldest(invoices.where(is_due(now)), limit)


def due_for_extraction(invoices: DataFrame, limit: int | None = None) -> DataFrame:
    ready = (F.col("status") == fv.OCR_DONE) & F.col("ocr_text").isNotNull() & F.col("extracted_fields").isNull()
    return _oldest(invoices.where(ready), limit)


def backoff_minutes(attempt: Column) -> Column:
    """1, 2, 4, ... minutes by the attempt just counted, at most 60."""
    doublings = F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(30))
    return F.least(F.pow(F.lit(2.0), doublings), F.lit(float(fv.BACKOFF_CAP_MINUTES))).cast("int")


def _failed(rows: DataFrame, hit: Column, error: Column, now: Moment, max_attempts: int) -> DataFrame:
    attempt = F.col("attempt_count") + 1
    final = attempt >= max_attempts
    wait = F.make_interval(mins=backoff_minutes(attempt))
    return _set(
        rows, hit,
        status=F.when(final, fv.FAILED_FINAL).otherwise(fv.FAILED_RETRYABLE),
        next_attempt_at=F.when(final, at(now)).otherwise(at(now) + wait),
        attempt_count=attempt,
        last_error=error,
        updated_at=at(now),
    )


def apply_failures(
    invoices: DataFrame, failures: DataFrame, now: Moment, max_attempts: int = fv.MAX_ATTEMPTS, changed_only: bool = False
) -> DataFrame:
    """``failures(id, error)``: counts the attempt and sets the next one, or gives up."""
    rows = _joined(invoices, failures, changed_only, _error="error")
    return _failed(rows, F.col("_hit"), F.col("_error"), now, max_attempts).select(*invoices.columns)


def text_error() -> Column:
    """Why a text result cannot be used, null when it can."""
    unsupported = F.concat(
        F.lit("Unsupported file type: "),
        F.when(F.coalesce(F.col("content_type"), F.lit("")) != "", F.col("content_type")).otherwise("unknown"),
        F.lit(". Supported: PDF, PNG, JPEG, TIFF"),
    )
    return (
        F.when(
            F.coalesce(F.col("storage_path"), F.lit("")) == "",
            F.concat(F.lit("File not found: "), F.coalesce(F.col("storage_path"), F.lit("None"))),
        )
        .when(F.col("_found") & ~F.col("_supported"), unsupported)
        .when(~F.col("_found") | (F.coalesce(F.col("_text"), F.lit("")) == ""), fv.ERROR_NO_TEXT)
    )


def apply_text(
    invoices: DataFrame, texts: DataFrame, now: Moment, max_attempts: int = fv.MAX_ATTEMPTS, changed_only: bool = False
) -> DataFrame:
    """``texts(id, file_found, supported, text)`` for due rows.

    A due row is claimed first; with a usable text it is done, with any other
    result it counts as a failed attempt. A claimed row without a result stays
    claimed. Results for rows that are not due are left alone. The changed rows are
    all that are due.
    """
    if changed_only:
        invoices = invoices.where(is_due(now))
    rows = _joined(invoices, texts, _found="file_found", _supported="supported", _text="text")
    rows = rows.withColumn("_due", is_due(now)).withColumn("_failure", F.when(F.col("_hit"), text_error()))
    claimed = _set(rows, F.col("_due"), status=fv.OCR_PENDING, updated_at=at(now))
    done = _set(
        claimed, F.col("_due") & F.col("_hit") & F.col("_failure").isNull(),
        status=fv.OCR_DONE, ocr_text=F.col("_text"),
    )
    failed = _failed(done, F.col("_due") & F.col("_failure").isNotNull(), F.col("_failure"), now, max_attempts)
    return failed.select(*invoices.columns)


def apply_extraction(invoices: DataFrame, extracted: DataFrame, now: Moment, changed_only: bool = False) -> DataFrame:
    """``extracted(id, fields, confidence_status, error)``; an error is final at once."""
    rows = _joined(invoices, extracted, changed_only, _fields="fields", _confidence="confidence_status", _error="error")
    failed = F.col("_error").isNotNull()
    done = _set(
        rows, F.col("_hit") & ~failed,
        status=fv.EXTRACTED, extracted_fields=F.col("_fields"),
        confidence_status=F.coalesce(F.col("_confidence"), F.lit(fv.ERROR)), updated_at=at(now),
    )
    return _set(
        done, F.col("_hit") & failed,
        status=fv.EXTRACTION_FAILED, last_error=F.concat(F.lit("Extraction failed: "), F.col("_error")),
        updated_at=at(now),
    ).select(*invoices.columns)


def set_status(invoices: DataFrame, updates: DataFrame, now: Moment, changed_only: bool = False) -> DataFrame:
    """``updates(id, status, error)``; a missing error clears the old one."""
    rows = _joined(invoices, updates, changed_only, _status="status", _error="error")
    return _set(
        rows, F.col("_hit"),
        status=F.col("_status"), last_error=F.coalesce(F.col("_error"), F.lit("")), updated_at=at(now),
    ).select(*invoices.columns)


def latest_status(status_events: DataFrame) -> DataFrame:
    """Current state per document; late or repeated events cannot turn it back.

    ``max_by`` combines before the shuffle, so a document with very many events
    sends one row per task.
    """
    newest = F.max_by(F.struct("event_ts", "seq", "event", "error"), F.struct("event_ts", "seq"))
    return status_events.groupBy("doc_id").agg(newest.alias("s")).select("doc_id", "s.*")
