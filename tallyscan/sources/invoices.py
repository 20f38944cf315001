"""Rows of the ``invoices`` table: first arrival, keys, first state, storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscan import fixed_values as fv
from tallyscan.operators.lifecycle import Moment, at

KEY = ["email_message_id", "sha256"]
INVOICE_COLUMNS = [
    "id", "email_message_id", "sender", "subject", "received_at", "filename", "content_type", "sha256",
    "storage_path", "status", "attempt_count", "next_attempt_at", "last_error", "ocr_text",
    "extracted_fields", "confidence_status", "created_at", "updated_at",
]
INVOICE_SCHEMA = ", ".join(
    f"{c} " + {"attempt_count": "int"}.get(c, "timestamp" if c.endswith("_at") else "string") for c in INVOICE_COLUMNS
)


def dedupe_ingest(new: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """New rows only, one per message id and digest; a stored row always wins.

    Among equal keys the earliest (then first by name) row stays. The choice is an
    aggregate that combines before the shuffle, so copies of one attachment do not
    pile up in a task. Bytes are left out: equal keys have equal bytes.
    """
    slim = new.drop("content")
    first = [c for c in ("received_at", "filename") if c in slim.columns]
    rest = [c for c in slim.columns if c not in (*KEY, *first)]
    unique = slim.groupBy(*KEY).agg(F.min(F.struct(*first, *rest)).alias("r")).select(*KEY, "r.*")
    unique = unique.select(*slim.columns)
    return unique if existing is None else unique.join(existing.select(*KEY), KEY, "left_anti")


def uuid_text(*parts: str) -> Column:
    """An id in UUID shape out of the digest of ``parts``; a rerun gives the same id."""
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    cut = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, start, length) for start, length in cut])


def assign_storage_key(rows: DataFrame, storage_dir: str = "storage") -> DataFrame:
    """Adds ``id`` and ``storage_path``: the id with the lower-case end of the name, if it has a dot."""
    end = F.lower(F.element_at(F.split("filename", r"\."), -1))
    suffix = F.when(F.col("filename").contains("."), F.concat(F.lit("."), end)).otherwise("")
    keyed = rows.withColumn("id", uuid_text(*KEY))
    return keyed.withColumn("storage_path", F.concat(F.lit(storage_dir.rstrip("/") + "/"), F.col("id"), suffix))


def initial_state(rows: DataFrame, now: Moment) -> DataFrame:
    """All invoice columns of rows that have just arrived, due at once."""
    text = lambda c, default: F.coalesce(F.col(c), F.lit(default)).alias(c)
    null = F.lit(None).cast("string")
    return rows.select(
        "id", "email_message_id", text("sender", ""), text("subject", ""),
        F.coalesce("received_at", at(now)).alias("received_at"),
        text("filename", "attachment"), text("content_type", fv.DEFAULT_CONTENT_TYPE),
        "sha256", "storage_path",
        F.lit(fv.RECEIVED).alias("status"), F.lit(0).alias("attempt_count"), at(now).alias("next_attempt_at"),
        F.lit("").alias("last_error"), null.alias("ocr_text"), null.alias("extracted_fields"),
        F.lit(fv.ERROR).alias("confidence_status"), at(now).alias("created_at"), at(now).alias("updated_at"),
    )


def evolve_schema(old: DataFrame) -> DataFrame:
    """Adds ``confidence_status`` where an older table has none; gaps become ERROR."""
    if "confidence_status" not in old.columns:
        return old.withColumn("confidence_status", F.lit(fv.ERROR))
    return old.withColumn("confidence_status", F.coalesce("confidence_status", F.lit(fv.ERROR)))


def write_invoices(invoices: DataFrame, path: str, mode: str = "append", by: str = "day") -> None:
    """Parquet in one folder per day (or month) of arrival.

    Rows are rebalanced by date: a task writes few folders, a day with very many rows is split over several
    tasks by its size, and the rows are worked out once, as nothing is sampled.
    """
    dated = invoices.withColumn("ingest_date", F.trunc(F.to_date("received_at"), by) if by != "day" else F.to_date("received_at"))
    dated.hint("rebalance", "ingest_date").sortWithinPartitions("ingest_date", "id").write.mode(mode).partitionBy("ingest_date").parquet(path)


def read_invoices(spark: SparkSession, path: str) -> DataFrame:
    """Stored rows, older files without the status column included. The schema is given, so no footers are merged."""
    stored = spark.read.schema(f"{INVOICE_SCHEMA}, ingest_date date").parquet(path)
    return evolve_schema(stored).select(*INVOICE_COLUMNS)
