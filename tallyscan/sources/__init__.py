"""Sources, ingest and sinks."""

from tallyscan.sources.files import check_sizes, classify_files, content_digest, file_stream, mime_type, scan_files
from tallyscan.sources.invoices import (
    assign_storage_key, dedupe_ingest, evolve_schema, initial_state, read_invoices, write_invoices,
)

__all__ = [
    "assign_storage_key", "check_sizes", "classify_files", "content_digest", "dedupe_ingest",
    "evolve_schema", "file_stream", "initial_state", "mime_type", "read_invoices", "scan_files", "write_invoices",
]
