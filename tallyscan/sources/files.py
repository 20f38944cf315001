"""Uploaded files as a table of bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscan import fixed_values as fv
from tallyscan.functions import strip


def scan_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of all files below ``path``."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
    )


FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(
    spark: SparkSession, path: str, pattern: str = "*", files_per_batch: int = 1000, archive: str | None = None
) -> DataFrame:
    """The same rows as ``scan_files`` as files arrive, ``files_per_batch`` at a time.

    With ``archive`` the source moves files there once a later batch has begun, so a listing stays short.
    """
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(path)


def classify_files(files: DataFrame) -> DataFrame:
    """Adds ``kind`` (image, pdf or null) and ``supported``.

    Needs ``path`` and ``content`` (or only its first bytes as ``head``); a
    ``content_type`` helps where there is one. The image test comes first, by extension or MIME type. A name that
    starts with its only dot has no extension.
    """
    head = F.col("head") if "head" in files.columns else F.substring(F.col("content"), 1, 4)
    extension = F.lower(F.regexp_extract("path", r"[^./][^/]*\.([^./]*)$", 1))
    content_type = F.col("content_type") if "content_type" in files.columns else F.lit(None).cast("string")
    mime = strip(F.split_part(F.lower(content_type), F.lit(";"), F.lit(1)))
    image = extension.isin(fv.IMAGE_EXTENSIONS) | F.coalesce(mime.isin(fv.IMAGE_MIME_TYPES), F.lit(False))
    kind = F.when(image, "image").when(head == F.lit(bytearray(fv.PDF_MAGIC.encode())), "pdf")
    return files.withColumn("kind", kind).withColumn("supported", F.col("kind").isNotNull())


def mime_type(files: DataFrame) -> DataFrame:
    """Adds ``content_type`` of classified files by extension and first bytes; null where neither tells."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    same = F.when(extension == "jpg", "jpeg").when(extension == "tif", "tiff").otherwise(extension)
    image = F.when(F.col("kind") == "image", F.concat(F.lit("image/"), same))
    return files.withColumn("content_type", F.when(F.col("kind") == "pdf", "application/pdf").otherwise(image))


def content_digest(files: DataFrame) -> DataFrame:
    """Adds ``sha256``, the first four bytes as ``head`` and the byte count as ``length``.

    Everything later needs of the bytes is here, so they stay out of the shuffles.
    """
    return files.withColumns({
        "sha256": F.sha2("content", 256),
        "head": F.substring(F.col("content"), 1, 4),
        "length": F.octet_length("content").cast("bigint"),
    })


def plain_path(path: Column) -> Column:
    """``file:/a/b`` and ``file:///a/b`` are ``/a/b``; other stores keep their scheme."""
    return F.regexp_replace(path, "^file:/+", "/")


def check_sizes(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(id, expected_length, stored_length) where a stored file is missing or differs in size."""
    stored = files.select(plain_path(F.col("path")).alias("path"), F.col("length").alias("stored_length"))
    joined = manifest.select("id", plain_path(F.col("storage_path")).alias("path"), "expected_length").join(stored, "path", "left")
    stored_length = F.coalesce("stored_length", F.lit(0))
    return joined.where(stored_length != F.col("expected_length")).select(
        "id", "expected_length", stored_length.alias("stored_length")
    )
