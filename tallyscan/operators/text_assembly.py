"""Text of a document out of pages, glyphs, table rows or OCR segments."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscan.functions import ascii_digits, is_blank, ordered_text, plain_spaces, strip

CHUNK_ROWS = 4096
GLYPH_STEP = 64.0
TABLE_TRY, GLYPH_TRY = 4, 5


def line_key(top: Column) -> Column:
    """Vertical position snapped to steps of five, halves to the even step."""
    return F.bround(top / 5).cast("bigint") * 5


def choose_page_text(page_text: DataFrame) -> DataFrame:
    """Per page and engine the first non-blank text in method order."""
    return (
        page_text.where(~is_blank(F.col("text")))
        .groupBy("doc_id", "engine_rank", "page")
        .agg(F.min(F.struct("method_rank", "text")).alias("t"))
        .select("doc_id", "engine_rank", "page", "t.text")
    )


def choose_pages(page_text: DataFrame) -> DataFrame:
    """``choose_engine`` of ``choose_page_text`` with one shuffle of texts.

    Which pages count is settled on thin rows; these meet the texts on the page, by which
    the texts lie already. Thin rows are told to have a text, which none is without, so that they come out of the
    same exchange and not of tries that are put together anew.
    """
    chosen = choose_page_text(page_text)
    thin = chosen.where(F.col("text").isNotNull()).select("doc_id", "engine_rank", "page")
    first = thin.groupBy("doc_id").agg(F.min("engine_rank").alias("engine_rank"))
    winners = thin.join(first, ["doc_id", "engine_rank"], "left_semi")
    return chosen.join(winners, ["doc_id", "engine_rank", "page"], "left_semi")


def choose_engine(page_text: DataFrame) -> DataFrame:
    """Keeps the rows of the first engine that read any text of the document.

    A later engine counts only for documents in which every earlier one found
    nothing on all pages. The choice travels as one small row per document; the
    texts join it on the key, where the engine may split a hot document.
    """
    found = page_text.where(~is_blank(F.col("text")))
    chosen = found.groupBy("doc_id").agg(F.min("engine_rank").alias("engine_rank"))
    return found.join(chosen, ["doc_id", "engine_rank"])


def glyph_lines(glyphs: DataFrame) -> DataFrame:
    """(doc_id, page, y, line): glyphs of a line from left to right, blank lines dropped."""
    keyed = glyphs.where(F.col("text") != "").withColumn("y", line_key(F.col("top")))
    chunk = F.floor(F.col("x0") / GLYPH_STEP)
    lines = ordered_text(keyed, ["doc_id", "page", "y"], ["x0", "seq"], "text", "", chunk, "line")
    return lines.where(~is_blank(F.col("line")))


def lines_from_glyphs(glyphs: DataFrame) -> DataFrame:
    """(doc_id, page, text). Lines stand in descending order of their key."""
    lines = glyph_lines(glyphs).withColumn("down", -F.col("y"))
    chunk = F.floor(F.col("down") / (5 * CHUNK_ROWS))
    return ordered_text(lines, ["doc_id", "page"], ["down"], "line", "\n", chunk)


def table_row_text(cells: Column) -> Column:
    """Cells with a bar between them, an empty one for null; null for a row without cells."""
    joined = F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " | ")
    return F.when(F.size(cells) > 0, joined)


def table_to_text(table_rows: DataFrame, deal: bool = True) -> DataFrame:
    """(doc_id, page, text): all table rows of a page, one per line."""
    rows = table_rows.withColumn("row_text", table_row_text(F.col("cells")))
    chunk = F.struct(F.col("table_idx"), F.floor(F.col("row_idx") / CHUNK_ROWS))
    return ordered_text(rows, ["doc_id", "page"], ["table_idx", "row_idx"], "row_text", "\n", chunk, deal=deal)


def pages_to_document(pages: DataFrame, deal: bool = True) -> DataFrame:
    """(doc_id, text): stripped non-blank pages with an empty line between.

    A document without any text gives no row.
    """
    rows = pages.select("doc_id", "page", strip(F.col("text")).alias("page_text")).where(F.col("page_text") != "")
    return ordered_text(rows, ["doc_id"], ["page"], "page_text", "\n\n", F.floor(F.col("page") / 256), deal=deal)


def segments_to_document(ocr_segments: DataFrame, deal: bool = True) -> DataFrame:
    """(doc_id, engine_rank, text): detections one per line, stripped, blank results dropped."""
    joined = ordered_text(
        ocr_segments, ["doc_id", "engine_rank"], ["seg_idx"], "text", "\n",
        F.floor(F.col("seg_idx") / CHUNK_ROWS), deal=deal,
    )
    return joined.withColumn("text", strip(F.col("text"))).where(F.col("text") != "")


def page_tries(
    page_text: DataFrame, table_rows: DataFrame | None = None, glyphs: DataFrame | None = None, engine_rank: int = 1
) -> DataFrame:
    """(doc_id, page, engine_rank, method_rank, text): all tries of each page.

    Texts as the reader gave them come first; the table rows of a page are the fourth
    try of the engine, its single characters the fifth. Table rows that lie by document are not moved.
    """
    columns = ["doc_id", "page", "engine_rank", "method_rank", "text"]
    tries = page_text.select(*columns)
    for parts, method, make in ((table_rows, TABLE_TRY, partial(table_to_text, deal=False)), (glyphs, GLYPH_TRY, lines_from_glyphs)):
        if parts is not None:
            ranks = {"engine_rank": F.lit(engine_rank), "method_rank": F.lit(method)}
            tries = tries.unionByName(make(parts).withColumns(ranks).select(*columns))
    return tries


def documents_from_parts(files: DataFrame, tries: DataFrame, ocr_segments: DataFrame | None = None) -> DataFrame:
    """(doc_id, kind, text) for ``files(doc_id, kind)``: pages of a PDF, detections of an image.

    A file of no known kind, or one in which no text was found, has a null text. Kinds
    join finished texts, one row per document. Parts that lie by document are put together where they are.
    """
    pages = pages_to_document(choose_pages(tries), deal=False).select("doc_id", F.lit("pdf").alias("kind"), "text")
    if ocr_segments is not None:
        images = choose_engine(segments_to_document(ocr_segments, deal=False))
        pages = pages.unionByName(images.select("doc_id", F.lit("image").alias("kind"), "text"))
    return files.select("doc_id", "kind").join(pages, ["doc_id", "kind"], "left")


def normalise_text(docs: DataFrame) -> DataFrame:
    """Adds the stripped text, its digits as ASCII ones, and a lower-case copy in which all white space is plain."""
    text = strip(ascii_digits(F.col("text")))
    return docs.withColumn("text", text).withColumn("text_lower", F.lower(plain_spaces(F.col("text"))))
