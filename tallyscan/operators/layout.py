"""Fields from the layout of the first page: table cells and positioned words."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tallyscan import fixed_values as fv
from tallyscan.functions import clean_amount, clean_date, computed, currency_code, is_upper, strip
from tallyscan.functions.amounts import MONEY
from tallyscan.operators.text_assembly import CHUNK_ROWS, line_key

LAYOUT_FIELDS = ["invoice_number", "invoice_date", "vendor_name", "subtotal", "tax", "vat", "total", "currency"]
# a digit, and no letter but that of an exponent: any other word is no number whatever is dropped from it
MAY_BE_AMOUNT = r"(?s)^[^A-DF-Za-df-z0-9]*+[0-9][^A-DF-Za-df-z]*+$"
_TYPES = {"invoice_date": "date", "subtotal": MONEY, "tax": MONEY, "vat": MONEY, "total": MONEY}


def first_page(parts: DataFrame) -> DataFrame:
    return parts.where(F.col("page") == 0)


def readable(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of documents that are no images."""
    no_image = ~F.coalesce(F.col("kind") == "image", F.lit(False))
    return rows.join(docs.where(no_image).select("doc_id"), "doc_id", "left_semi")


def layout_scope(parts: DataFrame, docs: DataFrame) -> DataFrame:
    """Words or table rows of the first page of documents that are no images."""
    return readable(first_page(parts), docs)


def _label_field(label: Column) -> Column:
    """Field a row label stands for; the first rule that fits takes the row."""
    has = label.contains
    return (
        F.when(has("invoice") & (has("number") | has("#") | has("no")), "invoice_number")
        .when(has("date") & (has("invoice") | has("billing")), "invoice_date")
        .when(has("subtotal") | has("sub total"), "subtotal")
        .when(has("tax") & ~has("vat"), "tax")
        .when(has("vat"), "vat")
        .when(has("total") & (has("due") | has("amount") | (label == "total")), "total")
        .when(has("currency") | has("curr"), "currency")
    )


def fields_from_tables(table_rows: DataFrame) -> DataFrame:
    """Label in the first cell, value in the last; the first acceptable row per field wins."""
    cell = lambda i: strip(F.coalesce(F.try_element_at("cells", F.lit(i)), F.lit("")))
    keys = ["doc_id", "table_idx", "row_idx"]
    cut = computed(table_rows.where(F.size("cells") >= 2), keys, F.lower(cell(1)).alias("label"), cell(-1).alias("value"))
    named = computed(cut.where(F.col("value") != ""), [*keys, "value"], _label_field(F.col("label")).alias("field"))
    pairs = named.where(F.col("field").isNotNull())
    place = F.struct("table_idx", "row_idx", "value")

    def first(field: str, value: Column) -> Column:
        usable = F.when(F.col("field") == field, value)
        return F.min_by(usable, F.when(usable.isNotNull(), place))

    cleaned = pairs.withColumns({
        "amount": F.when(F.col("field").isin("subtotal", "tax", "vat", "total"), clean_amount(F.col("value"))),
        "day": F.when(F.col("field") == "invoice_date", clean_date(F.col("value"))),
        "code": F.when(F.col("field") == "currency", currency_code(F.col("value"))),
    })
    return cleaned.groupBy("doc_id").agg(
        first("invoice_number", F.col("value")).alias("invoice_number"),
        first("invoice_date", F.col("day")).alias("invoice_date"),
        *[first(f, F.col("amount")).alias(f) for f in ("subtotal", "tax", "vat", "total")],
        first("currency", F.col("code")).alias("currency"),
    )


def lines_from_words(words: DataFrame, deal: bool = True) -> DataFrame:
    """(doc_id, page, y, line, amount): words of a line in input order.

    ``amount`` is the first word of the line that is one. Words meet in bounded
    chunks, chunk results per line, so a hot document spreads over many tasks. Without ``deal`` words that lie by
    document stay where they are, and only others are dealt.
    """
    keyed = words.where(F.col("text") != "").select(
        "doc_id", "page", line_key(F.coalesce(F.col("top"), F.lit(0.0))).alias("y"), "word_idx", "text",
        F.floor(F.col("word_idx") / CHUNK_ROWS).alias("chunk"),
    )
    sorted_words = F.sort_array(F.collect_list(F.struct("word_idx", "text")))
    if deal:  # by line and chunk even if a join before has put a document into one partition
        keyed = keyed.repartition("doc_id", "page", "y", "chunk")
    chunks = keyed.groupBy("doc_id", "page", "y", "chunk").agg(sorted_words.alias("words"))
    may_be_amount = F.filter(F.col("words")["text"], lambda w: w.rlike(MAY_BE_AMOUNT))
    amounts = F.filter(F.transform(may_be_amount, clean_amount), lambda a: a.isNotNull())
    chunk_lines = chunks.select(
        "doc_id", "page", "y",
        F.struct(
            "chunk",
            F.array_join(F.col("words")["text"], " ").alias("line"),
            F.get(amounts, F.lit(0)).alias("amount"),
        ).alias("part"),
    )
    parts = chunk_lines.groupBy("doc_id", "page", "y").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    part_amounts = F.filter(F.col("parts")["amount"], lambda a: a.isNotNull())
    return parts.select(
        "doc_id", "page", "y",
        F.array_join(F.col("parts")["line"], " ").alias("line"),
        F.get(part_amounts, F.lit(0)).alias("amount"),
    )


def amounts_from_lines(lines: DataFrame) -> DataFrame:
    """subtotal, tax, vat, total: amount of the topmost line with the label.

    The tests are independent, so a subtotal line above the total also sets it.
    """
    flags = _amount_labels()
    found = lines.where(F.col("amount").isNotNull()).select(
        "doc_id", "y", "amount", *[flag.alias(f"is_{name}") for name, flag in flags.items()]
    ).where(" or ".join(f"is_{name}" for name in flags))
    return found.groupBy("doc_id").agg(*_topmost_amounts(flags))


def _amount_labels() -> dict[str, Column]:
    label = F.lower("line")
    return {
        "subtotal": label.contains("subtotal") | label.contains("sub total"),
        "tax": label.contains("tax") & ~label.contains("vat"),
        "vat": label.contains("vat"),
        "total": label.contains("total") | label.contains("amount due"),
    }


def _topmost_amounts(names: Iterable[str]) -> list[Column]:
    return [F.min_by("amount", F.when(F.col(f"is_{name}"), F.col("y"))).alias(name) for name in names]


def vendor_from_lines(lines: DataFrame) -> DataFrame:
    """First company-like line among the five topmost ones.

    The rank limit is applied before the shuffle too, so five lines per document
    and task travel, not all of them.
    """
    top = lines.select("doc_id", "y", "line").withColumn("rank", F.row_number().over(_topmost())).where("rank <= 5")
    return (
        top.where(_may_be_vendor())
        .groupBy("doc_id")
        .agg(F.min_by("line", "y").alias("vendor_name"))
        .withColumn("vendor_name", strip(F.col("vendor_name")))
    )


def _topmost() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("y")


def _may_be_vendor() -> Column:
    line = F.col("line")
    label = F.lower(line)
    skipped = F.lit(False)
    for word in fv.LAYOUT_VENDOR_SKIP:
        skipped = skipped | label.contains(word)
    return ~skipped & F.length(line).between(4, 49) & is_upper(F.substring(line, 1, 1)) & ~is_upper(line)


def fields_from_lines(words: DataFrame) -> DataFrame:
    """Amounts and vendor out of positioned words: ``amounts_from_lines`` and ``vendor_from_lines`` in one pass over the lines.

    Words that lie by document, as after a join on it, are not moved at all, nor are their lines.
    """
    lines = lines_from_words(words, deal=False)
    flags = _amount_labels()
    ranked = lines.select("doc_id", "y", "line", "amount", F.row_number().over(_topmost()).alias("rank"))
    told = ranked.select(
        "doc_id", "y", "amount", *[(flag & F.col("amount").isNotNull()).alias(f"is_{name}") for name, flag in flags.items()],
        F.when((F.col("rank") <= 5) & _may_be_vendor(), F.col("line")).alias("vendor"),
    ).where(" or ".join([*[f"is_{name}" for name in flags], "vendor is not null"]))
    vendor = F.min_by("vendor", F.when(F.col("vendor").isNotNull(), F.col("y")))
    return told.groupBy("doc_id").agg(*_topmost_amounts(flags), strip(vendor).alias("vendor_name"))


def merge_layout(tables: DataFrame, lines: DataFrame) -> DataFrame:
    """Table value first, line value where the tables have none."""
    t, w = tables.alias("t"), lines.alias("w")
    joined = t.join(w, F.col("t.doc_id") == F.col("w.doc_id"), "full_outer")

    def merged(field: str) -> Column:
        sides = [F.col(f"{a}.{field}") for a, df in (("t", tables), ("w", lines)) if field in df.columns]
        return F.coalesce(*sides).alias(field)

    return joined.select(F.coalesce("t.doc_id", "w.doc_id").alias("doc_id"), *[merged(f) for f in LAYOUT_FIELDS])


def page_fields(words: DataFrame | None, table_rows: DataFrame | None) -> DataFrame:
    """Fields of every first page, one row per document with any of them.

    Images are not sorted out here: that is one test per document later, where a
    join at this point would move every word.
    """
    tables = None if table_rows is None else fields_from_tables(first_page(table_rows))
    lines = None if words is None else fields_from_lines(first_page(words))
    if tables is not None and lines is not None:
        return merge_layout(tables, lines)
    one = tables if tables is not None else lines
    missing = {f: F.lit(None).cast(_TYPES.get(f, "string")) for f in LAYOUT_FIELDS if f not in one.columns}
    return one.withColumns(missing).select("doc_id", *LAYOUT_FIELDS)


def layout_fields(docs: DataFrame, words: DataFrame | None, table_rows: DataFrame | None) -> DataFrame:
    """Everything the layout of the first page gives, for documents that are no images."""
    return readable(page_fields(words, table_rows), docs)
