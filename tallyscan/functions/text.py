"""Text helpers, and the ordered concatenation all text assembly uses."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscan.fixed_values import WHITESPACE
from tallyscan.functions.sqltext import WIDE_SPACE


def strip(col: Column) -> Column:
    """Both ends trimmed of every white space character, not of blanks only."""
    return F.btrim(col, F.lit(WHITESPACE))


def is_blank(col: Column) -> Column:
    """True for null, empty and white space only."""
    return F.coalesce(strip(col), F.lit("")) == ""


def plain_spaces(col: Column) -> Column:
    """Maps wide white space 1:1 to a blank, so that ``\\s`` sees it and offsets stay."""
    return F.regexp_replace(col, WIDE_SPACE, " ")


@lru_cache(maxsize=1)
def _digits() -> tuple[str, str]:
    """All decimal digits beyond ASCII, and the ASCII ones they stand for."""
    other = [chr(c) for c in range(128, 0x110000) if unicodedata.decimal(chr(c), None) is not None]
    return "".join(other), "".join(str(unicodedata.decimal(c)) for c in other)


def ascii_digits(col: Column) -> Column:
    """Decimal digits of any script as 0 to 9, one for one; texts without such digits are not touched."""
    return F.when(col.rlike(r"[\p{Nd}&&[^0-9]]"), F.translate(col, *_digits())).otherwise(col)


def is_upper(col: Column) -> Column:
    """At least one cased letter and no lower-case one."""
    return (col == F.upper(col)) & (col != F.lower(col))


def title_case(col: Column) -> Column:
    """Every run of letters gets a capital, so ``o'reilly & co-op`` -> ``O'Reilly & Co-Op``."""
    runs = F.regexp_extract_all(col, F.lit(r"([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed(df: DataFrame, keep: Sequence[str], *columns: Column) -> DataFrame:
    """``keep`` and ``columns`` as a one-row generator.

    A later filter on ``columns`` stays above it. In a plain projection the optimizer
    would push the filter below and evaluate the columns twice, patterns included.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*columns))))


def ordered_text(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    text: str,
    sep: str,
    chunk: Column,
    out: str = "text",
    deal: bool = True,
) -> DataFrame:
    """Concatenates ``text`` per ``keys`` in the order of ``order``.

    Two levels, so that no task has to hold all rows of a hot key: rows meet in
    chunks first (``chunk`` must not decrease along ``order``), and only finished
    chunk texts meet per key. Without ``deal`` rows that lie by key already stay where they are, and only
    others are dealt. Null texts are skipped; a key with no text at all gives no row.
    """
    rows = df.where(F.col(text).isNotNull())
    piece = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col(text).alias("t"))

    def joined(name: str) -> Column:
        return F.array_join(F.sort_array(F.collect_list(F.col(name)))["t"], sep)  # sort_array has no lambda for each comparison

    pieces = rows.select(*keys, chunk.alias("_chunk"), piece.alias("_piece"))
    if deal:  # by chunk even if the rows already lie by key, else a hot key stays in one task
        pieces = pieces.repartition(*keys, "_chunk")
    chunks = pieces.groupBy(*keys, "_chunk").agg(joined("_piece").alias("_text"))
    return (
        chunks.select(*keys, F.struct(F.col("_chunk").alias("o0"), F.col("_text").alias("t")).alias("_part"))
        .groupBy(*keys)
        .agg(joined("_part").alias(out))
    )
