"""Exact dedup by 128-bit content hashes, with DataFrame functions only.

Texts are equal when identical without white space. A thin row for each document (id, hash, length)
is grouped by hash; groups combine before the shuffle, so a group of any size sends one row a task.
Hashes that occur more than once are marked in a bitmap of fixed size, which is broadcast: only
texts whose hash is marked move. These are grouped by hash *and* bytes, which parts texts that
merely share a hash, and each such class of equal texts names the row that stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscan.llm.common import stored, table

BITS = 26
WINDOW_BITS = 15  # a bitmap of bitmap_construct_agg has 32,768 bits
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def content(text: Column) -> Column:
    """The text without white space; a null one is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def content_hash(content: Column) -> Column:
    return F.unhex(F.md5(content))


def _place(bits: int) -> Column:
    return F.xxhash64("digest").bitwiseAND(F.lit((1 << bits) - 1))


def _inside(bits: int) -> Column:
    return _place(bits).bitwiseAND(F.lit((1 << WINDOW_BITS) - 1)).cast("int")


def marked(digests: DataFrame, bits: int = BITS) -> DataFrame:
    """(_window, _bitmap): the hashes of ``digests(digest)`` in ``2 ** bits`` bits, whatever their number."""
    window = F.shiftright(_place(bits), WINDOW_BITS).alias("_window")
    return digests.groupBy(window).agg(F.bitmap_construct_agg(_inside(bits).cast("bigint")).alias("_bitmap"))


def maybe_marked(rows: DataFrame, bitmap: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows whose ``digest`` is marked, and some that share a bit with such a one. Nothing is shuffled."""
    byte = F.conv(F.hex(F.substring("_bitmap", F.shiftright(_inside(bits), 3) + 1, 1)), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, _inside(bits).bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1))
    joined = rows.join(F.broadcast(bitmap), F.shiftright(_place(bits), WINDOW_BITS) == F.col("_window"))
    return joined.where(bit == 1).select(*rows.columns)


def _classes(bodies: DataFrame, *more: str) -> DataFrame:
    """One row for each hash and body: its size and (less, id) of the row that stays, the longest and then least id."""
    best = F.min(F.struct((-F.col("chars")).alias("less"), "id")).alias("best")
    return bodies.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("n"), best).select("digest", *more, "n", "best")


def copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    hashed: Callable[[Column], Column] = content_hash, bits: int = BITS,
) -> DataFrame:
    """(``id_col``, keep_id, group_size, kept, text_sha256): a row for every row of ``docs``.

    Of equal texts that with the most code points in the original stays, of these the one with the
    smallest id (a null id is smallest). Null, empty and white texts are equal to each other. Every row
    counts in ``group_size``; rows that repeat the id and the length of the one that stays can't be told from
    it and are all marked as kept. Columns other than id and text are not read. An empty table gives
    an empty one. ``hashed`` and ``bits`` decide the cost alone: rows that share a hash are told apart by their bytes.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    body = content(text)
    bodies = docs.select(F.col(id_col).alias("id"), F.length(text).alias("chars"), body.alias("body"))
    bodies = bodies.select("id", hashed(F.col("body")).alias("digest"), "chars", "body")
    thin = stored(bodies.select("id", "digest", "chars", F.unhex(F.sha2("body", 256)).alias("sha256")), "copies-thin")

    several = thin.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    bitmap = stored(marked(several, bits), "copies-bitmap")
    classes = stored(_classes(maybe_marked(bodies, bitmap, bits)), "copies-classes")
    # a hash with two classes is a collision; bodies are fetched again for these few
    clashes = stored(classes.groupBy("digest").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("digest"), "copies-clashes")
    if clashes.isEmpty():
        found = thin.join(classes.where("n > 1"), "digest", "left")
    else:
        alike = bodies.join(clashes, "digest", "left_semi")
        apart = alike.withColumn("sha256", F.unhex(F.sha2("body", 256))).join(_classes(alike, "body"), ["digest", "body"], "left")
        rest = thin.join(clashes, "digest", "left_anti").join(classes.where("n > 1"), "digest", "left")
        columns = ["id", "chars", "sha256", "n", "best"]
        found = rest.select(*columns).union(apart.select(*columns))
    stays = F.col("n").isNull() | (F.col("best.id").eqNullSafe(F.col("id")) & (F.col("best.less") == -F.col("chars")))
    return found.select(
        F.col("id").alias(id_col), F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"), stays.alias("kept"), F.lower(F.hex("sha256")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each class of equal texts, with all their columns as they are.

    Rows that repeat id and text are one row.
    """
    kept = copies(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("id"), "text_sha256").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row").getField(id_col).alias("id"), F.col("row").getField(text_col).alias("text"))
    rows = rows.withColumns({"text_sha256": F.sha2(content(F.col("text")), 256), "less": -F.length(F.coalesce("text", F.lit("")))})
    same = rows["id"].eqNullSafe(kept["id"]) & (rows["text_sha256"] == kept["text_sha256"])
    # an id that stays may come with shorter texts of the same class
    one = rows.join(kept, same, "left_semi").groupBy("id", "text_sha256").agg(F.min_by("row", F.struct("less", "text")).alias("row"))
    return one.select("row.*")


def op11_copies(spark: SparkSession, folder: str) -> DataFrame:
    return copies(table(spark, folder, "documents"))


OP11_SQL = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as body from documents)
select doc_id, first_value(doc_id) over o as keep_id, count(*) over (partition by body) as group_size,
  doc_id = first_value(doc_id) over o as kept, sha256(body) as text_sha256
from d window o as (partition by body order by chars desc, doc_id)
"""
