"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

A window of a benchmark item (13 words, or the whole of a shorter item) is a set of word shingles.
All of them must occur in a document that holds the window, so it is enough to look for one: the
rarest in the documents. The documents are read once for all occurrences of any benchmark
shingle; rarity is counted over these, each window is joined on its one prefix shingle, bounded
by position and length, and compared word by word with the document's words at that place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyscan.llm.common import stored, table, unused

WINDOW = 13
SHINGLE = 5
PIECE = 256
BROADCAST_ROWS = 1_000_000  # shingles of eight bytes
# ASCII characters that no word has.
SEPARATORS = "".join(chr(i) for i in range(128) if not chr(i).isalnum())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words: runs of digits, ASCII letters and all characters beyond ASCII."""
    plain = F.translate(F.coalesce(text, F.lit("")), SEPARATORS + UPPER, " " * len(SEPARATORS) + LOWER)
    return F.array_remove(F.split(plain, " "), "")


def benchmark_windows(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(window, length, item): all windows as words joined by a blank."""
    rows = items.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words"))
    length = F.least(F.lit(window), F.size("words"))
    starts = F.sequence(F.lit(0), F.size("words") - length)
    rows = rows.where(F.size("words") > 0).select("item", "words", length.alias("length"), F.explode(starts).alias("at"))
    return rows.select(F.array_join(F.slice("words", F.col("at") + 1, F.col("length")), " ").alias("window"), "length", "item").distinct()


def _shingle_hash(k: int, words: list[Column]) -> Column:
    return F.xxhash64(F.lit(k), *words[:k])


def _window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """(window, length, k, offset, h): the shingles of each window."""
    rows = windows.select("window", "length").distinct().withColumn("words", F.split("window", " "))
    rows = rows.withColumn("k", F.least(F.lit(shingle), F.col("length")))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("length") - F.col("k"))).alias("offset"))
    each = [F.get("words", F.col("offset") + i) for i in range(shingle)]
    h = reduce(lambda other, k: F.when(F.col("k") == k, _shingle_hash(k, each)).otherwise(other), range(1, shingle + 1), F.lit(None))
    return rows.select("window", "length", "k", "offset", h.alias("h"))


def _occurrences(rows: DataFrame, shingles: DataFrame, sizes: list[int], window: int, small: bool) -> DataFrame:
    """(id, digest, n, at, h, first, near): where a benchmark shingle occurs, with the words around it.

    ``near`` are the words from position ``first`` on that any window over this place can have.
    Documents are cut into overlapping pieces first, so that no row holds more than a piece. A small
    set of shingles is broadcast; otherwise bare places are shuffled and meet their document again.
    """
    margin = window - 1
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(PIECE))
    pieces = F.transform(
        starts,
        lambda s: F.struct(
            s.alias("from"), F.greatest(s - margin, F.lit(0)).alias("base"),
            F.slice("words", F.greatest(s - margin, F.lit(0)) + 1, F.lit(PIECE + 2 * margin)).alias("words"),
        ),
    )
    cut = rows.where(F.size("words") > 0).select("id", "digest", F.size("words").alias("n"), F.explode(pieces).alias("p"))
    cut = cut.select("id", "digest", "n", "p.from", "p.base", F.col("p.words").alias("part"))
    last = F.least(F.col("from") + PIECE, F.col("n")) - 1
    placed = cut.select("*", F.explode(F.sequence(F.col("from"), last)).alias("at"))
    each = [F.get("part", F.col("at") - F.col("base") + i) for i in range(max(sizes))]
    fits = [F.when(F.col("at") + k <= F.col("n"), _shingle_hash(k, each)) for k in sizes]
    if len(sizes) == 1:
        placed = placed.withColumn("h", fits[0]).where("h is not null")
    else:
        placed = placed.withColumn("h", F.explode(F.filter(F.array(*fits), lambda h: h.isNotNull())))
    wanted = shingles.select("h").distinct()
    first = F.greatest(F.lit(0), F.col("at") - margin)
    if small:
        found = placed.join(F.broadcast(wanted), "h", "left_semi")
        near = F.slice("part", first - F.col("base") + 1, F.lit(2 * window - 1))
        return found.select("id", "digest", "n", "at", "h", first.alias("first"), near.alias("near"))
    bare = placed.select("id", "digest", "at", "h").join(wanted, "h", "left_semi")
    of_document = bare.groupBy(F.col("id").alias("_id"), F.col("digest").alias("_digest")).agg(F.collect_set(F.struct("at", "h")).alias("places"))
    key = F.col("id").eqNullSafe(F.col("_id")) & F.col("digest").eqNullSafe(F.col("_digest"))
    again = rows.dropDuplicates(["id", "digest"]).join(of_document, key)
    near = F.transform(
        "places",
        lambda q: F.struct(
            q["at"].alias("at"), q["h"].alias("h"), F.greatest(F.lit(0), q["at"] - margin).alias("first"),
            F.slice("words", F.greatest(F.lit(0), q["at"] - margin) + 1, F.lit(2 * window - 1)).alias("near"),
        ),
    )
    return again.select("id", "digest", F.size("words").alias("n"), F.inline(near))


def window_hits(rows: DataFrame, windows: DataFrame, window: int, shingle: int) -> DataFrame:
    """(id, digest, start, length, window): all occurrences of windows in ``rows(id, digest, words)``."""
    shingles = stored(_window_shingles(windows, shingle), "decontaminate-shingles")
    bounds = shingles.agg(F.collect_set("k"), F.count(F.lit(1))).first()  # at most ``shingle`` sizes, and a count
    sizes = sorted(bounds[0]) or [shingle]
    found = stored(_occurrences(rows, shingles, sizes, window, bounds[1] <= BROADCAST_ROWS), "decontaminate-occurrences")
    counts = found.groupBy("h").agg(F.count(F.lit(1)).alias("documents"))
    rarest = F.min(F.struct("documents", "h", "offset")).alias("prefix")
    prefix = (
        shingles.join(counts, "h", "left")
        .groupBy("window", "length")
        .agg(rarest, F.count("documents").alias("present"), F.count(F.lit(1)).alias("needed"))
        .where("present = needed")
        .select("window", "length", "prefix.h", "prefix.offset")
    )
    start = F.col("at") - F.col("offset")
    joined = found.join(prefix, "h").where((start >= 0) & (start + F.col("length") <= F.col("n")))
    there = F.array_join(F.slice("near", start - F.col("first") + 1, F.col("length")), " ")
    return joined.where(there == F.col("window")).select("id", "digest", start.alias("start"), "length", "window")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
) -> DataFrame:
    """(id_col, n_words, n_hit, n_items, items_sha256, contaminated, digest) for every row of ``docs``.

    A word inside any occurrence of a window is hit; contaminated means that at least one word in
    twenty is. Null and empty texts have no words and are clean, as are documents when there are no
    items; items without words have no window; items without an id are not counted but hit. Rows
    that repeat an id are told apart by their text (``digest``); exact repeats get equal results.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("_text"))
    rows = rows.select("id", F.md5("_text").alias("digest"), "_text")
    windows = stored(benchmark_windows(items, item_col, item_text_col, window), "decontaminate-windows")
    words = rows.select("id", "digest", words_of(F.col("_text")).alias("words"))
    hits = stored(window_hits(words, windows, window, shingle).distinct(), "decontaminate-hits")
    end = F.col("start") + F.col("length")
    before = Window.partitionBy("id", "digest").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("id", "digest", "start", "length").distinct()
    covered = (
        spans.withColumn("before", F.coalesce(F.max(end).over(before), F.lit(0)))
        .groupBy("id", "digest")
        .agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "before"))).alias("n_hit"))
    )
    named = (
        hits.select("id", "digest", "window").distinct().join(windows.where("item is not null"), "window")
        .groupBy("id", "digest")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    counts = rows.select("id", "digest", F.coalesce(F.regexp_count("_text", F.lit(WORD)), F.lit(0)).alias("n_words"))

    def keys(name: str):
        return F.col("d.id").eqNullSafe(F.col(f"{name}.id")) & F.col("d.digest").eqNullSafe(F.col(f"{name}.digest"))

    n_hit = F.coalesce("c.n_hit", F.lit(0)).cast("bigint")
    ids = F.coalesce("i.items", F.array().cast("array<string>"))
    return (
        counts.alias("d").join(covered.alias("c"), keys("c"), "left").join(named.alias("i"), keys("i"), "left")
        .select(
            F.col("d.id").alias(id_col),
            F.col("n_words").cast("bigint").alias("n_words"),
            n_hit.alias("n_hit"),
            F.size(ids).cast("bigint").alias("n_items"),
            F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
            ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
            F.col("d.digest").alias("digest"),
        )
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns kept."""
    bad_id, bad_digest = (unused(name, docs.columns) for name in ("_bad_id", "_bad_digest"))
    bad = decontaminate(docs, items, id_col, text_col).where("contaminated").select(
        F.col(id_col).alias(bad_id), F.col("digest").alias(bad_digest)
    ).distinct()
    key = F.col(id_col).eqNullSafe(F.col(bad_id)) & F.md5(F.col(text_col).cast("string")).eqNullSafe(F.col(bad_digest))
    return docs.join(bad, key, "left_anti")


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("digest")


OP1_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (
  select distinct item_id, least(13, len(w)) as n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') as t
  from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as s from b where len(w) > 0)),
lens as (select distinct n from bw),
dw as (
  select doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') as t
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, lens where len(w) >= n)),
hit as (select distinct doc_id, n, s, t from dw where t in (select t from bw)),
nh as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from hit) group by doc_id),
it as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from hit join bw using (t)) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join nh using (doc_id) left join it using (doc_id)
"""
