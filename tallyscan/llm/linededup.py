"""Line dedup by winnowing over line hashes, with DataFrame functions only.

Blank lines aside, a document is a sequence of line digests. Grams of two digests are hashed, and of
every window of grams that covers a run of ``run`` lines the least is a fingerprint (the last of
equal ones), so equal runs share a fingerprint at the same place. Fingerprints that occur more than
once are joined with their positions, matches are extended both ways to whole runs and compared
by digest, and every run that has an earlier equal is deleted; overlapping runs grow together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyscan.llm.common import stored, table

RUN = 3
GRAM = 2
LONG = 50
SEPARATOR = "\n"
NOT_BLANK = r"[^ \t\r\f\x0B]"


def _digests(text: Column) -> Column:
    """(no, d) of the lines that are not blank: line number and 16-byte digest."""
    lines = F.split(text, SEPARATOR)
    numbered = F.transform(lines, lambda line, no: F.struct(no.alias("no"), line.alias("line")))
    real = F.filter(numbered, lambda s: s["line"].rlike(NOT_BLANK))
    return F.transform(real, lambda s: F.struct(s["no"].alias("no"), F.unhex(F.md5(s["line"])).alias("d")))


def fingerprints(rows: DataFrame, run: int, gram: int) -> DataFrame:
    """(id, digest, g, at, first, near): the selected grams of ``rows(id, digest, text)``.

    ``near`` are the lines from index ``first`` on that any run over this gram can have.
    """
    width = run - gram + 1
    rows = rows.select("id", "digest", _digests(F.col("text")).alias("lines")).where(F.size("lines") >= run)
    grams = F.transform(
        F.sequence(F.lit(0), F.size("lines") - gram), lambda p: F.xxhash64(F.slice("lines.d", p + 1, F.lit(gram)))
    )
    rows = rows.withColumn("grams", grams)

    def selected(s: Column) -> Column:
        window = F.slice("grams", s + 1, F.lit(width))
        return s + width - F.array_position(F.reverse(window), F.array_min(window))

    chosen = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("lines") - run), selected))
    rows = rows.select("id", "digest", "lines", "grams", F.explode(chosen.cast("array<int>")).alias("at"))
    first = F.greatest(F.lit(0), F.col("at") - (run - gram))
    last = F.col("at") + gram + (run - gram)
    return rows.select(
        "id", "digest", F.get("grams", "at").alias("g"), "at", first.alias("first"),
        F.slice("lines", first + 1, last - first).alias("near"),
    )


def long_runs(rows: DataFrame, run: int, words: int) -> DataFrame:
    """(id, digest, s, start, end, content): runs of fewer than ``run`` lines that hold ``words`` words or more."""
    lines = F.split("text", SEPARATOR)
    numbered = F.transform(lines, lambda line, no: F.struct(no.alias("no"), line.alias("line")))
    real = F.filter(numbered, lambda s: s["line"].rlike(NOT_BLANK))
    counted = F.transform(real, lambda s: F.struct(
        s["no"].alias("no"), F.md5(s["line"]).alias("d"), F.size(F.split(F.trim(s["line"]), r"[ \t\r\f\x0B]+")).alias("n")
    ))
    # as an array of one, so that the lines are split once for all lengths
    rows = rows.where(F.length("text") >= 2 * words - 1).select("id", "digest", F.explode(F.array(counted)).alias("lines"))

    def of(size: int) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda s: s <= F.size("lines") - size)
        runs = F.transform(starts, lambda s: F.struct(s.alias("s"), F.slice("lines", s + 1, size).alias("run")))
        whole = F.filter(runs, lambda r: F.aggregate(r["run"]["n"], F.lit(0), lambda n, k: n + k) >= words)
        return F.transform(whole, lambda r: F.struct(
            r["s"].alias("s"), F.get(r["run"]["no"], F.lit(0)).alias("start"), F.get(r["run"]["no"], F.lit(size - 1)).alias("end"),
            F.md5(F.array_join(r["run"]["d"], "")).alias("content"),
        ))

    found = F.concat(*[of(size) for size in range(1, run)])
    return rows.where(F.size("lines") > 0).select("id", "digest", F.inline(found))


def repeated_runs(rows: DataFrame, run: int = RUN, gram: int = GRAM, words: int | None = None) -> DataFrame:
    """(id, digest, start, end): merged stretches of line numbers, both ends included, to delete.

    A run is deleted if an equal one starts earlier, by (id, digest, line). With ``words`` so is a
    shorter one that holds as many words.
    """
    prints = stored(fingerprints(rows, run, gram), "lines-fingerprints")
    several = prints.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g")
    matched = prints.join(several, "g", "left_semi")
    offsets = F.sequence(F.greatest(F.lit(0), F.col("at") - (run - gram)), F.least(F.col("at"), F.col("first") + F.size("near") - run))
    extended = matched.where(F.col("first") + F.size("near") - run >= F.col("first")).select(
        "id", "digest", "first", "near", F.explode(offsets).alias("s")
    )
    lines = F.slice("near", F.col("s") - F.col("first") + 1, F.lit(run))
    runs = (
        extended.select("id", "digest", "s", lines.alias("run"))
        .select("id", "digest", "s", F.get("run.no", F.lit(0)).alias("start"), F.get("run.no", F.lit(run - 1)).alias("end"),
                F.md5(F.array_join(F.transform("run.d", lambda d: F.hex(d)), "")).alias("content"))
    )
    if words is not None and run > 1:
        runs = runs.union(long_runs(rows, run, words))
    found = stored(runs, "lines-runs")
    place = F.struct("id", "digest", "s")
    first = found.groupBy("content").agg(F.min(place).alias("earliest"))
    later = found.join(first, "content").where(place > F.col("earliest")).select("id", "digest", "start", "end").distinct()
    order = Window.partitionBy("id", "digest").orderBy("start", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.col("start") > F.max("end").over(before) + 1, F.lit(True)).cast("int")
    marked = later.withColumn("fresh", fresh).withColumn("stretch", F.sum("fresh").over(order))
    return marked.groupBy("id", "digest", "stretch").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("stretch")


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, gram: int = GRAM, words: int | None = None
) -> DataFrame:
    """``docs`` with ``_kept`` (the text that is left), ``_lines``, ``_removed`` and ``_runs``.

    A run of ``run`` or more lines (blank ones aside) that has been seen in an earlier document, or
    earlier in the same one, is deleted with the blank lines inside it; the first one stays. With ``words`` a
    run of fewer lines goes too if it holds as many words. Earlier means a smaller id, then
    a smaller digest for rows that repeat an id; exact repeats count as one document. A null id is
    earliest. Null texts stay null; a document that is deleted whole becomes empty. A column of ``docs`` with
    the name of a new one is replaced.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.md5(F.col(text_col)).alias("digest"), F.col(text_col).alias("text"))
    stretches = repeated_runs(rows, run, gram, words)
    per_doc = stretches.groupBy(F.col("id").alias("_id"), F.col("digest").alias("_digest")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_gone")
    )
    # the columns travel as one, so their names can't clash with those used here
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")
    )
    key = F.col("id").eqNullSafe(F.col("_id")) & F.md5("text").eqNullSafe(F.col("_digest"))
    joined = packed.join(per_doc, key, "left")
    lines = F.split("text", SEPARATOR)
    gone = F.col("_gone")
    edges = F.concat(gone, F.array(F.struct(F.size(lines).alias("start"), F.size(lines).alias("end"))))
    kept = F.flatten(
        F.transform(
            edges,
            lambda e, i: F.slice(
                F.col("_split"), F.when(i == 0, 0).otherwise(F.get(gone, i - 1)["end"] + 1) + 1,
                e["start"] - F.when(i == 0, 0).otherwise(F.get(gone, i - 1)["end"] + 1),
            ),
        )
    )
    removed = F.aggregate(gone, F.lit(0), lambda n, g: n + g["end"] - g["start"] + 1)
    new = {
        "_kept": F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(kept, SEPARATOR)),
        "_lines": F.coalesce(F.size(lines), F.lit(0)).cast("bigint"),
        "_removed": F.coalesce(removed, F.lit(0)).cast("bigint"),
        "_runs": F.coalesce(F.size(gone), F.lit(0)).cast("bigint"),
    }
    return joined.withColumn("_split", F.when(gone.isNotNull(), lines)).select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns if c not in new], *[v.alias(c) for c, v in new.items()]
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int | None = LONG) -> DataFrame:
    """``docs`` with the text that is left; documents of which nothing is left are dropped.

    Runs of three lines and more go, and runs of one or two lines that hold ``words`` words or more.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(row.alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    done = without_repeats(packed, "id", "text", words=words)
    done = done.where((F.col("_removed") == 0) | F.col("_kept").rlike(r"[^ \t\r\n\f\x0B]"))
    new = {text_col: F.col("_kept"), "n_chars": F.length("_kept").cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    return done.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op10_lines(spark: SparkSession, folder: str) -> DataFrame:
    return without_repeats(table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.col("_runs").alias("n_runs"),
        F.sha2(F.coalesce("_kept", F.lit("")), 256).alias("kept_sha256"),
    )


OP10_SQL = r"""
with l as (
  select doc_id, line, no - 1 as no from (
    select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as no
    from documents where text is not null)),
r as (
  select *, row_number() over (partition by doc_id order by no) as p from l where regexp_matches(line, '[^ \t\r\f\x0B]')),
w as (
  select doc_id, p, no as a, lead(no, 2) over o as z, line || chr(10) || lead(line) over o || chr(10) || lead(line, 2) over o as t
  from r window o as (partition by doc_id order by p)),
later as (
  select doc_id, a, z from (
    select *, row_number() over (partition by t order by doc_id, p) as k from w where z is not null) where k > 1),
gone as (select distinct doc_id, unnest(range(a, z + 1)) as no from later),
runs as (
  select doc_id, count(*) as n_removed, count(*) filter (where before is null or before < no - 1) as n_runs
  from (select *, lag(no) over (partition by doc_id order by no) as before from gone) group by doc_id),
kept as (
  select l.doc_id, string_agg(l.line, chr(10) order by l.no) as text
  from l left join gone on l.doc_id = gone.doc_id and l.no = gone.no where gone.no is null group by l.doc_id)
select d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0) as n_lines, coalesce(n_removed, 0) as n_removed,
  coalesce(n_runs, 0) as n_runs, sha256(coalesce(kept.text, '')) as kept_sha256
from documents d left join runs using (doc_id) left join kept using (doc_id)
"""
