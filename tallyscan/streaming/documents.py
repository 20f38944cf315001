"""Extraction on every level while texts, words, cells and answers arrive in any order.

One query reads all kinds of parts. A document is closed when it is complete (its row says how many parts belong
to it) or when event time has gone on for ``wait`` since its last part. Closed documents go through the same job as in batch.

A micro-batch writes its parts once, as they come, and beside them one thin row for each document that is open: how
many parts have come and from when on. Repeats count there too, so these rows only tell which documents may be closed; the parts of
those are read and counted without repeats. Parts of open documents are written again only when more than half of
all that is kept belongs to documents that are closed, so the state stays within about twice what is unfinished, in Parquet below ``root``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyscan.plans.extract import Options, extract_documents
from tallyscan.streaming.state import BUCKETS, StateTable, batch_folder, exists, forget
from tallyscan.streaming.stream import COMPACT_EVERY, run_batches

DOC = "doc"
KINDS = {
    DOC: "kind string, text string, parts bigint",
    "word": "page int, word_idx int, text string, top double",
    "cell": "page int, table_idx int, row_idx int, cells array<string>",
    "answer": "provider_rank int, raw_response string",
    "entity": "entity_idx int, type string, content string",
}
#: Parts of a document are counted in so many groups, so that one with very many is no single task's.
COUNT_GROUPS = 4
FOR_EVER = 2**62


def _parts(streams: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, event_time, what, doc, word, cell, answer, entity): one of the last five is there."""
    def part(kind: str, rows: DataFrame) -> DataFrame:
        schemas = {k: StructType.fromDDL(d) for k, d in KINDS.items()}
        columns = [
            (F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in s.fields]) if k == kind else F.lit(None).cast(s)).alias(k)
            for k, s in schemas.items()
        ]
        return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "event_time", F.lit(kind).alias("what"), *columns)

    return reduce(DataFrame.unionByName, [part(k, rows) for k, rows in streams.items()])


def _of_kind(parts: DataFrame, kind: str) -> DataFrame:
    return parts.where(F.col("what") == kind).select("doc_id", f"{kind}.*")


def _arrivals(parts: DataFrame) -> DataFrame:
    """(doc_id, wanted, own, came, low, high, since) of parts: how many came, repeats included, and between which times."""
    own = F.col("what") == DOC
    return parts.groupBy("doc_id").agg(
        F.max("doc.parts").alias("wanted"), F.count_if(own).alias("own"), F.count_if(~own).alias("came"),
        F.min("event_time").alias("low"), F.max("event_time").alias("high"), F.min("came_in").alias("since"),
    )


def _repeated(parts: DataFrame, columns: list[str]) -> DataFrame:
    """Each part once, with its first time; grouping by all of it keeps a document with very many parts apart."""
    return parts.groupBy(*columns).agg(F.min("event_time").alias("event_time"))


def _counted(parts: DataFrame, columns: list[str]) -> DataFrame:
    """(doc_id, rows, own, different, last): parts without repeats if ``different`` and ``own`` make up ``rows``.

    Parts are told apart by a hash. It never takes equal parts for different ones, so a document with as many hashes
    as rows has no repeats; any other has to be counted by its parts themselves.
    """
    hashed = parts.select("doc_id", "event_time", (F.col("what") == DOC).alias("own"), F.xxhash64(*columns[1:]).alias("hash"))
    dealt = hashed.withColumn("group", F.pmod("hash", F.lit(COUNT_GROUPS))).repartition("doc_id", "group")
    one = dealt.groupBy("doc_id", "group", "hash", "own").agg(F.count(F.lit(1)).alias("n"), F.min("event_time").alias("event_time"))
    return one.groupBy("doc_id").agg(F.sum("n").alias("rows"), *_without_repeats())


def _without_repeats() -> list[Column]:
    return [F.count_if("own").alias("own"), F.count_if(~F.col("own")).alias("different"), F.max("event_time").alias("last")]


def closed_documents(counted: DataFrame, late: str | None) -> DataFrame:
    """Adds known, complete and closed: documents that are complete, or whose last part is older than ``late`` (a timestamp as text).

    ``known`` says that the document's own row has come.
    """
    known = F.col("own") > 0
    complete = F.coalesce(known & (F.col("different") >= F.col("wanted")), F.lit(False))
    over = F.lit(False) if late is None else F.coalesce(F.col("last") < F.lit(late).cast("timestamp"), F.lit(False))
    return counted.withColumns({"known": known, "complete": complete, "closed": complete | over})


def _opened(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    """The thin rows of documents that wait after a batch; what was counted without repeats takes the place of what came."""
    rows = spark.read.parquet(batch_folder(root, "parts", batch_id)).alias("r")
    counted = spark.read.parquet(batch_folder(root, "closed", batch_id)).alias("c")
    seen = F.col("c.doc_id").isNotNull()
    joined = rows.join(counted, F.col("r.doc_id") == F.col("c.doc_id"), "left").where("c.closed is null or not c.closed")
    return joined.select(
        "r.doc_id", "r.wanted", "r.own", F.when(seen, F.col("c.different")).otherwise(F.col("r.came")).alias("came"),
        F.when(seen, F.col("c.last")).otherwise(F.col("r.low")).alias("low"), "r.since",
    )


def stream_documents(
    docs: DataFrame, root: str, words: DataFrame | None = None, table_rows: DataFrame | None = None,
    model_responses: DataFrame | None = None, entities: DataFrame | None = None, options: Options = Options(),
    wait: str = "1 hour", buckets: int = BUCKETS, compact_every: int = COMPACT_EVERY,
) -> DataFrame:
    """The result of ``extract_documents`` for every document that has been closed so far.

    All inputs are streams with the columns of the batch job and ``event_time``; ``docs`` also has ``parts``, the number
    of different words, table rows, answers and entities that belong to the document (null: not known, it then waits).
    Parts may come in any order, in any batch and repeatedly. The first result of a document stands: parts that
    come after it was closed are dropped, and so are, after ``wait``, parts whose document row never comes. Event time goes on with
    all that comes for documents without a result, repeats included; a part itself counts from the first time it has.
    """
    spark = docs.sparkSession
    given = {DOC: docs, "word": words, "cell": table_rows, "answer": model_responses, "entity": entities}
    streams = {k: rows for k, rows in given.items() if rows is not None}
    parts = _parts(streams)
    columns = ["doc_id", "what", *KINDS]

    def extracted(rows: DataFrame) -> DataFrame:
        kind = lambda k: _of_kind(rows, k) if k in streams else None
        one = _of_kind(rows, DOC).groupBy("doc_id").agg(F.min(F.struct("text", "kind")).alias("d"))
        return extract_documents(one.select("doc_id", "d.*"), kind("word"), kind("cell"), kind("answer"), kind("entity"), options)

    empty = spark.createDataFrame([], parts.schema)
    table = StateTable(spark, f"{root}/table", extracted(empty).schema, "doc_id", buckets)
    kept_schema = parts.withColumn("came_in", F.lit(0).cast("bigint")).schema

    def at(name: str, batch_id: int) -> str:
        return batch_folder(root, name, batch_id)

    def stored(rows: DataFrame, name: str, batch_id: int) -> DataFrame:
        """Rows that are read more than once, or after this batch."""
        rows.write.mode("overwrite").parquet(at(name, batch_id))
        return spark.read.schema(rows.schema).parquet(at(name, batch_id))

    def kept(base: int, until: int, carried: bool = True) -> DataFrame:
        """All parts that are kept: those carried over when batch ``base`` began, and what came from then on."""
        reader = spark.read.schema(kept_schema)
        came = reader.option("basePath", f"{root}/arrived").parquet(*[at("arrived", k) for k in range(base, until + 1)]).select(*kept_schema.names)
        if not base or not carried:
            return came
        return came.unionByName(spark.read.schema(kept_schema).parquet(at("carried", base)).select(*kept_schema.names))

    def parts_of(all_parts: DataFrame, thin: DataFrame, gone: DataFrame, name: str, batch_id: int) -> DataFrame:
        """The parts of the documents of ``thin`` that are ``asked``.

        ``thin`` and ``gone`` name all documents with parts. Where fewer are not asked, those are taken away instead: parts meet the shorter list.
        """
        asked = thin.where("asked").select("doc_id", F.col("since").alias("limit"))
        others = thin.where("not asked").select("doc_id", F.lit(FOR_EVER).alias("limit")).unionByName(gone.select("doc_id", F.col("until").alias("limit")))
        fewer = asked.count() <= others.count()
        ids = stored(asked if fewer else others, name, batch_id).alias("i")
        p, same = all_parts.alias("p"), F.col("p.doc_id") == F.col("i.doc_id")
        if fewer:
            return p.join(ids, same & (F.col("p.came_in") >= F.col("i.limit")), "left_semi")
        return p.join(ids, same & (F.col("p.came_in") <= F.col("i.limit")), "left_anti")

    def store(batch: DataFrame, batch_id: int) -> None:
        if compact_every and batch_id and batch_id % compact_every == 0:
            table.compact(batch_id)
        high, base, older, amount, opened, done = None, 0, 0, 0, None, range(0)
        gone_schema = "doc_id bigint, until bigint"
        gone = spark.createDataFrame([], gone_schema)
        if batch_id and exists(spark, at("clock", batch_id - 1)):
            last = spark.read.parquet(at("clock", batch_id - 1)).first()
            high, base, older, amount = last["high"], last["base"], last["older"], last["amount"]
            done = range(older, base) if base == batch_id - 1 else done
            opened = _opened(spark, root, batch_id - 1)
            waiting = opened.agg(F.coalesce(F.sum(F.col("own") + F.col("came")), F.lit(0)).alias("n")).first()["n"]
            gone = spark.read.parquet(*[at("closed", k) for k in range(base, batch_id)]).where("closed").select("doc_id", "until")
            if amount > 2 * waiting:
                held = parts_of(kept(base, batch_id - 1), opened.withColumn("asked", F.lit(True)), gone, "ids", batch_id)
                held.write.partitionBy("what").mode("overwrite").parquet(at("carried", batch_id))
                older, base, amount, gone = base, batch_id, waiting, spark.createDataFrame([], gone_schema)
        arrived = batch.where("doc_id is not null").withColumn("came_in", F.lit(batch_id).cast("bigint"))
        # a writer for each kind, so that rows need no sort; kinds lie apart, so that each is read by tasks of its own
        batch.sparkSession.conf.set("spark.sql.maxConcurrentOutputFileWriters", str(len(KINDS)))
        arrived.write.partitionBy("what").mode("overwrite").parquet(at("arrived", batch_id))
        came = stored(_arrivals(kept(batch_id, batch_id, carried=False)), "came", batch_id)
        # parts of documents that have a result come too late, or again
        known = table.of(came, batch_id).select("doc_id")
        late = came.join(known, "doc_id", "left_semi")
        fresh = came.join(known, "doc_id", "left_anti")
        rows = fresh.drop("high") if opened is None else opened.unionByName(fresh.drop("high"))
        merged = rows.groupBy("doc_id").agg(*[f(c).alias(c) for c, f in
            (("wanted", F.max), ("own", F.sum), ("came", F.sum), ("low", F.min), ("since", F.min))])
        now = stored(merged, "parts", batch_id)
        high, until = fresh.agg(F.greatest(F.max("high"), F.lit(high).cast("timestamp")).alias("high")).select(
            F.col("high").cast("string"), (F.col("high") - F.expr(f"interval {wait}")).cast("string")
        ).first()
        amount += came.agg(F.coalesce(F.sum(F.col("own") + F.col("came")), F.lit(0)).alias("n")).first()["n"]
        gone = gone.unionByName(late.select("doc_id", F.lit(batch_id).cast("bigint").alias("until")))
        everything = kept(base, batch_id)

        may = (F.col("own") > 0) & (F.col("came") >= F.col("wanted"))
        if until is not None:
            may = F.coalesce(may, F.lit(False)) | (F.col("low") < F.lit(until).cast("timestamp"))
        asked = now.withColumn("asked", F.coalesce(may, F.lit(False)))
        counted = spark.createDataFrame([], "doc_id bigint, rows bigint, own bigint, different bigint, last timestamp")
        if not asked.where("asked").isEmpty():
            those = parts_of(everything, asked, gone, "ids", batch_id)
            counted = stored(_counted(those, columns), "counted", batch_id)
            more = counted.where("rows > own + different").select("doc_id")
            if not more.isEmpty():
                exact = _repeated(those.join(more, "doc_id", "left_semi"), columns).withColumn("own", F.col("what") == DOC)
                exact = exact.groupBy("doc_id").agg(F.lit(None).cast("bigint").alias("rows"), *_without_repeats())
                counted = counted.join(more, "doc_id", "left_anti").unionByName(exact)
        over = closed_documents(counted.join(now.select("doc_id", "wanted"), "doc_id"), until).withColumns(
            {"repeats": F.col("rows").isNull(), "until": F.lit(batch_id).cast("bigint")}).drop("rows", "wanted", "own")
        came_late = late.select("doc_id", F.lit(True).alias("closed"), F.lit(batch_id).cast("bigint").alias("until"))
        over = stored(over.unionByName(came_late, allowMissingColumns=True), "closed", batch_id)
        closing = over.where("closed and known")
        if not closing.isEmpty():
            thin = now.join(closing.select("doc_id", F.lit(True).alias("asked")), "doc_id", "left").fillna(False, ["asked"])
            rows = parts_of(everything, thin, gone, "taken", batch_id)
            repeats = closing.where("repeats").select("doc_id")
            if not repeats.isEmpty():
                again = _repeated(rows.join(repeats, "doc_id", "left_semi"), columns)
                rows = rows.join(repeats, "doc_id", "left_anti").select(*columns).unionByName(again.select(*columns))
            table.write(extracted(rows), batch_id)
        # last, so that a batch that did not end runs again from the one before
        clock = spark.createDataFrame([(high, base, older, amount)], "high string, base long, older long, amount long").coalesce(1)
        clock.write.mode("overwrite").parquet(at("clock", batch_id))
        for name in ("parts", "clock", "came", "ids", "counted", "taken"):
            forget(spark, at(name, batch_id - 2))
        # what was carried over when the batch before began is in there; that batch will not run again
        for k in done:
            for name in ("arrived", "closed", "carried"):
                forget(spark, at(name, k))

    run_batches(parts, root, store)
    return table.current()


def open_documents(spark, root: str, batch_id: int) -> DataFrame:
    """(doc_id, wanted, own, came, ...) of the documents that wait after a batch."""
    return _opened(spark, root, batch_id)
