"""What several operators share: scratch tables, hot-group blocks, local links and connected components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyscan.session import scratch_root

BLOCK = 1024


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's code to the executors, once per application: their Python must import it."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).parents[1]
        target = Path(tempfile.mkdtemp(prefix="tallyscan-code-")) / f"{package.name}.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for file in sorted(package.rglob("*.py")):
                archive.write(file, file.relative_to(package.parent))
        context.addPyFile(str(target))
        _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; every registered query starts here."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: worked out once, and not again when an executor is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(name: str, columns: Sequence[str]) -> str:
    """``name``, with underscores in front until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def blocks(
    rows: DataFrame, key: str, spread: Column, size: int = BLOCK, leads: str | None = None, apart: bool = False
) -> DataFrame:
    """Rows of keys that more than one row has, dealt to pairs of blocks ``(key, _i, _j)``.

    ``_b`` is the block of the row and ``_of`` the number of blocks of its key.

    A group of up to ``size`` rows is one block. A larger one is split by ``spread`` and every
    pair of its blocks becomes a task of its own, so any two rows of a key meet somewhere and no
    task holds more than about two blocks. Nothing is left out at any group size. With ``leads`` (a
    flag) only pairs with a leading row matter: rows that have no such partner are left out.
    With ``apart`` groups of one block don't pass the step that deals large ones; it suits short
    rows, as the counting is done for both kinds.
    """
    all_of_key = Window.partitionBy(key)
    counted = rows.withColumn("_n", F.count(F.lit(1)).over(all_of_key))
    if leads:
        others = F.sum(F.col(leads).cast("int")).over(all_of_key) - F.col(leads).cast("int")
        counted = counted.withColumn("_leaders", others).where(f"_n > 1 and ({leads} or _leaders > 0)")
    else:
        counted = counted.where("_n > 1")
    if apart:
        zero = F.lit(0)
        few = counted.where(F.col("_n") <= size).select(
            *rows.columns, zero.alias("_b"), F.lit(1).alias("_of"), zero.alias("_i"), zero.alias("_j")
        )
        counted = counted.where(F.col("_n") > size)
    parts = F.ceil(F.col("_n") / F.lit(size)).cast("int")
    dealt = counted.withColumn("_of", parts).withColumn("_b", F.pmod(spread, F.col("_of")).cast("int"))
    others = F.filter(
        F.sequence(F.lit(0), F.col("_of") - 1), lambda o: (o != F.col("_b")) | (F.col("_of") == 1)
    )
    dealt = dealt.withColumn("_o", F.explode(others))
    dealt = dealt.select(
        *rows.columns, "_b", "_of", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j")
    )
    return few.union(dealt) if apart else dealt


def by_group(
    rows: DataFrame, keys: Sequence[str], work: Callable[[pa.Table, np.ndarray], pa.RecordBatch], schema: str
) -> DataFrame:
    """``work(rows, group number)`` over whole groups of ``keys``, many small groups at a time.

    Rows are sorted by key within partitions; the last group of an Arrow batch waits for the next
    one. Groups must be bounded (see ``blocks``).
    """
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            rest = now if rest is None else pa.concat_tables([rest, now])
            change = _changes(rest, keys)
            if not change.any():
                continue
            cut = int(np.flatnonzero(change)[-1]) + 1
            ready, rest = rest.slice(0, cut), rest.slice(cut)
            yield work(ready.combine_chunks(), np.concatenate([[0], np.cumsum(change[: cut - 1])]))
        if rest is not None:
            change = _changes(rest, keys)
            yield work(rest.combine_chunks(), np.concatenate([[0], np.cumsum(change)]))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def by_size(batches: Iterator[pa.RecordBatch], column: int | str, size: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``size`` bytes in a column, a row at least: bounds what a task holds."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
        start = 0
        while start < batch.num_rows:
            stop = max(int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, side="right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def _changes(rows: pa.Table, keys: Sequence[str]) -> np.ndarray:
    change = np.zeros(max(rows.num_rows - 1, 0), bool)
    for key in keys:
        values = rows.column(key).to_numpy()
        change |= values[1:] != values[:-1]
    return change


def pairs_in_groups(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of one group, rows sorted by group, one distance at a time."""
    at = np.arange(len(group))
    step = 1
    while True:
        at = at[at + step < len(group)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            return
        yield at, at + step
        step += 1


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the given links, for each of ``n`` rows."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame, left: str = "a", right: str = "b", name: str = "components") -> DataFrame:
    """(node, root): the smallest node reachable, for every node with a link to another one.

    Alternating large-star and small-star steps over plain aggregations and joins. A node with
    very many links is no hot group: its minimum is combined before the shuffle, and the join of
    links with minima can be split by the skew handling of joins. Every round is a stored table.
    """
    spark = edges.sparkSession
    now = stored(
        edges.where(F.col(left) != F.col(right))
        .select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .distinct(),
        name,
    )
    mark = _mark(now)
    if mark[0] == 0:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: every node points to smaller ones only
        large = large.union(now.join(low, "u").where("u != m").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v"))
        )
        now = stored(small.where("u != v").distinct(), name)
        new = _mark(now)
        if new == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = new


def _mark(links: DataFrame) -> tuple:
    return tuple(
        links.agg(
            F.count(F.lit(1)),
            F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).cast("string"),
            F.coalesce(F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")), F.lit(0)).cast("string"),
        ).first()
    )
