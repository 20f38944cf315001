"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Vectors are turned into integers, ordered along a Hilbert curve through all their dimensions and
written as Parquet blocks: a row holds up to 1,024 neighbours on the curve and, beside them, the
least and greatest value in every dimension (and of the label). An anchor asks for the best rows within
windows of scores. Interval arithmetic on the minima and maxima bounds the score of any row of a block,
so only blocks whose bounds meet a window are read; what its own block holds raises the lower end first.
Parts of the curve have such maps too, so an anchor is held against parts, then blocks, then rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyscan.llm.common import scratch_path, stored, table

SCALE = 256
BITS = 4
BLOCK_BYTES = 1 << 20
MOST_PARTS = 1024
LEAST, MOST = -(2**62), 2**62

BLOCKS = ("no int, size int, rows int, low binary, high binary, label_low bigint, label_high bigint, "
          "ids binary, labels binary, vectors binary, part int")
ASKED = "anchor_id bigint, label bigint, size int, vec binary, lows array<bigint>, highs array<bigint>"


@dataclass(frozen=True)
class Layout:
    """Rows of a block, rows of a part of the curve, and anchors that are read for together. Decides cost, not results."""

    block_rows: int = 1024
    part_rows: int = 1 << 14
    chunk: int = 4096


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of each row of ``points`` (integers below ``2 ** bits``), as bytes in order."""
    x = points.astype(np.int64).T.copy()
    dimensions = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(dimensions):
            on = (x[i] >> bit) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, dimensions):
        x[i] ^= x[i - 1]
    turn = np.zeros(points.shape[0], np.int64)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= turn
    # most significant bits of all dimensions first
    planes = np.stack([(x >> bit) & 1 for bit in range(bits - 1, -1, -1)])
    return np.packbits(planes.reshape(-1, points.shape[0]).T.astype(np.uint8), axis=1)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), size)


def _exact(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact: doubles where they suffice, else 64-bit integers."""
    most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(left.shape[1], 1)
    if most < 2**52:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    if most >= MOST:
        raise OverflowError("scores of these vectors do not fit in 64 bits")
    return left @ right.T


def usable(rows: DataFrame, scale: int) -> DataFrame:
    """(id, label, size, vec, anchor) of the rows that take part, a row for each id."""
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    taken = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()).where(fine)
    whole = F.transform("vec", lambda x: F.floor(F.lit(float(scale)) * x))
    taken = taken.select("id", "label", F.size("vec").alias("size"), whole.alias("vec"), "anchor")
    again = stored(taken.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "negatives-again")
    if again.isEmpty():
        return taken
    least = taken.join(again, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "size", "vec", "anchor")).alias("r"))
    return taken.join(again, "id", "left_anti").union(least.select("id", "r.*"))


def _keyed(low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                some = batch.filter(pa.array(sizes == size))
                values = _matrix(some.column("vec"), size)
                places = (values - low).astype(np.float64) * (1 << BITS) / (high - low + 1)
                keys = hilbert_keys(places.astype(np.int64)) if size else np.zeros((len(values), 1), np.uint8)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array([k.tobytes() for k in keys], pa.binary())], [*some.schema.names, "key"])

    return run


def _binary(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def _packed(block_rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one part in the order of the curve to blocks; last, for each size, the maps of the whole part as block -1."""
    part, no = TaskContext.get().partitionId(), 0
    whole: dict[int, list] = {}
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    types = {"binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in BLOCKS.split(", ")])

    def block(rows: pa.Table) -> pa.RecordBatch:
        nonlocal no
        size = rows.column("size")[0].as_py()
        ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        order = np.argsort(ids, kind="stable")  # of equal scores the first is that with the least id
        values = _matrix(rows.column("vec").combine_chunks(), size)[order]
        maps = [values.min(axis=0), values.max(axis=0), int(labels.min()), int(labels.max())]
        known = whole.get(size)
        whole[size] = maps if known is None else [
            np.minimum(known[0], maps[0]), np.maximum(known[1], maps[1]), min(known[2], maps[2]), max(known[3], maps[3])]
        row = [no, size, len(ids), _binary(maps[0]), _binary(maps[1]), maps[2], maps[3],
               _binary(ids[order]), _binary(labels[order]), _binary(values), part]
        no += 1
        return pa.RecordBatch.from_pylist([dict(zip(names, row))], schema)

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        rest = now if rest is None else pa.concat_tables([rest, now])
        sizes = rest.column("size").to_numpy()
        at = 0
        while at < len(sizes):
            most = max(1, min(block_rows, BLOCK_BYTES // (8 * max(int(sizes[at]), 1))))
            same = int(np.searchsorted(sizes, sizes[at], side="right"))
            stop = min(at + most, same)
            if stop == len(sizes) and stop - at < most:
                break
            yield block(rest.slice(at, stop - at))
            at = stop
        rest = rest.slice(at)
    if rest is not None and rest.num_rows:
        yield block(rest)
    for size, (low, high, label_low, label_high) in whole.items():
        row = [-1, size, 0, _binary(low), _binary(high), label_low, label_high, b"", b"", b"", part]
        yield pa.RecordBatch.from_pylist([dict(zip(names, row))], schema)


@dataclass(frozen=True)
class Index:
    """Blocks and zone maps of a set of vectors, and the anchors among them."""

    path: str
    blocks: DataFrame
    anchors: DataFrame
    chunks: int


def build(rows: DataFrame, scale: int = SCALE, layout: Layout = Layout()) -> Index:
    """Writes the blocks of ``rows(id bigint, label bigint, vec array<double>, anchor boolean)``."""
    spark = rows.sparkSession
    fine = stored(usable(rows, scale), "negatives-rows")
    n, low, high, asked = fine.agg(
        F.count(F.lit(1)), F.min(F.array_min("vec")), F.max(F.array_max("vec")), F.sum(F.col("anchor").cast("int"))
    ).first()
    low, high = low or 0, high or 0
    if max(-low, high) >= 2**31:
        raise OverflowError(f"components times {scale} must be below 2 ** 31")
    schema = "id bigint, label bigint, size int, vec array<bigint>, anchor boolean, key binary"
    keyed = stored(fine.mapInArrow(_keyed(low, high), schema), "negatives-keyed")
    parts = max(1, min(MOST_PARTS, -(-n // layout.part_rows)))
    # the id parts rows with equal keys, so copies of a vector are many parts if need be
    curve = keyed.repartitionByRange(parts, "size", "key", "id").sortWithinPartitions("size", "key", "id")
    path = scratch_path(spark, "negatives-blocks")
    curve.mapInArrow(partial(_packed, layout.block_rows), BLOCKS).write.partitionBy("part").parquet(path)
    blocks = spark.read.schema(BLOCKS).parquet(path)
    anchors = stored(keyed.where("anchor").select(F.col("id").alias("anchor_id"), "label", "size", "vec", "key"), "negatives-anchors")
    return Index(path, blocks, anchors, max(1, -(-(asked or 0) // layout.chunk)))


def _bounds(vectors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product that each vector can have with a point in each box."""
    up, down = np.maximum(vectors, 0), np.minimum(vectors, 0)
    return _exact(up, low) + _exact(down, high), _exact(up, high) + _exact(down, low)


def _meets(vectors, label, lows, highs, box_low, box_high, box_labels, same: bool) -> np.ndarray:
    """Whether each box (column) may hold a row that one of the windows of a vector (row) asks for."""
    least, most = _bounds(vectors, box_low, box_high)
    hit = np.zeros(least.shape, bool)
    for w in range(lows.shape[1]):
        hit |= (most >= lows[:, w, None]) & (least <= highs[:, w, None]) & (lows[:, w, None] <= highs[:, w, None])
    first, last = box_labels
    label = label[:, None]
    return hit & ((first <= label) & (label <= last) if same else (first != last) | (first != label))


def _windows(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the windows as two arrays, rows padded with windows that hold nothing."""
    out = []
    for name, fill in (("lows", MOST), ("highs", LEAST)):
        lists = batch.column(name).to_pylist()
        width = max(map(len, lists), default=0)
        out.append(np.array([[*x, *[fill] * (width - len(x))] for x in lists], np.int64).reshape(len(lists), width))
    return out[0], out[1]


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), size)


def _by_size(batch: pa.RecordBatch, step: int = 256) -> Iterator[pa.RecordBatch]:
    sizes = batch.column("size").to_numpy()
    for size in np.unique(sizes):
        some = batch.filter(pa.array(sizes == size))
        for at in range(0, some.num_rows, step):
            yield some.slice(at, step)


def _parts_to_read(maps: dict[int, tuple], same: bool):
    """Query rows, once for each part of the curve that their windows can meet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _by_size(batch):
                size = some.column("size")[0].as_py()
                if size not in maps:
                    continue
                part, low, high, labels = maps[size]
                hit = _meets(_vectors(some.column("vec"), size), some.column("label").to_numpy(), *_windows(some), low, high, labels, same)
                row, box = np.nonzero(hit)
                yield pa.RecordBatch.from_arrays([*some.take(pa.array(row)).columns, pa.array(part[box], pa.int32())], [*some.schema.names, "part"])

    return run


def _with_boxes(group: list[str], work):
    """Streams rows sorted by ``group`` and kind: boxes (kind 0) first, then the queries that are held against them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, boxes, ready = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column("kind").to_numpy()
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in [*group, "size"]] + [kind.astype(np.int64)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for start, stop in zip(cuts, cuts[1:]):
                some, key = batch.slice(start, stop - start), tuple(keys[start, :-1])
                if key != now:
                    now, boxes, ready = key, [], None
                if kind[start] == 0:
                    boxes.append(some)
                elif boxes:
                    ready = ready or work.open(pa.Table.from_batches(boxes))
                    for at in range(0, some.num_rows, 256):
                        yield work(ready, some.slice(at, 256))

    return run


class _BlocksToRead:
    """Query rows, once for each block of the part that their windows can meet."""

    def __init__(self, same: bool):
        self.same = same

    def open(self, boxes: pa.Table) -> tuple:
        size = boxes.column("size")[0].as_py()
        arrays = [_vectors(boxes.column(c), size) for c in ("low", "high")]
        return boxes.column("no").to_numpy(), *arrays, [boxes.column(c).to_numpy()[None, :] for c in ("label_low", "label_high")]

    def __call__(self, ready: tuple, asked: pa.RecordBatch) -> pa.RecordBatch:
        no, low, high, labels = ready
        size = asked.column("size")[0].as_py()
        hit = _meets(_vectors(asked.column("vec"), size), asked.column("label").to_numpy(), *_windows(asked), low, high, labels, self.same)
        row, box = np.nonzero(hit)
        taken = asked.take(pa.array(row))
        names = ["anchor_id", "label", "size", "vec", "lows", "highs", "part"]
        return pa.RecordBatch.from_arrays([*[taken.column(c) for c in names], pa.array(no[box], pa.int32())], [*names, "no"])


class _Best:
    """(anchor_id, w, id, score): the ``k`` best rows of a block in each window of each query."""

    def __init__(self, k: int, same: bool):
        self.k, self.same = k, same

    def open(self, boxes: pa.Table) -> tuple:
        size, row = boxes.column("size")[0].as_py(), boxes.slice(0, 1).to_pylist()[0]
        ids, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        return ids, labels, np.frombuffer(row["vectors"], np.int64).reshape(len(ids), size)

    def __call__(self, ready: tuple, asked: pa.RecordBatch) -> pa.RecordBatch:
        ids, labels, values = ready
        size = asked.column("size")[0].as_py()
        anchors, own = asked.column("anchor_id").to_numpy(), asked.column("label").to_numpy()[:, None]
        scores = _exact(_vectors(asked.column("vec"), size), values)
        able = (labels == own) & (ids != anchors[:, None]) if self.same else labels != own
        lows, highs = _windows(asked)
        out: list[list[np.ndarray]] = [[], [], [], []]
        for w in range(lows.shape[1]):
            left = np.where(able & (scores >= lows[:, w, None]) & (scores <= highs[:, w, None]), scores, LEAST)
            for _ in range(min(self.k, len(ids))):
                at = left.argmax(axis=1)
                best = left[np.arange(len(at)), at]
                got = np.flatnonzero(best > LEAST)
                if not len(got):
                    break
                for column, x in zip(out, (anchors[got], np.full(len(got), w), ids[at[got]], best[got])):
                    column.append(x)
                left[got, at[got]] = LEAST
        columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor_id", "w", "id", "score"])


def _beside(boxes: DataFrame, asked: DataFrame, group: list[str], chunks: int) -> DataFrame:
    """Boxes and queries by ``group`` and chunk of anchors, boxes first; a box goes to the chunks that ask for it."""
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("anchor_id"), F.lit(chunks)).cast("int"))
    need = asked.select(*group, "size", "chunk").distinct()
    boxes = boxes.join(need, [*group, "size"]).withColumn("kind", F.lit(0))
    both = boxes.unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition(*group, "chunk").sortWithinPartitions(*group, "chunk", "size", "kind")


def _read(index: Index, asked: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor_id, w, id, score, rank) of the best ``k`` rows in the blocks that ``asked(..., part, no)`` names."""
    columns = ["part", "no", "size", "ids", "labels", "vectors"]
    both = _beside(index.blocks.where("no >= 0").select(*columns), asked, ["part", "no"], index.chunks)
    found = both.mapInArrow(_with_boxes(["part", "no", "chunk"], _Best(k, same)), "anchor_id bigint, w bigint, id bigint, score bigint")
    order = Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _chosen(index: Index, asked: DataFrame, same: bool) -> DataFrame:
    """``asked`` with (part, no) of every block whose bounds meet a window."""
    maps: dict[int, list] = {}
    # at most MOST_PARTS rows and one for each further length of vectors
    for row in index.blocks.where("no = -1").select("part", "size", "low", "high", "label_low", "label_high").collect():
        maps.setdefault(row["size"], []).append(row)
    packed = {}
    for size, rows in maps.items():
        low, high = (np.frombuffer(b"".join(bytes(r[c]) for r in rows), np.int64).reshape(len(rows), size) for c in ("low", "high"))
        labels = [np.array([r[c] for r in rows])[None, :] for c in ("label_low", "label_high")]
        packed[size] = (np.array([r["part"] for r in rows]), low, high, labels)
    by_part = asked.mapInArrow(_parts_to_read(packed, same), f"{ASKED}, part int")
    zones = index.blocks.where("no >= 0").select("part", "no", "size", "low", "high", "label_low", "label_high")
    both = _beside(zones, by_part, ["part"], index.chunks)
    return both.mapInArrow(_with_boxes(["part", "chunk"], _BlocksToRead(same)), f"{ASKED}, part int, no int")


def search(index: Index, asked: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor_id, w, id, score, rank): for each anchor and window the ``k`` rows of highest score, ties by id.

    ``asked`` has the columns of ``index.anchors``, with ``lows`` and ``highs`` of the windows in place of
    the key. With ``same`` the rows have the anchor's label and are not the anchor, else they have another label.
    """
    names = [c.split()[0] for c in ASKED.split(", ")]
    asked = asked.select(*names)
    seeds = stored(_read(index, asked.join(_own_blocks(index), "anchor_id"), k, same), "negatives-seeds")
    least = seeds.where(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("least"))
    raised = F.transform("lows", lambda x, w: F.greatest(x, F.coalesce(F.get(F.array(F.col("least")), F.lit(0))[w.cast("bigint")], x)))
    asked = asked.join(least, "anchor_id", "left").withColumn("lows", F.when(F.col("least").isNull(), F.col("lows")).otherwise(raised))
    return stored(_read(index, _chosen(index, stored(asked.select(*names), "negatives-asked"), same), k, same), "negatives-found")


def _own_blocks(index: Index) -> DataFrame:
    """(anchor_id, part, no) of the block each anchor lies in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(np.full(len(ids), row["part"]), pa.int32()), pa.array(np.full(len(ids), row["no"]), pa.int32())],
                    ["anchor_id", "part", "no"])

    placed = index.blocks.where("no >= 0").select("ids", "part", "no").mapInArrow(run, "anchor_id bigint, part int, no int")
    return placed.join(index.anchors.select("anchor_id"), "anchor_id", "left_semi")


def hard_negatives(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = SCALE, layout: Layout = Layout(),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A score is the inner product of two vectors of ``floor(scale * x)``. The positives of an anchor (a row
    for which ``anchor`` holds) are the ``positives`` other rows of its label with the highest scores; the
    negatives of a positive are the ``negatives`` rows of other labels with the highest scores between
    ``low`` and ``high`` percent of the positive's, both included. Ties go to the smaller id. All of them where there are fewer.

    Rows with a null id, label or vector, or a component that is null or not finite, take no part. Of rows that
    repeat an id that with the smallest label and vector does. Vectors of different length have no score and never
    meet; empty ones score 0. Other columns are not read. An empty table gives an empty one. A component of
    ``2 ** 31`` or more after scaling is an error. Ids and labels are whole numbers.
    """
    given = rows.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"),
        F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )
    index = build(given, scale, layout)
    binary = _as_binary(index.anchors.select("anchor_id", "label", "size", "vec"))
    every = binary.withColumns({"lows": F.array(F.lit(LEAST + 1)), "highs": F.array(F.lit(MOST - 1))})
    best = search(index, every, positives, True).select(
        "anchor_id", (F.col("rank") - 1).cast("bigint").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    # whole numbers n with low * p <= 100 * n <= high * p, for p = 100 * q + r
    r = F.pmod(F.col("positive_score"), F.lit(100))
    parts = best.select("anchor_id", "w", r.alias("r"), F.call_function("div", F.col("positive_score") - r, F.lit(100)).alias("q"))
    ends = parts.select(
        "anchor_id", "w", F.expr(f"{low} * q + ({low} * r + 99) div 100").alias("low"), F.expr(f"{high} * q + ({high} * r) div 100").alias("high"))
    windows = ends.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("w", "low", "high"))).alias("e"))
    asked = binary.join(windows.select("anchor_id", F.col("e.low").alias("lows"), F.col("e.high").alias("highs")), "anchor_id")
    found = search(index, asked, negatives, False)
    return best.join(found, ["anchor_id", "w"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def _as_binary(anchors: DataFrame) -> DataFrame:
    """The vectors of few rows as the bytes of 64-bit integers, as the blocks hold them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.array(v, np.int64).tobytes() for v in batch.column("vec").to_pylist()]
            columns = [batch.column(c) for c in ("anchor_id", "label", "size")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(vectors, pa.binary())], ["anchor_id", "label", "size", "vec"])

    return anchors.mapInArrow(run, "anchor_id bigint, label bigint, size int, vec binary")


def op13_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


OP13_SQL = r"""
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where label is not null and embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score
  from e a join e b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % 50 = 0),
p as (
  select * from (select *, row_number() over (partition by anchor_id order by score desc, id) as k from s where same) where k <= 5),
n as (
  select p.anchor_id, p.id as positive_id, p.score as positive_score, s.id as negative_id, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.id order by s.score desc, s.id) as rank
  from p join s on p.anchor_id = s.anchor_id and not s.same
  where 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 3
"""
