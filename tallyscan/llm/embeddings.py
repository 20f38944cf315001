"""Embedding near-duplicates by spherical-cap filters.

Filter directions are the words of a structured random product code: the space is turned by a
random rotation and cut into blocks, each block has a list of random unit vectors, and a direction
is one of them from every block. A vector is list-decoded to all directions whose inner product
with it exceeds a threshold, block by block with pruning, so the directions are never listed.
Vectors that share a direction meet, and their cosine is worked out in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscan.llm.common import BLOCK, by_group, components, roots, stored, table

COSINE = 0.95
FILTERS = 96.0
LOAD = 64
HEAVY_KEYS = 1 << 18
BLOCKS = 3
SEED = 5


@dataclass(frozen=True)
class ProductCode:
    """Code over ``dimensions`` with ``words`` unit vectors in each block; a vector exceeds ``filters`` directions on average."""

    dimensions: int
    words: int
    filters: float

    @staticmethod
    def sized(dimensions: int, rows: int, filters: float = FILTERS, load: int = LOAD) -> ProductCode:
        """So many directions that about ``load`` of ``rows`` vectors exceed each."""
        parts = min(BLOCKS, dimensions)
        words = max(4, int(np.ceil((rows * filters / load) ** (1 / parts))))
        return ProductCode(dimensions, words, filters)

    @property
    def parts(self) -> int:
        return min(BLOCKS, self.dimensions)

    def decoder(self) -> Decoder:
        return _decoder(self)


class Decoder:
    def __init__(self, code: ProductCode):
        self.code = code
        rng = np.random.default_rng([SEED, code.dimensions, code.words])
        self.rotation = np.linalg.qr(rng.standard_normal((code.dimensions, code.dimensions)))[0]
        self.cuts = np.array_split(np.arange(code.dimensions), code.parts)
        self.words = []
        for cut in self.cuts:
            block = rng.standard_normal((code.words, len(cut)))
            self.words.append(block / np.linalg.norm(block, axis=1, keepdims=True) / np.sqrt(code.parts))
        share = min(code.filters / code.words**code.parts, 0.5)
        self.least = NormalDist().inv_cdf(1 - share) / np.sqrt(code.dimensions)

    def decode(self, units: np.ndarray) -> list[np.ndarray]:
        """Numbers of all directions each unit vector exceeds, sorted; the nearest one if there is none."""
        turned = units @ self.rotation
        scores = [turned[:, cut] @ words.T for cut, words in zip(self.cuts, self.words)]
        return [self._list([s[i] for s in scores]) for i in range(len(units))]

    def _list(self, scores: list[np.ndarray]) -> np.ndarray:
        tops = [s.max() for s in scores]
        sums, numbers = np.zeros(1), np.zeros(1, np.int64)
        for part, score in enumerate(scores):
            rest = sum(tops[part + 1 :])
            # what the rest can't lift over the threshold goes before it is combined
            able = np.flatnonzero(score >= self.least - rest - sums.max())
            both = sums[:, None] + score[None, able]
            left, right = np.nonzero(both >= self.least - rest)
            sums, numbers = both[left, right], numbers[left] * self.code.words + able[right]
            if not len(sums):
                break
        if not len(numbers):
            nearest = 0
            for score in scores:
                nearest = nearest * self.code.words + int(np.argmax(score))
            return np.array([nearest], np.int64)
        return np.sort(numbers)


@lru_cache(maxsize=16)
def _decoder(code: ProductCode) -> Decoder:
    return Decoder(code)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    rows = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _keys(codes: dict[int, ProductCode]):
    """(key, n): how many vectors of a batch exceed each direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                units = _matrix(batch.filter(pa.array(sizes == size)).column("vec"))
                lists = [x for at in range(0, len(units), 1024) for x in codes[int(size)].decoder().decode(units[at : at + 1024])]
                key, n = np.unique(np.concatenate(lists), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key * 65536 + int(size)), pa.array(n, pa.int64())], ["key", "n"])

    return run


def _dealt(keyed: DataFrame, heavy: DataFrame, size: int) -> DataFrame:
    """``keyed`` with the blocks (see ``common.blocks``) of the few keys in ``heavy(key, n)``; all others are one block.

    Vectors travel once, after this, as keys were counted without them.
    """
    n = heavy.count()
    if not n:
        return keyed.select("*", *[F.lit(v).alias(c) for c, v in (("_b", 0), ("_of", 1), ("_i", 0), ("_j", 0))])
    few = heavy.select("key", F.ceil(F.col("n") / size).cast("int").alias("_of"))
    rows = keyed.join(F.broadcast(few) if n <= HEAVY_KEYS else few, "key", "left").withColumn("_of", F.coalesce("_of", F.lit(1)))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("u"), F.col("_of")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("_of") - 1), lambda o: (o != F.col("_b")) | (F.col("_of") == 1))
    rows = rows.withColumn("_o", F.explode(others))
    return rows.select(*keyed.columns, "_b", "_of", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"))


def _filters(codes: dict[int, ProductCode], number: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                for at in range(0, part.num_rows, 1024):
                    some = part.slice(at, 1024)
                    lists = codes[int(size)].decoder().decode(_matrix(some.column("vec")))
                    times = [len(x) for x in lists]
                    took = some.take(pa.array(np.repeat(np.arange(len(lists)), times)))
                    ends = pa.array(np.concatenate([[0], np.cumsum(times)]), pa.int32())
                    every = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(lists), number))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate(lists) * 65536 + int(size)), took.column("u"), took.column("copies"),
                            took.column("vec"), every.take(pa.array(np.repeat(np.arange(len(lists)), times))),
                        ],
                        ["key", "u", "copies", "vec", "filters"],
                    )

    return run


def _verify(cosine: float):
    """Links of each group, each counted where it is first found: at the least common filter, in one pair of blocks."""

    def run(rows: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        names, copies = rows.column("u"), rows.column("copies").to_numpy()
        key, block, of = (rows.column(c).to_numpy() for c in ("key", "_b", "_of"))
        first, second = rows.column("_i").to_numpy(), rows.column("_j").to_numpy()
        vectors = rows.column("vec").combine_chunks()
        filters = rows.column("filters").combine_chunks()
        offsets, values = filters.offsets.to_numpy(), filters.values.to_numpy()
        starts = np.concatenate([np.flatnonzero(np.diff(group, prepend=-1)), [len(group)]])
        links = np.zeros(len(group), np.int64)
        root = np.arange(len(group))
        for start, stop in zip(starts[:-1].tolist(), starts[1:].tolist()):
            unit = _matrix(vectors.slice(start, stop - start))
            a, b = np.nonzero(np.triu(unit @ unit.T >= cosine, 1))
            if not len(a):
                continue
            a, b = a + start, b + start
            _connect(root, a, b)
            # blocks i and i + 1 (in a ring) count the links inside block i
            inside = block[a] == block[b]
            next_block = (block[a] + 1) % of[a]
            here = ~inside | (first[a] == np.minimum(block[a], next_block)) & (second[a] == np.maximum(block[a], next_block))
            a, b = a[here], b[here]
            new = _first_met(a, b, key[start] // 65536, offsets, values)
            np.add.at(links, a[new], copies[b[new]])
            np.add.at(links, b[new], copies[a[new]])
        told = np.flatnonzero((links > 0) | (root != np.arange(len(group))))
        return pa.RecordBatch.from_arrays(
            [names.take(pa.array(told)).combine_chunks(), names.take(pa.array(root[told])).combine_chunks(), pa.array(links[told])],
            ["u", "root", "links"],
        )

    return run


def _first_met(a: np.ndarray, b: np.ndarray, number: int, offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which pairs share no filter with a number less than this one's."""
    rows, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    own = [values[offsets[r] : offsets[r + 1]] for r in rows.tolist()]
    own = [f[: np.searchsorted(f, number)] for f in own]
    which, column = np.unique(np.concatenate(own), return_inverse=True)
    member = np.zeros((len(rows), len(which)), np.float32)
    member[np.repeat(np.arange(len(rows)), [len(f) for f in own]), column] = 1
    member = member[:, member.sum(axis=0) > 1]
    shared = member @ member.T
    return shared[at[: len(a)], at[len(a) :]] == 0


def _connect(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    low, high = int(a.min()), int(b.max()) + 1
    root[low:high] = roots(high - low, a - low, b - low) + low


def link_embeddings(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = COSINE,
    filters: float = FILTERS,
    load: int = LOAD,
) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row.

    Equal vectors are compared once, with their number of copies. A null or zero vector, or one
    with null or non-finite components, links with nothing, as do vectors of different length. The
    least id reachable is the component; kept marks its row. A null id takes part but names no
    component, unless no row of it has an id. Rows that repeat an id are rows of their own.
    """
    # floats stay floats on their way; cosines are worked out in double precision
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(kind).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce(finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    name = F.concat(F.hex(F.xxhash64("vec")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "vec")))
    rows = rows.select("id", F.when(usable, name).alias("u"), "vec")
    distinct = stored(
        rows.where("u is not null").groupBy("u").agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("copies"))
        .withColumn("size", F.size("vec")),
        "embeddings-distinct",
    )
    # one row for each length of vector there is
    counts = {r.size: r.n for r in distinct.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    codes = {size: ProductCode.sized(size, n, filters, load) for size, n in counts.items()}
    small = all(code.words**code.parts < 2**31 for code in codes.values())
    number, named = (pa.int32(), "int") if small else (pa.int64(), "bigint")
    keyed = distinct.mapInArrow(_filters(codes, number), f"key bigint, u string, copies bigint, vec {kind}, filters array<{named}>")
    counted = distinct.select("size", "vec").mapInArrow(_keys(codes), "key bigint, n bigint")
    heavy = stored(counted.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK), "embeddings-heavy")
    dealt = _dealt(keyed, heavy, BLOCK)
    found = stored(by_group(dealt, ["key", "_i", "_j"], _verify(cosine), "u string, root string, links bigint"), "embeddings-links")
    links = found.groupBy("u").agg(F.sum("links").alias("others"))
    component = components(found.select(F.col("u").alias("a"), F.col("root").alias("b")), name="embeddings-components")
    per_vector = (
        distinct.select("u", "copies").join(links, "u", "left").join(component.select(F.col("node").alias("u"), "root"), "u", "left")
        .select("u", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "u").alias("root"))
    )
    named = rows.select("id", "u").join(per_vector, "u", "left")
    least = named.where("root is not null").groupBy("root").agg(F.min("id").alias("component_id"))
    out = named.join(least, "root", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def op5_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return link_embeddings(table(spark, folder, "embeddings"))
