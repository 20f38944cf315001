"""SimHash near-duplicates by fuzzy hashing with the binary Golay code.

Two 64-bit fingerprints link at three or fewer differing bits. They are cut into four segments.
A segment, padded to 23 bits, is decoded to the codewords of the perfect Golay [23, 12, 7] code at
distance four or less (one to six of them): of two segments that differ in at most one bit, the
codeword nearest to the one is among those of the other. By the pigeonhole principle either two
segments are equal, or one is equal and the others differ in one bit each. So keys are two equal
segments, or one equal segment with a codeword of the next. Rows that share a key which is a
nearest one for either of them are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscan.llm.common import BLOCK, blocks, by_group, components, pairs_in_groups, roots, stored, table, unused

# Generator of the Golay code (x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1), widths of the segments.
GENERATOR = 0b110001110101
SEGMENTS = (16, 16, 16, 16)
SHINGLE = 3
SEED = 42
DISTANCE = 3


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << bit - 11
    return word


class Golay:
    """Nearest codewords of 23-bit words, as 12-bit indices."""

    def __init__(self):
        self.high = np.array([_remainder(m << 11) for m in range(4096)], np.int64)
        self.error = np.zeros(2048, np.int64)
        ones = [1 << i for i in range(23)]
        for i, a in enumerate(ones):
            self.error[_remainder(a)] = a
            for j, b in enumerate(ones[:i]):
                self.error[_remainder(a | b)] = a | b
                for c in ones[:j]:
                    self.error[_remainder(a | b | c)] = a | b | c

    def decode(self, words: np.ndarray) -> np.ndarray:
        """Index of the one codeword within distance three."""
        syndrome = self.high[words >> 11] ^ (words & 0x7FF)
        return (words ^ self.error[syndrome]) >> 11

    def near(self, words: np.ndarray, width: int) -> np.ndarray:
        """Codewords of a word and of all words one bit (of ``width``) away: a row of indices each, -1 where repeated."""
        flips = np.array([0] + [1 << i for i in range(width)], np.int64)
        found = np.sort(self.decode(words[:, None] ^ flips[None, :]), axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        return -np.sort(-found, axis=1)[:, :6]


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all word shingles, as an unsigned number."""
    words = (text or b"").lower().split()
    n = max(len(words) - shingle + 1, 1 if words else 0)
    if not n:
        return 0
    xxh64 = xxhash.xxh64_intdigest
    shingles = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    hashes = np.fromiter((xxh64(s, SEED) for s in map(b" ".join, shingles)), "<u8", n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): fingerprint of every row's whole text as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def _keys(prints: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, key, and whether the key can lead: every link has a leading side."""
    words, near, own, shift = [], [], [], 0
    for width in SEGMENTS:
        words.append((prints >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64))
        near.append(golay.near(words[-1], width))
        own.append(golay.decode(words[-1]))
        shift += width
    at, keys, leads = [], [], []

    def add(key: np.ndarray, used: np.ndarray, lead: np.ndarray) -> None:
        at.append(np.nonzero(used)[0])
        keys.append(key[used])
        leads.append(np.broadcast_to(lead, used.shape)[used])

    kind = 0
    for i, j in combinations(range(len(SEGMENTS)), 2):
        add((kind << 36 | words[i] << 16 | words[j])[:, None], np.ones((len(prints), 1), bool), np.array(True))
        kind += 1
    for i in range(len(SEGMENTS)):
        j = (i + 1) % len(SEGMENTS)
        add(kind << 36 | words[i][:, None] << 12 | near[j], near[j] >= 0, near[j] == own[j][:, None])
        kind += 1
    return np.concatenate(at), np.concatenate(keys), np.concatenate(leads)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    golay = Golay()
    for batch in batches:
        prints = batch.column(0).to_numpy()
        for at in range(0, len(prints), 4096):
            part = prints[at : at + 4096]
            rows, keys, leads = _keys(part.view(np.uint64), golay)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows]), pa.array(leads)], ["key", "fp", "leads"])


def _links(rows: pa.Table, group: np.ndarray) -> pa.RecordBatch:
    prints = rows.column("fp").to_numpy()
    bits = prints.view(np.uint64)
    left, right = [np.empty(0, int)], [np.empty(0, int)]
    for a, b in pairs_in_groups(group):
        near = np.bitwise_count(bits[a] ^ bits[b]) <= DISTANCE
        left.append(a[near])
        right.append(b[near])
    root = roots(len(prints), np.concatenate(left), np.concatenate(right))
    moved = np.flatnonzero(root != np.arange(len(prints)))
    return pa.RecordBatch.from_arrays([pa.array(prints[moved]), pa.array(prints[root[moved]])], ["a", "b"])


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough of them to connect all that are linked.

    Within a block of rows that share a key every pair is compared, but only a spanning set of
    the links leaves the task, so the output grows with the rows, not with their pairs.
    """
    keyed = prints.select("fp").distinct().mapInArrow(_expand, "key bigint, fp bigint, leads boolean")
    dealt = blocks(keyed, "key", F.xxhash64("fp"), BLOCK, "leads", apart=True)
    return by_group(dealt.select("key", "_i", "_j", "fp"), ["key", "_i", "_j"], _links, "a bigint, b bigint")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row.

    component_id is the smallest id reachable over links of three or fewer differing bits, the
    row's own included. Null and empty texts have fingerprint zero and link like any other. Rows
    that repeat an id are rows of their own. A null id takes part but names no component: the
    component_id of rows none of which has an id is null. Other columns are not read.
    """
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "simhash-prints")
    found = components(links(prints), name="simhash-components")
    rooted = (
        prints.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left")
        .select("id", "fp", F.coalesce("root", "fp").alias("root"))
    )
    first = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return rooted.join(first, "root").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group (see ``simhash_groups``), all columns kept.

    Rows that share an id stay or go together, except that of exact repeats (id and text) one
    stays. Rows without an id stay, as nothing tells them apart.
    """
    groups = simhash_groups(docs, id_col, text_col, shingle)
    kept = groups.where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    digest = unused("_digest", docs.columns)
    rows = docs.where(F.col(id_col).isNotNull()).join(kept, id_col, "left_semi").select(docs.columns)
    rows = rows.withColumn(digest, F.md5(text_col)).dropDuplicates([id_col, digest]).drop(digest)
    return rows.union(docs.where(F.col(id_col).isNull()))


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_groups(table(spark, folder, "documents"))
