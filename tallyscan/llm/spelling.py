"""Groups of spelling variants, with Bloom filters that say which edits are worth a join.

Two words are near if one inserted, deleted or replaced letter turns one into the other. The vocabulary goes
into blocked Bloom filters, one for each word length, whose bytes together have a fixed bound; they are
broadcast. Each word's deletions are probed in the filter of the next shorter length and its replacements in
that of its own (an insertion is a deletion of the other word). Hashes are polynomials of the letters, so
that of an edit follows from that of the word without building it. Only positives are built, shuffled
and joined with the vocabulary, which removes the false ones.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscan.llm.common import by_group, stored, table

LETTERS = 6
OCCURRENCES = 5
TYPO = 199
LARGER = 5
FILTER_BYTES = 64 << 20
BITS_A_WORD = 16
LAST_SHARD = 64
SEGMENT = 1024
WORDS_A_TASK = 4096
HELD = 300_000
BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: One odd factor for each of the eight bits that a word sets in its block.
FACTORS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint32)


def _counted(letters: int, typo: int | None):
    run = re.compile("[a-zÀ-ÿ]{%d,}" % letters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])
            words.clear()
            return out

        for batch in batches:
            texts = pc.cast(batch.column("text"), pa.binary())
            for key, text in zip(batch.column("id"), texts):
                data = text.as_py()
                if data is None:
                    continue
                # bytes.lower() lowers A-Z alone
                start = zlib.crc32(f"{'' if (k := key.as_py()) is None else k}:".encode())
                for word, n in Counter(run.findall(data.lower().decode(errors="replace"))).items():
                    if typo and (h := zlib.crc32(word.encode(), start)) % typo == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < letters:
                            continue
                    words[word] += n
                if len(words) > HELD:
                    yield flush()
        yield flush()

    return count


def vocabulary(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LETTERS, occurrences: int = OCCURRENCES, typo: int | None = None
) -> DataFrame:
    """(word, n): words of ``letters`` or more that occur ``occurrences`` times in all texts together.

    A word is a maximal run of ``[A-Za-zÀ-ÿ]``, with A-Z lowered and nothing else. With ``typo`` a run loses
    a letter in documents that its checksum chooses: where ``typo`` divides the crc32 of ``<id>:<run>``, the one at
    the checksum modulo its length. Null texts have no words; a null id is written as nothing. Repeated rows count again.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(_counted(letters, typo), "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def _points(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length).astype(np.uint64)


def _powers(length: int) -> np.ndarray:
    out = np.full(length, BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def hashes(words: list[str]) -> np.ndarray:
    """A polynomial in the letters, for words of any length."""
    out = np.zeros(len(words), np.uint64)
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        out[at] = (_points([words[i] for i in at], length) * _powers(length)).sum(axis=1)
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _block(mixed: np.ndarray, blocks: int) -> np.ndarray:
    return ((mixed >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def _bit(mixed: np.ndarray, lane: int) -> np.ndarray:
    low = (mixed & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return np.uint32(1) << (low * FACTORS[lane] >> np.uint32(27))


def probe(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in ``h`` whose hash may be in the filter ``words`` (a row of eight 32-bit words for each block)."""
    if not len(words):
        return np.zeros(0, np.int64)
    mixed = _mixed(h)
    block, left = _block(mixed, len(words)), np.arange(len(h))
    for lane in range(8):
        left = left[words[block[left], lane] & _bit(mixed[left], lane) != 0]
    return left


def shard(length: int) -> int:
    return min(length, LAST_SHARD)


def _hashed(blocks: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            mixed = _mixed(hashes(words))
            shards = np.array([shard(len(w)) for w in words], np.int32)
            block = np.array([_block(mixed[i : i + 1], blocks[int(s)])[0] for i, s in enumerate(shards)], np.int64)
            columns = [pa.array(shards), pa.array((block // SEGMENT).astype(np.int32)), pa.array(block % SEGMENT), pa.array(mixed.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "segment", "block", "mixed"])

    return run


def _segments(blocks: dict[int, int]):
    def work(rows: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        out = []
        for start, stop in zip(cuts, cuts[1:]):
            some = rows.slice(start, stop - start)
            which, segment = some.column("shard")[0].as_py(), some.column("segment")[0].as_py()
            words = np.zeros((min(SEGMENT, blocks[which] - segment * SEGMENT), 8), np.uint32)
            block, mixed = some.column("block").to_numpy(), some.column("mixed").to_numpy().view(np.uint64)
            for lane in range(8):
                np.bitwise_or.at(words, (block, lane), _bit(mixed, lane))
            out.append((which, segment, words.tobytes()))
        columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, ["shard", "segment", "bits"])

    return work


def filters(words: DataFrame, most_bytes: int = FILTER_BYTES) -> dict[int, np.ndarray]:
    """Blocked Bloom filters of ``words(word)`` by length (64 letters and more share one), in ``most_bytes`` and 32 for each length.

    With more words there are fewer bits for each, thus more false positives for the join to remove; nothing is lost.
    """
    lengths = words.groupBy(F.least(F.length("word"), F.lit(LAST_SHARD)).alias("shard")).agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["n"] for r in lengths)
    bits = min(BITS_A_WORD, most_bytes * 8 / max(total, 1))
    blocks = {r["shard"]: int(r["n"] * bits / 256) + 1 for r in lengths}
    placed = words.select("word").mapInArrow(_hashed(blocks), "shard int, segment int, block bigint, mixed bigint")
    parts = by_group(placed, ["shard", "segment"], _segments(blocks), "shard int, segment int, bits binary")
    out = {s: np.zeros((n, 8), np.uint32) for s, n in blocks.items()}
    for r in parts.collect():
        part = np.frombuffer(r["bits"], np.uint32).reshape(-1, 8)
        out[r["shard"]][r["segment"] * SEGMENT : r["segment"] * SEGMENT + len(part)] = part
    return out


def _probed(shards: Broadcast, letters: int, alphabet: list[int]):
    """(word, n, edit): shorter words and words with a later letter in one place that the filters hold."""
    none = np.zeros((0, 8), np.uint32)

    def of_length(words: list[str], counts: np.ndarray, length: int) -> Iterator[tuple[int, str]]:
        points, powers = _points(words, length), _powers(length)
        before = np.cumsum(points * powers, axis=1, dtype=np.uint64)
        whole = before[:, -1:]
        if length > letters:
            shorter = before - points * powers + (whole - before) * BACK
            # of a run of one letter any deletion gives the same word
            first = np.ones(points.shape, bool)
            first[:, 1:] = points[:, 1:] != points[:, :-1]
            row, at = np.nonzero(first)
            for i in probe(shards.value.get(shard(length - 1), none), shorter[row, at]):
                word = words[row[i]]
                yield int(row[i]), word[: at[i]] + word[at[i] + 1 :]
        own = shards.value.get(shard(length), none)
        for letter in alphabet:
            row, at = np.nonzero(points < np.uint64(letter))
            changed = whole[row, 0] + (np.uint64(letter) - points[row, at]) * powers[at]
            for i in probe(own, changed):
                word = words[row[i]]
                yield int(row[i]), word[: at[i]] + chr(letter) + word[at[i] + 1 :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, counts = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            lengths = np.array([len(w) for w in every])
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                step = max(1, 250_000 // int(length))
                for start in range(0, len(at), step):
                    some = at[start : start + step]
                    found = list(of_length([every[i] for i in some], counts[some], int(length)))
                    rows = some[[i for i, _ in found]] if found else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([every[i] for i in rows], pa.string()), pa.array(counts[rows], pa.int64()), pa.array([e for _, e in found], pa.string())],
                        ["word", "n", "edit"])

    return run


def near_pairs(words: DataFrame, letters: int = LETTERS, most_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, n, other, m): both ways, every two words of ``words(word, n)`` that are one edit apart."""
    spark = words.sparkSession
    # letters of words are among 90 at most
    alphabet = sorted(ord(r[0]) for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c != ''").distinct().collect())
    shards = spark.sparkContext.broadcast(filters(words, most_bytes))
    tasks = max(1, -(-words.count() // WORDS_A_TASK))
    edits = words.repartition(tasks, "word").mapInArrow(_probed(shards, letters, alphabet), "word string, n bigint, edit string")
    exact = edits.join(words.select(F.col("word").alias("edit"), F.col("n").alias("m")), "edit")
    one = stored(exact.select("word", "n", F.col("edit").alias("other"), "m"), "spelling-pairs")
    return one.union(one.select("other", "m", "word", "n"))


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) by following ``forms(word, form)`` to the end, twice as far each round. Counts grow along the way, so there are no circles."""
    now = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def spelling_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LETTERS, occurrences: int = OCCURRENCES,
    larger: int = LARGER, typo: int | None = None, most_bytes: int = FILTER_BYTES,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary (see ``vocabulary``).

    The form of a word is its near word that occurs most (ties: the first by code points), if that occurs ``larger`` times
    as often or more, else null. The root is the last word that forms lead to. Columns other than id and text
    are not read. No words give an empty table.
    """
    words = stored(vocabulary(docs, id_col, text_col, letters, occurrences, typo), "spelling-words")
    best = F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best")
    near = near_pairs(words, letters, most_bytes).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    enough = -F.col("best.less") >= F.lit(larger) * F.col("n")
    joined = words.join(near, "word", "left").select(
        "word", F.when(enough, F.col("best.other")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    formed = stored(joined, "spelling-forms")
    roots = roots_of(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_groups(table(spark, folder, "documents"), typo=TYPO)
