"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by score (ties: leftmost), merges the
best one, and offers the new neighbours until no pair is a piece. White space marks occur only at
the start of pieces, so a text falls into units (marks, then other characters) that never merge
with each other; each distinct unit of a batch is worked out once and checked against the library.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_format

from tallyscan.llm.common import table

MARK = "▁"
UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
CACHED_UNITS = 600_000
SHORT = 40
NEVER = float("inf")
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE, UNUSED = 1, 2, 3, 4, 6, 5


class MergeVocabulary:
    """A merge-type vocabulary with identity normalisation, and its encoder and decoder."""

    def __init__(self, path: str):
        model = model_format.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec, rules = model.trainer_spec, model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        if spec.model_type != 2 or rules.precompiled_charsmap or rules.remove_extra_whitespaces:
            raise ValueError("only merge-type vocabularies with identity normalisation")
        if not rules.escape_whitespaces or spec.treat_whitespace_as_suffix or kinds & {USER_DEFINED, UNUSED}:
            raise ValueError("white space must be escaped as a prefix; no user-defined or unused pieces")
        if any(MARK in p.piece.lstrip(MARK) for p in model.pieces if p.type == NORMAL):
            raise ValueError("a piece has a white space mark inside")
        self.pieces = [p.piece for p in model.pieces]
        self.prefix = MARK if rules.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        # the larger the score the earlier the merge: ranks are negated scores
        self.rank = {p.piece: -p.score for p in model.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.unknown_text = spec.unk_surface
        self.control = {i for i, p in enumerate(model.pieces) if p.type == CONTROL}
        named = {p.piece: i for i, p in enumerate(model.pieces)}
        self.begin, self.end = named[spec.bos_piece], named[spec.eos_piece]
        self.surface = ["" if i in self.control else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]
        self.special = np.array([i in self.byte_of or i == self.unknown for i in range(len(self.pieces))])
        self.cache: dict[str, bytes] = {}

    def encode_unit(self, unit: str) -> list[int]:
        """Ids of one unit by the agenda."""
        symbols = list(unit)
        symbols = self._merge_few(symbols) if len(symbols) <= SHORT else self._merge_many(symbols)
        ids = []
        for symbol in symbols:
            found = self.ids.get(symbol)
            if found is not None:
                ids.append(found)
            elif self.bytes:
                ids += [self.bytes[b] for b in symbol.encode()]
            else:
                ids.append(self.unknown)
        return ids

    def _merge_few(self, symbols: list[str]) -> list[str]:
        """The agenda as a plain list, one entry for each pair in the order of the text."""
        rank = self.rank
        agenda = [rank.get(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := min(agenda)) is not NEVER:
            i = agenda.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank.get(symbols[i] + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = rank.get(symbols[i - 1] + symbols[i], NEVER)
        return symbols

    def _merge_many(self, symbols: list[str]) -> list[str]:
        """The agenda as a heap over linked symbols."""
        rank, n = self.rank, len(symbols)
        agenda = [
            (rank[pair], i, pair) for i in range(n - 1) if (pair := symbols[i] + symbols[i + 1]) in rank
        ]
        heapify(agenda)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while agenda:
            _, i, pair = heappop(agenda)
            left, j = symbols[i], after[i]
            # an entry is stale once one of its symbols has been merged or taken
            if not left or j >= n or left + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (wider := pair + symbols[k]) in rank:
                    heappush(agenda, (rank[wider], i, wider))
            k = before[i]
            if k >= 0 and (wider := symbols[k] + pair) in rank:
                heappush(agenda, (rank[wider], k, wider))
        return [s for s in symbols if s]

    def units(self, text: str) -> list[str]:
        return UNIT.findall(self.prefix + text.replace(" ", MARK)) if text else []

    def encode_packed(self, texts: list[str], library=None) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers, begin and end included.

        With ``library`` every distinct unit is also encoded by it; a difference is an error.
        """
        begin, end = np.array([self.begin], "<u4").tobytes(), np.array([self.end], "<u4").tobytes()
        cache, packed = self.cache, []
        for text in texts:
            units = self.units(text)
            try:
                body = b"".join([cache[u] for u in units])
            except KeyError:
                self._learn([u for u in dict.fromkeys(units) if u not in cache], library)
                body = b"".join([cache[u] for u in units])
                if len(cache) > CACHED_UNITS:
                    cache.clear()
            packed.append(begin + body + end)
        return packed

    def _learn(self, units: list[str], library) -> None:
        encoded = [self.encode_unit(u) for u in units]
        if library is not None and self.prefix:
            # the library puts the mark in front itself; a first unit after the prefix always has one
            theirs = library.encode([u[1:] for u in units], num_threads=1)
            for unit, ours, other in zip(units, encoded, theirs):
                if ours != other and unit != MARK:
                    raise ValueError(f"unit {unit!r}: {ours} is not the library's {other}")
        for unit, ids in zip(units, encoded):
            self.cache[unit] = np.array(ids, "<u4").tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD one by one."""
        surface = self.surface
        first = next((i for i in ids.tolist() if i not in self.control), self.unknown)
        marked = bool(self.prefix) and not self.special[first] and surface[first].startswith(" ")
        special = np.flatnonzero(self.special[ids])
        if not len(special):
            text = "".join([surface[i] for i in ids.tolist()])
        else:
            out, at = [], 0
            values = ids.tolist()
            n = len(values)
            for start in special.tolist():
                if start < at:
                    continue
                out.append("".join([surface[i] for i in values[at:start]]))
                at = start
                if values[at] == self.unknown:
                    out.append(self.unknown_text)
                    at += 1
                    continue
                run = bytearray()
                while at < n and values[at] in self.byte_of:
                    run.append(self.byte_of[values[at]])
                    at += 1
                out.append(_replace_invalid(bytes(run)))
            out.append("".join([surface[i] for i in values[at:]]))
            text = "".join(out)
        return text[1:] if marked else text


def _replace_invalid(run: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that is no part of a character."""
    out, at = [], 0
    while at < len(run):
        try:
            out.append(run[at:].decode())
            break
        except UnicodeDecodeError as error:
            out.append(run[at : at + error.start].decode())
            out.append("�")
            at += error.start + 1
    return "".join(out)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> MergeVocabulary:
    return MergeVocabulary(path)


@lru_cache(maxsize=2)
def _library(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def encode_pieces(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``ids``: the ids of each whole text with begin and end. Null is taken as empty.

    ``path`` is the vocabulary's place on every executor.
    """
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = vocabulary(path).encode_packed(_texts(batch.column(len(keep))), _library(path))
            lists = [np.frombuffer(p, "<u4").astype(np.int32) for p in packed]
            ids = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]), pa.int32()),
                pa.array(np.concatenate([*lists, np.empty(0, np.int32)])),
            )
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], ids], [*keep, "ids"])

    return rows.mapInArrow(run, f"{fields}, ids array<int>")


def decode_pieces(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``decoded``: the text of the ids of each row; null ids give null."""
    rows = encoded.select(*keep, "ids")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(len(keep))
            texts = [None if i is None else vocabulary(path).decode(i) for i in _arrays(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], [*keep, "decoded"])

    return rows.mapInArrow(run, f"{fields}, decoded string")


def _arrays(ids: pa.Array) -> list[np.ndarray | None]:
    offsets, values, null = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False), ids.is_null().to_pylist()
    return [None if gone else values[a:b] for gone, a, b in zip(null, offsets[:-1], offsets[1:])]


def round_trip(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of each row: encoded, then decoded from the ids alone.

    Both steps run on one Arrow batch, so neither ids nor texts travel. Null is taken as empty;
    repeated rows get equal results; other columns are not read.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(path)
        for batch in batches:
            packed = pieces.encode_packed(_texts(batch.column(1)), _library(path))
            decoded = (pieces.decode(np.frombuffer(p, "<u4")) for p in packed)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
                ],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def given_vocabulary() -> str:
    """Place of the public vocabulary the registered query uses."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(table(spark, folder, "documents"), given_vocabulary())
