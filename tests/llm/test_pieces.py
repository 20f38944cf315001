import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from tallyscan.llm import pieces
from tallyscan.llm.pieces import decode_pieces, encode_pieces, given_vocabulary, op7_pieces, round_trip, vocabulary

FOLDER = "/root/testdata/sf0.001"
ODD = ["", " ", "  ", "▁", "▁▁ a", "\x00", "a\x00b", "é" * 50, "😀 \U0010ffff x", "�", "<s></s><unk><0x41>", "a" * 3000, " " * 5000, "x \n\n\t  y ", "▁▁foo ▁", "the" * 999]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=given_vocabulary())


@pytest.mark.parametrize("short", [0, 40])
def test_equals_the_library(library, monkeypatch, short):
    monkeypatch.setattr(pieces, "SHORT", short)
    own = pieces.MergeVocabulary(given_vocabulary())
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(" ab▁é\n😀thex") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for text, packed in zip(texts, own.encode_packed(texts)):
        ids = np.frombuffer(packed, "<u4")
        wanted = library.encode(text, add_bos=True, add_eos=True)
        assert ids.tolist() == wanted, text
        assert own.decode(ids) == library.decode(wanted), text


def test_decodes_any_ids(library):
    own = vocabulary(given_vocabulary())
    rng = random.Random(2)
    some = lambda: rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(3, 258), rng.randint(259, 31999), 28705])
    for _ in range(3000):
        ids = [some() for _ in range(rng.randint(0, 12))]
        assert own.decode(np.array(ids, np.int64)) == library.decode(ids), ids


def test_a_difference_from_the_library_is_an_error(library):
    own = pieces.MergeVocabulary(given_vocabulary())
    own.rank = {}
    with pytest.raises(ValueError):
        own.encode_packed(["thing"], library)


def digests(library, rows):
    out = []
    for i, text in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_against_the_library(spark, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert sorted(map(tuple, op7_pieces(spark, FOLDER).collect()), key=str) == digests(library, rows)


def test_odd_rows(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (3, None), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(*r, 5, "c") for r in rows], "doc_id long, text string, n_tokens int, ids string")
    assert sorted(map(tuple, round_trip(df, given_vocabulary()).collect()), key=str) == digests(library, rows)
    encoded = encode_pieces(df, given_vocabulary())
    back = decode_pieces(encoded, given_vocabulary())
    assert sorted(((r.doc_id, r.decoded) for r in back.collect()), key=str) == sorted(((i, t or "") for i, t in ((i, (t or "").replace("▁", " ")) for i, t in rows)), key=str)
    assert round_trip(df.limit(0), given_vocabulary()).collect() == []
