import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyscan.llm import spelling
from tallyscan.llm.spelling import filters, hashes, op12_spelling, probe, shard, spelling_groups


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, letters=6, occurrences=5, larger=5, typo=199):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if typo and h % typo == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= letters and n >= occurrences}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    form, out = {}, {}
    for w, n in words.items():
        others = [o for k in (-1, 0, 1) for o in by_length.get(len(w) + k, []) if near(w, o)]
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= larger * n else None
        out[w] = len(others)
    result = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        result.append((w, form[w], root, n, out[w], words[form[w]] if form[w] else None))
    return sorted(result)


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "f") for r in rows], "doc_id long, text string, n int, form string").repartition(4)
    return sorted(map(tuple, spelling_groups(df, **more).collect()))


def some_rows(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abéÀ") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    words += [w[:3] + rng.choice("xyzÿ") + w[4:] for w in words if len(w) > 4]
    rows = [(i, rng.choice([" ", "-", "9", "Ā"]).join(rng.choice(words[: 1 + rng.randrange(len(words))]) for _ in range(200))) for i in range(60)]
    long = "w" * 80 + "abc" * 30
    rows += [(900 + i, f"{long} {long[1:]} {long[:5]}q{long[6:]} " + "Straße STRASSE naïveté Naivete naïvete " * 3) for i in range(7)]
    return rows + [(1000, None), (1001, ""), (1002, "1 2 ÷×"), (None, "abcdefg " * 9), (5, "abcdefh " * 90), (5, "abcdefh " * 90), (2000, "z" * 200_000)]


@pytest.mark.parametrize("typo,most_bytes", [(199, spelling.FILTER_BYTES), (3, spelling.FILTER_BYTES), (None, 32)])
def test_against_brute_force(spark, typo, most_bytes):
    rows = some_rows(typo or 1)
    assert found(spark, rows, typo=typo, most_bytes=most_bytes) == brute(rows, typo=typo) != []


def test_other_limits_and_no_words(spark):
    rows = some_rows(8)
    assert found(spark, rows, letters=3, occurrences=2, larger=2) == brute(rows, 3, 2, 2, None)
    assert found(spark, []) == [] == found(spark, [(1, "short"), (2, None)])


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op12_spelling(spark, folder).collect())) == brute(rows)


def test_filters_lose_nothing_and_let_few_others_pass(spark):
    rng = random.Random(5)
    words = list({"".join(rng.choice("abcdefghij") for _ in range(rng.choice([7, 8, 70, 71]))) for _ in range(5000)})
    made = filters(spark.createDataFrame([(w,) for w in words], "word string"))
    for size in (7, 8, 70):
        own = [w for w in words if shard(len(w)) == shard(size)]
        assert len(probe(made[shard(size)], hashes(own))) == len(own)
        assert len(probe(made[shard(size)], np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64))) < 200
    assert sum(f.nbytes for f in filters(spark.createDataFrame([(w,) for w in words], "word string"), 1024).values()) <= 1024 + 3 * 32
