import hashlib
import random
import re

import pytest

from tallyscan.llm import decontaminate as module
from tallyscan.llm.decontaminate import decontaminate, drop_contaminated

LOW = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(max(len(w) - 12, 1) if w else 0):
            windows.setdefault(tuple(w[s : s + 13]), set()).add(item)
    out = []
    for i, text in docs:
        w = words(text)
        hit, found = set(), set()
        for size in {len(k) for k in windows}:
            for s in range(len(w) - size + 1):
                if tuple(w[s : s + size]) in windows:
                    hit.update(range(s, s + size))
                    found |= windows[tuple(w[s : s + size])]
        names = ",".join(sorted(str(x) for x in found if x is not None))
        n = len([x for x in found if x is not None])
        out.append((i, len(w), len(hit), n, hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(module, "BROADCAST_ROWS", broadcast)
    rng = random.Random(1)
    text = lambda n, k=6: " ".join(rng.choice(["ab", "É", "é", "x1", "cd", "the"][:k]) for _ in range(n))
    items = [(1, text(30)), (2, text(13)), (3, text(5)), (10, text(3)), (11, "zz"), (12, text(14, 2)), (4, None), (5, ""), (6, "?!"), (7, "X" * 3), (8, "ZZ"), (None, text(20)), (3, text(5)), (1, "a b c d e f")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)]
    for i in range(40, 80):
        item = rng.choice([t for _, t in items if t])
        docs.append((i, text(rng.randint(0, 400)) + rng.choice([" ", "\n", ".-"]) + item.upper() + " " + text(rng.randint(0, 9))))
    docs += [(100, None), (101, ""), (102, "?? !!"), (103, "zz " * 30000), (103, "zz"), (103, "zz"), (None, "xxx"), (104, "a b c d e f " * 3)]
    df = spark.createDataFrame([(*d, 1, "c", "w") for d in docs], "doc_id long, text string, h int, window string, digest string")
    bench = spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, h int")
    got = decontaminate(df, bench).drop("digest")
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)
    clean = drop_contaminated(df, bench)
    assert clean.columns == df.columns
    bad = [r[0] for r in brute(docs, items) if r[-1]]
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((d[0] for d in docs if d[0] not in bad or (d[0] == 103 and 103 not in bad)), key=str)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in decontaminate(docs, none).collect()] == [(2, 0, False)]
    assert decontaminate(docs.limit(0), none).collect() == []
