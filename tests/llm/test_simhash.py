import numpy as np
import pytest
import xxhash

from tallyscan.llm.simhash import Golay, fingerprint, one_of_each_group, op4_simhash, simhash_groups

FOLDER = "/root/testdata/sf0.001"


def plain(text):
    words = [w for w in (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = np.array([plain(t) for _, t in rows], np.uint64)
    ids = [i for i, _ in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3):
            label[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, n in enumerate(ids):
        groups.setdefault(find(i), []).append(n)
    least = {g: min((n for n in m if n is not None), default=None) for g, m in groups.items()}
    return sorted(((n, f"{int(prints[i]):016x}", least[find(i)]) for i, n in enumerate(ids)), key=str)


def test_perfect_code():
    golay = Golay()
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 2000)
    assert len({int(golay.decode(np.array([w]))[0]) for w in range(1 << 12)}) <= 4096
    near = golay.near(words, 23)
    for _ in range(20):
        other = words ^ (1 << rng.integers(0, 23, len(words)))
        theirs = golay.near(other, 23)
        shared = ((near[:, :, None] == theirs[:, None, :]) & (near[:, :, None] >= 0)).any((1, 2))
        assert shared.all()


def test_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert sorted(map(tuple, op4_simhash(spark, FOLDER).collect()), key=str) == brute(rows)


def test_planted_bit_errors(spark, monkeypatch):
    """A chain of texts whose fingerprints differ in few bits, hot copies, nulls, empties, repeats, long texts."""
    base = "the quick brown fox jumps over the lazy dog " * 40
    rows = [(i, base + "x" * (i % 3)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "one"), (104, "one two"), (103, "one"), (None, base), (None, "alone é")]
    rows += [(105, "É é A a " * 30000), (106, "É é a a " * 30000), (-5, "x" * 300000)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, fp int, root int")
    assert sorted(map(tuple, simhash_groups(df).collect()), key=str) == brute(rows)
    kept = [r.doc_id for r in one_of_each_group(df).collect()]
    assert sorted(i for i in kept if i is not None) == [-5, 0, 100, 103, 104, 105] and kept.count(None) == 2


@pytest.mark.parametrize("size", [4, 50])
def test_large_groups_are_split(spark, monkeypatch, size):
    from tallyscan.llm import simhash

    rng = np.random.default_rng(3)
    prints = rng.integers(0, 2**64, 20, dtype=np.uint64)
    near = [p ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for p in prints for a, b in rng.integers(0, 64, (10, 2))]
    given = np.unique(np.concatenate([prints, np.array(near, np.uint64)])).view(np.int64).tolist()
    monkeypatch.setattr(simhash, "BLOCK", size)
    df = spark.createDataFrame([(g,) for g in given], "fp bigint")
    found = {(r.node, r.root) for r in simhash.components(simhash.links(df)).collect()}
    wanted = {}
    bits = np.array(given, np.int64).view(np.uint64)
    label = np.arange(len(bits))
    for _ in range(30):
        for i in range(len(bits)):
            label[i] = label[np.bitwise_count(bits ^ bits[i]) <= 3].min()
    for i, root in enumerate(label):
        wanted.setdefault(root, []).append(given[i])
    groups = {}
    for node, root in found:
        groups.setdefault(root, {root}).add(node)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in wanted.values() if len(g) > 1)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash_groups(df).collect() == []
    assert fingerprint(None) == 0


def test_keys_meet_for_every_pattern_of_three_bits():
    from tallyscan.llm.simhash import _keys

    rng = np.random.default_rng(7)
    golay = Golay()
    prints = rng.integers(0, 2**64, 400, dtype=np.uint64)
    for bits in (1, 2, 3):
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in prints], np.uint64)
        sides = []
        for side in (prints, prints ^ flips):
            at, keys, leads = _keys(side, golay)
            sides.append([{} for _ in prints])
            for i, k, lead in zip(at.tolist(), keys.tolist(), leads.tolist()):
                sides[-1][i][k] = lead
        assert all(any(a[k] or b[k] for k in a.keys() & b.keys()) for a, b in zip(*sides))


def test_one_of_each_group_against_brute_force(spark):
    """Families of copies with a few words changed, one of them large; columns may have any name."""
    import random

    rng = random.Random(5)
    rows = []
    for family in range(12):
        base = [f"w{int(rng.paretovariate(0.7)) % 5000}" for _ in range(rng.randint(150, 400))]
        for copy in range(300 if family == 0 else rng.randint(1, 6)):
            words = base[:]
            for _ in range(copy % 4):
                words[rng.randrange(len(words))] = f"changed{copy}"
            rows.append((len(rows), " ".join(words)))
        rng.shuffle(base)
        rows.append((len(rows), " ".join(base)))
    names = ["_digest", "fp", "root", "component_id", "fingerprint", "node", "key"]
    df = spark.createDataFrame([(*r, *[f"{n}{r[0]}" for n in names]) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    done = one_of_each_group(df)
    assert done.columns == df.columns
    assert sorted(r.doc_id for r in done.collect()) == sorted({c for _, _, c in brute(rows)})
    assert all(r[n] == f"{n}{r.doc_id}" for r in done.collect() for n in names)
