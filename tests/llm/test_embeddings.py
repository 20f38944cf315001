import numpy as np
import pytest

from tallyscan.llm.common import roots
from tallyscan.llm.embeddings import ProductCode, link_embeddings, op5_embeddings

FOLDER = "/root/testdata/sf0.01"


def brute(ids, vectors, least=0.95):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(unit @ unit.T >= least, 1))
    links = np.bincount(np.concatenate([a, b]), minlength=len(ids))
    label = roots(len(ids), a, b)
    first = {}
    for i, r in zip(ids, label.tolist()):
        first[r] = min(first.get(r, i), i)
    return {i: (int(n), first[r]) for i, n, r in zip(ids, links, label.tolist())}


def test_list_decoding_finds_all_directions_above_the_threshold():
    decoder = ProductCode(12, 5, 8.0).decoder()
    rng = np.random.default_rng(1)
    units = rng.standard_normal((50, 12))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    turned = units @ decoder.rotation
    for unit, found in zip(turned, decoder.decode(units)):
        one, two, three = (unit[cut] @ words.T for cut, words in zip(decoder.cuts, decoder.words))
        sums = (one[:, None, None] + two[None, :, None] + three[None, None, :]).ravel()
        wanted = np.flatnonzero(sums >= decoder.least)
        assert found.tolist() == (wanted.tolist() if len(wanted) else [int(np.argmax(sums))])


def test_given_table_against_brute_force(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").collect()
    wanted = brute([r.vec_id for r in rows], np.array([r.embedding for r in rows], float))
    got = {r.vec_id: (r.n_links, r.component_id) for r in op5_embeddings(spark, FOLDER).collect()}
    assert got.keys() == wanted.keys()
    assert all(got[i][0] <= wanted[i][0] for i in got)
    assert sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in wanted.values())


@pytest.mark.parametrize("dimensions", [64, 256])
def test_recall_near_the_threshold(spark, dimensions):
    """1,000 pairs at each of three cosines among single vectors: at least 0.93 of each kind are linked."""
    rng = np.random.default_rng(dimensions)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    rows, least = [], []
    for cosine in (0.951, 0.96, 0.99):
        a = unit(rng.standard_normal((1000, dimensions)))
        side = rng.standard_normal((1000, dimensions))
        side = unit(side - (side * a).sum(axis=1, keepdims=True) * a)
        rows += [x for pair in zip(a, cosine * a + np.sqrt(1 - cosine**2) * side) for x in pair]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>").repartition(8)
    got = {r.vec_id: r.component_id for r in link_embeddings(df).collect()}
    for kind in range(3):
        found = sum(got[i] == got[i + 1] for i in range(2000 * kind, 2000 * (kind + 1), 2))
        assert found >= 930, (dimensions, kind, found)


def test_hot_group_in_blocks(spark, monkeypatch):
    """Many near copies of one vector: every link is counted once though groups are split and filters shared."""
    from tallyscan.llm import embeddings

    monkeypatch.setattr(embeddings, "BLOCK", 40)
    rng = np.random.default_rng(2)
    base = rng.standard_normal(32)
    vectors = np.concatenate([base + 0.1 * rng.standard_normal((300, 32)), rng.standard_normal((200, 32))])
    vectors[10] = vectors[11] = vectors[12]
    wanted = brute(list(range(500)), vectors)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in link_embeddings(df, filters=60.0).collect()}
    assert all(got[i][0] <= wanted[i][0] for i in got)
    assert sum(n for n, _ in got.values()) >= 0.98 * sum(n for n, _ in wanted.values())


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, v), (2, [2.0, 4.0, 6.0, 8.0]), (3, [-1.0, -2.0, -3.0, -4.0]), (4, None), (5, [0.0] * 4), (6, [1.0, None, 3.0, 4.0]), (7, [1.0, float("nan"), 3.0, 4.0]),
            (8, [float("inf"), 2.0, 3.0, 4.0]), (9, [1.0, 2.0, 3.0]), (10, []), (1, v), (None, v), (None, None), (11, [1e300, 2e300, 3e300, 4e300]), (12, [5.0]), (13, [7.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, n_links int, u string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in link_embeddings(df).collect()), key=str)
    linked = [(1, 4, 1, True), (1, 4, 1, True), (2, 4, 1, False), (11, 4, 1, False), (None, 4, 1, False)]
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)] + [(None, 0, None, True), (12, 1, 12, True), (13, 1, 12, False)]
    assert got == sorted(linked + alone, key=str)
    assert link_embeddings(df.limit(0)).collect() == []
