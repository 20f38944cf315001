import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyscan.llm import negatives
from tallyscan.llm.negatives import BITS, Layout, _bounds, hard_negatives, hilbert_keys


def brute(rows, every, positives=5, keep=3, low=50, high=95, scale=256):
    """rows: (id, label, vector); the same result by comparing all rows with each anchor."""
    fine = [(i, k, v) for i, k, v in rows if i is not None and k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole = {}
    for i, k, v in sorted((i, k, len(v), [int(np.floor(scale * x)) for x in v]) for i, k, v in fine) and sorted(
            ((i, k, [int(np.floor(scale * x)) for x in v]) for i, k, v in fine), key=lambda r: (r[0], r[1], len(r[2]), r[2])):
        whole.setdefault(i, (k, v))
    out = []
    for a, (label, v) in whole.items():
        if a % every:
            continue
        scores = [(-sum(x * y for x, y in zip(v, u)), i, k) for i, (k, u) in whole.items() if i != a and len(u) == len(v)]
        for s, i, _ in sorted(x for x in scores if x[2] == label)[:positives]:
            within = sorted(x for x in scores if x[2] != label and low * -s <= 100 * -x[0] <= high * -s)[:keep]
            out += [(a, i, r, j, -s, -t) for r, (t, j, _) in enumerate(within, 1)]
    return sorted(out)


SCHEMA = "vec_id long, label int, embedding array<double>, w string, part int"


def found(spark, rows, every, **more):
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], SCHEMA)
    return sorted(map(tuple, hard_negatives(df, F.col("vec_id") % every == 0, **more).collect()))


def clustered(n, dimensions, labels, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, dimensions))
    return [(i, int(rng.integers(labels)), (centres[i % 8] + 0.4 * rng.standard_normal(dimensions)).tolist()) for i in range(n)]


@pytest.mark.parametrize("dimensions,block", [(2, 16), (8, 7), (16, 1024)])
def test_against_brute_force(spark, dimensions, block):
    rows = clustered(700, dimensions, 4, dimensions)
    rows += [(1000 + i, 1 + i % 3 // 2, rows[50][2]) for i in range(200)]  # copies of a vector, more than a part holds
    assert found(spark, rows, 25, layout=Layout(block, 100, 8)) == brute(rows, 25) != []


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = clustered(60, 3, 2, 9)
    rows += [(100, None, [1.0, 2.0, 3.0]), (101, 1, None), (102, 1, [1.0, None, 2.0]), (103, 1, [nan, 1.0, 1.0]), (104, 1, [inf, 1.0, 1.0]), (None, 1, [1.0, 1.0, 1.0])]
    rows += [(105, 1, []), (110, 1, []), (111, 0, []), (120, 0, [9.0]), (121, 0, [8.0]), (122, 1, [7.0]), (130, 1, [0.0, 0.0, 0.0])]
    rows += [(10, 1, [5.0, 5.0, 5.0]), (10, 1, [5.0, 5.0, 5.0]), (20, 0, [-1.0, 0.0, 2.0]), (140, 5, [1.0, 1.0, 1.0])]
    assert found(spark, rows, 5) == brute(rows, 5)
    assert found(spark, [], 5) == []
    assert found(spark, rows, 5, positives=2, negatives=1, low=10, high=99, scale=7) == brute(rows, 5, 2, 1, 10, 99, 7)


def test_large_numbers_stay_exact(spark):
    rng = random.Random(4)
    rows = [(i, i % 2, [rng.uniform(-3e6, 3e6) for _ in range(4)]) for i in range(80)]
    assert found(spark, rows, 10) == brute(rows, 10)


def test_curve_visits_neighbours_and_every_cell():
    side = 1 << BITS
    points = np.array([(x, y) for x in range(side) for y in range(side)])
    order = np.argsort([k.tobytes() for k in hilbert_keys(points)])
    steps = np.abs(np.diff(points[order], axis=0)).sum(axis=1)
    assert (steps == 1).all()
    cube = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    order = np.argsort([k.tobytes() for k in hilbert_keys(cube)])
    assert (np.abs(np.diff(cube[order], axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_every_score():
    rng = np.random.default_rng(1)
    points, asked = rng.integers(-50, 50, (40, 6)), rng.integers(-50, 50, (9, 6))
    least, most = _bounds(asked, points.min(axis=0)[None], points.max(axis=0)[None])
    scores = asked @ points.T
    assert (least <= scores).all() and (scores <= most).all()


def test_far_blocks_are_not_read(spark):
    rows = [(i, i % 2, [float(np.cos(i / 300)), float(np.sin(i / 300))]) for i in range(1800)]
    df = spark.createDataFrame([(*r, True) for r in rows], "id long, label long, vec array<double>, anchor boolean").withColumn("anchor", F.col("id") % 50 == 0)
    index = negatives.build(df, layout=Layout(32, 256))
    asked = negatives._as_binary(index.anchors).withColumns({"lows": F.array(F.lit(65000).cast("bigint")), "highs": F.array(F.lit(negatives.MOST - 1))})
    pairs = negatives._chosen(index, asked, True).count()
    assert 36 <= pairs < 36 * index.blocks.where("no >= 0").count() / 4
