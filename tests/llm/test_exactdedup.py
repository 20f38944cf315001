import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyscan.llm.exactdedup import content_hash, copies, without_copies


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), (i is not None, i or 0), i))
    out = []
    for i, t in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best = min(groups[body])
        out.append((i, best[2], len(groups[body]), (i, -len(t or "")) == (best[2], best[0]), hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=str)


def some_rows():
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab é \n\t\x0b\xa0") for _ in range(rng.randint(0, 5)))) for i in range(400)]
    rows += [(1000 + i, "hot  text") for i in range(300)] + [(2000, "hot te\txt  \r"), (2001, None), (2002, ""), (2003, " \n ")]
    rows += [(3000, "long " * 50_000), (3001, "long" * 50_000), (7, "twice"), (7, "twice"), (7, "tw ice"), (None, "hot text "), (None, None)]
    return rows


@pytest.mark.parametrize("hashed", [content_hash, lambda c: F.substring(content_hash(c), 1, 1), lambda c: F.unhex(F.lit("00"))])
def test_against_brute_force_whatever_the_hash(spark, hashed):
    rows = some_rows()
    df = spark.createDataFrame([(*r, 1, "d") for r in rows], "doc_id long, text string, n int, digest string").repartition(5)
    assert sorted((tuple(r) for r in copies(df, hashed=hashed, bits=16).collect()), key=str) == brute(rows)


def test_bitmap_lets_all_shared_hashes_pass(spark):
    rows = some_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in copies(df, bits=15).collect()), key=str) == brute(rows)


def test_one_row_of_each_class_stays_with_its_columns(spark):
    rows = some_rows()
    names = ["id", "kept", "row", "text_sha256", "less", "best", "n", "_window"]
    df = spark.createDataFrame([(*r, *[f"{k}{r[0]}" for k in names]) for r in rows], "doc_id long, text string, " + ", ".join(f"{k} string" for k in names))
    done = without_copies(df)
    assert done.columns == df.columns
    stay = {(r[0], r[4]) for r in brute(rows) if r[3]}
    found = [(r.doc_id, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r.text or "").encode()).hexdigest()) for r in done.collect()]
    assert sorted(found, key=str) == sorted(stay, key=str)
    assert all(r["_window"] == f"_window{r.doc_id}" for r in done.collect())


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert copies(df).collect() == [] and without_copies(df).collect() == []


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(500)] + [(900, "text 5")], "doc_id long, text string")
    plan = copies(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
