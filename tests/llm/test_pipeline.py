import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
import test_decontaminate
import test_linededup
import test_simhash
from tallyscan.llm.common import stored

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def results(spark):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        given, docs = docs, stored(stage(spark, docs, FOLDER), f"test-{name}")
        out.append((given, docs))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_all_but_the_last_keep_the_columns(results):
    for given, done in results[:-1]:
        assert done.columns == given.columns and done.dtypes == given.dtypes


def test_language(results):
    given, done = map(texts, results[0])
    assert done.items() <= given.items() and len(done) >= 0.998 * len(given)


def test_lines(results):
    given, done = map(texts, results[1])
    wanted = {i: kept for i, kept, n in test_linededup.brute(list(given.items()), 3, 50) if n == 0 or (kept or "").strip()}
    assert done == wanted


def test_near_duplicates(results):
    """One document stays of each group that links of three or fewer differing bits connect."""
    given, done = map(texts, results[2])
    assert done == {i: given[i] for i in {c for _, _, c in test_simhash.brute(list(given.items()))}}


def test_decontamination(spark, results):
    given, done = map(texts, results[3])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    bad = {row[0] for row in test_decontaminate.brute(list(given.items()), items) if row[-1]}
    assert set(done) == set(given) - bad and done.items() <= given.items()


def test_encoding(results):
    given, done = results[4]
    assert sorted(r.doc_id for r in done.collect()) == sorted(r.doc_id for r in given.collect())


def test_run_is_the_last_stage(spark, results):
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(tuple, results[-1][1].collect()))


def test_odd_rows(spark):
    """Nulls, repeats, very long texts and more columns run through; an empty table gives an empty one."""
    names = ["digest", "_gone", "_id", "_digest", "_kept", "_lines", "_removed", "_runs", "_split", "_lang", "_text_digest", "_bad_id", "_bad_digest", "row", "id"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("*", "1 as node", *[f"'c' as {n}" for n in names])
    odd = [(None, "the and of that\nwith this", "en", "s", 9), (-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, "one\n" * 20000, "en", "s", 1),
           (-4, "the same and the same", "en", "s", 1), (-4, "the same and the same", "en", "s", 1)]
    extra = spark.createDataFrame([(*r, 1, *["c"] * len(names)) for r in odd], docs.schema)
    for rows in (docs.limit(200).union(extra), docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rows = stored(stage(spark, rows, FOLDER), f"odd-{name}")
            assert rows.columns == docs.columns
            assert rows.where(" or ".join(f"{n} is distinct from 'c'" for n in names)).isEmpty()
        ids = [r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, rows, FOLDER).collect()]
        assert ids == [] or (ids.count(-4) == 1 and ids.count(None) == 1 and -1 not in ids and -2 not in ids)
