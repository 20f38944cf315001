import zlib

import numpy as np

from tallyscan.llm import langid
from tallyscan.llm.langid import count_ngrams, drop_rejected, fold, op8_langid

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    given = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = op8_langid(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in found) == sorted(given)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in found if r.held_out and given[r.doc_id].lang]
    assert sum(r.lang_pred == given[r.doc_id].lang for r in held) >= 0.97 * len(held)
    assert sum(r.rejected for r in found) <= 0.002 * len(found)


def test_pieces_give_the_same_counts(monkeypatch):
    text = "Ça va?! 12 .. été  ÜBER\n\tx " * 9
    whole = count_ngrams(text)
    for piece in (1, 2, 3, 7, 50):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert (count_ngrams(text) == whole).all()
    assert count_ngrams("12 !\n") is None and count_ngrams("") is None and count_ngrams(None) is None


def test_odd_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(90001, None, "en"), (90002, "", "fr"), (90003, "12 34 !!", None), (90004, "漢字かな交じり文で書かれた長い文章です" * 5, None),
           (90005, "the and of that with " * 60000, "en"), (90006, "x", None), (None, "the and of with that", "en"), (90007, "the", None), (90007, "the", None)]
    both = docs.union(spark.createDataFrame(odd, docs.schema)).selectExpr("*", "1 as score", "'c' as _lang")
    rows = langid.langid(both.drop("score", "_lang")).collect()
    found = {r.doc_id: r for r in rows if r.doc_id is None or r.doc_id >= 90000}
    assert [found[i].lang_pred for i in (90001, 90002, 90003)] == ["und"] * 3
    assert found[90004].rejected and found[90005].lang_pred == "en" and not found[None].held_out
    assert sum(r.doc_id == 90007 for r in rows) == 2
    kept = drop_rejected(both)
    assert kept.columns == both.columns and {r["_lang"] for r in kept.collect()} == {"c"}
    left = {r.doc_id for r in kept.where("doc_id >= 90000 or doc_id is null").collect()}
    assert not left & {90001, 90002, 90003, 90004} and {90005, None} <= left


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.langid(none).collect() == []
    one = spark.createDataFrame([(1, "text", None)], none.schema)
    assert [(r.lang_pred, r.score) for r in langid.langid(one).collect()] == [("und", 0.0)]


def test_prediction_ignores_language_and_id(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(300)
    model = langid.fit(docs, fold() != 1)
    other = docs.selectExpr("doc_id + 7 as doc_id", "text", "'xx' as lang")
    one = [r._lang for r in langid.identify(docs, model).orderBy("doc_id").collect()]
    two = [r._lang for r in langid.identify(other, model).orderBy("doc_id").collect()]
    assert one == two and np.isclose(np.linalg.norm(model.centroids, axis=1), 1).all()


def test_document_frequencies_count_all_rows(spark):
    """Rows beyond the ones the centroids are fitted on count too; unlabelled ones, and those not learned from, do not."""
    rows = [(i, f"alpha beta {'gamma' if i % 2 else 'delta'} text{'abcdefghij'[i % 10]}", "en" if i % 3 else "de") for i in range(60)]
    rows += [(100, "omega", None), (101, None, "en"), (102, "12", "en"), (103, "theta", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(df, langid.F.col("doc_id") != 103, per_language=5)
    seen = np.ones(langid.DIMENSIONS)
    for _, text, _ in rows[:60]:
        seen[np.flatnonzero(count_ngrams(text))] += 1
    assert np.allclose(model.idf, np.log(61 / seen) + 1)
