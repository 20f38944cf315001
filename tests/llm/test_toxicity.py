import random

from tallyscan.llm.toxicity import classify, describe, fit_chain, op3_toxicity

FOLDER = "/root/testdata/sf0.01"
INSULTS = {"clown", "idiot", "loser", "worthless", "disgusting", "stupid", "moron", "pathetic", "scum", "trash"}


def test_held_out(spark):
    """Documents with insults are found whether labelled or not, others are left alone."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = {r.doc_id: r.toxic for r in op3_toxicity(spark, FOLDER).collect()}
    assert found.keys() == texts.keys()
    insults = {i: len(describe(t)[0] & INSULTS) if describe(t) else 0 for i, t in texts.items()}
    bad = [i for i, n in insults.items() if n >= 2]
    clean = [i for i, n in insults.items() if n == 0]
    assert sum(found[i] for i in bad) >= 0.9 * len(bad)
    assert sum(found[i] for i in clean) <= 0.01 * len(clean)


def rows(n, seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "house", "tree", "river", "stone"]
    out = []
    for i in range(n):
        text, rude, threat = [rng.choice(words) for _ in range(rng.randint(1, 60))], rng.random() < 0.3, False
        if rude:
            text += ["oaf", "dolt"]
            threat = rng.random() < 0.5
            text += ["smite"] if threat else []
        out.append((seed * 100000 + i, " ".join(text), int(rude), int(threat)))
    return out


def test_chain_of_categories(spark):
    given = spark.createDataFrame(rows(600, 1), "doc_id long, text string, rude int, threat int")
    chain = fit_chain(given, given, ["rude", "threat"])
    assert len(chain.models[1].rest) == len(chain.models[0].rest) + 1  # sees the earlier category
    test = rows(300, 2)
    docs = spark.createDataFrame([(*r[:2], "clash", 0.5) for r in test], "doc_id long, text string, p_rude string, words double")
    found = {r.doc_id: (r.p_rude >= 0.5, r.p_threat >= 0.5) for r in classify(docs, chain).collect()}
    right = sum(found[i] == (bool(a), bool(b)) for i, _, a, b in test)
    assert right >= 0.97 * len(test)


def test_odd_rows(spark):
    given = spark.createDataFrame(rows(300, 1) + [(1, None, 1, None), (None, "x", 1, 1), (100001, "oaf", 1, 0)], "doc_id long, text string, rude int, threat int")
    chain = fit_chain(given, given, ["rude", "threat"])
    odd = [(1, None), (2, ""), (3, "12 !"), (4, "oaf dolt " * 50000), (4, "oaf dolt"), (4, "oaf dolt"), (None, "river")]
    found = [(r.doc_id, r.p_rude, r.p_threat) for r in classify(spark.createDataFrame(odd, "doc_id long, text string"), chain).collect()]
    assert found[:3] == [(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.0)]
    assert found[3][1] > 0.5 and found[4] == found[5] and found[6][1] < 0.5


def test_one_class_and_empty_tables(spark):
    given = spark.createDataFrame([(i, "a b c", 0, 1) for i in range(20)], "doc_id long, text string, rude int, threat int")
    chain = fit_chain(given, given, ["rude", "threat"])
    assert [(r.p_rude < 0.5, r.p_threat > 0.5) for r in classify(given, chain).collect()] == [(True, True)] * 20
    none = given.limit(0)
    chain = fit_chain(none, none, ["rude", "threat"])
    assert classify(none, chain).collect() == []
    assert [r.p_rude < 0.5 for r in classify(given.limit(1), chain).collect()] == [True]


def test_inflected_words(spark):
    """A stem that toxic texts inflect in a thousand ways is learned, though most of its forms are not among the learned rows."""
    rng = random.Random(5)
    syllables = ["ba", "de", "fi", "go", "lu", "ma", "ne", "ri", "so", "tu"]
    word = lambda n: "".join(rng.choice(syllables) for _ in range(n))

    def some(first):
        out = []
        for i in range(first, first + 400):
            text, rude = [word(rng.randint(2, 4)) for _ in range(40)], rng.random() < 0.2
            if rude:
                text[rng.randrange(40)] = "zork" + word(3)
            out.append((i, " ".join(text), 1, int(rude)))
        return out

    given, test = some(0), some(1000)
    columns = "doc_id long, text string, quality int, toxic int"
    given = spark.createDataFrame(given, columns)
    chain = fit_chain(given, given, ["quality", "toxic"])
    found = {r.doc_id: r.p_toxic >= 0.5 for r in classify(spark.createDataFrame(test, columns), chain).collect()}
    assert sum(found[i] == bool(toxic) for i, *_, toxic in test) >= 0.98 * len(test)
