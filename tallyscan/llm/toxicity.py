"""Toxicity by a classifier chain of linear models.

The categories are predicted one after another; a model sees the words, their stems (the first letters of longer
words, as most languages inflect at the end and each form alone is rare) and some text statistics,
and the log-odds of all earlier categories. In training these log-odds are out-of-fold predictions,
so that a later model meets earlier ones as unsure as they will be on unseen documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyscan.llm.common import table

WORD = re.compile(r"[^\W\d_]+")
STATISTICS = 5
STEMS = (4, 5)
FEATURES = 300
LEAST_DOCUMENTS = 4
LEAST_SCORE = 4.0
RIDGE = 0.3
FOLDS = 5


def describe(text: str | None) -> tuple[set[str], np.ndarray] | None:
    """Distinct lower-case words and statistics of a whole text; None if it has no word."""
    if not text:
        return None
    words = WORD.findall(text.lower())
    if not words:
        return None
    distinct = set(words)
    letters = sum(map(len, words))
    upper = sum(map(len, re.findall(r"[A-Z]+", text)))
    blanks = text.count(" ") + text.count("\n")
    return distinct, np.array([
        np.log1p(len(words)), upper / letters, (len(text) - letters - blanks) / len(text), letters / len(words), len(distinct) / len(words),
    ])


def with_stems(words: set[str]) -> set[str]:
    """The words and the stems of longer ones, marked by a star, which no word has."""
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in STEMS))


@dataclass
class Linear:
    """Logistic regression on the presence of words and stems and on standardised numbers."""

    words: list[str]
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    bias: float

    def __post_init__(self):
        self.weight_of = dict(zip(self.words, self.weights.tolist()))
        self.rest = self.weights[len(self.words) :]

    def log_odds(self, words: set[str], numbers: np.ndarray) -> float:
        known = sum(map(self.weight_of.__getitem__, self.weight_of.keys() & words))
        return float(known + self.rest @ _standard(numbers, self.mean, self.scale) + self.bias)


def _standard(numbers: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Numbers in standard deviations, within three, so that odd texts don't reach beyond what was learned."""
    return np.clip((numbers - mean) / scale, -3, 3)


def _numbered(docs: list[list[str]]) -> tuple[list[str], list[np.ndarray]]:
    """All words and stems, and the place of each document's in that list."""
    at: dict[str, int] = {}
    rows = [np.array([at.setdefault(w, len(at)) for w in sorted(with_stems(set(words)))], np.int64) for words in docs]
    return list(at), rows


def _choose_words(docs: list[np.ndarray], names: list[str], y: np.ndarray, weight: np.ndarray, features: int) -> list[int]:
    """The words whose document frequency differs most between the classes, in standard errors."""
    sizes, every = [len(d) for d in docs], np.concatenate(docs)
    label, each = np.repeat(y, sizes), np.repeat(weight, sizes)
    seen = np.bincount(every, minlength=len(names))
    total = [weight[y == k].sum() for k in (0, 1)]
    q, p = (np.bincount(every[label == k], each[label == k], len(names)) / total[k] for k in (0, 1))
    error = np.sqrt((np.maximum(p * (1 - p), 0) + 0.25 / total[1]) / total[1] + (np.maximum(q * (1 - q), 0) + 0.25 / total[0]) / total[0])
    able = np.flatnonzero((seen >= LEAST_DOCUMENTS) & (np.abs(p - q) >= LEAST_SCORE * error))
    score = np.abs(p - q) / error
    return sorted(able.tolist(), key=lambda i: (-score[i], names[i]))[:features]


def _table(docs: list[np.ndarray], chosen: list[int], numbers: np.ndarray, mean: np.ndarray, scale: np.ndarray, size: int) -> np.ndarray:
    """A row for each document: presence of the chosen words, standardised numbers, one."""
    at = np.full(size, -1)
    at[chosen] = np.arange(len(chosen))
    x = np.zeros((len(docs), len(chosen) + numbers.shape[1] + 1))
    for row, found in enumerate(docs):
        places = at[found]
        x[row, places[places >= 0]] = 1
    x[:, len(chosen) : -1] = _standard(numbers, mean, scale)
    x[:, -1] = 1
    return x


def train(
    docs: list[np.ndarray], names: list[str], numbers: np.ndarray, y: np.ndarray, weight: np.ndarray, features: int = FEATURES
) -> tuple[Linear, list[int]]:
    """Ridge logistic regression by Newton steps, and the places of its words; one class only gives that class."""
    mean, scale = numbers.mean(axis=0), np.where(numbers.std(axis=0) > 1e-9, numbers.std(axis=0), 1.0)
    if len(set(y.tolist())) < 2:
        return Linear([], np.zeros(numbers.shape[1]), mean, scale, 8.0 if y.any() else -8.0), []
    chosen = _choose_words(docs, names, y, weight, features)
    x = _table(docs, chosen, numbers, mean, scale, len(names))
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-6
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * beta
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        move = np.linalg.solve(curve, slope)
        beta -= move
        if np.abs(move).max() < 1e-6:
            break
    return Linear([names[i] for i in chosen], beta[:-1], mean, scale, float(beta[-1])), chosen


@dataclass
class Chain:
    categories: list[str]
    models: list[Linear]

    def predict(self, text: str | None) -> list[float]:
        """Probability of each category; all zero for a text without words."""
        found = describe(text)
        if found is None:
            return [0.0] * len(self.models)
        words, numbers = with_stems(found[0]), found[1]
        odds: list[float] = []
        for model in self.models:
            odds.append(model.log_odds(words, np.concatenate([numbers, np.clip(odds, -8, 8)])))
        return (1 / (1 + np.exp(-np.clip(odds, -30, 30)))).tolist()


def fit_chain(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    per_labels: int = 1000,
    features: int = FEATURES,
) -> Chain:
    """Fits the chain on at most ``per_labels`` rows of each combination of labels.

    That bound keeps the fit in the driver small; rows are taken by the hash of their id and weighted
    back to the counts of all labelled rows. Labels with a null are not used; of several labels of
    one document the largest of each category counts.
    """
    names = list(categories)
    one_each = (
        labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
        .agg(*[F.max(F.col(c).cast("int")).alias(f"y{i}") for i, c in enumerate(names)])
        .withColumn("labels", F.array(*[F.col(f"y{i}") for i in range(len(names))]))
        .where(~F.exists("labels", lambda y: y.isNull()))
        .select("id", F.transform("labels", lambda y: (y > 0).cast("int")).alias("labels"))
    )
    order = Window.partitionBy("labels").orderBy(F.xxhash64("id"), "id")
    taken = one_each.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_labels).select("id", "labels")
    counts = {tuple(r.labels): r.n for r in one_each.groupBy("labels").agg(F.count(F.lit(1)).alias("n")).collect()}

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, given, text in zip(batch["id"], batch["labels"], batch["text"]):
                found = describe(text)
                if found is not None:
                    out.append((key, list(given), " ".join(sorted(found[0])), found[1].tolist()))
            yield pd.DataFrame(out, columns=["id", "labels", "words", "numbers"])

    # at most per_labels rows for each combination: small whatever the data
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(taken), "id")
    kind = texts.schema["id"].dataType.simpleString()
    sample = texts.mapInPandas(described, f"id {kind}, labels array<int>, words string, numbers array<double>").toPandas()
    if not len(sample):
        return Chain(names, [Linear([], np.zeros(STATISTICS + i), np.zeros(STATISTICS + i), np.ones(STATISTICS + i), -8.0) for i in range(len(names))])
    sample = sample.sort_values(["id", "words"], ignore_index=True)
    vocabulary, words = _numbered([w.split(" ") for w in sample["words"]])
    numbers = np.array(sample["numbers"].tolist(), float)
    y = np.array(sample["labels"].tolist(), int).reshape(len(sample), len(names))
    each = Counter(map(tuple, y.tolist()))
    weight = np.array([counts[tuple(row)] / each[tuple(row)] for row in y.tolist()])
    weight *= len(weight) / weight.sum()
    fold = np.arange(len(sample)) % FOLDS
    models = []
    for i in range(len(names)):
        models.append(train(words, vocabulary, numbers, y[:, i], weight, features)[0])
        unseen = np.zeros(len(sample))
        for f in range(FOLDS if i + 1 < len(names) else 0):
            learn = np.flatnonzero(fold != f)
            if not len(learn):
                continue
            part, chosen = train([words[j] for j in learn], vocabulary, numbers[learn], y[learn, i], weight[learn], features)
            rest = np.flatnonzero(fold == f)
            x = _table([words[j] for j in rest], chosen, numbers[rest], part.mean, part.scale, len(vocabulary))
            unseen[rest] = x @ np.append(part.weights, part.bias)
        numbers = np.column_stack([numbers, np.clip(unseen, -8, 8)])
    return Chain(names, models)


def classify(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, p_<category> ..) for every row's whole text; null texts and such without words get 0."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # a few hundred weights for each category
    schema = ", ".join(f"p{i} double" for i in range(len(chain.categories)))

    @F.pandas_udf(schema)
    def predict(texts: pd.Series) -> pd.DataFrame:
        columns = [f"p{i}" for i in range(len(shared.value.categories))]
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=columns, dtype="float64")

    rows = docs.select(F.col(id_col), predict(F.col(text_col).cast("string")).alias("_p"))
    return rows.select(id_col, *[F.col(f"_p.p{i}").alias(f"p_{c}") for i, c in enumerate(chain.categories)])


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    chain = fit_chain(docs, table(spark, folder, "labels"), ["quality", "toxic"])
    return classify(docs, chain).withColumn("toxic", F.col("p_toxic") >= 0.5)
