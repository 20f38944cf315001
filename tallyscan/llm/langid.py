"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of hashed letter n-grams (one to three letters, words set
apart by one blank). Every language has several centroids, found by spherical k-means. The
language of the nearest centroid by cosine wins; a text too far from every centroid is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyscan.llm.common import stored, table, unused

DIMENSIONS = 1 << 14
PIECE = 1 << 20
FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def count_ngrams(text: str | None, dimensions: int = DIMENSIONS) -> np.ndarray | None:
    """Counts of the hashed n-grams of the whole text, any run of other characters as one blank; None without a letter."""
    counts = np.zeros(dimensions, np.float64)
    seen = False
    before = np.empty(0, np.uint32)
    for at in range(0, len(text or ""), PIECE):  # bounds the arrays; n-grams run on over the pieces
        codes = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = _letters()[codes]
        seen = seen or bool(is_letter.any())
        codes = np.concatenate([before, np.where(is_letter, codes, np.uint32(32))])
        blank = codes == 32
        codes = codes[~np.concatenate([[False], blank[1:] & blank[:-1]])]
        hashed = np.zeros(len(codes), np.uint32)
        for n in range(3):
            hashed = hashed[: max(len(codes) - n, 0)] + codes[n:] * FACTORS[n]
            mixed = hashed ^ hashed >> np.uint32(15)
            mixed = (mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - dimensions.bit_length() + 1)
            counts += np.bincount(mixed[max(len(before) - n, 0) :], minlength=dimensions)
        before = codes[-2:]
    return counts if seen else None


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    vector = np.log1p(counts) * idf
    length = np.sqrt(vector @ vector)
    return (vector / length if length else vector).astype(np.float32)


@dataclass
class Model:
    """Centroids with unit length, a row each, with their language and the least cosine that is not rejected."""

    languages: list[str]
    centroids: np.ndarray
    least: np.ndarray
    idf: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        counts = count_ngrams(text, len(self.idf))
        if counts is None or not self.languages:
            return UNKNOWN, 0.0, True
        cosine = self.centroids @ tf_idf(counts, self.idf)
        best = int(np.argmax(cosine))
        return self.languages[best], float(min(max(cosine[best], 0.0), 1.0)), bool(cosine[best] < self.least[best])


def _clusters(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centroids are the mean's farthest points in turn."""
    centroids = [vectors.mean(axis=0)]
    nearest = vectors @ centroids[0]
    for _ in range(min(k, len(vectors)) - 1):
        centroids.append(vectors[int(np.argmin(nearest))])
        nearest = np.maximum(nearest, vectors @ centroids[-1])
    centroids = _unit(np.array(centroids))
    for _ in range(rounds):
        owner = np.argmax(vectors @ centroids.T, axis=1)
        means = [vectors[owner == i].mean(axis=0) if (owner == i).any() else c for i, c in enumerate(centroids)]
        centroids = _unit(np.array(means))
    return centroids


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length == 0, 1, length)


def document_frequencies(rows: DataFrame, dimensions: int = DIMENSIONS) -> tuple[int, np.ndarray]:
    """Number of texts with n-grams, and for each bucket the number of those that have it, over all ``rows(text)``."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, seen = 0, np.zeros(dimensions, np.int64)
        for batch in batches:
            for text in batch["text"]:
                counts = count_ngrams(text, dimensions)
                if counts is not None:
                    n += 1
                    seen[np.flatnonzero(counts)] += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"at": np.append(at, -1).astype(np.int32), "n": np.append(seen[at], n)})

    total = rows.select("text").mapInPandas(counted, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    seen, real = np.zeros(dimensions), total["at"] >= 0
    seen[total["at"][real]] = total["n"][real]
    return int(total["n"][~real].sum()), seen


def fit(
    docs: DataFrame,
    may_learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 400,
    centroids: int = 3,
    reject: float = 0.3,
    dimensions: int = DIMENSIONS,
) -> Model:
    """Fits centroids on at most ``per_language`` labelled rows of each language.

    Document frequencies are counted over all labelled rows, the bound is for the centroids.
    That bound is what keeps the fit in the driver small; the rows taken are those with the least
    hash of their id, whatever the order of the table. A text is rejected if its cosine with the
    nearest centroid is below ``reject`` times what all but one in a hundred of the learned texts
    of that language reach.
    """
    rows = docs.where(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")
    )
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    first = lambda r: r.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).drop("n")
    # ids are chosen first, so that texts travel for the chosen rows alone
    chosen = stored(first(rows.select("lang", "id")).distinct(), "langid-chosen")
    one, other = rows.alias("r"), chosen.alias("c")
    taken = one.join(other, (F.col("r.lang") == F.col("c.lang")) & F.col("r.id").eqNullSafe(F.col("c.id")), "left_semi")
    taken = first(taken).select("lang", "text")  # ids may repeat

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for lang, text in zip(batch["lang"], batch["text"]):
                counts = count_ngrams(text, dimensions)
                if counts is not None:
                    at = np.flatnonzero(counts)
                    out.append((lang, at.astype(np.int32), counts[at].astype(np.float32)))
            yield pd.DataFrame(out, columns=["lang", "at", "counts"])

    sample = taken.mapInPandas(counted, "lang string, at array<int>, counts array<float>").toPandas()
    n, seen = document_frequencies(rows, dimensions)
    idf = np.log((1 + n) / (1 + seen)) + 1
    languages, all_centroids, least = [], [], []
    for lang, part in sorted(sample.groupby("lang"), key=lambda p: p[0]):
        vectors = np.zeros((len(part), dimensions), np.float32)
        for row, (at, counts) in enumerate(zip(part["at"], part["counts"])):
            dense = np.zeros(dimensions)
            dense[np.asarray(at)] = counts
            vectors[row] = tf_idf(dense, idf)
        found = _clusters(vectors, centroids).astype(np.float32)
        reached = (vectors @ found.T).max(axis=1)
        languages += [lang] * len(found)
        all_centroids.append(found)
        least += [reject * float(np.quantile(reached, 0.01))] * len(found)
    stacked = np.concatenate(all_centroids) if all_centroids else np.zeros((0, dimensions), np.float32)
    return Model(languages, stacked, np.array(least), idf)


def identify(docs: DataFrame, model: Model, text_col: str = "text", name: str = "_lang") -> DataFrame:
    """``docs`` with a struct ``name(pred, score, rejected)``: the language of each whole text.

    A null text or one without a letter is ``und`` with score 0 and rejected. Only the text is
    read; repeated rows get equal results.
    """
    schema = "pred string, score double, rejected boolean"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x centroids x dimensions, whatever the data

    @F.pandas_udf(schema)
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["pred", "score", "rejected"])

    return docs.withColumn(name, predict(F.col(text_col).cast("string")))


def fold(id_col: str = "doc_id", folds: int = 3) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % folds


def langid(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, held_out, lang_pred, score, rejected) for every row.

    Learns from rows whose fold is not 1; a row without an id has no fold, is not learned from and
    not held out. With nothing to learn from every row is ``und``.
    """
    model = fit(docs, fold(id_col) != 1, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    return identify(rows, model, "_text").select(
        id_col,
        F.coalesce(fold(id_col) == 1, F.lit(False)).alias("held_out"),
        F.col("_lang.pred").alias("lang_pred"),
        F.col("_lang.score").alias("score"),
        F.col("_lang.rejected").alias("rejected"),
    )


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is known, all columns kept."""
    model = fit(docs, fold(id_col) != 1, id_col, text_col, lang_col)
    name = unused("_lang", docs.columns)
    return identify(docs, model, text_col, name).where(~F.col(name)["rejected"]).select(docs.columns)


def op8_langid(spark: SparkSession, folder: str) -> DataFrame:
    return langid(table(spark, folder, "documents"))
