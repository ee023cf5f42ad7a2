"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade > k) = sigmoid(w . x - threshold_k): one weight vector over hashed text features, shared by all grades, and
ordered thresholds. Features are the hashed word, its shape and its ending, averaged over the words of the whole text,
and a few hashed measures of the document (repetition, length). Fitted in numpy on a sample of at most `sample_size`
rated documents (those with the lowest id hashes) and `sample_chars` characters; every document is scored.

Defined results: a null or empty text has no word features and is scored by the rest; with no rated document, or one
grade only, the expected grade is that grade (0 if none) for every document; rows that share an id are scored each for
itself, and a rating counts once per id; a null rating or id is not learned from; extra columns are ignored by
score_documents and passed on by keep_documents; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillworks.llm import common
from quillworks.llm.common import give_back, received, send, worker_cache

common.ship(__name__)

BUCKETS = 1 << 18
#: Characters of the longest word whose weight a worker keeps.
LONGEST = 64
#: The bound of the sample of rated documents that the model is fitted on.
SAMPLE_SIZE = 8_000
#: The bound of their texts together.
SAMPLE_CHARS = 64_000_000
_SHAPES = ((re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "X"), (re.compile(r"[^\W\d_X]+"), "x"), (re.compile(r"\d+"), "9"), (re.compile(r"(.)\1+"), r"\1\1"))


def bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % BUCKETS


def shape(word: str) -> str:
    """A word with its letters and digits replaced by their kind, runs shortened: `Then,` gives `Xx,`."""
    for pattern, kind in _SHAPES:
        word = pattern.sub(kind, word)
    return word[:12]


def word_buckets(word: str) -> tuple[int, int, int]:
    return bucket("w " + word), bucket("s " + shape(word)), bucket("e " + word[-3:])


def document_buckets(text: str, words: list[str]) -> list[int]:
    """Hashed measures of the whole document: share of distinct words, of distinct lines, length."""
    n = len(words)
    if not n:
        return [bucket("d empty")]
    lines = text.split("\n")
    return [bucket(f"d words {10 * len(set(words)) // n} {min(n.bit_length(), 8)}"), bucket(f"d lines {5 * len(set(lines)) // len(lines)}"), bucket(f"d length {n.bit_length()}")]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text; values of the words' features add up to 1 a kind."""
    words = text.split()
    found: dict[int, float] = {}
    for word in words:
        for b in word_buckets(word):
            found[b] = found.get(b, 0.0) + 1 / len(words)
    for b in document_buckets(text, words):
        found[b] = found.get(b, 0.0) + 1.0
    return np.fromiter(found, dtype=np.int32, count=len(found)), np.fromiter(found.values(), dtype=np.float32, count=len(found))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    grades: list[int]

    def tails(self, eta: np.ndarray) -> np.ndarray:
        """P(grade above the k-th), a column per threshold."""
        return sigmoid(eta[:, None] - self.thresholds[None, :])

    def expected(self, eta: np.ndarray) -> np.ndarray:
        """Sum over the grades of their probability times the grade."""
        return self.grades[0] + self.tails(eta) @ np.diff(self.grades)


def fit_ordinal(rows: list[tuple[int, np.ndarray, np.ndarray]], steps: int = 150, rate: float = 0.3, decay: float = 1e-4) -> OrdinalModel:
    """Maximum likelihood by Adam on all sampled rows at once. rows: grade, buckets, values."""
    grades = sorted({g for g, _, _ in rows})
    if len(grades) < 2:
        return OrdinalModel(np.zeros(BUCKETS, dtype=np.float32), np.zeros(0), grades or [0])
    # parts of 500 rows: places, buckets and values; temporary arrays stay small
    parts = []
    for at in range(0, len(rows), 500):
        own = rows[at : at + 500]
        parts.append((at, len(own), np.repeat(np.arange(len(own), dtype=np.int32), [len(b) for _, b, _ in own]), np.concatenate([b for _, b, _ in own]).astype(np.int32), np.concatenate([v for _, _, v in own]).astype(np.float32)))
    above = np.array([[g > k for k in grades[:-1]] for g, _, _ in rows], dtype=np.float64)
    share = np.clip(above.mean(axis=0), 1e-3, 1 - 1e-3)
    # the first threshold, and the logarithms of the steps from it to the next ones: these keep the order
    start = np.log((1 - share) / share)
    par = np.concatenate([np.zeros(BUCKETS), start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    n, k = len(rows), len(grades) - 1
    m, v = np.zeros_like(par), np.zeros_like(par)
    for step in range(1, steps + 1):
        w, theta = par[:BUCKETS], np.cumsum(np.concatenate([par[BUCKETS : BUCKETS + 1], np.exp(par[BUCKETS + 1 :])]))
        eta = np.concatenate([np.bincount(doc, weights=val * w[col], minlength=size) for _, size, doc, col, val in parts])
        tail = np.hstack([np.ones((n, 1)), sigmoid(eta[:, None] - theta[None, :]), np.zeros((n, 1))])
        grade = above.sum(axis=1).astype(int)
        each = np.arange(n)
        p = np.maximum(tail[each, grade] - tail[each, grade + 1], 1e-12)
        slope = tail * (1 - tail)
        d_eta = (slope[each, grade + 1] - slope[each, grade]) / p / n  # of minus the log-likelihood
        d_theta = np.zeros(k)
        np.add.at(d_theta, grade[grade > 0] - 1, (slope[each, grade] / p / n)[grade > 0])
        np.add.at(d_theta, grade[grade < k], -(slope[each, grade + 1] / p / n)[grade < k])
        back = np.cumsum(d_theta[::-1])[::-1]
        d_w = decay * w
        for at, size, doc, col, val in parts:
            d_w = d_w + np.bincount(col, weights=val * d_eta[at : at + size][doc], minlength=BUCKETS)
        g = np.concatenate([d_w, back[:1], back[1:] * np.exp(par[BUCKETS + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        par = par - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return OrdinalModel(par[:BUCKETS].astype(np.float32), np.cumsum(np.concatenate([par[BUCKETS : BUCKETS + 1], np.exp(par[BUCKETS + 1 :])])), grades)


def fit(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", sample_size: int = SAMPLE_SIZE, sample_chars: int = SAMPLE_CHARS) -> OrdinalModel:
    """Fit on at most sample_size rated documents and sample_chars characters; features, not texts, come to the driver.

    Texts of over a 64th of sample_chars are not learned from.
    """

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [features(t or "") for t in batch["text"]]
            yield pd.DataFrame({"key": batch["key"], "grade": batch["grade"], "buckets": [b.astype("<i4").tobytes() for b, _ in found], "values": [v.astype("<f4").tobytes() for _, v in found]})

    rated = ratings.select(F.col(id_col).alias("rated_id"), F.col(grade_col).cast("int").alias("grade")).where("grade is not null")
    sample = common.bounded_sample(rated, "rated_id", ["grade"], sample_size)
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(F.broadcast(sample), F.col("doc") == F.col("sample_id"))
    rows, n = common.within_chars(texts.select(F.xxhash64("doc", "text").alias("key"), "grade", "text"), ["key"], sample_size, sample_chars)
    found = rows.mapInPandas(extract, "key long, grade int, buckets binary, values binary").orderBy("key", "grade").limit(n).collect()
    return fit_ordinal([(r.grade, np.frombuffer(r.buckets, dtype="<i4"), np.frombuffer(r["values"], dtype="<f4")) for r in found])


class WordWeights(dict):
    """word -> the sum of its features' weights; a miss is worked out and, up to LONGEST characters, kept; up to `most` words."""

    def __init__(self, weights: np.ndarray, most: int = 200_000):
        super().__init__()
        self.weights, self.most = weights, most

    def __missing__(self, word: str) -> float:
        w = float(sum(self.weights[b] for b in word_buckets(word)))
        if len(word) <= LONGEST:
            if len(self) > self.most:
                self.clear()
            self[word] = w
        return w

    def eta(self, text: str) -> float:
        words = text.split()
        own = sum(float(self.weights[b]) for b in document_buckets(text, words))
        return own + (sum(map(self.__getitem__, words)) / len(words) if words else 0.0)


def scorer(spark: SparkSession, model: OrdinalModel):
    """A pandas UDF: text -> struct(expected_grade, tails)."""
    sent, label = send(spark, model), hash(model.weights.tobytes()) ^ hash(model.thresholds.tobytes())

    @F.pandas_udf("struct<expected_grade double, tails array<double>>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = received(sent)
        words = worker_cache(("quality weights", label), lambda: WordWeights(model.weights))
        for texts in batches:
            eta = np.array([words.eta(t or "") for t in texts], dtype=np.float64)
            yield pd.DataFrame({"expected_grade": model.expected(eta), "tails": list(model.tails(eta))})
            del texts
            give_back()
        give_back()

    return score


def tail_column(scored: Column, model: OrdinalModel, least_grade: int) -> Column:
    """P(grade >= least_grade)."""
    k = sum(g < least_grade for g in model.grades)
    if k == 0:
        return F.lit(1.0)
    return F.get(scored["tails"], k - 1) if k < len(model.grades) else F.lit(0.0)


def score_documents(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", least_grade: int = 1, least_tail: float = 0.5) -> DataFrame:
    """One row per document: id, expected_grade, tail (P(grade >= least_grade)), selected (tail >= least_tail)."""
    rows = docs.select(F.col(id_col), scorer(docs.sparkSession, model)(F.col(text_col)).alias("quality_score"))
    tail = tail_column(F.col("quality_score"), model, least_grade)
    return rows.select(id_col, F.col("quality_score.expected_grade").alias("expected_grade"), tail.alias("tail"), (tail >= least_tail).alias("selected"))


def keep_documents(docs: DataFrame, model: OrdinalModel, text_col: str = "text", least_grade: int = 1, least_tail: float = 0.5) -> DataFrame:
    """The documents, with all their columns, whose P(grade >= least_grade) reaches least_tail."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("quality_row"), scorer(docs.sparkSession, model)(F.col(text_col)).alias("quality_score"))
    return rows.where(tail_column(F.col("quality_score"), model, least_grade) >= least_tail).select("quality_row.*")


def graded(labels: DataFrame) -> DataFrame:
    """Graded ratings from the labels: 0 for low quality, 1 for good but toxic, 2 for good."""
    return labels.withColumn("grade", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, graded(common.table(spark, sf_dir, "labels"))))
