"""Operator 13: quality by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Words are runs without white space, A-Z lower-cased. Features are hashes of one and of two words in a row, of one to three
shapes in a row (a shape is the word with letters, capitals and digits each as one sign for a run, other signs as they
are), and of whether a word repeats the one before. A feature's value is its count over the number of words, so that long and short
texts compare. A score is one sparse dot product: the mean of the weights that a text's features look up.

Fitting takes at most SAMPLE labelled rows, those with the least hashes of their ids, on the driver (a bounded size, whatever
the corpus): each row updates the sums of its own features only, and a feature whose sum stays within L1 has weight 0.
Weights, a vector of fixed size, go to the tasks, which read whole texts.

Result for odd input: null and empty texts have no words and the score of the bias alone; labels that are null, not 0 or 1,
or whose doc_id is null or unknown aren't used; of labels that share a doc_id the greatest counts, of texts that do the least
is fitted on; without labels of both kinds the score is the share of label 1 (0.5 without any); repeated rows score alike; other columns pass through
unchanged, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointfold.llm.common import ODD, SPACE, in_batches, mixed, table, word_hashes
from pointfold.llm.toxicity import held_out

#: Bounds of what the driver fits on: rows, and characters of their texts (longer texts wait for the next fit).
SAMPLE, SAMPLE_TEXT = 12_000, 20_000
#: Weights; rounds over the sample; the usual four constants of the updates.
ROWS, EPOCHS, ALPHA, BETA, L1, L2 = 1 << 18, 6, 0.5, 0.05, 0.002, 0.0
THRESHOLD = 0.5

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Letters (all bytes beyond ASCII too), capitals and digits are one sign each.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("0")
_RUNS = np.zeros(256, bool)
_RUNS[[ord("a"), ord("A"), ord("0")]] = True


def features(text: str | None) -> tuple[np.ndarray, int]:
    """The weight that each n-gram of the text looks up, and the number of words."""
    buf = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    words = word_hashes(_FOLD[buf])
    if not len(words):
        return np.zeros(0, np.int64), 0
    shape = _SHAPE[buf]
    new = np.ones(len(shape), bool)
    new[1:] = (shape[1:] != shape[:-1]) | ~_RUNS[shape[1:]]
    shapes = word_hashes(shape[new])
    found = []
    for kind, (h, most) in enumerate(((words, 2), (shapes, 3))):
        gram = h
        for n in range(most):
            if n:
                gram = gram[:-1] * ODD[n] + h[n:]
            found.append(mixed(gram + ODD[8 + 4 * kind + n]))
    found.append(mixed((words[1:] == words[:-1]).astype(np.uint64) + ODD[20]))
    return (np.concatenate(found) % np.uint64(ROWS)).astype(np.int64), len(words)


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


class Regression:
    """Weights and bias; fit() also keeps the sums z and n of the updates, the bias last."""

    def __init__(self, weights: np.ndarray | None = None, bias: float = 0.0) -> None:
        self.weights, self.bias = np.zeros(ROWS, np.float32) if weights is None else weights, bias

    def lazy(self, at: np.ndarray) -> np.ndarray:
        """Weights of some features, from the sums."""
        z = self.z[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0, w)

    def fit(self, texts: list[tuple[np.ndarray, int]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> None:
        self.z, self.n = np.zeros(ROWS + 1), np.zeros(ROWS + 1)
        rows = []
        for at, size in texts:
            ids, count = np.unique(at, return_counts=True)
            rows.append((np.append(ids, ROWS), np.append(count / max(size, 1), 1.0)))
        r = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in r.permutation(len(rows)):
                at, x = rows[i]
                w = self.lazy(at)
                g = (sigmoid(float(w @ x)) - labels[i]) * x
                n = self.n[at]
                self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
                self.n[at] = n + g * g
        w = self.lazy(np.arange(ROWS + 1))
        self.weights, self.bias = w[:-1].astype(np.float32), float(w[-1])

    def score(self, at: np.ndarray, size: int) -> float:
        return sigmoid(float(self.weights[at].sum(dtype=np.float64)) / max(size, 1) + self.bias)


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id and quality of the labelled rows to learn from, one for each doc_id; never a held-out row."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return known.where(~held_out("doc_id"))


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> list:
    """Rows to fit on: (text, quality), at most `most`, in the labels' own shares. Ordered by a hash of doc_id, so reruns agree; only a bounded number of ids is taken before texts are looked up, and of each one text."""
    ids = labelled(labels).withColumn("by", F.xxhash64("doc_id")).orderBy("by", "doc_id").limit(most)
    texts = docs.where(F.length("text") <= SAMPLE_TEXT).select("doc_id", "text")
    rows = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality", "by").agg(F.min("text").alias("text"))
    return sorted(rows.select("text", "quality", "by", "doc_id").collect(), key=lambda r: (r.by, r.doc_id))


def fitted(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Regression:
    rows = sample(docs, labels, most)
    model = Regression()
    y = np.array([r.quality for r in rows], float)
    if len(y) and y.min() < y.max():
        model.fit([features(r.text) for r in rows], y)
    elif len(y):
        model.bias = 30.0 if y[0] else -30.0
    return model


def scored(docs: DataFrame, model: Regression, keep: list[str]) -> DataFrame:
    """row (a struct of the columns `keep` of docs) and score, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # fixed size: ROWS

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Regression(*shared.value)
        for b in batches:
            s = [m.score(*features(t.as_py())) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(s, pa.float64())], names=["row", "score"])

    rows = docs.select(F.struct(*keep).alias("row"), "text")
    return in_batches(rows, scan, f"row {rows.schema['row'].dataType.simpleString()}, score double")


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, fitted(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    held = F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out")
    return out.select("row.doc_id", "score").select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
