"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, of pairs of neighbours, of pairs with one word between, and of
the stems of its words (their first 4, 5 and 6 characters, which inflected and compound forms share), after
lower-casing and with letters and digits alone. Every coordinate has its own learning rate; the L1 term keeps
all but a few weights at exactly 0, so a model is two short arrays that go out with the task, whatever the corpus.
Training takes at most ``rows`` labelled documents, the first by a hash of their id.

Defined results: a null or empty text has no features and its score is that of the bias; a label that is null, or whose
document is missing, isn't learnt from; without labels every score is 0.5 (not toxic); rows are scored alone, so
repeated rows and ties get equal scores; an empty table gives no rows; other columns are kept, those with an added
column's name are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, mix, with_columns_from_text
from .quality_classifier import held_out, training_sample

BITS, TRAIN_ROWS, EPOCHS, ACCEPT = 20, 8_000, 4, 0.7
ALPHA, BETA, L1, L2 = 0.3, 1.0, 3.0, 0.1
STEMS = (4, 5, 6)
_WORD = re.compile(r"[^\W_]+")


class WordTable(dict):
    """Word -> its row in ``rows``: the hash of the word and those of its stems (0: it is no longer than the stem).
    Bounded: emptied before it would hold over ``most`` words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most, self.hashes = most, WordHashes(most)
        self.rows, self.new = np.zeros((1024, 1 + len(STEMS)), np.uint64), []

    def __missing__(self, word):
        self[word] = at = len(self)
        self.new.append([self.hashes[word.encode()]] + [self.hashes[f"{n}:{word[:n]}".encode()] if len(word) > n else 0 for n in STEMS])
        return at

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) + len(words) > self.most:
            self.clear()
        old = len(self)
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            while len(self) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[old : len(self)] = np.array(self.new, np.uint64)
            self.new = []
        return self.rows[at]


def grams(text: str, table: WordTable, bits: int = BITS) -> np.ndarray:
    """Buckets of all words, pairs, skip pairs and stems of a text (repeats included)."""
    rows = table.of(_WORD.findall(text.lower()))
    h, stems = rows[:, 0], rows[:, 1:].ravel()
    pair = lambda a, b, salt: mix(a * np.uint64(0x9E3779B97F4A7C15) + b + np.uint64(salt))
    parts = [mix(h), pair(h[:-1], h[1:], 1), pair(h[:-2], h[2:], 2), mix(stems[stems != 0])]
    return (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass(frozen=True)
class SparseModel:
    """bias, and the buckets whose weight isn't 0."""

    bias: float
    buckets: np.ndarray
    weights: np.ndarray
    bits: int = BITS
    shift: float = 0.0

    def scorer(self):
        dense = np.zeros(1 << self.bits)
        dense[self.buckets] = self.weights
        table = WordTable()

        def margin(text: str) -> float:
            at = grams(text, table, self.bits)
            return self.bias + float(dense[np.unique(at[dense[at] != 0])].sum())

        return lambda texts: [1 / (1 + np.exp(-np.clip([margin(t) + self.shift for t in texts], -50, 50)))]


def fit_ftrl(examples: list[np.ndarray], label: np.ndarray, bits: int = BITS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, seed: int = 7) -> SparseModel:
    """examples: distinct buckets of each document. Bucket 1 << bits is the bias, which L1 leaves alone."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    rng = np.random.default_rng(seed)

    def weights(at: np.ndarray) -> np.ndarray:
        keep = np.where(at == size - 1, 0.0, l1)
        return np.where(np.abs(z[at]) <= keep, 0.0, -(z[at] - np.sign(z[at]) * keep) / ((beta + np.sqrt(n[at])) / alpha + l2))

    margins = np.zeros(len(examples))
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            at = np.append(examples[k], size - 1)
            w = weights(at)
            margins[k] = w.sum()
            g = 1 / (1 + np.exp(-np.clip(margins[k], -50, 50))) - label[k]
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - rate * w
            n[at] += g * g
    every = weights(np.arange(size))
    buckets = np.flatnonzero(every[:-1])
    return SparseModel(float(every[-1]), buckets, every[buckets], bits, cut_shift(margins, label, float(every[-1])))


def cut_shift(margins: np.ndarray, label: np.ndarray, bias: float) -> float:
    """What puts the best cut of the last pass's own predictions (made before each update) at ACCEPT: the middle of the
    cuts with the fewest errors, where a clean document that is flagged and a toxic one that is missed weigh alike. A text
    without any evidence has the margin ``bias``, and a cut goes above it where that costs no error."""
    if not len(label) or not label.any() or label.all():
        return 0.0
    order = np.argsort(margins, kind="stable")
    ranked, toxic = margins[order], label[order] == 1
    errors = np.concatenate([[0], np.cumsum(toxic)]) + (~toxic).sum() - np.concatenate([[0], np.cumsum(~toxic)])
    best = np.flatnonzero(errors[1:-1] == errors[1:-1].min()) + 1
    below, above = ranked[best - 1], ranked[best]
    cut = (np.where(above > bias, np.maximum(below, bias), below) + above) / 2
    return float(np.log(ACCEPT / (1 - ACCEPT)) - np.median(cut))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", rows: int = TRAIN_ROWS, fold: Column | None = None) -> SparseModel:
    sample = training_sample(docs, labels, label_col, rows, fold)

    def make():
        table = WordTable()
        return lambda texts: [[np.unique(grams(t, table)).astype("<u4").tobytes() for t in texts]]

    made = with_columns_from_text(sample, "text", [("buckets", T.BinaryType(), pa.binary())], make)
    # Bounded by ``rows``; Arrow columns, so that a document's buckets are held once.
    got = made.select("doc_id", "label", "buckets").toArrow().combine_chunks()
    order = sorted(range(got.num_rows), key=lambda k: (got["doc_id"][k].as_py(), got["label"][k].as_py(), got["buckets"][k].as_buffer().to_pybytes()[:64]))
    examples = [np.frombuffer(got["buckets"][k].as_buffer(), "<u4").astype(np.int32) for k in order]
    return fit_ftrl(examples, np.array([got["label"][k].as_py() for k in order], float))


def score(df: DataFrame, model: SparseModel, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    return with_columns_from_text(df, text_col, [(out, T.DoubleType(), pa.float64())], model.scorer)


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels, fold=~held_out(F.col("doc_id"), 3, 1))
    scored = score(docs.select("doc_id", "text"), model, out="score")
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
