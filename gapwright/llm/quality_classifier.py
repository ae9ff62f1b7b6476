"""Quality scores by Bradley-Terry ranking: a document's worth is linear in its features; a pair of a good and a bad
document adds logistic loss on the difference of their features; the cut is a quantile of the training scores.

Features are of form, not of vocabulary: character classes, repeats of words, pairs and lines, lengths. They are made
over whole texts in Arrow batches. Weights (a few dozen numbers) go to the executors with the task. Training takes at
most ``rows`` labelled documents, the first by a hash of their id, and ``pairs`` pairs for each good document.

Defined results: a null or empty text has all features 0 and gets their score; a label that is null, or whose document
is missing, isn't learnt from; several labels of one id are separate examples; without labels of both kinds every
weight is 0 and every document scores 0.7 (kept); rows are scored alone, so repeated rows and ties get equal scores;
an empty table gives no rows; other columns are kept, those with an added column's name are replaced.
"""

from __future__ import annotations

import functools
import operator
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_columns_from_text

TRAIN_ROWS, PAIRS, BLOCK, RIDGE, ACCEPT = 20_000, 16, 16_384, 1e-2, 0.7
#: Bytes of a text that a model learns from; with the rows of a sample this bounds what the driver gets. All texts are scored.
TRAIN_TEXT = 1 << 15
#: Names of the classes of characters, as unicodedata's categories give them.
UPPER, LOWER, OTHER_LETTER, DIGIT, SPACE, STOP, BANG, SYMBOL, REST = range(9)


@functools.cache
def char_classes() -> np.ndarray:
    """Class of each code point of the basic plane; others count as REST."""

    def one(c: str) -> int:
        kind = unicodedata.category(c)
        if kind[0] == "L":
            return {"Lu": UPPER, "Lt": UPPER, "Ll": LOWER}.get(kind, OTHER_LETTER)
        if kind[0] == "N":
            return DIGIT
        if c.isspace():
            return SPACE
        if c in "!?":
            return BANG
        if c in ".,;:'\"()-":
            return STOP
        return SYMBOL if kind[0] in "PS" else REST

    return np.array([one(chr(i)) for i in range(1 << 16)], np.uint8)


def raw_features(text: str) -> list[float]:
    """Shares in 0..1 where the name has a share, else logarithms."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.bincount(char_classes()[np.minimum(code, 0xFFFF)], minlength=9)
    words = text.split()
    w = max(len(words), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    letters, solid = max(n[UPPER] + n[LOWER] + n[OTHER_LETTER], 1), max(len(code) - n[SPACE], 1)
    distinct = len(set(words))
    return [
        n[UPPER] / letters, n[DIGIT] / solid, n[STOP] / solid, n[BANG] / solid, n[SYMBOL] / solid, n[REST] / solid,
        (n[UPPER] + n[LOWER] + n[OTHER_LETTER]) / solid,
        sum(map(operator.eq, words, words[1:])) / w,  # a word after itself
        1 - len(set(zip(words, words[1:]))) / max(w - 1, 1) if len(words) > 1 else 0.0,  # repeated pairs
        1 - distinct / w if words else 0.0,
        1 - len(set(lines)) / max(len(lines), 1) if lines else 0.0,
        float(np.log1p(len(words))), float(np.log1p(len(lines))), float(np.log1p(solid / w)),
    ]


SHARES = 11
EDGES = (0.01, 0.05, 0.15, 0.3, 0.5)


def expand(raw: np.ndarray) -> np.ndarray:
    """The features of the model: raw ones, and for each share how far it is past some edges."""
    shares = raw[:, :SHARES]
    return np.concatenate([raw, np.sqrt(shares)] + [np.clip((shares - e) / 0.1, 0, 1) for e in EDGES], axis=1)


@dataclass(frozen=True)
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float

    def worth(self, raw: np.ndarray) -> np.ndarray:
        return ((expand(raw) - self.mean) / self.scale) @ self.weights

    def score(self, raw: np.ndarray) -> np.ndarray:
        """0 to 1, ACCEPT at the cut."""
        z = (self.worth(raw) - self.cut) / self.spread + np.log(ACCEPT / (1 - ACCEPT))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_pairs(raw: np.ndarray, label: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, seed: int = 7) -> Ranking:
    """Newton's method for the logistic loss of preference pairs, then the quantile that parts the labels best."""
    x = expand(raw) if len(raw) else np.zeros((0, raw.shape[1] + SHARES * (1 + len(EDGES))))
    mean, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    scale = np.where(scale > 1e-9, scale, 1.0)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    weights = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return Ranking(mean, scale, weights, 0.0, 1.0)
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    most = max(len(good), len(bad))
    left, right = np.resize(rng.permutation(good), most * pairs), np.concatenate([rng.permutation(np.resize(bad, most)) for _ in range(pairs)])
    for _ in range(25):
        slope, curve = -ridge * weights, ridge * np.eye(len(weights))
        for at in range(0, len(left), BLOCK):  # a block of pairs at a time: the differences of all would fill the driver
            d = z[left[at : at + BLOCK]] - z[right[at : at + BLOCK]]
            p = 1 / (1 + np.exp(np.clip(d @ weights, -50, 50)))  # the chance that the pair is lost
            slope = slope + d.T @ p / len(left)
            curve = curve + (d * (p * (1 - p))[:, None]).T @ d / len(left)
        step = np.linalg.solve(curve, slope)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    worth = z @ weights
    # Cuts between neighbours in the order of scores; the error of a cut weighs both labels alike.
    order = np.argsort(worth, kind="stable")
    ranked, hit = worth[order], label[order] == 1
    lost_good = np.concatenate([[0], np.cumsum(hit)]) / len(good)
    kept_bad = (len(bad) - np.concatenate([[0], np.cumsum(~hit)])) / len(bad)
    error = lost_good + kept_bad
    best = np.flatnonzero(error <= error.min() + 1e-12)
    # The cut is the score quantile below which the training rows have the fewest errors: between two ranks, their middle.
    quantile = best[len(best) // 2] / len(ranked)
    return Ranking(mean, scale, weights, float(np.quantile(worth, quantile, method="hazen")), max(float(worth.std()), 1e-6))


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, fold: Column | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of ``rows`` labelled documents at most, the first by a hash of the id, of texts up to TRAIN_TEXT
    bytes. ``fold`` is over doc_id. The ids are chosen first, so only that bounded table meets the documents, by a
    broadcast; rows that share an id and a label are one example, with the smallest text."""
    held = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    held = held if fold is None else held.where(fold)
    chosen = held.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.octet_length("text") <= TRAIN_TEXT)
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def _features(texts: list[str]) -> list:
    return [[raw_features(t) for t in texts]]


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = TRAIN_ROWS, fold: Column | None = None) -> Ranking:
    sample = training_sample(docs, labels, label_col, rows, fold)
    made = with_columns_from_text(sample, "text", [("features", T.ArrayType(T.DoubleType()), pa.list_(pa.float64()))], lambda: _features)
    got = sorted(made.select("doc_id", "label", "features").collect())  # bounded by ``rows``, and sorted: the fit is the same each time
    raw = np.array([r.features for r in got]).reshape(len(got), len(raw_features("")))
    return fit_pairs(raw, np.array([r.label for r in got]))


def score(df: DataFrame, model: Ranking, text_col: str = "text", out: str = "score") -> DataFrame:
    def make():
        return lambda texts: [model.score(np.array([raw_features(t) for t in texts]))]

    return with_columns_from_text(df, text_col, [(out, T.DoubleType(), pa.float64())], make)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts == part


def classifier_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels, fold=~held_out(F.col("doc_id"), 4, 2))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
