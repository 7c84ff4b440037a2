"""Quality classifier: naive Bayes support vectors on byte n-grams.

The indicators of a text's 1- to 3-grams of bytes, and of the shapes of its words,
are scaled by the log ratio of their counts in the two classes, and a linear
hinge-loss model is fitted on the scaled indicators by dual coordinate descent. It
is fitted in one task on a sample of bounded rows and bounded bits; scoring is one
pass over all texts.
"""

from __future__ import annotations

import io
from functools import partial

import numpy as np

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelake.llm.common import remainder, short_batches
from ridelake.llm.samples import bits_of, gathered, labelled

#: Rows of each label the model is fitted on, at most.
SAMPLE_ROWS = 4000
#: Hashed features.
SIZE = 1 << 16
GRAMS = 3
SLICE = 1 << 20
#: Fit: share of the learned weights against their mean, bound of the duals, passes.
BETA, COST, PASSES = 0.25, 1.0, 12
FOLDS, HELD = 5, 0
THRESHOLD = 0.3


#: Multipliers of a word's bytes by their place, for telling equal neighbours.
_PLACES = np.random.default_rng(11).integers(1, 1 << 62, 64, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def _shapes(data: np.ndarray) -> np.ndarray:
    """One number per word: whether it repeats the word before, has capitals, digits, symbols, and its length in steps."""
    inside = data > 32
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    word = np.cumsum(np.bincount(starts, minlength=len(data))) - 1
    place = np.arange(len(data)) - starts[np.maximum(word, 0)]
    kinds = np.where(inside, data, 0)
    total = lambda x: np.add.reduceat(x, starts)
    same = total(kinds.astype(np.uint64) * _PLACES[place % 64])
    same = np.concatenate([[False], same[1:] == same[:-1]])
    capitals = total(((kinds >= 65) & (kinds <= 90)).astype(np.int64))
    digits = total(((kinds >= 48) & (kinds <= 57)).astype(np.int64))
    symbols = total((((kinds > 32) & (kinds < 48)) | ((kinds > 57) & (kinds < 65)) | ((kinds > 90) & (kinds < 97)) | ((kinds > 122) & (kinds < 128))).astype(np.int64))
    length = np.minimum(np.log2(total(inside.astype(np.int64))).astype(np.int64), 5)
    code = same + 2 * np.minimum(capitals, 2) + 6 * np.minimum(digits, 1) + 12 * np.minimum(symbols, 3) + 48 * length
    return code.astype(np.uint64)


def _mark(mark: np.ndarray, items: np.ndarray, seed: int) -> None:
    code = np.full(len(items), seed, dtype=np.uint64)
    for n in range(1, min(GRAMS, len(items)) + 1):
        code = code[: len(items) - n + 1] * np.uint64(1009) + items[n - 1 :] + np.uint64(1)
        mark[((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)] = True


def features(text: str | None) -> np.ndarray:
    """Hashed places of the text's n-grams of bytes and of word shapes, each once."""
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    mark = np.zeros(SIZE, dtype=bool)
    for start in range(0, len(data), SLICE):
        part = data[start : start + SLICE + GRAMS - 1]
        _mark(mark, part.astype(np.uint64), 0)
        _mark(mark, _shapes(part), 1)
    return np.flatnonzero(mark)


def _descend(rows: list[np.ndarray], sign: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Scales by class, weights of the scaled unit rows, and bias."""
    in_class = np.ones((2, SIZE))
    for p, s in zip(rows, sign):
        in_class[0 if s > 0 else 1, p] += 1  # a row's places are distinct
    ratio = np.log(in_class[0] / in_class[0].sum()) - np.log(in_class[1] / in_class[1].sum())
    # A row's scaled values are made when it is visited: kept for all rows they would be twice the sample.
    lengths = [max(np.sqrt((ratio[p] ** 2).sum()), 1e-12) for p in rows]
    n, good = len(rows), max((sign > 0).mean(), 1e-9)
    most = np.where(sign > 0, COST * 0.5 / good, COST * 0.5 / max(1 - good, 1e-9))
    weights, bias, duals, order = np.zeros(SIZE), 0.0, np.zeros(n), np.random.default_rng(7)
    for _ in range(PASSES):
        for i in order.permutation(n):
            p = rows[i]
            x = ratio[p] / lengths[i]
            gap = sign[i] * (weights[p] @ x + bias) - 1
            dual = min(max(duals[i] - gap / (x @ x + 1), 0.0), most[i])  # the bias is a feature that is always one
            if dual != duals[i]:
                step = (dual - duals[i]) * sign[i]
                weights[p] += step * x
                bias += step
                duals[i] = dual
    weights = (1 - BETA) * np.abs(weights).mean() * np.sign(weights) + BETA * weights
    return ratio, weights, BETA * bias


def _margin(places: np.ndarray, ratio: np.ndarray, weights: np.ndarray, bias: float) -> float:
    scale = ratio[places]
    return float((scale * weights[places]).sum() / max(np.sqrt((scale**2).sum()), 1e-12) + bias)


def fit(places: np.ndarray, starts: np.ndarray, labels: np.ndarray, odds: float = 1.0) -> bytes:
    """Direction, scales, bias and the sigmoid of the margin; ``odds`` are those of the sample's classes over all labels'.

    The sigmoid is fitted on margins of quarters that the weights have not seen.
    """
    rows, sign = [places[a:b] for a, b in zip(starts[:-1], starts[1:])], np.where(labels > 0, 1.0, -1.0)
    margins = np.zeros(len(rows))
    for part in range(4):
        seen = np.arange(len(rows)) % 4 != part
        if seen.any():
            model = _descend([p for p, s in zip(rows, seen) if s], sign[seen])
            margins[~seen] = [_margin(p, *model) for p, s in zip(rows, seen) if not s]
    slope, shift = sigmoid_fit(margins, labels)
    ratio, weights, bias = _descend(rows, sign)
    out = io.BytesIO()
    np.savez(out, direction=ratio * weights, square=ratio**2, line=np.array([bias, slope, shift - np.log(odds)]))
    return out.getvalue()


def sigmoid_fit(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid that gives the labels' probability, by Newton steps on smoothed targets."""
    up, down = (labels > 0).sum(), (labels <= 0).sum()
    target = np.where(labels > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([margins / max(np.abs(margins).max(), 1e-12), np.ones(len(margins))], axis=1)
    at = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * at)
        at += np.clip(step, -5, 5)
    return at[0] / max(np.abs(margins).max(), 1e-12), at[1]


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> bytes | None:
    """The model, fitted on at most ``rows`` documents of each label outside the held-out fold; None without any.

    With one class only every score is near that class's label.
    """
    short_batches(docs.sparkSession)
    sample, odds = labelled(docs, labels, "quality", FOLDS, HELD, rows)
    sample = sample.withColumn("key", F.xxhash64("doc_id"))
    return gathered(bits_of(sample, features, SIZE, "label"), partial(fit, odds=odds), "label")


def scorer(docs: DataFrame, model: bytes | None):
    """A column function text -> probability of good quality; 0.5 without a model."""
    parts = dict(np.load(io.BytesIO(model))) if model else None
    sent = docs.sparkSession.sparkContext.broadcast(parts)

    @F.pandas_udf("double")
    def score(texts):
        parts = sent.value
        if parts is None:
            return texts.map(lambda _: 0.5, na_action=None).astype(float)
        direction, square, (bias, slope, shift) = parts["direction"], parts["square"], parts["line"]

        def one(text) -> float:
            p = features(text)
            margin = direction[p].sum() / max(np.sqrt(square[p].sum()), 1e-12) + bias
            return float(1 / (1 + np.exp(-np.clip(slope * margin + shift, -35, 35))))

        return texts.map(one, na_action=None).astype(float)

    return lambda text: score(text.cast("string"))


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, FOLDS) == HELD


def classify(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text; other columns are ignored).

    ``labels`` (doc_id, quality) is only read outside the held-out fold. Null and
    empty texts have no n-grams and get the score of the bias.
    """
    score = scorer(docs, train(docs, labels, rows))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier does not reject."""
    score = scorer(docs, train(docs, labels, rows))
    return docs.filter(score(F.col("text")) >= THRESHOLD)
