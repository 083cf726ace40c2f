"""Quality classifier: naive Bayes support vectors.

Word and punctuation unigrams and bigrams, and whether any only repeat a token or a pair, are
2**20 hashed indicators. Each is scaled by its
class log-count ratio, documents are scaled to unit length, and a linear hinge-loss model is
fitted by dual coordinate descent and mixed with the ratios themselves. Margins of folds left
out are calibrated to probabilities.

It is fitted on at most ``SAMPLE_ROWS`` labelled rows, and of these on as many as have at most
``SAMPLE_BYTES`` of features (these bounds are parameters), that the caller's condition allows;
scoring reads whole texts of all documents, and the model is an array of fixed size.

Defined cases: null and empty texts are scored by the intercept; rows without doc_id are scored
and never learned from; labels other than 0 and 1 are left out; without labels of both classes
the score is the rate of label 1 (0.5 without any); repeated rows are scored each; input columns
named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.ngrams import Hasher, calibrate, fold_of, labelled_sample, sample_features, scored, sigmoid
from tidemark.llm.staging import trim

SAMPLE_ROWS, BITS, ORDER = 8000, 20, 2
PATTERN = r"\w+|[^\w\s]+"
COST, MIX, SMOOTH, FOLDS = 1.0, 0.75, 1.0, 3
#: rounds over the sample at most, and the gradient at which the solver ends
ROUNDS, GAP = 30, 0.1
RESULT = ("held_out", "score", "predicted")


def log_count_ratios(rows: list[np.ndarray], label: np.ndarray, size: int) -> np.ndarray:
    counts = np.full((2, size), SMOOTH, np.float32)
    for x, y in zip(rows, label, strict=True):
        counts[int(y), x] += 1
    total = counts.sum(1, dtype=np.float64)
    return np.log(counts[1] / counts[0]) + np.float32(np.log(total[0] / total[1]))


def dual_coordinate_descent(rows: list[np.ndarray], values: Sequence[np.ndarray], label: np.ndarray, size: int, cost: float = COST, rounds: int = ROUNDS, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the L2-regularised hinge-loss model, the last one the intercept, and the dual
    variables, each between 0 and its row's cost. Classes weigh the same in sum. Ends when no dual
    variable can improve by more than ``gap`` of its gradient."""
    sign = np.where(label == 1, 1.0, -1.0)
    rate = label.mean()
    most = np.where(label == 1, 0.5 / rate, 0.5 / (1 - rate)) * cost
    w, alpha, rng = np.zeros(size + 1), np.zeros(len(rows)), np.random.default_rng(0)
    square = np.array([v @ v + 1 for v in values])
    for _ in range(rounds):
        largest = 0.0
        for i in rng.permutation(len(rows)).tolist():
            x, v, s = rows[i], values[i], sign[i]
            gradient = s * (float((w[x] * v).sum()) + w[size]) - 1
            # what of it leads into the box
            if alpha[i] == 0:
                gradient = min(gradient, 0.0)
            elif alpha[i] == most[i]:
                gradient = max(gradient, 0.0)
            if gradient == 0.0:
                continue
            largest = max(largest, abs(gradient))
            new = min(max(alpha[i] - gradient / square[i], 0.0), most[i])
            step, alpha[i] = new - alpha[i], new
            w[x] += step * s * v
            w[size] += step * s
        if largest < gap:
            break
    return w, alpha


class Model:
    """Weights per n-gram number; picklable and of fixed size."""

    def __init__(self, hasher: Hasher, ratio: np.ndarray, weight: np.ndarray, scale: float, shift: float):
        self.hasher, self.ratio, self.scale, self.shift = hasher, ratio, scale, shift
        self.weight, self.intercept = weight[:-1].astype(np.float32), float(weight[-1])

    def margin(self, x: np.ndarray) -> float:
        r = self.ratio[x]
        norm = float(np.sqrt(r @ r))
        return float(self.weight[x] @ r) / norm + self.intercept if norm else self.intercept

    def score(self, text: str | None) -> float:
        return float(sigmoid(self.scale * self.margin(self.hasher.features(text)) + self.shift))


class _Scaled:
    """Rows' indicators times their class ratios, to unit length; made when asked for."""

    def __init__(self, rows: list[np.ndarray], ratio: np.ndarray):
        self.rows, self.ratio = rows, ratio
        self.scale = [1 / max(1e-12, float(np.sqrt(np.square(ratio[x]).sum()))) for x in rows]

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ratio[self.rows[i]] * np.float32(self.scale[i])


def _weights(rows: list[np.ndarray], label: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    ratio = log_count_ratios(rows, label, size)
    w, _ = dual_coordinate_descent(rows, _Scaled(rows, ratio), label, size)
    # towards a plain naive Bayes vote where the data say little about a weight
    used = np.zeros(size + 1, bool)
    for x in rows:
        used[x] = True
    intercept, w[size] = w[size], 0.0
    mean = np.abs(w).sum() / max(1, used.sum())
    w *= MIX
    w[used] += (1 - MIX) * mean
    w[size] = intercept
    return ratio, w


def fit_model(rows: list[np.ndarray], label: np.ndarray) -> Callable[[str | None], float]:
    hasher, size = Hasher(PATTERN, BITS, ORDER), 1 << BITS
    if len(set(label.tolist())) < 2:
        rate = float(label.mean()) if len(label) else 0.5
        return lambda text: rate
    fold, margins = np.arange(len(rows)) % FOLDS, np.zeros(len(rows))
    for k in range(FOLDS):
        train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(set(label[train].tolist())) < 2:
            train = np.arange(len(rows))
        part = Model(hasher, *_weights([rows[i] for i in train], label[train], size), 1, 0)
        margins[test] = [part.margin(rows[i]) for i in test]
    return Model(hasher, *_weights(rows, label, size), *calibrate(margins, label)).score


def fit(documents: DataFrame, labels: DataFrame, fold: Column, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Callable[[str | None], float]:
    hasher = Hasher(PATTERN, BITS, ORDER)
    y, rows = sample_features(documents, labelled_sample(labels, label, fold, sample_rows), lambda t: hasher.features(t).tobytes(), sample_rows)
    score = fit_model([np.frombuffer(r, np.int32) for r in rows], y)
    trim()
    return score


def score_quality(documents: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, keep: list[str] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``documents`` (its columns ``keep``; all without it) with ``RESULT``."""
    keep = [c for c in keep or documents.columns if c not in RESULT]
    score = fit(documents, labels, fold_of(F.col("doc_id"), folds) != held, sample_rows=sample_rows)
    out = scored(documents, score, list(dict.fromkeys([*keep, "doc_id"])))
    return out.select(*keep, (fold_of(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
