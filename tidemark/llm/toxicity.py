"""Toxicity: a classifier regularised by counterfactuals.

Documents are sets of words and prefixes; the model is logistic over presence of those that go with a
label in a sample of labelled documents: in ``LEAST_DOCUMENTS`` of them at least, and beyond chance.
Sentences of that sample that mention a group are repeated with the term swapped for another of its
kind and for a neutral one, and the squared change of the score is penalised. So no group's name
carries a weight of its own, and a neutral mention does not raise the score, while words that make a
mention toxic keep theirs. Terms are those of ``IDENTITY``, in four languages, or the caller's; the
fitted model tells how many swapped pairs it was held to (``Model.pairs``), which is 0 where no
labelled text mentions a group - then the penalty has nothing to act on.

It is fitted on at most ``SAMPLE_ROWS`` labelled rows, and of these on as many as have at most
``ngrams.SAMPLE_BYTES`` of features (these bounds are parameters), that the caller's condition
allows; words and the sentences that are swapped are sent to the driver, not texts. Scoring reads
whole texts of all documents.

Defined cases: null and empty texts are scored by the intercept; rows without doc_id are scored
and never learned from; labels other than 0 and 1 are left out; without labels of both classes
the score is the rate of label 1 (0.5 without any); repeated rows are scored each; input columns
named like a result column are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.ngrams import fold_of, labelled_sample, sample_features, scored, sigmoid
from tidemark.llm.staging import trim

SAMPLE_ROWS = 8000
#: documents of the sample that a feature must be in, and weights of the two penalties
LEAST_DOCUMENTS, RIDGE, SWAP = 3, 0.0001, 4.0
#: prefixes that are features besides whole words
PREFIXES = (4, 6)
RESULT = ("held_out", "score", "predicted")
NEUTRAL = "people"
#: fixed values: terms for groups of people, by kind; a term is swapped within its kind
IDENTITY = (
    ("woman", "man", "female", "male", "transgender", "nonbinary"),
    ("women", "men", "females", "males"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "arab"),
    ("mexican", "american", "chinese", "indian", "german", "french", "spanish", "russian"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("disabled", "deaf", "blind", "autistic"),
    ("old", "young", "elderly"),
    ("frau", "mann", "transfrau", "transmann"),
    ("frauen", "männer"),
    ("schwul", "lesbisch", "bisexuell", "heterosexuell", "homosexuell"),
    ("muslim", "christ", "jude", "hindu", "buddhist", "atheist"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("türken", "polen", "russen", "franzosen", "araber", "deutsche", "afrikaner"),
    ("ausländer", "einwanderer", "flüchtling", "einheimischer"),
    ("behindert", "taub", "blind", "autistisch"),
    ("femme", "homme"),
    ("femmes", "hommes"),
    ("gai", "lesbienne", "bisexuel", "hétérosexuel", "homosexuel"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("arabes", "africains", "asiatiques", "français", "allemands", "russes"),
    ("immigré", "réfugié", "étranger", "citoyen"),
    ("handicapé", "sourd", "aveugle", "autiste"),
    ("mujer", "hombre"),
    ("mujeres", "hombres"),
    ("lesbiana", "bisexual", "heterosexual", "homosexual"),
    ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("árabes", "africanos", "asiáticos", "españoles", "mexicanos", "rusos"),
    ("inmigrante", "refugiado", "extranjero", "ciudadano"),
    ("discapacitado", "sordo", "ciego", "autista"),
)
_word = re.compile(r"[^\W_]+(?:['’][^\W_]+)*").findall
_sentence = re.compile(r"[^.!?\n]+").findall
Terms = tuple[tuple[str, ...], ...]


def kinds_of(terms: Terms) -> dict[str, tuple[str, ...]]:
    """Term -> the terms that it can be swapped for; the first list that has it counts."""
    out: dict[str, tuple[str, ...]] = {}
    for kind in terms:
        for t in kind:
            out.setdefault(t, kind)
    return out


def words_of(text: str | None) -> list[str]:
    return _word((text or "").lower())


def features(words) -> set[str]:
    """Words and, so that forms of one stem count together, their longer prefixes."""
    out = set(words)
    return out | {w[:n] + "*" for w in out for n in PREFIXES if len(w) > n}


def mentions(text: str | None, kinds: dict[str, tuple[str, ...]]) -> list[list[str]]:
    """Sentences with a group's term, as words."""
    if kinds.keys().isdisjoint(words_of(text)):
        return []
    sentences = map(_word, _sentence((text or "").lower()))
    return [words for words in sentences if not kinds.keys().isdisjoint(words)]


def swaps(words: list[str], kinds: dict[str, tuple[str, ...]]) -> list[list[str]]:
    """A sentence with its terms swapped: once within their kinds and once for the neutral one."""

    def following(w: str) -> str:
        kind = kinds[w]
        return kind[(kind.index(w) + 1) % len(kind)]

    return [[put(w) if w in kinds else w for w in words] for put in (following, lambda w: NEUTRAL)]


def extracted(text: str | None, kinds: dict[str, tuple[str, ...]]) -> bytes:
    """What fitting needs of a text: a line of its distinct words, then one for each mention."""
    lines = [sorted(set(words_of(text))), *mentions(text, kinds)]
    return "\n".join(map(" ".join, lines)).encode("utf-8", "surrogatepass")


class Model:
    def __init__(self, weights: dict[str, float], intercept: float, pairs: int):
        self.weights, self.intercept, self.pairs = weights, intercept, pairs

    def score(self, text: str | None) -> float:
        get = self.weights.get
        return float(sigmoid(self.intercept + sum(get(w, 0.0) for w in self.weights.keys() & features(words_of(text)))))


def vocabulary(documents: list[list[str]], label: np.ndarray) -> list[str]:
    """Features whose presence goes with the label beyond chance (chi-square over 3.84). Feature
    sets are counted and let go; only counts are held for all texts."""
    counts = (Counter(), Counter())
    for words, y in zip(documents, label, strict=True):
        counts[int(y)].update(features(words))
    n1, n0 = max(1, int(label.sum())), max(1, int(len(label) - label.sum()))
    n, found = n1 + n0, []
    for w in counts[0].keys() | counts[1].keys():
        a, b = counts[1][w], counts[0][w]
        if a + b >= LEAST_DOCUMENTS and a + b < n:
            chi = n * (a * (n0 - b) - b * (n1 - a)) ** 2 / (n1 * n0 * (a + b) * (n - a - b))
            if chi > 3.84:
                found.append(w)
    return sorted(found)


class Problem:
    """The objective: mean logistic loss, ridge, and the mean squared change of swapped sentences."""

    def __init__(self, documents: list[list[str]], label: np.ndarray, pairs: list[tuple[list[str], list[str]]], names: list[str]):
        self.number, self.label, self.n, self.m, self.size = {w: i for i, w in enumerate(names)}, label, len(documents), max(1, len(pairs)), len(names)
        self.docs, self.before, self.after = self._rows(documents), self._rows(a for a, _ in pairs), self._rows(b for _, b in pairs)
        #: bounds the curvature
        self.steep = 0.25 * (1 + len(self.docs[0]) / self.n) + RIDGE + 2 * SWAP * (len(self.before[0]) + len(self.after[0])) / self.m

    def _rows(self, lists) -> tuple[np.ndarray, np.ndarray]:
        cols = [np.array(sorted(self.number[w] for w in features(x) & self.number.keys()), np.int64) for x in lists]
        return np.repeat(np.arange(len(cols)), [len(c) for c in cols]), np.concatenate([*cols, np.empty(0, np.int64)])

    def change(self, w: np.ndarray) -> np.ndarray:
        """By how much each swap changes the log-odds."""
        return np.bincount(self.before[0], w[self.before[1]], self.m) - np.bincount(self.after[0], w[self.after[1]], self.m)

    def value(self, w: np.ndarray, b: float) -> float:
        z = np.bincount(self.docs[0], w[self.docs[1]], self.n) + b
        return float(np.mean(np.logaddexp(0, z) - self.label * z) + RIDGE / 2 * (w @ w) + SWAP / 2 * np.mean(self.change(w) ** 2))

    def gradient(self, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        gap = (sigmoid(np.bincount(self.docs[0], w[self.docs[1]], self.n) + b) - self.label) / self.n
        change = self.change(w)
        swapped = np.bincount(self.before[1], change[self.before[0]], self.size) - np.bincount(self.after[1], change[self.after[0]], self.size)
        return np.bincount(self.docs[1], gap[self.docs[0]], self.size) + RIDGE * w + SWAP / self.m * swapped, float(gap.sum())


def fit_model(rows: list[bytes | memoryview], label: np.ndarray, terms: Terms = IDENTITY) -> Callable[[str | None], float]:
    """``rows`` as ``extracted`` gives them. The score's model is its ``__self__``."""
    if len(set(label.tolist())) < 2:
        rate = float(label.mean()) if len(label) else 0.5
        return lambda text: rate
    kinds = kinds_of(terms)
    lines = [[line.split(" ") if line else [] for line in bytes(r).decode("utf-8", "surrogatepass").split("\n")] for r in rows]
    documents = [x[0] for x in lines]
    pairs = [(words, other) for x in lines for words in x[1:] for other in swaps(words, kinds)]
    names = vocabulary(documents, label)
    problem, rate = Problem(documents, label, pairs, names), label.mean()
    w, b = np.zeros(len(names)), float(np.log(rate / (1 - rate)))
    velocity, vb = np.zeros(len(names)), 0.0
    # accelerated gradient steps
    for k in range(1500):
        look, lb = w + velocity, b + vb
        slope, sb = problem.gradient(look, lb)
        keep = k / (k + 3)
        new_w, new_b = look - slope / problem.steep, lb - sb / problem.steep
        velocity, vb = keep * (new_w - w), keep * (new_b - b)
        w, b = new_w, new_b
    return Model({x: float(v) for x, v in zip(names, w, strict=True) if abs(v) > 1e-6}, b, len(pairs)).score


def fit(documents: DataFrame, labels: DataFrame, fold: Column, label: str = "toxic", sample_rows: int = SAMPLE_ROWS, terms: Terms = IDENTITY) -> Callable[[str | None], float]:
    kinds = kinds_of(terms)
    y, rows = sample_features(documents, labelled_sample(labels, label, fold, sample_rows), lambda t: extracted(t, kinds), sample_rows)
    score = fit_model(rows, y, terms)
    trim()
    return score


def score_toxicity(documents: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, keep: list[str] | None = None, sample_rows: int = SAMPLE_ROWS, terms: Terms = IDENTITY) -> DataFrame:
    """``documents`` (its columns ``keep``; all without it) with ``RESULT``."""
    keep = [c for c in keep or documents.columns if c not in RESULT]
    score = fit(documents, labels, fold_of(F.col("doc_id"), folds) != held, sample_rows=sample_rows, terms=terms)
    out = scored(documents, score, list(dict.fromkeys([*keep, "doc_id"])))
    return out.select(*keep, (fold_of(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
