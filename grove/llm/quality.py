"""Quality classifier: hashed word n-grams, logistic regression with follow-the-regularised-leader updates.

Words are runs of letters and digits, and runs of other visible characters; case is kept. A feature is a hashed word or pair
of neighbours (a pair of equal words is one feature, whatever the word), its value its share of the text's features. A score is the mean weight of the features, times SCALE, plus bias.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from grove.llm.ftrl import FTRL, logistic
from grove.llm.training import examples, kept, labelled, scored

BITS, SCALE, EPOCHS, THRESHOLD = 18, 40.0, 3, 0.3
#: At most so many labelled documents train the model: those of smallest id hash that are not held out.
SAMPLE = 6000
MOD, REST = 5, 0
TWICE = np.uint64(0x94D049BB133111EB)
_WORDS = re.compile(r"\w+|[^\w\s]+").findall
_memo: dict[str, int] = {}


def word_hashes(words: list[str]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    global _memo
    if len(_memo) > 100_000:
        _memo = {}
    for w in [w for w in set(words) if w not in _memo]:
        _memo[w] = xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))


def release() -> None:
    global _memo
    _memo = {}


def features(text: str) -> np.ndarray:
    """Places of all words and pairs, repeats included; none for a text without words."""
    h = word_hashes(_WORDS(text))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xBF58476D1CE4E5B9)
    pairs[h[:-1] == h[1:]] = TWICE
    return (np.concatenate((h, pairs)) >> np.uint64(64 - BITS)).astype(np.int64)


def sparse(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for t in texts:
        f = features(t)
        at, n = np.unique(f, return_counts=True)
        out.append((at, n * (SCALE / max(1, len(f)))))
    return out


@dataclass
class Model:
    """Without labelled rows every text scores 1: nothing is rejected."""

    weights: np.ndarray | None
    bias: float

    def scores(self, texts: list[str]) -> list[float]:
        if self.weights is None:
            return [1.0] * len(texts)
        out = []
        for t in texts:
            f = features(t)
            out.append(logistic(self.bias + (SCALE * float(self.weights[f].sum(dtype=np.float64)) / len(f) if len(f) else 0.0)))
        return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """labels.quality of rows that are not held out; only ids choose the sample and only texts are inputs."""
    found = examples(labelled(docs, labels, "quality", MOD, REST, sample), sparse)
    if not found:
        return Model(None, 0.0)
    return Model(*FTRL(BITS, alpha=0.3, l1=0.3, l2=0.05).fit(found, EPOCHS))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each row of docs. A null text is empty and has the bias's score; repeated ids have a row each; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return scored(docs, lambda texts: shared.value.scores(texts), MOD, REST, THRESHOLD)


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text's score reaches the threshold; a null text is empty; an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return kept(docs, lambda texts: shared.value.scores(texts), lambda s: s >= threshold, release)
