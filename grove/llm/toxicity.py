"""Toxicity of texts behind leetspeak, spacing and repetition.

The writer is a noisy channel over clean words. A word with signs of disguise (digits or symbols among letters, separators
inside, a letter twice in a row, look-alikes of another script among letters, three or more letters spaced out one by one, by
any white space) becomes a lattice: a sign stands for a letter or nothing, a repeated letter for itself or nothing. Viterbi decoding under a trigram model of characters picks the likeliest clean form.
The model counts the trigrams of all documents. Words and word beginnings of the restored text are the features of a logistic
regression with follow-the-regularised-leader updates.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from grove.llm.common import id_text
from grove.llm.ftrl import FTRL, logistic
from grove.llm.training import examples, kept, labelled, scored

BITS, EPOCHS, THRESHOLD = 20, 4, 0.3
#: The least log-odds of a text without telling features: 1 %. Labelled toxic texts hold several toxic words, so that a bias
#: fitted to them would ask for as many.
LEAST_BIAS = -4.6
#: At most so many labelled documents train the model: those of smallest id hash that are not held out.
SAMPLE = 8000
MOD, REST = 4, 2
PREFIXES = (4, 5, 6)
#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "(": "c"}
SEPARATORS = " .-_*~'/\\,:;^#=`\""
#: Letters of Cyrillic that look like Latin ones.
ALIKE = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s"}
SIGN, DROP, BREAK = 1.0, 1.0, 4.0  # costs in nats: a sign for a letter, a separator for nothing, a separator for a gap
#: A repeat or a sign for nothing: DROP and about what a letter costs under the model, so that a reading isn't cheaper for being shorter.
SHORTER = DROP + 2.5
OTHER = 27
_DISGUISED = re.compile(r"[^\W\d_][^\w\s]+\w|[^\W\d_]*\d[^\W\d_]|[^\W\d_]\d|[@$!|+€(][^\W\d_]|[^\W\d_]_|(\w)\1|[a-z][\u0400-\u045f]|[\u0400-\u045f][a-z]").search
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
_RUN = re.compile(r"([^\w\s])\1+")
#: What _DISGUISED finds in letters alone, and the signs that `stripped` takes off the ends of a word whatever they stand beside.
_ODD = re.compile(r"(\w)\1|[a-z][\u0400-\u045f]|[\u0400-\u045f][a-z]").search
ENDS = "\"#%&'()*+,-./:;<=>?[\\]^_`{|}~"


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each 16-bit code unit: 1-26 letters without accents, 27 other letters, 0 all else."""
    out = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c).lower()[:1]
        if ch.isalpha():
            base = unicodedata.normalize("NFD", ch)[0]
            out[c] = ord(base) - 96 if "a" <= base <= "z" else OTHER
    return out


def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of class trigrams in a partition's texts; each text stands between gaps."""
    total = np.zeros(1 << 15, np.int64)
    for b in batches:
        for t in b.column("text").to_pylist():
            raw = np.frombuffer(t.encode("utf-16-le", "surrogatepass"), np.uint16)
            c = np.zeros(len(raw) + 3, np.int64)
            c[2:-1] = classes()[raw]
            total += np.bincount(c[:-2] << 10 | c[1:-1] << 5 | c[2:], minlength=1 << 15)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])


def trigram_costs(docs: DataFrame) -> np.ndarray:
    """-log P(c | a, b) over the 32^3 class trigrams of all documents; at most that many counts reach the driver."""
    rows = id_text(docs).select("text").mapInArrow(count_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(1 << 15)
    for r in rows:
        n[r["gram"]] = r["n"]
    n = n.reshape(32, 32, 32)
    two, one = n.sum(0), n.sum((0, 1))
    p1 = (one + 0.5) / (one.sum() + 0.5 * 28)
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    p3 = (n + 5 * p2) / (n.sum(2, keepdims=True) + 5)
    return -np.log(p3)


def choices(ch: str, again: bool) -> list[tuple[str, float]]:
    """What a character may stand for, at which cost. again: it repeats the one before."""
    if ch in SEPARATORS:
        return [("", DROP), (" ", BREAK)]
    if ch in LEET:
        return [(x, SIGN) for x in LEET[ch]] + ([("", SHORTER)] if ch == "!" or again else [])
    if again and ch.isalpha():
        return [(ch, 0.0), ("", SHORTER)] + ([(ALIKE[ch], SIGN)] if ch in ALIKE else [])
    if ch in ALIKE:
        return [(ch, 0.0), (ALIKE[ch], SIGN)]
    return [(ch if ch.isalpha() else " ", 0.0)]


def options(word: str) -> list[list[tuple[str, float]]]:
    """The lattice: for each character what it may stand for, at which cost."""
    return [choices(ch, i > 0 and word[i - 1] == ch) for i, ch in enumerate(word)]


@lru_cache(maxsize=10_000)
def coded(ch: str, again: bool) -> list[tuple[str, float, int]]:
    """choices with the class of each; -1 for nothing."""
    of = lambda x: 0 if x == " " else int(classes()[ord(x)]) if ord(x) < 1 << 16 else OTHER
    return [(x, c, of(x) if x else -1) for x, c in choices(ch, again)]


def decode(word: str, cost: np.ndarray) -> str:
    """The likeliest clean form of a word under costs of a class after two others."""
    return likeliest(word, cost.ravel().tolist())


def likeliest(word: str, cost: list[float]) -> str:
    """The same: Viterbi over states of the last two classes (ten bits); time and memory grow with the length.

    cost: by the fifteen bits of the three classes.
    """
    states: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
    before = ""
    for ch in word:
        new: dict[int, tuple[float, tuple]] = {}
        ways = coded(ch, ch == before)
        before = ch
        for state, (total, path) in states.items():
            for x, c, k in ways:
                if k < 0:
                    key, value, way = state, total + c, path
                else:
                    at = state << 5 | k
                    key, value, way = at & 1023, total + c + cost[at], (path, x)
                if key not in new or value < new[key][0]:
                    new[key] = (value, way)
        states = new
    best = min(((v + cost[s << 5], p) for s, (v, p) in states.items()), key=lambda x: x[0])[1]
    out = []
    while best:
        best, x = best
        out.append(x)
    return "".join(reversed(out))


def stripped(word: str) -> str:
    """The word without runs of a symbol and without symbols at its ends, unless one there can be a letter."""
    word = _RUN.sub(" ", word).strip()
    a, z = 0, len(word)
    while a < z and not word[a].isalnum() and not (word[a] in "@$!" and a + 1 < z and word[a + 1].isalnum()):
        a += 1
    while z > a and not word[z - 1].isalnum() and word[z - 1] not in "@$":
        z -= 1
    return word[a:z]


@dataclass
class Restorer:
    """Words to their clean forms, with a bounded memo in each worker."""

    cost: np.ndarray
    limit: int = 50_000
    memo: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.flat = self.cost.ravel().tolist()

    def __getstate__(self) -> dict:
        return {"cost": self.cost, "limit": self.limit, "memo": {}}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def word(self, word: str) -> tuple[str, ...]:
        """word: lower case, without white space, or letters spaced out."""
        core = stripped(word)
        if not any(map(str.isalpha, core)):
            return ()
        if core.isalpha() and not _DISGUISED(core):
            return (core,)
        if (found := self.memo.get(core)) is None:
            if len(self.memo) >= self.limit:
                self.memo = {}
            plain = tuple(w for w in re.findall(r"[^\W\d_]+", core) if len(w) > 1)
            clean = likeliest(core, self.flat).split() if _DISGUISED(core) or " " in core else ()
            found = self.memo[core] = tuple(dict.fromkeys((*clean, *plain)))
        return found

    def restore(self, text: str) -> str:
        """The text with every disguised word in its clean form, white space as single spaces."""
        text = _SPACED.sub(lambda m: " ".join(self.word(" ".join(m[0].split()))) or m[0], text.lower())
        return " ".join(" ".join(self.word(w)[:1]) or w for w in text.split())


def place(key: str) -> int:
    return xxh64_intdigest(key.encode("utf-8", "surrogatepass")) >> (64 - BITS)


def beginnings(word: str) -> list[int]:
    return [place(f"{word[:n]}_") for n in PREFIXES if len(word) >= n]


def places(word: str) -> list[int]:
    """Hashed features of a clean word: itself and its beginnings."""
    return [place(word), *beginnings(word)]


def raw_words(text: str) -> set[str]:
    text = text.lower()
    return set(text.split()).union(" ".join(w.split()) for w in _SPACED.findall(text))


def sparse_with(restorer: Restorer):
    def run(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for t in texts:
            at = np.array(sorted({p for w in raw_words(t) for c in restorer.word(w) for p in places(c)}), np.int64)
            out.append((at, np.ones(len(at))))
        return out

    return run


@dataclass
class Model:
    """weights: of features with one only. Without labelled rows every text scores 0: nothing is rejected."""

    restorer: Restorer
    weights: dict[int, float] | None
    bias: float
    limit: int = 300_000
    #: Words of the texts that have no feature with a weight; features of the others; and of beginnings, which many words share.
    dull: set[str] = field(default_factory=set)
    memo: dict[str, tuple[int, ...]] = field(default_factory=dict)
    heads: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"dull": set(), "memo": {}, "heads": {}}

    def weighted(self, at: list[int]) -> tuple[int, ...]:
        return tuple({p for p in at if p in self.weights})

    def plain(self, word: str) -> tuple[int, ...]:
        """The features with a weight of letters without any sign of disguise."""
        head = word[: PREFIXES[-1]]
        if (found := self.heads.get(head)) is None:
            if len(self.heads) >= self.limit // 4:
                self.heads.clear()
            found = self.heads[head] = self.weighted(beginnings(head))
        own = place(word)
        return (*found, own) if own in self.weights else found

    def telling(self, word: str) -> tuple[int, ...]:
        """The features of a word of the text that have a weight."""
        core = word.strip(ENDS)
        if core.isalpha() and not _ODD(core):
            found = self.plain(core)
        else:
            found = self.weighted([p for c in self.restorer.word(word) for p in places(c)])
        if len(self.dull) + len(self.memo) >= self.limit:
            self.dull.clear()
            self.memo.clear()
        if found:
            self.memo[word] = found
        else:
            self.dull.add(word)
        return found

    def score(self, text: str) -> float:
        if self.weights is None:
            return 0.0
        hits: set[int] = set()
        for w in raw_words(text) - self.dull:
            found = self.memo.get(w)
            hits.update(self.telling(w) if found is None else found)
        return logistic(self.bias + sum(self.weights[h] for h in sorted(hits)))

    def scores(self, texts: list[str]) -> list[float]:
        return [self.score(t) for t in texts]

    def release(self) -> None:
        self.dull, self.memo, self.heads, self.restorer.memo = set(), {}, {}, {}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """labels.toxic of rows that are not held out; only ids choose the sample and only texts are inputs."""
    restorer = Restorer(trigram_costs(docs))
    found = examples(labelled(docs, labels, "toxic", MOD, REST, sample), sparse_with(restorer))
    if not found:
        return Model(restorer, None, 0.0)
    weights, bias = FTRL(BITS, alpha=0.5, l1=4.0, l2=0.1, rising=True).fit(found, EPOCHS)  # no word speaks for a text
    return Model(restorer, {int(i): float(weights[i]) for i in np.flatnonzero(weights)}, max(bias, LEAST_BIAS))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each row of docs. A null text is empty and has the bias's score; repeated ids have a row each; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return scored(docs, lambda texts: shared.value.scores(texts), MOD, REST, THRESHOLD)


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text's score is below the threshold; a null text is empty; an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return kept(docs, lambda texts: shared.value.scores(texts), lambda s: s < threshold, lambda: shared.value.release())
