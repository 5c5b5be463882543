"""Order MinHash fingerprints: sketches that follow the edit distance, not only the set of k-mers.

Each k-mer is numbered by its occurrence. For every one of SKETCHES hash functions the TUPLE smallest (k-mer, occurrence)
pairs are selected, put back into text order, and hashed as a tuple of k-mers. Two texts' share of equal sketches is
their likeness.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.llm.common import Deal, id_text, longs, shuffle_partitions, slices

K, TUPLE, SKETCHES = 6, 2, 64
BLOCK = 1 << 13
POS_BITS = 24
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_rng = np.random.default_rng(20240131)
MULTIPLY = _rng.integers(0, 1 << 32, SKETCHES, dtype=np.uint32) | np.uint32(1)
ADD = _rng.integers(0, 1 << 32, SKETCHES, dtype=np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def kmers(text: str) -> np.ndarray:
    """A 64-bit hash of each k-mer of code points; a shorter text is one k-mer with its length."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(x) - K + 1
    if n < 1:
        h = np.full(1, len(x), np.uint64)
        for v in x:
            h = h * M1 + v
        return mixed(h)
    h = x[:n].copy()
    for t in range(1, K):
        h *= M1
        h += x[t : n + t]
    return mixed(h)


def occurrences(h: np.ndarray) -> np.ndarray:
    """For each position, how many earlier positions hold the same k-mer, by all 64 bits of its hash."""
    n = len(h)
    at = None
    if n < 1 << POS_BITS:  # sorting hash and position in one word is stable, and faster
        low = np.uint64((1 << POS_BITS) - 1)
        both = np.sort((h & ~low) | np.arange(n, dtype=np.uint64))
        at = (both & low).astype(np.int64)
        key, high = h[at], both & ~low
        if ((high[1:] == high[:-1]) & (key[1:] != key[:-1])).any():  # the high bits don't tell two k-mers apart
            at = None
    if at is None:
        at = np.argsort(h, kind="stable")
        key = h[at]
    starts = np.zeros(n, np.int64)
    new = np.flatnonzero(key[1:] != key[:-1]) + 1
    starts[new] = new
    np.maximum.accumulate(starts, out=starts)
    out = np.empty(n, np.uint64)
    out[at] = (np.arange(n) - starts).astype(np.uint64)
    return out


def sketches(text: str) -> np.ndarray:
    """SKETCHES unsigned 32-bit tuple hashes of the whole text, in bounded memory beside it."""
    h = kmers(text)
    n, want = len(h), min(TUPLE, len(h))
    e = (mixed(h + occurrences(h) * M1) >> np.uint64(32)).astype(np.uint32)
    odds = 10.0
    while True:
        limit = np.uint32(min(2**32 - 1, odds / n * 2**32))
        rows, cols, vals = [], [], []
        for a in range(0, n, BLOCK):
            v = e[a : a + BLOCK] * MULTIPLY[:, None]
            v += ADD[:, None]
            flat = np.flatnonzero(v <= limit)
            w = min(BLOCK, n - a)
            rows.append(flat // w)
            cols.append(flat % w + a)
            vals.append(v.ravel()[flat])
        j, p, v = (np.concatenate(x) for x in (rows, cols, vals))
        if (counts := np.bincount(j, minlength=SKETCHES)).min() >= want:
            break
        odds *= 8
    order = np.lexsort((p, v, j))
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    chosen = np.sort(p[order][first[:, None] + np.arange(want)], axis=1)
    t = np.full(SKETCHES, want, np.uint64)
    for c in range(want):
        t = mixed(t * M1 + h[chosen[:, c]])
    return (t >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / SKETCHES


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame, parts: int | None = None) -> tuple[DataFrame, Deal]:
    """Rows (doc_id, text, borrowed) dealt out as contiguous id ranges and sorted; ties of ids by text.

    Every range ends with borrowed rows, copies of the first id of the next range (after the last: of the first), so that
    each row's successor is in its own partition. One shuffle; a text moves once, and twice only at a bound.
    """
    docs = id_text(docs)
    deal = Deal(docs, "doc_id", parts or shuffle_partitions(docs.sparkSession))
    key, part = deal.key("doc_id"), deal.part("doc_id")
    to = lambda p, b: F.struct(p.cast("int").alias("p"), F.lit(b).alias("b"))
    places = F.when(key == F.lit(deal.first), F.array(to(part, False), to(F.lit(deal.parts - 1), True)))
    if deal.cuts:
        places = places.when(F.array_contains(longs(deal.cuts), key), F.array(to(part, False), to(part - 1, True)))
    dealt = docs.select("doc_id", "text", F.explode(places.otherwise(F.array(to(part, False)))).alias("to"))
    dealt = dealt.select("doc_id", "text", F.col("to.p").alias("part"), F.col("to.b").alias("borrowed")).repartitionById(deal.parts, F.col("part"))
    return dealt.sortWithinPartitions("borrowed", "doc_id", "text"), deal


def fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import sha256

    held, done = None, False
    for batch in batches:
        for piece in slices(batch, 256):
            out = []
            for doc_id, text, borrowed in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "text", "borrowed")), strict=True):
                if done:
                    continue
                own = sketches(text)
                if held is not None:
                    edited = edited_text(held[1], text)
                    other = sketches(edited)
                    out.append((held[0], len(held[1]), sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), held[2].astype(">u4").tobytes().hex(), other.astype(">u4").tobytes().hex(), likeness(held[2], other), likeness(held[2], own)))
                held, done = (doc_id, text, own), borrowed
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=COLUMNS)


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every whole text and of its edited form (its second half replaced by the start of the next text).

    A null text is empty; an empty text has the fingerprint of an empty k-mer; rows that repeat an id follow each other in
    text order, and each has its own result row; an empty table gives no rows; other columns are left out.
    """
    rows, _ = in_order(docs, parts)
    return rows.mapInArrow(fingerprint_rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
