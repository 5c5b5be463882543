"""Byte-level BPE with two tiers: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the others."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from xxhash import xxh64_intdigest

from grove.llm.common import id_text
from grove.llm.words import WordMemo, in_groups

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
_MASK = (1 << 64) - 1


class PerfectHash:
    """A minimal perfect hash of distinct byte strings: as many slots as keys.

    Keys fall into buckets; the largest first, each bucket gets the first displacement that puts all its keys into free slots.
    Buckets of one key name a free slot outright (a negative displacement). A lookup is one hash and one comparison.
    """

    def __init__(self, keys: list[bytes]) -> None:
        self.n, self.m = len(keys), max(1, len(keys) // 4)
        buckets: list[list[int]] = [[] for _ in range(self.m)]
        hashes = [xxh64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            buckets[h % self.m].append(i)
        self.shift = [0] * self.m
        self.slots = [-1] * self.n
        for b in sorted(range(self.m), key=lambda b: -len(buckets[b])):
            own = buckets[b]
            if len(own) < 2:
                break
            d = 1
            while True:
                at = [self._slot(hashes[i], d) for i in own]
                if len(set(at)) == len(at) and all(self.slots[a] < 0 for a in at):
                    break
                d += 1
            self.shift[b] = d
            for i, a in zip(own, at, strict=True):
                self.slots[a] = i
        free = iter([a for a, i in enumerate(self.slots) if i < 0])
        for b, own in enumerate(buckets):
            if len(own) == 1:
                a = next(free)
                self.shift[b] = -a - 1
                self.slots[a] = own[0]
        self.keys = [keys[i] for i in self.slots]

    def _slot(self, h: int, d: int) -> int:
        return ((h >> 20) * (2 * d + 1) + (h * d >> 40) & _MASK) % self.n

    def get(self, key: bytes) -> int:
        """The place of the key in the list, or -1."""
        if not self.n:
            return -1
        h = xxh64_intdigest(key)
        d = self.shift[h % self.m]
        a = -d - 1 if d < 0 else self._slot(h, d)
        return self.slots[a] if self.keys[a] == key else -1


class ByteBPE:
    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        words = [base64.b64decode(a) for a, _ in pairs]
        self.ranks = {w: int(r) for w, (_, r) in zip(words, pairs, strict=True)}
        self.ids = [int(r) for _, r in pairs]
        self.whole = PerfectHash(words)
        self.bytes_of = {r: w for w, r in self.ranks.items()}
        self.memo = WordMemo(regex.compile(pattern).findall, self.pre_token)

    def merged(self, word: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals: a heap of pairs over a linked list of parts."""
        n, rank = len(word), self.ranks.get
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            if not alive[i] or (j := after[i]) >= n or after[j] != end:
                continue  # one of its parts has been merged since
            alive[j] = False
            after[i] = end
            if end < n:
                before[end] = i
                if (r := rank(word[i : after[end]])) is not None:
                    heappush(heap, (r, i, after[end]))
            if (p := before[i]) >= 0 and (r := rank(word[p:end])) is not None:
                heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : after[i]]])
            i = after[i]
        return out

    def pre_token(self, token: str) -> bytes:
        """The ids of one pre-token: the whole of it from the perfect hash, else its merged parts."""
        word = token.encode("utf-8", "surrogatepass")
        at = self.whole.get(word)
        return array("I", [self.ids[at]] if at >= 0 else self.merged(word)).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.memo.texts(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def encode_batches(path: str, pattern: str):
    """Batches of (doc_id, text) to (doc_id, ids), ids as bytes of little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text").to_pylist()
            for a, z in in_groups(texts):
                yield pa.RecordBatch.from_arrays([ids.slice(a, z - a), pa.array(bpe.encode(texts[a:z]), pa.binary())], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids) of every whole text, without special tokens; a null or empty text has none."""
    own = default_files()
    return id_text(docs).mapInArrow(encode_batches(path or own[0], pattern or own[1]), "doc_id long, ids binary")


def decode(tokens: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, bytes) of (doc_id, ids)."""
    own = default_files()
    at = path or own[0], pattern or own[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(*at)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([bpe.decode(x) for x in b.column("ids").to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Digests of each row's ids and of the bytes decoded from those ids, in one pass.

    A null or empty text has no ids and the digests of the empty string; rows that repeat an id have a row each; an empty
    table gives none; other columns are left out.
    """
    own = default_files()
    at = path or own[0], pattern or own[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(*at)
        for b in encode_batches(*at)(batches):
            ids = b.column("ids").to_pylist()
            out = [[len(x) // 4 for x in ids], [sha256(x).hexdigest() for x in ids], [sha256(bpe.decode(x)).hexdigest() for x in ids]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
