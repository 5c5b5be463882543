"""Harmonic packing of documents into sequences of CAPACITY tokens, by each worker alone.

A document's ids are cut into whole sequences, then pieces of exactly 1/2, 1/4, ... of the capacity down to its square root,
then one rest. A piece of length n is of class k = capacity // n, and a bin of class k takes exactly k pieces. Cut this way a
class has one length, and bins of the fractions are full; a bin of rests lacks less than one rest. The pieces of bins that
stay open at the end of a partition, fewer than k a class, are put together, largest first; the pieces of the last such
sequence of fractions become sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.llm.common import id_text
from grove.llm.library_tokens import encoder, tokenizer_path
from grove.llm.words import in_groups

VOCABULARY, END, CAPACITY = "byte_bpe_50k.json", 0, 1024
#: Pieces of texts in a generation of a worker's memo: with 350,000 a worker held 80 MB more.
MEMO = 150_000
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of n ids, in order."""
    whole, rest = divmod(n, capacity)
    least = 1 << (capacity.bit_length() - 1) // 2
    out, size = [capacity] * whole, capacity // 2
    while size >= least:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] * (rest > 0)


class Bins:
    """Bins of one worker. place and close return sequences, each a list of (length, piece)."""

    def __init__(self, capacity: int = CAPACITY) -> None:
        self.capacity = capacity
        self.open: dict[int, list] = {}

    def place(self, length: int, piece: object) -> list[list[tuple[int, object]]]:
        held = self.open.setdefault(length, [])
        held.append((length, piece))
        if len(held) < self.capacity // length:
            return []
        return [self.open.pop(length)]

    def close(self) -> list[list[tuple[int, object]]]:
        left = sorted((x for held in self.open.values() for x in held), key=lambda x: -x[0])
        least = 1 << (self.capacity.bit_length() - 1) // 2
        fractions, rests = [x for x in left if x[0] >= least], [x for x in left if x[0] < least]
        out, now, room = [], [], self.capacity
        for x in fractions:  # lengths fall and each divides those before: bins fill up exactly
            now.append(x)
            room -= x[0]
            if not room:
                out.append(now)
                now, room = [], self.capacity
        total = self.capacity - room
        for bit in reversed(range(self.capacity.bit_length())):
            if total >> bit & 1:
                part, n = [], 0
                while n < 1 << bit:
                    part.append(now.pop(0))
                    n += part[-1][0]
                out.append(part)
        now, room = [], self.capacity
        for x in rests:
            if x[0] > room:
                out.append(now)
                now, room = [], self.capacity
            now.append(x)
            room -= x[0]
        return out + [now] * bool(now)


def pack_batches(path: str, end: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        memo, bins, tail = encoder(path, True, MEMO), Bins(capacity), end.to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def emit(filled: list[list[tuple[int, object]]]) -> None:
            nonlocal sequence
            for seq in filled:
                at = 0
                for length, (doc_id, start, ids, total) in seq:
                    rows.append((doc_id, start, length, ids, total, sequence, at))
                    at += length
                sequence += 1

        def batch() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            rows.clear()
            return out

        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for a, z in in_groups(texts):
                for doc_id, tokens in zip(ids[a:z], memo.texts(texts[a:z]), strict=True):
                    tokens += tail
                    at, total = 0, len(tokens) // 4
                    for length in cuts(total, capacity):
                        emit(bins.place(length, (doc_id, at, tokens[4 * at : 4 * (at + length)], total)))
                        at += length
                if rows:
                    yield batch()
        emit(bins.close())
        if rows:
            yield batch()

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents, each row a document of its own, with their ids as little-endian unsigned 32-bit integers.

    No shuffle: every task packs the rows that it reads and numbers its sequences within a range of its own. A null or empty
    text is its end id only; an empty table gives no rows; other columns are left out.
    """
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("capacity must be a power of two")
    return id_text(docs).mapInArrow(pack_batches(vocabulary or tokenizer_path(VOCABULARY), end, capacity), SCHEMA)


def pieces(packed: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
