"""Byte-level BPE, token files and packing against the libraries."""

import base64
import os
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from grove.llm import byte_bpe, packing, token_files  # noqa: E402
from grove.llm.common import new_path  # noqa: E402
from grove.llm.library_tokens import encoder, tokenizer_path  # noqa: E402
from grove.llm.words import Memo  # noqa: E402

TEXTS = st.lists(st.sampled_from(list(" \n\t\r\x0b\x1c\x85  abzABZéÉßΣςİ日\U0001f600'0019.,!?*#-_|<>") + ["é", "'s", "'ll", "<|endoftext|>", "<|startoftext|>", "<|endoftext", "<|ENDOFTEXT|>", "  ", " \n"]), max_size=24).map("".join)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(P.path(byte_bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_bpe_as_tiktoken(reference, text):
    bpe = byte_bpe.codec(*byte_bpe.default_files())
    ids = bpe.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
    assert bpe.decode(ids) == text.encode()


@pytest.mark.parametrize(("name", "spaces"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_memo_as_library(name, spaces):
    memo, want = encoder(tokenizer_path(name), spaces), library(name)

    @settings(max_examples=400, deadline=None)
    @given(TEXTS)
    def same(text):
        assert np.frombuffer(memo.text(text), "<u4").tolist() == want(text)

    same()


def test_perfect_hash():
    keys = [f"k{i}".encode() for i in range(997)]
    h = byte_bpe.PerfectHash(keys)
    assert sorted(h.slots) == list(range(997)) and [h.get(k) for k in keys] == list(range(997)) and h.get(b"none") == -1
    assert byte_bpe.PerfectHash([]).get(b"x") == -1 and byte_bpe.PerfectHash([b"a"]).get(b"a") == 0


def test_heap_merges_long_runs(reference):
    for text in ("a" * 3000, "ab" * 1000, "日本" * 500, "Z" * 5000):
        assert np.frombuffer(byte_bpe.codec(*byte_bpe.default_files()).encode([text])[0], "<u4").tolist() == reference.encode_ordinary(text)


def test_memo_is_bounded():
    m = Memo(lambda k: k.encode(), 10)
    assert [m[str(i)] for i in range(100)] == [str(i).encode() for i in range(100)] and len(m) <= 10 and len(m.older) <= 10


def test_round_trip_query(odd, plain, empty, reference):
    got = Counter(map(tuple, byte_bpe.round_trip(odd).collect()))
    ids = lambda t: np.array(reference.encode_ordinary(t), "<u4").tobytes()
    assert got == Counter((d, len(ids(t)) // 4, sha256(ids(t)).hexdigest(), sha256(t.encode()).hexdigest()) for d, t in plain)
    assert byte_bpe.round_trip(empty).count() == 0
    back = byte_bpe.decode(byte_bpe.encode(odd)).collect()
    assert Counter((r["doc_id"], bytes(r["bytes"]).decode()) for r in back) == Counter(plain)


def test_token_files(spark, odd, plain, empty):
    path, want = new_path(spark, "test"), library("word_bpe_49k.json")
    token_files.write_tokens(odd, path)
    got = Counter(map(tuple, token_files.digests(token_files.read_tokens(spark, path)).collect()))
    rows, at = Counter(), 0
    for d, t in sorted(plain, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = np.array([*want(t), 1], "<u4")
        rows[(d, at, len(ids), crc32(ids.tobytes()))] += 1
        at += len(ids)
    assert got == rows
    where = F.col("doc_id") == 6
    assert token_files.read_tokens(spark, path, where).select("start").first()[0] == next(s for d, s, *_ in rows if d == 6)
    none = new_path(spark, "test")
    token_files.write_tokens(empty, none)
    assert token_files.digests(token_files.read_tokens(spark, none)).count() == 0


def test_file_format(spark, odd):
    import pyarrow.parquet as pq

    path = new_path(spark, "format")
    token_files.write_tokens(odd, path)
    local = path.removeprefix("file:")
    files = [f for f in os.listdir(local) if f.endswith(".parquet")]
    groups = [m.row_group(g) for f in files if (m := pq.ParquetFile(f"{local}/{f}").metadata).num_rows for g in range(m.num_row_groups)]
    ids = [c for g in groups for c in map(g.column, range(g.num_columns)) if c.path_in_schema.startswith("ids")]
    assert ids and all(any("DICTIONARY" in e or "DELTA" in e for e in c.encodings) and c.has_offset_index and c.has_column_index for c in ids)


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 511, 1023, 1024, 1025, 5000])
def test_cuts(n):
    parts = packing.cuts(n)
    assert sum(parts) == n and all(p <= 1024 and (p < 32 or p & (p - 1) == 0) for p in parts) and sum(p < 32 for p in parts) <= 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4000), max_size=60))
def test_bins(lengths):
    bins, filled = packing.Bins(), []
    for i, n in enumerate(lengths):
        for j, length in enumerate(packing.cuts(n)):
            filled += bins.place(length, (i, j))
    filled += bins.close()
    assert sorted(p for s in filled for _, p in s) == sorted((i, j) for i, n in enumerate(lengths) for j in range(len(packing.cuts(n))))
    totals = [sum(n for n, _ in s) for s in filled]
    assert all(0 < t <= 1024 for t in totals)
    rests = sum(n % 32 for n in lengths)
    assert sum(0 if t & (t - 1) == 0 else 1024 - t for t in totals) <= 1024 + 31 * (rests // 512 + 1)


def test_packing_query(odd, plain, empty):
    want = library("byte_bpe_50k.json")
    packed = packing.pack(odd).collect()
    checks = {(r["sequence_id"], r["offset"]): r for r in packing.pieces(packing.pack(odd)).collect()}
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in packed:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and checks[(r["sequence_id"], r["offset"])]["ids_crc32"] == crc32(ids.tobytes())
        docs[(r["doc_id"], r["doc_tokens"])].append((r["start"], ids.tolist()))
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    tokens = Counter((d, len(want(t)) + 1) for d, t in plain)
    for (d, n), count in tokens.items():
        texts = [t for x, t in plain if x == d and len(want(t)) + 1 == n]
        assert sum(len(i) for _, i in docs[(d, n)]) == n * count
        if count == 1:
            assert [i for _, part in sorted(docs[(d, n)]) for i in part] == [*want(texts[0]), 0]
    assert packing.pack(empty).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd, capacity=1000)


def test_packing_keeps_few_pieces():
    """A worker of the packing, whose stage follows others in the same executor, holds no more than two small generations."""
    words = [" ".join(f"w{i}x" for i in range(n, n + 10_000)) for n in range(0, 380_000, 10_000)]
    memo = encoder(tokenizer_path(packing.VOCABULARY), True, packing.MEMO)
    memo.texts(words)
    assert packing.MEMO <= 150_000 and len(memo.pieces) + len(memo.pieces.older) <= 2 * packing.MEMO
    assert len(memo.text(words[0])) == 4 * len(library(packing.VOCABULARY)(words[0]))
