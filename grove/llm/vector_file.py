"""Exact top-k by inner product with vector-approximation files.

A first pass writes the approximation file: of each vector one byte a component, the number of one of CELLS equal intervals of
the vector's own range, and that range. Queries and approximations are dealt into a grid: a cell holds about QUERIES queries and
about CANDIDATES approximations, whatever their number. A scan of those alone bounds every score from both sides, and gives the
vectors that can be among the k best there, and the kth best lower bound over all cells rules out more. Exact vectors of what is
left are read in the order of their upper bounds, in rounds of k, then k more, 2k, 4k and so on for each query, until the kth best exact score is
certain: no bound left reaches it. A query reads at most about twice what one vector at a time would need, in few rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grove.llm.common import bounded, forget, saved, slices

QUERIES, CANDIDATES, CELLS, UNIT = 2048, 16384, 256, 1024
#: Scores are held to the range of long.
MOST = 2.0**63


def integers(column: pa.ChunkedArray) -> np.ndarray:
    """floor(UNIT * x) of each component, as doubles that are whole numbers."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(UNIT * flat).reshape(len(lists), -1) + 0.0 if len(lists) else np.zeros((0, 0))


class Approximation:
    """One byte a component, and bounds of inner products from them."""

    def __init__(self, low: np.ndarray, width: np.ndarray, code: np.ndarray) -> None:
        self.low, self.width, self.code = low, width, code
        self.plain = code.astype(np.float32)

    @classmethod
    def of(cls, x: np.ndarray) -> Approximation:
        low, high = (x.min(1), x.max(1)) if x.shape[1] else (np.zeros(len(x)), np.zeros(len(x)))
        width = (high - low) / CELLS
        step = np.where(width > 0, width, 1.0)
        return cls(low, width, np.minimum((x - low[:, None]) / step[:, None], CELLS - 1).astype(np.uint8))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the best possible score of each query with each vector, rounding included."""
        with np.errstate(all="ignore"):
            dots = (q.astype(np.float32) @ self.plain.T).astype(np.float64)
            middle = q.sum(1)[:, None] * (self.low + self.width / 2) + dots * self.width
            rounding = (q.shape[1] + 4) * (1.2e-7 * CELLS * self.width + 1e-12 * (np.abs(self.low) + CELLS * self.width))
            far = np.abs(q).sum(1)[:, None] * (self.width / 2 + rounding) + 1
            known = np.isfinite(middle) & np.isfinite(far)
            return np.where(known, np.clip(middle - far, -MOST, MOST), -MOST), np.where(known, np.clip(middle + far, -MOST, MOST), MOST)


def needed_copies(ids: np.ndarray, same: np.ndarray, k: int) -> np.ndarray:
    """Places of the k + 1 smallest ids of each distinct vector (rows of same), in order of ids: no others can be among k best."""
    order = np.lexsort((ids, same[:, 1], same[:, 0]))
    s, i = same[order], ids[order]
    other = np.concatenate(([True], (s[1:] != s[:-1]).any(axis=1)))
    new = other.copy()
    new[1:] |= i[1:] != i[:-1]
    nth = np.cumsum(new)
    kept = order[new & (nth - nth[np.maximum.accumulate(np.where(other, np.arange(len(i)), 0))] <= k)]
    return kept[np.argsort(ids[kept], kind="stable")]


def candidates(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, file: Approximation, k: int) -> tuple[np.ndarray, ...]:
    """(query, id, least, best) of all vectors that can be among the k best here. ids are sorted; rows of one id count as one."""
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    names = ids[first]
    out = []
    for a in range(0, len(q), 256):
        asked = q_ids[a : a + 256]
        least, best = file.bounds(q[a : a + 256])
        if len(first) < len(ids):
            least, best = np.maximum.reduceat(least, first, axis=1), np.maximum.reduceat(best, first, axis=1)
        own = np.minimum(np.searchsorted(names, asked), len(names) - 1)
        at = np.flatnonzero(names[own] == asked)
        least[at, own[at]] = best[at, own[at]] = -np.inf
        sure = np.partition(least, len(names) - k, axis=1)[:, [len(names) - k]] if len(names) > k else -np.inf
        row, col = np.nonzero((best >= sure) & (best > -np.inf))
        out.append((asked[row], names[col], least[row, col], best[row, col]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row, held to the range of long."""
    with np.errstate(all="ignore"):
        out, plain = np.empty(len(q), np.int64), (np.abs(q) * np.abs(x)).sum(1) < 2**53
    out[plain] = (q[plain] * x[plain]).sum(1).astype(np.int64)
    for i in np.flatnonzero(~plain):
        out[i] = max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(q[i], x[i], strict=True))))
    return out


def search(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, id, score) of the k best candidates of each query in memory, its own id left out; ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    found: dict[int, dict[int, int]] = {}
    for i, row in zip(q_ids, q, strict=True):
        _, near, *_ = candidates(np.array([i]), row[None], ids, Approximation.of(x), k)
        at = np.flatnonzero(np.isin(ids, near))
        best = found.setdefault(int(i), {})
        for j, s in zip(ids[at].tolist(), exact_scores(np.broadcast_to(row, x[at].shape), x[at]).tolist(), strict=True):
            best[j] = max(s, best.get(j, s))
    return [(i, j, s) for i, best in found.items() for j, s in sorted(best.items(), key=lambda t: (-t[1], t[0]))[:k]]


def by_length(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The rows in small batches of vectors of one length."""
    for batch in batches:
        for b in slices(batch, 4096):
            sizes = pc.list_value_length(b.column(column))
            for n in sizes.unique():
                yield b.filter(pc.equal(sizes, n))


def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the approximation file, with a digest of the exact vector."""
    from hashlib import blake2b

    for b in by_length(batches, "embedding"):
        x = integers(b.column("embedding"))
        file = Approximation.of(x)
        cols = [b.column("vec_id"), pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(file.low), pa.array(file.width), pa.array([r.tobytes() for r in file.code], pa.binary()), pa.array([blake2b(r.tobytes(), digest_size=16).digest() for r in x], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "dim", "low", "width", "code", "same"])


def score_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in by_length(batches, "q"):
        score = exact_scores(integers(b.column("q")), integers(b.column("x")))
        yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("vec_id"), pa.array(score)], names=["query_id", "vec_id", "score"])


def usable(c: Column) -> Column:
    return c.isNotNull() & ~F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def in_order(value: str) -> Column:
    """The place of a row (query_id, vec_id, value) in its query, highest value first, ties to the smaller id."""
    return F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(value), "vec_id"))


def read_in_order(ranked: DataFrame, asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the exact vectors read: all whose upper bound reaches a query's kth best exact score are among them.

    ranked: (query_id, vec_id, best, nth), nth by descending upper bound. Each round is written, and the next one starts from it.
    """
    scores, at, step = None, 0, k
    while True:
        due = ranked.where((F.col("nth") > at) & (F.col("nth") <= at + step))
        if scores is not None:
            each = scores.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            kth = each.withColumn("place", in_order("score")).where(F.col("place") == k).select("query_id", F.col("score").cast("double").alias("kth"))
            due = due.join(kth, "query_id", "left").where(F.col("kth").isNull() | (F.col("best") >= F.col("kth") - F.abs("kth") * 1e-15))
        wanted = saved(due.select("query_id", "vec_id"), "wanted")
        if scores is not None and wanted.isEmpty():
            forget(wanted)
            return scores
        read = bounded(wanted).join(rows.withColumnRenamed("embedding", "x"), "vec_id")
        pairs = read.join(asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id").where(F.size("q") == F.size("x"))
        found = saved(pairs.select("query_id", "vec_id", "q", "x").mapInArrow(score_pairs, "query_id long, vec_id long, score long"), "exact")
        forget(wanted)
        scores = found if scores is None else scores.union(found)
        at, step = at + step, k if at == 0 else 2 * step


def top_k(vectors: DataFrame, every: int, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by every, the k best others.

    Scores are inner products of floor(1024 * x), held to the range of long. Vectors that are null or hold null or non-finite
    components, and rows without an id, take no part; vectors of different lengths aren't compared; an empty table gives no
    rows; rows that repeat an id count as one candidate, with the highest score; other columns are left out.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    asked = rows.where(F.col("vec_id") % every == 0)
    file = saved(rows.mapInArrow(approximate, "vec_id long, dim int, low double, width double, code binary, same binary"), "approximation")
    total, n_asked = file.select(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    across, down = max(1, ceil(n_asked / QUERIES)), max(1, ceil(total / CANDIDATES))
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    q = asked.select(F.size("embedding").alias("dim"), place(across).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("c"), "vec_id", "embedding")
    x = file.select("dim", F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("g"), place(down).alias("c"), "vec_id", "low", "width", "code", "same")

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2
        if left.num_rows and right.num_rows:
            same = np.frombuffer(b"".join(right.column("same").to_pylist()), np.uint64).reshape(-1, 2)
            right = right.take(pa.array(needed_copies(right.column("vec_id").to_numpy(), same, k)))
            code = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(right.num_rows, -1)
            scan = Approximation(right.column("low").to_numpy(), right.column("width").to_numpy(), code)
            found = candidates(left.column("vec_id").to_numpy(), integers(left.column("embedding")), right.column("vec_id").to_numpy(), scan, k)
        return pa.table(dict(zip(("query_id", "vec_id", "least", "best"), map(pa.array, found), strict=True)))

    key = ("dim", "g", "c")
    scanned = q.groupBy(*key).cogroup(x.groupBy(*key)).applyInArrow(cell, "query_id long, vec_id long, least double, best double")
    bounds = saved(scanned.groupBy("query_id", "vec_id").agg(F.max("least").alias("least"), F.max("best").alias("best")), "bounds")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("least"), "vec_id"))
    sure = bounds.withColumn("nth", nth).where(F.col("nth") == k).select("query_id", F.col("least").alias("sure"))
    open_pairs = bounds.join(sure, "query_id", "left").where("sure IS NULL OR best >= sure")
    ranked = saved(open_pairs.select("query_id", "vec_id", "best", in_order("best").alias("nth")), "open")
    forget(bounds, file)
    exact = read_in_order(ranked, asked, rows, k)
    forget(ranked)
    best = exact.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", in_order("score")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(every: int = 100, k: int = 10) -> str:
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({UNIT} * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, coalesce(list_sum(list_transform(range(1, len(v.e) + 1), lambda i: q.e[i] * v.e[i])), 0)::BIGINT AS score
    FROM v AS q, v WHERE q.vec_id % {every} = 0 AND v.vec_id <> q.vec_id AND len(q.e) = len(v.e)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {k}"""
