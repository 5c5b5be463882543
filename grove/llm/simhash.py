"""SimHash near-duplicate detection by anchor-point covering.

Anchors are the words of a covering code: the direct sum of two binary Golay codes [23,12], over bits 0-22 and 23-45 of a
fingerprint, and of the Hamming code [15,11] over bits 46-60; the other 3 bits are free. The codes are perfect with radius
3, 3 and 1, so every fingerprint has an anchor within 7, the covering radius. Let x and y differ in at most 3 bits. On a path from x to
y lies a point m with d(x, m) <= 1 and d(m, y) <= 2, and the anchor of m is within 8 of x and within 9 of y. So each
fingerprint is replicated to every anchor within the covering radius plus its share of the threshold (as home within 8, as
visitor within 9), and each anchor compares its homes with its visitors on all 64 bits. No pair is lost, however the
fingerprints lie. There are 2^35 anchors, so that few unrelated fingerprints meet even among billions.

Equal fingerprints are merged before that. An anchor never emits all its pairs: it emits a spanning forest of the links in
it, which has the same components. Components come from alternating star contractions over those links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grove.llm.common import bounded, forget, fresh, id_text, saved, shuffle_partitions, slices, small_batches

WORDS, BITS, SEED = 3, 3, 42
BLOCK = 2048
#: Fingerprints that are replicated to their anchors at a time.
SLICE = 512
#: Generator polynomials of the Golay code (degree 11) and of the Hamming code (degree 4).
GOLAY, HAMMING = 0b101011100011, 0b10011


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """Unsigned XXH64 of each shingle of the text; the whole sequence where it has fewer words; none without words."""
    from xxhash import xxh64_intdigest

    ws = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six white-space bytes only
    if len(ws) < words:
        grams = [b" ".join(ws)] if ws else []
    else:
        grams = map(b" ".join, zip(*(ws[i:] for i in range(words)), strict=False))
    return np.array([xxh64_intdigest(g, SEED) for g in grams], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if more than half of the hashes have it."""
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[a : a + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_map(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(shingle_hashes(t, words)) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long. A null text is empty."""
    return id_text(docs).mapInArrow(fingerprint_map(words), "doc_id long, fp long")


@lru_cache(maxsize=8)
def code(bits: int, generator: int, most: int) -> tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Of a cyclic code: its degree, the syndromes of the bits from there on, and the error patterns of each syndrome.

    A word's syndrome is that of its high bits xor its low bits. Patterns go up to weight most, with their weights.
    """
    degree = generator.bit_length() - 1
    units = []
    for b in range(bits):
        x = 1 << b
        for high in range(b, degree - 1, -1):
            if x >> high & 1:
                x ^= generator << (high - degree)
        units.append(x)
    high = np.zeros(1 << (bits - degree), np.int64)
    for b in range(degree, bits):
        high[1 << (b - degree) : 2 << (b - degree)] = high[: 1 << (b - degree)] ^ units[b]
    unit, value = np.array(units), np.left_shift(1, np.arange(bits))
    some = [np.array(list(combinations(range(bits), w)), np.int64).reshape(comb(bits, w), w) for w in range(most + 1)]
    words = np.concatenate([np.bitwise_or.reduce(value[c], axis=1) if c.shape[1] else np.zeros(1, np.int64) for c in some])
    syndromes = np.concatenate([np.bitwise_xor.reduce(unit[c], axis=1) if c.shape[1] else np.zeros(1, np.int64) for c in some])
    order = np.argsort(syndromes, kind="stable")
    bounds = np.searchsorted(syndromes[order], np.arange((1 << degree) + 1))
    return degree, high, [(e := words[order[a:b]], np.bitwise_count(e)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


class Cover:
    """Anchors: the direct sum of perfect cyclic codes (bits, generator, radius), laid side by side from bit 0.

    Bits of a fingerprint above them are free, or, if tagged, part of the anchor as they are.
    """

    def __init__(self, codes: tuple[tuple[int, int, int], ...], home: int, visitor: int, tagged: bool = False) -> None:
        self.codes, self.home, self.visitor, self.tagged = codes, home, visitor, tagged
        self.radius = sum(r for _, _, r in codes)

    def anchors(self, fp: int, extra: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all anchors within the covering radius plus extra, and their distances."""
        keys, distance, at, least = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, []
        parts = []
        for bits, generator, radius in self.codes:
            degree, high, patterns = code(bits, generator, radius + extra)
            word = fp >> at & (1 << bits) - 1
            errors, weight = patterns[high[word >> degree] ^ word & (1 << degree) - 1]
            parts.append(((word ^ errors) << at, weight))
            least.append(int(weight.min()))
            at += bits
        for i, (words, weight) in enumerate(parts):
            d = distance[:, None] + weight[None, :]
            x, y = np.nonzero(d <= self.radius + extra - sum(least[i + 1 :]))
            keys, distance = keys[x] | words[y], d[x, y]
        return (keys | (fp >> at << at) if self.tagged else keys), distance

    def replicate(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row (anchor, fp, home) for each anchor of each fingerprint; a home is a visitor too."""
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for a in range(0, len(fps), SLICE):
                keys, who, home = [], [], []
                for fp in fps[a : a + SLICE]:
                    far, distance = self.anchors(int(fp) & (1 << 64) - 1, self.visitor)
                    keys.append(far)
                    home.append(distance <= self.radius + self.home)
                    who.append(np.full(len(far), fp, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(who)), pa.array(np.concatenate(home))], names=["anchor", "fp", "home"])


#: Golay, Golay, Hamming over 61 bits; pairs within 3 bits meet as d(x, m) <= 1 and d(m, y) <= 2.
COVER = Cover(((23, GOLAY, 3), (23, GOLAY, 3), (15, HAMMING, 1)), home=1, visitor=2)


def forest(fps: np.ndarray, home: np.ndarray, other: np.ndarray | None, other_home: np.ndarray | None, bits: int) -> list[tuple[int, int]]:
    """Spanning links among fps, or between fps and other, of pairs of a home and a visitor within bits."""
    both = fps if other is None else np.concatenate((fps, other))
    root = list(range(len(both)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out, q, h, base = [], (fps if other is None else other), (home if other is None else other_home), 0 if other is None else len(fps)
    for i in range(len(fps)):
        lo = i + 1 if other is None else 0
        near = np.flatnonzero((np.bitwise_count(q[lo:] ^ fps[i]) <= bits) & (home[i] | h[lo:])) + lo + base
        for j in near:
            a, b = find(i), find(int(j))
            if a != b:
                root[a] = b
                out.append((int(fps[i]), int(both[j])))
    return out


def links_of(cols: list[np.ndarray], bits: int, many) -> list[tuple[int, int]]:
    """Links within each run of equal (anchor, left, right); runs of one and two members cost no Python loop.

    cols: anchor, fp, home and, for anchors dealt in blocks, left, right and the member's own block, side. many: the links of
    larger runs.
    """
    anchor, fp, home, *blocks = cols
    if not len(anchor):
        return []
    change = anchor[1:] != anchor[:-1]
    for x in blocks[:2]:
        change |= x[1:] != x[:-1]
    new = np.flatnonzero(np.concatenate(([True], change)))
    ends = np.append(new[1:], len(anchor))
    pair = new[ends - new == 2]
    ok = (np.bitwise_count(fp[pair] ^ fp[pair + 1]) <= bits) & (home[pair] | home[pair + 1])
    if blocks:
        ok &= (blocks[0][pair] == blocks[1][pair]) | (blocks[2][pair] != blocks[2][pair + 1])
    pair = pair[ok]
    out = list(zip(fp[pair].tolist(), fp[pair + 1].tolist(), strict=True))
    for a, b in zip(new[ends - new > 2], ends[ends - new > 2], strict=True):
        f, h = fp[a:b], home[a:b]
        if not blocks or blocks[0][a] == blocks[1][a]:
            out += many(f, h, None, None, bits)
        else:
            s = blocks[2][a:b] == blocks[0][a]
            out += many(f[s], h[s], f[~s], h[~s], bits)
    return out


def columns(batch: pa.RecordBatch, names: tuple[str, ...]) -> list[np.ndarray]:
    cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
    cols[1] = cols[1].view(np.uint64)
    return cols


def as_links(found: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    e = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
    e = np.unique(np.stack((e.max(axis=1), e.min(axis=1))), axis=1)
    return e[0], e[1]


def compare(batches: Iterator[pa.RecordBatch], bits: int = BITS, many=forest) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor to links (u, v, anchor null), and the members of anchors of more than BLOCK as they are (home, fp, anchor)."""
    held, crowded = None, None

    def batch_of(found: list[tuple[int, int]], crowd: list[np.ndarray]) -> pa.RecordBatch:
        u, v = as_links(found)
        anchor, fp, home = crowd
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate((u, home.astype(np.int64)))), pa.array(np.concatenate((v, fp.view(np.int64)))), pa.array([None] * len(u) + anchor.tolist(), pa.int64())], names=["u", "v", "anchor"])

    for batch in batches:
        cols = columns(batch, ("anchor", "fp", "home"))
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        anchor = cols[0]
        last = int(np.searchsorted(anchor, anchor[-1]))
        starts = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        sizes = np.diff(np.append(starts, len(anchor)))
        big = np.repeat((sizes > BLOCK) | (anchor[starts] == crowded if crowded is not None else False), sizes)
        if big[-1]:
            crowded, last = int(anchor[-1]), len(anchor)  # its other members come in later batches and are passed on too
        held = [c[last:] for c in cols]
        done = [c[:last] for c in cols]
        yield batch_of(links_of([c[~big[:last]] for c in done], bits, many), [c[big[:last]] for c in done])
    if held is not None and len(held[0]):
        yield batch_of(links_of(held, bits, many), [c[:0] for c in held])


def compare_blocks(batches: Iterator[pa.RecordBatch], bits: int = BITS, many=forest) -> Iterator[pa.RecordBatch]:
    """Links between two blocks of a crowded anchor; rows come sorted by (anchor, left, right)."""
    held = None
    for batch in batches:
        cols = columns(batch, ("anchor", "fp", "home", "left", "right", "side"))
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        same = (cols[0] == cols[0][-1]) & (cols[3] == cols[3][-1]) & (cols[4] == cols[4][-1])
        cut = int(np.argmax(same))
        held = [c[cut:] for c in cols]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in as_links(links_of([c[:cut] for c in cols], bits, many))], names=["u", "v"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in as_links(links_of(held, bits, many))], names=["u", "v"])


def link_forest(fps: DataFrame, cover: Cover = COVER, bits: int = BITS, many=forest) -> DataFrame:
    """(u, v), u > v: links that have the components of all links between the distinct fps.

    One shuffle brings an anchor's members together. An anchor of up to BLOCK members, as nearly all are, is compared there.
    The members of a larger one only pass through: they are dealt into blocks, and blocks meet in pairs, each pair in a task
    of its own, so that no task compares a whole anchor, however many members it has.
    """
    parts = shuffle_partitions(fps.sparkSession)
    members = fps.select("fp").repartition(parts, "fp").mapInArrow(cover.replicate, "anchor long, fp long, home boolean")
    near = members.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(lambda b: compare(b, bits, many), "u long, v long, anchor long")
    found = saved(near, "compared")
    links = found.where("anchor IS NULL").select("u", "v")
    crowd = found.where("anchor IS NOT NULL").select("anchor", F.col("v").alias("fp"), (F.col("u") == 1).alias("home"))
    sized = crowd.join(crowd.groupBy("anchor").agg(F.count("*").alias("n")), "anchor")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    spread = sized.select("anchor", "fp", "home", own.alias("side"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    rows = spread.select("anchor", "fp", "home", F.least("side", "other").alias("left"), F.greatest("side", "other").alias("right"), "side")
    dealt = rows.repartition(parts, "anchor", "left", "right").sortWithinPartitions("anchor", "left", "right")
    return links.union(dealt.mapInArrow(lambda b: compare_blocks(b, bits, many), "u long, v long")).distinct()


def contract(links: DataFrame) -> DataFrame:
    """(fp, root): the smallest signed fp of each component, for every fp that has a link.

    Alternating large-star and small-star steps until nothing changes. Minima are combined before the shuffle and written, so
    that the join with them shuffles both sides anew and can be split where one star has most of the leaves. Each step is
    written to the shared folder.
    """
    edges = saved(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "links")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.where("v > u").join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = saved(large, "large")
        low = saved(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        small = saved(small, "small")
        same = small.select(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        before = edges.select(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        forget(edges, lows, large, low)
        edges = small
        if same == before:
            roots = edges.select(F.col("u").alias("fp"), F.col("v").alias("root"))
            roots.scratch = edges.scratch
            return roots


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp, component_id) for each row: the smallest doc_id of its component, itself included.

    Null and empty texts have fingerprint zero and link like any other; a null doc_id counts as the largest id; rows that
    repeat an id stay rows of their own; an empty table gives none.
    """
    prints = saved(fingerprints(docs, words), "prints")
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = contract(link_forest(distinct.select("fp")))
    of = distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    least = of.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = of.join(least, "root").select("fp", "component_id")
    return prints.join(found, "fp").select("doc_id", "fp", "component_id")


def components(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near duplicates by word shingles: fingerprints find most links, and an exact join over prefixes of the sets finds the rest.

LAST_ID = 2**63 - 1
#: Shingles of LEAST or more of about SAMPLE texts, COMMON of them at most, come last in the order of shingles. The order decides
#: how many candidates there are, never which pairs are found.
SAMPLE, LEAST, COMMON = 10_000, 4, 50_000
SLACK = 1e-6
#: Fingerprints of shingles within 2 bits meet as d(x, m) <= 1 and d(m, y) <= 1.
NEAR_BITS, NEAR_COVER = 2, Cover(COVER.codes, home=1, visitor=1)
#: The parity of a set's shingles in each of 64 * 8 buckets. Two sets differ in as many shingles as their bitmaps in bits, or more.
BITMAP = tuple(f"b{i}" for i in range(8))
#: Before the sets themselves, bitmaps of 64 * WIDE buckets are compared.
WIDE = 64
#: So many times each set is paired with one other, before all pairs that are left in different groups.
TURNS = 3


def prefix(shingles: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a sorted set, common ones last: so many that sets as similar have one of them in common.

    Of n shingles, at least similarity * n are in the other set, and so the first common one is among the first n - that + 1.
    """
    n = len(shingles)
    if n and len(common):
        last = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles
        shingles = np.concatenate((shingles[~last], shingles[last]))
    return shingles[: n - int(np.ceil(similarity * n - SLACK)) + 1]


def bitmap(shingles: np.ndarray, longs: int = len(BITMAP)) -> np.ndarray:
    odd = np.bincount((shingles >> np.uint64(7)).astype(np.int64) & 64 * longs - 1, minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def shingle_counts(words: int):
    """Rows (shingle, n): in how many texts of a batch a shingle is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t, words)) for t in b.column("text").to_pylist()]
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["shingle", "n"])

    return run


def common_shingles(texts: DataFrame, words: int) -> np.ndarray:
    share = min(1.0, SAMPLE / max(1, texts.count()))
    some = texts.where(F.pmod(F.xxhash64("doc_id", "digest"), F.lit(1 << 20)) < int(share * (1 << 20)))
    found = some.select("text").mapInArrow(shingle_counts(words), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = found.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "shingle").limit(COMMON).select("shingle").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


PRINTS = "doc_id long, digest string, same binary, n long, fp long, prefix array<bigint>, " + ", ".join(f"{b} long" for b in BITMAP)


def print_rows(words: int, similarity: float, common: np.ndarray):
    """Of each text: a digest of its set of shingles, the set's size, prefix and bitmap, and the fingerprint of all its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        for batch in batches:
            for b in slices(batch, 1024):
                same, n, fp, first, bits = [], [], [], [], []
                for t in b.column("text").to_pylist():
                    h = shingle_hashes(t, words)
                    s = np.unique(h)
                    same.append(blake2b(s.tobytes(), digest_size=16).digest())
                    n.append(len(s))
                    fp.append(simhash(h))
                    first.append(prefix(s, common, similarity).view(np.int64))
                    bits.append(bitmap(s))
                ends = np.cumsum([0, *map(len, first)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *first])))
                words_of = np.array(bits, np.int64).reshape(-1, len(BITMAP))
                cols = [b.column("doc_id"), b.column("digest"), pa.array(same, pa.binary()), pa.array(n, pa.int64()), pa.array(np.array(fp, np.uint64).view(np.int64)), lists, *(pa.array(words_of[:, i].copy()) for i in range(len(BITMAP)))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "digest", "same", "n", "fp", "prefix", *BITMAP])

    return run


def text_sets(words: int):
    """Rows (v, text) to (v, shingles, wide): the sorted set of the whole text's shingles, and a bitmap of it as of WIDE words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 256):
                sets = [np.unique(shingle_hashes(t, words)) for t in b.column("text").to_pylist()]
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("v"), pa.array([s.view(np.int64) for s in sets], longs), pa.array([bitmap(s, WIDE) for s in sets], longs)], names=["v", "shingles", "wide"])

    return run


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, digest): a null id as the largest."""
    return id_text(docs).select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"), "text", F.sha2("text", 256).alias("digest"))


def may_be_alike(similarity: float) -> Column:
    """Of two sets side by side (sizes m and n, bitmaps with x and y after their names): whether they can be as similar.

    Sets as similar differ in (1 - s) / (1 + s) * (m + n) shingles at most.
    """
    apart = sum((F.bit_count(F.col(f"{b}x").bitwiseXOR(F.col(f"{b}y"))) for b in BITMAP), F.lit(0))
    return (F.least("m", "n") >= similarity * F.greatest("m", "n") - SLACK) & (apart <= most_apart(similarity))


def most_apart(similarity: float) -> Column:
    return (1 - similarity) / (1 + similarity) * (F.col("m") + F.col("n")) + SLACK


def side(once: DataFrame, v: str, n: str, mark: str) -> DataFrame:
    return once.select(F.col("v").alias(v), F.col("n").alias(n), *(F.col(b).alias(b + mark) for b in BITMAP))


def checked(pairs: DataFrame, once: DataFrame, texts: DataFrame, words: int, similarity: float, repeats: bool) -> DataFrame:
    """(u, v): those of the pairs (a, b) whose sets of shingles are as similar, by the whole texts. Only texts of pairs are read into sets.

    Wide bitmaps show most of the other pairs, so that few sets meet. repeats: whether some rows have both id and text in common.
    """
    pairs = saved(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct()
    needed = saved(once.join(wanted, "v").select("v", "first.*"), "needed")
    picked = texts.join(bounded(needed), ["doc_id", "digest"]).select("v", "text")
    sets = saved((picked.dropDuplicates(["v"]) if repeats else picked).mapInArrow(text_sets(words), "v long, shingles array<bigint>, wide array<bigint>"), "sets")

    def beside(pairs: DataFrame, what: str) -> DataFrame:
        x, y = (sets.select(F.col("v").alias(v), F.col(what).alias(to)) for v, to in (("a", "x"), ("b", "y")))
        return pairs.join(x, "a").join(y, "b")

    sizes = once.select("v", "n")
    apart = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, n: total + n)
    sized = beside(pairs, "wide").join(sizes.select(F.col("v").alias("a"), F.col("n").alias("m")), "a").join(sizes.withColumnRenamed("v", "b"), "b")
    may = saved(sized.where(apart <= most_apart(similarity)).select("a", "b"), "may")
    both = F.size(F.array_intersect("x", "y"))
    found = beside(may, "shingles").where(both >= similarity * (F.size("x") + F.size("y") - both))
    found = saved(found.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "alike")
    forget(pairs, needed, sets, may)
    return found


def fingerprint_pairs(once: DataFrame) -> DataFrame:
    """(a, b): sets of equal fingerprints, and of linked ones, each with the first set of its fingerprint."""
    firsts = saved(once.groupBy("fp").agg(F.min("v").alias("one")), "firsts")
    near = link_forest(firsts.select("fp"), NEAR_COVER, NEAR_BITS)
    u, v = (firsts.select(F.col("fp").alias(c), F.col("one").alias(to)) for c, to in (("u", "a"), ("v", "b")))
    return once.join(firsts, "fp").where("v <> one").select(F.col("one").alias("a"), F.col("v").alias("b")).union(near.join(u, "u").join(v, "v").select("a", "b"))


def shared_shingles(once: DataFrame) -> DataFrame:
    """(shingle, v, n, pos, prev, w): of the shingles in several prefixes, one row for each set, with the shingle before it there.

    w shingles with the same sets are one, at their first place. They are told by a hash of their sets; those that a chance makes
    one give more candidates, never fewer.
    """
    each = Window.partitionBy("shingle")
    tokens = once.select("v", "prefix", F.posexplode("prefix").alias("pos", "shingle")).select("v", "shingle", "pos", F.get("prefix", F.col("pos") - 1).alias("prev"))
    several = tokens.withColumn("texts", F.count("*").over(each)).where("texts > 1").withColumn("all", F.xxhash64("texts", F.bit_xor(F.xxhash64("v")).over(each)))
    ones = several.groupBy(F.col("all").alias("shingle"), "v").agg(F.min(F.struct("pos", "prev")).alias("at"), F.count("*").alias("w"))
    return saved(ones.join(once.select("v", "n"), "v").select("shingle", "v", "n", "at.*", "w"), "shared")


def mixed_shingles(shared: DataFrame, roots: DataFrame | None, similarity: float, turn: int) -> DataFrame:
    """Of shared, the shingles whose sets are in several groups, with root, the shingle's main (largest) group, and center, a set of it.

    The first shingle that two similar sets have in common has at most (1 - s) / (1 + s) * (m + n) others before it in both
    together. Rows too far behind to be that of any pair go. Each turn takes other centers.
    """
    parts = shuffle_partitions(shared.sparkSession)
    each = Window.partitionBy("shingle")
    member = shared.select("shingle", "v", "n", "pos", "prev", "w")
    member = member.withColumn("root", F.col("v")) if roots is None else member.join(roots.withColumnRenamed("fp", "v"), "v", "left").withColumn("root", F.coalesce("root", "v"))
    sized = member.repartition(parts, "shingle").withColumn("size", F.count("*").over(Window.partitionBy("shingle", "root")))
    several = F.min("root").over(each) != F.max("root").over(each)
    found = sized.select("*", F.max(F.struct("size", "root")).over(each)["root"].alias("main"), F.min("pos").over(each).alias("least"), several.alias("several")).where("several").drop("several", "size")
    near = found.where(F.col("pos") + F.col("least") <= (1 - similarity) / similarity * F.col("n") + SLACK).drop("least")
    center = F.min(F.when(F.col("root") == F.col("main"), F.struct(F.xxhash64("v", F.lit(turn)), "v"))).over(each)["v"]
    return saved(near.withColumn("center", center), "mixed")


def star_pairs(mixed: DataFrame, once: DataFrame, similarity: float) -> DataFrame:
    """(a, b): each set outside a shingle's main group with one set of such a group, that with which it shares most of its shingles."""
    many = mixed.where("root <> main AND center IS NOT NULL").groupBy("center", "v").agg(F.sum("w").alias("both"))
    best = many.groupBy("v").agg(F.max(F.struct("both", "center")).alias("best")).select(F.col("best.center").alias("a"), F.col("v").alias("b"))
    return best.join(side(once, "a", "m", "x"), "a").join(side(once, "b", "n", "y"), "b").where(may_be_alike(similarity)).select("a", "b")


def other_pairs(mixed: DataFrame, once: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs of different groups that can be as similar. Of a shingle's sets, those outside its main group meet all others.

    A pair is wanted at the first shingle that it has in common: not where the shingles before are too many, or the same one.
    """
    rows = saved(mixed.join(once.select("v", *BITMAP), "v"), "rows")
    left = rows.where("root <> main").select("shingle", F.col("v").alias("a"), F.col("n").alias("m"), F.col("pos").alias("p"), F.col("prev").alias("prev_a"), F.col("root").alias("root_a"), *(F.col(b).alias(b + "x") for b in BITMAP))
    right = rows.select("shingle", F.col("v").alias("b"), "n", F.col("pos").alias("q"), F.col("prev").alias("prev_b"), F.col("root").alias("root_b"), "main", *(F.col(b).alias(b + "y") for b in BITMAP))
    first = (F.col("p") + F.col("q") <= most_apart(similarity)) & F.expr("root_a <> root_b AND (root_b = main OR a < b) AND NOT coalesce(prev_a = prev_b, false)")
    met = left.join(right, (left["shingle"] == right["shingle"]) & first & may_be_alike(similarity))
    pairs = saved(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "others")
    forget(rows)
    return pairs


def joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """The groups (fp, root) that those before and the links give; links goes."""
    new = contract(links if roots is None else links.union(roots.select(F.col("fp").alias("u"), F.col("root").alias("v"))))
    forget(*(df for df in (links, roots) if df is not None))
    return new


def grouped(docs: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame, bool]:
    """(doc_id, digest, same, mine) for each row, (same, first) for each set of shingles, and whether rows repeat both id and text.

    first: the first (doc_id, digest) of the set's group.

    An id that repeats with other texts stands for the first of them by digest, whose rows are mine; each text without an id
    stands for itself.

    Texts of equal sets are merged first. Candidates are the pairs whose SimHash fingerprints meet at an anchor, and each set with
    one that shares most of its rare shingles with it; whole texts decide. Further turns pair what is left with other sets of the
    groups that came of it. Then all pairs are taken that those links leave in different groups, that have a shingle of their prefixes in
    common, and whose sizes, places of that shingle and bitmaps allow the similarity: so no pair is lost.
    """
    texts = keyed_texts(docs)
    common = common_shingles(texts, words)
    prints = saved(texts.mapInArrow(print_rows(words, similarity, common), PRINTS), "prints")
    repeated = prints.where(F.col("doc_id") < LAST_ID).groupBy("doc_id").agg(F.min("digest").alias("own"), F.max("digest").alias("last")).where("own <> last").select("doc_id", "own")
    marked = prints.join(repeated, "doc_id", "left").withColumn("mine", F.expr("own IS NULL OR own = digest"))
    sets = marked.where("mine").groupBy("same").agg(F.min(F.struct("doc_id", "digest")).alias("first"), F.min("fp").alias("fp"), *(F.first(c).alias(c) for c in ("n", "prefix", *BITMAP)))
    once = saved(sets.withColumn("v", F.monotonically_increasing_id()), "once")
    rows = saved(marked.select("doc_id", "digest", "same", "mine"), "rows")
    forget(prints)
    repeats = rows.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0
    mixed = shared_shingles(once)
    links, roots = fingerprint_pairs(once), None
    for turn in range(TURNS):
        shared, mixed = mixed, mixed_shingles(mixed, roots, similarity, turn)
        forget(shared)
        stars = star_pairs(mixed, once, similarity)
        found = checked(links.union(stars).distinct() if roots is None else stars, once, texts, words, similarity, repeats)
        roots = joined(roots, found)
    last = mixed_shingles(mixed, roots, similarity, TURNS)
    forget(mixed)
    others = other_pairs(last, once, similarity)
    found = checked(others, once, texts, words, similarity, repeats)
    forget(last, others)
    roots = joined(roots, found)
    of = once.join(roots.select(F.col("fp").alias("v"), "root"), "v", "left").select("same", F.coalesce("root", "v").alias("root"), "first")
    least = of.groupBy("root").agg(F.min("first").alias("first"))
    return rows, of.select("same", "root").join(least, "root").select("same", "first"), repeats


def duplicate_ids(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(doc_id, first_id) for each row (null as the largest id): the smallest id of its group of exact and near copies.

    Groups are the components of the pairs of texts whose sets of word shingles reach the similarity.
    """
    rows, groups, _ = grouped(docs, words, similarity)
    return rows.where("mine").join(groups, "same").select("doc_id", F.col("first.doc_id").alias("first_id"))


def representatives(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The documents of which each group keeps one: that of the smallest doc_id (null last), and of its texts the first by digest.

    Groups are of texts, so that rows without an id and with other texts stay. Rows that repeat an id are one document.
    """
    rows, groups, repeats = grouped(docs, words, similarity)
    gone_id, gone_digest = fresh(docs, "gone_id", "gone_digest")
    key = (F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST_ID)) == F.col(gone_id)) & (F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256) == F.col(gone_digest))
    keys = lambda df, what: bounded(saved(df.select(F.col("doc_id").alias(gone_id), F.col("digest").alias(gone_digest)).distinct(), what))
    gone = rows.join(groups, "same", "left").where(~F.col("mine") | (F.col("doc_id") != F.col("first.doc_id")) | (F.col("digest") != F.col("first.digest")))
    kept = docs.join(keys(gone, "gone"), key, "left_anti")
    if not repeats:
        return kept
    again = keys(rows.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1"), "again")
    return kept.join(again, key, "left_anti").unionByName(kept.join(again, key).dropDuplicates([gone_id, gone_digest]).select(*docs.columns))
