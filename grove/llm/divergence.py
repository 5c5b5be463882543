"""How far the sources of a language differ in their words: wide term vectors, pairs of sources, and each source's own terms.

Every kept term of a language is one row with an array of its counts, a place for each source of that language. Higher-order
functions turn the counts into shares and the shares into an entry a pair of sources; map-side aggregation sums the entries.
All arithmetic is in whole numbers, and exact while a language has fewer than 2.8e14 occurrences of kept terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grove.llm.common import saved, small_batches

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of a language that a kept term occurs in at least, what is added to each count, and the ranks of terms returned.
DOCS, ADDED, RANKS = 30, 5, 50
#: The sizes of a language are repeated so often, so that its terms needn't meet in one task where they aren't broadcast.
SALTS = 64
#: Bytes of a text that are split into terms at a time, and terms that a task counts before it gives the counts out.
PIECE, HELD = 4 << 20, 500_000


def share(n: str, of: str) -> str:
    """SQL of 1 + floor(1e9 * n / of) for n <= of, in two steps so that no product passes 64 bits."""
    return f"(1 + (31250 * ({n})) div ({of}) * 32000 + ((31250 * ({n})) % ({of}) * 32000) div ({of}))"


def named(docs: DataFrame) -> DataFrame:
    """text, lang and source of each row, nulls as empty."""
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


#: Bytes to bytes of UTF-8: capitals in lower case, other ASCII that is no letter as a space, all else as it is.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def term_lists(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of those of about PIECE bytes."""
    folded = text.encode().translate(_FOLD)
    at = 0
    while at < len(folded):
        cut = folded.find(b" ", at + PIECE)
        cut = cut if cut >= 0 else len(folded)
        yield folded[at:cut].split()
        at = cut


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's rows by lang, source and term, given out whenever HELD terms have been met and at the end."""
    found: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in found.items():
            terms = pa.array(list(n), pa.binary()).cast(pa.string())
            k = len(terms)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), terms, pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        found.clear()

    held = 0
    for b in batches:
        for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            if (counts := found.get((lang, source))) is None:
                counts = found[lang, source] = (Counter(), Counter())
            n, docs = counts
            held -= len(n)
            seen: set[bytes] = set()
            for terms in term_lists(text):
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            held += len(n)
            if held > HELD:
                yield from flush()
                held = 0
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and the rows that hold the term.

    Each task counts its own rows, so that hot sources and terms shuffle no more than others. What it counted is dealt by lang and
    term, which the sums here and those of kept_terms both keep.
    """
    found = small_batches(named(docs)).mapInArrow(partial_counts, "lang string, source string, term string, n long, docs long")
    return found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least: int = DOCS) -> DataFrame:
    """(lang, term, n, by_source): terms in at least so many documents of the language; by_source has at most one entry a source."""
    entry = F.struct("source", "n")
    return counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(entry).alias("by_source")).where(F.col("docs") >= least).drop("docs")


def sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, sources, bases, base): a row a language; its sources in order, and the denominators of their shares and the language's."""
    groups = named(docs).select("lang", "source").distinct()
    of_group = kept.select("lang", F.explode("by_source").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n"))
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("all"))
    rows = groups.join(of_group, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("g"))
    added = ADDED * F.coalesce("v", F.lit(0))
    sized = rows.join(of_lang, "lang", "left").select("lang", "g", added.alias("added"), (F.coalesce("all", F.lit(0)) + added).alias("base"))
    return sized.select("lang", F.expr("transform(g, x -> x.source)").alias("sources"), F.expr("transform(g, x -> x.n + added)").alias("bases"), "base")


def vectors(kept: DataFrame, sized: DataFrame) -> DataFrame:
    """(lang, term, sources, counts, p, q): the wide rows; p has the share of the term in each source, q in the language."""
    salted = sized.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    wide = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"])
    wide = wide.withColumn("found", F.map_from_entries("by_source")).withColumn("counts", F.expr("transform(sources, s -> coalesce(try_element_at(found, s), 0L))"))
    p = F.expr(f"transform(counts, (n, i) -> {share(f'n + {ADDED}', 'bases[i]')})")
    return wide.select("lang", "term", "sources", "counts", p.alias("p"), F.expr(share(f"n + {ADDED}", "base")).alias("q"))


def pair_sums(wide: DataFrame) -> DataFrame:
    """(lang, i, j, value): the summed difference of two sources of a language, i < j being their places."""
    entries = F.expr("flatten(transform(p, (x, i) -> transform(slice(p, i + 2, size(p)), (y, k) -> struct(i, i + 1 + k as j, abs(x - y) as f))))")
    return wide.select("lang", F.explode(entries).alias("e")).groupBy("lang", "e.i", "e.j").agg(F.sum("e.f").alias("value"))


def pairs(sized: DataFrame, sums: DataFrame) -> DataFrame:
    """(lang, source, item, value): every source with every other of its language; 0 where the language keeps no term."""
    each = sized.select("lang", "sources", F.posexplode("sources").alias("a", "source")).select("lang", "source", "a", F.posexplode("sources").alias("b", "item")).where("a <> b")
    keyed = each.select("lang", "source", "item", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))
    return keyed.join(sums, ["lang", "i", "j"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))


def own_terms(wide: DataFrame) -> DataFrame:
    """(lang, source, item, value): the terms that a source has, and more of than its language."""
    more = F.expr("filter(transform(p, (x, i) -> struct(sources[i] as source, x - q as value, counts[i] as n)), e -> e.n > 0 AND e.value > 0)")
    return wide.select("lang", F.col("term").alias("item"), F.explode(more).alias("e")).select("lang", "e.source", "item", "e.value")


def ranked(rows: DataFrame, ranks: int | None = None) -> DataFrame:
    """rows with their rank in their group, the largest value first, then items in order of their UTF-8 bytes."""
    place: Column = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = rows.withColumn("rank", place)
    return out if ranks is None else out.where(F.col("rank") <= ranks)


def audit(docs: DataFrame, least: int = DOCS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank) of part "pair" (all other sources of the language) and "term" (a source's own terms).

    Null text, lang or source: empty. A source without terms, and a language that keeps none, have their rows of pairs, with
    value 0 in the latter; a language of one source has no pairs. Ties go to the lesser item. Rows that repeat an id are each a
    document; ids, and columns other than these three, are not read. An empty table gives no rows.
    """
    kept = saved(kept_terms(term_counts(docs), least), "kept")
    sized = saved(sizes(docs, kept), "sizes")
    wide = vectors(kept, sized)
    parts = {"pair": ranked(pairs(sized, pair_sums(wide))), "term": ranked(own_terms(wide), ranks)}
    each = [p.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, p in parts.items()]
    return each[0].unionByName(each[1])


def oracle() -> str:
    return f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS ts FROM documents),
t AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT r) >= {DOCS}),
v AS (SELECT lang, count(*) AS v, sum(total) AS whole FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
c AS (SELECT g.lang, g.source, k.term, k.total, v.v, v.whole, coalesce(x.n, 0) AS n
    FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + {ADDED})) // (sum(n) OVER (PARTITION BY lang, source) + {ADDED} * v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (total + {ADDED})) // (whole + {ADDED} * v)::HUGEINT AS q FROM c),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM f
QUALIFY part = 'pair' OR rank <= {RANKS}"""
