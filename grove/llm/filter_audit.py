"""What five document filters remove in each order of them: a trie of orders, in which equal sets of filters share one state.

Which filters a document fails is found once and kept in narrow rows. The trie is walked depth first: a state's survivors are
persisted while its subtree is walked, each filter that is left is applied to them, and what it removes is counted. A state is a
set of filters, whatever their order; one that has been walked is not walked again, so 120 orders need 32 states and 80 edges.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.llm.common import forget, new_path, saved

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#$%&*|]"
#: At most so many texts have more than this part of all rows as copies; those are few enough to send to all executors.
HOT = 1000


def flagged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, fails): a narrow row for each row of docs; fails is a bit for each of the filters A to D."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words = F.transform(F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("kinds")))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), F.get(words, 0).alias("w"), F.char_length("text").cast("long").alias("chars"), F.char_length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("capitals"), F.col("text").rlike(SYMBOLS).alias("symbol"))
    failed = {"A": F.col("w.n") < 50, "B": 100 * F.col("w.kinds") < 65 * F.col("w.n"), "C": 100 * F.col("capitals") > 5 * F.col("chars"), "D": F.col("symbol")}
    bits = sum((F.when(c, 1 << FILTERS.index(f)).otherwise(0) for f, c in failed.items()), F.lit(0))
    return rows.select("doc_id", "part", "digest", bits.alias("fails"))


def with_copies(rows: DataFrame) -> DataFrame:
    """rows with the bit of E where a row with a smaller id has the same text. A null id counts as larger than all others.

    Texts that occur once need no join. Of the others, those with more than a HOT-th part of all rows are joined by broadcast:
    there are fewer than HOT of them. No key of the remaining join has more rows than that part.
    """
    repeated = saved(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "copies")
    least = rows.count() // HOT
    later = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    hot = rows.join(F.broadcast(repeated.where(F.col("n") > least).select("digest", F.col("first").alias("hot_first"), F.lit(True).alias("hot"))), "digest", "left")
    marked = lambda df: df.select("doc_id", "part", "digest", (F.col("fails") + F.when(later, 1 << FILTERS.index("E")).otherwise(0)).alias("fails"))
    common = marked(hot.where("hot").withColumn("first", F.col("hot_first")))
    rest = marked(hot.where("hot IS NULL").join(repeated.where(F.col("n") <= least).select("digest", "first"), "digest", "left"))
    return common.unionByName(rest)


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic (0 or 1): whether a label of the id says so. Rows without an id have none, and are spread by their text."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("doc_id IS NOT NULL")
    once = known.groupBy("doc_id").agg(*(F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(c) for c in ("good", "toxic"))).withColumn("spread", F.lit(0).cast("long"))
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0)
    found = rows.withColumn("spread", spread).join(once, ["doc_id", "spread"], "left")
    return found.select("part", "fails", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))


def edge_counts(survivors: DataFrame, state: int) -> DataFrame:
    """(part, state, alive, only, edges): a row a part; edges has what each filter outside the state removes from its survivors."""

    def edge(i: int):
        fails = F.col("fails").bitwiseAND(1 << i) != 0
        count = lambda *c: F.coalesce(F.sum(F.when(fails, c[0] if c else F.lit(1)).otherwise(0)), F.lit(0)).cast("long")
        only = F.coalesce(F.sum(F.when(F.col("fails") == 1 << i, 1).otherwise(0)), F.lit(0)).cast("long")
        return F.struct(F.lit(i).alias("filter"), count().alias("removed"), count(F.col("good")).alias("good_lost"), count(F.col("toxic")).alias("toxic_lost"), only.alias("only"))

    left = [i for i in range(len(FILTERS)) if not state >> i & 1]
    return survivors.groupBy("part").agg(F.count("*").alias("alive"), F.array(*map(edge, left)).alias("edges")).select("part", F.lit(state).alias("state"), "alive", "edges")


def walk(rows: DataFrame, path: str) -> None:
    """Writes the edge counts of all states below path. At most one state a depth is persisted at a time."""
    done: set[int] = set()
    every = (1 << len(FILTERS)) - 1

    def visit(state: int, survivors: DataFrame) -> None:
        done.add(state)
        survivors.persist(StorageLevel.MEMORY_AND_DISK)  # a lost executor's part is computed anew from the rows on disk
        try:
            edge_counts(survivors, state).write.parquet(f"{path}/s{state:02d}")
            for i in range(len(FILTERS)):
                child = state | 1 << i
                if child not in done and child != every:
                    visit(child, survivors.where(F.col("fails").bitwiseAND(1 << i) == 0))
        finally:
            survivors.unpersist()

    visit(0, rows)


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step, filter, state before it) of every step of every order."""
    out = []
    for order in permutations(range(len(FILTERS))):
        state = 0
        for step, i in enumerate(order, 1):
            out.append(("".join(FILTERS[k] for k in order), step, i, state))
            state |= 1 << i
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each source (part), order and step: documents kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null text or source: empty. An empty text fails A only, unless a row of smaller id has it too. Rows that repeat an id are each
    a document; equal ids with equal texts are no copies of each other. A null id counts as the largest and has no labels. Of
    several labels of an id any counts. Columns other than doc_id, source and text aren't read. An empty table gives no rows.
    """
    narrow = saved(flagged(docs), "flags")
    rows = saved(labelled(with_copies(narrow), labels), "filtered")
    forget(narrow)
    path = new_path(docs.sparkSession, "edges")
    walk(rows, path)
    forget(rows)
    counts = docs.sparkSession.read.parquet(f"{path}/*")
    by_part = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("state", F.struct("alive", "edges")))).alias("states"))  # at most 31 entries
    of = lambda state, i: f"try_element_at(filter(try_element_at(states, {state}).edges, e -> e.filter = {i}), 1)"
    n = len(FILTERS)
    # An edge lies on as many orders as its state and what is left after it can be arranged in.
    weights = [f"coalesce({of(s, i)}.removed, 0L) * {factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())}" for i in range(n) for s in range(1 << n) if not s >> i & 1]
    per = len(weights) // n
    shapley = F.array(*(F.expr(" + ".join(weights[i * per : (i + 1) * per])) for i in range(n)))
    first = F.expr("try_element_at(states, 0).edges")
    steps = F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","s":{s},"f":{f},"t":{t}}}' for o, s, f, t in orders()) + "]"), "array<struct<o:string,s:int,f:int,t:int>>")
    framed = by_part.withColumn("shapleys", shapley).withColumn("first", first).withColumn("at", F.explode(steps))
    framed = framed.withColumn("edge", F.expr(of("at.t", "at.f"))).withColumn("alive", F.expr("coalesce(try_element_at(states, at.t).alive, 0L)")).withColumn("root", F.expr("first[at.f]"))
    lost = lambda c: F.coalesce(F.col(f"edge.{c}"), F.lit(0))
    return framed.select(
        "part", F.col("at.o").alias("filter_order"), F.col("at.s").alias("step"), (F.col("alive") - lost("removed")).alias("kept"), lost("removed").alias("removed"), (F.col("root.removed") - lost("removed")).alias("redundant"),
        F.col("root.only").alias("unique_fails"), lost("good_lost").alias("good_lost"), lost("toxic_lost").alias("toxic_lost"), F.expr("shapleys[at.f]").alias("shapley"),
    )


def oracle() -> str:
    """The same in DuckDB, each step of each order counted by itself."""
    fails = lambda f: f"f{f.lower()}"
    before = " OR ".join(f"({fails(f)} AND instr(o.filter_order, '{f}') < o.step)" for f in FILTERS)
    here = " OR ".join(f"({fails(f)} AND o.letter = '{f}')" for f in FILTERS)
    alone = " + ".join(f"{fails(f)}::INT" for f in FILTERS)
    letters = " ".join(f"JOIN l l{i} ON l{i}.x NOT IN ({', '.join(f'l{k}.x' for k in range(i))})" for i in range(1, 5))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
n AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, len(w) < 50 AS fa, 100 * len(list_distinct(w)) < 65 * len(w) AS fb, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS fc,
    regexp_matches(t, '{SYMBOLS}') AS fd, doc_id > min(doc_id) OVER (PARTITION BY t) AS fe, coalesce(n.good, 0) AS good, coalesce(n.toxic, 0) AS toxic FROM d LEFT JOIN n USING (doc_id)),
b AS (SELECT part, fa, fb, fc, fd, fe, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
l(x) AS (VALUES {', '.join(f"('{f}')" for f in FILTERS)}),
o AS (SELECT filter_order, step, filter_order[step] AS letter FROM (SELECT l0.x || l1.x || l2.x || l3.x || l4.x AS filter_order FROM l l0 {letters}), range(1, 6) r(step)),
s AS (SELECT part, filter_order, step, letter, sum(n) FILTER (NOT ({before}) AND NOT ({here})) AS kept, sum(n) FILTER (NOT ({before}) AND ({here})) AS removed, sum(n) FILTER (({before}) AND ({here})) AS redundant,
    sum(n) FILTER (({here}) AND {alone} = 1) AS unique_fails, sum(good) FILTER (NOT ({before}) AND ({here})) AS good_lost, sum(toxic) FILTER (NOT ({before}) AND ({here})) AS toxic_lost FROM b, o GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, {', '.join(f'coalesce({c}, 0)::BIGINT AS {c}' for c in ('kept', 'removed', 'redundant', 'unique_fails', 'good_lost', 'toxic_lost'))},
    coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley FROM s"""
