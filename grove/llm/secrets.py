"""Secret scans in DataFrame functions only: three base patterns, and sliding-window Shannon entropy per character class.

A candidate is a run of at least WINDOW characters of base64 or its URL form that holds digits and letters and isn't on the
allow-list. What is scored in it: the whole candidate as base64 if it has letters of both cases, and each run inside it of a
narrower class (hex of either case; letters of one case with digits) that is as long and holds both too. A window of WINDOW
characters slides over each; counts of each character, and the sum of c*log2(c), are changed by the character that enters and the
one that leaves. Where a window reaches the class's threshold, the span from the first such window to the last is reported.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grove.llm.common import fresh, id_text

WINDOW = 20
#: So many matches of a text are placed one after the other.
RUN = 256
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_single")
#: Java and RE2 both read these alike; letters of the keywords in either case, ASCII only.
_WORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = f"({_WORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
ALPHABETS = {
    "entropy_hex": "0123456789abcdef",
    "entropy_base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-",
    "entropy_single": "0123456789abcdefghijklmnopqrstuvwxyz",
}
#: Such that about one window of random characters of the class in 200 stays below.
LEAST = {"entropy_hex": 2.83, "entropy_base64": 3.61, "entropy_single": 3.35}
#: Runs inside a candidate that are scored by themselves, in lower case.
RUNS = {"[0-9a-f]{20,}": "entropy_hex", "[0-9A-F]{20,}": "entropy_hex", "[0-9a-z]{20,}": "entropy_single", "[0-9A-Z]{20,}": "entropy_single"}
#: Runs of one case that are hex have been scored as such, by a lower threshold.
HEX_ONLY = "^([0-9a-f]+|[0-9A-F]+)$"
#: Candidates that are no secrets: UUIDs, digests named as such, runs of the alphabet, and samples in manuals.
ALLOW = (
    "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    "^(sha1|sha256|sha384|sha512|md5)[-_=]",
    "(EXAMPLE|example|placeholder|dummy|0123456789|abcdefghij|ABCDEFGHIJ)",
)
_C_LOG_C = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, hit, part>>: the leftmost matches that don't overlap, in code points, end exclusive.

    The text between matches comes from split, so each start is a sum of lengths before it. Matches are counted in runs of RUN,
    and the runs then moved by the lengths before them, so that the work doesn't grow with the square of the matches.
    """
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    kind = "array<struct<start:bigint,end:bigint,hit:string,part:string>>"
    zipped = F.filter(F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), parts.alias("part")), lambda x: x["hit"].isNotNull())

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.char_length(x["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"), x["part"].alias("part"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).cast(kind).alias("out"))

    def run(found: Column, first: Column) -> Column:
        return F.aggregate(F.slice(found, first, F.lit(RUN)), F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind).alias("out")), add)

    once = lambda c, f: F.get(F.transform(F.array(c), f), 0)  # noqa: E731  c is computed once
    runs = once(zipped, lambda found: F.transform(F.sequence(F.lit(1), F.size(found), F.lit(RUN)), lambda first: run(found, first)))
    ends = lambda runs: F.aggregate(runs, F.array(F.lit(0).cast("bigint")), lambda s, r: F.concat(s, F.array(F.element_at(s, -1) + r["at"])))
    moved = lambda r, by: F.transform(r["out"], lambda x: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["hit"].alias("hit"), x["part"].alias("part")))
    placed = once(runs, lambda rs: once(F.struct(rs.alias("runs"), ends(rs).alias("ends")), lambda z: F.flatten(F.transform(z["runs"], lambda r, i: moved(r, F.get(z["ends"], i))))))
    return F.when(F.size(hits) == 0, F.array().cast(kind)).otherwise(placed.cast(kind))


def codes(hit: Column, kind: str) -> Column:
    """The place of each character in the class's alphabet, from 1."""
    return F.transform(F.slice(F.split(hit, ""), F.lit(1), F.char_length(hit)), lambda ch: F.instr(F.lit(ALPHABETS[kind]), ch))


def hot_windows(come: Column, kind: str) -> Column:
    """struct<first, last>: where the first and the last window that reach the threshold end (0: none does)."""
    moves = F.arrays_zip(come.alias("come"), F.slice(F.concat(F.array_repeat(F.lit(0), WINDOW), come), F.lit(1), F.size(come)).alias("go"))
    table = F.array(*(F.lit(x) for x in _C_LOG_C))
    g = lambda c: F.get(table, c)

    def step(s: Column, x: Column) -> Column:
        come, go, i = x["come"], x["go"], s["i"] + 1
        a = F.get(s["counts"], come - 1)
        b = F.get(s["counts"], go - 1) + F.when(come == go, 1).otherwise(0)
        total = s["sum"] - g(a) + g(a + 1) + F.when(go > 0, g(b - 1) - g(b)).otherwise(0.0)
        counts = F.transform(s["counts"], lambda v, k: v + F.when(k == come - 1, 1).otherwise(0) - F.when(k == go - 1, 1).otherwise(0))
        return F.struct(i.alias("i"), counts.cast("array<int>").alias("counts"), total.cast("double").alias("sum"), s["first"].alias("first"), s["last"].alias("last"))

    def mark(s: Column) -> Column:
        hot = (s["i"] >= WINDOW) & (math.log2(WINDOW) - s["sum"] / WINDOW >= LEAST[kind])
        first = F.when(hot & (s["first"] == 0), s["i"]).otherwise(s["first"])
        return F.struct(s["i"].alias("i"), s["counts"].alias("counts"), s["sum"].alias("sum"), first.alias("first"), F.when(hot, s["i"]).otherwise(s["last"]).alias("last"))

    once = lambda c, f: F.get(F.transform(F.array(c), f), 0)  # noqa: E731  c is computed once
    zero = F.struct(F.lit(0).alias("i"), F.array_repeat(F.lit(0), len(ALPHABETS[kind])).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("first"), F.lit(0).alias("last"))
    return F.aggregate(moves, zero, lambda s, x: once(step(s, x), mark), lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def with_spans(docs: DataFrame, text_col: str, to: str) -> DataFrame:
    """docs with a column of sorted spans (start, kind as a place in KINDS, end) of each whole text; null: none."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    assigned, access, hexes, cand = fresh(docs, "assign", "access", "hex", "cand")
    raw = docs.withColumns({assigned: matches(text, ASSIGN, 2), access: matches(text, ACCESS), hexes: matches(text, HEX), cand: matches(text, CANDIDATE)})
    no_secret = lambda x: x.rlike("|".join(f"(?:{a})" for a in ALLOW))
    wanted = raw.withColumn(cand, F.filter(cand, lambda c: c["hit"].rlike("[0-9]") & c["hit"].rlike("[A-Za-z]") & ~no_secret(c["hit"])))

    once = lambda c, f: F.get(F.transform(F.array(c), f), 0)
    one = "struct<start:bigint,kind:int,end:bigint>"

    def heat(kind: str, c: Column) -> Column:
        span = lambda hot: F.struct(c["start"] + hot["first"] - WINDOW, F.lit(KINDS.index(kind)), F.when(hot["last"] > 0, c["start"] + hot["last"]).otherwise(0)).cast(one)
        return once(codes(c["hit"], kind), lambda come: once(hot_windows(come, kind), span))

    def runs(c: Column, pattern: str, kind: str) -> Column:
        wanted = lambda r: r["hit"].rlike("[0-9]") & r["hit"].rlike("[A-Za-z]") & (F.lit(kind == "entropy_hex") | ~r["hit"].rlike(HEX_ONLY))
        lower = lambda r: F.struct((c["start"] + r["start"]).alias("start"), F.lower(r["hit"]).alias("hit"))
        return F.transform(F.filter(matches(c["hit"], pattern), wanted), lambda r: heat(kind, lower(r))).cast(_SPAN)

    def entropies(c: Column) -> Column:
        mixed = c["hit"].rlike("[A-Z]") & c["hit"].rlike("[a-z]")
        whole = F.when(mixed, F.array(heat("entropy_base64", c))).otherwise(F.array().cast(_SPAN))
        return F.filter(F.concat(whole, *(runs(c, p, k) for p, k in RUNS.items())), lambda x: x["end"] > 0)

    as_span = lambda kind: lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"))
    found = F.concat(
        F.transform(F.filter(assigned, lambda x: F.char_length(x["part"]) >= 8), as_span(0)).cast(_SPAN),
        F.transform(access, as_span(1)).cast(_SPAN),
        F.transform(hexes, as_span(2)).cast(_SPAN),
        F.when(F.size(cand) == 0, F.array().cast(_SPAN)).otherwise(F.flatten(F.transform(cand, entropies))),
    )
    return wanted.withColumn(to, F.sort_array(found)).drop(assigned, access, hexes, cand)


def listed(spans: Column) -> Column:
    name = lambda k: F.get(F.array(*(F.lit(x) for x in KINDS)), k)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts, digest and list of spans for each row. Null or empty text: none, and the digest of the empty string.

    Rows that repeat an id have a row each; an empty table gives none; other columns are left out.
    """
    rows = with_spans(id_text(docs), "text", "found").select("doc_id", "found")
    base = F.filter("found", lambda x: x["kind"] < 3)
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def marked(text: Column, spans: Column, mark: str) -> Column:
    """The text with a mark in place of each run of sorted spans that overlap.

    RUN spans at a time, each in its own piece of the text, so that work doesn't grow with the square of the spans.
    """
    once = lambda c, f: F.get(F.transform(F.array(c), f), 0)  # noqa: E731  c is computed once
    between = lambda s, a, b: F.substring(s, (a + 1).cast("int"), (b - a).cast("int"))
    runs = F.transform(F.sequence(F.lit(1), F.size(spans), F.lit(RUN)), lambda first: F.slice(spans, first, F.lit(RUN)))
    last = lambda r: F.array_max(F.transform(r, lambda x: x["end"]))
    covered = lambda rs: F.aggregate(rs, F.array(F.lit(0).cast("bigint")), lambda s, r: F.concat(s, F.array(F.greatest(F.element_at(s, -1), last(r)))))

    def part(r: Column, a: Column, b: Column) -> Column:
        def cut(piece: Column) -> Column:
            def step(s: Column, x: Column) -> Column:
                out = F.concat(s["out"], between(piece, s["at"] - a, x["start"] - a), F.lit(mark))
                return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], out).otherwise(s["out"]).alias("out"))

            return F.aggregate(r, F.struct(a.alias("at"), F.lit("").alias("out")), step, lambda s: s["out"])

        return once(between(text, a, b), cut)

    joined = lambda z: F.array_join(F.transform(z["runs"], lambda r, i: part(r, F.get(z["ends"], i), F.get(z["ends"], i + 1))), "")
    rest = lambda z: F.substring(text, (F.element_at(z["ends"], -1) + 1).cast("int"), F.lit(2**31 - 1))
    return once(runs, lambda rs: once(F.struct(rs.alias("runs"), covered(rs).alias("ends")), lambda z: F.concat(joined(z), rest(z))))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced in text, spans that overlap by one mark, and n_chars counted anew where one was.

    A null text stays null, a text without secrets as it is; rows that repeat an id are judged each by itself; an empty table
    stays empty; all columns, whatever their names, pass through.
    """
    (found,) = fresh(docs, "found")
    rows = with_spans(docs, "text", found)
    rows = rows.withColumn("text", F.when(F.size(found) > 0, marked(F.col("text"), F.col(found), mark)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size(found) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def oracle() -> str:
    """The same in DuckDB: windows are counted one by one there."""
    esc = lambda p: p.replace("'", "''")
    allow = esc("|".join(f"(?:{a})" for a in ALLOW))

    def found(pattern: str, group: int = 0, t: str = "t") -> str:
        p = esc(pattern)
        return f"""list_transform(range(1, len(regexp_extract_all({t}, '{p}')) + 1), lambda i: {{
            's': list_sum(list_transform(regexp_split_to_array({t}, '{p}')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all({t}, '{p}')[1:i - 1], lambda x: length(x))), 0),
            'h': regexp_extract_all({t}, '{p}')[i], 'p': regexp_extract_all({t}, '{p}', {group})[i]}})"""

    def runs(kind: str) -> str:
        hex_only = "" if kind == "entropy_hex" else f" AND NOT regexp_matches(r.h, '{HEX_ONLY}')"
        of = (f"""list_transform(list_filter({found(p, t="c.h")}, lambda r: regexp_matches(r.h, '[0-9]') AND regexp_matches(r.h, '[A-Za-z]'){hex_only}),
            lambda r: {{'s': c.s + r.s, 'h': lower(r.h)}})""" for p, k in RUNS.items() if k == kind)
        return f"flatten(list_transform(cs, lambda c: list_concat({', '.join(of)})))"

    def heat(kind: str) -> str:
        ends = f"""list_filter(range({WINDOW}, length(c.h) + 1), lambda e: list_sum(list_transform(list_distinct(string_split(substr(c.h, e - {WINDOW - 1}, {WINDOW}), '')),
            lambda x: -(({WINDOW} - length(replace(substr(c.h, e - {WINDOW - 1}, {WINDOW}), x, ''))) / {WINDOW}.0) * log2(({WINDOW} - length(replace(substr(c.h, e - {WINDOW - 1}, {WINDOW}), x, ''))) / {WINDOW}.0))) >= {LEAST[kind]})"""
        return f"{{'s': (c.s + list_min({ends}) - {WINDOW})::BIGINT, 'k': {KINDS.index(kind)}, 'e': (c.s + list_max({ends}))::BIGINT}}"

    span = lambda k, p, g=0: f"list_transform(list_filter({found(p, g)}, lambda x: {'length(x.p) >= 8' if g else 'true'}), lambda x: {{'s': x.s::BIGINT, 'k': {k}, 'e': (x.s + length(x.h))::BIGINT}})"
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    text = lambda c: f"array_to_string(list_transform({c}, lambda x: {names}[x.k + 1] || ':' || x.s || ':' || x.e), ',')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, {span(0, ASSIGN, 2)} AS a, {span(1, ACCESS)} AS b, {span(2, HEX)} AS h,
    list_filter({found(CANDIDATE)}, lambda c: regexp_matches(c.h, '[0-9]') AND regexp_matches(c.h, '[A-Za-z]') AND NOT regexp_matches(c.h, '{allow}')) AS cs FROM d),
r AS (SELECT doc_id, a, b, h, cs, {runs('entropy_hex')} AS hs, {runs('entropy_single')} AS ss FROM m),
e AS (SELECT doc_id, a, b, h, list_transform(hs, lambda c: {heat('entropy_hex')}) AS x, list_transform(ss, lambda c: {heat('entropy_single')}) AS z,
    list_transform(list_filter(cs, lambda c: regexp_matches(c.h, '[A-Z]') AND regexp_matches(c.h, '[a-z]')), lambda c: {heat('entropy_base64')}) AS y FROM r),
f AS (SELECT doc_id, list_sort(list_concat(a, b, h)) AS base, list_sort(list_concat(a, b, h, list_filter(list_concat(x, y, z), lambda w: w.e IS NOT NULL))) AS found, len(a) AS n_assign, len(b) AS n_access, len(h) AS n_hex FROM e)
SELECT doc_id, n_assign::BIGINT AS n_assign, n_access::BIGINT AS n_access, n_hex::BIGINT AS n_hex, sha256({text('base')}) AS base_sha256, {text('found')} AS spans FROM f"""
