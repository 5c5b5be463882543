"""Chat formatting from event logs, in DataFrame functions only.

A log has events (conv_id, turn, seq, kind, role, text). Within a conversation they are sorted by turn and sequence and
folded: "message" starts a message, "delta" appends to it, "edit" replaces its text, "regenerate" empties it for new deltas.
Final messages are rendered turn by turn:

    <|im_start|>ROLE newline TEXT<|im_end|> newline

with "&" in texts as "&amp;" and "<|" as "&lt;|" (and a newline in a role as "&#10;"), so that no text holds a marker and
every text comes back as it was. The loss mask is the spans of assistant texts in the rendered string.

A conversation is kept as segments of SEGMENT turns, each a row, so that no row and no task needs a whole conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 64
START, END = "<|im_start|>", "<|im_end|>\n"
_MESSAGE = "struct<turn:bigint,role:string,text:string>"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


#: Events of a turn in a log that events_of makes.
EVENTS = 8


def events_of(rows: DataFrame) -> DataFrame:
    """Finished turns (conv_id, turn, role, text) as a log of how they came about.

    A turn of the assistant begins as a message, gets a delta that is thrown away by a regeneration, and is streamed again in
    three deltas. One of any other role begins as a draft, gets a delta, and is edited; what the edit leaves out follows as a
    delta. Rows that repeat a turn follow each other by role and text. A null text is empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    third = F.floor(F.char_length(text) / 3).cast("int")
    part = lambda a, b: F.substring(text, a + 1, b - a)
    whole = F.char_length(text)
    event = lambda step, kind, said: F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), said.alias("said"))
    zero = F.lit(0)
    streamed = [event(0, "message", part(zero, third)), event(1, "delta", F.lit(" no, wait")), event(2, "regenerate", F.lit(None).cast("string")), event(3, "delta", part(zero, third)), event(4, "delta", part(third, 2 * third)), event(5, "delta", part(2 * third, whole))]
    edited = [event(0, "message", F.lit("draft: ")), event(1, "delta", part(third, whole)), event(2, "edit", part(zero, whole - third)), event(3, "delta", part(whole - third, whole))]
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.coalesce("role", F.lit("")), text)) - 1
    log = rows.select("conv_id", "turn", "role", nth.alias("nth"), F.explode(F.when(F.col("role") == "assistant", F.array(*streamed)).otherwise(F.array(*edited))).alias("e"))
    return log.select("conv_id", "turn", (F.col("nth").cast("long") * EVENTS + F.col("e.step")).alias("seq"), "e.kind", "role", F.col("e.said").alias("text"))


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, segment, messages): the final messages of each segment in order.

    Null roles and texts are empty; null turns come first; events that tie are ordered by kind (message, regenerate, edit,
    delta), role and text; events that repeat each count; a change before any message of its turn starts one. One shuffle.
    """
    order = F.when(F.col("kind") == "message", 0).when(F.col("kind") == "regenerate", 1).when(F.col("kind") == "edit", 2).otherwise(3)
    clean = events.select(
        "conv_id", F.floor(F.col("turn") / SEGMENT).cast("long").alias("segment"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.col("seq").cast("long").alias("seq"), order.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("event"),
    )
    log = clean.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list("event")).alias("events"))

    def step(s: Column, e: Column) -> Column:
        last = F.try_element_at(s, F.lit(-1))
        new = (e["kind"] == 0) | last.isNull() | ~last["turn"].eqNullSafe(e["turn"])
        begun = F.struct(e["turn"].alias("turn"), e["role"].alias("role"), F.when(e["kind"] == 1, F.lit("")).otherwise(e["text"]).alias("text")).cast(_MESSAGE)
        text = F.when(e["kind"] == 3, F.concat(last["text"], e["text"])).when(e["kind"] == 2, e["text"]).otherwise(F.lit(""))
        changed = F.struct(last["turn"].alias("turn"), last["role"].alias("role"), text.alias("text")).cast(_MESSAGE)
        return F.when(new, F.concat(s, F.array(begun))).otherwise(F.concat(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), F.array(changed)))

    return log.select("conv_id", "segment", F.aggregate("events", F.array().cast(f"array<{_MESSAGE}>"), step).alias("messages"))


def render(segments: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """(conv_id, segment, formatted, loss): loss has the spans of texts to learn, in code points of formatted, end exclusive."""
    safe = segments.select("conv_id", "segment", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.replace(escaped(m["role"]), F.lit("\n"), F.lit("&#10;")).alias("safe_role"), escaped(m["text"]).alias("text"))).alias("m"))
    spans = "array<struct<start:bigint,end:bigint>>"

    def step(s: Column, m: Column) -> Column:
        start = s["at"] + len(START) + 1 + F.char_length(m["safe_role"])
        end = start + F.char_length(m["text"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"))).cast(spans)
        return F.struct((end + len(END)).cast("long").alias("at"), F.when(m["role"] == learn_from, F.concat(s["out"], one)).otherwise(s["out"]).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(spans).alias("out"))
    formatted = F.array_join(F.transform("m", lambda m: F.concat(F.lit(START), m["safe_role"], F.lit("\n"), m["text"], F.lit(END))), "")
    return safe.select("conv_id", "segment", formatted.alias("formatted"), F.aggregate("m", zero, step, lambda s: s["out"]).alias("loss"))


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests of each conversation, from the rendered segments alone.

    The digests of a conversation need its texts in one string; only here do its segments come together.
    """
    turn = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda p: p != "")
    role = lambda p: F.substring_index(F.substring(p, len(START) + 1, 2**31 - 1), "\n", 1)
    text = lambda p: F.substring(p, F.lit(len(START) + 2) + F.char_length(role(p)), F.lit(2**31 - 1))
    plain_role = lambda p: unescaped(F.replace(role(p), F.lit("&#10;"), F.lit("\n")))
    read = rendered.select(
        "conv_id", "segment", F.char_length("formatted").alias("chars"), turn.alias("turns"),
        F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))).alias("learned"),
    )
    parts = read.select(
        "conv_id", "segment", "chars", F.size("turns").alias("n"), F.array_join(F.transform("turns", lambda p: F.concat(plain_role(p), F.lit("\n"), unescaped(text(p)), F.lit("\n"))), "").alias("said"),
        F.array_join("learned", "").alias("learned"),
    )
    whole = parts.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), F.sum(F.char_length("learned")).cast("long").alias("loss_chars"), F.sum("chars").cast("long").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("segment", "said", "learned"))).alias("parts"),
    )
    joined = lambda name: F.sha2(F.array_join(F.transform("parts", lambda p: p[name]), ""), 256)
    return whole.select("conv_id", "n_turns", joined("said").alias("turns_sha256"), "loss_chars", joined("learned").alias("loss_sha256"), "formatted_chars")


def oracle() -> str:
    esc = lambda c: f"replace(replace({c}, '&', '&amp;'), '<|', '&lt;|')"
    return f"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
    UNION ALL SELECT -1, i, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r))
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) AS turns_sha256,
    coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum({len(START) + 1 + len(END)} + length(replace({esc('role')}, chr(10), '&#10;')) + length({esc('t')}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""
