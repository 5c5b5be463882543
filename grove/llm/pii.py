"""Personal data: four base patterns, and a skip-chain conditional random field that adds the mentions they miss.

Words that hold a digit or an at sign, and those around a spelled-out "at" or "dot", are variables; all other words are only
observed. Neighbours in the text form the chain. Words that occur again (letters and digits alone, any case) and words with the
same last digits are linked to the occurrence before, so that evidence anywhere in a document reaches all mentions of an entity.
Loopy message passing in rounds gives each variable's marginals; words within base matches are held at the base's label.

Potentials are trained by pseudo-likelihood on a bounded sample of documents, in which the base matches are the labels: as they
stand, and once more with every second match in a form that the patterns miss.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.llm.common import id_text

KINDS = ("email", "ip", "card", "phone")
#: No entity, then the first and the further words of each kind.
O, LABELS = 0, 1 + 2 * len(KINDS)
CHAIN, SAME, ALIKE = range(3)
#: Sampled documents; words of one of them at most, or it is passed over; rounds of messages, at inference; passes over the sample, and steps in all.
SAMPLE, SAMPLE_WORDS, ROUNDS, EPOCHS, STEPS = 20_000, 2_000, 12, 20, 1_200
#: The largest weight of a link, so that no link outvotes what the words themselves say.
LINK = 3.0
#: The kind of each label (0: none), and which labels are of one kind.
KIND = np.array([0, *((k // 2) + 1 for k in range(2 * len(KINDS)))])
ALIKE_LABELS = (KIND[:, None] == KIND[None, :]).astype(float)
#: Variables whose features are held at a time; a feature looks at fewer words beside its own than MARGIN.
STEP, MARGIN = 5_000, 8
SPACE = " \t\n\x0b\x0c\r"
_SPACES = re.compile(r"[\x20\x09-\x0D]").search
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+").finditer
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_HOLDS = re.compile(r"[0-9@]").search
_SPELLED = re.compile(r"[\x20(\[{]dot[\x20)\]}]|[(\[{]at[)\]}]", re.I).search
_MARK = re.compile(r"^[(\[{]?(?:at|dot|@|\.)[)\]}]?$", re.I).match
_WORDS = re.compile(r"[^\x20\x09-\x0D]+").finditer
_EDGE = "\"'`,;:!?<>"
_DIGITS = re.compile(r"[0-9]+").findall
_AT = re.compile(r"@|[(\[{]\x20?(?:at|@)\x20?[)\]}]|\x20at\x20", re.I).search
_DOT = re.compile(r"\.|[(\[{]\x20?dot\x20?[)\]}]|\x20dot\x20", re.I).search
_BREAKS = re.compile(r"[^0-9]+").findall


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGITS(s))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with the longest run of local characters before it, and a domain after: linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN(text, at + 1) if start < at else None
        end = m.end() if m else at + 1
        if m:
            yield start, end
        at = text.find("@", end)


def base(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Spans (kind, start, end) of the base patterns by kind, then start; and what matched them but failed their conditions."""
    if _HOLDS(text) is None:
        return [], []
    out, failed = [(0, s, e) for s, e in emails(text)], []
    tests = (None, lambda x: all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in x.split(".")), lambda x: 16 <= len(d := _digits(x)) <= 19 and luhn(d), lambda x: 8 <= len(_digits(x)) <= 15)
    for kind, find in ((1, _IP), (2, _CARD), (3, _PHONE)):
        for m in find(text):
            if tests[kind](m[0]):
                out.append((kind, *m.span()))
            else:
                failed.append(m.span())
    return out, failed


def words(text: str) -> list[tuple[int, int]]:
    """The variables: words that hold a digit or an at sign, and the words of spelled-out addresses."""
    out, end = [], 0
    m = _HOLDS(text)
    while m:
        start = 1 + max(text.rfind(s, end, m.start()) for s in SPACE)
        start = max(start, end)
        stop = s.start() if (s := _SPACES(text, m.end())) else len(text)
        out.append((start, stop))
        end = stop
        m = _HOLDS(text, end)
    if (m := _SPELLED(text)) is None:
        return out
    found = set(out)
    while m:  # the words of "a at b dot c dot d" around each mark
        lo, hi = max(0, m.start() - 200), min(len(text), m.end() + 100)
        near = [(lo + w.start(), lo + w.end()) for w in _WORDS(text[lo:hi])]
        near = [w for w in near if w[1] - w[0] <= 64 and (w[0] > lo or lo == 0) and (w[1] < hi or hi == len(text))]
        k = next((i for i, w in enumerate(near) if w[1] > m.start() + 1), len(near))
        if any(_AT(f" {text[w[0] : w[1]]} ") for w in near[max(0, k - 4) : k + 1]):
            found.update(near[max(0, k - 4) : k + 2])
        m = _SPELLED(text, m.end() - 1)
    return sorted(found)


def core(text: str, start: int, end: int) -> tuple[int, int]:
    """A word without the punctuation at its ends."""
    while start < end and text[start] in _EDGE:
        start += 1
    while end > start and (text[end - 1] in _EDGE or text[end - 1] == "." and end - start > 1):
        end -= 1
    return start, end


def shape(word: str) -> str:
    return re.sub("[^\\W\\d_]+", "a", re.sub("[0-9]", "9", word))[:24]


def _beside(text: str, start: int, end: int) -> tuple[str, str]:
    """The words before and after a place, within 24 characters."""
    left, right = text[max(0, start - 24) : start].split(), text[end : end + 24].split()
    return (left[-1].lower() if left else ""), (right[0].lower() if right else "")


def features(text: str, at: list[tuple[int, int]]) -> list[list[str]]:
    """Observed features of each variable: its form, its digits, their checks over the words that follow, the words beside it."""
    cores = [text[slice(*core(text, s, e))] for s, e in at]
    digits = [_digits(c) for c in cores]
    plain = [bool(c) and not re.search("[^\\W\\d_]", c) and bool(d) for c, d in zip(cores, digits, strict=True)]
    out = []
    for i, ((s, e), c, d) in enumerate(zip(at, cores, digits, strict=True)):
        f = ["bias", "s=" + shape(c), "c=" + re.sub("9+", "9", shape(c)), f"d={min(len(d), 24)}"]
        if 12 <= len(d) <= 19:
            f.append(f"luhn={luhn(d) and len(d) >= 13}")
        if len(p := _DIGITS(c)) == 4:
            f.append(f"quad={plain[i] and all(len(x) <= 3 and int(x) <= 255 for x in p)}{len(set(_BREAKS(c)) - {''}) <= 2}")
        if _MARK(c):
            f.append("mark=" + re.sub("\\W", "", c.lower()))
        if "@" in c or _AT(c):
            f.append(f"at={bool(_DOMAIN(c, c.find('@') + 1))}")
        f.append("k=" + "".join(t for t, x in (("a", any(map(str.isalpha, c))), ("9", bool(d)), (".", "." in c), ("-", "-" in c), ("@", "@" in c)) if x))
        before, after = _beside(text, s, e)
        for side, w in (("pm=", before), ("nm=", after)):
            if _MARK(w):
                f.append(side + re.sub("\\W", "", w))
        f += ["p=" + before, "n=" + after]
        out.append(f)
    for i in range(len(at)):  # a card in groups of digits: the words of such a run know it
        j, run = i, ""
        while j < len(at) and plain[j] and 3 <= len(digits[j]) <= 6 and len(run) + len(digits[j]) <= 19 and (j == i or at[j][0] - at[j - 1][1] == 1):
            run += digits[j]
            j += 1
            if j - i > 2 and 13 <= len(run) and luhn(run):
                out[i].append("run=first")
                for k in range(i + 1, j):
                    out[k].append("run=more")
                break
    return out


def keys(word: str) -> list[tuple[int, str]]:
    """What links a word with others: its letters and digits, and its last seven digits."""
    bare = re.sub(r"[\W_]", "", word).lower()
    digits = _digits(word)
    return ([(SAME, bare)] if len(bare) >= 4 else []) + ([(ALIKE, digits[-7:])] if len(digits) >= 7 else [])


def links(text: str, at: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(i, j, type), i < j: next words in the text, and each word with the occurrence before of the same and the alike key."""
    out, last = [], {}
    for j, (s, e) in enumerate(at):
        if j and not text[at[j - 1][1] : s].strip() and s - at[j - 1][1] <= 2:
            out.append((j - 1, j, CHAIN))
        met: set[int] = set()
        for kind, k in keys(text[s:e]):
            i = last.get((kind, k))
            if i is not None and i not in met:
                met.add(i)
                out.append((i, j, kind))
            last[kind, k] = j
    return out


def held(at: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[int]:
    """The label of each variable that a span touches: first or further word of its kind; -1: none touches it."""
    out = [-1] * len(at)
    for kind, start, end in sorted(spans, key=lambda x: (x[1], x[0])):
        first, lo = True, _first(at, start)
        for i in range(lo, len(at)):
            if at[i][0] >= end:
                break
            if out[i] < 0:
                out[i] = 1 + 2 * kind + (not first)
            first = False
    return out


def _first(at: list[tuple[int, int]], start: int) -> int:
    """The first variable that ends after a place."""
    lo, hi = 0, len(at)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if at[mid][1] <= start else (lo, mid)
    return lo


def disguised(kind: int, word: str, pick: int) -> str:
    """A form of a match that the base patterns miss, or one that stands among other numbers."""
    if kind == 0:
        local, _, domain = word.partition("@")
        return (f"{local} [at] {domain}", f"{local}[at]{domain.replace('.', '[dot]')}", f"{local} at {domain.replace('.', ' dot ')}", f"{local} (at) {domain.replace('.', ' (dot) ')}")[pick % 4]
    d = _digits(word)
    if kind == 1:
        return (word.replace(".", "[.]"), word.replace(".", "(.)"), word.replace(".", "-"))[pick % 3]
    if kind == 2:
        four = [d[i : i + 4] for i in range(0, len(d), 4)]
        return (".".join(four), "/".join(four), "_".join(four), "  ".join(four))[pick % 4]
    n = d[-10:]
    return (f"({n[:3]}) {n[3:6]}-{n[6:]}", f"{n[:3]}-{n[3:6]}-{n[6:]}", f"{n[:3]}.{n[3:6]}.{n[6:]}")[pick % 3]


def hidden(text: str, spans: list[tuple[int, int, int]], seed: int) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with about every second match disguised, and where the matches are now.

    Some have a card right behind, which the patterns read as one number with them. The bare digits of some phones come once more
    at the end, where only the link tells them from numbers that aren't personal, which come there too.
    """
    parts, out, at, n = [], [], 0, 0
    flat = []
    for kind, s, e in sorted(spans, key=lambda x: (x[1], x[0])):
        if not flat or s >= flat[-1][2]:
            flat.append((kind, s, e))
    cards = [text[s:e] for kind, s, e in flat if kind == 2]
    for k, (kind, s, e) in enumerate(flat):
        parts.append(text[at:s])
        n += s - at
        pick = zlib.crc32(f"{seed}:{k}".encode())
        new = text[s:e] if pick & 1 else disguised(kind, text[s:e], pick >> 1)
        parts.append(new)
        out.append((kind, n, n + len(new)))
        n += len(new)
        if pick >> 8 & 1 and cards and kind in (1, 3):  # a card right behind: the patterns then read both as one number
            parts.append(" " + cards[0])
            out.append((2, n + 1, n + 1 + len(cards[0])))
            n += 1 + len(cards[0])
        at = e
    parts.append(text[at:])
    n += len(text) - at
    coin = zlib.crc32(f"{seed}".encode())
    numbers = [str(10**9 + (coin * k * 7919) % (9 * 10**9)) for k in (1, 2, 3)]
    day = f"{1990 + coin % 40}-{1 + coin % 12:02d}-{1 + coin % 28:02d}"
    bare = [_digits(text[s:e])[-10:] for kind, s, e in flat if kind == 3]
    for tail, kind in (*((x, None) for x in numbers), (day, None), *((b, 3) for b in bare[:1] if coin >> 6 & 1)):
        parts.append(" and " + tail)
        if kind is not None:
            out.append((kind, n + 5, n + 5 + len(tail)))
        n += 5 + len(tail)
    return "".join(parts), out


def _lesson(text: str, spans: list[tuple[int, int, int]], failed: list[tuple[int, int]]) -> dict | None:
    at = words(text)
    if not at or len(at) > SAMPLE_WORDS:
        return None
    y = [max(v, O) for v in held(at, spans)]
    dim = held(at, [(0, s, e) for s, e in failed])  # what failed a condition teaches nothing: it may be two entities read as one
    use = [v != O or d < 0 for v, d in zip(y, dim, strict=True)]
    return {"f": features(text, at), "y": y, "use": use, "links": [x for e in links(text, at) for x in e]}


_LESSON = "doc_id long, f array<array<string>>, y array<int>, use array<boolean>, links array<int>"


def lessons(docs: DataFrame, sample: int) -> list[dict]:
    """The sampled documents that hold variables, plain and disguised, made where the texts are; at most 2 * sample rows."""
    few = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    rows = id_text(docs).join(F.broadcast(few), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                spans, failed = base(text)
                first = _lesson(text, spans, failed)
                if first:
                    out.append({"doc_id": i} | first)
                if spans and first:
                    changed, moved = hidden(text, spans, i)
                    if other := _lesson(changed, moved, []):
                        out.append({"doc_id": i} | other)
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("f", pa.list_(pa.list_(pa.string()))), ("y", pa.list_(pa.int32())), ("use", pa.list_(pa.bool_())), ("links", pa.list_(pa.int32()))]))

    got = [r.asDict() for r in rows.mapInArrow(run, _LESSON).collect()]
    return sorted(got, key=lambda r: (r["doc_id"], r["y"], r["f"]))


@dataclass
class Model:
    """unary: weights of features by label; chain: of two labels in a row; link: of one kind at both ends, by type of link."""

    unary: dict[str, np.ndarray] = field(default_factory=dict)
    chain: np.ndarray = field(default_factory=lambda: np.zeros((LABELS, LABELS)))
    link: np.ndarray = field(default_factory=lambda: np.zeros((3, 1 + len(KINDS))))

    def pairwise(self) -> np.ndarray:
        """Log potentials by type of link."""
        return np.stack([self.chain, *(ALIKE_LABELS * self.link[t][KIND] for t in (SAME, ALIKE))])

    def scores(self, text: str, at: list[tuple[int, int]]) -> np.ndarray:
        """Log potentials of each variable alone, STEP variables at a time."""
        out = np.zeros((len(at), LABELS))
        for lo in range(0, len(at), STEP):
            first = max(0, lo - MARGIN)
            for i, f in enumerate(features(text, at[first : lo + STEP + MARGIN])[lo - first : lo - first + STEP], lo):
                for x in f:
                    if (w := self.unary.get(x)) is not None:
                        out[i] += w
        return out


def marginals(unary: np.ndarray, edges: np.ndarray, pairwise: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Sum-product messages along both directions of each edge (i, j, type), all at once, for a number of rounds.

    A message depends on its own component alone, so that documents may share a call. Exact on trees no longer than the rounds.
    """
    n, e = len(unary), len(edges)
    if e == 0:
        z = np.exp(unary - unary.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)
    i, j, kind = edges.T
    src, dst = np.concatenate((i, j)), np.concatenate((j, i))
    psi = np.exp(np.concatenate((pairwise[kind], pairwise[kind].transpose(0, 2, 1))))
    back = np.concatenate((np.arange(e, 2 * e), np.arange(e)))
    messages = np.zeros((2 * e, LABELS))
    for _ in range(rounds):
        total = unary.copy()
        np.add.at(total, dst, messages)
        out = total[src] - messages[back]
        out = np.exp(out - out.max(1, keepdims=True))
        messages = np.log(np.einsum("ea,eab->eb", out, psi))
        messages -= messages.max(1, keepdims=True)
    total = unary.copy()
    np.add.at(total, dst, messages)
    z = np.exp(total - total.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def train(found: list[dict], epochs: int = EPOCHS, rate: float = 0.3, l2: float = 1e-4, seed: int = 5) -> Model:
    """Pseudo-likelihood: each label given the labels that it is linked with; adaptive gradient steps over shuffled groups of words."""
    counts: dict[str, int] = {}
    for r in found:
        for f in r["f"]:
            for x in set(f):
                counts[x] = counts.get(x, 0) + 1
    place = {x: k for k, x in enumerate(sorted(x for x, c in counts.items() if c >= 3))}
    rows, cols, y, use, edges = [], [], [], [], []
    for r in found:
        at = len(y)
        for i, f in enumerate(r["f"]):
            ids = [place[x] for x in f if x in place]
            rows += [at + i] * len(ids)
            cols += ids
        y += r["y"]
        use += r["use"]
        edges += [(at + a, at + b, t) for a, b, t in zip(*[iter(r["links"])] * 3, strict=True)]
    if not any(y):
        return Model()
    rows, cols, y, use = np.array(rows), np.array(cols), np.array(y), np.array(use, bool)
    e = np.array(edges, np.int64).reshape(-1, 3)
    near = np.concatenate((np.column_stack((e[:, 1], e[:, 0], e[:, 2], np.zeros(len(e), int))), np.column_stack((e[:, 0], e[:, 1], e[:, 2], np.ones(len(e), int)))))  # variable, neighbour, type, neighbour comes after
    near = near[np.argsort(near[:, 0], kind="stable")]
    w, chain, link = np.zeros((len(place), LABELS)), np.zeros((LABELS, LABELS)), np.zeros((3, 1 + len(KINDS)))
    g2 = [np.full(x.shape, 1e-3) for x in (w, chain, link)]
    starts = np.searchsorted(rows, np.arange(len(y) + 1))
    near_at = np.searchsorted(near[:, 0], np.arange(len(y) + 1))
    rng, taught = np.random.default_rng(seed), np.flatnonzero(use)
    size = max(64, len(taught) * epochs // STEPS)
    spread = lambda at, b: np.concatenate([np.arange(at[v], at[v + 1]) for v in b]) if len(b) else np.zeros(0, int)
    for _ in range(epochs):
        order = rng.permutation(taught)
        for k in range(0, len(order), size):
            b = order[k : k + size]
            pos = np.full(len(y), -1)
            pos[b] = np.arange(len(b))
            fa, na = spread(starts, b), spread(near_at, b)
            logit = np.zeros((len(b), LABELS))
            np.add.at(logit, pos[rows[fa]], w[cols[fa]])
            v, yn, t, after = pos[near[na, 0]], y[near[na, 1]], near[na, 2], near[na, 3] == 1
            c = t == CHAIN
            np.add.at(logit, v[c & ~after], chain[yn[c & ~after]])
            np.add.at(logit, v[c & after], chain[:, yn[c & after]].T)
            np.add.at(logit, v[~c], ALIKE_LABELS[yn[~c]] * link[t[~c], KIND[yn[~c]]][:, None])
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(b)), y[b]] -= 1
            gw, gc, gl = np.zeros_like(w), np.zeros_like(chain), np.zeros_like(link)
            np.add.at(gw, cols[fa], p[pos[rows[fa]]])
            np.add.at(gc, yn[c & ~after], p[v[c & ~after]])
            np.add.at(gc.T, yn[c & after], p[v[c & after]])
            np.add.at(gl, (t[~c], KIND[yn[~c]]), (p[v[~c]] * ALIKE_LABELS[yn[~c]]).sum(1))
            for x, g, s in ((w, gw, g2[0]), (chain, gc, g2[1]), (link, gl, g2[2])):
                g = g / len(b) + l2 * x
                s += g * g
                x -= rate * g / np.sqrt(s)
            np.clip(link, 0.0, LINK, out=link)
    return Model({x: w[k] for x, k in place.items()}, chain, link)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the sampled ids of smallest hash; one without weights, which adds nothing, where they hold no base match."""
    return train(lessons(docs, sample))


def sound(kind: int, found: str) -> bool:
    """An exact check of what the field adds."""
    d = _digits(found)
    if kind == 0:
        return bool((m := _AT(found)) and m.start() and _DOT(found, m.end()) and re.search(r"[^A-Za-z][A-Za-z]{2,4}$", found))
    if kind == 1:
        return len(p := _DIGITS(found)) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in p)
    return 13 <= len(d) <= 19 and luhn(d) if kind == 2 else 10 <= len(d) <= 15


def added(text: str, at: list[tuple[int, int]], fixed: list[int], labels: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans of words that are free and labelled: each first word with the further ones of its kind that follow it."""
    out, i = [], 0
    while i < len(at):
        if fixed[i] >= 0 or labels[i] == O:
            i += 1
            continue
        kind, j = (int(labels[i]) - 1) // 2, i + 1
        while j < len(at) and fixed[j] < 0 and labels[j] == 2 + 2 * kind and at[j][0] - at[j - 1][1] <= 2 and not text[at[j - 1][1] : at[j][0]].strip():
            j += 1
        s, e = core(text, *at[i])[0], core(text, *at[j - 1])[1]
        if kind > 0:
            while s < e and not (text[s].isascii() and (text[s].isdigit() or text[s] in "+(" and kind == 3)):
                s += 1
            while e > s and not (text[e - 1].isascii() and text[e - 1].isdigit()):
                e -= 1
        if sound(kind, text[s:e]):
            out.append((kind, s, e))
        i = j
    return out


def find(texts: list[str], model: Model) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base and added spans (kind, start, end) of each text. Texts share one graph of no more than about 50,000 variables."""
    out, waiting, n = [], [], 0
    fixed_cost = 60.0

    def settle() -> None:
        nonlocal n
        if waiting:
            scores = [model.scores(texts[k], at) for k, at, _ in waiting]
            edges, start = [], 0
            for (k, at, fixed), u in zip(waiting, scores, strict=True):
                for i, v in enumerate(fixed):
                    if v >= 0:
                        u[i] = -fixed_cost
                        u[i, v] = 0.0
                edges += [(start + a, start + b, t) for a, b, t in links(texts[k], at)]
                start += len(at)
            best = marginals(np.concatenate(scores), np.array(edges, np.int64).reshape(-1, 3), pairs).argmax(1)
            start = 0
            for k, at, fixed in waiting:
                out[k][1].extend(added(texts[k], at, fixed, best[start : start + len(at)]))
                start += len(at)
        waiting.clear()
        n = 0

    pairs = model.pairwise()
    for k, text in enumerate(texts):
        spans, _ = base(text)
        out.append((spans, []))
        if model.unary and (_HOLDS(text) or _SPELLED(text)):
            at = words(text)
            fixed = held(at, spans)
            if -1 in fixed:
                waiting.append((k, at, fixed))
                n += len(at)
                if n > 50_000:
                    settle()
    settle()
    return out


_SPANS = "doc_id long, spans array<struct<kind:int,start:long,end:long,added:boolean>>"


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, spans) of every whole text: base and added ones, by kind, then start; offsets in code points.

    A null text is empty and has none. Rows that repeat an id have a row each; an empty table gives none; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())]))
        for b in batches:
            spans = [sorted([(*s, False) for s in old] + [(*s, True) for s in new]) for old, new in find(b.column("text").to_pylist(), shared.value)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([[dict(zip(("kind", "start", "end", "added"), s, strict=True)) for s in row] for row in spans], kind)], names=["doc_id", "spans"])

    return id_text(docs).mapInArrow(run, _SPANS)


def report(found: DataFrame) -> DataFrame:
    """Counts by kind, digest and list of spans for each row of scan."""
    names = F.array(*(F.lit(k) for k in KINDS))
    listed = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    first = F.filter("spans", lambda x: ~x["added"])
    count = lambda k: F.size(F.filter("spans", lambda x: ~x["added"] & (x["kind"] == k))).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *map(count, range(len(KINDS))), F.sha2(listed(first), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda x: x["added"])).cast("long").alias("n_added"))
