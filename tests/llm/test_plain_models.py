"""Both classifiers, and the parts of operators 1, 2, 8 and 10, against plain versions that go step by step."""

import math
import time
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from grove.llm import chat, order_minhash, quality, secrets, toxicity, vector_file
from grove.llm.ftrl import FTRL

# Follow the regularised leader, one coordinate at a time


def plain_ftrl(examples, order, alpha, beta, l1, l2, rising):
    z, n = {}, {}
    zb = nb = 0.0

    def weight(i):
        s = z.get(i, 0.0)
        if (s >= -l1) if rising else (abs(s) <= l1):
            return 0.0
        return -(s - math.copysign(l1, s)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for e in order:
        at, x, y = examples[e]
        w = [weight(int(i)) for i in at]
        bias = -zb / ((beta + math.sqrt(nb)) / alpha)
        p = 1 / (1 + math.exp(-max(-35.0, min(35.0, bias + sum(a * float(v) for a, v in zip(w, x))))))
        for i, v, u in zip(at, x, w):
            i, g = int(i), (p - y) * float(v)
            old = n.get(i, 0.0)
            n[i] = old + g * g
            z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(old)) / alpha * u
        g = p - y
        zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * bias
        nb += g * g
    return weight, -zb / ((beta + math.sqrt(nb)) / alpha)


@pytest.mark.parametrize("rising", [False, True])
def test_ftrl_against_plain(rising):
    rng = np.random.default_rng(3)
    examples = [((at := np.unique(rng.integers(0, 60, 8))), rng.random(len(at)) * 3, int(rng.random() < 0.4)) for _ in range(200)]
    weights, bias = FTRL(6, alpha=0.4, l1=0.6, l2=0.07, rising=rising).fit(examples, 2)
    seeded = np.random.default_rng(7)
    order = [int(i) for _ in range(2) for i in seeded.permutation(len(examples))]
    weight, want_bias = plain_ftrl(examples, order, 0.4, 1.0, 0.6, 0.07, rising)
    assert bias == pytest.approx(want_bias)
    assert weights[:64] == pytest.approx([weight(i) for i in range(64)], rel=1e-5)
    assert 0 < np.count_nonzero(weights) < 64 and (not rising or weights.min() >= 0)


# Toxicity: every reading of a short lattice


def every_reading(word, cost):
    cls = toxicity.classes()
    of = lambda x: 0 if x == " " else int(cls[ord(x)])
    best = math.inf
    for way in product(*toxicity.options(word)):
        a = b = 0
        total = 0.0
        for x, c in way:
            total += c
            if x:
                total += cost[a, b, of(x)]
                a, b = b, of(x)
        best = min(best, total + cost[a, b, 0])
    return best


def cost_of(word, clean, cost):
    """The least cost of the readings that spell clean."""
    cls = toxicity.classes()
    of = lambda x: 0 if x == " " else int(cls[ord(x)])
    best = math.inf
    for way in product(*toxicity.options(word)):
        if "".join(x for x, _ in way) == clean:
            a = b = 0
            total = 0.0
            for x, c in way:
                total += c
                if x:
                    total += cost[a, b, of(x)]
                    a, b = b, of(x)
            best = min(best, total + cost[a, b, 0])
    return best


def test_viterbi_against_every_reading(spark):
    rows = [(i, t) for i, t in enumerate(["the idiot was a trash loser", "idle lost time is stone light", "a loss of class, a glass of water", None, ""])]
    cost = toxicity.trigram_costs(spark.createDataFrame(rows, "doc_id long, text string"))
    rng = np.random.default_rng(11)
    words = ["1d10t", "l0s3r", "t r a s h", "iidiiott", "tr@$h", "cl455", "g.l.a.s.s", "!!", "5!0w"]
    words += ["".join(rng.choice(list("aeilost015$!. -"), int(rng.integers(1, 8)))) for _ in range(40)]
    for w in words:
        assert cost_of(w, toxicity.decode(w, cost), cost) == pytest.approx(every_reading(w, cost)), w


def test_plain_words_need_no_lattice(monkeypatch):
    """Letters between signs go to their features at once; those are the restorer's, as all words' are."""

    class Some(dict):
        def __contains__(self, p):
            return p % 3 == 0

    restorer = toxicity.Restorer(np.ones((32, 32, 32)))
    model = toxicity.Model(restorer, Some(), -1.0)
    odd = "!!idiot $$fool a-s-s ..word.., __init__ @you f00l 're ab' moss na\u00efve... \u0434\u043e\u043c \u0434o\u043c x|y hi! cool$ \u0301a \u2167 id__iot a''b".split()
    plain = "(stone) stones, stonework. \"house\" \u00e9t\u00e9 \u0434\u043e\u043c; a of".split()
    want = {w: {p for c in restorer.word(w) for p in toxicity.places(c) if p % 3 == 0} for w in odd + plain}
    for _ in range(2):
        assert {w: set(model.telling(w)) for w in odd + plain} == want
    assert any(want.values()) and model.dull | set(model.memo) == set(want)
    model.release()
    monkeypatch.setattr(toxicity.Restorer, "word", lambda *_: pytest.fail("a plain word was restored"))
    assert {w: set(model.telling(w)) for w in plain} == {w: want[w] for w in plain}


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_against_plain(spark, odd, plain, module):
    """Scores of all odd rows from the model's weights, one feature after the other, with no memos."""
    rng = np.random.default_rng(2)
    if module is toxicity:
        restorer = toxicity.Restorer(toxicity.trigram_costs(odd))
        weights = {p: float(rng.random()) for w in ("river", "stone", "house", "été") for p in toxicity.places(w)}
        model = toxicity.Model(restorer, weights, -2.0)

        def want(text):
            fresh = toxicity.Restorer(restorer.cost)
            places = {p for w in toxicity.raw_words(text) for c in fresh.word(w) for p in toxicity.places(c)}
            return -2.0 + sum(weights.get(p, 0.0) for p in places)
    else:
        table = rng.normal(size=1 << quality.BITS).astype(np.float32)
        model = quality.Model(table, -0.5)

        def want(text):
            f = quality.features(text).tolist()
            return -0.5 + quality.SCALE * sum(float(table[i]) for i in f) / max(1, len(f))

    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["score"], r["predicted"]) for r in module.score(odd, model).collect())
    expected = sorted((i is None, i or 0, 1 / (1 + math.exp(-max(-35.0, min(35.0, want(t)))))) for i, t in plain)
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    assert [g[2] for g in got] == pytest.approx([e[2] for e in expected], abs=1e-6)
    assert all(p == int(s >= module.THRESHOLD) for *_, s, p in got)


# Order MinHash: colliding high bits


def test_occurrences_by_all_bits():
    low = [5, 7, 5, 5, 7, 9, 5]
    h = np.array([(3 << 40) + x for x in low], np.uint64)
    seen, want = {}, []
    for x in low:
        want.append(seen.get(x, 0))
        seen[x] = seen.get(x, 0) + 1
    assert order_minhash.occurrences(h).tolist() == want
    assert order_minhash.occurrences(np.array([1 << 50, 2 << 50, 1 << 50], np.uint64)).tolist() == [0, 0, 1]


# Secrets: many matches in one text


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 700])
def test_places_of_many_matches(spark, n):
    text = "é " + "".join(f"{i:032x} x " for i in range(n))
    (row,) = spark.createDataFrame([(text,)], "text string").select(secrets.matches(F.col("text"), secrets.HEX).alias("m")).collect()
    assert [(m["start"], m["end"], m["hit"]) for m in row["m"]] == [(2 + 35 * i, 34 + 35 * i, f"{i:032x}") for i in range(n)]


def test_time_of_many_matches(spark):
    """Eight times the matches take far less than 64 times the time."""
    took = []
    for n in (8_000, 8_000, 64_000):
        text = "".join(f"{i:032x} x " for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        assert df.select(F.size(secrets.matches(F.col("text"), secrets.HEX)).alias("n")).first()["n"] == n
        took.append(time.perf_counter() - began)
    assert took[2] < 24 * max(took[1], 0.5)


def test_redact_many_spans(spark):
    """Spans that overlap, touch and lie apart, more than one run of them, against cutting by hand."""
    rng = np.random.default_rng(8)
    for n in (1, 255, 256, 257, 800):
        text = "é" + "".join(rng.choice(list("abc \U0001f600"), 12 * n))
        starts = np.sort(rng.integers(0, 11 * n, n))
        spans = sorted((int(a), 0, int(a + rng.integers(1, 30))) for a in starts)
        spans = [(a, k, min(b, len(text))) for a, k, b in spans]
        want, at = "", 0
        for a, _, b in spans:
            if a >= at:
                want += text[at:a] + "#"
            at = max(at, b)
        want += text[at:]
        df = spark.createDataFrame([(text, spans)], "text string, spans array<struct<start:bigint,kind:int,end:bigint>>")
        assert df.select(secrets.marked(F.col("text"), F.col("spans"), "#").alias("t")).first()["t"] == want


# Chat: the log that the query folds


def test_log_has_all_kinds(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi there"), (1, 1, "assistant", "yes\U0001f600, ok"), (1, 1, "assistant", "again"), (1, 2, None, None)], "conv_id long, turn long, role string, text string")
    log = chat.events_of(rows)
    assert {r["kind"] for r in log.collect()} == {"message", "delta", "edit", "regenerate"}
    (row,) = chat.reconstruct(log).collect()
    assert [(m["turn"], m["role"], m["text"]) for m in row["messages"]] == [(0, "user", "hi there"), (1, "assistant", "again"), (1, "assistant", "yes\U0001f600, ok"), (2, "", "")]


# Vector-approximation files


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e6, 1e30])
def test_bounds_hold(scale):
    rng = np.random.default_rng(4)
    x, q = (np.floor(1024 * scale * rng.normal(size=(n, 33))) for n in (200, 20))
    x[7], x[8] = 3.0, 0.0
    least, best = vector_file.Approximation.of(x).bounds(q)
    exact = np.array([vector_file.exact_scores(np.broadcast_to(r, x.shape), x) for r in q]).astype(np.float64)
    assert (least <= exact).all() and (exact <= best).all()


def test_few_vectors_are_read():
    """Of 4,000 vectors few are open after the scan, and the best ten are among them."""
    rng = np.random.default_rng(6)
    x = np.floor(1024 * rng.normal(size=(4000, 64)) / 8)
    ids = np.arange(len(x))
    query, near, *_ = vector_file.candidates(ids[:20], x[:20], ids, vector_file.Approximation.of(x), 10)
    assert len(near) < 20 * 40
    for i in range(20):
        s = sorted(((-int(x[i] @ x[j]), j) for j in ids if j != i))[:10]
        assert {j for _, j in s} <= set(near[query == i].tolist())


def test_needed_copies():
    ids = np.array([9, 1, 5, 3, 3, 7, 2])
    same = np.array([[1, 1], [1, 1], [1, 1], [1, 1], [1, 1], [2, 1], [1, 2]], np.uint64)
    assert ids[vector_file.needed_copies(ids, same, 1)].tolist() == [1, 2, 3, 7]
    assert ids[vector_file.needed_copies(ids, same, 10)].tolist() == [1, 2, 3, 5, 7, 9]
