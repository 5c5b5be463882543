"""The filter and source audits and personal data against plain versions of themselves."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from grove.llm import divergence, filter_audit, pii
from tests.llm.conftest import SCHEMA, odd_rows, prose


def shouting(seed):
    r = random.Random(seed)
    n = r.choice([0, 3, 49, 50, 80])
    text = " ".join(r.choice(["word", "Other", "AND", "x#1", f"n{i}"]) for i in range(n))
    return text if r.random() < 0.6 else r.choice(["", "THE SAME TEXT", "a | b"])


@pytest.fixture(scope="module")
def mixed():
    """Rows in which every filter removes some, with copies, repeated ids, and ids and sources that are null."""
    rows = [(i % 57 if i % 11 else None, shouting(i), "en", [None, "", "a", "b", "hot", "hot", "hot"][i % 7], 0, *[None] * 6) for i in range(120)]
    return [*odd_rows(), *rows]


LABELS = [(0, 1, 0), (3, 1, 1), (3, 0, None), (5, None, 1), (7, 1, 0), (10, 0, 0), (None, 1, 1), (40, 1, 1), (40, 1, 1)]


def plain_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if i is not None and q == 1}, {i for i, _, t in labels if i is not None and t == 1}
    least = {}
    inf = float("inf")
    for r in rows:
        t, i = r[1] or "", inf if r[0] is None else r[0]
        least[t] = min(least.get(t, inf), i)
    docs = []
    for r in rows:
        t, i = r[1] or "", inf if r[0] is None else r[0]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i > least[t]}
        docs.append((r[3] or "", {x for x, v in f.items() if v}, r[0] in good, r[0] in toxic))
    out, shapley = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        left = docs
        for step, x in enumerate(order, 1):
            for part in {d[0] for d in docs}:
                mine = [d for d in left if d[0] == part]
                gone = [d for d in mine if x in d[1]]
                failing = [d for d in docs if d[0] == part and x in d[1]]
                out[part, order, step] = (len(mine) - len(gone), len(gone), len(failing) - len(gone), sum(d[1] == {x} for d in failing), sum(d[2] for d in gone), sum(d[3] for d in gone))
                shapley[part, x] += len(gone)
            left = [d for d in left if x not in d[1]]
    return sorted((p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items())


def test_filter_audit(spark, mixed):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(spark.createDataFrame(mixed, SCHEMA), labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == plain_audit(mixed, LABELS)


def test_filter_audit_of_nothing(spark, empty):
    assert filter_audit.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_states_are_shared():
    steps = filter_audit.orders()
    assert len(steps) == 600 and len({s for _, _, _, s in steps}) == 31 and len({(s, f) for _, _, f, s in steps}) == 80


def test_hot_copies_and_others_agree(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "p", bytearray(str(i % 7 if i % 3 else 0), "ascii"), 0) for i in range(90)], "doc_id long, part string, digest binary, fails int")
    want = sorted(map(str, filter_audit.with_copies(rows).collect()))
    monkeypatch.setattr(filter_audit, "HOT", 2)  # only texts with half the rows count as hot
    assert sorted(map(str, filter_audit.with_copies(rows).collect())) == want


def plain_divergence(rows, least, ranks):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for r in rows:
        text, lang, source = (r[i] or "" for i in (1, 2, 3))
        terms = re.findall(divergence.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        whole = sum((counts[lang, s] for s in sources), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        q, p = share(whole), {s: share(counts[lang, s]) for s in sources}
        for s in sources:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            term = [(q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", i.decode(), -v, k) for k, (v, i) in enumerate(sorted(pair), 1)]
            out += [(lang, s, "term", i.decode(), -v, k) for k, (v, i) in enumerate(sorted(term)[:ranks], 1)]
    return sorted(out)


def test_divergence(spark, monkeypatch):
    langs, sources = ["en", None, "fr", "en"], ["a", "é", "", None, "B", "hot", "hot", "hot"]
    rows = [(i, prose(i, i % 40) + ["", " ÉTÉ Été x", " \x00Ab1cD"][i % 3], langs[i % 4], sources[i % 8], 0, *[None] * 6) for i in range(150)] + odd_rows()
    rows += [(900, "", "xx", "only", 0, *[None] * 6), (901, None, "yy", "one", 0, *[None] * 6), (902, "12 34", "yy", "two", 0, *[None] * 6)]
    want = plain_divergence(rows, 3, 4)
    assert {r[2] for r in want} == {"pair", "term"} and ("yy", "one", "pair", "two", 0, 1) in want
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, divergence.audit(docs, 3, 4).collect())) == want
    assert sorted(map(tuple, divergence.audit(docs, 30, 50).collect())) == plain_divergence(rows, 30, 50)


def test_terms_in_pieces(monkeypatch):
    text = prose(4, 3000) + "  Ωmega-" + "z" * 500
    whole = [t for part in divergence.term_lists(text) for t in part]
    monkeypatch.setattr(divergence, "PIECE", 64)
    assert [t for part in divergence.term_lists(text) for t in part] == whole
    assert [t.decode() for t in whole] == re.findall(divergence.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_divergence_of_nothing(empty):
    assert divergence.audit(empty).count() == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    def fits(kind, s):
        d = [int(c) for c in s if c.isdigit()]
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        if kind == "card":
            twice = [sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(reversed(d))]
            return 16 <= len(d) <= 19 and sum(twice) % 10 == 0
        return kind == "email" or 8 <= len(d) <= 15

    return [(k, *m.span()) for k, name in enumerate(PLAIN) for m in re.finditer(PLAIN[name], text) if fits(name, m[0])]


def test_base_spans(plain):
    r = random.Random(3)
    bits = ["a", "@", ".", "1", "255", "256", "4012888888881881", "+", " ", "-", "(", ")", "x@y.z", "1.2.3.4", "+1 (487) 555-7209", "0", "\n", "é", "00", "a.b%c"]
    texts = [t for _, t in plain] + ["".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(3000)]
    for t in texts:
        assert pii.base(t)[0] == plain_base(t), t


def exact_marginals(unary, edges, pairwise):
    n = len(unary)
    out = np.zeros_like(unary)
    for y in itertools.product(range(pii.LABELS), repeat=n):
        p = np.exp(sum(unary[i, y[i]] for i in range(n)) + sum(pairwise[t, y[i], y[j]] for i, j, t in edges))
        for i in range(n):
            out[i, y[i]] += p
    return out / out.sum(1, keepdims=True)


def test_messages_are_exact_on_trees_and_as_plain_ones_on_loops():
    rng = np.random.default_rng(1)
    unary, pairwise = rng.normal(size=(4, pii.LABELS)), rng.normal(size=(3, pii.LABELS, pii.LABELS))
    tree = np.array([(0, 1, 0), (1, 2, 1), (1, 3, 2)])
    assert np.allclose(pii.marginals(unary, tree, pairwise), exact_marginals(unary, tree, pairwise))
    loop = [(0, 1, 0), (1, 2, 0), (0, 2, 1), (2, 3, 2)]
    m = {(a, b): np.zeros(pii.LABELS) for i, j, _ in loop for a, b in ((i, j), (j, i))}
    for _ in range(pii.ROUNDS):
        new = {}
        for i, j, t in loop:
            for a, b, psi in ((i, j, pairwise[t]), (j, i, pairwise[t].T)):
                s = unary[a] + sum(v for (x, y), v in m.items() if y == a and x != b)
                v = np.array([np.logaddexp.reduce(s + psi[:, y]) for y in range(pii.LABELS)])
                new[a, b] = v - v.max()
        m = new
    z = np.exp(np.array([unary[a] + sum(v for (_, y), v in m.items() if y == a) for a in range(4)]))
    assert np.allclose(pii.marginals(unary, np.array(loop), pairwise), z / z.sum(1, keepdims=True))


def luhn_card(r):
    d = [r.randrange(10) for _ in range(15)]
    return next("".join(map(str, [*d, k])) for k in range(10) if pii.luhn("".join(map(str, [*d, k]))))


def private(i):
    r = random.Random(i)
    phone = f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}"
    what = [f"{r.choice(['ann', 'bo.lee', 'kim_x'])}{r.randrange(99)}@mail{r.randrange(9)}.example.com", f"{r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}", luhn_card(r), phone]
    return f"{prose(i, 12)} {what[i % 4]} {prose(i + 1, 9)} {what[(i + 1) % 4]} {prose(i + 2, 9)} on page {r.randrange(1, 400)} of 2.{i}"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, private(i) if i % 3 else prose(i, 30), "en", "s", 0, *[None] * 6) for i in range(1500)]
    return pii.fit(spark.createDataFrame(rows, SCHEMA))


CASES = {
    "call (487) 555-7209 or 487-555-7209 now": ["phone (487) 555-7209", "phone 487-555-7209"],
    "host 12[.]34[.]56[.]78 is up": ["ip 12[.]34[.]56[.]78"],
    "pay 4736.9625.7309.9581 by noon": ["card 4736.9625.7309.9581"],
    "ring +1 (269) 555-3296 4736962573099581 and go": ["card 4736962573099581", "phone +1 (269) 555-3296"],
    "cards 4736962573099581 4736962573099581 twice": ["card 4736962573099581", "card 4736962573099581"],
    "kim_x12 [at] mail3.example.com is mine": ["email kim_x12 [at] mail3.example.com"],
    "order 12345678 of 2021-03-04 at 10:00, page 17 of version 2.4": [],
    "meet at noon near the dot of light": [],
    "": [],
}


@pytest.mark.parametrize("text", CASES)
def test_added_spans(model, text):
    ((_, new),) = pii.find([text], model)
    assert sorted(f"{pii.KINDS[k]} {text[s:e]}" for k, s, e in new) == CASES[text]


def test_a_mention_is_found_by_its_link(model):
    alone, linked = "reach 2695553296 today", "reach +1 (269) 555-3296 today, " + "the light of the river house " * 40 + "or 2695553296"
    (_, none), (base, new) = pii.find([alone, linked], model)
    assert none == [] and [linked[s:e] for _, s, e in base] == ["+1 (269) 555-3296"]
    assert [(pii.KINDS[k], linked[s:e]) for k, s, e in new] == [("phone", "2695553296")]


def test_texts_share_a_graph_without_effect(model):
    texts = [*CASES, *(private(i) for i in range(40))]
    assert pii.find(texts, model) == [pii.find([t], model)[0] for t in texts]


def test_many_mentions_in_one_text(model, monkeypatch):
    text = " ".join(f"{i} x (487) 555-{7000 + i % 50} y" for i in range(2000))
    whole = pii.find([text], model)
    monkeypatch.setattr(pii, "STEP", 37)
    assert pii.find([text], model) == whole and len(whole[0][1]) == 2000


def test_scan_and_report(spark, odd, empty, model, plain):
    rows = {(r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in pii.report(pii.scan(odd, model)).collect()}
    kinds = lambda t: [sum(k == x for x, _, _ in plain_base(t)) for k in range(4)]
    assert rows == {(i, *kinds(t)) for i, t in plain}
    assert pii.report(pii.scan(odd, model)).count() == len(plain)
    assert pii.scan(empty, model).count() == 0 and pii.fit(empty).unary == {}
    one = spark.createDataFrame([(1, "a@b.c 4736962573099581 4736962573099581")], "doc_id long, text string")
    r = pii.report(pii.scan(one, model)).first()
    assert r["spans"] == "email:0:5,card:6:22,card:23:39" and (r["n_card"], r["n_added"]) == (0, 2)


def test_the_query_over_a_whole_table(spark):
    from hashlib import sha256

    from grove.llm.queries import queries
    from tests.conftest import SF

    names = list(PLAIN)
    listed = lambda spans: ",".join(f"{names[k]}:{s}:{e}" for k, s, e in spans)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries()["op12_pii"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_base(texts[r["doc_id"]])
        assert r["base_sha256"] == sha256(listed(want).encode()).hexdigest()
        assert [r[f"n_{n}"] for n in names] == [sum(k == i for k, _, _ in want) for i in range(4)]
        spans = r["spans"].split(",") if r["spans"] else []
        assert len(spans) == len(want) + r["n_added"] and set(listed(want).split(",") if want else []) <= set(spans)
        assert spans == sorted(spans, key=lambda x: (names.index(x.split(":")[0]), int(x.split(":")[1])))
