"""Order MinHash and SimHash against plain versions."""

from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from xxhash import xxh64_intdigest

from grove.llm import order_minhash as om
from grove.llm import simhash as sh


def plain_sketches(text):
    """One pair of loops a sketch."""
    x = [ord(c) + 1 for c in text]
    if len(x) < om.K:
        h = [len(x)]
        for v in x:
            h = [(h[0] * int(om.M1) + v) % 2**64]
    else:
        h = []
        for i in range(len(x) - om.K + 1):
            v = 0
            for c in x[i : i + om.K]:
                v = (v * int(om.M1) + c) % 2**64
            h.append(v)
    mix = lambda v: int(om.mixed(np.array([v % 2**64], np.uint64))[0])
    h = [mix(v) for v in h]
    seen, e = Counter(), []
    for v in h:
        e.append(mix(v + seen[v] * int(om.M1)) >> 32)
        seen[v] += 1
    out = []
    for a, b in zip(om.MULTIPLY.tolist(), om.ADD.tolist(), strict=True):
        best = sorted(range(len(e)), key=lambda i: ((e[i] * a + b) % 2**32, i))[: om.TUPLE]
        t = len(best)
        for i in sorted(best):
            t = mix(t * int(om.M1) + h[i])
        out.append(t >> 32)
    return out


@pytest.mark.parametrize("text", ["", "a", "abcde", "abcdef", "abcdefabcdefabcdef", "the cat sat on the mat, the cat sat", "é\U0001f600" * 9, "a" * 60])
def test_sketches(text):
    assert om.sketches(text).tolist() == plain_sketches(text)


def test_sketches_follow_order():
    a, b = "one two three four five six seven " * 3, "seven six five four three two one " * 3
    assert om.likeness(om.sketches(a), om.sketches(a)) == 1.0
    words = [f"w{i:04d}" for i in range(600)]
    same, shuffled = " ".join(words), " ".join(words[300:] + words[:300])
    edited = " ".join(words[:590] + ["zz"] * 10)
    assert om.likeness(om.sketches(same), om.sketches(edited)) > 0.8 > om.likeness(om.sketches(same), om.sketches(shuffled)) > 0.2
    assert om.likeness(om.sketches(a), om.sketches(b)) < 0.5


def test_blocks_and_long_hashes_agree(monkeypatch):
    text = "".join(chr(97 + i * i % 7) for i in range(3000))
    want = om.sketches(text).tolist()
    monkeypatch.setattr(om, "BLOCK", 100)
    monkeypatch.setattr(om, "POS_BITS", 4)
    assert om.sketches(text).tolist() == want


def test_fingerprints_query(odd, plain):
    got = om.fingerprints(odd, 3).collect()
    order = sorted(plain, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert len(got) == len(order)
    want = Counter()
    for i, (doc_id, text) in enumerate(order):
        edited = om.edited_text(text, order[(i + 1) % len(order)][1])
        want[(doc_id, len(text), sha256(edited.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    prints = {r["doc_id"]: r for r in got}
    assert prints[7]["fingerprint"] == prints[8]["fingerprint"] != prints[9]["fingerprint"]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_parts_make_no_difference(odd):
    rows = lambda n: sorted(map(str, om.fingerprints(odd, n).collect()))
    assert rows(1) == rows(5) == rows(50)


def test_single_and_empty(spark, empty):
    assert om.fingerprints(empty).count() == 0
    one = om.fingerprints(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == sha256(b"abab").hexdigest() and one["near_next"] == 1.0


# SimHash


def plain_simhash(text, words=3):
    ws = [w for w in "".join(c.lower() if c.isascii() else c for c in text).replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    grams = [" ".join(ws[i : i + words]) for i in range(len(ws) - words + 1)] or ([" ".join(ws)] if ws else [])
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def plain_components(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, f) in enumerate(prints):
        for j in range(i):
            if (f ^ prints[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (doc_id, _) in enumerate(prints):
        groups[find(i)].append(doc_id)
    return {(d, f, min((x for x in groups[find(i)] if x is not None), default=None)) for i, (d, f) in enumerate(prints)}


def test_components_query(odd, plain):
    got = {(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in sh.components(odd).collect()}
    assert got == plain_components([(d, plain_simhash(t)) for d, t in plain])


def test_empty_table(empty):
    assert sh.components(empty).count() == 0
    assert sh.representatives(empty, 5, 0.8).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3))
def test_anchors_cover(x, flips):
    y = x
    for b in flips:
        y ^= 1 << b
    a, da = sh.COVER.anchors(x, 2)
    b, db = sh.COVER.anchors(y, 2)
    assert min(da) <= sh.COVER.radius == 7
    home = lambda k, d: set(k[d <= 8].tolist())
    assert home(a, da) & set(b.tolist()) or home(b, db) & set(a.tolist())


@pytest.mark.parametrize("block", [3, 2048])
def test_crowded_anchors(spark, monkeypatch, block):
    """Chains, stars and copies around few centres, in one block and in many."""
    monkeypatch.setattr(sh, "BLOCK", block)
    rng = np.random.default_rng(3)
    fps = []
    for c in rng.integers(0, 2**64, 4, dtype=np.uint64).tolist():
        for _ in range(40):
            fps.append(c)
            c ^= 1 << int(rng.integers(64)) if rng.random() < 0.7 else 0
            c ^= (1 << int(rng.integers(64))) if rng.random() < 0.5 else 0
    fps += rng.integers(0, 2**64, 40, dtype=np.uint64).tolist()
    distinct = sorted(set(fps))
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in distinct], "fp long")
    roots = {r["fp"]: r["root"] for r in sh.contract(sh.link_forest(df)).collect()}
    signed = lambda f: f - 2**64 if f >> 63 else f
    want = plain_components([(signed(f), f) for f in distinct])
    assert {(signed(f), f, roots.get(signed(f), signed(f))) for f in distinct} == want


def test_groups_by_shingles(spark):
    import random

    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8)))
    docs, i = [], 0
    for _ in range(12):
        base = [word() for _ in range(r.randrange(30, 300))]
        for edits in (0, 0, 1, 2, 5, 40):
            t = list(base)
            for _ in range(edits):
                t[r.randrange(len(t))] = word()
            docs.append((i, " ".join(t)))
            i += 1
    docs += [(900, ""), (901, None), (902, "few words"), (903, "few  words"), (None, docs[0][1])]
    sets = {d: set(sh.shingle_hashes(t or "", 5).tolist()) for d, t in docs}
    pairs = [(a, b) for a in sets for b in sets if a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    group = {d: d if d is not None else 2**63 - 1 for d in sets}
    for _ in range(len(sets)):
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    got = {r["doc_id"]: r["first_id"] for r in sh.duplicate_ids(spark.createDataFrame(docs, "doc_id long, text string"), 5, 0.8).collect()}
    assert got == {(2**63 - 1 if d is None else d): g for d, g in group.items()}


def test_representatives_keep_columns(odd):
    kept = sh.representatives(odd, 5, 0.8)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 7 in ids and 8 not in ids and 9 not in ids and None in ids


def groups_by_brute_force(docs):
    """The smallest id of each id's component of pairs that share 80 % of their five-word shingles."""
    sets = [(d, set(sh.shingle_hashes(t, 5).tolist())) for d, t in docs]
    group = {d: d for d, _ in sets}
    pairs = [(a, b) for a, x in sets for b, y in sets if a < b and len(x & y) >= 0.8 * len(x | y)]
    for _ in sets:
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    return group


def groups(spark, docs):
    return {r["doc_id"]: r["first_id"] for r in sh.duplicate_ids(spark.createDataFrame(docs, "doc_id long, text string"), 5, 0.8).collect()}


def test_groups_of_equal_words(spark):
    """The first text with the same words isn't similar to the others, which are to each other."""
    words = [f"w{i}" for i in range(200)]
    docs = [(1, "red blue"), (2, "blue red"), (3, "Blue red"), (10, " ".join(words[::-1])), (11, " ".join(words)), (12, " ".join([*words[5:], *words[:5]])), (13, " ".join([*words[10:], *words[:10]]))]
    got = groups(spark, docs)
    assert got == groups_by_brute_force(docs) == {1: 1, 2: 2, 3: 2, 10: 10, 11: 11, 12: 11, 13: 11}


def test_groups_of_block_edits(spark):
    """Each text with a copy that lost its tail, or got a header or a passage: similarity 0.8 and little more."""
    import random

    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9)))
    docs = []
    for i in range(90):
        base = [word() for _ in range(r.choice([60, 150, 400, 1500]))]
        new = [word() for _ in range(len(base) // 5 - 4 - r.randrange(3))]
        cut = r.randrange(len(base))
        copy = [base[: len(base) - len(new)], new + base, base[:cut] + new + base[cut:]][i % 3]
        docs += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    want = groups_by_brute_force(docs)
    assert sum(d != g for d, g in want.items()) >= 80 and groups(spark, docs) == want


def kept_rows(spark, rows):
    return [tuple(r) for r in sh.representatives(spark.createDataFrame(rows, "doc_id long, text string"), 5, 0.8).collect()]


def test_texts_without_ids(spark):
    text = " ".join(f"w{i}" for i in range(200))
    kept = kept_rows(spark, [(3, text), (None, text + " more"), (None, "unrelated"), (None, "Another one"), (None, "unrelated")])
    assert sorted(kept, key=repr) == [(3, text), (None, "Another one"), (None, "unrelated")]


def test_copies_of_texts_with_repeated_ids(spark):
    """One row an id stays; a text whose row goes for that is no reason to drop its copies."""
    one, two = (" ".join(f"{c}{i}" for i in range(200)) for c in "ab")
    kept = kept_rows(spark, [(3, one), (3, two), (5, two + " end"), (6, one + " end")])
    assert len(kept) == 2 and kept.count((3, one)) + kept.count((3, two)) == 1 and {t[0] for _, t in kept} == {"a", "b"}
