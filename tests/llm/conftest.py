import random

import pytest

WORDS = "the and of in on river stone light house market little under over river idea answer window paper garden".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, fp long, score double, found string, keep_id long, borrowed boolean"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", ".\n"]) + (str(r.randrange(99)) if r.random() < 0.03 else "") for _ in range(n))


def odd_rows():
    """Nulls in every column, empty, tiny and very long texts, exact and near copies, repeated rows and ids, odd characters."""
    long = prose(1, 30_000)
    base = prose(2, 400)
    near = base.replace("river", "brook", 1)
    texts = ["", None, "a", "ab cd", " ", "\n\n \t", long, base, base, near, "été ÉCOLE straße \U0001f600‍ x", "<|endoftext|> <|im_end|>", "a  b   c  d\x1c e", "0" * 300, prose(3, 60), prose(4, 61), "Z" * 5000]
    rows = [(i, t, "en", "s", len(t or ""), 1, 2, 0.5, "x", 3, True) for i, t in enumerate(texts)]
    return [*rows, rows[7], (14, prose(5, 40), None, None, None, None, None, None, None, None, None), (None, "no id here at all", None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def plain():
    """(doc_id, text) of the odd rows, a null text as empty."""
    return [(r[0], r[1] or "") for r in odd_rows()]
