"""Diffs against a plain reading of them."""

import random
import re

from grove.operators import change


def plain_diff(text):
    out, path, start, n = set(), None, None, 0
    for line in text.split("\n"):
        head = False
        if line.startswith("+++ "):
            path = re.sub(r"\t.*$", "", re.sub(r"^\+\+\+ (?:b/)?", "", line))
        if m := re.match(r"@@ -\d+(?:,\d+)? \+(\d+)", line):
            if int(m[1]) < 2**31:
                start, n, head = int(m[1]), 0, True
        if head or re.match(r"\+\+\+|---|diff |index ", line):
            continue
        if start is not None and path not in (None, "/dev/null") and line[:1] in ("+", "-"):
            out.add((path, start + n))
        n += not line.startswith("-")
    return out


def test_diff_lines_on_odd_diffs(spark):
    r = random.Random(5)
    lines = ["+++ b/x.py", "+++ y\t2020", "+++ /dev/null", "+++z", "--- a/x", "---", "-- a", "- gone", "-", "+new", "+", "++", " same", "", "@@ -1,2 +5,6 @@ f", "@@ -3 +9 @@", "@@ bad", "@@ -1 +99999999999 @@", "diff --git a b", "index 1..2"]
    texts = ["\n".join(r.choice(lines) for _ in range(r.randrange(14))) for _ in range(1000)]
    found = change.diff_lines(spark.createDataFrame(list(enumerate(texts)), "diff_id int, text string"))
    got = {tuple(x) for x in found.collect()}
    assert got == {(i, *x) for i, t in enumerate(texts) for x in plain_diff(t)}


def test_diff_lines_sorts_pieces_once(spark):
    """Before, a row for each line was sorted twice."""
    found = change.diff_lines(spark.createDataFrame([(1, "+++ b/x\n@@ -1 +1 @@\n+a")], "diff_id int, text string"))
    assert len(re.findall(r"\bSort \[", found._jdf.queryExecution().executedPlan().toString())) == 1
