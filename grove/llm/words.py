"""Token ids of whole texts from bounded memos: of the pieces between spaces, and of their pre-tokens.

A pre-token never spans a space but at its own start. So a text may be cut before every space, and each piece (with that
space) be encoded alone, unless the space stands between two white-space characters: a run of those is one pre-token. Such
texts are cut only before spaces that a visible character follows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import islice

_BETWEEN = re.compile(r"\s \s").search
_VISIBLE = re.compile(r" (?=\S)").split
#: Signs that, in a row after a word, are one pre-token (an apostrophe may begin another).
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class Memo(dict):
    """make(key) of every key asked for, kept in two generations of limit keys each.

    A full generation becomes the older one; keys that are met again move up from it, and the others go with the next turn.
    """

    def __init__(self, make: Callable[[str], bytes], limit: int) -> None:
        super().__init__()
        self.make, self.limit = make, limit
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


class WordMemo:
    """Ids of texts as bytes of little-endian unsigned 32-bit integers.

    split gives the pre-tokens of a piece and encode the ids of a pre-token. spaces: whether a space belongs to the pre-token
    after it; if not, white space only separates. plain tells whether letters alone are one pre-token as they stand, and fold
    gives a form of a text that has the same ids and more pieces in common with others. marks: strings that are found first, the longest of those at
    a place, with their ids.
    """

    def __init__(self, split: Callable[[str], list[str]], encode: Callable[[str], bytes], spaces: bool = True, plain: Callable[[str], bool] = str.isalpha, fold: Callable[[str], str] | None = None, limit: int = 350_000, marks: dict[str, bytes] | None = None) -> None:
        self.marks = marks or {}
        self.marked = re.compile("|".join(map(re.escape, sorted(self.marks, key=len, reverse=True)))) if self.marks else None
        self.split, self.encode, self.plain, self.spaces, self.fold = split, encode, plain, spaces, fold
        self.parts = Memo(encode, limit // 4)
        self.pieces = Memo(self.spaced if spaces else self.bare, limit)
        self.heads = Memo(self.bare, limit // 4) if spaces else self.pieces

    def any(self, piece: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, self.split(piece)))

    def bare(self, piece: str) -> bytes:
        """A piece as it stands. Letters, and signs in a row after them, need no pattern."""
        if self.plain(piece):
            return self.encode(piece)
        word = piece.rstrip(SIGNS)
        if len(word) < len(piece) and self.plain(word):
            return self.heads[word] + self.parts[piece[len(word) :]]
        return self.any(piece)

    def spaced(self, piece: str) -> bytes:
        """A piece with the space before it. A newline between two visible characters is a pre-token of its own."""
        if self.plain(piece):
            return self.encode(" " + piece)
        word = piece.rstrip(SIGNS)
        if len(word) < len(piece) and self.plain(word):
            return self.pieces[word] + self.parts[piece[len(word) :]]
        if piece.count("\n") == 1 and len(two := piece.split()) == 2 and len(two[0]) + len(two[1]) + 1 == len(piece):
            return self.pieces[two[0]] + self.parts["\n"] + self.heads[two[1]]
        return self.any(" " + piece)

    def text(self, text: str) -> bytes:
        """What stands between two marks is encoded as a text of its own."""
        if self.marked is None or self.marked.search(text) is None:
            return self.unmarked(text)
        out, at = [], 0
        for m in self.marked.finditer(text):
            out += (self.unmarked(text[at : m.start()]), self.marks[m[0]])
            at = m.end()
        return b"".join((*out, self.unmarked(text[at:])))

    def unmarked(self, text: str) -> bytes:
        if not self.spaces:
            text = text.replace("\n", " ")
            return b"".join(map(self.pieces.__getitem__, (self.fold(text) if self.fold else text).split(" ")))
        cut = _VISIBLE(text) if _BETWEEN(text) else text.split(" ")
        return self.any(cut[0]) + b"".join(map(self.pieces.__getitem__, islice(cut, 1, None)))

    def texts(self, texts: list[str]) -> list[bytes]:
        return [self.text(t) for t in texts]


def in_groups(texts: list[str], chars: int = 4_000_000) -> list[tuple[int, int]]:
    """Bounds of runs of texts with about so many characters, to bound what is held at a time."""
    out, at, n = [], 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= chars:
            out.append((at, i + 1))
            at, n = i + 1, 0
    if at < len(texts):
        out.append((at, len(texts)))
    return out
