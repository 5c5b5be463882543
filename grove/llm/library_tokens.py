"""The tokenizers library behind memos of pieces and pre-tokens; one of each in a Python worker.

The library's normalizer and model make the ids. Its pre-tokenizer's pattern is applied here, so that each distinct pre-token
goes through the library once; tests hold the ids against the library's own encoding of whole texts.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache
from unicodedata import is_normalized

from grove.llm.words import WordMemo

#: The pattern of a byte-level pre-tokenizer that names none (a fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return {b: chr(b if b in plain else next(other)) for b in range(256)}


@lru_cache(maxsize=4)
def encoder(path: str, spaces: bool, limit: int = 350_000) -> WordMemo:
    """For a vocabulary with a byte-level pre-tokenizer, alone or after one that splits by a pattern and drops the rest.

    Strings of added tokens in a text are found first and have one id each, as in the library's own encoding.
    """
    import regex
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    model, normalizer, letters = t.model, t.normalizer, byte_letters()
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    pre = file["pre_tokenizer"]
    if any(x[k] for x in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: added tokens that aren't found just as they stand")
    marks = {x["content"]: array("I", [x["id"]]).tobytes() for x in file["added_tokens"]}
    steps = pre.get("pretokenizers", [pre])
    find = regex.compile(next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), BYTE_LEVEL)).findall

    def encode(token: str) -> bytes:
        shown = token if token.isascii() and token.isalpha() else token.encode("utf-8", "surrogatepass").decode("latin-1").translate(letters)
        return array("I", [x.id for x in model.tokenize(shown)]).tobytes()

    if normalizer is None:
        return WordMemo(find, encode, spaces, limit=limit, marks=marks)
    return WordMemo(lambda piece: find(normalizer.normalize_str(piece)), lambda token: encode(token.lower()), spaces, plain_word, folded, limit=limit, marks=marks)


def folded(text: str) -> str:
    """The text in lower case, where that is what the normalizer makes of each letter."""
    return text.lower() if text.isascii() or ("Σ" not in text and "İ" not in text and is_normalized("NFC", text)) else text


def plain_word(piece: str) -> bool:
    """Whether lower-casing is all that the normalizer (NFC, then letter by letter lower case) does to a word of letters."""
    if not piece.isalpha():
        return False
    return piece.isascii() or ("Σ" not in piece and is_normalized("NFC", piece) and piece.lower().isalpha())


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
