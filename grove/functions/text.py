"""Text for search: embedding texts, key terms, query patterns, the tokenizer and the Porter stemmer."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from grove.functions.names import second_last_part, split_camel, split_snake

#: Sections of an embedding text that hold no key terms, and limits of key terms and query words.
STRUCTURAL = ("importance", "path", "called-by", "calls", "in")
MAX_SECTIONS, MAX_TERMS, MIN_LETTERS = 4, 8, 3


def embedding_text(kind: Column, name: Column, signature: Column, docstring: Column, parent: Column, file_path: Column, callers: Column, callees: Column, importance: Column) -> Column:
    """Sections joined by " | ". parent is the parent's name; callers and callees are arrays of names."""
    given = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    changed = lambda new, old: F.when(new != old, new)
    path = F.filter(F.split(file_path, "/"), lambda s: (s != "src") & ~F.contains(s, F.lit(".")))
    some = lambda label, names: F.when(F.size(names) > 0, F.concat(F.lit(label + " "), F.array_join(names, " ")))
    return F.concat_ws(
        " | ", F.concat_ws(" ", kind, name), changed(split_camel(name), name), changed(split_snake(name), name), given(signature), given(docstring),
        F.concat(F.lit("in "), given(parent)), F.concat(F.lit("in "), changed(split_camel(given(parent)), parent)),
        some("path", path), some("called-by", callers), some("calls", callees), F.concat(F.lit(""), F.when(importance > 0.7, "importance high core").when(importance > 0.3, "importance medium")),
    )


def strict_parent(parent_id: Column) -> Column:
    """The part of a parent's id that older three-part ids held the name in; on four-part ids this is the kind."""
    return second_last_part(parent_id)


def words_of(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def key_terms(text: Column) -> Column:
    """Up to eight distinct lower-case words of the first four sections that aren't structural."""
    sections = F.filter(F.slice(F.split(text, r" \| "), 1, MAX_SECTIONS), lambda s: ~s.rlike(f"^(?:{'|'.join(STRUCTURAL)}) "))
    found = F.flatten(F.transform(sections, lambda s: F.transform(words_of(s), F.lower)))
    return F.slice(F.array_distinct(F.filter(found, lambda w: F.octet_length(w) >= MIN_LETTERS)), 1, MAX_TERMS)


def query_terms(c: Column) -> Column:
    """Prefix patterns, without their "*", of a search text: each word, its camel-case parts, then its snake-case parts."""
    clean = F.filter(F.transform(words_of(c), lambda w: F.regexp_replace(w, r"[^\p{L}\p{Nd}_]", "")), lambda w: w != "")

    def parts(w: Column) -> Column:
        long = lambda x: F.octet_length(x) >= MIN_LETTERS
        camel = F.filter(F.transform(words_of(split_camel(w)), F.lower), lambda x: (x != F.lower(w)) & long(x))
        snake = F.when(F.contains(w, F.lit("_")), F.filter(F.transform(words_of(split_snake(w)), F.lower), long)).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(w), camel, snake)

    return F.array_distinct(F.flatten(F.transform(clean, parts)))


def query_patterns(query: str) -> list[str]:
    """query_terms of one text, on the driver. Words like AND and OR are words here."""
    out: dict[str, None] = {}
    camel = re.compile(r"(?<=[^\W\d_])(?=[^\W\d_])")
    for word in query.split():
        clean = "".join(ch for ch in word if ch.isalpha() or ch.isdecimal() or ch == "_")
        if not clean:
            continue
        out[clean] = None
        cuts = [m.start() for m in camel.finditer(clean) if (clean[m.start()].isupper() and (clean[m.start() - 1].islower() or (clean[m.start() - 1].isupper() and clean[m.start() + 1 : m.start() + 2].islower())))]
        pieces = [clean[a:b] for a, b in zip([0, *cuts], [*cuts, len(clean)], strict=True)]
        for p in " ".join(pieces).split():
            if p.lower() != clean.lower() and len(p.lower().encode()) >= MIN_LETTERS:
                out[p.lower()] = None
        if "_" in clean:
            for p in clean.replace("_", " ").split():
                if len(p.lower().encode()) >= MIN_LETTERS:
                    out[p.lower()] = None
    return list(out)


_MARKED = {ch: unicodedata.normalize("NFD", ch)[0] for ch in map(chr, range(0xC0, 0x250)) if unicodedata.normalize("NFD", ch)[0] != ch}


def tokens(c: Column, unaccent: bool = False) -> Column:
    """Lower-case runs of letters and digits; "_" separates. unaccent takes marks off Latin letters."""
    low = F.lower(F.coalesce(c, F.lit("")))
    if unaccent:
        low = F.translate(low, "".join(_MARKED), "".join(_MARKED.values()))
    return F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def pattern_tokens(pattern: str, unaccent: bool = False) -> list[str]:
    low = pattern.lower()
    if unaccent:
        low = low.translate({ord(k): v for k, v in _MARKED.items()})
    return re.findall(r"[^\W_]+", low)


# The stemmer follows M. F. Porter, "An algorithm for suffix stripping", 1980. Its suffix lists are fixed values.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """v for vowels and c for consonants; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def porter(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: len(word) - len(end)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in _shape(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif word[-1:] == word[-2:-1] and _shape(word)[-2:] == "cc" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP2, _STEP3):
        end = max((e for e in table if word.endswith(e)), key=len, default=None)
        if end and _measure(word[: -len(end)]) > 0:
            word = word[: -len(end)] + table[end]
    end = max((e for e in _STEP4 if word.endswith(e)), key=len, default=None)
    if end and _measure(stem := word[: -len(end)]) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
        word = stem
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short_end(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(StringType())
def stem(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """porter of each term; the index stems distinct terms only."""
    for s in batches:
        yield s.map(porter)
