"""English suffix stripping after Porter, "An algorithm for suffix stripping" (1980)."""

from __future__ import annotations

import re
from functools import lru_cache

# Rule tables of the paper: (suffix, replacement), tried in this order.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
)
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def _shape(word: str) -> str:
    """The word as c (consonant) and v (vowel) letters."""
    out = ""
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and out.endswith("c"))
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _double_consonant(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _ends_cvc(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _replace_longest(word: str, rules) -> str:
    suffix = _longest(word, [s for s, _ in rules])
    if suffix and _measure(word[: -len(suffix)]) > 0:
        return word[: -len(suffix)] + dict(rules)[suffix]
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if len(word) <= 2 or not re.fullmatch("[a-z]+", word):
        return word
    # 1a: plurals
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # 1b: -eed, -ed, -ing
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        suffix = _longest(word, ("ed", "ing"))
        if suffix and "v" in _shape(word[: -len(suffix)]):
            word = word[: -len(suffix)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double_consonant(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _ends_cvc(word):
                word += "e"
    # 1c: final y
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace_longest(word, STEP_2)
    word = _replace_longest(word, STEP_3)
    # 4: drop a suffix after a long stem
    suffix = _longest(word, STEP_4)
    if suffix:
        base = word[: -len(suffix)]
        if _measure(base) > 1 and (suffix != "ion" or base[-1:] in ("s", "t")):
            word = base
    # 5: final e, double l
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _ends_cvc(base)):
            word = base
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
