"""Porter's suffix stripping (Program 14(3), 1980), from the published description."""

from __future__ import annotations

import re
from functools import lru_cache

_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c for each consonant, v for each vowel; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _closed(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return len(word) > 2 and _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _replaced(word: str, table: dict[str, str]) -> str:
    for ending in sorted(table, key=len, reverse=True):
        if word.endswith(ending):
            base = word[: -len(ending)]
            return base + table[ending] if _measure(base) > 0 else word
    return word


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for ending in ("ed", "ing"):
            base = word.removesuffix(ending)
            if base != word:
                if "v" in _shape(base):
                    if base.endswith(("at", "bl", "iz")):
                        base += "e"
                    elif len(base) > 1 and base[-1] == base[-2] and _shape(base)[-1] == "c" and base[-1] not in "lsz":
                        base = base[:-1]
                    elif _measure(base) == 1 and _closed(base):
                        base += "e"
                    word = base
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, _STEP2), _STEP3)
    for ending in sorted(_STEP4, key=len, reverse=True):
        if word.endswith(ending):
            base = word[: -len(ending)]
            if _measure(base) > 1 and (ending != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _closed(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
