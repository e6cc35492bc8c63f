"""The Porter stemmer (1980)."""

from __future__ import annotations

import re

_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _measure(word: str) -> int:
    return len(re.findall("VC", re.sub("C+", "C", re.sub("V+", "V", "".join("V" if c in "aeiou" or c == "y" and i and word[i - 1] not in "aeiou" else "C" for i, c in enumerate(word))))))


def _vowel(word: str) -> bool:
    return any(c in "aeiou" or c == "y" and i for i, c in enumerate(word))


def _cvc(word: str) -> bool:
    kinds = ["V" if c in "aeiou" or c == "y" and i and word[i - 1] not in "aeiou" else "C" for i, c in enumerate(word)]
    return kinds[-3:] == ["C", "V", "C"] and word[-1] not in "wxy"


def _longest(word: str, table) -> str | None:
    return max((s for s in table if word.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    """The stem of a lower-case English word; words of up to two letters stay."""
    if len(word) < 3:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = None
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    elif word.endswith("ed") and _vowel(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and _vowel(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        word = cut
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and word[-1] not in "aeioulsz":
            word = word[:-1]
        elif _measure(word) == 1 and _cvc(word):
            word += "e"
    if word.endswith("y") and _vowel(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP2, _STEP3):
        s = _longest(word, table)
        if s and _measure(word[: -len(s)]):
            word = word[: -len(s)] + table[s]
    s = _longest(word, _STEP4)
    if s and _measure(word[: -len(s)]) > 1 and (s != "ion" or word[: -len(s)].endswith(("s", "t"))):
        word = word[: -len(s)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _cvc(word[:-1])):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
