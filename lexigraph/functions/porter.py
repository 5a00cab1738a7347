"""The Porter stemmer (M. F. Porter, 1980), as full-text indexes apply it: to tokens of 3 to 64 bytes."""

from __future__ import annotations

import functools

_VOWELS = "aeiou"


def _consonant(w: str, i: int) -> bool:
    c = w[i]
    return c not in _VOWELS and (c != "y" or i == 0 or not _consonant(w, i - 1))


def _measure(w: str) -> int:
    shape = [_consonant(w, i) for i in range(len(w))]
    return sum(1 for a, b in zip(shape, shape[1:], strict=False) if not a and b)


def _vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and w[-1] not in _VOWELS


def _short(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 1) and not _consonant(w, n - 2) and _consonant(w, n - 3) and w[-1] not in "wxy"


# The paper's suffix tables of steps 2, 3 and 4.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _replace(w: str, table: dict[str, str]) -> str:
    for n in range(min(7, len(w)), 1, -1):
        if w[-n:] in table:
            return w[:-n] + table[w[-n:]] if _measure(w[:-n]) > 0 else w
    return w


def stem(w: str) -> str:
    size = len(w.encode())
    if size < 3 or size > 64:
        return w
    if (w.endswith("sses") and len(w) > 4) or (w.endswith("ies") and len(w) > 3):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed") and len(w) > 3:
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((n for s, n in (("ed", 2), ("ing", 3)) if w.endswith(s) and _vowel(w[:-n])), 0)
        if cut:
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short(w):
                w += "e"
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(w, _STEP2), _STEP3)
    hit = max((s for s in _STEP4 if w.endswith(s)), key=len, default="")
    if hit and _measure(w[: -len(hit)]) > 1 and (hit != "ion" or w[: -len(hit)].endswith(("s", "t"))):
        w = w[: -len(hit)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


#: `stem`, which remembers words.
known = functools.lru_cache(1 << 17)(stem)
