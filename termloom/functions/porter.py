"""The Porter stemmer of 1980, with ``bli -> ble`` and ``logi -> log`` and words of up to two
letters left alone. Rules are data; a word is described by its consonant/vowel pattern."""

from __future__ import annotations

import re
from functools import lru_cache

# The suffix rules of the published algorithm, by step.
_STEP_2 = """ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize
ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"""
_STEP_3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _rules(text: str) -> list[tuple[str, str]]:
    pairs = [tuple(x.split(":")) for x in text.split()]
    return sorted(pairs, key=lambda p: -len(p[0]))


_RULES_2, _RULES_3 = _rules(_STEP_2), _rules(_STEP_3)
_ENDS_4 = sorted(_STEP_4.split(), key=len, reverse=True)
_MEASURE = re.compile(r"v+c+")


def _pattern(word: str) -> str:
    """c and v for each letter: y is a vowel unless first or after a vowel."""
    out = []
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or ch == "y" and i > 0 and out[i - 1] == "c"
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(_MEASURE.findall(_pattern(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _pattern(stem)


def _double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _pattern(word)[-1] == "c"


def _short_end(word: str) -> bool:
    return _pattern(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _plurals(w: str) -> str:
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            return w[: len(w) - len(end)] + new
    return w


def _past(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for end in ("ed", "ing"):
        if w.endswith(end):
            stem = w[: -len(end)]
            if not _has_vowel(stem):
                return w
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _double_end(stem):
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem
    return w


def _mapped(w: str, rules: list[tuple[str, str]]) -> str:
    for end, new in rules:
        if w.endswith(end):
            stem = w[: len(w) - len(end)]
            return stem + new if _measure(stem) > 0 else w
    return w


def _dropped(w: str) -> str:
    for end in _ENDS_4:
        if w.endswith(end):
            stem = w[: len(w) - len(end)]
            if end == "ion" and not stem.endswith(("s", "t")):
                return w
            return stem if _measure(stem) > 1 else w
    return w


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    w = _past(_plurals(word))
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _dropped(_mapped(_mapped(w, _RULES_2), _RULES_3))
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short_end(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
