"""Stems of English words by the suffix rules that M. F. Porter published in 1980, as overlap scores use them.

A word is taken as [C](VC)^m[V], C and V being runs of consonants and vowels, a y being a vowel behind a consonant.  The
rules are stated as text; ``published`` leaves out the later departures from them (short words in -ies and -ied, words of
their own, -fulli, -logi, -alli followed by another suffix), which common implementations make and published scores have.
"""

from __future__ import annotations

import functools
import re

# The rules' suffixes with what replaces them, in the order of the five steps.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
LATER_2 = {**{k: v for k, v in STEP_2.items() if k != "abli"}, "bli": "ble", "fulli": "ful"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
# Words of their own.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: Patterns of stems: m > 0, m = 1, m > 1, with a vowel, with a double consonant at the end, and the short consonant-vowel-consonant.
SOME = f"^(?:{_C})?{_V}{_C}"
ONE = f"^(?:{_C})?{_V}{_C}(?:{_V})?$"
MORE = f"^(?:{_C})?{_V}{_C}{_V}{_C}"
VOWEL = f"^(?:{_C})?[aeiouy]"
SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"
#: A vowel and a consonant alone count as short too, in the later form.
SHORT_LATER = f"{SHORT}|^[aeiou][^aeiou]$"

_some, _one, _more, _vowel = (re.compile(p).search for p in (SOME, ONE, MORE, VOWEL))


def _suffix(rules) -> re.Pattern:
    return re.compile(f"^(.*?)({'|'.join(rules)})$")


_STEP_2, _LATER_2, _STEP_3, _STEP_4 = _suffix(STEP_2), _suffix(LATER_2), _suffix(STEP_3), _suffix(STEP_4)


def _plural(word: str, later: bool) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith("ies"):
        return word[:-1] if later and len(word) == 4 else word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str, short, later: bool) -> str:
    if later and word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _some(word[:-3]) else word
    found = re.match("^(.*)(ed|ing)$", word)
    if not found or not _vowel(found[1]):
        return word
    stem = found[1]
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if re.search(r"([^aeiouylsz])\1$", stem):
        return stem[:-1]
    return stem + "e" if _one(stem) and short(stem) else stem


def _final_y(word: str, later: bool) -> bool:
    """Whether a y at the end becomes an i: behind a stem with a vowel; in the later form behind a consonant that isn't the first letter."""
    if not word.endswith("y"):
        return False
    return bool(len(word) > 2 and re.search("[^aeiouy]y$|[aeiou]yy$", word) if later else _vowel(word[:-1]))


def _second(word: str, later: bool) -> str:
    found = (_LATER_2 if later else _STEP_2).match(word)
    if found:
        if not _some(found[1]):
            return word
        made = found[1] + (LATER_2 if later else STEP_2)[found[2]]
        return _second(made, later) if later and found[2] == "alli" else made
    return word[:-1] if later and word.endswith("logi") and _some(word[:-3]) else word


def _fourth(word: str) -> str:
    found = _STEP_4.match(word)
    if not found or not _more(found[1]) or (found[2] == "ion" and not found[1].endswith(("s", "t"))):
        return word
    return found[1]


@functools.lru_cache(1 << 17)
def stem(word: str, published: bool = False) -> str:
    """The stem of a lower-case word; words of one and two letters are their own."""
    later = not published
    if len(word) <= 2:
        return word
    if later and word in IRREGULAR:
        return IRREGULAR[word]
    short = re.compile(SHORT_LATER if later else SHORT).search
    word = _past(_plural(word, later), short, later)
    if _final_y(word, later):
        word = word[:-1] + "i"
    word = _second(word, later)
    if (found := _STEP_3.match(word)) and _some(found[1]):
        word = found[1] + STEP_3[found[2]]
    word = _fourth(word)
    if word.endswith("e") and (_more(word[:-1]) or _one(word[:-1]) and not short(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _more(word[:-1]) else word
