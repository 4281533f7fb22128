"""Forms of English verbs: regular by rules of spelling, others from a table that is a parameter.

A lexicon maps a lemma to another one, as an antonym dictionary does; ``inflected`` makes of it a table from every form
to the same form of the other, so that texts are changed by look-ups alone.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

FORMS = ("base", "third", "past", "participle", "ing")
#: Past and participle of common verbs that have forms of their own; any other table is a parameter.
IRREGULAR = {
    "be": ("was", "been"), "become": ("became", "become"), "begin": ("began", "begun"), "break": ("broke", "broken"), "bring": ("brought", "brought"), "build": ("built", "built"),
    "buy": ("bought", "bought"), "catch": ("caught", "caught"), "choose": ("chose", "chosen"), "come": ("came", "come"), "cut": ("cut", "cut"), "do": ("did", "done"), "draw": ("drew", "drawn"),
    "drive": ("drove", "driven"), "eat": ("ate", "eaten"), "fall": ("fell", "fallen"), "feel": ("felt", "felt"), "find": ("found", "found"), "fly": ("flew", "flown"), "forget": ("forgot", "forgotten"),
    "get": ("got", "got"), "give": ("gave", "given"), "go": ("went", "gone"), "grow": ("grew", "grown"), "have": ("had", "had"), "hear": ("heard", "heard"), "hold": ("held", "held"),
    "keep": ("kept", "kept"), "know": ("knew", "known"), "lead": ("led", "led"), "leave": ("left", "left"), "lose": ("lost", "lost"), "make": ("made", "made"), "mean": ("meant", "meant"),
    "meet": ("met", "met"), "pay": ("paid", "paid"), "put": ("put", "put"), "read": ("read", "read"), "rise": ("rose", "risen"), "run": ("ran", "run"), "say": ("said", "said"), "see": ("saw", "seen"),
    "sell": ("sold", "sold"), "send": ("sent", "sent"), "set": ("set", "set"), "show": ("showed", "shown"), "shut": ("shut", "shut"), "sing": ("sang", "sung"), "sink": ("sank", "sunk"),
    "speak": ("spoke", "spoken"), "spend": ("spent", "spent"), "stand": ("stood", "stood"), "take": ("took", "taken"), "teach": ("taught", "taught"), "tell": ("told", "told"),
    "think": ("thought", "thought"), "throw": ("threw", "thrown"), "understand": ("understood", "understood"), "win": ("won", "won"), "write": ("wrote", "written"),
}
#: Verbs of several syllables that double their last consonant; any other set is a parameter.
DOUBLED = frozenset("admit begin commit compel control equip expel forget occur omit permit prefer propel rebel refer regret submit transfer".split())
_SHORT = re.compile("^[^aeiou]*[aeiouy][^aeiouwxy]$")


def _stem(lemma: str, doubled: frozenset[str]) -> str:
    """What -ed and -ing are put to where nothing is dropped."""
    return lemma + lemma[-1] if lemma in doubled or _SHORT.match(lemma) and len(lemma) > 2 else lemma


def forms(lemma: str, irregular: Mapping[str, tuple[str, str]] = IRREGULAR, doubled: frozenset[str] = DOUBLED) -> dict[str, str]:
    """The forms of a verb; of a verb with words behind it, those of its first word with these behind them."""
    verb, _, rest = lemma.partition(" ")
    if rest:
        return {k: f"{v} {rest}" for k, v in forms(verb, irregular, doubled).items()}
    ends_y = re.search("[^aeiou]y$", verb)
    third = "has" if verb == "have" else "is" if verb == "be" else verb[:-1] + "ies" if ends_y else verb + "es" if re.search("(s|x|z|ch|sh|o)$", verb) else verb + "s"
    past = verb[:-1] + "ied" if ends_y else verb + "d" if verb.endswith("e") else _stem(verb, doubled) + "ed"
    ing = verb[:-2] + "ying" if verb.endswith("ie") else verb[:-1] + "ing" if re.search("[^eoy]e$", verb) and len(verb) > 2 else _stem(verb, doubled) + "ing"
    own = irregular.get(verb, (past, past))
    return {"base": verb, "third": third, "past": own[0], "participle": own[1], "ing": ing}


def inflected(lexicon: Mapping[str, str], irregular: Mapping[str, tuple[str, str]] = IRREGULAR, doubled: frozenset[str] = DOUBLED) -> dict[str, str]:
    """Each form of each lemma of the lexicon to the same form of what it maps to.  Of words that are several forms, the first counts, earlier lemmas first."""
    out: dict[str, str] = {}
    for lemma, other in lexicon.items():
        one, two = forms(lemma, irregular, doubled), forms(other, irregular, doubled)
        for k in FORMS:
            out.setdefault(one[k], two[k])
    return {k: v for k, v in out.items() if k != v}


def participle(word: str, irregular: Mapping[str, tuple[str, str]] = IRREGULAR, doubled: frozenset[str] = DOUBLED) -> str:
    """The participle of a verb in any form: of a known form by the table, of a regular one by the rules for its end."""
    for lemma, (past, own) in irregular.items():
        if word in (past, own, *(forms(lemma, irregular, doubled)[k] for k in ("base", "third", "ing"))):
            return own
    if word.endswith("ed"):
        return word
    if word.endswith("ies"):
        return word[:-3] + "ied"
    if re.search("(s|x|z|ch|sh)es$", word):
        return word[:-2] + "ed"
    if re.search("[^s]s$", word):
        word = word[:-1]
    return forms(word, irregular, doubled)["participle"]
