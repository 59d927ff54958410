"""A stemmer for English after the published Porter2 rules, for distinct words; those of other languages are in ``snowball``.

Languages without rules here keep their words, which is also what an index without a stemmer does.
"""

from __future__ import annotations

import re

from folioflow.functions.snowball import stem_french, stem_german, stem_spanish

VOWELS = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_KEPT = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""))
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
_REGION = re.compile(r"[aeiouy][^aeiouy]")


def _regions(word: str) -> tuple[int, int]:
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    if r1 is None:
        m = _REGION.search(word)
        r1 = m.end() if m else len(word)
    m = _REGION.search(word, r1)
    return r1, m.end() if m else len(word)


def _short_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS + "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


def stem_english(word: str) -> str:
    if len(word) <= 2:
        return word
    word = word.lstrip("'")
    if word in _WHOLE:
        return _WHOLE[word]
    if word in _KEPT:
        return word
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    r1, r2 = _regions(word)
    for tail in ("'s'", "'s", "'"):
        if word.endswith(tail):
            word = word[: -len(tail)]
            break
    # plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{VOWELS}]", word[:-2]):
        word = word[:-1]
    if word in _AFTER_1A:
        return word
    # past tense and participles
    for tail in ("eedly", "eed"):
        if word.endswith(tail):
            if len(word) - len(tail) >= r1:
                word = word[: -len(tail)] + "ee"
            break
    else:
        for tail in ("ingly", "edly", "ing", "ed"):
            if word.endswith(tail):
                if re.search(f"[{VOWELS}]", word[: -len(tail)]):
                    word = word[: -len(tail)]
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif word.endswith(_DOUBLE):
                        word = word[:-1]
                    elif _short_end(word) and r1 >= len(word):
                        word += "e"
                break
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    for tail, new in _STEP2:
        if word.endswith(tail):
            if len(word) - len(tail) >= r1 and (tail != "ogi" or word[-4:-3] == "l") and (tail != "li" or word[-3:-2] in tuple(_LI)):
                word = word[: -len(tail)] + new
            break
    for tail, new in _STEP3:
        if word.endswith(tail):
            at = len(word) - len(tail)
            if at >= r1 and (tail != "ative" or at >= r2):
                word = word[:at] + new
            break
    for tail in _STEP4:
        if word.endswith(tail):
            if len(word) - len(tail) >= r2 and (tail != "ion" or word[-4:-3] in ("s", "t")):
                word = word[: -len(tail)]
            break
    if word.endswith("e"):
        if len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _short_end(word[:-1]):
            word = word[:-1]
    elif word.endswith("l") and len(word) - 1 >= r2 and word.endswith("ll"):
        word = word[:-1]
    return word.lower()


STEMMERS = {"de": stem_german, "en": stem_english, "es": stem_spanish, "fr": stem_french}
