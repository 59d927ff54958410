"""Stemmers for German, French and Spanish after their published Snowball definitions, for distinct lower-case words.

Each works on regions of a word: R1 is what follows the first consonant after a vowel, R2 the same within R1, and RV (in the
Romance languages) what follows the first syllable, by a rule of the language.  An ending goes only if it lies in the region
that its rule names.  Letters that count as consonants for once are held in upper case meanwhile.
"""

from __future__ import annotations

import re

# The endings of the published definitions.
_DE_VOWELS = "aeiouyäöü"
_DE_S, _DE_ST = "bdfghklmnrt", "bdfghklmnt"

_FR_VOWELS = "aeiouyâàëéêèïîôûù"
_FR_PLAIN = ("ance", "iqUe", "isme", "able", "iste", "eux", "ances", "iqUes", "ismes", "ables", "istes")
_FR_ATION = ("atrice", "ateur", "ation", "atrices", "ateurs", "ations")
_FR_I_VERBS = "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split()
_FR_E_VERBS = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
_FR_A_VERBS = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()

_ES_VOWELS = "aeiouáéíóúü"
_ES_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
_ES_PLAIN = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
_ES_ADOR = "adora ador ación adoras adores aciones ante antes ancia ancias".split()
_ES_Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
_ES_E_VERBS = "en es éis emos".split()
_ES_VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais "
    "arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()
_ES_ACUTE = str.maketrans("áéíóú", "aeiou")


_SYLLABLE = {v: re.compile(f"[{v}][^{v}]") for v in (_DE_VOWELS, _FR_VOWELS, _ES_VOWELS)}


def _after_syllable(word: str, vowels: str, start: int = 0) -> int:
    m = _SYLLABLE[vowels].search(word, start)
    return m.end() if m else len(word)


class Endings:
    """Endings, to be looked up by length."""

    def __init__(self, words):
        self.words, self.most = frozenset(words), max(map(len, words))

    def longest(self, word: str, start: int = 0) -> str | None:
        """The longest of them that the word has from ``start`` on."""
        for n in range(min(self.most, len(word) - start), 0, -1):
            if word[-n:] in self.words:
                return word[-n:]
        return None


def _longest(word: str, endings, start: int = 0) -> str | None:
    return next((e for e in sorted(endings, key=len, reverse=True) if word.endswith(e) and len(word) - len(e) >= start), None)


_DE_1, _DE_2 = Endings(("em", "ern", "er", "e", "en", "es", "s")), Endings(("en", "er", "est", "st"))
_DE_3 = Endings(("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
_FR_SUFFIXES = Endings(
    (
        *_FR_PLAIN, *_FR_ATION, "logie", "logies", "usion", "ution", "usions", "utions", "ence", "ences", "ement", "ements", "ité", "ités", "if", "ive", "ifs", "ives",
        "eaux", "aux", "euse", "euses", "issement", "issements", "amment", "emment", "ment", "ments",
    )
)
_FR_I, _FR_OTHER = Endings(_FR_I_VERBS), Endings(("ions", *_FR_E_VERBS, *_FR_A_VERBS))
_ES_SUFFIXES = Endings((*_ES_PLAIN, *_ES_ADOR, "logía", "logías", "ución", "uciones", "encia", "encias", "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"))
_ES_PRONOUN, _ES_Y, _ES_OTHER = Endings(_ES_PRONOUNS), Endings(_ES_Y_VERBS), Endings((*_ES_E_VERBS, *_ES_VERBS))


def stem_german(word: str) -> str:
    v = _DE_VOWELS
    word = word.replace("ß", "ss")
    word = re.sub(f"(?<=[{v}])[uy](?=[{v}])", lambda m: m[0].upper(), word)
    r1 = _after_syllable(word, v)
    r2 = _after_syllable(word, v, r1)
    r1 = max(r1, 3)

    end = _DE_1.longest(word)
    if end and len(word) - len(end) >= r1 and (end != "s" or word[-2:-1] in tuple(_DE_S)):
        word = word[: -len(end)]
        if end in ("e", "en", "es") and word.endswith("niss"):
            word = word[:-1]

    end = _DE_2.longest(word)
    if end and len(word) - len(end) >= r1 and (end != "st" or len(word) >= 6 and word[-3] in _DE_ST):
        word = word[: -len(end)]

    end = _DE_3.longest(word)
    if end and len(word) - len(end) >= r2:
        rest = word[: -len(end)]
        if end in ("ig", "ik", "isch"):
            word = word if rest.endswith("e") else rest
        else:
            word = rest
            if end in ("end", "ung") and word.endswith("ig") and len(word) - 2 >= r2 and word[-3:-2] != "e":
                word = word[:-2]
            elif end in ("lich", "heit") and word.endswith(("er", "en")) and len(word) - 2 >= r1:
                word = word[:-2]
            elif end == "keit":
                more = _longest(word, ("lich", "ig"), r2)
                word = word[: -len(more)] if more else word
    return word.lower().translate(str.maketrans("äöü", "aou"))


def _french_rv(word: str) -> int:
    if word.startswith(("par", "col", "tap")):
        return 3
    if len(word) > 2 and word[0] in _FR_VOWELS and word[1] in _FR_VOWELS:
        return 3
    return next((i + 1 for i in range(1, len(word)) if word[i] in _FR_VOWELS), len(word))


def _french_suffix(word: str, rv: int, r1: int, r2: int) -> tuple[str, bool]:
    """The word without its standard suffix, and whether verb endings are to be tried still."""
    v = _FR_VOWELS
    end = _FR_SUFFIXES.longest(word)
    if not end:
        return word, True
    at = len(word) - len(end)
    rest = word[:at]

    def without(stem: str, tail: str, region: int, other: str | None = None) -> str:
        """``stem`` without ``tail`` if that lies in the region, otherwise with ``other`` in its place."""
        if not stem.endswith(tail):
            return stem
        if len(stem) - len(tail) >= region:
            return stem[: -len(tail)]
        return stem if other is None else stem[: -len(tail)] + other

    if end in _FR_PLAIN:
        return (rest, False) if at >= r2 else (word, True)
    if end in _FR_ATION:
        return (without(rest, "ic", r2, "iqU"), False) if at >= r2 else (word, True)
    if end in ("logie", "logies"):
        return (rest + "log", False) if at >= r2 else (word, True)
    if end in ("usion", "ution", "usions", "utions"):
        return (rest + "u", False) if at >= r2 else (word, True)
    if end in ("ence", "ences"):
        return (rest + "ent", False) if at >= r2 else (word, True)
    if end in ("ement", "ements"):
        if at < rv:
            return word, True
        if rest.endswith("iv") and at - 2 >= r2:
            return without(rest[:-2], "at", r2), False
        if rest.endswith("eus"):
            return (rest[:-3] if at - 3 >= r2 else rest[:-3] + "eux" if at - 3 >= r1 else rest), False
        if rest.endswith(("abl", "iqU")):
            return (rest[:-3] if at - 3 >= r2 else rest), False
        if rest.endswith(("ièr", "Ièr")) and at - 3 >= rv:
            return rest[:-3] + "i", False
        return rest, False
    if end in ("ité", "ités"):
        if at < r2:
            return word, True
        if rest.endswith("abil"):
            return without(rest, "abil", r2, "abl"), False
        if rest.endswith("ic"):
            return without(rest, "ic", r2, "iqU"), False
        return without(rest, "iv", r2), False
    if end in ("if", "ive", "ifs", "ives"):
        if at < r2:
            return word, True
        if rest.endswith("at") and at - 2 >= r2:
            return without(rest[:-2], "ic", r2, "iqU"), False
        return rest, False
    if end == "eaux":
        return rest + "eau", False
    if end == "aux":
        return (rest + "al", False) if at >= r1 else (word, True)
    if end in ("euse", "euses"):
        return (rest, False) if at >= r2 else (rest + "eux", False) if at >= r1 else (word, True)
    if end in ("issement", "issements"):
        return (rest, False) if at >= r1 and rest[-1:] and rest[-1] not in v else (word, True)
    if end in ("amment", "emment"):
        return (rest + ("ant" if end[0] == "a" else "ent"), True) if at >= rv else (word, True)
    return (rest, True) if at - 1 >= rv and rest[-1] in v else (word, True)  # ment, ments


def stem_french(word: str) -> str:
    v = _FR_VOWELS
    word = re.sub(f"(?<=[{v}])[ui](?=[{v}])|(?<=[{v}])y|y(?=[{v}])|(?<=q)u", lambda m: m[0].upper(), word)
    rv, r1 = _french_rv(word), _after_syllable(word, v)
    r2 = _after_syllable(word, v, r1)
    begun = word
    word, verbs = _french_suffix(word, rv, r1, r2)
    if verbs:
        before = word
        end = _FR_I.longest(word, rv)
        at = len(word) - len(end or "")
        if end and at - 1 >= rv and word[at - 1] not in v:
            word = word[:at]
        else:
            end = _FR_OTHER.longest(word, rv)
            at = len(word) - len(end or "")
            if end in _FR_E_VERBS or end == "ions" and at >= r2:
                word = word[:at]
            elif end in _FR_A_VERBS:
                word = word[:at]
                if word.endswith("e") and at - 1 >= rv:
                    word = word[:-1]
        verbs = word == before
    if word != begun:
        if word.endswith("Y"):
            word = word[:-1] + "i"
        elif word.endswith("ç"):
            word = word[:-1] + "c"
    elif verbs:
        if word.endswith("s") and word[-2:-1] not in tuple("aiouès") and len(word) > 1:
            word = word[:-1]
        end = _longest(word, ("ion", "ier", "ière", "Ier", "Ière", "e", "ë"), rv)
        at = len(word) - len(end or "")
        if end == "ion":
            word = word[:at] if at >= r2 and at - 1 >= rv and word[at - 1] in "st" else word
        elif end in ("ier", "ière", "Ier", "Ière"):
            word = word[:at] + "i"
        elif end == "e" or end == "ë" and word[:at].endswith("gu") and at - 2 >= rv:
            word = word[:at]
    if word.endswith(("enn", "onn", "ett", "ell", "eill")):
        word = word[:-1]
    word = re.sub(f"[éè](?=[^{v}]+$)", "e", word)
    return word.lower()


def _spanish_rv(word: str) -> int:
    v = _ES_VOWELS
    if len(word) < 3:
        return len(word)
    if word[1] not in v:
        return next((i + 1 for i in range(2, len(word)) if word[i] in v), len(word))
    if word[0] in v:
        return next((i + 1 for i in range(2, len(word)) if word[i] not in v), len(word))
    return 3


def _spanish_suffix(word: str, r1: int, r2: int) -> str:
    end = _ES_SUFFIXES.longest(word)
    if not end:
        return word
    at = len(word) - len(end)
    rest = word[:at]
    if at < (r1 if end == "amente" else r2):
        return word

    def without(stem: str, *tails: str) -> str:
        tail = _longest(stem, tails)
        return stem[: -len(tail)] if tail and len(stem) - len(tail) >= r2 else stem

    if end in _ES_PLAIN:
        return rest
    if end in _ES_ADOR:
        return without(rest, "ic")
    if end.startswith("log"):
        return rest + "log"
    if end.startswith("uci"):
        return rest + "u"
    if end.startswith("enc"):
        return rest + "ente"
    if end == "amente":
        if rest.endswith("iv") and at - 2 >= r2:
            return without(rest[:-2], "at")
        return without(rest, "os", "ic", "ad")
    if end == "mente":
        return without(rest, "ante", "able", "ible")
    if end.startswith("idad"):
        return without(rest, "abil", "ic", "iv")
    return without(rest, "at")


def stem_spanish(word: str) -> str:
    v = _ES_VOWELS
    rv, r1 = _spanish_rv(word), _after_syllable(word, v)
    r2 = _after_syllable(word, v, r1)
    pronoun = _ES_PRONOUN.longest(word, rv)
    if pronoun:
        rest = word[: -len(pronoun)]
        if _longest(rest, ("iéndo", "ándo", "ár", "ér", "ír"), rv):
            word = re.sub("[áéí](?=[^áéí]*$)", lambda m: m[0].translate(_ES_ACUTE), rest)
        elif _longest(rest, ("ando", "iendo", "ar", "er", "ir"), rv) or _longest(rest, ("yendo",), rv) and rest.endswith("uyendo"):
            word = rest
    begun = word
    word = _spanish_suffix(word, r1, r2)
    if word == begun:
        end = _ES_Y.longest(word, rv)
        if end and word[: -len(end)].endswith("u"):
            word = word[: -len(end)]
        else:
            end = _ES_OTHER.longest(word, rv)
            if end:
                word = word[: -len(end)]
                if end in _ES_E_VERBS and word.endswith("gu"):
                    word = word[:-1]
    end = _longest(word, ("os", "a", "o", "á", "í", "ó", "e", "é"), rv)
    if end:
        word = word[: -len(end)]
        if end in ("e", "é") and word.endswith("gu") and len(word) - 1 >= rv:
            word = word[:-1]
    return word.translate(_ES_ACUTE)
