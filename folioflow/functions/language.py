"""A coarse language guess from function words, for choosing a stemmer.

The share of a language among the function words found is its confidence; below FLOOR, with fewer than LEAST words, or
without Latin letters there is no guess, and an index then keeps raw words only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR, SAMPLE, LEAST = 0.40, 2000, 2

FUNCTION_WORDS = {
    "de": "der die das und ist nicht von mit für auf ein eine den dem des zu sich auch es als".split(),
    "en": "the and of to in is that it for was on are as with his they at be this have".split(),
    "es": "el la los las de que y en un una por con para del se no su al lo como".split(),
    "fr": "le la les de des et est un une en que qui dans pour pas sur par au du il".split(),
}


def _hits(words: Column, language: str) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(FUNCTION_WORDS[language])))


def detect(text: Column, words: Column | None = None) -> Column:
    """The language of the first SAMPLE characters, or null.  Ties go to the first code in order."""
    sample = F.substr(text, F.lit(1), F.lit(SAMPLE))
    found = F.regexp_extract_all(F.lower(sample), F.lit(r"(\p{L}+)"), 1) if words is None else words
    counts = {k: _hits(found, k) for k in sorted(FUNCTION_WORDS)}
    total = sum(counts.values(), F.lit(0))
    best = F.greatest(*counts.values())
    guess = F.lit(None).cast("string")
    for k in reversed(sorted(FUNCTION_WORDS)):
        guess = F.when(counts[k] == best, k).otherwise(guess)
    return F.when(sample.rlike(r"\p{IsLatin}") & (best >= LEAST) & (best >= FLOOR * total), guess)
