import random

import numpy as np
from pyspark.sql import functions as F

from folioflow.functions import language_model as L

TEXTS = {
    "de": "der schnelle braune fuchs springt über den faulen hund und die katze schläft auf dem warmen ofen während es draußen regnet",
    "en": "the quick brown fox jumps over the lazy dog and the cat sleeps on the warm stove while it is raining outside of the house",
    "fr": "le rapide renard brun saute par dessus le chien paresseux et le chat dort sur le poêle chaud pendant que la pluie tombe dehors",
}


def labelled(spark, n=40):
    r = random.Random(1)
    rows = [(c, " ".join(r.sample(t.split(), len(t.split())))) for c, t in TEXTS.items() for _ in range(n)]
    return spark.createDataFrame(rows + [(None, "the fox"), ("de", None)], "lang string, text string")


def test_guesses_and_what_is_not_guessed(spark):
    model = L.learnt(labelled(spark))
    assert model.languages == ["de", "en", "fr"]
    asked = ["the dog sleeps outside while it rains", "der hund schläft auf dem ofen", "le chien dort pendant la pluie", "xqzvk wjpqx zzkqv qqxwz", "速い茶色の狐", "Быстрая лиса", "", None, "a", "123 456 _", "the dog " * 10_000]
    rows = spark.createDataFrame(list(enumerate(asked)), "i int, t string").select("i", L.guessed(F.col("t"), model).alias("g")).orderBy("i").collect()
    assert [r.g.language for r in rows] == ["en", "de", "fr", None, None, None, None, None, None, None, "en"]
    assert rows[0].g.confidence > rows[3].g.confidence and rows[3].g.confidence < 0.4


def test_same_as_counting_by_hand(spark):
    rows = labelled(spark, 3)
    model = L.learnt(rows)
    counts = {c: {} for c in model.languages}
    for r in rows.where("lang IS NOT NULL AND text IS NOT NULL").collect():
        for word in r.text.split():
            padded = f"  {word} "
            for g in zip(padded, padded[1:], padded[2:]):
                if g[1] != " ":
                    counts[r.lang][g] = counts[r.lang].get(g, 0) + 1
    grams = sorted({g for c in counts.values() for g in c})
    assert [tuple(chr(x >> s & 0x1FFFFF) for s in (42, 21, 0)) for x in model.grams.tolist()] == grams
    for k, c in enumerate(model.languages):
        total = sum(counts[c].values()) + 0.5 * (len(grams) + 1)
        assert np.allclose(model.weights[:-1, k], [np.log((counts[c].get(g, 0) + 0.5) / total) for g in grams])


def test_the_sample_is_bounded_and_a_table_without_labels_teaches_nothing(spark):
    assert L.learnt(labelled(spark).where("lang IS NULL")).guess("the dog sleeps") == (None, None)
    few = L.learnt(labelled(spark), per_language=1)
    assert few.guess("the dog sleeps outside while it rains")[0] == "en"
