"""Language identification by character trigrams, learnt from labelled rows.

A language's model is how often each trigram of letters (words padded by spaces, lower case) comes up in its texts, smoothed;
a text's score is the mean logarithm of its trigrams' probabilities.  The confidence is the best language's share of the
languages' mean likelihoods, so it doesn't grow with the text's length, and text that no language explains is near an even
share.  Below FLOOR, with fewer than LEAST trigrams, or without Latin letters there is no guess, and an index keeps raw words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOOR, SAMPLE, LEAST = 0.40, 2000, 5
PER_LANGUAGE = 1_000  #: labelled rows of a language that a model is learnt from, at most
GRAMS = 20_000  #: trigrams of a language that a model keeps, the most frequent ones
SMOOTHING = 0.5

_LETTERS = re.compile(r"[^\W\d_]+")
_LATIN = re.compile("[A-Za-zªºÀ-ÖØ-öø-ʸḀ-ỿ]")


def trigrams(text: str) -> np.ndarray:
    """The trigrams of the first SAMPLE characters' words, each as one number."""
    padded = "".join(f"  {w} " for w in _LETTERS.findall(text[:SAMPLE].lower()))
    points = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if len(points) < 3:
        return np.zeros(0, np.int64)
    found = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
    return found[(points[1:-1] != 32)]  # not across words


@dataclass
class LanguageModel:
    languages: list[str]
    grams: np.ndarray  #: sorted
    weights: np.ndarray  #: a row of logarithms for each trigram, and one for unknown ones
    floor: float = FLOOR

    def guess(self, text: str | None) -> tuple[str | None, float | None]:
        """The language and the confidence; ties go to the first code in order."""
        found = trigrams(text or "")
        if not len(self.languages) or len(found) < LEAST or not _LATIN.search(text[:SAMPLE]):
            return None, None
        at = np.minimum(np.searchsorted(self.grams, found), max(len(self.grams) - 1, 0))
        known = self.grams[at] == found if len(self.grams) else np.zeros(len(found), bool)
        means = self.weights[np.where(known, at, len(self.grams))].mean(0)
        share = np.exp(means - means.max())
        best = int(share.argmax())
        confidence = float(share[best] / share.sum())
        return (self.languages[best] if confidence >= self.floor else None), confidence


def _counts(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in frames:
        for lang in set(batch.column("lang").to_pylist()):
            mine = [t for t, c in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True) if c == lang]
            grams, n = np.unique(np.concatenate([trigrams(t or "") for t in mine]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def learnt(labelled: DataFrame, text: str = "text", language: str = "lang", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """A model from at most ``per_language`` labelled rows of each language, those with the smallest hash of their text.

    Rows without a language teach nothing; a table without labelled rows gives a model without languages, which never guesses.
    The driver gets at most GRAMS trigrams of a language.
    """
    rows = labelled.select(F.col(language).cast("string").alias("lang"), F.substring(F.col(text).cast("string"), 1, SAMPLE).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("h", F.xxhash64("text"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))  # a row a language
    # hashes are even, so the smallest come from the lowest share of their range; twice the share that is wanted holds them
    share = F.least(F.lit(1.0), F.lit(2.0 * per_language + 100) / F.col("n"))
    near = rows.join(F.broadcast(sizes), "lang").where(F.col("h").cast("double") / 2.0**64 + 0.5 <= share)
    sample = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= per_language)
    counted = sample.select("lang", "text").mapInArrow(_counts, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    most = counted.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= GRAMS)
    found = most.select("lang", "gram", "n").toPandas()
    languages = sorted(found["lang"].unique())
    grams = np.unique(found["gram"].to_numpy(np.int64))
    n = np.zeros((len(grams) + 1, len(languages)))
    n[np.searchsorted(grams, found["gram"].to_numpy(np.int64)), [languages.index(x) for x in found["lang"]]] = found["n"]
    n += SMOOTHING
    return LanguageModel(languages, grams, np.log(n / n.sum(0)) if languages else n)


def guessed(text: Column, model: LanguageModel) -> Column:
    """language and confidence of each text; only its first SAMPLE characters leave Spark."""

    @F.pandas_udf("struct<language:string,confidence:double>")
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.guess(t) for t in values], columns=["language", "confidence"])

    return run(F.substring(text.cast("string"), 1, SAMPLE))
