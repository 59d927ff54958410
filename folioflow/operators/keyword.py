"""Keyword retrieval: tokens, postings, BM25.

Postings are rows (group, document, term, frequency); everything else is joins and aggregations on them.  Scoring starts
from the query's few terms, which are broadcast, so a query reads only their postings.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import language
from folioflow.functions.stemming import STEMMERS
from folioflow.scratch import materialise

K1, B, EMPTY_AVERAGE = 1.2, 0.75, 100.0
ACCENTED, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüýÿçñ", "aaaaaaeeeeiiiiooooouuuuyycn"
WORD = r"[\p{L}\p{N}\p{M}_]+"
#: Characters beyond U+009F that NFKC keeps, whatever stands beside them: no decomposition, no mark, nothing that composes
#: with what comes before.
STABLE = (
    "\\u00A1-\\u00A7\\u00A9\\u00AB-\\u00AE\\u00B0\\u00B1\\u00B6\\u00B7\\u00BB\\u00BF-\\u0131\\u0134-\\u013E\\u0141-\\u0148\\u014A-\\u017E\\u0180-\\u01C3"
    "\\u0400-\\u0482\\u048A-\\u052F\\u2010\\u2012-\\u2016\\u2018-\\u2023\\u3041-\\u3096\\u30A1-\\u30FE\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uAC00-\\uD7A3"
)
CHANGED_BY_NFKC = f"(?![\\u0000-\\u009F])[^{STABLE}]"  #: the cheap class first, which most characters fail
MARKS = "[^\\u0000-\\u02FF]"  #: no combining mark comes before
MAY_HOLD_CJK = "[^\\u0000-\\u10FF\\u2000-\\u206F]"  #: also what becomes CJK in NFKC
CJK = "\\u3040-\\u30FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uAC00-\\uD7AF\\uF900-\\uFAFF"


def _beyond_ascii(text: Column) -> Column:
    return F.octet_length(text) > F.length(text)


def nfkc(text: Column) -> Column:
    """``text`` in NFKC, the one step that Spark has no function for.

    Only texts with a character that the form may change are sent to Python; for all others a null goes.  Texts of ASCII
    alone are told by their sizes, without a look at their characters.
    """

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    return F.coalesce(run(F.when(_beyond_ascii(text) & text.rlike(CHANGED_BY_NFKC), text)), text)


def words(text: Column, normalise: bool = True) -> Column:
    """Lower-cased runs of letters, digits, marks and ``_``, in NFKC; marks right after a Latin letter go."""
    base = F.lower(nfkc(text) if normalise else text)
    base = F.when(_beyond_ascii(base) & base.rlike(MARKS), F.regexp_replace(base, r"(?<=\p{IsLatin})\p{Mn}+", "")).otherwise(base)
    return F.regexp_extract_all(base, F.lit(f"({WORD})"), 1)


def cjk_split(word: Column) -> Column:
    """A word's tokens: overlapping bigrams of its CJK runs, and its other runs whole."""
    runs = F.regexp_extract_all(word, F.lit(f"([{CJK}]+|[^{CJK}]+)"), 1)
    bigrams = lambda run: F.when(F.length(run) == 1, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substr(run, i, F.lit(2))))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^[{CJK}]"), bigrams(r)).otherwise(F.array(r))))


def tokens(text: Column, normalise: bool = True) -> Column:
    """All raw tokens; their number is the document's length.  Texts without CJK characters are taken word by word."""
    found = words(text, normalise)
    split = F.flatten(F.transform(found, lambda w: F.when(w.rlike(f"[{CJK}]"), cjk_split(w)).otherwise(F.array(w))))
    return F.when(_beyond_ascii(text) & text.rlike(MAY_HOLD_CJK), split).otherwise(found)


def asked_tokens(spark: SparkSession, query: str, language: str | None = None) -> list[str]:
    """The distinct tokens of a query in order, each followed by its stem in ``language`` where that differs."""
    text = unicodedata.normalize("NFKC", query)
    found = spark.sql("SELECT :q AS text", args={"q": text}).select(tokens(F.col("text"), normalise=False).alias("t")).first()["t"]
    pairs = [[t, stem(t, language)] for t in found]
    return list(dict.fromkeys(x for pair in pairs for x in pair if x is not None))


def stem(term: str, language: str | None) -> str | None:
    """The stem of a term where its language has a stemmer and the stem differs."""
    made = STEMMERS[language](term) if language in STEMMERS else None
    return None if made == term else made


def query_language(query: str) -> str:
    """The language whose stemmer a query takes: the detected one, English where there is none."""
    seen = re.findall(r"[^\W\d_]+", query[: language.SAMPLE].lower())
    hits = {k: sum(w in words for w in seen) for k, words in language.FUNCTION_WORDS.items()}
    best = max(sorted(hits), key=hits.get)
    return best if hits[best] >= language.LEAST and hits[best] >= language.FLOOR * sum(hits.values()) else "en"


def stem_column(term: Column, language: Column) -> Column:
    """The stem of each term; Cyrillic, Greek and Arabic words take their script's language.  Null where there is none."""

    @F.pandas_udf("string")
    def run(values: pd.Series, languages: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for pair in zip(values, languages, strict=True):
            if pair not in known:
                known[pair] = stem(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype=object)

    by_script = F.when(term.rlike("[\\u0400-\\u04FF]"), "ru").when(term.rlike("[\\u0370-\\u03FF]"), "el").when(term.rlike("[\\u0600-\\u06FF\\u0750-\\u077F]"), "ar").otherwise(language)
    return run(term, by_script)


def stems(terms: DataFrame, term: str = "term", language: str = "lang") -> DataFrame:
    """``terms`` with the stem of each term, null where there is none; best applied to distinct terms."""
    return terms.withColumn("stem", stem_column(F.col(term), F.col(language)))


def counted(tokens: Column) -> Column:
    """``tokens`` as an array of term and tf, each distinct token once in order: a row's counts without a shuffle."""
    runs = lambda sorted_: F.filter(F.sequence(F.lit(0), F.greatest(F.array_size(sorted_) - 1, F.lit(0))), lambda i: (i < F.array_size(sorted_)) & ((i == 0) | (F.get(sorted_, i) != F.get(sorted_, i - 1))))
    count = lambda sorted_, starts: F.transform(starts, lambda at, i: F.struct(F.get(sorted_, at).alias("term"), (F.coalesce(F.get(starts, i + 1), F.array_size(sorted_)) - at).cast("bigint").alias("tf")))
    # each step's array is bound to a name, so that it is made once
    bound = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
    return bound(F.sort_array(tokens), lambda sorted_: bound(runs(sorted_), lambda starts: count(sorted_, starts)))


def term_counts(docs: DataFrame, held: Sequence[str], text: str = "text") -> DataFrame:
    """``held``, length and terms (``counted``) of each row, which is tokenised once."""
    cut = docs.select(*held, F.explode(F.array(tokens(F.col(text)))).alias("_t"))
    return cut.select(*held, F.inline(F.array(F.struct(F.array_size("_t").cast("bigint").alias("length"), counted(F.col("_t")).alias("terms")))))


def postings(docs: DataFrame, keys: Sequence[str], text: str = "text", normalise: bool = True, language: str | None = None) -> DataFrame:
    """``keys``, term and tf: how often each raw token occurs in each document.  Documents without tokens have no rows.

    With ``language``, a column of codes, each occurrence counts for its token and, where that differs, for its stem.
    """
    held = [*dict.fromkeys([*keys, *([language] if language else [])])]
    found = docs.select(*held, F.explode(tokens(F.col(text), normalise)).alias("term")).groupBy(*held, "term").agg(F.count("*").alias("tf"))
    if not language:
        return found
    both = F.array_compact(F.array("term", stem_column(F.col("term"), F.col(language))))
    return found.select(*keys, F.explode(both).alias("term"), "tf").groupBy(*keys, "term").agg(F.sum("tf").alias("tf"))


def tf_weight(tf: Column, length: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def idf(n: Column, df: Column) -> Column:
    """ln(1 + (N - df + 0.5) / (df + 0.5)); N and df are those of the same group."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def lengths(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    return docs.select(*keys, F.size(tokens(F.col(text))).cast("bigint").alias("length"))


def average_length(sized: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Mean length and number of documents of each group; a group without tokens counts 100."""
    return sized.groupBy(*group).agg(F.coalesce(F.nullif(F.avg("length"), F.lit(0.0)), F.lit(EMPTY_AVERAGE)).alias("average"), F.count("*").alias("n"))


def _occurrences(term: str) -> Column:
    return F.size("_t") - F.size(F.array_remove("_t", F.lit(term)))


def bm25(docs: DataFrame, query: str, doc: str = "doc_id", group: Sequence[str] = (), text: str = "text", k1: float = K1, b: float = B, stored: bool = False) -> DataFrame:
    """``group``, doc and score of every document that has a term of the query.

    Each of the query's distinct tokens weighs 1.  The average length, N and the document frequencies are those of the
    group.  Each row is tokenised once for the hits and once for the sums: the tokens and the counts stand behind
    generators, below which no filter is pushed.  What is shuffled are the few matching rows and the group's sums.  With
    ``stored`` a row is tokenised once in all: its length and its counts of the query's terms are written to the shared folder.
    """
    asked = asked_tokens(docs.sparkSession, query)
    if not asked:
        return docs.select(*group, doc, F.lit(0.0).alias("score")).limit(0)
    cut = docs.select(*group, doc, F.explode(F.array(tokens(F.col(text)))).alias("_t"))
    numbers = F.struct(F.size("_t").cast("bigint").alias("length"), *[_occurrences(q).alias(f"_{i}") for i, q in enumerate(asked)])
    seen = cut.select(*group, doc, F.inline(F.array(numbers)))
    seen = materialise(seen, "bm25") if stored else seen
    stats = [F.coalesce(F.nullif(F.avg("length"), F.lit(0.0)), F.lit(EMPTY_AVERAGE)).alias("average"), F.count("*").alias("n"), *[F.count_if(F.col(f"_{i}") > 0).alias(f"_d{i}") for i in range(len(asked))]]
    score = sum((F.when(F.col(f"_{i}") > 0, idf(F.col("n"), F.col(f"_d{i}")) * tf_weight(F.col(f"_{i}"), F.col("length"), F.col("average"), k1, b)).otherwise(0.0) for i in range(len(asked))), F.lit(0.0))
    hit = seen.where(" OR ".join(f"_{i} > 0" for i in range(len(asked))))
    sums = seen.groupBy(*group).agg(*stats)
    joined = hit.join(sums, list(group)) if group else hit.join(F.broadcast(sums))
    return joined.select(*group, doc, score.alias("score"))


def bm25_stems(docs: DataFrame, query: str, doc: str = "doc_id", group: Sequence[str] = (), text: str = "text", language: str = "lang", k1: float = K1, b: float = B) -> DataFrame:
    """``bm25`` over tokens and stems: ``group``, doc and score of each document with a token or stem of the query's.

    The query's tokens and their stems in ``query_language`` weigh 1 each; a document's occurrence counts for its token and,
    where that differs, for its stem in the document's language.  Lengths are those of the tokens.  Each row is tokenised
    once; only tokens that share the first letter with something asked (accents aside, no stemmer changes it otherwise) are
    kept, counted, in the shared folder.  Of those each distinct one of a language is stemmed once, and the few that are
    asked, or have an asked stem, meet the rows by a broadcast: a stem has no more forms than its language has endings.
    """
    spark = docs.sparkSession
    asked = asked_tokens(spark, query, query_language(query))
    if not asked:
        return docs.select(*group, doc, F.lit(0.0).alias("score")).limit(0)
    held = [*dict.fromkeys([*group, doc, language])]
    first = lambda term: F.translate(F.substring(term, 1, 1), ACCENTED, PLAIN)
    heads = spark.range(1).select(F.explode(F.array(*map(F.lit, asked))).alias("t")).select(first(F.col("t")).alias("h")).distinct()
    heads = [r["h"] for r in heads.collect()]  # one for each asked term at most
    cut = docs.select(*held, F.explode(F.array(tokens(F.col(text)))).alias("_t"))
    near = F.filter("_t", lambda t: first(t).isin(heads))
    cut = materialise(cut.select(*held, F.inline(F.array(F.struct(F.array_size("_t").cast("bigint").alias("length"), counted(near).alias("near"))))), "stems")
    each = cut.select(*held, "length", F.inline("near"))
    forms = each.select(F.col(language).alias("_lang"), F.col("term").alias("_form")).distinct()
    both = F.array_compact(F.array("_form", stem_column(F.col("_form"), F.col("_lang"))))
    forms = forms.select("_lang", "_form", F.explode(both).alias("_asked")).where(F.col("_asked").isin(asked))
    found = each.join(F.broadcast(forms), each[language].eqNullSafe(forms["_lang"]) & (each["term"] == forms["_form"]))
    found = found.select(*group, doc, "length", F.col("_asked").alias("term"), "tf").groupBy(*group, doc, "length", "term").agg(F.sum("tf").alias("tf"))
    sums = average_length(cut, group)
    df = found.groupBy(*group, "term").agg(F.count("*").alias("df"))  # a row for each group and asked term
    joined = found.join(df, [*group, "term"])
    joined = joined.join(sums, list(group)) if group else joined.join(F.broadcast(sums))
    weight = idf(F.col("n"), F.col("df")) * tf_weight(F.col("tf"), F.col("length"), F.col("average"), k1, b)
    return joined.groupBy(*group, doc).agg(F.sum(weight).alias("score"))


def sparse_vectors(docs: DataFrame, doc: str = "doc_id", text: str = "text", group: Sequence[str] = (), language: str | None = None) -> DataFrame:
    """group, doc, term, tf and weight: the stored part of BM25, against the exact average length.

    A row's tokens are counted within the row; a second look at the texts, for the average, shuffles nothing but sums.

    With ``language`` stems are stored beside the tokens, as in ``postings``; a document's length is that of its tokens.
    """
    held = [*dict.fromkeys([*group, doc, *([language] if language else [])])]
    sized = docs.select(*group, F.array_size(tokens(F.col(text))).cast("bigint").alias("length"))
    return weights(term_counts(docs, held, text), sized, doc, group, language)


def weights(cut: DataFrame, sized: DataFrame, doc: str = "doc_id", group: Sequence[str] = (), language: str | None = None, distinct: bool = False) -> DataFrame:
    """``sparse_vectors`` of counted rows (``term_counts``) and of all rows' lengths; null ones don't count.

    Rows of one document are added up, which takes a shuffle of all postings; ``distinct`` says that there are none such.
    """
    found = cut.select(*cut.columns[:-1], F.inline("terms"))
    if language:
        both = F.array_compact(F.array("term", stem_column(F.col("term"), F.col(language))))
        found = found.select(*group, doc, "length", F.explode(both).alias("term"), "tf")
    if language or not distinct:
        found = found.groupBy(*group, doc, "length", "term").agg(F.sum("tf").alias("tf"))
    average = average_length(sized, group).drop("n")
    joined = found.join(average, list(group)) if group else found.join(F.broadcast(average))
    return joined.select(*group, doc, "term", "tf", tf_weight(F.col("tf"), F.col("length"), F.col("average")).alias("weight"))


def score_postings(stored: DataFrame, query: str, n: int, doc: str = "doc_id", language: str | None = None) -> DataFrame:
    """doc and score from stored weights: the query's terms, with their stems in ``language``, meet their postings.

    Those postings are written to the shared folder, so that weights that aren't stored yet are made for them alone and once.
    """
    asked = asked_tokens(stored.sparkSession, query, language)
    found = materialise(stored.where(F.col("term").isin(asked)).select(doc, "term", "weight"), "asked")
    df = found.groupBy("term").agg(F.count("*").alias("df"))  # a row for each of the query's terms
    return found.join(F.broadcast(df), "term").groupBy(doc).agg(F.sum(idf(F.lit(n), F.col("df")) * F.col("weight")).alias("score"))
