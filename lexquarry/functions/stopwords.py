"""Stopwords: lists of this package and Spark's public ones, a file or list of the user's, or the corpus's own most frequent terms."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.functions.stopword_lists import LISTS

# Tags of Spark's default lists, for languages without one here.
DEFAULT_LISTS = {
    "nl": "dutch", "en": "english", "fi": "finnish", "fr": "french", "de": "german", "hu": "hungarian",
    "it": "italian", "no": "norwegian", "pt": "portuguese", "ru": "russian", "es": "spanish", "sv": "swedish", "tr": "turkish",
}


def default_stopwords(language: str) -> list[str]:
    """This package's list for the language, else Spark's, lower-case; empty where there is none."""
    if language in LISTS:
        return sorted(set(LISTS[language].split()))
    from pyspark.ml.feature import StopWordsRemover

    name = DEFAULT_LISTS.get(language)
    return sorted({w.lower() for w in StopWordsRemover.loadDefaultStopWords(name)}) if name else []


def stopwords_from_file(spark: SparkSession, path: str) -> list[str]:
    """One word a line; blank lines and lines that begin with # are skipped."""
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    return sorted({r[0].strip().lower() for r in rows.collect()})


def frequent_terms(lexicon: DataFrame, total_documents: int, share: float = 0.5, at_most: int = 1000) -> list[str]:
    """The terms in more than ``share`` of the documents, the ``at_most`` most frequent of them."""
    top = lexicon.where(F.col("num_docs") > total_documents * share).orderBy(F.col("num_docs").desc(), "term").limit(at_most)
    return [r[0] for r in top.select("term").collect()]


def remove_stopwords(tokens: Column, words: Iterable[str]) -> Column:
    """``tokens`` without stopwords, order and repetition kept. Words are compared as strings, numbers too.

    Written with ``isin``, of which the optimizer makes a hash set.
    """
    known = sorted(set(words))
    if not known:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(known))
