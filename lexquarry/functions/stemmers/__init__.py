"""Suffix-stripping stemmers after the published Snowball descriptions, and stemming of columns.

Columns are stemmed in Arrow UDFs: a batch is dictionary-encoded, only its distinct words reach Python,
and each worker remembers the words it met.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexquarry.errors import QueryError
from lexquarry.functions.stemmers.arabic import stem as arabic
from lexquarry.functions.stemmers.baltic_and_esperanto import esperanto, lithuanian
from lexquarry.functions.stemmers.dutch import stem as dutch
from lexquarry.functions.stemmers.english import stem as english
from lexquarry.functions.stemmers.german import stem as german
from lexquarry.functions.stemmers.nordic import danish, norwegian, swedish
from lexquarry.functions.stemmers.others import armenian, hindi, indonesian, irish, nepali
from lexquarry.functions.stemmers.polish import stem as polish
from lexquarry.functions.stemmers.romance import french, italian, portuguese, spanish
from lexquarry.functions.stemmers.romanian import stem as romanian
from lexquarry.functions.stemmers.russian import stem as russian
from lexquarry.functions.stemmers.turkish import stem as turkish
from lexquarry.functions.stemmers.uralic import finnish, hungarian

STEMMERS: dict[str, Callable[[str], str]] = {
    "ar": arabic,
    "da": danish,
    "de": german,
    "en": english,
    "eo": esperanto,
    "es": spanish,
    "fi": finnish,
    "fr": french,
    "ga": irish,
    "hi": hindi,
    "hu": hungarian,
    "hy": armenian,
    "id": indonesian,
    "it": italian,
    "lt": lithuanian,
    "ne": nepali,
    "nl": dutch,
    "no": norwegian,
    "pl": polish,
    "pt": portuguese,
    "ro": romanian,
    "ru": russian,
    "sv": swedish,
    "tr": turkish,
}


@lru_cache(500_000)
def stem_word(word: str, language: str | None) -> str:
    """The stem of a lower-case word; the word itself where the language has no stemmer."""
    f = STEMMERS.get(language or "")
    return f(word) if f else word


def _stem_words(words: pa.Array, language: str) -> pa.Array:
    """Stems of an array of words; each distinct word of the array is looked at once."""
    coded = words.dictionary_encode()
    stems = pa.array([None if w is None else stem_word(w, language) for w in coded.dictionary.to_pylist()], pa.string())
    return stems.take(coded.indices)


def _known(language: str | None) -> str:
    if language not in STEMMERS:
        raise QueryError(f"no stemmer for language {language!r}")
    return language


def stem_column(word: Column, language: str | None) -> Column:
    """Stems of a column of lower-case words; null stays null."""
    language = _known(language)

    @F.arrow_udf("string")
    def stems(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for words in batches:
            yield _stem_words(words, language)

    return stems(word)


def stem_tokens(tokens: Column, language: str | None) -> Column:
    """Stems of a column of token lists without nulls."""
    language = _known(language)

    @F.arrow_udf("array<string>")
    def stems(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield pa.ListArray.from_arrays(lists.offsets, _stem_words(lists.values, language))

    return stems(tokens)
