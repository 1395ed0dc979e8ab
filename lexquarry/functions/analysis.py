"""Tokens as Column expressions, and the same for single strings in Python."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexquarry.functions.languages import ngram_size

#: A token is a longest run of letters, numbers, connectors and @.
TOKEN_JAVA = r"[\p{L}\p{N}\p{Pc}@]+"
#: The same in Python's re, whose \w is letters, numbers and the underscore; the rest are the other connectors.
TOKEN_PYTHON = re.compile("[\\w@‿⁀⁔︳︴﹍﹎﹏＿]+")
#: Han, kana, Hangul and Thai: tokens with one of these are cut into n-grams.
NGRAM_SCRIPTS = "一-鿿぀-ヿ가-힯฀-๿"
_NGRAM_PYTHON = re.compile(f"[{NGRAM_SCRIPTS}]")


def split_tokens(text: Column) -> Column:
    """Lower-case tokens of a text; null gives none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN_JAVA})"), 1), F.array().cast("array<string>"))


def is_ngram_token(token: Column) -> Column:
    return token.rlike(f"[{NGRAM_SCRIPTS}]")


def ngrams(text: Column, n: int, unigrams: bool = False) -> Column:
    """All runs of ``n`` code points in order, then each code point if ``unigrams``. Shorter texts have no runs."""
    length = F.char_length(text)
    none = F.array().cast("array<string>")
    grams = F.when(length >= n, F.transform(F.sequence(F.lit(1), length - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(none)
    if not unigrams:
        return grams
    singles = F.when(length >= 1, F.transform(F.sequence(F.lit(1), length), lambda i: F.substring(text, i, F.lit(1)))).otherwise(none)
    return F.concat(grams, singles)


def tokenize(text: Column, language: str | None = None, include_unigrams: bool = True) -> Column:
    """Tokens; for Chinese, Japanese, Korean (pairs) and Thai (triples) tokens in those scripts as n-grams."""
    tokens = split_tokens(text)
    n = ngram_size(language)
    if not n:
        return tokens
    grams = F.transform(tokens, lambda t: F.when(is_ngram_token(t), ngrams(t, n, include_unigrams and n == 2)).otherwise(F.array(t)))
    return F.flatten(grams)


def py_split(text: str) -> list[str]:
    return TOKEN_PYTHON.findall(text.lower())


def py_ngrams(text: str, n: int, unigrams: bool = False) -> list[str]:
    return [text[i : i + n] for i in range(len(text) - n + 1)] + (list(text) if unigrams else [])


def py_tokenize(text: str, language: str | None = None, include_unigrams: bool = True) -> list[str]:
    n = ngram_size(language)
    tokens = py_split(text)
    if not n:
        return tokens
    return [g for t in tokens for g in (py_ngrams(t, n, include_unigrams and n == 2) if _NGRAM_PYTHON.search(t) else [t])]


def py_is_ngram_token(token: str) -> bool:
    return bool(_NGRAM_PYTHON.search(token))


def py_offsets(text: str, language: str | None = None, include_unigrams: bool = False) -> list[tuple[str, int]]:
    """(token, offset in code points of the text as it is); for n-gram languages runs of the whole text.

    Lower-casing is done code point by code point, so that offsets hold where a capital becomes two characters.
    """
    n = ngram_size(language)
    low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
    if not n:
        return [(m[0], m.start()) for m in TOKEN_PYTHON.finditer(low)]
    out = [(low[i : i + n], i) for i in range(len(low) - n + 1)]
    if include_unigrams:
        out = sorted(out + [(c, i) for i, c in enumerate(low)], key=lambda x: x[1])
    return out


def token_offsets(text: Column, language: str | None = None, include_unigrams: bool = False) -> Column:
    """``py_offsets`` of a text column: ``array<struct<token:string,offset:int>>``; empty for null."""

    @F.pandas_udf("array<struct<token:string,offset:int>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else [{"token": w, "offset": i} for w, i in py_offsets(t, language, include_unigrams)])

    return cut(text)


def edit_distance(a: str, b: str) -> int:
    """The built-in ``levenshtein`` for two strings on the driver, in code points."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]
