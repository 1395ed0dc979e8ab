"""Size of a text in tokens of the project's public tokenizer, Han and kana taken singly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One token: a character of these two ranges, or a longest run of the word characters outside them.
SINGLE = r"぀-ヿ一-鿿"
TOKEN_JAVA = rf"[{SINGLE}]|[\p{{L}}\p{{N}}\p{{Pc}}@&&[^{SINGLE}]]+"
TOKEN_PYTHON = rf"[{SINGLE}]|(?:(?![{SINGLE}])[\p{{L}}\p{{N}}\p{{Pc}}@])+"


def token_count(text: Column) -> Column:
    """Tokens of ``text``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN_JAVA)), F.lit(0)).cast("bigint")
